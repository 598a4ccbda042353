"""The Merkle manifest against a plain one, over odd rows and several shapes of tree."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from roadloom.llm.merkle import fold, merkle_manifest, op11_merkle, row_hash, siblings

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("source", StringType()), StructField("text", StringType()), StructField("path", StringType())])
COLUMNS = ["doc_id", "source", "text"]


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """(root, siblings of each node as a list of (left, right))"""
    at, own = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, a in enumerate(at):
            s = a // fanout * fanout
            own[i].append(("".join(nodes[s:a]), "".join(nodes[a + 1 : s + fanout])))
            at[i] = a // fanout
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], own


def plain(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), leaf(r[:3]), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climb([x[1] for x in sorted(groups[g])], fanout) for g in names}
    root, over = climb([tops[g][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for x, p in zip(sorted(groups[g]), tops[g][1]):
            out.append((x[2], x[1], tops[g][0], root, h("".join(a + b for a, b in p + over[k]))))
    return sorted(out, key=str)


def odd_rows():
    rows = [(i, "hot", f"text {i}", "x") for i in range(300)] + [(i, f"s{i:03d}", "Ab" * i, None) for i in range(40)]
    rows += [(None, "hot", None, None), (7, "hot", "text 7", "x"), (7, "hot", "other", "y"), (1, None, "", None), (2, None, "é€😀", None), (3, "Z", "x" * 300_000, None), (-4, "é", "\n|:-", None)]
    return rows


@pytest.mark.parametrize("fanout,height", [(16, 2), (2, 1), (2, 3), (3, 2)])
def test_manifest_like_plain_trees(spark, fanout, height):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)
    m = merkle_manifest(df, "doc_id", "source", COLUMNS, fanout=fanout, height=height)
    got = m.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256), fold(F.col("leaf"), F.col("path")).alias("up")).collect()
    assert all(r.up == r.root for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain(odd_rows(), fanout)


def test_changed_row_does_not_fold_to_the_root(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    changed = F.when(F.col("doc_id") == 5, row_hash([F.col("doc_id"), F.col("source"), F.lit("other")])).otherwise(row_hash([F.col(c) for c in COLUMNS]))
    m = merkle_manifest(df, "doc_id", "source", COLUMNS, changed)
    bad = m.where(fold(F.col("changed"), F.col("path")) != F.col("root")).select("doc_id").collect()
    assert [r.doc_id for r in bad] == [5, 5]


def test_lone_row_and_empty_table(spark):
    one = spark.createDataFrame([(1, "a", "t", None)], SCHEMA)
    r = merkle_manifest(one, "doc_id", "source", COLUMNS).collect()[0]
    assert r.leaf == r.subroot == r.root == leaf((1, "a", "t")) and r.path == []
    assert merkle_manifest(one.where("false"), "doc_id", "source", COLUMNS).count() == 0


def test_query_without_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int, leaf string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert op11_merkle(spark, str(tmp_path)).count() == 0
