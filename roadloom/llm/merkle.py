"""Merkle manifest of a dataset: leaves, subroots of groups, one root, and for every row the siblings that prove it.

A node is a digest as 64 hex characters. Aligned blocks of fanout ** height nodes keep each of their levels as one string of
digests, so parents are hashes of fixed-width substrings and a node's siblings are the substrings beside it in its run. The roots
of the blocks are the nodes of the next round; a group is done when one node is left. Nothing but SQL functions is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.shared import materialize
from roadloom.llm.text import crc_mod, read

WIDTH = 64
FANOUT = 16
#: Levels that one block holds: blocks of 256 nodes are 16 KB strings, and many enough to spread a small table.
HEIGHT = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def row_hash(columns: list[Column]) -> Column:
    """Lowercase hex sha256 of the values one after the other: `-` for null, else the value's UTF-8 byte count, `:` and the value."""
    parts = []
    for c in columns:
        v = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(node: Column, path: Column) -> Column:
    """The root above a node: along the path, the digest of the siblings to the left, the node and those to the right, run together."""
    return F.aggregate(path, node, lambda at, s: F.sha2(F.concat(s["l"], at, s["r"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path from the bottom up, left to right, as one string of digests."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def place(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows plus pos, their place within the group from 0, and n, the group's rows.

    Rows are dealt by ranges of (group, order), so a group of any size spreads over many tasks, equal rows included; each task
    counts its own, and the counts, one row a task and group, are summed before it.
    """
    # The sort stands below the numbers: a task numbers its rows in their order, with the task in the upper 31 bits.
    by = [F.col(group), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)), "merkle-order")
    counts = dealt.groupBy(group, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = W.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(group, "_task", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n"))
    return dealt.join(counts, [group, "_task"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def _parents(level: Column, fanout: int) -> Column:
    """The level above: digests of runs of fanout nodes, the last run may be shorter."""
    run = fanout * WIDTH
    starts = F.sequence(F.lit(0), F.ceil(F.length(level) / run).cast("int") - 1)
    return F.array_join(F.transform(starts, lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), "")


def blocks_of(nodes: DataFrame, group: str, carry: list[str], fanout: int, height: int) -> DataFrame:
    """(group, n, block, items, l0, l1, .., top) of nodes (group, n, pos, node, carry ..): items in order, each level as a string.

    A group of one block stops at the level where one node is left (further levels are null); blocks of larger groups go up height
    levels, whatever they hold.
    """
    size = fanout**height
    items = F.sort_array(F.collect_list(F.struct("pos", "node", *carry)))
    b = nodes.groupBy(group, "n", F.floor(F.col("pos") / size).alias("block")).agg(items.alias("items"))
    b = b.withColumn("l0", F.array_join(F.transform("items", lambda x: x["node"]), ""))
    for k in range(height):
        more = F.length(f"l{k}") > F.when(F.col("n") > size, 0).otherwise(WIDTH)
        b = b.withColumn(f"l{k + 1}", F.when(more, _parents(F.col(f"l{k}"), fanout)))
    return b.withColumn("top", F.coalesce(*[F.col(f"l{k}") for k in range(height, -1, -1)]))


def _path(i: Column, fanout: int, height: int) -> Column:
    """Siblings of node i of a block, level by level, as (l, r); levels that the block doesn't have give none."""
    steps = []
    for k in range(height):
        at = F.floor(i / fanout**k)
        first = F.floor(at / fanout) * fanout
        left = F.substring(F.col(f"l{k}"), (first * WIDTH + 1).cast("int"), ((at - first) * WIDTH).cast("int"))
        right = F.substring(F.col(f"l{k}"), ((at + 1) * WIDTH + 1).cast("int"), ((first + fanout - 1 - at) * WIDTH).cast("int"))
        steps.append(F.when(F.col(f"l{k + 1}").isNotNull(), F.struct(left.alias("l"), right.alias("r"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _open(blocks: DataFrame, group: str, carry: list[str], above: DataFrame | None, kept: list[str], fanout: int, height: int) -> DataFrame:
    """Nodes of blocks with their whole path: (group, pos, node, carry .., path, top, kept ..). above has the paths of the blocks themselves
    by (group, block); without it, each block is a whole group."""
    tail = F.array().cast("array<struct<l:string,r:string>>")
    b = blocks.withColumn("_tail", tail) if above is None else blocks.drop("top").join(above, [group, "block"], "inner")
    levels = [f"l{k}" for k in range(height + 1)]
    e = b.select(group, *levels, "_tail", "top", *kept, F.posexplode("items").alias("_i", "_x"))
    return e.select(group, "_x.pos", "_x.node", *[f"_x.{c}" for c in carry], F.concat(_path(F.col("_i"), fanout, height), F.col("_tail")).alias("path"), "top", *kept)


def tree(placed: DataFrame, group: str, carry: list[str], fanout: int = FANOUT, height: int = HEIGHT) -> tuple[DataFrame, list[DataFrame]]:
    """(roots, rounds) of nodes (group, n, pos, node, carry ..): roots (group, top) has one row a group, rounds the stored blocks from the
    bottom up, each round as many times smaller as a block holds nodes."""
    rounds, size = [materialize(blocks_of(placed, group, carry, fanout, height), "merkle-blocks")], fanout**height
    while rounds[-1].where(F.col("n") > size).limit(1).count():
        last = rounds[-1].where(F.col("n") > size)
        up = last.select(group, F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("pos"), F.col("top").alias("node"))
        rounds.append(materialize(blocks_of(up, group, [], fanout, height), "merkle-blocks"))
    roots = rounds[0].where(F.col("n") <= size).select(group, "top")
    for r in rounds[1:]:
        roots = roots.union(r.where(F.col("n") <= size).select(group, "top"))
    return roots, rounds


def paths(rounds: list[DataFrame], group: str, carry: list[str], above: DataFrame | None = None, kept: list[str] | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """Every node of the lowest round with its path to the group's root or, with above (group, _tail, kept ..), on to what lies above it."""
    size, kept, found = fanout**height, kept or [], None
    for k in range(len(rounds) - 1, -1, -1):
        whole = rounds[k].where(F.col("n") <= size)
        mine = carry if k == 0 else []
        if above is None:
            done = _open(whole, group, mine, None, kept, fanout, height)
        else:
            done = _open(whole, group, mine, above.withColumn("block", F.lit(0).cast("long")), kept, fanout, height)
        if found is not None:
            tails = found.select(group, F.col("pos").alias("block"), F.col("path").alias("_tail"), "top", *kept)
            done = done.union(_open(rounds[k].where(F.col("n") > size), group, mine, tails, kept, fanout, height))
        found = done
    return found


def merkle_manifest(rows: DataFrame, key: str, group: str, columns: list[str], changed: Column | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """(key, leaf, changed, subroot, root, path) of all rows: path leads from the row's leaf over its group's subroot to the root.

    A leaf is row_hash of the columns. Within a group leaves ascend by key (null first; equal keys by leaf, repeated rows in any order),
    groups ascend by name (null first, bytewise) and their subroots are the leaves of the root's tree. While a tree has several nodes,
    each run of fanout, the last perhaps shorter, becomes the digest of its digests. changed is a hash that is carried along, such as that
    of a row to be held against the manifest; by default the leaf. Other columns are ignored, an empty table gives no rows. Texts are
    hashed where they are read; digests alone are shuffled.
    """
    leaf = row_hash([F.col(c) for c in columns])
    # Names in order, null first: '-' sorts before ':'.
    name = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit("-"))
    leaves = rows.select(F.col(key).alias("_key"), name.alias("_group"), leaf.alias("node"), (leaf if changed is None else changed).alias("changed"))
    leaves = materialize(leaves, "merkle-leaves")
    carry = ["_key", "changed"]
    subroots, rounds = tree(place(leaves, "_group", ["_key", "node"]), "_group", carry, fanout, height)
    top = place(subroots.select(F.lit("").alias("_all"), "_group", F.col("top").alias("node")), "_all", ["_group"])
    _, over = tree(top, "_all", ["_group"], fanout, height)
    above = paths(over, "_all", ["_group"], fanout=fanout, height=height)
    above = above.select("_group", F.col("path").alias("_tail"), F.col("node").alias("subroot"), F.col("top").alias("root"), F.col("top"))
    out = paths(rounds, "_group", carry, above, ["subroot", "root"], fanout, height)
    return out.select(F.col("_key").alias(key), F.col("node").alias("leaf"), "changed", "subroot", "root", "path")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of documents by source, each row held against it after the lower-casing of every fifth one's text (by crc32 of the id;
    a row without id is left as it is)."""
    docs = read(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = [F.translate(c, UPPER, LOWER) if c == "text" else F.col(c) for c in columns]
    changed = F.when(crc_mod(F.col("doc_id"), 5) == 0, row_hash(lowered)).otherwise(row_hash([F.col(c) for c in columns]))
    m = merkle_manifest(docs, "doc_id", "source", columns, changed)
    m = m.withColumn("proof_sha256", F.sha2(siblings(F.col("path")), 256)).withColumn("folded_root", fold(F.col("changed"), F.col("path")))
    return m.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _part(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


ORACLE_OP11 = f"""
with recursive docs as (
  select *, translate(text, '{UPPER}', '{LOWER}') low,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) crc
  from documents
), leaves as (
  select doc_id, source, sha256({" || ".join(_part(c) for c in ["doc_id", "source", "lang", "n_chars", "text"])}) leaf,
    case when crc % 5 = 0 then sha256({" || ".join(_part(c) for c in ["doc_id", "source", "lang", "n_chars", "low"])}) end changed
  from docs
), placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by source) n from leaves
), nodes as (
  select 0 lvl, source, pos, n, leaf node from placed
  union all
  select lvl + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' order by pos)) from nodes where n > 1 group by lvl, source, pos // 16, n
), runs as (
  select lvl, source, pos // 16 run, string_agg(node, '' order by pos) run_nodes from nodes where n > 1 group by lvl, source, pos // 16
), subroots as (
  select source, node subroot, row_number() over (order by source nulls first) - 1 pos, count(*) over () n from nodes where n = 1
), tops as (
  select 0 lvl, pos, n, subroot node from subroots
  union all
  select lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' order by pos)) from tops where n > 1 group by lvl, pos // 16, n
), top_runs as (
  select lvl, pos // 16 run, string_agg(node, '' order by pos) run_nodes from tops where n > 1 group by lvl, pos // 16
), root as (
  select node root from tops where n = 1
), steps as (
  select p.source, p.pos, r.lvl, r.run_nodes, (p.pos // (16 ** r.lvl)::bigint) % 16 spot
  from placed p join runs r on r.source is not distinct from p.source and r.run = p.pos // (16 ** (r.lvl + 1))::bigint
  union all
  select p.source, p.pos, 100 + r.lvl, r.run_nodes, (s.pos // (16 ** r.lvl)::bigint) % 16
  from placed p join subroots s on s.source is not distinct from p.source join top_runs r on r.run = s.pos // (16 ** (r.lvl + 1))::bigint
), proofs as (
  select source, pos, list(substr(run_nodes, 1, spot * 64) || '|' || substr(run_nodes, spot * 64 + 65) order by lvl) steps from steps group by source, pos
), done as (
  select p.doc_id, p.leaf, s.subroot, t.root, sha256(coalesce(replace(array_to_string(x.steps, ''), '|', ''), '')) proof_sha256,
    list_reduce(list_prepend(coalesce(p.changed, p.leaf), coalesce(x.steps, [])), lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) folded_root
  from placed p join subroots s on s.source is not distinct from p.source cross join root t
  left join proofs x on x.source is not distinct from p.source and x.pos = p.pos
)
select *, folded_root = root verified from done
"""
