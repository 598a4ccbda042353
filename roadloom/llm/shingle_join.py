"""Exact Jaccard self-join of word shingle sets, size-aware (after Deng, Tao and Li, 2018), for classes of linked documents.

Sets below a size boundary are light: they emit all their subsets of the size that a partner must share, so that equal
subsets are links without further checks. All other pairs go through inverted lists over each set's rarest shingles
(as many as a partner must meet), followed by an exact count of the intersection. The boundary is the one of least
estimated cost. Rarity comes from a fixed-size count sketch of all shingles; it orders the lists and never decides a link.

Only classes are asked for, so equal sets are collapsed, a list links its members to its most central one first, and a
second pass compares only members of different classes. That pass is complete: no link between two classes is lost.
"""

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.shared import forget, materialize
from roadloom.llm.words import bound_batches, lean, split_texts, text_blocks
from roadloom.operators.components import connected_components

CELLS = 1 << 19
SLOT = 4096
#: The boundary search looks at set sizes up to this one; larger sets go through lists, so it loses nothing.
LIGHT_MAX = 24
BLOCK = 512
FIELD_BITS = 1 << 24
TOKEN_BITS = 1 << 24
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each whole text, in order; see shingle_classes for words. Texts are those of a block."""
    from xxhash import xxh3_64_intdigest

    offsets, codes, distinct = split_texts(texts, lambda t: pc.ascii_split_whitespace(pc.ascii_lower(t)))
    hashes = np.fromiter((xxh3_64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))
    w = hashes[codes]
    h = np.zeros(max(len(w) - size + 1, 0), np.uint64)
    for i in range(size):
        h += w[i : len(h) + i] * _MULT[i % 8] + np.uint64(i // 8)
    h = mix(h)
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n = z - a
        if n >= size:
            yield np.unique(h[a : z - size + 1])
        elif n:
            yield mix((w[a:z] * np.array([_MULT[i % 8] for i in range(n)])).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            yield h[:0]


def set_id(s: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _lists(arrays: list) -> pa.Array:
    """A list array of int64 from numpy arrays; None is null."""
    ends = np.cumsum([0, *[0 if x is None else len(x) for x in arrays]])
    flat = np.concatenate([np.zeros(0, np.int64), *[x.astype(np.int64) for x in arrays if x is not None]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([x is None for x in arrays], pa.bool_()))


def overlap(n: int, m: int, pct: int) -> int:
    """Least intersection of linked sets of n and m shingles: 100 i >= pct (n + m - i)."""
    return -(-pct * (n + m) // (100 + pct))


def prefix_length(n: int, pct: int) -> int:
    return n - -(-pct * n // 100) + 1


def count_sketch(docs: DataFrame, text: str, size: int, shares: int = 256) -> np.ndarray:
    """Occurrences per cell over all documents, a shingle counting once a document. CELLS numbers, at any input size."""

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, part in text_blocks(batch, "t"):
                sets = list(shingle_sets(part.column("t"), size))
                total += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        slots = [s for s in range(CELLS // SLOT) if total[s * SLOT : (s + 1) * SLOT].any()]
        at = [np.flatnonzero(total[s * SLOT : (s + 1) * SLOT]) for s in slots]
        cells = [a.astype("<u2").tobytes() for a in at], [total[s * SLOT + a].astype("<u4").tobytes() for s, a in zip(slots, at)]
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(cells[0], pa.binary()), pa.array(cells[1], pa.binary())], names=["slot", "at", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(SLOT, np.int64)
        for a, n in zip(pdf["at"], pdf["n"]):
            out[np.frombuffer(a, "<u2")] += np.frombuffer(n, "<u4")
        at = np.flatnonzero(out)
        return pd.DataFrame({"slot": pdf["slot"].iloc[:1], "at": [at.astype("<u2").tobytes()], "n": [np.minimum(out[at], 2**32 - 1).astype("<u4").tobytes()]})

    schema = "slot int, at binary, n binary"
    rows = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(lean(count), schema)
    # Two levels, so that a group holds the rows of a share of the tasks, or one row a share.
    part = F.pmod(F.floor(F.spark_partition_id() / 64), F.lit(shares))
    first = rows.withColumn("share", part).groupBy("slot", "share").applyInPandas(lambda pdf: add(pdf[["slot", "at", "n"]]), schema)
    total = np.zeros(CELLS, np.int64)
    for r in first.groupBy("slot").applyInPandas(add, schema).collect():
        total[r["slot"] * SLOT + np.frombuffer(r["at"], "<u2").astype(np.int64)] = np.frombuffer(r["n"], "<u4")
    return total


def describe_sets(docs: DataFrame, key: str, text: str, size: int, pct: int, sketch: np.ndarray) -> DataFrame:
    """(key, sid, n, score, scan, prefix, small, last_level): sid names the set (null if empty); prefix holds its rarest shingles in
    the global order (sketch level, hash), last_level the level of its last one; score says how common its shingles are, scan how long its lists; small holds
    all shingles of sets up to LIGHT_MAX."""
    level = np.log2(np.maximum(sketch, 1)).astype(np.uint8)
    spare = np.maximum(sketch - sketch.mean(), 1).astype(np.float32)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, part in text_blocks(batch, "t"):
                rows = []
                for s in shingle_sets(part.column("t"), size):
                    n = len(s)
                    if not n:
                        rows.append((None, 0, 0.0, 0.0, None, None, 0))
                        continue
                    cell = (s & np.uint64(CELLS - 1)).astype(np.int64)
                    lv = level[cell]
                    order = np.argsort(lv, kind="stable")[: prefix_length(n, pct)]  # s is sorted: ties by hash
                    rows.append((set_id(s), n, float(lv.mean()), float(spare[cell[order]].sum()), s[order], s if n <= LIGHT_MAX else None, int(lv[order[-1]])))
                sid, n, score, scan, prefix, small, last = zip(*rows)
                arrays = [part.column("k"), pa.array(sid, pa.int64()), pa.array(n, pa.int32()), pa.array(score, pa.float64()), pa.array(scan, pa.float64()), _lists(prefix), _lists(small), pa.array(last, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "sid", "n", "score", "scan", "prefix", "small", "last_level"])

    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(lean(run), f"key {kind}, sid long, n int, score double, scan double, prefix array<long>, small array<long>, last_level int")


def subsets_of(n: int, m: int, pct: int) -> int:
    """Subsets that a set of n emits for partners of m; 0 if such sets can't link."""
    o = overlap(n, m, pct)
    return comb(n, o) if o <= min(n, m) else 0


def choose_boundary(sizes: dict[int, tuple[int, float]], pct: int, limit: int = LIGHT_MAX) -> int:
    """The boundary x (sets below x are light) of least cost: subsets emitted by light sets against list entries sent
    and scanned for the others. sizes: n -> (number of sets, length of all their lists)."""
    def cost(x):
        light = sum(c * sum(subsets_of(n, m, pct) for m in range(1, x)) for n, (c, _) in sizes.items() if n < x)
        return light + sum(c * prefix_length(n, pct) + s for n, (c, s) in sizes.items() if n >= -(-pct * x // 100))

    return min(range(1, limit + 2), key=lambda x: (cost(x), -x))


def light_links(sets: DataFrame, boundary: int, pct: int) -> DataFrame:
    """Edges (src, dst) that join all light sets which share a subset of the size their two sizes ask for.

    A subset is known by the sum of its shingles' 128-bit hashes, of which no two subsets are expected to share one."""

    def emit(batches):
        cols, low = ["subset", "subset2", "lo", "hi", "n", "sid"], 2**64 - 1
        for b in batches:
            rows = []
            for sid, n, s in zip(b["sid"], b["n"], b["small"]):
                t = np.asarray(s, np.int64).astype(np.uint64)
                t = [(x << 64) | y for x, y in zip(mix(t).tolist(), mix(t * _MULT[0] + _MULT[1]).tolist())]
                whole = sum(t)
                for m in range(1, boundary):
                    o = overlap(n, m, pct)
                    if o > min(n, m):
                        continue
                    for gone in combinations(t, int(n) - o):
                        key = whole - sum(gone)
                        rows.append((((key >> 64) & low) - 2**63, (key & low) - 2**63, min(n, m), max(n, m), n, sid))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=cols)
                    rows = []
            yield pd.DataFrame(rows, columns=cols).astype("int64")

    got = sets.where(F.col("n") < boundary).select("sid", "n", "small").mapInPandas(lean(emit), "subset long, subset2 long, lo int, hi int, n int, sid long")
    keys = ["subset", "subset2", "lo", "hi"]
    hubs = got.groupBy(*keys).agg(F.min("sid").alias("hub"), F.max("sid").alias("last"), F.min("n").alias("a"), F.max("n").alias("b"))
    hubs = hubs.where("hub <> last and (lo = hi or a <> b)").select(*keys, "hub")
    return got.join(hubs, keys).where("sid <> hub").select(F.col("sid").alias("src"), F.col("hub").alias("dst")).distinct()


def bit_field(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """Field of `bits` bits with those of the column's values set; its size doesn't depend on the input. See in_field."""
    return _field(values.select(F.pmod(F.xxhash64(column), F.lit(bits)).alias("p")), bits)


def _field(at: DataFrame, bits: int) -> np.ndarray:
    rows = at.groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits")).toPandas()
    field = np.zeros(bits // 64, np.uint64)
    field[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint64)
    return field


def in_field(field: np.ndarray, p: np.ndarray) -> np.ndarray:
    return ((field[p // 64] >> (p % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)


def shared_entries(reps: DataFrame, least: int, bits: int = TOKEN_BITS) -> DataFrame:
    """Inverted-list entries (token, sid, n, score, pos) of the sets of `least` shingles or more, without the tokens that
    one set alone has in its prefix.

    Most tokens are such, so tokens are counted first; a bit field of fixed size then drops most lone entries before the
    lists are dealt out. Entries that it lets pass wrongly fall out in the join with the lists' heads.
    """
    heavy = reps.where(F.col("n") >= least)
    counted = heavy.select(F.explode("prefix").alias("token")).groupBy("token").count().where("count > 1")
    field = _field(counted.select(F.pmod("token", F.lit(bits)).alias("p")), bits)

    def keep(batches):
        for b in batches:
            if not len(b):
                continue
            lens = b["prefix"].map(len).to_numpy()
            token = np.concatenate(b["prefix"].to_list())
            pos = np.arange(len(token)) - np.repeat(np.cumsum(lens) - lens, lens)
            row = np.repeat(np.arange(len(b)), lens)
            ok = in_field(field, (token % bits + bits) % bits)
            row = row[ok]
            yield pd.DataFrame({"token": token[ok], "sid": b["sid"].to_numpy()[row], "n": b["n"].to_numpy()[row], "score": b["score"].to_numpy()[row], "pos": pos[ok]})

    return heavy.select("sid", "n", "score", "prefix").mapInPandas(lean(keep), "token long, sid long, n int, score double, pos int")


def picked(rows: DataFrame, column: str, wanted: DataFrame, schema: str) -> DataFrame:
    """rows (columns as in schema) whose column may be among wanted's: a bit field test ahead of a shuffled join."""
    field = bit_field(wanted, column, FIELD_BITS)

    def keep(batches):
        for b in batches:
            yield b[in_field(field, b["p"].to_numpy(np.int64))].drop(columns="p")

    return rows.withColumn("p", F.pmod(F.xxhash64(column), F.lit(FIELD_BITS))).mapInPandas(lean(keep), schema)


def plausible(pairs: DataFrame, reps: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) whose prefixes have enough in common. Beyond the prefix that ends first in the global order nothing
    of it can be in the other prefix, so the intersection is at most the common prefix plus what is left of that set."""
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    few = picked(reps.select("sid", "n", "prefix", "last_level"), "sid", ends, "sid long, n int, prefix array<long>, last_level int")
    side = lambda x: few.select(*[F.col(c).alias(f"{c}_{x}") for c in few.columns]).withColumnRenamed(f"sid_{x}", x)
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # Tokens are ordered as unsigned numbers within a level.
    last = lambda x: f"struct(last_level_{x}, element_at(prefix_{x}, -1) ^ -9223372036854775808L)"
    rest = f"case when {last('a')} <= {last('b')} then n_a - size(prefix_a) else n_b - size(prefix_b) end"
    return both.where(F.expr(f"({100 + pct}) * (size(array_intersect(prefix_a, prefix_b)) + {rest}) >= {pct} * (n_a + n_b)")).select("a", "b")


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str, size: int, pct: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets link: those with plausible prefixes, by their exact intersection.

    Sets are made again from the texts of those documents that stand for a set in a pair. A bit field of fixed size picks
    them out of all documents before anything is shuffled; where it is full it lets more pass, which the join drops.
    """
    pairs = materialize(plausible(pairs, reps, pct), "join-pairs")
    need = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct().join(reps.select("sid", "rep"), "sid")
    field = bit_field(need, "rep", FIELD_BITS)

    def tokens(batches):
        for batch in batches:
            wanted = batch.filter(pa.array(in_field(field, batch.column("p").to_numpy(zero_copy_only=False))))
            for _, part in text_blocks(wanted, "t"):
                sets = [s for s in shingle_sets(part.column("t"), size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), _lists(sets)], names=["sid", "tokens"])

    made = docs.where(F.col(key).isNotNull()).select(F.col(text).cast("string").alias("t"), F.pmod(F.xxhash64(key), F.lit(FIELD_BITS)).alias("p")).mapInArrow(lean(tokens), "sid long, tokens array<long>")
    made = materialize(made, "join-sets")
    one = pairs.join(made.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), "a")
    both = one.join(made.select(F.col("sid").alias("b"), F.col("tokens").alias("tb")), "b")
    i, u = F.size(F.array_intersect("ta", "tb")), F.size("ta") + F.size("tb")
    # Stored ahead of distinct, so that Spark may split the join's hot keys.
    linked = materialize(both.where((100 + pct) * i >= pct * u).select("a", "b"), "join-linked")
    forget(pairs, made)
    return linked.distinct()


def list_pairs(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (columns of the left member, those of the right one with a 2 behind) of different members (token, sid, ...) of each list.

    Long lists are cut in blocks of about `block` members, and each two blocks meet under a key of their own, so no task
    holds a list."""
    members = materialize(members, "join-members")
    sizes = materialize(members.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"), "join-sizes")
    dealt = members.join(sizes, "token").withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).withColumn("i", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    dealt = dealt.drop("m").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = dealt.where("i <= j").withColumn("lo", F.col("i")).withColumn("hi", F.col("j")).drop("i", "j", "blocks")
    right = dealt.where("j <= i").select("token", *[F.col(c).alias(f"{c}2") for c in members.columns if c != "token"], F.col("j").alias("lo"), F.col("i").alias("hi"))
    return left.join(right, ["token", "lo", "hi"]).where("lo < hi or sid < sid2").drop("lo", "hi")


def _fits(pct: int, n: str, m: str, p: str, q: str) -> str:
    """SQL: sets of n and m shingles that have a shingle at places p and q of their prefixes may still link."""
    need = f"cast(ceil({pct} * ({n} + {m}) / {100.0 + pct} - 1e-9) as int)"
    return f"100 * least({n}, {m}) >= {pct} * greatest({n}, {m}) and least({n} - {p}, {m} - {q}) >= {need}"


def _described(docs: DataFrame, key: str, text: str, size: int, pct: int) -> tuple[DataFrame, DataFrame]:
    """(described rows of docs, one row per distinct set with rep, the least key that has it), both stored."""
    bound_batches(docs.sparkSession)
    sketch = count_sketch(docs, text, size)
    rows = materialize(describe_sets(docs, key, text, size, pct, sketch), "join-docs")
    reps = rows.where("sid is not null").groupBy("sid").agg(F.min("key").alias("rep"), *[F.first(c).alias(c) for c in ("n", "score", "scan", "prefix", "small", "last_level")])
    reps = materialize(reps, "join-reps")
    few = materialize(rows.select("key", "sid", "n"), "join-keys")
    forget(rows)  # the prefixes are in reps, once a set
    return few, reps


def shingle_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, pct: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, as (pairs, members): pairs (rep_a, rep_b) of representatives, members (key, n_shingles, rep).

    A representative is the least non-null key of the rows with one set, so copies are members of one representative and
    are not expanded into pairs. Words, shingles and the rule are those of shingle_classes; empty sets have a null rep.
    All pairs of a list are looked at, in blocks: the work grows with the links and near links that there are. Rows that
    share a key and have different texts are members of each of their sets; pairs of a representative with itself are left out.
    """
    rows, reps = _described(docs, key, text, size, pct)
    lists = shared_entries(reps, 1).select("token", "sid", "n", "pos")
    found = list_pairs(lists).where(F.expr(_fits(pct, "n", "n2", "pos", "pos2")))
    found = materialize(found.select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct(), "join-cross")
    linked = confirmed(found, reps, docs, key, text, size, pct)
    ids = reps.select("sid", "rep")
    named = linked.join(ids.select(F.col("sid").alias("a"), F.col("rep").alias("x")), "a").join(ids.select(F.col("sid").alias("b"), F.col("rep").alias("y")), "b")
    pairs = named.where("x <> y").select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b")).distinct()
    members = rows.select(F.col("key").alias(key), "sid", F.col("n").cast("long").alias("n_shingles")).join(ids, "sid", "left").select(key, "n_shingles", "rep")
    return pairs, members


def shingle_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, pct: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) per row of docs: classes of documents linked by Jaccard >= pct / 100.

    Texts are lower-cased in A-Z and split at ASCII white space. A set holds the distinct shingles of `size` words; shorter
    texts have their whole sequence as one; null texts and texts without words have an empty set and link with nothing.
    component_id is the smallest key reachable by links. Rows with one key and different texts share their links; rows
    with a null key belong to no class but their set's smallest non-null key. Repeated rows have equal results; an empty
    table gives an empty result; columns other than key and text are not read. Keys are of any type that has an order.
    Sets are known by 64-bit hashes of their sorted shingles' hashes. For the links themselves see shingle_pairs.
    """
    rows, reps = _described(docs, key, text, size, pct)
    sizes = {r["n"]: (r["c"], r["s"]) for r in reps.where(F.col("n") <= LIGHT_MAX).groupBy("n").agg(F.count("*").alias("c"), F.sum("scan").alias("s")).collect()}
    boundary = choose_boundary(sizes, pct)
    light = materialize(light_links(reps, boundary, pct), "join-light")

    entries = shared_entries(reps, -(-pct * boundary // 100))
    entries = materialize(entries, "join-entries")
    hubs = entries.groupBy("token").agg(F.max(F.struct("score", "sid", "n", "pos")).alias("h"), F.count("*").alias("c")).where("c > 1").select("token", "h")
    hubs = materialize(hubs, "join-hubs")  # as plain tables, both sides of the next join can be split at hot tokens
    lists = materialize(entries.join(hubs, "token").select("token", "sid", "n", "pos", F.col("h.sid").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.pos").alias("hub_pos")), "join-lists")
    forget(entries, hubs)

    star = materialize(lists.where(F.expr("sid <> hub and " + _fits(pct, "n", "hub_n", "pos", "hub_pos"))).select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct(), "join-star")
    edges = materialize(light.union(confirmed(star, reps, docs, key, text, size, pct).select(F.col("a").alias("src"), F.col("b").alias("dst"))), "join-edges")
    forget(light, star)
    comp = materialize(connected_components(edges), "join-classes")

    # Members of one list that are still in different classes.
    of = lists.select("token", "sid", "n", "pos").join(comp.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    of = materialize(of, "join-of")
    forget(lists, comp)
    open_ = materialize(of.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token"), "join-open")
    cross = list_pairs(of.join(open_, "token", "left_semi")).where(F.expr("component <> component2 and " + _fits(pct, "n", "n2", "pos", "pos2")))
    cross = materialize(cross.select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct(), "join-cross")
    forget(of, open_)
    more = confirmed(cross, reps, docs, key, text, size, pct).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    ids = reps.select("sid", "rep")
    named = edges.union(more).join(ids.select(F.col("sid").alias("src"), F.col("rep").alias("s")), "src").join(ids.select(F.col("sid").alias("dst"), F.col("rep").alias("d")), "dst").select("s", "d")
    final = connected_components(materialize(named, "join-named"), "s", "d")
    label = ids.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("sid", F.coalesce("component", "rep").alias("component"))
    out = rows.select(F.col("key").alias(key), "sid", F.col("n").cast("long").alias("n_shingles")).join(label, "sid", "left")
    return out.select(key, "n_shingles", F.coalesce("component", key).alias("component_id"))


def op4_shingle_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shingle_classes(docs, size=4, pct=85)
