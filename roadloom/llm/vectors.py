"""Near-duplicate vectors by p-stable hashing (Datar et al., 2004), confirmed by exact cosines.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so Euclidean hashing applies: a table joins `width`-wide quantised
Gaussian projections into a bucket key. The number of projections grows with the logarithm of the number of vectors (a
bucket then holds about one unrelated vector), the number of tables follows from the recall wanted at the threshold.
"""

from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.shared import materialize
from roadloom.llm.words import lean
from roadloom.operators.components import connected_components

WIDTH = 2.0
BLOCK = 512


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection of two points so far apart is equal."""
    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def plan_tables(n: int, threshold: float, recall: float = 0.995, width: float = WIDTH) -> tuple[int, int]:
    """(projections per table, tables) for n vectors; `recall` holds for pairs right at the threshold."""
    k = max(4, ceil(log(max(n, 64)) / -log(collision(sqrt(2), width))))
    p = collision(max(sqrt(2 - 2 * threshold), 1e-3), width) ** k
    return k, max(1, ceil(log(1 - recall) / log(1 - min(p, 0.999))))


def bucket_keys(x: np.ndarray, k: int, tables: int, seed: int = 11, width: float = WIDTH) -> np.ndarray:
    """int32 keys (rows, tables) of unit vectors x."""
    rng = np.random.default_rng([seed, x.shape[1], k, tables])
    a = rng.normal(size=(x.shape[1], k * tables))
    b = rng.uniform(0, width, k * tables)
    mult = rng.integers(1, 2**62, k * tables, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    q = np.floor((x @ a + b) / width).astype(np.int64).astype(np.uint64)
    h = ((q + np.uint64(0x9E3779B97F4A7C15)) * mult).reshape(len(x), tables, k).sum(2, dtype=np.uint64)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by their largest component first: squares of huge or tiny numbers would not fit a double."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys, across batches; only the run in hand is kept."""
    held = []
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        for i, (s, e) in enumerate(zip([0, *cut], [*cut, len(b)])):
            part = b.iloc[s:e]
            if i or (held and (held[-1][keys].iloc[-1].to_numpy() != k[0]).any()):
                if held:
                    yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def compare_blocks(threshold: float, dtype: str):
    """mapInPandas function: (table, lo, hi, side, node, weight, vec, keys) sorted by block -> (node, links, root).

    Compares the vectors of a block, or of two blocks crosswise. A pair that met in an earlier table is left to that
    table, so no pair counts twice and none has to be sent anywhere. root links the nodes of the block that belong together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for g in runs(batches, ["table", "key", "lo", "hi"]):
            if len(g) < 2:
                continue
            t = int(g["table"].iloc[0])
            x = np.stack([np.frombuffer(v, dtype) for v in g["vec"]]).astype(np.float64)
            x = unit(x)
            side = g["side"].to_numpy()
            node, weight = g["node"].to_numpy(), g["weight"].to_numpy()
            if g["lo"].iloc[0] == g["hi"].iloc[0]:
                a, b = np.nonzero(np.triu(x @ x.T >= threshold - 1e-9, 1))
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                i, j = np.nonzero(x[left] @ x[right].T >= threshold - 1e-9)
                a, b = left[i], right[j]
            if not len(a):
                continue
            ok = (x[a] * x[b]).sum(1) >= threshold
            if t:
                keys = np.stack([np.frombuffer(v, np.int32) for v in g["keys"]])[:, :t]
                ok &= ~(keys[a] == keys[b]).any(1)
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            links = np.bincount(a, weight[b], len(g)) + np.bincount(b, weight[a], len(g))
            root = list(range(len(g)))

            def find(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, j in zip(a.tolist(), b.tolist()):
                i, j = find(i), find(j)
                if i != j:
                    root[max(i, j)] = min(i, j)
            for i in np.flatnonzero(links):
                out.append((node[i], int(links[i]), node[find(int(i))]))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["node", "links", "root"])
                out = []
        yield pd.DataFrame(out, columns=["node", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", threshold: float = 0.95, recall: float = 0.995, block: int = BLOCK) -> DataFrame:
    """vectors' keys with n_links, component_id and kept: one row per row of vectors.

    Equal vectors are one class with a weight, so copies are never paired. Buckets of classes are cut into blocks of about
    `block`; block pairs are compared in separate tasks. Every pair that shares a bucket is compared in double precision.
    Null and zero vectors, vectors with null or non-finite components and rows with a null key link with nothing (a null
    key's component is null, and it is kept). Vectors of different lengths don't link. Rows with one key and different
    vectors share their links. Keys are of any type that has an order. Repeated rows link with each other as copies do. An
    empty table gives an empty result; other columns are dropped.
    """
    item = vectors.schema[vec].dataType.elementType.simpleString()
    wide = item != "float"
    v = vectors.select(F.col(key), F.col(vec).cast("array<double>" if wide else "array<float>").alias("v"))
    big = float(np.finfo(np.float64).max)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= big))
    v = v.withColumn("v", F.when(F.col(key).isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.col("v")))
    # Classes are equal vectors; two hashes of 64 bits name them in the join back, so that hot copies shuffle no vectors.
    v = v.withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit("second"), "v").alias("b")))
    kind = vectors.schema[key].dataType.simpleString()
    classes = materialize(v.where("v is not null").groupBy("h", "v").agg(F.min(key).alias("node"), F.count("*").alias("weight")), "vec-classes")
    n = classes.count()
    k, tables = plan_tables(n, threshold, recall)
    dtype = "<f8" if wide else "<f4"

    def index(batches):
        for b in batches:
            lens = b["v"].map(len).to_numpy()
            for size in np.unique(lens):
                part = b[lens == size]
                keys = bucket_keys(unit(np.stack(part["v"].to_list()).astype(np.float64)), k, tables)
                yield pd.DataFrame({"node": part["node"], "weight": part["weight"], "size": size, "vec": [np.asarray(r, dtype).tobytes() for r in part["v"]], "keys": list(keys), "packed": [r.tobytes() for r in keys]})

    indexed = materialize(classes.select("node", "weight", "v").mapInPandas(lean(index), f"node {kind}, weight long, size int, vec binary, keys array<int>, packed binary"), "vec-index")
    slots = indexed.select("node", "size", F.posexplode("keys").alias("table", "key"))
    live = slots.groupBy("table", "key", "size").agg(F.count("*").alias("m")).where("m > 1")
    member = slots.join(live, ["table", "key", "size"]).withColumn("b", F.ceil(F.col("m") / block).cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("b")).cast("int"))
    member = member.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    member = member.select("node", "table", "key", "size", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.when(F.col("i") > F.col("j"), 1).otherwise(0).alias("side"))
    full = member.join(indexed.select("node", "weight", "vec", F.col("packed").alias("keys")), "node")
    full = full.withColumn("key", F.xxhash64("key", "size"))
    dealt = full.repartition("table", "key", "lo", "hi").sortWithinPartitions("table", "key", "lo", "hi")
    found = materialize(dealt.select("table", "key", "lo", "hi", "side", "node", "weight", "vec", "keys").mapInPandas(lean(compare_blocks(threshold, dtype)), f"node {kind}, links long, root {kind}"), "vec-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = connected_components(found, "node", "root")
    by_class = classes.select("h", "node", "weight").join(links, "node", "left").join(comp, "node", "left").select("h", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = v.select(key, F.when(F.col("v").isNotNull(), F.col("h")).alias("h")).join(by_class, "h", "left")
    out = out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", key).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op3_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
