"""Connected components as alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is two shuffles over the edge list; no task holds a component: a hub's neighbours are only
reduced with min(), which combines map-side, and a hub's edges are re-linked in a salted join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.shared import drop_scratch, scratch_path


def _least(edges: DataFrame, low: DataFrame, hot: int = 128, salts: int = 64) -> DataFrame:
    """edges (u, v) with the least neighbour m of u. low: (u, m, deg). Edges of nodes with more than `hot` neighbours meet
    their node in a join on (u, salt of v), so a hub's edges are spread; the others join on u."""
    spread = low.where(F.col("deg") > hot).select("u", F.col("m").alias("hm"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(spread, ["u", "salt"], "left")
    of_hubs = salted.where("hm is not null").select("u", "v", F.col("hm").alias("m"))
    others = salted.where("hm is null").select("u", "v").join(low.where(F.col("deg") <= hot).select("u", "m"), "u")
    return of_hubs.union(others.select("u", "v", "m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v: link neighbours of u to the least node of u's neighbourhood."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg")).select("u", F.least("m", "u").alias("m"), "deg")
        return _least(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg"))
    moved = _least(edges, low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another node; component is the least node id.

    Nulls and self loops are dropped; repeated and reversed edges are one edge. An empty edge table gives an empty
    result. Each round is a table in the shared scratch folder, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "cc")
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path), path

    first = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).where("u <> v").distinct()
    schema = first.schema
    cur, path = stored(first)
    seen = None
    for _ in range(max_rounds):
        row = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or seen == (row["n"], row["h"]):
            break
        seen = (row["n"], row["h"])
        # Each step is stored, so that no plan holds more than one step.
        half, half_path = stored(_star(cur, True))
        nxt, nxt_path = stored(_star(half, False))
        for old in (path, half_path):
            drop_scratch(spark, old)
        cur, path = nxt, nxt_path
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
