"""Interval algebra as gaps and islands. Windows are keyed by the caller's group columns; islands of a hot key are found in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.operators.scans import along, deal


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", max_gap: float = 0.025) -> DataFrame:
    """keys + (island, start, end): intervals of a key merged where the gap is at most max_gap. Bounds may be swapped; empty
    and null intervals are dropped."""
    iv = df.select(*keys, F.least(start, end).alias("start"), F.greatest(start, end).alias("end")).where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col("end") > F.col("start")))
    d, hot = deal(iv, keys, ["start", "end"], "interval-blocks")
    d = along(d, hot, keys, ["start", "end"], maxes={"reach": F.col("end")})
    cut = d.withColumn("cut", F.when(F.col("reach").isNull() | (F.col("start") - F.col("reach") > max_gap), 1).otherwise(0))
    return along(cut, hot, keys, ["start", "end"], sums={"island": F.col("cut")}).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def interval_length(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", max_gap: float = 0.025) -> DataFrame:
    """keys + (length, segments) of the merged intervals."""
    return merge_intervals(df, keys, start, end, max_gap).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("length"), F.count("*").alias("segments"))


def point_length(df: DataFrame, keys: list[str], point: str, max_gap: float = 0.25) -> DataFrame:
    """keys + (length, segments) of distinct points, split where the jump exceeds max_gap; single points have no length, and
    keys without any length are left out."""
    p = df.select(*keys, F.round(point, 6).alias("p")).where("p is not null").distinct()
    w = W.partitionBy(*keys).orderBy("p")
    cut = p.withColumn("cut", F.when(F.col("p") - F.lag("p").over(w) <= max_gap, 0).otherwise(1))
    seg = cut.withColumn("seg", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(*keys, "seg").agg((F.max("p") - F.min("p")).alias("len"), F.count("*").alias("n"))
    return seg.where("n > 1").groupBy(*keys).agg(F.sum("len").alias("length"), F.count("*").alias("segments")).where("length > 0")


def hard_gaps(df: DataFrame, keys: list[str], name: str, start: str = "start", end: str = "end", tolerance: float = 5.0) -> DataFrame:
    """keys + (previous, name, kind, from, to): gaps and overlaps against the predecessor that reaches furthest (the first of
    equals), beyond the tolerance."""
    w = W.partitionBy(*keys).orderBy(start, end, name)
    ranked = df.withColumn("_i", F.row_number().over(w))
    prev = F.max(F.struct(F.col(end).alias("e"), (-F.col("_i")).alias("i"), F.col(name).alias("n"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = ranked.withColumn("_p", prev).where("_p is not null").withColumn("_g", F.col(start) - F.col("_p.e"))
    kind = F.when(F.col("_g") > tolerance, "gap").when(F.col("_g") < -tolerance, "overlap")
    return d.select(*keys, F.col("_p.n").alias("previous"), F.col(name).alias("name"), kind.alias("kind"), F.least(F.col(start), F.col("_p.e")).alias("from"), F.greatest(F.col(start), F.col("_p.e")).alias("to")).where("kind is not null")


def overlap_sum(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, bucket: float = 1000.0) -> DataFrame:
    """left_id + (objects, overlap): how much of each left interval right intervals cover, added up.

    Both sides are cut into buckets of `bucket` length, so that a long axis is no single join key; a pair counts in the
    bucket where its common part begins. Columns: keys, start, end on both sides.
    """
    cells = lambda: F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)))
    a = left.select(*keys, left_id, "start", "end").withColumn("cell", cells())
    b = right.select(*keys, F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("cell"))
    j = a.join(b, [*keys, "cell"]).where("s2 < end and e2 > start").where(F.floor(F.greatest("start", "s2") / bucket) == F.col("cell"))
    return j.groupBy(*keys, left_id).agg(F.count("*").alias("objects"), F.sum(F.least("end", "e2") - F.greatest("start", "s2")).alias("overlap"))


def occupied_gaps(gaps: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """gaps (of hard_gaps) + (objects, covered): overlaps, and those gaps that objects (keys, start, end) of the same keys lie in. A
    gap without any object is the end of what is there, not a hole in the projects. Overlaps have neither objects nor covered: gaps of
    a key lie apart, so that an object meets few of them, but overlaps can each span the whole axis."""
    g = gaps.where("kind = 'gap'").select(*keys, F.struct("previous", "name", "from").alias("_id"), F.col("from").alias("start"), F.col("to").alias("end")).where("end > start")
    n = overlap_sum(g, objects, keys, "_id").where("overlap > 0")
    j = gaps.withColumn("_id", F.struct("previous", "name", "from")).join(n, [*keys, "_id"], "left").drop("_id")
    return j.where("kind <> 'gap' or objects is not null").withColumnRenamed("overlap", "covered")


def last_before(probe: DataFrame, known: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """As-of join without a range join: probe rows take values of the last known row with known.at <= probe.at.

    Both sides are stacked and the values carried forward in one window per key.
    """
    a = probe.withColumn("_probe", F.lit(True)).withColumn("_row", F.struct(*probe.columns))
    b = known.select(*keys, at, F.struct(*values).alias("_v"))
    stacked = a.select(*keys, at, "_probe", "_row").unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(F.col(at), F.coalesce("_probe", F.lit(False))).rowsBetween(W.unboundedPreceding, 0)
    got = stacked.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_probe")
    return got.select("_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)
