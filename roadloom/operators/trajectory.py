"""Trajectory length per attribute value, from the best source that the objects offer, and quantities with length and area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.names import name_range
from roadloom.functions.text import clean_text, display_text, numbers_in, positive_number
from roadloom.operators.intervals import interval_length, point_length


def _best(df: DataFrame, keys: list[str], quality: str, rank: int) -> DataFrame:
    return df.select(*keys, (F.col("length") * 1000).alias("length_m"), F.col("segments").cast("long").alias("segments"), F.lit(quality).alias("quality"), F.lit(rank).alias("rank"))


def trajectory_lengths(objects: DataFrame, keys: list[str], begin: str = "begin", end: str = "end", text: str = "chainage_text", project: str = "project", warn_m: float = 50.0, warn_share: float = 0.1) -> DataFrame:
    """keys + (length_m, segments, quality, object_m, object_quality, name_m, difference_m, warning): one row per key.

    Sources of a key from best to worst: `precise` begin and end columns, `range` texts with two numbers or more, project
    `name`s, single `coarse` points. Intervals are merged over gaps up to 25 m, points split at jumps over 250 m. A project's
    name counts only where the whole table has it under one key. Keys without any source have quality `none` and null lengths.
    Every source is one aggregation by key; nothing is collected.
    """
    o = objects.select(*keys, positive_number(begin).alias("b"), positive_number(end).alias("e"), numbers_in(text).alias("n"), clean_text(project).alias("p"))
    precise = interval_length(o, keys, "b", "e")
    ranged = interval_length(o.where(F.size("n") >= 2).select(*keys, F.get("n", F.lit(0)).alias("b"), F.try_element_at("n", F.lit(-1)).alias("e")), keys, "b", "e")
    points = point_length(o.where(F.size("n") == 1).select(*keys, F.get("n", F.lit(0)).alias("at")), keys, "at")
    own = o.where("p is not null").groupBy("p").agg(F.count_distinct(F.struct(*keys)).alias("k"), *[F.min(k).alias(k) for k in keys]).where("k = 1")
    r = name_range("p")
    names = own.withColumn("r", r).where("r is not null").groupBy(*keys).agg(F.sum(F.col("r.end") - F.col("r.start")).alias("length"), F.count("*").alias("segments"))
    found = _best(precise, keys, "precise", 1).unionByName(_best(ranged, keys, "range", 2)).unionByName(_best(names, keys, "name", 3)).unionByName(_best(points, keys, "coarse", 4)).where("length_m > 0")
    best = lambda cond: F.min_by(F.struct("length_m", "segments", "quality"), F.when(cond, F.col("rank")))
    g = found.groupBy(*keys).agg(best(F.lit(True)).alias("top"), best(F.col("rank") != 3).alias("obj"), F.max(F.when(F.col("rank") == 3, F.col("length_m"))).alias("name_m"))
    out = o.select(*keys).distinct().join(g, keys, "left").withColumn("difference_m", F.col("name_m") - F.col("obj.length_m"))
    off = (F.abs("difference_m") >= warn_m) | (F.abs("difference_m") / F.greatest(F.col("obj.length_m"), F.lit(1.0)) >= warn_share)
    coarse = F.col("obj.quality") == "coarse"
    warning = F.when(off & coarse, "chainage is coarse, the name is used").when(off, "name and chainage differ").when(coarse & F.col("name_m").isNull(), "coarse chainage only").when(F.col("top").isNull(), "no length").otherwise("")
    return out.select(
        *keys, F.col("top.length_m").alias("length_m"), F.coalesce("top.segments", F.lit(0)).alias("segments"), F.coalesce("top.quality", F.lit("none")).alias("quality"), F.col("obj.length_m").alias("object_m"),
        F.coalesce("obj.quality", F.lit("none")).alias("object_quality"), "name_m", "difference_m", warning.alias("warning"),
    )


def first_filled(df: DataFrame, aliases: list[str]) -> str | None:
    """The first of the columns that has a value in any row, in one pass; None if none has."""
    here = [c for c in aliases if c in df.columns]
    if not here:
        return None
    row = df.agg(*[F.bool_or(clean_text(c).isNotNull()).alias(c) for c in here]).first()
    return next((c for c in here if row[c]), None)


def ordered_values(df: DataFrame, value: str) -> DataFrame:
    """(value, objects, place): the values of a category in legend order: numbers by size if all known values are numbers, else
    texts; unknown last."""
    g = df.groupBy(display_text(value).alias("value")).agg(F.count("*").alias("objects"))
    number = F.replace("value", F.lit(","), F.lit(".")).try_cast("double")
    whole = g.agg(F.bool_and(F.when(F.col("value") != "", number.isNotNull())).alias("numeric"))
    from pyspark.sql import Window as W

    # Values of a legend are few, so one window orders them.
    order = W.orderBy((F.col("value") == "").cast("int"), F.when(F.col("numeric"), number), "value")
    return g.join(F.broadcast(whole)).withColumn("place", F.row_number().over(order)).select("value", "objects", "place")


def measured_quantities(df: DataFrame, value: str, length: str = "length_m", area: str = "area_m2", width: str = "width_m") -> DataFrame:
    """(value, road, objects, length_m, area_m2, area_source): per value over all roads (road `*`) and per road.

    The area's source is chosen once for the whole table: the area column if any row has one, else length times width.
    """
    d = df.withColumns({"value": display_text(value), "_l": positive_number(length), "_a": positive_number(area), "_w": positive_number(width)})
    given = first_filled(df, [area]) is not None
    d = d.withColumn("_m", F.col("_a") if given else F.col("_l") * F.col("_w"))
    g = d.groupingSets([["value", "road"], ["value"]], "value", "road").agg(F.count("*").alias("objects"), F.sum("_l").alias("length_m"), F.sum("_m").alias("area_m2"))
    return g.withColumn("road", F.coalesce("road", F.lit("*"))).withColumn("area_source", F.lit("area" if given else "length times width"))
