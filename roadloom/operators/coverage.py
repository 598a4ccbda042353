"""Coverage of axes by projects of one type: what is covered, which gaps are left once the zones of names are taken off, what lies in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.names import type_family
from roadloom.functions.shared import materialize
from roadloom.operators.boundaries import name_zone_routes
from roadloom.operators.intervals import merge_intervals
from roadloom.operators.scans import BLOCK, along, deal


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], bucket: float = 1000.0) -> DataFrame:
    """Pairs of left (keys, start, end, ..) and right (keys, start, end, ..; its other columns are kept too) that share a stretch, with
    that stretch as (from, to). Both are cut into buckets of the axis, so that no axis is a single join key; a pair counts in the
    bucket where its common part begins."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)))
    a = left.withColumn("_cell", cells)
    b = right.withColumn("_cell", cells).withColumnsRenamed({"start": "_s", "end": "_e"})
    j = a.join(b, [*keys, "_cell"]).where("_s < end and _e > start").where(F.floor(F.greatest("start", "_s") / bucket) == F.col("_cell"))
    return j.withColumn("from", F.greatest("start", "_s")).withColumn("to", F.least("end", "_e")).drop("_cell", "_s", "_e")


def subtract_intervals(base: DataFrame, holes: DataFrame, keys: list[str], ident: list[str], bucket: float = 1000.0) -> DataFrame:
    """keys + ident + (start, end): the parts of each base interval (keys, ident, start, end) that no hole (keys, start, end) covers.

    A sweep along each base interval: a hole's part adds one at its start and takes one at its end, and where the sum is 0 the base is
    free. Empty and null intervals count for nothing; holes may overlap each other and reach beyond the base.
    """
    real = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") > F.col("start"))
    b = materialize(base.select(*keys, *ident, "start", "end").where(real), "subtract-base")
    cut = overlapping(b, holes.select(*keys, "start", "end").where(real), keys, bucket)
    at = lambda df, c, d: df.select(*keys, *ident, F.col(c).alias("at"), F.lit(d).alias("d"))
    ends = at(cut, "from", 1).unionAll(at(cut, "to", -1)).unionAll(at(b, "start", 0)).unionAll(at(b, "end", 0))
    w = W.partitionBy(*keys, *ident).orderBy("at")
    s = ends.groupBy(*keys, *ident, "at").agg(F.sum("d").alias("d")).withColumn("_open", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("end", F.lead("at").over(w))
    # Free stretches that touch are one: a hole without length splits nothing.
    free = s.where("end is not null").withColumn("_new", F.when((F.col("_open") == 0) & (F.coalesce(F.lag("_open").over(w), F.lit(1)) != 0), 1).otherwise(0))
    part = free.withColumn("_part", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).where("_open = 0")
    return part.groupBy(*keys, *ident, "_part").agg(F.min("at").alias("start"), F.max("end").alias("end")).drop("_part")


def side_fits(side: Column, gap_family: Column, gap_side: Column) -> Column:
    """Whether an object of a gap's family lies on its side: sides are equal, one of them is LR and the other L or R, or a main
    carriageway's gap has none."""
    single = lambda c: c.isin("L", "R")
    return (side == gap_side) | ((side == "LR") & single(gap_side)) | ((gap_side == "LR") & single(side)) | ((gap_family == "HRB") & (gap_side == ""))


def project_coverage(projects: DataFrame, anchors: DataFrame, objects: DataFrame, tolerance_m: float = 30.0, snap_m: float = 2.5, axis: str = "axis_id", labels: int = 10) -> DataFrame:
    """(axis, type, check, from_m, to_m, length_m, hard_from_m, hard_to_m, hard_length_m, margin_left_m, margin_right_m, left, right,
    covered_m, span_m, calibrated_m, pct, objects, objects_m, object_names, status) per axis and project type.

    projects: (axis, type, name, start_m, end_m, begin_km, end_km), ends in any order; objects: the primary ones, (axis, type, name,
    start, end). `coverage` rows sum up a type; `overlap` rows are projects that begin more than tolerance_m before what reaches
    furthest so far ends; `gap` rows are stretches without a project: from the zone in which the last name allows its end to the zone
    in which the next allows its begin more than tolerance_m must be left, and primary objects of that type must lie in what is left. Up
    to `labels` of their names are given, by place. Axes without anchors have no zones.
    """
    of = type_family("type")
    p = projects.withColumns({"_a": F.least("start_m", "end_m"), "_e": F.greatest("start_m", "end_m")}).where("_e > _a and type <> ''")
    p = materialize(p.select(axis, "type", "name", F.col("_a").alias("start"), F.col("_e").alias("end"), "begin_km", "end_km"), "coverage-projects")
    keys = [axis, "type"]
    span = p.groupBy(*keys).agg(F.min("start").alias("from_m"), F.max("end").alias("to_m")).withColumn("span_m", F.col("to_m") - F.col("from_m"))
    covered = merge_intervals(p, keys, "start", "end", 0.0).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered_m"))
    known = anchors.groupBy(axis).agg((F.max("route_m") - F.min("route_m")).alias("calibrated_m"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    total = materialize(span.join(covered, keys).join(known, axis, "left"), "coverage-total")

    by = ["start", "end", "name"]
    d, hot = deal(p, keys, by, "coverage-blocks")
    d = along(d, hot, keys, by, sums={"_i": F.lit(1)})
    reach = F.struct(F.col("end").alias("end"), (-F.col("_i")).alias("i"), F.col("name").alias("name"), F.col("end_km").alias("end_km"))
    d = along(d, hot, keys, by, maxes={"_p": reach}).drop(BLOCK).where("_p is not null")
    beside = d.select(*keys, F.struct(*keys, "_i").alias("id"), "start", "end", F.col("_p.end").alias("before"), F.col("_p.name").alias("left"), F.col("name").alias("right"), F.col("_p.end_km").alias("left_km"), F.col("begin_km").alias("right_km"))
    beside = materialize(beside.where(F.abs(F.col("start") - F.col("before")) > tolerance_m), "coverage-beside")

    gaps = beside.where("start > before")
    zone = lambda c, name: name_zone_routes(gaps.select("id", axis, c), anchors, "id", c, axis, snap_m).select("id", F.col("route_from").alias(f"{name}_from"), F.col("route_to").alias(f"{name}_to"))
    zoned = materialize(gaps.join(zone("left_km", "l"), "id", "left").join(zone("right_km", "r"), "id", "left"), "coverage-zones")
    holes = zoned.select("id", F.explode(F.array(F.struct(F.col("before").alias("start"), F.col("l_to").alias("end")), F.struct(F.col("r_from").alias("start"), F.col("start").alias("end")))).alias("h")).select("id", "h.*")
    hard = subtract_intervals(zoned.select("id", F.col("before").alias("start"), F.col("start").alias("end")), holes, ["id"], [])
    hard = hard.where(F.col("end") - F.col("start") > tolerance_m).join(zoned.select("id", *keys), "id")
    hard = materialize(hard.withColumns({"family": of["family"], "_side": of["side"]}), "coverage-hard")

    o = objects.withColumns({"family": of["family"], "_own": of["side"]}).select(axis, "family", "_own", F.coalesce("name", F.lit("")).alias("_name"), F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"))
    inside = overlapping(hard.select("id", axis, "family", "_side", "start", "end"), o.where("family <> ''"), [axis, "family"]).where(side_fits(F.col("_own"), F.col("family"), F.col("_side")))
    inside = materialize(inside, "coverage-inside")
    counts = inside.groupBy("id").agg(F.count("*").alias("objects"), F.sum(F.col("to") - F.col("from")).alias("objects_m"))
    # Names are counted down before they meet: of each gap the first few by place.
    first = inside.where("_name <> ''").groupBy("id", "_name").agg(F.min("from").alias("at"))
    first = first.withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy("at", "_name"))).where(F.col("_k") <= labels)
    names = first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_name"))), lambda x: x["_name"]), ", ").alias("object_names"))

    none = lambda kind, *cs: [F.lit(None).cast(kind).alias(c) for c in cs]
    left = zoned.select("id", "before", F.col("start").alias("to"), "left", "right")
    gap = hard.join(left, "id").join(counts, "id").join(names, "id", "left").join(total.select(*keys, "span_m", "calibrated_m"), keys).select(
        *keys, F.lit("gap").alias("check"), F.col("before").alias("from_m"), F.col("to").alias("to_m"), (F.col("to") - F.col("before")).alias("length_m"), F.col("start").alias("hard_from_m"), F.col("end").alias("hard_to_m"), (F.col("end") - F.col("start")).alias("hard_length_m"),
        (F.col("start") - F.col("before")).alias("margin_left_m"), (F.col("to") - F.col("end")).alias("margin_right_m"), "left", "right", *none("double", "covered_m"), "span_m", "calibrated_m", *none("double", "pct"), "objects", "objects_m", F.coalesce("object_names", F.lit("")).alias("object_names"), F.lit("check").alias("status"),
    )
    nothing = [*none("double", "hard_from_m", "hard_to_m", "hard_length_m", "margin_left_m", "margin_right_m")]
    bare = [*none("long", "objects"), *none("double", "objects_m"), F.lit("").alias("object_names")]
    overlap = beside.where("start < before").join(total.select(*keys, "span_m", "calibrated_m"), keys).select(
        *keys, F.lit("overlap").alias("check"), F.col("start").alias("from_m"), F.col("before").alias("to_m"), (F.col("before") - F.col("start")).alias("length_m"), *nothing, "left", "right", *none("double", "covered_m"), "span_m", "calibrated_m", *none("double", "pct"), *bare, F.lit("check").alias("status"),
    )
    whole = total.select(
        *keys, F.lit("coverage").alias("check"), "from_m", "to_m", F.col("covered_m").alias("length_m"), *nothing, F.lit("").alias("left"), F.lit("").alias("right"), "covered_m", "span_m", "calibrated_m", (F.col("covered_m") / F.col("span_m") * 100).alias("pct"), *bare, F.lit("overview").alias("status"),
    )
    return whole.unionByName(gap).unionByName(overlap)
