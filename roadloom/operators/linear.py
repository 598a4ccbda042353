"""Linear referencing: axis segments, positions along them, calibration against distance posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.names import hm_label, interval_status
from roadloom.operators.nearest import nearest_segment
from roadloom.operators.scans import metres, nanometres, straight


def axis_segments(vertices: DataFrame, axis: str = "axis_id", seq: str = "seq") -> DataFrame:
    """(axis, seq, x1, y1, x2, y2, length, from_m): one row per line segment with its cumulative start, summed in whole nanometres; zero
    segments dropped."""
    w = W.partitionBy(axis).orderBy(seq)
    s = vertices.select(axis, seq, F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    s = s.withColumn("length", straight(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).where("length > 0")
    return s.withColumn("from_m", F.coalesce(metres(F.sum(nanometres("length")).over(w.rowsBetween(W.unboundedPreceding, -1))), F.lit(0.0)))


def axis_lengths(segments: DataFrame, axis: str = "axis_id") -> DataFrame:
    return segments.groupBy(axis).agg(F.sum("length").alias("length_m"), F.count("*").alias("segments"))


def sample_positions(axes: DataFrame, axis: str = "axis_id", count: int = 26, step_m: float = 100.0, most: int = 500) -> DataFrame:
    """(axis, position_m): `count` even positions plus one every step_m, thinned evenly to `most` with both ends kept."""
    even = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.round(F.col("length_m") * i / (count - 1), 3))
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.col("length_m") / step_m).cast("int")), lambda i: F.round(i * F.lit(step_m), 3))
    s = axes.select(axis, F.array_sort(F.array_distinct(F.concat(even, steps))).alias("p"))
    n = F.size("p")
    thin = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at("p", (F.floor(i * (n - 1) / (most - 1)) + 1).cast("int")))
    return s.select(axis, F.explode(F.when(n > most, F.array_distinct(thin)).otherwise(F.col("p"))).alias("position_m"))


def points_at(positions: DataFrame, segments: DataFrame, axis: str = "axis_id", bucket_m: float = 1000.0) -> DataFrame:
    """positions + (x, y): the point at position_m of its axis. Segments and positions meet per axis and `bucket_m`."""
    last = segments.groupBy(axis).agg(F.max("from_m").alias("_last"))
    seg = segments.join(last, axis).withColumn("to_m", F.col("from_m") + F.col("length"))
    seg = seg.withColumn("b", F.explode(F.sequence(F.floor(F.col("from_m") / bucket_m), F.floor(F.col("to_m") / bucket_m))))
    p = positions.withColumn("b", F.floor(F.col("position_m") / bucket_m))
    hit = (F.col("position_m") >= F.col("from_m")) & ((F.col("position_m") < F.col("to_m")) | ((F.col("from_m") == F.col("_last")) & (F.col("position_m") <= F.col("to_m") + 1e-6)))
    t = F.least(F.lit(1.0), (F.col("position_m") - F.col("from_m")) / F.col("length"))
    return p.join(seg, [axis, "b"]).where(hit).select(*positions.columns, (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))


def project_points(points: DataFrame, segments: DataFrame, max_offset_m: float | None = None, point: str = "point_id", axis: str = "axis_id") -> DataFrame:
    """(point, axis, route_m, offset_m): nearest axis position, however far or within max_offset_m; ties go to the first axis, then route."""
    found = nearest_segment(points, segments, [axis, "route_m"], point, within_m=max_offset_m)
    return found.select(point, axis, "route_m", F.col("distance_m").alias("offset_m"))


def build_anchors(posts: DataFrame, axis: str = "axis_id") -> DataFrame:
    """(axis, hm_km, route_m, posts, max_offset_m, monotone): projected posts (hm_km, route_m, offset_m) grouped by kilometre
    label; an axis is monotone if its anchors rise or fall throughout."""
    a = posts.groupBy(axis, F.round("hm_km", 3).alias("hm_km")).agg(F.median("route_m").alias("route_m"), F.count("*").alias("posts"), F.max("offset_m").alias("max_offset_m"))
    w = W.partitionBy(axis).orderBy("route_m", "hm_km")
    sign = F.signum(F.col("hm_km") - F.lag("hm_km").over(w))
    s = a.withColumn("_s", sign)
    whole = W.partitionBy(axis)
    return s.withColumn("monotone", F.coalesce(F.min("_s").over(whole) == F.max("_s").over(whole), F.lit(False))).drop("_s")


def hectometre_intervals(anchors: DataFrame, axis: str = "axis_id") -> DataFrame:
    """Consecutive anchors by route: measured against expected length, deviation, factor and status."""
    w = W.partitionBy(axis).orderBy("route_m", "hm_km")
    d = anchors.select(axis, F.lag("hm_km").over(w).alias("hm_from"), F.col("hm_km").alias("hm_to"), F.lag("route_m").over(w).alias("route_from"), F.col("route_m").alias("route_to"))
    d = d.withColumn("measured_m", F.col("route_to") - F.col("route_from")).withColumn("expected_m", F.abs(F.col("hm_to") - F.col("hm_from")) * 1000.0).where("measured_m > 0 and expected_m > 0")
    return d.withColumn("deviation_m", F.col("measured_m") - F.col("expected_m")).withColumn("factor", F.col("measured_m") / F.col("expected_m")).withColumn("status", interval_status("measured_m", "expected_m")).withColumn("label", F.concat(hm_label("hm_from"), F.lit("-"), hm_label("hm_to")))


def interpolate(probe: DataFrame, anchors: DataFrame, axis: str, x: str, y: str, bucket: float = 1000.0) -> DataFrame:
    """probe + (y, in_range): linear interpolation of y at x between the anchors of its axis, clamped at the ends.

    Anchors become intervals entered in every bucket they touch; a probe meets the intervals of its own bucket. What lies
    outside takes the end value of its axis; an end anchor itself is in range. Axes with one anchor have no interval and
    axes without any give null.
    """
    w = W.partitionBy(axis).orderBy(x, y)
    iv = anchors.select(axis, F.col(x).alias("_x1"), F.col(y).alias("_y1"), F.lead(x).over(w).alias("_x2"), F.lead(y).over(w).alias("_y2")).where("_x2 > _x1")
    ends = anchors.groupBy(axis).agg(F.min(F.struct(x, y)).alias("_lo"), F.max(F.struct(x, y)).alias("_hi"))
    # Of the ends only what is needed goes on, as probes are shuffled.
    lo, hi = F.col(f"_lo.{x}"), F.col(f"_hi.{x}")
    p = probe.join(ends, axis, "left").withColumn("_xc", F.greatest(F.least(F.col(x), hi), lo))
    p = p.select(*probe.columns, "_xc", F.floor(F.col("_xc") / bucket).alias("_b"), (F.col("_xc") == hi).alias("_end"), F.col(f"_lo.{y}").alias("_y0"), ((F.col(x) >= lo) & (F.col(x) <= hi)).alias("in_range"))
    cells = iv.withColumn("_cb", F.explode(F.sequence(F.floor(F.col("_x1") / bucket), F.floor(F.col("_x2") / bucket)))).withColumnRenamed(axis, "_axis")
    j = p.join(cells, (F.col(axis) == F.col("_axis")) & (F.col("_b") == F.col("_cb")) & (F.col("_xc") >= F.col("_x1")) & ((F.col("_xc") < F.col("_x2")) | ((F.col("_xc") == F.col("_x2")) & F.col("_end"))), "left")
    val = F.coalesce(F.col("_y1") + (F.col("_xc") - F.col("_x1")) / (F.col("_x2") - F.col("_x1")) * (F.col("_y2") - F.col("_y1")), F.col("_y0"))
    return j.select(*probe.columns, val.alias(y), "in_range")


def deviation_zones(samples: DataFrame, axis: str = "axis_id", attention_m: float = 10.0, check_m: float = 25.0) -> DataFrame:
    """Zones of samples (position_m, distance_m) further off than attention_m; a new zone starts where the step exceeds 1.5
    median steps of the axis (10 m at least)."""
    w = W.partitionBy(axis).orderBy("position_m")
    s = samples.withColumn("step", F.col("position_m") - F.lag("position_m").over(w))
    typical = s.groupBy(axis).agg(F.median("step").alias("m"))
    far = s.drop("step").where(F.col("distance_m") > attention_m).join(typical, axis)
    cut = F.when(F.col("position_m") - F.lag("position_m").over(w) <= F.greatest(1.5 * F.col("m"), F.lit(10.0)), 0).otherwise(1)
    z = far.withColumn("_c", cut).withColumn("zone", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = z.groupBy(axis, "zone").agg(F.min("position_m").alias("from_m"), F.max("position_m").alias("to_m"), F.max("distance_m").alias("max_m"), F.avg("distance_m").alias("mean_m"), F.count("*").alias("samples"))
    return out.withColumn("color", F.when(F.col("max_m") > check_m, "red").otherwise("orange"))


def zone_types(zones: DataFrame, axes: DataFrame, samples: DataFrame, axis: str = "axis_id") -> DataFrame:
    """zones (of deviation_zones) + (type, advice): where on its axis (axes: length_m) a zone lies and what that may mean.

    The ends of an axis are its first and last 2 %, 150 m at least; a zone is long from 300 m and three median steps of the samples on.
    """
    w = W.partitionBy(axis).orderBy("position_m")
    step = F.col("position_m") - F.lag("position_m").over(w)
    typical = samples.withColumn("_s", step).where("_s > 0").groupBy(axis).agg(F.median("_s").alias("_step"))
    z = zones.join(axes.select(axis, F.col("length_m").alias("_len")), axis, "left").join(typical, axis, "left")
    edge = F.greatest(F.lit(150.0), F.col("_len") * 0.02)
    begin, end = F.col("from_m") <= edge, F.col("_len") - F.col("to_m") <= edge
    long = F.col("to_m") - F.col("from_m") >= F.greatest(F.lit(300.0), 3 * F.greatest("_step", F.lit(1.0)))
    z = z.withColumn("type", F.when(begin & end, "begin and end").when(begin, "begin").when(end, "end").when(long, "long").otherwise("local"))
    advice = F.when(F.col("type").isin("begin", "end", "begin and end"), "check where the axis begins and ends").when(F.col("type") == "long", "check that both follow one road").when(F.col("color") == "red", "look at the place before a boundary is set there").otherwise("look at the place")
    return z.withColumn("advice", advice).drop("_len", "_step")
