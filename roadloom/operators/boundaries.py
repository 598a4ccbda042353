"""Diagnosis of project boundaries on calibrated axes: where objects and names lie, in which interval and zone, and what to check.

Everything is keyed by axis, object or project; points meet segments and intervals in grid cells or buckets of the axis.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.names import name_range, name_zone, snap_label, validate_name, worst_status
from roadloom.functions.shared import materialize
from roadloom.operators.diagnostics import boundary_zones, choose_axis
from roadloom.operators.linear import hectometre_intervals, interpolate
from roadloom.operators.nearest import nearest_segment


def geometry_ranges(vertices: DataFrame, middles: DataFrame, segments: DataFrame, reach_m: float = 50.0, key: str = "object_id", axis: str = "axis_id") -> DataFrame:
    """(key, axis, route_from, route_mid, route_to, offset_m): the axis nearest to an object's middle (key, x, y), however far, and least,
    median and greatest route of its vertices (key, x, y) on that axis; ties go to the first axis, then the least route. Objects
    without coordinates are left out. reach_m is what a first look covers."""
    mid = nearest_segment(middles, segments, [axis, "route_m"], key, reach_m=reach_m, carry=[])
    mid = mid.groupBy(key).agg(F.min(F.struct("distance_m", axis)).alias("_m")).select(key, F.col(f"_m.{axis}").alias(axis), F.col("_m.distance_m").alias("offset_m"))
    # Vertices at one place are one point that counts several times; with the offset along, nothing is joined afterwards.
    v = vertices.join(mid, key).groupBy(key, axis, "offset_m", "x", "y").agg(F.count("*").alias("_n"))
    r = nearest_segment(v, segments, ["route_m"], key, [axis], reach_m, carry=["offset_m", "_n"])
    r = r.select(key, axis, "offset_m", "_n", "route_m").repartition(key)  # rows are smaller than what a median keeps of them
    g = r.groupBy(key, axis, "offset_m").agg(F.min("route_m").alias("route_from"), F.percentile("route_m", 0.5, F.col("_n")).alias("route_mid"), F.max("route_m").alias("route_to"))
    return g.select(key, axis, "route_from", "route_mid", "route_to", "offset_m")


def monotone_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors of axes whose chainage rises or falls throughout: only they turn kilometres into routes."""
    return anchors.where("monotone")


def km_to_route(probe: DataFrame, anchors: DataFrame, axis: str = "axis_id") -> DataFrame:
    """probe (axis, hm_km, …) + (route_m, in_range), on monotone axes only; null on others."""
    return interpolate(probe, monotone_anchors(anchors).select(axis, "hm_km", "route_m"), axis, "hm_km", "route_m", bucket=1.0)


def name_zone_routes(probe: DataFrame, anchors: DataFrame, key: str, label_km: str, axis: str = "axis_id", tolerance_m: float = 2.5) -> DataFrame:
    """(key, axis, route_from, route_to): where on the axis a boundary may lie that is written as label_km. key names a probe row."""
    z = name_zone(label_km, tolerance_m)
    ends = probe.select(key, axis, F.explode(F.array(z["lower"], z["upper"])).alias("hm_km")).where("hm_km is not null")
    return km_to_route(ends, anchors, axis).where("route_m is not null").groupBy(key, axis).agg(F.min("route_m").alias("route_from"), F.max("route_m").alias("route_to"))


def interval_at(probe: DataFrame, anchors: DataFrame, axis: str = "axis_id", route: str = "route_m", bucket: float = 1000.0) -> DataFrame:
    """probe + (interval, interval_m, expected_m, interval_status, position_m, outside, diagnosis): the post interval of a route.

    A route on an anchor belongs to the interval before it; one beyond the anchors is judged by the first or last interval.
    Axes without two anchors, and null routes, give nulls, and outside is false.
    """
    h = hectometre_intervals(anchors, axis)
    ends = anchors.groupBy(axis).agg(F.min(route).alias("_lo"), F.max(route).alias("_hi"))
    p = probe.join(ends, axis, "left").withColumn("_c", F.greatest(F.least(F.col(route), F.col("_hi")), F.col("_lo"))).withColumn("_b", F.floor(F.col("_c") / bucket))
    cells = h.select(F.col(axis).alias("_axis"), "route_from", "route_to", "measured_m", F.col("expected_m").alias("_e"), F.col("status").alias("_s"), F.col("label").alias("_l"))
    cells = cells.withColumn("_cb", F.explode(F.sequence(F.floor(F.col("route_from") / bucket), F.floor(F.col("route_to") / bucket))))
    inside = (F.col("_c") > F.col("route_from")) & (F.col("_c") <= F.col("route_to")) | ((F.col("_c") == F.col("_lo")) & (F.col("route_from") == F.col("_lo")))
    j = p.join(cells, (F.col(axis) == F.col("_axis")) & (F.col("_b") == F.col("_cb")) & inside, "left")
    out = F.coalesce((F.col(route) < F.col("_lo")) | (F.col(route) > F.col("_hi")), F.lit(False))
    said = F.filter(F.array(
        F.when(out, "outside the calibrated part"), F.when(F.col("_s") != "ok", F.concat(F.lit("interval "), F.col("_l"), F.format_string(" is %.1f m instead of %.1f m", "measured_m", "_e"))),
    ), lambda x: x.isNotNull())
    return j.select(
        *probe.columns, F.col("_l").alias("interval"), F.col("measured_m").alias("interval_m"), F.col("_e").alias("expected_m"), F.col("_s").alias("interval_status"),
        (F.col(route) - F.col("route_from")).alias("position_m"), (out & F.col("_l").isNotNull()).alias("outside"), F.when(F.col("_l").isNotNull(), F.array_join(said, "; ")).otherwise("").alias("diagnosis"),
    )


def object_ranges(objects: DataFrame, ranges: DataFrame, anchors: DataFrame, max_offset_m: float = 50.0, key: str = "object_id", axis: str = "axis_id") -> DataFrame:
    """objects + (axis, route_from, route_to, km_from, km_to, offset_m, status, warning): what geometry_ranges found, in kilometres.

    status is `projected`, or `check` where the object lies further off than max_offset_m, partly beyond the calibrated part,
    or on no axis at all.
    """
    r = ranges.select(key, axis, F.explode(F.array("route_from", "route_to")).alias("route_m"))
    k = interpolate(r, anchors.select(axis, "route_m", "hm_km"), axis, "route_m", "hm_km").groupBy(key).agg(F.min("hm_km").alias("km_from"), F.max("hm_km").alias("km_to"), F.bool_and(F.coalesce("in_range", F.lit(False))).alias("_in"))
    o = objects.join(ranges.select(key, axis, "route_from", "route_to", "offset_m"), key, "left").join(k, key, "left")
    parts = F.filter(F.array(
        F.when(F.col(axis).isNull(), "on no axis"), F.when(F.col("offset_m") > max_offset_m, "far from the axis"), F.when(F.col(axis).isNotNull() & ~F.coalesce("_in", F.lit(False)), "partly outside the calibrated part"),
    ), lambda x: x.isNotNull())
    return o.withColumn("warning", F.array_join(parts, "; ")).withColumn("status", F.when(F.col("warning") == "", "projected").otherwise("check")).drop("_in")


def project_extents(ranges: DataFrame, project: str = "project", axis: str = "axis_id") -> DataFrame:
    """(project, axis, objects_on_axis, object_from_m, object_to_m, object_from_km, object_to_km): the extent of a project's usable
    primary objects (columns primary, status of object_ranges) on each axis that it has objects on."""
    use = lambda c: F.when((F.col("status") == "projected") & F.col("primary"), F.col(c))
    g = ranges.where(F.col(axis).isNotNull() & (F.col(project) != "")).groupBy(project, axis)
    return g.agg(F.count("*").alias("objects_on_axis"), F.min(use("route_from")).alias("object_from_m"), F.max(use("route_to")).alias("object_to_m"), F.min(use("km_from")).alias("object_from_km"), F.max(use("km_to")).alias("object_to_km"))


def _joined(parts: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "; ")


def project_boundaries(
    projects: DataFrame, axes: DataFrame, anchors: DataFrame, ranges: DataFrame, zones: DataFrame, length_tolerance_m: float = 50.0, zone_buffer_m: float = 10.0, snap_m: float = 2.5, axis: str = "axis_id",
) -> DataFrame:
    """One row per project name (projects: project, road): its boundaries on the best axis of its road, and three statuses.

    axes: (axis, road). Candidates are the calibrated axes of the road; choose_axis picks one. name_status is that of the name
    rules, boundary_status that of the boundaries (check beyond the calibrated part or in a red zone, attention for an orange
    zone or a length off by more than length_tolerance_m), object_status that of the objects' extent, which is context
    and stays out of status. Names without a range are left out. Projects without a calibrated axis are a check.
    """
    v, r = validate_name("project", F.col("road")), name_range("project")
    p = projects.select("project", "road").distinct().withColumn("_r", r).where("_r is not null")
    p = p.select("project", "road", v.alias("v"), F.col("_r.start").alias("start_km"), F.col("_r.end").alias("end_km"), ((F.col("_r.end") - F.col("_r.start")) * 1000).alias("length_m"))
    p = materialize(p, "boundary-projects")
    extents = materialize(project_extents(ranges, axis=axis), "boundary-extents")
    tried = p.select("project", "road", F.explode(F.array(F.struct(F.lit("begin").alias("end"), F.col("start_km").alias("hm_km")), F.struct(F.lit("end").alias("end"), F.col("end_km").alias("hm_km")))).alias("e")).join(axes.select(axis, "road"), "road")
    ends = km_to_route(tried.select("project", axis, "e.end", "e.hm_km"), anchors, axis).where("route_m is not null")
    at = lambda e, c: F.max(F.when(F.col("end") == e, F.col(c)))
    found = ends.groupBy("project", axis).agg(*[at(e, c).alias(f"{e}_{c}") for e in ("begin", "end") for c in ("route_m", "in_range")])
    found = materialize(found.withColumn("axis_length_m", F.abs(F.col("end_route_m") - F.col("begin_route_m"))), "boundary-candidates")
    scored = found.join(p.select("project", "length_m"), "project").join(extents.select("project", axis, "objects_on_axis"), ["project", axis], "left")
    best = choose_axis(scored.select("project", axis, "length_m", "axis_length_m", (F.col("begin_in_range") & F.col("end_in_range")).alias("in_range"), F.coalesce("objects_on_axis", F.lit(0)).alias("objects")), "project", axis)
    chosen = materialize(best.select("project", axis).join(found, ["project", axis]), "boundary-chosen")

    def one_end(e: str) -> DataFrame:
        q = interval_at(chosen.select("project", axis, F.col(f"{e}_route_m").alias("route_m")), anchors, axis)
        q = q.join(boundary_zones(chosen.select("project", axis, F.col(f"{e}_route_m").alias("route_m")), zones, "project", axis, zone_buffer_m).select("project", "color", "zones"), "project", "left")
        return q.select("project", *[F.col(c).alias(f"{e}_{c}") for c in ("interval", "interval_m", "interval_status", "position_m", "diagnosis", "color", "zones")])

    total = ranges.where("project <> ''").groupBy("project").agg(F.count("*").alias("objects"))
    d = p.join(chosen, "project", "left").join(one_end("begin"), "project", "left").join(one_end("end"), "project", "left").join(total, "project", "left").join(extents, ["project", axis], "left")
    out = lambda e: ~F.coalesce(F.col(f"{e}_in_range"), F.lit(False))
    none = F.col(axis).isNull()
    off = F.abs(F.col("axis_length_m") - F.col("length_m")) > length_tolerance_m
    zoned = lambda e: F.when(F.col(f"{e}_color").isNotNull(), F.concat(F.lit(f"{e} in a "), F.col(f"{e}_color"), F.lit(" zone")))
    warned = F.when(none, "no calibrated axis").otherwise(_joined([*[F.when(out(e), f"{e} outside the calibrated part") for e in ("begin", "end")], F.when(off, "name and axis differ in length"), zoned("begin"), zoned("end")]))
    red = (F.col("begin_color") == "red") | (F.col("end_color") == "red")
    d = d.withColumn("boundary_warning", warned)
    d = d.withColumn("boundary_status", F.when(none | out("begin") | out("end") | F.coalesce(red, F.lit(False)), "check").when(F.col("boundary_warning") != "", "attention").otherwise("ok"))
    shift = F.greatest(F.abs(F.col("object_from_km") - F.col("start_km")), F.abs(F.col("object_to_km") - F.col("end_km"))) * 1000
    by_rule = F.concat_ws("-", snap_label("object_from_km", snap_m)["label"], snap_label("object_to_km", snap_m)["label"])
    lost, flat = F.coalesce("objects", F.lit(0)) > 0, F.col("object_from_m").isNull() | F.col("object_to_m").isNull()
    facts = [
        (lost & (F.coalesce("objects_on_axis", F.lit(0)) == 0), "check", F.lit("objects are not on the axis")), (lost & flat, "check", F.lit("no usable primary object")),
        (shift > length_tolerance_m, "attention", F.lit("objects lie off the name's range")),
        (F.col("object_from_km").isNotNull() & (by_rule != F.concat_ws("-", "v.begin_label", "v.end_label")), "attention", F.concat(F.lit("objects give "), by_rule)),
    ]
    d = d.withColumn("object_status", worst_status(*[F.when(c, s).otherwise("ok") for c, s, _ in facts])).withColumn("object_warning", _joined([F.when(c, m) for c, _, m in facts]))
    status = worst_status(F.col("v.status"), F.col("boundary_status"))
    advice = (
        F.when((status == "ok") & (F.col("object_status") != "ok"), "fine, look at the objects as context").when(status == "ok", "nothing to do").when(F.col("begin_color").isNotNull() | F.col("end_color").isNotNull(), "look at the zone on the map")
        .when(F.col("v.status") != "ok", "check the name first").otherwise("check boundary and anchors")
    )
    return d.select(
        "project", "road", "v.type", "v.family", "v.side", F.col("v.status").alias("name_status"), F.col("v.message").alias("name_warning"), "start_km", "end_km", "length_m", axis, "begin_route_m", "end_route_m", "axis_length_m",
        F.coalesce("begin_in_range", F.lit(False)).alias("begin_in_range"), F.coalesce("end_in_range", F.lit(False)).alias("end_in_range"), "begin_interval", "begin_interval_status", "begin_position_m", "begin_diagnosis", "begin_color", "begin_zones",
        "end_interval", "end_interval_status", "end_position_m", "end_diagnosis", "end_color", "end_zones", F.coalesce("objects", F.lit(0)).alias("objects"), F.coalesce("objects_on_axis", F.lit(0)).alias("objects_on_axis"),
        "object_from_km", "object_to_km", shift.alias("object_shift_m"), "boundary_status", "boundary_warning", "object_status", "object_warning", status.alias("status"), advice.alias("advice"),
    )


def control_list(boundaries: DataFrame, gaps: DataFrame) -> DataFrame:
    """(priority, status, category, road, point, main_message, context_message, axis_id, from_m, to_m): the rows that need action.

    Boundaries with a status other than ok: an ill name is the main message and all else context, otherwise the boundary is,
    with the objects as context. gaps: (road, axis_id, previous, name, kind, from, to), as of hard_gaps; all of them are rows.
    """
    named = F.col("name_status") != "ok"
    b = boundaries.where("status <> 'ok' or name_status <> 'ok' or boundary_status <> 'ok'").select(
        F.when(F.col("status") == "check", 2).otherwise(1).alias("priority"), "status", F.when(named, "name").otherwise("boundary").alias("category"), "road", F.col("project").alias("point"),
        F.when(named, F.col("name_warning")).otherwise(F.col("boundary_warning")).alias("main_message"), F.when(named, _joined([F.col("boundary_warning"), F.col("object_warning")])).otherwise(F.col("object_warning")).alias("context_message"),
        "axis_id", F.col("begin_route_m").alias("from_m"), F.col("end_route_m").alias("to_m"),
    )
    g = gaps.select(
        F.when(F.col("kind") == "gap", 2).otherwise(1).alias("priority"), F.when(F.col("kind") == "gap", "check").otherwise("attention").alias("status"), F.lit("coverage").alias("category"), "road", F.concat_ws(" > ", F.col("previous").cast("string"), F.col("name").cast("string")).alias("point"),
        F.concat(F.col("kind"), F.lit(" between projects")).alias("main_message"), F.lit("").alias("context_message"), "axis_id", F.col("from").cast("double").alias("from_m"), F.col("to").cast("double").alias("to_m"),
    )
    return b.unionByName(g)


def reference_summary(objects: DataFrame, project: str = "project") -> DataFrame:
    """(project, objects, usable, km_from, km_to, delta_from_m, delta_to_m, warning): a project's usable objects (usable, km_from,
    km_to) against the range of its name; null where none is usable."""
    r = name_range(project)
    use = lambda c: F.when(F.col("usable"), F.col(c))
    g = objects.where(F.col(project) != "").groupBy(project).agg(F.count("*").alias("objects"), F.count_if("usable").alias("usable"), F.min(use("km_from")).alias("km_from"), F.max(use("km_to")).alias("km_to"))
    d = g.withColumn("_r", r)
    return d.select(
        project, "objects", "usable", "km_from", "km_to", ((F.col("km_from") - F.col("_r.start")) * 1000).alias("delta_from_m"), ((F.col("km_to") - F.col("_r.end")) * 1000).alias("delta_to_m"),
        F.when(F.col("usable") == 0, "no usable object").when(F.col("usable") < F.col("objects"), "some objects are not usable").otherwise("").alias("warning"),
    )


def reference_objects(ranges: DataFrame, margin_km: float = 0.2, jump_km: float = 0.5, axis: str = "axis_id") -> DataFrame:
    """ranges of carriageway objects + (km_mid, name_from, name_to, outside_name, jump, usable): which of them may set a project's extent.

    outside_name: further than margin_km beyond the name's range; jump: more than jump_km from the object before it on the
    axis in its project. usable: projected, not outside, no jump.
    """
    d = ranges.withColumn("km_mid", (F.col("km_from") + F.col("km_to")) / 2).withColumn("_r", name_range("project")).withColumn("name_from", F.col("_r.start")).withColumn("name_to", F.col("_r.end")).drop("_r")
    w = W.partitionBy("project", axis).orderBy("km_from", "object_id")
    jump = F.coalesce(F.col("km_from") - F.lag("km_to").over(w) > jump_km, F.lit(False))
    out = F.coalesce((F.col("km_from") < F.col("name_from") - margin_km) | (F.col("km_to") > F.col("name_to") + margin_km), F.lit(False))
    return d.withColumn("outside_name", out).withColumn("jump", jump).withColumn("usable", (F.col("status") == "projected") & ~F.col("outside_name") & ~F.col("jump"))


def axis_diagnosis(objects: DataFrame, vertices: DataFrame, middles: DataFrame, segments: DataFrame, anchors: DataFrame, axes: DataFrame, zones: DataFrame, **limits) -> dict[str, DataFrame]:
    """The whole diagnosis as tables: ranges, extents, boundaries, reference, summary. Shared parts are stored once; limits go to project_boundaries."""
    ranges = materialize(object_ranges(objects, geometry_ranges(vertices, middles, segments), anchors), "diagnosis-ranges")
    reference = reference_objects(ranges.where("primary"))  # not stored: the summary needs few of its columns
    boundaries = project_boundaries(objects.where("project <> ''").select("project", "road"), axes, anchors, ranges, zones, **limits)
    return {"ranges": ranges, "extents": project_extents(ranges), "boundaries": boundaries, "reference": reference, "summary": reference_summary(reference)}
