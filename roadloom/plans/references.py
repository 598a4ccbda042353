"""Registered queries of geometry measures, references, concept rows and change logs; importing this module adds them to the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.operators import changes, linear, proposals, reconcile, references, segment
from roadloom.plans.cyclepaths import BENT, ORACLE_SQL, QUERIES, TURNED, _bent
from roadloom.plans.fixtures import fixture, oracle
from roadloom.plans.proposals import PROP, _assigned, _proposals, thinned
from roadloom.plans.queries import A, ABSORB, DIFFS, PROFILE, RUNS, SEG, TRACK, asset, maint, query, _runs, _segments

__all__ = ["ORACLE_SQL", "QUERIES"]

BENT_CTE = f"tl as ({TURNED}), bent as ({BENT})"


@query(oracle("select object_id, cast(round(sum(coalesce(l, 0)) * 1000) as bigint) as length_mm from (select *, sqrt((lead(x) over w - x) ** 2 + (lead(y) over w - y) ** 2) as l from bent window w as (partition by object_id order by seq)) q group by 1", BENT_CTE))
def line_lengths(spark, d):
    return references.line_lengths(_bent(spark, d)).select("object_id", F.round(F.col("length_m") * 1000).cast("bigint").alias("length_mm"))


#: Strips along the road with a hole in every third of them.
AREAS = """select object_id, cast(0 as bigint) as part, hole, k as seq, case when k in (1, 4) then l + hole else h - hole end as x, case when k in (1, 2) then b + hole else b + 6 - hole end as y
 from (select object_id, x1 as l, x2 + 3 as h, y1 as b, s.hole, t.k from fx_line join (select cast(0 as bigint) as hole union all select cast(1 as bigint)) s on s.hole = 0 or object_id % 3 = 0 join (select 1 as k union all select 2 union all select 3 union all select 4) t on true) q"""


@query(oracle("select object_id, (x2 + 3 - x1) * 6 - case when object_id % 3 = 0 then (x2 + 1 - x1) * 4 else 0 end as area_m2, 2 * (x2 + 3 - x1 + 6) + case when object_id % 3 = 0 then 2 * (x2 + 1 - x1 + 4) else 0 end as perimeter_m from fx_line"))
def polygon_areas(spark, d):
    return references.polygon_areas(fixture(spark, d, AREAS))


@query(oracle("select axis_id, seq, x, y from (select *, row_number() over (partition by axis_id order by seq) - 1 as i, count(*) over (partition by axis_id) as n from fx_vertex) q where n <= 20 or (i % greatest(1, n // 20) = 0 and i // greatest(1, n // 20) < 20)"))
def sample_vertices(spark, d):
    return references.sample_vertices(fixture(spark, d, "select * from fx_vertex"), "axis_id", 20)


@query(oracle("""select axis_id, unnest(case when n > 500 then list_distinct(list_transform(range(0, 500), lambda i: p[cast(floor(i * (n - 1) / 499) as bigint) + 1])) else p end) as position_m from (select axis_id, p, len(p) as n from (select axis_id,
 list_sort(list_distinct(list_concat(list_transform(range(0, 26), lambda i: round(len * i / 25, 3)), list_transform(range(0, cast(floor(len / 100) as bigint) + 1), lambda i: round(i * 100.0, 3))))) as p from (select axis_id, sum(length) as len from seg group by 1) a) b) c""", SEG))
def axis_samples(spark, d):
    return linear.sample_positions(linear.axis_lengths(_segments(spark, d)))


#: External segments: the axes, shifted by up to 40 m sideways, every ninth missing.
REFS = "select road || '-' || cast(idx as varchar(19)) as segment_id, road, min(ok) as link, cast(idx * 25 as double) as x1, cast(idx * 25 + 480 as double) as x2, cast(1000 * rd + (idx * 7) % 40 as double) as y1, cast(1000 * rd + (idx * 7) % 40 as double) as y2, cast(idx as double) / 40 as begin_km, cast(idx as double) / 40 + 0.5 as end_km from fx_asset where ln = 1 and idx % 20 = 0 and (idx / 20) % 9 <> 4 group by road, rd, idx"
SAMPLES = "select road || ':' || cast(idx as varchar(19)) as point_id, road as axis_id, cast(idx * 25 as double) as x, cast(1000 * rd as double) as y from fx_asset where ln = 1 and idx % 4 = 0 group by road, rd, idx"
_T = "greatest(0, least(1, ((p.x - s.x1) * (s.x2 - s.x1) + (p.y - s.y1) * (s.y2 - s.y1)) / greatest((s.x2 - s.x1) ** 2 + (s.y2 - s.y1) ** 2, 1e-300)))"
NEAREST = f"""rf as ({REFS}), sm as ({SAMPLES}), nq as (select point_id, axis_id, min(d) as d, arg_min(segment_id, {{'d': d, 's': segment_id}}) as segment_id from (select p.point_id, p.axis_id, s.segment_id, sqrt((p.x - s.x1 - {_T} * (s.x2 - s.x1)) ** 2 + (p.y - s.y1 - {_T} * (s.y2 - s.y1)) ** 2) as d
 from sm p join rf s on true) q group by 1, 2)"""


def _nearest(spark, d):
    return references.nearest_segments(fixture(spark, d, SAMPLES), fixture(spark, d, REFS), ["link"])


@query(oracle("select sm.point_id, cast(round(nq.d * 100) as bigint) as distance_cm, nq.segment_id, rf.link from sm left join nq on nq.point_id = sm.point_id left join rf on rf.segment_id = nq.segment_id", NEAREST))
def nearest_segments(spark, d):
    return _nearest(spark, d).select("point_id", F.round(F.col("distance_m") * 100).cast("bigint").alias("distance_cm"), "segment_id", "link")


@query(oracle("select sm.axis_id, count(*) as samples, cast(round(min(d) * 100) as bigint) as min_cm, cast(round(max(d) * 100) as bigint) as max_cm, case when max(d) > 25 or count(d) < count(*) then 'check' else 'ok' end as status from sm left join nq on nq.point_id = sm.point_id group by 1", NEAREST))
def compared_axes(spark, d):
    c = references.compare_axes(_nearest(spark, d))
    return c.select("axis_id", "samples", F.round(F.col("min_m") * 100).cast("bigint").alias("min_cm"), F.round(F.col("max_m") * 100).cast("bigint").alias("max_cm"), "status")


POSTS = "select ' ' || lower(road) || '-' || cast(idx - idx % 20 as varchar(19)) || '.0' as segment_id, cast(idx as double) / 4 as hectometre from fx_asset where ln = 1 and idx % 4 = 0 group by road, idx"
POST_CTE = f"rf as ({REFS}), po as (select *, replace(upper(trim(segment_id)), '.0', '.0') as k from ({POSTS}) q)"


@query(oracle("select segment_id, hectometre from po where k in (select upper(segment_id) || '.0' from rf)", POST_CTE))
def posts_of_segments(spark, d):
    refs = fixture(spark, d, REFS).select(F.concat("segment_id", F.lit(".0")).alias("segment_id"))
    return references.posts_of_segments(fixture(spark, d, POSTS), refs)


@query(oracle("""select s.road, s.segments, s.segments as segment_ids, s.km_from, s.km_to, coalesce(p.posts, 0) as posts, p.lo as post_km_from, p.hi as post_km_to, case when p.posts > 0 then 'found' else 'no posts' end as status from (select road, count(*) as segments, min(begin_km) as km_from, max(end_km) as km_to from rf group by 1) s
 left join (select rf.road, count(*) as posts, min(hectometre) / 10 as lo, max(hectometre) / 10 as hi from po join rf on po.k = upper(rf.segment_id) || '.0' group by 1) p on p.road = s.road""", POST_CTE))
def reference_sources(spark, d):
    refs = fixture(spark, d, REFS).withColumn("segment_id", F.concat("segment_id", F.lit(".0")))
    return references.reference_sources(refs, fixture(spark, d, POSTS))


#: Every fifth bucket is followed by five more, 8 mm apart each.
CENTRES = """select road, blk as section, cast(floor(idx / 4) as double) / 10 as km, (start_m + end_m) / 2 as x, cast(1000 * rd + ln as double) as y, end_m - start_m as weight from fx_asset where track <> ''
 union all select road, blk, cast(floor(min(idx) / 4) as double) / 10 + k / 10000.0, sum((start_m + end_m) / 2 * (end_m - start_m)) / sum(end_m - start_m) + 0.008 * k, sum((1000 * rd + ln) * (end_m - start_m)) / sum(end_m - start_m), 1.0
 from fx_asset join (select 1 as k union all select 2 union all select 3 union all select 4 union all select 5) c on true where track <> '' and floor(idx / 4) % 5 = 0 group by road, blk, floor(idx / 4), k"""


@query(thinned("select road, seq, section, km, cast(round(route * 100) as bigint) as route_cm from axes", f"select road, section, km, x, y, row_number() over (partition by road order by section, km, x) as i from (select road, section, round(km, 4) as km, sum(x * weight) / sum(weight) as x, sum(y * weight) / sum(weight) as y from ({CENTRES}) ce group by 1, 2, 3) b"))
def local_axis(spark, d):
    return references.local_axis(fixture(spark, d, CENTRES)).select("road", "seq", "section", "km", F.round(F.col("route_m") * 100).cast("bigint").alias("route_cm"))


@query(oracle("""select p.proposal_id, case when contains(p.proposed, 'FP') then 'FP' when contains(p.proposed, '-HRB') then 'HRB' else 'PW' end as sheet, p.proposed as new_name, p.start_m as cut_from_m, p.end_m as cut_to_m, coalesce(c.contracts, '') as contracts, coalesce(m.layer, '') as layer from prop p
 left join (select road || '-' || track || '-' || run as proposal_id, string_agg(contract, ', ' order by contract) filter (where k <= 4) || case when max(k) > 4 then ' (+' || (max(k) - 4) || ')' else '' end as contracts from
  (select road, track, run, contract, row_number() over (partition by road, track, run order by contract) as k from (select distinct road, track, run, contract from runs1 where contract <> '') x) y group by 1) c on c.proposal_id = p.proposal_id
 left join (select road || '-' || track || '-' || run as proposal_id, arg_min(layer, {'n': -n, 'l': layer}) as layer from (select road, track, run, layer, count(*) as n from runs1 where layer <> '' group by all) x group by 1) m on m.proposal_id = p.proposal_id""", PROP))
def concept_rows(spark, d):
    p = _proposals(spark, d).select("proposal_id", F.lit("").alias("type"), F.lit("").alias("family"), "proposed", F.lit(None).cast("string").alias("existing"), (F.col("start_m") / 1000).alias("start_km"), (F.col("end_m") / 1000).alias("end_km"), F.lit("").alias("note"))
    m = _assigned(spark, d).select("proposal_id", F.lit("").alias("name"), F.col("subtheme").alias("info"), "contract", "layer")
    return references.concept_rows(p, m, ["layer"]).select("proposal_id", "sheet", "new_name", "cut_from_m", "cut_to_m", "contracts", "layer")


@query(oracle("select distinct r.road || '-' || r.track || '-' || r.run as proposal_id, o.object_id from runs1 r join a o on o.project_key = upper(trim(r.project)) where r.project <> ''", A + ", " + PROP))
def proposal_project_objects(spark, d):
    c = _assigned(spark, d).select("proposal_id", F.col("project").alias("existing"))
    return references.proposal_project_objects(c, asset(spark, d).select("object_id", "project")).select("proposal_id", "object_id")


@query(oracle("select road, min(least(x1, x2)) as min_x, cast(min(least(y1, y2)) as double) as min_y, max(greatest(x1, x2)) as max_x, cast(max(greatest(y1, y2)) as double) as max_y, count(*) as objects from fx_line group by 1"))
def bounding_boxes(spark, d):
    return references.bounding_boxes(fixture(spark, d, "select road, x1, x2, cast(y1 as double) as y1, cast(y2 as double) as y2 from fx_line"), "road")


@query(oracle("select object_id, project, road from fx_asset"))
def plain_columns(spark, d):
    a = asset(spark, d).select("object_id", "project", "road", F.lit("POINT (0 0)").alias("gps_wkt"), F.lit("x").alias("Geometry"))
    return references.without_geometry(a)


@query(oracle("select object_id, field, old, value, seq from (select object_id, 'layer' as field, nullif(layer, '') as old, case when pk % 5 = 0 then 'L7' else nullif(layer, '') end as value, case when pk % 10 = 0 then 4 else 1 end as seq from fx_asset) q where old is distinct from value union all select object_id, 'layer', null, 'L1', 3 from fx_asset where pk % 10 = 0"))
def appended_changes(spark, d):
    a = asset(spark, d)
    log = a.where("pk % 10 = 0").select("object_id", F.lit("layer").alias("field"), F.lit("L1").alias("value"), F.lit(0).cast("timestamp").alias("ts"), F.lit(3).cast("long").alias("seq"))
    new = a.withColumn("layer", F.when(F.col("pk") % 5 == 0, "L7").otherwise(F.col("layer")))
    return changes.append_changes(log, a, new, "object_id", ["layer"], "2026-01-01 00:00:00").select("object_id", "field", "old", "value", "seq")


@query(oracle("select 'import' as profile, contract as field from (select distinct contract from fx_asset where contract <> '') q"))
def profile_gaps(spark, d):
    a = asset(spark, d)
    wanted = a.where("contract <> ''").select("contract").distinct().union(spark.createDataFrame([("layer",)], "contract string")).select(F.lit("import").alias("profile"), F.col("contract").alias("field"))
    return changes.profile_gaps(a, wanted)


@query(oracle("select object_id from fx_asset where contains(lower(concat_ws(' ', object_no, road, subtheme, project, layer)), 'hrb-01') and pk % 5 = 0"))
def changed_object_search(spark, d):
    a = asset(spark, d)
    return changes.search_objects(a, " HRB-01 ", ["object_no", "road", "subtheme", "project", "layer"], a.where("pk % 5 = 0")).select("object_id")


@query(oracle("select layer, road, project_key from (select project_key, road, layer from (select project_key, arg_min(road, {'n': -n, 'v': road}) as road from (select project_key, road, count(*) as n from a where project_key <> '' group by 1, 2) x group by 1) r left join (select project_key as pk2, arg_min(layer, {'n': -n, 'v': layer}) as layer from (select project_key, layer, count(*) as n from a where project_key <> '' and layer <> '' group by 1, 2) y group by 1) l on l.pk2 = r.project_key) z", A))
def common_values(spark, d):
    a = reconcile.project_key("project")
    return references.most_common(asset(spark, d).withColumn("project_key", a).where("project_key <> ''"), "project_key", ["road", "layer"])


@query(oracle("""select road, track, run, part_of, case when (layer <> al and layer <> '') or (year_layer <> ay and year_layer <> '') then 'technical deviation' else 'missing values' end as kind, concat_ws(', ', case when layer <> al then 'layer' end, case when year_layer <> ay then 'year_layer' end) as fields from
 (select m.road, m.track, m.run, m.part_of, r.layer, r.year_layer, a.layer as al, a.year_layer as ay from (select road, track, x.run as part_of, unnest(x.members) as run from ab) m join runs2 r on r.road = m.road and r.track = m.track and r.run = m.run join runs2 a on a.road = m.road and a.track = m.track and a.run = m.part_of where m.run <> m.part_of) q
 where layer <> al or year_layer <> ay""", ABSORB))
def local_deviations(spark, d):
    runs = segment.summarise_runs(_runs(spark, d), TRACK, PROFILE)
    out = segment.local_deviations(runs, segment.absorb_deviations(runs, TRACK, PROFILE), TRACK, PROFILE)
    return out.withColumn("fields", F.array_join("fields", ", "))


@query(oracle("""select road, track, run, case when g is null then 'end of track' when g then 'gap' when layer = nl and year_layer = ny then 'no technical cut' else (case when layer <> nl and (layer = '' or nl = '') then 'check structural cut: ' else 'hard technical cut: ' end) || concat_ws(', ', case when layer <> nl then 'layer' end, case when year_layer <> ny then 'year_layer' end)
 || case when len(c) > 0 and len(nc) > 0 and not list_has_any(c, nc) then '; contract changes too' else '' end end as reason from (select *, lead(gap_before) over w as g, lead(layer) over w as nl, lead(year_layer) over w as ny, lead(c) over w as nc
 from (select r.*, coalesce(k.c, []) as c from runs2 r left join (select road, track, run, list(distinct contract) filter (contract <> '') as c from runs1 group by 1, 2, 3) k on k.road = r.road and k.track = r.track and k.run = r.run) x window w as (partition by road, track order by run)) q""", RUNS))
def contract_transitions(spark, d):
    objects = _runs(spark, d)
    contracts = objects.groupBy(*TRACK, "run").agg(F.array_sort(F.collect_set(F.nullif("contract", F.lit("")))).alias("contracts"))
    return segment.transitions(segment.summarise_runs(objects, TRACK, PROFILE), TRACK, PROFILE, contracts).select(*TRACK, "run", "reason")


ZONED = "smp as (select road as axis_id, start_m as position_m, cast(max(blk * 7 % 31) as double) as distance_m from fx_asset group by 1, 2)"


@query(oracle("""select axis_id, zone, case when from_m <= edge and len - to_m <= edge then 'begin and end' when from_m <= edge then 'begin' when len - to_m <= edge then 'end' when to_m - from_m >= greatest(300, 3 * greatest(step, 1)) then 'long' else 'local' end as type
 from (select z.*, l.len, greatest(150, l.len * 0.02) as edge, s.step from (select axis_id, zone, min(position_m) as from_m, max(position_m) as to_m from (select *, cast(sum(c) over (partition by axis_id order by position_m) as bigint) as zone from
 (select s.axis_id, position_m, distance_m, case when position_m - lag(position_m) over (partition by s.axis_id order by position_m) <= greatest(1.5 * t.m, 10) then 0 else 1 end as c from smp s join (select axis_id, median(st) as m from (select axis_id, position_m - lag(position_m) over (partition by axis_id order by position_m) as st from smp) q group by 1) t on s.axis_id = t.axis_id where distance_m > 10) r) u group by 1, 2) z
 join (select axis_id, sum(length) as len from seg group by 1) l on l.axis_id = z.axis_id join (select axis_id, median(st) as step from (select axis_id, position_m - lag(position_m) over (partition by axis_id order by position_m) as st from smp) q where st > 0 group by 1) s on s.axis_id = z.axis_id) y""", SEG + ", " + ZONED))
def zone_types(spark, d):
    s = fixture(spark, d, "select road as axis_id, start_m as position_m, cast(max(blk * 7 % 31) as double) as distance_m from fx_asset group by road, start_m")
    return linear.zone_types(linear.deviation_zones(s), linear.axis_lengths(_segments(spark, d)), s).select("axis_id", "zone", "type")


@query(oracle("""select road, complex, parts, case when am then 'micro' when parts > 1 then 'duplicate name' when sm then 'micro' when len < 100 then 'short' when mm then 'family mismatch' when df then 'name difference' else 'regular' end as kind from (select p.road, p.proposed as complex, count(*) as parts, bool_and(category = 'micro') as am, bool_or(category = 'micro') as sm,
 max(end_m) - min(start_m) as len, bool_or(coalesce(f.mm, false)) as mm, bool_or(coalesce(f.df, false)) as df from prop p left join (select road || '-' || track || '-' || run as proposal_id, bool_or(contract = 'B-7') as mm, bool_or(project <> '' and project not like '%00.0%') as df from runs1 group by 1) f on f.proposal_id = p.proposal_id group by 1, 2) q""", PROP))
def flagged_complexes(spark, d):
    flags = _assigned(spark, d).groupBy("proposal_id").agg(F.bool_or(F.col("contract") == "B-7").alias("mismatch"), F.bool_or((F.col("project") != "") & ~F.col("project").like("%00.0%")).alias("differs"))
    return proposals.visible_complexes(_proposals(spark, d), flags=flags).select("road", "complex", "parts", "kind")


@query(oracle("""select coalesce(x.project_key, y.project_key) as project_key, coalesce(x.object_key, y.object_key) as object_key, coalesce(x.k, y.k) as row_no, x.project_key is not null as in_asset, y.measure, coalesce(w.differences, '') as differences
 from (select *, object_no as object_key, row_number() over (partition by project_key, object_no) as k from a where project_key in (select project_key from diffs)) x
 full join (select *, object_no as object_key, row_number() over (partition by project_key, object_no order by measure) as k from m where project_key in (select project_key from diffs)) y on x.project_key = y.project_key and x.object_key = y.object_key and x.k = y.k
 left join (select project_key, object_key, string_agg(difference, ', ' order by difference) as differences from (select distinct project_key, object_key, difference from diffs) q group by 1, 2) w on w.project_key = coalesce(x.project_key, y.project_key) and w.object_key = coalesce(x.object_key, y.object_key)""", DIFFS))
def control_point_details(spark, d):
    a, m = reconcile.stored_sides(asset(spark, d), maint(spark, d))
    return reconcile.control_point_details(a, m, reconcile.object_differences(a, m)).select("project_key", "object_key", "row_no", F.col("asset_object_no").isNotNull().alias("in_asset"), F.col("maint_measure").alias("measure"), "differences")
