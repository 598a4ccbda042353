"""Registered queries of proposals and axis diagnostics; importing this module adds them to those of plans.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.operators import diagnostics, intervals, proposals, reconcile, segment
from roadloom.plans.fixtures import fixture, oracle
from roadloom.plans.queries import CMP, DIFFS, ORACLE_SQL, PROFILE, QUERIES, RUNS, TRACK, asset, maint, query, _runs

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Tracks and the subtheme texts that they accept.
ACCEPTED = [("HRB", "rijstrook"), ("PWR", "parallelweg"), ("PWL", "parallelweg")]

_TENTHS = "cast(ceil({m} / 100) as bigint)"
_LABEL = f"case when {_TENTHS} < 100 then '0' else '' end || ({_TENTHS} // 10) || '.' || ({_TENTHS} % 10)"
PROP = RUNS + f""", prop as (select *, road || '-' || track || '-' || run as proposal_id, road || '-' || track || '-' || {_LABEL.format(m='start_m')} || '-' || {_LABEL.format(m='end_m')} as proposed,
 end_m - start_m as length_m, case when end_m - start_m <= 25 then 'micro' else 'regular' end as category from runs2)"""


def _proposals(spark, d):
    return proposals.proposal_table(segment.summarise_runs(_runs(spark, d), TRACK, PROFILE))


def _assigned(spark, d):
    return _runs(spark, d).withColumn("proposal_id", F.concat_ws("-", "road", "track", F.col("run").cast("string")))


@query(oracle("select proposal_id, road, track, run, proposed, length_m, category, objects from prop", PROP))
def project_proposals(spark, d):
    return _proposals(spark, d).select("proposal_id", "road", "track", "run", "proposed", "length_m", "category", "objects")


@query(oracle("""select *, case when difference = 'match' then 'ok' when difference in ('splits over proposals', 'joins projects') then 'check' else 'attention' end as status from lv""", PROP + """,
pairs as (select road || '-' || track || '-' || run as proposal_id, project as existing, count(*) as n from runs1 group by 1, 2),
named as (select p.*, q.proposed from pairs p join prop q on p.proposal_id = q.proposal_id),
lv as (select 'project' as level, existing as name, case when count(*) > 1 then 'splits over proposals' when bool_and(proposed = existing) then 'match' else 'name differs' end as difference, cast(sum(n) as bigint) as objects from named where existing <> '' group by existing
 union all select 'proposal', proposal_id, case when count(*) filter (existing <> '') = 0 then 'no existing project' when count(*) filter (existing <> '') > 1 then 'joins projects' when bool_or(existing <> '' and existing = proposed) then 'match' else 'name differs' end, cast(sum(n) as bigint) from named group by proposal_id)"""))
def proposal_comparison(spark, d):
    return proposals.compare_proposals(_proposals(spark, d), _assigned(spark, d).select("proposal_id", F.col("project").alias("existing")))


@query(oracle("select field, track, count(*) as proposals, round(count(*) * 100.0 / (select count(*) from runs2), 1) as share_pct from (select track, unnest(case when len(f) = 0 then ['none'] else f end) as field from t3) q group by 1, 2", RUNS + """,
t1 as (select *, lead(gap_before) over (partition by road, track order by run) as g, lead(layer) over (partition by road, track order by run) as nl, lead(year_layer) over (partition by road, track order by run) as ny from runs2),
t2 as (select *, case when g is null or g then cast([] as varchar[]) else list_filter([case when layer <> nl then 'layer' end, case when year_layer <> ny then 'year_layer' end], lambda x: x is not null) end as here from t1),
t3 as (select road, track, run, list_distinct(list_concat(here, coalesce(lag(here) over (partition by road, track order by run), cast([] as varchar[])))) as f from t2)"""))
def cut_reasons(spark, d):
    return proposals.cut_reasons(segment.transitions(segment.summarise_runs(_runs(spark, d), TRACK, PROFILE), TRACK, PROFILE), TRACK)


@query(oracle("""select *, kind not in ('micro', 'short') as listed, row_number() over (partition by road order by start_m, end_m, complex) as complex_no from (select road, proposed as complex, min(start_m) as start_m, max(end_m) as end_m, count(*) as parts, cast(sum(objects) as bigint) as objects,
 case when bool_and(category = 'micro') then 'micro' when count(*) > 1 then 'duplicate name' when max(end_m) - min(start_m) < 100 then 'short' else 'regular' end as kind from prop group by 1, 2) q""", PROP))
def visible_complexes(spark, d):
    return proposals.visible_complexes(_proposals(spark, d))


@query(oracle("select proposal_id, end_km, end_km >= max(end_km) over (partition by road) - 0.0001 and count(*) over (partition by road) >= 2 and length_m % 100 >= 15 as terminal from (select *, ceil(end_m / 100) / 10 as end_km from prop) q", PROP))
def terminal_attention(spark, d):
    p = _proposals(spark, d).withColumn("end_km", F.ceil(F.col("end_m") / 100) / 10)
    return proposals.terminal_attention(p.withColumn("bad", F.col("length_m") % 100 >= 15), "bad").select("proposal_id", "end_km", "terminal")


@query(oracle("select road || '-' || track || '-' || run as proposal_id, subtheme, count(*) as objects from runs1 where track in ('HRB', 'PWR', 'PWL') and subtheme <> case track when 'HRB' then 'rijstrook' else 'parallelweg' end group by 1, 2", RUNS))
def family_mismatches(spark, d):
    return proposals.family_mismatches(_proposals(spark, d), _assigned(spark, d), spark.createDataFrame(ACCEPTED, "track string, subtheme string"))


@query(oracle("""select n.road, n.track, n.objects, c.covered_m, c.span_m, round(c.covered_m * 100 / c.span_m, 1) as pct from (select road, track, count(*) as objects from fx_asset where track <> '' group by 1, 2) n
 join (select road, track, sum(e - s) as covered_m, max(e) - min(s) as span_m from (select road, track, island, min(start_m) as s, max(end_m) as e from
 (select *, sum(cut) over (partition by road, track order by start_m, end_m, object_id) as island from (select *, case when start_m - max(end_m) over (partition by road, track order by start_m, end_m, object_id rows between unbounded preceding and 1 preceding) <= 5 then 0 else 1 end as cut from fx_asset where track <> '') x) y
 group by 1, 2, 3) z group by 1, 2) c on n.road = c.road and n.track = c.track"""))
def track_coverage(spark, d):
    a = asset(spark, d).where("track <> ''")
    return proposals.coverage(a, TRACK, intervals.merge_intervals(a, TRACK, "start_m", "end_m", 5.0))


ZONES = "select axis_id, cast(round(hm_km * 10) as bigint) as zone, route_m as from_m, route_m + 30 as to_m, case when offset_m > 5 then 'red' else 'orange' end as color from fx_post where offset_m >= 5"
POINTS = "select object_id as point_id, road as axis_id, start_m + pk % 50 as route_m from fx_asset"


@query(oracle("select p.point_id, p.axis_id, p.route_m, max(color) as color, string_agg(cast(zone as varchar), ', ' order by zone) as zones from p left join z on p.axis_id = z.axis_id and p.route_m between z.from_m - 10 and z.to_m + 10 group by 1, 2, 3", f"p as ({POINTS}), z as ({ZONES})"))
def boundary_zones(spark, d):
    return diagnostics.boundary_zones(fixture(spark, d, POINTS), fixture(spark, d, ZONES), "point_id")


CANDIDATES = """select project, track as axis_id, cast(400 as double) as length_m, max(end_m) - min(start_m) as axis_length_m, min(pk) % 7 > 0 as in_range, count(*) as objects from fx_asset where project <> '' and track <> '' group by project, track"""


@query(oracle("select project, arg_min(axis_id, {'s': score, 'a': axis_id}) as axis_id, min(score) as score from (select *, abs(axis_length_m - length_m) + case when in_range then 0 else 100000 end - least(objects, 25) * 1000 as score from c) q group by 1", f"c as ({CANDIDATES})"))
def project_axis(spark, d):
    return diagnostics.choose_axis(fixture(spark, d, CANDIDATES), "project")


#: Posts; those of every seventh label are followed by six more, 8 mm apart each.
XY = """select axis_id as road, hm_km, route_m as x, offset_m as y from fx_post
 union all select axis_id, hm_km + k / 1000.0, avg(route_m) + 0.008 * k, avg(offset_m) from fx_post join (select 1 as k union all select 2 union all select 3 union all select 4 union all select 5 union all select 6) c on true where cast(round(hm_km * 10) as bigint) % 7 = 0 group by axis_id, hm_km, k"""


def thinned(select: str, points: str, near: str = "0.01") -> str:
    """SQL over axes (road, .., x, y, seq, route): points (road, .., x, y, i) without those near the last one kept, walked per stretch
    of points that lie closer together than twice that."""
    return "with recursive " + oracle(select, f"""pts as ({points}), cuts as (select *, sum(c) over (partition by road order by i) as stretch from (select *, case when sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) <= 2 * {near} then 0 else 1 end as c from pts window w as (partition by road order by i)) q),
walk as (select road, stretch, min(i) as i from cuts group by 1, 2
 union all select road, stretch, i from (select b.road, b.stretch, b.i, row_number() over (partition by b.road, b.stretch order by b.i) as k from walk a join cuts p on p.road = a.road and p.i = a.i join cuts b on b.road = a.road and b.stretch = a.stretch and b.i > a.i and sqrt((b.x - p.x) ** 2 + (b.y - p.y) ** 2) > {near}) r where k = 1),
axes as (select *, cast(cast(sum(cast(round(coalesce(d, 0) * 1e9) as bigint)) over (partition by road order by i) as bigint) as double) / 1e9 as route, row_number() over (partition by road order by i) as seq from (select c.*, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as d, count(*) over (partition by c.road) as n from cuts c join walk k on k.road = c.road and k.i = c.i window w as (partition by c.road order by c.i)) s where n > 1)""").removeprefix("with ")


@query(thinned("select road, hm_km, points, cast(round(route * 100) as bigint) as route_cm from axes", f"select *, row_number() over (partition by road order by hm_km) as i from (select road, round(hm_km, 3) as hm_km, avg(x) as x, avg(y) as y, count(*) as points from ({XY}) r group by 1, 2) q"))
def reference_axis(spark, d):
    return diagnostics.reference_axis(fixture(spark, d, XY)).select("road", "hm_km", "points", F.round(F.col("route_m") * 100).cast("bigint").alias("route_cm"))


GROUPS = "select road, track, project, min(start_m) as hm_min, max(end_m) as hm_max, min(start_m) + (min(pk) % 3) * 400 as route_m from fx_asset where project <> '' and track <> '' group by road, track, project"


@query(oracle("""select road, track, project, cluster, order_no, coalesce(hm_min < lag(hm_max) over (partition by road, track order by order_no), false) as overlaps, coalesce(route_m < lag(route_m) over (partition by road, track order by order_no), false) as falls_back,
 count(*) over (partition by road, track, hm_min, route_m) > 1 as duplicate from g3""", f"""g as ({GROUPS}),
g1 as (select *, case when hm_min < max(hm_max) over (partition by road, track order by hm_min, hm_max, project rows between unbounded preceding and 1 preceding) or abs(hm_min - lag(hm_min) over (partition by road, track order by hm_min, hm_max, project)) <= 1e-4 then 0 else 1 end as c from g),
g2 as (select *, cast(sum(c) over (partition by road, track order by hm_min, hm_max, project) as bigint) as cluster from g1),
g3 as (select *, row_number() over (partition by road, track order by cluster, route_m, hm_min, project) as order_no from g2)"""))
def group_order(spark, d):
    o = diagnostics.order_diagnostics(diagnostics.overlap_clusters(fixture(spark, d, GROUPS), TRACK, "project"), TRACK)
    return o.select(*TRACK, "project", "cluster", "order_no", "overlaps", "falls_back", "duplicate")


BUCKETS = "select road, track, blk, start_m + case when pk % 97 = 0 then 1500 else 0 end as route_m from fx_asset where track <> ''"


@query(oracle("select road, track, blk, count(*) as objects, max(route_m) - min(route_m) as span_m, case when max(route_m) - min(route_m) > 1000 then 'check' else 'info' end as severity from b group by 1, 2, 3 having count(*) > 1", f"b as ({BUCKETS})"))
def bucket_diagnostics(spark, d):
    return diagnostics.bucket_diagnostics(fixture(spark, d, BUCKETS), [*TRACK, "blk"])


@query(oracle("""select project_key, '' as object_key, 'CREATE_PROJECT_OR_CHECK_EXPORT' as suggestion, project_key as proposed from cmp where status = 'MISSING_IN_MAINTENANCE'
 union all select project_key, '', 'CHECK_PROJECT_WITHOUT_OBJECTS', '' from cmp where status = 'NO_ASSET_OBJECTS'
 union all select d.project_key, d.object_key, case d.difference when 'only_in_asset' then 'CHECK_LINK_IN_MAINTENANCE' when 'only_in_maintenance' then 'CHECK_LINK_IN_ASSET' when 'suspicious_road' then 'CHECK_ROAD' else 'CHECK_CHAINAGE' end, '' from diffs d join cmp c on d.project_key = c.project_key where c.status <> 'OK_COMPLETE'""", CMP))
def mutation_suggestions(spark, d):
    a, m = reconcile.stored_sides(asset(spark, d), maint(spark, d))
    return reconcile.mutation_suggestions(reconcile.compare_projects(a, m), reconcile.object_differences(a, m))


@query(oracle("""select coalesce(x.project_key, y.project_key) as project_key, coalesce(x.object_key, y.object_key) as object_key, coalesce(x.n, 0) as asset_rows, coalesce(y.n, 0) as maint_rows, coalesce(w.differences, '') as differences
 from (select project_key, object_no as object_key, count(*) as n from a where project_key <> '' group by 1, 2) x full join (select project_key, object_no as object_key, count(*) as n from m group by 1, 2) y on x.project_key = y.project_key and x.object_key = y.object_key
 left join (select project_key, object_key, string_agg(difference, ', ' order by difference) as differences from (select distinct project_key, object_key, difference from diffs) q group by 1, 2) w on w.project_key = coalesce(x.project_key, y.project_key) and w.object_key = coalesce(x.object_key, y.object_key)""", DIFFS))
def project_objects(spark, d):
    a, m = reconcile.stored_sides(asset(spark, d), maint(spark, d))
    return reconcile.project_objects(a, m, reconcile.object_differences(a, m))
