"""Registered queries: every operator applied to the derived tables, with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions import names, text
from roadloom.functions.shared import materialize
from roadloom.operators import changes, graph, intervals, linear, quality, reconcile, segment
from roadloom.plans.fixtures import fixture, oracle

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}
PROFILE = ["layer", "year_layer"]
TRACK = ["road", "track"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def asset(spark, d) -> DataFrame:
    return fixture(spark, d, "select * from fx_asset")


def maint(spark, d) -> DataFrame:
    return fixture(spark, d, "select * from fx_maintenance")


# Texts that recur in the oracles.
KM = "case when try_cast(replace({c}, ',', '.') as double) < 90000 then try_cast(replace({c}, ',', '.') as double) end"
PKEY = "upper(regexp_replace(trim({c}), '\\s*-\\s*', '-', 'g'))"
A = "a as (select *, " + PKEY.format(c="project") + " as project_key, " + KM.format(c="chainage_text") + " as km, lower(trim(subtheme)) in ('rijstrook','parallelweg','landbouwpad','busbaan','fietspad') as prim, lower(trim(subtheme)) = 'carpoolplaats' as exempt from fx_asset)"
M = "m as (select *, " + PKEY.format(c="project") + " as project_key from fx_maintenance)"
DIFFS = A + ", " + M + """, pa as (select distinct project_key, object_no as object_key from a where project_key <> ''), pm as (select distinct project_key, object_no as object_key from m),
diffs as (select project_key, object_key, 'only_in_asset' as difference, '' as chainage from pa where (project_key, object_key) not in (select (project_key, object_key) from pm)
 union all select project_key, object_key, 'only_in_maintenance', '' from pm where (project_key, object_key) not in (select (project_key, object_key) from pa)
 union all select project_key, object_key, 'suspicious_road', '' from pm where regexp_extract(project_key, '\\b(N\\d{3,4})\\b', 1) <> regexp_extract(object_key, '\\b(N\\d{3,4})\\b', 1)
 union all select project_key, object_no, 'invalid_chainage', case when chainage_text = 'nan' then '' else chainage_text end from a where project_key <> '' and km is null)"""
AP = """ap as (select project_key, count(*) as asset_rows, count(distinct object_no) as asset_objects, count(*) filter (where prim) as asset_primary, count(*) filter (where not prim) as asset_secondary,
 count(*) filter (where exempt) as asset_exempt, count(*) filter (where km is null) as bad_chainages, min(km) as hm_min, max(km) as hm_max from a where project_key <> '' group by 1)"""
MP = """mp as (select project_key, count(*) as maint_rows, count(distinct object_no) as maint_objects, count(distinct measure) as measures,
 sum(cast(replace(amount, ',', '.') as double)) as amount, sum(cast(price as double)) as price from m group by 1)"""
DC = """dc as (select project_key, count(*) filter (where difference = 'only_in_asset') as only_in_asset, count(*) filter (where difference = 'only_in_maintenance') as only_in_maintenance,
 count(*) filter (where difference = 'suspicious_road') as suspicious_road, count(*) filter (where difference = 'invalid_chainage') as invalid_chainage from diffs group by 1)"""
CMP = DIFFS + ", " + AP + ", " + MP + ", " + DC + """, j0 as (select coalesce(ap.project_key, mp.project_key) as project_key, ap.asset_rows, mp.maint_rows, ap.asset_objects, mp.maint_objects, ap.asset_primary from ap full join mp on ap.project_key = mp.project_key),
cmp as (select j0.project_key, regexp_extract(j0.project_key, '\\b(N\\d{3,4})\\b', 1) as road, asset_rows, maint_rows, asset_objects, maint_objects, asset_primary, coalesce(only_in_asset, 0) as only_in_asset, coalesce(only_in_maintenance, 0) as only_in_maintenance,
 coalesce(suspicious_road, 0) as suspicious_road, coalesce(invalid_chainage, 0) as invalid_chainage,
 case when asset_rows > 0 and maint_rows > 0 then case when coalesce(suspicious_road, 0) > 0 then 'OBJECT_ROAD_SUSPICIOUS' when coalesce(only_in_asset, 0) + coalesce(only_in_maintenance, 0) > 0 then 'OBJECT_DIFFERENCE'
   when coalesce(invalid_chainage, 0) > 0 then 'CHAINAGE_SUSPICIOUS' else 'OK_COMPLETE' end when maint_rows is null then 'MISSING_IN_MAINTENANCE' else 'NO_ASSET_OBJECTS' end as status
 from j0 left join dc on j0.project_key = dc.project_key)"""


@query(oracle("select object_id, case when layer = '' then null else layer end as layer, replace(year_layer, '.0', '') as year_text, km as chainage, cast(replace(year_layer, '.0', '') as bigint) as year_no, replace(year_layer, '.0', '') as year_profile, replace(year_layer, '.0', '') || '/0' as year_month, side || '|' || lower(trim(subtheme)) as theme from a", A))
def clean_values(spark, d):
    a = asset(spark, d)
    ym = text.date_year_month("year_layer")
    return a.select("object_id", text.clean_text("layer").alias("layer"), text.display_text("year_layer").alias("year_text"), text.chainage_km("chainage_text").alias("chainage"), text.safe_int("year_layer").alias("year_no"), text.profile_value("year_layer").alias("year_profile"), F.concat_ws("/", ym["year"].cast("string"), ym["month"].cast("string")).alias("year_month"), F.concat_ws("|", "side", text.normal_text("subtheme")).alias("theme"))


@query("select l_orderkey, l_linenumber, cast(l_extendedprice as double) as plain, cast(cast(l_quantity as bigint) as double) as lead_number, cast(l_quantity as bigint) + cast(l_linenumber as bigint) as total from lineitem")
def parse_numbers(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    english = F.format_number(F.col("l_extendedprice").cast("double"), 2)
    dutch = F.translate(english, ",.", ".,")
    label = F.concat(F.lit("hm "), F.col("l_quantity").cast("bigint").cast("string"), F.lit(" - "), F.col("l_linenumber").cast("string"))
    return li.select("l_orderkey", "l_linenumber", text.positive_number(F.concat(F.lit("EUR "), dutch)).alias("plain"), F.element_at(text.numbers_in(label), 1).alias("lead_number"), F.aggregate(text.numbers_in(label), F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("total"))


@query(oracle("select distinct project_key, regexp_extract(project_key, '^(N\\d+)-', 1) as road, regexp_extract(project_key, '^N\\d+-([A-Z]+)-', 1) as category, least(cast(regexp_extract(project_key, '-([0-9.]+)-[0-9.]+$', 1) as double), cast(regexp_extract(project_key, '-([0-9.]+)$', 1) as double)) as hm_start, greatest(cast(regexp_extract(project_key, '-([0-9.]+)-[0-9.]+$', 1) as double), cast(regexp_extract(project_key, '-([0-9.]+)$', 1) as double)) as hm_end, regexp_extract(project_key, '-(HRB|PW|FP)', 1) as family, regexp_extract(project_key, '-(?:HRB|PW|FP)([RL]?)-', 1) as side from a where project_key <> ''", A))
def parse_project_names(spark, d):
    p = asset(spark, d).select(text.project_key("project").alias("project_key")).where("project_key <> ''").distinct()
    n, = [names.name_parts("project_key")]
    t = names.type_family(n["category"])
    return p.select("project_key", n["road"].alias("road"), n["category"].alias("category"), n["hm_start"].alias("hm_start"), n["hm_end"].alias("hm_end"), t["family"].alias("family"), t["side"].alias("side"))


#: Whether a name's begin is not before its end.
TURNED_NAME = "cast(regexp_extract(project, '-([0-9.]+)-[0-9.]+$', 1) as double) >= cast(regexp_extract(project, '-([0-9.]+)$', 1) as double)"


@query(oracle(f"""select distinct project, road, case when regexp_extract(project, '^(N\\d+)', 1) <> 'N350' or not regexp_matches(project, '^N\\d{{3,4}}-[A-Z0-9]+-\\d{{2,3}}\\.\\d-\\d{{2,3}}\\.\\d$') or {TURNED_NAME} then 'check' else 'ok' end as status,
 concat_ws('; ', case when regexp_extract(project, '^(N\\d+)', 1) <> 'N350' then 'road in name (' || regexp_extract(project, '^(N\\d+)', 1) || ') differs from (N350)' end, case when {TURNED_NAME} then 'begin is not before end' end) as message from fx_asset where project <> ''"""))
def validate_project_names(spark, d):
    p = asset(spark, d).where("project <> ''").select("project", "road").distinct()
    v = names.validate_name("project", F.lit("N350"))
    return p.select("project", "road", v["status"].alias("status"), v["message"].alias("message"))


@query("""with p as (select distinct l_partkey as m from lineitem), q as (select m, cast(floor(m / 100) as bigint) * 100 as base, m % 100 as off, cast(floor((m + 50) / 100) as bigint) as near from p)
select m, (base + case when off = 0 then 0 else least(greatest(cast(floor((off + 2.5) / 5) as bigint) * 5, 5), 95) end) / 1000.0 as five_m, ceil(m / 100.0) / 10.0 as tenth,
 near / 10.0 as nearest, abs(m - near * 100) <= 2 as snapped, case when abs(m - near * 100) <= 2 then near / 10.0 else ceil(m / 100.0) / 10.0 end as effective,
 cast(greatest(0, near * 1000 - 975) as bigint) as zone_from_dm, cast(near * 1000 + 25 as bigint) as zone_to_dm from q""")
def round_chainages(spark, d):
    p = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("m")).distinct().withColumn("km", F.col("m") / 1000.0)
    s, z = names.snap_label("km"), names.name_zone("km")
    return p.select("m", names.round_to_5m("km").alias("five_m"), names.tenth_up("km").alias("tenth"), s["nearest_hm_km"].alias("nearest"), s["snapped"].alias("snapped"), s["effective_km"].alias("effective"), F.round(z["lower"] * 10000).cast("bigint").alias("zone_from_dm"), F.round(z["upper"] * 10000).cast("bigint").alias("zone_to_dm"))


@query(oracle("select * from ap", A + ", " + AP))
def asset_projects(spark, d):
    return reconcile.asset_projects(asset(spark, d))


@query(oracle("select project_key, maint_rows, maint_objects, measures, cast(round(amount * 2) as bigint) as amount_halves, cast(round(price * 100) as bigint) as price from mp", M + ", " + MP))
def maintenance_projects(spark, d):
    m = reconcile.maintenance_projects(maint(spark, d))
    return m.select("project_key", "maint_rows", "maint_objects", "measures", F.round(F.col("amount") * 2).cast("bigint").alias("amount_halves"), F.round(F.col("price") * 100).cast("bigint").alias("price"))


@query(oracle("select * from diffs", DIFFS))
def object_differences(spark, d):
    return reconcile.object_differences(asset(spark, d), maint(spark, d))


@query(oracle("select * from dc", DIFFS + ", " + DC))
def difference_counts(spark, d):
    return reconcile.difference_counts(reconcile.object_differences(asset(spark, d), maint(spark, d)))


@query(oracle("select project_key, road, status, only_in_asset, only_in_maintenance, suspicious_road, invalid_chainage, asset_rows, maint_rows from cmp", CMP))
def reconcile_projects(spark, d):
    c = reconcile.compare_projects(asset(spark, d), maint(spark, d))
    return c.select("project_key", "road", "status", "only_in_asset", "only_in_maintenance", "suspicious_road", "invalid_chainage", "asset_rows", "maint_rows")


@query(oracle("select x.project_key as missing, y.project_key as candidate, count(*) as objects from diffs x join diffs y on x.object_key = y.object_key where x.difference = 'only_in_asset' and y.difference = 'only_in_maintenance' and x.project_key <> y.project_key group by 1, 2", DIFFS))
def moved_objects(spark, d):
    return reconcile.moved_objects(reconcile.object_differences(asset(spark, d), maint(spark, d)))


@query()
def replacement_candidates(spark, d):
    a, m = reconcile.stored_sides(asset(spark, d), maint(spark, d))
    return reconcile.replacement_candidates(reconcile.compare_projects(a, m), reconcile.object_differences(a, m))


ACTIONS = CMP + """, act0 as (select *, case status when 'OBJECT_ROAD_SUSPICIOUS' then suspicious_road when 'OBJECT_DIFFERENCE' then only_in_asset + only_in_maintenance when 'CHAINAGE_SUSPICIOUS' then invalid_chainage when 'MISSING_IN_MAINTENANCE' then only_in_asset else only_in_maintenance end as objects from cmp where status <> 'OK_COMPLETE'),
act as (select road, project_key, status, objects, least(100, case status when 'CHAINAGE_SUSPICIOUS' then 25 else 45 end + case status when 'NO_ASSET_OBJECTS' then 15 when 'CHAINAGE_SUSPICIOUS' then 10 else 20 end + case when asset_primary > 0 then 20 else 0 end
 + case when greatest(objects, coalesce(asset_objects, 0), coalesce(maint_objects, 0)) >= 25 then 20 when greatest(objects, coalesce(asset_objects, 0), coalesce(maint_objects, 0)) >= 8 then 12 when greatest(objects, coalesce(asset_objects, 0), coalesce(maint_objects, 0)) >= 1 then 5 else 0 end
 + case status when 'CHAINAGE_SUSPICIOUS' then 15 when 'OBJECT_DIFFERENCE' then 10 else 0 end) as score from act0)"""


@query(oracle("select road, project_key, status, cast(score as int) as score, case when score >= 85 then 'high' when score >= 55 then 'middle' else 'low' end as priority, objects from act", ACTIONS))
def action_list(spark, d):
    return reconcile.action_list(reconcile.compare_projects(asset(spark, d), maint(spark, d))).select("road", "project_key", "status", "score", "priority", "objects")


def _lists(spark, d):
    """(action list of today, one of an older, smaller export with follow-up entries); the asset side is read once."""
    a = materialize(reconcile.keyed_assets(asset(spark, d)), "keyed-assets")
    return reconcile.action_list(reconcile.compare_projects(a, maint(spark, d))), _previous(spark, d, a)


def _previous(spark, d, a=None):
    old = reconcile.action_list(reconcile.compare_projects(a if a is not None else asset(spark, d), maint(spark, d).where("pk % 7 > 1")))
    return old.select("project_key", "status", F.concat(F.lit("s"), F.length("project_key") % 4).alias("state"), F.concat(F.lit("o"), F.length("status") % 3).alias("owner"), F.lit(None).cast("string").alias("remark"), F.col("project_key").alias("row_no"))


OLD = ACTIONS.replace("from fx_maintenance)", "from fx_maintenance where pk % 7 > 1)")


@query(oracle("select n.project_key, n.status, coalesce(p.state, q.state) as state, coalesce(p.owner, q.owner) as owner from now_ n left join old_ p on n.project_key = p.project_key and n.status = p.status left join old_ q on n.project_key = q.project_key",
       "now_ as (with " + ACTIONS + " select project_key, status from act), old_ as (with " + OLD + " select project_key, status, 's' || (length(project_key) % 4) as state, 'o' || (length(status) % 3) as owner from act)"))
def carried_follow_up(spark, d):
    now, before = _lists(spark, d)
    return reconcile.carry_over(now.select("project_key", "status"), before).select("project_key", "status", "state", "owner")


PROG = "now_ as (with " + ACTIONS + " select project_key, status from act), old_ as (with " + OLD + " select project_key, status from act), prog as (select coalesce(n.project_key, o.project_key) as project_key, coalesce(n.status, o.status) as status, case when o.status is null then 'new' when n.status is null then 'resolved' else 'existing' end as progress from now_ n full join old_ o on n.project_key = o.project_key and n.status = o.status)"


@query(oracle("select * from prog", PROG))
def action_progress(spark, d):
    return reconcile.track_progress(*_lists(spark, d))


@query(oracle("select road, project_key, n as new, x as existing, r as resolved, lvl as level, case when n > 0 and r = 0 then 'worse' when n = 0 and r > 0 then 'better' when n = 0 and x = 0 then 'done' else 'mixed' end as conclusion from (select regexp_extract(project_key, '\\b(N\\d{3,4})\\b', 1) as road, project_key, count(*) filter (where progress='new') as n, count(*) filter (where progress='existing') as x, count(*) filter (where progress='resolved') as r, 'project' as lvl from prog group by all union all select regexp_extract(project_key, '\\b(N\\d{3,4})\\b', 1), null, count(*) filter (where progress='new'), count(*) filter (where progress='existing'), count(*) filter (where progress='resolved'), 'road' from prog group by 1) t", PROG))
def progress_report(spark, d):
    return reconcile.progress_report(reconcile.track_progress(*_lists(spark, d)))


VIOL = A + """, viol as (select 'MISSING_PROJECT' as rule_code, 'error' as severity, 'project missing' as category, object_id from a where not exempt and project = ''
 union all select 'INVALID_CHAINAGE', 'warning', 'location data', object_id from a where chainage_text <> 'nan' and km is null
 union all select 'EXEMPT_HAS_PROJECT', 'warning', 'project not expected', object_id from a where exempt and project <> '')"""


@query(oracle("select *, rule_code || ':' || object_id as issue_key from viol", VIOL))
def attribute_violations(spark, d):
    return quality.attribute_violations(asset(spark, d)).drop("missing_cols")


@query(oracle("select category, count(*) as issues from viol where object_id % 5 > 0 group by 1", VIOL))
def violation_counts(spark, d):
    v = quality.attribute_violations(asset(spark, d))
    return quality.category_counts(quality.without_ignored(v, v.where("object_id % 5 = 0")))


@query(oracle("""select 'asset' as source, 'EMPTY_PROJECT' as issue, count(*) filter (where project = '') as n from a union all select 'asset', 'EMPTY_OBJECT', 0 union all select 'asset', 'EMPTY_CHAINAGE', count(*) filter (where chainage_text = 'nan') from a
 union all select 'asset', 'BAD_CHAINAGE', count(*) filter (where chainage_text <> 'nan' and km is null) from a union all select 'asset', 'ODD_PROJECT_NAME', 0 union all select 'maintenance', 'EMPTY_PROJECT', 0 union all select 'maintenance', 'EMPTY_OBJECT', 0
 union all select 'maintenance', 'EMPTY_MEASURE', 0 union all select 'maintenance', 'ODD_PROJECT_NAME', 0 union all select 'maintenance', 'DUPLICATE_LINE', count(*) from (select object_no, project, measure from fx_maintenance group by all having count(*) > 1) q""", A))
def issue_report(spark, d):
    return quality.issue_report(asset(spark, d), maint(spark, d))


@query(oracle("""select road, track, island, min(start_m) as start, max(end_m) as "end" from (select *, cast(sum(cut) over (partition by road, track order by start_m, end_m, object_id) as bigint) as island from
 (select *, case when start_m - max(end_m) over (partition by road, track order by start_m, end_m, object_id rows between unbounded preceding and 1 preceding) <= 5 then 0 else 1 end as cut from fx_asset where track <> '') q) r group by 1, 2, 3"""))
def merged_intervals(spark, d):
    a = asset(spark, d).where("track <> ''")
    return intervals.merge_intervals(a, TRACK, "start_m", "end_m", 5.0)


@query(oracle("""select road, track, cast(round(sum(l) * 1000) as bigint) as length_m, count(*) as segments from (select road, track, s, max(p) - min(p) as l, count(*) as n from (select *, sum(c) over (partition by road, track order by p) as s from
 (select *, case when p - lag(p) over (partition by road, track order by p) <= 0.25 then 0 else 1 end as c from (select distinct road, track, km as p from a where km is not null) q) r) t group by 1, 2, 3) u where n > 1 group by 1, 2""", A))
def point_lengths(spark, d):
    a = asset(spark, d).withColumn("km", text.chainage_km("chainage_text"))
    return intervals.point_length(a, TRACK, "km").select(*TRACK, F.round(F.col("length") * 1000).cast("bigint").alias("length_m"), "segments")


@query(oracle("""select road, track, prev as previous, object_id as name, kind, least(start_m, e) as "from", greatest(start_m, e) as "to" from (select road, track, object_id, start_m, e, prev, case when start_m - e > 30 then 'gap' when start_m - e < -30 then 'overlap' end as kind from
 (select *, (max({'e': end_m, 'i': -i, 'n': object_id}) over w).e as e, (max({'e': end_m, 'i': -i, 'n': object_id}) over w).n as prev from (select *, row_number() over (partition by road, track order by start_m, end_m, object_id) as i from fx_asset where track <> '') q
  window w as (partition by road, track order by i rows between unbounded preceding and 1 preceding)) r) s where kind is not null"""))
def gaps_and_overlaps(spark, d):
    return intervals.hard_gaps(asset(spark, d).where("track <> ''"), TRACK, "object_id", "start_m", "end_m", 30.0)


@query(oracle("select x.road, x.track, x.object_id, count(*) as objects, sum(least(x.end_m, y.end_m) - greatest(x.start_m, y.start_m)) as overlap from fx_asset x join fx_asset y on x.road = y.road and x.track = y.track and y.start_m < x.end_m and y.end_m > x.start_m where x.track <> '' group by 1, 2, 3"))
def overlap_sums(spark, d):
    a = asset(spark, d).where("track <> ''").withColumnsRenamed({"start_m": "start", "end_m": "end"})
    return intervals.overlap_sum(a, a, TRACK, "object_id")


RUNS = """runs0 as (select *, max(end_m) over (partition by road, track order by start_m, end_m, object_id rows between unbounded preceding and 1 preceding) as reach, lag(layer || '|' || year_layer) over (partition by road, track order by start_m, end_m, object_id) as before from fx_asset where track <> ''),
runs1 as (select *, coalesce(start_m - reach > 5, false) as gap_before, cast(sum(case when before is null or start_m - reach > 5 or before <> layer || '|' || year_layer then 1 else 0 end) over (partition by road, track order by start_m, end_m, object_id) as bigint) as run from runs0),
runs2 as (select road, track, run, min(start_m) as start_m, max(end_m) as end_m, count(*) as objects, bool_or(gap_before) as gap_before, min(layer) as layer, min(year_layer) as year_layer from runs1 group by 1, 2, 3)"""


def _runs(spark, d):
    return segment.technical_runs(asset(spark, d).where("track <> ''"), TRACK, PROFILE)


@query(oracle("select * from runs2", RUNS))
def technical_runs(spark, d):
    return segment.summarise_runs(_runs(spark, d), TRACK, PROFILE)


ABSORB = RUNS + """, ab as (with recursive s0 as (select road, track, run, {'run': run, 's': start_m, 'e': end_m, 'n': objects, 'gap': gap_before, 'p': layer || '|' || year_layer, 'members': [run]} as r from runs2),
 w as (select road, track, run, [r] as st from s0 where run = 1 union all select road, track, run, case when len(st) >= 2 and st[-1].n <= 2 and st[-1].e - st[-1].s < 100 and not st[-1].gap and not r.gap and st[-2].p = r.p
   then list_append(st[1:len(st) - 2], {'run': st[-2].run, 's': least(st[-2].s, st[-1].s, r.s), 'e': greatest(st[-2].e, st[-1].e, r.e), 'n': st[-2].n + st[-1].n + r.n, 'gap': st[-2].gap, 'p': st[-2].p, 'members': list_concat(list_concat(st[-2].members, st[-1].members), r.members)}) else list_append(st, r) end
  from (select y.road, y.track, y.run, w.st, y.r from w join s0 y on y.road = w.road and y.track = w.track and y.run = w.run + 1) q)
 select road, track, unnest(st) as x from (select * from w qualify row_number() over (partition by road, track order by run desc) = 1) l)"""


@query(oracle("select road, track, x.run as part_of, unnest(x.members) as run from ab", ABSORB))
def absorbed_runs(spark, d):
    return segment.absorb_deviations(segment.summarise_runs(_runs(spark, d), TRACK, PROFILE), TRACK, PROFILE)


@query(oracle("""select road, track, run, unnest(list_filter([case when kinds > 1 then 'several contracts' end, case when gone = 0 then null when gone <= 2 and gone_m < 100 and kinds = 1 then 'few objects without contract' when kinds = 0 then 'no contract' else 'some objects without contract' end], lambda x: x is not null)) as signal
 from (select road, track, run, count(distinct nullif(contract, '')) as kinds, count(*) filter (where contract = '') as gone, sum(case when contract = '' then end_m - start_m end) as gone_m from runs1 group by 1, 2, 3) q""", RUNS))
def contract_signals(spark, d):
    return segment.contract_signals(_runs(spark, d), [*TRACK, "run"])


@query(oracle("""select road, track, run, case when g is null then 'end of track' when g then 'gap' when layer = nl and year_layer = ny then 'no technical cut' else (case when layer <> nl and (layer = '' or nl = '') then 'check structural cut: ' else 'hard technical cut: ' end) || concat_ws(', ', case when layer <> nl then 'layer' end, case when year_layer <> ny then 'year_layer' end) end as reason
 from (select *, lead(gap_before) over w as g, lead(layer) over w as nl, lead(year_layer) over w as ny from runs2 window w as (partition by road, track order by run)) q""", RUNS))
def run_transitions(spark, d):
    return segment.transitions(segment.summarise_runs(_runs(spark, d), TRACK, PROFILE), TRACK, PROFILE).select(*TRACK, "run", "reason")


SEG = """seg0 as (select axis_id, seq, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2 from fx_vertex window w as (partition by axis_id order by seq)),
seg1 as (select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as length from seg0 where x2 is not null), seg as (select *, coalesce(cast(cast(sum(cast(round(length * 1e9) as bigint)) over (partition by axis_id order by seq rows between unbounded preceding and 1 preceding) as bigint) as double) / 1e9, 0) as from_m from seg1 where length > 0)"""


def _segments(spark, d):
    return linear.axis_segments(fixture(spark, d, "select * from fx_vertex"))


@query(oracle("select axis_id, seq, x1, y1, x2, y2, cast(round(length * 1000) as bigint) as length_mm, cast(round(from_m * 1000) as bigint) as from_mm from seg", SEG))
def axis_segments(spark, d):
    return _segments(spark, d).select("axis_id", "seq", "x1", "y1", "x2", "y2", F.round(F.col("length") * 1000).cast("bigint").alias("length_mm"), F.round(F.col("from_m") * 1000).cast("bigint").alias("from_mm"))


@query(oracle("""select p.axis_id, cast(p.n as bigint) as n, cast(round((s.x1 + (p.pos - s.from_m) / s.length * (s.x2 - s.x1)) * 100) as bigint) as x_cm, cast(round((s.y1 + (p.pos - s.from_m) / s.length * (s.y2 - s.y1)) * 100) as bigint) as y_cm
 from (select axis_id, n, n * 100.0 as pos from (select axis_id, unnest(range(0, cast(floor((len - 1) / 100) as bigint) + 1)) as n from (select axis_id, max(from_m + length) as len from seg group by 1) q where len >= 1) r) p join seg s on s.axis_id = p.axis_id and p.pos >= s.from_m and p.pos < s.from_m + s.length""", SEG))
def axis_points(spark, d):
    s = _segments(spark, d)
    pos = linear.axis_lengths(s).where("length_m >= 1").select("axis_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("length_m") - 1) / 100).cast("int"))).alias("n")).withColumn("position_m", F.col("n") * 100.0)
    p = linear.points_at(pos, s)
    return p.select("axis_id", F.col("n").cast("bigint").alias("n"), F.round(F.col("x") * 100).cast("bigint").alias("x_cm"), F.round(F.col("y") * 100).cast("bigint").alias("y_cm"))


@query()
def axis_samples(spark, d):
    return linear.sample_positions(linear.axis_lengths(_segments(spark, d)))


@query(oracle("""select object_id as point_id, axis_id, cast(round(route * 10) as bigint) as route_dm, cast(round(off * 100) as bigint) as offset_cm from (select object_id, axis_id, off, route, row_number() over (partition by object_id order by off, axis_id, route) as k from
 (select object_id, axis_id, sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2) as off, from_m + t * length as route from (select l.object_id, s.*, l.x1 as px, l.y1 as py, greatest(0, least(1, ((l.x1 - s.x1) * (s.x2 - s.x1) + (l.y1 - s.y1) * (s.y2 - s.y1)) / (s.length * s.length))) as t
  from fx_line l join seg s on l.x1 between s.x1 - 60 and s.x2 + 60 and abs(l.y1 - s.y1) < 100) q) r where off <= 30) z where k = 1""", SEG))
def projected_objects(spark, d):
    pts = fixture(spark, d, "select object_id as point_id, x1 as x, y1 as y from fx_line")
    p = linear.project_points(pts, _segments(spark, d), 30.0)
    return p.select("point_id", "axis_id", F.round(F.col("route_m") * 10).cast("bigint").alias("route_dm"), F.round(F.col("offset_m") * 100).cast("bigint").alias("offset_cm"))


ANCH = "anch as (select axis_id, round(hm_km, 3) as hm_km, median(route_m) as route_m, count(*) as posts, max(offset_m) as max_offset_m from fx_post where offset_m <= 5 group by 1, 2)"


def _anchors(spark, d):
    return linear.build_anchors(fixture(spark, d, "select * from fx_post where offset_m <= 5"))


@query(oracle("select *, coalesce(min(s) over (partition by axis_id) = max(s) over (partition by axis_id), false) as monotone from (select *, sign(hm_km - lag(hm_km) over (partition by axis_id order by route_m, hm_km)) as s from anch) q", ANCH).replace("select *, coalesce(min(s)", "select axis_id, hm_km, route_m, posts, max_offset_m, coalesce(min(s)"))
def axis_anchors(spark, d):
    return _anchors(spark, d)


@query(oracle("""select axis_id, hm_from, hm_to, measured as measured_m, cast(round(expected) as bigint) as expected_m, case when abs(measured - round(expected)) <= 5 then 'ok' when abs(measured - round(expected)) <= 15 then 'attention' else 'check' end as status from
 (select axis_id, lag(hm_km) over w as hm_from, hm_km as hm_to, route_m - lag(route_m) over w as measured, abs(hm_km - lag(hm_km) over w) * 1000 as expected from anch window w as (partition by axis_id order by route_m, hm_km)) q where measured > 0 and expected > 0""", ANCH))
def hectometre_intervals(spark, d):
    i = linear.hectometre_intervals(_anchors(spark, d))
    return i.select("axis_id", "hm_from", "hm_to", "measured_m", F.round("expected_m").cast("bigint").alias("expected_m"), names.interval_status("measured_m", F.round("expected_m")).alias("status"))


@query(oracle("""select p.object_id, cast(round(1e4 * case when p.route_m <= e.lo then e.lok when p.route_m >= e.hi then e.hik else i.k1 + (p.route_m - i.r1) / (i.r2 - i.r1) * (i.k2 - i.k1) end) as bigint) as km_dm, p.route_m between e.lo and e.hi as in_range
 from (select object_id, road as axis_id, start_m + 7 as route_m from fx_asset) p join (select axis_id, min(route_m) as lo, max(route_m) as hi, arg_min(hm_km, route_m) as lok, arg_max(hm_km, route_m) as hik from anch group by 1) e on e.axis_id = p.axis_id
 left join (select axis_id, route_m as r1, hm_km as k1, lead(route_m) over w as r2, lead(hm_km) over w as k2 from anch window w as (partition by axis_id order by route_m, hm_km)) i on i.axis_id = p.axis_id and p.route_m >= i.r1 and p.route_m < i.r2""", ANCH))
def route_to_chainage(spark, d):
    p = fixture(spark, d, "select object_id, road as axis_id, start_m + 7 as route_m from fx_asset")
    k = linear.interpolate(p, _anchors(spark, d).select("axis_id", "route_m", "hm_km"), "axis_id", "route_m", "hm_km")
    return k.select("object_id", F.round(F.col("hm_km") * 1e4).cast("bigint").alias("km_dm"), "in_range")


@query(oracle("""select axis_id, zone, min(position_m) as from_m, max(position_m) as to_m, max(distance_m) as max_m, count(*) as samples, case when max(distance_m) > 25 then 'red' else 'orange' end as color from (select *, cast(sum(c) over (partition by axis_id order by position_m) as bigint) as zone from
 (select s.axis_id, position_m, distance_m, case when position_m - lag(position_m) over (partition by s.axis_id order by position_m) <= greatest(1.5 * t.m, 10) then 0 else 1 end as c from smp s join (select axis_id, median(st) as m from (select axis_id, position_m - lag(position_m) over (partition by axis_id order by position_m) as st from smp) q group by 1) t on s.axis_id = t.axis_id where distance_m > 10) r) u group by 1, 2""",
       "smp as (select road as axis_id, start_m as position_m, cast(max(blk * 7 % 31) as double) as distance_m from fx_asset group by 1, 2)"))
def deviation_zones(spark, d):
    s = fixture(spark, d, "select road as axis_id, start_m as position_m, cast(max(blk * 7 % 31) as double) as distance_m from fx_asset group by road, start_m")
    return linear.deviation_zones(s).drop("mean_m")


EDGES = """edges as (select a.object_id as src, b.object_id as dst, case when a.subtheme_key = b.subtheme_key then 'longitudinal' else 'lateral' end as relation from fx_line a join fx_line b on a.road = b.road and a.y1 = b.y1 and a.object_id <> b.object_id and a.x1 <= b.x2 + 0.5 and b.x1 <= a.x2 + 0.5)"""


def _edges(spark, d):
    return graph.proximity_edges(fixture(spark, d, "select * from fx_line"))


@query(oracle("select * from edges", EDGES))
def proximity_edges(spark, d):
    return _edges(spark, d)


@query(oracle("""select rule_code, severity, category, object_id, rule_code || ':' || object_id as issue_key from (
 select 'FLOATING_SECONDARY' as rule_code, 'warning' as severity, 'topology' as category, object_id from f where not prim and not exempt and not nb
 union all select 'ISOLATED_PROJECT', 'warning', 'project consistency', object_id from f where project <> '' and not exempt and not np
 union all select 'NO_DIRECT_PROJECT_BACKBONE', 'info', 'project consistency', object_id from f where project <> '' and not exempt and np and not prim and not npb) q""",
       A + ", " + EDGES + ", f as (select x.object_id, x.project, x.prim, x.exempt, bool_or(y.prim) as nb, bool_or(x.project <> '' and x.project = y.project) as np, bool_or(x.project <> '' and x.project = y.project and y.prim) as npb from edges e join a x on x.object_id = e.src join a y on y.object_id = e.dst group by 1, 2, 3, 4)"))
def neighbour_violations(spark, d):
    return quality.neighbour_violations(asset(spark, d), _edges(spark, d)).drop("missing_cols")


@query()
def backbone_groups(spark, d):
    a = asset(spark, d).where("track <> ''")
    return graph.backbone_groups(a, _edges(spark, d), "track", PROFILE)


@query()
def secondary_assignment(spark, d):
    a = asset(spark, d)
    main = a.where("ln in (1, 3)").select("object_id", F.col("object_id").alias("group_id"))
    return graph.nearest_group(main, a.where("ln not in (1, 3)"), _edges(spark, d))


@query("""select user_id as object_id, event_type as field, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) q where k = 1""")
def change_replay(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("object_id"), F.col("event_type").alias("field"), "value", "ts", F.col("event_id").alias("seq"))
    return changes.last_values(e)


@query("select count(distinct user_id) as objects, count(distinct (user_id, event_type)) as cells, count(distinct case when event_type = 'click' then (user_id, event_type) end) as written_cells, count(distinct case when event_type <> 'click' then event_type end) as omitted_fields from events")
def export_impact(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("object_id"), F.col("event_type").alias("field"))
    return changes.export_impact(e, "object_id", ["click"])


@query(oracle("select object_id, field, old, new from (select object_id, 'layer' as field, nullif(layer, '') as old, case when pk % 5 = 0 then 'L7' else nullif(layer, '') end as new from fx_asset union all select object_id, 'contract', nullif(contract, ''), case when pk % 11 = 0 then null else nullif(contract, '') end from fx_asset) q where old is distinct from new"))
def snapshot_changes(spark, d):
    a = asset(spark, d)
    new = a.withColumn("layer", F.when(F.col("pk") % 5 == 0, "L7").otherwise(F.col("layer"))).withColumn("contract", F.when(F.col("pk") % 11 == 0, "").otherwise(F.col("contract")))
    return changes.snapshot_changes(a, new, "object_id", ["layer", "contract"])


@query(oracle("select object_id, layer, contract from fx_asset where pk % 5 = 0 or pk % 11 = 0"))
def changed_export(spark, d):
    a = asset(spark, d)
    return changes.export_changed(a, a.where("pk % 5 = 0 or pk % 11 = 0"), "object_id", ["layer", "contract", "not_there"])


@query(oracle("select layer as value, coalesce(road, '*') as road, count(*) as objects, cast(round(sum(qty)) as bigint) as amount from fx_asset group by grouping sets ((layer, road), (layer))"))
def attribute_quantities(spark, d):
    q = reconcile.quantities(asset(spark, d), "layer", "qty")
    return q.select("value", "road", "objects", F.round("amount").cast("bigint").alias("amount"))


@query(oracle("select road, arg_min(layer, {'c': -n, 'v': layer}) as layer, max(n) as n from (select road, layer, count(*) as n from fx_asset where layer <> '' group by 1, 2) q group by 1"))
def dominant_layer(spark, d):
    n = asset(spark, d).where("layer <> ''").groupBy("road", "layer").agg(F.count("*").alias("n"))
    return n.groupBy("road").agg(F.min_by("layer", F.struct(-F.col("n"), F.col("layer"))).alias("layer"), F.max("n").alias("n"))


@query(oracle("select project_key, count(*) as n from (select project_key, track from a where project_key <> '' and track <> '' group by 1, 2) q group by 1 having count(*) > 1", A))
def duplicate_projects(spark, d):
    p = asset(spark, d).where("track <> ''").select(text.project_key("project").alias("project_key"), "track").where("project_key <> ''").distinct()
    return p.groupBy("project_key").agg(F.count("*").alias("n")).where("n > 1")


@query(oracle("select object_id from fx_asset where contains(lower(concat_ws(' ', object_no, road, subtheme, project, layer)), 'hrb-01')"))
def object_search(spark, d):
    a = asset(spark, d)
    return a.where(F.contains(F.lower(F.concat_ws(" ", "object_no", "road", "subtheme", "project", "layer")), F.lit("hrb-01"))).select("object_id")


@query(oracle("select road, string_agg(v, ', ' order by v) filter (where k <= 6) || case when max(k) > 6 then ' (+' || (max(k) - 6) || ')' else '' end as years from (select road, replace(year_layer, '.0', '') as v, row_number() over (partition by road order by replace(year_layer, '.0', '')) as k from fx_asset group by 1, 2) q group by 1"))
def year_preview(spark, d):
    y = asset(spark, d).select("road", text.display_text("year_layer").alias("v")).distinct()
    return y.groupBy("road").agg(F.array_sort(F.collect_set("v")).alias("vs")).select("road", text.preview(F.col("vs")).alias("years"))


@query(oracle("select object_id, field, value from (unpivot (select object_id, road, subtheme, side, layer from fx_asset) on road, subtheme, side, layer into name field value value) q"))
def object_preview(spark, d):
    a = asset(spark, d)
    return a.unpivot(["object_id"], ["road", "subtheme", "side", "layer"], "field", "value")


@query(oracle("select object_no as id, count(*) as n from (select distinct project, object_no from fx_asset where project <> '') q group by 1"))
def split_id_lists(spark, d):
    lists = asset(spark, d).where("project <> ''").groupBy("project").agg(F.array_join(F.collect_list("object_no"), "; ").alias("ids"))
    return lists.select(F.explode(text.split_ids("ids")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
