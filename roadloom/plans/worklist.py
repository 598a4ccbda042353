"""Registered queries of domain codes, work lists and trajectory lengths; importing this module adds them to the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import domain, text
from roadloom.operators import quality, reconcile, trajectory, worklist
from roadloom.plans.advice import ORACLE_SQL, QUERIES
from roadloom.plans.fixtures import fixture, oracle
from roadloom.plans.queries import A, ACTIONS, asset, maint, query

__all__ = ["ORACLE_SQL", "QUERIES"]

FAMILY = "case lower(trim(subtheme)) when 'rijstrook' then 'HRB' when 'parallelweg' then 'PW' when 'fietspad' then 'FP' else '' end"


@query(oracle(f"""select object_id, case when project_key <> '' then regexp_extract(project_key, '^N\\d+-([A-Z]+)-', 1) else fam || case when fam = '' then '' else sd end end as type,
 case when project_key <> '' then regexp_extract(project_key, '-(HRB|PW|FP)', 1) else fam end as family, case when project_key <> '' then regexp_extract(project_key, '-(?:HRB|PW|FP)([RL]?)-', 1) when fam = '' then '' else sd end as side
 from (select *, {FAMILY} as fam, case side when 'links' then 'L' when 'rechts' then 'R' else '' end as sd from a) q""", A))
def object_types(spark, d):
    a = asset(spark, d).withColumn("category", F.regexp_extract(text.project_key("project"), r"^N\d+-([A-Z]+)-", 1))
    t = domain.object_type(F.col("category"), "subtheme", "side")
    return a.select("object_id", t["type"].alias("type"), t["family"].alias("family"), t["side"].alias("side"))


@query(oracle("select code, family from (select distinct code, case when code in ('HRB', 'HRBR') then 'HRB' when code in ('PWR', 'PWL') then 'PW' else regexp_replace(code, '[LR]$', '') end as family from (select coalesce(nullif(regexp_extract(project, '^N\\d+-([A-Z]+)-', 1), ''), 'X' || layer || 'R') as code from fx_maintenance full join (select distinct layer from fx_asset) l on false) q) r"))
def category_families(spark, d):
    codes = maint(spark, d).select(F.regexp_extract("project", r"^N\d+-([A-Z]+)-", 1).alias("code")).where("code <> ''")
    codes = codes.union(asset(spark, d).select(F.concat(F.lit("X"), "layer", F.lit("R")))).distinct()
    return domain.category_family(codes, "code", spark.createDataFrame([("HRB", "HRBR"), ("PW", "PWR"), ("PW", "PWL")], "family string, variant string")).select("code", "family")


@query(oracle("select axis_id, hm_km, round(hm_km * 10) / 10 as from_tenths, hm_km as from_km, round(hm_km * 1000) as meters from (select distinct axis_id, hm_km from fx_post where hm_km > 0 and hm_km < 100 and round(hm_km * 10) % 10 <> 0) q"))
def post_values(spark, d):
    p = fixture(spark, d, "select distinct axis_id, hm_km from fx_post where hm_km > 0 and hm_km < 100 and round(hm_km * 10) % 10 <> 0")
    tenths = F.format_string("%.0f", F.col("hm_km") * 10)
    return p.select("axis_id", "hm_km", domain.post_km(tenths).alias("from_tenths"), domain.post_km(F.col("hm_km").cast("string")).alias("from_km"), domain.meter_value("hm_km").alias("meters"))


@query(oracle("select object_id, nullif(layer, '') as layer, replace(year_layer, '.0', '') as year from fx_asset"))
def parsed_profiles(spark, d):
    p = domain.parse_profile(F.concat(F.lit("layer=old, layer="), "layer", F.lit(", nothing, year = "), F.regexp_replace("year_layer", r"\.0$", "")))
    return asset(spark, d).withColumn("p", p).select("object_id", F.nullif(F.element_at("p", "layer"), F.lit("")).alias("layer"), F.element_at("p", "year").alias("year"))


@query(oracle("select object_id, case when exempt then 'exempt' when prim then 'primary' else 'secondary' end as map_layer, case when subtheme = 'fietspad' then 'FP' when lower(trim(subtheme)) = 'rijstrook' then 'HRB' else 'PW' end as sheet from a", A))
def object_layers(spark, d):
    a = asset(spark, d)
    f = domain.subtheme_family("subtheme")
    return a.select("object_id", domain.object_layer("subtheme", reconcile.is_exempt(a), reconcile.RULES.backbone).alias("map_layer"), domain.sheet_class(f, f, F.lit("")).alias("sheet"))


@query(oracle("select object_id from fx_asset where road = 'N354' or ok % 12 = 4"))
def road_filter(spark, d):
    a = fixture(spark, d, "select object_id, road, 'WA-N' || cast(350 + ok % 12 as varchar(9)) || '_1' as axis from fx_asset")
    return domain.of_road(a, ["road", "axis", "no_such_column"], "354.0").select("object_id")


SPECIALS = "select object_id, project, case when pk % 9 = 0 then 'Kruispunt ' || cast(pk % 7 as varchar(9)) when pk % 9 = 1 then 'x' else '' end as name, case when pk % 9 = 1 then 'aan de Brugweg' when pk % 9 = 2 then 'tunnel en rotonde' else subtheme end as info from fx_asset where project <> ''"


@query(oracle("""select project, string_agg(said, ', ' order by said) filter (where k <= 6) || case when max(k) > 6 then ' (+' || (max(k) - 6) || ')' else '' end as specials from (select project, said, row_number() over (partition by project order by said) as k from
 (select distinct project, case when contains(lower(info || ' ' || name), 'rotonde') then 'rotonde' when contains(lower(name), 'kruispunt') then name when contains(lower(info), 'brug') then 'brug' end as said from s) q where said is not null) r group by project""", f"s as ({SPECIALS})"))
def special_objects(spark, d):
    s = fixture(spark, d, SPECIALS).select("project", domain.special_object(F.concat_ws(" | ", "info", "name"), "name").alias("said")).where("said is not null").distinct()
    return s.groupBy("project").agg(F.array_sort(F.collect_set("said")).alias("v")).select("project", text.preview(F.col("v")).alias("specials"))


QUEUE = ACTIONS + """, queue as (select road, project_key, status, objects, case when status = 'CHAINAGE_SUSPICIOUS' then 'attention' else 'warning' end as severity, length(project_key) % 3 = 0 as old, score from act),
qd as (select *, case when old then p else case when score >= 85 then 'high' when score >= 55 then 'middle' else 'low' end end as priority, cast(case when old then s else score end as int) as priority_score from
 (select *, s, case when s >= 85 then 'high' when s >= 55 then 'middle' else 'low' end as p from (select *, case severity when 'warning' then 70 else 45 end + least(objects, 20) as s from queue) x) y)"""


def _queue(spark, d):
    q = reconcile.action_list(reconcile.compare_projects(asset(spark, d), maint(spark, d)))
    old = F.length("project_key") % 3 == 0
    return q.withColumn("priority", F.when(old, "").otherwise(F.col("priority"))).withColumnRenamed("score", "priority_score")


@query(oracle("select project_key, status, priority, priority_score, 'new' as state from qd", QUEUE))
def queue_defaults(spark, d):
    return worklist.queue_defaults(_queue(spark, d)).select("project_key", "status", "priority", "priority_score", "state")


@query(oracle("select project_key, status, priority from qd where severity = 'warning' and priority = 'middle' and contains(lower(project_key), 'hrb-0')", QUEUE))
def filtered_queue(spark, d):
    return worklist.filter_queue(_queue(spark, d), search=" HRB-0 ", severity="warning", priority="middle", owner="", no_such_column="x").select("project_key", "status", "priority")


PROJECTS = QUEUE + """, ap2 as (select q.road, q.project_key, max(priority_score) as priority_score, max(case priority when 'high' then 3 when 'middle' then 2 else 1 end) as p, count(*) as points, count(*) filter (severity = 'warning') as warnings,
 cast(sum(objects) as bigint) as objects, string_agg(status, ', ' order by status) as statuses from qd q group by 1, 2)"""


@query(oracle("""select road, project_key, priority_score, ['low', 'middle', 'high'][p] as priority, points, points as open_points, warnings, objects, statuses,
 case when contains(statuses, 'MISSING_IN_MAINTENANCE') then 'check export selection or create the project' when contains(statuses, 'OBJECT_DIFFERENCE') then 'compare the object lists' when contains(statuses, 'OBJECT_ROAD_SUSPICIOUS') then 'check the objects'' road'
 when contains(statuses, 'NO_ASSET_OBJECTS') then 'check for an orphaned project' else 'correct the chainage' end as next_step from ap2""", PROJECTS))
def action_projects(spark, d):
    return worklist.action_projects(_queue(spark, d)).select("road", "project_key", "priority_score", "priority", "points", "open_points", "warnings", "objects", "statuses", "next_step")


@query(oracle("select project_key, priority_score, points from ap2 order by priority_score desc, points desc, project_key limit 10", PROJECTS))
def top_projects(spark, d):
    return worklist.top_projects(worklist.action_projects(_queue(spark, d))).select("project_key", "priority_score", "points")


@query(oracle("""select road, actions, high, case when high > 0 then 'usable, with points of high priority' when actions > 0 then 'usable with points of attention' else 'usable, nothing urgent found' end as verdict,
 case when high > 0 then 'orange' when actions > 0 then 'yellow' else 'green' end as color from (select road, count(*) as actions, count(*) filter (priority = 'high') as high from qd group by 1) q""", QUEUE))
def road_verdicts(spark, d):
    q = worklist.queue_defaults(_queue(spark, d)).groupBy("road").agg(F.count("*").alias("actions"), F.count_if(F.col("priority") == "high").alias("high"))
    zero = {c: F.lit(0) for c in ("blocking", "warnings", "mutations", "resolved")}
    return worklist.run_verdict(q.withColumns(zero)).select("road", "actions", "high", "verdict", "color")


#: Values of which L0 has begin and end columns, L1 range texts, and the others single points or nothing.
TRAJ = """select coalesce(nullif(layer, ''), 'none') as value, project, case when layer = 'L0' then cast(start_m / 1000 as varchar(20)) else '' end as begin_km, case when layer = 'L0' then cast(end_m / 1000 as varchar(20)) else '' end as end_km,
 case when layer = 'L0' then '' when layer = 'L1' then cast(start_m / 1000 as varchar(20)) || ' - ' || cast(end_m / 1000 as varchar(20)) when layer = 'L9' then '' else cast(start_m / 1000 as varchar(20)) end as hm from fx_asset where lower(trim(subtheme)) = 'rijstrook'"""


@query(oracle("""select v.value, case when i.m is not null then i.m when n.m is not null then n.m else p.m end as length_m, coalesce(i.c, n.c, p.c, 0) as segments,
 case when i.m is not null then case v.value when 'L0' then 'precise' else 'range' end when n.m is not null then 'name' when p.m is not null then 'coarse' else 'none' end as quality, n.m as name_m
 from (select distinct value from t) v
 left join (select value, cast(round(sum(e - b) * 1000) as bigint) as m, count(*) as c from (select value, g, min(b) as b, max(e) as e from (select *, sum(cut) over (partition by value order by b, e) as g from
  (select *, case when b - max(e) over (partition by value order by b, e rows between unbounded preceding and 1 preceding) <= 0.025 then 0 else 1 end as cut from
   (select value, cast(case value when 'L0' then begin_km else split_part(hm, ' - ', 1) end as double) as b, cast(case value when 'L0' then end_km else split_part(hm, ' - ', 2) end as double) as e from t where value in ('L0', 'L1')) a where e > b) x) y group by 1, 2) z group by 1) i on i.value = v.value
 left join (select value, cast(round(sum(l) * 1000) as bigint) as m, count(*) as c from (select project, min(value) as value, any_value(cast(regexp_extract(project, '-([0-9.]+)$', 1) as double) - cast(regexp_extract(project, '-([0-9.]+)-[0-9.]+$', 1) as double)) as l from t where project <> '' group by project having count(distinct value) = 1) a group by 1) n on n.value = v.value
 left join (select value, cast(round(sum(l) * 1000) as bigint) as m, count(*) as c from (select value, g, max(p) - min(p) as l, count(*) as k from (select *, sum(cut) over (partition by value order by p) as g from (select *, case when p - lag(p) over (partition by value order by p) <= 0.25 then 0 else 1 end as cut from
  (select distinct value, round(cast(hm as double), 6) as p from t where value not in ('L0', 'L1') and hm <> '') a) x) y group by 1, 2) z where k > 1 group by 1) p on p.value = v.value""", f"t as ({TRAJ})"))
def trajectory_lengths(spark, d):
    t = trajectory.trajectory_lengths(fixture(spark, d, TRAJ), ["value"], "begin_km", "end_km", "hm", "project")
    return t.select("value", F.round("length_m").cast("bigint").alias("length_m"), "segments", "quality", F.round("name_m").cast("bigint").alias("name_m"))


@query(oracle("select value, objects, row_number() over (order by value = '', value) as place from (select layer as value, count(*) as objects from fx_asset group by 1) q"))
def ordered_layers(spark, d):
    return trajectory.ordered_values(asset(spark, d), "layer")


@query(oracle("select value, objects, row_number() over (order by cast(value as double)) as place from (select replace(year_layer, '.0', '') as value, count(*) as objects from fx_asset group by 1) q"))
def ordered_years(spark, d):
    return trajectory.ordered_values(asset(spark, d), "year_layer")


@query(oracle("select layer as value, coalesce(road, '*') as road, count(*) as objects, sum(end_m - start_m) as length_m, cast(round(sum((end_m - start_m) * 3.5)) as bigint) as area_m2 from fx_asset group by grouping sets ((layer, road), (layer))"))
def layer_quantities(spark, d):
    a = asset(spark, d).select("layer", "road", (F.col("end_m") - F.col("start_m")).alias("length_m"), F.lit("").alias("area_m2"), F.lit("3,5").alias("width_m"))
    return trajectory.measured_quantities(a, "layer").select("value", "road", "objects", "length_m", F.round("area_m2").cast("bigint").alias("area_m2"))


#: Exports with the faults that the report counts.
BAD_ASSET = """select case when pk % 71 = 0 then '' when pk % 73 = 0 then 'VV-TWIN' else object_no end as object_no, case when pk % 67 = 0 then 'nan' else road end as road, case when pk % 61 = 0 then 'oud project ' || cast(pk % 3 as varchar(9)) when pk % 59 = 0 then replace(project, 'N3', 'N9') else project end as project, subtheme,
 case when pk % 47 = 0 then 'x,1' else chainage_text end as chainage_text, case when pk % 83 = 0 then '' when pk % 89 = 0 then 'POINT (x)' else 'POINT (1 2)' end as wkt, pk from fx_asset"""
BAD_MAINT = "select case when pk % 53 = 0 then '' else object_no end as object_no, case when pk % 79 = 0 then ' ' when pk % 61 = 0 then 'los werk' else project end as project from fx_maintenance"


@query(oracle("""select * from (select 'asset' as source, 'warning' as severity, 'empty cells' as category, 'OBJECT_EMPTY' as code, count(*) filter (object_no = '') as rows, 'object_no' as "column" from ba
 union all select 'asset', 'attention', 'duplicate objects', 'OBJECT_DUPLICATE', count(*), 'object_no' from ba where object_no = 'VV-TWIN'
 union all select 'asset', 'attention', 'empty cells', 'ROAD_EMPTY', count(*) filter (road = 'nan'), 'road' from ba
 union all select 'asset', 'warning', 'selection', 'ROAD_OUTSIDE_SELECTION', count(*) filter (road not in ('nan', 'N350')), 'road' from ba
 union all select 'asset', 'warning', 'project', 'PROJECT_EMPTY', count(*) filter (project = '' and subtheme <> 'carpoolplaats'), 'project' from ba
 union all select 'asset', 'attention', 'project', 'EXEMPT_HAS_PROJECT', count(*) filter (project <> '' and subtheme = 'carpoolplaats'), 'project' from ba
 union all select 'asset', 'attention', 'names', 'PROJECT_NAME_ODD', count(distinct project), 'project' from ba where project like 'oud%'
 union all select 'asset', 'warning', 'road', 'PROJECT_ROAD_MISMATCH', count(*), 'project, road' from ba where project like 'N%' and road <> 'nan' and regexp_extract(project, '^(N\\d+)', 1) <> road
 union all select 'asset', 'attention', 'chainage', 'CHAINAGE_EMPTY', count(*), 'chainage_text' from ba where project <> '' and chainage_text = 'nan'
 union all select 'asset', 'warning', 'chainage', 'CHAINAGE_INVALID', count(*), 'chainage_text' from ba where project <> '' and chainage_text in ('x,1', '4,,9')
 union all select 'asset', 'attention', 'geometry', 'GEOMETRY_EMPTY', count(*), 'wkt' from ba where wkt = '' union all select 'asset', 'attention', 'geometry', 'GEOMETRY_INVALID', count(*), 'wkt' from ba where wkt = 'POINT (x)'
 union all select 'maintenance', 'warning', 'project', 'PROJECT_EMPTY', count(*), 'project' from bs where project = ' ' union all select 'maintenance', 'warning', 'empty cells', 'OBJECT_EMPTY', count(*), 'object_no' from bs where object_no = ''
 union all select 'maintenance', 'attention', 'duplicate objects', 'OBJECT_DUPLICATE', coalesce(sum(n), 0), 'project, object_no' from (select count(*) as n from bs where trim(project) <> '' and object_no <> '' group by project, object_no having count(*) > 1) q
 union all select 'maintenance', 'attention', 'names', 'PROJECT_NAME_ODD', count(distinct project), 'project' from bs where project = 'los werk') z where rows > 0""",
              f"ba as ({BAD_ASSET}), bm as ({BAD_MAINT}), bs as (select * from bm where trim(project) = '' or not project like 'N%' or project like 'N350%')"))
def quality_report(spark, d):
    return quality.quality_report(fixture(spark, d, BAD_ASSET), fixture(spark, d, BAD_MAINT), road="N350")



@query(oracle("""select 'action_list' as "table", (select count(*) from act) as rows union all select 'compared', (select count(*) from cmp) union all select 'differences', (select count(*) from diffs) union all select 'progress', (select count(*) from act)
 union all select 'work_queue', (select count(*) from act) union all select 'projects', (select count(*) from (select distinct road, project_key from act) q)""", ACTIONS))
def control_run(spark, d):
    run = worklist.control_run(asset(spark, d), maint(spark, d))
    rows = [run[n].select(F.lit(n).alias("table")) for n in ("action_list", "compared", "differences", "progress", "work_queue", "projects")]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.groupBy("table").agg(F.count("*").alias("rows"))
