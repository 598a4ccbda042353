"""Registered queries of the column work that readers do, over tables that stand for landed exports; importing this module adds them to the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.operators import intervals, proposals, segment
from roadloom.plans.fixtures import fixture, oracle
from roadloom.plans.queries import PROFILE, RUNS, TRACK, query, _runs
from roadloom.plans.references import ORACLE_SQL, QUERIES
from roadloom.sources import files

__all__ = ["ORACLE_SQL", "QUERIES"]

#: An export with alias headers, empty tokens and rows without anything.
LANDED = "select case when pk % 7 = 0 then 'nan' when pk % 31 = 1 then '' else object_no end as nummer, case when pk % 31 = 1 then ' ' when pk % 7 = 0 then 'B' || cast(ok as varchar(19)) else '' end as bron, case when pk % 31 = 1 then 'none' else subtheme end as subthema, case when pk % 31 = 1 then null else project end as onderhoudsproject, 'f' || cast(ln % 3 as varchar(9)) as source_file from fx_asset"
ALIASES = {"object_id": ["Nummer", "Bron"], "subtheme": ["Subthema"], "project": ["Onderhouds-project"]}


@query(oracle("select object_id, subtheme, project, source_file from (select coalesce(nullif(case when nummer in ('nan', '') then null else nummer end, ''), nullif(trim(bron), '')) as object_id, case when subthema = 'none' then null else trim(subthema) end as subtheme, nullif(onderhoudsproject, '') as project, source_file from l) q where object_id is not null or subtheme is not null or project is not null", f"l as ({LANDED})"))
def canonical_rows(spark, d):
    d_ = files.canonical_columns(fixture(spark, d, LANDED), ALIASES)
    return d_.where(F.coalesce("object_id", "subtheme", "project").isNotNull())


@query(oracle("""select source_file as source, 'EMPTY_COLUMN' as code, 'absent' as "column", count(*) as rows from l group by 1 union all select source_file, 'EMPTY_CELLS', 'onderhoudsproject', count(*) from l where coalesce(onderhoudsproject, '') = '' group by 1""", f"l as ({LANDED})"))
def source_warnings(spark, d):
    return files.source_warnings(fixture(spark, d, LANDED), ["onderhoudsproject", "absent"])


@query(oracle("select object_id, case when s = '' then 'Unknown' else upper(s[1]) || lower(s[2:]) end as side, lower(trim(subtheme)) as subtheme_clean, case lower(trim(subtheme)) when 'rijstrook' then 1 when 'parallelweg' then 2 when 'fietspad' then 3 else 4 end as rank, 1990 + blk % 30 as registered_year, 1 + ln as registered_month from (select *, trim(side) as s from fx_asset) q"))
def domain_columns(spark, d):
    rows = fixture(spark, d, "select object_id, side, subtheme, cast(1990 + blk % 30 as varchar(9)) || '-0' || cast(1 + ln as varchar(9)) || '-05' as registered from fx_asset")
    return files.domain_columns(rows).select("object_id", "side", "subtheme_clean", "rank", F.col("registered_year").cast("long").alias("registered_year"), F.col("registered_month").cast("long").alias("registered_month"))


#: Texts of lines and areas: degrees in the GPS column, metres in the RD column, some of them spoilt.
WKT = """select object_id, case when object_id % 11 = 0 then 'nan' when object_id % 13 = 0 then 'LINESTRING (a b, 1 2)' when object_id % 17 = 0 then 'POINT (155000 463000)' else 'SRID=4326;LINESTRING (' || cast(5 + x1 / 1000000 as varchar(30)) || ' ' || cast(52 + y1 / 1000000 as varchar(30)) || ', ' || cast(5 + x2 / 1000000 as varchar(30)) || ' ' || cast(52 + y2 / 1000000 as varchar(30)) || ')' end as gps,
 case when object_id % 143 = 0 then '' when object_id % 2 = 0 then 'POINT (1)' else 'POLYGON ((' || cast(x1 as varchar(30)) || ' 0, ' || cast(x2 as varchar(30)) || ' 0, ' || cast(x2 as varchar(30)) || ' 5), (1 1, 2 1, 2 2))' end as rd, 5 + x1 / 1000000 as lon, 52 + y1 / 1000000 as lat, x1
 from (select object_id, x1, cast(x2 as double) as x2, cast(y1 as double) as y1, cast(y2 as double) as y2 from fx_line) w"""
_P, _L = "(0.36 * (lat - 52.15517440))", "(0.36 * (lon - 5.38720621))"
RD_X = f"155000 + 190094.945 * {_L} - 11832.228 * {_P} * {_L} - 114.221 * {_P} ** 2 * {_L} - 32.391 * {_L} ** 3 - 0.705 * {_P} - 2.340 * {_P} ** 3 * {_L} - 0.608 * {_P} * {_L} ** 3 - 0.008 * {_L} ** 2 + 0.148 * {_P} ** 2 * {_L} ** 3"


@query(oracle(f"""select object_id, case when g then 'gps' else 'rd' end as geometry_column, case when g then 1 else 2 end as parts, case when g then cast(round({RD_X}) as bigint) else cast(round(x1) as bigint) end as x_m
 from (select *, object_id % 11 <> 0 and object_id % 13 <> 0 and object_id % 17 <> 0 as g, object_id % 143 <> 0 and object_id % 2 = 1 as r from w) q where g or r""", f"w as ({WKT})"))
def located_objects(spark, d):
    valid, _ = files.locate(fixture(spark, d, WKT), "gps", "rd")
    return valid.select("object_id", "geometry_column", F.size("parts").alias("parts"), F.round(F.col("parts")[0][0]["x"]).cast("bigint").alias("x_m"))


@query(oracle("""select object_id, 'gps: ' || case when object_id % 11 = 0 then 'empty' when object_id % 13 = 0 then 'unreadable' else 'outside the globe' end || '; rd: ' || case when object_id % 143 = 0 then 'empty' else 'unreadable' end as reason
 from w where (object_id % 11 = 0 or object_id % 13 = 0 or object_id % 17 = 0) and (object_id % 143 = 0 or object_id % 2 = 0)""", f"w as ({WKT})"))
def quarantined_objects(spark, d):
    _, lost = files.locate(fixture(spark, d, WKT), "gps", "rd")
    return lost.select("object_id", "reason")


_NEAR = "cast(floor(({m} + 50) / 100) as bigint)"
_SNAP = f"case when abs({{m}} - {_NEAR} * 100) <= 2.5 then {_NEAR} else cast(ceil({{m}} / 100) as bigint) end"


def _snapped(m: str) -> str:
    k = f"({_SNAP.format(m=m)})"
    return f"case when {k} < 100 then '0' else '' end || ({k} // 10) || '.' || ({k} % 10)"


@query(oracle(f"select road || '-' || track || '-' || run as proposal_id, road || '-' || track || '-' || {_snapped('start_m')} || '-' || {_snapped('end_m')} as proposed from runs2", RUNS))
def snapped_proposals(spark, d):
    return proposals.proposal_table(segment.summarise_runs(_runs(spark, d), TRACK, PROFILE), snap_m=2.5).select("proposal_id", "proposed")


SPANS = "select road, track, project as name, min(start_m) as start_m, max(end_m) as end_m from fx_asset where project <> '' and track <> '' and blk % 7 <> 3 group by road, track, project"


@query(oracle("""select g.road, g.track, g.prev as previous, g.name, g.kind, case when n.objects > 0 then n.objects end as objects from (select road, track, name, prev, case when start_m - e > 30 then 'gap' when start_m - e < -30 then 'overlap' end as kind, least(start_m, e) as a, greatest(start_m, e) as b from
 (select *, (max({'e': end_m, 'i': -i, 'n': name}) over w).e as e, (max({'e': end_m, 'i': -i, 'n': name}) over w).n as prev from (select *, row_number() over (partition by road, track order by start_m, end_m, name) as i from sp) q window w as (partition by road, track order by i rows between unbounded preceding and 1 preceding)) r) g
 left join (select g2.road, g2.track, g2.name, count(*) as objects from (select road, track, name, e as a, start_m as b from (select *, max(end_m) over (partition by road, track order by start_m, end_m, name rows between unbounded preceding and 1 preceding) as e from sp) q where start_m - e > 30) g2 join fx_asset o on o.road = g2.road and o.track = g2.track and o.project = '' and o.start_m < g2.b and o.end_m > g2.a group by 1, 2, 3) n on g.kind = 'gap' and n.road = g.road and n.track = g.track and n.name = g.name
 where g.kind = 'overlap' or n.objects > 0""", f"sp as ({SPANS})"))
def occupied_gaps(spark, d):
    gaps = intervals.hard_gaps(fixture(spark, d, SPANS), TRACK, "name", "start_m", "end_m", 30.0)
    objects = fixture(spark, d, "select road, track, start_m as start, end_m as `end` from fx_asset where project = '' and track <> ''")
    return intervals.occupied_gaps(gaps, objects, TRACK).select("road", "track", "previous", "name", "kind", F.when(F.col("kind") == "gap", F.col("objects")).alias("objects"))
