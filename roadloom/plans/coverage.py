"""Registered queries of coverage, gaps without name zones and interval subtraction; importing this module adds them to the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.operators import coverage, merging
from roadloom.plans.fixtures import fixture, oracle
from roadloom.plans.queries import ANCH, SEG, query, _anchors
from roadloom.plans.sources import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Projects per road and track with every seventh block of objects taken out; their kilometres are those of the name.
SPANS = """select road as axis_id, track as type, project as name, min(start_m) as start_m, max(end_m) as end_m, {begin} as begin_km, {end} as end_km
 from fx_asset where project <> '' and track <> '' and (blk % 7 <> 3 or pk % 5 = 0) group by road, track, project"""
_SPARK = SPANS.format(begin=r"cast(regexp_extract(project, '-([0-9.]+)-[0-9.]+$', 1) as double)", end=r"cast(regexp_extract(project, '-([0-9.]+)$', 1) as double)")
#: Primary objects without project and some with; parallel roads that lie on both sides, and carriageways with a side.
INSIDE = """select road as axis_id, case when track in ('PWR', 'PWL') and pk % 5 = 0 then 'PWLR' when track = 'HRB' and pk % 3 = 0 then 'HRBR' else track end as type, object_no as name, start_m as {q}start{q}, end_m as {q}end{q} from fx_asset where track <> '' and (project = '' or blk % 7 = 3)"""

ROUTE = """case when k <= e.lok then e.lo when k >= e.hik then e.hi else r1 + (k - k1) / (k2 - k1) * (r2 - r1) end"""
COVER = ANCH + f""", sp as ({_SPARK}), ob as ({INSIDE.format(q='"')}), ends as (select axis_id, min(route_m) as lo, max(route_m) as hi, arg_min(hm_km, route_m) as lok, arg_max(hm_km, route_m) as hik from anch group by 1),
iv as (select axis_id, route_m as r1, hm_km as k1, lead(route_m) over w as r2, lead(hm_km) over w as k2 from anch window w as (partition by axis_id order by route_m, hm_km)),
sq as (select *, row_number() over (partition by axis_id, type order by start_m, end_m, name) as i from sp where end_m > start_m),
pv as (select *, max({{'e': end_m, 'i': -i, 'n': name, 'k': end_km}}) over (partition by axis_id, type order by i rows between unbounded preceding and 1 preceding) as p from sq),
bs as (select axis_id, type, i, p.e as before, start_m, p.n as lname, name as rname, p.k as lkm, begin_km as rkm from pv where p is not null and abs(start_m - p.e) > 30),
zl as (select z.axis_id, type, i, max({ROUTE}) as z from (select axis_id, type, i, unnest([greatest(0, lkm - 0.1 + 0.0025), lkm + 0.0025]) as k from bs where start_m > before) z join ends e on e.axis_id = z.axis_id left join iv on iv.axis_id = z.axis_id and k >= k1 and k < k2 group by 1, 2, 3),
zr as (select z.axis_id, type, i, min({ROUTE}) as z from (select axis_id, type, i, unnest([greatest(0, rkm - 0.1 + 0.0025), rkm + 0.0025]) as k from bs where start_m > before) z join ends e on e.axis_id = z.axis_id left join iv on iv.axis_id = z.axis_id and k >= k1 and k < k2 group by 1, 2, 3),
hd as (select b.*, greatest(before, coalesce(zl.z, before)) as h1, least(start_m, coalesce(zr.z, start_m)) as h2 from bs b left join zl on zl.axis_id = b.axis_id and zl.type = b.type and zl.i = b.i left join zr on zr.axis_id = b.axis_id and zr.type = b.type and zr.i = b.i where start_m > before),
oc as (select h.axis_id, h.type, h.i, count(*) as objects, sum(least(h2, o."end") - greatest(h1, o."start")) as objects_m from hd h join ob o on o.axis_id = h.axis_id and o."start" < h2 and o."end" > h1 and (o.type = h.type or (h.type in ('PWR', 'PWL') and o.type = 'PWLR') or (h.type = 'HRB' and o.type = 'HRBR')) where h2 - h1 > 30 group by 1, 2, 3),
tt as (select axis_id, type, min(start_m) as a, max(end_m) as e from sq group by 1, 2),
il as (select axis_id, type, isl, min(start_m) as a, max(end_m) as e from (select *, sum(c) over (partition by axis_id, type order by i) as isl from (select *, case when start_m <= p.e then 0 else 1 end as c from pv) q) r group by 1, 2, 3)"""
_CM = lambda c: f"cast(round({c} * 100) as bigint)"


@query(oracle(f"""select axis_id, type, 'coverage' as "check", {_CM('a')} as from_cm, {_CM('e')} as to_cm, null::bigint as hard_from_cm, null::bigint as hard_to_cm, '' as "left", '' as "right", null::bigint as objects, null::bigint as objects_cm, cast(round((select sum(il.e - il.a) from il where il.axis_id = tt.axis_id and il.type = tt.type) / (e - a) * 1000) as bigint) as permille from tt
 union all select axis_id, type, 'overlap', {_CM('start_m')}, {_CM('before')}, null, null, lname, rname, null, null, null from bs where start_m < before
 union all select h.axis_id, h.type, 'gap', {_CM('before')}, {_CM('start_m')}, {_CM('h1')}, {_CM('h2')}, lname, rname, objects, {_CM('objects_m')}, null from hd h join oc on oc.axis_id = h.axis_id and oc.type = h.type and oc.i = h.i""", COVER))
def project_coverage(spark, d):
    c = coverage.project_coverage(fixture(spark, d, _SPARK.replace("\\", "\\\\")), _anchors(spark, d), fixture(spark, d, INSIDE.format(q="`")))
    cm = lambda a, b: F.round(F.col(a) * 100).cast("bigint").alias(b)
    return c.select("axis_id", "type", "check", cm("from_m", "from_cm"), cm("to_m", "to_cm"), cm("hard_from_m", "hard_from_cm"), cm("hard_to_m", "hard_to_cm"), "left", "right", "objects", cm("objects_m", "objects_cm"), F.round(F.col("pct") * 10).cast("bigint").alias("permille"))


#: Stretches of a kilometre per track, and the objects of layer L1 as holes in them.
BASE = "select distinct road, track, cast(floor(start_m / 1000) as bigint) as km, floor(start_m / 1000) * 1000.0 as {q}start{q}, floor(start_m / 1000) * 1000.0 + 1000 as {q}end{q} from fx_asset where track <> ''"
HOLES = "select road, track, start_m as {q}start{q}, end_m as {q}end{q} from fx_asset where track <> '' and layer in ('L0', 'L1')"


@query(oracle("""select road, track, km, cast(round(pos * 100) as bigint) as from_cm, cast(round(nxt * 100) as bigint) as to_cm from (select *, lead(pos) over (partition by road, track, km order by pos) as nxt from (select distinct b.road, b.track, b.km, unnest([b."start", b."end"]) as pos from b
 union select b.road, b.track, b.km, least(b."end", greatest(b."start", unnest([h."start", h."end"]))) from b join h on h.road = b.road and h.track = b.track and h."start" < b."end" and h."end" > b."start") q) r
 where nxt > pos and not exists (select 1 from h where h.road = r.road and h.track = r.track and h."start" <= r.pos and h."end" >= r.nxt)""", f"b as ({BASE.format(q=chr(34))}), h as ({HOLES.format(q=chr(34))})"))
def uncovered_stretches(spark, d):
    u = coverage.subtract_intervals(fixture(spark, d, BASE.format(q="`")), fixture(spark, d, HOLES.format(q="`")), ["road", "track"], ["km"])
    return u.select("road", "track", "km", F.round(F.col("start") * 100).cast("bigint").alias("from_cm"), F.round(F.col("end") * 100).cast("bigint").alias("to_cm"))


#: The axes in parts of seven segments, with shuffled numbers; every third part is turned.
PARTS = """select axis_id, part, case when (part * 7 % 1000003) % 3 = 0 then -seq else seq end as seq, x, y from (
 select axis_id, cast((floor(n / 7) * 7919 + 13) % 1000003 as bigint) as part, n as seq, x, y from (select *, row_number() over (partition by axis_id order by seq) - 1 as n from fx_vertex) a
 union all select axis_id, cast((floor(n / 7 - 1) * 7919 + 13) % 1000003 as bigint), n, x, y from (select *, row_number() over (partition by axis_id order by seq) - 1 as n from fx_vertex) b where n % 7 = 0 and n > 0) p"""


@query(oracle("select axis_id, row_number() over (partition by axis_id order by from_m) as seq, x1, y1, x2, y2, cast(round(length * 1000) as bigint) as length_mm, cast(round(from_m * 1000) as bigint) as from_mm from seg", SEG))
def merged_axes(spark, d):
    s = merging.merged_segments(fixture(spark, d, PARTS))
    return s.select("axis_id", "seq", "x1", "y1", "x2", "y2", F.round(F.col("length") * 1000).cast("bigint").alias("length_mm"), F.round(F.col("from_m") * 1000).cast("bigint").alias("from_mm"))
