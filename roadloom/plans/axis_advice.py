"""Registered queries of advice on the calibrated axis with its own signals; importing this module adds them to the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.operators import advice, axis_advice as on_axis, boundaries
from roadloom.plans.boundaries import BOUND, OBJECTS, RANGES, REF, _ranges, _shapes
from roadloom.plans.fixtures import fixture, oracle
from roadloom.plans.previews import ORACLE_SQL, QUERIES
from roadloom.plans.proposals import ZONES
from roadloom.plans.queries import ABSORB, PROFILE, _anchors, _segments, asset, query

__all__ = ["ORACLE_SQL", "QUERIES"]

_UP = "cast(ceil(cast({k} as decimal(20, 9)) * 10) as bigint)"
_NAME = "lpad(cast({t} // 10 as varchar), 2, '0') || '.' || cast({t} % 10 as varchar)"
_T1, _T2 = _UP.format(k="least(sk, ek)"), _UP.format(k="greatest(sk, ek)")
#: Runs of the objects' routes on their nearest axis (under the name road; home is the object's own road), and what is known of their ends.
ON_AXIS = RANGES + """, ax as (select a.object_id, r.axis_id as road, a.road as home, a.track, a.project, a.contract, a.layer, a.year_layer, r.route_from as start_m, r.route_to as end_m from fx_asset a join rng r on r.object_id = a.object_id where a.track <> ''), """ + ABSORB.replace("from fx_asset where track <> ''", "from ax") + f""",
mem as (select road, track, x.run as part_of, unnest(x.members) as run from ab),
fr as (select m.road, m.track, m.part_of as run, min(start_m) as s, max(end_m) as e, cast(sum(objects) as bigint) as n, max(case when r.run = m.part_of then layer end) as layer, max(case when r.run = m.part_of then year_layer end) as year_layer, bool_or(r.run = m.part_of and gap_before) as gap from mem m join runs2 r on r.road = m.road and r.track = m.track and r.run = m.run group by 1, 2, 3),
ob as (select o.*, m.part_of from runs1 o join mem m on m.road = o.road and m.track = o.track and m.run = o.run),
fe as (select f.road, track, run, which, case when r <= lo then lok when r >= ends.hi then hik else k1 + (r - r1) / (r2 - r1) * (k2 - k1) end as k, r between lo and ends.hi as inr, (select (h.r2 - h.r1) - abs(h.k2 - h.k1) * 1000 from iv h where h.axis_id = f.road and h.r2 > h.r1 and h.k1 <> h.k2 and ((least(greatest(r, lo), ends.hi) > h.r1 and least(greatest(r, lo), ends.hi) <= h.r2) or (r <= lo and h.r1 = lo))) as dev
 from (select road, track, run, unnest(['s', 'e']) as which, unnest([s, e]) as r from fr) f join ends on ends.axis_id = f.road left join iv on iv.axis_id = f.road and r >= r1 and r < r2),
fk as (select road, track, run, max(case when which = 's' then k end) as sk, max(case when which = 'e' then k end) as ek, bool_and(inr) as inr, arg_max(dev, {{'a': round(abs(dev), 6), 'd': dev}}) as dev from fe group by 1, 2, 3),
fp as (select fr.*, fr.road || '-' || fr.track || '-' || fr.run as proposal_id, fk.sk, fk.ek, fk.inr, fk.dev, {_T1} as t1, {_T2} as t2, (select min(home) from ob where ob.road = fr.road and ob.track = fr.track and ob.part_of = fr.run) as home from fr join fk on fk.road = fr.road and fk.track = fr.track and fk.run = fr.run),
fn as (select *, home || '-' || track || '-' || {_NAME.format(t='t1')} || '-' || {_NAME.format(t='t2')} as proposed from fp),
fc as (select fn.road, fn.track, fn.run, case when count(distinct nullif(project, '')) = 0 then null when count(distinct nullif(project, '')) > 1 then 'check' when bool_or(project = proposed) then 'ok' else 'attention' end as cmp,
 count(distinct nullif(contract, '')) as kinds, count(*) filter (contract = '') as gone, sum(case when contract = '' then greatest(end_m - start_m, 0) end) as gone_m from fn join ob on ob.road = fn.road and ob.track = fn.track and ob.part_of = fn.run group by 1, 2, 3),
fl as (select m.road, m.track, m.part_of as run, count(*) as n from mem m join runs2 r on r.road = m.road and r.track = m.track and r.run = m.run join runs2 p on p.road = m.road and p.track = m.track and p.run = m.part_of where m.run <> m.part_of and (r.layer <> p.layer or r.year_layer <> p.year_layer) and (r.layer = p.layer or r.layer = '') and (r.year_layer = p.year_layer or r.year_layer = '') group by 1, 2, 3),
ft as (select fn.*, coalesce(cmp, 'unknown') as comparison, (case when kinds > 1 then 1 else 0 end) + (case when gone > 0 then 1 else 0 end) + coalesce(fl.n, 0) as data_signals, not inr or abs(dev) >= 15 as bad,
 case when not lead(gap) over w and (layer <> lead(layer) over w or year_layer <> lead(year_layer) over w) and ((layer <> lead(layer) over w and (layer = '' or lead(layer) over w = '')) or (year_layer <> lead(year_layer) over w and (year_layer = '' or lead(year_layer) over w = ''))) then 'check' end as own
 from fn join fc on fc.road = fn.road and fc.track = fn.track and fc.run = fn.run left join fl on fl.road = fn.road and fl.track = fn.track and fl.run = fn.run window w as (partition by fn.road, fn.track order by fn.run)),
fs as (select *, case when not inr then 'outside' when e - s <= 25 or t1 = t2 then 'micro' else 'regular' end as cat, case when data_signals > 0 then 'attention' else 'ok' end as data_status, case when not inr then 'check' when abs(dev) >= 15 then 'attention' else 'ok' end as boundary_status,
 coalesce(count(*) over (partition by home) >= 2 and t2 >= max(t2) over (partition by home) and bad, false) as terminal from ft),
st as (select *, case when cat <> 'regular' then 'check' when comparison <> 'unknown' then comparison else coalesce(own, 'ok') end as advice, case when cat = 'outside' then 'do not use without a check by hand' when cat = 'micro' then 'not a regular project' when comparison in ('check', 'attention') then 'check difference with existing projects'
  when terminal then 'check end boundary on the map' when boundary_status = 'check' then 'check boundary and calibration' when data_status <> 'ok' then 'agreed, check data quality' when boundary_status = 'attention' then 'agreed, look at the boundary on the map' else 'agreed if the map is right' end as final from fs),
wl as (select *, case when cat = 'outside' then 'outside calibrated range' when cat = 'micro' then 'very short' when comparison in ('check', 'attention') then 'differs from existing projects' when terminal then 'end boundary at the last post'
  when boundary_status = 'check' then 'boundary or axis needs a check' when advice = 'check' then 'needs a check by hand' end as reason from st)"""


def _advice(spark, d):
    return on_axis.axis_advice(asset(spark, d), _ranges(spark, d), _anchors(spark, d), PROFILE)


@query(oracle("select proposal_id, proposed, n as objects, cast(round(s * 10) as bigint) as from_dm, cast(round(e * 10) as bigint) as to_dm, cast(round(dev * 10) as bigint) as deviation_dm, inr as in_range, comparison, cat as category, cast(data_signals as bigint) as data_signals, data_status, boundary_status, terminal, advice, final from st", ON_AXIS))
def axis_advice(spark, d):
    dm = lambda c, n: F.round(F.col(c) * 10).cast("bigint").alias(n)
    return _advice(spark, d).select("proposal_id", "proposed", "objects", dm("start_m", "from_dm"), dm("end_m", "to_dm"), dm("deviation_m", "deviation_dm"), "in_range", "comparison", "category", F.col("data_signals").cast("bigint").alias("data_signals"), "data_status", "boundary_status", "terminal", "advice", "final")


@query(oracle("select proposal_id, reason from wl where reason is not null", ON_AXIS))
def axis_worklist(spark, d):
    return advice.worklist(_advice(spark, d)).select("proposal_id", "reason")


@query(oracle("""select road, unnest(['proposals', 'no direct action', 'work list', 'differences', 'micro', 'outside', 'data quality', 'boundary']) as item, unnest([n, n - w, w, dif, mic, outs, dq, bnd]) as value,
 case when outs = n then 'check sources first' when w = 0 then 'usable, no actions' when n > w then 'usable with work list' else 'all proposals need judging' end as verdict
 from (select home as road, count(*) as n, count(reason) as w, count(*) filter (comparison in ('attention', 'check')) as dif, count(*) filter (cat = 'micro') as mic, count(*) filter (cat = 'outside') as outs,
 count(*) filter (data_status = 'attention') as dq, count(*) filter (boundary_status <> 'ok') as bnd from wl group by home) q""", ON_AXIS))
def axis_report(spark, d):
    return advice.run_report(_advice(spark, d))


@query(oracle("""select road as axis_id, track, chain, cast(round(min(s) * 10) as bigint) as from_dm, cast(round(max(e) * 10) as bigint) as to_dm, count(*) as parts, string_agg(proposal_id, ', ' order by s, e, proposal_id) filter (k <= 6) || case when count(*) > 6 then ' (+' || (count(*) - 6) || ')' else '' end as proposals, case when min(e - s) <= 100 then 1 else 2 end as priority
 from (select *, row_number() over (partition by road, track, chain order by s, e, proposal_id) as k from (select *, cast(sum(c) over (partition by road, track order by s, e, proposal_id) as bigint) as chain from (select *, case when e - s <= 200 and lag(e - s) over w <= 200 and s - lag(e) over w <= 5 and (layer = lag(layer) over w or layer = '' or lag(layer) over w = '') and (year_layer = lag(year_layer) over w or year_layer = '' or lag(year_layer) over w = '') then 0 else 1 end as c
 from st where cat = 'regular' window w as (partition by road, track order by s, e, proposal_id)) q) r) z group by 1, 2, 3 having count(*) > 1""", ON_AXIS))
def merge_candidates(spark, d):
    m = on_axis.merge_candidates(_advice(spark, d), PROFILE)
    dm = lambda c, n: F.round(F.col(c) * 10).cast("bigint").alias(n)
    return m.select("axis_id", "track", F.col("chain").cast("bigint").alias("chain"), dm("start_m", "from_dm"), dm("end_m", "to_dm"), "parts", "proposals", "priority")


_PRIMARY = "('rijstrook', 'parallelweg', 'landbouwpad', 'busbaan', 'fietspad')"
DIAGNOSIS = BOUND + REF.removeprefix(RANGES).replace("object_id in (select object_id from fx_asset where lower(trim(subtheme)) = 'rijstrook')", f"object_id in (select object_id from fx_asset where lower(trim(subtheme)) in {_PRIMARY})")


@query(oracle("""select bx.project, bx.axis_id, bx.status as boundary_status, bx.warning as boundary_warning, x.objects_on_axis, s.n as reference_objects, s.u as usable from bx join (select project, axis_id, count(*) as objects_on_axis from oranges where axis_id is not null group by 1, 2) x on x.project = bx.project and x.axis_id = bx.axis_id
 left join (select project, count(*) as n, count(*) filter (usable) as u from ru group by 1) s on s.project = bx.project""", DIAGNOSIS))
def axis_diagnosis(spark, d):
    objects = fixture(spark, d, OBJECTS.replace('"primary"', "`primary`"))
    axes = fixture(spark, d, "select distinct axis_id, axis_id as road from fx_vertex")
    t = boundaries.axis_diagnosis(objects, *_shapes(spark, d), _segments(spark, d), _anchors(spark, d), axes, fixture(spark, d, ZONES))
    b = t["boundaries"].select("project", "axis_id", "boundary_status", "boundary_warning")
    s = t["summary"].select("project", F.col("objects").alias("reference_objects"), "usable")
    return b.join(t["extents"].select("project", "axis_id", "objects_on_axis"), ["project", "axis_id"]).join(s, "project", "left")
