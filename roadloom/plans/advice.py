"""Registered queries of proposal advice; importing this module adds them to those of plans.proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.operators import advice, proposals
from roadloom.plans.fixtures import oracle
from roadloom.plans.proposals import ACCEPTED, ORACLE_SQL, PROP, QUERIES, _assigned, _proposals
from roadloom.plans.queries import query

__all__ = ["ORACLE_SQL", "QUERIES"]

# What the statuses look at, made of the proposals' own extent so that every branch occurs.
_IN = """in0 as (select *, start_m / 1000 as name_from, end_m / 1000 as name_to, run % 17 <> 0 as in_range,
 case run % 5 when 0 then 'attention' when 1 then 'check' when 2 then null else 'ok' end as comparison0, case when run % 3 = 0 then 'check' end as own_status,
 case when layer = '' then 1 else 0 end as data_signals, cast(run % 23 as double) as deviation_m, run % 13 = 0 as terminal from prop)"""
ST = PROP + ", " + _IN + """, st0 as (select *, coalesce(comparison0, 'unknown') as comparison, case when not in_range then 'outside' when length_m <= 25 then 'micro' else 'regular' end as cat,
 case when data_signals > 0 then 'attention' else 'ok' end as data_status, case when not in_range then 'check' when deviation_m >= 15 then 'attention' else 'ok' end as boundary_status from in0),
st as (select *, case when cat <> 'regular' then 'check' when comparison <> 'unknown' then comparison else coalesce(own_status, 'ok') end as advice,
 case when cat = 'outside' then 'do not use without a check by hand' when cat = 'micro' then 'not a regular project' when comparison in ('check', 'attention') then 'check difference with existing projects'
  when terminal then 'check end boundary on the map' when data_status <> 'ok' then 'agreed, check data quality' when boundary_status = 'attention' then 'agreed, look at the boundary on the map' else 'agreed if the map is right' end as final from st0),
wl as (select *, case when cat = 'outside' then 'outside calibrated range' when cat = 'micro' then 'very short' when comparison in ('check', 'attention') then 'differs from existing projects' when terminal then 'end boundary at the last post'
  when boundary_status = 'check' then 'boundary or axis needs a check' when advice = 'check' then 'needs a check by hand' end as reason from st)"""


def _statuses(spark, d):
    p = _proposals(spark, d)
    run = F.col("run")
    p = p.withColumns({
        "name_from": F.col("start_m") / 1000, "name_to": F.col("end_m") / 1000, "in_range": run % 17 != 0,
        "comparison": F.when(run % 5 == 0, "attention").when(run % 5 == 1, "check").when(run % 5 == 2, None).otherwise("ok"), "own_status": F.when(run % 3 == 0, "check"),
        "data_signals": F.when(F.col("layer") == "", 1).otherwise(0), "deviation_m": (run % 23).cast("double"), "terminal": run % 13 == 0,
    })
    return advice.proposal_statuses(p)


@query(oracle("select proposal_id, comparison, cat as category, data_status, boundary_status, boundary_status as axis_status, advice, final from st", ST))
def proposal_statuses(spark, d):
    return _statuses(spark, d).select("proposal_id", "comparison", "category", "data_status", "boundary_status", "axis_status", "advice", "final")


@query(oracle("""select proposal_id, reason, case reason when 'outside calibrated range' then 'check boundary on the map' when 'very short' then 'judge micro or end zone' when 'differs from existing projects' then 'check difference with existing projects'
 when 'end boundary at the last post' then 'check boundary on the map' when 'boundary or axis needs a check' then 'check boundary on the map' else 'judge by hand' end as action from wl where reason is not null""", ST))
def proposal_worklist(spark, d):
    return advice.worklist(_statuses(spark, d)).select("proposal_id", "reason", "action")


@query(oracle("""select road, unnest(['proposals', 'no direct action', 'work list', 'differences', 'micro', 'outside', 'data quality', 'boundary']) as item, unnest([n, n - w, w, dif, mic, outs, dq, bnd]) as value,
 case when outs = n then 'check sources first' when w = 0 then 'usable, no actions' when n > w then 'usable with work list' else 'all proposals need judging' end as verdict
 from (select road, count(*) as n, count(reason) as w, count(*) filter (comparison in ('attention', 'check')) as dif, count(*) filter (cat = 'micro') as mic, count(*) filter (cat = 'outside') as outs,
 count(*) filter (data_status = 'attention') as dq, count(*) filter (boundary_status <> 'ok') as bnd from wl group by road) q""", ST))
def run_report(spark, d):
    return advice.run_report(_statuses(spark, d))


_POINTS = ST + """, mm as (select road || '-' || track || '-' || run as proposal_id, count(*) as objects from runs1 where track in ('HRB', 'PWR', 'PWL') and subtheme <> case track when 'HRB' then 'rijstrook' else 'parallelweg' end group by 1),
points as (select case when length_m <= 100 then 1 else 2 end as priority, case when length_m <= 100 then 'very short proposal' else 'short proposal' end as kind, proposal_id, proposed, cast(1 as bigint) as objects from st where cat = 'regular' and length_m <= 200
 union all select 1, 'repeated name', '', proposed, count(*) from st group by proposed having count(*) > 1
 union all select 2, 'object family differs', mm.proposal_id, st.proposed, mm.objects from mm join st on mm.proposal_id = st.proposal_id)"""


def _points(spark, d):
    accepted = spark.createDataFrame(ACCEPTED, "track string, subtheme string")
    return advice.calibration_points(_statuses(spark, d), proposals.family_mismatches(_proposals(spark, d), _assigned(spark, d), accepted))


@query(oracle("select priority, kind, proposal_id, proposed, objects from points", _POINTS))
def calibration_points(spark, d):
    return _points(spark, d)


@query(oracle("select kind, priority, count(*) as points, cast(sum(objects) as bigint) as objects from points group by 1, 2", _POINTS))
def calibration_summary(spark, d):
    return advice.calibration_summary(_points(spark, d))
