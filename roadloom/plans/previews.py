"""Registered queries of previews by first sight; importing this module adds them to the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions.text import chainage_km, project_key
from roadloom.operators import previews
from roadloom.plans.coverage import ORACLE_SQL, QUERIES
from roadloom.plans.fixtures import fixture, oracle
from roadloom.plans.queries import A, M, asset, maint, query

__all__ = ["ORACLE_SQL", "QUERIES"]


def _said(table: str, column: str, most: int) -> str:
    """SQL (key, t): the first values of a column by their least position."""
    return f"""(select project_key, string_agg(v, ', ' order by k) filter (where k <= {most}) || case when max(k) > {most} then ' (+' || (max(k) - {most}) || ')' else '' end as t from
 (select *, row_number() over (partition by project_key order by p, v) as k from (select project_key, v, min(pos) as p from (select project_key, trim({column}) as v, pos from {table}) c where v <> '' group by 1, 2) q) r group by 1)"""


#: Rows in an order of their own, as if read from a file.
_POS = "pk * 8 + ln"
ASSET_POS = A + f", ap as (select *, {_POS} as pos from a where project_key <> '')"
MAINT_POS = M + ", mp as (select *, object_no || measure as pos from m where project_key <> '')"


def _asset(spark, d):
    return asset(spark, d).withColumn("project_key", project_key("project")).withColumn("km", chainage_km("chainage_text")).withColumn("pos", F.expr(_POS))


@query(oracle(f"""select k.project_key, coalesce(s.t, '') as subthemes, coalesce(r.t, '') as roads, coalesce(v.t, '') as variants, coalesce(o.t, '') as object_nos from (select distinct project_key from ap) k left join {_said('ap', 'subtheme', 6)} s on s.project_key = k.project_key
 left join {_said('ap', 'road', 6)} r on r.project_key = k.project_key left join {_said('ap', 'project', 6)} v on v.project_key = k.project_key left join {_said('ap', 'object_no', 8)} o on o.project_key = k.project_key""", ASSET_POS))
def asset_previews(spark, d):
    return previews.asset_previews(_asset(spark, d), "pos").select("project_key", "subthemes", "roads", "variants", "object_nos")


@query(oracle(f"""select k.project_key, coalesce(v.t, '') as variants, coalesce(s.t, '') as measures, coalesce(o.t, '') as object_nos from (select distinct project_key from mp) k left join {_said('mp', 'project', 6)} v on v.project_key = k.project_key
 left join {_said('mp', 'measure', 6)} s on s.project_key = k.project_key left join {_said('mp', 'object_no', 8)} o on o.project_key = k.project_key""", MAINT_POS))
def maintenance_previews(spark, d):
    m = maint(spark, d).withColumn("project_key", project_key("project")).withColumn("pos", F.concat("object_no", "measure"))
    return previews.maintenance_previews(m, "pos")


@query(oracle("""select project_key, max(case when c = 'layer' then v end) as layer, max(case when c = 'contract' then v end) as contract from (select project_key, c, arg_min(v, {'n': -n, 'p': p, 'v': v}) as v from (select project_key, c, v, count(*) as n, min(pos) as p from
 (select project_key, pos, unnest(['layer', 'contract']) as c, unnest([layer, contract]) as v from ap) u where v <> '' group by 1, 2, 3) q group by 1, 2) r group by 1""", ASSET_POS))
def common_values_first(spark, d):
    return previews.most_common_first(_asset(spark, d).where("project_key <> ''"), ["project_key"], ["layer", "contract"], "pos")


@query(oracle("select project_key, string_agg(v || case when n > 1 then ' (' || n || ')' else '' end, ', ' order by n desc, v) as subtheme from (select project_key, lower(trim(subtheme)) as v, count(*) as n from ap group by 1, 2) q where v <> '' group by 1", ASSET_POS))
def subtheme_counts(spark, d):
    return previews.counts_text(_asset(spark, d).where("project_key <> ''"), ["project_key"], "subtheme")
