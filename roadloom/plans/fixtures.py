"""Asset, maintenance, axis and post tables derived from lineitem by one SQL text that Spark and DuckDB both run."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

NAME = """'N' || cast(350 + rd as varchar(9)) || '-' || case ln when 3 then 'PWR' when 4 then 'PWL' when 5 then 'FPR' else 'HRB' end || '-' ||
    lpad(cast(cast(floor({b} * 4 / 10) as bigint) as varchar(9)), 2, '0') || '.' || cast(({b} * 4) % 10 as varchar(9)) || '-' ||
    lpad(cast(cast(floor(({b} + 1) * 4 / 10) as bigint) as varchar(9)), 2, '0') || '.' || cast((({b} + 1) * 4) % 10 as varchar(9))"""
_BLOCK = "(pblk + case when pk % 31 = 0 then 1 else 0 end)"

#: Common table expressions: fx_asset, fx_maintenance, fx_line, fx_vertex, fx_post.
FX = f"""with base as (
  select l_orderkey as ok, cast(l_linenumber as bigint) as ln, min(l_partkey) as pk, min(l_suppkey) as sk,
         cast(min(l_quantity) as bigint) as qty, min(l_extendedprice) as price
  from lineitem group by l_orderkey, cast(l_linenumber as bigint)),
asset0 as (
  select b.*, b.ok % 12 as rd, cast(floor(b.ok / 12) as bigint) as idx,
         cast(floor(floor(b.ok / 12) / 8) as bigint) as blk, cast(floor(floor(b.ok / 12) / 16) as bigint) as pblk
  from base b),
fx_asset as (
  select cast(ok * 8 + ln as bigint) as object_id,
    'VV-N' || cast(350 + rd as varchar(9)) || '-' || cast(ok as varchar(19)) || '.' || cast(ln as varchar(9)) as object_no,
    'N' || cast(350 + rd as varchar(9)) as road,
    case ln when 1 then 'rijstrook' when 2 then 'Rijstrook ' when 3 then 'parallelweg' when 4 then 'parallelweg'
            when 5 then 'fietspad' when 6 then 'bermverharding' else 'carpoolplaats' end as subtheme,
    case ln when 4 then 'links' when 6 then '' else 'rechts' end as side,
    case ln when 1 then 'HRB' when 2 then 'HRB' when 3 then 'PWR' when 4 then 'PWL' when 5 then 'FPR' else '' end as track,
    cast(idx * 25 as double) as start_m, cast(idx * 25 + qty as double) as end_m,
    case when pk % 37 = 0 then '4,,9' when pk % 41 = 0 then 'nan'
         else cast(cast(floor(idx * 25 / 1000) as bigint) as varchar(19)) || ',' || lpad(cast((idx * 25) % 1000 as varchar(9)), 3, '0') end as chainage_text,
    case when pk % 29 = 0 then '' when ln >= 6 and pk % 3 > 0 then '' else {NAME.format(b=_BLOCK)} end as project,
    case when pk % 17 = 0 then '' when pk % 23 = 0 then 'L9' else 'L' || cast(blk % 3 as varchar(9)) end as layer,
    cast(1990 + (blk * 7) % 30 as varchar(9)) || '.0' as year_layer,
    case when pk % 19 = 0 then '' else 'B-' || cast(cast(floor(blk / 2) as bigint) % 50 as varchar(9)) end as contract,
    cast(price as double) as price, sk, pk, ok, ln, idx, rd, blk, qty
  from asset0),
fx_maintenance as (
  select case when pk % 43 = 0 then 'VV-N999-' || cast(ok as varchar(19)) || '.' || cast(ln as varchar(9)) else object_no end as object_no,
    case when blk % 11 = 0 then replace(project, 'HRB', 'HRBR') else project end as project,
    'M' || cast(pk % 5 as varchar(9)) as measure, cast(qty as varchar(9)) || ',5' as amount, cast(price as varchar(30)) as price, pk
  from fx_asset where pk % 13 > 0 and project <> ''),
fx_line as (
  select object_id, road, lower(trim(subtheme)) as subtheme_key, start_m as x1, end_m as x2,
    1000.0 * rd + case track when 'HRB' then 0 when 'PWR' then 8 when 'PWL' then -8 when 'FPR' then 14 else 18 end as y1,
    1000.0 * rd + case track when 'HRB' then 0 when 'PWR' then 8 when 'PWL' then -8 when 'FPR' then 14 else 18 end as y2
  from fx_asset),
fx_vertex as (
  select road as axis_id, cast(idx as bigint) as seq, cast(idx * 25 as double) as x, cast(1000 * rd + (idx % 3) as double) as y
  from fx_asset where ln = 1 and idx % 20 = 0 group by road, idx, rd),
fx_post as (
  select road as axis_id, cast(idx * 25 / 100 as double) / 10 as hm_km, cast(idx * 25 + (blk % 5) * 4 as double) as route_m, cast(pk % 7 as double) as offset_m
  from (select road, idx, blk, min(pk) as pk from fx_asset where ln = 1 and idx % 4 = 0 group by road, idx, blk) q)
"""


def fixture(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    """select over the tables above."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(FX.replace("from lineitem", "from {src}") + select, src=line)


def oracle(select: str, more: str = "") -> str:
    """The same tables in front of a DuckDB query; more: further common table expressions."""
    return FX + (f", {more} " if more else "") + select


