"""Advice on a calibrated axis from end to end: objects on the axis, technical runs, proposals, and the signals that their statuses rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.names import hm_label, tenth_up
from roadloom.functions.shared import materialize
from roadloom.functions.text import preview
from roadloom.operators import segment
from roadloom.operators.advice import proposal_statuses
from roadloom.operators.boundaries import interval_at
from roadloom.operators.linear import interpolate
from roadloom.operators.proposals import proposal_verdicts, terminal_attention
from roadloom.operators.scans import BLOCK, along, deal


def axis_runs(objects: DataFrame, ranges: DataFrame, profile: list[str], gap_m: float = 5.0, axis: str = "axis_id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, runs, single, part) of the objects (object_id, road, track, project, contract, profile ..) that have a range (object_id, axis,
    route_from, route_to): members are the objects without profile with their run, short local deviations counted to the run around them (their own one
    is run0); runs has one row a run (axis, track, run) with the road, extent, objects, gap_before and the profile; single has the runs
    before deviations are absorbed, part (axis, track, run, part_of) the run that each of them belongs to."""
    keys = [axis, "track"]
    # Stored with the columns needed: the runs count it by key before they sort it.
    o = objects.where("track <> ''").select("object_id", "road", "track", "project", "contract", *profile)
    o = materialize(o.join(ranges.where(F.col(axis).isNotNull()).select("object_id", axis, F.col("route_from").alias("start_m"), F.col("route_to").alias("end_m")), "object_id"), "axis-objects")
    cut = materialize(segment.technical_runs(o, keys, profile, gap_m), "axis-runs")
    single = materialize(segment.summarise_runs(cut, keys, profile), "axis-single-runs")
    part = materialize(segment.absorb_deviations(single, keys, profile), "axis-absorbed")
    members = materialize(cut.drop("gap_before", *profile).withColumnRenamed("run", "run0").join(part.select(*keys, F.col("run").alias("run0"), F.col("part_of").alias("run")), [*keys, "run0"]), "axis-members")
    own = F.col("run") == F.col("part_of")
    whole = single.join(part, [*keys, "run"]).groupBy(*keys, "part_of").agg(
        F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m"), F.sum("objects").alias("objects"), F.bool_or(own & F.col("gap_before")).alias("gap_before"), *[F.max(F.when(own, F.col(c))).alias(c) for c in profile],
    ).withColumnRenamed("part_of", "run")
    road = members.groupBy(*keys, "run").agg(F.min("road").alias("road"))
    return members, materialize(whole.join(road, [*keys, "run"]), "axis-whole-runs"), single, part


def axis_ends(runs: DataFrame, anchors: DataFrame, axis: str = "axis_id") -> DataFrame:
    """(axis, track, run, start_km, end_km, in_range, deviation_m, intervals): the kilometres of a run's ends on the axis, whether both lie within
    the calibrated part, the deviation of the post intervals that they lie in which is larger either way (of equal ones the longer interval's), and what there is to say of these."""
    keys = [axis, "track", "run"]
    ends = runs.select(*keys, F.explode(F.array(F.struct(F.lit("start").alias("end"), F.col("start_m").alias("route_m")), F.struct(F.lit("end").alias("end"), F.col("end_m").alias("route_m")))).alias("e")).select(*keys, "e.*")
    km = interpolate(ends, anchors.select(axis, "route_m", "hm_km"), axis, "route_m", "hm_km")
    j = interval_at(km, anchors, axis).withColumn("_d", F.col("interval_m") - F.col("expected_m")).select(*keys, "end", "hm_km", "in_range", "_d", "diagnosis")
    of = lambda e, c: F.max(F.when(F.col("end") == e, F.col(c)))
    g = j.groupBy(*keys).agg(of("start", "hm_km").alias("start_km"), of("end", "hm_km").alias("end_km"), F.bool_and(F.coalesce("in_range", F.lit(False))).alias("in_range"), F.max_by("_d", F.struct(F.round(F.abs("_d"), 6), "_d")).alias("deviation_m"), of("start", "diagnosis").alias("_s"), of("end", "diagnosis").alias("_e"))
    said = F.filter(F.array(F.when(F.col("_s") != "", F.concat(F.lit("begin: "), "_s")), F.when(F.col("_e") != "", F.concat(F.lit("end: "), "_e"))), lambda x: x.isNotNull())
    return g.withColumn("intervals", F.array_join(said, "; ")).drop("_s", "_e")


def axis_advice(objects: DataFrame, ranges: DataFrame, anchors: DataFrame, profile: list[str], gap_m: float = 5.0, axis: str = "axis_id") -> DataFrame:
    """One row per proposal on an axis, with the statuses of proposal_statuses and the signals behind them.

    objects: object_id, road, track, project, contract and the profile; ranges: object_ranges or geometry_ranges; anchors of the axes.
    A proposal is a technical run (axis_runs). comparison: ok where an existing project of its objects bears its name, check where
    it joins several, attention where it bears another name, null where there is none. own_status: check where the cut at its end
    rests on a missing value. data_signals counts contracts that differ or lack, and absorbed runs that lack values. terminal: its
    end is the last name of its road, and the interval there is off by 15 m or more or lies outside. Axes without two anchors
    have no kilometres; their proposals are out of range and have no name.
    """
    keys = [axis, "track", "run"]
    members, runs, single, part = axis_runs(objects, ranges, profile, gap_m, axis)
    ends = axis_ends(runs, anchors, axis)
    low, high = F.least("start_km", "end_km"), F.greatest("start_km", "end_km")
    # Names and numbers that follow from other columns are left out of what is stored and shuffled, and added where they are read.
    bare = materialize(runs.join(ends, keys, "left"), "axis-proposals")
    named = F.concat(F.col("road"), F.lit("-"), F.col("track"), F.lit("-"), hm_label("name_from"), F.lit("-"), hm_label("name_to"))

    def full(d: DataFrame) -> DataFrame:
        d = d.withColumns({"name_from": tenth_up(low), "name_to": tenth_up(high), "in_range": F.coalesce("in_range", F.lit(False)), "length_m": F.col("end_m") - F.col("start_m")})
        return d.withColumns({"proposal_id": F.concat_ws("-", axis, "track", F.col("run").cast("string")), "proposed": F.coalesce(named, F.lit(""))})

    told = proposal_verdicts(full(bare), members.select(*keys, F.col("project").alias("existing")), keys)
    told = told.select(*keys, F.when(F.col("difference") != "no existing project", F.col("status")).alias("comparison"))
    cuts = segment.transitions(runs, keys[:2], profile).select(*keys, F.when(F.startswith("reason", F.lit("check")), "check").alias("own_status"))
    lacks = segment.contract_signals(members, keys).groupBy(*keys).agg(F.count("*").alias("_c"))
    local = segment.local_deviations(single, part, keys[:2], profile).where("kind = 'missing values'").groupBy(*keys[:2], F.col("part_of").alias("run")).agg(F.count("*").alias("_l"))
    d = full(bare.join(told, keys, "left").join(cuts, keys, "left").join(lacks, keys, "left").join(local, keys, "left"))
    d = d.withColumn("data_signals", F.coalesce("_c", F.lit(0)) + F.coalesce("_l", F.lit(0))).drop("_c", "_l")
    d = terminal_attention(d.withColumn("_bad", ~F.col("in_range") | F.coalesce(F.abs("deviation_m") >= 15.0, F.lit(False))), "_bad", "name_to").drop("_bad")
    return proposal_statuses(materialize(d, "axis-signals"))


def merge_candidates(statuses: DataFrame, profile: list[str], short_m: float = 200.0, very_short_m: float = 100.0, gap_m: float = 5.0, axis: str = "axis_id", listed: int = 6) -> DataFrame:
    """(axis, track, chain, start_m, end_m, length_m, parts, proposals, priority, intervals): short regular proposals that follow each other on
    a track without a gap and could be one: in each field of the profile they agree or one of them is empty.

    An island of such neighbours is a candidate, from two on; priority 1 where one of them is very short, else 2. intervals is what there is
    to say of the post intervals at the candidate's outer ends. Nothing is merged by this: it is a list for a check on the map.
    """
    keys, by = [axis, "track"], ["start_m", "end_m", "proposal_id"]
    few = statuses.where((F.col("category") == "regular")).withColumn("_short", F.col("length_m") <= short_m)
    d, hot = deal(few.select(*keys, *by, "length_m", "intervals", "_short", F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in profile]).alias("_p")), keys, by, "merge-blocks")
    d = along(d, hot, keys, by, lags={"_ls": F.col("_short"), "_lp": F.col("_p"), "_le": F.col("end_m")})
    alike = F.lit(True)
    for c in profile:
        alike = alike & ((F.col(f"_p.{c}") == F.col(f"_lp.{c}")) | (F.col(f"_p.{c}") == "") | (F.col(f"_lp.{c}") == ""))
    joins = F.coalesce(F.col("_short") & F.col("_ls") & alike & (F.col("start_m") - F.col("_le") <= gap_m), F.lit(False))
    c = along(d.withColumn("_cut", F.when(joins, 0).otherwise(1)), hot, keys, by, sums={"chain": F.col("_cut")}).drop(BLOCK)
    g = c.groupBy(*keys, "chain").agg(
        F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m"), F.count("*").alias("parts"), F.array_sort(F.collect_list(F.struct(*by))).alias("_ids"), F.min("length_m").alias("_least"),
        F.min_by("intervals", F.struct(*by)).alias("_s"), F.max_by("intervals", F.struct(*by)).alias("_e"),
    ).where("parts > 1")
    ids = preview(F.transform("_ids", lambda x: x["proposal_id"]), listed)
    both = F.array_distinct(F.filter(F.array("_s", "_e"), lambda x: x != ""))
    return g.select(*keys, "chain", "start_m", "end_m", (F.col("end_m") - F.col("start_m")).alias("length_m"), "parts", ids.alias("proposals"), F.when(F.col("_least") <= very_short_m, 1).otherwise(2).alias("priority"), F.array_join(both, "; ").alias("intervals"))
