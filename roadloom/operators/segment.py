"""Segmentation of tracks into runs of one technical profile, with short local deviations absorbed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.text import profile_value
from roadloom.operators.scans import BLOCK, along, deal


def technical_runs(objects: DataFrame, keys: list[str], profile: list[str], gap_m: float = 5.0, order: str = "object_id") -> DataFrame:
    """objects + run (from 1 within keys) and gap_before: a run ends at a gap beyond the furthest end so far, or where the
    profile changes. Columns: start_m, end_m; objects are taken in order of (start_m, end_m, order)."""
    by = ["start_m", "end_m", order]
    p = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in profile])
    d, hot = deal(objects.withColumn("_p", p), keys, by, "run-blocks")
    d = along(d, hot, keys, by, maxes={"_reach": F.col("end_m")}, lags={"_last": F.col("_p")})
    d = d.withColumn("gap_before", F.coalesce(F.col("start_m") - F.col("_reach") > gap_m, F.lit(False)))
    first = F.col("_last").isNull() | F.col("gap_before") | (F.col("_last") != F.col("_p"))
    return along(d.withColumn("_cut", F.when(first, 1).otherwise(0)), hot, keys, by, sums={"run": F.col("_cut")}).drop("_p", "_cut", "_reach", "_last", BLOCK)


def summarise_runs(runs: DataFrame, keys: list[str], profile: list[str]) -> DataFrame:
    """One row per run: extent, number of objects, profile, and whether a gap precedes it."""
    return runs.groupBy(*keys, "run").agg(
        F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m"), F.count("*").alias("objects"), F.bool_or("gap_before").alias("gap_before"), *[F.first(F.coalesce(c, F.lit(""))).alias(c) for c in profile],
    )


def cut_stretches(runs: DataFrame, keys: list[str], max_objects: int = 2, max_length_m: float = 100.0) -> DataFrame:
    """runs + stretch (from 1 within keys), cut at gaps and between two neighbours that are both too big to be absorbed.

    No deviation is absorbed across such a cut, as merged runs only grow."""
    big = (F.col("objects") > max_objects) | (F.col("end_m") - F.col("start_m") >= max_length_m)
    d, hot = deal(runs.withColumn("_big", big), keys, ["run"], "stretch-blocks")
    d = along(d, hot, keys, ["run"], lags={"_last": F.col("_big")})
    cut = F.coalesce(F.col("gap_before") | (F.col("_big") & F.col("_last")), F.lit(True))
    return along(d.withColumn("_cut", cut.cast("int")), hot, keys, ["run"], sums={"stretch": F.col("_cut")}).drop("_big", "_last", "_cut", BLOCK)


def absorb_deviations(runs: DataFrame, keys: list[str], profile: list[str], max_objects: int = 2, max_length_m: float = 100.0) -> DataFrame:
    """keys + (run, part_of): short A-B-A deviations join the run around them.

    A run B of at most max_objects objects and less than max_length_m, without a gap before it or before its right
    neighbour, between two runs of one profile becomes part of the left one. Merged runs have three objects at least and
    never count as short again, so one pass with a stack is the fixpoint. The stack holds the runs of one
    stretch (cut_stretches), not of a whole track; only an unbroken row in which no two neighbours are big makes it long.
    """
    p = F.struct(*[F.col(c) for c in profile])
    track = cut_stretches(runs, keys, max_objects, max_length_m).groupBy(*keys, "stretch").agg(F.array_sort(F.collect_list(F.struct("run", "start_m", "end_m", "objects", "gap_before", p.alias("p"), F.array("run").alias("members")))).alias("rs"))
    top, second = F.lit(-1), F.lit(-2)

    def push(stack, r):
        b, a = F.element_at(stack, top), F.element_at(stack, second)
        fold = (F.size(stack) >= 2) & (b["objects"] <= max_objects) & (b["end_m"] - b["start_m"] < max_length_m) & ~b["gap_before"] & ~r["gap_before"] & (a["p"] == r["p"])
        whole = F.struct(
            a["run"].alias("run"), F.least(a["start_m"], b["start_m"], r["start_m"]).alias("start_m"), F.greatest(a["end_m"], b["end_m"], r["end_m"]).alias("end_m"),
            (a["objects"] + b["objects"] + r["objects"]).alias("objects"), a["gap_before"].alias("gap_before"), a["p"].alias("p"), F.concat(a["members"], b["members"], r["members"]).alias("members"),
        )
        return F.when(F.size(stack) < 2, F.concat(stack, F.array(r))).when(fold, F.concat(F.slice(stack, 1, F.size(stack) - 2), F.array(whole))).otherwise(F.concat(stack, F.array(r)))

    folded = track.withColumn("st", F.aggregate("rs", F.filter("rs", lambda x: F.lit(False)), push))
    return folded.select(*keys, F.explode("st").alias("s")).select(*keys, F.col("s.run").alias("part_of"), F.explode("s.members").alias("run"))


def contract_signals(objects: DataFrame, keys: list[str], contract: str = "contract", max_objects: int = 2, max_length_m: float = 100.0) -> DataFrame:
    """keys (of a run) + signal: several contracts, all missing, a few missing, or some missing; rows without a signal are left out."""
    c = F.when(F.col(contract) != "", F.col(contract))
    g = objects.groupBy(*keys).agg(F.count_distinct(c).alias("kinds"), F.count_if(c.isNull()).alias("gone"), F.sum(F.when(c.isNull(), F.greatest(F.col("end_m") - F.col("start_m"), F.lit(0)))).alias("gone_m"))
    local = (F.col("gone") <= max_objects) & (F.col("gone_m") < max_length_m) & (F.col("kinds") == 1)
    signals = F.filter(F.array(
        F.when(F.col("kinds") > 1, "several contracts"),
        F.when(F.col("gone") == 0, None).when(local, "few objects without contract").when(F.col("kinds") == 0, "no contract").otherwise("some objects without contract"),
    ), lambda x: x.isNotNull())
    return g.select(*keys, F.explode(signals).alias("signal"))


def changed_fields(before: str, after: str, fields: list[str]) -> Column:
    """Names of the fields in which two structs differ, in the given order; empty equals null."""
    v = lambda s, f: F.coalesce(profile_value(F.col(f"{s}.{f}")), F.lit(""))
    return F.filter(F.array(*[F.when(v(before, f) != v(after, f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def local_deviations(runs: DataFrame, absorbed: DataFrame, keys: list[str], profile: list[str]) -> DataFrame:
    """keys + (run, part_of, kind, fields): absorbed runs that differ from the run that took them in.

    kind is `missing values` if all fields that differ are empty in the absorbed run, which is a matter of data quality, else
    `technical deviation`, which is worth a look but cuts nothing.
    """
    p = runs.select(*keys, "run", F.struct(*profile).alias("_p"))
    j = absorbed.where("run <> part_of").join(p, [*keys, "run"]).join(p.withColumnsRenamed({"run": "part_of", "_p": "_a"}), [*keys, "part_of"])
    j = j.withColumn("fields", changed_fields("_a", "_p", profile)).where(F.size("fields") > 0)
    filled = [F.when(F.array_contains("fields", f), F.coalesce(profile_value(F.col(f"_p.{f}")), F.lit("")) != "").otherwise(False) for f in profile]
    some = filled[0]
    for f in filled[1:]:
        some = some | f
    return j.select(*keys, "run", "part_of", F.when(some, "technical deviation").otherwise("missing values").alias("kind"), "fields")


def transitions(runs: DataFrame, keys: list[str], profile: list[str], contracts: DataFrame | None = None) -> DataFrame:
    """runs + (changed, reason): why each run ends. contracts: (keys, run, contracts), a run's contract numbers as a sorted array; where
    two neighbours have some and none in common, a cut says that the contract changes too."""
    w = W.partitionBy(*keys).orderBy("run")
    nxt = lambda c: F.lead(c).over(w)
    changed = F.filter(F.array(*[F.when(F.col(c) != F.col(f"_n_{c}"), F.lit(c)) for c in profile]), lambda x: x.isNotNull())
    d = runs.withColumns({f"_n_{c}": nxt(c) for c in profile} | {"_g": nxt("gap_before")}).withColumn("changed", F.when(F.col("_g").isNull(), F.array().cast("array<string>")).otherwise(changed))
    blank = F.exists(F.array(*[F.when((F.col(c) != F.col(f"_n_{c}")) & ((F.col(c) == "") | (F.col(f"_n_{c}") == "")), True).otherwise(False) for c in profile]), lambda x: x)
    text = F.array_join("changed", ", ")
    too = F.lit("")
    if contracts is not None:
        d = d.join(contracts.select(*keys, "run", F.col("contracts").alias("_c")), [*keys, "run"], "left").withColumn("_nc", F.lead("_c").over(w))
        too = F.when((F.size("_c") > 0) & (F.size("_nc") > 0) & ~F.arrays_overlap("_c", "_nc"), "; contract changes too").otherwise("")
    reason = F.when(F.col("_g").isNull(), "end of track").when(F.col("_g"), "gap").when(F.size("changed") == 0, "no technical cut").when(blank, F.concat(F.lit("check structural cut: "), text, too)).otherwise(F.concat(F.lit("hard technical cut: "), text, too))
    return d.withColumn("reason", reason).drop("_g", "_c", "_nc", *[f"_n_{c}" for c in profile])
