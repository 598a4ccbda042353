"""Advice on project proposals: separate statuses, the work list that follows from them, a report per road, calibration points.

Everything is a column expression on the proposal's own row, or a count per road or name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons for a row on the work list, and what to do about each.
ACTIONS = {
    "outside calibrated range": "check boundary on the map",
    "very short": "judge micro or end zone",
    "differs from existing projects": "check difference with existing projects",
    "end boundary at the last post": "check boundary on the map",
    "boundary or axis needs a check": "check boundary on the map",
}
#: Counters of the report: name and the condition on a row with statuses.
COUNTERS = {
    "proposals": "true",
    "no direct action": "reason is null",
    "work list": "reason is not null",
    "differences": "comparison in ('attention', 'check')",
    "micro": "category = 'micro'",
    "outside": "category = 'outside'",
    "data quality": "data_status = 'attention'",
    "boundary": "boundary_status <> 'ok'",
}


def _ladder(*steps: tuple[Column, str | Column]) -> Column:
    """The value of the first condition that holds; null where none does."""
    return F.coalesce(*[F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in steps])


def proposal_statuses(proposals: DataFrame, micro_m: float = 25.0, deviation_m: float = 15.0) -> DataFrame:
    """proposals + (comparison, category, data_status, boundary_status, axis_status, advice, final).

    Input: length_m, name_from, name_to (kilometres in the proposed name), in_range (both ends within the calibrated axis),
    comparison (ok, attention, check, or null: unknown), own_status, data_signals (count), deviation_m (the larger absolute
    deviation of the intervals at both ends), terminal (the end lies at the last post and asks for attention). Data quality
    never makes the advice worse; a null counts as no signal.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    out, cmp = ~F.coalesce(F.col("in_range"), F.lit(True)), F.coalesce(F.col("comparison"), F.lit("unknown"))
    short = (F.col("length_m") <= micro_m) | (F.abs(F.col("name_from") - F.col("name_to")) < 0.0001)
    far = F.coalesce(F.abs("deviation_m") >= deviation_m, F.lit(False))
    d = proposals.withColumns({
        "comparison": cmp,
        "category": _ladder((out, "outside"), (short, "micro"), (F.lit(True), "regular")),
        "data_status": F.when(F.coalesce("data_signals", F.lit(0)) > 0, "attention").otherwise("ok"),
        "boundary_status": _ladder((out, "check"), (far, "attention"), (F.lit(True), "ok")),
        "axis_status": _ladder((out, "check"), (far, "attention"), (F.lit(True), "ok")),
    })
    regular = F.col("category") == "regular"
    advice = _ladder((~regular, "check"), (F.col("comparison").isin("check", "attention", "ok"), F.col("comparison")), (F.lit(True), F.coalesce("own_status", F.lit("ok"))))
    final = _ladder(
        (F.col("category") == "outside", "do not use without a check by hand"), (F.col("category") == "micro", "not a regular project"),
        (F.col("comparison").isin("check", "attention"), "check difference with existing projects"), (yes("terminal"), "check end boundary on the map"),
        ((F.col("boundary_status") == "check") | (F.col("axis_status") == "check"), "check boundary and calibration"),
        (F.col("data_status") != "ok", "agreed, check data quality"), (F.col("boundary_status") == "attention", "agreed, look at the boundary on the map"), (F.lit(True), "agreed if the map is right"),
    )
    return d.withColumn("advice", advice).withColumn("final", final)


def with_reasons(statuses: DataFrame) -> DataFrame:
    """statuses + (reason, action): why a proposal is on the work list (null: it isn't), and what to do."""
    reason = _ladder(
        (F.col("category") == "outside", "outside calibrated range"), (F.col("category") == "micro", "very short"), (F.col("comparison").isin("check", "attention"), "differs from existing projects"),
        (F.coalesce(F.col("terminal"), F.lit(False)), "end boundary at the last post"), ((F.col("axis_status") == "check") | (F.col("boundary_status") == "check"), "boundary or axis needs a check"), (F.col("advice") == "check", "needs a check by hand"),
    )
    d = statuses.withColumn("reason", reason)
    told = _ladder(*[(F.col("reason") == r, a) for r, a in ACTIONS.items()], (F.col("reason").isNotNull(), "judge by hand"))
    quiet = _ladder((F.col("data_status") != "ok", "none, check data when handling this project"), (F.col("boundary_status") != "ok", "none, look at the map when judging"), (F.lit(True), "none"))
    return d.withColumn("action", F.coalesce(told, quiet))


def worklist(statuses: DataFrame) -> DataFrame:
    """Only the proposals that ask for an action."""
    return with_reasons(statuses).where("reason is not null")


def run_report(statuses: DataFrame, road: str = "road") -> DataFrame:
    """(road, item, value, verdict), a row per counter and road. verdict, the same in all rows of a road: no source to trust
    where every proposal is out of range, usable without actions, usable with a work list, or all need judging."""
    r = with_reasons(statuses).groupBy(road).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in COUNTERS.items()])
    verdict = _ladder(
        (F.col("outside") >= F.col("proposals"), "check sources first"), (F.col("work list") == 0, "usable, no actions"),
        (F.col("no direct action") > 0, "usable with work list"), (F.lit(True), "all proposals need judging"),
    )
    r = r.withColumn("verdict", verdict)
    return r.unpivot([road, "verdict"], list(COUNTERS), "item", "value").select(road, "item", "value", "verdict")


def calibration_points(statuses: DataFrame, mismatches: DataFrame, short_m: float = 200.0, very_short_m: float = 100.0) -> DataFrame:
    """(priority, kind, proposal_id, proposed, objects): where merging and cutting of proposals may need tuning.

    Short regular proposals (priority 2, very short ones 1), names that several proposals share (1, once per name), and
    proposals with objects of another family (2; mismatches: proposal_id, objects). objects counts what the row is about.
    """
    brief = statuses.where((F.col("category") == "regular") & (F.col("length_m") <= short_m))
    very = F.col("length_m") <= very_short_m
    a = brief.select(F.when(very, 1).otherwise(2).alias("priority"), F.when(very, "very short proposal").otherwise("short proposal").alias("kind"), "proposal_id", "proposed", F.lit(1).cast("long").alias("objects"))
    b = statuses.where("trim(proposed) <> ''").groupBy("proposed").agg(F.count("*").alias("objects")).where("objects > 1")
    b = b.select(F.lit(1).alias("priority"), F.lit("repeated name").alias("kind"), F.lit("").alias("proposal_id"), "proposed", "objects")
    c = mismatches.groupBy("proposal_id").agg(F.sum("objects").alias("objects")).join(statuses.select("proposal_id", "proposed"), "proposal_id", "left")
    c = c.select(F.lit(2).alias("priority"), F.lit("object family differs").alias("kind"), "proposal_id", F.coalesce("proposed", F.lit("")).alias("proposed"), "objects")
    return a.unionByName(b).unionByName(c)


def calibration_summary(points: DataFrame) -> DataFrame:
    """(kind, priority, points, objects) of calibration_points."""
    return points.groupBy("kind", "priority").agg(F.count("*").alias("points"), F.sum("objects").alias("objects"))
