"""The work list as people use it: defaults, filters, a summary per project, and the verdict on a whole run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.shared import materialize
from roadloom.functions.text import clean_text, display_text
from roadloom.operators.quality import quality_report
from roadloom.operators.reconcile import action_list, carry_over, compare_projects, mutation_suggestions, object_differences, replacement_candidates, stored_sides, track_progress

FOLLOW_UP = ["state", "owner", "remark"]
#: Score of a severity in lists that have no priority yet.
SEVERITY_SCORE = {"warning": 70, "attention": 45, "info": 20}
PRIORITIES = ["low", "middle", "high"]


def priority_label(score: Column) -> Column:
    return F.when(score >= 85, "high").when(score >= 55, "middle").otherwise("low")


def queue_defaults(actions: DataFrame) -> DataFrame:
    """actions with every column that the work list needs: follow-up columns (state `new`), project, priority and priority_score.

    Rows of older lists without a priority get one from their severity and the number of objects, 20 at most.
    """
    have = set(actions.columns)
    text = lambda c, default="": F.coalesce(clean_text(c), F.lit(default)) if c in have else F.lit(default)
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    base = reduce(lambda w, kv: w.when(F.lower(text("severity")) == kv[0], kv[1]), SEVERITY_SCORE.items(), F.when(F.lit(False), 0)).otherwise(20)
    derived = (base + F.least(number("objects"), F.lit(20.0))).cast("int")
    missing = text("priority") == ""
    score = F.when(missing, derived).otherwise(number("priority_score").cast("int"))
    return actions.withColumns(
        {c: text(c, "new" if c == "state" else "") for c in FOLLOW_UP} | {"project_key": text("project_key", "control point")}
        | {"priority": F.when(missing, priority_label(derived)).otherwise(text("priority")), "priority_score": score}
    )


def filter_queue(actions: DataFrame, search: str | None = None, search_columns: list[str] | None = None, **equal) -> DataFrame:
    """Rows whose columns equal the given values and whose search columns (by default all texts) hold the search text, in any
    case. Empty values, and columns that the list doesn't have, don't filter."""
    q = queue_defaults(actions)
    for c, v in equal.items():
        if v not in (None, "") and c in q.columns:
            q = q.where(F.col(c).cast("string") == str(v))
    if search and search.strip():
        cols = [c for c, t in q.dtypes if t == "string" and (search_columns is None or c in search_columns)]
        q = q.where(F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit(search.strip().lower())))
    return q


def action_projects(actions: DataFrame) -> DataFrame:
    """One row per (road, project_key): heaviest priority, points, open ones, warnings, statuses, best candidate, and what to do first.

    Optional columns of actions: candidate, match_score, asset_primary. Statuses and candidates are sets of few codes.
    """
    q = queue_defaults(actions)
    have = set(q.columns)
    opt = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    g = q.groupBy("road", "project_key").agg(
        F.max(F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.lower("priority"))).alias("_p"), F.max("priority_score").alias("priority_score"), F.count("*").alias("points"),
        F.count_if(F.lower("state") != "done").alias("open_points"), F.count_if(F.lower("severity") == "warning").alias("warnings"), F.count_if(F.lower("severity") == "attention").alias("attentions"),
        F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"), F.max(F.coalesce(opt("asset_primary", "long"), F.lit(0))).alias("primary"),
        F.array_join(F.array_sort(F.collect_set("status")), ", ").alias("statuses"), F.max_by(opt("candidate", "string"), F.struct(opt("match_score", "int"), opt("candidate", "string"))).alias("candidate"),
    )
    has = lambda s: F.contains(F.col("statuses"), F.lit(s))
    step = (
        F.when(has("MISSING_IN_MAINTENANCE") & F.col("candidate").isNotNull(), "check the candidate name").when(has("MISSING_IN_MAINTENANCE"), "check export selection or create the project")
        .when(has("OBJECT_DIFFERENCE"), "compare the object lists").when(has("OBJECT_ROAD_SUSPICIOUS"), "check the objects' road").when(has("NO_ASSET_OBJECTS"), "check for an orphaned project")
        .when(has("CHAINAGE_SUSPICIOUS"), "correct the chainage").when(F.col("primary") > 0, "check the backbone objects").otherwise("judge by hand")
    )
    labels = F.array(*[F.lit(p) for p in PRIORITIES])
    return g.withColumn("priority", F.when(F.col("_p") > 0, F.element_at(labels, F.greatest(F.col("_p"), F.lit(1)).cast("int"))).otherwise("")).withColumn("next_step", step).drop("_p")


def top_projects(projects: DataFrame, most: int = 10) -> DataFrame:
    """The front sheet: projects of highest score, then most points, then by name."""
    return projects.orderBy(F.desc("priority_score"), F.desc("points"), "project_key").limit(most)


def quality_summary(report: DataFrame) -> DataFrame:
    """One row of counts by severity: issues, blocking, warnings, attentions, ok."""
    s = F.lower(display_text("severity"))
    return report.agg(F.count_if(~s.isin("", "ok")).alias("issues"), F.count_if(s == "blocking").alias("blocking"), F.count_if(s == "warning").alias("warnings"), F.count_if(s == "attention").alias("attentions"), F.count_if(s == "ok").alias("ok"))


def run_verdict(summary: DataFrame) -> DataFrame:
    """summary (blocking, warnings, high, actions, mutations, resolved; counts of a run) + verdict and color."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    ladder = [
        (n("blocking"), "not reliable enough for firm conclusions", "red"), (n("high"), "usable, with points of high priority", "orange"), (n("warnings") | n("actions"), "usable with points of attention", "yellow"),
        (n("mutations"), "usable, check the suggestions", "yellow"), (n("resolved"), "nothing open, check the progress", "green"),
    ]
    pick = lambda i, last: reduce(lambda w, x: w.when(x[0], x[i]), ladder[1:], F.when(ladder[0][0], ladder[0][i])).otherwise(last)
    return summary.withColumn("verdict", pick(1, "usable, nothing urgent found")).withColumn("color", pick(2, "green"))


def control_run(asset: DataFrame, maint: DataFrame, previous: DataFrame | None = None, road: str | None = None) -> dict[str, DataFrame]:
    """The whole control of two exports as tables: quality, differences, compared, candidates, action_list, progress, work_queue
    (with the follow-up of the previous list), suggestions, projects, summary (one row of counts with the verdict).

    Shared parts are stored once. previous: an earlier work queue (project_key, status, state, owner, remark, row_no).
    """
    a, m = stored_sides(asset, maint)
    compared = compare_projects(a, m)
    diffs = materialize(object_differences(a, m), "control-differences")
    candidates = materialize(replacement_candidates(compared, diffs), "control-candidates")
    actions = action_list(compared, candidates)
    if previous is None:
        previous = actions.where("false").select("project_key", "status", *[F.lit("").alias(c) for c in FOLLOW_UP], F.lit(0).alias("row_no"))
    progress = materialize(track_progress(actions, previous), "control-progress")
    queue = materialize(queue_defaults(carry_over(actions.withColumnRenamed("score", "priority_score"), previous)), "control-queue")
    quality = quality_report(asset, maint, road)
    suggestions = mutation_suggestions(compared, diffs, candidates)
    q = quality_summary(quality).select("blocking", "warnings")
    n = queue.agg(F.count("*").alias("actions"), F.count_if(F.col("priority") == "high").alias("high"))
    counts = q.join(F.broadcast(n)).join(F.broadcast(suggestions.agg(F.count("*").alias("mutations")))).join(F.broadcast(progress.agg(F.count_if(F.col("progress") == "resolved").alias("resolved"))))
    return {
        "quality": quality, "differences": diffs, "compared": compared, "candidates": candidates, "action_list": actions, "progress": progress, "work_queue": queue, "suggestions": suggestions,
        "projects": action_projects(queue), "summary": run_verdict(counts),
    }
