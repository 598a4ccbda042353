"""Data-quality rules on attributes and on neighbours, and a report of issue counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.names import name_parts, name_range
from roadloom.functions.shared import materialize
from roadloom.functions.text import chainage_km, clean_text, display_text, normal_text, project_key, road_in
from roadloom.operators.reconcile import RULES, Rules, is_exempt
from roadloom.sources.files import wkt_parts


def _violations(df: DataFrame, rules: list[tuple[Column, str, str, str, list[str]]]) -> DataFrame:
    """(rule_code, severity, category, object_id, issue_key, missing_cols) for every rule (condition, code, severity, category,
    columns at fault) that a row breaks, in one pass over df."""
    found = F.array(*[
        F.when(cond, F.struct(F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.array(*[F.lit(c) for c in cols]).cast("array<string>").alias("missing_cols")))
        for cond, code, severity, category, cols in rules
    ])
    v = df.select("object_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v"))
    return v.select("v.rule_code", "v.severity", "v.category", "object_id", F.concat_ws(":", "v.rule_code", F.col("object_id").cast("string")).alias("issue_key"), "v.missing_cols")


def attribute_violations(asset: DataFrame, rules: Rules = RULES) -> DataFrame:
    """MISSING_PROJECT, INVALID_CHAINAGE and EXEMPT_HAS_PROJECT per object."""
    a = asset.select("object_id", is_exempt(asset, rules).alias("exempt"), clean_text("project").isNotNull().alias("named"), (clean_text("chainage_text").isNotNull() & chainage_km("chainage_text").isNull()).alias("bad_km"))
    return _violations(a, [
        (~F.col("exempt") & ~F.col("named"), "MISSING_PROJECT", "error", "project missing", ["project"]),
        (F.col("bad_km"), "INVALID_CHAINAGE", "warning", "location data", ["chainage_text"]),
        (F.col("exempt") & F.col("named"), "EXEMPT_HAS_PROJECT", "warning", "project not expected", ["project"]),
    ])


def neighbour_violations(asset: DataFrame, edges: DataFrame, rules: Rules = RULES) -> DataFrame:
    """FLOATING_SECONDARY, ISOLATED_PROJECT and NO_DIRECT_PROJECT_BACKBONE for objects that have neighbours.

    edges: symmetric (src, dst). A neighbour list is only reduced with flags, so a hub needs no collected list.
    """
    a = asset.select("object_id", F.coalesce(clean_text("project"), F.lit("")).alias("p"), normal_text("subtheme").isin(list(rules.backbone)).alias("b"), is_exempt(asset, rules).alias("e"))
    n = a.select(F.col("object_id").alias("dst"), F.col("p").alias("np"), F.col("b").alias("nb"))
    own = edges.select("src", "dst").join(a.withColumnRenamed("object_id", "src"), "src").join(n, "dst")
    same = (F.col("p") != "") & (F.col("p") == F.col("np"))
    f = own.groupBy(F.col("src").alias("object_id"), "p", "b", "e").agg(F.bool_or("nb").alias("near_backbone"), F.bool_or(same).alias("near_project"), F.bool_or(same & F.col("nb")).alias("near_project_backbone"))
    c = F.expr
    return _violations(f, [
        (c("not b and not e and not near_backbone"), "FLOATING_SECONDARY", "warning", "topology", []),
        (c("p <> '' and not e and not near_project"), "ISOLATED_PROJECT", "warning", "project consistency", ["project"]),
        (c("p <> '' and not e and near_project and not b and not near_project_backbone"), "NO_DIRECT_PROJECT_BACKBONE", "info", "project consistency", []),
    ])


def category_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("category").agg(F.count("*").alias("issues"))


def without_ignored(violations: DataFrame, ignored: DataFrame) -> DataFrame:
    return violations.join(ignored.select("issue_key"), "issue_key", "left_anti")


def issue_report(asset: DataFrame, maint: DataFrame) -> DataFrame:
    """(source, issue, n): counts of empty, unreadable, duplicate and ill-named cells of both exports, one pass each."""
    def stack(df: DataFrame, source: str, tests: dict[str, Column]) -> DataFrame:
        one = df.agg(*[F.count_if(v).alias(k) for k, v in tests.items()])
        return one.unpivot([], list(tests), "issue", "n").select(F.lit(source).alias("source"), "issue", "n")

    odd = (project_key("project") != "") & name_range("project").isNull()
    a = stack(asset, "asset", {"EMPTY_PROJECT": clean_text("project").isNull(), "EMPTY_OBJECT": clean_text("object_no").isNull(), "EMPTY_CHAINAGE": clean_text("chainage_text").isNull(), "BAD_CHAINAGE": clean_text("chainage_text").isNotNull() & chainage_km("chainage_text").isNull(), "ODD_PROJECT_NAME": odd})
    m = stack(maint, "maintenance", {"EMPTY_PROJECT": clean_text("project").isNull(), "EMPTY_OBJECT": clean_text("object_no").isNull(), "EMPTY_MEASURE": clean_text("measure").isNull(), "ODD_PROJECT_NAME": odd})
    dup = maint.groupBy(display_text("object_no").alias("o"), project_key("project").alias("p"), display_text("measure").alias("m")).count().where("count > 1")
    d = dup.agg(F.count("*").alias("n")).select(F.lit("maintenance").alias("source"), F.lit("DUPLICATE_LINE").alias("issue"), "n")
    return a.unionByName(m).unionByName(d)


REPORT = "source string, severity string, category string, code string, rows bigint, column string"
#: Columns that an export must have, with the severity of their absence.
REQUIRED = {
    "asset": {"project": "warning", "road": "warning", "subtheme": "attention", "chainage_text": "attention", "object_no": "warning"},
    "maintenance": {"project": "blocking", "object_no": "warning"},
}


def _counted(df: DataFrame, source: str, tests: list[tuple[str, str, str, str, Column]]) -> DataFrame:
    """Report rows of (severity, category, code, column, condition or aggregate) over df, in one pass."""
    row = df.agg(F.count("*").alias("_all"), *[c.alias(code) for _, _, code, _, c in tests])
    out = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(k).alias("category"), F.lit(code).alias("code"), F.col(code).alias("rows"), F.lit(col).alias("column")) for s, k, code, col, _ in tests])
    return row.select(F.explode(out).alias("r")).select(F.lit(source).alias("source"), "r.severity", "r.category", "r.code", "r.rows", "r.column").where("rows > 0")


def _twins(df: DataFrame, keys: list[Column], source: str, code: str, column: str) -> DataFrame:
    """Rows whose keys, all of them filled, stand in several rows."""
    k = [f"k{i}" for i in range(len(keys))]
    d = df.select(*[c.alias(n) for c, n in zip(keys, k)]).where(" and ".join(f"{n} <> ''" for n in k)).groupBy(*k).agg(F.count("*").alias("n")).where("n > 1").agg(F.sum("n").alias("rows")).where("rows > 0")
    return d.select(F.lit(source).alias("source"), F.lit("attention").alias("severity"), F.lit("duplicate objects").alias("category"), F.lit(code).alias("code"), "rows", F.lit(column).alias("column"))


def _odd_names(df: DataFrame, source: str) -> DataFrame:
    """Distinct project names that don't read road, type, begin, end."""
    odd = df.select(project_key("project").alias("p")).where("p <> ''").distinct().where(name_parts("p")["hm_start"].isNull())
    return odd.agg(F.count("*").alias("rows")).where("rows > 0").select(F.lit(source).alias("source"), F.lit("attention").alias("severity"), F.lit("names").alias("category"), F.lit("PROJECT_NAME_ODD").alias("code"), "rows", F.lit("project").alias("column"))


def quality_report(asset: DataFrame, maint: DataFrame, road: str | None = None, wkt: str = "wkt", rules: Rules = RULES) -> DataFrame:
    """(source, severity, category, code, rows, column): what may make a reconciliation of two exports unreliable.

    Columns that an export lacks are reported, and what depends on them is left out; an export without rows is blocking.
    road, if given, is the selection that rows are expected to belong to. Every other count is over all rows. A clean pair of exports gives
    one row of severity ok. Geometry is judged by its text column, if there is one.
    """
    spark = asset.sparkSession
    parts = []

    def fixed(rows):
        return spark.createDataFrame(rows, REPORT)

    def filled(c):
        return F.coalesce(clean_text(c), F.lit(""))

    n = {"asset": asset.agg(F.count("*")).first()[0], "maintenance": maint.agg(F.count("*")).first()[0]}
    for source, df in (("asset", asset), ("maintenance", maint)):
        if not n[source]:
            parts.append(fixed([(source, "blocking", "file", "EXPORT_EMPTY", 0, "")]))
            continue
        lost = [(source, s, "required columns", "COLUMN_MISSING", n[source], c) for c, s in REQUIRED[source].items() if c not in df.columns]
        if lost:
            parts.append(fixed(lost))
    if n["asset"]:
        have, tests = set(asset.columns), []
        count = lambda s, k, code, col, cond: tests.append((s, k, code, col, F.count_if(cond)))
        if "object_no" in have:
            count("warning", "empty cells", "OBJECT_EMPTY", "object_no", filled("object_no") == "")
            parts.append(_twins(asset, [filled("object_no")], "asset", "OBJECT_DUPLICATE", "object_no"))
        if "road" in have:
            count("attention", "empty cells", "ROAD_EMPTY", "road", filled("road") == "")
            if road:
                count("warning", "selection", "ROAD_OUTSIDE_SELECTION", "road", (filled("road") != "") & (F.upper(filled("road")) != road.upper()))
        named = filled("project") != "" if "project" in have else F.lit(False)
        if "project" in have:
            exempt = is_exempt(asset, rules) if "subtheme" in have else F.lit(False)
            count("warning", "project", "PROJECT_EMPTY", "project", ~named & ~exempt)
            count("attention", "project", "EXEMPT_HAS_PROJECT", "project", named & exempt)
            parts.append(_odd_names(asset, "asset"))
            if "road" in have:
                of = road_in(project_key("project"))
                count("warning", "road", "PROJECT_ROAD_MISMATCH", "project, road", (of != "") & (filled("road") != "") & (of != F.upper(filled("road"))))
        if "chainage_text" in have:
            count("attention", "chainage", "CHAINAGE_EMPTY", "chainage_text", named & (filled("chainage_text") == ""))
            count("warning", "chainage", "CHAINAGE_INVALID", "chainage_text", named & (filled("chainage_text") != "") & F.replace(filled("chainage_text"), F.lit(","), F.lit(".")).try_cast("double").isNull())
        if wkt in have:
            count("attention", "geometry", "GEOMETRY_EMPTY", wkt, filled(wkt) == "")
            count("attention", "geometry", "GEOMETRY_INVALID", wkt, (filled(wkt) != "") & wkt_parts(wkt).isNull())
        else:
            parts.append(fixed([("asset", "attention", "geometry", "GEOMETRY_COLUMN_MISSING", n["asset"], wkt)]))
        if tests:
            parts.append(_counted(asset, "asset", tests))
    if n["maintenance"] and "project" in maint.columns:
        m = maint
        if road:
            own = road_in(project_key("project"))
            m = m.where((project_key("project") == "") | own.isin("", road.upper()) | F.contains(project_key("project"), F.lit(road.upper())))
        tests = [("warning", "project", "PROJECT_EMPTY", "project", F.count_if(filled("project") == ""))]
        if "object_no" in m.columns:
            tests.append(("warning", "empty cells", "OBJECT_EMPTY", "object_no", F.count_if(filled("object_no") == "")))
            parts.append(_twins(m, [filled("project"), filled("object_no")], "maintenance", "OBJECT_DUPLICATE", "project, object_no"))
        parts += [_counted(m, "maintenance", tests), _odd_names(m, "maintenance")]
    out = materialize(reduce(lambda a, b: a.unionByName(b), parts), "quality-report")
    return fixed([("both", "ok", "exports", "NOTHING_FOUND", 0, "")]) if out.isEmpty() else out
