"""Reconciliation of an asset table and a maintenance export: projects, objects, and what differs.

Asset rows: object_no, road, project, subtheme, chainage_text. Maintenance rows: object_no, project, measure, amount, price.
All roads at once; every grouping is by project key, so nothing larger than a project meets in a group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from roadloom.functions.names import name_parts, type_family
from roadloom.functions.shared import materialize
from roadloom.functions.text import chainage_km, clean_text, display_text, normal_text, object_key, positive_number, project_key, road_in


@dataclass(frozen=True)
class Rules:
    """Fixed values of the domain: subthemes that form the backbone, and those that need no project."""

    backbone: tuple[str, ...] = ("rijstrook", "parallelweg", "landbouwpad", "busbaan", "fietspad")
    exempt: tuple[str, ...] = ("carpoolplaats", "fietsstalling", "parkeerplaats", "perron", "picknickplaats", "rotonderand", "wegas koppeling dielplak", "opstelplaats", "verkeerseiland of middengeleider", "verharding derden")
    markers: tuple[str, ...] = ("oorspronkelijke bgt-data", "oorspronkelijke bgt data", "oorspronkelijke bgt")


RULES = Rules()


def is_exempt(df: DataFrame, rules: Rules = RULES, skip: tuple[str, ...] = ("project",)):
    """Subtheme on the exempt list, or a marker text in any column but the skipped ones."""
    cols = [F.col(c) for c, t in df.dtypes if t == "string" and c not in skip]
    whole = F.lower(F.concat_ws("\u0001", *cols))
    return reduce(lambda x, m: x | F.contains(whole, F.lit(m)), rules.markers, normal_text("subtheme").isin(list(rules.exempt)))


def keyed_assets(asset: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The columns of asset rows that reconciliation needs, read and cleaned once: project_key, object_no, object_key, km,
    chainage, primary, exempt. A table that has been keyed stays as it is."""
    if {"project_key", "object_key", "km"} <= set(asset.columns):
        return asset
    return asset.select(
        project_key("project").alias("project_key"), "object_no", object_key("object_no").alias("object_key"), chainage_km("chainage_text").alias("km"), display_text("chainage_text").alias("chainage"),
        normal_text("subtheme").isin(list(rules.backbone)).alias("primary"), is_exempt(asset, rules).alias("exempt"),
    )


def keyed_maintenance(maint: DataFrame) -> DataFrame:
    """As keyed_assets, of a maintenance export: project_key, object_no, object_key, measure, amount, price."""
    if {"project_key", "object_key", "measure"} <= set(maint.columns):
        return maint
    num = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0)).alias(c)
    return maint.select(project_key("project").alias("project_key"), clean_text("object_no").alias("object_no"), object_key("object_no").alias("object_key"), clean_text("measure").alias("measure"), num("amount"), num("price"))


def stored_sides(asset: DataFrame, maint: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables keyed and stored, for several operators: the wide exports are read once. A table that has been keyed stays as it is."""
    a, m = keyed_assets(asset), keyed_maintenance(maint)
    return a if a is asset else materialize(a, "keyed-assets"), m if m is maint else materialize(m, "keyed-maintenance")


def asset_projects(asset: DataFrame, rules: Rules = RULES) -> DataFrame:
    """One row per project key: counts of rows, objects, backbone, other and exempt objects, chainage range, unreadable chainages."""
    return keyed_assets(asset, rules).where("project_key <> ''").groupBy("project_key").agg(
        F.count("*").alias("asset_rows"), F.count_distinct("object_no").alias("asset_objects"), F.count_if("primary").alias("asset_primary"), F.count_if(~F.col("primary")).alias("asset_secondary"),
        F.count_if("exempt").alias("asset_exempt"), F.count_if(F.col("km").isNull()).alias("bad_chainages"), F.min("km").alias("hm_min"), F.max("km").alias("hm_max"),
    )


def maintenance_projects(maint: DataFrame) -> DataFrame:
    """One row per project key: lines, objects, measures, amount and price (decimal comma or point)."""
    return keyed_maintenance(maint).where("project_key <> ''").groupBy("project_key").agg(
        F.count("*").alias("maint_rows"), F.count_distinct("object_no").alias("maint_objects"), F.count_distinct("measure").alias("measures"), F.sum("amount").alias("amount"), F.sum("price").alias("price"),
    )


def _both_sides(a: DataFrame, m: DataFrame) -> DataFrame:
    """(project_key, object_key, in_asset, in_maint): every object of a project once, in one shuffle of both tables."""
    one = lambda df, x, y: df.where("project_key <> '' and object_key <> ''").select("project_key", "object_key", F.lit(x).alias("in_asset"), F.lit(y).alias("in_maint"))
    return one(a, True, False).union(one(m, False, True)).groupBy("project_key", "object_key").agg(F.max("in_asset").alias("in_asset"), F.max("in_maint").alias("in_maint"))


def _side_kinds() -> dict[str, Column]:
    """Conditions on a row of _both_sides, by kind of difference."""
    want, have = road_in("project_key"), road_in("object_key")
    return {
        "only_in_asset": ~F.col("in_maint"), "only_in_maintenance": ~F.col("in_asset"),
        "suspicious_road": F.col("in_maint") & (want != have) & (want != "") & (have != ""),
    }


BAD_CHAINAGE = "project_key <> '' and km is null"


def object_differences(asset: DataFrame, maint: DataFrame) -> DataFrame:
    """(project_key, object_key, difference, chainage): objects on one side only, objects of another road, bad chainages."""
    a, m = stored_sides(asset, maint)
    kinds = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in _side_kinds().items()]), lambda x: x.isNotNull())
    sides = _both_sides(a, m).select("project_key", "object_key", F.explode(kinds).alias("difference"), F.lit("").alias("chainage"))
    bad = a.where(BAD_CHAINAGE).select("project_key", "object_key", F.lit("invalid_chainage").alias("difference"), "chainage")
    return sides.unionByName(bad)


def difference_counts(diffs: DataFrame) -> DataFrame:
    """Differences per project, one column per kind."""
    kinds = ["only_in_asset", "only_in_maintenance", "suspicious_road", "invalid_chainage"]
    return diffs.groupBy("project_key").agg(*[F.count_if(F.col("difference") == k).alias(k) for k in kinds])


def _project_sums(a: DataFrame, m: DataFrame) -> DataFrame:
    """One row per project of keyed assets and maintenance rows: the columns of asset_projects and maintenance_projects but measures (null
    where a side has no rows), and the counts of _side_kinds. Rows of both sides are summed up per object once, in one shuffle; what
    follows reads those sums."""
    flag = lambda c: c.cast("long")
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    one = a.where("project_key <> ''").select("project_key", "object_key", "object_no", F.lit(1).cast("long").alias("a"), zero.alias("m"), flag(F.col("primary")).alias("p"), flag(F.col("exempt")).alias("x"), flag(F.col("km").isNull()).alias("bad"), F.col("km").alias("lo"), F.col("km").alias("hi"), none.alias("amount"), none.alias("price"))
    two = m.where("project_key <> ''").select("project_key", "object_key", "object_no", zero.alias("a"), F.lit(1).cast("long").alias("m"), zero.alias("p"), zero.alias("x"), zero.alias("bad"), none.alias("lo"), none.alias("hi"), "amount", "price")
    sums = [F.sum(c).alias(c) for c in ("a", "m", "p", "x", "bad")] + [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("amount").alias("amount"), F.sum("price").alias("price")]
    numbers = one.union(two).groupBy("project_key", "object_key", "object_no").agg(*sums)
    named = lambda c: flag((F.col(c) > 0) & F.col("object_no").isNotNull())
    objects = numbers.withColumns({"an": named("a"), "mn": named("m")}).groupBy("project_key", "object_key").agg(*sums, F.sum("an").alias("an"), F.sum("mn").alias("mn"))
    sided = objects.withColumns({"in_asset": F.col("a") > 0, "in_maint": F.col("m") > 0})
    kinds = [F.count_if((F.col("object_key") != "") & c).alias(kind) for kind, c in _side_kinds().items()]
    p = sided.groupBy("project_key").agg(*sums, F.sum("an").alias("an"), F.sum("mn").alias("mn"), *kinds)
    here = lambda side, c: F.when(F.col(side) > 0, c)
    return p.select(
        "project_key", here("a", F.col("a")).alias("asset_rows"), here("a", F.col("an")).alias("asset_objects"), here("a", F.col("p")).alias("asset_primary"), here("a", F.col("a") - F.col("p")).alias("asset_secondary"), here("a", F.col("x")).alias("asset_exempt"),
        here("a", F.col("bad")).alias("bad_chainages"), F.col("lo").alias("hm_min"), F.col("hi").alias("hm_max"), here("m", F.col("m")).alias("maint_rows"), here("m", F.col("mn")).alias("maint_objects"), "amount", "price", *_side_kinds(),
    )


def compare_projects(asset: DataFrame, maint: DataFrame) -> DataFrame:
    """Full reconciliation: every project of either side with its status ladder and difference counts.

    The counts are those of difference_counts, taken from one row per object and from the projects' bad chainages.
    """
    k, n = keyed_assets(asset), keyed_maintenance(maint)
    if n is not maint:
        n = materialize(n, "keyed-maintenance")  # both reads of it would clean the texts
    measures = n.where("project_key <> '' and measure is not null").select("project_key", "measure").distinct().groupBy("project_key").agg(F.count("*").alias("measures"))
    j = _project_sums(k, n).join(measures, "project_key", "left").withColumn("invalid_chainage", F.col("bad_chainages"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("only_in_asset", "only_in_maintenance", "suspicious_road", "invalid_chainage")}
    both = F.col("asset_rows").isNotNull() & F.col("maint_rows").isNotNull()
    j = j.withColumns(zero | {"measures": F.when(F.col("maint_rows").isNotNull(), F.coalesce("measures", F.lit(0)))})
    status = (
        F.when(both & (F.col("suspicious_road") > 0), "OBJECT_ROAD_SUSPICIOUS").when(both & (F.col("only_in_asset") + F.col("only_in_maintenance") > 0), "OBJECT_DIFFERENCE")
        .when(both & (F.col("invalid_chainage") > 0), "CHAINAGE_SUSPICIOUS").when(both, "OK_COMPLETE").when(F.col("maint_rows").isNull(), "MISSING_IN_MAINTENANCE").otherwise("NO_ASSET_OBJECTS")
    )
    severity = F.when(status == "OK_COMPLETE", "ok").when(status == "CHAINAGE_SUSPICIOUS", "attention").otherwise("warning")
    # Stored: a row per project, which every list after it reads.
    return materialize(j.withColumn("status", status).withColumn("severity", severity).withColumn("road", road_in("project_key")), "compared")


def moved_objects(diffs: DataFrame) -> DataFrame:
    """(missing, candidate, objects): objects that left one project of the asset side and stand in another of the maintenance side."""
    a = diffs.where("difference = 'only_in_asset'").select(F.col("project_key").alias("missing"), "object_key")
    m = diffs.where("difference = 'only_in_maintenance'").select(F.col("project_key").alias("candidate"), "object_key")
    return a.join(m, "object_key").where("missing <> candidate").groupBy("missing", "candidate").agg(F.count("*").alias("objects"))


@F.pandas_udf(IntegerType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """8 for names with a sequence matcher ratio from 0.92, 4 from 0.85, else 0. Called on pairs that survived the road join."""
    from difflib import SequenceMatcher

    def bonus(x, y):
        if not x or not y or 2 * min(len(x), len(y)) < 0.85 * (len(x) + len(y)):
            return 0
        r = SequenceMatcher(None, x, y).ratio()
        return 8 if r >= 0.92 else 4 if r >= 0.85 else 0

    return pd.Series([bonus(x, y) for x, y in zip(a, b)], dtype="int32")


def _names_alike(gone: DataFrame, have: DataFrame, ratio: float) -> DataFrame:
    """Pairs of one road and category whose names may reach that sequence matcher ratio: it leaves a share of 1 - ratio of both names'
    characters unmatched at most, so no more edits than those part them."""
    edits = f"levenshtein(missing, candidate, cast(floor({1 - ratio:.2f}D * (length(missing) + length(candidate)) + 1e-9) as int)) >= 0"
    return gone.where("c1 <> ''").join(have.withColumn("c1", F.col("c2")), ["road", "c1"]).where(edits)


def replacement_candidates(compared: DataFrame, diffs: DataFrame, least: int = 65, most: int = 3, bucket: float = 1.0, near_km: float = 1.0) -> DataFrame:
    """(missing, candidate, score, place, objects, evidence): up to `most` maintenance projects of the same road that may stand for a
    project missing in maintenance.

    Score: road 35; same category 25, same family 15; ranges that overlap or a point inside the other 30, a gap up to 0.2 km 18, up
    to near_km 8, by the better of the name's range and that of the objects' chainages; moved objects 45 and 5 more for each beyond
    the first up to 60; a similar name 4 or 8. Of equal scores more objects win, then more overlap, the smaller gap and the
    larger name. A project of another family counts only with moved objects.

    Pairs come from three joins by equality: moved objects of one road, stretches of road that both touch, and names of one road and
    category that are all but equal, at any distance. Nothing else can reach 64.
    """
    if least < 64:
        raise ValueError("pairs that score below 64 are not all looked at")
    p = name_parts("project_key")
    base = compared.select("project_key", "status", p["road"].alias("road"), p["category"].alias("category"), p["hm_start"].alias("s"), p["hm_end"].alias("e"), *[F.col(c) if c in compared.columns else F.lit(None).cast("double").alias(c) for c in ("hm_min", "hm_max")]).where("road <> ''")
    # Stored, as both kinds of pairs need it: a row per project.
    base = materialize(base.withColumn("f", type_family("category")["family"]), "replacement-projects")
    both = F.array(F.struct(F.col("s"), F.col("e")), F.struct(F.col("hm_min").alias("s"), F.col("hm_max").alias("e")))
    gone = base.where("status = 'MISSING_IN_MAINTENANCE'").select(
        F.col("project_key").alias("missing"), "road", F.col("category").alias("c1"), F.col("f").alias("f1"), F.array_distinct(F.filter(both, lambda x: x["s"].isNotNull() & x["e"].isNotNull())).alias("rs"))
    have = base.where("status <> 'MISSING_IN_MAINTENANCE'").select(F.col("project_key").alias("candidate"), "road", F.col("category").alias("c2"), F.col("f").alias("f2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    moved = moved_objects(diffs).join(gone, "missing").join(have, ["candidate", "road"])
    # Ranges enter every bucket that they touch when widened by half the distance that still counts, so no road is a join key.
    half = max(near_km, 0.2) / 2 + 0.01
    cells = lambda s, e: F.sequence(F.floor((F.least(s, e) - half) / bucket), F.floor((F.greatest(s, e) + half) / bucket))
    g = gone.withColumn("b", F.explode(F.array_distinct(F.flatten(F.transform("rs", lambda x: cells(x["s"], x["e"]))))))
    h = have.where("s2 is not null and e2 is not null").withColumn("b", F.explode(cells(F.col("s2"), F.col("e2"))))
    near = g.join(h, ["road", "b"]).drop("b").where("f1 = f2 or c1 = '' or c2 = ''")
    alike = near.unionByName(_names_alike(gone, have, 0.92 if least > 64 else 0.85)).dropDuplicates(["missing", "candidate"])
    alike = alike.join(moved.select("missing", "candidate"), ["missing", "candidate"], "left_anti").withColumn("objects", F.lit(0).cast("long"))
    pairs = moved.unionByName(alike)

    def judged(x):
        over = F.least(x["e"], F.col("e2")) - F.greatest(x["s"], F.col("s2"))
        inside = (x["s"] == x["e"]) & x["s"].between(F.col("s2"), F.col("e2")) | (F.col("s2") == F.col("e2")) & F.col("s2").between(x["s"], x["e"])
        gap = F.round(F.greatest(-over, F.lit(0.0)), 9)
        score = F.when((over > 0) | inside, 30).when(gap <= 0.2, 18).when(gap <= near_km, 8).otherwise(0)
        return F.when(F.col("s2").isNotNull() & F.col("e2").isNotNull(), F.struct(score.alias("score"), F.greatest(over, F.lit(0.0)).alias("overlap"), (-gap).alias("gap")))

    pairs = pairs.withColumn("_h", F.coalesce(F.array_max(F.transform("rs", judged)), F.struct(F.lit(0).alias("score"), F.lit(0.0).alias("overlap"), F.lit(float("-inf")).alias("gap"))))
    family = F.when((F.col("c1") != "") & (F.col("c1") == F.col("c2")), 25).when((F.col("f1") != "") & (F.col("f1") == F.col("f2")), 15).otherwise(0)
    score = F.lit(35) + family + F.col("_h.score") + F.when(F.col("objects") > 0, F.least(40 + 5 * F.col("objects"), F.lit(60))).otherwise(0) + name_similarity("missing", "candidate")
    scored = pairs.withColumn("score", score.cast("int")).where(F.col("score") >= least)
    top = W.partitionBy("missing").orderBy(F.desc("score"), F.desc("objects"), F.desc("_h.overlap"), F.desc("_h.gap"), F.desc("candidate"))
    evidence = F.when(F.col("objects") > 0, "same objects").when(F.col("_h.score") == 30, "overlapping range").when(F.col("_h.score") == 18, "adjoining range").when(F.col("_h.score") == 8, "range nearby").otherwise("name")
    return scored.withColumn("place", F.row_number().over(top)).where(F.col("place") <= most).select("missing", "candidate", "score", "place", "objects", evidence.alias("evidence"))


#: Points of a status in the priority score.
STATUS_POINTS = {"OBJECT_DIFFERENCE": 20, "OBJECT_ROAD_SUSPICIOUS": 20, "MISSING_IN_MAINTENANCE": 20, "NO_ASSET_OBJECTS": 15, "CHAINAGE_SUSPICIOUS": 10}
#: What a status may mean, and the points of that meaning.
MEANING = {"CHAINAGE_SUSPICIOUS": ("probable error", 15), "OBJECT_DIFFERENCE": ("object link", 10), "OBJECT_ROAD_SUSPICIOUS": ("error or border case", 0), "NO_ASSET_OBJECTS": ("orphaned project or selection", 0)}


def action_list(compared: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Projects that need work: what their status may mean, a priority score (100 at most) and class (high from 85, middle from 55).

    Score: severity 45 or 25, status 10 to 20, backbone objects 20, size of the project or of the difference 5, 12 (from 8)
    or 20 (from 25), meaning up to 15, a replacement candidate 5 or 8 (from 90). candidates: as of replacement_candidates. objects counts
    the objects that differ in the way of the status.
    """
    rows = compared.where("status <> 'OK_COMPLETE'")
    if candidates is None:
        rows = rows.withColumn("candidate", F.lit(None).cast("string")).withColumn("match_score", F.lit(0))
    else:
        best = candidates.where("place = 1").select(F.col("missing").alias("project_key"), "candidate", F.col("score").alias("match_score"))
        rows = rows.join(best, "project_key", "left").withColumn("match_score", F.coalesce("match_score", F.lit(0)))
    pick = lambda d, last: reduce(lambda w, kv: w.when(F.col("status") == kv[0], kv[1]), d.items(), F.when(F.lit(False), last)).otherwise(last)
    old = (F.col("status") == "MISSING_IN_MAINTENANCE") & F.col("candidate").isNotNull()
    meaning = F.when(old, "old name or migration").otherwise(pick({k: v[0] for k, v in MEANING.items()}, "export or name"))
    points = F.when(old, 10).otherwise(pick({k: v[1] for k, v in MEANING.items()}, 0))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    kinds = {"OBJECT_ROAD_SUSPICIOUS": n("suspicious_road"), "OBJECT_DIFFERENCE": n("only_in_asset") + n("only_in_maintenance"), "CHAINAGE_SUSPICIOUS": n("invalid_chainage"), "MISSING_IN_MAINTENANCE": n("only_in_asset"), "NO_ASSET_OBJECTS": n("only_in_maintenance")}
    rows = rows.withColumn("objects", pick(kinds, F.lit(0)))
    size = F.greatest("objects", n("asset_objects"), n("maint_objects"))
    score = (
        F.when(F.col("severity") == "warning", 45).when(F.col("severity") == "attention", 25).otherwise(10) + pick(STATUS_POINTS, 0) + F.when(n("asset_primary") > 0, 20).otherwise(0)
        + F.when(size >= 25, 20).when(size >= 8, 12).when(size >= 1, 5).otherwise(0) + points + F.when(F.col("match_score") >= 90, 8).when(F.col("match_score") >= 65, 5).otherwise(0)
    )
    rows = rows.withColumn("meaning", meaning).withColumn("score", F.least(score, F.lit(100)).cast("int"))
    rows = rows.withColumn("priority", F.when(F.col("score") >= 85, "high").when(F.col("score") >= 55, "middle").otherwise("low"))
    return materialize(rows.select("road", "project_key", "status", "severity", "score", "priority", "objects", "meaning", "candidate", "match_score", n("asset_primary").alias("asset_primary")), "actions")


def carry_over(actions: DataFrame, previous: DataFrame, keys: list[str] = ["project_key", "status"], follow_up: list[str] = ["state", "owner", "remark"], order: str = "row_no") -> DataFrame:
    """Follow-up columns of the previous list: by all keys, else by the first key alone; of several the first in order."""
    def first(ks):
        w = W.partitionBy(*ks).orderBy(order)
        return previous.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*ks, *follow_up)

    strict = first(keys).select(*keys, *[F.col(c).alias(f"{c}_1") for c in follow_up])
    loose = first(keys[:1]).select(keys[0], *[F.col(c).alias(f"{c}_2") for c in follow_up])
    out = actions.join(strict, keys, "left").join(loose, keys[0], "left")
    return out.select(*actions.columns, *[F.coalesce(f"{c}_1", f"{c}_2").alias(c) for c in follow_up])


def track_progress(actions: DataFrame, previous: DataFrame, keys: list[str] = ["project_key", "status"]) -> DataFrame:
    """keys + progress: new, existing, or resolved (only in the previous list)."""
    now, was = actions.select(*keys).distinct().withColumn("_a", F.lit(1)), previous.select(*keys).distinct().withColumn("_b", F.lit(1))
    j = now.join(was, keys, "full_outer")
    return j.select(*keys, F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "resolved").otherwise("existing").alias("progress"))


def merge_edits(actions: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """actions with the edited follow-up fields taken over; edits without a matching row are dropped, nulls don't overwrite."""
    e = edits.select(key, *[F.col(f).alias(f"_e_{f}") for f in fields]).dropDuplicates([key])
    return actions.join(e, key, "left").withColumns({f: F.coalesce(f"_e_{f}", f) for f in fields}).drop(*[f"_e_{f}" for f in fields])


def progress_report(tracked: DataFrame) -> DataFrame:
    """Counts per road and per project in one pass (grouping sets), with a conclusion."""
    t = tracked.withColumn("road", road_in("project_key"))
    r = t.rollup("road", "project_key").agg(F.count_if(F.col("progress") == "new").alias("new"), F.count_if(F.col("progress") == "existing").alias("existing"), F.count_if(F.col("progress") == "resolved").alias("resolved"), F.grouping_id().alias("level"))
    r = r.where("level < 3").withColumn("level", F.when(F.col("level") == 0, "project").otherwise("road"))
    concl = F.when((F.col("new") > 0) & (F.col("resolved") == 0), "worse").when((F.col("new") == 0) & (F.col("resolved") > 0), "better").when((F.col("new") == 0) & (F.col("existing") == 0), "done").otherwise("mixed")
    return r.withColumn("conclusion", concl)


def amounts_from(df: DataFrame, preferred: str, stop: str | None = None, width: int = 4) -> str:
    """Name of the most numeric column from `preferred` up to `stop` (or `width` columns); leftmost on ties."""
    cols = df.columns
    i = cols.index(preferred)
    cand = cols[i : cols.index(stop) if stop in cols else i + width]
    row = df.agg(*[F.count(F.replace(F.col(c).cast("string"), F.lit(","), F.lit(".")).try_cast("double")).alias(c) for c in cand]).first()
    best = max(range(len(cand)), key=lambda k: (row[cand[k]], -k))
    return cand[best] if row[cand[best]] else preferred


def quantities(df: DataFrame, value: str, amount: str) -> DataFrame:
    """Objects and amount per attribute value, over the whole network and per road (grouping sets); '' is unknown."""
    d = df.withColumn("value", display_text(value)).withColumn("_n", positive_number(amount))
    return d.groupingSets([["value", "road"], ["value"]], "value", "road").agg(F.count("*").alias("objects"), F.sum("_n").alias("amount")).withColumn("road", F.coalesce("road", F.lit("*")))


def mutation_suggestions(compared: DataFrame, diffs: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(project_key, object_key, suggestion, proposed): what to check by hand in either export; nothing is written back.

    Projects missing on one side give one row, with the best replacement from candidates (missing, candidate, score) where there
    is one; each object difference of a project whose status isn't complete gives one row. object_key is empty in project rows.
    """
    # Stored, as both halves need it: a row per project.
    open_ = materialize(compared.where("status <> 'OK_COMPLETE'").select("project_key", "status"), "open-projects")
    a = open_.where("status in ('MISSING_IN_MAINTENANCE', 'NO_ASSET_OBJECTS')")
    if candidates is None:
        a = a.withColumn("_best", F.lit(None).cast("string"))
    else:
        top = candidates.groupBy("missing").agg(F.max_by("candidate", F.struct("score", "candidate")).alias("_best"))
        a = a.join(top.withColumnRenamed("missing", "project_key"), "project_key", "left")
    gone = F.col("status") == "MISSING_IN_MAINTENANCE"
    rename = F.when(~gone, "CHECK_PROJECT_WITHOUT_OBJECTS").when(F.col("_best").isNotNull(), "CHECK_PROJECT_NAME").otherwise("CREATE_PROJECT_OR_CHECK_EXPORT")
    a = a.select("project_key", F.lit("").alias("object_key"), rename.alias("suggestion"), F.when(gone, F.coalesce("_best", "project_key")).otherwise("").alias("proposed"))
    kind = F.when(F.col("difference") == "only_in_asset", "CHECK_LINK_IN_MAINTENANCE").when(F.col("difference") == "only_in_maintenance", "CHECK_LINK_IN_ASSET").when(F.col("difference") == "suspicious_road", "CHECK_ROAD").otherwise("CHECK_CHAINAGE")
    c = diffs.join(open_.select("project_key"), "project_key", "left_semi").select("project_key", "object_key", kind.alias("suggestion"), F.lit("").alias("proposed"))
    return a.unionByName(c)


def project_objects(asset: DataFrame, maint: DataFrame, diffs: DataFrame) -> DataFrame:
    """(project_key, object_key, asset_rows, maint_rows, differences): the objects of every project on both sides."""
    one = lambda df, x, y: df.where("project_key <> ''").select("project_key", "object_key", F.lit(x).alias("x"), F.lit(y).alias("y"))
    j = one(keyed_assets(asset), 1, 0).union(one(keyed_maintenance(maint), 0, 1)).groupBy("project_key", "object_key").agg(F.sum("x").alias("asset_rows"), F.sum("y").alias("maint_rows"))
    d = diffs.groupBy("project_key", "object_key").agg(F.array_join(F.array_sort(F.collect_set("difference")), ", ").alias("differences"))
    return j.join(d, ["project_key", "object_key"], "left").select("project_key", "object_key", "asset_rows", "maint_rows", F.coalesce("differences", F.lit("")).alias("differences"))


def control_point_details(asset: DataFrame, maint: DataFrame, diffs: DataFrame) -> DataFrame:
    """The records behind the differences: per (project_key, object_key) of a differing project the object's asset and
    maintenance rows side by side, with its kinds of difference.

    Several rows of one object on both sides are numbered and paired by number, so that rows aren't multiplied.
    """
    def side(df, cols, name):
        w = W.partitionBy("project_key", "object_key")
        d = df.where("project_key <> ''").select("project_key", "object_key", *[F.col(c).alias(f"{name}_{c}") for c in cols])
        return d.withColumn("row_no", F.row_number().over(w.orderBy(*[f"{name}_{c}" for c in cols])))

    # Stored, as both the projects and the objects are taken from it: the differences themselves are computed once.
    kinds = materialize(diffs.groupBy("project_key", "object_key").agg(F.array_join(F.array_sort(F.collect_set("difference")), ", ").alias("differences")), "detail-kinds")
    open_ = kinds.select("project_key").distinct()
    a = side(keyed_assets(asset), ["object_no", "chainage"], "asset").join(open_, "project_key", "left_semi")
    m = side(keyed_maintenance(maint), ["object_no", "measure", "amount", "price"], "maint").join(open_, "project_key", "left_semi")
    return a.join(m, ["project_key", "object_key", "row_no"], "full_outer").join(kinds, ["project_key", "object_key"], "left").withColumn("differences", F.coalesce("differences", F.lit("")))
