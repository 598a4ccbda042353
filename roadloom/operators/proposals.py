"""Project proposals made from technical runs, and what they are compared with. Every key is a track, proposal or project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.names import hm_label, snap_label, tenth_up

_NONE = "array<string>"


def proposal_table(runs: DataFrame, micro_m: float = 25.0, snap_m: float | None = None) -> DataFrame:
    """runs (road, track, run, start_m, end_m, …) + (proposal_id, proposed, length_m, category): the name is made of both
    boundaries rounded up to tenths of a kilometre, those within snap_m of a 100 m post taking that post; category is micro up
    to micro_m, else regular."""
    label = lambda m: hm_label(tenth_up(F.col(m) / 1000)) if snap_m is None else snap_label(F.col(m) / 1000, snap_m)["label"]
    length = F.col("end_m") - F.col("start_m")
    return runs.withColumns({
        "proposal_id": F.concat_ws("-", "road", "track", F.col("run").cast("string")),
        "proposed": F.concat_ws("-", "road", "track", label("start_m"), label("end_m")),
        "length_m": length,
        "category": F.when(length <= micro_m, "micro").otherwise("regular"),
    })


def _verdict(kinds: Column, same: Column, several: str) -> Column:
    return F.when(kinds == 0, "no existing project").when(kinds > 1, several).when(same, "match").otherwise("name differs")


def _status(difference: str = "difference") -> Column:
    d = F.col(difference)
    return F.when(d == "match", "ok").when(d.isin("splits over proposals", "joins projects"), "check").otherwise("attention")


def proposal_verdicts(proposals: DataFrame, assigned: DataFrame, by: list[str]) -> DataFrame:
    """(by .., difference, objects, status), once per proposal (by .., proposed): compare_proposals for proposals that are told apart by
    `by`. assigned: (by .., existing). Proposals and objects are shuffled once, by `by`."""
    own = assigned.select(*by, F.coalesce("existing", F.lit("")).alias("existing")).repartition(*by)
    pairs = own.groupBy(*by, "existing").agg(F.count("*").alias("n"))
    return _per_proposal(proposals.select(*by, "proposed"), pairs, by).withColumn("status", _status())


def _per_proposal(proposals: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    filled = F.when(F.col("existing") != "", 1)
    new = proposals.join(pairs, by, "left").groupBy(*by).agg(
        F.count(filled).alias("k"), F.coalesce(F.bool_or((F.col("existing") != "") & (F.col("existing") == F.col("proposed"))), F.lit(False)).alias("same"), F.coalesce(F.sum("n"), F.lit(0)).alias("objects"))
    return new.select(*by, _verdict(F.col("k"), F.col("same"), "joins projects").alias("difference"), "objects")


def compare_proposals(proposals: DataFrame, assigned: DataFrame) -> DataFrame:
    """(level, name, difference, status, objects), once per existing project and once per proposal.

    assigned: object rows (proposal_id, existing), existing empty or null where an object has no project. Objects are counted
    per (proposal, project) first, so that a large project meets its proposals and not its objects.
    """
    pairs = assigned.groupBy("proposal_id", F.coalesce("existing", F.lit("")).alias("existing")).agg(F.count("*").alias("n"))
    named = pairs.join(proposals.select("proposal_id", "proposed"), "proposal_id")
    old = named.where("existing <> ''").groupBy("existing").agg(F.count("*").alias("k"), F.bool_and(F.col("proposed") == F.col("existing")).alias("same"), F.sum("n").alias("objects"))
    per_old = old.select(F.lit("project").alias("level"), F.col("existing").alias("name"), _verdict(F.col("k"), F.col("same"), "splits over proposals").alias("difference"), "objects")
    new = _per_proposal(proposals.select("proposal_id", "proposed"), pairs, ["proposal_id"])
    per_new = new.select(F.lit("proposal").alias("level"), F.col("proposal_id").alias("name"), "difference", "objects")
    return per_old.unionByName(per_new).withColumn("status", _status())


def cut_reasons(transitions: DataFrame, keys: list[str], kind: str = "track") -> DataFrame:
    """(field, kind, proposals, share_pct): profile fields that cut at the start or end of proposals; share of all proposals."""
    w = W.partitionBy(*keys).orderBy("run")
    here = F.when(F.contains("reason", F.lit("cut: ")), F.col("changed")).otherwise(F.array().cast(_NONE))
    t = transitions.withColumn("_here", here)
    fields = F.array_union("_here", F.coalesce(F.lag("_here").over(w), F.array().cast(_NONE)))
    f = t.withColumn("_f", fields).select(kind, F.explode(F.when(F.size("_f") == 0, F.array(F.lit("none"))).otherwise(F.col("_f"))).alias("field"))
    whole = transitions.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    return f.groupBy("field", kind).agg(F.count("*").alias("proposals")).withColumn("share_pct", F.round(F.col("proposals") * 100 / whole, 1))


def visible_complexes(proposals: DataFrame, short_m: float = 100.0, flags: DataFrame | None = None) -> DataFrame:
    """One row per proposed name (proposals without a name stay alone): extent, parts, a class, and whether it is listed.

    Class, the first that holds: micro (all parts are), duplicate name, micro (a part is), short, outside (a part's category), family
    mismatch, name difference, regular. Micro and short ones aren't listed. flags: (proposal_id, mismatch, differs), as of
    family_mismatches and compare_proposals. complex_no counts within a road by start, end and name.
    """
    name = F.when(F.coalesce(F.trim("proposed"), F.lit("")) != "", F.trim("proposed")).otherwise(F.col("proposal_id"))
    p = proposals.withColumn("complex", name)
    if flags is not None:
        p = p.join(flags.select("proposal_id", "mismatch", "differs"), "proposal_id", "left")
    else:
        p = p.withColumn("mismatch", F.lit(False)).withColumn("differs", F.lit(False))
    some = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    g = p.groupBy("road", "complex").agg(
        F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m"), F.count("*").alias("parts"), F.sum("objects").alias("objects"), F.bool_and(F.col("category") == "micro").alias("_all"), some(F.col("category") == "micro").alias("_some"),
        some(F.col("category") == "outside").alias("_out"), some(F.col("mismatch")).alias("_mismatch"), some(F.col("differs")).alias("_differs"),
    )
    kind = (
        F.when(F.col("_all"), "micro").when(F.col("parts") > 1, "duplicate name").when(F.col("_some"), "micro").when(F.col("end_m") - F.col("start_m") < short_m, "short")
        .when(F.col("_out"), "outside").when(F.col("_mismatch"), "family mismatch").when(F.col("_differs"), "name difference").otherwise("regular")
    )
    w = W.partitionBy("road").orderBy("start_m", "end_m", "complex")
    return g.withColumn("kind", kind).withColumn("listed", ~F.col("kind").isin("micro", "short")).withColumn("complex_no", F.row_number().over(w)).drop("_all", "_some", "_out", "_mismatch", "_differs")


def terminal_attention(proposals: DataFrame, attention: str, end_km: str = "end_km", road: str = "road") -> DataFrame:
    """proposals + terminal (boolean): the end lies at the last name of its road, and the column `attention` holds for it.
    Roads with fewer than two known ends have none. The road's end is an aggregate that is joined back, not a window."""
    last = proposals.groupBy(road).agg(F.max(end_km).alias("_last"), F.count(end_km).alias("_n"))
    j = proposals.join(last, road, "left")
    at_end = (F.col("_n") >= 2) & (F.col(end_km) >= F.col("_last") - 0.0001) & F.col(attention)
    return j.withColumn("terminal", F.coalesce(at_end, F.lit(False))).drop("_last", "_n")


def family_mismatches(proposals: DataFrame, assigned: DataFrame, accepted: DataFrame) -> DataFrame:
    """(proposal_id, subtheme, objects): objects whose subtheme isn't accepted by the track of their proposal.
    accepted: (track, subtheme); tracks without a row in it accept everything."""
    known = accepted.select("track").distinct()
    o = assigned.groupBy("proposal_id", "subtheme").agg(F.count("*").alias("objects")).join(proposals.select("proposal_id", "track"), "proposal_id")
    return o.join(known, "track", "left_semi").join(accepted, ["track", "subtheme"], "left_anti").select("proposal_id", "subtheme", "objects")


def coverage(objects: DataFrame, keys: list[str], merged: DataFrame) -> DataFrame:
    """keys + (objects, covered_m, span_m, pct): length that the merged intervals (keys, start, end) cover of the whole span."""
    n = objects.groupBy(*keys).agg(F.count("*").alias("objects"))
    c = merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered_m"), (F.max("end") - F.min("start")).alias("span_m"))
    return n.join(c, keys, "left").withColumn("pct", F.when(F.col("span_m") > 0, F.round(F.col("covered_m") * 100 / F.col("span_m"), 1)))
