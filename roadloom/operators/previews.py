"""Short texts about a group's values: the first that were seen, the most common, counts; all mergeable, with no list of a group's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.text import display_text, normal_text


def _cells(df: DataFrame, keys: list[str], columns: list[str], position: str, clean) -> DataFrame:
    """(keys, _c, _v, _n, _at): each distinct non-empty value of each column, how often it is there and its least position."""
    long = df.select(*keys, F.col(position).alias("_at"), F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), clean(c).alias("_v")) for c in columns])).alias("x")).select(*keys, "_at", "x.*")
    return long.where("_v <> ''").groupBy(*keys, "_c", "_v").agg(F.count("*").alias("_n"), F.min("_at").alias("_at"))


def first_seen(df: DataFrame, keys: list[str], columns: dict[str, int], position: str, salts: int = 16) -> DataFrame:
    """keys + one text per column: its distinct values in order of first sight, as many as columns says, then (+rest); '' where a key has none.

    position orders the rows (such as a struct of file and line). Values are counted down to one row each before they meet, and
    ranked in salts of a key first, so a key with many values spreads; only the first few of each salt go on. Equal first
    positions are in order of the values. Keys whose values are all empty are there too.
    """
    cells = _cells(df, keys, list(columns), position, display_text)
    most = F.create_map(*[x for c, n in columns.items() for x in (F.lit(c), F.lit(n))])[F.col("_c")]
    group = [*keys, "_c"]
    salted = cells.withColumn("_s", F.pmod(F.xxhash64("_v"), F.lit(salts)))
    few = salted.withColumn("_k", F.row_number().over(W.partitionBy(*group, "_s").orderBy("_at", "_v"))).where(F.col("_k") <= max(columns.values()))
    few = few.withColumn("_k", F.row_number().over(W.partitionBy(*group).orderBy("_at", "_v"))).where(F.col("_k") <= most)
    head = few.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_h"))
    size = cells.groupBy(*group).agg(F.count("*").alias("_all"))
    j = head.alias("h").join(size.alias("s"), [F.col(f"h.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]).select(*[F.col(f"h.{c}").alias(c) for c in group], "_h", "_all")
    rest = F.col("_all") - F.size("_h")
    said = F.concat(F.array_join(F.transform("_h", lambda x: x["_v"]), ", "), F.when(rest > 0, F.concat(F.lit(" (+"), rest.cast("string"), F.lit(")"))).otherwise(""))
    wide = j.withColumn("_t", said).groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == c, F.col("_t"))).alias(c) for c in columns])
    every = df.select(*keys).distinct()
    w = wide.alias("w")
    return every.alias("e").join(w, [F.col(f"e.{c}").eqNullSafe(F.col(f"w.{c}")) for c in keys], "left").select(*[F.col(f"e.{c}").alias(c) for c in keys], *[F.coalesce(F.col(f"w.{c}"), F.lit("")).alias(c) for c in columns])


def most_common_first(df: DataFrame, keys: list[str], columns: list[str], position: str) -> DataFrame:
    """keys + columns: the most frequent non-empty value of each; of equally frequent ones that seen first. Null where a key has none."""
    best = F.min_by("_v", F.struct(-F.col("_n"), F.col("_at"), F.col("_v")))
    top = _cells(df, keys, columns, position, display_text).groupBy(*keys, "_c").agg(best.alias("_v"))
    return top.groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == c, F.col("_v"))).alias(c) for c in columns])


def counts_text(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys + column: its values in small letters with their counts, `a (3), b`, the most frequent first, then by name."""
    n = df.select(*keys, normal_text(column).alias("_v")).where("_v <> ''").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    one = F.when(F.col("_n") > 1, F.concat("_v", F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(F.col("_v"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"), one.alias("t"))))
    return n.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ", ").alias(column))


def cycle_path_text(subtheme: Column, paths: Column, attached: Column, unsure: Column) -> Column:
    """What a group of a dominant subtheme has to do with cycle paths: its own, attached ones, or none."""
    return (
        F.when((subtheme == "fietspad") & unsure, "cycle path of its own: role unsure, check").when(subtheme == "fietspad", "parallel cycle path, a project of its own")
        .when(attached > 0, F.concat(attached.cast("string"), F.lit(" cycle paths attached"))).when(paths > 0, F.concat(paths.cast("string"), F.lit(" cycle paths within the group"))).otherwise("no cycle paths")
    )


def asset_previews(asset: DataFrame, position: str, names: int = 6, objects: int = 8) -> DataFrame:
    """(project_key, subthemes, roads, variants, object_nos, bad_objects): what an asset project's rows say, by first sight: up to `names` of
    its subthemes, roads, ways to write it and objects with unreadable chainages, and `objects` of its objects. asset: rows
    with project_key, project, subtheme, road, object_no, km (null if unreadable)."""
    a = asset.where("project_key <> ''").select("project_key", position, F.col("subtheme").alias("subthemes"), F.col("road").alias("roads"), F.col("project").alias("variants"), F.col("object_no").alias("object_nos"), F.when(F.col("km").isNull(), F.col("object_no")).alias("bad_objects"))
    return first_seen(a, ["project_key"], {"subthemes": names, "roads": names, "variants": names, "object_nos": objects, "bad_objects": names}, position)


def maintenance_previews(maint: DataFrame, position: str, names: int = 6, objects: int = 8) -> DataFrame:
    """(project_key, variants, measures, object_nos) of a maintenance export's projects, as asset_previews."""
    m = maint.where("project_key <> ''").select("project_key", position, F.col("project").alias("variants"), F.col("measure").alias("measures"), F.col("object_no").alias("object_nos"))
    return first_seen(m, ["project_key"], {"variants": names, "measures": names, "object_nos": objects}, position)
