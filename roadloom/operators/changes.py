"""Change logs: differences of snapshots, replay, impact, and export of changed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.text import clean_text


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new) of the cells that differ between two snapshots; empty texts equal null."""
    def cells(df, name):
        return df.select(key, *[clean_text(f).alias(f) for f in fields]).unpivot([key], fields, "field", name)

    j = cells(old, "old").join(cells(new, "new"), [key, "field"])
    return j.where(~F.col("old").eqNullSafe(F.col("new")))


def last_values(log: DataFrame, key: str = "object_id") -> DataFrame:
    """(key, field, value): the last value per cell by (ts, seq)."""
    return log.groupBy(key, "field").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


def replay(table: DataFrame, log: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """table with the log's last value per cell written over it; unknown keys and fields are ignored."""
    last = last_values(log, key).groupBy(key).pivot("field", fields).agg(F.first("value"))
    r = last.select(key, *[F.col(f"`{f}`").alias(f"_new_{f}") for f in fields])
    return table.join(r, key, "left").withColumns({f: F.coalesce(F.col(f"_new_{f}").cast(table.schema[f].dataType), F.col(f)) for f in fields}).drop(*[f"_new_{f}" for f in fields])


def export_changed(table: DataFrame, log: DataFrame, key: str, profile: list[str]) -> DataFrame:
    """Rows with a change, in the columns of an import profile."""
    return table.join(log.select(key).distinct(), key, "left_semi").select(key, *[c for c in profile if c in table.columns and c != key])


def export_impact(log: DataFrame, key: str, profile: list[str]) -> DataFrame:
    """One row: changed objects and cells, cells inside the profile, and fields outside it."""
    inside = F.col("field").isin(profile)
    return log.agg(
        F.count_distinct(key).alias("objects"), F.count_distinct(key, "field").alias("cells"), F.count_distinct(F.when(inside, F.struct(key, "field"))).alias("written_cells"), F.count_distinct(F.when(~inside, F.col("field"))).alias("omitted_fields"),
    )


def write_export(df: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    """Semicolon CSV with a header and a byte order mark, one file per partition; names renames columns, such as the source's id.

    The mark is the header's first character; every file has a header, so every file begins with it.
    """
    out = df.withColumnsRenamed(names or {})
    first = out.columns[0]
    out.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path)


def write_results(tables: dict[str, DataFrame], path: str, by: str = "road") -> None:
    """Each table as Parquet under its name, partitioned by road where it has that column."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by in df.columns else w).parquet(f"{path}/{name}")


def append_changes(log: DataFrame, old: DataFrame, new: DataFrame, key: str, fields: list[str], ts, status: str = "changed") -> DataFrame:
    """log plus one row (key, field, old, value, ts, seq, status) per cell in which the two snapshots differ. seq goes on behind the
    log's last one of the cell, so that the last value wins whatever the clock says."""
    c = snapshot_changes(old, new, key, fields)
    last = log.groupBy(key, "field").agg(F.max("seq").alias("_q"))
    rows = c.join(last, [key, "field"], "left").select(key, "field", "old", F.col("new").alias("value"), F.lit(ts).cast("timestamp").alias("ts"), (F.coalesce("_q", F.lit(0)) + 1).cast("long").alias("seq"), F.lit(status).alias("status"))
    return log.unionByName(rows, allowMissingColumns=True)


def profile_gaps(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, field): fields of import profiles (profile, field) that the table doesn't have."""
    have = df.sparkSession.createDataFrame([(c,) for c in df.columns], "field string")
    return profiles.select("profile", "field").distinct().join(F.broadcast(have), "field", "left_anti").select("profile", "field")


def search_objects(df: DataFrame, query: str, columns: list[str], log: DataFrame | None = None, key: str = "object_id", most: int | None = None) -> DataFrame:
    """Rows whose columns, taken together, hold the query in any case; with a log only changed objects; `most` rows by key at most."""
    hit = df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.strip().lower())))
    if log is not None:
        hit = hit.join(log.select(key).distinct(), key, "left_semi")
    return hit if most is None else hit.orderBy(key).limit(most)


def object_cells(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value): objects as field and value rows, empty cells as ''."""
    return df.select(key, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]).unpivot([key], fields, "field", "value")
