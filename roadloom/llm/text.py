"""Column expressions on whole texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of other characters than these.
SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Array of words `[^\\x20\\x09-\\x0D]+`; null text: empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(m)


def read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
