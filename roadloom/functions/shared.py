"""Session helpers that every subpackage uses: shared scratch tables and session set-up."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Scratch tables take disk that the job needs for its shuffles.
SCRATCH_COMPRESSION = "zstd"


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder of this session if
    driver and executors are one process (tests), else a folder in the warehouse, which a cluster shares too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_roadloom_scratch", None)
    if not base:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        base = "file://" + tempfile.mkdtemp(prefix="spark-") if alone else _warehouse(spark) + f"/_scratch-{uuid.uuid4().hex}"
        spark._roadloom_scratch = base
    return base.rstrip("/")


def _warehouse(spark: SparkSession) -> str:
    """The warehouse's folder; an error where it is a path of each machine's own."""
    path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if path.startswith(("file:", "/")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is a local path")
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/roadloom-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back. See clear_scratch."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path, compression=SCRATCH_COMPRESSION)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables, as materialize gave them, that nothing reads any more: what was made of them is stored."""
    for df in tables:
        written = _written.get(df.sparkSession.sparkContext.applicationId, [])
        if df._scratch in written:
            written.remove(df._scratch)
            drop_scratch(df.sparkSession, df._scratch)


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are stored inside this block are deleted at its end. What leaves the block must be stored after it, or not read them."""
    written = _written.setdefault(spark.sparkContext.applicationId, [])
    before = set(written)
    try:
        yield
    finally:
        for path in [p for p in written if p not in before and p not in _kept]:
            drop_scratch(spark, path)
            written.remove(path)


def keep_scratch(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """As materialize, for what is to outlive a passing_scratch block around it."""
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=SCRATCH_COMPRESSION)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    _kept.add(path)
    return spark.read.schema(df.schema).parquet(path)


#: Scratch tables by application.
_written: dict[str, list[str]] = {}
_kept: set[str] = set()


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that this application has stored, and say how many. Call it when results have been written:
    DataFrames that still read such a table, results of operators among them, can't be used any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        drop_scratch(spark, path)
    return len(paths)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one scratch table that no live DataFrame reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
