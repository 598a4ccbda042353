"""Scans along an order without one task a key: rows are dealt by ranges of (keys, order) into blocks, folded in their block, and what a block
leaves behind is carried across the blocks of its key, one row a block."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roadloom.functions.shared import materialize

BLOCK = "_block"
ARROW = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}


def straight(dx: Column, dy: Column) -> Column:
    """Length of a step, by operations that every engine rounds alike."""
    return F.sqrt(dx * dx + dy * dy)


def nanometres(length: str | Column) -> Column:
    """A length in whole nanometres: their sum is the same in whatever order they are added, up to 9 million km."""
    return F.round((F.col(length) if isinstance(length, str) else length) * 1e9).cast("bigint")


def metres(nano: Column) -> Column:
    return nano.cast("double") / 1e9


def in_blocks(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "blocks") -> DataFrame:
    """df, stored, with _block: ranges of (keys, order), so that every task holds about as many rows, whatever the keys. Blocks of a
    key follow each other in its order; rows that are equal in keys and order are in one block."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = df.drop(BLOCK).repartitionByRange(n, *keys, *cols)
    return materialize(dealt.withColumn(BLOCK, F.spark_partition_id()), name)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"_k_{k}"])
    return cond


def _carry(blocked: DataFrame, keys: list[str], aggs: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """blocked + carry: aggs make one row a (keys, block); carry are expressions over those rows, in windows of the key's blocks."""
    per = blocked.groupBy(*keys, BLOCK).agg(*[e.alias(c) for c, e in aggs.items()])
    got = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(BLOCK).alias("_k_block"), *[e.alias(c) for c, e in carry.items()])
    return blocked.join(got, _same(blocked, got, keys) & (blocked[BLOCK] == got["_k_block"]), "left").drop("_k_block", *[f"_k_{k}" for k in keys])


def scan(blocked: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, lags: dict[str, Column] | None = None) -> DataFrame:
    """blocked + new columns along the order of each key: sums up to and with the row, maxes of all rows before it, lags of the row before it.

    blocked comes from in_blocks with the same keys and order; ties in the order are taken as they come, so let it end in an id.
    """
    sums, maxes, lags = sums or {}, maxes or {}, lags or {}
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)])
    w = W.partitionBy(*keys, BLOCK).orderBy(*cols)
    aggs = {f"_s_{c}": F.sum(e) for c, e in sums.items()} | {f"_x_{c}": F.max(e) for c, e in maxes.items()}
    if lags:
        aggs["_l"] = F.max_by(F.struct(*[e.alias(c) for c, e in lags.items()]), key)
    over = W.partitionBy(*keys).orderBy(BLOCK)
    before = over.rowsBetween(W.unboundedPreceding, -1)
    carry = {f"_s_{c}": F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)) for c in sums} | {f"_x_{c}": F.max(f"_x_{c}").over(before) for c in maxes}
    if lags:
        carry["_l"] = F.lag("_l").over(over)
    d = _carry(blocked, keys, aggs, carry)
    new = {c: F.sum(e).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col(f"_s_{c}") for c, e in sums.items()}
    new |= {c: F.greatest(F.max(e).over(w.rowsBetween(W.unboundedPreceding, -1)), F.col(f"_x_{c}")) for c, e in maxes.items()}
    first = F.row_number().over(w) == 1
    new |= {c: F.when(first, F.col("_l")[c]).otherwise(F.lag(e).over(w)) for c, e in lags.items()}
    return d.withColumns(new).drop(*carry)


def deal(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "blocks", hot_share: float = 0.05) -> tuple[DataFrame, bool]:
    """(df, False) where no key holds more than hot_share of the rows, so that windows by key are even enough; else (in_blocks(..), True).
    The choice changes no result; it costs a count by key."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if not n["all"] or n["most"] <= hot_share * n["all"]:
        return df, False
    return in_blocks(df, keys, order, name), True


def along(df: DataFrame, hot: bool, keys: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, lags: dict[str, Column] | None = None) -> DataFrame:
    """As scan, over what deal gave: by blocks, the result stored, or by plain windows."""
    if hot:
        return materialize(scan(df, keys, order, sums, maxes, lags), "scanned")
    w = W.partitionBy(*keys).orderBy(*order)
    new = {c: F.sum(e).over(w.rowsBetween(W.unboundedPreceding, 0)) for c, e in (sums or {}).items()}
    new |= {c: F.max(e).over(w.rowsBetween(W.unboundedPreceding, -1)) for c, e in (maxes or {}).items()}
    return df.withColumns(new | {c: F.lag(e).over(w) for c, e in (lags or {}).items()})


def fold_rows(df: DataFrame, keys: list[str], order: list[str], values: list[str], start: tuple, step: Callable, name: str, kind: str) -> DataFrame:
    """df + name: state, value = step(state, *values) row by row along the order of each key, from the state `start`; for folds that no
    window expresses. A task holds one batch of rows and one state, however many rows a key has; null numbers come as None."""
    number = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys])
    d = df.drop(name).withColumn("_key", number).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = StructType([*[f for f in d.schema.fields if f.name != "_key"], *StructType.fromDDL(f"{name} {kind}").fields])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, start
        for b in batches:
            out = []
            for key, *row in zip(*[b.column(c).to_pylist() for c in ("_key", *values)]):
                if key != at:
                    at, state = key, start
                state, value = step(state, *row)
                out.append(value)
            kept = [c for c in b.schema.names if c != "_key"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out, ARROW[kind])], names=[*kept, name])

    return d.mapInArrow(fold, schema)


def thin_points(points: DataFrame, keys: list[str], order: list[str], near_m: float = 0.01) -> DataFrame:
    """points (keys .., order .., x, y) without those within near_m of the last one kept, along the order of each key.

    A step beyond twice near_m keeps its point whatever happened before, for the last one kept is at most near_m from the
    point before; so points fall into stretches. Only stretches of several points are folded.
    """
    columns = points.columns
    d, hot = deal(points, keys, order, "thin-blocks")
    d = along(d, hot, keys, order, lags={"_lx": F.col("x"), "_ly": F.col("y")})
    step = F.hypot(F.col("x") - F.col("_lx"), F.col("y") - F.col("_ly"))
    d = along(d.withColumn("_cut", F.coalesce(step > 2 * near_m, F.lit(True)).cast("long")), hot, keys, order, sums={"_stretch": F.col("_cut")})
    s = materialize(d.select(*columns, "_stretch"), "thin-stretches")
    sizes = s.groupBy(*keys, "_stretch").agg(F.count("*").alias("_n")).where("_n > 1")
    many = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_stretch").alias("_k_stretch"))
    same = _same(s, many, keys) & (s["_stretch"] == many["_k_stretch"])
    alone, chains = s.join(many, same, "left_anti").select(*columns), s.join(many, same, "left_semi")

    def keep(last, x, y):
        near = last is not None and math.hypot(x - last[0], y - last[1]) <= near_m
        return (last, False) if near else ((x, y), True)

    kept = fold_rows(chains, [*keys, "_stretch"], order, ["x", "y"], None, keep, "_kept", "boolean").where("_kept")
    return alone.unionByName(kept.select(*columns))


def route_along(points: DataFrame, keys: list[str], order: list[str], route: str = "route_m", number: str | None = None) -> DataFrame:
    """points + route, the distance along the points of a key from its first one, summed in whole nanometres, and number, their place
    from 1."""
    d, hot = deal(points, keys, order, "route-blocks")
    d = along(d, hot, keys, order, lags={"_lx": F.col("x"), "_ly": F.col("y")})
    d = d.withColumn("_step", F.coalesce(nanometres(straight(F.col("x") - F.col("_lx"), F.col("y") - F.col("_ly"))), F.lit(0))).drop("_lx", "_ly")
    d = along(d, hot, keys, order, sums={route: F.col("_step")} | ({number: F.lit(1)} if number else {})).drop("_step", BLOCK)
    return d.withColumn(route, metres(F.col(route)))
