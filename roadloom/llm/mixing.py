"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Source shares p become weights proportional to p^t. The exponent t is bisected until the mix meets an entropy target or a
repetition limit; each source then gets a token budget, which its documents fill in passes over hash-permuted blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.functions.shared import materialize
from roadloom.llm.packing import RunEncoder, encode_texts, tokenizer_file
from roadloom.llm.words import bound_batches, lean, text_blocks

#: Rows of the whole table that there is a block for, and blocks at least.
BLOCK_ROWS, LEAST_BLOCKS = 8192, 4096


def _facts(totals: DataFrame, exps: list[float], entropy: bool) -> list[float]:
    """For each exponent, in one job: the mix's entropy over ln(number of sources), or the most passes of any source when
    the least repeated one gets one pass. Only sums leave the executors, however many sources there are."""
    big = totals.agg(F.max("total").alias("m"), F.count("*").alias("n")).first()
    x = F.col("total") / F.lit(big["m"])
    aggs: list[Column] = []
    for i, t in enumerate(exps):
        w = F.pow(x, F.lit(t))
        if entropy:
            aggs += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(w)).alias(f"l{i}")]
        else:
            r = F.pow(x, F.lit(t - 1))
            aggs += [F.max(r).alias(f"z{i}"), F.min(r).alias(f"l{i}")]
    row = totals.agg(*aggs).first()
    if entropy:
        top = math.log(big["n"]) or 1.0
        return [(math.log(row[f"z{i}"]) - row[f"l{i}"] / row[f"z{i}"]) / top for i in range(len(exps))]
    return [row[f"z{i}"] / row[f"l{i}"] for i in range(len(exps))]


def find_exponent(totals: DataFrame, target_entropy: float | None = None, max_passes: float | None = None, ways: int = 8, rounds: int = 6) -> float:
    """The exponent in [0, 1] that meets the target, by repeated sections of the interval (`ways` points a job).

    target_entropy: a fraction of the greatest entropy; the result is the largest exponent (nearest to the natural mix)
    that reaches it. max_passes: the smallest exponent (flattest mix) under which no source is repeated more than that,
    relative to the least repeated one. With both, the larger exponent wins: the repetition limit holds in any case.
    """
    if totals.isEmpty():
        return 1.0

    def section(ok_high: bool, test) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            grid = [lo + (hi - lo) * i / ways for i in range(ways + 1)]
            ok = test(grid)
            if ok_high:  # true from some exponent on
                i = next((i for i, v in enumerate(ok) if v), ways)
                lo, hi = grid[max(0, i - 1)], grid[i]
            else:  # true up to some exponent
                i = next((i for i in range(ways, -1, -1) if ok[i]), 0)
                lo, hi = grid[i], grid[min(ways, i + 1)]
            if lo == hi:
                break
        return hi if ok_high else lo

    exps = []
    if target_entropy is not None:
        exps.append(section(False, lambda g: [v >= target_entropy - 1e-12 for v in _facts(totals, g, True)]))
    if max_passes is not None:
        exps.append(section(True, lambda g: [v <= max_passes * (1 + 1e-9) for v in _facts(totals, g, False)]))
    return max(exps, default=1.0)


def mix_sources(
    docs: DataFrame, source: str = "source", tokens: str = "tokens", key: str = "doc_id", target_entropy: float | None = 0.9, max_passes: float | None = 2.0,
    budget: float | None = None, seed: int = 7, blocks: int | None = None,
) -> DataFrame:
    """One row per exposure of a document: its columns plus pass (from 0), block and mix_position (0 to 1).

    Weights are normalised; the budget (tokens of the whole mix) is by default the least that shows every document once,
    so nothing is lost and the repetition limit bounds the result. A source's budget is filled by whole passes; the last
    one takes blocks in their permuted order, then documents in theirs, while they start inside the budget. Each pass
    permutes blocks and the documents in them anew. Ordering by mix_position gives the mixed stream: every prefix holds
    the sources near their weights. Blocks are hash buckets, 4096 or, beyond that, one for each 8192 rows of the table, so a hot
    source is spread over them all; window state is one block, and one row per block for the blocks' own order. Rows without a key are
    spread by their tokens. Documents without tokens count one token. Null
    sources form a group; repeated rows are documents of their own; an empty table gives an empty result. Columns of docs
    named pass, block or mix_position are replaced. With both targets the repetition limit may leave the entropy short of its target;
    mix_weights tells what is reached.
    """
    docs = docs.drop("pass", "block", "mix_position")
    cols = docs.columns
    blocks = blocks or max(LEAST_BLOCKS, -(-docs.count() // BLOCK_ROWS))
    d = docs.withColumn("_src", F.coalesce(F.col(source).cast("string"), F.lit("\u0000"))).withColumn("_tok", F.greatest(F.coalesce(F.col(tokens), F.lit(1)), F.lit(1)).cast("double"))
    d = d.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), key, F.when(F.col(key).isNull(), F.col("_tok"))), F.lit(blocks)).cast("int"))
    per_block = materialize(d.groupBy("_src", "block").agg(F.sum("_tok").alias("_bt")), "mix-blocks")
    totals = per_block.groupBy("_src").agg(F.sum("_bt").alias("total"))
    t = find_exponent(totals, target_entropy, max_passes)
    z = totals.agg(F.sum(F.pow(F.col("total"), F.lit(t))).alias("z"), F.max(F.pow(F.col("total"), F.lit(1 - t))).alias("least")).first()
    if z["z"] is None:
        return docs.withColumn("pass", F.lit(0)).withColumn("block", F.lit(0)).withColumn("mix_position", F.lit(0.0))
    whole = budget if budget is not None else z["z"] * z["least"]
    share = totals.withColumn("_budget", F.lit(whole / z["z"]) * F.pow(F.col("total"), F.lit(t)))
    # Passes of a source: bounded by the repetition limit, or by the budget that the caller sets.
    passes = share.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_budget") / F.col("total") - 1e-9) - 1, F.lit(0)).cast("int"))))
    # Tokens are whole numbers, so half a token is no document; the first pass is whole unless the caller sets a budget.
    inside = lambda c: (F.col(c) < F.col("_budget") - 0.5) | (F.lit(budget is None) & (F.col("pass") == 0))
    order = W.partitionBy("_src", "pass").orderBy("_bh", "block").rowsBetween(W.unboundedPreceding, -1)
    started = (
        per_block.join(passes, "_src").withColumn("_bh", F.xxhash64(F.lit(seed), "pass", "block"))
        .withColumn("_b0", F.coalesce(F.sum("_bt").over(order), F.lit(0.0)) + F.col("pass") * F.col("total"))
        .where(inside("_b0")).select("_src", "block", "pass", "_b0", "_budget")
    )
    # Blocks are hash buckets of documents, so a join on (source, block) is even; every pass repeats the block's rows.
    x = d.join(started, ["_src", "block"]).withColumn("_dh", F.xxhash64(F.lit(seed), "pass", key))
    inner = W.partitionBy("_src", "block", "pass").orderBy("_dh", key).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("_at", F.coalesce(F.sum("_tok").over(inner), F.lit(0.0)) + F.col("_b0")).where(inside("_at"))
    return x.withColumn("mix_position", F.col("_at") / F.col("_budget")).select(*cols, "pass", "block", "mix_position")


def mix_weights(docs: DataFrame, source: str = "source", tokens: str = "tokens", target_entropy: float | None = 0.9, max_passes: float | None = 2.0) -> DataFrame:
    """(source, total, weight, passes, exponent, entropy): the mix that mix_sources makes without a budget of the caller's. passes is
    how often a source is shown, entropy that of the weights over the greatest possible; null sources are `\u0000`."""
    tok = F.greatest(F.coalesce(F.col(tokens), F.lit(1)), F.lit(1)).cast("double")
    totals = materialize(docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("\u0000")).alias("source")).agg(F.sum(tok).alias("total")), "mix-totals")
    t = find_exponent(totals, target_entropy, max_passes)
    reached = _facts(totals, [t], True)[0] if not totals.isEmpty() else None
    power = F.pow("total", F.lit(t))
    z = totals.agg(F.sum(power).alias("z"), F.max(F.pow("total", F.lit(1 - t))).alias("least")).first()
    weight, passes = power / F.lit(z["z"]), power * F.lit(z["least"]) / F.col("total")
    return totals.select("source", "total", weight.alias("weight"), passes.alias("passes"), F.lit(t).alias("exponent"), F.lit(reached).alias("entropy"))


def count_tokens(docs: DataFrame, text: str = "text", file: str | None = None) -> DataFrame:
    """docs plus tokens: those of the whole text by the tokenizer and one for its end, as packing counts them (null: the end
    alone). A column of that name is replaced."""
    bound_batches(docs.sparkSession)
    file, docs = file or tokenizer_file(), docs.drop("tokens").withColumn(text, F.col(text).cast("string"))

    def count(batches):
        enc = RunEncoder(file)
        for batch in batches:
            n = [np.diff(encode_texts(part.column(text), enc)[0]) for _, part in text_blocks(batch, text)]
            yield batch.append_column("tokens", pa.array(np.concatenate([np.zeros(0, np.int64), *n]) + 1, pa.int64()))

    return docs.mapInArrow(lean(count), T.StructType([*docs.schema.fields, T.StructField("tokens", T.LongType())]))


def op5_temperature_mixing(spark, sf_dir: str) -> DataFrame:
    """The flattest mix of the sources of documents in which none is shown more than twice as often as the least repeated one. A null
    doc_id is a document like others, a null source a source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    slim = materialize(count_tokens(docs).select("doc_id", "source", "tokens"), "mix-docs")
    return mix_sources(slim, target_entropy=None).select("doc_id", "source", "tokens", "pass", "mix_position")
