"""Quality scores by compression: how much better a text compresses with a dictionary of good texts than with one of bad texts.

A whole text is compressed in blocks with zstandard, once with each raw-content dictionary. The difference of the sizes over the
text's bytes is a margin; a logistic curve, fitted on texts that the dictionaries don't hold, makes it a probability.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.shared import materialize
from roadloom.llm.text import crc_mod, read
from roadloom.llm.words import bound_batches, lean

#: Bytes of a text at which the curve counts it as half short: short texts leave little to compress, whatever they are.
SHORT = 64
#: Steps to 1 of the margins and of the shares that the curve is fitted on; margins beyond MARGIN count as MARGIN.
STEPS, MARGIN = 500, 0.5


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries of good and bad texts and the curve: 1 / (1 + exp(-(bias + slope * margin + short * SHORT / (SHORT + bytes))))."""

    good: bytes
    bad: bytes
    bias: float
    slope: float
    short: float



def make_coder(dictionary: bytes, level: int = 6):
    """A compressor with a raw-content dictionary, or a plain one if that is empty. Matches of three bytes count: words are short."""
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(level, min_match=3, write_checksum=0, write_content_size=0, write_dict_id=0)
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=params)
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def measure(text: str | None, good, bad, block: int = 512) -> tuple[float, int]:
    """(margin, bytes): bytes that the good coder saves over the bad one, a byte of the text; 0 for null and empty texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    parts = [raw[i : i + block] for i in range(0, len(raw), block)]
    saved = sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts)
    return saved / max(len(raw), 1), len(raw)


def with_margin(df: DataFrame, pairs: list[tuple[bytes, bytes]], text: str, pick: str | None = None) -> DataFrame:
    """df plus _m (margin, size): by the first pair of dictionaries, or by that whose number stands in column pick."""
    bound_batches(df.sparkSession)

    @F.pandas_udf("margin double, size long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def measured(parts):
            coders = [(make_coder(g), make_coder(b)) for g, b in pairs]
            for texts, which in parts:
                yield pd.DataFrame([measure(t, *coders[k]) for t, k in zip(texts, which)], columns=["margin", "size"])

        yield from lean(measured)(batches)

    return df.withColumn("_m", run(F.col(text), F.col(pick) if pick else F.lit(0)))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int) -> DataFrame:
    """Stored (y, half, text) of at most about max_rows labelled documents, drawn by a hash of the key. half is 0 or 1 by a hash of the
    text, so copies are in one half. Keys with both labels count as good; other labels than 0 and 1, and null keys or texts, don't count."""
    lab = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    n = lab.count()
    if n > max_rows:
        lab = lab.where(F.pmod(F.xxhash64(F.lit("quality"), key), F.lit(1 << 30)) < F.lit(int((1 << 30) * max_rows / n)))
    found = docs.select(F.col(key), F.col(text).alias("text")).where("text is not null").join(F.broadcast(lab), key)
    return materialize(found.select("y", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), "text"), "quality-sample")


def draw_pieces(sample: DataFrame, pieces: int, chars: int) -> dict[tuple[int, int], list[str]]:
    """By (y, half): about so many pieces of so many characters, from everywhere in the texts, in an order given by hashes."""
    n = F.ceil(F.length("text") / chars).cast("int")
    t = sample.where(F.length("text") > 0).withColumn("n", n).withColumn("h", F.xxhash64("text"))
    sizes = t.groupBy("y", "half").agg(F.sum("n").alias("n")).collect()
    if not sizes:
        return {}
    share = F.create_map(*[x for r in sizes for x in (F.lit(2 * r["y"] + r["half"]), F.lit(min(1.0, pieces / r["n"])))])
    drawn = F.expr("filter(transform(sequence(0, n - 1), i -> named_struct('i', i, 'h', xxhash64('piece', h, i))), x -> pmod(x.h, 1073741824L) / 1073741824D < share)")
    few = t.withColumn("share", share[2 * F.col("y") + F.col("half")]).select("y", "half", "text", F.explode(drawn).alias("x"))
    rows = few.select("y", "half", F.expr(f"substring(text, x.i * {chars} + 1, {chars})").alias("t"), "x.h").collect()
    out: dict[tuple[int, int], list[str]] = {(r["y"], r["half"]): [] for r in sizes}
    for r in sorted(rows, key=lambda r: (r["h"], r["t"])):
        out[r["y"], r["half"]].append(r["t"])
    return out


def join_pieces(pieces: list[str], dict_bytes: int) -> bytes:
    """Dictionary of the first distinct pieces that fit; zstandard takes none below eight bytes."""
    body = b""
    for x in dict.fromkeys(pieces):
        body = x.encode("utf-8", "surrogatepass") + b" " + body
        if len(body) >= dict_bytes:
            break
    return body[-dict_bytes:].rjust(16) if body else b""


def fit_curve(margin: np.ndarray, size_share: np.ndarray, good: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """(bias, slope, short) of the logistic curve, by Newton steps; the ridge keeps separable labels finite."""
    x = np.column_stack([np.ones(len(margin)), margin * 20, size_share])
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (weight * (good - p)) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] * 20), float(w[2])


def fit_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000, pieces: int = 400, piece_chars: int = 256, dict_bytes: int = 64 << 10
) -> QualityModel:
    """Dictionaries and curve from a bounded sample of labelled rows (max_rows, see labelled_sample).

    The curve is fitted on margins across: texts of either half are measured with dictionaries of the other half, so no text meets
    itself. The driver gets 4 * pieces pieces and a table of counts by rounded margin and length. With one label only there is nothing to tell apart:
    every text gets that label's smoothed share, a half without labels. A label that one half lacks has no dictionary there.
    """
    sample = labelled_sample(docs, labels, key, text, label, max_rows)
    of = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(of) < 2:
        share = (of.get(1, 0) + 1) / (sum(of.values()) + 2)
        return QualityModel(b"", b"", float(np.log(share / (1 - share))), 0.0, 0.0)
    drawn = draw_pieces(sample, pieces, piece_chars)
    half = [tuple(join_pieces(drawn.get((y, k), []), dict_bytes) for y in (1, 0)) for k in (0, 1)]
    mixed = [[x for pair in zip(drawn.get((y, 0), []), drawn.get((y, 1), [])) for x in pair] + drawn.get((y, 0), []) + drawn.get((y, 1), []) for y in (1, 0)]
    good, bad = (join_pieces(m, dict_bytes) for m in mixed)
    crossed = with_margin(sample.withColumn("other", 1 - F.col("half")), half, "text", "other")
    margin = F.round(F.least(F.lit(MARGIN), F.greatest(F.lit(-MARGIN), "_m.margin")) * STEPS).cast("int")
    share = F.round(SHORT / (SHORT + F.col("_m.size")) * STEPS / 5).cast("int")
    grid = crossed.groupBy("y", margin.alias("margin"), share.alias("share")).agg(F.count("*").alias("n")).toPandas().sort_values(["y", "margin", "share"])
    curve = fit_curve(grid["margin"].to_numpy() / STEPS, grid["share"].to_numpy() * 5 / STEPS, grid["y"].to_numpy(float), grid["n"].to_numpy(float))
    return QualityModel(good, bad, *curve)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """docs plus quality_score (0 to 1) and quality_pred (1 from 0.5 on), from the whole text; same-named columns are replaced.

    Null and empty texts have margin 0 and get what the curve says of the shortest texts. Every row is scored on its own, so repeated
    rows and rows without a key are scored like any other; an empty table stays empty.
    """
    at = ["quality_score", "quality_pred", "_m"]
    measured = with_margin(docs.drop(*at), [(model.good, model.bad)], text)
    m = F.least(F.lit(MARGIN), F.greatest(F.lit(-MARGIN), "_m.margin"))
    z = F.lit(model.bias) + F.lit(model.slope) * m + F.lit(model.short) * SHORT / (SHORT + F.col("_m.size"))
    scored = measured.withColumn("quality_score", 1 / (1 + F.exp(-F.least(F.lit(40.0), F.greatest(F.lit(-40.0), z)))))
    return scored.withColumn("quality_pred", (F.col("quality_score") >= 0.5).cast("int")).drop("_m")


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. A null doc_id is in no fold: held_out is null, and the row isn't learned from."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = crc_mod(F.col("doc_id"), 3)
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").where(fold != 1)
    model = fit_quality(docs.where(fold != 1), labels)
    return score_quality(docs, model).select("doc_id", (fold == 1).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))
