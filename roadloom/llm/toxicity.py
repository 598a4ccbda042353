"""Toxicity scores by a factorization machine over hashed terms (Rendle, 2010).

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 if hashed term i occurs in the text. The pair term
learns combinations that single weights miss.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.text import crc_mod
from roadloom.llm.words import bound_batches, lean

TERM = re.compile(r"[^\W\d_]+")
BITS = 22


class Hasher:
    """Distinct hashed terms of a whole text: lower-cased runs of letters. Words repeat, so hashes are cached."""

    def __init__(self, bits: int = BITS, limit: int = 1_000_000):
        self.mask, self.limit, self.known = (1 << bits) - 1, limit, {}

    def __call__(self, text: str | None) -> set[int]:
        terms = set(TERM.findall((text or "").lower()))
        if len(self.known) > self.limit:
            self.known.clear()
        known, mask = self.known, self.mask
        out = set()
        for w in terms:
            h = known.get(w)
            if h is None:
                h = known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) & mask
            out.add(h)
        return out


@dataclass
class FM:
    """Weights of the kept terms: index of a hashed term -> row of w and v."""

    terms: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score_rows(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for n, i in enumerate(rows):
            s = self.v[i].sum(0)
            z = self.w0 + self.w[i].sum() + 0.5 * (s @ s - (self.v[i] ** 2).sum())
            out[n] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def fit_fm(rows: list, labels: np.ndarray, factors: int = 8, epochs: int = 30, l2: float = 1e-3, rate: float = 0.2, seed: int = 5, min_docs: int = 1) -> FM:
    """Adagrad on logistic loss over rows of distinct hashed terms. Every term in min_docs rows at least is learned, however rare.

    A term's x is what the other rows say for it, the larger of two shares: the square of its z (how far its rate of positives
    lies from the mean, in standard errors) over 4, 1 at most, and df / (df + half the rows), so that pairs of terms that tell
    nothing alone can form. In training a row's own label and count are left out of its x, or a term of that row alone would
    explain it; for scoring x is folded into w and v.
    """
    y = np.asarray(labels, np.float64)
    if not len(rows) or y.min() == y.max():
        mean = float(np.clip(y.mean() if len(y) else 0.0, 0.001, 0.999))
        return FM(np.zeros(0, np.int64), float(np.log(mean / (1 - mean))), np.zeros(0), np.zeros((0, factors)))
    flat = np.concatenate([np.fromiter(r, np.int32, len(r)) for r in rows])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    ids, col = np.unique(flat, return_inverse=True)
    base = y.mean()
    ok = np.bincount(col, minlength=len(ids)) >= min_docs
    pos_of = np.cumsum(ok) - 1
    doc, col, ids = doc[ok[col]], pos_of[col[ok[col]]].astype(np.int32), ids[ok]
    if not len(ids):
        return FM(np.zeros(0, np.int64), float(np.log(base / (1 - base))), np.zeros(0), np.zeros((0, factors)))
    df, pos = np.bincount(col), np.bincount(col, weights=y[doc])

    def weight(df, pos):
        z = (pos - df * base) / np.sqrt(np.maximum(df, 1) * base * (1 - base))
        return np.maximum(np.minimum(np.abs(z) / 4, 1) ** 2, df / (df + len(rows) / 2))

    x = weight(df[col] - 1, pos[col] - y[doc])
    starts = np.searchsorted(doc, np.arange(len(rows) + 1))
    rng = np.random.default_rng(seed)
    k = len(ids)
    w, v, w0 = np.zeros(k), rng.normal(0, 0.01, (k, factors)), float(np.log(base / (1 - base)))
    gw, gv, g0 = np.full(k, 1e-6), np.full((k, factors), 1e-6), 1e-6
    size, place = 256, np.zeros(k, np.int64)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            lens = starts[pick + 1] - starts[pick]
            c = np.concatenate([col[starts[p] : starts[p + 1]] for p in pick])
            used = np.flatnonzero(np.bincount(c, minlength=k))
            place[used] = np.arange(len(used))
            c = place[c]
            xs = np.concatenate([x[starts[p] : starts[p + 1]] for p in pick])
            r = np.repeat(np.arange(len(pick)), lens)
            n, wu, vu = len(used), w[used], v[used]
            s = np.stack([np.bincount(r, vu[:, f][c] * xs, len(pick)) for f in range(factors)], 1)
            q = np.bincount(r, (vu**2).sum(1)[c] * xs**2, len(pick))
            p = 1 / (1 + np.exp(-np.clip(w0 + np.bincount(r, wu[c] * xs, len(pick)) + 0.5 * ((s**2).sum(1) - q), -40, 40)))
            e = (p - y[pick]) / len(pick)
            d0 = e.sum()
            g0 += d0 * d0
            w0 -= rate * d0 / np.sqrt(g0)
            # The gradient of v is the sum of e * x * (s - v * x) over a term's rows.
            ex, es = e[r] * xs, e[:, None] * s
            dw = np.bincount(c, ex, n) + l2 * wu / 10
            gw[used] += dw**2
            w[used] = wu - rate * dw / np.sqrt(gw[used])
            dv = np.stack([np.bincount(c, es[:, f][r] * xs, n) for f in range(factors)], 1) - np.bincount(c, ex * xs, n)[:, None] * vu + l2 * vu
            gv[used] += dv**2
            v[used] = vu - rate * 0.3 * dv / np.sqrt(gv[used])
    full = weight(df, pos)
    return FM(ids, w0, w * full, v * full[:, None])


def collect_training(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 12_000):
    """(rows of hashed terms, labels) of at most about max_rows labelled documents, drawn by a hash of the key.

    Null labels, keys and texts are not learned from; a key labelled twice counts as its larger label; rows that share a key are
    all learned from. The labels' sample is bounded by max_rows and broadcast, so texts are not shuffled. The driver gets
    the distinct terms of the sampled texts, four bytes each. Without labelled rows the result is empty, and so is the model.
    """
    lab = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    n = lab.count()
    if n > max_rows:
        lab = lab.where(F.pmod(F.xxhash64(F.lit("tox"), key), F.lit(1 << 30)) < F.lit(int((1 << 30) * max_rows / n)))
    joined = docs.select(F.col(key), F.col(text).alias("_t")).where(F.col("_t").isNotNull()).join(F.broadcast(lab), key).select("_y", "_t")

    def terms(batches):
        h = Hasher()
        for b in batches:
            yield pd.DataFrame({"y": b["_y"].astype("int32"), "terms": [np.array(sorted(h(t)), np.int32).tobytes() for t in b["_t"]]})

    got = joined.mapInPandas(terms, "y int, terms binary").toPandas().sort_values(["y", "terms"])
    return [np.frombuffer(t, np.int32) for t in got["terms"]], got["y"].to_numpy()


def score_toxicity(docs: DataFrame, model: FM, text: str = "text") -> DataFrame:
    """docs plus toxicity (0 to 1) and toxic_pred (1 from 0.5 on), from the whole text; same-named columns are replaced.

    Null and empty texts have no terms and get the bias alone. Every row is scored on its own; only the text counts, so
    repeated rows and rows without a key are scored like any other. Whole texts are read, in batches of bounded size; an empty
    table stays empty.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("toxicity", "toxic_pred")

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def scored(parts):
            h, at = Hasher(), {int(t): i for i, t in enumerate(model.terms)}
            for texts in parts:
                rows = [np.sort(np.fromiter((at[x] for x in h(t) if x in at), np.int64)) for t in texts]
                yield pd.Series(model.score_rows(rows))

        yield from lean(scored)(batches)

    return docs.withColumn("toxicity", run(F.col(text))).withColumn("toxic_pred", (F.col("toxicity") >= 0.5).cast("int"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents. A null doc_id is in no fold: held_out is null, and the row isn't learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    learn = crc_mod(F.col("doc_id"), 5) != 0
    model = fit_fm(*collect_training(docs.where(learn), labels.where(learn)))
    return score_toxicity(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic_pred").alias("predicted"))
