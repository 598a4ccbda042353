"""The compression classifier: held-out accuracy, the curve, and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.llm.quality_classifier import MARGIN, SHORT, QualityModel, fit_curve, fit_quality, make_coder, measure, op13_quality_classifier, score_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op13_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and set(got["quality"]) == {0, 1}
    assert (got["predicted"] == got["quality"]).mean() >= 0.95
    assert ((got["score"] >= 0.5).astype(int) == got["predicted"]).all() and got["score"].between(0, 1).all()
    assert got[got["quality"] == 1]["score"].mean() > 0.9 > 0.4 > got[got["quality"] == 0]["score"].mean()


def test_every_document_once(spark):
    got = op13_quality_classifier(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count() and got.where("score is null or predicted is null or held_out is null").count() == 0


def toy(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(60)]
    plain = lambda: " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, plain() if i % 3 else "!! ".join(rng.choice(words).upper() for _ in range(60))) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)] + [(None, 0), (5, None), (6, 7)], "doc_id long, quality int")
    return spark.createDataFrame(rows, "doc_id long, text string"), labels


def test_odd_rows_and_score_formula(spark):
    docs, labels = toy(spark)
    model = fit_quality(docs.where("doc_id < 90"), labels)
    odd = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x" * 2_000_000, "c"), (4, "퟿\U0001f600 é", "d")]
    df = spark.createDataFrame(odd, "doc_id long, text string, quality_score string")
    got = score_quality(df, model).collect()
    assert len(got) == 5
    good, bad = make_coder(model.good), make_coder(model.bad)
    for r in got:
        m, n = measure(r.text, good, bad)
        z = model.bias + model.slope * min(MARGIN, max(-MARGIN, m)) + model.short * SHORT / (SHORT + n)
        assert math.isclose(r.quality_score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert got[0].quality_score == got[1].quality_score == got[2].quality_score
    assert score_quality(df.where("false"), model).count() == 0
    rest = score_quality(docs.where("doc_id >= 90"), model).collect()
    assert all(r.quality_pred == int(r.doc_id % 3 > 0) for r in rest)


def test_one_label_or_none(spark):
    docs, labels = toy(spark)
    only = fit_quality(docs, labels.where("quality = 1"))
    assert {r.quality_pred for r in score_quality(docs, only).collect()} == {1}
    none = fit_quality(docs, labels.where("false"))
    assert none == QualityModel(b"", b"", 0.0, 0.0, 0.0)
    assert score_quality(docs, none).where("quality_score <> 0.5").count() == 0


def test_curve_finds_weights():
    rng = np.random.default_rng(1)
    m, s = rng.uniform(-0.3, 0.3, 20000), rng.uniform(0, 1, 20000)
    y = rng.random(20000) < 1 / (1 + np.exp(-(0.5 + 12 * m + 2 * s)))
    assert fit_curve(m, s, y.astype(float), np.ones(20000)) == pytest.approx((0.5, 12, 2), rel=0.15)


def test_sample_is_bounded(spark):
    from roadloom.llm.quality_classifier import labelled_sample

    docs, labels = toy(spark)
    many = labelled_sample(docs, labels, "doc_id", "text", "quality", 30)
    assert 10 < many.count() < 50 and many.where(F.col("y").isin(0, 1)).count() == many.count()
