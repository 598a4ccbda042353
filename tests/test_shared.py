import os

import pytest

from roadloom.functions import shared


def test_scratch_tables_can_be_cleared(spark):
    shared.clear_scratch(spark)
    d = shared.materialize(spark.range(5), "numbers")
    assert d.count() == 5 and shared.clear_scratch(spark) == 1 and shared.clear_scratch(spark) == 0


def test_scratch_that_passes(spark):
    df = spark.range(5)
    outer = shared.materialize(df, "outer")
    with shared.passing_scratch(spark):
        inner = shared.materialize(df, "inner")
        kept = shared.keep_scratch(spark, inner.where("id > 2"), "kept")
        where = inner.inputFiles()[0]
    assert outer.count() == 5 and kept.count() == 2
    assert not os.path.exists(where.removeprefix("file://"))


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    with pytest.raises(RuntimeError):
        shared._warehouse(spark)


def test_the_shingle_join_drops_what_it_has_read(spark):
    from roadloom.llm.shingle_join import shingle_classes

    before = set(shared._written.get(spark.sparkContext.applicationId, []))
    same = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, same), (2, same), (3, same + " more"), (4, "other words here"), (5, None)], "doc_id long, text string")
    got = shingle_classes(docs)
    left = {p.split("roadloom-")[-1].rsplit("-", 1)[0] for p in shared._written[spark.sparkContext.applicationId] if p not in before}
    # Prefixes of all rows, lists and sets are gone when the result is read; it still can be.
    assert not left & {"join-docs", "join-entries", "join-hubs", "join-lists", "join-of", "join-sets", "join-pairs"} and {"join-keys", "join-reps"} <= left
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
