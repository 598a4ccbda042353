from roadloom.operators import segment


def test_a_long_track_is_folded_in_stretches(spark):
    # Every fourth run is short, between two of one profile; the other neighbours are big.
    rows = [("t", i, 200.0 * i, 200.0 * i + (50 if i % 4 == 2 else 200), 1 if i % 4 == 2 else 9, False, "b" if i % 4 == 2 else "a") for i in range(1, 401)]
    runs = spark.createDataFrame(rows, "t string, run long, start_m double, end_m double, objects long, gap_before boolean, p string")
    sizes = [r["count"] for r in segment.cut_stretches(runs, ["t"]).groupBy("t", "stretch").count().collect()]
    assert max(sizes) == 3 and sum(sizes) == 400
    got = {r["run"]: r["part_of"] for r in segment.absorb_deviations(runs, ["t"], ["p"]).collect()}
    assert got == {i: i - 1 if i % 4 == 2 else i - 2 if i % 4 == 3 else i for i in range(1, 401)}
