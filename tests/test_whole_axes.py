from roadloom.plans import queries


def test_points_reach_the_end_of_long_axes(spark, tmp_path):
    # One axis of 200 km: a vertex every 500 m.
    rows = [(12 * 20 * i, 1, 1, 1, 1.0, 1.0) for i in range(401)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    length = queries.linear.axis_lengths(queries._segments(spark, str(tmp_path))).first()["length_m"]
    got = sorted(r["n"] for r in queries.axis_points(spark, str(tmp_path)).collect())
    assert length > 199_000 and got == list(range(int((length - 1) // 100) + 1))
