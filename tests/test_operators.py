import random

from pyspark.sql import functions as F

from roadloom.operators import changes, components, graph, intervals, reconcile, segment


def test_components_with_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(30)] + [(5000, 5000), (None, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(400)} | {1000 + i: 1000 for i in range(31)}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_absorb_matches_repeated_scan(spark):
    rng = random.Random(3)
    rows = [(t, i, 1.0 * i * 50, 1.0 * i * 50 + rng.choice([10, 50, 120]), rng.choice([1, 2, 3]), rng.random() < 0.1, rng.choice("ab")) for t in range(40) for i in range(1, 12)]
    runs = spark.createDataFrame(rows, "t int, run long, start_m double, end_m double, objects long, gap_before boolean, p string")
    got = {(r["t"], r["run"]): r["part_of"] for r in segment.absorb_deviations(runs, ["t"], ["p"]).collect()}
    for t in range(40):
        rs = [dict(run=r[1], s=r[2], e=r[3], n=r[4], g=r[5], p=r[6], m=[r[1]]) for r in rows if r[0] == t]
        changed = True
        while changed:
            changed = False
            for i in range(1, len(rs) - 1):
                a, b, c = rs[i - 1 : i + 2]
                if a["p"] == c["p"] and not b["g"] and not c["g"] and b["n"] <= 2 and b["e"] - b["s"] < 100:
                    rs[i - 1 : i + 2] = [dict(run=a["run"], s=min(a["s"], b["s"], c["s"]), e=max(a["e"], b["e"], c["e"]), n=a["n"] + b["n"] + c["n"], g=a["g"], p=a["p"], m=a["m"] + b["m"] + c["m"])]
                    changed = True
                    break
        assert {m: r["run"] for r in rs for m in r["m"]} == {run: part for (tt, run), part in got.items() if tt == t}


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.01, 3.0), ("a", 5.0, 4.0), ("a", 6.0, 6.0), ("b", None, 1.0)], "k string, start double, end double")
    assert {(r["start"], r["end"]) for r in intervals.merge_intervals(df, ["k"]).collect()} == {(1.0, 3.0), (4.0, 5.0)}
    known = spark.createDataFrame([("a", 1.0, 10), ("a", 2.0, 20)], "k string, at double, v int")
    probe = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 9.0)], "k string, at double")
    assert {(r["at"], r["v"]) for r in intervals.last_before(probe, known, ["k"], "at", ["v"]).collect()} == {(0.5, None), (1.0, 10), (9.0, 20)}


def test_nearest_group_and_hops(spark):
    edges = spark.createDataFrame([(a, b, "x") for a, b in [(1, 2), (2, 3), (3, 4), (4, 5), (9, 5)] for a, b in ((a, b), (b, a))], "src long, dst long, relation string")
    groups = spark.createDataFrame([(1, 1), (9, 9)], "object_id long, group_id long")
    others = spark.createDataFrame([(i,) for i in (2, 3, 4, 5, 7)], "object_id long")
    assert {(r["object_id"], r["group_id"], r["hops"]) for r in graph.nearest_group(groups, others, edges).collect()} == {(2, 1, 1), (3, 1, 2), (4, 9, 2), (5, 9, 1)}
    assert graph.hop_distances(spark.createDataFrame([(1,)], "object_id long"), edges, 2).count() == 3


def test_replay(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "object_id long, f string, g string")
    log = spark.createDataFrame([(1, "f", "n1", 1, 1), (1, "f", "n2", 1, 2), (3, "f", "z", 1, 3)], "object_id long, field string, value string, ts long, seq long")
    assert {tuple(r) for r in changes.replay(table, log, "object_id", ["f", "g"]).collect()} == {(1, "n2", "x"), (2, "b", "y")}


def test_entry_imports_without_llm():
    import __spark_entry__ as e

    assert "reconcile_projects" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_details_compute_the_differences_once(spark):
    a = spark.createDataFrame([("P", "1", "O1", "0,1"), ("P", "2", "O2", "0,2"), ("Q", "3", "O3", "0,3")], "project_key string, object_no string, object_key string, chainage string").withColumn("km", F.lit(0.1))
    m = spark.createDataFrame([("P", "1", "O1", "M", 1.0, 1.0), ("P", "1", "O1", "N", 1.0, 1.0), ("Q", "3", "O3", "M", 1.0, 1.0)], "project_key string, object_no string, object_key string, measure string, amount double, price double")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    diffs = spark.createDataFrame([("P", "O2", "only_in_asset")], "project_key string, object_key string, difference string")
    got = reconcile.control_point_details(a, m, diffs.mapInArrow(count, diffs.schema)).collect()
    assert sorted((r["object_key"], r["row_no"], r["maint_measure"], r["differences"]) for r in got if r["object_key"] == "O1") == [("O1", 1, "M", ""), ("O1", 2, "N", "")]
    assert [(r["row_no"], r["maint_measure"], r["differences"]) for r in got if r["object_key"] == "O2"] == [(1, None, "only_in_asset")] and len(got) == 3
    assert seen.value == 1
