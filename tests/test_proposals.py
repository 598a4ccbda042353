import pytest
from pyspark.sql import functions as F

from roadloom.operators import diagnostics, proposals, references


def test_reference_axis_drops_near_points_and_lone_roads(spark):
    rows = [("A", 1.0, 0.0, 0.0), ("A", 1.0, 2.0, 0.0), ("A", 1.1, 1.0, 0.005), ("A", 1.2, 4.0, 4.0), ("B", 2.0, 5.0, 5.0), ("A", None, 1.0, 1.0)]
    got = diagnostics.reference_axis(spark.createDataFrame(rows, "road string, hm_km double, x double, y double")).orderBy("hm_km").collect()
    assert [(r["road"], r["hm_km"], r["points"], r["route_m"]) for r in got] == [("A", 1.0, 2, 0.0), ("A", 1.2, 1, 5.0)]


def test_overlap_clusters_start_anew_after_the_furthest_end(spark):
    rows = [("r", "a", 0.0, 5.0, 9.0), ("r", "b", 1.0, 2.0, 3.0), ("r", "c", 4.0, 4.5, 1.0), ("r", "d", 5.0, 6.0, 0.0), ("r", "e", 5.0, 5.0, 7.0)]
    got = diagnostics.overlap_clusters(spark.createDataFrame(rows, "k string, g string, hm_min double, hm_max double, route_m double"), ["k"], "g").orderBy("order_no").collect()
    assert [(r["g"], r["cluster"]) for r in got] == [("c", 1), ("b", 1), ("a", 1), ("d", 2), ("e", 2)]


def test_boundary_zone_takes_the_worst_colour(spark):
    p = spark.createDataFrame([(1, "x", 995.0), (2, "x", 500.0), (3, "y", 995.0)], "point_id long, axis_id string, route_m double")
    z = spark.createDataFrame([("x", 7, 1005.0, 1005.0, "orange"), ("x", 3, 900.0, 990.0, "red")], "axis_id string, zone long, from_m double, to_m double, color string")
    got = {r["point_id"]: (r["color"], r["zones"]) for r in diagnostics.boundary_zones(p, z, "point_id").collect()}
    assert got == {1: ("red", "3, 7"), 2: (None, None), 3: (None, None)}


def test_comparison_covers_every_verdict_and_empty_input(spark):
    p = spark.createDataFrame([("p1", "A"), ("p2", "B"), ("p3", "C"), ("p4", "D")], "proposal_id string, proposed string")
    a = spark.createDataFrame([("p1", "A"), ("p1", "A"), ("p2", "X"), ("p2", "Y"), ("p3", "X"), ("p3", None)], "proposal_id string, existing string")
    got = {(r["level"], r["name"]): (r["difference"], r["status"], r["objects"]) for r in proposals.compare_proposals(p, a).collect()}
    assert got == {
        ("project", "A"): ("match", "ok", 2), ("project", "X"): ("splits over proposals", "check", 2), ("project", "Y"): ("name differs", "attention", 1),
        ("proposal", "p1"): ("match", "ok", 2), ("proposal", "p2"): ("joins projects", "check", 2), ("proposal", "p3"): ("name differs", "attention", 2), ("proposal", "p4"): ("no existing project", "attention", 0),
    }
    assert proposals.compare_proposals(p.limit(0), a.limit(0)).count() == 0


@pytest.mark.parametrize("objects, axis", [(0, "near"), (5, "far")])
def test_axis_choice_weighs_objects_over_length(spark, objects, axis):
    c = spark.createDataFrame([("p", "near", 100.0, 110.0, True, 0), ("p", "far", 100.0, 900.0, True, objects), ("p", "out", 100.0, 100.0, False, 25)], "project string, axis_id string, length_m double, axis_length_m double, in_range boolean, objects long")
    assert diagnostics.choose_axis(c, "project").first()["axis_id"] == axis


def test_objects_of_touched_projects_come_whole_and_in_tiles(spark):
    c = spark.createDataFrame([("p1", "A - b"), ("p1", "a-B"), ("p1", "C"), ("p2", "A-B"), ("p3", ""), ("p4", None), ("p5", "gone")], "proposal_id string, existing string")
    a = [(i, "a-b") for i in range(7)] + [(6, "A-B"), (None, "A-B"), (8, "c"), (9, ""), (10, None), (11, "alone")]
    assets = spark.createDataFrame(a, "object_id long, project string")
    want = sorted([(p, o) for o in (*range(7), 6, None) for p in ("p1", "p2")] + [("p1", 8)], key=str)
    for size in ({}, {"names_each": 1, "tile": 3}):
        got = references.proposal_project_objects(c, assets, **size)
        assert got.columns == ["object_id", "project", "proposal_id"]
        assert sorted([(r["proposal_id"], r["object_id"]) for r in got.collect()], key=str) == want
    assert references.proposal_project_objects(c.limit(0), assets).count() == 0


def test_pairs_of_a_large_project_take_little_room_on_disk(spark, tmp_path):
    many, objects = 2999, 333
    c = spark.range(2 * many).select(F.concat(F.lit("N350-HRB-"), "id").alias("proposal_id"), F.concat(F.lit("N350-HRB-10.0-1"), F.col("id") % 2).alias("existing"))
    a = spark.range(2 * objects).select((F.col("id") * 9 + 1000000).alias("object_id"), F.concat(F.lit("N350-HRB-10.0-1"), F.col("id") % 2).alias("project"))
    references.proposal_project_objects(c, a).select("proposal_id", "object_id").write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == 2 * many * objects
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 0.25 * 2 * many * objects
