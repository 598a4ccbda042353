"""Nearest segments against brute force, at any distance."""

import math
import random

from roadloom.operators import boundaries, linear, nearest
from roadloom.operators.nearest import nearest_segment, shape_segments
from pyspark.sql import functions as F


def away(x, y, s):
    x1, y1, x2, y2 = s
    dx, dy = x2 - x1, y2 - y1
    t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / max(dx * dx + dy * dy, 1e-300)))
    return math.hypot(x - x1 - t * dx, y - y1 - t * dy)


def test_near_and_far_points(spark):
    rng = random.Random(5)
    segs = [(f"s{i:03d}", rng.choice("ab"), *(rng.uniform(0, 3000) for _ in range(2)), *(rng.uniform(0, 3000) for _ in range(2))) for i in range(60)] + [("s900", "a", 5.0, 5.0, 5.0, 5.0), ("s901", "b", 100.0, 100.0, 60100.0, 40100.0)]
    pts = [(i, rng.choice("abc"), rng.uniform(-scale, scale), rng.uniform(-scale, scale)) for i, scale in enumerate([100, 3000, 40_000, 2_000_000] * 30)]
    s = spark.createDataFrame(segs, "segment_id string, axis string, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(pts + [(900, "a", None, 1.0), (901, "a", float("nan"), 1.0)], "point_id long, axis string, x double, y double")
    got = {r["point_id"]: r for r in nearest_segment(p, s, ["segment_id"]).collect()}
    assert set(got) == {q[0] for q in pts}
    for i, _, x, y in pts:
        d = min(away(x, y, g[2:]) for g in segs)
        assert math.isclose(got[i]["distance_m"], d, rel_tol=1e-9, abs_tol=1e-6)
        assert math.isclose(away(x, y, next(g for g in segs if g[0] == got[i]["segment_id"])[2:]), d, rel_tol=1e-9, abs_tol=1e-6)
    keyed = {r["point_id"]: r["distance_m"] for r in nearest_segment(p, s, ["segment_id"], keys=["axis"]).collect()}
    assert set(keyed) == {q[0] for q in pts if q[1] != "c"}
    assert all(math.isclose(d, min(away(*pts[i][2:], g[2:]) for g in segs if g[1] == pts[i][1]), rel_tol=1e-9, abs_tol=1e-6) for i, d in keyed.items())
    close = {r["point_id"] for r in nearest_segment(p, s, ["segment_id"], within_m=200.0).collect()}
    assert close == {i for i, _, x, y in pts if min(away(x, y, g[2:]) for g in segs) <= 200}


def test_ties_and_nothing_to_find(spark):
    s = spark.createDataFrame([("b", 0.0, 0.0, 10.0, 0.0, 100.0), ("a", 0.0, 2.0, 10.0, 2.0, 0.0)], "axis_id string, x1 double, y1 double, x2 double, y2 double, from_m double").withColumn("length", F.lit(10.0))
    p = spark.createDataFrame([(1, 4.0, 1.0), (2, 9e6, 1.0)], "point_id long, x double, y double")
    got = sorted(tuple(r) for r in linear.project_points(p, s).collect())
    assert got[0] == (1, "a", 4.0, 1.0) and got[1][:3] == (2, "a", 10.0) and math.isclose(got[1][3], math.hypot(9e6 - 10, 1))
    assert linear.project_points(p, s, 5.0).count() == 1
    assert linear.project_points(p, s.where("false")).count() == 0 == linear.project_points(p.where("false"), s).count()


def test_objects_far_from_every_axis_have_a_range(spark):
    seg = spark.createDataFrame([("A", 0.0, 0.0, 1000.0, 0.0, 0.0)], "axis_id string, x1 double, y1 double, x2 double, y2 double, from_m double")
    v = spark.createDataFrame([(1, 300.0, 9000.0), (1, 500.0, 9700.0), (1, 2500.0, 9000.0)], "object_id long, x double, y double")
    r = boundaries.geometry_ranges(v, spark.createDataFrame([(1, 400.0, 9350.0)], "object_id long, x double, y double"), seg).collect()
    assert [tuple(x) for x in r] == [(1, "A", 300.0, 500.0, 1000.0, 9350.0)]


def test_shape_segments(spark):
    rows = [(1, 0, 0, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (4, 0), (4, 3)])] + [(2, 0, 0, 0, 7.0, 7.0)]
    v = spark.createDataFrame(rows, "object_id long, part long, hole long, seq long, x double, y double")
    lines = sorted((r["object_id"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in shape_segments(v).collect())
    assert lines == [(1, 0, 0, 4, 0), (1, 4, 0, 4, 3), (2, 7, 7, 7, 7)]
    areas = [(r["x1"], r["x2"], r["y2"]) for r in shape_segments(v, closed=F.col("object_id") == 1).collect() if r["object_id"] == 1]
    assert sorted(areas) == [(0, 4, 0), (4, 0, 0), (4, 4, 3)]


def test_cells_are_not_broadcast(spark, monkeypatch):
    plans, distances = [], nearest._distances

    def seen(pairs, *more):
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return distances(pairs, *more)

    monkeypatch.setattr(nearest, "_distances", seen)
    points = spark.createDataFrame([(1, 5.0, 1.0)], "point_id long, x double, y double")
    segments = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 0.0)], "axis_id string, x1 double, y1 double, x2 double, y2 double")
    assert nearest.nearest_segment(points, segments, ["axis_id"]).first()["distance_m"] == 1.0
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_cells_of_later_rounds_are_not_broadcast(spark, monkeypatch):
    plans, distances = [], nearest._distances

    def seen(pairs, *more):
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return distances(pairs, *more)

    monkeypatch.setattr(nearest, "_distances", seen)
    points = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 120.0)], "point_id long, x double, y double")
    segments = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 0.0)], "axis_id string, x1 double, y1 double, x2 double, y2 double")
    assert {r["point_id"]: r["distance_m"] for r in nearest.nearest_segment(points, segments, ["axis_id"]).collect()} == {1: 1.0, 2: 120.0}
    assert len(plans) == 2 and all("Broadcast" not in p for p in plans)


def test_vertices_at_one_place_count_several_times(spark):
    seg = spark.createDataFrame([("A", 0.0, 0.0, 1000.0, 0.0, 0.0)], "axis_id string, x1 double, y1 double, x2 double, y2 double, from_m double")
    v = spark.createDataFrame([(1, x, 1.0) for x in (100.0, 100.0, 100.0, 400.0, 900.0)] + [(2, 5.0, 300.0), (2, 5.0, 300.0), (2, 6.0, 2.0), (2, None, 2.0)], "object_id long, x double, y double")
    middles = spark.createDataFrame([(1, 400.0, 1.0), (2, 5.0, 2.0), (2, 5.0, 200.0), (3, 5.0, 2.0)], "object_id long, x double, y double")
    got = sorted(tuple(r) for r in boundaries.geometry_ranges(v, middles, seg).collect())
    assert got == [(1, "A", 100.0, 100.0, 900.0, 1.0), (2, "A", 5.0, 5.0, 6.0, 2.0)]


def test_first_round_shuffles_points_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(nearest, "materialize", lambda df, name, keep=nearest.materialize: (kept.append((name, df._jdf.queryExecution().executedPlan().toString())), keep(df, name))[1])
    points = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 2.0)], "point_id long, x double, y double")
    segments = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 0.0)], "axis_id string, x1 double, y1 double, x2 double, y2 double")
    assert nearest.nearest_segment(points, segments, ["axis_id"], carry=[]).count() == 2
    # One exchange of the points and one of the cells; points that look again are read from what the round stored.
    assert [p.count("Exchange hashpartitioning") for n, p in kept if n == "nearest-round"] == [2] and all("Exchange" not in p for n, p in kept if n != "nearest-round")
