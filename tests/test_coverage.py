"""Gaps without name zones, interval subtraction, merge candidates."""

import random

from roadloom.operators import axis_advice, coverage


def test_subtraction_against_a_plain_sweep(spark):
    rng = random.Random(8)
    base = [("k", i, float(a := rng.randint(0, 3000)), float(a + rng.randint(0, 900))) for i in range(60)] + [("other", 99, 0.0, 10.0), ("k", 98, 5.0, None)]
    holes = [("k", float(a := rng.randint(0, 3500)), float(a + rng.randint(0, 60))) for _ in range(120)] + [("k", 100.0, 100.0), ("k", None, 7.0)]
    got = coverage.subtract_intervals(spark.createDataFrame(base, "k string, id long, start double, end double"), spark.createDataFrame(holes, "k string, start double, end double"), ["k"], ["id"], bucket=250.0)
    want = set()
    for k, i, a, e in base:
        free = [(a, e)] if e is not None and e > a else []
        for hk, s, t in holes:
            if hk == k and s is not None:
                free = [p for x, y in free for p in (((x, min(y, s)), (max(x, t), y)) if t > x and s < y and t > s else ((x, y),)) if p[0] < p[1]]
        want |= {(k, i, x, y) for x, y in free}
    assert {(r["k"], r["id"], r["start"], r["end"]) for r in got.collect()} == want and len(want) > 60


def cover(spark, projects, objects):
    p = spark.createDataFrame(projects, "axis_id string, type string, name string, start_m double, end_m double, begin_km double, end_km double")
    a = spark.createDataFrame([("A", i / 10, i * 100.0, 1, 0.0, True) for i in range(31)], "axis_id string, hm_km double, route_m double, posts long, max_offset_m double, monotone boolean")
    o = spark.createDataFrame(objects, "axis_id string, type string, name string, start double, end double")
    return [r.asDict() for r in coverage.project_coverage(p, a, o).collect()]


def test_name_zones_shorten_gaps(spark):
    # The first project's end may lie up to km 1.0 + 2.5 m, the second's begin from km 1.4 + 2.5 m on.
    two = [("A", "PWR", "p", 0.0, 900.0, 0.0, 1.0), ("A", "PWR", "q", 2000.0, 1500.0, 1.5, 2.0)]
    inside = [("A", "PWR", "o1", 1100.0, 1200.0), ("A", "PWLR", "x", 1100.0, 1150.0), ("A", "PWL", "left", 1100.0, 1200.0), ("A", "HRB", "h", 1100.0, 1200.0), ("A", "PWR", "zone", 950.0, 1000.0)]
    rows = {r["check"]: r for r in cover(spark, two, inside)}
    g = rows["gap"]
    assert (g["from_m"], g["to_m"], g["left"], g["right"]) == (900.0, 1500.0, "p", "q")
    assert abs(g["hard_from_m"] - 1002.5) < 1e-6 and abs(g["hard_to_m"] - 1402.5) < 1e-6 and abs(g["margin_left_m"] - 102.5) < 1e-6 and abs(g["margin_right_m"] - 97.5) < 1e-6
    assert g["objects"] == 2 and g["object_names"] == "o1, x" and abs(g["objects_m"] - 150) < 1e-6
    assert abs(rows["coverage"]["pct"] - 70.0) < 1e-9 and rows["coverage"]["span_m"] == 2000.0 and rows["coverage"]["calibrated_m"] == 3000.0
    # Nothing of the type lies in what is left: no gap.
    assert {r["check"] for r in cover(spark, two, inside[2:])} == {"coverage"}


def test_sides_and_overlaps(spark):
    two = [("A", "PWLR", "p", 0.0, 900.0, 0.0, 0.9), ("A", "PWLR", "q", 1500.0, 2000.0, 1.5, 2.0), ("A", "PWLR", "r", 1900.0, 2500.0, 1.9, 2.5), ("A", "HRB", "m", 0.0, 500.0, 0.0, 0.5), ("A", "HRB", "n", 1500.0, 2000.0, 1.5, 2.0)]
    rows = cover(spark, two, [("A", "PWL", "l", 1000.0, 1100.0), ("A", "PWR", "r", 1200.0, 1300.0), ("A", "HRBR", "h", 900.0, 950.0)])
    gaps = {r["type"]: (r["objects"], r["object_names"]) for r in rows if r["check"] == "gap"}
    assert gaps == {"PWLR": (2, "l, r"), "HRB": (1, "h")}
    assert [(r["from_m"], r["to_m"], r["left"], r["right"]) for r in rows if r["check"] == "overlap"] == [(1900.0, 2000.0, "q", "r")]
    assert cover(spark, [("A", "PWL", "p", 5.0, 5.0, 0.0, 0.0)], [("A", "PWL", "l", 1.0, 2.0)]) == []


def test_merge_candidates_are_islands(spark):
    rows = [("A", "t", "1", 0.0, 90.0, "x"), ("A", "t", "2", 92.0, 250.0, ""), ("A", "t", "3", 250.0, 400.0, "y"), ("A", "t", "4", 500.0, 600.0, "y"), ("A", "t", "5", 600.0, 790.0, "y"), ("A", "t", "6", 790.0, 1100.0, "y"), ("A", "t", "7", 1100.0, 1200.0, "z"), ("A", "t", "8", 1200.0, 1300.0, "q")]
    s = spark.createDataFrame([(a, t, p, x, y, y - x, v, "regular", "begin: b" if p == "1" else "end: e" if p == "3" else "") for a, t, p, x, y, v in rows], "axis_id string, track string, proposal_id string, start_m double, end_m double, length_m double, layer string, category string, intervals string")
    got = sorted((r["start_m"], r["end_m"], r["parts"], r["proposals"], r["priority"], r["intervals"]) for r in axis_advice.merge_candidates(s, ["layer"]).collect())
    assert got == [(0.0, 400.0, 3, "1, 2, 3", 1, "begin: b; end: e"), (500.0, 790.0, 2, "4, 5", 1, "")]
