"""Chaining of parts by shared ends."""

import random

from roadloom.operators import merging


def parts_of(points, sizes, rng, first=0):
    out, at = [], 0
    for k, n in enumerate(sizes):
        p = points[at : at + n + 1]
        out.append(p[::-1] if rng.random() < 0.3 else p)
        at += n
    rng.shuffle(out)
    return [(first + i, k, float(x), float(y)) for i, p in enumerate(out) for k, (x, y) in enumerate(p)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "axis_id string, part long, seq long, x double, y double")


def test_shuffled_and_turned_parts_are_one_route(spark):
    rng = random.Random(3)
    points = [(i * 10, (i * i) % 7) for i in range(101)]
    rows = [("A", *r) for r in parts_of(points, [5] * 20, rng)]
    # Another axis with the same coordinates stays apart.
    rows += [("B", 0, k, float(x), float(y)) for k, (x, y) in enumerate(points[:3])]
    got = merging.merged_segments(frame(spark, rows)).collect()
    a = sorted((r for r in got if r["axis_id"] == "A"), key=lambda r: r["from_m"])
    route = [(a[0]["x1"], a[0]["y1"])] + [(r["x2"], r["y2"]) for r in a]
    assert route in (points, points[::-1]) and {r["chain"] for r in a} == {0} and [r["seq"] for r in a] == list(range(1, 101))
    at = 0.0
    for r in a:
        assert abs(r["from_m"] - at) < 1e-6
        at += r["length"]
    assert len(got) == 102


def test_direction_of_most_parts(spark):
    p = [(0, 0), (1, 0), (2, 0), (3, 0)]
    rows = [("A", 0, 0, 1.0, 0.0), ("A", 0, 1, 0.0, 0.0)] + [("A", i, k, float(p[i + k][0]), 0.0) for i in (1, 2) for k in (0, 1)]
    got = {r["part"]: (r["chain"], r["rank"], r["way"]) for r in merging.chain_parts(frame(spark, rows)).collect()}
    assert got == {0: (0, 0, -1), 1: (0, 1, 1), 2: (0, 2, 1)}


def test_junctions_rings_and_points(spark):
    line = lambda part, *ps: [("A", part, k, float(x), float(y)) for k, (x, y) in enumerate(ps)]
    rows = line(1, (0, 0), (1, 0)) + line(2, (1, 0), (2, 0)) + line(3, (1, 0), (1, 1)) + line(4, (1, 1), (1, 2))  # three ends at (1, 0)
    rows += line(9, (50, 0), (51, 0)) + line(7, (51, 0), (51, 1), (50, 1)) + line(8, (50, 0), (50, 1))  # a ring of three
    rows += line(10, (90, 0), (91, 0), (91, 1), (90, 0))  # a ring of its own
    rows += line(11, (5, 5)) + line(12, (6, 6), (6, 6)) + [("A", 13, 0, None, 1.0)]
    got = {r["part"]: (r["chain"], r["rank"], r["way"]) for r in merging.chain_parts(frame(spark, rows)).collect()}
    assert got[1] == (1, 0, 1) and got[2] == (2, 0, 1) and got[3] == (3, 0, 1) and got[4] == (3, 1, 1) and got[10] == (10, 0, 1)
    assert {got[k][0] for k in (7, 8, 9)} == {7} and sorted(got[k][1] for k in (7, 8, 9)) == [0, 1, 2] and set(got) == {1, 2, 3, 4, 7, 8, 9, 10}
    seg = merging.merged_segments(frame(spark, rows)).collect()
    assert len(seg) == 4 + 4 + 3 and abs(max(r["from_m"] + r["length"] for r in seg) - sum(r["length"] for r in seg)) < 1e-9
    assert merging.merged_segments(frame(spark, rows).where("false")).count() == 0
