"""Scans along hot keys in blocks, and thinning against the last point kept."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from roadloom.operators import cyclepaths, diagnostics, intervals, references, scans, segment


@pytest.fixture
def parts(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_in_blocks_equals_windows(spark, parts):
    rng = random.Random(2)
    rows = [("hot" if i % 4 else rng.choice(["a", "b", None]), rng.randint(0, 400), i, rng.randint(-5, 5)) for i in range(3000)]
    d = spark.createDataFrame(rows, "k string, o long, id long, v long")
    cols = {"sums": {"s": F.col("v")}, "maxes": {"m": F.col("v")}, "lags": {"l": F.col("v")}}
    b, hot = scans.deal(d, ["k"], ["o", "id"])
    assert hot and not scans.deal(d, ["id"], ["o"])[1]
    sizes = [r["count"] for r in b.groupBy(scans.BLOCK).count().collect()]
    assert max(sizes) < 0.05 * len(rows) * 1.6 and len(sizes) > 30
    got = {r["id"]: (r["s"], r["m"], r["l"]) for r in scans.along(b, True, ["k"], ["o", "id"], **cols).collect()}
    want = {r["id"]: (r["s"], r["m"], r["l"]) for r in scans.along(d, False, ["k"], ["o", "id"], **cols).collect()}
    assert got == want


def test_one_track_with_all_objects(spark, parts):
    rng = random.Random(3)
    rows = [("N1", "HRB", i, float(at := i * 20 + rng.randint(0, 40)), float(at + rng.randint(5, 60)), rng.choice("ab"), rng.choice("xy")) for i in range(2000)]
    d = spark.createDataFrame(rows, "road string, track string, object_id long, start_m double, end_m double, layer string, year string")
    got = {r["object_id"]: (r["run"], r["gap_before"]) for r in segment.technical_runs(d, ["road", "track"], ["layer", "year"]).collect()}
    run, reach, last, want = 0, None, None, {}
    for r in sorted(rows, key=lambda r: (r[3], r[4], r[2])):
        gap = reach is not None and r[3] - reach > 5
        run += last is None or gap or last != r[5:]
        reach, last = max(reach or r[4], r[4]), r[5:]
        want[r[2]] = (run, gap)
    assert got == want
    islands = sorted((r["start"], r["end"]) for r in intervals.merge_intervals(d, ["road", "track"], "start_m", "end_m", 5.0).collect())
    plain = []
    for a, e in sorted((r[3], r[4]) for r in rows):
        if plain and a - plain[-1][1] <= 5:
            plain[-1] = (plain[-1][0], max(plain[-1][1], e))
        else:
            plain.append((a, e))
    assert islands == plain
    runs = segment.summarise_runs(segment.technical_runs(d, ["road", "track"], ["layer", "year"]), ["road", "track"], ["layer", "year"])
    s = [r["stretch"] for r in segment.cut_stretches(runs, ["road", "track"]).orderBy("run").collect()]
    assert s[0] in (0, 1) and all(b - a in (0, 1) for a, b in itertools.pairwise(s)) and s[-1] > 100


def thin(points, near):
    kept = []
    for p in points:
        if not kept or ((p[0] - kept[-1][0]) ** 2 + (p[1] - kept[-1][1]) ** 2) ** 0.5 > near:
            kept.append(p)
    return kept


def test_chains_keep_what_is_far_from_the_last_one_kept(spark, parts):
    rows = [("A", 1.0 + k / 10, 0.008 * k, 0.0) for k in range(6)]
    got = diagnostics.reference_axis(spark.createDataFrame(rows, "road string, hm_km double, x double, y double")).orderBy("hm_km").collect()
    assert [r["hm_km"] for r in got] == [1.0, 1.2, 1.4] and abs(got[-1]["route_m"] - 0.032) < 1e-9
    o = spark.createDataFrame([("A", 1, k / 10, 0.008 * k, 0.0, 1.0) for k in range(6)] + [("B", 1, 0.0, 1.0, 1.0, 1.0), ("B", 1, 0.1, 1.004, 1.0, 1.0)], "road string, section long, km double, x double, y double, weight double")
    assert [(r["road"], r["seq"], r["km"]) for r in references.local_axis(o).orderBy("seq").collect()] == [("A", 1, 0.0), ("A", 2, 0.2), ("A", 3, 0.4)]


def test_thinning_against_a_plain_walk(spark, parts):
    rng = random.Random(9)
    rows, want = [], set()
    for k in ("a", "b", None):
        x = y = 0.0
        pts = []
        for i in range(700):
            s = rng.choice([0.0, 0.003, 0.006, 0.012, 0.5])
            x, y = x + s * rng.choice([-1, 1]), y + s * rng.choice([-1, 0, 1])
            pts.append((x, y, i))
        rows += [(k, i, x, y) for x, y, i in pts]
        want |= {(k, p[2]) for p in thin(pts, 0.01)}
    got = scans.thin_points(spark.createDataFrame(rows, "k string, i long, x double, y double"), ["k"], ["i"])
    assert {(r["k"], r["i"]) for r in got.collect()} == want and 300 < len(want) < 2000


def test_backtracking_of_one_key(spark, parts):
    rng = random.Random(4)
    rows = [("r", "L", i, float(i), float(i + rng.choice([0, 1, 3])), rng.uniform(0, 300) if i % 9 else None, i + 1) for i in range(300)]
    d = spark.createDataFrame(rows, "road string, layer string, group_id long, hm_min double, hm_max double, route_m double, order_no int")
    got = {r["group_id"]: (r["order_no"], r["conflict"]) for r in cyclepaths.settle_backtracking(d, ["road", "layer"]).collect()}
    first, on, far, reach, of = 0, False, None, float("-inf"), {}
    for _, _, g, lo, hi, r, n in rows:
        back = r is not None and far is not None and r + 0.01 < far
        if lo <= reach + 1e-4 and (on or back):
            on, far, reach = True, max([v for v in (far, r) if v is not None], default=None), max(reach, hi)
        else:
            first, on, far, reach = n, False, r, hi
        of[g] = first
    order = sorted(rows, key=lambda x: (of[x[2]], x[5] is None, x[5] or 0, x[3], x[2]))
    count = {f: list(of.values()).count(f) for f in of.values()}
    assert got == {x[2]: (i, of[x[2]] if count[of[x[2]]] > 1 else None) for i, x in enumerate(order, 1)} and max(count.values()) > 2


def test_routes_do_not_depend_on_the_order_of_their_sums(spark):
    from roadloom.operators.linear import axis_segments

    line = spark.createDataFrame([("a", 0, i, i % 2 / 10, 0.0) for i in range(60)], "axis_id string, part int, seq int, x double, y double")
    assert {r["seq"]: r["from_m"] for r in axis_segments(line).collect()} == {i: i / 10 for i in range(59)}


def test_merged_routes_do_not_depend_on_the_order_of_their_sums(spark):
    from roadloom.operators.merging import merged_segments

    line = spark.createDataFrame([("a", 0, i, i % 2 / 10, 0.0) for i in range(60)], "axis_id string, part int, seq int, x double, y double")
    assert sorted(r["from_m"] for r in merged_segments(line).collect()) == [i / 10 for i in range(59)]


def test_route_along_does_not_depend_on_the_order_of_its_sums(spark):
    from roadloom.operators.scans import route_along

    line = spark.createDataFrame([("a", i, i % 2 / 10, 0.0) for i in range(60)], "road string, seq int, x double, y double")
    assert {r["seq"]: r["route_m"] for r in route_along(line, ["road"], ["seq"]).collect()} == {i: i / 10 for i in range(60)}


def test_overlaps_along_a_whole_axis_meet_no_objects(spark):
    from roadloom.operators.intervals import occupied_gaps

    gaps = spark.createDataFrame([("a", "p", "q", "overlap", 0.0, 1e14), ("a", "q", "r", "gap", 0.0, 50.0), ("a", "r", "s", "gap", 900.0, 950.0)], "road string, previous string, name string, kind string, `from` double, `to` double")
    objects = spark.createDataFrame([("a", 10.0, 20.0), ("a", 45.0, 60.0)], "road string, start double, `end` double")
    got = {r["name"]: (r["objects"], r["covered"]) for r in occupied_gaps(gaps, objects, ["road"]).collect()}
    assert got == {"q": (None, None), "r": (2, 15.0)}
