import itertools
import math
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from roadloom.functions import domain, names
from roadloom.operators import cyclepaths, graph, reconcile, references, segment, worklist


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_codes(spark):
    assert [one(spark, domain.side_code(F.lit(t))) for t in ("Rechts", "links buiten", "links en rechts", "L R", "re", "x", None)] == ["R", "L", "LR", "LR", "R", "", ""]
    assert [one(spark, domain.road_number(F.lit(t))) for t in ("WA-N354_1", "354.0", "0354", "N35412", "x", None)] == ["354", "354", "354", None, None, None]
    assert [one(spark, domain.post_km(F.lit(t))) for t in ("115", "11,5", "86", "-3", "x", "100.5")] == [11.5, 11.5, 8.6, None, None, 10.05]
    assert [one(spark, domain.meter_value(F.lit(k), F.lit(m))) for k, m in ((25.8, 1.0), (None, 7.12345))] == [25800.0, 7.123]
    assert one(spark, domain.parse_profile(F.lit("a=1, b = x=y, c, a=2"))) == {"a": "2", "b": "x=y"}
    assert tuple(one(spark, domain.object_type(F.lit(""), F.lit("rijstrook"), F.lit("links rechts")))) == ("HRB", "HRB", "LR")
    assert [one(spark, domain.special_object(F.lit(t), F.lit(n))) for t, n in (("Rotonde A", "Rotonde A"), ("bij tunnel", "T1"), ("weg", "weg"))] == ["Rotonde A", "tunnel", None]
    assert [one(spark, names.angle_difference(F.lit(a), F.lit(b))) for a, b in ((10.0, 170.0), (0.0, 180.0), (5.0, 95.0))] == [20.0, 0.0, 90.0]
    got = one(spark, names.worst_change(F.array(F.lit("layer"), F.lit("contract")), F.lit(300.0)))
    assert tuple(got) == (True, "hard technical cut")
    assert one(spark, names.worst_change(F.array(F.lit("contract")), F.lit(300.0)))["cut"] is False


def test_names_keep_their_faults(spark):
    said = lambda t, road="N354": tuple(one(spark, names.validate_name(F.lit(t), F.lit(road)))[k] for k in ("status", "message"))
    assert said("N354-HRB-01.2-12.8") == ("ok", "")
    assert said("n 354_hrb 1,2/12.8") == ("check", "begin below 10 needs a leading zero; begin needs one decimal; fields must be parted by single hyphens")
    assert said("N355-PW-12.8-11.5") == ("check", "road in name (N355) differs from (N354); type PW needs side L, R or LR; begin is not before end")
    assert said("N354-PWX-01.2-12.8") == ("attention", "type PW needs side L, R or LR")
    assert said("werk aan de weg") == ("check", "name is not road, type, begin and end")
    p = one(spark, names.name_parts(F.lit("oud: N354 - HRB - 12,8 - 11.5 (deel)")))
    assert tuple(p) == ("N354", "HRB", 11.5, 12.8)
    assert tuple(one(spark, names.name_parts(F.lit("groot onderhoud N354"))))[:2] == ("N354", "")


def test_replacements_against_brute_force(spark):
    rng = random.Random(7)
    label = lambda: f"{rng.choice(['N350', 'N351'])}-{rng.choice(['HRB', 'HRBR', 'PWR', 'FPL'])}-{(a := rng.randint(0, 60) / 10):04.1f}-{a + rng.randint(1, 20) / 10:04.1f}"
    keys = sorted({label() for _ in range(70)})
    rows = [(k, "MISSING_IN_MAINTENANCE" if i % 2 else "NO_ASSET_OBJECTS", *((lambda a: (a, a + rng.random()))(rng.random() * 6) if i % 4 == 1 else (None, None))) for i, k in enumerate(keys)]
    gone, have = [r for r in rows if r[1][0] == "M"], [r for r in rows if r[1][0] == "N"]
    diffs, moved = [], {}
    for n in range(60):
        a, b = rng.choice(gone)[0], rng.choice(have)[0]
        moved[a, b] = moved.get((a, b), 0) + 1
        diffs += [(a, f"o{n}", "only_in_asset"), (b, f"o{n}", "only_in_maintenance")]

    def parts(k):
        r, c, a, b = k.split("-")
        return r, c, "HRB" if c.startswith("HRB") else c[:2], min(float(a), float(b)), max(float(a), float(b))

    want = {}
    for k, _, lo, hi in gone:
        r1, c1, f1, *own = parts(k)
        found = []
        for h, *_ in have:
            r2, c2, f2, s2, e2 = parts(h)
            n = moved.get((k, h), 0)
            if r1 != r2 or (f1 != f2 and not n):
                continue
            best = (0, 0.0, -math.inf)
            for s, e in [own] + ([(lo, hi)] if lo is not None else []):
                over, gap = min(e, e2) - max(s, s2), round(max(0.0, max(s, s2) - min(e, e2)), 9)
                best = max(best, (30 if over > 0 else 18 if gap <= 0.2 else 8 if gap <= 1 else 0, max(over, 0.0), -gap))
            ratio = SequenceMatcher(None, k, h).ratio()
            score = 35 + (25 if c1 == c2 else 15 if f1 == f2 else 0) + best[0] + (min(40 + 5 * n, 60) if n else 0) + (8 if ratio >= 0.92 else 4 if ratio >= 0.85 else 0)
            if score >= 65:
                found.append((score, n, best[1], best[2], h))
        want[k] = [(h, s) for s, _, _, _, h in sorted(found, reverse=True)[:3]]
    got = {}
    compared = spark.createDataFrame(rows, "project_key string, status string, hm_min double, hm_max double")
    for r in sorted(reconcile.replacement_candidates(compared, spark.createDataFrame(diffs, "project_key string, object_key string, difference string")).collect(), key=lambda r: r["place"]):
        got.setdefault(r["missing"], []).append((r["candidate"], r["score"]))
    assert got == {k: v for k, v in want.items() if v}


def test_backbone_and_secondaries_against_brute_force(spark):
    rng = random.Random(3)
    nodes = [(i, rng.choice("ab"), rng.choice("xy"), rng.random() < 0.5) for i in range(60)]
    links = {tuple(rng.sample(range(60), 2)) for _ in range(90)}
    edges = {e for a, b in links for e in ((a, b), (b, a))}
    o = spark.createDataFrame(nodes, "object_id long, layer string, attr string, main boolean")
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    group = {i: i for i, *_, m in nodes if m}
    for _ in range(60):
        for a, b in edges:
            if nodes[a][3] and nodes[b][3] and nodes[a][1:3] == nodes[b][1:3]:
                group[a] = group[b] = min(group[a], group[b])
    main = graph.backbone_groups(o.where("main"), e, "layer", ["attr"])
    assert {r["object_id"]: r["group_id"] for r in main.collect()} == group
    rank = {g: rng.randint(0, 2) for g in set(group.values())}
    known = spark.createDataFrame([(i, g, rank[g]) for i, g in group.items()], "object_id long, group_id long, rank long")
    best, front, hops = {}, {i: (rank[g], g) for i, g in group.items()}, 0
    while front:
        hops += 1
        nxt = {}
        for a, b in edges:
            if a in front and not nodes[b][3] and b not in best:
                nxt[b] = min(nxt.get(b, front[a]), front[a])
        best |= {i: (g, hops) for i, (_, g) in nxt.items()}
        front = nxt
    got = graph.nearest_group(known, o.where("not main"), e, ties=("rank",)).collect()
    assert {r["object_id"]: (r["group_id"], r["hops"]) for r in got} == best


def test_hops_and_pairs(spark):
    e = spark.createDataFrame([(a, b) for x, y in ((1, 2), (2, 3), (3, 4), (1, 5)) for a, b in ((x, y), (y, x))], "src long, dst long")
    got = {(r["object_id"], r["hops"]) for r in graph.hop_distances(spark.createDataFrame([(1,)], "object_id long"), e, 2).collect()}
    assert got == {(1, 0), (2, 1), (5, 1), (3, 2)}
    lines = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 5.0, -5.0, 5.0, 5.0), (3, 0.0, 3.0, 10.0, 3.0), (4, 500.0, 0.0, 510.0, 0.0)], "object_id long, x1 double, y1 double, x2 double, y2 double")
    d = {(r["src"], r["dst"]): r["distance_m"] for r in graph.near_pairs(lines, lines, 4.0).collect()}
    assert d == {(1, 2): 0.0, (2, 1): 0.0, (1, 3): 3.0, (3, 1): 3.0, (2, 3): 0.0, (3, 2): 0.0}


def test_areas_have_a_direction(spark):
    rng, rows = random.Random(2), []
    for i, (angle, long, short) in enumerate([(30, 20, 4), (120, 9, 2), (0, 5, 5), (77, 50, 1)]):
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        for u, v in [(0, 0), (long, 0), (long, short), (0, short)] + [(rng.random() * long, rng.random() * short) for _ in range(6)]:
            rows.append((i, 3 + u * c - v * s, 7 + u * s + v * c))
    rows += [(9, 1.0, 1.0), (9, 2.0, 2.0)]
    got = {r["object_id"]: r for r in cyclepaths.polygon_orientation(spark.createDataFrame(rows, "object_id long, x double, y double")).collect()}
    for i, angle, score in ((0, 30, 5), (1, 120, 4.5), (3, 77, 50)):
        assert abs(got[i]["angle_deg"] - angle) < 1e-6 and abs(got[i]["score"] - score) < 1e-6
    assert abs(got[2]["score"] - 1) < 1e-6 and got[9]["angle_deg"] is None


def test_absorbed_runs_against_a_stack(spark):
    rng, rows = random.Random(12), []
    for t in "pq":
        at = 0.0
        for i in range(1, 300):
            n = rng.choice([1, 1, 2, 5])
            rows.append((t, i, at, at + rng.choice([30.0, 60.0, 150.0]), n, rng.random() < 0.05, rng.choice("ab")))
            at = rows[-1][3]
    want = {}
    for t in "pq":
        st = []
        for _, i, s, e, n, gap, p in (r for r in rows if r[0] == t):
            r = [i, s, e, n, gap, p, [i]]
            if len(st) > 1 and st[-1][3] <= 2 and st[-1][2] - st[-1][1] < 100 and not st[-1][4] and not gap and st[-2][5] == p:
                b, a = st.pop(), st.pop()
                r = [a[0], min(a[1], b[1], s), max(a[2], b[2], e), a[3] + b[3] + n, a[4], p, a[6] + b[6] + [i]]
            st.append(r)
        want |= {(t, i): r[0] for r in st for i in r[6]}
    d = spark.createDataFrame(rows, "t string, run long, start_m double, end_m double, objects long, gap_before boolean, p string")
    assert {(r["t"], r["run"]): r["part_of"] for r in segment.absorb_deviations(d, ["t"], ["p"]).collect()} == want


def test_nearest_reference_prefers_hops(spark):
    xy = "object_id long, x1 double, y1 double, x2 double, y2 double"
    paths = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 900.0, 900.0, 910.0, 900.0)], xy)
    refs = spark.createDataFrame([(10, 0.0, 5.0, 10.0, 5.0, 1), (11, 0.0, 80.0, 10.0, 80.0, 1), (12, 0.0, 5.0, 10.0, 5.0, 0)], xy + ", rank int")
    edges = spark.createDataFrame([(1, 11), (11, 1)], "src long, dst long")
    got = lambda e: {r["object_id"]: (r["reference_id"], r["distance_m"], r["hops"]) for r in cyclepaths.nearest_reference(paths, refs, e).collect()}
    assert got(None) == {1: (12, 5.0, None)} and got(edges) == {1: (11, 80.0, 1)}


def test_worklist_edits_and_amounts(spark):
    a = spark.createDataFrame([("p", "new", "warning", 3), ("q", None, "info", None)], "project_key string, state string, severity string, objects int")
    q = {r["project_key"]: r for r in worklist.queue_defaults(a).collect()}
    assert (q["p"]["priority_score"], q["p"]["priority"], q["q"]["priority_score"], q["q"]["state"]) == (73, "middle", 20, "new")
    edits = spark.createDataFrame([("p", "done"), ("z", "done")], "project_key string, state string")
    assert {(r["project_key"], r["state"]) for r in reconcile.merge_edits(a, edits, "project_key", ["state"]).collect()} == {("p", "done"), ("q", None)}
    t = spark.createDataFrame([("a", "x", "1,5", None), ("b", "2", "2", "k")], "name string, amount string, unnamed_3 string, price string")
    assert reconcile.amounts_from(t, "amount", "price") == "unnamed_3"
    v = worklist.run_verdict(spark.createDataFrame([(0, 0, 0, 0, 0, 2), (1, 9, 9, 9, 9, 9)], "blocking int, warnings int, high int, actions int, mutations int, resolved int")).collect()
    assert [r["color"] for r in v] == ["green", "red"]
    assert references.without_geometry(spark.createDataFrame([(1, "x")], "id int, gps_wkt string")).columns == ["id"]


def test_every_pair_of_a_grid_cell_edge(spark):
    rows = [(i, 49.9 * i, 0.0, 49.9 * i + 30, 0.0) for i in range(12)]
    d = spark.createDataFrame(rows, "object_id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r["src"], r["dst"]) for r in graph.near_pairs(d, d, 20.0).collect()}
    want = {(a[0], b[0]) for a, b in itertools.permutations(rows, 2) if max(a[1], b[1]) - min(a[3], b[3]) <= 20}
    assert got == want


def test_cells_of_pairs_are_not_broadcast(spark, tmp_path):
    lines = spark.range(3).selectExpr("id as object_id", "'a' as subtheme_key", "cast(id * 10 as double) as x1", "0.0d as y1", "cast(id * 10 + 10 as double) as x2", "0.0d as y2")
    lines.write.parquet(f"{tmp_path}/lines")
    stored = spark.read.parquet(f"{tmp_path}/lines")
    for df in (graph.near_pairs(stored, stored, 1.0), graph.proximity_edges(stored)):
        assert df.count() == 4 and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_distances_are_compiled_and_judged_once(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0, "a"), (2, 10.2, 0.0, 20.0, 0.0, "a"), (3, 5.0, 0.3, 6.0, 9.0, "b"), (4, 5.0, 60.0, 6.0, 90.0, "b")], "object_id long, x1 double, y1 double, x2 double, y2 double, subtheme_key string")
    edges = graph.proximity_edges(lines)
    assert {tuple(r) for r in edges.collect()} == {(1, 2, "longitudinal"), (2, 1, "longitudinal"), (1, 3, "lateral"), (3, 1, "lateral")}
    for df, joins in ((edges, 1), (graph.near_pairs(lines, lines, 0.5), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("SortMergeJoin") == joins and "namedlambda" not in plan and "lambdafunction" not in plan
        # The distance is a column of its own; the filter reads it instead of repeating how it is made.
        assert any("Filter" in line and "distance_m" in line and "HYPOT" not in line.upper() for line in plan.splitlines())
