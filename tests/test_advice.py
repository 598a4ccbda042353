from roadloom.operators import advice

SCHEMA = """road string, proposal_id string, proposed string, length_m double, name_from double, name_to double, in_range boolean, comparison string,
 own_status string, data_signals long, deviation_m double, terminal boolean"""


def rows(spark, *given):
    base = ("A", "p", "n", 500.0, 1.0, 1.5, True, "ok", None, 0, 0.0, False)
    names = [c.split()[0] for c in SCHEMA.replace("\n", "").split(",")]
    return spark.createDataFrame([tuple({**dict(zip(names, base)), **g}[c] for c in names) for g in given], SCHEMA)


def test_statuses_keep_data_quality_apart_from_advice(spark):
    d = rows(
        spark, {"proposal_id": "plain"}, {"proposal_id": "data", "data_signals": 3}, {"proposal_id": "out", "in_range": False}, {"proposal_id": "same", "name_to": 1.0},
        {"proposal_id": "cmp", "comparison": "attention"}, {"proposal_id": "own", "comparison": None, "own_status": "check"}, {"proposal_id": "end", "terminal": True},
        {"proposal_id": "nulls", "length_m": None, "name_from": None, "in_range": None, "comparison": None, "data_signals": None, "deviation_m": None, "terminal": None},
    )
    got = {r["proposal_id"]: (r["category"], r["advice"], r["reason"]) for r in advice.with_reasons(advice.proposal_statuses(d)).collect()}
    assert got == {
        "plain": ("regular", "ok", None), "data": ("regular", "ok", None), "out": ("outside", "check", "outside calibrated range"), "same": ("micro", "check", "very short"),
        "cmp": ("regular", "attention", "differs from existing projects"), "own": ("regular", "check", "needs a check by hand"), "end": ("regular", "ok", "end boundary at the last post"), "nulls": ("regular", "ok", None),
    }


def test_report_gives_one_verdict_per_road(spark):
    d = rows(spark, {"road": "A", "in_range": False}, {"road": "B"}, {"road": "C", "in_range": False}, {"road": "C"}, {"road": "D", "length_m": 3.0}, {"road": "D", "in_range": False})
    got = {(r["road"], r["item"]): (r["value"], r["verdict"]) for r in advice.run_report(advice.proposal_statuses(d)).collect()}
    assert got["A", "outside"] == (1, "check sources first") and got["B", "work list"] == (0, "usable, no actions")
    assert got["C", "no direct action"] == (1, "usable with work list") and got["D", "micro"] == (1, "all proposals need judging")
    assert advice.run_report(advice.proposal_statuses(d.limit(0))).count() == 0


def test_calibration_points(spark):
    d = advice.proposal_statuses(rows(spark, {"proposal_id": "a", "proposed": "x", "length_m": 60.0}, {"proposal_id": "b", "proposed": "x", "length_m": 200.0}, {"proposal_id": "c", "proposed": "y", "length_m": 900.0}))
    m = spark.createDataFrame([("c", 2), ("c", 1)], "proposal_id string, objects long")
    got = sorted(tuple(r) for r in advice.calibration_points(d, m).collect())
    assert got == [(1, "repeated name", "", "x", 2), (1, "very short proposal", "a", "x", 1), (2, "object family differs", "c", "y", 3), (2, "short proposal", "b", "x", 1)]
