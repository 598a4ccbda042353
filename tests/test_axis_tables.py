from roadloom.operators import axis_advice, proposals


def test_what_runs_store_is_narrow_and_probes_meet_anchors_once(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(axis_advice, "materialize", lambda df, name, keep=axis_advice.materialize: (kept.update({name: df}), keep(df, name))[1])
    rows = [(i, "N1", "HRB", "N1-HRB-00.0-01.0", "B", "L0" if i < 6 or i > 6 else "L1", "1999", f"wide {i}") for i in range(12)]
    objects = spark.createDataFrame(rows, "object_id long, road string, track string, project string, contract string, layer string, year_layer string, object_no string")
    ranges = spark.createDataFrame([(i, "N1", i * 50.0, i * 50.0 + 50.0) for i in range(12)], "object_id long, axis_id string, route_from double, route_to double")
    anchors = spark.createDataFrame([("N1", k / 10, k * 100.0) for k in range(8)], "axis_id string, hm_km double, route_m double")
    got = axis_advice.axis_advice(objects, ranges, anchors, ["layer", "year_layer"]).collect()
    # The deviation of object 6 is absorbed: one proposal, named by its ends.
    assert [(r["proposal_id"], r["proposed"], r["objects"], r["length_m"], r["comparison"]) for r in got] == [("N1-HRB-1", "N1-HRB-00.0-00.6", 12, 600.0, "attention")]
    assert not any("object_no" in df.columns for df in kept.values()) and "proposed" not in kept["axis-proposals"].columns and "axis-ends" not in kept


def test_verdicts_by_keys_are_those_by_name(spark):
    p = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 2, "w")], "axis string, run long, proposed string").selectExpr("*", "axis || run as proposal_id")
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x"), ("b", 1, ""), ("b", 1, None), ("b", 2, "v"), ("b", 2, "w")]
    a = spark.createDataFrame(rows, "axis string, run long, existing string").selectExpr("*", "axis || run as proposal_id")
    want = {(r["name"], r["difference"], r["status"], r["objects"]) for r in proposals.compare_proposals(p, a).where("level = 'proposal'").collect()}
    got = {(r["axis"] + str(r["run"]), r["difference"], r["status"], r["objects"]) for r in proposals.proposal_verdicts(p, a, ["axis", "run"]).collect()}
    assert got == want and len(got) == 4
