from roadloom.operators import reconcile

GONE, HERE = "MISSING_IN_MAINTENANCE", "NO_ASSET_OBJECTS"


def test_moved_objects_lead_to_other_families_and_ranges(spark):
    projects = [("N350-HRB-01.0-02.0", GONE), ("N350-FPR-01.0-02.0", HERE), ("N350-HRB-08.0-09.0", HERE), ("N350-HRB-02.0-03.0", HERE), ("N350-HRB-05.0-06.0", HERE), ("N350-PWR-01.0-02.0", HERE), ("N351-HRB-01.0-02.0", HERE), ("N350-FPR-07.0-08.0", HERE)]
    compared = spark.createDataFrame(projects, "project_key string, status string")
    moved = [("N350-FPR-01.0-02.0", "a"), ("N350-HRB-08.0-09.0", "b"), ("N351-HRB-01.0-02.0", "c"), ("N350-FPR-07.0-08.0", "d")]
    diffs = [("N350-HRB-01.0-02.0", o, "only_in_asset") for _, o in moved] + [(p, o, "only_in_maintenance") for p, o in moved]
    got = reconcile.replacement_candidates(compared, spark.createDataFrame(diffs, "project_key string, object_key string, difference string"), most=9).collect()
    found = {r["candidate"]: r["score"] for r in got}
    assert set(found) == {"N350-FPR-01.0-02.0", "N350-HRB-08.0-09.0", "N350-HRB-02.0-03.0", "N350-FPR-07.0-08.0"}
    # Road 35, category 25, range 30 or 18, one object 45, name 4.
    assert found["N350-FPR-01.0-02.0"] == 35 + 30 + 45 + 4 and found["N350-HRB-08.0-09.0"] == 35 + 25 + 45 + 4 and found["N350-HRB-02.0-03.0"] in (35 + 25 + 18 + 4, 35 + 25 + 18 + 8)


def test_chainages_of_objects_count_as_a_range(spark):
    rows = [("N350-HRB-01.0-02.0", GONE, 8.2, 8.9), ("N350-HRB-08.0-09.0", HERE, None, None), ("N350-HRB-09.5-09.9", HERE, None, None), ("N350-HRB-12.0-13.0", HERE, None, None)]
    compared = spark.createDataFrame(rows, "project_key string, status string, hm_min double, hm_max double")
    got = reconcile.replacement_candidates(compared, spark.createDataFrame([], "project_key string, object_key string, difference string")).collect()
    assert [(r["candidate"], r["evidence"], r["place"]) for r in sorted(got, key=lambda r: r["place"])] == [("N350-HRB-08.0-09.0", "overlapping range", 1), ("N350-HRB-09.5-09.9", "range nearby", 2)]


def test_names_all_but_equal_count_at_any_distance(spark):
    gone, names = "N350-HRB-2.3-4.5", ["N350-HRB-12.3-14.5", "N350-HRB-32.3-34.5", "N350-HRB-62.3-84.5", "N350-HRB-12.34-14.5", "N350-PWR-12.3-14.5", "N350-HRBR-12.3-14.5", "N351-HRB-12.3-14.5"]
    compared = spark.createDataFrame([(gone, GONE)] + [(n, HERE) for n in names], "project_key string, status string")
    none = spark.createDataFrame([], "project_key string, object_key string, difference string")
    got = reconcile.replacement_candidates(compared, none, most=9).collect()
    # Road 35, category 25, name 8: no range is within 1 km.
    assert {(r["candidate"], r["score"], r["evidence"]) for r in got} == {(n, 68, "name") for n in names[:3]}
    # With 64 for the least, names that are less alike (4) count too.
    assert {(r["candidate"], r["score"]) for r in reconcile.replacement_candidates(compared, none, least=64, most=9).collect()} == {(n, 68) for n in names[:3]} | {(names[3], 64)}


def test_gaps_up_to_a_fifth_count_however_near_near_is(spark):
    compared = spark.createDataFrame([("N350-HRB-01.9-01.9", GONE), ("N350-HRBR-02.1-03.8", HERE)], "project_key string, status string")
    none = spark.createDataFrame([], "project_key string, object_key string, difference string")
    got = reconcile.replacement_candidates(compared, none, near_km=0.05, bucket=0.01).collect()
    assert [(r["candidate"], r["score"], r["evidence"]) for r in got] == [("N350-HRBR-02.1-03.8", 35 + 15 + 18, "adjoining range")]
