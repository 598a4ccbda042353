from pyspark.sql import functions as F

from roadloom.functions import names, text


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_empty_and_display(spark):
    assert [one(spark, text.clean_text(F.lit(v))) for v in ("nan", " NULL ", "", " a ")] == [None, None, None, "a"]
    assert [one(spark, text.display_text(F.lit(v))) for v in ("2005.0", "N351-HRB-01.0", "<NA>")] == ["2005", "N351-HRB-01.0", ""]


def test_numbers(spark):
    assert [one(spark, text.positive_number(F.lit(v))) for v in ("1.234,56", "hm 18,475", "1,234.5 m2", "-3", "m")] == [1234.56, 18.475, 1234.5, None, None]
    assert one(spark, text.numbers_in(F.lit("van 12,300 tot 14.405"))) == [12.3, 14.405]
    assert [one(spark, text.chainage_km(F.lit(v))) for v in ("12,5", "4,,9", "99999.9")] == [12.5, None, None]
    assert [tuple(one(spark, text.date_year_month(F.lit(v)))) for v in ("2026", "20260512", "20260512095736", "12-05-2026", "x")] == [(2026, 0), (2026, 5), (2026, 5), (2026, 5), (0, 0)]


def test_project_names(spark):
    p = one(spark, names.name_parts(F.lit("n354 hrb 12,8 11.5")))
    assert tuple(p) == ("N354", "HRB", 11.5, 12.8)
    assert one(spark, names.name_range(F.lit("N354-HRB-1.0-1.0"))) is None
    assert tuple(one(spark, names.type_family(F.lit("LBPL")))) == ("LBP", "L")
    assert one(spark, names.validate_name(F.lit("N354-PW-04.2-03.1"), F.lit("N354")))["status"] == "check"


def test_rounding(spark):
    r = lambda f, v: one(spark, f(F.lit(v)))
    assert [r(names.round_to_5m, v) for v in (14.0, 14.001, 14.007, 14.008, 14.099)] == [14.0, 14.005, 14.005, 14.01, 14.095]
    assert [r(names.tenth_up, v) for v in (3.8, 3.805)] == [3.8, 3.9]
    assert r(names.hm_label, 4.2) == "04.2" and r(names.hm_label, 12.3) == "12.3"
    assert r(names.snap_label, 12.301)["label"] == "12.3" and r(names.snap_label, 12.304)["label"] == "12.4"


def test_patterns_are_applied_where_they_may_fit(spark):
    assert [one(spark, text.project_key(F.lit(v))) for v in ("n350 – hrb-00.0 -\t00.4", "N350-HRB-00.0-00.4", "a \n b", "null\r\n")] == ["N350-HRB-00.0-00.4", "N350-HRB-00.0-00.4", "A B", " "]
    assert [one(spark, text.chainage_km(F.lit(v))) for v in ("NaN", "12,5", "89999,9", "90000", "-1", "x")] == [None, 12.5, 89999.9, None, -1.0, None]


def test_maintenance_rows_are_cleaned_once(spark, monkeypatch):
    from roadloom.operators import reconcile

    stored, real = [], reconcile.materialize
    monkeypatch.setattr(reconcile, "materialize", lambda df, name: stored.append(name) or real(df, name))
    a = spark.createDataFrame([("o1", "N1", "N350-HRB-00.0-00.4", "rijstrook", "0,1")], "object_no string, road string, project string, subtheme string, chainage_text string")
    m = spark.createDataFrame([("o1", "N350-HRB-00.0-00.4", "M1", "1,5", "2"), ("o2", "n350 - HRB-00.0-00.4", "M2", "1", "3")], "object_no string, project string, measure string, amount string, price string")
    row = reconcile.compare_projects(a, m).first()
    assert (row["status"], row["maint_objects"], row["measures"], row["amount"], row["price"]) == ("OBJECT_DIFFERENCE", 2, 2, 2.5, 5.0)
    assert stored == ["keyed-maintenance", "compared"]
