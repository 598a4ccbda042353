import codecs
import json

from pyspark.sql import functions as F

from roadloom.operators import changes
from roadloom.sources import files

ALIASES = {"object_id": ["id", "nummer"], "project": ["Onderhoudsproject"], "subtheme": ["subthema"], "road": ["Weg nummer"]}


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_headers():
    assert files.column_key("﻿Wég-Nummer ") == "wegnummer"
    assert files.unique_names(["a", "", "a", " "]) == ["a", "unnamed_2", "a_2", "unnamed_4"]


def test_assets_of_two_files(spark, tmp_path):
    a = write(tmp_path / "a.csv", "﻿Nummer;Subthema;Onderhouds project;ID\n1;rijstrook;;9\n;;;\n;fietspad;P;\n")
    b = write(tmp_path / "b.csv", "road;id\nN354;7\n")
    d = files.read_assets(spark, [a, b], ALIASES, ["project", "extra"])
    got = {(r["source_file"], r["object_id"], r["subtheme"], r["project"], r["extra"]) for r in d.collect()}
    assert got == {("a.csv", "1", "rijstrook", None, ""), ("a.csv", None, "fietspad", "P", ""), ("b.csv", "7", None, None, "")}
    keys = [r["row_key"] for r in d.collect()]
    assert "a.csv:1" in keys and "b.csv:7" in keys and len(set(keys)) == 3
    w = {(r["source"], r["column"]): (r["code"], r["rows"]) for r in files.source_warnings(d, ["object_id", "absent"]).collect()}
    assert w == {("a.csv", "object_id"): ("EMPTY_CELLS", 1), ("a.csv", "absent"): ("EMPTY_COLUMN", 2), ("b.csv", "absent"): ("EMPTY_COLUMN", 1)}
    assert [r["column"] for r in files.missing_columns(d, ["project", "absent"], "x").collect()] == ["absent"]


def test_domain_columns(spark):
    d = spark.createDataFrame([(" Rijstrook", "RECHTS", "12,5", "20260512"), ("x", "nan", "99999.9", "")], "subtheme string, side string, chainage_text string, registered string")
    got = [(r["side"], r["subtheme_clean"], r["rank"], r["chainage_km"], r["registered_year"], r["registered_month"]) for r in files.domain_columns(d).collect()]
    assert got == [("Rechts", "rijstrook", 1, 12.5, 2026, 5), ("Unknown", "x", 4, None, 0, 0)]
    assert files.domain_columns(spark.range(1)).first()["rank"] == 4


def test_table_below_titles_keeps_rows_that_repeat_a_title(spark, tmp_path):
    p = write(tmp_path / "m.csv", 'Export\n\nnummer;Onderhoudsproject;x\n1;"a;b";2\nExport\nnummer;Onderhoudsproject;x\n')
    got = [(r["object_id"], r["project"], r["x"]) for r in files.read_table_below_titles(spark, p, ALIASES).collect()]
    assert got == [("1", "a;b", "2"), ("Export", None, None), ("nummer", "Onderhoudsproject", "x")]
    assert files.read_table_below_titles(spark, write(tmp_path / "e.csv", ""), ALIASES).count() == 0


def test_actions(spark, tmp_path):
    p = write(tmp_path / "l.csv", "Onderhoudsproject;status;owner\nN354 - HRB;;an\n;;x\n;open;\n")
    assert [(r["project_key"], r["status"], r["owner"]) for r in files.read_actions(spark, [p], ALIASES).orderBy("row_no").collect()] == [("N354-HRB", None, "an"), ("", "open", None)]


def test_geojson_and_features(spark, tmp_path):
    shapes = [("Point", [1, 2], "a"), ("Point", [3, 4], "a"), ("LineString", [[0, 0], [1, 1]], None), ("Polygon", [[[0, 0], [1, 0], [1, 1]]], "p"), ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]]]], "m")]
    feats = [{"type": "Feature", "properties": {"id": i, "hm": "7"}, "geometry": {"type": k, "coordinates": c}} for k, c, i in shapes]
    whole = write(tmp_path / "f.json", json.dumps({"type": "FeatureCollection", "features": feats}))
    lines = write(tmp_path / "l.json", "\n".join(map(json.dumps, feats)))
    for path, by_line in ((whole, False), (lines, True)):
        got = {r["kind"]: [len(p) for p in r["parts"]] for r in files.read_geojson(spark, path, by_line).collect()}
        assert got == {"Point": [1], "LineString": [2], "Polygon": [3], "MultiPolygon": [3, 3]}
        assert files.read_features(spark, path, "id", "hm", by_line).count() == 4


def test_wkt_and_crs(spark):
    rows = [(1, "SRID=4326;POINT (5.38720621 52.1551744)", None), (2, "POINT (155000 463000)", "POINT (155000 463000)"), (3, "nan", "POLYGON ((0 0, 1 0, 1 1), (0.2 0.2, 0.3 0.2, 0.3 0.3))"), (4, "POINT (a b)", ""), (5, "MULTILINESTRING ((4 52, 5 52), (5 53, 6 53))", "x")]
    valid, lost = files.locate(spark.createDataFrame(rows, "id int, gps string, rd string"), "gps", "rd")
    v = {r["id"]: (r["geometry_column"], r["parts"]) for r in valid.collect()}
    assert {k: x[0] for k, x in v.items()} == {1: "gps", 2: "rd", 3: "rd", 5: "gps"}
    assert abs(v[1][1][0][0]["x"] - 155000) < 0.01 and abs(v[1][1][0][0]["y"] - 463000) < 0.01
    assert [len(p) for p in v[3][1]] == [3, 3] and [len(p) for p in v[5][1]] == [2, 2]
    assert [(r["id"], r["reason"]) for r in lost.collect()] == [(4, "gps: unreadable; rd: empty")]
    good, bad = files.split_valid(spark.createDataFrame(rows, "id int, gps string, rd string"), "gps")
    assert good.count() == 3 and {r["reason"] for r in bad.collect()} == {"empty geometry", "unreadable geometry"}


def test_texts_of_geometry_are_read_once(spark):
    rows = [(1, " 'LineString Z (1\t2 9,  3   4 9 ) '", "POINT (\t5 6)"), (2, "POINT (5 95)", "MULTIPOLYGON (((1 1, 2 1\t,2 2)) , ((3 3, 4 3, 4 4)))"), (3, "POINT (1\n2)", "POINT (1)")]
    df = spark.createDataFrame(rows, "id int, gps string, rd string")
    valid, lost = files.locate(df, "gps", "rd")
    for d in (valid, lost):
        assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2
    got = {r["id"]: (r["geometry_column"], r["parts"]) for r in valid.collect()}
    assert got[1][0] == "gps" and len(got[1][1][0]) == 2 and got[2] == ("rd", [[(1, 1), (2, 1), (2, 2)], [(3, 3), (4, 3), (4, 4)]])
    assert [(r["id"], r["reason"]) for r in lost.collect()] == [(3, "gps: unreadable; rd: unreadable")]


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", "N1"), (2, "é", "N2")], "object_id int, layer string, road string")
    changes.write_export(d.coalesce(1), str(tmp_path / "x"), {"object_id": "nummer"})
    raw = next((tmp_path / "x").glob("*.csv")).read_bytes()
    assert raw.startswith(codecs.BOM_UTF8 + b"nummer;layer;road") and "2;é;N2".encode() in raw
    changes.write_results({"r": d, "s": d.drop("road")}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/r")).where("road = 'N2'").count() == 1 and spark.read.parquet(str(tmp_path / "out/s")).count() == 2


def test_change_log_stream(spark, tmp_path):
    from roadloom.streaming.changes import cell_state, changes_per_window

    log = spark.createDataFrame([(1, "f", "a", 1, "2026-01-01"), (1, "f", "b", 2, "2026-01-01"), (2, "f", "c", 1, "2026-01-05")], "object_id int, field string, value string, seq int, d string").withColumn("ts", F.to_timestamp("d"))
    log.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("cells", cell_state(s), "complete"), ("windows", changes_per_window(s), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r["object_id"], r["value"]) for r in spark.table("cells").collect()} == {(1, "b"), (2, "c")}
    assert [r["changes"] for r in spark.table("windows").collect()] == [2]
