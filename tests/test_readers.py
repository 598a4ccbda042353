"""Readers that split: many files in one scan, one feature collection in many ranges."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from roadloom.sources import features, files

ALIASES = {"object_id": ["id", "nummer"], "project": ["Onderhoudsproject"], "road": ["Weg nummer"]}


def test_many_files_in_one_scan(spark, tmp_path):
    heads = ["id;Weg nummer;Onderhoudsproject", "Onderhoudsproject;nummer", "x;id;nummer"]
    for i in range(300):
        (tmp_path / f"f{i:03d}.csv").write_text(heads[i % 3] + "\n" + f"a{i};N{i};p\n\n;;\n" + (f"a{i};N{i};p\n" if i % 3 else ""), encoding="utf-8")
    d = files.read_assets(spark, sorted(map(str, tmp_path.iterdir())), ALIASES, ["project"])
    scans = d._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans <= 1
    got = {(r["source_file"], r["line_no"]): r for r in d.collect()}
    assert len(got) == 500 and got["f000.csv", 2]["object_id"] == "a0" and got["f000.csv", 2]["road"] == "N0" and got["f000.csv", 2]["x"] is None
    assert got["f001.csv", 2]["project"] == "a1" and got["f001.csv", 2]["object_id"] == "N1"
    assert got["f002.csv", 2]["x"] == "a2" and got["f002.csv", 4]["object_id"] == "N2"


def test_twins_without_id_have_keys_of_their_own(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    for k in "ab":
        (tmp_path / k / "same.csv").write_text('id;project\n;"x;y"\n;"x;y"\n7;z\n', encoding="utf-8")
    d = files.read_assets(spark, [str(tmp_path / "a" / "same.csv"), str(tmp_path / "b" / "same.csv")], ALIASES, ["road"])
    keys = [r["row_key"] for r in d.collect()]
    assert len(keys) == len(set(keys)) == 6 and {r["project"] for r in d.collect()} == {"x;y", "z"} and d.where("road <> ''").count() == 0


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id;project\n" + "".join(f"{i};p{i}\n" for i in range(5000)), encoding="utf-8")
    (tmp_path / "latin.csv").write_bytes("id;project\n1;é\n".encode("latin-1"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        d = files.read_assets(spark, [str(tmp_path / "big.csv")], ALIASES, [])
        assert d.where(F.col("line_no") != F.col("object_id").cast("int") + 2).count() == 0 and d.count() == 5000
        lines = files.numbered_lines(spark, [str(tmp_path / "big.csv")])
        assert lines.agg(F.count_distinct("line_no")).first()[0] == 5001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert files.read_assets(spark, [str(tmp_path / "latin.csv")], ALIASES, [], encoding="ISO-8859-1").first()["project"] == "é"
    (tmp_path / "empty.csv").write_text("")
    assert files.read_assets(spark, [str(tmp_path / "empty.csv")], ALIASES, ["road"]).count() == 0


def collection(n, seed=1):
    rng = random.Random(seed)
    nasty = ['{"type":"Feature"', '"type": "Feature", {', "é}{[", 'a\\"b{', "x" * 300]
    out = []
    for i in range(n):
        inner = {"type": "Feature", "properties": {"in": i}, "geometry": None}
        p = {"id": str(i), "t": rng.choice(nasty), "sub": rng.choice([None, inner, {"a": {"b": [1]}}])}
        g = {"type": "LineString", "coordinates": [[rng.randint(0, 9), 1.5] for _ in range(rng.randint(2, 40))]}
        f = {"type": "Feature", "properties": p, "geometry": g}
        out.append(dict(rng.sample(list(f.items()), 3)))
    return out


@pytest.mark.parametrize("indent", [None, 1])
def test_every_range_owns_its_features(indent):
    feats = collection(60)
    raw = json.dumps({"type": "FeatureCollection", "name": "x", "features": feats, "more": {"type": "Feature"}}, indent=indent, ensure_ascii=False).encode()
    for size in (37, 256, 1000, 10**6):
        got = [json.loads(t) for s in range(0, len(raw), size) for t in features.owned_features(io.BytesIO(raw), s, min(s + size, len(raw)))]
        assert got == feats
    assert list(features.owned_features(io.BytesIO(b'{"features": []}'), 0, 16)) == [] == list(features.owned_features(io.BytesIO(b""), 0, 0))


def test_one_collection_by_many_tasks(spark, tmp_path):
    feats = collection(400, 2)
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": feats}, ensure_ascii=False), encoding="utf-8")
    d = features.feature_texts(spark, [str(tmp_path / "f.json")], 4096)
    assert sorted(json.loads(r["value"])["properties"]["id"] for r in d.collect()) == sorted(f["properties"]["id"] for f in feats)
    share = [r["n"] for r in d.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(share) > 10 and max(share) < 60
    g = files.read_geojson(spark, str(tmp_path / "f.json"))
    assert g.count() == 400 and {r["kind"] for r in g.collect()} == {"LineString"}
