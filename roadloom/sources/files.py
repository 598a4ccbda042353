"""Readers of exports: delimited text with alias headers, tables below title rows, GeoJSON, WKT cells."""

from __future__ import annotations

import csv
import re
import unicodedata
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.shared import materialize
from roadloom.functions.text import chainage_km, clean_text, date_year_month, let, normal_text, project_key
from roadloom.sources.features import feature_texts


def column_key(name: str) -> str:
    """Header for comparison: no BOM, accents, case or punctuation."""
    flat = unicodedata.normalize("NFKD", str(name).replace("﻿", ""))
    return re.sub(r"[^a-z0-9]", "", "".join(c for c in flat if not unicodedata.combining(c)).lower())


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get _2, _3 …; empty ones become unnamed."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        base = str(n).strip() or f"unnamed_{i + 1}"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def canonical_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under their canonical names; of several aliases the first non-empty cell wins, in column order."""
    wanted = {column_key(a): c for c, names in aliases.items() for a in [c, *names]}
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(wanted.get(column_key(c), c), []).append(c)
    return df.select(*[F.coalesce(*[clean_text(f"`{c}`") for c in cs]).alias(name) for name, cs in groups.items()])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [clean_text(f"`{c}`").isNotNull() for c in df.columns]))


def with_columns_present(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.lit("") for n in names if n not in df.columns})


def missing_columns(df: DataFrame, names: list[str], source: str) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(source, "MISSING_COLUMN", n) for n in names if n not in df.columns], "source string, code string, column string")


def source_warnings(df: DataFrame, expected: list[str], source: str = "source_file") -> DataFrame:
    """(source, code, column, rows): per source file, its rows in which an expected column is empty; columns that the table lacks are
    empty in all rows."""
    cells = with_columns_present(df, expected).select(F.col(source).alias("source"), *[clean_text(c).isNull().cast("int").alias(c) for c in expected])
    n = cells.groupBy("source").agg(*[F.sum(c).alias(c) for c in expected], F.count("*").alias("_n"))
    long = n.unpivot(["source", "_n"], expected, "column", "rows").where("rows > 0")
    return long.select("source", F.when(F.col("rows") == F.col("_n"), "EMPTY_COLUMN").otherwise("EMPTY_CELLS").alias("code"), "column", "rows")


def numbered_lines(spark: SparkSession, paths: list[str], encoding: str = "UTF-8") -> DataFrame:
    """Stored (path, line_no, value): the lines of all files in one scan, numbered from 1 in their file, blank ones left out.

    A task numbers what it reads; what the blocks of a file hold, one row a block, is summed before each block.
    """
    at = F.monotonically_increasing_id()
    if encoding.upper().replace("-", "") == "UTF8":
        raw = spark.read.text(paths)
    else:  # the text reader knows UTF-8 alone; a separator that no export has leaves lines whole
        raw = spark.read.schema("value string").option("sep", "\u0001").option("quote", "").option("encoding", encoding).csv(paths)
    lines = raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"), at.alias("_i")).where("trim(value) <> ''")
    lines = materialize(lines, "lines")
    w = W.partitionBy("path").orderBy("_b")
    blocks = lines.groupBy("path", "_b").agg(F.count("*").alias("_n"))
    before = blocks.select("path", "_b", F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("path", "_b").orderBy("_i"))
    return materialize(lines.withColumn("_k", place).join(before, ["path", "_b"]).select("path", (F.col("_before") + F.col("_k")).alias("line_no"), "value"), "numbered-lines")


def read_assets(spark: SparkSession, paths: list[str], aliases: dict[str, list[str]], expected: list[str], sep: str = ";", encoding: str = "UTF-8", ids: tuple[str, ...] = ("object_id", "source_id")) -> DataFrame:
    """Union of CSV exports, all cells text, with source_file, line_no (from 1, the header's) and row_key.

    All files are read in one scan, however many there are. Each file's first line is its header; the driver gets one line a
    file, and from those which cells of a file go to which canonical column: of several aliases the first non-empty cell, in column
    order. row_key is the file and the first non-empty id of the row, or the file and the row's line where it has none; source_file
    is the file's name, or its path where two files share a name. Cells may be quoted, but not hold line breaks; rows without any
    cell are left out, cells beyond the header as well.
    """
    lines = numbered_lines(spark, paths, encoding)
    heads = {r["path"]: r["value"] for r in lines.where("line_no = 1").select("path", "value").collect()}
    wanted = {column_key(a): c for c, names in aliases.items() for a in [c, *names]}
    split = {h: unique_names(next(csv.reader([h], delimiter=sep), [])) for h in set(heads.values())}
    columns = list(dict.fromkeys(wanted.get(column_key(n), n) for p in sorted(heads) for n in split[heads[p]]))
    places = {h: [[i for i, n in enumerate(names) if wanted.get(column_key(n), n) == c] for c in columns] for h, names in split.items()}
    most = max((len(x) for p in places.values() for x in p), default=0)
    width = max(map(len, split.values()), default=0)
    short = [p.rsplit("/", 1)[-1] for p in heads]
    named = [(p, unquote(p.rsplit("/", 1)[-1]) if short.count(p.rsplit("/", 1)[-1]) == 1 else unquote(p), places[h]) for p, h in heads.items()]
    of = spark.createDataFrame(named, "path string, source_file string, _places array<array<int>>")
    if not columns:
        return with_columns_present(of.select("source_file", F.lit(0).cast("long").alias("line_no"), F.lit("").alias("row_key")).where("false"), expected)
    cells = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(width))), {"sep": sep, "mode": "PERMISSIVE"})
    rows = lines.where("line_no > 1").join(of, "path").withColumn("_c", cells).withColumn("_c", F.array(*[clean_text(F.col(f"_c.c{i}")) for i in range(width)]))
    cell = lambda c, k: F.get("_c", F.get(F.get("_places", F.lit(c)), F.lit(k)))
    rows = rows.select("source_file", "line_no", *[F.coalesce(*[cell(i, k) for k in range(most)]).alias(f"_v{i}") for i in range(len(columns))])
    rows = rows.where(reduce(lambda a, b: a | b, [F.col(f"_v{i}").isNotNull() for i in range(len(columns))]))
    out = rows.select(*[F.col(f"_v{i}").alias(c) for i, c in enumerate(columns)], "source_file", "line_no")
    out = with_columns_present(out, expected)
    own = [clean_text(c) for c in ids if c in out.columns]
    line = F.concat(F.lit("line "), F.col("line_no").cast("string"))
    return out.withColumn("row_key", F.concat_ws(":", "source_file", F.coalesce(*own, line)))


#: Rank of the backbone subthemes; any other has rank 4.
RANK = {"rijstrook": 1, "parallelweg": 2, "landbouwpad": 2, "busbaan": 2, "fietspad": 3}


def domain_columns(df: DataFrame) -> DataFrame:
    """df + side in title case (`Unknown` where empty), subtheme_clean, rank, chainage_km, registered_year and registered_month; columns
    that are missing count as empty."""
    d = with_columns_present(df, ["side", "subtheme", "chainage_text", "registered"])
    rank = reduce(lambda w, kv: w.when(normal_text("subtheme") == kv[0], kv[1]), RANK.items(), F.when(F.lit(False), 0)).otherwise(4)
    ym = date_year_month("registered")
    return d.withColumns({
        "side": F.coalesce(F.initcap(clean_text("side")), F.lit("Unknown")), "subtheme_clean": normal_text("subtheme"), "rank": rank, "chainage_km": chainage_km("chainage_text"), "registered_year": ym["year"], "registered_month": ym["month"],
    })


def read_table_below_titles(spark: SparkSession, path: str, aliases: dict[str, list[str]], sep: str = ";", head_lines: int = 25) -> DataFrame:
    """Table of one file whose header stands somewhere in the first lines: the line with most known headers, the first of equals.

    Only those first lines reach the driver. Lines are known by their place in the file's first block, so a later line that
    equals a title stays. Cells may be quoted.
    """
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_b"), at.alias("_i"))
    known = {column_key(a): c for c, names in aliases.items() for a in [c, *names]}
    head = [(r["_i"], r["value"]) for r in lines.where("_b = 0").orderBy("_i").limit(head_lines).collect()]
    if not head:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in aliases))
    split = lambda x: next(csv.reader([x], delimiter=sep), [])
    hits = [sum(column_key(x) in known for x in split(v)) for _, v in head]
    best = max(range(len(head)), key=lambda i: (hits[i], -i))
    names = unique_names(split(head[best][1]))
    cells = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(len(names)))), {"sep": sep, "mode": "PERMISSIVE"})
    body = lines.where((F.col("_b") > 0) | (F.col("_i") > head[best][0])).select(cells.alias("c")).select(*[F.col(f"c.c{i}").alias(n) for i, n in enumerate(names)])
    return drop_empty_rows(canonical_columns(body, aliases))


def read_actions(spark: SparkSession, paths: list[str], aliases: dict[str, list[str]], sep: str = ";") -> DataFrame:
    """A previous action list: rows with a project or a status, under canonical names, numbered within their files (row_no, the header not counted)."""
    rows = read_assets(spark, paths, aliases, ["project", "status", "state", "owner", "remark"], sep, ids=())
    kept = rows.where(clean_text("project").isNotNull() | clean_text("status").isNotNull())
    return kept.withColumn("project_key", project_key("project")).withColumn("row_no", F.col("line_no") - 1).drop("row_key", "line_no")


def read_features(spark: SparkSession, paths: list[str], id_field: str, label_field: str, lines: bool = False) -> DataFrame:
    """Features of landed files, one per id; those without an id are one per label (such as a post's hectometre), or all kept if
    they have neither."""
    f = read_geojson(spark, paths, lines).withColumn("_id", clean_text(F.col("properties")[id_field])).withColumn("_label", clean_text(F.col("properties")[label_field]))
    named = f.where("_id is not null").dropDuplicates(["_id"])
    labelled = f.where("_id is null and _label is not null").dropDuplicates(["_label"])
    return named.unionByName(labelled).unionByName(f.where("_id is null and _label is null")).drop("_id", "_label")


def read_geojson(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """One row per feature: properties (map) and parts (array of lines or rings of (x, y)) of points, lines and areas, also Multi*.

    A feature collection is read in byte ranges by many tasks (feature_texts); with lines=True the files have one feature a line.
    """
    one = "properties map<string,string>, geometry struct<type:string,coordinates:string>"
    if lines:
        f = spark.read.schema(one).json(path)
    else:
        f = feature_texts(spark, [path] if isinstance(path, str) else path).select(F.from_json("value", one).alias("f")).select("f.*")
    f = f.where("geometry is not null").select("properties", F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("c"))
    deep = lambda depth: F.from_json("c", "array<" * depth + "double" + ">" * depth)
    parts = (
        F.when(F.col("kind") == "Point", F.array(F.array(deep(1)))).when(F.col("kind").isin("LineString", "MultiPoint"), F.array(deep(2)))
        .when(F.col("kind") == "MultiPolygon", F.flatten(deep(4))).otherwise(deep(3))
    )
    xy = F.transform(parts, lambda p: F.transform(p, lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))))
    return f.select("properties", "kind", xy.alias("parts"))


def wkt_parts(c: str) -> Column:
    """parts (lines, or rings of areas) of a WKT or EWKT point, line or area, also Multi*; null if the text is none of them."""
    t = F.upper(F.regexp_replace(F.trim(F.col(c), F.lit(" \"'")), r"^(?i)SRID=\d+;\s*", ""))
    body = F.regexp_extract(t, r"^(?:MULTI)?(?:POINT|LINESTRING|POLYGON)\s*Z?\s*\((.*)\)$", 1)
    number = lambda x, i: F.get(x, F.lit(i)).try_cast("double")
    vertex = lambda v: let(F.split(F.trim(v), " "), lambda x: F.struct(number(x, 0).alias("x"), number(x, 1).alias("y")))
    part = lambda r: F.transform(F.split(F.regexp_replace(r, "[()]", ""), ","), vertex)
    ok = lambda parts: F.forall(parts, lambda p: F.forall(p, lambda v: v["x"].isNotNull() & v["y"].isNotNull()))
    # Each step is computed once, however often the next one uses it: patterns are most of the work.
    parts = lambda b: F.when(b != "", F.transform(F.filter(F.split(b, r"\)\s*,\s*\("), lambda x: x != ""), part))
    # Blanks are made single once a text, as a split by a pattern would read the pattern anew for every vertex.
    return let(let(F.regexp_replace(body, r"\s+", " "), parts), lambda p: F.when(ok(p), p))


def _within(parts: Column, x: float, y: float) -> Column:
    return F.forall(parts, lambda p: F.forall(p, lambda v: (F.abs(v["x"]) <= x) & (F.abs(v["y"]) <= y)))


def locate(df: DataFrame, gps: str, rd: str) -> tuple[DataFrame, DataFrame]:
    """(rows with parts in EPSG:28992 and the column they came from, quarantined rows with a reason per geometry column).

    The GPS cell counts if it can be read and lies within the degrees of a globe; otherwise the RD cell does, if it is finite.
    """
    # Exploded, one row each: filters on plain columns would be pushed below them and read every text again.
    both = F.struct(wkt_parts(gps).alias("_g"), wkt_parts(rd).alias("_r"))
    d = with_columns_present(df, [gps, rd])
    d = d.select("*", F.explode(F.array(both)).alias("_p")).select(*d.columns, "_p._g", "_p._r")
    good_g, good_r = F.coalesce(_within(F.col("_g"), 180.0, 90.0), F.lit(False)), F.coalesce(_within(F.col("_r"), 1.7e308, 1.7e308), F.lit(False))
    fault = lambda c, p, far: F.concat(F.lit(f"{c}: "), F.when(clean_text(c).isNull(), "empty").when(F.col(p).isNull(), "unreadable").otherwise(far))
    moved = F.transform("_g", lambda p: F.transform(p, lambda v: to_rd(v["x"], v["y"])))
    d = d.withColumn("_ok_g", good_g).withColumn("_ok_r", good_r)
    valid = d.where("_ok_g or _ok_r").withColumn("parts", F.when(F.col("_ok_g"), moved).otherwise(F.col("_r"))).withColumn("geometry_column", F.when(F.col("_ok_g"), gps).otherwise(rd))
    lost = d.where("not _ok_g and not _ok_r").withColumn("reason", F.concat_ws("; ", fault(gps, "_g", "outside the globe"), fault(rd, "_r", "not finite")))
    return valid.drop("_g", "_r", "_ok_g", "_ok_r"), lost.drop("_g", "_r", "_ok_g", "_ok_r")


def split_valid(df: DataFrame, wkt: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows with parts, quarantined rows with a reason)."""
    d = df.withColumn("parts", wkt_parts(wkt))
    reason = F.when(clean_text(wkt).isNull(), "empty geometry").otherwise("unreadable geometry")
    return d.where("parts is not null"), d.where("parts is null").drop("parts").withColumn("reason", reason)


def to_rd(lon: Column, lat: Column) -> Column:
    """struct(x, y) in EPSG:28992 by the published polynomial (Schreutelkamp and Strang van Hees), good to about 0.25 m.
    Fixed values below: its coefficients as (p, q, value)."""
    dphi, dlam = 0.36 * (lat - 52.15517440), 0.36 * (lon - 5.38720621)
    rx = [(0, 1, 190094.945), (1, 1, -11832.228), (2, 1, -114.221), (0, 3, -32.391), (1, 0, -0.705), (3, 1, -2.340), (1, 3, -0.608), (0, 2, -0.008), (2, 3, 0.148)]
    ry = [(1, 0, 309056.544), (0, 2, 3638.893), (2, 0, 73.077), (1, 2, -157.984), (3, 0, 59.788), (0, 1, 0.433), (2, 2, -6.439), (1, 1, -0.032), (0, 4, 0.092), (1, 4, -0.054)]
    power = lambda v, n: F.lit(1.0) if n == 0 else v if n == 1 else F.pow(v, F.lit(n))
    powers = F.struct(*[power(v, n).alias(f"{k}{n}") for k, v in (("p", dphi), ("l", dlam)) for n in range(5)])
    total = lambda w, base, terms: reduce(lambda a, t: a + F.lit(t[2]) * w[f"p{t[0]}"] * w[f"l{t[1]}"], terms, F.lit(float(base)))
    return let(powers, lambda w: F.struct(total(w, 155000, rx).alias("x"), total(w, 463000, ry).alias("y")))
