"""Column functions on the domain's codes: families, sides, object layers, post values, profiles written as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.names import type_family
from roadloom.functions.text import col, display_text, let, normal_text

#: The project family of each backbone subtheme.
SUBTHEME_FAMILY = {"rijstrook": "HRB", "parallelweg": "PW", "fietspad": "FP", "busbaan": "BB", "landbouwpad": "LBP"}
#: Texts that name a side, apart from those that hold the word.
LEFT, RIGHT = ["l", "li"], ["r", "re"]
#: Words that mark a special object, with the label that stands for it.
SPECIAL = [
    ("rotonde", ["rotonde", "turborotonde", "ovonde"]), ("kruispunt", ["kruispunt", "kruising"]), ("aansluiting", ["aansluiting", "oprit", "afrit"]), ("brug", ["brug", "brugdek", "beweegbare brug"]),
    ("tunnel", ["tunnel", "onderdoorgang"]), ("viaduct", ["viaduct"]), ("aquaduct", ["aquaduct"]), ("spoorwegovergang", ["spoorwegovergang", "overweg"]),
]


def subtheme_family(c) -> Column:
    """Family of a backbone subtheme, '' for any other."""
    t = normal_text(c)
    return F.coalesce(reduce(lambda w, kv: w.when(t == kv[0], kv[1]), SUBTHEME_FAMILY.items(), F.when(F.lit(False), "")), F.lit(""))


def side_code(c) -> Column:
    """L, R, LR or '' of a side text in words or letters."""
    t = normal_text(c)
    left, right = F.contains(t, F.lit("links")) | t.isin(LEFT), F.contains(t, F.lit("rechts")) | t.isin(RIGHT)
    return F.when(left & right, "LR").when(left, "L").when(right, "R").when(F.replace(t, F.lit(" "), F.lit("")) == "lr", "LR").otherwise("")


def object_type(category: Column, subtheme, side) -> Column:
    """struct(type, family, side) of an object: that of its project's type code, else of its subtheme and side; a main
    carriageway takes no LR."""
    own, fam, sd = type_family(category), subtheme_family(subtheme), side_code(side)
    taken = F.when((fam == "HRB") & (sd == "LR"), "").otherwise(sd)
    derived = F.struct(F.when(fam == "", "").otherwise(F.concat(fam, taken)).alias("type"), fam.alias("family"), F.when(fam == "", "").otherwise(sd).alias("side"))
    named = F.struct(F.upper(display_text(category)).alias("type"), own["family"].alias("family"), own["side"].alias("side"))
    return F.when(own["family"] != "", named).otherwise(derived)


def category_family(df: DataFrame, category: str, variants: DataFrame) -> DataFrame:
    """df + family: that of the configured variant (variants: family, variant; each family is its own variant), else the
    longest family that the code begins with, else the code without a last L or R.

    variants is a rule table of a few rows; it is joined twice by equality: on the code, and on the code's beginnings.
    """
    v = variants.select(F.upper("family").alias("_f"), F.upper("variant").alias("_v"))
    v = v.union(v.select("_f", F.col("_f"))).distinct().groupBy("_v").agg(F.min("_f").alias("_f"))
    heads = v.where("_f = _v").select(F.col("_v").alias("_h"))
    code = F.upper(display_text(category))
    d = df.withColumn("_code", code)
    codes = d.select("_code").distinct()
    begins = codes.select("_code", F.explode(F.expr("transform(sequence(1, greatest(length(_code), 1)), i -> substring(_code, 1, i))")).alias("_h")).join(heads, "_h").groupBy("_code").agg(F.max_by("_h", F.length("_h")).alias("_p"))
    known = codes.join(v.withColumnRenamed("_v", "_code"), "_code", "left").join(begins, "_code", "left").select("_code", F.coalesce("_f", "_p", F.regexp_replace("_code", "[LR]$", "")).alias("family"))
    return d.drop("family").join(known, "_code", "left").drop("_code")


def post_km(c) -> Column:
    """Kilometre of a post value: tenths where it is whole or 100 and more, kilometres otherwise; null if negative or no number."""
    def km(v):
        return F.when((v >= 0) & ~F.isnan(v) & (v < float("inf")), F.when((v >= 100) | (v == F.floor(v)), v / 10).otherwise(v))

    return let(F.replace(display_text(c), F.lit(","), F.lit(".")).try_cast("double"), km)


def meter_value(km, fallback_m=None) -> Column:
    """Chainage in metres of a kilometre value, whole where it is within a millimetre of it; else the fallback's metres."""
    m = F.coalesce(col(km) * 1000.0, col(fallback_m) if fallback_m is not None else F.lit(None).cast("double"))
    return F.when(F.abs(m - F.round(m)) < 0.001, F.round(m)).otherwise(F.round(m, 3))


def parse_profile(c) -> Column:
    """Map of a `field=value, field=value` text; parts without = are left out, of a repeated field the last one counts."""
    parts = F.filter(F.split(display_text(c), ","), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def sheet_class(type_, family, name) -> Column:
    """HRB, FP or PW: the sheet on which a proposal is noted; anything but main carriageways and cycle paths goes to PW."""
    t, f, n = (F.upper(F.coalesce(col(x), F.lit(""))) for x in (type_, family, name))
    return F.when(F.contains(F.concat_ws(" ", t, f, n), F.lit("FP")), "FP").when(F.startswith(t, F.lit("HRB")) | (f == "HRB") | F.contains(n, F.lit("-HRB")), "HRB").otherwise("PW")


def special_object(text, name) -> Column:
    """What a special object is called, by the first kind whose words its text holds: its name if that holds one of them, else
    the kind; null if it is none."""
    def called(x):
        low, own = x["low"], x["own"]
        hit = lambda t, words: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
        kinds = F.array(*[F.when(hit(low, words), F.struct(F.lit(kind).alias("kind"), hit(F.lower(own), words).alias("named"))) for kind, words in SPECIAL])
        first = F.get(F.filter(kinds, lambda k: k.isNotNull()), F.lit(0))
        return let(first, lambda k: F.when(k["named"], own).otherwise(k["kind"]))

    return let(F.struct(F.lower(F.coalesce(col(text), F.lit(""))).alias("low"), display_text(name).alias("own")), called)


def object_layer(subtheme, exempt: Column, backbone: list[str] | tuple[str, ...]) -> Column:
    """exempt, primary or secondary: how heavily an object counts on a control map."""
    return F.when(exempt, "exempt").when(normal_text(subtheme).isin(list(backbone)), "primary").otherwise("secondary")


def of_road(df: DataFrame, columns: list[str], road: str) -> DataFrame:
    """Rows of which any of the columns names the road: N354, 354, 354.0 and WA-N354_1 are one road. Missing columns are passed over."""
    want = road_number(F.lit(road))
    here = [c for c in columns if c in df.columns]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(road_number(c) == want, F.lit(False)) for c in here], F.lit(False)))


def road_number(c) -> Column:
    """Digits of a road's number without leading zeros, from an N-number anywhere in the text or a plain number; null without one."""
    t = F.upper(display_text(c))
    digits = F.coalesce(F.nullif(F.regexp_extract(t, r"N(\d{1,4})(?:\D|$)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^0*(\d{1,4})$", 1), F.lit("")))
    return digits.try_cast("int").cast("string")
