"""Column functions that clean and parse the text cells of asset and maintenance exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean an empty cell, besides white space.
EMPTY_TEXTS = ["", "nan", "none", "null", "<na>"]
#: Further texts that mean an empty technical attribute.
EMPTY_PROFILE = ["nat", "-", "nvt", "n.v.t."]
#: Chainages from here on stand for "unknown" in exports.
UNKNOWN_CHAINAGE_KM = 90000.0
#: Length of the longest of EMPTY_TEXTS with a line end, which $ lets pass.
_LONGEST_EMPTY = max(map(len, EMPTY_TEXTS)) + 2


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f applied to value, which is computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _trimmed(c) -> Column:
    # Patterns cost most of a reconciliation's time: only texts that they may fit are looked at by them, here and in project_key.
    t = F.trim(col(c).cast("string"))
    return F.when(F.length(t) > _LONGEST_EMPTY, t).otherwise(F.regexp_replace(t, "(?i)^(" + "|".join(EMPTY_TEXTS[1:]) + ")$", ""))


def clean_text(c) -> Column:
    """Trimmed text, null where the cell is empty in content."""
    return F.nullif(_trimmed(c), F.lit(""))


def display_text(c) -> Column:
    """Clean text without a trailing .0, unless it has letters; '' for empty."""
    return F.coalesce(F.regexp_replace(_trimmed(c), r"^([^\p{L}]*)\.0$", "$1"), F.lit(""))


def normal_text(c) -> Column:
    return F.coalesce(F.lower(clean_text(c)), F.lit(""))


def chainage_km(c) -> Column:
    """Kilometres with decimal comma or point; null if it can't be read or stands for unknown."""
    v = F.replace(clean_text(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(v < UNKNOWN_CHAINAGE_KM, v)  # NaN is greater than any number


def positive_number(c) -> Column:
    """Dutch or English notation, units and words stripped: 1.234,56 and 1,234.56 are equal; null if negative or no number."""
    text = F.regexp_replace(F.regexp_replace(display_text(c), "m²|m2|meter", ""), "[^0-9,.\\-]", "")

    def plain(t):
        dutch = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
        comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
        return (
            F.when(comma & dot & dutch, F.translate(t, ",.", "."))
            .when(comma & dot, F.translate(t, ",", ""))
            .otherwise(F.translate(t, ",", "."))
        )

    v = let(text, plain).try_cast("double")
    return F.when(v >= 0, v)


def numbers_in(c) -> Column:
    """All numbers in a text, decimal comma or point, in order."""
    found = F.regexp_extract_all(display_text(c), F.lit(r"\d+(?:[,.]\d+)?"), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def date_year_month(c) -> Column:
    """struct(year, month): a bare year has month 0; compact stamps of 8, 12 and 14 digits; day-first and ISO dates; else a
    leading year; (0, 0) if nothing fits."""
    return let(display_text(c), _year_month)


def _year_month(t: Column) -> Column:
    compact = F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd"))).when(t.rlike(r"^\d{12}$"), F.try_to_timestamp(t, F.lit("yyyyMMddHHmm"))).when(t.rlike(r"^\d{14}$"), F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")))
    head = F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})", 1)
    dated = F.when(head.rlike(r"^\d{4}-"), F.try_to_timestamp(head, F.lit("y-M-d"))).when(head != "", F.try_to_timestamp(F.regexp_replace(head, "[/.]", "-"), F.lit("d-M-y")))
    ts = F.coalesce(compact, dated)
    year = F.regexp_extract(t, r"^(\d{4})", 1).try_cast("int")
    y = F.when(t.rlike(r"^\d{4}$"), t.try_cast("int")).otherwise(F.coalesce(F.year(ts), year, F.lit(0)))
    m = F.when(t.rlike(r"^\d{4}$"), F.lit(0)).otherwise(F.coalesce(F.month(ts), F.lit(0)))
    return F.struct(y.alias("year"), m.alias("month"))


def safe_int(c) -> Column:
    """12 and 12.0 give 12; else null."""
    v = clean_text(c).try_cast("double")
    return F.when(~F.isnan(v), v.try_cast("bigint"))


def profile_value(c) -> Column:
    """A technical attribute: '' for empty tokens, whole numbers without decimals."""
    def value(t):
        v = F.translate(t, ",", ".").try_cast("double")
        whole = F.when((F.abs(v) < 9e15) & (v == F.floor(v)), v.cast("bigint").cast("string"))
        return F.when(F.lower(t).isin(EMPTY_TEXTS + EMPTY_PROFILE), "").otherwise(F.coalesce(whole, t))

    return let(display_text(c), value)


def project_key(c) -> Column:
    """Project name for comparison: one kind of dash, no blanks around it, single blanks, upper case; '' for empty."""
    t = display_text(c)
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[–—−]", "-"), r"\s*-\s*", "-"), r"\s+", " ")
    return F.upper(F.when(t.rlike(r"[\s–—−]"), spaced).otherwise(t))


def object_key(c) -> Column:
    """Object number for comparison: upper case without blanks; '' for empty."""
    return F.regexp_replace(F.upper(display_text(c)), r"\s+", "")


def road_in(c) -> Column:
    """First N-number of three or four digits that stands as a word, else ''."""
    return F.regexp_extract(F.upper(display_text(c)), r"\b(N\d{3,4})\b", 1)


def split_ids(c) -> Column:
    """Distinct non-empty ids of a list separated by ; , or |, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(display_text(c), "[;,|]"), lambda x: F.trim(x)), lambda x: x != ""))


def preview(values: Column, most: int = 6) -> Column:
    """Distinct non-empty texts of an ordered array, the first `most` of them, then (+rest)."""
    v = F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))
    rest = F.size(v) - most
    return F.concat(F.array_join(F.slice(v, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(" (+"), rest.cast("string"), F.lit(")"))).otherwise(""))
