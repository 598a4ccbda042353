"""Personal data in texts: regular expressions propose, checksums confirm, context words adjust the score.

DataFrame functions only. A pattern's matches and the text between them (regexp_extract_all and split by the same
pattern) give positions by a running sum of lengths, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in the order that breaks ties of equal starts. Loops are possessive and start at the head of their run
#: (or where the last match ended): that changes no match, and keeps long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # What stands behind a name such as token and = or :, and keys that are known by how they begin.
    "secret": r"(?<=(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\x22\x27]?\x20{0,3}[:=]\x20{0,3}[\x22\x27]?)[A-Za-z0-9_/+=.-]{16,512}+"
    r"|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}+|xox[abprs]-[A-Za-z0-9-]{10,250}+)(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
}
#: A cheap test that any text with a match passes; others skip the pattern.
GATE = {
    "email": "contains({t}, '@')", "ip": r"{t} rlike r'[0-9]\.[0-9]+\.[0-9]'", "card": r"{t} rlike r'[0-9](?:[\x20-]?[0-9]){{11}}'", "phone": "contains({t}, '+')",
    "iban": r"{t} rlike r'[A-Z]{{2}}[0-9]{{2}}'", "ssn": r"{t} rlike r'[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}'",
    "secret": r"{t} rlike r'(?i:token|secret|passw|key)[^A-Za-z0-9]{{1,9}}[A-Za-z0-9_/+=.-]{{16}}|AKIA|gh[pousr]_|xox[abprs]-|PRIVATE KEY'",
}
#: Prior score of a confirmed match, and words before it (within 40 characters) that raise it by 0.3.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.6, "phone": 0.6, "iban": 0.7, "ssn": 0.4, "secret": 0.7}
CONTEXT = {
    "email": "mail|contact|write|reply", "ip": "ip|host|server|address|from", "card": "card|visa|credit|pay|karte|carte|tarjeta", "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta", "ssn": "ssn|social security", "secret": "secret|token|key|auth|password",
}
KINDS = [*BASE, *ADDED]

DIGITS = "regexp_replace({m}, '[^0-9]', '')"
LUHN = (
    "aggregate(sequence(1, length({d})), 0, (a, i) -> a + (case when i % 2 = 1 then int(substring({d}, length({d}) - i + 1, 1)) "
    "else int(substring({d}, length({d}) - i + 1, 1)) * 2 - (case when int(substring({d}, length({d}) - i + 1, 1)) > 4 then 9 else 0 end) end)) % 10 = 0"
)
MOD97 = (
    "aggregate(split(concat(substring({c}, 5), substring({c}, 1, 4)), ''), 0, (a, x) -> case when x = '' then a when x between '0' and '9' then (a * 10 + int(x)) % 97 "
    "else (a * 100 + ascii(x) - 55) % 97 end) = 1"
)


def confirm_sql(kind: str, m: str) -> str:
    """SQL condition that confirms a match m of the kind."""
    d = DIGITS.format(m=m)
    if kind == "ip":
        return f"forall(split({m}, '[.]'), p -> length(ltrim('0', p)) < 4 and int(concat('0', ltrim('0', p))) <= 255)"
    if kind == "card":
        return f"(length({d}) between 12 and 19 and exists(array({d}), d -> {LUHN.format(d='d')}))"
    if kind == "phone":
        return f"length({d}) between 9 and 15"
    if kind == "iban":
        return f"exists(array(replace({m}, ' ', '')), c -> length(c) between 15 and 34 and {MOD97.format(c='c')})"
    if kind == "secret":
        return f"({m} like '-----BEGIN%' or ({m} rlike '[0-9]' and {m} rlike '[A-Za-z]' and size(array_distinct(split({m}, ''))) >= 8))"
    if kind == "ssn":
        return f"not ({m} rlike '^(000|666|9)|-00-|-0000$')"
    return "true"


SPAN = "struct<start:int,ord:int,end:int,kind:string,score:double>"


#: Length of the stretches in which running values are folded; any length gives the same values.
STRETCH = 256


def running(items: str, start: str, kind: str, step: str, keep: str) -> str:
    """SQL for the array of `keep` at each element x of items, while s runs on by `step` from `start` (of SQL type kind).

    A fold that appends copies its array at each step. Elements are therefore folded in stretches of STRETCH, whose arrays
    are then joined: n elements cost about n * STRETCH / 2 + (n / STRETCH)^2 / 2 copies.
    """
    inner = (
        f"aggregate(slice(v, c * {STRETCH} + 1, {STRETCH}), named_struct('s', a.s, 'o', cast(array() as array<{kind}>)), "
        f"(b, x) -> named_struct('s', transform(array(b.s), s -> {step})[0], 'o', array_append(b.o, transform(array(b.s), s -> {keep})[0])))"
    )
    return (
        f"transform(array({items}), v -> aggregate(sequence(0, cast(ceil(size(v) / {STRETCH}) as int)), named_struct('s', cast({start} as {kind}), 'o', cast(array() as array<array<{kind}>>)), "
        f"(a, c) -> transform(array({inner}), i -> named_struct('s', i.s, 'o', array_append(a.o, i.o)))[0], a -> flatten(a.o)))[0]"
    )


def spans_sql(kind: str, text: str) -> str:
    """SQL for the confirmed spans of one kind in a non-null text."""
    pattern = {**BASE, **ADDED}[kind]
    gate = GATE[kind].format(t=text)
    score = f"{PRIOR[kind]}D + case when lower(right(x.p, 40)) rlike '{CONTEXT[kind]}' then 0.3D else 0D end"
    item = f"named_struct('start', x.a, 'ord', {KINDS.index(kind)}, 'end', x.a + length(x.m), 'kind', '{kind}', 'score', least(1D, {score}))"
    ends = running("m", "0", "int", "s + length(x.p) + length(x.m)", "s + length(x.p)")
    # The last part of the text has no match behind it.
    pairs = f"transform(array(zip_with(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0), (p, m) -> named_struct('p', p, 'm', m))), w -> filter(w, x -> x.m is not null))[0]"
    placed = f"transform(array({pairs}), m -> zip_with(m, {ends}, (x, a) -> named_struct('p', x.p, 'm', x.m, 'a', a)))[0]"
    return f"""case when {gate} then transform(filter({placed}, x -> {confirm_sql(kind, 'x.m')}), x -> {item}) else cast(array() as array<{SPAN}>) end"""


def find_pii(docs: DataFrame, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """docs plus pii, an array of (start, ord, end, kind, score) over the whole text in order of start, then kind.

    The four base kinds (email, ip, card, phone) are leftmost non-overlapping matches per kind whose checks pass; they
    stay whatever their score. Of the added kinds (iban with mod-97, ssn, secret) those of min_score or more stay. Positions
    count code points, ends are exclusive; spans of different kinds may overlap. Null and empty texts have an empty
    array. A column named pii is replaced; all others, and repeated rows, are kept.
    """
    docs = docs.drop("pii")
    t = "coalesce(cast(`" + text.replace("`", "``") + "` as string), '')"
    cols = {f"_pii_{k}": F.expr(spans_sql(k, t)) for k in KINDS}
    added = F.filter(F.concat(*[F.col(f"_pii_{k}") for k in ADDED]), lambda s: s["score"] >= min_score)
    found = docs.withColumns(cols).withColumn("pii", F.array_sort(F.concat(*[F.col(f"_pii_{k}") for k in BASE], added)))
    return found.drop(*cols)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


PIECE = 4096


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", pii: str = "pii") -> DataFrame:
    """Replace the spans in text by <kind>; overlapping spans become one, named after the first. length, where docs has
    it, becomes the new number of characters of the changed texts. Null texts stay null, repeated rows stay repeated, an
    empty table stays empty, other columns are kept."""
    t, q = F.col(text), "`" + text.replace("`", "``") + "`"
    spans = f"`{pii}`"
    # A span is fresh if it starts where all spans before it have ended; the others belong to the one before.
    before = running(spans, "0", "int", "greatest(s, x.end)", "s")
    fresh = f"filter(zip_with({spans}, {before}, (x, e) -> named_struct('a', x.start, 'e', e, 'kind', x.kind)), x -> x.a >= x.e)"
    # Text between spans is cut out of pieces, so that a cut costs its own length, not that of the text before it.
    pieces = f"regexp_extract_all({q}, '(?s).{{1,{PIECE}}}', 0)"
    cut = f"substring(array_join(slice(ps, x.e div {PIECE} + 1, x.a div {PIECE} - x.e div {PIECE} + 1), ''), x.e % {PIECE} + 1, x.a - x.e)"
    last = f"aggregate({spans}, 0, (a, x) -> greatest(a, x.end))"
    tail = f"transform(array({last}), e -> substring(array_join(slice(ps, cast(e div {PIECE} + 1 as int), size(ps) + 1), ''), cast(e % {PIECE} + 1 as int)))[0]"
    new = F.expr(f"transform(array({pieces}), ps -> concat(array_join(transform({fresh}, x -> concat({cut}, '<', x.kind, '>')), ''), {tail}))[0]")
    out = docs.withColumn("_new", F.when(t.isNull() | (F.size(pii) == 0), t).otherwise(new))
    if length and length in docs.columns:
        out = out.withColumn(length, F.when(F.size(pii) > 0, F.length("_new").cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.withColumn(text, F.col("_new")).drop("_new")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["ord"] < len(BASE))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))
