"""Language identification by compression: the language whose dictionary compresses a text best."""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.text import crc_mod
from roadloom.llm.words import bound_batches, lean

NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def letters_only(text: str | None) -> str:
    """Lower-cased letters with single spaces between; '' for null or no letter."""
    out = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if out.isascii() or not any(c.isnumeric() for c in set(out)):
        return out if any(map(str.isalpha, out)) else ""
    return " ".join("".join(c if c.isalpha() or not c.isnumeric() else " " for c in out).split())


def fit_dictionaries(
    train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_pieces: int = 600, dict_bytes: int = 32 << 10, piece_chars: int = 512, max_languages: int = 1000
) -> dict[str, bytes]:
    """Raw-content dictionary per language from a bounded sample of pieces of whole texts.

    Every text is cut into pieces of piece_chars; of a language's pieces about sample_pieces (all, if it has fewer) are
    drawn by a hash of key and place, so any part of any training text may be drawn. They fill the dictionary in hash order
    up to dict_bytes. Null texts and languages are not learned from, nor texts without a letter; a language with few
    letters gets a short dictionary. More than max_languages languages are an error, none is left out in silence. The
    driver holds sample_pieces * piece_chars characters a language at most. Repeated rows are drawn or left alike.
    """
    t = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(F.col(key), F.octet_length(text)).alias("h"))
    n = F.ceil(F.greatest(F.length("t"), F.lit(1)) / piece_chars)
    sizes = t.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(n).alias("pieces")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages: every text is compressed once for each, so name those that are meant or set max_languages")
    if not sizes:
        return {}
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample_pieces / r["pieces"])))])
    drawn = F.expr("filter(transform(sequence(0, n - 1), i -> named_struct('i', i, 'h', xxhash64('piece', h, i))), x -> pmod(x.h, 1073741824L) / 1073741824D < share)")
    few = t.withColumn("n", n.cast("int")).withColumn("share", share[F.col("lang")]).where("share is not null").select("lang", "t", F.explode(drawn).alias("x"))
    rows = few.select("lang", F.expr(f"substring(t, x.i * {piece_chars} + 1, {piece_chars})").alias("t"), "x.h").collect()
    by: dict[str, list] = {r["lang"]: [] for r in sizes}
    for r in sorted(rows, key=lambda r: (r["h"], r["t"])):
        by[r["lang"]].append(letters_only(r["t"]))
    out = {}
    for k, pieces in by.items():
        body = b""
        for x in dict.fromkeys(p for p in pieces if p):
            body = x.encode() + b" " + body
            if len(body) >= dict_bytes:
                break
        if body:
            out[k] = body[-dict_bytes:].rjust(16)  # zstandard takes no dictionary below eight bytes
    return out


def make_classifier(dictionaries: dict[str, bytes], level: int = 6, block: int = 2048):
    """A function text -> (language, score); see identify_language. Matches of four bytes count: words are short."""
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(level, min_match=4, write_checksum=0, write_content_size=0, write_dict_id=0)
    names = sorted(dictionaries)
    coders = []
    for k in names:
        d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def classify(text):
        raw = letters_only(text).encode()
        if not raw or not names:
            return UNKNOWN, 0.0
        parts = [raw[i : i + block] for i in range(0, len(raw), block)]
        sizes = [sum(len(c.compress(p)) for p in parts) for c in coders]
        best = min(range(len(names)), key=lambda i: (sizes[i], names[i]))
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        return names[best], (second - sizes[best]) / second

    return classify


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = 0.002, level: int = 6) -> DataFrame:
    """docs plus lang_pred, score and lang_rejected; columns of these names are replaced, all others kept.

    The whole text is compressed in 2 KiB blocks with each language's dictionary; the smallest total wins, ties go to the
    first name. score is (second - best) / second. Rejected are margins below min_margin and texts that are null or have
    no letter, which get `und` and score 0. Without dictionaries every text is `und`; with one, its margin is a half. A row
    is judged on its own: repeated rows get equal results, and an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "lang_rejected")

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def judged(texts):
            classify = make_classifier(dictionaries, level)
            for b in texts:
                yield pd.DataFrame([classify(x) for x in b], columns=["lang_pred", "score"])

        yield from lean(judged)(batches)

    out = docs.withColumn("_l", run(F.col(text)))
    out = out.withColumn("lang_pred", F.col("_l.lang_pred")).withColumn("score", F.col("_l.score")).drop("_l")
    return out.withColumn("lang_rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_margin))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents. A null doc_id is in no fold: held_out is null, and the row isn't learned from; null, empty and letterless
    texts are `und`, repeated rows alike; without documents there are no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = crc_mod(F.col("doc_id"), 3)
    dicts = fit_dictionaries(docs.where(fold != 1).select("doc_id", "text", "lang"))
    return identify_language(docs.select("doc_id", "text"), dicts).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "lang_rejected")
