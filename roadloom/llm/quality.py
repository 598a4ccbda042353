"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules are fixed. The method adds cutoffs on further measures: one joint rule of a cutoff per measure may be used in a
stratum only if an exact binomial bound on labelled holdout documents shows that it rejects at most a share alpha of good
documents. Rules are tested from loosest to strictest up to the first failure, which needs no correction for their number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.shared import materialize
from roadloom.llm.text import SPACE

WINDOW = 8
#: Measures that the method puts cutoffs on; larger is worse.
MEASURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "odd_word_length": "abs(ln(greatest(word_chars, 1) / greatest(n_words, 1) / 5.0))",
}
#: Rules from loosest to strictest: shares of the way from good documents' largest value to that of all, then quantiles of good ones.
LOOSE = [0.5, 0.25, 0.125, 0.0625, 0.03125, 0.015625]
QUANTILES = [0.9995, 0.999, 0.998, 0.995, 0.99]


def repeat_words(words: str, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of `window` words occurring twice or more, the first occurrence included.

    Windows are 64-bit hashes. Texts whose windows are all different, most of them, are told by the number of distinct
    hashes; for the others, equal neighbours among the sorted (hash, position) mark the windows, and a sweep over their
    sorted positions adds up the words covered.
    """
    k = window
    hashes = f"transform(sequence(1, size({words}) - {k - 1}), i -> xxhash64(slice({words}, i, {k})))"
    same = "filter(array_sort(transform(h, (x, i) -> named_struct('x', x, 'i', i))), x -> true)"
    marked = (
        f"transform(array({same}), s -> filter(transform(s, (v, j) -> case when (j > 0 and s[greatest(j - 1, 0)].x = v.x) "
        "or (j < size(s) - 1 and s[least(j + 1, size(s) - 1)].x = v.x) then v.i end), p -> p is not null))[0]"
    )
    cover = f"aggregate(array_sort({marked}), named_struct('n', 0L, 'e', 0), (a, p) -> named_struct('n', a.n + (p + {k} - greatest(a.e, p)), 'e', p + {k}), a -> a.n)"
    return F.expr(f"case when size({words}) > {k} then transform(array({hashes}), h -> case when size(array_distinct(h)) = size(h) then 0L else {cover} end)[0] else 0L end")


def measure_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, plus n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long), base_failed
    and the method's measures. Null and empty texts have zeros and fail. Same-named columns are replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", *MEASURES]
    t = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in docs.columns if c not in names and c != text]
    d = docs.select(*rest, t.alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select(*rest, F.array_remove(F.split("_t", SPACE), "").alias("_w"), (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"), F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("u")))[0].alias("_l"))
    d = d.select(
        *rest, F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), "n_symbols", (F.col("_l.n") - F.col("_l.u")).alias("n_dup_lines"),
        F.col("_l.n").alias("n_lines"), repeat_words("_w").alias("n_repeat_words"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return d.withColumns({k: F.expr(v).cast("double") for k, v in MEASURES.items()})


def binomial_tail(k: str, n: str, alpha: float) -> Column:
    """P(X <= k) for X ~ Bin(n, alpha), exactly, summed in logarithms; 1 where k >= n * alpha, as no bound can pass there."""
    up = math.log(alpha / (1 - alpha))
    sum_up = (
        f"aggregate(sequence(1L, {k}), named_struct('t', {n} * ln({1 - alpha!r}D), 's', {n} * ln({1 - alpha!r}D)), (a, i) -> named_struct("
        f"'t', a.t + ln(({n} - i + 1) / i) + {up!r}D, 's', greatest(a.s, a.t + ln(({n} - i + 1) / i) + {up!r}D) + "
        f"ln(1 + exp(-abs(a.s - (a.t + ln(({n} - i + 1) / i) + {up!r}D))))), a -> least(1D, exp(a.s)))"
    )
    return F.expr(f"case when {k} >= {n} * {alpha!r}D then 1D when {k} = 0 then exp({n} * ln({1 - alpha!r}D)) else {sum_up} end")


def prove_rules(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "stratum", label: str = "quality", alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """(stratum, pooled, rules, passed, n, rejected, p, one cutoff per measure): how far each stratum's joint rules were proven safe.

    Documents are split by a hash of the key. One half proposes rules, nested from loose to strict: cutoffs between the largest
    value of all documents and of good ones (label 1), then quantiles of the good ones; values above are rejected. The good
    ones of the other half test them in this order, each at delta over the number of strata, and the first failure ends it,
    so with probability 1 - delta no stratum's rule rejects more than alpha of its good documents. n, rejected and p are of
    the strictest rule passed, or of the first one where none passes; cutoffs are null there.

    A stratum with fewer good test documents than ln(delta / strata) / ln(1 - alpha) can't prove any rule alone. Such strata are
    pooled and tested as one: the bound then holds for the pool, not for each of its strata. Strata without any good test document get no rule.
    Keys labelled twice count once, by their smaller label; null labels, keys and strata don't count.
    """
    names = list(MEASURES)
    half = F.crc32(F.concat_ws("/", F.lit("half"), F.col(key).cast("string")).cast("binary")) % 2
    lab = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_y")).where("_y = 1").select(key)
    known = measured.where(F.col(stratum).isNotNull()).select(key, stratum, *names, half.alias("half"))
    good = materialize(known.join(lab, key, "left_semi"), "quality-good")
    sizes = good.where("half = 1").groupBy(stratum).agg(F.count("*").alias("_n"))
    need = math.log(delta / max(sizes.count(), 1)) / math.log(1 - alpha)
    # Groups are strata by themselves, or the pool: (its flag, the stratum or null).
    alone = F.col("_n") >= math.ceil(need)
    groups = materialize(sizes.select(stratum, (~alone).alias("pooled"), F.when(alone, F.col(stratum)).alias("member")), "quality-groups")
    by = ["pooled", "member"]
    known, good = known.join(groups, stratum), materialize(good.join(groups, stratum), "quality-grouped")
    widest = known.where("half = 0").groupBy(*by).agg(*[F.max(m).alias(f"top_{m}") for m in names])
    own = good.where("half = 0").groupBy(*by).agg(*[F.percentile_approx(m, [1.0, *QUANTILES], 10000).alias(f"own_{m}") for m in names])
    same = lambda x, y: x["pooled"].eqNullSafe(y["pooled"]) & x["member"].eqNullSafe(y["member"])
    cut = lambda m: F.concat(*[F.array(F.col(f"own_{m}")[0] + f * (F.col(f"top_{m}") - F.col(f"own_{m}")[0])) for f in LOOSE], F.col(f"own_{m}"))
    grid = own.join(widest, same(own, widest)).select(own["pooled"], own["member"], *[cut(m).alias(f"c_{m}") for m in names])
    grid = materialize(grid, "quality-grid")
    tested = grid.count()
    rules = len(LOOSE) + 1 + len(QUANTILES)
    # Rules are nested, so the first one that rejects a document tells all that do.
    first = F.array_min(F.array(*[F.coalesce(F.array_min(F.expr(f"transform(c_{m}, (c, i) -> if({m} > c, i, null))")), F.lit(rules)) for m in names]))
    probe = good.where("half = 1").select("pooled", "member", *names)
    seen = probe.join(grid, same(probe, grid)).groupBy(grid["pooled"], grid["member"], first.alias("first")).agg(F.count("*").alias("m"))
    seen = seen.groupBy(*by).agg(F.sum("m").alias("n"), F.collect_list(F.struct("first", "m")).alias("firsts"))
    each = seen.select(*by, "n", F.explode(F.expr(f"transform(sequence(0, {rules - 1}), r -> struct(r as rule, aggregate(firsts, 0L, (a, x) -> a + if(x.first <= r, x.m, 0L)) as k))")).alias("t")).select(*by, "n", "t.rule", F.col("t.k").alias("k"))
    each = each.withColumn("p", binomial_tail("k", "n", alpha))
    # The count rejected grows with the rule, and p with it: those that pass come before the first failure.
    ok = F.col("p") <= delta / max(tested, 1)
    got = each.groupBy(*by).agg(F.first("n").alias("n"), F.count_if(ok).alias("passed"), F.array_sort(F.collect_list(F.struct("rule", "k", "p"))).alias("ts"))
    at = F.get("ts", F.greatest(F.col("passed") - 1, F.lit(0)).cast("int"))
    got = got.select(F.col("pooled").alias("_p"), F.col("member").alias("_m"), "n", "passed", "ts")
    full = grid.join(got, grid["pooled"].eqNullSafe(got["_p"]) & grid["member"].eqNullSafe(got["_m"]), "left").withColumns({"passed": F.coalesce("passed", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
    full = full.select(F.col("pooled").alias("_p"), F.col("member").alias("_m"), "passed", "n", at["k"].alias("rejected"), at["p"].alias("p"), *[F.when(F.col("passed") > 0, F.get(f"c_{m}", (F.col("passed") - 1).cast("int"))).alias(f"cut_{m}") for m in names])
    out = groups.join(full, groups["pooled"].eqNullSafe(full["_p"]) & groups["member"].eqNullSafe(full["_m"]), "left")
    return out.select(stratum, "pooled", F.lit(rules).alias("rules"), F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("n", F.lit(0)).alias("n"), "rejected", "p", *[f"cut_{m}" for m in names])


def choose_cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "stratum", label: str = "quality", alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """(stratum, one cutoff per measure) of the strictest joint rule proven safe; strata without one are left out.

    Strata with few labels share the rule of their pool; see prove_rules."""
    return prove_rules(measured, labels, key, stratum, label, alpha, delta).where("passed > 0").select(stratum, *[f"cut_{m}" for m in MEASURES])


def judge_quality(measured: DataFrame, cutoffs: DataFrame, stratum: str = "stratum", broadcast_rows: int = 100_000) -> DataFrame:
    """measured plus kept: false if base_failed or a measure is above its stratum's cutoff. Strata without cutoffs and
    null strata keep all that the base rules keep. Cutoffs are broadcast up to broadcast_rows rows, counted first."""
    cutoffs = materialize(cutoffs, "quality-cutoffs")
    side = F.broadcast(cutoffs) if cutoffs.count() <= broadcast_rows else cutoffs
    out = measured.drop("kept").join(side, stratum, "left")
    over = [F.coalesce(F.col(m) > F.col(f"cut_{m}"), F.lit(False)) for m in MEASURES]
    bad = over[0]
    for o in over[1:]:
        bad = bad | o
    return out.withColumn("kept", ~F.col("base_failed") & ~bad).drop(*[f"cut_{m}" for m in MEASURES])


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("stratum"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    measured = materialize(measure_quality(docs), "quality")
    out = judge_quality(measured, choose_cutoffs(measured, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
