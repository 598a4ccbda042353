import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.llm import langid, mixing, packing, pii, quality, shingle_join, toxicity, url_filter, vectors, warc

DOCS = "doc_id long, text string"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def test_packing_round_trip(spark):
    d = docs(spark, ["the cat", None, "", "word " * 9000, "the cat", "A<|endoftext|>b c é"])
    rows = packing.pack_documents(d, salts=4).collect()
    assert packing.pack_documents(d.where("false")).count() == 0
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_file())
    import zlib

    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, t in enumerate(["the cat", None, "", "word " * 9000, "the cat", "A<|endoftext|>b c é"]):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for r in by[i]:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in by[i]) == len(ids)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in places.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096


def test_plan_uses_every_piece_once():
    rng = random.Random(1)
    counts = {rng.randint(1, 60): rng.randint(1, 50) for _ in range(40)}
    plan = packing.plan_packing(counts, 60)
    used = defaultdict(int)
    for items, m in plan.patterns:
        assert sum(items) <= 60 and m > 0
        for x in items:
            used[x] += m
    assert used == counts
    # No packing needs fewer than this: pieces of over half a sequence never share one.
    least = max(-(-sum(k * v for k, v in counts.items()) // 60), sum(v for k, v in counts.items() if k > 30))
    assert plan.sequences <= 1.05 * least + 1


def brute_links(texts, size, pct):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    comp = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= pct * len(a | b):
            x, y = comp[i], comp[j]
            comp = [min(x, y) if c in (x, y) else c for c in comp]
    return [len(s) for s in sets], comp


def test_shingle_join_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    texts = [None, "", "  ", "One", "one", "one two"]
    for n in (3, 8, 9, 12, 15, 22, 40, 120):
        for _ in range(4):
            base = [rng.choice(vocab) for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(3):
                t = list(base)
                for _ in range(rng.randint(0, 2)):
                    t[rng.randrange(len(t))] = rng.choice(vocab)
                texts.append(" ".join(t + ([rng.choice(vocab)] if rng.random() < 0.4 else [])))
    n, comp = brute_links(texts, 4, 85)
    got = sorted(shingle_join.shingle_classes(docs(spark, texts), size=4, pct=85).collect())
    assert [r["n_shingles"] for r in got] == n
    assert [r["component_id"] for r in got] == comp


def test_light_subsets_link_exactly(spark):
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(30), rng.choice([6, 7, 12, 13, 14]))) for _ in range(300)]
    rows = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "sid long, n int, small array<long>")
    edges = {(r["src"], r["dst"]) for r in shingle_join.light_links(rows, 16, 85).collect()}
    comp = list(range(len(sets)))
    def join(c, i, j):
        x, y = c[i], c[j]
        return [min(x, y) if v in (x, y) else v for v in c]
    want = comp
    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = set(sets[i]), set(sets[j])
        if 100 * len(a & b) >= 85 * len(a | b):
            want = join(want, i, j)
    for i, j in edges:
        comp = join(comp, i, j)
    assert comp == want


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 16))
    x[20:40] = x[:20] + rng.normal(size=(20, 16)) * 0.15
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, [0.0] * 16), (101, None), (102, [float("nan")] * 16), (103, rows0 := [float(v) for v in x[0]]), (None, rows0)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.9999).collect()}
    u = {i: np.array(v) for i, v in rows if i is not None and i not in (100, 101, 102)}
    u = {i: v / np.linalg.norm(v) for i, v in u.items()}
    for i in u:
        assert got[i]["n_links"] == sum(u[i] @ u[j] >= 0.95 for j in u) - 1
    assert got[103]["component_id"] == got[0]["component_id"] and not got[103]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (100, 101, 102, None))


def test_warc_round_trip_in_small_ranges(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "http://b", "é" * 50000)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    files = spark.createDataFrame(warc.write_warc(warc.plan_revisits(pages, "page_id", "html").coalesce(1), path).collect())
    for split in (64, 1 << 20):
        got = {r["record_id"][9:]: r for r in warc.read_warc(files, path, split).collect()}
        assert sorted(got) == ["1", "2", "3", "4", "5"]
        assert (got["1"]["record_type"], got["1"]["refers_to"], got["1"]["payload_bytes"]) == ("revisit", "urn:page:2", 4)
        assert got["3"]["record_type"] == "revisit" and got["4"]["payload"] == b""
        assert got["5"]["payload"].decode() == "é" * 50000


def test_url_rules(spark):
    urls = ["http://x.Example.com/en/7817?q", "http://example.com/en/1", "http://example.net/de/8", "ftp://a.b.org/es/#x", "no url", None, "http://com/en/"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for limit in (10, 0):
        got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(d, url_filter.rule_table(spark), broadcast_rules=limit).collect()}
        assert got == {0: ("x.example.com", "example.com/en/7", "allow"), 1: ("example.com", "com/en/", "block"), 2: ("example.net", "example.net/de/8", "block"), 3: ("a.b.org", "org/es/", "block"), 4: ("", None, "allow"), 5: ("", None, "allow"), 6: ("com", "com/en/", "block")}


def test_pii(spark):
    d = docs(spark, ["mail a.b@c.de_f@g.h 1.2.3.4 300.1.1.1 card 4111 1111 1111 1111", "IBAN GB82 WEST 1234 5698 7654 32 +31 (0)20-1234567", None, "\U0001f600 x@y.z " + "1" * 3000])
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"]] for r in pii.find_pii(d).collect()}
    assert [k for k, *_ in found[0]] == ["email", "email", "ip", "card"] and found[2] == []
    assert ("iban", 5, 32) in found[1] and found[1][-1][0] == "phone"
    assert found[3] == [("email", 2, 7)]
    assert pii.redact(pii.find_pii(d)).where("doc_id = 3").first()["text"].startswith("\U0001f600 <email> 1")


def test_quality_bounds(spark):
    got = spark.createDataFrame([(3, 1000), (0, 500), (60, 1000)], "k long, n long").select("k", "n", quality.binomial_tail("k", "n", 0.01).alias("p")).collect()
    from math import comb

    for r in got:
        want = sum(comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1)) if r["k"] < r["n"] * 0.01 else 1
        assert abs(r["p"] - want) < 1e-9
    m = quality.measure_quality(docs(spark, [None, "a b c d e f g h i a b c d e f g h x", "x\nx\n\n y"])).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) for r in m] == [(0, 0, 0), (18, 16, 0), (3, 0, 1)]


def test_quality_cutoffs_pass_where_labels_are_enough(spark):
    rows = [(i, "a" if i < 1000 else "b", (i % 7) / 1000) for i in range(1100)] + [(2000 + i, "ab"[i % 2], 0.9) for i in range(40)]
    measured = spark.createDataFrame([(i, k, v, 0.0, 0.0, 0.1, False) for i, k, v in rows], "doc_id long, stratum string, symbol_share double, dup_line_share double, repeat_share double, odd_word_length double, base_failed boolean")
    labels = spark.createDataFrame([(i, 1 if i < 2000 else 0) for i, *_ in rows], "doc_id long, quality int")
    proven = {r["stratum"]: r for r in quality.prove_rules(measured, labels).collect()}
    assert proven["a"]["passed"] > 0 and proven["a"]["p"] <= 0.05 / 2 and proven["b"]["passed"] == 0 and proven["b"]["cut_symbol_share"] is None
    out = quality.judge_quality(measured, quality.choose_cutoffs(measured, labels)).collect()
    assert {r["doc_id"] for r in out if not r["kept"]} == {i for i, k, v in rows if k == "a" and v == 0.9}


def test_language_and_toxicity(spark):
    rng = random.Random(4)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["quick", "brown", "jumps", "lazy"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dicts = langid.fit_dictionaries(d.where("doc_id < 40"))
    got = langid.identify_language(d.where("doc_id >= 40"), dicts)
    assert got.where("lang <> lang_pred").count() == 0
    assert {r["lang_pred"] for r in langid.identify_language(docs(spark, [None, "12 !", ""]), dicts).collect()} == {"und"}
    train = [({1, 2, i + 10}, 1) if i % 4 == 0 else ({1 + i % 2, i % 7 + 50}, 0) for i in range(400)]
    model = toxicity.fit_fm([r for r, _ in train], np.array([y for _, y in train]), epochs=60, min_docs=2)
    at = {int(t): i for i, t in enumerate(model.terms)}
    s = model.score_rows([np.array(sorted(at[x] for x in r if x in at), np.int64) for r in ({1, 2}, {1}, {2})])
    assert s[0] > 0.5 > max(s[1:])


def test_toxicity_learns_rare_terms():
    # Each toxic row has two telling terms, which stand in four training rows only, among terms of no meaning.
    rng = random.Random(8)
    noise = lambda: set(rng.sample(range(1000, 3000), 20))
    rows = [(noise() | {i % 40, 40 + i * 7 % 40}, 1) for i in range(160)] + [(noise(), 0) for _ in range(1440)]
    model = toxicity.fit_fm([r for r, _ in rows], np.array([y for _, y in rows]))
    at = {int(t): i for i, t in enumerate(model.terms)}
    assert set(at) == set().union(*[r for r, _ in rows])
    score = lambda sets: model.score_rows([np.array([at[t] for t in s], np.int64) for s in sets])
    assert (score([noise() | {i, 40 + i * 7 % 40} for i in range(40)]) >= 0.5).mean() > 0.9 and (score([noise() for _ in range(200)]) >= 0.5).mean() < 0.05


def test_mixing(spark):
    rows = [(i, "big" if i < 300 else f"s{i % 3}", 10) for i in range(360)] + [(999, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    got = mixing.mix_sources(d, max_passes=2.0, target_entropy=0.99).collect()
    seen = defaultdict(int)
    for r in got:
        seen[r["doc_id"]] += 1
    assert set(seen) == {r[0] for r in rows} and max(seen.values()) <= 2 and len(got) > len(rows)
    assert mixing.mix_sources(d.where("false")).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_empty_input(spark, stage):
    import corpus_pipeline

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[stage][1](spark, empty, "").count() == 0
