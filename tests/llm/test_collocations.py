"""Collocations against plain counting, with tries and windows small enough to burst, spill and cut."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from roadloom.llm import collocations as co

SMALL = {"burst": 3, "full": 25, "words": 40, "window": 48}


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def pieces(text):
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text))) if w]


def plain(rows, min_count, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = f.setdefault(lang, Counter())
        for w in pieces(text):
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    c[tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if 2 <= len(p) <= 5 and a >= min_count}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        best = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and inside(p, q) for q, b in cand.items()):
                continue
            s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def odd_rows():
    rng = random.Random(7)
    words = ["New", "york", "CITY", "é", "É", "a", "b", "c", "x\x01y", "\xa0", "日本", "hall"]
    rows = []
    for i in range(160):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "  "]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, "und", "with space"]), t))
    rows += [("en", "new york city hall stays " * 9)] * 5 + [("en", None), (None, ""), ("fr", " .\n"), ("en", "a " * 4000), ("xx", "lonely")]
    return rows


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_like_plain_counts(spark, sizes):
    rows = odd_rows()
    df = spark.createDataFrame([(t, g, "clash", 1) for g, t in rows], "text string, lang string, phrase string, n int").repartition(3)
    got = sorted(tuple(r) for r in co.mine_collocations(df, min_count=6, top=30, salts=2, **sizes).collect())
    assert got == plain(rows, 6, 30) and len({g[0] for g in got}) >= 4


def test_empty_and_rare(spark):
    df = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert co.mine_collocations(df).count() == 0
    assert co.mine_collocations(df.where("false")).count() == 0


def test_full_filter_changes_nothing(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(co, "MIN_BITS", 6)
    monkeypatch.setattr(co, "MAX_BITS", 6)
    assert sorted(tuple(r) for r in co.mine_collocations(df, min_count=6, top=30).collect()) == plain(rows, 6, 30)


def test_scores_beyond_64_bits(spark):
    q = spark.sql("select (cast(a as decimal(19)) * cast(n as decimal(19)) * 1000) div (cast(l as decimal(19)) * cast(r as decimal(19))) s from values (900000000000L, 9000000000000L, 1000000000000L, 1100000000000L) t(a, n, l, r)")
    assert q.collect()[0].s == 1000 * 900000000000 * 9000000000000 // (1000000000000 * 1100000000000)


@pytest.mark.parametrize("k", [1, 2, 4, 5])
def test_trie_counts_rows(k):
    rng = np.random.default_rng(k)
    trie, want = co.HatTrie(k, burst=5), Counter()
    got = Counter()

    def take(keep):
        for rows, counts in trie.runs(keep):
            for r, c in zip(rows.tolist(), counts.tolist()):
                got[tuple(r)] += c

    for _ in range(20):
        rows = rng.integers(0, 6, (200, k)).astype(np.int32)
        want.update(map(tuple, rows.tolist()))
        trie.add(*co._distinct(rows))
        assert trie.entries == len({*trie_keys(trie)})
        take(20)
        assert trie.entries <= max(20, 0) or k == 1
    take(0)
    assert trie.entries == 0 and not any(trie.deep.values()) and got == want


def trie_keys(trie):
    for head, c in trie._walk(trie.root, ()):
        for key in c:
            yield head, key


def test_words_of_windows():
    texts = ["One two. three", None, "", "x" * 200, "a  b\tC;d", "", "end no stop"] * 3
    want = [(i, w) for i, t in enumerate(texts) for p in pieces(t) for w in p]
    for window in (1, 7, 30, 10_000):
        got, cuts = [], []
        for w in co.split_words(pa.array(texts), window):
            got += list(zip(w.row.tolist(), w.array().to_pylist()))
            cuts.append(len(set(zip(w.row.tolist(), w.piece.tolist()))))
            assert len({*zip(w.array().to_pylist(), w.hashes.tolist())}) == len(set(w.array().to_pylist())) == len(set(w.hashes.tolist()))
        assert got == want and sum(cuts) == sum(len(pieces(t)) for t in texts)
    assert [w.array().to_pylist() for w in co.split_words(pa.array(texts).slice(3, 2), 1000)] == [["x" * 200, "a", "b", "c", "d"]]
