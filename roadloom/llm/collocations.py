"""Collocations: phrases that occur more often than their parts make likely, counted exactly with HAT-tries inside tasks.

First phrases are screened length by length: a phrase can be frequent only if its parts are, so each length counts hashes of what the
last one left open, and those that reach the threshold go into a filter. Then one pass counts the phrases that pass the filters,
exactly: a task counts in tries over word ids with hash containers at their leaves (Askitis and Sinha, 2007), which burst into a
deeper node when they grow; when they are full their largest subtrees leave as sorted runs. Runs are merged by Spark, partitioned by
what phrases begin with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.shared import materialize
from roadloom.llm.text import read
from roadloom.llm.words import bound_batches, lean

#: Bytes of text that are split into words at once.
WINDOW = 4 << 20
#: Entries at which a container bursts, at which tries spill or hashes are handed on, and words that a task knows by number before it starts anew.
BURST, FULL, WORDS = 4096, 1_000_000, 1_000_000
#: Bits of a filter of frequent phrases: sixteen a phrase, but at most 2 ** 27 (16 MB). A fuller filter lets more phrases be counted; results stay.
MIN_BITS, MAX_BITS = 16, 27
#: Phrase hashes have 52 bits; a filter is asked at their lower bits and at those from this one on.
SECOND = 25
RUN_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
#: Fixed by the definition of pieces and words: piece ends, then spaces.
PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(PIECE_ENDS)], _KIND[list(SPACES)] = 2, 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class HatTrie:
    """Counts of rows of k word ids. A node is a dict: of containers by the next id (an int), or, at a leaf, of counts by the bytes of the ids left."""

    def __init__(self, k: int, burst: int = BURST):
        self.k, self.burst, self.entries = k, burst, 0
        self.root: dict = {}
        self.deep: dict[int, dict] = {}  # nodes that have burst, by identity
        self.depth = min(k - 1, 2)

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct rows in lexicographic order, with counts."""
        self._add(self.root, rows, counts, 0)

    def _add(self, node: dict, rows: np.ndarray, counts: np.ndarray, at: int) -> None:
        if id(node) in self.deep:
            ids = rows[:, at]
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                self._add(node.setdefault(int(ids[a]), {}), rows[a:b], counts[a:b], at + 1)
            return
        before = len(node)
        for key, c in zip(_keys(rows[:, at:]), counts.tolist()):
            node[key] = node.get(key, 0) + c
        self.entries += len(node) - before
        if len(node) > self.burst and at < self.depth:
            rest, n = _rows(list(node), self.k - at), np.fromiter(node.values(), np.int64, len(node))
            order = np.lexsort(rest.T[::-1])
            self.entries -= len(node)
            node.clear()
            self.deep[id(node)] = node
            self._add(node, np.column_stack([np.zeros((len(rest), at), np.int32), rest[order]]), n[order], at)

    def _walk(self, node: dict, head: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], dict]]:
        if id(node) in self.deep:
            for i in sorted(node):
                yield from self._walk(node[i], (*head, i))
        elif node:
            yield head, node

    def runs(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take the largest subtrees below the root out, until keep entries are left, and yield each as (rows, counts)."""
        if id(self.root) not in self.deep:
            parts = [(self.entries, None)]
        else:
            parts = sorted(((sum(len(c) for _, c in self._walk(v, ())), i) for i, v in self.root.items()), reverse=True)
        for size, i in parts:
            if self.entries <= keep:
                return
            top = self.root if i is None else self.root.pop(i)
            for head, c in self._walk(top, () if i is None else (i,)):
                rest = _rows(list(c), self.k - len(head))
                yield np.column_stack([np.tile(np.array(head, np.int32), (len(rest), 1)), rest]), np.fromiter(c.values(), np.int64, len(c))
            for node in self._nodes(top):
                self.deep.pop(id(node), None)
            if i is None:
                self.root = {}
            self.entries -= size

    def _nodes(self, node: dict) -> Iterator[dict]:
        if id(node) in self.deep:
            for v in node.values():
                yield from self._nodes(v)
            yield node


def _keys(rows: np.ndarray) -> list[bytes]:
    rows = np.ascontiguousarray(rows, np.int32)
    return rows.view(f"V{4 * rows.shape[1]}").ravel().tolist()


def _rows(keys: list[bytes], k: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.int32).reshape(-1, k)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and how often each is there."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    if rows.shape[1] <= 2:
        packed = rows[:, 0].astype(np.int64) << 32 | (rows[:, 1] if rows.shape[1] == 2 else 0)
        u, n = np.unique(packed, return_counts=True)
        return np.column_stack([u >> 32, u & 0xFFFFFFFF])[:, : rows.shape[1]].astype(np.int32), n
    s = rows[np.lexsort(rows.T[::-1])]
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]).any(1)]))
    return s[first], np.diff(np.append(first, len(s)))


@dataclass
class Words:
    """Words of a stretch of texts: letters and offsets of the lower-cased words, a hash of each, and of each the number of its piece (equal
    within a piece only) and of its text."""

    letters: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    piece: np.ndarray
    row: np.ndarray

    def array(self) -> pa.StringArray:
        return pa.StringArray.from_buffers(len(self.piece), pa.py_buffer(self.offsets.tobytes()), pa.py_buffer(self.letters.tobytes()))


def split_words(texts: pa.Array, window: int = WINDOW) -> Iterator[Words]:
    """Words of texts, stretch by stretch. Null texts have none. A piece is in one stretch; stretches hold about window bytes, more where a
    single piece does."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, end = int(offsets[0]), int(offsets[-1])
    starts = offsets[:-1]
    while at < end:
        stop, size = min(end, at + window), window
        while stop < end:
            # Cut behind the last end of a piece, or where a text begins, whichever is further on.
            ends = np.flatnonzero(_KIND[data[at:stop]] == 2)
            row = int(starts[np.searchsorted(starts, stop, "right") - 1])
            cut = max(at + int(ends[-1]) + 1 if len(ends) else 0, row)
            if cut > at:
                stop = cut
                break
            size *= 2
            stop = min(end, at + size)
        first = int(np.searchsorted(starts, at))
        yield _words_of(data[at:stop], starts[first : np.searchsorted(starts, stop)] - at, first)
        at = stop


def _words_of(raw: np.ndarray, starts: np.ndarray, first_row: int) -> Words:
    kind = _KIND[raw]
    mark = np.zeros(len(raw), np.bool_)
    mark[starts] = True
    inside = kind == 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | mark[1:]
    where = np.flatnonzero(begin)
    piece = np.cumsum((kind == 2) | mark, dtype=np.int32)[where]
    held = np.cumsum(inside, dtype=np.int32)
    offsets = np.append(held[where] - 1, held[-1] if len(held) else 0).astype(np.int32)
    letters = _LOWER[raw[inside]]
    # The text that holds a word is the last that begins at or before it; of texts that begin together all but the last are empty.
    return Words(letters, offsets, hash_words(letters, offsets), piece, np.searchsorted(starts, where, "right") - 1 + first_row)


def hash_words(letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits of each word: a polynomial of its bytes, mixed."""
    if len(offsets) < 2:
        return np.zeros(0, np.uint64)
    sizes = np.diff(offsets)
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(offsets[:-1], sizes)
    powers = np.full(int(sizes.max()), _STEP, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    return _mix(np.add.reduceat(powers[place] * (letters.astype(np.uint64) + np.uint64(1)), offsets[:-1]), sizes.astype(np.uint64))


_STEP = np.uint64(0x5851F42D4C957F2D)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _in_filter(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bits) * 8 - 1)
    hit = lambda x: bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & 1
    return (hit(key & mask) & hit(key >> np.uint64(SECOND) & mask)).astype(bool)


class Stretch:
    """Phrases of one stretch of words: hashes by length, and where those begin that may be frequent."""

    def __init__(self, words: Words, lang: np.ndarray, filters: dict[int, np.ndarray]):
        self.words, self.filters, self.n = words, filters, len(words.piece)
        self.hashes = {0: lang}
        self.passed: dict[int, np.ndarray] = {}

    def key(self, k: int) -> np.ndarray:
        """52-bit hash of the k words from each place on."""
        if k not in self.hashes:
            self.key(k - 1)
            n = max(self.n - k + 1, 0)
            self.hashes[k] = _mix(self.hashes[k - 1][:n], self.words.hashes[k - 1 : k - 1 + n])
        return self.hashes[k] >> np.uint64(12)

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each place on are in one piece."""
        n = max(self.n - k + 1, 0)
        return self.words.piece[:n] == self.words.piece[k - 1 : k - 1 + n]

    def frequent(self, k: int) -> np.ndarray:
        """Whether the k words from each place on are one piece's and pass the filter of their length."""
        if k not in self.passed:
            ok = self.whole(k)
            at = np.flatnonzero(ok)
            ok[at] = _in_filter(self.filters[k], self.key(k)[at])
            self.passed[k] = ok
        return self.passed[k]

    def open(self, k: int) -> np.ndarray:
        """Places where a phrase of k words begins whose parts, of the greatest length below k that has a filter, pass it."""
        m = max((j for j in self.filters if j < k), default=0)
        ok = self.whole(k)
        for j in range(k - m + 1 if m else 0):
            ok = ok & self.frequent(m)[j : j + len(ok)]
        return np.flatnonzero(ok)


def _stretches(batch: pa.RecordBatch, filters: dict[int, np.ndarray], window: int) -> Iterator[tuple[Stretch, np.ndarray, list[str]]]:
    """(stretch, language number of each word, names of the languages)"""
    langs = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
    of, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
    own = [np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8) for x in names]
    # A letter before each name, so that the empty one has bytes too.
    letters = np.concatenate([np.zeros(0, np.uint8), *[np.append(np.uint8(1), x) for x in own]])
    hashes = hash_words(letters, np.cumsum([0, *[len(x) + 1 for x in own]]).astype(np.int32))
    for words in split_words(batch.column("text"), window):
        if len(words.piece):
            lang = of[words.row]
            yield Stretch(words, hashes[lang], filters), lang, names


def screen(texts: DataFrame, lengths: list[int], filters: dict[int, np.ndarray], min_count: int, full: int = FULL, window: int = WINDOW) -> dict[int, np.ndarray]:
    """Filters of the phrases of `lengths` words of texts (lang, text) that may occur min_count times: those whose parts pass the filters
    given and whose hash does occur so often. Tasks add hashes up before they hand them on; only bits reach the driver."""
    held = texts.sparkSession.sparkContext.broadcast(filters)

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.add.reduceat(counts[order], first)

    def count(batches):
        open_: dict[int, list] = {k: [] for k in lengths}
        sizes = dict.fromkeys(lengths, 0)

        def hand_on(k):
            if open_[k]:
                keys, counts = summed(open_[k])
                open_[k], sizes[k] = [], 0
                for i in range(0, len(keys), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), k, np.int32)), pa.array(keys[part].astype(np.int64)), pa.array(counts[part])], names=["k", "key", "n"])

        for b in batches:
            for s, _, _ in _stretches(b, held.value, window):
                for k in lengths:
                    at = s.open(k)
                    if len(at):
                        open_[k].append(np.unique(s.key(k)[at], return_counts=True))
                        sizes[k] += len(open_[k][-1][0])
                        if sizes[k] > 2 * full:
                            open_[k] = [summed(open_[k])]
                            sizes[k] = len(open_[k][0][0])
                            if sizes[k] > full:
                                yield from hand_on(k)
        for k in lengths:
            yield from hand_on(k)

    found = texts.mapInArrow(lean(count), "k int, key long, n long").repartition("k", "key").groupBy("k", "key").agg(F.sum("n").alias("n"))
    found = materialize(found.where(F.col("n") >= min_count).select("k", "key"), "phrase-hashes")
    sizes = {r["k"]: r["n"] for r in found.groupBy("k").agg(F.count("*").alias("n")).collect()}
    bits = {k: 1 << min(MAX_BITS, max(MIN_BITS, (16 * sizes.get(k, 0) - 1).bit_length() if k in sizes else 0)) for k in lengths}
    mask = F.create_map(*[x for k, n in bits.items() for x in (F.lit(k), F.lit(n - 1).cast("long"))])[F.col("k")]
    places = found.select("k", F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", SECOND).bitwiseAND(mask))).alias("at"))
    words = places.groupBy("k", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = {}
    got = words.toPandas()
    for k, n in bits.items():
        mine = got[got["k"] == k]
        held_bits = np.zeros(n // 64, np.uint64)
        held_bits[mine["word"].to_numpy(np.int64)] = mine["bits"].to_numpy(np.int64).view(np.uint64)
        out[k] = held_bits.view(np.uint8)
    return out


class PhraseCounter:
    """Exact counts of a task's phrases that pass the filter of their length, and all words of a language together under the empty phrase."""

    def __init__(self, filters: dict[int, np.ndarray], burst: int = BURST, full: int = FULL, words: int = WORDS, window: int = WINDOW):
        self.filters, self.full, self.words, self.window = filters, full, words, window
        self.tries = {k: HatTrie(k, burst) for k in filters}
        self.known: dict[tuple[int, str], int] = {}
        self.langs: dict[str, int] = {}
        self.total: dict[str, int] = {}

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for s, lang, names in _stretches(batch, self.filters, self.window):
            for i, c in enumerate(np.bincount(lang, minlength=len(names)).tolist()):
                self.total[names[i]] = self.total.get(names[i], 0) + c
            at = {k: np.flatnonzero(s.frequent(k)) for k in self.filters}
            used = np.zeros(s.n, bool)
            for k, places in at.items():
                for j in range(k):
                    used[places + j] = True
            where = np.flatnonzero(used)
            if not len(where):
                continue
            # Numbers of this task for the (language, word) pairs that are in phrases.
            coded = s.words.array().take(pa.array(where)).dictionary_encode()
            pair = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(names) + lang[where]
            u, inverse = np.unique(pair, return_inverse=True)
            number = np.array([self.langs.setdefault(x, len(self.langs)) for x in names], np.int64)
            keys = zip(number[u % len(names)].tolist(), coded.dictionary.take(pa.array(u // len(names))).to_pylist())
            known = self.known
            ids = np.fromiter((known.setdefault(x, len(known)) for x in keys), np.int32, len(u))
            of = np.zeros(s.n, np.int32)
            of[where] = ids[inverse]
            for k, places in at.items():
                if len(places):
                    self.tries[k].add(*_distinct(np.stack([of[places + j] for j in range(k)], 1)))
            entries = sum(t.entries for t in self.tries.values())
            if len(known) > self.words:
                yield from self.spill(0.0)
                known.clear()
            elif entries > self.full:
                yield from self.spill(0.5)

    def spill(self, keep: float) -> Iterator[pa.RecordBatch]:
        """Sorted runs of what leaves the tries until a share of their entries is left."""
        names = list(self.langs)
        langs, words = pa.array([names[i] for i, _ in self.known], pa.string()), pa.array([w for _, w in self.known], pa.string())
        for k, trie in self.tries.items():
            held, count = [], 0
            for run in trie.runs(int(trie.entries * keep)):
                held.append(run)
                count += len(run[0])
                if count >= 100_000:
                    yield self._run(k, held, langs, words)
                    held, count = [], 0
            if held:
                yield self._run(k, held, langs, words)

    def _run(self, k: int, held: list, langs: pa.Array, words: pa.Array) -> pa.RecordBatch:
        rows, counts = np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held])
        cols = [words.take(pa.array(np.ascontiguousarray(rows[:, j]))) for j in range(k)]
        phrase = pc.binary_join_element_wise(*cols, " ") if k > 1 else cols[0]
        run = pa.RecordBatch.from_arrays([langs.take(pa.array(np.ascontiguousarray(rows[:, 0]))), phrase, pa.array(counts)], schema=RUN_SCHEMA)
        return run.take(pc.sort_indices(run, [("lang", "ascending"), ("phrase", "ascending")]))

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from self.spill(0.0)
        if self.total:
            names = list(self.total)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([""] * len(names)), pa.array([self.total[x] for x in names], pa.int64())], schema=RUN_SCHEMA)


def count_phrases(texts: DataFrame, filters: dict[int, np.ndarray], min_count: int, **sizes) -> DataFrame:
    """Stored (lang, phrase, n) of the phrases of texts (lang, text) that pass the filter of their length and occur min_count times, and
    each language's words in all, as the empty phrase."""
    held = texts.sparkSession.sparkContext.broadcast(filters)

    def count(batches):
        counter = PhraseCounter(held.value, **sizes)
        for b in batches:
            yield from counter.add(b)
        yield from counter.finish()

    runs = texts.mapInArrow(lean(count), "lang string, phrase string, n long")
    # Runs of one prefix, the first three words, meet in one partition and are merged there without another shuffle.
    runs = runs.withColumn("prefix", F.substring_index("phrase", " ", 3)).repartition("lang", "prefix")
    merged = runs.groupBy("lang", "prefix", "phrase").agg(F.sum("n").alias("n"))
    return materialize(merged.where((F.col("n") >= min_count) | (F.col("phrase") == "")).select("lang", "phrase", "n"), "phrases")


def _words(phrase: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def mine_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 100, max_words: int = 5, top: int = 2000, salts: int = 256, **sizes) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best top phrases of 2 to max_words words that occur min_count times.

    Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, and those into words at spaces and tabs. a counts a phrase's
    occurrences in pieces, overlaps included; n all words of the language. The cut into two parts with the lowest
    floor(1000 a n / (l r)) gives l, r and score. Phrases inside a longer one that occurs as often are left out. Null languages are
    `und`, null and empty texts have no words, repeated rows count each, other columns are ignored; an empty table gives no rows.
    Every text is counted whole. A task holds a trie of bounded size; the driver gets filters of at most 16 MB. Partial ranks by hash
    of the phrase (salts) bound what one task ranks to salts * top rows a language.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    filters: dict[int, np.ndarray] = {}
    few = {k: v for k, v in sizes.items() if k in ("full", "window")}
    # Phrases beyond three words are few, so that all their lengths are screened in one pass.
    for lengths in [[k] for k in range(1, min(max_words, 3) + 1)] + ([list(range(4, max_words + 1))] if max_words > 3 else []):
        filters |= screen(texts, lengths, filters, min_count, **few)
    every = count_phrases(texts, filters, min_count, **sizes)
    parts = every.where("phrase <> ''")
    total = every.where("phrase = ''").select("lang", F.col("n").alias("n"))
    found = every.where("instr(phrase, ' ') > 0").select("lang", "phrase", F.col("n").alias("a"), F.size(F.split("phrase", " ")).alias("m"))
    # One word more at either end is enough: what lies between two equal counts has that count too.
    longer = found.where("m > 2").select("lang", "a", F.explode(F.array(_words(F.col("phrase"), 1, F.col("m") - 1), _words(F.col("phrase"), 2, F.col("m") - 1))).alias("phrase")).distinct()
    kept = found.join(longer, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumn("first", _words(F.col("phrase"), 1, F.col("k"))).withColumn("rest", _words(F.col("phrase"), F.col("k") + 1, F.col("m") - F.col("k")))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(total, "lang").withColumn("score", F.expr("(cast(a as decimal(19)) * cast(n as decimal(19)) * 1000) div (cast(l as decimal(19)) * cast(r as decimal(19)))"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    some = best.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each language of documents."""
    return mine_collocations(read(spark, sf_dir, "documents").select("lang", "text"))


ORACLE_OP12 = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
  from documents
), words as (
  select lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') w from pieces
), total as (
  select lang, sum(len(w))::bigint n from words group by lang
), grams as (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') phrase
  from words, unnest(range(1, 6)) t(m), unnest(range(1, len(w) - m + 2)) s(i)
), f as (
  select lang, m, phrase, count(*) a from grams group by lang, m, phrase having count(*) >= 100
), longer as (
  select lang, array_to_string(string_split(phrase, ' ')[1:m - 1], ' ') phrase, a from f where m > 2
  union select lang, array_to_string(string_split(phrase, ' ')[2:], ' '), a from f where m > 2
), cuts as (
  select f.*, n, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') tail
  from f join total using (lang), unnest(range(1, m)) t(k)
  where m > 1 and not exists (select 1 from longer x where x.lang = f.lang and x.phrase = f.phrase and x.a >= f.a)
), scored as (
  select cuts.lang, cuts.phrase, cuts.a, l.a l, r.a r, n, k, ((1000::hugeint * cuts.a * n) // (l.a::hugeint * r.a))::bigint score
  from cuts join f l on l.lang = cuts.lang and l.phrase = head join f r on r.lang = cuts.lang and r.phrase = tail
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase, a, l, r, n, score
from best qualify "rank" <= 2000
"""
