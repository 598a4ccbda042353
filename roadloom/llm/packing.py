"""Best-fit packing of tokenised documents into sequences of at most `capacity` tokens.

Tokenising, cutting, ranking and placing run on Spark. The plan itself needs only how many pieces each length has: at most
`capacity` counts, whatever the number of documents, so it is made on the driver. It fills sequences exactly first
(complement by a single, a pair or a triple of available lengths) and best-fits the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.functions.shared import materialize
from roadloom.llm.words import bound_batches, gather_runs, lean, split_texts, text_blocks

CAPACITY = 4096
END_ID = 1
PIECES = "piece int, start long, length long, ids_crc32 long"


class RunEncoder:
    """Token ids of distinct runs between spaces and newlines.

    The tokenizer drops white space and never joins what stands on both sides of it (NFC, lower case and the splitter
    don't look across it either), so a text's ids are those of its runs in order. A run of letters with ASCII punctuation
    behind it splits once more: its letters and its punctuation are separate words to the splitter (an apostrophe may
    join, such runs stay whole). It keeps the tokenizer alone, no words.
    """

    LETTERS = r"^(?P<head>\pL+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"

    def __init__(self, file: str, chunk: int = 4096):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; threads of its own cost more than they give
        from tokenizers import Tokenizer

        self.tok, self.chunk = Tokenizer.from_file(file), chunk
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone are one word to the splitter too: encoded together, they part at the word ends."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        n = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
        return (ids, n) if len(n) == len(words) else self._one_by_one(words)

    def _words(self, words: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, ids a word); letters marks words of letters alone."""
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
        cut = int(letters.sum())
        take = lambda a, z: [words[i] for i in order[a:z].tolist()]
        parts = [self._letters(take(i, min(i + self.chunk, cut))) for i in range(0, cut, self.chunk)]
        parts += [self._one_by_one(take(i, i + self.chunk)) for i in range(cut, len(words), self.chunk)]
        pool = np.concatenate([np.zeros(0, np.uint32), *[p for p, _ in parts]])
        got = np.concatenate([np.zeros(0, np.int64), *[n for _, n in parts]])
        n, starts = np.empty_like(got), np.empty_like(got)
        n[order], starts[order] = got, np.cumsum(got) - got
        return gather_runs(pool, starts, n), n

    def __call__(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs one after the other, ids a run)."""
        parted = pc.extract_regex(runs, self.LETTERS)
        whole = pc.is_null(parted)
        head = pc.if_else(whole, runs, pc.ascii_lower(pc.struct_field(parted, "head")))
        tail = pc.if_else(whole, "", pc.struct_field(parted, "tail"))
        words = pa.concat_arrays([head, tail]).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(2, -1)
        letters = np.zeros(len(words.dictionary), bool)
        letters[codes[0][~whole.to_numpy(zero_copy_only=False)]] = True
        pool, n = self._words(words.dictionary.to_pylist(), letters)
        pairs = codes.T
        return gather_runs(pool, (np.cumsum(n) - n)[pairs.ravel()], n[pairs.ravel()]), n[pairs].sum(1)


def encode_texts(texts: pa.Array, encoder: RunEncoder) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids): text i has ids[offsets[i]:offsets[i + 1]], without end id."""
    offsets, codes, runs = split_texts(texts, lambda t: pc.split_pattern(pc.replace_substring(t, "\n", " "), " "))
    pool, n = encoder(runs)
    count = n[codes]
    ends = np.concatenate([[0], np.cumsum(count)])
    return ends[offsets], gather_runs(pool, (np.cumsum(n) - n)[codes], count)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def cut_pieces(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32. A null text is empty and has the end id alone."""

    def encode(batches):
        enc, end = RunEncoder(file), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first, part in text_blocks(batch, text):
                offsets, ids = encode_texts(part.column(text), enc)
                ids = ids.astype("<u4", copy=False)
                rows = []
                for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    for p, s in enumerate(range(a, z + 1, capacity)):  # the end id stands at z
                        e = min(s + capacity, z)
                        crc = zlib.crc32(ids[s:e])
                        last = s + capacity > z
                        rows.append((first + i, p, s - a, e - s + last, zlib.crc32(end, crc) if last else crc))
                row, *cols = np.array(rows, np.int64).reshape(-1, 5).T
                out = [batch.column(key).take(pa.array(row)), *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]]
                yield pa.RecordBatch.from_arrays(out, names=[key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias(text)).mapInArrow(lean(encode), f"`{key}` {kind}, {PIECES}")


@dataclass
class Plan:
    """Patterns of lengths that fill a sequence, and how often each is used."""

    patterns: list[tuple[tuple[int, ...], int]]

    @property
    def sequences(self) -> int:
        return sum(m for _, m in self.patterns)


class SumIndex:
    """Which available lengths add up to a sum: one, pairs (a, b) and triples (a, b, c), by the sum.

    An entry lists the largest members, rising, of those available when its sum is first asked for. Counts only fall, and the
    largest lengths run out first: members that have run out are dropped from the end, others passed over. There are at most
    `capacity` sums of each kind, and capacity members a sum.
    """

    def __init__(self, counts: np.ndarray):
        self.left, self.entries = counts, ({}, {})

    def _members(self, kind: int, total: int, parts: int) -> Iterator[int]:
        entry = self.entries[kind].get(total)
        if entry is None:
            have = self.left[1:total] > 0
            some = np.flatnonzero(have & have[::-1] if parts == 2 else have[: total - 2]) + 1
            entry = self.entries[kind][total] = some[some * parts >= total].tolist()
        while entry and not self.left[entry[-1]]:
            entry.pop()
        return reversed(entry)

    def pairs(self, total: int) -> Iterator[int]:
        """The larger ones of pairs with this sum, falling."""
        return (a for a in self._members(0, total, 2) if self.left[a] and self.left[total - a]) if total > 1 else iter(())

    def triples(self, total: int) -> Iterator[int]:
        """The largest ones of triples that may have this sum, falling; the rest is a pair."""
        return (a for a in self._members(1, total, 3) if self.left[a]) if total > 2 else iter(())


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Patterns for counts[length] pieces of each length.

    The longest length left is served first. Its gap is filled exactly by one available length, else by a pair, else by a
    triple, looked up by their sums (SumIndex). The pattern repeats as often as the counts allow. Where no exact complement
    exists the largest length that fits goes in, and the rest of the gap is treated alike. Every pattern uses up a length, so
    there are at most about `capacity` of them.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] += c
    out: list[tuple[tuple[int, ...], int]] = []
    index = SumIndex(left)

    def times(items):
        return min(int(left[x]) // items.count(x) for x in set(items))

    def pair(gap, used):
        return next(([a, gap - a] for a in index.pairs(gap) if times([*used, a, gap - a]) > 0), None)

    def exact(gap, used):
        if left[gap] > 0 and times([*used, gap]) > 0:
            return [gap]
        if found := pair(gap, used):
            return found
        for a in index.triples(gap):
            if times([*used, a]) > 0 and (found := pair(gap - a, [*used, a])):
                return [a, *found]
        return None

    top = capacity
    while True:
        while top > 0 and left[top] == 0:
            top -= 1
        if top == 0:
            return Plan(out)
        items, gap = [top], capacity - top
        while gap > 0:
            if found := exact(gap, items):
                items += found
                break
            fit = next((int(x) for x in np.flatnonzero(left[1 : gap + 1] > 0)[::-1] + 1 if times([*items, int(x)]) > 0), None)
            if fit is None:
                break
            items.append(fit)
            gap -= fit
        m = times(items)
        for x in items:
            left[x] -= m
        out.append((tuple(items), m))


def place_pieces(pieces: DataFrame, plan: Plan, rank: str = "rank", length: str = "length") -> DataFrame:
    """Add sequence_id and offset to pieces whose rank (from 0) counts within their length.

    The plan's slots are arrays of at most some 10 * capacity entries, sent with the tasks; a piece finds its slot by
    binary search on (length, rank).
    """
    taken: dict[int, int] = {}
    slots = []
    base = 0
    for items, m in plan.patterns:
        seen: dict[int, int] = {}
        at = 0
        for x in items:
            per = items.count(x)
            if x not in seen:
                slots.append((x, taken.get(x, 0), base, per, [i for i, y in enumerate(items) if y == x]))
                taken[x] = taken.get(x, 0) + per * m
                seen[x] = 1
        base += m
    offsets = [np.concatenate([[0], np.cumsum(items)[:-1]]) for items, _ in plan.patterns]
    rows, i = [], 0
    for k, (items, _) in enumerate(plan.patterns):
        for x in dict.fromkeys(items):
            _, lo, b, per, where = slots[i]
            rows.append((x, lo, b, per, [int(offsets[k][w]) for w in where]))
            i += 1
    rows.sort(key=lambda r: (r[0], r[1]))
    n, lo, first, per = (np.array([r[j] for r in rows], np.int64) for j in range(4))
    flat = np.array([o for r in rows for o in r[4]], np.int64)
    flat_at = np.concatenate([[0], np.cumsum(per)[:-1]]) if len(rows) else np.zeros(0, np.int64)
    bounds = [np.searchsorted(n, x) for x in range(int(n.max()) + 2)] if len(rows) else [0, 0]

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rk: pd.Series) -> pd.DataFrame:
        s, r = size.to_numpy(), rk.to_numpy()
        got = np.zeros(len(s), np.int64)
        for x in np.unique(s):
            mine = s == x
            a, z = bounds[x], bounds[x + 1]
            got[mine] = a + np.searchsorted(lo[a:z], r[mine], side="right") - 1
        inside = r - lo[got]
        return pd.DataFrame({"sequence_id": first[got] + inside // per[got], "offset": flat[flat_at[got] + inside % per[got]]})

    return pieces.withColumn("_p", place(F.col(length), F.col(rank))).withColumn("sequence_id", F.col("_p.sequence_id")).withColumn("offset", F.col("_p.offset")).drop("_p")


def rank_within(rows: DataFrame, group: str, order: list[str], salts: int) -> DataFrame:
    """Add rank (long, from 0) of each row within its group, the group spread over `salts` windows.

    Rows of a group are numbered salt by salt: one window per (group, salt), plus offsets from the salts' counts. Rows
    that are equal in all order columns are equal altogether for our use, so their mutual order doesn't matter.
    """
    from pyspark.sql import Window as W

    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy(group, "_salt").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = salted.withColumn("_i", F.row_number().over(W.partitionBy(group, "_salt").orderBy(*order)))
    return local.join(before, [group, "_salt"]).withColumn("rank", F.col("_i") - 1 + F.col("_before")).drop("_i", "_before", "_salt")


def pack_documents(docs: DataFrame, file: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, salts: int = 1024) -> DataFrame:
    """Pack all documents: one row per piece with key, piece, start, length, ids_crc32, sequence_id and offset.

    Only documents longer than `capacity` are cut. Null texts count as empty and hold the end id alone; repeated rows are
    packed once each; an empty table gives an empty result; other columns of docs are ignored.
    """
    bound_batches(docs.sparkSession)
    pieces = materialize(cut_pieces(docs, file or tokenizer_file(), key, text, capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = plan_packing(counts, capacity)
    ranked = rank_within(pieces, "length", [key, "piece", "ids_crc32"], salts)
    return place_pieces(ranked, plan).drop("rank").select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs)
