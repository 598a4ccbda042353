"""Splittable reading of GeoJSON feature collections: tasks take byte ranges and own the features that begin inside."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, and of what is read at once.
RANGE, CHUNK = 32 << 20, 1 << 20
_BRACE, _LIST = re.compile(r"\{"), re.compile(r'"features"\s*:\s*\[')


class _Bytes:
    """A file's bytes from a place on, read as they are needed; one character a byte, so that places count bytes."""

    def __init__(self, file, start: int):
        self.file, self.start, self.text, self.ended = file, start, "", False
        file.seek(start)

    def more(self) -> bool:
        """Read as much again as is held; false at the end of the file."""
        got = b"" if self.ended else self.file.read(max(CHUNK, len(self.text)))
        self.text += got.decode("latin-1")
        self.ended = self.ended or not got
        return bool(got)

    def drop(self, n: int) -> None:
        self.text, self.start = self.text[n:], self.start + n

    def char(self, i: int) -> str:
        """The next character from place i on that isn't blank, and its place; '' at the end."""
        while True:
            m = re.compile(r"\S").search(self.text, i)
            if m or not self.more():
                return (m[0], m.start()) if m else ("", len(self.text))

    def value(self, i: int):
        """(value, end) of the JSON value at place i; None if there is none."""
        while True:
            try:
                return json.JSONDecoder().raw_decode(self.text, i)
            except json.JSONDecodeError as e:
                # Cut off or wrong: wrong where the fault lies before what is held ends (numbers, names and strings may run into it).
                if e.pos < len(self.text) - 16 and not e.msg.startswith("Unterminated string"):
                    return None
                if not self.more():
                    return None


def _is_feature(v) -> bool:
    return isinstance(v, dict) and v.get("type") == "Feature"


def owned_features(file, start: int, end: int) -> Iterator[str]:
    """JSON texts of the features of a collection that begin in [start, end) of a file.

    In the middle of a file the first one is found by trying braces: what decodes as a Feature and stands in a list of such is one;
    objects that decode as something else, such as properties, are stepped over. From there on features follow each other, so texts
    and properties that look like features are never taken for one.
    """
    b, i = _Bytes(file, start), 0
    synced = False
    if start == 0:
        while not (m := _LIST.search(b.text)):
            if not b.more():
                return
        i, synced = m.end(), True
    while True:
        if synced:
            c, i = b.char(i)
            if c == ",":
                c, i = b.char(i + 1)
            if c != "{":
                return
        else:
            while not (m := _BRACE.search(b.text, i)):
                i = len(b.text)
                if b.start + i >= end or not b.more():
                    return
            i = m.start()
        if b.start + i >= end:
            return
        got = b.value(i)
        if got is None:
            if synced:
                raise ValueError(f"no feature at byte {b.start + i}")
            i += 1
            continue
        v, to = got
        if not synced and _is_feature(v):
            # In a list of features another one or the list's end follows.
            c, at = b.char(to)
            if c == ",":
                c, at = b.char(at + 1)
                after = b.value(at) if c == "{" else None
                synced = after is not None and _is_feature(after[0])
            else:
                synced = c == "]"
        if synced:
            yield b.text[i:to].encode("latin-1").decode("utf-8")
        b.drop(to)
        i = 0


def feature_texts(spark: SparkSession, paths: list[str], range_bytes: int = RANGE) -> DataFrame:
    """(value): one JSON text per feature of the collections, read in ranges of range_bytes by as many tasks. Storage is reached through
    pyarrow.fs by URI; a task holds one chunk and the feature at hand. Members of the collection other than its features are left out."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    cut = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))))
    cut = cut.withColumn("end", F.least(F.col("start") + range_bytes, F.col("length")))
    tasks = max(spark.sparkContext.defaultParallelism, int(cut.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, start, end in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "end")]):
                where, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", path) else path)
                held, size = [], 0
                with where.open_input_file(name) as f:
                    for text in owned_features(f, start, end):
                        held.append(text)
                        size += len(text)
                        if size > CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                            held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    # By number, so that every range is a task of its own.
    return cut.select("path", "start", "end").repartition(tasks, "path", "start").mapInArrow(read, "value string")
