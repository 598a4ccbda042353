"""Words of many texts at once, by Arrow kernels inside tasks: what is done for a word is done once a block, not once an occurrence.

A block is a run of rows whose texts hold about BLOCK_BYTES together (a longer text is a block of its own), so a task holds
one Arrow batch and one block, however long the table is. Nothing is kept from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20


def text_blocks(batch: pa.RecordBatch, column: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row, rows) of a batch, in order; every row is in one block."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + block_bytes, side="right")))
        yield at, batch.slice(at, to - at)
        at = to


def split_texts(texts: pa.Array, kernel, keep_empty: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, distinct words): the words of text i are distinct[codes[offsets[i]:offsets[i + 1]]]. Null texts have none.

    kernel splits an array of strings, such as pyarrow.compute.ascii_split_whitespace. Empty words are left out unless wanted.
    """
    lists = kernel(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    if not keep_empty:
        full = pc.not_equal(pc.binary_length(flat), 0)
        offsets = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[offsets]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def gather_runs(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[starts[i] : starts[i] + lengths[i]] for all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return pool[:0]
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return pool[shift + np.arange(total)]


def bound_batches(spark, batch_bytes: int = 4 << 20) -> None:
    """Let Arrow batches of texts hold about batch_bytes instead of Spark's 64 MB; a limit that the user has set stays.

    Executor and worker each hold a batch or two per task, so this bounds what long texts take. It changes no result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(name, str(batch_bytes))


def give_back() -> None:
    """Hand memory that this worker process holds for nothing back to the system; what is in use stays.

    Spark keeps workers for later tasks, several per core at times, and each would otherwise stay as large as its largest task.
    """
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def lean(run):
    """run(batches), a function for mapInArrow or mapInPandas, giving memory back when its task ends."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
