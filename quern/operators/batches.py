"""Work on Arrow batches, whole runs of sorted partitions, and broadcast filters of keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.lineage import checkpoint


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches: bounds the memory of the vectorised steps."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = 1000) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, rows):
            if (out := f(b)) is not None and out.num_rows:
                yield out

    return run


def bitmap(spark: SparkSession, keys: DataFrame, log2_words: int | None = None):
    """Broadcast filter over the 64-bit values of the only column of ``keys``.

    2^log2_words words of 64 bits; without that, as many as give a key 16 bits,
    from 2^12 to 2^21 (16 MB): beyond 8 million keys it gets denser and lets more
    pass. The driver gets at most one row per word. It has no false negatives,
    and every use is followed by an exact step.
    """
    (c,) = keys.columns
    if log2_words is None:
        keys = checkpoint(keys)
        log2_words = min(max((keys.count() // 4).bit_length(), 12), 21)
    word = F.col(c).bitwiseAND((1 << log2_words) - 1).alias("w")
    bit = F.expr(f"shiftleft(1L, cast(shiftright(`{c}`, {log2_words}) & 63 as int))").alias("b")
    t = keys.select(word, bit).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << log2_words, np.uint64)
    table[t.column("w").to_numpy()] = t.column("b").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    h = h.view(np.uint64)
    shift = np.uint64(len(table).bit_length() - 1)
    return (table[(h & np.uint64(len(table) - 1)).astype(np.int64)] >> ((h >> shift) & np.uint64(63))) & np.uint64(1) > 0


def by_runs(f: Callable[[pa.Table], pa.RecordBatch | None], keys: list[str], rows: int = 200_000) -> Callable:
    """For sorted partitions: calls f with whole runs of equal keys, some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def parts(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            t = pa.Table.from_batches(held).combine_chunks()
            cut = t.num_rows
            if not last:
                same = np.ones(cut, bool)
                for k in keys:
                    a = t.column(k).to_numpy()
                    same &= a == a[-1]
                cut = int(np.argmax(same))  # the last run may go on
            if cut and (out := f(t.slice(0, cut))) is not None and out.num_rows:
                yield out
            held = t.slice(cut).to_batches()
            size = t.num_rows - cut

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= rows:
                yield from parts(False)
        if held:
            yield from parts(True)

    return run
