"""Structured Streaming: bounded-state versions of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events_stream(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def once_each(stream: DataFrame, key: Sequence[str], time: str, delay: str) -> DataFrame:
    """Repeats of a key within the delay go; state is dropped by the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def windowed(stream: DataFrame, time: str, delay: str, size: str, slide: str | None = None, by: Sequence[str] = (), aggregates: Sequence[Column] = ()) -> DataFrame:
    """Tumbling, or with slide hopping, windows; rows later than the delay are left out of the windows that are closed."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = stream.withWatermark(time, delay).groupBy(w.alias("w"), *by).agg(*(aggregates or [F.count("*").alias("n")]))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in g.columns if c != "w"])


def sessions(stream: DataFrame, time: str, delay: str, gap: str, by: Sequence[str], aggregates: Sequence[Column] = ()) -> DataFrame:
    g = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*(aggregates or [F.count("*").alias("n")]))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in g.columns if c != "w"])


def ring_log(stream: DataFrame, key: str, line: str, capacity: int = 5000, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """(key, first_offset, next_offset, truncated, lines): after each batch the last ``capacity`` lines of each key, with global offsets. Keys idle for ``ttl_ms`` are forgotten; with None never, which a run over what there is now needs: a processing-time timeout keeps it waiting."""

    def f(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, lines = state.get if state.exists else (0, [])
        lines = list(lines)
        for p in frames:
            n += len(p)
            lines = (lines + p[line].tolist())[-capacity:]
        state.update((n, lines))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({key: [k[0]], "first_offset": [n - len(lines)], "next_offset": [n], "truncated": [n > len(lines)], "lines": [lines]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, line).groupBy(key).applyInPandasWithState(f, f"{key} {kind}, first_offset long, next_offset long, truncated boolean, lines array<string>", "n long, lines array<string>", "update", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def near_duplicate_sink(store: str, pairs: Callable[[DataFrame, DataFrame], DataFrame], id: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends to the store the batch's rows that aren't alike an earlier stored row or an earlier row of the batch. ``pairs(rows, store)`` gives (a: row, b: earlier row). Each batch is a partition of the store, so that a batch that is run again replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        from quern.sources.readers import exists

        once = batch.dropDuplicates([id])
        old = spark.read.parquet(store).where(F.col("batch") < number).drop("batch") if exists(spark, store) else once.limit(0)
        dup = pairs(once, old).select(F.col("a").alias(id)).distinct()
        once.join(dup, id, "left_anti").write.mode("overwrite").parquet(f"{store}/batch={number}")

    return run


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is now and gives the result as a table in memory: for tests and small reports."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
