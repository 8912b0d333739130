"""Seams for models, selection among scored variants, controlled corruption."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import let


def score_rows(df: DataFrame, id: str, columns: Sequence[str], load: Callable[[], Callable[[pd.DataFrame], Sequence[float]]], out: str = "score") -> DataFrame:
    """(id, score) by a model: ``load`` runs once per task, its result once per Arrow batch. Batches are bounded by spark.sql.execution.arrow.maxRecordsPerBatch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield pd.DataFrame({id: b[id], out: pd.Series(list(model(b)), dtype="float64")})

    return df.select(id, *columns).mapInPandas(run, f"{id} {df.schema[id].dataType.simpleString()}, {out} double")


def score_missing(df: DataFrame, scores: DataFrame, id: str, columns: Sequence[str], load: Callable, out: str = "score") -> DataFrame:
    """(id, score): known scores as they are, the model for the rows without one only."""
    new = score_rows(df.join(scores.select(id), id, "left_anti"), id, columns, load, out)
    return scores.select(id, F.col(out).cast("double").alias(out)).join(df.select(id), id, "left_semi").unionByName(new)


def first_passing(variants: DataFrame, keys: Sequence[str], order: Sequence[str], passes: Column) -> DataFrame:
    """Of each key the first variant that passes; keys without one give no row."""
    return variants.where(passes).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def pad_to(items: Column, n: Column | int) -> Column:
    """Exactly n items: the first ones, or the last one repeated; an empty array stays empty."""
    n = F.lit(n) if isinstance(n, int) else n
    return let(items, lambda t: F.when(F.size(t) > 0, F.slice(F.concat(t, F.array_repeat(F.element_at(t, -1), n)), F.lit(1), n)).otherwise(t))


def swap_clauses(text: Column) -> Column:
    """First sentence to the end."""
    return F.regexp_replace(text, r"(?s)^([^.!?]*[.!?])\s*(.+)$", "$2 $1")


def negate(text: Column, verb: str, negation: str = "không") -> Column:
    """A negation before the first occurrence of a word."""
    return F.regexp_replace(text, rf"(?s)^(.*?)(?<![\p{{L}}\p{{N}}_]){verb}(?![\p{{L}}\p{{N}}_])", f"$1{negation} {verb}")


def corrupted(df: DataFrame, id: str, text: str, ways: dict[str, Column], seed: int = 0) -> DataFrame:
    """Adds ``way`` and ``corrupted``: one of the ways for each row, chosen by hash."""
    names = sorted(ways)
    pick = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64(id, F.lit(seed)), F.lit(len(names))) + 1).cast("int"))
    d = df.withColumn("way", pick)
    out = F.col(text)
    for n in names:
        out = F.when(F.col("way") == n, ways[n]).otherwise(out)
    return d.withColumn("corrupted", out)


def detection_rates(results: DataFrame, by: Sequence[str], degraded: str, flagged: str) -> DataFrame:
    """(..., n, k): degraded texts and those of them that were flagged, by group."""
    return results.where(degraded).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(flagged).alias("k"))


def durations(runs: DataFrame, started: str, ended: str) -> DataFrame:
    """Adds ``duration_s`` and the start as ISO text."""
    return runs.withColumn("duration_s", (F.unix_micros(F.to_timestamp(ended)) - F.unix_micros(F.to_timestamp(started))) / 1e6).withColumn("started_iso", F.date_format(F.to_timestamp(started), "yyyy-MM-dd'T'HH:mm:ss"))


def mock_verdict(key: Column, rate: Column, seed: int = 0) -> Column:
    """A judge without a model: true for a seeded share of the keys."""
    h = F.md5(F.concat_ws("/", F.lit(str(seed)), key))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0) < rate
