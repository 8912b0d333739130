"""Samples, group-aware stratified splits and their repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.plans.lineage import checkpoint


def sample(df: DataFrame, id: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: the least seeded hashes, taken per task and merged."""
    return df.orderBy(seeded(id, seed), id).limit(n)


def seeded(id: Column, seed: int) -> Column:
    """MD5 of seed/id: the same order in any engine."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), id.cast("string")))


def exemplars(df: DataFrame, id: Column, text: Column, but: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows at random with a text that isn't blank, without those of ``but``."""
    return sample(df.where((F.trim(text) != "") & ~F.coalesce(but, F.lit(False))), id, n, seed)


def weighted_sample(df: DataFrame, id: Column, weight: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement with chances by weight: the least -ln(u)/w."""
    u = (F.conv(F.substring(seeded(id, seed), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return df.where(weight > 0).orderBy(F.round(-F.log(u) / weight, 9), id).limit(n)


def stratified_split(df: DataFrame, id: str, unit: Column, strata: Sequence[str], shares: dict[str, float], rest: str, seed: int = 0, buckets: int = 256) -> DataFrame:
    """(id, unit, split): units whole, within each stratum the shares, rounded half to even, of its units; others go to ``rest``.

    A unit's stratum is that of its first row. Units are ranked by hash within
    their stratum; ranks are made in hash buckets with the counts of the buckets
    before, so that a stratum with a third of all units isn't one window.
    """
    d = df.select(F.col(id).alias("id"), unit.alias("unit"), F.to_json(F.struct(*strata), {"ignoreNullFields": "false"}).alias("stratum"))
    u = d.groupBy("unit").agg(F.min_by("stratum", "id").alias("stratum")).withColumn("h", F.xxhash64("unit", F.lit(seed)))
    u = checkpoint(u.withColumn("bucket", F.pmod(F.shiftright("h", 40), F.lit(buckets)).cast("int")))
    counts = u.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("stratum").orderBy("bucket")
    placed = counts.select("stratum", "bucket", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("stratum")).alias("all"))
    r = u.join(placed, ["stratum", "bucket"]).withColumn("rank", F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("h", "unit")) + F.col("before"))
    take, at = F.when(F.lit(False), F.lit("")), F.lit(0)
    for s, x in shares.items():
        end = at + F.bround(F.col("all") * x).cast("int")
        take = take.when(F.col("rank") <= end, s)
        at = end
    return d.join(r.select("unit", take.otherwise(rest).alias("split")), "unit").select(F.col("id").alias(id), "unit", "split")


def repair_coverage(assigned: DataFrame, items: DataFrame, id: str, target: str) -> DataFrame:
    """The assignment with units moved so that each item that occurs anywhere occurs in ``target``: for each missing item the first unit that has it moves."""
    x = items.join(assigned, id).select("item", "unit", "split")
    have = x.where(F.col("split") == target).select("item").distinct()
    moved = x.join(have, "item", "left_anti").groupBy("item").agg(F.min("unit").alias("unit")).select("unit").distinct().withColumn("__m", F.lit(True))
    return assigned.join(moved, "unit", "left").select(id, "unit", F.when(F.col("__m"), target).otherwise(F.col("split")).alias("split"))


def round_robin(df: DataFrame, number: Column, values: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int")))


def shortfall(df: DataFrame, key: str, targets: dict[str, int]) -> DataFrame:
    """(key, have, missing) for each wanted key, one that doesn't occur included."""
    t = df.sparkSession.createDataFrame(sorted(targets.items()), f"{key} string, target int")
    c = df.groupBy(key).agg(F.count("*").alias("have"))
    return t.join(c, key, "left").select(key, F.coalesce("have", F.lit(0)).alias("have"), F.greatest(F.lit(0), F.col("target") - F.coalesce("have", F.lit(0))).alias("missing"))
