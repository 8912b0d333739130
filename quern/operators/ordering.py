"""Global order without a global task: ranks, running sums, percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.stats import keep_count
from quern.plans.lineage import checkpoint


def ranked(df: DataFrame, order: Sequence[Column], *, running: str | None = None) -> DataFrame:
    """Adds ``rank`` (from 1, over the whole table) and, for a numeric column, ``running``, its sum up to and with the row.

    Rows are range-partitioned by the order (which must be total), numbered
    within their partition, and shifted by the counts of the partitions before;
    one small row per partition passes the driver. A plain window without
    partitions would bring the whole table to one task.
    """
    d = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    d = checkpoint(d)
    total = F.sum(running) if running else F.lit(0)
    sums = sorted(d.groupBy("__p").agg(F.count("*").alias("n"), total.alias("s")).collect(), key=lambda r: r["__p"])
    n, s, before = 0, 0, []
    for r in sums:
        before.append((r["__p"], n, s or 0))
        n, s = n + r["n"], s + (r["s"] or 0)
    kind = d.schema[running].dataType.simpleString() if running else "int"
    kind = "double" if kind in ("double", "float") else "long"
    table = F.broadcast(df.sparkSession.createDataFrame([(p, a, float(b) if kind == "double" else int(b)) for p, a, b in before], f"__p int, __n long, __s {kind}"))  # one row per partition
    w = Window.partitionBy("__p").orderBy(*order)
    out = d.join(table, "__p").withColumn("rank", F.row_number().over(w) + F.col("__n"))
    if running:
        out = out.withColumn("running", F.sum(running).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__s"))
    return out.drop("__p", "__n", "__s")


def percentiles(df: DataFrame, value: str, ps: Sequence[float]) -> DataFrame:
    """(p, value): sorted[min(n - 1, int(p n))]. Values are counted first, so the ranks run over different values only. No rows for an empty table; nulls aren't counted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    r = checkpoint(ranked(counts, [F.col(value)], running="n"))
    n = r.agg(F.sum("n")).first()[0]
    if not n:
        return r.select(F.lit(0.0).alias("p"), F.col(value).alias("value")).limit(0)
    places = df.sparkSession.createDataFrame([(float(p), min(n, int(p * n) + 1)) for p in ps], "p double, place long")
    hit = (F.col("running") >= F.col("place")) & (F.col("running") - F.col("n") < F.col("place"))
    return r.join(F.broadcast(places), hit).select("p", F.col(value).alias("value"))  # as many rows as percentiles asked for


def top_fraction(df: DataFrame, score: str, id: str, fraction: float) -> DataFrame:
    """Adds ``kept``: whether the row is among the best fraction by score, ties by id."""
    order = [F.col(score).desc_nulls_last(), F.col(id).asc()]
    r = checkpoint(ranked(df, order))
    return r.withColumn("kept", F.col("rank") <= keep_count(r.count(), fraction))


def within_budget(df: DataFrame, order: Sequence[Column], size: str, budget: int) -> DataFrame:
    """Rows in order until the budget is reached, the crossing row included."""
    return ranked(df, order, running=size).where(F.col("running") - F.col(size) < budget)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page from 1 with 1 to 200 rows; past the end it is empty."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("a page is 1 or more, its size 1 to 200")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(total: int, size: int) -> int:
    return max(1, -(-total // size))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int = 1) -> DataFrame:
    """First rows of each group by the order. Spark prunes each task's rows to the limit before the shuffle (window group limit)."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def numbered_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str, out: str) -> DataFrame:
    """``label #k`` in order where a label stands more than once in its group."""
    w = Window.partitionBy(*keys, label)
    return df.withColumn(out, F.when(F.count("*").over(w) > 1, F.concat(F.col(label), F.lit(" #"), F.row_number().over(w.orderBy(*order)).cast("string"))).otherwise(F.col(label)))


def listed(value: Column, known: Sequence[str]) -> Column:
    """Sort key: the place in the list of known values, those not in it after all."""
    return F.coalesce(F.nullif(F.array_position(F.lit(list(known)), value), F.lit(0)), F.lit(len(known) + 1))


def digits(text: Column) -> Column:
    """Sort key: the digits in a name as a number, 0 without any."""
    return F.coalesce(F.regexp_replace(text, r"[^0-9]", "").try_cast("long"), F.lit(0))


def capped(df: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """The first rows of a global order, ``most`` of them: taken per task and merged."""
    return df.orderBy(*order).limit(most)


def next_number(df: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """(by, next): one more than the largest number of the group, 0 where it has none."""
    return df.groupBy(*by).agg((F.coalesce(F.max(number), F.lit(-1)) + 1).alias("next"))
