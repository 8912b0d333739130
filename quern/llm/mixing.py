"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import ordering


@dataclass(frozen=True)
class Target:
    source: str
    weight: float
    max_repeats: int


def read_targets(table: DataFrame) -> tuple[list[Target], int]:
    """Targets and budget of a table (source, target_weight, max_repeats, budget_tokens): one row per source of the mix, so it is small by what it is. Rows with a null in them, a weight of 0 or less, or no repeats count for nothing."""
    rows = table.dropna().dropDuplicates(["source"]).collect()
    return [Target(r["source"], r["target_weight"], r["max_repeats"]) for r in sorted(rows, key=lambda r: r["source"]) if r["target_weight"] > 0 and r["max_repeats"] > 0], max((r["budget_tokens"] for r in rows), default=0)


def source_sizes(sized: DataFrame, targets: list[Target]) -> dict[str, tuple[int, int]]:
    """Per target source its tokens and documents; one small row each."""
    got = {r["source"]: (r["t"], r["n"]) for r in sized.where(F.col("source").isin([t.source for t in targets])).groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    return {t.source: got.get(t.source, (0, 0)) for t in targets}


def cut_time(sizes: dict[str, tuple[int, int]], targets: list[Target], budget: int) -> float:
    """The virtual time until which all sources together have sent the budget; a source stops when its repeats are used up."""
    ends = sorted((sizes[t.source][0] * t.max_repeats / t.weight, t.weight) for t in targets)
    rate, at, sent = sum(t.weight for t in targets), 0.0, 0.0
    for end, weight in ends:
        if sent + rate * (end - at) >= budget:
            return at + (budget - sent) / rate
        sent, at, rate = sent + rate * (end - at), end, rate - weight
    return at


def queue(docs: DataFrame, targets: list[Target], *, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """(doc_id, copy, source, tokens, finish): every copy that may be sent, with its virtual finish time.

    ``docs`` has (doc_id, source, tokens). Each source's documents are shuffled
    by a hash; a copy finishes at (tokens of its source up to and with it) /
    weight, second copies after all first ones. The running sum is made in hash
    buckets, whose sums alone reach the driver (sources x buckets), so a source
    with a third of all rows is many small windows. Documents without tokens, or
    of sources without a target, are left out.
    """
    w = {t.source: t for t in targets}
    lit = lambda f, kind: F.create_map(*(x for s, t in w.items() for x in (F.lit(s), F.lit(f(t)).cast(kind))))[F.col("source")]
    spark = docs.sparkSession
    empty = spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, copy int, source string, tokens long, finish double")
    if not w:
        return empty
    d = docs.where(F.col("source").isin(list(w)) & (F.col("tokens") > 0)).withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftright("h", 40), F.lit(buckets)).cast("int"))
    sums = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).collect()
    total = dict.fromkeys(w, 0)
    offsets = []
    for r in sorted(sums, key=lambda r: (r["source"], r["bucket"])):
        offsets.append((r["source"], r["bucket"], total[r["source"]]))
        total[r["source"]] += r["t"]
    if not offsets:
        return empty
    base = F.broadcast(spark.createDataFrame(offsets, "source string, bucket int, base long"))  # sources x buckets rows at most
    inner = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    size = F.create_map(*(x for s, t in total.items() for x in (F.lit(s), F.lit(t).cast("long"))))[F.col("source")]
    placed = d.withColumn("inner", inner).join(base, ["source", "bucket"]).withColumn("copy", F.explode(F.sequence(F.lit(1), lit(lambda t: t.max_repeats, "int"))))
    sent = (F.col("copy") - 1) * size + F.col("base") + F.col("inner")
    return placed.select("doc_id", F.col("copy").cast("int").alias("copy"), "source", "tokens", (sent / lit(lambda t: t.weight, "double")).alias("finish"))


def short_sources(queued: DataFrame, targets: list[Target], budget: int) -> list[str]:
    """Sources whose last copy finishes before the virtual time at which each source should have sent its share of the budget. Those without a copy finish at 0."""
    last = {r["source"]: r["f"] for r in queued.groupBy("source").agg(F.max("finish").alias("f")).collect()}  # a row per source of the mix
    return [t.source for t in targets if last.get(t.source, 0.0) < budget - 1e-6 / t.weight]


def mix(docs: DataFrame, targets: list[Target], budget: int, *, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """(doc_id, copy, source, tokens, finish): the documents in the mix, each up to its source's repeats.

    All copies of the queue are put in global order of finish time by range
    partitions, and the order is cut where the running sum passes the budget.
    Copies that finish after all sources together have surely sent the budget
    aren't sorted.
    """
    queued = queue(docs, targets, seed=seed, buckets=buckets)
    facts = {r["source"]: r for r in queued.groupBy("source").agg(F.sum(F.when(F.col("copy") == 1, F.col("tokens"))).alias("t"), F.max("tokens").alias("most")).collect()}
    if budget <= 0 or not facts:
        return queued.limit(0)
    own = [t for t in targets if t.source in facts]
    until = cut_time({t.source: (facts[t.source]["t"], 0) for t in own}, own, budget) + max(facts[t.source]["most"] / t.weight for t in own)
    order = [F.col(c) for c in ("finish", "source", "doc_id", "copy")]
    sent = ordering.ranked(queued.where(F.col("finish") <= until + 1e-6), order, running="tokens")
    return sent.where(F.col("running") <= budget).select("doc_id", "copy", "source", "tokens", "finish")


def ordered(mixed: DataFrame) -> DataFrame:
    """In the order of the queue: range partitions by finish time, sorted."""
    return mixed.repartitionByRange("finish", "source", "doc_id", "copy").sortWithinPartitions("finish", "source", "doc_id", "copy")


def report(mixed: DataFrame, targets: list[Target], sizes: dict[str, tuple[int, int]], short: list[str]) -> DataFrame:
    """(source, target_weight, actual_share, tokens, copies, most_repeats, available, short) per target source."""
    spark = mixed.sparkSession
    t = spark.createDataFrame([(x.source, float(x.weight), int(sizes[x.source][0]), x.source in short) for x in targets], "source string, target_weight double, available long, short boolean")
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies"), F.max("copy").alias("most_repeats"))
    all_ = got.agg(F.sum("tokens").alias("all"))
    return t.join(got, "source", "left").crossJoin(F.broadcast(all_)).select("source", "target_weight", (F.coalesce("tokens", F.lit(0)) / F.col("all")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "available", "short")

