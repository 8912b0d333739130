"""Connected components by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.lineage import checkpoint


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """Rows (node, component) for each node of the edges; ``component`` is the least node.

    Each node keeps a cluster as rows (node, member). A round sends a node's
    cluster to the cluster's minimum and the minimum to every member, until
    nothing changes; rounds grow with the logarithm of the longest path. No
    cluster is ever collected: rows are shuffled by node, minima are combined
    before the shuffle, and each round is checkpointed. Null ends are no edges;
    loops and repeated edges do no harm; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    ends = F.explode(F.array(*(F.struct(F.col(x).alias("v"), F.col(y).alias("u")) for x, y in (("v", "u"), ("u", "v"), ("v", "v"), ("u", "u")))))
    c = checkpoint(e.select(ends.alias("e")).select("e.*").distinct())
    seen = None
    for _ in range(most):
        least = c.groupBy("v").agg(F.min("u").alias("m"))
        sent = F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))
        c = checkpoint(c.join(least, "v").select(sent.alias("e")).select("e.*").distinct())
        now = c.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return c.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
        seen = tuple(now)
    raise RuntimeError(f"no fixed point after {most} rounds")


def joined(rows: DataFrame, facts: DataFrame, key: str, hot: int = 1000) -> DataFrame:
    """Inner join of rows with a table of at most one row per key. Keys with more than 1/``hot`` of all rows, so fewer than ``hot``, are joined by broadcast: their rows aren't brought to one task. Null keys join nothing. ``rows`` is read three times; it should be stored."""
    total = rows.count()
    many = checkpoint(rows.groupBy(key).agg(F.count("*").alias("__c")).where((F.col("__c") * hot > total) & F.col(key).isNotNull()).select(key))
    mark = F.broadcast(many.withColumn("__hot", F.lit(True)))  # fewer than ``hot`` rows
    marked = rows.join(mark, key, "left")
    warm = F.broadcast(facts.join(F.broadcast(many), key, "left_semi"))
    names = [*rows.columns, *(c for c in facts.columns if c != key)]
    return marked.where("__hot").join(warm, key).select(names).unionByName(marked.where("__hot is null").join(facts, key).select(names))
