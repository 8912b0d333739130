"""Conforming sources to one key: aliases, lookups, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources that are keyed by name must not carry a number to join by.
BANNED_KEYS = ("card_id", "number", "numeric_id", "card_number", "id")
SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint behind a check of the size: one count that stops at the bound. Larger tables are left to Spark's own choice of join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def normal_name(name: Column) -> Column:
    """Lower case, letters and digits, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^\w]+", " "))


def alias_table(canonical: DataFrame, id: str, name: str, ranks: dict[str, Sequence[str]] | None = None, suits: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(alias, id): normalised names, and where a name is "rank of suit" each spelling of the rank with each of the suit. An alias of two ids raises ValueError."""
    base = canonical.select(F.col(id).alias("id"), normal_name(F.col(name)).alias("alias")).distinct()
    spark = canonical.sparkSession
    more = []
    if ranks and suits:
        spell = lambda m, a, b: F.broadcast(spark.createDataFrame([(k.lower(), s.lower()) for k, v in m.items() for s in (k, *v)], f"{a} string, {b} string"))
        parts = base.withColumn("rank", F.regexp_extract("alias", r"^(\w+) of (\w+)$", 1)).withColumn("suit", F.regexp_extract("alias", r"^(\w+) of (\w+)$", 2))
        both = parts.join(spell(ranks, "rank", "r"), "rank").join(spell(suits, "suit", "s"), "suit")
        more = [both.select("id", normal_name(F.concat_ws(" of ", "r", "s")).alias("alias")), both.select("id", normal_name(F.concat_ws(" ", "r", "s")).alias("alias"))]
    out = reduce(DataFrame.unionByName, more, base).distinct()
    if out.groupBy("alias").agg(F.countDistinct("id").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("an alias names two ids")
    return out.select("alias", "id")


def resolve(df: DataFrame, name: str, aliases: DataFrame, out: str = "resolved_id") -> DataFrame:
    """Left join by alias: as it is, without "the ", with "the "; null where unknown. One join: each alias stands with its article variants, the exact one first."""
    exact = aliases.select("alias", F.col("id").alias(out), F.lit(0).alias("p"))
    without = aliases.where(F.col("alias").startswith("the ") == F.lit(False)).select(F.concat(F.lit("the "), "alias").alias("alias"), F.col("id").alias(out), F.lit(1).alias("p"))
    with_ = aliases.where(F.col("alias").startswith("the ")).select(F.expr("substr(alias, 5)").alias("alias"), F.col("id").alias(out), F.lit(2).alias("p"))
    all_ = exact.union(without).union(with_).groupBy("alias").agg(F.min_by(out, "p").alias(out)).withColumnRenamed("alias", "__alias")
    return df.withColumn("__key", normal_name(F.col(name))).join(small(all_), F.col("__key") == F.col("__alias"), "left").drop("__key", "__alias")


def unresolved(df: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    return resolve(df, name, aliases).where("resolved_id is null").select(name).distinct()


def guard_name_keyed(df: DataFrame, banned: Sequence[str] = BANNED_KEYS) -> DataFrame:
    """The table itself; TypeError if a name-keyed source has a numeric key."""
    if bad := [c for c in df.columns if c.lower() in banned]:
        raise TypeError(f"name-keyed source with numeric keys: {bad}")
    return df


def crosstab_with_labels(rows: DataFrame, labels: DataFrame, id: str, label: str, by: str) -> DataFrame:
    """(label, by, n) over the left join; null label: rows without one. Counted per id first, so the shuffle carries a narrow row."""
    return rows.select(id, by).join(labels.select(id, label), id, "left").groupBy(label, by).agg(F.count("*").alias("n"))


def missing_combinations(present: DataFrame, universe: Sequence[DataFrame]) -> DataFrame:
    """Combinations of the given (small, fixed) value tables that don't occur."""
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), universe)
    return grid.join(present.select(grid.columns).distinct(), grid.columns, "left_anti")


def fill_down(df: DataFrame, scores: DataFrame, id: str, score: str, out: str) -> DataFrame:
    """Score of the row where it has one, else the separate table's."""
    s = scores.groupBy(id).agg(F.min(score).alias("__s"))
    return df.join(s, id, "left").withColumn(out, F.coalesce(score, "__s")).drop("__s")


def compact_card(keywords: Column, meaning: Column, most_keywords: int = 5, most_chars: int = 180) -> Column:
    """struct(keywords, meaning): first keywords, and the meaning without a source note in brackets, shortened."""
    from quern.functions.text import truncate

    return F.struct(F.slice(keywords, 1, most_keywords).alias("keywords"), truncate(F.regexp_replace(meaning, r"\s*\((?:Waite|Mathers):.*?\)\s*$", ""), most_chars).alias("meaning"))


def repaired(df: DataFrame, renames: dict[str, str], swaps: Sequence[tuple[str, str, Column]] = ()) -> DataFrame:
    """Columns under their right names, and pairs of columns changed over where a condition holds. A misspelt column fills the right one where that is missing or blank."""
    for wrong, right in renames.items():
        if wrong in df.columns:
            own = [F.nullif(F.trim(right), F.lit(""))] if right in df.columns else []
            df = df.withColumn(right, F.coalesce(*own, F.col(wrong))).drop(wrong)
    for a, b, when in swaps:
        w = F.coalesce(when, F.lit(False))
        df = df.withColumns({a: F.when(w, F.col(b)).otherwise(F.col(a)), b: F.when(w, F.col(a)).otherwise(F.col(b))})
    return df


def complete_draws(df: DataFrame, id: str, draw: Column, kb: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(id, place, keys, columns of kb): each drawn item with its row; a record with any item unknown is left out whole."""
    d = df.select(id, F.posexplode(draw).alias("place", "x")).select(id, "place", *(F.col("x")[k].alias(k) for k in keys))
    found = d.join(small(kb.withColumn("__known", F.lit(True))), list(keys), "left")
    bad = found.where("__known is null").select(id).distinct()
    return found.join(bad, id, "left_anti").drop("__known")


def best_reply(posts: DataFrame, replies: DataFrame, id: str, good: Column, order: Sequence[Column], more: dict[str, Column]) -> DataFrame:
    """Each post with the first of its good replies by the order (of the columns ``more``), and how many there are; posts without one are left out."""
    from quern.operators.ordering import first_per

    r = replies.where(good)
    n = r.groupBy(id).agg(F.count("*").alias("replies"))
    best = first_per(r.select(id, *(c.alias(k) for k, c in more.items())), [id], order)
    return posts.join(best, id).join(n, id)


def planned(units: Sequence[DataFrame], id: Sequence[str], per: str, n: int, seed: int = 0) -> DataFrame:
    """Of the cross product of small value tables n combinations for each value of ``per``, the least by seeded MD5 of the key."""
    from quern.operators.ordering import first_per

    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), units)
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), *(F.col(c).cast("string") for c in id)))
    return first_per(grid.withColumn("__h", key), [per], [F.col("__h")], n).drop("__h")
