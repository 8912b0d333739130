"""Distributions, histograms and scores by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.functions.stats import bin_of, idf
from quern.functions.text import let


def as_key(c: Column, kind: T.DataType | None = None) -> Column:
    """As the text of a key; booleans are True and False."""
    return F.when(c, "True").when(~c, "False") if isinstance(kind, T.BooleanType) else c.cast("string")


def field_distributions(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, n) of many columns in one pass and one shuffle, by GROUPING SETS; nulls aren't counted."""
    d = df.select(*(as_key(F.col(f), df.schema[f].dataType).alias(f) for f in fields))
    names = [f"`{f}`" for f in fields]
    d.createOrReplaceTempView("__fields")
    sets = ", ".join(f"({n})" for n in names)
    g = d.sparkSession.sql(f"select {', '.join(names)}, grouping_id() as gid, count(*) as n from __fields group by grouping sets ({sets})")
    full = (1 << len(fields)) - 1
    pick = lambda i: F.col("gid") == full - (1 << (len(fields) - 1 - i))
    field = F.coalesce(*(F.when(pick(i), F.lit(f)) for i, f in enumerate(fields)))
    value = F.coalesce(*(F.when(pick(i), F.col(f"`{f}`")) for i, f in enumerate(fields)))
    return g.select(field.alias("field"), value.alias("value"), "n").where("value is not null")


def exploded_counts(df: DataFrame, items: Column, out: str = "value") -> DataFrame:
    return df.select(F.explode(items).alias(out)).groupBy(out).agg(F.count("*").alias("n"))


def card_mix(df: DataFrame, cards: str = "cards_used") -> DataFrame:
    """(card_id, frequency, upright, reversed): anything but reversed is upright; null cards aren't counted."""
    c = df.select(F.explode(cards).alias("c")).select("c.card_id", (F.coalesce(F.col("c.orientation"), F.lit("")) == "reversed").alias("r")).where("card_id is not null")
    return c.groupBy("card_id").agg(F.count("*").alias("frequency"), F.count_if(~F.col("r")).alias("upright"), F.count_if("r").alias("reversed"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n) for all bins; two passes, the first for the range. No rows for a table without values."""
    d = df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    r = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    n = d.crossJoin(F.broadcast(r)).groupBy(bin_of(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))
    all_ = r.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / bins
    return all_.join(n, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * w).alias("low"), (F.col("lo") + (F.col("bin") + 1) * w).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def stepped_histogram(df: DataFrame, value: str, per_unit: int = 20) -> DataFrame:
    """(bin_low, n) in steps of 1/per_unit from the step under the least value to the one over the greatest; the last bin is closed."""
    x = F.col(value).cast("double")
    r = df.where(x.isNotNull()).agg(F.floor(F.min(x) * per_unit).alias("lo"), F.ceil(F.max(x) * per_unit).alias("hi"))
    d = df.where(x.isNotNull()).crossJoin(F.broadcast(r))
    b = F.greatest(F.col("lo"), F.least(F.floor(x * per_unit), F.greatest(F.col("hi") - 1, F.col("lo"))))
    return d.groupBy(b.alias("b")).agg(F.count("*").alias("n")).select((F.col("b") / per_unit).alias("bin_low"), "n")


def length_stats(df: DataFrame, text: Column) -> DataFrame:
    """(n, least, most, mean) of the characters of texts that aren't empty."""
    return df.select(F.length(text).alias("l")).where("l > 0").agg(F.count("*").alias("n"), F.min("l").alias("least"), F.max("l").alias("most"), F.avg("l").alias("mean"))


def gram_counts(grams: DataFrame, gram: str = "gram") -> DataFrame:
    """(gram, n, share of the most frequent)."""
    c = grams.groupBy(gram).agg(F.count("*").alias("n"))
    top = c.agg(F.max("n").alias("top"))
    return c.crossJoin(F.broadcast(top)).select(gram, "n", (F.col("n") / F.col("top")).alias("share"))


def distinct_share(grams: DataFrame, gram: str = "gram", by: Sequence[str] = ()) -> DataFrame:
    """Different n-grams / n-grams, by group; counted in two steps, so no task sees all n-grams of a large group."""
    c = grams.groupBy(*by, gram).agg(F.count("*").alias("n"))
    return c.groupBy(*by).agg(F.count("*").alias("different"), F.sum("n").alias("total")).withColumn("distinct_n", F.col("different") / F.col("total"))


def blacklist(grams: DataFrame, protected: Sequence[str], ratio: float = 0.55, gram: str = "gram") -> DataFrame:
    """Grams nearly as frequent as the most frequent one, none with a protected token."""
    return gram_counts(grams, gram).where((F.col("share") >= ratio) & ~F.arrays_overlap(F.split(gram, " "), F.array(*map(F.lit, protected)).cast("array<string>")))


def tfidf(docs: DataFrame, doc: str, tokens: str) -> DataFrame:
    """(doc, term, weight): relative frequency times smoothed idf ln((1+n)/(1+df)) + 1."""
    t = docs.select(doc, F.size(tokens).alias("size"), F.explode(tokens).alias("term")).groupBy(doc, "size", "term").agg(F.count("*").alias("tf"))
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("docs"))
    return t.join(df, "term").crossJoin(F.broadcast(n)).select(doc, "term", (F.col("tf") / F.col("size") * idf(F.col("df"), F.col("docs"))).alias("weight"))


def retrieve(queries: DataFrame, docs: DataFrame, query: str, doc: str) -> DataFrame:
    """(query, doc, cosine): for each query the document with the highest cosine of sparse weights, the least document on ties. An inverted-index join on terms; no pair without a common term is made."""
    norm = lambda d, k: d.groupBy(k).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(f"{k}_norm"))
    dots = queries.select(query, "term", F.col("weight").alias("a")).join(docs.select(doc, "term", F.col("weight").alias("b")), "term").groupBy(query, doc).agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    s = dots.join(norm(queries, query), query).join(norm(docs, doc), doc).withColumn("cosine", F.round(F.col("dot") / (F.col(f"{query}_norm") * F.col(f"{doc}_norm")), 12))
    w = Window.partitionBy(query).orderBy(F.desc("cosine"), F.asc(doc))
    return s.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(query, doc, "cosine")


def layer_loss(layers: DataFrame, order: str, kept: str, dropped: str) -> DataFrame:
    """Adds ``lost``: the stated drop, else what the layer before kept and this one didn't. Layers are a handful of rows."""
    w = Window.partitionBy().orderBy(order)
    return layers.withColumn("lost", F.greatest(F.lit(0), F.coalesce(F.col(dropped), F.lag(kept).over(w) - F.col(kept), F.lit(0))))


def profile(tokens: DataFrame, vocabulary: Sequence[str], token: str = "token") -> DataFrame:
    """(word, frequency) for each word of the vocabulary, 0 where it doesn't occur."""
    spark = tokens.sparkSession
    v = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    total = tokens.agg(F.count("*").alias("all"))
    c = tokens.where(F.col(token).isin(list(vocabulary))).groupBy(F.col(token).alias("word")).agg(F.count("*").alias("n"))
    return v.join(c, "word", "left").crossJoin(F.broadcast(total)).select("word", F.coalesce(F.col("n") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0)).alias("frequency"))


def profile_distance(tokens: Column, frequencies: dict[str, float]) -> Column:
    """Mean relative deviation of a text from a profile; null without tokens (an infinite distance)."""
    used = sorted((w, f) for w, f in frequencies.items() if f > 0)
    if not used:
        return F.lit(None).cast("double")
    profile = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(f).alias("f")) for w, f in used))

    def distance(t: Column) -> Column:
        off = F.aggregate(profile, F.lit(0.0), lambda s, p: s + F.abs(F.size(F.filter(t, lambda x: x == p["w"])) / F.size(t) - p["f"]) / p["f"])
        return F.when(F.size(t) > 0, off / len(used))

    return let(tokens, distance)


def tightening(grams: DataFrame, batch: str, batches: int, ratio: float = 0.55, gram: str = "gram") -> DataFrame:
    """(batch, phrases, top): after each batch, from 0, how many phrases reach the ratio of the most frequent so far. Counts of a batch are made once and summed up over those before; each different phrase passes once per batch it is seen in."""
    counts = grams.groupBy(gram, batch).agg(F.count("*").alias("n"))
    later = F.sequence(F.col(batch), F.lit(batches - 1))
    c = counts.withColumn("__b", F.explode(later)).groupBy("__b", gram).agg(F.sum("n").alias("n"))
    top = c.groupBy("__b").agg(F.max("n").alias("top"))
    return c.join(F.broadcast(top), "__b").where(F.col("n") / F.col("top") >= ratio).groupBy(F.col("__b").alias(batch)).agg(F.count("*").alias("phrases"), F.max("top").alias("top"))  # a row per batch
