"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, defects, langid, lookalikes, mixing, neardup, overlap, sampling, splitting
from quern.plans.lineage import stored


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sft(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _t(spark, d, "sft_rows").select("example_id", *columns)


# 1: records across splits


def _overlaps(spark: SparkSession, d: str, band: int | None = None) -> DataFrame:
    return overlap.cross_split_pairs(_sft(spark, d, "reading_vi"), F.col("example_id"), F.col("reading_vi"), overlap.split_labels(_t(spark, d, "splits")), band=band)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(_overlaps(spark, d, 16), _sft(spark, d, "provenance"), F.col("example_id"), F.col("provenance")[0])


# 3: near-duplicate records


def _near(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(_sft(spark, d, "question_vi", "reading_vi"), F.col("example_id"), F.col("reading_vi"), F.col("question_vi"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select(F.col("id").alias("example_id"), "group_id")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select(F.col("id").alias("example_id"), "group_id", "links")


# 4: visually identical text


def _texts(spark: SparkSession, d: str) -> DataFrame:
    a = _sft(spark, d, "reading_vi").select(F.concat(F.lit("sft_rows\t"), "example_id").alias("id"), F.col("reading_vi").alias("text"))
    b = _t(spark, d, "anchor_readings").select(F.concat(F.lit("anchor_readings\t"), "anchor_id").alias("id"), F.col("prose_vi").alias("text"))
    return a.unionByName(b)


def _unified(spark: SparkSession, d: str, changed_only: bool) -> DataFrame:
    texts = _texts(spark, d)
    out = lookalikes.unify(texts, F.col("id"), F.col("text"), lookalikes.learn(texts.select("text")), changed_only)
    return out.select(F.substring_index("id", "\t", 1).alias("tbl"), F.expr("substr(id, instr(id, '\t') + 1)").alias("record_id"), "text", "changed")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _unified(spark, d, True).select("tbl", "record_id").distinct()


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    return _unified(spark, d, False)


# 5: splits that keep related records together


def _related(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    rows = _sft(spark, d, "spread_id", "card_ids", "cards_used", "safety_category", "matched_pair_id", "task_type")
    return rows, {"draw": splitting.draw_key(), "pair": splitting.pair_key()}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows, keys = _related(spark, d)
    g = splitting.related_groups(rows, F.col("example_id"), keys)
    many = g.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return g.join(many, "group_id").select(F.col("id").alias("example_id"), "group_id")


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    rows, keys = _related(spark, d)
    shares = {r["split"]: r["share"] for r in _t(spark, d, "split_targets").collect()}  # fixed, 3 rows
    out = splitting.assign_splits(rows, F.col("example_id"), keys, F.lower(F.trim("task_type")), shares)
    return out.select(F.col("id").alias("example_id"), "group_id", F.col("stratum").alias("task_type"), "split")


# 2: sample with target proportions


def _plan(spark: SparkSession, d: str) -> sampling.Plan:
    return sampling.plan(_t(spark, d, "sft_rows"), F.col("example_id"), _t(spark, d, "sample_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    p = _plan(spark, d)
    short = sampling.shortfalls(p.counts, p.dims, p.targets, p.size)
    return spark.createDataFrame(sorted(short), "dimension string, category string")


def _sample(spark: SparkSession, d: str) -> tuple[sampling.Plan, DataFrame]:
    p = _plan(spark, d)
    quota = {json.dumps(dict(zip(p.dims, k, strict=True)), ensure_ascii=False, separators=(",", ":")): n for k, n in sampling.quotas(p.counts, p.dims, p.targets, p.size).items()}
    return p, sampling.draw(p.labelled, quota)


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    p, drawn = _sample(spark, d)
    cell = F.from_json("cell", ", ".join(f"{x} string" for x in p.dims))
    return drawn.select(F.col("id").alias("example_id"), cell.alias("c")).select("example_id", "c.*")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    p, drawn = _sample(spark, d)
    cell = F.from_json("cell", ", ".join(f"{x} string" for x in p.dims))
    got = drawn.groupBy("cell").count().select(cell.alias("c"), "count").select(F.explode(F.array(*(F.struct(F.lit(x).alias("dimension"), F.col("c")[x].alias("form"), F.col("count").alias("n")) for x in p.dims))).alias("x")).select("x.*").groupBy("dimension", "form").agg(F.sum("n").alias("drawn"))
    want = spark.createDataFrame([(t.dimension, t.category, sampling.form(t.category), t.share, sampling.needed(t, p.size), p.have.get((t.dimension, sampling.form(t.category)), 0)) for t in p.targets], "dimension string, category string, form string, target_share double, needed long, available long")
    return want.join(got, ["dimension", "form"], "left").select("dimension", "category", "target_share", "needed", "available", F.greatest(F.col("needed") - F.coalesce("drawn", F.lit(0)), F.lit(0)).alias("shortfall"), F.coalesce("drawn", F.lit(0)).alias("drawn"), (F.coalesce("drawn", F.lit(0)) / p.size).alias("actual_share"))


# 6: broken pairs


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return defects.label_pairs(_sft(spark, d, "question_vi", "reading_vi", "task_type"), F.col("example_id"), F.col("question_vi"), F.col("reading_vi"), F.col("task_type"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select(F.col("id").alias("example_id"), "defect")


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select(F.col("id").alias("example_id"), F.explode(F.arrays_zip("defects", "posteriors")).alias("x")).select("example_id", F.col("x.defects").alias("defect"), F.col("x.posteriors").alias("posterior"))


# 7: encoding


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(_t(spark, d, "documents"), F.col("doc_id"), F.col("text")).withColumnRenamed("id", "doc_id")


# 8: mixing


def _sized(spark: SparkSession, d: str) -> tuple[DataFrame, list, int]:
    targets, budget = mixing.read_targets(_t(spark, d, "mix_targets"))
    docs = _t(spark, d, "documents").where(F.col("source").isin([t.source for t in targets]))
    return stored(bpe.token_counts(docs, {"doc_id": F.col("doc_id"), "source": F.col("source")}, F.col("text"))), targets, budget


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    sized, targets, budget = _sized(spark, d)
    return spark.createDataFrame([(s,) for s in mixing.short_sources(mixing.queue(sized, targets), targets, budget)], "source string")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.ordered(mixing.mix(*_sized(spark, d)))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    sized, targets, budget = _sized(spark, d)
    return mixing.report(mixing.mix(sized, targets, budget), targets, mixing.source_sizes(sized, targets), mixing.short_sources(mixing.queue(sized, targets), targets, budget))


# 9: languages


def _languages(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    names = [r[0] for r in _t(spark, d, "cards").select("name_en").distinct().collect()]  # fixed, 78
    return langid.languages(docs, F.col("doc_id"), F.col("text"), F.col("lang"), langid.train(docs, F.col("text"), F.col("lang")), names)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(_languages(spark, d)).select(F.col("id").alias("doc_id"), "lang")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select(F.col("id").alias("doc_id"), F.posexplode("passages").alias("passage", "x")).select("doc_id", "passage", "x.*")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_sample, p2_report, p3_found, p3_links, p4_found, p4_texts, p5_found, p5_splits, p6_found, p6_labels, p7_ids, p8_found, p8_mix, p8_report, p9_found, p9_passages)}
# SQL where it can say the result; the others are tested against brute force and definitions (tests/llm).
ORACLES: dict[str, str] = {
    "p2_found": """with r as (select example_id, min(task_type) as task_type, min(register) as register, min(length_band) as length_band, min(querent_context) as querent_context from sft_rows group by 1),
        u as (unpivot r on task_type, register, length_band, querent_context into name dimension value category),
        h as (select dimension, lower(trim(nfc_normalize(category))) as form, count(*) as n from u group by 1, 2)
        select t.dimension, t.category from sample_targets t left join h on h.dimension = t.dimension and h.form = lower(trim(nfc_normalize(t.category)))
        where coalesce(n, 0) < greatest(min_rows, ceil(round(target_share * sample_size, 6)))""",
    "p5_found": """with recursive k as (select distinct example_id as id, case when spread_id is not null and len(c) > 0 then spread_id || list_sort(list_distinct(c))::varchar end as draw, safety_category || '/' || matched_pair_id as pair
            from (select *, list_filter(coalesce(card_ids, list_transform(cards_used, lambda x: x.card_id)), lambda x: x is not null) as c from sft_rows)),
        h as (select id, min(id) over (partition by draw) as head from k where draw is not null union select id, min(id) over (partition by pair) from k where pair is not null),
        e as (select id as x, head as y from h union select head, id from h),
        reach as (select distinct id, id as root from k union select e.y, reach.root from reach join e on e.x = reach.id),
        g as (select id, min(root) as group_id, count(*) as n from reach group by 1)
        select id as example_id, group_id from g where n > 1""",
}
