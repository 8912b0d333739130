"""The library's own queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import canonical, stats, text
from quern.operators import aggregating, conforming, deduplicating, filtering, integrity, ordering, partitioning, scheduling, validating
from quern.plans.lineage import checkpoint, stored
from quern.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Records once each: a record delivered again differs in its time of ingestion only.
ONCE = "(select * from sft_rows qualify row_number() over (partition by example_id order by ingested_at) = 1)"
TOKENS = f"regexp_extract_all({{}}, '(?i){text.TOKEN}')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Columns of long texts, which aren't shuffled to find the first delivery.
LONG = {"reading_vi", "target_vi", "question_vi", "reading_vi_original", "position_glosses"}


def records(spark: SparkSession, d: str, *columns: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """First delivery of each record, of the wanted columns only.

    A record delivered again differs in its time of ingestion only, so ``keep``, a
    filter, may come first, at the scan. Long texts aren't shuffled: ids that
    occur twice are found on narrow columns, and only their rows are aggregated.
    """
    t = table(spark, d, "sft_rows")
    if keep is not None:
        t = keep(t)
    wanted = [c for c in columns if c != "example_id"]
    if not wanted:
        return t.select("example_id").distinct()

    def first(x: DataFrame) -> DataFrame:
        g = x.groupBy("example_id").agg(F.min_by(F.struct(*wanted), "ingested_at").alias("x"))
        return g.select("example_id", *(F.col(f"x.{c}").alias(c) for c in wanted))

    if not LONG & {*wanted}:
        return first(t)
    again = conforming.small(t.groupBy("example_id").agg(F.count("*").alias("n")).where("n > 1").select("example_id"))
    narrow = t.select("example_id", "ingested_at", *wanted)
    return narrow.join(again, "example_id", "left_anti").select("example_id", *wanted).unionByName(first(narrow.join(again, "example_id", "left_semi")))


def deliveries(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Every delivery of each record: (delivery, key) and the wanted columns.

    ``delivery`` is unique and in the order of ids, then of deliveries: the id, for a
    later one with its number. ``key`` is the hash of the whole row but its time of
    ingestion. Only rows of ids that occur twice are shuffled.
    """
    t = table(spark, d, "sft_rows")
    key = F.sha2(canonical.canonical_json(t, [c for c in t.columns if c != "ingested_at"]), 256)
    again = conforming.small(t.groupBy("example_id").agg(F.count("*").alias("n")).where("n > 1").select("example_id"))
    r = t.select("example_id", "ingested_at", *columns, key.alias("key"))
    number = F.row_number().over(Window.partitionBy("example_id").orderBy("ingested_at", "key"))
    later = F.concat("example_id", F.lit("\x01"), F.lpad(F.col("n").cast("string"), 10, "0"))
    more = r.join(again, "example_id", "left_semi").withColumn("n", number).withColumn("delivery", F.when(F.col("n") == 1, F.col("example_id")).otherwise(later))
    once = r.join(again, "example_id", "left_anti").withColumn("delivery", F.col("example_id"))
    out = ("delivery", "key", *columns)
    return once.select(*out).unionByName(stored(more.select(*out)))


# --- rows: filters, search, pages, lookups


@query(f"""select example_id, task_type, querent_context, ifd_score from {ONCE} r
    where register = 'warm' and (ifd_score is null or (ifd_score >= -0.1 and ifd_score <= 0.5))
      and contains(lower(concat_ws(chr(0), question_vi, reading_vi, array_to_string(position_glosses, chr(0)))), lower('CON THUYỀN'))
    order by example_id limit 50""")
def rows_filter_page(spark, d):
    f = filtering.RowFilter(register="warm", ifd_min=-0.1, ifd_max=0.5, q="CON THUYỀN")
    r = records(spark, d, "task_type", "querent_context", "ifd_score", keep=lambda t: filtering.matching(t, f, kind="sft"))
    return ordering.page(r, [F.col("example_id")], 1, 50).select("example_id", "task_type", "querent_context", "ifd_score")


@query("select c_custkey, c_name, c_acctbal from customer where c_custkey = 42")
def rows_point_lookup(spark, d):
    return filtering.lookup(table(spark, d, "customer"), "c_custkey", "42").select("c_custkey", "c_name", "c_acctbal")


@query("select card_id, orientation, name_en from cards where card_id = 7 and orientation = 'reversed'")
def rows_composite_lookup(spark, d):
    return filtering.lookup(table(spark, d, "cards"), "card_id,orientation", "7/reversed").select("card_id", "orientation", "name_en")


@query(f"select example_id from {ONCE} where list_contains(card_ids, 7) and list_contains(orientations, 'reversed')")
def rows_membership_filter(spark, d):
    return records(spark, d, keep=lambda t: filtering.matching(t, filtering.RowFilter(card_id="7", orientation="reversed")))


@query(f"select example_id, ifd_score from {ONCE} where ifd_score is null or ifd_score >= 0.2")
def rows_score_range(spark, d):
    return records(spark, d, "ifd_score", keep=lambda t: filtering.matching(t, filtering.RowFilter(ifd_min=0.2)))


@query("select tier, count(*) as n, count(ifd_score) as scored from sft_rows group by tier")
def union_tier_tagged(spark, d):
    t = table(spark, d, "sft_rows").select("tier", "ifd_score")
    parts = {k: t.where(F.col("tier") == k).drop("tier") for k in ("core", "bulk")}
    return filtering.tagged_union(parts).groupBy("tier").agg(F.count("*").alias("n"), F.count("ifd_score").alias("scored"))


@query("""select sha256(string_agg('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}', chr(10) order by n_nationkey)) as digest from nation""")
def export_ndjson_digest(spark, d):
    n = table(spark, d, "nation")
    return canonical.digest(n, canonical.canonical_json(n), [F.col("n_nationkey")])


def _json_sql(columns: dict[str, str]) -> str:
    """SQL of a canonical JSON object of the columns: their kinds are text, number or list (of texts)."""
    said = {"text": "coalesce(to_json({})::varchar, 'null')", "number": "coalesce({}::varchar, 'null')", "list": "coalesce(to_json({})::varchar, 'null')"}
    return "'{' || " + " || ',' || ".join(f"'\"{c}\":' || {said[k].format(c)}" for c, k in sorted(columns.items())) + " || '}'"


CARD_COLUMNS = dict.fromkeys(("name_en", "name_vi_gloss", "arcana", "suit", "rank_name", "orientation", "element", "polarity_axis", "meaning_en", "meaning_vi", "yes_no", "vi_provenance"), "text") | {"card_id": "number", "keywords_vi": "list"}


@query(f"select card_id, orientation, {_json_sql(CARD_COLUMNS)} as line from cards")
def canonical_json_rows(spark, d):
    c = table(spark, d, "cards")
    return c.select("card_id", "orientation", canonical.canonical_json(c).alias("line"))


@query()
def tree_digest_lineitem(spark, d):
    li = table(spark, d, "lineitem")
    return canonical.tree_digest(li, canonical.canonical_json(li))


@query("""select c_mktsegment, count(*) as n from customer group by 1 order by n desc, 1 limit 3""")
def most_common_values(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_mktsegment").limit(3)


# --- joins and set operations

RANKS = {"ace": ["one", "1"], "two": ["2"], "three": ["3"], "four": ["4"], "five": ["5"], "six": ["6"], "seven": ["7"], "eight": ["8"], "nine": ["9"], "ten": ["10"], "page": ["princess"], "knight": [], "queen": [], "king": []}
SUITS = {"cups": ["chalices"], "wands": ["rods", "staves"], "swords": ["blades"], "pentacles": ["coins", "discs"]}
ASKED = ["fool", "The  Moon", "moon", "ace of coins", "2 of rods", "Nine of Swords", "Magician", "knight chalices", "the strength", "Unknown Card"]


@query(
    "with c as (select distinct card_id, lower(name_en) as n from cards), asked(name, want) as (values ('fool', 'the fool'), ('The  Moon', 'the moon'), ('moon', 'the moon'), ('ace of coins', 'ace of pentacles'), ('2 of rods', 'two of wands'), ('Nine of Swords', 'nine of swords'), ('Magician', 'the magician'), ('knight chalices', 'knight of cups'), ('the strength', 'strength'), ('Unknown Card', null)) select name, card_id as resolved_id from asked left join c on n = want"
)
def alias_resolution_join(spark, d):
    aliases = conforming.alias_table(table(spark, d, "cards"), "card_id", "name_en", RANKS, SUITS)
    return conforming.resolve(spark.createDataFrame([(n,) for n in ASKED], "name string"), "name", aliases)


@query("select distinct name_en from anchor_readings where lower(name_en) not in (select lower(name_en) from cards)")
def alias_unresolved(spark, d):
    return conforming.unresolved(conforming.guard_name_keyed(table(spark, d, "anchor_readings").select("name_en")), "name_en", conforming.alias_table(table(spark, d, "cards"), "card_id", "name_en"))


@query("""with u as (select card_id, name_en, meaning_vi from cards where orientation = 'upright'), r as (select card_id, meaning_vi as reversed_vi, polarity_axis from cards where orientation = 'reversed'),
    a as (select card_id, orientation, max_by(prose_vi, anchor_id) as prose from anchor_readings where prose_vi is not null group by 1, 2)
    select u.card_id, name_en, length(meaning_vi)::int as upright_chars, length(reversed_vi)::int as reversed_chars, polarity_axis, length(x.prose)::int as upright_anchor_chars, length(y.prose)::int as reversed_anchor_chars
    from u join r using (card_id) left join a x on x.card_id = u.card_id and x.orientation = 'upright' left join a y on y.card_id = u.card_id and y.orientation = 'reversed'""")
def multi_source_conform(spark, d):
    c = table(spark, d, "cards")
    u = c.where("orientation = 'upright'").select("card_id", "name_en", F.length("meaning_vi").alias("upright_chars"))
    r = c.where("orientation = 'reversed'").select("card_id", F.length("meaning_vi").alias("reversed_chars"), "polarity_axis")
    a = table(spark, d, "anchor_readings").where("prose_vi is not null").groupBy("card_id", "orientation").agg(F.length(F.max_by("prose_vi", "anchor_id")).alias("n"))
    side = lambda o: conforming.small(a.where(F.col("orientation") == o).select("card_id", F.col("n").alias(f"{o}_anchor_chars")))
    return u.join(conforming.small(r), "card_id").join(side("upright"), "card_id", "left").join(side("reversed"), "card_id", "left")


@query(f"""with s as (select distinct example_id, case lower(trim(split)) when 'validation' then 'val' else lower(trim(split)) end as split from splits)
    select split, lower(trim(task_type)) as task_type, count(*) as n from {ONCE} r left join s using (example_id) group by 1, 2""")
def split_left_join_crosstab(spark, d):
    s = table(spark, d, "splits").select("example_id", F.lower(F.trim("split")).alias("s")).select("example_id", F.when(F.col("s") == "validation", "val").otherwise(F.col("s")).alias("split")).distinct()
    r = records(spark, d, "task_type").select("example_id", F.lower(F.trim("task_type")).alias("task_type"))
    return conforming.crosstab_with_labels(r, s, "example_id", "split", "task_type")


@query("""select lower(trim(task_type)) as task_type, count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val, count(*) filter (split = 'test') as test
    from (select distinct example_id, case lower(trim(split)) when 'validation' then 'val' else lower(trim(split)) end as split from splits) join (select example_id, min(task_type) as task_type from sft_rows group by 1) using (example_id) group by 1""")
def split_task_pivot(spark, d):
    s = table(spark, d, "splits").select("example_id", F.regexp_replace(F.lower(F.trim("split")), "^validation$", "val").alias("split")).distinct()
    r = records(spark, d, "task_type").select("example_id", F.lower(F.trim("task_type")).alias("task_type"))
    return r.join(s, "example_id").groupBy("task_type").pivot("split", ["train", "val", "test"]).count().na.fill(0)


@query("""select tier, count(*) as orders, sum(o_totalprice)::decimal(38, 2)::double as total from (
    select case when o_orderkey in (select l_orderkey from lineitem where l_quantity >= 45) then 'core' else 'bulk' end as tier, o_totalprice::decimal(18, 2) as o_totalprice from orders) group by 1""")
def semi_anti_tiers(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    big = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    parts = {"core": o.join(big, "o_orderkey", "left_semi"), "bulk": o.join(big, "o_orderkey", "left_anti")}
    return filtering.tagged_union(parts).groupBy("tier").agg(F.count("*").alias("orders"), F.sum("p").cast("double").alias("total"))


@query("""select s.spread_id, c.card_id, c.orientation from (select spread_id from spreads) s, (select card_id, orientation from cards) c
    where not exists (select 1 from (select spread_id, unnest(cards_used) as u from sft_rows) r where r.spread_id = s.spread_id and u.card_id = c.card_id and u.orientation = c.orientation)""")
def coverage_missing_grid(spark, d):
    present = table(spark, d, "sft_rows").select("spread_id", F.explode("cards_used").alias("u")).select("spread_id", "u.card_id", "u.orientation")
    return conforming.missing_combinations(present, [table(spark, d, "spreads").select("spread_id"), table(spark, d, "cards").select("card_id", "orientation")])


@query(f"""select u.card_id, round(len(list_intersect(u.t, r.t)) / len(list_distinct(u.t || r.t)), 9) as jaccard
    from (select card_id, list_distinct({TOKENS.format("lower(meaning_vi)")}) as t from cards where orientation = 'upright') u
    join (select card_id, list_distinct({TOKENS.format("lower(meaning_vi)")}) as t from cards where orientation = 'reversed') r using (card_id)""")
def pair_self_join_jaccard(spark, d):
    return _card_pairs(spark, d).select("card_id", F.round("jaccard", 9).alias("jaccard"))


def _card_pairs(spark, d):
    c = table(spark, d, "cards").select("card_id", "orientation", F.array_distinct(text.tokens(F.lower("meaning_vi"))).alias("t"))
    r = conforming.small(c.where("orientation = 'reversed'").select("card_id", F.col("t").alias("r")))
    return c.where("orientation = 'upright'").join(r, "card_id").select("card_id", text.jaccard(F.col("t"), F.col("r")).alias("jaccard"))


@query(f"""with p as ({ORACLES["pair_self_join_jaccard"]}), r as (select floor(min(jaccard) * 20) as lo, ceil(max(jaccard) * 20) as hi from p)
    select (greatest(lo, least(floor(jaccard * 20), greatest(hi - 1, lo))) / 20)::double as bin_low, count(*) as n from p, r group by 1""")
def jaccard_histogram(spark, d):
    return aggregating.stepped_histogram(_card_pairs(spark, d).withColumn("jaccard", F.round("jaccard", 9)), "jaccard")


@query(f"""select safety_category, matched_pair_id, count(*) as n, max(matched_member) filter (matched_member = 'risk') is not null as has_risk from {ONCE} where matched_pair_id is not null group by 1, 2 having count(*) >= 2""")
def matched_pairs(spark, d):
    r = records(spark, d, "safety_category", "matched_pair_id", "matched_member").where("matched_pair_id is not null")
    return r.groupBy("safety_category", "matched_pair_id").agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("matched_member") == "risk"), F.lit(False)).alias("has_risk")).where("n >= 2")


@query(f"""select r.example_id, coalesce(r.ifd_score, s.ifd_score) as score from {ONCE} r left join (select example_id, min(ifd_score) as ifd_score from ifd_scores group by 1) s using (example_id)""")
def score_reuse_merge(spark, d):
    return conforming.fill_down(records(spark, d, "ifd_score"), table(spark, d, "ifd_scores"), "example_id", "ifd_score", "score").select("example_id", "score")


@query(f"""select anchor_id from anchor_readings a where prose_vi is not null and not exists (select 1 from {ONCE} r where r.reading_vi = a.prose_vi)""")
def contamination_anti_join(spark, d):
    a = table(spark, d, "anchor_readings").where("prose_vi is not null").select("anchor_id", F.col("prose_vi").alias("t"))
    r = table(spark, d, "sft_rows").select(F.col("reading_vi").alias("t")).where("t is not null")
    return a.join(r, "t", "left_anti").select("anchor_id")


@query("""with need as (select distinct lower(trim(task_type)) as task_type from sft_rows), have as (select distinct lower(trim(task_type)) as task_type from sft_rows join splits using (example_id) where lower(trim(split)) = 'test')
    select task_type, task_type in (select task_type from have) as in_test from need""")
def superset_check(spark, d):
    r = records(spark, d, "task_type").select("example_id", F.lower(F.trim("task_type")).alias("task_type"))
    t = table(spark, d, "splits").where(F.lower(F.trim("split")) == "test").select("example_id")
    have = r.join(t, "example_id", "left_semi").select("task_type").distinct().withColumn("__h", F.lit(True))
    return r.select("task_type").distinct().join(conforming.small(have), "task_type", "left").select("task_type", F.coalesce("__h", F.lit(False)).alias("in_test"))


# --- distributions, histograms, percentiles

FIELDS = ["tier", "task_type", "register", "length_band", "querent_context", "spread_id", "critique_applied", "safety_category", "matched_member"]


@query(" union all ".join(f"select '{f}' as field, {f'case when {f} then $$True$$ else $$False$$ end' if f == 'critique_applied' else f} as value, count(*) as n from {ONCE} where {f} is not null group by 2" for f in FIELDS).replace("$$", "'"))
def field_distributions(spark, d):
    return aggregating.field_distributions(records(spark, d, *FIELDS), FIELDS)


@query(f"select coalesce(len(cards_used), 0)::int as cards, coalesce(critique.verdict, 'no_critique') as verdict, count(*) as n from {ONCE} group by 1, 2")
def nested_distributions(spark, d):
    r = records(spark, d, "cards_used", "critique")
    return r.groupBy(F.coalesce(F.size("cards_used"), F.lit(0)).alias("cards"), F.coalesce("critique.verdict", F.lit("no_critique")).alias("verdict")).agg(F.count("*").alias("n"))


@query(f"select tag as value, count(*) as n from (select unnest(provenance) as tag from {ONCE}) group by 1")
def provenance_counts(spark, d):
    return aggregating.exploded_counts(records(spark, d, "provenance"), F.col("provenance"))


@query(f"""with u as (select unnest(cards_used) as c from {ONCE}) select c.card_id as card_id, count(*) as frequency, count(*) filter (coalesce(c.orientation, '') <> 'reversed') as upright, count(*) filter (coalesce(c.orientation, '') = 'reversed') as reversed from u where c.card_id is not null group by 1""")
def per_card_mix(spark, d):
    return aggregating.card_mix(records(spark, d, "cards_used"))


@query(f"""with u as (select unnest(cards_used) as c from {ONCE}), n as (select c.card_id as card_id, count(*) as n from u group by 1) select i as card_id, coalesce(n, 0) as n from range(80) t(i) left join n on n.card_id = i""")
def zero_filled_matrix(spark, d):
    n = aggregating.card_mix(records(spark, d, "cards_used")).select("card_id", F.col("frequency").alias("n"))
    return spark.range(80).withColumnRenamed("id", "card_id").join(n, "card_id", "left").na.fill(0, ["n"])


@query("""with x as (select l_extendedprice as x from lineitem), r as (select min(x) as lo, max(x) as hi from x), b as (select least(floor((x - lo) / ((hi - lo) / 10)), 9)::int as bin, count(*) as n from x, r group by 1)
    select i::int as bin, round(lo + i * ((hi - lo) / 10), 6) as low, round(lo + (i + 1) * ((hi - lo) / 10), 6) as high, coalesce(n, 0) as n from range(10) t(i) cross join r left join b on bin = i""")
def histogram_10bin(spark, d):
    h = aggregating.histogram(table(spark, d, "lineitem"), "l_extendedprice")
    return h.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query("""with s as (select n_chars as v, row_number() over (order by n_chars) as r, count(*) over () as n from documents where n_chars is not null), p(p) as (values (0.25::double), (0.5::double), (0.75::double), (0.9::double)) select p, v as value from p, s where r = least(n, floor(p * n)::bigint + 1)""")
def length_percentiles(spark, d):
    return ordering.percentiles(table(spark, d, "documents"), "n_chars", [0.25, 0.5, 0.75, 0.9])


@query("select source, count(*) as n, min(length(text))::int as least, max(length(text))::int as most, round(avg(length(text)), 6) as mean from documents where length(text) > 0 group by source")
def length_stats(spark, d):
    t = table(spark, d, "documents").select("source", F.length("text").alias("l")).where("l > 0")
    return t.groupBy("source").agg(F.count("*").alias("n"), F.min("l").alias("least"), F.max("l").alias("most"), F.round(F.avg("l"), 6).alias("mean"))


@query("select event_type, k as key, count(*) as n from (select event_type, unnest(json_keys(props)) as k, props from events) group by 1, 2")
def map_key_coverage(spark, d):
    e = table(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return e.groupBy("event_type", "key").agg(F.count("*").alias("n"))


@query("select spread_id, cards_drawn, len(positions)::int as positions, len(list_filter(positions, lambda p: trim(p.gloss_compact) = ''))::int as empty_glosses, difficulty_ordinal from spreads")
def spread_stats(spark, d):
    s = table(spark, d, "spreads")
    return s.select("spread_id", "cards_drawn", F.size("positions").alias("positions"), F.size(F.filter("positions", lambda p: F.trim(p["gloss_compact"]) == "")).alias("empty_glosses"), "difficulty_ordinal")


@query("select card_id, orientation, count(*) as n, count(prose_vi) as with_prose from anchor_readings group by grouping sets ((card_id), (orientation))")
def anchor_counts(spark, d):
    table(spark, d, "anchor_readings").createOrReplaceTempView("__anchors")
    return spark.sql("select card_id, orientation, count(*) as n, count(prose_vi) as with_prose from __anchors group by grouping sets ((card_id), (orientation))")


@query("select arcana, coalesce(suit, 'none') as suit, orientation, count(*) as n, count(polarity_axis) as with_axis from cards where contains(lower(name_en || ' ' || meaning_en), 'the') group by 1, 2, 3")
def card_filters(spark, d):
    c = table(spark, d, "cards").where(filtering.search(table(spark, d, "cards").select("name_en", "meaning_en"), "the"))
    return c.groupBy("arcana", F.coalesce("suit", F.lit("none")).alias("suit"), "orientation").agg(F.count("*").alias("n"), F.count("polarity_axis").alias("with_axis"))


# --- text measures

BIGRAMS = f"(select *, {TOKENS.format('reading_vi')} as t from {ONCE} where reading_vi is not null)"


@query(f"""with g as (select lower(trim(task_type)) as task_type, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as gram from {BIGRAMS} where len(t) >= 2)
    select task_type, count(distinct gram) as different, count(*)::bigint as total, round(count(distinct gram) / count(*), 9) as distinct_n from g group by 1""")
def distinct_n(spark, d):
    r = records(spark, d, "task_type", "reading_vi").select(F.lower(F.trim("task_type")).alias("task_type"), F.explode(text.ngrams(text.tokens(F.col("reading_vi")), 2)).alias("gram"))
    return aggregating.distinct_share(r, by=["task_type"]).select("task_type", "different", "total", F.round("distinct_n", 9).alias("distinct_n"))


@query(f"""with r as (select *, ((row_number() over (order by example_id) - 1) // 100)::bigint as w from {BIGRAMS}), g as (select w, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as gram from r where len(t) >= 2)
    select w as window_no, round(count(distinct gram) / count(*), 9) as distinct_n from g group by 1""")
def distinct_n_windows(spark, d):
    r = ordering.ranked(records(spark, d, "reading_vi").where("reading_vi is not null"), [F.col("example_id")])
    g = r.select(F.floor((F.col("rank") - 1) / 100).alias("window_no"), F.explode(text.ngrams(text.tokens(F.col("reading_vi")), 2)).alias("gram"))
    return aggregating.distinct_share(g, by=["window_no"]).select("window_no", F.round("distinct_n", 9).alias("distinct_n"))


@query(f"""with g as (select unnest(list_transform(range(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3])) as gram from {BIGRAMS} where len(t) >= 4), c as (select gram, count(*) as n from g group by 1)
    select gram, n, round(n / (select max(n) from c), 9) as share from c where n / (select max(n) from c) >= 0.55 and not list_has_any(string_split(gram, ' '), ['xuôi', 'ngược'])""")
def ngram_blacklist(spark, d):
    g = records(spark, d, "reading_vi").select(F.explode(text.ngrams(text.tokens(F.col("reading_vi")), 4)).alias("gram"))
    return aggregating.blacklist(g, ["xuôi", "ngược"]).select("gram", "n", F.round("share", 9).alias("share"))


@query("""with t as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents) select term, count(*) as df from t group by 1 having count(*) >= 5""")
def term_document_frequency(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(text.ascii_tokens(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df")).where("df >= 5")


@query("""with pos as (select spread_id || '/' || p.index as pos, spread_id, regexp_extract_all(lower(p.label_en), '[a-z0-9]+') as q, regexp_extract_all(lower(p.label_en || ' ' || p.gloss_compact), '[a-z0-9]+') as t from (select spread_id, unnest(positions) as p from spreads)),
    tf as (select pos, term, count(*) / any_value(n) as tf from (select pos, len(t) as n, unnest(t) as term from pos) group by 1, 2), df as (select term, count(*) as df from tf group by 1),
    qtf as (select pos, term, count(*) / any_value(n) as tf from (select pos, len(q) as n, unnest(q) as term from pos) group by 1, 2), qdf as (select term, count(*) as df from qtf group by 1),
    n as (select count(*) as n from pos), dw as (select pos as doc, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (term), n), qw as (select pos as q, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from qtf join qdf using (term), n),
    dot as (select q, doc, sum(a.w * b.w) as dot from qw a join dw b using (term) group by 1, 2), s as (select q, doc, round(dot / (sqrt((select sum(w * w) from qw x where x.q = dot.q)) * sqrt((select sum(w * w) from dw y where y.doc = dot.doc))), 12) as cosine from dot)
    select q as query, doc, round(cosine, 9) as cosine from s qualify row_number() over (partition by q order by cosine desc, doc) = 1""")
def tfidf_retrieval(spark, d):
    p = table(spark, d, "spreads").select("spread_id", F.explode("positions").alias("p")).select(F.concat_ws("/", "spread_id", F.col("p.index").cast("string")).alias("pos"), text.ascii_tokens(F.col("p.label_en")).alias("q"), text.ascii_tokens(F.concat_ws(" ", "p.label_en", "p.gloss_compact")).alias("t"))
    queries, docs = aggregating.tfidf(p.select(F.col("pos").alias("query"), "q"), "query", "q"), aggregating.tfidf(p.select(F.col("pos").alias("doc"), "t"), "doc", "t")
    return aggregating.retrieve(queries, docs, "query", "doc").select("query", "doc", F.round("cosine", 9).alias("cosine"))


@query(f"""with t as (select unnest({TOKENS.format("lower(reading_vi)")}) as t from {ONCE}), n as (select count(*) as n from t) select w as word, round(coalesce(c, 0) / n, 12) as frequency from (select unnest({text.FUNCTION_WORDS}) as w) left join (select t, count(*) as c from t group by 1) on t = w cross join n""")
def function_word_profile(spark, d):
    t = records(spark, d, "reading_vi").select(F.explode(text.tokens(F.lower("reading_vi"))).alias("token"))
    return aggregating.profile(t, text.FUNCTION_WORDS).select("word", F.round("frequency", 12).alias("frequency"))


@query(f"""with p as ({ORACLES["function_word_profile"]}), a as (select anchor_id, {TOKENS.format("prose_vi")} as t from anchor_readings where prose_vi is not null)
    select anchor_id, round(avg(abs(len(list_filter(t, lambda x: x = word)) / len(t) - frequency) / frequency), 6) as distance from a, p where frequency > 0 and len(t) > 0 group by 1""")
def profile_distance(spark, d):
    freq = {r["word"]: r["frequency"] for r in function_word_profile(spark, d).collect()}  # a fixed vocabulary
    a = table(spark, d, "anchor_readings").where("prose_vi is not null").select("anchor_id", text.tokens(F.col("prose_vi")).alias("t"))
    return a.select("anchor_id", F.round(aggregating.profile_distance(F.col("t"), freq), 6).alias("distance")).where("distance is not null")


@query(f"""select doc_id, round(case when len(t) > 0 then len(list_filter(t, lambda x: regexp_matches(x, '(?i)[{text.MARKED}]'))) / len(t) else 0 end, 9) as ratio from (select doc_id, {TOKENS.format("text")} as t from documents where text is not null)""")
def diacritic_ratio(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(text.diacritic_ratio(F.col("text")), 9).alias("ratio"))


@query(f"""with n as (select doc_id, ' ' || regexp_replace(lower(text), '[^\\pL\\pN_]+', ' ', 'g') || ' ' as t, lower(text) as low from documents where text is not null),
    h as (select doc_id, ({"+".join(f"(regexp_matches(low, '(^|[^\\pL\\pN_]){x}($|[^\\pL\\pN_])'))::int" for x in text.UPRIGHT_TERMS)}) as u, ({"+".join(f"(regexp_matches(low, '(^|[^\\pL\\pN_]){x}($|[^\\pL\\pN_])'))::int" for x in text.REVERSED_TERMS)}) as r from n)
    select doc_id, round(case when u + r > 0 then (u - r) / (u + r) else 0 end, 6) as score, (u + r)::int as hits, case when u + r = 0 or abs((u - r) / (u + r)) < 0.15 then 'vi_orientation_agnostic' when u > r then 'vi_upright' else 'vi_reversed_skew' end as attribution from h""")
def polarity_attribution(spark, d):
    p = table(spark, d, "documents").where("text is not null").select("doc_id", text.polarity(F.col("text")).alias("p"))
    return p.select("doc_id", F.round("p.score", 6).alias("score"), "p.hits", "p.attribution")


def _claims(c: str) -> str:
    return ", ".join(f"case when regexp_matches({c}, '(?i)(^|[^\\pL\\pN_])({'|'.join(p.replace(' ', '\\s+') for p in ps)})($|[^\\pL\\pN_])') then '{n}' end" for n, ps in text.FORBIDDEN.items())


@query(f"select example_id, array_to_string(list_filter([{_claims('reading_vi')}, {_claims('question_vi').replace('then ', 'then $$q:$$ || ')}], lambda x: x is not null), ',') as claims from {ONCE}".replace("$$", "'"))
def forbidden_claim_flags(spark, d):
    r = records(spark, d, "reading_vi", "question_vi")
    both = F.concat(F.coalesce(text.matched_categories(F.col("reading_vi"), text.FORBIDDEN), F.array()), F.transform(F.coalesce(text.matched_categories(F.col("question_vi"), text.FORBIDDEN), F.array()), lambda x: F.concat(F.lit("q:"), x)))
    return r.select("example_id", F.array_join(both, ",").alias("claims"))


@query("""select anchor_id, round(len(list_filter(keywords_vi, lambda k: k <> '' and contains(lower(prose_vi), lower(k)))) / len(keywords_vi), 9) as containment from anchor_readings join cards using (card_id, orientation) where prose_vi is not null and len(keywords_vi) > 0""")
def keyword_containment(spark, d):
    k = conforming.small(table(spark, d, "cards").select("card_id", "orientation", "keywords_vi").where(F.size("keywords_vi") > 0))
    a = table(spark, d, "anchor_readings").where("prose_vi is not null").select("anchor_id", "card_id", "orientation", "prose_vi")
    return a.join(k, ["card_id", "orientation"]).select("anchor_id", F.round(text.keyword_containment(F.col("prose_vi"), F.col("keywords_vi")), 9).alias("containment"))


@query("""with k as (select card_id, orientation, list_filter(list_transform(keywords_vi, lambda x: trim(x)), lambda x: x is not null and x <> '') as ks from cards) select card_id, orientation, array_to_string(list_filter(ks, lambda x, i: list_position(list_transform(ks, lambda y: lower(y)), lower(x)) = i)[1:9], '|') as keywords from k""")
def keyword_distinct(spark, d):
    return table(spark, d, "cards").select("card_id", "orientation", F.array_join(text.distinct_ignoring_case(F.col("keywords_vi"), 9), "|").alias("keywords"))


@query("""with c as (select card_id, orientation, keywords_vi[1:5] as k, case when length(m) > 80 then rtrim(m[1:77]) || '...' else m end as m from (select *, regexp_replace(meaning_en, '\\s*\\((?:Waite|Mathers):.*?\\)\\s*$', '') as m from cards))
    select card_id, orientation, array_to_string(k, '|') as keywords, m as meaning from c""")
def compact_cards(spark, d):
    c = table(spark, d, "cards").select("card_id", "orientation", conforming.compact_card(F.col("keywords_vi"), F.col("meaning_en"), 5, 80).alias("x"))
    return c.select("card_id", "orientation", F.array_join("x.keywords", "|").alias("keywords"), "x.meaning")


@query("select round(avg(greatest(1, len(regexp_extract_all(meaning_en, '[\\pL\\pM\\p{Nd}\\p{Pc}]+|[^\\pL\\pM\\p{Nd}\\p{Pc}\\s\\x0b\\x{85}\\p{Z}]')))), 6) as mean_tokens from cards")
def mean_token_estimate(spark, d):
    return table(spark, d, "cards").agg(F.round(F.avg(text.token_estimate(F.col("meaning_en"))), 6).alias("mean_tokens"))


@query("select p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@query("select doc_id, coalesce(nullif(trim(author), ''), nullif(trim(lang), ''), source) as label from documents")
def first_filled(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_filled(F.col("author"), F.col("lang"), F.col("source")).alias("label"))


@query("select n_nationkey, 'A & B ' || n_name as plain from nation")
def html_to_text(spark, d):
    page = F.concat(F.lit("<html><script>var a = '<b>';</script><p>A &amp; B</p>\n<b>"), "n_name", F.lit("</b></html>"))
    return table(spark, d, "nation").select("n_nationkey", text.from_html(page).alias("plain"))


@query("select c_custkey, 'key [REDACTED] Bearer [REDACTED] for [REDACTED]' as line from customer")
def secret_scrubbing(spark, d):
    line = F.concat(F.lit("key sk-abcdefgh"), F.col("c_custkey").cast("string"), F.lit(" bearer tok.en"), F.col("c_custkey").cast("string"), F.lit(" for hunter2"))
    return table(spark, d, "customer").select("c_custkey", text.scrub(line, ["hunter2"]).alias("line"))


@query("""select doc_id, case when length(text) >= 2000 then 'long' when contains(text, '?') then 'question' when length(text) >= 350 then 'strict' when length(text) >= 250 then 'relaxed' else 'short' end as label from documents where text is not null""")
def funnel_first_match(spark, d):
    t, n = F.col("text"), F.length("text")
    label = F.when(n >= 2000, "long").when(F.contains(t, F.lit("?")), "question").when(n >= 350, "strict").when(n >= 250, "relaxed").otherwise("short")
    return table(spark, d, "documents").where("text is not null").select("doc_id", label.alias("label"))


# --- exact and near duplicates, selection


@query("select min(doc_id) as doc_id from documents where text is not null group by text")
def exact_dedup(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return deduplicating.exact(t.select("doc_id", "text"), F.sha2("text", 256), F.col("doc_id")).select("doc_id")


@query(f"""select example_id from {ONCE} where matched_pair_id is not null union all select min(example_id) from {ONCE} where matched_pair_id is null group by list_sort(card_ids), orientations, task_type, spread_id, length_band, register""")
def structural_dedup(spark, d):
    r = records(spark, d, "card_ids", "orientations", "task_type", "spread_id", "length_band", "register", "matched_pair_id")
    key = [F.array_sort("card_ids"), *map(F.col, ("orientations", "task_type", "spread_id", "length_band", "register"))]
    return deduplicating.structural(r, key, F.col("example_id"), F.col("matched_pair_id").isNotNull()).select("example_id")


@query()
def minhash_neardup(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return deduplicating.cascade(t, "doc_id", "text", F.sha2("text", 256), None, F.col("doc_id"), F.lit(False))


def _with_near_copies(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    near = F.transform("v", lambda x, i: x + 0.03 * ((i + F.col("vec_id")) % 3 - 1))
    return e.union(e.select(F.col("vec_id") + 1_000_000, near))


@query()
def diversity_greedy(spark, d):
    e = _with_near_copies(spark, d)
    scored = ordering.ranked(e.select("vec_id", "v", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)), 9).alias("score")), [F.desc("score"), F.asc("vec_id")])
    scored = checkpoint(scored.select("rank", "vec_id", "v"))
    keep = deduplicating.greedy_keep(scored, deduplicating.cosine_pairs(scored, "rank", "v", 0.92), "rank", "rank")
    return scored.select("rank", "vec_id").join(keep, "rank").select("vec_id", "kept")


@query("with e as (select vec_id, embedding::double[] as v from embeddings), n as (from e union all select vec_id + 1000000, list_transform(v, lambda x, i: x + 0.03::double * ((i - 1 + vec_id) % 3 - 1)) from e) select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id < b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.92")
def embedding_neardup(spark, d):
    return deduplicating.cosine_pairs(_with_near_copies(spark, d), "vec_id", "v", 0.92).select("a", "b")


@query(f"""with p as (select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as r, count(*) over () as n from orders), k as (select *, r <= greatest(1, round_even(n * 0.85, 0)) as kept from p)
    select round((avg(o_totalprice) filter (kept) - avg(o_totalprice) filter (not kept)) / sqrt(((count(*) filter (kept) - 1) * var_samp(o_totalprice) filter (kept) + (count(*) filter (not kept) - 1) * var_samp(o_totalprice) filter (not kept)) / (count(*) - 2)), 6) as d, count(*) filter (kept) as kept, count(*) filter (not kept) as rejected from k""")
def cohens_d_topfraction(spark, d):
    t = ordering.top_fraction(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 0.85)
    x, k = F.col("o_totalprice"), F.col("kept")
    g = t.agg(*(f(F.when(c, x)).alias(f"{n}{i}") for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count)) for i, c in (("1", k), ("0", ~k))))
    return g.select(F.round(stats.cohens_d(*(F.col(c) for c in ("m1", "v1", "n1", "m0", "v0", "n0"))), 6).alias("d"), F.col("n1").alias("kept"), F.col("n0").alias("rejected"))


@query("""with w as (select doc_id, regexp_extract_all(text, '[^ \\n\\r\\t]+') as w, text from documents where text is not null), f as (select doc_id, ln(1 + len(w)) as a, len(list_distinct(w)) / greatest(1, len(w)) as b, len(regexp_extract_all(text, '[.!?…]')) + 1 as c from w),
    z as (select doc_id, coalesce((a - avg(a) over ()) / nullif(stddev_pop(a) over (), 0), 0) + coalesce((b - avg(b) over ()) / nullif(stddev_pop(b) over (), 0), 0) + coalesce((c - avg(c) over ()) / nullif(stddev_pop(c) over (), 0), 0) as s from f) select doc_id, round(0.5 * s, 6) as score from z""")
def zscore_composite(spark, d):
    w = F.regexp_extract_all("text", F.lit(r"[^ \n\r\t]+"), F.lit(0))
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.log1p(F.size(w)).alias("a"), text.type_token_ratio(w).alias("b"), text.sentence_count(F.col("text")).cast("double").alias("c"))
    m = F.broadcast(t.agg(*(f(x).alias(f"{n}{x}") for x in "abc" for n, f in (("m", F.avg), ("s", F.stddev_pop)))))  # one row: no window over the whole table
    z = sum((F.coalesce((F.col(x) - F.col(f"m{x}")) / F.nullif(F.col(f"s{x}"), F.lit(0.0)), F.lit(0.0)) for x in "abc"), F.lit(0.0))
    return t.crossJoin(m).select("doc_id", F.round(0.5 * z, 6).alias("score"))


# --- statistics and gates


@query("""with g as (select event_type, count(*) as n, count(*) filter (value > 20) as k from events group by 1), w as (select *, k / n as p, 1 + 3.8416 / n as d from g)
    select event_type, n, k, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / d), 9) as low, round(least(1, (p + 3.8416 / (2 * n)) / d + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / d), 9) as high, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / d > 0.5 as passes from w""")
def wilson_by_group(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("k"))
    g = g.withColumn("ci", stats.wilson(F.col("k"), F.col("n")))
    return g.select("event_type", "n", "k", F.round("ci.low", 9).alias("low"), F.round("ci.high", 9).alias("high"), (F.col("ci.low") > 0.5).alias("passes"))


@query("""with g as (select event_type, user_id % 2 as judge, count(*) as n, count(*) filter (value > 20) as k from events group by 1, 2) select event_type, round(abs(max(k) filter (judge = 0) - max(k) filter (judge = 1)) / min(n), 9) as disagreement from g group by 1""")
def judge_disagreement(spark, d):
    g = table(spark, d, "events").withColumn("judge", F.col("user_id") % 2).groupBy("event_type", "judge").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("k"))
    k = lambda j: F.max(F.when(F.col("judge") == j, F.col("k")))
    return g.groupBy("event_type").agg(F.round(F.abs(k(0) - k(1)) / F.min("n"), 9).alias("disagreement"))


def _reason_sql() -> str:
    low = "lower(target_vi)"
    first = [f"case when {c} is null then 'schema:{c}' end" for c in validating.REQUIRED]
    known = {"task_type": validating.TASK_TYPES, "length_band": tuple(validating.LENGTH_BOUNDS), "register": validating.REGISTERS}
    first += [f"case when {c} is not null and {c} not in {v} then 'schema:{c}:value' end" for c, v in known.items()]
    first += ["case when len(orientations) <> len(cards_used) then 'schema:orientation_count' end"]
    first += [f"case when not regexp_matches({c}, '[^\\s\\x0b\\x{{85}}\\p{{Z}}]') then 'schema:empty_{c}' end" for c in ("question_vi", "target_vi", "reading_vi")]
    words = "list_filter(regexp_extract_all(target_vi, '[^\\s\\x0b\\x{85}\\p{Z}]+'), lambda x: x <> '')"
    solid = f"list_filter({words}, lambda x: regexp_matches(x, '[\\pL\\pN]'))"
    bounds = " ".join(f"when length_band = '{k}' then len({words}) not between {a} and {b}" for k, (a, b) in validating.LENGTH_BOUNDS.items())
    then = [
        f"case when case when len({solid}) > 0 then len(list_filter({solid}, lambda x: regexp_matches(x, '(?i)[{text.MARKED}]'))) / len({solid}) else 0 end < 0.15 then 'lang_id' end",
        f"case when case {bounds} end then 'length_bounds' end",
        f"case when len(list_filter(cards_used, lambda c: not contains({low}, lower(c.name_en)))) > 0 then 'card_containment' end",
        f"case when len(list_filter(cards_used, lambda c: c.orientation = 'reversed')) > 0 and not contains({low}, 'ngược') then 'orientation_no_marker' end",
    ]
    notnull = lambda xs: f"list_filter([{', '.join(xs)}], lambda x: x is not null)"
    return f"select example_id, array_to_string(case when len({notnull(first)}) > 0 then {notnull(first)} else {notnull(then)} end, ',') as reasons from {ONCE}"


@query(_reason_sql())
def rule_filter_reasons(spark, d):
    r = records(spark, d, *validating.REQUIRED)
    return r.select("example_id", F.array_join(validating.record_reasons(r), ",").alias("reasons"))


@query(f"""with r as ({ORACLES["rule_filter_reasons"]}) select reason, count(*) as n from (select unnest(string_split(reasons, ',')) as reason from r where reasons <> '') group by 1""")
def reason_counts(spark, d):
    r = rule_filter_reasons(spark, d).where("reasons <> ''")
    return aggregating.exploded_counts(r, F.split("reasons", ","), "reason")


@query(f"""with u as (select example_id, lower(reading_vi) as t, unnest(cards_used) as c from {ONCE} where reading_vi is not null and len(cards_used) > 0),
    m as (select example_id, lower(c.name_en) as n, not regexp_matches(t, '(^|[^\\pL\\pN_])' || lower(c.name_en) || '($|[^\\pL\\pN_])') as missing from u)
    select example_id, string_agg(distinct n, '|' order by n) filter (missing) as missing from m group by 1""")
def name_containment(spark, d):
    names = [r[0] for r in table(spark, d, "cards").select("name_en").distinct().collect()]  # fixed, 78
    r = records(spark, d, "reading_vi", "cards_used").where(F.col("reading_vi").isNotNull() & (F.size("cards_used") > 0))
    drawn = F.array_distinct(F.transform("cards_used", lambda c: c["name_en"]))
    return r.select("example_id", F.nullif(F.array_join(F.array_sort(validating.name_containment(F.col("reading_vi"), drawn, names)["missing"]), "|"), F.lit("")).alias("missing"))


@query(f"""with k as (select card_id, keywords_vi as k from cards where orientation = 'upright'), u as (select example_id, reading_vi, unnest(cards_used) as c from {ONCE} where reading_vi is not null)
    select distinct example_id, c.card_id as card_id, len(list_distinct(list_filter(list_transform(k, lambda x: trim(x)), lambda x: length(x) >= 4 and contains(lower(reading_vi), lower(x)))))::int as hits from u join k on k.card_id = c.card_id
    where c.orientation = 'reversed' and len(list_distinct(list_filter(list_transform(k, lambda x: trim(x)), lambda x: length(x) >= 4 and contains(lower(reading_vi), lower(x))))) >= 2""")
def orientation_conflicts(spark, d):
    u = records(spark, d, "reading_vi", "cards_used").where("reading_vi is not null").select("example_id", "reading_vi", F.explode("cards_used").alias("c")).select("example_id", "reading_vi", "c.card_id", "c.orientation")
    kb = table(spark, d, "cards").select("card_id", "orientation", F.col("keywords_vi").alias("keywords"))
    return validating.orientation_conflicts(u, kb, "reading_vi").select("example_id", "card_id", F.size("hits").alias("hits")).distinct()


@query(f"""with k as (select distinct card_id, lower(trim(k)) as keyword from (select card_id, unnest(keywords_vi) as k from cards) where length(lower(trim(k))) >= 5), few as (select keyword from k group by 1 having count(distinct card_id) <= 2), w as (select k.* from k join few using (keyword))
    select example_id, card_id, count(*) as hits from (select example_id, reading_vi, list_transform(cards_used, lambda c: c.card_id) as drawn from {ONCE} where reading_vi is not null and cards_used is not null) r join w on contains(lower(reading_vi), keyword) and not list_contains(drawn, card_id) group by 1, 2 having count(*) >= 2""")
def keyword_collisions(spark, d):
    r = records(spark, d, "reading_vi", "cards_used").where("reading_vi is not null and cards_used is not null").select("example_id", "reading_vi", F.transform("cards_used", lambda c: c["card_id"]).alias("drawn"))
    kb = table(spark, d, "cards").select("card_id", F.col("keywords_vi").alias("keywords"))
    return validating.keyword_collisions(r, "example_id", "reading_vi", "drawn", kb)


@query("""select * from (values ('cards_156', (select count(*) = 156 from cards)), ('orientations_2', (select count(distinct orientation) = 2 from cards)), ('meanings', (select count(*) filter (meaning_vi is null) = 0 from cards)), ('all', (select count(*) = 156 and count(distinct orientation) = 2 and count(*) filter (meaning_vi is null) = 0 from cards))) t("check", passed)""")
def acceptance_report(spark, d):
    checks = {"cards_156": F.count("*") == 156, "orientations_2": F.countDistinct("orientation") == 2, "meanings": F.count_if(F.col("meaning_vi").isNull()) == 0}
    return validating.acceptance(checks, table(spark, d, "cards"))


@query("""select 'named' as rule, count(*) filter (name_en is null) as violations from cards union all select 'keywords', count(*) filter (not coalesce(len(keywords_vi) between 3 and 9, false)) from cards union all select 'suited', count(*) filter (not coalesce(arcana = 'major' or suit is not null, false)) from cards""")
def constraint_report(spark, d):
    rules = {"named": F.col("name_en").isNotNull(), "keywords": F.size("keywords_vi").between(3, 9), "suited": (F.col("arcana") == "major") | F.col("suit").isNotNull()}
    return validating.constraint_report(table(spark, d, "cards"), rules)


@query("""with l(no, layer, kept, dropped) as (values (1, 'raw', 100, 0), (2, 'dedup', 90, null), (3, 'rules', 70, 25), (4, 'score', 75, null)) select layer, kept, greatest(0, coalesce(dropped, lag(kept) over (order by no) - kept, 0)) as lost from l""")
def layer_loss(spark, d):
    rows = spark.createDataFrame([(1, "raw", 100, 0), (2, "dedup", 90, None), (3, "rules", 70, 25), (4, "score", 75, None)], "no int, layer string, kept int, dropped int")
    return aggregating.layer_loss(rows, "no", "kept", "dropped").select("layer", "kept", "lost")


# --- order, budgets, samples, splits


@query("select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey) as r from lineitem) where r = 1")
def top_per_group(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return ordering.first_per(li, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey")]).drop("l_extendedprice")


@query("""with t as (select doc_id, n_chars, sum(n_chars) over (order by created_at, doc_id rows unbounded preceding) as running from documents where n_chars is not null) select doc_id, running::bigint as running from t where running - n_chars < 200000""")
def budget_running_sum(spark, d):
    t = table(spark, d, "documents").where("n_chars is not null").select("doc_id", "n_chars", "created_at")
    return ordering.within_budget(t, [F.col("created_at"), F.col("doc_id")], "n_chars", 200_000).select("doc_id", "running")


@query("""with p as (select spread_id, p.index as i, p.label_en as label from (select spread_id, unnest(positions) as p from spreads)) select spread_id, i as "index", case when count(*) over (partition by spread_id, label) > 1 then label || ' #' || row_number() over (partition by spread_id, label order by i) else label end as numbered from p""")
def dup_numbering(spark, d):
    p = table(spark, d, "spreads").select("spread_id", F.explode("positions").alias("p")).select("spread_id", F.col("p.index").alias("index"), F.col("p.label_en").alias("label"))
    return ordering.numbered_duplicates(p, ["spread_id"], [F.col("index")], "label", "numbered").drop("label")


@query()
def stratified_group_split(spark, d):
    r = records(spark, d, "task_type", "length_band", "register", "safety_category", "matched_pair_id", "cards_used")
    unit = F.when(F.col("matched_pair_id").isNotNull(), F.concat_ws("/", "safety_category", "matched_pair_id")).otherwise(F.col("example_id"))
    a = partitioning.stratified_split(r, "example_id", unit, ["task_type", "length_band", "register"], {"test": 0.07, "val": 0.08}, "train")
    items = r.select("example_id", F.explode("cards_used").alias("c")).select("example_id", F.concat_ws("/", F.col("c.card_id").cast("string"), "c.orientation").alias("item"))
    return partitioning.repair_coverage(a, items, "example_id", "train")


@query("select doc_id, source from documents order by md5('7/' || doc_id), doc_id limit 100")
def seeded_sample(spark, d):
    return partitioning.sample(table(spark, d, "documents").select("doc_id", "source"), F.col("doc_id"), 100, seed=7)


@query("""select p_partkey, p_size from part where p_size > 0 order by round(-ln((('0x' || md5('7/' || p_partkey)[1:13])::bigint + 0.5::double) / 4503599627370496) / p_size, 9), p_partkey limit 100""")
def weighted_sample(spark, d):
    return partitioning.weighted_sample(table(spark, d, "part").select("p_partkey", "p_size"), F.col("p_partkey"), F.col("p_size"), 100, seed=7)


@query("select event_id, (['register', 'length', 'topic', 'tone'])[(event_id % 4 + 1)::int] as axis from events")
def round_robin(spark, d):
    return partitioning.round_robin(table(spark, d, "events").select("event_id"), F.col("event_id"), ["register", "length", "topic", "tone"], "axis")


@query("""with t(safety_category, target) as (values ('medical', 30), ('legal', 30), ('death', 30), ('nothing', 5)) select safety_category, coalesce(n, 0)::bigint as have, greatest(0, target - coalesce(n, 0))::bigint as missing from t left join (select safety_category, count(*) as n from sft_rows group by 1) using (safety_category)""")
def resume_shortfall(spark, d):
    return partitioning.shortfall(table(spark, d, "sft_rows"), "safety_category", {"medical": 30, "legal": 30, "death": 30, "nothing": 5})


# --- time, latest state, caches, files


@query("""with t as (select event_id, ts + interval 7 hour as l from events) select event_id, case when l::date > date '2024-01-05' + 20 then 'stale' when isodow(l) between 3 and 7 and l::time between time '13:00:00' and time '20:30:00' then 'open' else 'closed' end as state from t""")
def schedule_routing(spark, d):
    return table(spark, d, "events").select("event_id", scheduling.schedule_state(F.col("ts"), "Asia/Ho_Chi_Minh", (2, 3, 4, 5, 6), "13:00", "20:30", "2024-01-05", 20).alias("state"))


@query("select user_id, event_type, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def run_state_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return deduplicating.latest(e, ["user_id"], F.struct("ts", "event_id")).drop("ts")


@query("""with h as (select event_id from events where event_type = 'view'), c as (select distinct user_id, event_type from events where ts < timestamp '2024-01-10') select count(*) filter (hit) as hits, count(*) filter (not hit) as misses from (select (user_id, event_type) in (select (user_id, event_type) from c) as hit from events where ts >= timestamp '2024-01-10')""")
def cache_read_through(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts")
    key = F.sha2(F.to_json(F.struct("event_type", "user_id"), {"ignoreNullFields": "false"}), 256)
    cache = e.where("ts < timestamp '2024-01-10'").select(key.alias("key")).distinct()
    hits, misses = readers.read_through(e.where("ts >= timestamp '2024-01-10'"), cache, ["user_id", "event_type"])
    return hits.agg(F.count("*").alias("hits")).crossJoin(misses.agg(F.count("*").alias("misses")))


@query("select k as key, count(*) as n from (select unnest(json_keys(props)) as k from events) group by 1")
def json_key_listing(spark, d):
    return integrity.json_keys(table(spark, d, "events"), "props")


@query()
def file_catalog(spark, d):
    return readers.file_facts(spark, f"{d}/*.parquet").select("name", "bytes", "sha256")


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, d):
    from quern.streaming.operators import windowed

    out = windowed(table(spark, d, "events"), "ts", "1 hour", "1 day", by=["event_type"], aggregates=[F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return out.select("window_start", "event_type", "n", "total")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w >= interval 6 hour or lag(ts) over w is null then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as session_start, count(*) as n from s group by user_id, s""")
def event_sessions(spark, d):
    from quern.streaming.operators import sessions

    return sessions(table(spark, d, "events"), "ts", "1 hour", "6 hours", ["user_id"]).select("user_id", "session_start", "n")


@query(f"""with p as ({ORACLES["profile_distance"]}) select count(*) as n, round(max(distance) filter (r = least(n, floor(0.9 * n)::bigint + 1)), 6) as p90 from (select distance, row_number() over (order by distance) as r, count(*) over () as n from p)""")
def calibrated_threshold(spark, d):
    p = profile_distance(spark, d)
    return p.agg(F.count("*").alias("n")).crossJoin(ordering.percentiles(p, "distance", [0.9]).select(F.round("value", 6).alias("p90")))

