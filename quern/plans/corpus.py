"""More of the library's queries: labels and names in text, gates, lookups, reports, plans and order, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import canonical, text
from quern.operators import aggregating, conforming, deduplicating, filtering, integrity, ordering, partitioning, validating
from quern.plans.contract import ONCE, ORACLES, deliveries, query, records, table
from quern.plans.lineage import checkpoint

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "sft_rows", "splits", "ifd_scores", "anchor_readings", "cards", "spreads", "sample_targets", "split_targets", "mix_targets")
B, E = "(^|[^\\pL\\pN_])", "($|[^\\pL\\pN_])"


def _names(spark, d) -> list[str]:
    return [r[0] for r in table(spark, d, "cards").select("card_id", "name_en").distinct().orderBy("card_id").select("name_en").collect()]  # fixed, 78


# --- labels, names and shapes of text


@query("""select anchor_id, trim(regexp_replace(name_en, '\\s+', ' ', 'g')) as name, case when orientation = 'reversed' then 'reversed' else 'upright' end as orientation from anchor_readings where name_en is not null""")
def label_parse(spark, d):
    a = table(spark, d, "anchor_readings").where("name_en is not null")
    label = F.concat(F.lit("Lá  bài "), "name_en", F.when(F.col("orientation") == "reversed", " ngược").otherwise(""))
    return a.select("anchor_id", text.label_parts(label).alias("x")).select("anchor_id", "x.*")


@query(f"""with n as (select distinct lower(name_en) as name from cards), t as (select doc_id, lower(text) as low from documents where text is not null),
    h as (select doc_id, low, name, unnest(list_filter(range(1, length(low)::bigint + 1), lambda i: substr(low, i, length(name)) = name)) as i from t join n on contains(low, name))
    select distinct doc_id, name, regexp_matches(substr(low, (i + length(name))::bigint, 22), '(?s){B}(reversed|rx|inverted|upside[- ]down){E}') as reversed from h
    where not regexp_matches(substr(low, (i - 1)::bigint, 1), '[\\pL\\pN_]') or i = 1 and not regexp_matches(substr(low, (i + length(name))::bigint, 1), '[\\pL\\pN_]')""".replace("or i = 1 and not", "and not"))
def name_mentions(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.explode(text.mentions(F.col("text"), _names(spark, d))).alias("x")).select("doc_id", "x.*")


@query("""with t as (select doc_id, unnest(regexp_extract_all(regexp_replace(text, '(\\s)', '\\1\\1', 'g'), '(?:^|[^\\pL\\pN_])(The\\s+[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?)(?:$|[^\\pL\\pN_])', 1)) as x from documents where text is not null)
    select distinct doc_id, regexp_replace(x, '\\s+', ' ', 'g') as name from t where lower(regexp_replace(x, '\\s+', ' ', 'g')) not in (select lower(name_en) from cards) and lower(regexp_replace(x, '\\s+', ' ', 'g')) not in ('the past', 'the present', 'the future', 'the querent', 'the reader', 'the outcome', 'the situation', 'the question', 'the cards', 'the reading', 'the universe')""")
def unknown_names(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.explode(text.unknown_names(F.col("text"), _names(spark, d))).alias("name"))


# Vietnamese position labels, and the order of difficulties.
LABELS = {"past": "quá khứ", "present": "hiện tại", "future": "tương lai", "outcome": "kết quả", "significator": "chủ bài", "obstacles": "trở ngại", "suggestions": "gợi ý", "blind spot": "điểm mù", "next step": "bước tiếp", "work": "công việc", "home": "gia đình", "finance": "tài chính", "friends": "bạn bè", "partners": "đối tác", "hopes and fears": "hy vọng và lo sợ", "reputation": "danh tiếng"}
DIFFICULTIES = {"easiest": 1, "very easy": 1, "easy": 2, "moderate": 3, "average": 3, "somewhat tough": 4, "varies": 3, "hard": 5, "complicated": 5}
OVERRIDES = [("spread_past_present_future", 1, "Past"), ("spread_decision", 1, "Choice"), ("spread_decision", 2, "Cost")]


def _case(c: str, m: dict, other: str) -> str:
    return f"case lower({c}) {' '.join(f'when $${k}$$ then ' + (str(v) if isinstance(v, int) else f'$${v}$$') for k, v in m.items())} else {other} end".replace("$$", "'")


_POSITIONS = "(select spread_id, difficulty, unnest(positions) as p from spreads)"


@query(f"""with o(spread_id, i, label) as (values {", ".join(f"('{a}', {b}, '{c}')" for a, b, c in OVERRIDES)}), x as (select spread_id, p.index as i, coalesce(label, p.label_en) as label, {_case("coalesce(difficulty, 'average')", DIFFICULTIES, "3")} as ordinal from {_POSITIONS} left join o on o.spread_id = spread_id_ and o.i = p.index)
    select spread_id, i as "index", {_case("label", LABELS, "label")} as label_vi, ordinal from x""".replace("(select spread_id, difficulty", "(select spread_id as spread_id_, spread_id, difficulty").replace("x as (select spread_id,", "x as (select spread_id_ as spread_id,"))
def position_labels(spark, d):
    o = spark.createDataFrame(OVERRIDES, "spread_id string, index int, label string")
    p = table(spark, d, "spreads").select("spread_id", "difficulty", F.explode("positions").alias("p")).select("spread_id", "difficulty", F.col("p.index").alias("index"), F.col("p.label_en").alias("label_en"))
    j = p.join(F.broadcast(o), ["spread_id", "index"], "left").withColumn("label", F.coalesce("label", "label_en"))  # a list in the code
    return j.select("spread_id", "index", text.mapped(F.col("label"), LABELS, F.col("label")).alias("label_vi"), text.mapped(F.coalesce("difficulty", F.lit("average")), DIFFICULTIES, F.lit(3)).alias("ordinal"))


@query(f"""with x as (select spread_id, p.index as i, p.label_en as label, trim(regexp_replace(p.gloss_compact, '\\s+', ' ', 'g')) as g from {_POSITIONS}), w as (select *, list_filter(string_split(g, ' '), lambda z: z <> '') as ws, list_filter(string_split(trim(regexp_split_to_array(g, '[.;]')[1]), ' '), lambda z: z <> '') as cs from x),
    b as (select *, case when len(ws) <= 4 and length(g) <= 20 then g else array_to_string(cs[1:4], ' ') end as body from w) select spread_id, i as "index", case when contains(lower(body), lower(label)) then body else label || ': ' || body end as gloss from b""")
def position_glosses(spark, d):
    p = table(spark, d, "spreads").select("spread_id", F.explode("positions").alias("p"))
    return p.select("spread_id", F.col("p.index").alias("index"), text.short_gloss(F.col("p.gloss_compact"), F.col("p.label_en"), 4, 20).alias("gloss"))


@query("""with w as (select card_id, orientation, trim(meaning_en) as t, list_filter(string_split(trim(regexp_replace(meaning_en, '\\s+', ' ', 'g')), ' '), lambda z: z <> '') as ws, regexp_extract_all(lower(meaning_en), '[a-z0-9]+') as ts from cards)
    select card_id, orientation, case when len(ws) <= 4 and length(t) <= 40 then t else coalesce(nullif(array_to_string(ts[1:3], ' '), ''), t[1:20]) end as label from w""")
def short_labels(spark, d):
    return table(spark, d, "cards").select("card_id", "orientation", text.short_label(F.col("meaning_en")).alias("label"))


@query("""with c as (select card_id, orientation, trim(meaning_en) as m, trim(meaning_vi) as h from cards) select card_id, orientation, case when h is null or h = '' or contains(lower(m), lower(h)) then m else regexp_replace(m, '\\.+$', '') || ' (Waite: ' || case when length(h) < 60 then h else h[1:57] || '...' end || ')' end as meaning from c""")
def meanings_with_cue(spark, d):
    return table(spark, d, "cards").select("card_id", "orientation", text.with_cue(F.col("meaning_en"), F.col("meaning_vi"), "Waite", 60).alias("meaning"))


@query("""select doc_id, trim(text, chr(32)) in ('[removed]', '[deleted]') as removed, regexp_matches(lower(text), '\\?|(^|[^a-z0-9_])(asked|question|wondering|guidance|advice|does he|will i|should i|what does|help me|pulled|drew|spread|about my|my ex|clarify)($|[^a-z0-9_])') as asks from documents where text is not null""")
def posts_asking(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.is_removed(F.col("text")).alias("removed"), text.is_question(F.col("text")).alias("asks"))


@query("""select doc_id, 1 + len(regexp_extract_all(text, '---\\s*Page\\s+\\d+\\s*---'))::int as pages, length(trim(regexp_replace(regexp_replace(text, '---\\s*Page\\s+\\d+\\s*---', ' ', 'g'), '[\\s\\x0b\\x{85}\\p{Z}]+', ' ', 'g')))::int as chars from documents where text is not null""")
def page_markers(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", (1 + text.page_count(F.col("text"))).alias("pages"), F.length(text.without_pages(F.concat(F.lit("--- Page "), F.col("doc_id").cast("string"), F.lit(" ---"), "text"))).alias("chars"))


SCAFFOLDS = ["Moon", "Sau một quãng chờ", "as an AI"]


@query(f"select doc_id, array_to_string(list_filter({SCAFFOLDS}, lambda s: contains(lower(text), lower(s))), '|') as leaks from documents where text is not null and len(list_filter({SCAFFOLDS}, lambda s: contains(lower(text), lower(s)))) > 0")
def scaffold_leaks(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", text.leaks(F.col("text"), SCAFFOLDS).alias("x"))
    return t.where(F.size("x") > 0).select("doc_id", F.array_join("x", "|").alias("leaks"))


@query(f"""with n as (select distinct card_id, name_en, lower(name_en) as n from cards), r as (select example_id, lower(reading_vi) as low, list_transform(cards_used, lambda c: lower(c.name_en)) as drawn from {ONCE} where reading_vi is not null and cards_used is not null)
    select example_id, min_by(name_en, card_id) as name from r join n on contains(low, n) and not list_contains(drawn, n) and (length(low) - length(replace(low, n, ''))) / length(n) >= 2 group by 1""")
def repeated_undrawn_names(spark, d):
    r = records(spark, d, "reading_vi", "cards_used").where("reading_vi is not null and cards_used is not null")
    return r.select("example_id", text.first_repeated(F.col("reading_vi"), _names(spark, d), F.transform("cards_used", lambda c: F.lower(c["name_en"]))).alias("name")).where("name is not null")


@query(f"""select example_id, array_to_string(list_prepend('Cards', list_transform(cards_used, lambda c: '- ' || c.name_en || ' (' || coalesce(c.orientation, 'upright') || ')')), chr(10)) as block from {ONCE} where cards_used is not null""")
def prompt_blocks(spark, d):
    r = records(spark, d, "cards_used").where("cards_used is not null")
    return r.select("example_id", text.block("Cards", F.transform("cards_used", lambda c: F.concat(c["name_en"], F.lit(" ("), F.coalesce(c["orientation"], F.lit("upright")), F.lit(")")))).alias("block"))


@query("select doc_id from documents where lower(trim(coalesce(lang, ''))) = 'vi' or (trim(coalesce(lang, '')) = '' and (contains(lower(coalesce(kind, '')), 'reading') or ends_with(lower(trim(coalesce(kind, ''))), '_vi') or lower(trim(coalesce(kind, ''))) = 'vi'))")
def language_or_category(spark, d):
    return table(spark, d, "documents").where(text.is_language(F.col("lang"), F.col("kind"), "vi", "reading")).select("doc_id")


@query("select doc_id, regexp_matches(text, '(?is)(moon|trăng).*;.*reversed') as probed from documents where text is not null")
def text_probe(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").rlike("(?isu)(moon|trăng).*;.*reversed").alias("probed"))


# --- rows: predicates, repair, tags


@query(f"select example_id from {ONCE} where starts_with(example_id, 'w32_') and coalesce(len(provenance) > 0 and not list_has_any(provenance, ['safety_slice', 'anchor']), false) and task_type in ('reading', 'grounding') and register = 'casual' and length_band = 'ngắn' and querent_context = 'love'")
def rows_equality_filters(spark, d):
    r = records(spark, d, "provenance", "task_type", "register", "length_band", "querent_context", keep=lambda t: filtering.matching(t, filtering.RowFilter(register="casual", length_band="ngắn", querent_context="love")))
    ok = F.col("example_id").startswith("w32_") & (F.size("provenance") > 0) & ~F.arrays_overlap("provenance", F.array(F.lit("safety_slice"), F.lit("anchor")))
    return r.where(ok & F.col("task_type").isin("reading", "grounding")).select("example_id")


@query(f"""with s as (select *, length(question_vi) > length(reading_vi) as w from {ONCE}) select example_id, length(case when w then reading_vi else question_vi end)::int as question_chars, length(case when w then question_vi else reading_vi end)::int as answer_chars, coalesce(nullif(trim(register), ''), tier) as register from s where w""")
def fields_repaired(spark, d):
    r = records(spark, d, "question_vi", "reading_vi", "register", "tier").where("length(question_vi) > length(reading_vi)")
    out = conforming.repaired(r, {"tier": "register"}, [("question_vi", "reading_vi", F.length("question_vi") > F.length("reading_vi"))])
    return out.select("example_id", F.length("question_vi").alias("question_chars"), F.length("reading_vi").alias("answer_chars"), "register")


@query(f"select example_id, array_to_string(list_append(provenance, 'tier:' || tier), '|') as provenance from {ONCE} where provenance is not null")
def provenance_tagged(spark, d):
    r = records(spark, d, "provenance", "tier").where("provenance is not null")
    return r.select("example_id", F.array_join(F.array_append("provenance", F.concat(F.lit("tier:"), "tier")), "|").alias("provenance"))


@query(f"""select example_id, array_to_string(list_sort(list_distinct(list_transform(range(1, len(card_ids) + 1), lambda i: coalesce(card_ids[i]::varchar, '?') || '/' || coalesce(orientations[i], '?')))), '|') as draws from {ONCE} where card_ids is not null and orientations is not null and len(card_ids) = len(orientations)""")
def draw_sets(spark, d):
    r = records(spark, d, "card_ids", "orientations").where("card_ids is not null and orientations is not null and size(card_ids) = size(orientations)")
    pairs = F.transform(F.arrays_zip("card_ids", "orientations"), lambda x: F.concat(F.coalesce(x["card_ids"].cast("string"), F.lit("?")), F.lit("/"), F.coalesce(x["orientations"], F.lit("?"))))
    return r.select("example_id", F.array_join(F.array_sort(F.array_distinct(pairs)), "|").alias("draws"))


@query("select array_to_string(list_sort(list_distinct(list(lower(n)))), '|') as names from (select name_en as n from cards union all select name_vi_gloss from cards) where n is not null")
def name_whitelist(spark, d):
    c = table(spark, d, "cards")  # fixed, 156 rows
    return c.agg(F.collect_set(F.lower("name_en")).alias("a"), F.collect_set(F.lower("name_vi_gloss")).alias("b")).select(F.array_join(F.array_sort(F.array_union("a", "b")), "|").alias("names"))


# --- joins


@query(f"""with u as (select example_id, unnest(cards_used) as c, generate_subscripts(cards_used, 1) - 1 as place from {ONCE} where len(cards_used) > 0), j as (select u.example_id, u.place::int as place, u.c.card_id as card_id, u.c.orientation as orientation, k.yes_no, k.card_id is not null as known from u left join cards k on k.card_id = u.c.card_id and k.orientation = u.c.orientation)
    select example_id, place, card_id, orientation, yes_no from j where example_id not in (select example_id from j where not known)""")
def draws_resolved(spark, d):
    kb = table(spark, d, "cards").select("card_id", "orientation", "yes_no")
    return conforming.complete_draws(records(spark, d, "cards_used"), "example_id", F.col("cards_used"), kb, ["card_id", "orientation"]).select("example_id", "place", "card_id", "orientation", "yes_no")


@query("""with g as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem where l_returnflag <> 'A' and l_quantity >= 20) select o_orderkey, count(*) as replies, (arg_max(l_linenumber, (l_extendedprice, -l_linenumber, -l_partkey)))::bigint as best, max(l_extendedprice) as score from orders join g on l_orderkey = o_orderkey where o_orderstatus = 'O' group by 1""")
def best_replies(spark, d):
    posts = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    replies = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = conforming.best_reply(posts, replies, "o_orderkey", (F.col("l_returnflag") != "A") & (F.col("l_quantity") >= 20), [F.desc("score"), F.asc("best"), F.asc("part")], {"score": F.col("l_extendedprice"), "best": F.col("l_linenumber"), "part": F.col("l_partkey")})
    return out.select("o_orderkey", "replies", F.col("best").cast("long").alias("best"), "score")


@query("""select arcana, coalesce(suit, 'none') as suit, array_to_string(list_sort(list(distinct name_en)), '|') as names, count(*) as n from cards group by 1, 2""")
def buckets_by_key(spark, d):
    c = table(spark, d, "cards")  # fixed, 156 rows: the lists are small
    return c.groupBy("arcana", F.coalesce("suit", F.lit("none")).alias("suit")).agg(F.array_join(F.array_sort(F.collect_set("name_en")), "|").alias("names"), F.count("*").alias("n"))


@query("select card_id, count(distinct name_en || '/' || arcana || '/' || coalesce(suit, '?') || '/' || coalesce(element, '?')) = 1 as equal from cards group by 1")
def equal_within_group(spark, d):
    return validating.all_equal(table(spark, d, "cards"), ["card_id"], ["name_en", "arcana", "suit", "element"])


# --- statistics and reports

AXES = ("orientation_ok", "faithful", "answers_question", "vietnamese_natural")


@query("""select 'suit' as stat, coalesce(suit, 'none') as key, count(*)::double as value from cards group by 2 union all select 'axis', polarity_axis, count(*)::double from cards where polarity_axis is not null group by 2
    union all select 'chars:' || k, orientation, round(avg(length(v)), 2) from (select orientation, 'meaning_en' as k, meaning_en as v from cards union all select orientation, 'meaning_vi', meaning_vi from cards) where length(v) > 0 group by 1, 2
    union all select 'filled:' || k, orientation, count(*) filter (trim(coalesce(v, '')) <> '') from (select orientation, 'yes_no' as k, yes_no as v from cards union all select orientation, 'element', element from cards union all select orientation, 'suit', suit from cards) group by 1, 2""")
def kb_stats(spark, d):
    c = table(spark, d, "cards")
    count = lambda stat, k: c.where(k.isNotNull()).groupBy(k.alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(stat).alias("stat"), "key", "value")
    cols = [F.round(F.avg(F.when(F.length(x) > 0, F.length(x))), 2).alias(f"chars:{x}") for x in ("meaning_en", "meaning_vi")] + [F.count_if(F.trim(F.coalesce(x, F.lit(""))) != "").cast("double").alias(f"filled:{x}") for x in ("yes_no", "element", "suit")]
    wide = c.groupBy("orientation").agg(*cols)
    long = wide.unpivot("orientation", [x for x in wide.columns if x != "orientation"], "stat", "value").select("stat", F.col("orientation").alias("key"), "value").where("value is not null")
    return count("suit", F.coalesce("suit", F.lit("none"))).union(count("axis", F.col("polarity_axis"))).union(long)


@query(f"select count(*) as processed, count(*) filter (critique.faithful) as passed, count(*) filter (not critique.faithful) as failed, count(*) filter (critique.faithful is null) as pending from {ONCE}")
def gate_totals(spark, d):
    return validating.gate_counts(records(spark, d, "critique"), F.col("critique.faithful"))


@query(" union all ".join(f"select '{a}' as axis, count(*) filter (critique.{a}) as passed, count(*) filter (not coalesce(critique.{a}, false)) as failed, count(*) filter (not coalesce(critique.{a}, false)) / greatest(1, count(*)) > 0.6 as defect from {ONCE} where critique is not null" for a in AXES))
def axis_report(spark, d):
    return validating.axis_counts(records(spark, d, "critique").where("critique is not null"), {a: F.col(f"critique.{a}") for a in AXES})


@query(f"select round_even(avg((critique.verdict <> 'pass')::int), 4) as rate from {ONCE} where critique.verdict is not null")
def rejected_share(spark, d):
    return validating.rejection_rate(records(spark, d, "critique").where("critique.verdict is not null"), F.col("critique.verdict") != "pass")


@query(f"""with r as ({ORACLES["tfidf_retrieval"]}), s as (select string_split(query, '/')[1] as spread_id, (query = doc)::int as ok from r), n as (select count(*) as n from s) select coalesce(spread_id, 'all') as spread_id, sum(ok)::bigint as hits, count(*) as positions, round(avg(ok), 6) as rate, avg(ok) > 1 / (select n from n) as above from s group by rollup (spread_id)""")
def retrieval_accuracy(spark, d):
    from quern.plans.contract import tfidf_retrieval

    r = tfidf_retrieval(spark, d).select(F.substring_index("query", "/", 1).alias("spread_id"), (F.col("query") == F.col("doc")).cast("int").alias("ok"))
    g = r.rollup("spread_id").agg(F.sum("ok").alias("hits"), F.count("*").alias("positions"), F.avg("ok").alias("p"))
    n = g.where("spread_id is null").select(F.col("positions").alias("all"))
    return g.crossJoin(F.broadcast(n)).select(F.coalesce("spread_id", F.lit("all")).alias("spread_id"), "hits", "positions", F.round("p", 6).alias("rate"), (F.col("p") > 1 / F.col("all")).alias("above"))  # one row


@query("""with c as (select event_type as key, count(*) as n from events group by 1) select key as top, n, (select sum(n) from c)::bigint as total from c order by n desc, key limit 1""")
def top_of_distribution(spark, d):
    c = table(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"))
    one = c.agg(F.min(F.struct((-F.col("n")).alias("less"), "key")).alias("x"), F.sum("n").alias("total"))
    return one.select(F.col("x.key").alias("top"), (-F.col("x.less")).alias("n"), "total")


@query("""select sha256('[' || string_agg('{"card_id":' || card_id || ',"name_en":"' || name_en || '","orientation":"' || orientation || '"}', ',' order by card_id, case orientation when 'upright' then 0 when 'reversed' then 1 else 9 end) || ']') as digest from cards""")
def document_digest(spark, d):
    c = table(spark, d, "cards").select("card_id", "name_en", "orientation")
    return canonical.document_digest(c, canonical.canonical_json(c), [F.col("card_id"), F.when(F.col("orientation") == "upright", 0).when(F.col("orientation") == "reversed", 1).otherwise(9)])


# --- gates


@query(f"""with r as ({ORACLES["keyword_containment"]}), a as (select anchor_id, regexp_matches(prose_vi, '(?i){B}' || regexp_escape(name_en) || '{E}') as inline, not regexp_matches(prose_vi, '(?i){B}({"|".join(p.replace(" ", "\\s+") for ps in text.FORBIDDEN.values() for p in ps)}){E}') as clean from anchor_readings where prose_vi is not null)
    select a.anchor_id, inline, coalesce(containment, 0) as recall, clean, inline and clean and coalesce(containment, 0) >= 0.7 as passed from a left join r using (anchor_id)""")
def prose_gates(spark, d):
    k = conforming.small(table(spark, d, "cards").select("card_id", "orientation", "keywords_vi"))
    a = table(spark, d, "anchor_readings").where("prose_vi is not null").join(k, ["card_id", "orientation"], "left")
    g = validating.text_gates(F.col("prose_vi"), F.col("name_en"), F.coalesce("keywords_vi", F.array().cast("array<string>")), F.lit(None).cast("double"), text.FORBIDDEN)
    return a.select("anchor_id", g.alias("g")).select("anchor_id", "g.inline", F.round("g.recall", 9).alias("recall"), "g.clean", "g.passed")


def _rules_sql() -> str:
    names = f"(select distinct card_id, name_en, lower(name_en) as n from cards)"  # noqa: F541
    base = ORACLES["rule_filter_reasons"]
    first, then = base.index("case when len(") , base.index(" as reasons")
    body = base[first:then]
    ctx = " ".join(f"when spread_id = '{s}' then not coalesce(querent_context in ({', '.join(repr(c) for c in ok)}), false)" for s, ok in validating.SPREAD_CONTEXTS.items())
    known = {"task_type": validating.TASK_TYPES, "length_band": tuple(validating.LENGTH_BOUNDS), "register": validating.REGISTERS}
    a = [f"case when {c} is null then 'schema:{c}' end" for c in validating.REQUIRED] + [f"case when not coalesce({c} in {v}, false) then 'schema:{c}:value' end" for c, v in known.items()]
    a += [f"case when case {ctx} else false end then 'spread_context_mismatch' end", "case when len(orientations) <> len(cards_used) then 'schema:orientation_count' end"]
    a += [f"case when not coalesce(regexp_matches({c}, '[^\\s\\x0b\\x{{85}}\\p{{Z}}]'), false) then 'schema:empty_{c}' end" for c in ("question_vi", "target_vi", "reading_vi")]
    second = body[body.rindex("list_filter([case when case when") :].replace("'orientation_no_marker'", "'orientation_no_nguoc'").removesuffix(" end, ',')")
    second = second.replace("then 'lang_id' end,", "then 'lang_id' end, case when contains(target_vi, 'khoẻ') then 'diacritic_health_typo' end,", 1)
    return f"""with r as (select example_id, cards_used, target_vi, list_filter([{", ".join(a)}], lambda x: x is not null) as a, {second} as b from {ONCE}),
        w as (select example_id, min_by(name_en, card_id) as warning from r join {names} k on len(a) = 0 and contains(lower(target_vi), n) and not list_contains(list_transform(cards_used, lambda c: lower(c.name_en)), n) and (length(target_vi) - length(replace(lower(target_vi), n, ''))) / length(n) >= 2 group by 1)
        select example_id, array_to_string(case when len(a) > 0 then a else b end, ',') as reasons, warning from r left join w using (example_id)"""


@query(_rules_sql())
def rule_findings(spark, d):
    r = records(spark, d, *validating.REQUIRED)
    return r.select("example_id", validating.rule_findings(r, _names(spark, d)).alias("x")).select("example_id", F.array_join("x.reasons", ",").alias("reasons"), "x.warning")


@query(f"""with k as (select card_id, keywords_vi as k from cards where orientation = 'upright'), u as (select distinct example_id, reading_vi, c.card_id as card_id, c.name_en as name_en from (select example_id, reading_vi, unnest(cards_used) as c from {ONCE} where reading_vi is not null) where c.orientation = 'reversed'),
    f as (select example_id, u.card_id, len(list_filter(list_transform(k, lambda x: trim(x)), lambda x: length(x) >= 4 and contains(lower(reading_vi), lower(x)))) >= 2 as a, regexp_matches(reading_vi, '(?i)' || regexp_escape(name_en) || '.{{0,60}}(upright|xuôi)') as b from u join k using (card_id))
    select example_id, card_id, array_to_string(list_filter([case when a then 'reversed_draw_has_upright_keywords' end, case when b then 'reversed_named_as_upright' end], lambda x: x is not null), ',') as reasons from f where coalesce(a, false) or coalesce(b, false)""")
def orientation_findings(spark, d):
    u = records(spark, d, "reading_vi", "cards_used").where("reading_vi is not null").select("example_id", "reading_vi", F.explode("cards_used").alias("c")).select("example_id", "reading_vi", "c.card_id", "c.orientation", "c.name_en")
    kb = table(spark, d, "cards").select("card_id", "orientation", F.col("keywords_vi").alias("keywords"))
    return validating.orientation_findings(u, kb, "reading_vi").select("example_id", "card_id", F.array_join("reasons", ",").alias("reasons")).distinct()


@query(f"select spread_id, querent_context, count(*) as n from {ONCE} where case {' '.join(f'when spread_id = $${s}$$ then not coalesce(querent_context in ({", ".join(f"$${c}$$" for c in ok)}), false)' for s, ok in validating.SPREAD_CONTEXTS.items())} else false end group by 1, 2".replace("$$", "'"))
def context_mismatches(spark, d):
    return records(spark, d, "spread_id", "querent_context").where(validating.context_mismatch(F.col("spread_id"), F.col("querent_context"))).groupBy("spread_id", "querent_context").agg(F.count("*").alias("n"))


KNOWN_TAGS = ("w32_generated", "gen_v4", "hand_made", "scrubbed", "safety_slice")


@query(f"""select 'unknown_tag' as rule, count(*) as violations from (select unnest(provenance) as t from {ONCE}) where t not in {KNOWN_TAGS} union all select 'anchor_in_training', (select count(*) from anchor_readings where anchor_id in (select example_id from {ONCE} r join splits using (example_id) where lower(trim(split)) = 'train'))""")
def provenance_isolation(spark, d):
    r = records(spark, d, "provenance")
    tags = r.select(F.explode("provenance").alias("t")).where(~F.col("t").isin(*KNOWN_TAGS)).agg(F.count("*").alias("violations")).select(F.lit("unknown_tag").alias("rule"), "violations")
    train = table(spark, d, "splits").where(F.lower(F.trim("split")) == "train").select("example_id").join(r.select("example_id"), "example_id", "left_semi")
    a = table(spark, d, "anchor_readings").select(F.col("anchor_id").alias("example_id")).join(train, "example_id", "left_semi")
    return tags.union(a.agg(F.count("*").alias("violations")).select(F.lit("anchor_in_training").alias("rule"), "violations"))


@query(f"select spread_id, p.index as \"index\" from {_POSITIONS} where lower(trim(coalesce(p.gloss_compact, ''))) in ('', 'passion', 'passion.') or contains(lower(p.gloss_compact), 'no reversed') or contains(p.gloss_compact, '§4')")
def missing_sources(spark, d):
    p = table(spark, d, "spreads").select("spread_id", F.explode("positions").alias("p")).select("spread_id", F.col("p.index").alias("index"), F.coalesce("p.gloss_compact", F.lit("")).alias("g"))
    return p.where(F.lower(F.trim("g")).isin("", "passion", "passion.") | F.contains(F.lower("g"), F.lit("no reversed")) | F.contains("g", F.lit("§4"))).select("spread_id", "index")


# --- order, samples, plans


@query("select card_id, orientation, row_number() over (partition by orientation order by card_id)::bigint as place from cards")
def parts_by_orientation(spark, d):
    c = table(spark, d, "cards").select("card_id", "orientation")
    return ordering.ranked(c.where("orientation = 'upright'"), [F.col("card_id")]).unionByName(ordering.ranked(c.where("orientation = 'reversed'"), [F.col("card_id")])).select("card_id", "orientation", F.col("rank").cast("long").alias("place"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 500")
def capped_core(spark, d):
    return ordering.capped(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 500)


@query("select event_id, event_type from events order by ts desc, event_id desc limit 50")
def newest_first(spark, d):
    return ordering.capped(table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "event_type")


@query("select lower(trim(task_type)) as task_type, coalesce(max(prompt_slot), -1) + 1 as next from sft_rows group by 1")
def next_slots(spark, d):
    return ordering.next_number(table(spark, d, "sft_rows").select(F.lower(F.trim("task_type")).alias("task_type"), "prompt_slot"), ["task_type"], "prompt_slot")


KNOWN_SOURCES = ["reading_log", "forum_lantern", "card_lexicon"]


@query(f"with s as (select distinct source, coalesce(nullif(regexp_replace(source, '[^0-9]', '', 'g'), ''), '0')::bigint as digits, coalesce(list_position({KNOWN_SOURCES}, source), 4)::int as p from documents where source is not null) select source, digits, row_number() over (order by p, digits, source)::bigint as place from s")
def known_order(spark, d):
    s = table(spark, d, "documents").where("source is not null").select("source").distinct()
    r = ordering.ranked(s.select("source", ordering.digits(F.col("source")).alias("digits"), ordering.listed(F.col("source"), KNOWN_SOURCES).alias("p")), [F.col("p"), F.col("digits"), F.col("source")])
    return r.select("source", "digits", F.col("rank").cast("long").alias("place"))


@query("""select anchor_id from anchor_readings where trim(prose_vi) <> '' and anchor_id not in (select min(anchor_id) from anchor_readings) order by md5('7/' || anchor_id), anchor_id limit 5""")
def exemplars(spark, d):
    a = table(spark, d, "anchor_readings")
    first = a.agg(F.min("anchor_id")).first()[0]
    return partitioning.exemplars(a.select("anchor_id", "prose_vi"), F.col("anchor_id"), F.col("prose_vi"), F.col("anchor_id") == first, 5, seed=7).select("anchor_id")


@query(f"""with g as (select spread_id, card_id, orientation, ctx from (select spread_id from spreads), (select card_id, orientation from cards), (select unnest({list(validating.CONTEXTS)}) as ctx)) select spread_id, card_id, orientation, ctx as querent_context from g
    where not case {' '.join(f"when spread_id = '{s}' then not (ctx in ({', '.join(repr(c) for c in ok)}))" for s, ok in validating.SPREAD_CONTEXTS.items())} else false end qualify row_number() over (partition by spread_id order by md5('3/' || spread_id || '/' || card_id || '/' || orientation || '/' || ctx)) <= 10""")
def example_plan(spark, d):
    ctx = spark.createDataFrame([(c,) for c in validating.CONTEXTS], "querent_context string")
    pairs = table(spark, d, "spreads").select("spread_id").crossJoin(F.broadcast(ctx)).where(~validating.context_mismatch(F.col("spread_id"), F.col("querent_context")))
    return conforming.planned([table(spark, d, "cards").select("card_id", "orientation"), pairs], ["spread_id", "card_id", "orientation", "querent_context"], "spread_id", 10, seed=3)


@query(" union all ".join(f"select '{t}' as name, (select count(*) from {t}) as n, (select string_agg(c, ', ' order by c) from (select column_name as c from (describe {t}))) as columns" for t in TABLES))
def table_catalog(spark, d):
    return integrity.table_facts({t: table(spark, d, t) for t in TABLES})


@query("""with f as (select n_name as report, case when n_nationkey % 3 = 0 then '[1]' when n_nationkey % 3 = 1 then '{"a":1}' end as body from nation where n_nationkey < 6) select coalesce(f.report, r.report) as report, case when r.report is null then 'unknown' when body is null then 'missing' when body[1:1] <> '{' then 'broken' else 'ok' end as state from f full join (select n_name as report from nation where n_nationkey between 2 and 8) r on r.report = f.report""")
def report_registry(spark, d):
    n = table(spark, d, "nation")
    body = F.when(F.col("n_nationkey") % 3 == 0, "[1]").when(F.col("n_nationkey") % 3 == 1, '{"a":1}')
    names = [r[0] for r in n.where("n_nationkey between 2 and 8").select("n_name").collect()]  # fixed, 25
    return integrity.report_states(n.where("n_nationkey < 6").select(F.col("n_name").alias("report"), body.alias("body")), names)


@query("""select doc_id, axis, ('0x' || md5('5/' || axis || '/' || doc_id)[1:8])::bigint / 4294967296 < case axis when 'tone' then 0.9 else 0.55 end as flagged from documents, (select unnest(['tone', 'orientation']) as axis) where text is not null""")
def mock_judge(spark, d):
    from quern.operators import scoring

    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.array(F.lit("tone"), F.lit("orientation"))).alias("axis"))
    return t.select("doc_id", "axis", scoring.mock_verdict(F.concat_ws("/", "axis", F.col("doc_id").cast("string")), text.mapped(F.col("axis"), {"tone": 0.9}, F.lit(0.55)), 5).alias("flagged"))


@query(f"""with g as (select unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as gram, b from (select {{T}} as t, (('0x' || md5(example_id)[1:4])::bigint % 4)::int as b from {ONCE} where reading_vi is not null) where len(t) >= 2), c as (select s.b, gram, count(*) as n from g join (select unnest([0, 1, 2, 3]) as b) s on g.b <= s.b group by 1, 2),
    m as (select b, max(n) as top from c group by 1) select b as batch, count(*) as phrases, max(top) as top from c join m using (b) where n / top >= 0.55 group by 1""".replace("{T}", f"regexp_extract_all(reading_vi, '(?i){text.TOKEN}')"))
def tightening_blacklist(spark, d):
    r = records(spark, d, "reading_vi").where("reading_vi is not null")
    b = F.pmod(F.conv(F.substring(F.md5("example_id"), 1, 4), 16, 10).cast("int"), F.lit(4))
    return aggregating.tightening(r.select(b.alias("batch"), F.explode(text.ngrams(text.tokens(F.col("reading_vi")), 2)).alias("gram")), "batch", 4)


# --- memory of texts: order-dependent or by hashed vectors, so without SQL (tested against row-by-row versions)


@query()
def cascade_stages(spark, d):
    columns = ("target_vi", "card_ids", "orientations", "task_type", "spread_id", "length_band", "register", "matched_pair_id")
    r = deliveries(spark, d, *columns)  # the first stage removes what was delivered again
    structure = [F.array_sort("card_ids"), *map(F.col, ("orientations", "task_type", "spread_id", "length_band", "register"))]
    stages = deduplicating.cascade(r, "delivery", "target_vi", F.col("key"), structure, F.col("delivery"), F.col("matched_pair_id").isNotNull(), cosine=0.92)
    return stages.groupBy("stage").agg(F.count("*").alias("n"))


def _anchors(spark, d):
    return table(spark, d, "anchor_readings").where("prose_vi is not null").select(F.col("anchor_id").alias("id"), F.col("prose_vi").alias("t"))


@query()
def memory_rate(spark, d):
    memory = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("t"))
    return deduplicating.duplicate_rate(deduplicating.remembered(_anchors(spark, d), memory, "id", "t"))


@query()
def replay_rate(spark, d):
    return deduplicating.duplicate_rate(deduplicating.replayed(_anchors(spark, d), "id", "t", F.col("id")))


@query()
def ablation_report(spark, d):
    a = _anchors(spark, d)
    flags = checkpoint(deduplicating.replayed(a, "id", "t", F.col("id")))
    grams = lambda t: text.ngrams(text.tokens(t), 2)
    listed = aggregating.blacklist(a.select(F.explode(text.ngrams(text.tokens(F.col("t")), 4)).alias("gram")), ["xuôi", "ngược"])
    phrases = [r["gram"] for r in listed.select("gram").collect()]  # anchors are a fixed table
    return deduplicating.ablation(a, flags, "id", "t", phrases, grams)


# --- summaries


@query(f"select count(ifd_score) as n, min(ifd_score) as least, max(ifd_score) as most, round(avg(ifd_score), 6) as mean from {ONCE}")
def score_summary(spark, d):
    x = F.col("ifd_score")
    return records(spark, d, "ifd_score").agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.round(F.avg(x), 6).alias("mean"))


@query(f"""with w as (select example_id, r.ifd_score, regexp_extract_all(reading_vi, '[^ \\n\\r\\t]+') as w, reading_vi as t from {ONCE} r where reading_vi is not null and ifd_score is not null), f as (select example_id, ifd_score as i, ln(1 + len(w)) as a, len(list_distinct(w)) / greatest(1, len(w)) as b, len(regexp_extract_all(t, '[.!?…]')) + 1 as c from w),
    z as (select example_id, {" + ".join(f"coalesce(({x} - avg({x}) over ()) / nullif(stddev_pop({x}) over (), 0), 0)" for x in "abc")} as s, coalesce((i - avg(i) over ()) / nullif(stddev_pop(i) over (), 0), 0) as zi from f) select example_id, round(0.5 * s + 0.5 * zi, 5) as score from z""")
def composite_with_score(spark, d):
    w = F.regexp_extract_all("reading_vi", F.lit(r"[^ \n\r\t]+"), F.lit(0))
    r = records(spark, d, "reading_vi", "ifd_score").where("reading_vi is not null and ifd_score is not null")
    t = r.select("example_id", F.log1p(F.size(w)).alias("a"), text.type_token_ratio(w).alias("b"), text.sentence_count(F.col("reading_vi")).cast("double").alias("c"), F.col("ifd_score").alias("i"))
    m = F.broadcast(t.agg(*(f(x).alias(f"{n}{x}") for x in "abci" for n, f in (("m", F.avg), ("s", F.stddev_pop)))))  # one row
    z = lambda x: F.coalesce((F.col(x) - F.col(f"m{x}")) / F.nullif(F.col(f"s{x}"), F.lit(0.0)), F.lit(0.0))
    return t.crossJoin(m).select("example_id", F.round(0.5 * (z("a") + z("b") + z("c")) + 0.5 * z("i"), 5).alias("score"))


@query("""with t as (select doc_id, text, length(text) as n, sum(length(text)) over (order by created_at, doc_id rows unbounded preceding) as running from documents where length(text) > 0) select doc_id, least(n, 200000 - (running - n))::int as chars, sha256(text[1:least(n, 200000 - (running - n))]) as digest from t where running - n < 200000""")
def budget_texts(spark, d):
    t = table(spark, d, "documents").where("length(text) > 0").select("doc_id", "created_at", F.length("text").cast("long").alias("n"))
    cut = ordering.within_budget(t, [F.col("created_at"), F.col("doc_id")], "n", 200_000).select("doc_id", F.least("n", F.lit(200_000) - (F.col("running") - F.col("n"))).cast("int").alias("chars"))
    return table(spark, d, "documents").select("doc_id", "text").join(cut, "doc_id").select("doc_id", "chars", F.sha2(F.substring("text", F.lit(1), F.col("chars")), 256).alias("digest"))


@query("""with s as (select kind, text is not null as a, length(text) >= 250 as b, length(text) >= 250 and contains(text, '?') as c from documents) select coalesce(kind, 'none') as kind, count(*) as scanned, count(*) filter (a) as filled, count(*) filter (b) as long, count(*) filter (c) as asking, round(100 * count(*) filter (c) / count(*), 2) as percent from s group by 1""")
def funnel_counts(spark, d):
    n = F.length("text") >= 250
    g = table(spark, d, "documents").groupBy(F.coalesce("kind", F.lit("none")).alias("kind"))
    asking = F.count_if(n & F.contains("text", F.lit("?")))
    return g.agg(F.count("*").alias("scanned"), F.count("text").alias("filled"), F.count_if(n).alias("long"), asking.alias("asking"), F.round(100 * asking / F.count("*"), 2).alias("percent"))


_PAIRS = f"(select safety_category, matched_pair_id, matched_member, example_id, len(card_ids)::int as cards from {ONCE} where matched_pair_id is not null)"


@query(f"select b.safety_category, b.matched_pair_id, b.example_id as benign, r.example_id as risk, b.cards = r.cards as same_size from {_PAIRS} b join {_PAIRS} r on b.safety_category = r.safety_category and b.matched_pair_id = r.matched_pair_id where b.matched_member = 'benign' and r.matched_member = 'risk'")
def matched_members(spark, d):
    r = records(spark, d, "safety_category", "matched_pair_id", "matched_member", "card_ids").where("matched_pair_id is not null")
    side = lambda m: r.where(F.col("matched_member") == m).select("safety_category", "matched_pair_id", F.col("example_id").alias(m), F.size("card_ids").alias(f"{m}_n"))
    return side("benign").join(side("risk"), ["safety_category", "matched_pair_id"]).select("safety_category", "matched_pair_id", "benign", "risk", (F.nullif("benign_n", F.lit(-1)) == F.nullif("risk_n", F.lit(-1))).alias("same_size"))


@query("""with r as (select n_name as artifact, sha256(n_name) as digest from nation where n_nationkey < 20), c as (select n_name as artifact, sha256(case when n_nationkey % 5 = 0 then 'changed' else n_name end) as digest from nation where n_nationkey >= 3) select coalesce(r.artifact, c.artifact) as artifact, case when r.digest is null then 'unrecorded' when c.digest is null then 'missing' when r.digest = c.digest then 'match' else 'drift' end as state from r full join c on r.artifact = c.artifact""")
def digest_drift(spark, d):
    n = table(spark, d, "nation")
    r = n.where("n_nationkey < 20").select(F.col("n_name").alias("artifact"), F.sha2("n_name", 256).alias("digest"))
    c = n.where("n_nationkey >= 3").select(F.col("n_name").alias("artifact"), F.sha2(F.when(F.col("n_nationkey") % 5 == 0, "changed").otherwise(F.col("n_name")), 256).alias("digest"))
    return integrity.check_digests(r, c).select("artifact", "state")


@query("""with s as (select n_chars as v, row_number() over (order by n_chars) as r, count(*) over () as n from documents where n_chars > 0), m as (select v as median from s where r = least(n, floor(0.5 * n)::bigint + 1)) select case when v <= median then 'short' else 'long' end as band, count(*) as n, round(count(*) / (select count(*) from s), 4) as share from s, m group by 1""")
def length_bands(spark, d):
    t = table(spark, d, "documents").where("n_chars > 0").select("n_chars")
    m = F.broadcast(ordering.percentiles(t, "n_chars", [0.5]).select(F.col("value").alias("median")))  # one row
    g = t.crossJoin(m).groupBy(F.when(F.col("n_chars") <= F.col("median"), "short").otherwise("long").alias("band")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("all")))).select("band", "n", F.round(F.col("n") / F.col("all"), 4).alias("share"))


@query(f"""with r as (select cards_used from {ONCE} where len(cards_used) > 0), u as (select unnest(cards_used) as c from r) select c.card_id as card_id, round(count(*) / (select count(*) from r), 4) as per_reading, round(count(*) filter (c.orientation = 'reversed') / count(*), 4) as reversed_share from u where c.card_id is not null group by 1
    union all select -1, round((select avg(len(cards_used)) from r), 4), round(count(*) filter (c.orientation = 'reversed') / count(*), 4) from u""")
def card_rates(spark, d):
    r = records(spark, d, "cards_used").where("size(cards_used) > 0")
    u = r.select(F.explode("cards_used").alias("c")).select("c.card_id", "c.orientation")
    g = u.groupBy("card_id").agg(F.count("*").alias("n"), F.count_if(F.col("orientation") == "reversed").alias("k"))
    all_ = F.broadcast(r.agg(F.count("*").alias("readings")))  # one row
    one = g.where("card_id is not null").unionByName(g.agg(F.lit(-1).alias("card_id"), F.sum("n").alias("n"), F.sum("k").alias("k")))
    return one.crossJoin(all_).select("card_id", F.round(F.col("n") / F.col("readings"), 4).alias("per_reading"), F.round(F.col("k") / F.col("n"), 4).alias("reversed_share"))


@query(f"with p as ({ORACLES['polarity_attribution']}) select attribution, count(*) as n, round(avg(score), 6) as score, count(*) > 0.5 * (select count(*) from p) as dominant from p group by 1")
def attribution_summary(spark, d):
    p = table(spark, d, "documents").where("text is not null").select(text.polarity(F.col("text")).alias("p")).select("p.attribution", F.round("p.score", 6).alias("s"))
    g = p.groupBy("attribution").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("score"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("all")))).select("attribution", "n", "score", (F.col("n") > 0.5 * F.col("all")).alias("dominant"))


@query(f"""with p as ({ORACLES["profile_distance"]}), q as (select max(distance) filter (r = least(n, floor(0.9 * n)::bigint + 1)) as p90 from (select distance, row_number() over (order by distance) as r, count(*) over () as n from p)), a as (select anchor_id, {{T}} as t from anchor_readings where prose_vi is not null)
    select anchor_id, coalesce(distance <= p90, false) and case when len(t) > 0 then len(list_filter(t, lambda x: regexp_matches(x, '(?i)[{text.MARKED}]'))) / len(t) else 0 end >= 0.5 as vietnamese from a left join p using (anchor_id), q""".replace("{T}", f"regexp_extract_all(prose_vi, '(?i){text.TOKEN}')"))
def vietnamese_gate(spark, d):
    from quern.plans.contract import profile_distance

    p = checkpoint(profile_distance(spark, d))
    p90 = F.broadcast(ordering.percentiles(p, "distance", [0.9]).select(F.col("value").alias("p90")))  # one row
    a = table(spark, d, "anchor_readings").where("prose_vi is not null").select("anchor_id", "prose_vi").join(p, "anchor_id", "left").crossJoin(p90)
    return a.select("anchor_id", (F.coalesce(F.col("distance") <= F.col("p90"), F.lit(False)) & (text.diacritic_ratio(F.col("prose_vi")) >= 0.5)).alias("vietnamese"))


@query(f"with p as (select jaccard, row_number() over (order by jaccard) as r, count(*) over () as n from ({ORACLES['pair_self_join_jaccard']})) select coalesce(round(max(jaccard) filter (r = least(n, floor(0.9 * n)::bigint + 1)), 9), 0.55) as threshold from p")
def drift_threshold(spark, d):
    from quern.plans.contract import pair_self_join_jaccard

    p = ordering.percentiles(pair_self_join_jaccard(spark, d), "jaccard", [0.9])
    return p.agg(F.coalesce(F.round(F.max("value"), 9), F.lit(0.55)).alias("threshold"))


@query("""select o_orderkey, case when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'P' then 'failed' when date_diff('second', o_orderdate::timestamp, timestamp '1998-01-01') > 31536000 then 'timed_out' when o_orderkey % 2 = 0 then 'orphaned' else 'running' end as state from orders""")
def run_states(spark, d):
    from quern.operators.scheduling import run_state

    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    return table(spark, d, "orders").select("o_orderkey", run_state(status, F.col("o_orderdate").cast("timestamp"), F.lit("1998-01-01").cast("timestamp"), 31_536_000, F.col("o_orderkey") % 2 == 1).alias("state"))
