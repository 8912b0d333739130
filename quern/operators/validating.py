"""Gates: rules with reasons, containment, orientation, collisions, acceptance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import diacritic_ratio, gazetteer, let

# Categories of records, and bounds in words by length band.
TASK_TYPES = ("explanation", "reading", "safety", "grounding", "correction")
LENGTH_BOUNDS = {"ngắn": (40, 320), "đầy_đủ": (60, 420)}
REGISTERS = ("formal", "warm", "casual")
REQUIRED = ("example_id", "question_vi", "target_vi", "reading_vi", "card_ids", "cards_used", "orientations", "task_type", "spread_id", "length_band", "register", "querent_context", "provenance", "prompt_slot")


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; an unknown outcome breaks none."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))


def staged(first: dict[str, Column], then: dict[str, Column]) -> Column:
    """Reasons of the first stage if there are any, else of the second."""
    return let(reasons(first), lambda a: F.when(F.size(a) > 0, a).otherwise(reasons(then)))


def marked_word_share(text: Column) -> Column:
    """Share of the words with a letter or digit that have a Vietnamese mark."""
    from quern.functions.text import MARKED, share, word_split

    return share(F.filter(word_split(text), lambda w: w.rlike(r"[\p{L}\p{N}]")), lambda w: w.rlike(f"(?iu)[{MARKED}]"))


def record_reasons(df: DataFrame) -> Column:
    """Of training records: missing and unknown fields first; then language, length, cards named, reversed cards said to be so."""
    present = lambda c: F.col(c) if c in df.columns else F.lit(None)
    first = {f"schema:{c}": present(c).isNull() for c in REQUIRED}
    known = {"task_type": TASK_TYPES, "length_band": tuple(LENGTH_BOUNDS), "register": REGISTERS}
    first |= {f"schema:{c}:value": F.col(c).isNotNull() & ~F.col(c).isin(*v) for c, v in known.items()}
    first["schema:orientation_count"] = F.size("orientations") != F.size("cards_used")
    first |= {f"schema:empty_{c}": ~F.col(c).rlike(r"[^\s\x0B\x85\p{Z}]") for c in ("question_vi", "target_vi", "reading_vi")}
    text, low = F.col("target_vi"), F.lower("target_vi")
    n = F.regexp_count(text, F.lit(r"[^\s\x0B\x85\p{Z}]+"))
    out = reduce(lambda a, k: a.when(F.col("length_band") == k, ~n.between(*LENGTH_BOUNDS[k])), LENGTH_BOUNDS, F.when(F.lit(False), F.lit(False)))
    then = {
        "lang_id": marked_word_share(text) < 0.15,
        "length_bounds": out,
        "card_containment": let(low, lambda t: F.exists("cards_used", lambda c: ~F.contains(t, F.lower(c["name_en"])))),
        "orientation_no_marker": F.exists("cards_used", lambda c: c["orientation"] == "reversed") & ~F.contains(low, F.lit("ngược")),
    }
    return staged(first, then)


def name_containment(text: Column, drawn: Column, names: Sequence[str]) -> Column:
    """struct(found, missing, extra): names of the gazetteer in the text against the drawn ones, all in lower case."""
    d = F.transform(drawn, lambda x: F.lower(x))
    return let(gazetteer(text, names), lambda found: F.struct(found.alias("found"), F.array_except(d, found).alias("missing"), F.array_except(found, d).alias("extra")))


def orientation_conflicts(draws: DataFrame, kb: DataFrame, text: str, least: int = 2) -> DataFrame:
    """Exploded draws (..., card_id, orientation) in the text of which a reversed card has at least so many of its upright keywords, of 4 letters or more. ``kb`` (card_id, orientation, keywords) has two rows a card."""
    up = kb.where("orientation = 'upright'").select("card_id", F.col("keywords").alias("__k"))
    from quern.operators.conforming import small

    hits = let(F.lower(text), lambda low: F.filter(F.transform("__k", lambda k: F.trim(k)), lambda k: (F.length(k) >= 4) & F.contains(low, F.lower(k))))
    return draws.where("orientation = 'reversed'").join(small(up), "card_id").withColumn("hits", F.array_distinct(hits)).where(F.size("hits") >= least).drop("__k")


def distinctive_keywords(kb: DataFrame, most_cards: int = 2, least_letters: int = 5) -> DataFrame:
    """(card_id, keyword): keywords of few cards only."""
    k = kb.select("card_id", F.explode("keywords").alias("k")).select("card_id", F.lower(F.trim("k")).alias("keyword")).where(F.length("keyword") >= least_letters).distinct()
    few = k.groupBy("keyword").agg(F.countDistinct("card_id").alias("n")).where(F.col("n") <= most_cards).select("keyword")
    return k.join(few, "keyword").select("card_id", "keyword")


def keyword_collisions(texts: DataFrame, id: str, text: str, drawn: str, kb: DataFrame, least: int = 2, most_cards: int = 2) -> DataFrame:
    """(id, card_id, hits): cards that weren't drawn and of which a text has several distinctive keywords. Each keyword is looked for in each text: of a knowledge base of known size."""
    from quern.operators.conforming import small

    words = distinctive_keywords(kb, most_cards)
    names = [r[0] for r in words.select("keyword").distinct().orderBy("keyword").collect()]
    if not names:
        return texts.select(id, F.lit(0).alias("card_id"), F.lit(0).alias("hits")).limit(0)
    t = texts.select(id, drawn, let(F.lower(text), lambda low: F.filter(F.lit(names), lambda k: F.contains(low, k))).alias("ks")).where(F.size("ks") >= least)
    hit = t.select(id, drawn, F.explode("ks").alias("keyword")).join(small(words), "keyword").where(~F.array_contains(drawn, F.col("card_id")))
    return hit.groupBy(id, "card_id").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)


def is_vietnamese(text: Column, distance: Column, most_distance: float, least_marks: float = 0.5) -> Column:
    return (distance <= most_distance) & (diacritic_ratio(text) >= least_marks)


def acceptance(checks: dict[str, Column], df: DataFrame) -> DataFrame:
    """(check, passed) of aggregates over a table, and ``all``."""
    one = df.agg(*(c.alias(n) for n, c in checks.items()))
    both = one.withColumn("all", reduce(Column.__and__, (F.col(f"`{n}`") for n in checks)))
    return both.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(F.col(f"`{n}`"), F.lit(False)).alias("passed")) for n in (*checks, "all")))).alias("x")).select("x.*")


def constraint_report(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows for which a condition isn't true, of all rules in one pass."""
    one = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in constraints.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in constraints))).alias("x")).select("x.*")


# Contexts of records, and the spreads that allow few of them.
CONTEXTS = ("love", "career", "money", "health", "spiritual", "decision")
SPREAD_CONTEXTS = {"spread_relationship1": ("love",), "spread_relationship2": ("love",), "spread_relationship3": ("love",), "spread_decision": ("decision",)}


def context_mismatch(spread: Column, context: Column, allow: dict[str, Sequence[str]] = SPREAD_CONTEXTS) -> Column:
    """Whether a spread of a domain stands with another domain's context; a null context doesn't fit either. Other spreads allow all."""
    out = None
    for s, ok in allow.items():
        out = (F if out is None else out).when(spread == s, ~F.coalesce(context.isin(*ok), F.lit(False)))
    return out.otherwise(F.lit(False)) if out is not None else F.lit(False)


def rule_findings(df: DataFrame, names: Sequence[str]) -> Column:
    """struct(reasons, warning) of training records: missing, unknown, mismatched and empty fields first; only where there are none language, spelling, length, cards named and reversed cards said to be so. The warning, where no field is at fault, is the first undrawn name that occurs twice."""
    from quern.functions.text import first_repeated

    first = {f"schema:{c}": F.col(c).isNull() for c in REQUIRED}
    known = {"task_type": TASK_TYPES, "length_band": tuple(LENGTH_BOUNDS), "register": REGISTERS}
    first |= {f"schema:{c}:value": ~F.coalesce(F.col(c).isin(*v), F.lit(False)) for c, v in known.items()}
    first["spread_context_mismatch"] = context_mismatch(F.col("spread_id"), F.col("querent_context"))
    first["schema:orientation_count"] = F.size("orientations") != F.size("cards_used")
    first |= {f"schema:empty_{c}": ~F.coalesce(F.col(c).rlike(r"[^\s\x0B\x85\p{Z}]"), F.lit(False)) for c in ("question_vi", "target_vi", "reading_vi")}
    text, low = F.col("target_vi"), F.lower("target_vi")
    n = F.regexp_count(text, F.lit(r"[^\s\x0B\x85\p{Z}]+"))
    out = reduce(lambda a, k: a.when(F.col("length_band") == k, ~n.between(*LENGTH_BOUNDS[k])), LENGTH_BOUNDS, F.when(F.lit(False), F.lit(False)))
    then = {
        "lang_id": marked_word_share(text) < 0.15,
        "diacritic_health_typo": F.contains(text, F.lit("khoẻ")),
        "length_bounds": out,
        "card_containment": let(low, lambda t: F.exists("cards_used", lambda c: ~F.contains(t, F.lower(c["name_en"])))),
        "orientation_no_nguoc": F.exists("cards_used", lambda c: c["orientation"] == "reversed") & ~F.contains(low, F.lit("ngược")),
    }
    drawn = F.transform("cards_used", lambda c: F.lower(c["name_en"]))
    return let(reasons(first), lambda a: F.struct(F.when(F.size(a) > 0, a).otherwise(reasons(then)).alias("reasons"), F.when(F.size(a) == 0, first_repeated(text, names, drawn)).alias("warning")))


def named_as_upright(text: Column, name: Column, within: int = 60) -> Column:
    """Whether the name is followed, on its line and within so many characters, by a word for upright."""
    spot = F.concat(F.lit(r"(?iu)\Q"), F.replace(name, F.lit(r"\E"), F.lit("")), F.lit(rf"\E.{{0,{within}}}(?:upright|xuôi)"))
    return F.coalesce(F.regexp_like(text, spot), F.lit(False))


def orientation_findings(draws: DataFrame, kb: DataFrame, text: str, least: int = 2) -> DataFrame:
    """Of exploded draws (..., card_id, orientation, name_en) the reversed ones whose text has upright keywords of theirs (so many, of 4 letters or more) or names them as upright, with the reasons. A card without a row in ``kb`` (card_id, orientation, keywords) is looked for within 40 characters instead of 60."""
    from quern.operators.conforming import small

    up = small(kb.where("orientation = 'upright'").select("card_id", F.col("keywords").alias("__k")))
    hits = let(F.lower(text), lambda low: F.filter(F.transform("__k", lambda k: F.trim(k)), lambda k: (F.length(k) >= 4) & F.contains(low, F.lower(k))))
    d = draws.where("orientation = 'reversed'").join(up, "card_id", "left")
    named = F.when(F.col("__k").isNull(), named_as_upright(F.col(text), F.col("name_en"), 40)).otherwise(named_as_upright(F.col(text), F.col("name_en")))
    found = reasons({"reversed_draw_has_upright_keywords": F.size(hits) >= least, "reversed_named_as_upright": named})
    return d.withColumn("reasons", found).where(F.size("reasons") > 0).drop("__k")


def text_gates(text: Column, name: Column, keywords: Column, drift: Column, forbidden: dict[str, Sequence[str]], least_recall: float = 0.7, most_drift: float = 0.55) -> Column:
    """struct(inline, recall, drift_ok, clean, passed): the name stands in the text, enough keywords do, the likeness to other texts isn't too high, no forbidden claim is made; passed: all."""
    from quern.functions.text import keyword_containment, matched_categories

    spot = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}_])"))
    parts = F.struct(F.coalesce(F.regexp_like(text, spot), F.lit(False)).alias("inline"), keyword_containment(text, keywords).alias("recall"), F.coalesce(drift <= most_drift, F.lit(True)).alias("drift_ok"), (F.size(matched_categories(text, forbidden)) == 0).alias("clean"))
    return let(parts, lambda g: F.struct(g["inline"].alias("inline"), g["recall"].alias("recall"), g["drift_ok"].alias("drift_ok"), g["clean"].alias("clean"), (g["inline"] & (g["recall"] >= least_recall) & g["drift_ok"] & g["clean"]).alias("passed")))


def gate_counts(df: DataFrame, state: Column) -> DataFrame:
    """One row (processed, passed, failed, pending): pending has no state."""
    return df.agg(F.count("*").alias("processed"), F.count_if(F.coalesce(state, F.lit(False))).alias("passed"), F.count_if(F.coalesce(~state, F.lit(False))).alias("failed"), F.count_if(state.isNull()).alias("pending"))


def axis_counts(df: DataFrame, axes: dict[str, Column], most: float = 0.6) -> DataFrame:
    """(axis, passed, failed, defect): of judged rows; an unknown verdict fails. defect: more than so much of them fails."""
    one = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"{a}_p") for a, c in axes.items()), F.count("*").alias("n"))
    rows = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"{a}_p").alias("passed"), (F.col("n") - F.col(f"{a}_p")).alias("failed")) for a in axes))
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("defect", F.col("failed") / F.greatest(F.lit(1), F.col("passed") + F.col("failed")) > most)


def rejection_rate(df: DataFrame, rejected: Column) -> DataFrame:
    """One row (rate): share of rejected rows to four places; null without rows."""
    return df.agg(F.bround(F.avg(rejected.cast("double")), 4).alias("rate"))


def all_equal(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, equal): whether the rows of a group agree in all the values, nulls included."""
    return df.groupBy(*keys).agg((F.countDistinct(F.to_json(F.struct(*values), {"ignoreNullFields": "false"})) == 1).alias("equal"))
