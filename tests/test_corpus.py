import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import aggregating, conforming, deduplicating, integrity, ordering, partitioning, scoring, validating
from quern.sources import readers, writers


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("label", "want"), [("Lá bài The Fool ngược", ("The Fool", "reversed")), ("lá  bài\nThe Sun", ("The Sun", "upright")), ("Death ngược ", ("Death", "reversed")), ("", ("", "upright"))])
def test_label_parts(spark, label, want):
    assert tuple(one(spark, label, text.label_parts)) == want


def test_null_texts_give_nulls(spark):
    for f in (text.label_parts, text.page_count, text.without_pages, text.is_question, text.is_removed, text.short_label):
        assert one(spark, None, f) is None


def test_mentions_look_ahead(spark):
    names = ["The Sun", "The Sunrise", "Death"]
    got = one(spark, "The Sun, then Death upside down. the sun (reversed); THE SUNRISE rx. Deathly", lambda x: text.mentions(x, names))
    assert [tuple(r) for r in got] == [("the sun", False), ("death", True), ("the sun", True), ("the sunrise", True)]
    assert one(spark, "Death " + "." * 30 + " reversed", lambda x: text.mentions(x, names))[0]["reversed"] is False


def test_unknown_names(spark):
    assert one(spark, "The Future, The Moon and The  Silver Key; The Silver Key. Then", lambda x: text.unknown_names(x, ["The Moon"])) == ["The Silver Key"]


def test_glosses_labels_and_cues(spark):
    g = lambda t, label: one(spark, t, lambda x: text.short_gloss(x, F.lit(label), 4, 20))
    assert g("what was", "Past") == "Past: what was" and g("the past  itself", "Past") == "the past itself"
    assert g("what lies behind you now and ever; more", "Past") == "Past: what lies behind you"
    assert one(spark, "Hope", text.short_label) == "Hope" and one(spark, "What is it that you hope for", text.short_label) == "what is it"
    assert one(spark, "A start.", lambda x: text.with_cue(x, F.lit("folly"), "Waite")) == "A start (Waite: folly)"
    assert one(spark, "A start.", lambda x: text.with_cue(x, F.lit("START"), "Waite")) == "A start."
    assert one(spark, "A start.", lambda x: text.with_cue(x, F.lit(None).cast("string"), "Waite")) == "A start."


def test_pages_leaks_blocks(spark):
    assert one(spark, "a\n--- Page 3 ---\nb", text.page_count) == 1 and one(spark, "a\n--- Page 3 ---\nb", text.without_pages) == "a b"
    assert one(spark, "As An AI model", lambda x: text.leaks(x, ["as an AI", "other"])) == ["as an AI"]
    assert one(spark, ["a", "b"], lambda x: text.block("T", x), "array<string>") == "T\n- a\n- b" and one(spark, [], lambda x: text.block("T", x), "array<string>") == "T"
    assert one(spark, "sun sun moon moon", lambda x: text.first_repeated(x, ["Star", "Sun", "Moon"], F.array(F.lit("sun")))) == "Moon"


def test_language_or_category(spark):
    d = spark.createDataFrame([("VI ", None), (None, "news_vi"), ("", "vietnamese"), ("en", "vi"), (None, None)], "g string, c string")
    assert [r[0] for r in d.select(text.is_language(F.col("g"), F.col("c"), "vi", "vietnamese")).collect()] == [True, True, True, False, False]


def test_rules_stop_at_the_schema(spark):
    base = {"example_id": "e", "question_vi": "q", "target_vi": "Lá The Sun ngược sáng " * 20, "reading_vi": "r", "card_ids": [1], "cards_used": [{"name_en": "The Sun", "orientation": "reversed"}], "orientations": ["reversed"], "task_type": "reading", "spread_id": "s", "length_band": "ngắn", "register": "warm", "querent_context": "love", "provenance": ["x"], "prompt_slot": 1}
    rows = [base, base | {"spread_id": "spread_decision"}, base | {"target_vi": "khoẻ " + "The Moon the moon " * 30}, base | {"register": None, "reading_vi": " "}]
    kind = "example_id string, question_vi string, target_vi string, reading_vi string, card_ids array<int>, cards_used array<struct<name_en string, orientation string>>, orientations array<string>, task_type string, spread_id string, length_band string, register string, querent_context string, provenance array<string>, prompt_slot int"
    d = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    got = [(r["x"]["reasons"], r["x"]["warning"]) for r in d.select(validating.rule_findings(d, ["The Sun", "The Moon"]).alias("x")).collect()]
    assert got[0] == ([], None) and got[1] == (["spread_context_mismatch"], None)
    assert got[2] == (["lang_id", "diacritic_health_typo", "card_containment", "orientation_no_nguoc"], "The Moon")
    assert got[3] == (["schema:register", "schema:register:value", "schema:empty_reading_vi"], None)


def test_orientation_findings(spark):
    kb = spark.createDataFrame([(1, "upright", ["sáng rõ", "vui vẻ", "abc"])], "card_id int, orientation string, keywords array<string>")
    rows = [("Sáng rõ và vui vẻ", 1, "reversed", "A"), ("A (B) nằm xuôi", 1, "reversed", "A (B)"), ("A xuôi", 1, "upright", "A"), ("C" + "." * 50 + "xuôi", 2, "reversed", "C"), (None, 1, "reversed", "A")]
    got = {r["t"]: r["reasons"] for r in validating.orientation_findings(spark.createDataFrame(rows, "t string, card_id int, orientation string, name_en string"), kb, "t").collect()}
    assert got == {"Sáng rõ và vui vẻ": ["reversed_draw_has_upright_keywords"], "A (B) nằm xuôi": ["reversed_named_as_upright"]}


def test_gates_and_counts(spark):
    d = spark.createDataFrame([(True,), (False,), (False,), (None,)], "ok boolean")
    assert tuple(validating.gate_counts(d, F.col("ok")).first()) == (4, 1, 2, 1)
    assert [tuple(r) for r in validating.axis_counts(d, {"a": F.col("ok")}).collect()] == [("a", 1, 3, True)]
    assert validating.rejection_rate(d.limit(0), F.col("ok")).first()["rate"] is None
    g = spark.createDataFrame([("Lá The Sun sáng và vui", 0.2), ("sẽ chết The Sun sáng vui", 0.2), ("The Sunny sáng vui", None)], "t string, j double")
    x = g.select(validating.text_gates(F.col("t"), F.lit("The Sun"), F.array(F.lit("sáng"), F.lit("vui")), F.col("j"), text.FORBIDDEN).alias("x")).select("x.*").collect()
    assert [r["passed"] for r in x] == [True, False, False] and [r["clean"] for r in x] == [True, False, True] and not x[2]["inline"]


def test_complete_draws_leave_out_whole_records(spark):
    kb = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "card int, side string, v string")
    d = spark.createDataFrame([("x", [(1, "u"), (2, "u")]), ("y", [(1, "u"), (3, "u")]), ("z", []), ("n", None)], "id string, draw array<struct<card int, side string>>")
    assert sorted((r["id"], r["place"], r["v"]) for r in conforming.complete_draws(d, "id", F.col("draw"), kb, ["card", "side"]).collect()) == [("x", 0, "a"), ("x", 1, "b")]


def test_repair(spark):
    d = spark.createDataFrame([("w", "m", None, "h"), ("m", "w", "x", "y")], "work string, money string, health string, heath string")
    got = conforming.repaired(d, {"heath": "health", "none": "work"}, [("work", "money", F.col("work") == "m")]).collect()
    assert [tuple(r) for r in got] == [("w", "m", "h"), ("w", "m", "x")]


def test_orders_and_numbers(spark):
    d = spark.createDataFrame([("b10", 1), ("a2", None), ("c", 7)], "n string, k int")
    assert [r["n"] for r in d.orderBy(ordering.listed(F.col("n"), ["c"]), ordering.digits(F.col("n"))).collect()] == ["c", "a2", "b10"]
    assert {r["n"]: r["next"] for r in ordering.next_number(d, ["n"], "k").collect()} == {"b10": 2, "a2": 0, "c": 8}
    assert partitioning.exemplars(d, F.col("n"), F.col("n"), F.col("n") == "c", 5).count() == 2


def test_registry_and_cache(spark, tmp_path):
    found = spark.createDataFrame([("a", '{"x":1}'), ("b", "[1]"), ("z", "{}")], "report string, body string")
    assert {r["report"]: r["state"] for r in integrity.report_states(found, ["a", "b", "c"]).collect()} == {"a": "ok", "b": "broken", "c": "missing", "z": "unknown"}
    p = str(tmp_path / "t")
    spark.range(3).write.parquet(p)
    cache = integrity.FileCache()
    first = cache.get("t", lambda: spark.read.parquet(p))
    assert cache.get("t", lambda: spark.read.parquet(p)) is first
    spark.range(5).write.mode("append").parquet(p)
    assert cache.get("t", lambda: spark.read.parquet(p)).count() == 8
    assert [tuple(r) for r in integrity.table_facts({"t": spark.range(2)}).collect()] == [("t", 2, "id")]


def test_tightening_and_verdicts(spark):
    g = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (1, "b"), (2, "c")], "batch int, gram string")
    assert sorted(tuple(r) for r in aggregating.tightening(g, "batch", 3).collect()) == [(0, 1, 2), (1, 2, 2), (2, 2, 2)]
    d = spark.range(2000).select(scoring.mock_verdict(F.col("id").cast("string"), F.lit(0.3), 1).alias("v"))
    assert 0.26 < d.agg(F.avg(F.col("v").cast("int"))).first()[0] < 0.34


def texts(n=120, seed=4):
    rng = random.Random(seed)
    vocab = [f"{c}{i}{c}o" for c in "bcdđghklmn" for i in "aeiou"]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choices(vocab, k=rng.randrange(20, 40))))
    return out


def test_text_cosine_pairs_against_all_pairs(spark):
    rows = [*enumerate(texts()), (500, None), (501, ""), (502, "ab"), (503, texts()[0])]
    d = spark.createDataFrame(rows, "i int, t string")
    v = {i: deduplicating.gram_vector(t) for i, t in rows if t is not None}
    want = {(a, b) for a in v for b in v if a < b and v[a] @ v[b] >= 0.9 - 1e-9}
    first = {t: min(i for i, x in rows if x == t) for _, t in rows}
    reps = {i for i, t in rows if t is not None and first[t] == i}
    got = {(r["a"], r["b"]) for r in deduplicating.text_cosine_pairs(d, "i", "t", 0.9).collect()}
    assert {(a, b) for a, b in want if a in reps} == {(a, b) for a, b in got if a in reps} and got <= want and len(want) > 20
    left, right = d.where("i % 2 = 0"), d.where("i % 2 = 1")
    hit = {r["i"] for r in deduplicating.remembered(left, right, "i", "t", 0.9).where("duplicate").collect()}
    assert hit == {i for i in v if i % 2 == 0 and any(j % 2 == 1 and v[i] @ v[j] >= 0.9 - 1e-9 for j in v)}
    assert deduplicating.text_cosine_pairs(d.limit(0), "i", "t", 0.9).count() == 0


def test_replay_and_ablation_against_row_by_row(spark):
    rows = list(enumerate(texts(80, 6)))
    d = spark.createDataFrame(rows, "i int, t string")
    kept, want = [], {}
    for i, t in rows:
        x = deduplicating.gram_vector(t)
        want[i] = any(x @ y >= 0.92 - 1e-6 for y in kept)
        if not want[i]:
            kept.append(x)
    flags = deduplicating.replayed(d, "i", "t", F.col("i"))
    assert {r["i"]: r["duplicate"] for r in flags.collect()} == want and any(want.values())
    rate = deduplicating.duplicate_rate(flags).first()
    assert (rate["n"], rate["dups"], rate["rate"]) == (80, sum(want.values()), round(sum(want.values()) / 80, 4))
    phrase = rows[0][1].split()[0]
    got = {r["kept"]: (r["n"], r["distinct"]) for r in deduplicating.ablation(d, flags, "i", "t", [phrase], lambda t: text.ngrams(F.split(t, " "), 2)).collect()}

    def distinct(ts):
        g = [x for t in ts for x in zip(t.split(), t.split()[1:], strict=False)]
        return round(len(set(g)) / len(g), 4)

    memory = [t for i, t in rows if not want[i]]
    clean = [t for t in memory if phrase not in t]
    assert got == {k: (len(ts), distinct(ts)) for k, ts in (("none", [t for _, t in rows]), ("memory", memory), ("all", clean))}
    none = {r["kept"]: r["n"] for r in deduplicating.ablation(d, flags, "i", "t", [""], lambda t: text.ngrams(F.split(t, " "), 2)).collect()}
    assert none["all"] == none["memory"] == len(memory)


def test_cascade_with_vectors_against_row_by_row(spark):
    rows = [(i, t, i % 7 == 0) for i, t in enumerate(texts(90, 8))]
    d = spark.createDataFrame(rows, "i int, t string, safe boolean")
    got = {r["i"]: r["stage"] for r in deduplicating.cascade(d, "i", "t", F.sha2("t", 256), None, F.col("i"), F.col("safe"), cosine=0.8).collect()}
    lanes = {r["i"]: r["l"] for r in d.select("i", deduplicating.minhash(F.col("t")).alias("l")).collect()}
    seen, kept, want = set(), [], {}
    for i, t, safe in rows:
        if t in seen:
            want[i] = "exact"
            continue
        seen.add(t)
        n, v = len(t.split()), deduplicating.gram_vector(t)
        near = any(sum(x == y for x, y in zip(lanes[i], lanes[j], strict=True)) >= 0.85 * 128 and m * 1.2 >= n and n * 1.2 >= m for j, m, _ in kept)
        close = any(v @ w >= 0.8 - 1e-9 for _, _, w in kept)
        want[i] = "kept" if safe or not (near or close) else "near" if near else "embedding"
        if want[i] == "kept":
            kept.append((i, n, v))
    assert got == want and {"exact", "near", "embedding", "kept"} <= set(want.values())


def test_cascade_stages_drops_what_was_delivered_again(spark, tmp_path):
    """Whole rows are told apart but for their time of ingestion: a protected record goes only if it was delivered again."""
    import __spark_entry__ as entry

    words = texts(4, 5)
    kind = "example_id string, target_vi string, card_ids array<int>, orientations array<string>, task_type string, spread_id string, length_band string, register string, matched_pair_id string, matched_member string, ingested_at int"
    row = lambda id, t, cards, pair, member, at: (id, words[t], cards, ["upright"], "x", "s", "short", "warm", pair, member, at)
    rows = [row("a", 0, [1], "p", "one", 5), row("a", 0, [1], "p", "one", 3), row("a", 0, [1], "p", "one", 3), row("ab", 0, [1], "p", "other", 4)]
    rows += [row("b", 1, [2], None, None, 1), row("b", 1, [2], None, None, 2), row("c", 2, [2], None, None, 1), row("d", 3, [3], None, None, 1)]
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/sft_rows.parquet")
    got = {r["stage"]: r["n"] for r in entry.queries()["cascade_stages"](spark, str(tmp_path)).collect()}
    assert got == {"exact": 3, "structural": 1, "kept": 4}


def test_no_wide_row_is_joined_to_pairs_that_are_not_alike(spark):
    """Texts of one vocabulary meet in most bands of few lanes; sketches leave about the pairs that are alike."""
    rng = random.Random(3)
    phrases = ["".join(rng.choices("abcdefghij ", k=40)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(phrases, k=12))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " and a few more words") for i in range(40)]
    d = spark.createDataFrame(rows, "i int, t string")
    t = [x for _, x in rows]
    axes = deduplicating._axes(deduplicating.gram_matrix(t).T @ (deduplicating.gram_matrix(t) @ deduplicating._directions(deduplicating.SKETCH)))
    v = (deduplicating.gram_matrix(t) @ axes).astype(np.float16)
    out = deduplicating.sketch_tile(pa.table({"node": list(range(len(t))), "side": pa.array([3] * len(t), pa.int32()), "v": pa.array([x.tobytes() for x in v], pa.binary())}), 0.92)
    met = set(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
    g = deduplicating.gram_matrix(t)
    want = {(a, b) for a in range(len(t)) for b in range(a + 1, len(t)) if g[a] @ g[b] >= 0.92}
    assert want <= met and 40 <= len(want) and len(met) < 2 * len(want)
    got = {(r["a"], r["b"]) for r in deduplicating.text_cosine_pairs(d, "i", "t", 0.92).collect()}
    assert got == {(rows[a][0], rows[b][0]) for a, b in want}


def test_tiles_whose_pairs_all_fail_the_whole_sketch_give_no_rows():
    """Two vectors that are alike along the first axes only, those of the first comparison."""
    v = np.eye(deduplicating.SKETCH, dtype=np.float16)[[deduplicating.FIRST, deduplicating.FIRST + 1]]
    t = pa.table({"bi": [0, 0], "bj": [0, 0], "node": [1, 2], "side": pa.array([3, 3], pa.int32()), "v": pa.array([x.tobytes() for x in v], pa.binary())})
    assert deduplicating.sketch_tiles(t, 0.92) is None


def test_a_repeated_text_is_alike_at_any_length(spark):
    """The cosine doesn't depend on the length, so no window of sizes may."""
    t = "một hai ba bốn năm sáu bảy tám chín mười "
    d = spark.createDataFrame([(1, t * 2), (2, t * 9), (3, "khác hẳn")], "i int, t string")
    assert [(r["a"], r["b"]) for r in deduplicating.text_cosine_pairs(d, "i", "t", 0.92).collect()] == [(1, 2)]


def test_remembered_few_and_many_find_the_same(spark):
    rows = list(enumerate(texts()))
    left, right = (spark.createDataFrame([r for r in rows if r[0] % 2 == k], "i int, t string") for k in (0, 1))
    few, many = ({tuple(r) for r in deduplicating.text_cosine_pairs(left, "i", "t", 0.9, right, few=n).collect()} for n in (2048, 1))
    assert few == many and few
    plan = deduplicating.text_cosine_pairs(left, "i", "t", 0.9, right)._jdf.queryExecution().toString()
    assert "array<long>" not in plan and "lanes" not in plan


def test_gram_vectors_are_made_some_at_a_time():
    """What is made on the way stayed no smaller than all texts of a batch; the hashes are those of zlib, across the ends of texts too."""
    rng = random.Random(2)
    rows = ["".join(rng.choices("aàạ 😀b", k=1100)) for _ in range(500)]
    deduplicating.gram_matrix(rows[:5])
    tracemalloc.start()
    v = deduplicating.gram_matrix(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * v.nbytes
    assert all(np.allclose(v[i], deduplicating.gram_vector(rows[i]), atol=1e-6) for i in (0, 99, 100, 499))
    odd = ["", "abc", "abcd", "\ud800abc", "", "߿ࠀ￿𐀀\U0010ffff", "é" * 5, "ab", "x" * 9]
    for n in (1, 4, 5):
        row, x = deduplicating.gram_crcs(odd, n)
        assert list(zip(row.tolist(), x.tolist(), strict=True)) == [(i, zlib.crc32(t[j : j + n].encode("utf-8", "surrogatepass"))) for i, t in enumerate(odd) for j in range(len(t) - n + 1)]


def test_settings_reports_and_backups(spark, tmp_path):
    assert readers.settings("# x\nA=1\n\nexport B = 'two words'\nA=2\nnothing\n=3") == {"A": "1", "B": "two words"}
    d = spark.createDataFrame([("a|b", 0.5), (None, None)], "name string, x double")
    assert writers.markdown_table(d, "T") == "# T\n\n| name | x |\n|---|---|\n| a\\|b | 0.5 |\n| – | – |\n"
    with pytest.raises(ValueError, match="no report"):
        writers.markdown_table(spark.range(5), "T", 4)
    p = str(tmp_path / "out")
    assert writers.set_aside(spark, p, "1") is None
    spark.range(2).write.json(p)
    writers.rewrite(spark.range(3), p, "2")
    assert spark.read.json(p).count() == 3 and spark.read.json(f"{p}.2").count() == 2
    with pytest.raises(FileExistsError):
        writers.set_aside(spark, p, "2")
    assert readers.first_keys(spark, p) == ["id"]


def test_language_sample_counts_what_it_skips(spark):
    d = spark.createDataFrame([("a", "vi", None), (" ", "vi", None), ("b", "en", None), ("c", None, None), (None, None, "{")], "t string, g string, _c string")
    kept, skipped = readers.language_sample(d, "t", "_c", F.col("g") == "vi")
    assert [r["t"] for r in kept.collect()] == ["a"] and skipped == {"no_object": 1, "language": 2, "blank": 1}
