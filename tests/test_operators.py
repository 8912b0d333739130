import random
import time

import pytest
from pyspark.sql import functions as F

from quern.operators import aggregating, conforming, deduplicating, filtering, integrity, ordering, partitioning, scheduling, validating


@pytest.fixture(scope="module")
def golden(spark):
    """Seven records: four core, three bulk."""
    rows = [
        ("w1", "core", "reading", "casual", "medium", "love", "single", [0, 1], ["upright", "upright"], "câu", "đọc một", 0.5),
        ("w2", "core", "reading", "casual", "medium", "general", "single", [2], ["reversed"], "câu", "đọc hai", -0.1),
        ("w3", "core", "safety", "formal", "short", "crisis", "single", [5], ["upright"], "câu", "cơn khủng hoảng", 0.9),
        ("w4", "core", "reading", "casual", "medium", "general", "single", [0], ["upright"], "câu", "đọc bốn", 0.5),
        ("w5", "bulk", "explanation", "formal", "long", "career", "celtic", [0, 1], ["upright", "reversed"], "câu", "năm 100% chắc", 0.2),
        ("w6", "bulk", "grounding", "casual", "medium", "general", "single", [], [], "câu", None, None),
        ("w7", "bulk", "reading", "casual", "medium", "love", "single", [0], ["reversed"], "câu", "đọc bảy", 0.35),
    ]
    return spark.createDataFrame(rows, "example_id string, tier string, task_type string, register string, length_band string, querent_context string, spread_id string, card_ids array<int>, orientations array<string>, question_vi string, reading_vi string, ifd_score double").withColumn("position_glosses", F.array(F.lit("g")))


def ids(df):
    return sorted(r["example_id"] for r in df.collect())


def test_filters(golden):
    f = filtering.RowFilter
    m = lambda **k: ids(filtering.matching(golden, f(**k), kind="sft", union=True))
    assert m(ifd_min=0.5) == ["w1", "w3", "w4", "w6"]  # a null score passes
    assert m(card_id="0") == m(card_id=0) == ["w1", "w4", "w5", "w7"]
    assert m(q="KHỦNG HOẢNG") == ["w3"] and m(q="100%") == ["w5"] and m(q="%") == ["w5"]
    assert m(tier="bulk", register="casual") == ["w6", "w7"] and m(orientation="reversed") == ["w2", "w5", "w7"]
    assert len(m()) == 7
    assert len(ids(filtering.matching(golden, f(tier="bulk")))) == 7  # the tier counts for the union only
    with pytest.raises(ValueError):
        filtering.parse_filter({"nope": "1"})
    assert filtering.parse_filter({"ifd_min": "0.5"}).ifd_min == 0.5


def test_filter_reaches_the_scan(golden, tmp_path):
    golden.write.parquet(str(tmp_path / "g"))
    d = filtering.matching(golden.sparkSession.read.parquet(str(tmp_path / "g")), filtering.RowFilter(register="casual"))
    plan = d.select("example_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(register,casual)" in plan and "reading_vi" not in plan.split("ReadSchema")[1]


def test_pages(golden):
    sizes = [ordering.page(golden, [F.col("example_id")], n, 3).count() for n in (1, 2, 3, 4)]
    assert sizes == [3, 3, 1, 0] and ordering.pages(7, 3) == 3 and ordering.pages(0, 3) == 1
    with pytest.raises(ValueError):
        ordering.page(golden, [F.col("example_id")], 0, 3)


def test_lookup(golden):
    assert ids(filtering.lookup(golden, "example_id", "w3")) == ["w3"] and filtering.lookup(golden, "example_id", "x").count() == 0
    assert filtering.lookup(golden, "tier,example_id", "core").count() == 0
    assert ids(filtering.lookup(golden, "tier,example_id", "core/w1")) == ["w1"]


def test_export(golden):
    lines = list(filtering.export_lines(golden.select("example_id", "ifd_score").where("example_id = 'w6'")))
    assert lines == ['{"example_id":"w6","ifd_score":null}']


def test_union_fills_missing_columns(golden):
    u = filtering.tagged_union({"a": golden.select("example_id", "tier").drop("tier"), "b": golden.select("example_id", "ifd_score")})
    assert u.count() == 14 and u.where("tier = 'a' and ifd_score is not null").count() == 0


def test_distributions(golden):
    d = {(r["field"], r["value"]): r["n"] for r in aggregating.field_distributions(golden.withColumn("ok", F.col("ifd_score") > 0.3), ["task_type", "register", "ok"]).collect()}
    assert d == {("task_type", "reading"): 4, ("task_type", "explanation"): 1, ("task_type", "grounding"): 1, ("task_type", "safety"): 1, ("register", "casual"): 5, ("register", "formal"): 2, ("ok", "True"): 4, ("ok", "False"): 2}


def test_histograms(golden):
    h = {r["bin"]: r["n"] for r in aggregating.histogram(golden, "ifd_score").collect()}
    assert sum(h.values()) == 6 and len(h) == 10 and h[9] == 1 and h[0] == 1
    assert aggregating.histogram(golden.where("false"), "ifd_score").count() == 0
    s = {round(r["bin_low"], 2): r["n"] for r in aggregating.stepped_histogram(golden, "ifd_score").collect()}
    assert sum(s.values()) == 6


def test_ranks_running_sums_percentiles(spark):
    rng = random.Random(1)
    xs = [(i, rng.randrange(50)) for i in range(2000)]
    d = spark.createDataFrame(xs, "id int, v int").repartition(7)
    got = ordering.ranked(d, [F.col("v"), F.col("id")], running="v").orderBy("rank").collect()
    want, s = sorted(xs, key=lambda x: (x[1], x[0])), 0
    for k, (r, (i, v)) in enumerate(zip(got, want, strict=True), 1):
        s += v
        assert (r["rank"], r["id"], r["running"]) == (k, i, s)
    values = sorted(v for _, v in xs)
    for r in ordering.percentiles(d, "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        assert r["value"] == values[min(len(values) - 1, int(r["p"] * len(values)))]
    assert ordering.percentiles(d.where("false"), "v", [0.5]).count() == 0
    t = ordering.top_fraction(d, "v", "id", 0.85)
    assert t.where("kept").count() == round(2000 * 0.85)
    assert ordering.within_budget(d, [F.col("v"), F.col("id")], "v", 1000).agg(F.sum("v")).first()[0] >= 1000


def test_percentile_of_ten(spark):
    d = spark.range(1, 11).select(F.col("id").alias("v"))
    assert ordering.percentiles(d, "v", [0.9]).first()["value"] == 10


def test_duplicate_numbers(spark):
    d = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 3, "a")], "g string, i int, l string")
    assert [r["o"] for r in ordering.numbered_duplicates(d, ["g"], [F.col("i")], "l", "o").orderBy("i").collect()] == ["a #1", "b", "a #2"]


def test_aliases(spark):
    c = spark.createDataFrame([(0, "The Fool"), (1, "Ace of Cups"), (2, "Strength")], "card_id int, name string")
    a = conforming.alias_table(c, "card_id", "name", {"ace": ["1"]}, {"cups": ["chalices"]})
    q = spark.createDataFrame([(n,) for n in ["fool", " THE  fool", "1 of chalices", "the strength", "nobody"]], "n string")
    assert {r["n"]: r["resolved_id"] for r in conforming.resolve(q, "n", a).collect()} == {"fool": 0, " THE  fool": 0, "1 of chalices": 1, "the strength": 2, "nobody": None}
    assert [r["n"] for r in conforming.unresolved(q, "n", a).collect()] == ["nobody"]
    with pytest.raises(ValueError):
        conforming.alias_table(c.union(spark.createDataFrame([(9, "the FOOL")], c.schema)), "card_id", "name")
    with pytest.raises(TypeError):
        conforming.guard_name_keyed(c)


def test_small_is_checked(spark):
    assert "broadcast" in conforming.small(spark.range(10), 20)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in conforming.small(spark.range(100), 20)._jdf.queryExecution().logical().toString().lower()


def test_coverage_and_fill(spark, golden):
    u = [spark.range(2).select(F.col("id").alias("a")), spark.createDataFrame([("x",), ("y",)], "b string")]
    p = spark.createDataFrame([(0, "x"), (1, "y")], "a long, b string")
    assert sorted((r["a"], r["b"]) for r in conforming.missing_combinations(p, u).collect()) == [(0, "y"), (1, "x")]
    s = spark.createDataFrame([("w6", 0.7), ("w1", 0.1)], "example_id string, ifd_score double")
    got = {r["example_id"]: r["s"] for r in conforming.fill_down(golden, s, "example_id", "ifd_score", "s").collect()}
    assert got["w6"] == 0.7 and got["w1"] == 0.5


def greedy(nodes, pairs, safe):
    kept = []
    near = {frozenset(p) for p in pairs}
    for n in nodes:
        if n in safe or not any(frozenset((n, k)) in near for k in kept):
            kept.append(n)
    return set(kept)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_keep_is_the_row_by_row_result(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(60))
    rng.shuffle(nodes)
    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.05]
    safe = {n for n in nodes if rng.random() < 0.1}
    n = spark.createDataFrame([(i, r, i in safe) for r, i in enumerate(nodes)], "id int, r int, safe boolean")
    e = spark.createDataFrame(pairs, "a int, b int")
    got = {r["id"] for r in deduplicating.greedy_keep(n, e, "id", "r", F.col("safe")).where("kept").collect()}
    assert got == greedy(nodes, pairs, safe)


def test_structural_keeps_protected(spark):
    d = spark.createDataFrame([(1, "k", False), (2, "k", False), (3, "k", True), (4, "m", None)], "p int, k string, s boolean")
    assert sorted(r["p"] for r in deduplicating.structural(d, [F.col("k")], F.col("p"), F.col("s")).collect()) == [1, 3, 4]


def test_minhash_cascade_against_all_pairs(spark):
    rng = random.Random(7)
    vocab = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(60)]
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(w[:-1] + ["end"])), (3 * i + 2, " ".join(w) if i % 3 else None)]
    d = spark.createDataFrame(rows, "id int, t string")
    lanes = {r["id"]: r["l"] for r in d.where("t is not null").select("id", deduplicating.minhash(F.col("t")).alias("l")).collect()}
    got = {r["id"]: r["stage"] for r in deduplicating.cascade(d, "id", "t", F.sha2(F.coalesce("t", F.lit("")), 256), None, F.col("id"), F.lit(False)).collect()}
    seen, kept, want = set(), [], {}
    for i, t in rows:
        if (t or "") in seen:
            want[i] = "exact"
            continue
        seen.add(t or "")
        near = t and any(sum(a == b for a, b in zip(lanes[i], lanes[k], strict=True)) >= 0.85 * 128 for k in kept if k in lanes)
        want[i] = "near" if near else "kept"
        if not near:
            kept.append(i)
    assert got == want and "near" in want.values()


def test_lane_bands_miss_no_pair_and_hold_no_lanes(spark):
    """One band more than lanes may differ, so one is the same; a row to be shuffled has keys and one bit of each lane."""
    rng = random.Random(11)
    rows = []
    for i in range(30):
        w = [f"word{rng.randrange(300)}" for _ in range(80)]
        rows += [(2 * i, " ".join(w), 80), (2 * i + 1, " ".join(w[:-2] + ["x", "y"]), 80)]
    d = spark.createDataFrame(rows, "id int, t string, n int")
    made = {r["id"]: r for r in deduplicating.lane_features(d, "id", "t", "n", 0.85).collect()}
    lanes = deduplicating.minhash_lanes([t for _, t, _ in rows], 128, 5, 7)
    alike = [(a, b) for a in range(60) for b in range(a) if (lanes[a] == lanes[b]).sum() >= 109]
    assert len(alike) >= 20 and all(any(x == y for x, y in zip(made[a]["bands"], made[b]["bands"], strict=True)) for a, b in alike)
    assert max(len(r["bands"]) for r in made.values()) == 20 and set(made[0].asDict()) == {"id", "node", "words", "s0", "s1", "bands"}
    got = {(r["a"], r["b"]) for r in deduplicating.banded_pairs(d, "id", "t", "n", d.select("id")).collect()}
    assert got == {(b, a) for a, b in alike}


def test_lanes_are_compared_once_and_shuffle_files_freed(spark):
    """The comparison of lanes stood three times in the plan, and the shuffle files of all steps were on disk at once."""
    rng = random.Random(5)
    rows = []
    for i in range(200):
        w = [f"word{rng.randrange(300)}" for _ in range(80)]
        rows += [(2 * i, " ".join(w), 80), (2 * i + 1, " ".join(w[:-1] + ["x"]), 80)]
    d = spark.createDataFrame(rows, "id int, t string, n int")
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def held():
        files = disk.getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()))

    spark.sparkContext._jvm.System.gc()
    time.sleep(1)  # files are deleted by a thread of their own
    before = held()
    got = deduplicating.banded_pairs(d, "id", "t", "n", d.select("id"))
    until = time.time() + 10
    while held() > before and time.time() < until:
        time.sleep(0.2)
    assert held() <= before
    assert "alike" not in got._jdf.queryExecution().toString()
    lanes = deduplicating.minhash_lanes([t for _, t, _ in rows], 128, 5, 7)
    want = {(a, b) for b in range(400) for a in range(b) if (lanes[a] == lanes[b]).sum() >= 109}
    assert {(r["a"], r["b"]) for r in got.collect()} == want and len(want) >= 100


def test_blacklist_and_distinct(spark):
    g = spark.createDataFrame([("a b",)] * 10 + [("c d",)] * 6 + [("e f",)] * 5 + [("k z",)] * 9, "gram string")
    assert sorted(r["gram"] for r in aggregating.blacklist(g, ["k"]).collect()) == ["a b", "c d"]
    assert aggregating.distinct_share(g).first()["distinct_n"] == pytest.approx(4 / 30)


def test_gates(spark, golden):
    r = golden.select("example_id", validating.staged({"null": F.col("reading_vi").isNull()}, {"low": F.col("ifd_score") < 0.3}).alias("r")).collect()
    assert {x["example_id"]: x["r"] for x in r if x["r"]} == {"w2": ["low"], "w5": ["low"], "w6": ["null"]}
    a = {x["check"]: x["passed"] for x in validating.acceptance({"seven": F.count("*") == 7, "scored": F.count("ifd_score") == 7}, golden).collect()}
    assert a == {"seven": True, "scored": False, "all": False}
    c = {x["rule"]: x["violations"] for x in validating.constraint_report(golden, {"scored": F.col("ifd_score") >= 0, "id": F.col("example_id").isNotNull()}).collect()}
    assert c == {"scored": 2, "id": 0}
    m = spark.createDataFrame([({"a": True},), ({"a": True, "b": False},), ({},), (None,)], "m map<string,boolean>")
    assert [x[0] for x in m.select(integrity.gates_passed("m")).collect()] == [True, False, False, False]


def test_digests(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "artifact string, digest string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("n", "4")], "artifact string, digest string")
    assert {r["artifact"]: r["state"] for r in integrity.check_digests(a, b).collect()} == {"x": "match", "y": "drift", "z": "missing", "n": "unrecorded"}


def test_stratified_split_and_repair(spark):
    rows = [(f"r{i}", f"u{i // 2}", "ab"[i // 2 % 2], f"item{i % 7}" if i > 1 else "rare") for i in range(2000)]
    d = spark.createDataFrame(rows, "id string, u string, s string, item string")
    a = partitioning.stratified_split(d, "id", F.col("u"), ["s"], {"test": 0.07, "val": 0.08}, "train")
    got = a.collect()
    units = {}
    for r in got:
        units.setdefault(r["unit"], set()).add(r["split"])
    assert len(got) == 2000 and all(len(s) == 1 for s in units.values())
    assert sum(s == {"test"} for s in units.values()) == 70 and sum(s == {"val"} for s in units.values()) == 80
    moved = a.withColumn("split", F.when(F.col("unit") == "u0", "test").otherwise(F.col("split")))
    fixed = partitioning.repair_coverage(moved, d.select("id", "item"), "id", "train")
    assert {r["split"] for r in fixed.where("unit = 'u0'").collect()} == {"train"} and fixed.count() == 2000


def test_samples_are_stable(spark):
    d = spark.range(1000)
    a = {r["id"] for r in partitioning.sample(d, F.col("id"), 50, 1).collect()}
    assert a == {r["id"] for r in partitioning.sample(d.repartition(9), F.col("id"), 50, 1).collect()} and len(a) == 50
    heavy = partitioning.weighted_sample(d, F.col("id"), F.when(F.col("id") < 100, 50.0).otherwise(0.1), 60, 2)
    assert heavy.where("id < 100").count() > 45


def test_schedule_every_hour_and_the_edges(spark):
    rows = [(f"2026-06-{1 + h // 24:02d} {h % 24:02d}:00:00",) for h in range(168)] + [("2026-06-03 12:59:00",), ("2026-06-03 20:30:00",), ("2026-06-03 20:31:00",), ("2026-09-01 14:00:00",)]
    d = spark.createDataFrame(rows, "l string").select("l", F.to_utc_timestamp(F.to_timestamp("l"), "Asia/Ho_Chi_Minh").alias("t"))
    got = {r["l"]: r["s"] for r in d.select("l", scheduling.schedule_state(F.col("t"), "Asia/Ho_Chi_Minh", (2, 3, 4, 5, 6), "13:00", "20:30", "2026-06-01", 90).alias("s")).collect()}
    assert sum(s == "open" for t, s in got.items() if t.endswith("00:00")) == 5 * 8  # 13 to 20 on the hour, Wednesday to Sunday
    assert got["2026-06-03 12:59:00"] == "closed" and got["2026-06-03 20:30:00"] == "open" and got["2026-06-03 20:31:00"] == "closed" and got["2026-09-01 14:00:00"] == "stale"


def test_layers(spark):
    d = spark.createDataFrame([(1, 100, None), (2, 90, None), (3, 80, 3), (4, 85, None)], "no int, kept int, dropped int")
    assert [r["lost"] for r in aggregating.layer_loss(d, "no", "kept", "dropped").orderBy("no").collect()] == [0, 10, 3, 0]


def test_cosine_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(80)]
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, [x + rng.gauss(0, 0.2) for x in v]) for i, v in enumerate(base)] + [(500, base[0]), (501, [0.0] * 64)]
    d = spark.createDataFrame(rows, "id int, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / max((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 1e-12)
    want = {(i, j) for i, a in rows for j, b in rows if i < j and cos(a, b) >= 0.92}
    got = {(r["a"], r["b"]) for r in deduplicating.cosine_pairs(d, "id", "v", 0.92).collect()}
    assert got == want and (0, 500) in got and (100, 500) in got and len(want) > 50
