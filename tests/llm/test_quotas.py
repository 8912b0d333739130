import itertools
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, sampling

SCHEMA = "dimension string, category string, target_share double, min_rows bigint, sample_size bigint"


def records(n=3000, seed=1):
    rng = random.Random(seed)
    kinds, bands = ["Reading", "reading ", "safety", None], ["ngắn", "ngắn", "dài"]
    return [(f"r{i:05d}", rng.choices(kinds, [5, 3, 2, 1])[0], rng.choice(bands), "x") for i in range(n)]


TARGETS = [("kind", "reading", 0.4, 5, 1000), ("kind", "safety", 0.55, 5, 1000), ("kind", "none", 0.05, 3, 1000), ("band", "ngắn", 0.3, 1, 1000), ("band", "dài", 0.7, 1, 1000)]


def made(spark, rows, targets=TARGETS):
    r = spark.createDataFrame(rows, "rid string, kind string, band string, cell string")
    return sampling.plan(r, F.col("rid"), spark.createDataFrame(targets, SCHEMA))


def test_shortfalls_and_spellings(spark):
    rows = records()
    p = made(spark, [*rows, rows[0], (None, "safety", "dài", "x")])
    safe = sum(k == "safety" for _, k, _, _ in rows)
    assert p.have["kind", "safety"] == safe and p.have["band", "ngắn"] == sum(b != "dài" for _, _, b, _ in rows)
    assert sampling.shortfalls(p.counts, p.dims, p.targets, p.size) == {("kind", "none"): 50} | ({("kind", "safety"): 550 - safe} if safe < 550 else {})


def test_needed_rounds_up_once():
    assert sampling.needed(sampling.Target("d", "c", 0.07, 0), 10_000) == 700
    assert sampling.needed(sampling.Target("d", "c", 0.07, 0), 10) == 1
    assert sampling.needed(sampling.Target("d", "c", 0.0, 4), 10) == 4


def test_sample_has_the_shares(spark):
    p = made(spark, records(8000))
    q = sampling.quotas(p.counts, p.dims, p.targets, p.size)
    assert sum(q.values()) == 1000 and all(q[k] <= p.counts[k] for k in q)
    band = {c: sum(n for k, n in q.items() if k[p.dims.index("band")] == sampling.form(c)) for c in ("ngắn", "dài")}
    assert abs(band["ngắn"] - 300) <= 2 and abs(band["dài"] - 700) <= 2
    kind = sum(n for k, n in q.items() if k[p.dims.index("kind")] == "safety")
    assert abs(kind - min(550, p.have["kind", "safety"])) <= 2


def test_draw_takes_exactly_the_quota(spark):
    d = spark.createDataFrame([(f"i{i}", "ab"[i % 3 == 0]) for i in range(5000)], "id string, cell string")
    got = sampling.draw(d, {"a": 700, "b": 1666, "c": 5}, buckets=16)
    assert {r["cell"]: r["count"] for r in got.groupBy("cell").count().collect()} == {"a": 700, "b": 1666}
    assert got.select("id").distinct().count() == 2366


def test_empty_sample(spark):
    p = made(spark, [])
    assert sampling.quotas(p.counts, p.dims, p.targets, p.size) == {}
    assert set(sampling.shortfalls(p.counts, p.dims, p.targets, p.size)) == {(t[0], t[1]) for t in TARGETS}
    assert sampling.draw(p.labelled, {}).count() == 0


def test_min_cost_flow_against_all_flows():
    rng = random.Random(4)
    for _ in range(30):
        arcs = [(a, b, rng.randrange(3), float(rng.randrange(4))) for a, b in [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]]
        flow = sampling.min_cost_flow(4, arcs, 0, 3, 3)
        best = None
        for f in itertools.product(*(range(c + 1) for _, _, c, _ in arcs)):
            if f[0] == f[2] + f[3] and f[1] + f[2] == f[4] and f[0] + f[1] <= 3:
                key = (-(f[0] + f[1]), sum(x * w for x, (_, _, _, w) in zip(f, arcs, strict=True)))
                best = min(best or key, key)
        assert (-(flow[0] + flow[1]), sum(x * w for x, (_, _, _, w) in zip(flow, arcs, strict=True))) == best


def brute_mix(docs, targets, budget):
    """The queue itself: copies sorted by finish time, taken while they fit."""
    copies = []
    for t in targets:
        own = [d for d in docs if d[1] == t.source and d[2] > 0]
        total, sent = sum(d[2] for d in own), 0
        for c in range(1, t.max_repeats + 1):
            for d in own:
                sent += d[2]
                copies.append((sent / t.weight, t.source, d[0], c, d[2]))
        assert sent == total * t.max_repeats
    used, out = 0, []
    for f, s, i, c, n in sorted(copies):
        if used + n > budget:
            break
        used += n
        out.append((i, c, s))
    return out, used


def test_mix_shares_and_repeats(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", "other"]), rng.randrange(0, 200)) for i in range(3000)] + [(9999, None, 10)]
    targets = [mixing.Target("a", 0.5, 1), mixing.Target("b", 0.3, 2), mixing.Target("c", 0.2, 3)]
    d = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    budget = 120_000
    got = mixing.mix(d, targets, budget, buckets=8).collect()
    used = sum(r["tokens"] for r in got)
    assert budget - 200 * 3 <= used <= budget
    size = {t.source: sum(r["tokens"] for r in got if r["source"] == t.source) for t in targets}
    for t in targets:
        assert abs(size[t.source] / used - t.weight) < 0.01
        assert max(r["copy"] for r in got if r["source"] == t.source) <= t.max_repeats
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
    # the same as the queue in the hash order that the operator used
    order = {r["doc_id"]: r["finish"] for r in mixing.queue(d, targets, buckets=8).where("copy = 1").collect()}
    ranked = sorted(docs, key=lambda x: order.get(x[0], 1e18))
    taken, brute = brute_mix(ranked, targets, budget)
    assert brute == used and {(i, c) for i, c, _ in taken} == {(r["doc_id"], r["copy"]) for r in got}


def test_short_sources(spark):
    targets = [mixing.Target("a", 0.5, 2), mixing.Target("b", 0.5, 3), mixing.Target("none", 0.1, 3)]
    d = spark.createDataFrame([(1, "a", 100), (2, "b", 20), (3, "b", 0)], "doc_id long, source string, tokens long")
    sizes = mixing.source_sizes(d, targets)
    short = mixing.short_sources(mixing.queue(d, targets), targets, 300)
    assert short == ["b", "none"]
    got = mixing.mix(d, targets, 10_000)
    assert got.count() == 2 + 3  # all that there is
    assert mixing.mix(d.limit(0), targets, 100).count() == 0 and mixing.mix(d, [], 100).count() == 0
    rep = {r["source"]: r for r in mixing.report(got, targets, sizes, short).collect()}
    assert rep["none"]["tokens"] == 0 and rep["none"]["short"] and rep["a"]["most_repeats"] == 2


def test_cut_time():
    t = [mixing.Target("a", 1.0, 1), mixing.Target("b", 1.0, 1)]
    assert mixing.cut_time({"a": (10, 1), "b": (100, 1)}, t, 50) == pytest.approx(40)
