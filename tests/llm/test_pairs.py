import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import neardup, overlap, splitting
from quern.llm.components import hash_to_min
from quern.llm.words import words


def runs(text, k=3):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def like(a, b):
    a, b = runs(a), runs(b)
    return len(a & b) / max(len(a | b), 1)


def corpus(seed=1, families=40, singles=60):
    rng = random.Random(seed)
    vocab = [f"từ{i}" for i in range(400)]
    sentence = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randrange(6, 12))).capitalize() + "."
    texts = []
    for _ in range(families):
        base = [sentence() for _ in range(rng.randrange(4, 16))]
        for _ in range(rng.randrange(2, 5)):
            s = list(base)
            for _ in range(rng.randrange(0, 3)):
                kind = rng.randrange(4)
                i = rng.randrange(len(s))
                if kind == 0:
                    s[i] = sentence()
                elif kind == 1:
                    s.insert(i, sentence())
                elif kind == 2:
                    rng.shuffle(s) if len(s) < 4 else s.append(s.pop(i))
                else:
                    w = s[i].split()
                    w[rng.randrange(len(w))] = rng.choice(vocab)
                    s[i] = " ".join(w)
            texts.append(" ".join(s))
    texts += [" ".join(sentence() for _ in range(rng.randrange(4, 16))) for _ in range(singles)]
    return [(f"r{i:04d}", t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    r = corpus()
    return [*r, ("x0", None), ("x1", ""), ("x2", "ngắn quá"), ("x3", r[0][1]), r[5], ("x4", "dài " * 30_000), (None, r[0][1])]


def brute(rows):
    big = sorted({(i, t) for i, t in rows if i is not None and len(words(t)) >= 30})
    return {(a, b) for k, (a, s) in enumerate(big) for b, t in big[k + 1 :] if a != b and like(s, t) >= 0.6}


def frame(spark, rows):
    # names that the operators use inside
    return spark.createDataFrame([(i, t, 1, "n", "k") for i, t in rows], "rid string, body string, id int, node string, text string")


def test_near_links_against_brute_force(spark, rows):
    members, links = neardup.near_links(frame(spark, rows), F.col("rid"), F.col("body"))
    by = {}
    for r in members.collect():
        by.setdefault(r["node"], set()).add(r["id"])
    got = {tuple(sorted((x, y))) for s in by.values() for x in s for y in s if x < y}
    got |= {tuple(sorted((x, y))) for r in links.collect() for x in by[r["a"]] for y in by[r["b"]]}
    assert got == brute(rows) and len(got) > 50


def evenly_edited(step):
    """Two long texts of which every ``step``-th word differs."""
    a = [f"chữ{i}" for i in range(420)]
    return [("a", " ".join(a)), ("b", " ".join(f"khác{i}" if i % step == step - 1 else w for i, w in enumerate(a)))]


@pytest.mark.parametrize("step", [13, 14, 18, 24])
def test_links_without_a_long_common_run(spark, step):
    pair = evenly_edited(step)
    assert like(pair[0][1], pair[1][1]) >= 0.6
    assert neardup.near_links(frame(spark, pair), F.col("rid"), F.col("body"))[1].count() == 1


@pytest.mark.parametrize("step", [12, 18, 23])
def test_overlap_without_a_long_common_run(spark, step):
    pair = evenly_edited(step)
    label = spark.createDataFrame([("a", "train"), ("b", "test")], "id string, split string")
    got = overlap.cross_split_pairs(frame(spark, pair), F.col("rid"), F.col("body"), label).collect()
    assert [(r["train_id"], r["eval_id"]) for r in got] == [("a", "b")]


@pytest.mark.parametrize("step", [10, 12, 15])
def test_evenly_inserted_words(spark, step):
    a = [f"chữ{i}" for i in range(300)]
    b = [w for i, x in enumerate(a) for w in ([x, f"thêm{i}"] if i % step == step - 1 else [x])]
    pair = [("a", " ".join(a)), ("b", " ".join(b))]
    assert 0.6 <= like(pair[0][1], pair[1][1]) < 0.76
    assert neardup.near_links(frame(spark, pair), F.col("rid"), F.col("body"))[1].count() == 1
    label = spark.createDataFrame([("a", "val"), ("b", "train")], "id string, split string")
    assert [r["train_id"] for r in overlap.cross_split_pairs(frame(spark, pair), F.col("rid"), F.col("body"), label).collect()] == ["b"]


def test_classes_never_change_the_links(spark, rows, monkeypatch):
    a = neardup.near_links(frame(spark, rows), F.col("rid"), F.col("body"))[1].select("a", "b").collect()
    monkeypatch.setattr(neardup, "COUNTED", 1)
    monkeypatch.setattr(neardup, "FOLLOWS", 0.0)  # long chains
    assert sorted(a) == sorted(neardup.near_links(frame(spark, rows), F.col("rid"), F.col("body"))[1].select("a", "b").collect())


def test_tiles_in_blocks_find_the_same(spark, rows):
    a = neardup.near_links(frame(spark, rows), F.col("rid"), F.col("body"))[1].select("a", "b").collect()
    b = neardup.near_links(frame(spark, rows), F.col("rid"), F.col("body"), block=2)[1].select("a", "b").collect()
    assert sorted(a) == sorted(b)


def test_groups_in_turns_find_the_same(spark, rows, monkeypatch):
    a = neardup.near_links(frame(spark, rows), F.col("rid"), F.col("body"))[1].select("a", "b").collect()
    monkeypatch.setattr(neardup, "ROUND", 1000)
    b = neardup.near_links(frame(spark, rows), F.col("rid"), F.col("body"))[1].select("a", "b").collect()
    assert sorted(a) == sorted(b)


def test_long_texts_with_one_class_in_common_are_told_apart():
    """All bits of a short signature are about as different for all long texts."""
    rng = np.random.RandomState(1)
    h = rng.randint(0, 2**63, (40, 470)).astype(np.uint64)
    h[1, 60:] = h[0, 60:]
    h[:, 0] = 7
    h.sort(axis=1)
    doc, size = np.repeat(np.arange(40), 470), np.full(40, 470)
    one = pa.array([[5]] * 40, pa.list_(pa.int32()))
    t = {"bi": [0] * 40, "bj": [0] * 40, "block": [0] * 40, "node": pa.array(range(40), pa.int64()), "n": pa.array(size, pa.int32()), "side": pa.array([3] * 40, pa.int32())}
    t |= {s: pa.array(x) for s, x in zip(neardup.SIG, neardup.signatures(doc, h.ravel(), 40), strict=True)} | {"keys": one, "at": pa.array([[0]] * 40, pa.list_(pa.int32()))}
    assert neardup.bounded_pairs(pa.table(t), 0.6).num_rows > 100
    got = neardup.bounded_pairs(pa.table(t | {"more": neardup.further(doc, h.ravel(), size)}), 0.6)
    assert (got.column("a").to_pylist(), got.column("b").to_pylist()) == ([0], [1])


def test_a_group_of_classes_fits_a_block():
    """Where it doesn't, its nodes are sent once for each block."""
    assert "block" in neardup.candidates.__code__.co_varnames and 1.3 * neardup.GROUP < neardup.near_links.__kwdefaults__["block"] == overlap.cross_split_pairs.__kwdefaults__["block"]


def test_all_rows_are_counted(spark):
    """Each shingle occurs in one text only; the classes of every text are learnt."""
    rows = [(f"r{i}", " ".join(f"w{i}x{j}" for j in range(12))) for i in range(40)]
    src = frame(spark, rows * 2).select(F.col("rid").alias("id"), F.lit(None).cast("string").alias("lead"), F.col("body").alias("text"))
    table = neardup.classes(src, 3).value
    for _, t in rows:
        _, h = neardup.Batch([t.split()]).shingles(3)
        of = table[(h & np.uint64(len(table) - 1)).astype(np.int64)]
        assert len(set(of.tolist())) < 5


def test_groups(spark, rows):
    up = {i: i for i, t in rows if i}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in brute(rows):
        a, b = sorted((find(a), find(b)))
        up[b] = a
    groups = {}
    for i in up:
        groups.setdefault(find(i), set()).add(i)
    want = {(i, min(g)) for g in groups.values() if len(g) > 1 for i in g}
    got = neardup.near_groups(frame(spark, rows), F.col("rid"), F.col("body")).collect()
    assert {(r["id"], r["group_id"]) for r in got} == want and len(got) == len(want)


def test_empty(spark, rows):
    e = frame(spark, rows).limit(0)
    assert neardup.near_groups(e, F.col("rid"), F.col("body")).count() == 0
    s = spark.createDataFrame([], "id string, split string")
    assert overlap.cross_split_pairs(e, F.col("rid"), F.col("body"), s).count() == 0


def test_cross_split_against_brute_force(spark, rows):
    rng = random.Random(3)
    label = {i: rng.choice(["train", "train", "val", "test"]) for i, _ in rows if i}
    given = [(i, f" {s.upper()} " if rng.random() < 0.2 else s) for i, s in label.items()] + [("gone", "train"), (None, "val"), ("x0", None), ("r0001", label["r0001"])]
    splits = overlap.split_labels(spark.createDataFrame(given, "example_id string, split string"))
    got = overlap.cross_split_pairs(frame(spark, rows), F.col("rid"), F.col("body"), splits).collect()
    want = {(a, b) for p in brute(rows) for a, b in (p, p[::-1]) if label[a] == "train" and label[b] != "train"}
    assert {(r["train_id"], r["eval_id"]) for r in got} == want and len(got) == len(want) > 10
    text = dict(t for t in rows if t[0])
    for r in got:
        assert abs(r["likeness"] - like(text[r["train_id"]], text[r["eval_id"]])) < 1e-9


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_banded_distance():
    rng = np.random.RandomState(0)
    a, b = [], []
    for _ in range(60):
        x = rng.randint(0, 6, rng.randint(0, 30)).astype(np.uint64)
        y = np.delete(x, rng.randint(0, max(len(x), 1), 2)) if len(x) > 4 and rng.rand() < 0.6 else rng.randint(0, 6, rng.randint(0, 30)).astype(np.uint64)
        a.append(x), b.append(y)
    got = overlap.banded_distance(a, b, 5)
    for x, y, g in zip(a, b, got, strict=True):
        d = distance(list(x), list(y))
        assert g == (d if d <= 5 else -1)


def test_report(spark):
    pairs = spark.createDataFrame([("t1", "e1", "val", 0.7, 0), ("t2", "e1", "val", 0.8, 2)], "train_id string, eval_id string, split string, likeness double, edit_distance int")
    rows = spark.createDataFrame([("e1", ["web", "x"]), ("e1", ["web", "x"])], "rid string, provenance array<string>")
    got = overlap.report(pairs, rows, F.col("rid"), F.col("provenance")[0]).collect()
    assert [tuple(r) for r in got] == [("val", "web", 1, 2, 2, 1, 1)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(200)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("z", "z"), (None, "z"), ("z", None)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = {r["node"]: r["component"] for r in hash_to_min(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in up}
    assert hash_to_min(spark.createDataFrame([], "a string, b string")).count() == 0


def draws(spark):
    s = "example_id string, spread_id string, card_ids array<int>, cards_used array<struct<card_id:int,orientation:string>>, safety_category string, matched_pair_id string, task_type string"
    return [("a", "s1", [1, 2], None, None, None, "x"), ("b", "s1", [2, 1, 1], None, "c", "p1", "x"), ("c", "s2", None, [(5, "u")], "c", "p1", "y"), ("d", "s2", [5], None, None, None, "y"), ("e", None, [5], None, None, None, "y"), ("f", "s3", [], [(5, "u")], None, None, None), ("g", "s3", None, None, "d", "p1", "x"), ("a", "s1", [1, 2], None, None, None, "x"), (None, "s1", [1, 2], None, None, None, "x")], s


def test_related_and_assigned(spark):
    data, schema = draws(spark)
    rows = spark.createDataFrame(data, schema).withColumn("group_id", F.lit(0)).withColumn("id", F.lit(0))
    keys = {"draw": splitting.draw_key(), "pair": splitting.pair_key()}
    got = {r["id"]: r["group_id"] for r in splitting.related_groups(rows, F.col("example_id"), keys).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f", "g": "g"}
    out = splitting.assign_splits(rows, F.col("example_id"), keys, F.col("task_type"), {"train": 0.8, "test": 0.2}).collect()
    assert len(out) == 7 and len({r["split"] for r in out if r["group_id"] == "a"}) == 1
    assert splitting.related_groups(rows.limit(0), F.col("example_id"), keys).count() == 0
    assert splitting.assign_splits(rows.limit(0), F.col("example_id"), keys, F.col("task_type"), {"train": 0.8, "test": 0.2}).count() == 0


def test_shares(spark):
    rows = spark.createDataFrame([(f"r{i}", f"s{i % 700}", [i % 700], None, None, None, "xy"[i % 2]) for i in range(4000)], draws(spark)[1])
    out = splitting.assign_splits(rows, F.col("example_id"), {"draw": splitting.draw_key()}, F.col("task_type"), {"train": 0.85, "val": 0.08, "test": 0.07})
    share = {r["split"]: r["count"] / 4000 for r in out.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.85) < 0.02 and abs(share["val"] - 0.08) < 0.02 and abs(share["test"] - 0.07) < 0.02


def test_a_third_of_the_rows_are_copies(spark, rows):
    hot = next(t for i, t in rows if i == "r0000")
    many = [*rows, *((f"c{i:04d}", hot) for i in range(400))]
    groups = {r["id"]: r["group_id"] for r in neardup.near_groups(frame(spark, many), F.col("rid"), F.col("body")).collect()}
    assert all(groups[f"c{i:04d}"] == groups["r0000"] == "c0000" for i in range(400))
    plain = {r["id"]: r["group_id"] for r in neardup.near_groups(frame(spark, rows), F.col("rid"), F.col("body")).collect()}
    family = {i for i, g in plain.items() if g == plain["r0000"]}
    assert {i for i, g in groups.items() if g == "c0000"} == family | {f"c{i:04d}" for i in range(400)}
    label = spark.createDataFrame([(f"c{i:04d}", "train" if i else "test") for i in range(400)], "id string, split string")
    assert overlap.cross_split_pairs(frame(spark, many), F.col("rid"), F.col("body"), label).count() == 399


def test_a_sentence_that_all_texts_share(spark):
    r = corpus(seed=8, families=15, singles=80)
    shared = "Lời nhắn chung này đứng ở cuối mỗi bài để nhắc bạn rằng lá bài chỉ soi đường còn bước đi là của bạn và chỉ của bạn mà thôi."
    all_ = [(i, f"{t} {shared}") for i, t in r]
    links = neardup.near_links(frame(spark, all_), F.col("rid"), F.col("body"), block=16)
    by = {x["node"]: x["id"] for x in links[0].orderBy("id").collect()}
    got = {tuple(sorted((by[x["a"]], by[x["b"]]))) for x in links[1].collect()}
    text = dict(all_)
    want = {p for p in brute(all_) if words(text[p[0]]) != words(text[p[1]])}
    members = {}
    for x in links[0].collect():
        members.setdefault(x["node"], []).append(x["id"])
    full = {tuple(sorted((a, b))) for x in links[1].collect() for a in members[x["a"]] for b in members[x["b"]]}
    assert full == want and got
