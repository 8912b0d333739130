import json

import pytest
from pyspark.sql import functions as F

from quern.sources import readers, search, writers
from quern.streaming import operators as streams


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "b": "ă"}\n\n{"a": 2}\n')
    assert sorted(tuple(r) for r in readers.json_lines(spark, str(p), "a int, b string").collect()) == [(1, "ă"), (2, None)]
    p.write_text('{"a": 1}\nnonsense\n')
    with pytest.raises(Exception):  # noqa: B017, PT011
        readers.json_lines(spark, str(p), "a int").collect()
    t = readers.tolerant_json_lines(spark, str(p), "a int").cache()
    assert t.where("_corrupt_record is not null").count() == 1 and t.where("_corrupt_record is null").count() == 1
    assert readers.json_lines(spark, str(tmp_path / "none"), "a int", missing="empty").count() == 0
    with pytest.raises(Exception):  # noqa: B017, PT011
        readers.json_lines(spark, str(tmp_path / "none"), "a int").collect()


def test_documents_and_maps(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"x": "train", "y": "val"}))
    assert sorted(tuple(r) for r in readers.map_table(spark, str(tmp_path / "m.json"), "id", "split").collect()) == [("x", "train"), ("y", "val")]
    (tmp_path / "d.json").write_text(json.dumps({"cards": [{"n": 1}, {"n": 2}]}, indent=1))
    assert readers.json_document(spark, str(tmp_path / "d.json"), "cards array<struct<n:int>>").select(F.explode("cards")).count() == 2


def test_dirty_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Card 1, Card 2, Card 3, Reading\nA, B,,"two\nlines"\n,,C,x\n')
    got = readers.dirty_csv(spark, str(tmp_path / "c.csv"), "Card").collect()
    assert [(r["cards"], r["Reading"]) for r in got] == [(["A", "B"], "two\nlines"), (["C"], "x")]


def test_records_in_text(spark):
    d = spark.createDataFrame([("intro 1. Fool - a fresh start. 2. Magus - skill. 1. Fool - again.",)], "t string")
    over = spark.createDataFrame([("Magus", "will")], "name string, meaning string")
    got = readers.records_in_text(d, "t", r"\d\. ", {"name": r"\d\. (\w+)", "meaning": r"- (.*?)\."}, over, "name").collect()
    assert {(r["name"], r["meaning"]) for r in got} == {("Fool", "a fresh start"), ("Magus", "will")}


def test_files_and_cache(spark, tmp_path):
    (tmp_path / "f.txt").write_text("abc")
    r = readers.file_facts(spark, str(tmp_path / "f.txt")).first()
    assert (r["name"], r["bytes"], r["sha256"][:8]) == ("f.txt", 3, "ba7816bf")
    q = spark.createDataFrame([("a", 1), ("b", 2)], "m string, n int")
    _, miss = readers.read_through(q, spark.createDataFrame([], "key string, content string"), ["m", "n"])
    cache = miss.where("m = 'a'").select("key", F.lit("answer").alias("content"))
    hit, miss = readers.read_through(q, cache, ["n", "m"])
    assert [x["content"] for x in hit.collect()] == ["answer"] and miss.count() == 1


def test_writers_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(2, "b"), (1, None)], "n int, s string")
    writers.write_json_lines(d, str(tmp_path / "o"), [F.col("n")], one_file=True)
    (part,) = (tmp_path / "o").glob("part-*")
    assert part.read_text() == '{"n":1,"s":null}\n{"n":2,"s":"b"}\n'
    writers.append(d, str(tmp_path / "h"))
    writers.append(d, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4


def test_paged_search(spark, tmp_path):
    posts = [{"id": f"p{i}", "title": "moon" if i % 2 else "sun", "body": "", "created_utc": 1000 + i, "score": i} for i in range(25)]
    (tmp_path / "a.json").write_text(json.dumps(posts[:12]))
    (tmp_path / "b.json").write_text(json.dumps(posts[12:]))
    spark.dataSource.register(search.SearchSource)
    d = spark.read.format("paged_search").options(pages=str(tmp_path), terms="moon,sun", size="4").load()
    assert d.count() == 25 and {r["term"]: r["count"] for r in d.groupBy("term").count().collect()} == {"moon": 12, "sun": 13}


def batches(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    kind = spark.read.parquet(str(tmp_path / "in" / "b0")).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def test_stream_once_each(spark, tmp_path):
    s = batches(spark, tmp_path, [[("2024-01-01 00:00:00", "a"), ("2024-01-01 00:00:01", "a")], [("2024-01-01 00:00:05", "a"), ("2024-01-01 00:00:06", "b")]], "ts string, k string")
    got = streams.drain(streams.once_each(s, ["k"], "ts", "1 hour"), "once", "append", str(tmp_path / "c"))
    assert sorted(r["k"] for r in got.collect()) == ["a", "b"]


def test_stream_windows_and_sessions(spark, tmp_path):
    rows = [[("2024-01-01 00:01:00", "a"), ("2024-01-01 00:09:00", "a"), ("2024-01-01 00:12:00", "b")]]
    s = batches(spark, tmp_path, rows, "ts string, k string")
    got = streams.drain(streams.windowed(s, "ts", "1 minute", "10 minutes"), "win", "complete", str(tmp_path / "c1"))
    assert sorted(r["n"] for r in got.collect()) == [1, 2]
    got = streams.drain(streams.sessions(s, "ts", "1 minute", "5 minutes", ["k"]), "ses", "complete", str(tmp_path / "c2"))
    assert sorted((r["k"], r["n"]) for r in got.collect()) == [("a", 1), ("a", 1), ("b", 1)]


def test_ring_log(spark, tmp_path):
    rows = [[("2024-01-01 00:00:00", "r", f"line {i}") for i in range(7)], [("2024-01-01 00:00:01", "r", f"more {i}") for i in range(3)]]
    s = batches(spark, tmp_path, rows, "ts string, k string, line string")
    got = streams.drain(streams.ring_log(s, "k", "line", capacity=5, ttl_ms=None), "ring", "update", str(tmp_path / "c"))
    last = got.orderBy(F.desc("next_offset")).first()
    assert (last["first_offset"], last["next_offset"], last["truncated"], len(last["lines"])) == (5, 10, True, 5)


def test_near_duplicate_sink(spark, tmp_path):
    store = str(tmp_path / "store")

    def same_text(rows, old):
        a = rows.select(F.col("id").alias("a"), "t").join(old.select(F.col("id").alias("b"), "t"), "t").select("a", "b")
        b = rows.select(F.col("id").alias("a"), "t").join(rows.select(F.col("id").alias("b"), "t"), "t").where("b < a").select("a", "b")
        return a.union(b)

    sink = streams.near_duplicate_sink(store, same_text, "id")
    sink(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, t string"), 0)
    sink(spark.createDataFrame([(4, "y"), (5, "z")], "id int, t string"), 1)
    sink(spark.createDataFrame([(4, "y"), (5, "z")], "id int, t string"), 1)  # run again after a failure
    assert sorted(r["id"] for r in spark.read.parquet(store).collect()) == [1, 3, 5]
