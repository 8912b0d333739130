from pyspark.sql import functions as F

from quern.operators import scoring



def test_models_score_what_is_missing(spark):
    def load():
        return lambda b: [float(len(t)) for t in b["t"]]

    d = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc")], "id int, t string")
    known = spark.createDataFrame([(2, 9.0), (8, 1.0)], "id int, score double")
    got = {r["id"]: r["score"] for r in scoring.score_missing(d, known, "id", ["t"], load).collect()}
    assert got == {1: 1.0, 2: 9.0, 3: 3.0}


def test_first_passing(spark):
    v = spark.createDataFrame([("x", 1, 1, False), ("x", 1, 2, True), ("x", 2, 1, True), ("y", 1, 1, False)], "k string, attempt int, variant int, ok boolean")
    assert [(r["k"], r["attempt"], r["variant"]) for r in scoring.first_passing(v, ["k"], ["attempt", "variant"], F.col("ok")).collect()] == [("x", 1, 2)]


def test_padding(spark):
    d = spark.createDataFrame([(["a", "b"],), (["a", "b", "c", "d"],), ([],)], "t array<string>")
    assert [r[0] for r in d.select(scoring.pad_to(F.col("t"), 3)).collect()] == [["a", "b", "b"], ["a", "b", "c"], []]


def test_corruption(spark):
    d = spark.createDataFrame([(i, "Bạn sẽ đi. Rồi về.") for i in range(20)], "id int, t string")
    got = scoring.corrupted(d, "id", "t", {"swap": scoring.swap_clauses(F.col("t")), "negate": scoring.negate(F.col("t"), "đi")}).collect()
    assert {(r["way"], r["corrupted"]) for r in got} == {("swap", "Rồi về. Bạn sẽ đi."), ("negate", "Bạn sẽ không đi. Rồi về.")}


def test_rates_and_durations(spark):
    r = spark.createDataFrame([("tone", True, True), ("tone", True, False), ("tone", False, True)], "axis string, d boolean, f boolean")
    assert [tuple(x) for x in scoring.detection_rates(r, ["axis"], "d", "f").collect()] == [("tone", 2, 1)]
    t = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 00:01:30.5")], "a string, b string")
    x = scoring.durations(t, "a", "b").first()
    assert x["duration_s"] == 90.5 and x["started_iso"] == "2024-01-01T00:00:00"
