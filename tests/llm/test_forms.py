import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import lookalikes
from quern.llm.forms import LookalikeModel, consistent, reads_as, symbols

CASES = {
    "ấ": "ấ", "ậ": "ậ", "ｃủａ　ｔôi": "của tôi", "x​y­z﻿": "xyz", "a b c": "a b c", "đаng": "đang", "сó": "có",
    "Ταρώ Таро 塔羅": "Ταρώ Таро 塔羅", "❤️‍🔥 👩‍🚀": "❤️‍🔥 👩‍🚀", "1️⃣": "1️⃣", "a‍b": "ab", "x️": "x", "hòa  hoà\r\n": "hòa  hoà\r\n", "Tаро": "Таро", "": "", "o‍́": "ó", "Ðến ÐƯỜNG Ɖi": "Đến ĐƯỜNG Đi",
}


@pytest.mark.parametrize("text", CASES)
def test_consistent(text):
    assert consistent(text) == unicodedata.normalize("NFC", CASES[text])
    assert consistent(consistent(text)) == consistent(text)


def test_null():
    assert consistent(None) is None


def test_script_of_a_mixed_word():
    assert reads_as("оf") == "LATIN" and reads_as("Tаро") == "CYRILLIC" and reads_as("abc") is None


def test_model_agrees_with_the_definition():
    rng = random.Random(5)
    alphabet = "aáộ ơđĐÐOoeE.,\n" + "̣́̂" + "аеорсίαοΟ" + "​‍­️" + " 　" + "ａｏ！" + "🔥👩❤1"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    counts = Counter()
    for t in texts:
        counts.update(t)
        counts.update(s for s in symbols(t) if len(s) > 1)
    model = LookalikeModel(counts)
    differ = [t for t in texts if model.rewrite(t) != consistent(t)]
    assert len(differ) < 0.02 * len(texts)  # random heaps of marks; the operator then takes the definition's form


def test_model_decides_alone(spark):
    # a mixed word in a corpus without any other look-alike symbol; piles of more than three marks
    assert LookalikeModel({"T": 1, "а": 2, "р": 1, "о": 1}).rewrite("Tаро") == consistent("Tаро") != "Tаро"
    assert LookalikeModel(Counter("Ðến")).rewrite("Ðến") == "Đến"  # the class holds the letter of the language, seen or not
    model = LookalikeModel(Counter("Ðến đаng"))
    model.by_script, model.fixed = {}, {}
    model.auto.clear()
    assert model.rewrite("Ðến") == "Ðến"  # nothing but the classes rewrites a letter of one script
    rng = random.Random(6)
    marks = "\u0301\u0302\u0303\u0323\u0306\u031b"
    texts = ["".join(rng.choice("aeoư ДаеоσΟ\u200bｏ") + "".join(rng.choices(marks, k=rng.choice([0, 0, 1, 2, 4, 6]))) for _ in range(rng.randrange(1, 12))) for _ in range(1000)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    got = {r["id"]: r["text"] for r in lookalikes.unify(df, F.col("id"), F.col("text"), lookalikes.learn(df.select("text"))).collect()}
    assert got == {str(i): consistent(t) for i, t in enumerate(texts)}


def test_unify(spark):
    rows = [("a", "đаng"), ("b", "đang"), ("c", None), ("d", ""), ("e", "x​" * 20_000), ("a", "đаng")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("changed", F.lit(1))
    counts = lookalikes.learn(df.select("text"))
    got = lookalikes.unify(df, F.col("id"), F.col("text"), counts).collect()
    assert sorted((r["id"], r["changed"]) for r in got) == [("a", True), ("a", True), ("b", False), ("c", False), ("d", False), ("e", True)]
    assert {r["text"] for r in got if r["id"] == "a"} == {"đang"}
    empty = df.limit(0)
    assert lookalikes.unify(empty, F.col("id"), F.col("text"), lookalikes.learn(empty.select("text"))).count() == 0
