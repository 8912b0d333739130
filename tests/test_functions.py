import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import canonical, stats, text


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


def test_tokens_fold_capitals_with_marks(spark):
    assert one(spark, text.tokens(F.col("t")), t="KHỎE, sẽ 2 lần!") == ["KHỎE", "sẽ", "2", "lần"]


def test_ngrams_guard_short_texts(spark):
    assert one(spark, text.ngrams(F.col("t"), 3), t=["a", "b"]) == []
    assert one(spark, text.ngrams(F.col("t"), 2), t=["a", "b", "c"]) == ["a b", "b c"]
    assert one(spark, text.char_ngrams(F.col("t"), 4), t="abc") == [] and one(spark, text.char_ngrams(F.col("t"), 2), t="abc") == ["ab", "bc"]


def test_jaccard_and_shares(spark):
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.col("b")), b=["y"]) == 0.0
    assert one(spark, text.diacritic_ratio(F.col("t")), t="một the hai of") == 0.25


def test_whole_words_only(spark):
    assert not one(spark, text.has_term(F.col("t"), "đạt được"), t="ađạt được")
    assert one(spark, text.has_term(F.col("t"), "đạt được"), t="(đạt được)")


def test_polarity(spark):
    r = one(spark, text.polarity(F.col("t")), t="Thành công và may mắn, dù khó khăn")
    assert (round(r["score"], 4), r["hits"], r["attribution"]) == (0.3333, 3, "vi_upright")
    assert one(spark, text.polarity(F.col("t")), t="không gì")["attribution"] == "vi_orientation_agnostic"


def test_text_repairs(spark):
    assert one(spark, text.truncate(F.col("t"), 10), t="abcdefgh ijkl") == "abcdefg..."
    assert one(spark, text.slug(F.col("t")), t=" The Moon's! ") == "the-moon-s"
    assert one(spark, text.distinct_ignoring_case(F.col("t"), 2), t=["A", " a ", "", "b", "c"]) == ["A", "b"]
    assert one(spark, text.from_html(F.col("t")), t="<p>a&amp;b</p><SCRIPT>x\n</SCRIPT> c") == "a&b c"
    assert one(spark, text.scrub(F.col("t"), ["pass", "password"]), t="sk-12345678 password") == "[REDACTED] [REDACTED]"
    assert one(spark, text.json_in(F.col("t")), t='ok {"a": {"b": 1}} end') == '{"a": {"b": 1}}'
    assert one(spark, text.strip_headers(F.col("t"), ["ý nghĩa:\\s*", "chung\\s*"]), t="Ý NGHĨA: chung abc") == "abc"
    assert one(spark, text.nfc(F.col("t")), t="ô") == "ô"
    assert one(spark, text.first_filled(F.col("a"), F.col("b")), a="  ", b=" x ") == "x"
    assert one(spark, text.first_match(F.col("t"), {"a": "^x", "b": "y"}, "none"), t="zy") == "b"


def test_gazetteer_takes_the_longest(spark):
    assert one(spark, text.gazetteer(F.col("t"), ["The Star", "The Star Gate", "Star"]), t="the star gate, THE STAR; Stars") == ["the star gate", "the star"]


def test_hashed_vector_is_unit(spark):
    v = one(spark, text.hashed_vector(F.col("t")), t="abcabcabc")
    grams = ["abcabcabc"[i : i + 4] for i in range(6)]
    counts = {}
    for g in grams:
        k = zlib.crc32(g.encode()) % 4096
        counts[k] = counts.get(k, 0) + 1
    norm = math.sqrt(sum(c * c for c in counts.values()))
    assert {k: pytest.approx(c / norm) for k, c in counts.items()} == v


def test_wilson_known_values(spark):
    r = one(spark, stats.wilson(F.lit(50), F.lit(100)))
    assert (round(r["low"], 3), round(r["high"], 3)) == (0.404, 0.596) or (round(r["low"], 3), round(r["high"], 3)) == (0.402, 0.598)
    assert tuple(one(spark, stats.wilson(F.col("n"), F.col("n")), n=0)) == (0.0, 0.0)


def test_cohens_d(spark):
    rng = np.random.RandomState(1)
    a, b = rng.randn(40) + 1, rng.randn(30)
    s = math.sqrt((39 * a.var(ddof=1) + 29 * b.var(ddof=1)) / 68)
    got = one(spark, stats.cohens_d(*(F.lit(float(x)) for x in (a.mean(), a.var(ddof=1), 40, b.mean(), b.var(ddof=1), 30))))
    assert got == pytest.approx((a.mean() - b.mean()) / s)


def test_bins_close_on_the_right(spark):
    for x, want in ((0.0, 0), (9.99, 9), (10.0, 9)):
        assert one(spark, stats.bin_of(F.col("x"), F.lit(0.0), F.lit(10.0), 10), x=x) == want
    assert one(spark, stats.bin_of(F.col("x"), F.lit(5.0), F.lit(5.0), 10), x=5.0) == 0


def test_cosine(spark):
    assert one(spark, stats.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(math.sqrt(0.5))
    assert one(spark, stats.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_canonical_json_keeps_nulls_and_sorts(spark):
    d = spark.createDataFrame([(1, None, ("z", ["ă"]), {"b": 1, "a": 2})], "b int, a string, s struct<y:string,x:array<string>>, m map<string,int>")
    assert d.select(canonical.canonical_json(d)).first()[0] == '{"a":null,"b":1,"m":{"a":2,"b":1},"s":{"x":["ă"],"y":"z"}}'


def test_tree_digest_ignores_order_and_sees_changes(spark):
    d = spark.range(1000).select(F.col("id").cast("string").alias("v"))
    line = F.col("v")
    a = canonical.tree_digest(d, line).first()
    assert a == canonical.tree_digest(d.orderBy(F.desc("v")).repartition(7), line).first()
    assert a["digest"] != canonical.tree_digest(d.where("v <> '7'"), line).first()["digest"] and a["rows"] == 1000
    assert canonical.tree_digest(d.limit(0), line).first()["rows"] == 0
