import os
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, defects, langid

needs_tokenizer = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no public tokenizer here")
TEXTS = [None, "", " ", "aaaa aaaaaaa", "I'm don't it's ’s", "a\n\n  b\t c  ", "đường về nhà, 2024!", "<|endoftext|> x", "👩‍🚀❤️", "x" * 5000, "từ " * 20_000, "\x00퟿"]


@needs_tokenizer
def test_ids_against_a_public_library():
    import tiktoken

    e = bpe.PairIndexEncoder()
    rng = random.Random(1)
    alphabet = "abcdeđếộ 's.,\n\t129🔥"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(500)]
    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    got = e.encode(texts).to_pylist()
    assert got == [ref.encode_ordinary(t) if t else [] for t in texts]
    assert [e.decode(g) for g in got] == [t or "" for t in texts]
    assert e.lengths(texts).tolist() == [len(g) for g in got]
    small = bpe.PairIndexEncoder(most=50)  # forgets and learns again
    assert small.encode(texts[:200]).to_pylist() == got[:200]


@needs_tokenizer
def test_encode_rows(spark):
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS[:-1])] + [(3, TEXTS[3], 1)], "doc_id long, text string, id int")
    got = bpe.encode(d, F.col("doc_id"), F.col("text")).collect()
    assert len(got) == len(TEXTS) and {r["id"]: r["ids"] for r in got}[0] == []
    n = bpe.token_counts(d, {"doc_id": F.col("doc_id")}, F.col("text")).collect()
    assert {r["doc_id"]: r["tokens"] for r in n} == {r["id"]: len(r["ids"]) for r in got}
    assert bpe.encode(d.limit(0), F.col("doc_id"), F.col("text")).count() == 0


GOOD = "Lá The Moon ngược nhắc bạn rằng điều còn mờ sẽ tự sáng. Hãy đi chậm, lắng nghe trực giác và giữ lời với chính mình. " * 4
Q = "Tôi cần làm gì với công việc đang làm trong quý này?"
LABELLED = [
    (None, "empty"), ("", "empty"), ("  \n", "empty"), ("N/A", "empty"), ("(trống)", "empty"), ("...", "empty"), ("chưa có nội dung", "empty"),
    (Q, "copy"), (Q.upper(), "copy"), ("Câu hỏi: " + Q, "copy"), ("“" + Q[:-1] + "”", "copy"), (Q.replace("đang ", ""), "copy"),
    ("Xin lỗi, mình không thể trả lời câu hỏi này.", "refusal"), ("Rất tiếc, yêu cầu này nằm ngoài phạm vi hỗ trợ. Hãy hỏi chủ đề khác.", "refusal"), ("Với vai trò trợ lý, tôi xin từ chối luận bài lần này.", "refusal"),
    ("The open hand unsettles a harvest still far away before the moon is full and that is enough for you. " * 5, "language"), ("Cảm ơn bạn đã hỏi. " + "La semilla sembrada acompaña una respiración más firme, así que ve paso a paso con el corazón. " * 5, "language"),
    ("Der gesäte Keim spiegelt ein locker gewordenes Band und nichts drängt dich in dieser Legung. " * 5, "language"), ("La lampe près de la porte protège le désir d'être vu, et cela suffit pour vous dans cette lame. " * 5, "language"),
    (GOOD + "Bên dưới lớp lo âu, cái tôi bướng bỉnh", "truncated"), (GOOD + "Dòng suy nghĩ xoay quanh (nhất là", "truncated"),
    (GOOD + "Vì lá Page...", "truncated"), (GOOD + "Xét về những…", "truncated"), (GOOD + "Vì lá Page . . .", "truncated"),
    (GOOD, None), ("Mình không thể đoán chắc tương lai, nhưng lá bài gợi mở như sau. " + GOOD, None), (Q + " " + GOOD, None), (GOOD + "Cứ thong thả thôi nha ✨", None), (GOOD + "Bạn nhớ câu “carpe diem” nhé.", None),
    ("La Five of Wands xuoi do lay nhip buoc cua ban. Anh sang nho kia goi y rang long can dam vua du de khoi lap lai chuyen cu. Nguoi trong ban bao ve long can dam vua du nen hay de tam tung buoc. " * 2, None),
]


def test_defects_on_labelled_pairs(spark):
    rows = [(f"r{i:03d}", Q, a, "reading") for i, (a, _) in enumerate(LABELLED)] + [(f"g{i:04d}", Q, f"{GOOD} Lần {i}.", "reading") for i in range(400)] + [("r000", Q, None, "reading"), (None, Q, "", None), ("n1", None, GOOD, None), ("n2", None, None, None), ("long", Q, GOOD * 500, "x")]
    d = spark.createDataFrame(rows, "rid string, q string, a string, task string").withColumn("votes", F.lit(1)).withColumn("id", F.lit(2))
    got = {r["id"]: r["defect"] for r in defects.label_pairs(d, F.col("rid"), F.col("q"), F.col("a"), F.col("task")).collect()}
    assert got == {f"r{i:03d}": w for i, (_, w) in enumerate(LABELLED) if w} | {"n2": "empty"}
    assert defects.label_pairs(d.limit(0), F.col("rid"), F.col("q"), F.col("a"), F.col("task")).count() == 0


LONG_Q = " ".join(f"{w} {i}" for i, w in enumerate("tôi muốn hỏi về công việc gia đình tình cảm sức khỏe tiền bạc và đường đi sắp tới của mình trong năm nay khi mọi thứ cứ đổi thay".split())) + "?"
LONG = [
    (LONG_Q, LONG_Q, "copy"),
    (Q, "Rất tiếc, mình không thể trả lời câu hỏi này của bạn hôm nay. Yêu cầu này nằm ngoài phạm vi hỗ trợ mà mình đang có. Mình xin từ chối luận bài lần này và mong bạn thông cảm. Với vai trò trợ lý, mình không được phép đưa ra lời khuyên như vậy.", "refusal"),
    (Q, "Mình không thể đoán chắc tương lai. " + GOOD, None),
]


def labelled(cutoffs):
    pairs = [(Q, a, w) for a, w in LABELLED] + LONG + [(Q, f"{GOOD} Lần {i}.", None) for i in range(400)]
    v = [defects.votes(q, a, None) for q, a, _ in pairs]
    post = defects.fit(dict(langid.Counter(v)))
    return sum(next((d for d in defects.DEFECTS if post[d][p] >= cutoffs[d]), None) == w for p, (_, _, w) in zip(v, pairs, strict=True)), len(pairs)


def test_long_copies_and_refusals_and_cutoffs():
    assert all(len(a.split()) >= defects.SHORT for _, a, _ in LONG)
    right, n = labelled(defects.CUTOFFS)
    assert right == n
    assert all(labelled({**defects.CUTOFFS, d: c / 10})[0] <= right for d in defects.DEFECTS for c in range(1, 10))


def test_em_posteriors_are_probabilities():
    v = {defects.votes(Q, a, None): 5 for a, _ in LABELLED}
    post = defects.fit(v)
    assert all(0 <= p <= 1 for d in post.values() for p in d.values())


def test_automaton():
    s = "banana bandana"
    a = langid.SuffixAutomaton(s)
    subs = {s[i:j] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for q in ["band", "nanab", "xbanx", "", "ana ban", s]:
        for i in range(len(q)):
            assert a.longest(q, i) == max([k for k in range(len(q) - i + 1) if k == 0 or q[i : i + k] in subs])
    assert a.phrases("nanab") == 2 and a.phrases("xx") == 2 and a.phrases("") == 0


SENTENCES = {
    "vi": ["Khi mọi thứ lặng lại, bước chân chậm dẫn lối tới bạn.", "Chiếc cầu gỗ xác nhận nền móng cần thêm thời gian.", "Ngọn đèn trước hiên bồi đắp mùa gặt còn xa của bạn."],
    "en": ["Late at night, the changing wind mirrors a blind spot in the sums.", "The lamp by the door stands guard over a role that has grown tight.", "With a little patience, an old worry asks for courage."],
    "fr": ["Au premier regard, la lampe près de la porte protège le désir.", "Une vieille inquiétude dévoile doucement la valeur des mots.", "Avec un peu de patience, votre intuition éclaire la raison du départ."],
    "es": ["En esta tirada, la semilla sembrada acompaña una respiración firme.", "Después de una larga espera, una promesa refleja el deseo.", "La barca pequeña cuestiona el valor de las palabras sencillas."],
    "de": ["Der gesäte Keim spiegelt ein locker gewordenes Band mit dir.", "Unter der Oberfläche bleibt es, die hölzerne Brücke befragt eine Furcht.", "In dieser Legung wird klar, die Lampe an der Tür sammelt den Wert."],
}


def documents(seed=3, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = rng.choice(langid.LANGUAGES)
        out.append((i, " ".join(rng.choices(SENTENCES[g], k=4)), rng.choice([g, g, g, g.upper(), f"{g}-XX"]) if rng.random() < 0.9 else rng.choice(langid.LANGUAGES), g))
    return out


def test_held_out_languages(spark):
    rows = documents()
    d = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    model = langid.train(d, F.col("text"), F.col("lang"))
    special = [(1000, None, "vi"), (1001, "", None), (1002, "12 / 7 🌙", "vi"), (1003, "Ngon den truoc hien boi dap mua gat con xa cua ban.", "vi"), (1004, SENTENCES["vi"][0] + "\n\n" + SENTENCES["de"][1], "mul"), (1005, SENTENCES["en"][0] + " “" + SENTENCES["fr"][0] + "” " + SENTENCES["en"][1], "English"), (1006, "The Moon: The Moon\n" + SENTENCES["vi"][1], "vi_VN"), (1007, (SENTENCES["es"][1] + " ") * 3000, "spa")]
    both = d.union(spark.createDataFrame(special, d.schema)).withColumn("id", F.lit(0)).withColumn("label", F.lit(0))
    found = langid.languages(both, F.col("doc_id"), F.col("text"), F.col("lang"), model, ["The Moon"]).cache()
    got = {r["id"]: [p["lang"] for p in r["passages"]] for r in found.collect()}
    assert sum(got[i] == [g] for i, _, _, g in rows) >= 0.99 * len(rows)
    assert not {1000, 1001, 1002} & set(got)
    assert got[1003] == ["vi"] and got[1004] == ["vi", "de"] and got[1005] == ["en"] and got[1006] == ["vi"] and got[1007] == ["es"]
    wrong = {(r["id"], r["lang"]) for r in langid.mislabelled(found).collect()}
    want = {(i, g) for i, _, label, g in rows if langid.label_language(label) != g} | {(1004, "vi"), (1004, "de")}
    assert wrong == want
    assert langid.languages(both.limit(0), F.col("doc_id"), F.col("text"), F.col("lang"), model).count() == 0
    assert langid.train(both.limit(0), F.col("text"), F.col("lang")) == {}


def test_copies_of_a_document_count_once(spark):
    texts = [f"{SENTENCES['vi'][i % 3]} từ{chr(97 + i)} khác nhau trong mỗi văn bản" for i in range(26)]
    d = spark.createDataFrame([(t, "vi") for t in texts], "text string, lang string")
    first = d.orderBy(F.xxhash64("text")).first()["text"]
    hot = d.union(spark.createDataFrame([(first, "vi")] * 50, d.schema))
    assert langid.train(hot, F.col("text"), F.col("lang"), per_language=20) == langid.train(d, F.col("text"), F.col("lang"), per_language=20)


@pytest.mark.parametrize(("label", "want"), [("VI", "vi"), ("vi_VN", "vi"), ("Vietnamese", "vi"), ("deu", "de"), ("es-MX", "es"), ("French", "fr"), ("und", None), ("mul", None), ("??", None), (" ", None), (None, None), ("it", None)])
def test_labels(label, want):
    assert langid.label_language(label) == want
