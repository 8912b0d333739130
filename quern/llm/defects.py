"""Broken question-answer pairs: noisy labelling functions and a label model."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.forms import consistent
from quern.llm.words import WORD, per_batch
from quern.plans.lineage import stored

DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
SHORT = 45  # words: a reading of a card is longer, most refusals aren't

# Answers that only hold the place of one, without diacritics.
PLACEHOLDERS = {"n a", "na", "null", "none", "nil", "nan", "todo", "tbd", "trong", "rong", "khong co", "chua co", "khong", "chua co noi dung", "khong co noi dung", "dang cap nhat", "cap nhat sau", "chua cap nhat", "chua tra loi", "khong co cau tra loi", "empty", "undefined", "xxx", "noi dung", "placeholder", "no answer", "no content"}
# Ways to decline in Vietnamese, and in other languages.
_REFUSES = re.compile(
    r"không (?:thể|được phép|hỗ trợ|đủ thông tin|có đủ|khả dụng|cho phép|xem bài|đọc lá|đi vào|bình luận|trả lời|tiện|nhận)|chưa thể|từ chối|xin phép không|nằm ngoài (?:khả năng|phạm vi)|đành bỏ qua|dừng ở đây|chỉ là (?:chương trình|mô hình|trợ lý)|xin (?:thứ lỗi|lỗi|kiếu|dừng)|rất tiếc|thông cảm|với vai trò trợ lý"
    r"|\b(?:i can'?t|i cannot|i'?m sorry|unable to|as an ai|je ne peux pas|no puedo|ich kann (?:das )?nicht)\b"
)
# Frequent short words; Vietnamese ones as they are without diacritics where no other language has them.
STOP = {
    "en": "the of and that with your you is it for this from what when are in to an as by not than at".split(),
    "fr": "le les des du une vous votre est que dans pour avec sur pas ce cette et qui plus sans au ne la un de".split(),
    "es": "el los las del una tu que con por para es en lo como este esta se su y al sin no la un de".split(),
    "de": "der die das und den ein eine einen dem mit nicht ist du dich für auf von zu es noch im sich was so".split(),
}
VI = set("la khong ban mot cua cho trong nguoi long minh nay khi dieu voi nhung cung hay duoc theo truoc ngay moi qua chi con nhip lai viec nguoc xuoi dung tu giu tren duoi nhin giua mang noi".split())
_MARKED = re.compile("[àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ]")
_ONLY_VI = re.compile("[ảãạăằắẳẵặầấẩẫậđẻẽẹềếểễệỉĩịỏõọồốổỗộơờớởỡợủũụưừứửữựỳỷỹỵ]")
_SYLLABLE = re.compile(r"(?:ngh?|[cgkpt]h|gi|qu|tr|[bcdghklmnpqrstvxđ])?(?:i?eu|u?oi|u?ye?|i?a[ouy]?|oa[iyo]?|oe|ua?y?|ie|e[ou]?|i[u]?|o[ai]?|uo|u[aiy]?|y)(?:ch|ng|nh|[cmnpt])?\Z")
_CLOSED = re.compile("[.!?。！？\"”’»)\\]]\\Z")
_TRAILS = re.compile(r"(?:…|\.\s?\.\s?\.)\Z")
_PICTO = re.compile("[☀-➿\U0001f000-\U0001faff]\\Z")
_TRAIL = re.compile("[\\s‍️​]+\\Z")
_SENTENCE = re.compile(r"[^.!?…;\n]+")


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("đ", "d")


class _Known(dict):
    """Of a word: (marked, only Vietnamese, Vietnamese or like it, languages whose short word it is)."""

    def __missing__(self, w: str) -> tuple:
        if len(self) > 200_000:
            self.clear()
        b = _bare(w)
        own = bool(_ONLY_VI.search(w))
        self[w] = out = (bool(_MARKED.search(w)), own, own or b in VI, tuple(g for g, s in STOP.items() if w in s), bool(_SYLLABLE.match(b)))
        return out


_known = _Known()


def _closed(text: str) -> bool:
    t = _TRAIL.sub("", text)
    if _PICTO.search(t):
        return True
    return bool(_CLOSED.search(t)) and not _TRAILS.search(t)


def _unclosed(text: str) -> bool:
    return text.count("(") > text.count(")") or text.count("“") > text.count("”") or text.count("[") > text.count("]")


def _similar(a: list[str], b: list[str]) -> float:
    """Words of b that a has, in multiplicity up to twice, by the words of b."""
    have = Counter(a)
    return sum(min(n, 2 * have[w]) for w, n in Counter(b).items()) / max(len(b), 1)


def votes(question: str | None, answer: str | None, task: str | None) -> int:
    """Bit set of the labelling functions of ``FUNCTIONS`` that fire. Null and blank questions fire nothing; a null task type may ask for a reading."""
    text = consistent(answer or "")
    low = text.lower()
    w = WORD.findall(low)
    n = len(w)
    out = 0

    def vote(name: str, fires: bool) -> None:
        nonlocal out
        out |= fires << BIT[name]

    vote("no_words", n == 0)
    vote("placeholder", n == 0 or n <= 6 and _bare(" ".join(w)) in PLACEHOLDERS)
    vote("tiny", n <= 4)
    q = WORD.findall(consistent(question or "").lower())
    if q:
        vote("words_of_question", n > 0 and _similar(q, w) >= 0.7)
        vote("covers_question", n > 0 and sum((Counter(q) & Counter(w)).values()) >= 0.7 * len(q))
        vote("as_long_as_question", 0.6 * len(q) <= n <= 2 * len(q) + 6)
    if n:
        said = _SENTENCE.findall(low)
        declining = [bool(_REFUSES.search(" ".join(x.split()))) for x in said if x.strip()]
        mostly = n < SHORT or 2 * sum(declining) >= len(declining)  # a reading may decline to foretell and go on
        vote("declines", mostly and bool(_REFUSES.search(low)))
        vote("declines_early", mostly and bool(_REFUSES.search(" ".join(said[:1]))))
        vote("not_of_question", _similar(q, w) < 0.6)
    vote("reading_asked", "safety" not in consistent(task or "").lower())  # there a notice of limits is part of the answer
    vote("brief", 4 < n < SHORT)
    if n >= 5:
        k = [_known[x] for x in w]
        foreign = Counter(g for x in k for g in x[3])
        best = max(foreign.values(), default=0)
        viet = sum(x[2] for x in k)
        vote("unmarked", sum(x[1] for x in k) < 0.2 * n)
        vote("foreign_words", best >= 0.08 * n and best > viet)
        vote("few_vietnamese", viet < 0.12 * n)
        vote("not_syllables", sum(x[4] for x in k) < 0.78 * n and sum(x[1] for x in k) < 0.3 * n)
    if n >= 5:
        vote("open_end", not _closed(text))
        vote("unclosed", not _closed(text) and _unclosed(text))
        vote("long_open", n >= SHORT and not _closed(text))
    return out


#: Per defect its labelling functions, each with a first guess of how often it fires for the defect and otherwise.
FUNCTIONS = {
    "empty": {"no_words": (0.6, 1e-5), "placeholder": (0.95, 1e-5), "tiny": (0.98, 1e-3)},
    "copy": {"words_of_question": (0.97, 1e-3), "covers_question": (0.97, 1e-3), "as_long_as_question": (0.97, 0.01)},
    "refusal": {"declines": (0.97, 1e-3), "declines_early": (0.9, 1e-3), "not_of_question": (0.95, 0.02), "brief": (0.97, 0.01), "reading_asked": (0.98, 0.9)},
    "language": {"unmarked": (0.97, 0.03), "foreign_words": (0.97, 1e-3), "few_vietnamese": (0.95, 1e-2), "not_syllables": (0.9, 1e-2)},
    "truncated": {"open_end": (0.98, 2e-3), "long_open": (0.95, 1e-3), "unclosed": (0.3, 1e-3)},
}
BIT = {f: i for i, f in enumerate(f for fs in FUNCTIONS.values() for f in fs)}
#: Posteriors from which a label is kept; of 0.1, 0.2 .. 0.9 none does better on the labelled pairs (tests/llm/test_texts.py).
CUTOFFS = dict.fromkeys(DEFECTS, 0.5)


def fit(patterns: dict[int, int], rounds: int = 50, strength: float = 50.0) -> dict[str, dict[int, float]]:
    """Expectation maximisation per defect over counted vote patterns: posteriors by pattern.

    Rates start from, and are drawn with ``strength`` pseudo-counts to, the
    first guesses, so that a defect no record has isn't fitted to noise.
    """
    total = sum(patterns.values())
    out: dict[str, dict[int, float]] = {}
    for d, fs in FUNCTIONS.items():
        seen: Counter = Counter()
        for p, n in patterns.items():
            seen[tuple(p >> BIT[f] & 1 for f in fs)] += n
        prior, rates, first = 0.01, [list(r) for r in fs.values()], list(fs.values())
        post: dict[tuple, float] = {}
        for _ in range(rounds):
            for v in seen:
                odds = math.log(prior / (1 - prior))
                for x, (hit, false) in zip(v, rates, strict=True):
                    odds += math.log(hit / false) if x else math.log((1 - hit) / (1 - false))
                post[v] = 1 / (1 + math.exp(-max(min(odds, 500), -500)))
            mass = sum(n * post[v] for v, n in seen.items())
            prior = (mass + 0.01 * strength) / (total + strength)
            for i, (hit, false) in enumerate(first):
                rates[i][0] = min((sum(n * post[v] for v, n in seen.items() if v[i]) + hit * strength) / (mass + strength), 1 - 1e-6)
                rates[i][1] = max((sum(n * (1 - post[v]) for v, n in seen.items() if v[i]) + false * strength) / (total - mass + strength), 1e-7)
        out[d] = {p: post[tuple(p >> BIT[f] & 1 for f in fs)] for p in patterns}
    return out


def label_pairs(rows: DataFrame, id: Column, question: Column, answer: Column, task: Column) -> DataFrame:
    """(id, defects, posteriors, defect) for each record with a defect: all labels whose posterior passes their cutoff, in the order of ``DEFECTS``, and the first of them.

    A null answer is an empty one; a record delivered again counts once (null
    ids give no row); an empty table gives no rows. The whole table is voted on
    once; only counts of vote patterns, at most 2^18, reach the driver.
    """

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        q, a, t = (b.column(i).to_pylist() for i in (1, 2, 3))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(map(votes, q, a, t), pa.int32())], ["id", "votes"])

    src = rows.select(id.cast("string").alias("id"), question.cast("string"), answer.cast("string"), task.cast("string")).where("id is not null")
    voted = stored(src.mapInArrow(per_batch(f), "id string, votes int"))
    patterns = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    found = []
    if patterns:
        post = fit(patterns)
        for p in patterns:
            kept = [d for d in DEFECTS if post[d][p] >= CUTOFFS[d]]
            if kept:
                found.append((p, kept, [post[d][p] for d in kept], kept[0]))
    table = rows.sparkSession.createDataFrame(found, "votes int, defects array<string>, posteriors array<double>, defect string")
    return voted.join(F.broadcast(table), "votes").select("id", "defects", "posteriors", "defect").dropDuplicates(["id"])
