"""Language of documents and passages by cross-parsing entropy."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.forms import consistent
from quern.llm.words import per_batch
from quern.operators import ordering

LANGUAGES = ("vi", "en", "fr", "es", "de")
# Names of the languages in labels, beside their two letters.
NAMES = {
    "vie": "vi", "vietnamese": "vi", "tiếng việt": "vi", "tieng viet": "vi", "việt": "vi", "viet": "vi", "vietnamien": "vi", "vietnamesisch": "vi", "vietnamita": "vi",
    "eng": "en", "english": "en", "anglais": "en", "englisch": "en", "inglés": "en", "tiếng anh": "en",
    "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr", "französisch": "fr", "francés": "fr", "tiếng pháp": "fr",
    "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "castilian": "es", "espagnol": "es", "spanisch": "es", "tiếng tây ban nha": "es",
    "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "allemand": "de", "alemán": "de", "tiếng đức": "de",
}
_LETTERS = re.compile(r"[^\W\d_]+")
_QUOTED = re.compile(r"“[^”\n]*”|«[^»\n]*»|„[^“\n]*“|\"[^\"\n]*\"")
_HEADING = re.compile(r"\[[^\]\n]*\]|^\s*#+[^\n]*$", re.M)
_SENTENCE = re.compile(r"[^.!?…\n]+[.!?…]*")


def label_language(label: str | None) -> str | None:
    """The language that a label names in any spelling: code, three letters, name, region after - or _. None for no label and for words that name none of the languages."""
    if label is None:
        return None
    low = consistent(label).strip().lower()
    if low in NAMES:
        return NAMES[low]
    head = re.split(r"[-_ ]", low, maxsplit=1)[0]
    return head if head in LANGUAGES else NAMES.get(head) if re.fullmatch(r"[a-z]{3}", head) else None


def bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("đ", "d")


class SuffixAutomaton:
    """Of one string; ``longest`` is the length of the longest prefix of s[i:] that occurs in it."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, size, last = [-1], [0], 0
        for ch in text:
            cur = len(self.next)
            self.next.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p != -1 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = link[p]
            if p != -1:
                q = self.next[p][ch]
                if size[p] + 1 == size[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p != -1 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def longest(self, s: str, i: int) -> int:
        state, k = 0, i
        while k < len(s) and (n := self.next[state].get(s[k])) is not None:
            state, k = n, k + 1
        return k - i

    def phrases(self, s: str) -> int:
        """Phrases of the cross-parsing of s: the longest match each time, one character where there is none."""
        i = n = 0
        while i < len(s):
            i += max(self.longest(s, i), 1)
            n += 1
        return n


class LanguageModel:
    """Automata of the languages, and per word its phrases in each.

    Phrases don't cross a word's end, so a word's counts are computed once and
    a text's are sums. A phrase costs the logarithm of the size of the language's
    text, as a place in it has to be named; costs are in units of the largest one.
    """

    def __init__(self, vocabulary: dict[str, list[str]], names: list[str] | None = None):
        """names: proper names, which have no language, wherever they stand."""
        longest = sorted({" ".join(_LETTERS.findall(consistent(n).lower())) for n in names or () if n} - {""}, key=lambda n: (-len(n), n))
        self.names = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, longest)) + r")(?!\w)") if longest else None
        held = {g: " " + " ".join(vocabulary.get(g, [])) + " " for g in LANGUAGES}
        self.auto = {g: SuffixAutomaton(t) for g, t in held.items()}
        bits = [math.log2(len(t) + 1) for t in held.values()]
        self.cost = [b / max(bits) if vocabulary.get(g) else 1.0 for g, b in zip(LANGUAGES, bits, strict=True)]
        self.seen: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> tuple[int, ...]:
        if (n := self.seen.get(w)) is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[w] = n = tuple(self.auto[g].phrases(f" {w} ") for g in LANGUAGES)
        return n

    def score(self, words: list[str]) -> list[float]:
        return [sum(x) * c for x, c in zip(zip(*map(self.word, words), strict=True), self.cost, strict=True)] if words else [0.0] * len(LANGUAGES)

    def words(self, text: str) -> list[str]:
        low = consistent(text).lower()
        return _LETTERS.findall(self.names.sub(" ", low) if self.names else low)

    @staticmethod
    def decide(score: list[float], words: int) -> tuple[str | None, float]:
        """(language with the fewest phrases, confidence); no language where the next one has hardly more."""
        order = sorted(range(len(score)), key=score.__getitem__)
        best, second = score[order[0]], score[order[1]]
        conf = 1 / sum(math.exp(-(x - best)) for x in score)
        return (LANGUAGES[order[0]] if second - best >= max(2, 0.12 * words) else None), conf

    def passages(self, text: str) -> list[tuple[str, int, int, float, int]]:
        """(language, start, end, confidence, sentences) of the text's passages: neighbouring sentences in one language. Quotations inside a sentence, headings and sentences that tell nothing (card names, numbers) belong to the passage before them, or else after."""
        clean = _HEADING.sub(lambda m: " " * len(m.group()), text)
        if (rest := _QUOTED.sub(lambda m: " " * len(m.group()), clean)) and _LETTERS.search(rest):
            clean = rest
        out: list[list] = []
        start = 0
        for m in _SENTENCE.finditer(clean):
            w = self.words(m.group())
            score = self.score(w)
            g, conf = self.decide(score, len(w)) if len(w) >= 3 else (None, 0.0)
            if g is None:
                if out:
                    out[-1][2] = m.end()
                continue
            if out and out[-1][0] == g:
                out[-1][2], out[-1][3], out[-1][4] = m.end(), out[-1][3] + conf * len(w), out[-1][4] + 1
                out[-1][5] += len(w)
            else:
                out.append([g, start if not out else m.start(), m.end(), conf * len(w), 1, len(w)])
        if not out:  # no whole sentence: the text's words together
            w = self.words(text) or _LETTERS.findall(consistent(text).lower())
            if not w:
                return []
            score = self.score(w)
            k = min(range(len(score)), key=lambda i: (score[i], i))
            return [(LANGUAGES[k], 0, len(text), 1 / sum(math.exp(-(x - score[k])) for x in score), 0)]
        return [(g, a, z, c / n, s) for g, a, z, c, s, n in out]


def train(docs: DataFrame, text: Column, label: Column, *, per_language: int = 300, most_words: int = 6000) -> dict[str, list[str]]:
    """Vocabulary per language from a bounded sample of labelled documents.

    Of each language ``per_language`` different labelled documents, chosen by
    hash among all, are read whole. Labels may be wrong: a word stays with a language only
    if its share of documents there is at least a third of its highest share
    anywhere; at most ``most_words`` words per language. Vietnamese words also
    stand without their marks.
    """

    @F.pandas_udf("string")
    def language(labels: pd.Series) -> pd.Series:
        known = {x: label_language(x) for x in labels.unique()}
        return labels.map(known.get)

    src = docs.select(language(label.cast("string")).alias("g"), text.cast("string").alias("t")).where("g is not null and length(t) >= 40").withColumn("h", F.xxhash64("t"))
    least = ordering.first_per(src.select("g", "h").distinct(), ["g"], [F.col("h")], per_language)  # copies of a text count once
    sample = src.join(F.broadcast(least), ["g", "h"]).select("g", "h", "t").distinct().toPandas()  # five times per_language texts
    shares: dict[str, Counter] = {}
    for g in LANGUAGES:
        own = sample[sample["g"] == g].sort_values(["h", "t"])["t"].head(per_language)
        df: Counter = Counter()
        for t in own:
            df.update(set(_LETTERS.findall(consistent(t).lower())))
        if len(own):
            shares[g] = Counter({w: n / len(own) for w, n in df.items()})
    out = {}
    for g, c in shares.items():
        kept = [w for w, s in c.items() if s >= max(o[w] for o in shares.values()) / 3]
        kept = sorted(kept, key=lambda w: (-c[w], w))[:most_words]
        out[g] = sorted({*kept, *map(bare, kept)} if g == "vi" else set(kept))
    return out


def languages(docs: DataFrame, id: Column, text: Column, label: Column, vocabulary: dict[str, list[str]], names: list[str] | None = None) -> DataFrame:
    """(id, label, passages) per document with words; passages is an array of (lang, start, end, confidence, sentences). Documents without letters have no row."""
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, names))  # at most five times most_words words, and the names given
    models: list[LanguageModel] = []
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("sentences", pa.int32())]))

    def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
        if not models:
            models.append(LanguageModel(*held.value))
        found = [models[0].passages(t) if t else [] for t in b.column(1).to_pylist()]
        keep = [i for i, p in enumerate(found) if p]
        at = pa.array(keep, pa.int32())
        named = [label_language(x) for x in b.column(2).take(at).to_pylist()]
        lists = pa.array([[dict(zip(("lang", "start", "end", "confidence", "sentences"), p, strict=True)) for p in found[i]] for i in keep], kind)
        return pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(named, pa.string()), lists], ["id", "label", "passages"])

    src = docs.select(id.alias("id"), text.cast("string").alias("text"), label.cast("string").alias("label"))
    return src.mapInArrow(per_batch(f, 500), f"id {src.schema['id'].dataType.simpleString()}, label string, passages array<struct<lang:string,start:int,end:int,confidence:double,sentences:int>>")


def mislabelled(found: DataFrame) -> DataFrame:
    """(id, lang): of documents whose label is missing, names a language that the text isn't in, or that have sentences in several languages, each language of the text."""
    langs = F.array_distinct(F.transform("passages", lambda p: p["lang"]))
    wrong = F.col("label").isNull() | ~F.array_contains(langs, F.col("label")) | (F.size(langs) > 1)
    return found.where(wrong).select("id", F.explode(langs).alias("lang"))
