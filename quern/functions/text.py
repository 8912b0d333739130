"""Text as Column expressions: everything stays in the JVM but ``nfc``."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The letters of the Vietnamese tokenizer beside 0-9 and a-z.
MARKED = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
TOKEN = f"[0-9a-z{MARKED}]+"

# Function words of the register profile.
FUNCTION_WORDS = "thì là mà của sẽ rằng và nhưng nếu khi để cho với trong ngoài đã đang bị được các những một này đó kia vì do bởi nên cũng rất nhiều ít không chưa chỉ còn hay hoặc về như theo sau trước giữa bằng từ đến tại qua lại vào ra lên xuống ạ nhé nha nhỉ ừ à chứ thôi vậy thế sao gì nào ai đâu".split()
# The two lexicons of the orientation score.
UPRIGHT_TERMS = "thành công, cơ hội, may mắn, thuận lợi, phát triển, hòa hợp, hạnh phúc, thịnh vượng, đạt được, tích cực, tốt đẹp, ổn định, khởi đầu, khởi sắc, cải thiện, tiến triển, viên mãn, vui vẻ, bình an, sung túc, đủ đầy, gắn kết, thấu hiểu, chân thành, nỗ lực, kiên trì, tự tin, quyết tâm, đồng thuận, ủng hộ".split(", ")
REVERSED_TERMS = "khó khăn, trở ngại, thất bại, mất mát, rủi ro, lo lắng, xung đột, rạn nứt, suy sụp, chậm trễ, tổn thất, bất lợi, nguy hiểm, bế tắc, trì trệ, suy giảm, khủng hoảng, căng thẳng, mâu thuẫn, phản bội, lừa dối, thiếu sót, sa sút, đổ vỡ, chán nản, mệt mỏi, dao động, hoang mang, bất an, cô lập".split(", ")
# Claims that no text may make, by category.
FORBIDDEN = {
    "death_prediction": ["sẽ chết", "chết chóc", "tử vong", "chết người", "mất mạng"],
    "medical_diagnosis": ["chẩn đoán", "mắc bệnh ung thư", "mắc bệnh nan y", "ung thư giai đoạn", "phát hiện bệnh"],
    "prescription": ["uống thuốc này", "uống thuốc đó", "liều thuốc", "ngừng thuốc", "kê đơn"],
    "legal_advice": ["tư vấn pháp lý", "luật sư", "khởi kiện chắc", "chắc thắng kiện", "kiện sẽ thắng"],
    "financial_guarantee": ["đảm bảo lợi nhuận", "chắc chắn sinh lời", "đầu tư chắc thắng"],
}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once. An expression that stands inside a lambda is otherwise computed again for each element, and one that stands twice outside compiled code twice."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _quote(literal: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|\-#&~])", r"\\\1", literal)


def tokens(text: Column) -> Column:
    """Vietnamese tokens as written; null for null. Case folding needs (?iu): (?i) alone splits capitals with marks."""
    return F.regexp_extract_all(text, F.lit(f"(?iu){TOKEN}"), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_split(text: Column) -> Column:
    """Runs between blanks; an empty array for blank texts."""
    return F.regexp_extract_all(text, F.lit(r"[^\s\x0B\x85\p{Z}]+"), F.lit(0))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def ngrams(items: Column, n: int, sep: str = " ") -> Column:
    """Runs of n items joined; none where there are fewer (sequence would otherwise count down)."""
    none = F.array().cast("array<string>")
    return let(items, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), sep))).otherwise(none))


def char_ngrams(text: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return let(text, lambda t: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(none))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def share(items: Column, holds) -> Column:
    """Share of the items for which it holds; 0 without items."""
    return let(items, lambda t: F.when(F.size(t) > 0, F.size(F.filter(t, holds)) / F.size(t)).otherwise(F.lit(0.0)))


def diacritic_ratio(text: Column) -> Column:
    return share(tokens(text), lambda t: t.rlike(f"(?iu)[{MARKED}]"))


def type_token_ratio(words: Column) -> Column:
    return let(words, lambda w: F.size(F.array_distinct(w)) / F.greatest(F.lit(1), F.size(w)))


def sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[.!?…]")) + 1


def has_term(text: Column, term: str) -> Column:
    """As whole words. \\b is written out, as it means ASCII words on some Java versions."""
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}_]){_quote(term)}(?![\p{{L}}\p{{N}}_])")


def term_hits(text: Column, terms: Iterable[str]) -> Column:
    """Number of terms that occur at least once."""
    return let(F.lower(text), lambda low: sum((F.when(F.contains(low, F.lit(t)) & has_term(low, t), 1).otherwise(0) for t in terms), F.lit(0)))


def polarity(text: Column, up: Sequence[str] = UPRIGHT_TERMS, down: Sequence[str] = REVERSED_TERMS, epsilon: float = 0.15) -> Column:
    """struct(score, hits, attribution): balance of two lexicons, agnostic within epsilon and without hits."""

    def judged(h: Column) -> Column:
        u, d = h["u"], h["d"]
        score = F.when(u + d > 0, (u - d) / (u + d)).otherwise(F.lit(0.0))
        label = F.when((u + d == 0) | (F.abs(score) < epsilon), "vi_orientation_agnostic").when(score > 0, "vi_upright").otherwise("vi_reversed_skew")
        return F.struct(score.alias("score"), (u + d).alias("hits"), label.alias("attribution"))

    return let(F.struct(term_hits(text, up).alias("u"), term_hits(text, down).alias("d")), judged)


def matched_categories(text: Column, patterns: dict[str, Sequence[str]]) -> Column:
    """Names of the categories with a phrase in the text; blanks inside a phrase match any white space."""

    def one(phrases: Sequence[str]) -> Column:
        body = "|".join(_quote(p).replace(" ", r"\s+") for p in phrases)
        return text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])")

    return F.array_compact(F.array(*(F.when(one(p), F.lit(n)) for n, p in patterns.items())))


def first_match(text: Column, patterns: dict[str, str], default: str | None = None) -> Column:
    """Ordered classifier: label of the first pattern that matches."""
    out = None
    for label, p in patterns.items():
        out = (F if out is None else out).when(text.rlike(p), F.lit(label))
    return out.otherwise(F.lit(default))


def keyword_containment(text: Column, keywords: Column) -> Column:
    """Share of the keywords that stand in the text, whatever their case; 0 without keywords."""
    return let(F.lower(text), lambda low: F.when(F.size(keywords) > 0, F.size(F.filter(keywords, lambda k: (k != "") & F.contains(low, F.lower(k)))) / F.size(keywords)).otherwise(F.lit(0.0)))


def first_filled(*texts: Column) -> Column:
    """First that isn't null or blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(t), F.lit("")) for t in texts))


def truncate(text: Column, most: int) -> Column:
    """At most so many characters, the last three an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def distinct_ignoring_case(items: Column, most: int) -> Column:
    """Trimmed items without blanks, each spelling-by-case once in order, at most so many."""
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return let(kept, lambda k: let(F.transform(k, lambda y: F.lower(y)), lambda low: F.slice(F.filter(k, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, most)))


def from_html(html: Column) -> Column:
    """Without scripts, tags and the commonest entities, blanks collapsed."""
    t = F.regexp_replace(html, "(?is)<script.*?</script>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for entity, ch in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"')):
        t = F.replace(t, F.lit(entity), F.lit(ch))
    return collapse(t)


def scrub(text: Column, secrets: Iterable[str] = ()) -> Column:
    """Keys, bearer tokens and the given secrets (longest first) out of a line."""
    t = F.regexp_replace(text, r"sk-[A-Za-z0-9_-]{8,}", "[REDACTED]")
    t = F.regexp_replace(t, r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]")
    for s in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        t = F.replace(t, F.lit(s), F.lit("[REDACTED]"))
    return t


def strip_headers(text: Column, patterns: Sequence[str]) -> Column:
    """Each pattern in its order off the start, whatever its case."""
    for p in patterns:
        text = F.regexp_replace(text, f"(?iu)^(?:{p})", "")
    return text


def gazetteer(text: Column, names: Iterable[str]) -> Column:
    """Names found in the text: at a place the longest wins, matches don't overlap, each name once, in lower case."""
    body = "|".join(_quote(n.lower()) for n in sorted(set(names), key=lambda n: (-len(n), n)))
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])"), F.lit(0)))


def token_estimate(text: Column) -> Column:
    """Words and single signs, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]")))


def json_in(text: Column) -> Column:
    """The outermost object in a chatty answer: from the first brace to the last."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def hashed_vector(text: Column, n: int = 4, dims: int = 4096) -> Column:
    """map(dimension -> weight): L2-normalised counts of hashed character n-grams. Sparse: never a dense array of all dimensions."""
    grams = F.transform(char_ngrams(F.lower(text), n), lambda g: F.pmod(F.crc32(F.encode(g, "UTF-8")), F.lit(dims)).cast("int"))

    def weights(g: Column) -> Column:
        counts = let(F.array_sort(F.array_distinct(g)), lambda ds: F.transform(ds, lambda d: F.struct(d.alias("d"), F.size(F.filter(g, lambda x: x == d)).cast("double").alias("c"))))

        def normed(cs: Column) -> Column:
            norm = F.sqrt(F.aggregate(cs, F.lit(0.0), lambda a, x: a + x["c"] * x["c"]))
            return let(norm, lambda z: F.map_from_entries(F.transform(cs, lambda x: F.struct(x["d"], x["c"] / z))))

        return let(counts, normed)

    return let(grams, weights)


def label_parts(label: Column, prefix: str = "lá bài", reversed_mark: str = "ngược") -> Column:
    """struct(name, orientation) of a free label: single blanks, without the prefix; a mark at the end says that it is reversed."""
    name = F.regexp_replace(collapse(label), rf"(?iu)^{_quote(prefix)}\s+", "")
    return let(name, lambda n: F.when(n.isNotNull(), F.struct(F.trim(F.regexp_replace(n, rf"\s*{_quote(reversed_mark)}\s*$", "")).alias("name"), F.when(n.endswith(reversed_mark), "reversed").otherwise("upright").alias("orientation"))))


def mentions(text: Column, names: Iterable[str], mark: str = r"reversed|rx|inverted|upside[- ]down", ahead: int = 22) -> Column:
    """array<struct(name, reversed)>: names in the text, lower case, each with whether a mark stands within so many characters after it; each such pair once."""
    body = "|".join(_quote(n.lower()) for n in sorted(set(names), key=lambda n: (-len(n), n)))
    found = lambda low, i: F.regexp_extract_all(low, F.lit(rf"(?s)(?<![\p{{L}}\p{{N}}_])({body})(?![\p{{L}}\p{{N}}_])(?=(.{{0,{ahead}}}))"), F.lit(i))
    marked = lambda after: after.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{mark})(?![\p{{L}}\p{{N}}_])")
    return let(F.lower(text), lambda low: F.array_distinct(F.zip_with(found(low, 1), found(low, 2), lambda n, a: F.struct(n.alias("name"), marked(a).alias("reversed")))))


# Phrases of the same shape as a name.
NO_NAMES = ("the past", "the present", "the future", "the querent", "the reader", "the outcome", "the situation", "the question", "the cards", "the reading", "the universe")


def unknown_names(text: Column, known: Iterable[str], stop: Sequence[str] = NO_NAMES) -> Column:
    """"The" with one or two capitalised words that is neither a known name nor a stop phrase, as written with single blanks."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])The\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?(?![\p{L}\p{N}_])"), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", " "))
    out = sorted({*(k.lower() for k in known), *stop})
    return F.filter(F.array_distinct(found), lambda x: ~F.lower(x).isin(out) if out else F.lit(True))


def first_words(text: Column, n: int) -> Column:
    return let(word_split(text), lambda w: F.array_join(F.slice(w, 1, n), " "))


def short_gloss(full: Column, label: Column, most_words: int = 12, most_chars: int = 90) -> Column:
    """The whole gloss if it is short, else the first words of its first clause; the label before it unless it holds it."""
    whole = collapse(full)
    fits = (F.size(word_split(whole)) <= most_words) & (F.length(whole) <= most_chars)
    body = F.when(fits, whole).otherwise(first_words(F.trim(F.element_at(F.split(whole, "[.;]"), 1)), most_words))
    return let(body, lambda b: F.when(F.contains(F.lower(b), F.lower(label)), b).otherwise(F.concat(label, F.lit(": "), b)))


def short_label(text: Column, most_words: int = 4, most_chars: int = 40, words: int = 3) -> Column:
    """The text itself if it is a label already, else its first words of letters and digits, or its first 20 characters."""
    own = F.array_join(F.slice(ascii_tokens(text), 1, words), " ")
    return let(F.trim(text), lambda t: F.when((F.size(word_split(t)) <= most_words) & (F.length(t) <= most_chars), t).otherwise(F.coalesce(F.nullif(own, F.lit("")), F.substring(t, 1, 20))))


def with_cue(modern: Column, historical: Column, source: str, most: int = 160) -> Column:
    """The modern meaning, and in brackets the historical one, shortened, unless the modern one holds it."""
    m, h = F.trim(modern), F.trim(historical)
    cue = F.when(F.length(h) < most, h).otherwise(F.concat(F.substring(h, 1, most - 3), F.lit("...")))
    return F.when(h.isNull() | (h == "") | F.contains(F.lower(m), F.lower(h)), m).otherwise(F.concat(F.regexp_replace(m, r"\.+$", ""), F.lit(f" ({source}: "), cue, F.lit(")")))


# Words by which a post asks, and texts of removed posts.
ASKING = r"\?|(?<![a-z0-9_])(?:asked|question|wondering|guidance|advice|does he|will i|should i|what does|help me|pulled|drew|spread|about my|my ex|clarify)(?![a-z0-9_])"
REMOVED = ("[removed]", "[deleted]")


def is_question(text: Column) -> Column:
    return F.lower(text).rlike(ASKING)


def is_removed(text: Column) -> Column:
    return F.trim(text).isin(*REMOVED)


PAGE = r"---\s*Page\s+\d+\s*---"


def page_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PAGE))


def without_pages(text: Column) -> Column:
    return collapse(F.regexp_replace(text, PAGE, " "))


def leaks(text: Column, scaffolds: Sequence[str]) -> Column:
    """Scaffold phrases that stand in the text, whatever the case."""
    return let(F.lower(text), lambda low: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(s.lower())), F.lit(s)) for s in scaffolds))))


def first_repeated(text: Column, names: Sequence[str], but: Column, least: int = 2) -> Column:
    """First of the names, in their order, that isn't among ``but`` (lower case) and occurs so often in the text; null if none."""
    often = lambda low, n: (F.length(low) - F.length(F.replace(low, F.lit(n.lower()), F.lit("")))) / len(n) >= least
    return let(F.struct(F.lower(text).alias("low"), but.alias("b")), lambda x: F.coalesce(*(F.when(F.contains(x["low"], F.lit(n.lower())) & ~F.array_contains(x["b"], n.lower()) & often(x["low"], n), F.lit(n)) for n in names)))


def block(title: str, items: Column, bullet: str = "- ") -> Column:
    """A titled list, a line per item; without items the title alone."""
    return F.concat_ws("\n", F.lit(title), F.transform(items, lambda x: F.concat(F.lit(bullet), x)))


def is_language(lang: Column, category: Column, want: str, category_mark: str) -> Column:
    """The language where it is given; else the category names it: holds the mark, ends with _want or is it."""
    g, c = F.lower(F.trim(F.coalesce(lang, F.lit("")))), F.lower(F.trim(F.coalesce(category, F.lit(""))))
    return (g == want) | ((g == "") & (F.contains(c, F.lit(category_mark)) | c.endswith(f"_{want}") | (c == want)))


def mapped(value: Column, table: dict, default: Column) -> Column:
    """Value of the table by the lower-cased key, else the default."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.lower(value)], default)
