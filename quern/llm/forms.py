"""Consistent form of text, and look-alike classes learnt from a corpus.

``consistent`` is the plain definition (the exact check); ``LookalikeModel`` is
the corpus operator's method: union-find over the strings and code points that
were seen, frequency-based representatives, and one greedy left-to-right
rewrite with an Aho-Corasick automaton.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

# Letters of other scripts that look like a Latin letter.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅ", "aeopcyxijshdqwABEKMHOPCTYXIJS", strict=True))
GREEK = dict(zip("αορνικυχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aopvikuxyABEZHIKMNOPTYX", strict=True))
# Letters that look like another one of their script.
SAME = {"Ð": "Đ", "Ɖ": "Đ"}
LIKE = {"CYRILLIC": CYRILLIC, "GREEK": GREEK}
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
TO = {("LATIN", s): m for s, m in LIKE.items()} | {(s, "LATIN"): {v: k for k, v in reversed(m.items())} for s, m in LIKE.items()}
TO |= {(a, b): {y: TO[a, "LATIN"][x] for y, x in LIKE[b].items() if x in TO[a, "LATIN"]} for a in LIKE for b in LIKE if a != b}

_KEPT_CONTROLS = "\t\n\r\v\f\x1c\x1d\x1e\x1f\x85  "
_SELECTORS = "︀-️\U000e0100-\U000e01ef"
_TAGS = "\U000e0020-\U000e007f"


def _invisible() -> set[str]:
    found = {chr(c) for c in range(0x20) if chr(c) not in _KEPT_CONTROLS} | {chr(c) for c in range(0x7F, 0xA0) if chr(c) not in _KEPT_CONTROLS}
    found |= {chr(c) for c in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0xE0000, 0xE0080))}
    shown = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD}  # format characters with a glyph
    return found | {chr(c) for c in range(0x20, 0x11000) if unicodedata.category(chr(c)) == "Cf" and c not in shown}


def _narrow(ch: str) -> str:
    return unicodedata.normalize("NFKC", ch) if unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")) else ch


INVISIBLE = _invisible()
BLANKS = {chr(c) for c in range(0x21, 0x3001) if unicodedata.category(chr(c)) == "Zs"}
WIDTH = {chr(c): _narrow(chr(c)) for c in range(0xFF01, 0xFFEF) if _narrow(chr(c)) != chr(c)}
_PLAIN = {**SAME, **{c: " " for c in BLANKS}, **{c: n for c, n in WIDTH.items() if c not in INVISIBLE}}


def _cls(chars: Iterable[str]) -> str:
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}" + (f"-\\U{b:08x}" if b > a else "") for a, b in out)


_MARKS = "̀-ͯ"
_OTHER = "Ͱ-ϿЀ-ԯἀ-῿"
SUSPECT = re.compile(f"[{_MARKS}{_OTHER}{_cls(INVISIBLE)}{_cls(BLANKS)}{_cls(WIDTH)}{_cls(SAME)}]")
_TO_PLAIN = re.compile(f"[{_cls(_PLAIN)}]")
_HIDDEN = re.compile(f"[{_cls(INVISIBLE)}]+")
_WORD = re.compile(f"[^\\W\\d_][^\\W\\d_{_MARKS}]*(?:[{_MARKS}]+[^\\W\\d_]*)*")
_FOREIGN = re.compile(f"[{_OTHER}]")
_PICTO = re.compile("[©®‼⁉™ℹ↔-↪⌚-⏿Ⓜ▪-➿⤴-⭕〰〽㊗㊙\U0001f000-\U0001faff]")
_BEFORE_SELECTOR = re.compile("[#*0-9©-\U0001faff]")


def _held(text: str, i: int, ch: str) -> bool:
    """Whether the invisible character at i holds an emoji together."""
    before = text[i - 1] if i else ""
    if ch == "‍":
        k = i - 1
        while k > 0 and text[k] in "︎️":
            k -= 1
        return k >= 0 and i + 1 < len(text) and bool(_PICTO.match(text[k]) and _PICTO.match(text[i + 1]))
    if ch in "︎️":
        keycap = before in "#*0123456789" and text[i + 1 : i + 2] == "⃣"
        return bool(before) and (keycap or bool(_PICTO.match(before)))
    if "\U000e0020" <= ch <= "\U000e007f":
        return before == "\U0001f3f4" or "\U000e0020" <= before <= "\U000e007f"
    return False


def _plain(text: str) -> str:
    return _TO_PLAIN.sub(lambda m: _PLAIN[m.group()], text)


def drop_invisible(text: str) -> str:
    return _HIDDEN.sub(lambda m: "".join(c for k, c in enumerate(m.group(), m.start()) if _held(text, k, c)), text)


def script(ch: str) -> str | None:
    if ch.isascii():
        return "LATIN" if ch.isalpha() else None
    if "Ͱ" <= ch <= "Ͽ" or "ἀ" <= ch <= "῿":
        return "GREEK"
    if "Ѐ" <= ch <= "ԯ":
        return "CYRILLIC"
    return "LATIN" if ch.isalpha() and unicodedata.name(ch, "").startswith("LATIN") else None


def reads_as(letters: str) -> str | None:
    """The script a mixed word reads as: one that all its letters can be written in; of several the most frequent one, Latin before others. None: one script, or none fits."""
    have = Counter(filter(None, map(script, letters)))
    if len(have) < 2:
        return None
    fits = [s for s in SCRIPTS if s in have and all((k := script(c)) in (None, s) or c in TO[s, k] for c in letters)]
    return max(fits, key=lambda s: (have[s], s == "LATIN")) if fits else None


def _one_script(m: re.Match) -> str:
    word = m.group()
    if not _FOREIGN.search(word):
        return word
    parts = unicodedata.normalize("NFD", word)
    to = reads_as("".join(c for c in parts if not unicodedata.combining(c)))
    if to is None:
        return word
    return unicodedata.normalize("NFC", "".join(c if (k := script(c)) in (None, to) else TO[to, k][c] for c in parts))


def consistent(text: str | None) -> str | None:
    """Null stays null, empty stays empty. Idempotent."""
    if text is None or text.isascii() and text.isprintable():
        return text
    if SUSPECT.search(text):
        text = unicodedata.normalize("NFC", drop_invisible(_plain(text)))
        return _WORD.sub(_one_script, text) if _FOREIGN.search(text) else text
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


#: A letter with marks after it, at most 3: longer piles are composed when the rewritten text is.
PILE = re.compile(f"\\w[{_MARKS}]{{1,3}}")


def symbols(text: str) -> Iterator[str]:
    """Strings of a text that may belong to a look-alike class of more than one member."""
    yield from SUSPECT.findall(text)
    yield from PILE.findall(text)
    if not unicodedata.is_normalized("NFC", text):
        yield from (c for c in set(text) if not unicodedata.is_normalized("NFC", c))


class LookalikeModel:
    """Look-alike classes over seen symbols.

    ``counts``: how often each code point and each pile of marks occurs in the
    corpus. Its size is bounded by what one writing system can combine, not by
    the number of rows. Members of a class look alike over several steps; each
    script's most frequent well-formed member represents the class there.
    """

    def __init__(self, counts: dict[str, int]):
        import ahocorasick

        self.counts, self.up = counts, {}
        self.fixed: dict[str, str] = {}
        for s in sorted(counts):
            for t in self._links(s):
                self._union(s, t)
        classes: dict[str, list[str]] = {}
        for s in sorted(self.up):
            classes.setdefault(self._find(s), []).append(s)
        self.by_script: dict[str, dict[str, str]] = {}
        for members in classes.values():
            if any(m in ("", " ") for m in members):
                self.fixed |= {m: "" if "" in members else " " for m in members if m not in ("", " ")}
                continue
            best: dict[str, str] = {}
            for m in sorted((m for m in members if self._formed(m)), key=lambda m: (-counts.get(m, 0), m)):
                best.setdefault(self._script(m), m)
            for m in members:
                self.by_script[m] = best
                own = best.get(self._script(m))
                if own is not None and own != m and not self._formed(m):
                    self.fixed[m] = own
        self.auto = ahocorasick.Automaton()
        for m, rep in self.fixed.items():
            self.auto.add_word(m, (len(m), m, rep))
        if len(self.auto):
            self.auto.make_automaton()

    @staticmethod
    def _formed(s: str) -> bool:
        return unicodedata.is_normalized("NFC", s) and not any(c in WIDTH or c in INVISIBLE or c in BLANKS or c in SAME for c in s)

    @staticmethod
    def _script(s: str) -> str:
        return next(filter(None, map(script, unicodedata.normalize("NFKD", s))), "")

    @staticmethod
    def _links(s: str) -> Iterator[str]:
        if len(s) == 1:
            if s in INVISIBLE:
                yield ""
                return
            if s in BLANKS:
                yield " "
                return
            if s in WIDTH:
                yield WIDTH[s]
        if (c := unicodedata.normalize("NFC", _plain(s))) != s:
            yield c
        parts = unicodedata.normalize("NFD", s)
        if (k := script(parts[0])) in LIKE and parts[0] in LIKE[k]:
            yield unicodedata.normalize("NFC", LIKE[k][parts[0]] + parts[1:])

    def _find(self, s: str) -> str:
        self.up.setdefault(s, s)
        while self.up[s] != s:
            self.up[s] = s = self.up[self.up[s]]
        return s

    def _union(self, a: str, b: str) -> None:
        a, b = self._find(a), self._find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def rewrite(self, text: str) -> str:
        """Greedy: of the matches at a place the longest wins; then each mixed word takes the representatives of one script."""
        out, at = [], 0
        best: dict[int, tuple[int, str, str]] = {}
        for end, (n, m, rep) in self.auto.iter(text) if len(self.auto) else ():
            if n > best.get(end - n + 1, (0,))[0]:
                best[end - n + 1] = (n, m, rep)
        for start in sorted(best):
            n, m, rep = best[start]
            if start < at or (n == 1 and m in INVISIBLE and _held(text, start, m)):
                continue
            out += (text[at:start], rep)
            at = start + n
        text = "".join((*out, text[at:]))
        if not unicodedata.is_normalized("NFC", text):  # marks that a dropped character had kept apart
            text = unicodedata.normalize("NFC", text)
        return _WORD.sub(self._word, text) if _FOREIGN.search(text) else text

    def _word(self, m: re.Match) -> str:
        word = m.group()
        if not _FOREIGN.search(word):
            return word
        parts = unicodedata.normalize("NFD", word)
        to = reads_as("".join(c for c in parts if not unicodedata.combining(c)))
        if to is None:
            return word
        letters = re.findall(f".[{_MARKS}]*", word, re.S)
        return unicodedata.normalize("NFC", "".join(self.by_script.get(x, {}).get(to) or _one(x, to) for x in letters))


def _one(letter: str, to: str) -> str:
    parts = unicodedata.normalize("NFD", letter)
    return "".join(c if (k := script(c)) in (None, to) else TO[to, k].get(c, c) for c in parts)
