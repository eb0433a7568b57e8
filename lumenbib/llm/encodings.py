"""Text that was decoded with the wrong character encoding: which records are, and what they said.

Method: characters are mapped back to the bytes of a legacy encoding, a byte-structure automaton finds the maximal
well-formed multibyte spans, and only those spans are decoded; this is repeated while it finds any, as a text may have
been decoded wrongly more than once. Bytes of a single-byte encoding have no such structure: where none is left,
words are mapped back and read in the other encoding, and taken if they turn into words of the corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.parallel import spread, spread_groups

#: Encodings in which UTF-8 bytes may have been read (fixed values); cp1252 stands for latin-1, too.
FAMILIES = ["cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman"]

#: (what the bytes were in, what they were read in) for single-byte encodings, commoner ones first (fixed values).
PAIRS = [
    *[("cp1251", w) for w in ("cp1252", "koi8_r", "mac_roman", "cp866", "cp850", "cp437", "cp1250")],
    *[("koi8_r", w) for w in ("cp1251", "cp1252", "cp866", "mac_roman", "cp850", "cp437")],
    *[("cp866", w) for w in ("cp1251", "cp1252", "koi8_r", "mac_roman", "cp850", "cp437")],
    *[("cp1252", w) for w in ("cp1252", "cp850", "mac_roman", "cp437", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_2")],
    *[("cp1250", w) for w in ("cp1252", "iso8859_2", "cp1251", "cp850", "mac_roman", "cp437")],
    *[("iso8859_2", w) for w in ("cp1252", "cp1250", "cp1251", "cp850", "mac_roman", "cp437")],
    *[("mac_roman", w) for w in ("cp1252", "cp850", "cp437", "cp1250", "cp1251")],
    *[(t, w) for t in ("cp850", "cp437", "cp852") for w in ("cp1252", "cp1250", "mac_roman", "cp1251")],
]

#: Byte ranges of a well-formed multibyte character by its first byte: (first, following, following, following).
_SHAPES = [
    ((0xC2, 0xDF), (0x80, 0xBF)),
    ((0xE0, 0xE0), (0xA0, 0xBF), (0x80, 0xBF)),
    ((0xE1, 0xEC), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xED, 0xED), (0x80, 0x9F), (0x80, 0xBF)),
    ((0xEE, 0xEF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF0, 0xF0), (0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF1, 0xF3), (0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF4, 0xF4), (0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF)),
]
_TOKEN = re.compile(r"[^ \t\r\n\x0b\x0c]+")
_SPACED = re.compile("([ÂÃĂ]|[á-ï][¡-¿€-™]) (?=[ \\d%-]|$)")
#: Marks that stand in clean texts, inside words and between or beside them (fixed values).
_INNER, _BESIDE = set("’‑–—\xa0\xad\u202f\u200b"), set("‘“”„…«»‹›°²™®©€−≤≥≈→§")
#: Words of one letter that are no ASCII in the languages here (fixed values).
_ONE_LETTER = set("àèéòóíаявиксоу")
_EDGE = ".,;:!?()[]\"'«»“”„"
#: How much more frequent an unlikely word must be than one it may be reread as, to be taken for right.
TIMES = 10
_QUOTES = "“”„\"'«»‘’`"


@lru_cache(maxsize=None)
def to_bytes(encoding: str) -> dict[int, int]:
    """Code point -> byte for what is no ASCII; bytes the encoding leaves open are read as control characters."""
    table = {}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            table[b] = b
    if encoding == "cp1252":
        for b in range(128, 160):
            table.setdefault(b, b)
    return table


@lru_cache(maxsize=None)
def automaton(encoding: str) -> re.Pattern:
    """The automaton over the characters that stand for the bytes, so that a text need not be mapped to be searched."""
    table = to_bytes(encoding)

    def chars(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(chr(c)) for c, b in sorted(table.items()) if lo <= b <= hi) + "]"

    return re.compile("(?:" + "|".join("".join(chars(*r) for r in shape) for shape in _SHAPES) + ")+")


@lru_cache(maxsize=None)
def start_of(encoding: str) -> re.Pattern:
    """A first and a following byte side by side, which every span begins with: quicker to search for than whole spans."""
    table = to_bytes(encoding)
    first = "".join(re.escape(chr(c)) for c, b in sorted(table.items()) if any(x[0][0] <= b <= x[0][1] for x in _SHAPES))
    following = "".join(re.escape(chr(c)) for c, b in sorted(table.items()) if 0x80 <= b <= 0xBF)
    return re.compile(f"[{first}][{following}]")


def _script(ch: str) -> str:
    """'l' or 'c' of a Latin or Cyrillic letter, 'e' of an East Asian sign, '' of anything else."""
    c = ord(ch)
    if 0x3040 <= c <= 0x30FF or 0x4E00 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3:
        return "e"
    if not ch.isalpha():
        return ""
    return "c" if 0x400 <= c <= 0x52F else "l" if c < 0x250 else ""


def _plausible(ch: str) -> bool:
    c = ord(ch)
    return (
        0x80 <= c <= 0x17F
        or c in (0x192, 0x218, 0x219, 0x21A, 0x21B, 0x2C6, 0x2DC, 0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x30A, 0x30B, 0x30C, 0x327, 0x328)
        or 0x391 <= c <= 0x3C9
        or 0x401 <= c <= 0x45F
        or c in (0x490, 0x491, 0xFB01, 0xFB02, 0xF8FF, 0xFE0F, 0xFEFF, 0xFFFD)
        or 0x2000 <= c <= 0x22FF
        or 0x2320 <= c <= 0x2321
        or 0x2500 <= c <= 0x27BF
        or 0x3000 <= c <= 0x30FF
        or 0x4E00 <= c <= 0x9FFF
        or 0xAC00 <= c <= 0xD7A3
        or 0x1F300 <= c <= 0x1FAFF
    )


def _cyrillic(ch: str) -> bool:
    return "Ѐ" <= ch <= "џ"


@lru_cache(maxsize=4)
def _places(text: str, encoding: str) -> tuple[list[int], list[int]]:
    """Where white space stands in text, and Cyrillic letters that are in no span of the encoding."""
    inside = {i for m in automaton(encoding).finditer(text) for i in range(m.start(), m.end())} if encoding == "cp1251" else set()
    return [m.start() for m in re.finditer(r"[ \t\r\n]", text)], [m.start() for m in re.finditer("[\u0400-\u045f]", text) if m.start() not in inside]


def _cyrillic_around(text: str, encoding: str, a: int, b: int) -> bool:
    """Whether the token that text[a:b] stands in has a Cyrillic letter outside of all spans."""
    gaps, letters = _places(text, encoding)
    i = bisect_left(gaps, a)
    start = gaps[i - 1] + 1 if i else 0
    j = bisect_left(gaps, b)
    end = gaps[j] if j < len(gaps) else len(text)
    return bisect_left(letters, a) > bisect_left(letters, start) or bisect_left(letters, end) > bisect_left(letters, b)


def spans(text: str, encoding: str) -> list[tuple[int, int, str]]:
    """(start, end, decoded) of the maximal well-formed multibyte spans of text that decode to plausible characters.

    A span that is all there is between two quotation marks is being shown, not garbled, and is left out.
    """
    table = to_bytes(encoding)
    out = []
    for m in automaton(encoding).finditer(text):
        start = at = m.start()
        decoded = bytes([table[ord(c)] for c in m.group()]).decode("utf-8")
        run: list[str] = []
        # cut at characters that no text here has
        for ch in decoded + "\0":
            if ch != "\0" and _plausible(ch):
                run.append(ch)
            else:
                if run and _fits(text, start, at, run, encoding):
                    out.append((start, at, "".join(run)))
                run = []
                start = at + len(ch.encode("utf-8"))
            at += len(ch.encode("utf-8"))
    return out


def _fits(text: str, a: int, b: int, run: list[str], encoding: str) -> bool:
    """Whether the span may be garbled: not shown between quotation marks, and of one script with what it touches."""
    left, right = text[a - 1] if a else " ", text[b] if b < len(text) else " "
    if left in _QUOTES and right in _QUOTES and len(run) <= 2:
        return False
    if "\u0300" <= run[0] <= "\u036f" and not ("a" <= left.lower() <= "z"):
        return False
    if encoding != "cp1251" and (_script(left) == "c" or _script(right) == "c"):
        return False
    scripts = {_script(ch) for ch in run}
    if "e" in scripts:
        if any(c > "\x7f" and _script(c) in ("l", "c") for c in left + right) or _cyrillic_around(text, encoding, a, b):
            return False
        if len(run) == 1 and not ("\u3040" <= run[0] <= "\u30ff" or left.isdigit() or right.isdigit()):
            return False
    for ch, near in ((run[0], left), (run[-1], right)):
        mine, its = _script(ch), _script(near)
        if mine and its and mine != its:
            return False
    return True


def _strong(text: str, encoding: str, span: tuple[int, int, str]) -> bool:
    a, _, decoded = span
    if encoding != "cp1251" or len(decoded) > 1 or len(decoded.encode("utf-8")) > 2:
        return True
    return not _cyrillic(decoded) and not (a and _cyrillic(text[a - 1]))


@lru_cache(maxsize=None)
def any_start() -> re.Pattern:
    """What `start_of` of any encoding finds, and more: one search for the many texts that have nothing of the kind."""
    pairs = [start_of(e).pattern[1:-1].split("][") for e in FAMILIES]
    return re.compile("[" + "".join(f for f, _ in pairs) + "][" + "".join(n for _, n in pairs) + "]")


def repair_once(text: str) -> str | None:
    """One round over multibyte spans, in the encoding whose spans cover most; None if there are none."""
    if not any_start().search(text) and not _SPACED.search(text):
        return None
    best, chosen = 0, None
    for e in FAMILIES:
        spaced = e in ("cp1252", "cp1250") and _SPACED.search(text)
        if not spaced and not start_of(e).search(text):
            continue
        found = spans(text, e)
        if found and spaced:
            # where a no-break space, the second byte of some characters, has since become a plain one
            found = spans(_SPACED.sub("\\1\xa0", text), e)
        if found and any(_strong(text, e, s) for s in found):
            size = sum(b - a for a, b, _ in found)
            if size > best:
                best, chosen = size, found
    if chosen is None:
        return None
    out, at = [], 0
    for a, b, decoded in chosen:
        out += [text[at:a], decoded]
        at = b
    return "".join([*out, text[at:]])


def repair_multibyte(text: str) -> str:
    """Rounds of repair_once until no span is left; each makes the text shorter."""
    while True:
        nxt = repair_once(text)
        if nxt is None or len(nxt) >= len(text):
            return text
        text = nxt


class WordModel:
    """Character trigrams of tokens, lower-cased, with digits as 0; unseen ones back off to bigrams and characters."""

    def __init__(self, texts: list[str], usual: frozenset[str] = frozenset()):
        self.usual = usual
        tokens, alone = Counter(), Counter()
        for t in texts:
            found = _TOKEN.findall(t)
            tokens.update(found)
            alone.update(single_letters(found))
        self.c1, self.c2, self.c3 = grams_of(tokens)
        self.alone, self.texts = alone, len(texts)
        self._sum_up()

    def _sum_up(self) -> None:
        self.h2 = Counter()
        for (a, b), n in self.c2.items():
            self.h2[a] += n
        self.n = sum(self.c1.values())
        self._cache: dict[str, float] = {}

    def with_counts(self, counts: dict[int, Counter], usual: frozenset[str] = frozenset()) -> WordModel:
        """The model of this one's texts and those of `gram_counts`."""
        m = WordModel([], usual)
        m.c1, m.c2, m.c3, m.alone = (Counter(c) for c in (self.c1, self.c2, self.c3, self.alone))
        m.c1.update(counts[1])
        m.c2.update({tuple(k): n for k, n in counts[2].items()})
        m.c3.update({tuple(k): n for k, n in counts[3].items()})
        m.alone.update(counts[4])
        m.texts = self.texts + counts[0][""]
        m._sum_up()
        return m

    @staticmethod
    def _norm(word: str) -> str:
        return "\x02\x02" + re.sub(r"\d", "0", word.lower()) + "\x03"

    def score(self, word: str) -> float:
        """Log-probability of a token; capitals after small letters and a change of script cost extra."""
        got = self._cache.get(word)
        if got is None:
            from math import log

            x, got = self._norm(word), 0.0
            for a, b, c in zip(x, x[1:], x[2:]):
                p1 = (self.c1[c] + 0.1) / (self.n + 200)
                p2 = (self.c2[b, c] + 5 * p1) / (self.h2[b] + 5)
                got += log((self.c3[a, b, c] + 5 * p2) / (self.c2[a, b] + 5))
            scripts = "".join(map(_script, word))
            got -= 6.0 * (("lc" in scripts) + ("cl" in scripts))
            got -= 3.0 * sum(p.islower() and q.isupper() for p, q in zip(word, word[1:])) + 4.0 * (len(word) == 1 and word.isupper())
            if len(self._cache) < 500_000:
                self._cache[word] = got
        return got


def single_letters(tokens: list[str]) -> set[str]:
    """Characters that stand alone among the tokens of a text and aren't ASCII."""
    return {w.strip(".,;:()") for w in tokens if not w.isascii() and len(w.strip(".,;:()")) == 1}


def grams_of(tokens: dict[str, int]) -> tuple[Counter, Counter, Counter]:
    """How often characters, bigrams and trigrams occur in tokens that occur so often."""
    c1, c2, c3 = Counter(), Counter(), Counter()
    for w, n in tokens.items():
        x = WordModel._norm(w)
        for a in x:
            c1[a] += n
        for k in zip(x, x[1:]):
            c2[k] += n
        for k in zip(x, x[1:], x[2:]):
            c3[k] += n
    return c1, c2, c3


@lru_cache(maxsize=None)
def _reread(was: str, read: str) -> dict[int, str | None]:
    """Translation of characters read in one encoding into what the other has at their bytes; None where it has nothing."""
    out: dict[int, str | None] = {}
    for c, b in to_bytes(read).items():
        try:
            out[c] = bytes([b]).decode(was)
        except UnicodeDecodeError:
            out[c] = None
    return {c: v for c, v in out.items() if v != chr(c)}


@lru_cache(maxsize=1 << 18)
def reread_token(token: str, was: str, read: str) -> str | None:
    """The token read in the right encoding; None if it holds a character that can't have come from the wrong one."""
    table, known = _reread(was, read), to_bytes(read)
    if any(c > "\x7f" and (ord(c) not in known or table.get(ord(c), "") is None) for c in token):
        return None
    return token.translate(table)


@lru_cache(maxsize=1 << 16)
def _clean(token: str) -> bool:
    """Whether a token is ASCII but for marks at their usual places."""
    for i, c in enumerate(token):
        if c > "\x7f" and c not in _INNER and not (c in _BESIDE and not (0 < i < len(token) - 1 and token[i - 1].isalpha() and token[i + 1].isalpha())):
            return False
    return True


def _seen(old: str, new: str, model: WordModel) -> bool:
    """Whether the model knows most of the changed characters between their neighbours."""
    x = model._norm(new)
    at = [i + 2 for i, (p, q) in enumerate(zip(old, new)) if p != q]
    known = sum((x[i - 1], x[i], x[i + 1]) in model.c3 for i in at)
    return known == len(at) if len(at) < 3 else known >= 0.7 * len(at)


def _helps(old: str, new: str, model: WordModel, gain: float, cyrillic: float) -> float:
    """By how much a token improves, 0 if it doesn't count: it must become a likely word, or a word of one letter in the text's script."""
    if len(new) == 1:
        usual = model.alone[old] > max(1, model.texts // 2000) or old.lower() in _ONE_LETTER
        fits = new in _ONE_LETTER and old.isalpha() and not usual and (cyrillic > 0.1 if _cyrillic(new) else cyrillic < 0.5)
        return gain + 1.0 if fits else 0.0
    up = model.score(new) - model.score(old)
    return up if up > gain and sum(c.isalpha() for c in new) > 1 and _seen(old, new, model) else 0.0


def _odd(token: str, model: WordModel, odd: float = -4.5) -> bool:
    """Whether a token is an unlikely word, holds control characters or has capitals inside."""
    return model.score(token) < odd * (len(token) + 1) or bool(re.search("[\x80-\x9f]", token)) or any(a.islower() and b.isupper() and b > "\x7f" for a, b in zip(token, token[1:]))


def _single_letters(old: list[str], new: list[str], was: str, read: str) -> list[str]:
    """new, with words of one letter that are words in Latin script, too, read as Cyrillic between words that were."""

    def near(at: range) -> bool | None:
        # the next word of the language; names and abbreviations are the same in all
        i = next((i for i in at if sum(map(str.isalpha, old[i])) > 1 and not (old[i].isascii() and old[i].strip(_EDGE)[:1].isupper())), None)
        return None if i is None else old[i] != new[i] and any(map(_cyrillic, new[i]))

    out = list(new)
    for i, w in enumerate(old):
        if w == new[i] and not w.isascii() and len(w.strip(_EDGE)) == 1:
            x = reread_token(w, was, read)
            c = (x or "").strip(_EDGE)
            if len(c) == 1 and _cyrillic(c) and c.lower() in _ONE_LETTER:
                sides = {near(range(i - 1, -1, -1)), near(range(i + 1, len(old)))}
                if True in sides and False not in sides:
                    out[i] = x
    return out


def repair_bytes(text: str, model: WordModel, gain: float = 6.0, odd: float = -4.5, letters: bool = True) -> str | None:
    """Tokens read anew in one other single-byte encoding, the one that helps the text most; None if none helps.

    A token counts if it becomes a likely word and its log-probability grows by more than `gain`; only tokens that are
    below `odd` per character, hold control characters or have capitals inside are tried (without `letters`, none of one letter).
    """
    words = _TOKEN.findall(text)
    tokens = {t for t in set(words) if not t.isascii() and not _clean(t) and t.strip(_EDGE) not in model.usual}
    bad = [t for t in tokens if (letters or len(t) > 1) and _odd(t, model, odd)]
    if not bad:
        return None
    best, chosen = 0.0, None
    cyrillic = sum(map(_cyrillic, text)) / max(1, sum(map(str.isalpha, text)))
    for was, read in PAIRS:
        total = 0.0
        for t in bad:
            new = reread_token(t, was, read)
            if new is not None and new != t:
                total += _helps(t, new, model, gain, cyrillic)
        if total > best + 1e-9:
            best, chosen = total, (was, read)
    if chosen is None:
        return None
    # all tokens of the text in that encoding pair, as garbled ones may look harmless one by one
    swap = {}
    for t in {t for t in set(words) if not t.isascii() and t.strip(_EDGE) not in model.usual}:
        new = reread_token(t, *chosen)
        if new is None or new == t:
            continue
        if len(t) == 1 and new in _ONE_LETTER and t not in _ONE_LETTER and t.isalpha() and best > 20 and model.alone[t] <= max(1, model.texts // 2000) + 2 * t.isupper() * _cyrillic(t) * model.texts:
            swap[t] = new
        elif len(t) == 1 and not t.isalpha() and new.lower() in _ONE_LETTER and best > 20:  # a sign that stands alone like a word
            swap[t] = new
        elif _helps(t, new, model, 1.0, cyrillic) or model.score(new) - model.score(t) > 1.0 and not any(q.isalpha() for p, q in zip(t, new) if p != q):
            swap[t] = new
    out = iter(_single_letters(words, [swap.get(w, w) for w in words], *chosen))
    return _TOKEN.sub(lambda m: next(out), text)


def count_words(texts: list[str]) -> dict[str, int]:
    """In how many of the texts each word of more than a letter occurs that isn't ASCII; `word_counts` does so for a table."""
    return Counter(w for t in texts if not t.isascii() for w in {w.strip(_EDGE) for w in _TOKEN.findall(t) if not w.isascii()} if len(w) > 1)


def least_usual(docs: int) -> int:
    """In how many of so many texts a word must occur to be frequent."""
    return max(4, docs // 1000)


def _learnt(seeds: list[str] | tuple[WordModel, frozenset[str]]) -> tuple[WordModel, frozenset[str]]:
    """The model of the seeds and their words, which may have been counted already."""
    return seeds if isinstance(seeds, tuple) else (WordModel(seeds), frozenset(count_words(seeds)))


def usual_words(counts: dict[str, int], docs: int, seeds: list[str] | tuple[WordModel, frozenset[str]], times: int = TIMES) -> frozenset[str]:
    """The frequent words that stand as they are, whatever they might be read as.

    Frequency alone doesn't make a word clean, as a source or a family of copies may be garbled as a whole: the word must
    be a likely one by the seeds, or `times` as frequent as any word it may be reread as, with no reading of two or more
    characters in it that turns an unlikely word into a likely one.
    """
    clean, known = _learnt(seeds)

    def stands(w: str) -> bool:
        if w in known or not _odd(w, clean):
            return True
        for pair in PAIRS:
            x = reread_token(w, *pair)
            if x is None or x == w:
                continue
            if x in known or counts.get(x, 0) * times > counts[w]:
                return False
            several = len(x) == len(w) and sum(p != q and q.isalpha() for p, q in zip(w, x)) > 1
            if several and not _odd(x, clean) and _helps(w, x, clean, 6.0, 0.0):
                return False
        return True

    return frozenset(w for w, n in counts.items() if n >= least_usual(docs) and stands(w))


def is_plain(text: str, model: WordModel) -> bool:
    """Whether nothing is found to mend in text."""
    return text.isascii() or (repair_once(text) is None and repair_bytes(text, model, letters=False) is None)


def fit_words(seeds: list[str], texts: list[str], usual: frozenset[str] | None = None) -> WordModel:
    """A model of seeds, which are clean, and of those texts that nothing is found to mend in; `train` fits one in Spark.

    usual: words left alone, by default those of `usual_words` in texts. A text is judged by a model of the seeds, then by
    one of the seeds and the other half of the texts, never by one that has learnt it.
    """
    if usual is None:
        usual = usual_words(count_words(texts), len(texts), seeds)
    first = WordModel(seeds, usual)
    halves = [[t for t in texts if half_of(t) == k and is_plain(t, first)] for k in (0, 1)]
    models = [WordModel(seeds + h, usual) for h in halves]
    return WordModel(seeds + [t for k in (0, 1) for t in halves[k] if is_plain(t, models[1 - k])], usual)


def half_of(text: str) -> int:
    """Which half of the texts a text is in."""
    return crc32(text.encode()) & 1


def gram_counts(df: DataFrame, models: list[WordModel] = [], words: bool = False) -> list[dict[int, Counter]]:
    """For either half of the texts (one column, not null) that are plain by the models, counts by kind: 0 texts, 1 to 3
    characters, bigrams and trigrams of tokens as strings, 4 letters that stand alone, 5 (with words) those of `count_words`.

    models: one for all, and behind it one that judges half 0 and one that judges half 1. Each task counts its tokens and
    sends what they hold; what is collected is bounded by the grams there are, not by the texts.
    """
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judges = shared.value
        held = [(Counter(), Counter(), Counter(), Counter()) for _ in (0, 1)]

        def sent() -> Iterator[pd.DataFrame]:
            for half, (texts, tokens, alone, own) in enumerate(held):
                c1, c2, c3 = grams_of(tokens)
                rows = [(half, kind, "".join(k), n) for kind, c in ((0, texts), (1, c1), (2, c2), (3, c3), (4, alone), (5, own)) for k, n in c.items()]
                yield pd.DataFrame(rows, columns=["half", "kind", "gram", "n"])
                for c in held[half]:
                    c.clear()

        for f in batches:
            for t in f.iloc[:, 0]:
                half = half_of(t)
                if all(is_plain(t, m) for m in (judges[:1] + judges[1 + half : 2 + half])):
                    texts, tokens, alone, own = held[half]
                    found = _TOKEN.findall(t)
                    texts[""] += 1
                    tokens.update(found)
                    if not t.isascii():
                        alone.update(single_letters(found))
                        if words:
                            own.update(count_words([t]))
            if max(len(h[1]) for h in held) > 300_000:
                yield from sent()
        yield from sent()

    got = df.mapInPandas(run, "half int, kind int, gram string, n bigint").groupBy("half", "kind", "gram").agg(F.sum("n").alias("n")).toPandas()
    out: list[dict[int, Counter]] = [{k: Counter() for k in range(6)} for _ in (0, 1)]
    for half, kind, gram, n in zip(got["half"], got["kind"], got["gram"], got["n"]):
        out[half][kind][gram] = int(n)
    return out


def _shown(text: str, at: int) -> bool:
    return 0 < at < len(text) - 1 and text[at - 1] in _QUOTES and text[at + 1] in _QUOTES


def restore(text: str, model: WordModel | None) -> tuple[str, bool]:
    """(restored text, whether it lost characters for good); the text itself if nothing was garbled."""
    if text.isascii():
        return text, False
    out = repair_multibyte(text)
    seen = {out}
    while model:
        nxt = repair_bytes(out, model)
        if nxt is None:
            break
        out = repair_multibyte(nxt)
        if out in seen:
            break
        seen.add(out)
    lost = any(not _shown(out, m.start()) for m in re.finditer("\ufffd", out))
    return out, lost


def word_counts(documents: DataFrame, docs: int, seeds: list[str] | tuple[WordModel, frozenset[str]]) -> dict[str, int]:
    """In how many distinct documents (one text column) the words of `count_words` occur, counted in Spark over all of them.

    Left out are words too rare to be usual or to speak against a usual one; what is collected is bounded by that. Words
    are counted in two passes and texts are never shuffled: the first counts documents, copies and all; of the frequent
    words that seeds make unlikely, and of what these may be reread as, the second counts distinct texts by their hash.
    """
    edge = "[" + re.escape(_EDGE) + "]+"
    text = F.col(documents.columns[0])
    some = documents.dropna().filter(text.rlike("[^\\x00-\\x7f]"))
    words = F.filter(F.split(text, "[ \\t\\r\\n\\x0b\\x0c]+"), lambda w: w.rlike("[^\\x00-\\x7f]"))
    words = F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, f"^{edge}|{edge}$", "")))
    least = least_usual(docs)
    rows = some.select(F.explode(words).alias("w")).filter(F.length("w") > 1).groupBy("w").agg(F.count("*").alias("n"))
    counts = {r["w"]: r["n"] for r in rows.filter(F.col("n") * TIMES >= least).collect()}
    clean, known = _learnt(seeds)
    odd = {w for w, n in counts.items() if n >= least and w not in known and _odd(w, clean)}
    odd |= {x for w in odd for pair in PAIRS for x in [reread_token(w, *pair)] if x in counts}
    if odd:
        wanted = F.broadcast(documents.sparkSession.createDataFrame([(w,) for w in sorted(odd)], "w string"))  # bounded as counts is
        pairs = some.select(F.xxhash64(text).alias("h"), F.explode(words).alias("w")).join(wanted, "w").select("w", "h").distinct()
        counts.update({r["w"]: r["n"] for r in pairs.groupBy("w").agg(F.count("*").alias("n")).collect()})
    return counts


def train(samples: DataFrame, documents: DataFrame) -> WordModel:
    """The word model of all samples (one text column, as in documents; samples are clean) and of all documents that nothing
    is found to mend in, copies of one text counting once: `fit_words`, counted in Spark. Which words are usual is counted
    over all documents, too."""
    documents = documents.dropna()
    docs = documents.count()
    seeds, known = WordModel([]), frozenset()
    for half in gram_counts(spread(samples.dropna()), words=True):
        seeds, known = seeds.with_counts(half), known | frozenset(half[5])
    usual = usual_words(word_counts(documents, docs, (seeds, known)), docs, (seeds, known))
    seeds.usual = usual
    texts = spread_groups(documents, documents.columns[0]).distinct()  # no more shuffle for that
    halves = [seeds.with_counts(h, usual) for h in gram_counts(texts, [seeds])]
    model = seeds
    for half in gram_counts(texts, [seeds, *halves[::-1]]):
        model = model.with_counts(half, usual)
    return model


def restore_documents(df: DataFrame, model: WordModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, restored, lost) of the rows whose text, or part of it, was decoded with a wrong encoding; other rows give none.

    lost says that the decoding destroyed characters; restored is then as far as it could be got back. Whole texts are
    read; null, empty and ASCII texts are no case; equal texts have equal results; no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<restored:string,lost:boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in batches:
            out = []
            for t in s:
                restored, lost = restore(t, m)
                out.append((restored, lost) if lost or restored != t else (None, None))
            yield pd.DataFrame(out, columns=["restored", "lost"])

    run = run.asNondeterministic()  # or a filter on the result would be pushed below and evaluate it twice
    # plain ASCII never leaves the JVM
    some = spread(df.select(id_col, text_col).filter(F.col(text_col).rlike("[^\\x00-\\x7f]"))).select(F.col(id_col), run(F.col(text_col)).alias("r"))
    return some.select(id_col, "r.restored", "r.lost").filter("restored is not null")


def found(df: DataFrame, model: WordModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """p8_found's rows: (doc_id, restored_md5), '' where characters are lost for good."""
    r = restore_documents(df, model, id_col, text_col)
    return r.select(id_col, F.when(F.col("lost"), "").otherwise(F.md5("restored")).alias("restored_md5"))
