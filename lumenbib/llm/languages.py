"""A language, with a confidence, for every document and every segment of one language in it.

Method: multinomial naive Bayes over hashed character n-grams. The log-probability matrix (languages x 2^bits) is fitted
on labelled sentences, a bounded sample, and broadcast; a batch of sentences is scored as one sparse product in numpy.
Sentences are scored one by one, neighbouring sentences of one language are joined to segments, and what stands in
quotation marks or brackets, where foreign terms are quoted, doesn't speak for its sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.parallel import spread

#: Names and codes of the languages, besides the two-letter code (fixed values).
NAMES = {
    "en": "eng english anglais englisch inglés inglese inglês angielski английский",
    "de": "deu ger german deutsch allemand alemán tedesco alemão niemiecki немецкий",
    "fr": "fra fre french français francais französisch francés francese francês francuski французский",
    "es": "spa spanish español espanol castellano espagnol spanisch spagnolo espanhol hiszpański испанский",
    "pt": "por portuguese português portugues portugais portugiesisch portugués portoghese portugalski португальский",
    "it": "ita italian italiano italien italienisch włoski итальянский",
    "ru": "rus russian русский russe russisch ruso russo rosyjski",
    "pl": "pol polish polski polonais polnisch polaco polacco polonês польский",
}
#: What may stand before the end of a sentence without ending it (fixed values).
ABBREVIATIONS = "al dr prof mr mrs ms st vs etc cf fig figs eq no nr vol pp bzw usw ca vgl abb ggf z.b d.h u.a e.g i.e sr sra dra p.ej núm nº sig dott ecc г гг др т.е т.д рис см им np tj tzn itd str rys por".split()

_SPLIT = re.compile(r"(?<=[.!?…])[\"'”»’)\]]*\s+|[\r\n]+")
_LAST = re.compile(r"([\w.]+)\.[\"'”»’)\]]*\s*$")
_QUOTED = re.compile(r"«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|\"[^\"]*\"|\([^()]*\)|\[[^\[\]]*\]")
_NOISE = re.compile(r"https?://\S+|\b\w*\d\w*\b|[^\w\s'’-]|_")
_CODE = re.compile(r"\b[A-ZÀ-Þ]{2,}\w*\b")
_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class Model:
    """Log-probabilities (languages x buckets), the languages' names, and the n-gram lengths."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bits: int
    sizes: tuple[int, ...]


def sentences(text: str) -> list[str]:
    """The sentences of text, in order; a part that ends in an abbreviation or starts in lower case goes on with the next."""
    out: list[str] = []
    pos = 0
    for m in _SPLIT.finditer(text):
        left, rest = text[pos : m.end()], text[m.end() : m.end() + 1]
        last = _LAST.search(left)
        newline = "\n" in m.group() or "\r" in m.group()
        if not newline and (rest.islower() or rest.isdigit() or last and (last.group(1).lower() in ABBREVIATIONS or len(last.group(1)) == 1 and last.group(1).isalpha())):
            continue
        if left.strip():
            out.append(left)
        pos = m.end()
    if text[pos:].strip():
        out.append(text[pos:])
    return out


@lru_cache(maxsize=1 << 16)
def plain(sentence: str) -> str:
    """The sentence as it is scored: lower case, without quotations, brackets, codes and numbers (unless nothing else is there)."""
    for cut in (lambda s: _CODE.sub(" ", _QUOTED.sub(" ", s)), lambda s: s):
        x = _SPACE.sub(" ", _NOISE.sub(" ", cut(sentence))).strip().lower()
        if len(x) > 3:
            return f" {x} "
    return ""


def _grams(texts: list[str], bits: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the text) of every n-gram of the texts, hashed together; no n-gram spans two texts."""
    a = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    buckets, owners = [], []
    for n in sizes:
        m = len(a) - n + 1
        if m <= 0:
            continue
        h = np.full(m, (0x9E3779B97F4A7C15 + n) & (2**64 - 1), dtype=np.uint64)
        for i in range(n):
            h = (h ^ a[i : m + i]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        inside = of[:m] == of[n - 1 :]
        buckets.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)[inside])
        owners.append(of[:m][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def fit(labelled: list[tuple[str, str]], bits: int = 18, sizes: tuple[int, ...] = (1, 2, 3, 4), alpha: float = 0.05) -> Model:
    """Fit on (language, sentence) pairs; languages have equal priors, buckets are smoothed by alpha."""
    langs = tuple(sorted({x for x, _ in labelled}))
    counts = np.full((len(langs), 1 << bits), alpha)
    for i, lang in enumerate(langs):
        texts = [plain(t) for x, t in labelled if x == lang]
        for at in range(0, len(texts), 1000):
            counts[i] += np.bincount(_grams(texts[at : at + 1000], bits, sizes)[0], minlength=1 << bits)
    return Model(langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32), bits, sizes)


def score(model: Model, texts: list[str], chunk: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language or -1, confidence) of each sentence: the n-grams of many are one sparse product.

    Confidence is the posterior after dividing the log-likelihood by the root of the number of n-grams, since
    overlapping n-grams aren't independent.
    """
    clean = [plain(t) for t in texts]
    best, sure = np.full(len(texts), -1), np.zeros(len(texts))
    at = 0
    while at < len(clean):
        end, size = at, 0
        while end < len(clean) and (end == at or size + len(clean[end]) <= chunk):
            size += len(clean[end])
            end += 1
        bucket, owner = _grams(clean[at:end], model.bits, model.sizes)
        n = np.bincount(owner, minlength=end - at)
        total = np.stack([np.bincount(owner, weights=w[bucket], minlength=end - at) for w in model.weights], axis=1)
        some = n > 0
        z = total[some] / np.sqrt(n[some])[:, None]
        z = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        rows = at + np.flatnonzero(some)
        best[rows] = total[some].argmax(1)
        sure[rows] = (z / z.sum(1, keepdims=True)).max(1) if len(z) else 0
        at = end
    return best, sure


def _runs(model: Model, parts: list[str], best: np.ndarray, sure: np.ndarray) -> list[tuple[int, str, float, int, int]]:
    known = np.flatnonzero(best >= 0)
    if not len(known):
        return []
    best[: known[0]], sure[: known[0]] = best[known[0]], sure[known[0]]
    for i in range(known[0] + 1, len(best)):
        if best[i] < 0:
            best[i], sure[i] = best[i - 1], sure[i - 1]
    out, pos, start = [], 0, 0
    weight: list[tuple[float, int]] = []
    for i, part in enumerate(parts):
        weight.append((float(sure[i]), len(part)))
        pos += len(part)
        if i + 1 == len(parts) or best[i + 1] != best[i]:
            size = sum(n for _, n in weight)
            out.append((len(out) + 1, model.languages[best[i]], sum(c * n for c, n in weight) / size, start, pos))
            weight, start = [], pos
    return out


def segments(model: Model, texts: list[str | None]) -> list[list[tuple[int, str, float, int, int]]]:
    """Of each text (number from 1, language, confidence, start, end) of the longest runs of sentences in one language.

    A sentence without letters goes with the one before it (the first ones with the one after). Null and blank texts have none.
    """
    parts = [sentences(t) if t else [] for t in texts]
    best, sure = score(model, [s for p in parts for s in p])
    ends = np.cumsum([len(p) for p in parts])
    return [_runs(model, p, best[e - len(p) : e], sure[e - len(p) : e]) for p, e in zip(parts, ends)]


def label_language(label: Column) -> Column:
    """The two-letter code that a label stands for: a code of two or three letters or a name, in any case, with a region or odd space; null if none."""
    known = {w: code for code, names in NAMES.items() for w in [code, *names.split()]}
    base = F.regexp_extract(F.lower(F.trim(label)), r"^\s*([^\s_,;()-]+)", 1)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return table[base]


def train(samples: DataFrame, labelled: DataFrame | None = None, per_language: int = 250, rounds: int = 2, sample_rows: int = 100_000) -> Model:
    """Fit on samples (lang, text), a fixed table, and on a bounded sample of labelled documents (label, text).

    Of the samples, the `sample_rows` with the smallest hashes are taken, of the documents `per_language` of each language. Labels may be wrong:
    only sentences where the model so far agrees with the label are learnt from, in `rounds` rounds. Rows with a null
    are left out; both tables may be empty.
    """
    base = [(r[0], r[1]) for r in samples.dropna().orderBy(F.xxhash64(samples.columns[1])).limit(sample_rows).collect()]
    model = fit(base) if base else None
    if labelled is None or model is None:
        return model
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("text"), "text"))
    docs = labelled.toDF("label", "text").select(label_language(F.col("label")).alias("code"), "text").dropna().withColumn("r", rank).filter(F.col("r") <= per_language)
    pairs = [(r["code"], s) for r in docs.select("code", "text").collect() for s in sentences(r["text"])]
    for _ in range(rounds if pairs else 0):
        best, _ = score(model, [s for _, s in pairs])
        model = fit(base + [p for p, b in zip(pairs, best) if b >= 0 and model.languages[b] == p[0]])
    return model


def segment_documents(df: DataFrame, model: Model, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, label, segs array<struct<seg_no, lang, confidence, start_char, end_char>>): one row per row of df; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<seg_no:int,lang:string,confidence:double,start_char:int,end_char:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in batches:
            yield pd.Series([[dict(zip(("seg_no", "lang", "confidence", "start_char", "end_char"), x)) for x in runs] for runs in segments(m, list(s))], dtype=object)

    run = run.asNondeterministic()  # or a filter on the result would be pushed below and evaluate it twice
    return spread(df.select(id_col, label_col, text_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), run(F.col(text_col)).alias("segs"))


def found(df: DataFrame, model: Model, id_col: str = "id", text_col: str = "abstract", label_col: str = "language") -> DataFrame:
    """p3_found's rows: the segments of documents whose label is missing, meaningless or wrong, or that mix languages.

    Null and blank texts, and texts without a letter, give no row; repeated ids each give their own rows; other columns
    are ignored; an empty table gives an empty result.
    """
    s = segment_documents(df.filter(F.col(text_col).isNotNull()), model, id_col, text_col, label_col)
    wrong = (F.size("segs") > 1) | ~F.coalesce(label_language(F.col("label")) == F.col("segs")[0]["lang"], F.lit(False))
    return s.filter(F.size("segs") > 0).filter(wrong).select(F.col("id").alias("paper_id"), F.explode("segs").alias("s")).select("paper_id", "s.seg_no", "s.lang", "s.confidence")
