"""Keyphrases of documents: candidates, two unsupervised scores, features, a linear ranker and a filter of near-equal terms.

Scoring a document needs that document only, so the whole chain runs in one Arrow-batched map without a shuffle. The two
scores follow the published YAKE! features (casing, position, frequency, relatedness, sentence spread) and SingleRank (a
weighted walk over words that occur near each other). The ranker's weights are a documented parameter, in place of
trained ones; another scorer or an embedder can be given.
"""

from __future__ import annotations

import math
import re
import statistics
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, TOKEN
from .parallel import spread

STOP = set(STOPWORDS)
#: Word endings of adjectives; other words with a letter count as nouns where no tagger is there (fixed values).
ADJECTIVE_ENDINGS = ("al", "ic", "ive", "ous", "able", "ible", "ary", "less")
#: Phrases scored by each scorer, rank kept in either, kept by mean reciprocal rank, least kept, rank of the
#: unranked, most candidates that are compared pair by pair.
BEST, RANK_KEPT, AGREED_KEPT, LEAST_KEPT, UNRANKED, MOST_COMPARED = 100, 150, 250, 50, 999, 2500
#: Names of the features that a ranker is given (fixed values).
FEATURES = [
    "contains_hyphen",
    "ends_with_noun",
    "pke_yake_w8_rrank_doc_z",
    "pke_singlerank_w4_rrank_doc_z",
    "pke_rrank_max",
    "pke_rrank_mean",
    "pke_rrank_range",
    "pke_top5_count",
    "pke_top10_count",
    "pke_rrank_delta_yake_singlerank",
    "pke_yake_beats_singlerank",
    "pke_singlerank_beats_yake",
    "embedrank_best_sentence_cosine",
    "candidate_substring_of_other",
    "candidate_contains_other",
    "candidate_token_overlap_max",
]
#: Weights of the linear ranker (a parameter), in place of trained ones; `frequency` and `early` are features of its own.
WEIGHTS = {
    "frequency": 0.45, "early": 0.15, "ends_with_noun": 0.05, "pke_rrank_mean": 0.35, "pke_yake_w8_rrank_doc_z": 0.02, "pke_singlerank_w4_rrank_doc_z": 0.02,
    "pke_top10_count": 0.02, "embedrank_best_sentence_cosine": 0.0, "candidate_substring_of_other": -0.05, "candidate_contains_other": 0.02,
}
SCHEMA = "keyphrase string, score double, rank int, first_pos int"


def is_noun(word: str) -> bool:
    return any(c.isalpha() for c in word) and not word.endswith(ADJECTIVE_ENDINGS)


def words_of(text: str) -> list[list[str]]:
    """Sentences of a text as lists of word tokens."""
    out = [re.findall(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*", s) for s in re.split(r"(?<=[.!?])\s+|\n+", text)]
    return [s for s in out if s]


def stem(word: str) -> str:
    """A word without its plural ending."""
    if len(word) > 5 and word.endswith("ies"):
        return word[:-3] + "y"
    return word[:-1] if len(word) > 4 and word.endswith("s") and not word.endswith("ss") else word


def clean(text: str, longest: int = 4) -> str | None:
    """The phrase as lower-case tokens; null for none, too many, no letter, or a stopword at an end."""
    t = re.findall(TOKEN, text.lower())
    if not t or len(t) > longest or not any(c.isalpha() for c in "".join(t)) or t[0] in STOP or t[-1] in STOP:
        return None
    return " ".join(t)


def candidates(sents: list[list[str]], longest: int = 3) -> dict[str, list[int]]:
    """Phrases without stopwords inside or at the ends, with the places of their occurrences."""
    out: dict[str, list[int]] = defaultdict(list)
    pos = 0
    for s in sents:
        low = [w.lower() for w in s]
        for i in range(len(low)):
            for n in range(1, longest + 1):
                part = low[i : i + n]
                if len(part) < n or part[-1] in STOP or part[0] in STOP:
                    if part and part[0] in STOP:
                        break
                    continue
                if any(len(w) < 3 and not w.isdigit() for w in part) or all(w.isdigit() for w in part):
                    continue
                out[" ".join(part)].append(pos + i)
        pos += len(low)
    return out


def yake(sents: list[list[str]], phrases: dict[str, list[int]], window: int = 8) -> dict[str, float]:
    """Lower is better: the product of the words' scores over one plus their sum, times the phrase's frequency."""
    tf, upper, places = Counter(), Counter(), defaultdict(list)
    left, right = defaultdict(set), defaultdict(set)
    n_left, n_right = Counter(), Counter()
    for k, s in enumerate(sents):
        low = [w.lower() for w in s]
        for i, x in enumerate(low):
            tf[x] += 1
            upper[x] += i > 0 and s[i][0].isupper()
            places[x].append(k)
            before = low[max(0, i - window) : i]
            left[x].update(before)
            n_left[x] += len(before)
            for y in before:
                right[y].add(x)
                n_right[y] += 1
    content = [n for w, n in tf.items() if w not in STOP] or [1]
    mean, std, most = float(np.mean(content)), float(np.std(content)), max(tf.values(), default=1)
    h = {}
    for w, n in tf.items():
        rel = 1 + (len(left[w]) / max(1, n_left[w]) + len(right[w]) / max(1, n_right[w])) * n / most
        case = upper[w] / (1 + math.log(n))
        position = math.log(math.log(3 + statistics.median(places[w])) + 1e-9)
        spread = len(set(places[w])) / len(sents)
        h[w] = max(position, 0.01) * rel / (case + (n / (mean + std)) / rel + spread / rel)
    out = {}
    for p, at in phrases.items():
        parts = [h[w] for w in p.split()]
        out[p] = math.prod(parts) / (len(at) * (1 + sum(parts)))
    return out


def single_rank(sents: list[list[str]], phrases: dict[str, list[int]], window: int = 4, damping: float = 0.85) -> dict[str, float]:
    """Higher is better: the sum of the phrase's words in a weighted PageRank of nouns and adjectives near each other."""
    ids: dict[str, int] = {}
    edges = Counter()
    flat = [w.lower() for s in sents for w in s]
    keep = [(i, w) for i, w in enumerate(flat) if w not in STOP and len(w) > 2 and any(c.isalpha() for c in w)]
    for a, (i, w) in enumerate(keep):
        u = ids.setdefault(w, len(ids))
        for j, x in keep[a + 1 : a + window]:
            if j - i >= window:
                break
            v = ids.setdefault(x, len(ids))
            if u != v:
                edges[u, v] += 1
                edges[v, u] += 1
    n = len(ids)
    if not n:
        return dict.fromkeys(phrases, 0.0)
    m = np.zeros((n, n))
    for (u, v), c in edges.items():
        m[v, u] = c
    m /= np.maximum(m.sum(0, keepdims=True), 1e-12)
    r = np.full(n, 1 / n)
    for _ in range(50):
        new = (1 - damping) / n + damping * (m @ r)
        if np.abs(new - r).sum() < 1e-8:
            break
        r = new
    return {p: float(sum(r[ids[w]] for w in p.split() if w in ids)) for p in phrases}


def filter_similar(ranked: list[tuple[str, float]], overlap: float = 0.67, jaccard: float = 0.50, gap: float = 0.005, most: int | None = None) -> list[tuple[str, float]]:
    """Greedy from the best, until `most` are kept: a term goes if one kept has the same tokens, or holds enough of them, by the smaller of both and by their union, and scores clearly more."""
    kept: list[tuple[str, float, frozenset[str]]] = []
    scale = max((abs(s) for _, s in ranked), default=1.0) or 1.0
    for term, score in ranked:
        if most is not None and len(kept) >= most:
            break
        t = frozenset(stem(w) for w in term.split())

        def covers(u: frozenset[str], other: float) -> bool:
            both = len(t & u)
            return t == u or both > 0 and both / min(len(t), len(u)) >= overlap - 0.005 and both / len(t | u) >= jaccard - 0.005 and (other - score) / scale >= gap

        if not any(covers(u, other) for _, other, u in kept):
            kept.append((term, score, t))
    return [(w, s) for w, s, _ in kept]


def baseline(ry: dict[str, int], rs: dict[str, int], phrases: list[str]) -> list[str]:
    """Phrases worth ranking, in their order: well ranked by either scorer, or among the best by mean reciprocal rank; if these are few, the next by the better one."""
    rr = lambda r, p: 1 / r[p] if p in r else 0.0
    keep = {p for p in phrases if ry.get(p, UNRANKED) <= RANK_KEPT or rs.get(p, UNRANKED) <= RANK_KEPT}
    keep |= set(sorted(phrases, key=lambda p: -(rr(ry, p) + rr(rs, p)))[:AGREED_KEPT])
    rest = sorted((p for p in phrases if p not in keep), key=lambda p: -max(rr(ry, p), rr(rs, p)))
    keep |= set(rest[: max(0, min(LEAST_KEPT, len(phrases)) - len(keep))])
    return [p for p in phrases if p in keep]


def zscores(x: list[float]) -> list[float]:
    """Deviations from the mean in population standard deviations; 0 if there is none."""
    mean, std = (float(np.mean(x)), float(np.std(x))) if x else (0.0, 0.0)
    return [(v - mean) / std if std > 0 else 0.0 for v in x]


def competition(phrases: list[str]) -> list[tuple[float, float, float]]:
    """(is in a longer other one, holds a shorter other one, greatest Jaccard of tokens with another) of each phrase; zeros beyond MOST_COMPARED."""
    if len(phrases) > MOST_COMPARED:
        return [(0.0, 0.0, 0.0)] * len(phrases)
    tokens = [frozenset(p.split()) for p in phrases]
    size = [len(p.split()) for p in phrases]
    known = set(phrases)
    having: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(tokens):
        for w in t:
            having[w].append(i)
    # all phrases of more, and of fewer, tokens as one text each, so that a phrase is looked up in one search
    longer = {n: "\n".join(p for p, m in zip(phrases, size) if m > n) for n in set(size)}
    shorter = {n: [p for p, m in zip(phrases, size) if m < n] for n in set(size)}
    out = []
    for i, p in enumerate(phrases):
        parts = p.split()
        # most phrases hold one of their own words or pairs; only for the others all shorter ones are tried
        held = any(" ".join(parts[a:b]) in known for a in range(size[i]) for b in range(a + 1, size[i] + 1) if b - a < size[i]) or any(q in p for q in shorter[size[i]])
        near = {j for w in tokens[i] for j in having[w]} - {i}
        out.append((float(p in longer[size[i]]), float(held), max((len(tokens[i] & tokens[j]) / len(tokens[i] | tokens[j]) for j in near), default=0.0)))
    return out


def features(sents: list[list[str]], phrases: dict[str, list[int]], embed: Callable[[list[str]], np.ndarray] | None = None) -> dict[str, dict[str, float]]:
    """FEATURES, and frequency and early, of the phrases that pass `baseline`."""
    y, s = yake(sents, phrases), single_rank(sents, phrases)
    rank = lambda scores, sign: {p: i for i, p in enumerate(sorted(scores, key=lambda p: (sign * scores[p], p))[:BEST], 1)}
    ry, rs = rank(y, 1), rank(s, -1)
    keep = baseline(ry, rs, list(phrases))
    a, b = [1 / ry[p] if p in ry else 0.0 for p in keep], [1 / rs[p] if p in rs else 0.0 for p in keep]
    cosine = [0.0] * len(keep)
    if embed is not None and keep:
        cosine = (embed(keep) @ embed([" ".join(x) for x in sents[:64]]).T).max(1).tolist()
    total, most = sum(map(len, sents)), max(map(len, phrases.values()))
    rows = {}
    for p, u, v, zu, zv, c, (within, holds, overlap) in zip(keep, a, b, zscores(a), zscores(b), cosine, competition(keep)):
        ranks = ry.get(p, UNRANKED), rs.get(p, UNRANKED)
        rows[p] = {
            "contains_hyphen": float("-" in p), "ends_with_noun": float(is_noun(p.split()[-1])), "pke_yake_w8_rrank_doc_z": zu, "pke_singlerank_w4_rrank_doc_z": zv,
            "pke_rrank_max": max(u, v), "pke_rrank_mean": (u + v) / 2, "pke_rrank_range": abs(u - v), "pke_top5_count": float(sum(r <= 5 for r in ranks)), "pke_top10_count": float(sum(r <= 10 for r in ranks)),
            "pke_rrank_delta_yake_singlerank": u - v, "pke_yake_beats_singlerank": float(u > v), "pke_singlerank_beats_yake": float(v > u), "embedrank_best_sentence_cosine": c,
            "candidate_substring_of_other": within, "candidate_contains_other": holds, "candidate_token_overlap_max": overlap,
            "frequency": math.log(len(phrases[p])) / math.log(most) if most > 1 else 0.0, "early": 1 - min(phrases[p]) / max(1, total),
        }
    return rows


def extract(text: str | None, top_k: int = 10, weights: dict[str, float] | None = None, embed: Callable[[list[str]], np.ndarray] | None = None, ranker: Callable[[np.ndarray], np.ndarray] | None = None) -> list[tuple[str, float, int, int]]:
    """(keyphrase, score, rank from 1, place of the first word) of one text; none for null and empty texts.

    ranker takes a matrix of FEATURES, a row a phrase, and gives scores; without one the weights are a linear ranker.
    """
    if not text:
        return []
    w = WEIGHTS | (weights or {})
    sents = words_of(text)
    by_stem: dict[str, str] = {}
    phrases: dict[str, list[int]] = {}
    for p, at in candidates(sents).items():
        c = clean(p)
        if c:
            first = by_stem.setdefault(" ".join(map(stem, c.split())), c)
            phrases.setdefault(first, []).extend(at)
    if not phrases:
        return []
    rows = features(sents, phrases, embed)
    keep = list(rows)
    scores = ranker(np.array([[rows[p][f] for f in FEATURES] for p in keep])).tolist() if ranker else [sum(v * rows[p][k] for k, v in w.items()) for p in keep]
    ranked = sorted(zip(keep, zscores(scores)), key=lambda t: (-t[1], min(phrases[t[0]]), t[0]))
    return [(p, round(x, 6), i, min(phrases[p])) for i, (p, x) in enumerate(filter_similar(ranked, most=top_k if top_k >= 0 else None), 1)]


def extract_documents(df: DataFrame, id_col: str, text_col: str, top_k: int = 10, weights: dict[str, float] | None = None, min_score: float | None = None) -> DataFrame:
    """(id, keyphrase, score, rank, first_pos) of every text, of scores of at least min_score; null and empty texts give no row; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *x) for i, t in zip(b[id_col], b[text_col]) for x in extract(t, top_k, weights) if min_score is None or x[1] >= min_score]
            yield pd.DataFrame(rows, columns=[id_col, "keyphrase", "score", "rank", "first_pos"])

    return spread(df.select(id_col, text_col)).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, {SCHEMA}")


def extract_papers(papers: DataFrame, top_k: int = 10, min_score: float | None = None, skip_non_english: bool = True) -> tuple[DataFrame, DataFrame]:
    """(keyphrases as `extract_documents` gives them, status of every paper (id, status)) of papers (id, title, abstract, language).

    Papers in a language other than English, by their label, are skipped; those without a label aren't. A paper that gives
    no keyphrase has failed. The texts are read once: both results come from one kept table of arrays.
    """
    from ..functions.text import is_blank
    from .checkpoints import cut

    english = is_blank(F.col("language")) | F.lower(F.trim("language")).startswith("en")
    x = papers.select("id", F.concat_ws("\n", "title", "abstract").alias("text"), (F.coalesce(english, F.lit(True)) | F.lit(not skip_non_english)).alias("take"))
    got = extract_documents(x.filter("take"), "id", "text", top_k, min_score=min_score)
    got = cut(got)
    some = got.select("id").distinct().withColumn("_some", F.lit(True))
    status = F.when(~F.col("take"), "skipped").when(F.col("_some"), "done").otherwise("failed")
    return got, x.select("id", "take").join(some, "id", "left").select("id", status.alias("status"))


def doc_zscores(df: DataFrame, doc: str, value: str) -> DataFrame:
    """df with z: the value's deviation from its document's mean in population standard deviations, 0 if there is none; null for a null value."""
    g = df.groupBy(doc).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    x = df.join(g, doc)
    return x.withColumn("z", F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.when(F.col(value).isNotNull(), 0.0))).drop("_m", "_s")


def candidate_overlap(df: DataFrame, doc: str, terms: str) -> DataFrame:
    """df (doc, terms: array of phrases) -> (doc, term, within, holds, overlap) as `competition` has it, in column expressions.

    A document's terms are one array already, so that the comparison needs no join; null and repeated terms are left out.
    """
    t = F.array_distinct(F.array_compact(F.col(terms)))
    words = lambda x: F.array_distinct(F.split(x, " "))
    size = lambda x: F.size(F.split(x, " "))
    x = df.select(doc, t.alias("_t")).select(doc, "_t", F.explode("_t").alias("term"))
    others = F.filter("_t", lambda o: o != F.col("term"))
    jaccard = F.transform(others, lambda o: F.size(F.array_intersect(words(o), words(F.col("term")))) / F.size(F.array_union(words(o), words(F.col("term")))))
    few = F.size("_t") <= MOST_COMPARED
    within = F.exists(others, lambda o: (size(o) > size(F.col("term"))) & o.contains(F.col("term")))
    holds = F.exists(others, lambda o: (size(o) < size(F.col("term"))) & F.col("term").contains(o))
    return x.select(doc, "term", (few & within).alias("within"), (few & holds).alias("holds"), F.when(few, F.coalesce(F.array_max(jaccard), F.lit(0.0))).otherwise(0.0).alias("overlap"))
