"""What a request asks of papers, as predicates, and papers as an answer shows them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PaperRequest:
    """Conditions that must all hold; None and empty ask for nothing."""

    date_from: str | None = None
    language: str | None = None
    is_open_access: bool | None = None
    topic_ids: tuple[int, ...] = ()
    keywords: tuple[str, ...] = ()


def all_of(tests: list[Column]) -> Column:
    """All tests, where a test of a null value fails."""
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def matches(r: PaperRequest, topic_ids: Column | None = None, keywords: Column | None = None) -> Column:
    """Whether a row with publication_date, language, is_open_access fits; topic_ids and keywords are arrays, any shared value will do."""
    tests = []
    if r.date_from:
        tests.append(F.col("publication_date") >= F.to_date(F.lit(r.date_from)))
    if r.language:
        tests.append(F.col("language") == r.language)
    if r.is_open_access is not None:
        tests.append(F.col("is_open_access") == r.is_open_access)
    for column, wanted in ((topic_ids, r.topic_ids), (keywords, r.keywords)):
        if wanted:
            tests.append(F.lit(False) if column is None else F.arrays_overlap(column, F.array(*[F.lit(w) for w in wanted])))
    return all_of(tests)


def matching_papers(papers: DataFrame, links: DataFrame, keywords: DataFrame, r: PaperRequest) -> DataFrame:
    """Papers that fit the request: the plain conditions reach the scan, links and keywords are semi joins."""
    x = papers.filter(matches(PaperRequest(r.date_from, r.language, r.is_open_access)))
    if r.topic_ids:
        x = x.join(links.filter(F.col("topic_id").isin(list(r.topic_ids))).select(F.col("paper_id").alias("id")), "id", "left_semi")
    if r.keywords:
        x = x.join(keywords.filter(F.col("keyword").isin(list(r.keywords))).select(F.col("paper_id").alias("id")), "id", "left_semi")
    return x


def works_filter(date_from: str | None = None, date_to: str | None = None, year_from: int | None = None, year_to: int | None = None, languages: list[str] = (), types: list[str] = (), is_oa: bool | None = None) -> Column:
    """The condition that a works listing is asked with; dates come before years, which count only where no date is given."""
    day, tests = F.col("publication_date"), []
    low, high = date_from or (f"{year_from}-01-01" if year_from else None), date_to or (f"{year_to}-12-31" if year_to else None)
    if low:
        tests.append(day >= F.to_date(F.lit(low)))
    if high:
        tests.append(day <= F.to_date(F.lit(high)))
    if languages:
        tests.append(F.col("language").isin(list(languages)))
    if types:
        tests.append(F.col("type").isin(list(types)))
    if is_oa is not None:
        tests.append(F.col("is_open_access") == is_oa)
    return all_of(tests)


def payload_value(payload: Column, key: str, kind: str) -> Column:
    """A value of a JSON payload, read tolerantly as date, int, double, boolean or string: null if it can't be."""
    raw = F.get_json_object(payload, f"$.{key}")
    if kind == "date":
        return F.substring(raw, 1, 10).try_cast("date")
    if kind == "boolean":
        low = F.lower(F.trim(raw))
        return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)
    return F.nullif(F.trim(raw), F.lit("")) if kind == "string" else F.trim(raw).try_cast(kind)


def short_papers(papers: DataFrame, points: DataFrame) -> DataFrame:
    """(id, title, publication_year, language, topic_ids) of every point: the table's value if there is one, else its payload's."""
    p = papers.select("id", *[F.col(c).alias(f"_{c}") for c in ("title", "publication_year", "language")])
    x = points.select("id", "payload").join(p, "id", "left")
    pick = lambda c, kind: F.coalesce(F.col(f"_{c}"), payload_value(F.col("payload"), c, kind)).alias(c)
    ids = F.from_json(F.get_json_object("payload", "$.topic_ids"), "array<bigint>")
    return x.select("id", pick("title", "string"), pick("publication_year", "int"), pick("language", "string"), ids.alias("topic_ids"))


def all_topic_ids(primary: Column, linked: Column) -> Column:
    """Primary and linked topics of a paper, distinct and in order."""
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(primary), F.coalesce(linked, F.array().cast("array<bigint>"))))))


def cache_key(request: dict) -> str:
    """The same key for requests that hold the same, in whatever order."""
    return hashlib.sha256(json.dumps(request, sort_keys=True, default=str, ensure_ascii=False).encode()).hexdigest()
