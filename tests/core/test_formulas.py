"""The literal cases of FIXTURES.md."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenbib.functions import dates, scoring, text, vectors
from lumenbib.operators import merge, papers, profiles, quality


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def L(x):
    return F.lit(x)


def test_growth_and_trend(spark):
    assert one(spark, scoring.growth_rate(L(9), L(4)), scoring.ratio_growth(L(9), L(4)), scoring.ratio_growth(L(3), L(0)), scoring.growth_rate(L(-1), L(2))) == (1.0, 1.25, 0.0, None)
    assert one(spark, scoring.trend_score(L(0.5), L(50), L(0.0)))[0] == pytest.approx(0.65)
    cases = [(2, 0, 0.0, "new"), (10, 5, 0.51, "emerging"), (10, 4, 0.51, "growing"), (10, 0, -0.21, "declining"), (10, 0, 0.2, "stable")]
    assert [one(spark, scoring.trend_status(L(a), L(n), L(g)))[0] for a, n, g, _ in cases] == [c[3] for c in cases]


def test_recency_citation_recommendation(spark):
    day = L("2020-12-31").cast("date")
    got = one(spark, scoring.recency_score(F.date_sub(day, 365), day), scoring.recency_score(F.date_add(day, 5), day), scoring.recency_score(L(None).cast("date"), day), scoring.citation_score(L(1000)), scoring.citation_score(L(0)), scoring.citation_score(L(None).cast("int")))
    assert got == pytest.approx((0.8, 1, 0, 1, 0, 0))
    parts = [L(x) for x in (0.8, 0.65, 0.8, 1.0)]
    assert one(spark, scoring.recommendation_score(*parts), scoring.recommendation_score(*parts, tag=L(0.7))) == pytest.approx((0.7725, 0.7625))
    assert one(spark, scoring.tag_match(F.array(L(1), L(2)), {"topics": F.array(L(9)), "subfields": F.array(L(2)), "fields": F.array(L(1)), "domains": None}))[0] == 0.70


def test_january_and_quotas(spark):
    cases = {(310, 280): (31, 279), (100, 100): (0, 100), (10, 0): (10, 0), (62, 47): (16, 46)}
    for (jan, first), want in cases.items():
        assert one(spark, *scoring.january_split(L(jan).cast("bigint"), L(first).cast("bigint"))) == want
    assert [one(spark, scoring.quota(L(20), 3, L(i)))[0] for i in range(3)] == [7, 7, 6]


def test_vectors(spark):
    v = lambda *x: F.array(*[L(float(y)) for y in x])
    assert one(spark, vectors.cosine(v(1, 0), v(0, 1)), vectors.cosine(v(0, 0), v(1, 1)), vectors.drift(v(1, 2), v(1, 2)), vectors.cosine(v(1), v(1, 2))) == pytest.approx((0, 0, 0, None), abs=1e-12)
    df = spark.createDataFrame([(13, "favourite", [1.0, 0.0]), (13, "favourite", [0.0, 1.0]), (13, "topic", [2.0, 4.0]), (14, "topic", [2.0, 4.0]), (15, "topic", None)], "user_id bigint, category string, vector array<double>")
    got = {r["user_id"]: r["profile"] for r in profiles.profile_vectors(df).collect()}
    assert got[13] == pytest.approx([1.035714, 1.75], abs=1e-6) and got[14] == [2.0, 4.0] and 15 not in got


def test_text(spark):
    d = [" HTTPS://DOI.org/10.1/AB ", "doi: 10.1/ab", "  ", None]
    assert [one(spark, text.normalize_doi(L(x).cast("string")))[0] for x in d] == ["10.1/ab", "10.1/ab", None, None]
    index = F.from_json(L('{"deep":[0,3],"learning":[1],"for":[2],"nets":[4]}'), "map<string,array<int>>")
    assert one(spark, text.inverted_index_text(index))[0] == "deep learning for deep nets"
    arr = lambda *x: F.array(*[L(y) for y in x])
    assert one(spark, text.merge_keywords(arr("ML", " nlp "), arr("ml", "Graphs")))[0] == ["ML", "nlp", "Graphs"]
    assert one(spark, text.truncate(L("abcdef   gh"), 6), text.truncate(L("ab  c"), 9), text.truncate(L("abcdef"), 3)) == ("abc...", "ab c", "abc")
    assert one(spark, text.topic_of_cluster(L("topic:12")), text.topic_of_cluster(L("x:1")), text.topic_of_cluster(L(None).cast("string"))) == (12, -1, -1)
    assert one(spark, text.candidate(L("The neural nets")), text.candidate(L("Neural nets")), text.candidate(L("12 34"))) == (None, "neural nets", None)


def test_periods(spark):
    assert [r["period_key"] for r in dates.quarters(spark, "2024-02-15", "2024-07-01").collect()] == ["2024-Q1", "2024-Q2", "2024-Q3"]
    got = [tuple(r) for r in dates.load_periods(spark, "2024-01-01", "2024-02-10").orderBy("period_start").collect()]
    assert got == [(dt.date(2024, 1, 2), dt.date(2024, 1, 31)), (dt.date(2024, 2, 1), dt.date(2024, 2, 10))]
    with pytest.raises(ValueError):
        dates.months(spark, "2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        dates.period_start(L("2024-01-01").cast("date"), "day")


def test_merge(spark):
    t = spark.createDataFrame([(1, "T", "A"), (2, "K", None)], "id bigint, title string, abstract string")
    s = spark.createDataFrame([(1, "X", "Z", 1), (1, "U", None, 2), (3, "N", "B", 1), (None, "n", "n", 1)], "id bigint, title string, abstract string, seq int")
    got = {tuple(r) for r in merge.merge(t, s, ["id"], {"title": "overwrite", "abstract": "coalesce"}, "seq").collect()}
    assert got == {(1, "U", "A", "updated"), (2, "K", None, "kept"), (3, "N", "B", "inserted")}
    with pytest.raises(ValueError):
        merge.merge(t, s, ["id"], {"title": "replace"})
    links = spark.createDataFrame([(1, 1, 0.5, 1), (1, 1, None, 2)], "p bigint, t bigint, score double, seq int")
    assert merge.dedupe(links, ["p", "t"], "seq").first()["score"] is None
    pt = spark.createDataFrame([(1, 1, 0.3), (1, 2, 0.9), (1, 3, 0.9), (2, 5, None)], "paper_id bigint, topic_id bigint, score double")
    assert {tuple(r) for r in merge.primary_topics(pt).collect()} == {(1, 2), (2, 5)}


def test_coverage_and_chunks(spark):
    topics = spark.createDataFrame([(1,), (2,)], "topic_id bigint")
    have = spark.createDataFrame([(1, dt.date(2024, 1, 1))] * 2, "topic_id bigint, period_start date")
    cov = quality.coverage(topics, dates.months(spark, "2024-01-01", "2024-02-29"), have)
    assert tuple(cov.agg(F.count("*"), F.count(F.when(F.col("covered"), 1))).first()) == (4, 1)
    c = quality.chunks(spark.range(7).withColumn("k", F.lit(1)), ["k"], "id", 3).collect()
    assert sorted(r["ids"] for r in c) == [[0, 1, 2], [3, 4, 5], [6]]


def test_lookups(spark):
    df = spark.range(10)
    assert papers.by_ids(df, []).count() == 0 and papers.by_ids(df, list(range(500))).count() == 10
    assert [r["id"] for r in papers.in_order(df, [7, 3, 7, 99, 1]).collect()] == [7, 3, 1]
    with pytest.raises(ValueError):
        papers.check_topic_match("fuzzy")
