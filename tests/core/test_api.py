import pytest
from pyspark.sql import functions as F

from lumenbib import api
from lumenbib.sources import store

D = "/root/testdata/sf0.001"


def test_insights(spark):
    r = api.topic_insights(spark, D, 17, "2018-01-01", "2020-12-31")
    assert r["errors"] == [] and r["activity"].count() == 36
    assert {x["kind"] for x in r["forecast"].collect()} == {"count", "share"}
    assert r["decomposition"].count() == 1 and 0 < r["related"].count() <= 10
    bad = api.topic_insights(spark, D + "/missing", 17, "2018-01-01", "2020-12-31")
    assert len(bad["errors"]) == 4
    with pytest.raises(api.RequestError):
        api.topic_insights(spark, D, 17, "2020-01-01", "2018-01-01")


def test_recommendations(spark):
    with pytest.raises(api.NotEnoughData):
        api.recompute_profile(spark, D, 10**9)
    assert {r["strategy"] for r in api.recommend_papers(spark, D, 10**9, "2022-12-31", 5).collect()} == {"trending_fallback"}
    user = api.user_profiles(spark, D).orderBy("user_id").first()["user_id"]
    got = api.recommend_papers(spark, D, user, "2022-12-31", 5).collect()
    assert len(got) == 5 and {r["strategy"] for r in got} == {"profile"} and all(0 <= r["score"] <= 1 for r in got)


def test_store(spark, tmp_path):
    p = str(tmp_path / "points")
    a = spark.createDataFrame([("a", [1.0, 2.0], "x"), ("b", [0.0, 1.0], "y")], "point_id string, vector array<double>, payload string")
    store.write_version(a, p, 1)
    bad = spark.createDataFrame([("c", [1.0], "bad", 2)], "point_id string, vector array<double>, payload string, seq int")
    with pytest.raises(Exception, match="a vector must have 2 values: point c"):
        store.upsert_points(a, bad, 2, "seq").collect()
    b = spark.createDataFrame([("b", [5.0, 5.0], None, 1), ("d", [1.0, 1.0], "z", 3)], "point_id string, vector array<double>, payload string, seq int")
    store.write_version(store.upsert_points(store.read_current(spark, p), b, 2, "seq"), p, 2)
    got = {r["point_id"]: (r["vector"], r["payload"]) for r in store.read_current(spark, p).collect()}
    assert got == {"a": ([1.0, 2.0], "x"), "b": ([5.0, 5.0], None), "d": ([1.0, 1.0], "z")}
    ids = spark.createDataFrame([("a",), ("q",)], "point_id string")
    assert store.retrieve(store.read_current(spark, p), ids, with_vectors=False).columns == ["point_id", "payload"]
    store.write_report(str(tmp_path / "r/report.json"), {"n": 1})
    assert (tmp_path / "r/report.json").read_text().strip().startswith("{")


def test_collections(spark, tmp_path):
    p = str(tmp_path / "c")
    store.create_collection(spark, p, 2)
    store.create_collection(spark, p, 2)
    assert store.describe_collection(spark, p) == (2, "cosine") and store.read_current(spark, p).count() == 0
    with pytest.raises(store.WrongDimension):
        store.create_collection(spark, p, 3)


def test_a_section_that_fails_when_it_runs(spark, monkeypatch):
    lazy = lambda *a, **k: spark.range(1).select(F.raise_error(F.lit("broken")).alias("topic_id"))
    monkeypatch.setattr(api.insights, "same_subfield", lazy)
    r = api.topic_insights(spark, D, 17, "2018-01-01", "2020-12-31")
    assert len(r["errors"]) == 1 and r["errors"][0].startswith("related") and r["activity"].count() == 36


def test_summary(spark):
    a = F.array(F.lit("k1"), F.lit("k2"))
    assert spark.range(1).select(api.cluster_summary(F.lit("N"), F.array().cast("array<string>"), a)).first()[0] == "N. Keywords: k1, k2."
