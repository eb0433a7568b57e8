import json

import pytest
from pyspark.sql import functions as F

from lumenbib import api
from lumenbib.operators import charts, ingest, profiles
from lumenbib.operators import cluster_tables as T
from lumenbib.operators import entities as E
from lumenbib.operators import quality as Q
from lumenbib.operators import reports as P
from lumenbib.operators import requests as R
from lumenbib.sources import store

D = "/root/testdata/sf0.001"


def test_requests(spark):
    rows = [(1, "2020-01-02", "en", True, [1, 2], ["a"]), (2, None, "en", True, [1], ["a"]), (3, "2020-05-05", None, False, None, None), (4, "2018-01-01", "en", None, [], [])]
    df = spark.createDataFrame(rows, "id int, d string, language string, is_open_access boolean, t array<int>, k array<string>").withColumn("publication_date", F.to_date("d"))
    ids = lambda r: {x["id"] for x in df.filter(R.matches(r, F.col("t"), F.col("k"))).collect()}
    assert ids(R.PaperRequest()) == {1, 2, 3, 4}
    assert ids(R.PaperRequest(date_from="2019-01-01")) == {1, 3}  # a null date fails
    assert ids(R.PaperRequest(language="en", is_open_access=True, topic_ids=(2, 9))) == {1}
    assert ids(R.PaperRequest(keywords=("a",))) == {1, 2} and ids(R.PaperRequest(keywords=("z",))) == set()
    assert R.cache_key({"a": 1, "b": [2]}) == R.cache_key({"b": [2], "a": 1}) != R.cache_key({"a": 2})
    j = spark.createDataFrame([('{"d": "2020-01-02T10:00", "n": " 7 ", "x": "1.5", "b": "TRUE", "s": ""}',), ("broken",), (None,)], "p string")
    got = j.select(*[R.payload_value(F.col("p"), k, t).alias(k) for k, t in (("d", "date"), ("n", "int"), ("x", "double"), ("b", "boolean"), ("s", "string"))]).collect()
    assert (str(got[0]["d"]), got[0]["n"], got[0]["x"], got[0]["b"], got[0]["s"]) == ("2020-01-02", 7, 1.5, True, None) and all(v is None for r in got[1:] for v in r)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "x", "Ann", "o1"), (2, None, "Bob", None)], "author_id bigint, external_id string, display_name string, orcid string")
    new = [(1, None, "Ann K", "o1"), (2, "y", "Bob", " "), (3, "z", "Cy", "o9"), (4, "z2", "Cy2", "o9"), (5, None, None, ""), (6, "w", "Dee", None)]
    got = {r["author_id"]: (r["external_id"], r["display_name"], r["orcid"], r["change"]) for r in E.upsert_authors(old, spark.createDataFrame(new, "seq bigint, external_id string, display_name string, orcid string"), "seq").collect()}
    assert got == {1: ("x", "Ann K", "o1", "updated"), 2: ("y", "Bob", " ", "updated"), 3: ("w", "Dee", None, "inserted"), 4: ("z2", "Cy2", "o9", "inserted")}
    assert E.upsert_authors(old.limit(0), old.limit(0).withColumnRenamed("author_id", "seq"), "seq").count() == 0
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    assert {tuple(r) for r in E.update_known(t, spark.createDataFrame([(1, None)], "id bigint, v string"), ["id"], ["v"]).collect()} == {(1, None), (2, "b")}
    with pytest.raises(Exception, match="no row to update: 9"):
        E.update_known(t, spark.createDataFrame([(9, "q")], "id bigint, v string"), ["id"], ["v"], strict=True).collect()
    with pytest.raises(Exception, match="exists already: 2"):
        E.insert_only(t, spark.createDataFrame([(2, "q")], "id bigint, v string"), ["id"]).collect()
    load, bad, n = E.import_checked(t, t.filter("id = 1"), "id", {"no b": F.col("v") == "b"}, skip_existing=True)
    assert load.count() == 0 and [tuple(r) for r in bad.collect()] == [(2, "b", "no b")] and {tuple(r) for r in n.collect()} == {("skipped", 1), ("failed", 1)}
    children = E.replace_children(t, t.filter("id = 2"), spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "id bigint, v string"), ["id"])
    assert {tuple(r) for r in children.collect()} == {(1, "a"), (2, "c"), (2, "d")}


def test_vector_store(spark):
    c = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [1.0, 1.0], "y"), ("c", None, "x"), ("d", [0.0, 1.0, 2.0], "x"), ("e", [2.0, 0.0], "x")], "point_id string, vector array<double>, payload string")
    assert [r["point_id"] for r in store.search(c, [1.0, 0.0], 3).collect()] == ["a", "e", "b"]
    assert [(r["point_id"], r["score"]) for r in store.search(c, [1.0, 0.0], 3, F.col("payload") == "x", "dot").collect()] == [("e", 2.0), ("a", 1.0)]
    assert store.search(c, [1.0, 0.0], 1, distance="euclid").first()["point_id"] == "a" and store.scroll(c, with_vectors=False).columns == ["point_id", "payload"]
    t = spark.createDataFrame([("deep nets",), (None,), (" ",), ("deep nets",)], "t string")
    v = [r["vector"] for r in store.embed(t, "t", store.hash_embedder(8), 8).collect()]
    assert v[0] == v[3] and sum(x * x for x in v[0]) == pytest.approx(1) and v[1] is v[2] is None
    with pytest.raises(Exception, match="the embedder gave"):
        store.embed(t, "t", lambda x: [[1.0]] * len(x), 2).collect()
    assert store.complete(None, [], "fallback") == "fallback" and store.complete(lambda m: '{"a": 1}', [], as_json=True)
    with pytest.raises(ValueError):
        store.complete(lambda m: "[1]", [], as_json=True)


def test_clusters(spark):
    c = api.recompute_clusters(spark, D, "2020-12-31")
    row = c.filter("outcome = 'ok'").orderBy("topic_id").first()
    assert row["n_vectors"] >= 2 and row["summary"].startswith(row["name"]) and len(row["representatives"]) <= 5
    old = spark.createDataFrame([(row["cluster_key"], "kept")], "cluster_key string, summary string")
    again = api.recompute_clusters(spark, D, "2020-12-31", old).filter(F.col("cluster_key") == row["cluster_key"]).first()
    assert again["summary"] == "kept" and api.recompute_clusters(spark, D, "2020-12-31", old, True).filter(F.col("cluster_key") == row["cluster_key"]).first()["summary"] != "kept"
    assert T.get_cluster(c.filter("false"), c, row["cluster_key"]).count() == 1 and T.get_cluster(c, c, "topic:0").count() == 0
    with pytest.raises(ValueError):
        T.top_clusters(c, 0)
    none = api.recompute_periods(spark, D, "1901-01-01", "1901-03-01", "month")
    assert none.count() == 0 and charts.drift_line(none).count() == 0
    kept, n = T.sync(old, old, ["cluster_key"], {"summary": "overwrite"}, dry_run=True)
    assert kept is old and n.first()["change"] == "skipped"
    w = charts.list_weights(F.array(F.lit("a"), F.lit("b")))
    assert [x["weight"] for x in spark.range(1).select(w.alias("w")).first()["w"]] == [2, 1]


def test_profiles_and_recommendations(spark):
    user = api.user_profiles(spark, D).orderBy("user_id").first()["user_id"]
    point = api.profile_points(spark, D, [user]).first()
    assert point["point_id"] == f"user:{user}" and json.loads(point["payload"])["source_counts"] and len(point["vector"]) == 64
    s = spark.createDataFrame([(13, "topic", [2.0, 4.0])], "user_id bigint, category string, vector array<double>")
    p = profiles.profile_points(profiles.profile_vectors(s), profiles.source_counts(s)).first()
    assert p["vector"] == [2.0, 4.0] and json.loads(p["payload"]) == {"user_id": 13, "vector_size": 2, "source_counts": {"topic": 1}}
    r = R.PaperRequest(date_from="2019-01-01")
    got = api.recommend_papers(spark, D, user, "2022-12-31", 5, r, {"topics": [17]}).join(spark.read.parquet(f"{D}/papers.parquet").select(F.col("id").alias("paper_id"), "publication_date"), "paper_id")
    assert got.count() > 0 and got.filter("publication_date < date'2019-01-01'").count() == 0
    a = api.analyze_coverage(spark, D, "2020-01-01", "2020-03-31")
    assert {r["code"]: r["expected"] for r in a["summary"].collect()} == {"publication_stats": 1200, "sample_papers": 1200}


def test_reports(spark):
    keys = "topic_id bigint, period_key string"
    m = spark.createDataFrame([(1, "2020-Q1", 5)], f"{keys}, paper_count int")
    k = spark.createDataFrame([(1, "2020-Q1", ["a"])], f"{keys}, stable array<string>")
    p = spark.createDataFrame([(1, "2020-Q1", [7])], f"{keys}, ids array<int>")
    payload = P.prompt_payload(m, k, p)
    assert json.loads(payload.first()["payload"])["metrics"] == {"paper_count": 5}
    text = json.dumps({"summary": "s", "items": [{"item_type": "method", "title": "t", "maturity": "growing"}, {"item_type": "odd", "title": "t"}, None, {"item_type": "approach", "title": "u", "sort_order": 9}]})
    answers = P.answer(P.due(payload, m.limit(0)), lambda batch: [text] * len(batch))
    reports, items = P.parsed(answers)
    assert [(r["title"], r["sort_order"]) for r in items.orderBy("sort_order").collect()] == [("t", 0), ("u", 9)]
    assert P.due(payload, m).count() == 0 and P.due(payload, m, force=True).count() == 1
    links = P.paper_links(spark.createDataFrame([(1, "2020-Q1", 7, ["representative", "odd"], None)], f"{keys}, paper_id bigint, roles array<string>, score double"))
    stored = {"reports": reports.limit(0), "items": items.limit(0), "links": links.limit(0)}
    first = P.upsert_reports(stored, reports, items, links)
    full = P.full_reports({"reports": first["reports"].drop("change"), "items": first["items"], "links": first["links"]}).first()
    assert first["reports"].first()["change"] == "inserted" and len(full["items"]) == 2 and [x["paper_id"] for x in full["papers"]] == [7]
    for bad in ("{", "[]", '{"summary": " "}'):
        r, i = P.parsed(answers.withColumn("answer", F.lit(bad)))
        assert r.count() == 0 and i.count() == 0


def test_ingest_and_quality(spark):
    assert [ingest.backoff_seconds(n) for n in (0, 3, 9)] == [0.5, 4.0, 30.0] and ingest.backoff_seconds(1, 7) == 7.0
    with pytest.raises(ValueError):
        ingest.scope_filter("domain")
    x = spark.createDataFrame([(i,) for i in range(1000, 0, -1)], "k int")
    assert {(r["k"], r["i"]) for r in ingest.numbered(x, "k").collect()} == {(k, k - 1) for k in range(1, 1001)}
    pages = spark.createDataFrame([(1, 1), (1, 2)], "u int, page int")
    assert ingest.pending_pages(pages, pages.filter("page = 1"), ["u", "page"]).collect() == [(1, 2)]
    tasks = spark.createDataFrame([("p", "a", [2, 1]), ("p", "a", [3])], "panel string, period_start string, ids array<int>")
    active = spark.createDataFrame([("p", "a", [1, 2])], "panel string, period_start string, ids array<int>")
    assert [r["ids"] for r in Q.not_active(tasks, active).collect()] == [[3]]
    t = spark.createDataFrame([(1, " a "), (2, "b"), (3, "  "), (4, None)], "id int, v string")
    assert [tuple(r) for r in Q.trimmed(t, "v", "id").collect()] == [(1, " a ", "a")]
