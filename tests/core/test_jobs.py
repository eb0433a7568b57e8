import json

import pytest
from pyspark.sql import functions as F

from lumenbib import cli
from lumenbib.operators import indexing
from lumenbib.operators import records as R
from lumenbib.sources import feed, store
from lumenbib.streaming import workflow as W

D = "/root/testdata/sf0.001"


def test_records(spark):
    assert R.payload_schema({"a": "keyword", "n": "integer"}) == "a string, n bigint"
    with pytest.raises(ValueError):
        R.payload_schema({"a": "geo"})
    table = spark.createDataFrame([(5, "k1"), (3, "k2"), (9, None)], "id bigint, k string")
    items = spark.createDataFrame([("k2", 0), ("k1", 1), ("k2", 2), ("zz", 3), (None, 4)], "k string, place int")
    assert [r["id"] for r in R.resolve_ids(items, table, "k", "place").collect()] == [3, 5]
    assert R.exists(table, F.col("id") == 5) and not R.exists(table, F.col("id") == 6)
    m = spark.createDataFrame([({"a": "", "b": "x"},)], "p map<string,string>")
    got = m.select(R.with_defaults(F.col("p"), {"a": F.lit(1), "c": F.lit("d")}).alias("w"), R.merged(F.col("p"), F.create_map(F.lit("b"), F.lit("y"))).alias("m"), R.first_of(F.col("p"), "q", "b").alias("f")).first()
    assert got["w"] == {"a": "1", "b": "x", "c": "d"} and got["m"] == {"a": "", "b": "y"} and got["f"] == "x"
    p = [("c1", {"period_start": "2020-01-01T00:00", "period_end": "2020-01-31", "paper_count": "4"}), ("c2", {"period_start": "2020-01-01", "period_end": "2020-01-31", "paper_count": "four"}), ("c3", {"period_end": "2020-01-31"}), ("c4", None)]
    rows, bad = R.typed_periods(spark.createDataFrame(p, "cluster_key string, payload map<string,string>"))
    assert [(r["cluster_key"], r["paper_count"], r["previous_paper_count"], r["growth_rate"]) for r in rows.collect()] == [("c1", 4, 0, None)]
    assert {r["cluster_key"]: r["reason"] for r in bad.collect()} == {"c2": "bad paper_count", "c3": "no period_start", "c4": "no period_start"}
    log = spark.createDataFrame([("a", "1", 0, None), ("a", "2", 50, 10), ("b", "3", 0, None), ("b", None, 9, None), ("c", "4", 0, 1000)], "key string, value string, s int, ttl_seconds int").withColumn("ts", F.timestamp_seconds("s"))
    assert {tuple(r) for r in R.live_state(log, "1970-01-01 00:01:30").collect()} == {("c", "4")}
    f = spark.createDataFrame([(1, 7, "t"), (1, 8, "u")], "user_id int, paper_id int, x string").withColumn("created_at", F.col("paper_id"))
    assert [r["paper_id"] for r in R.listed_newest(f, 1, "paper_id").collect()] == [8, 7]
    i = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "b", 2), (1, None, 3)], "paper int, name string, place int")
    assert R.distinct_in_order(i, ["paper"], "name", "place").first()["values"] == ["b", "a"]
    e = spark.createDataFrame([(1, 2019, 3), (1, 2020, 4), (2, 2019, 5)], "topic_id int, stat_year int, artificial int")
    assert R.estimates_for(e, [1], [2019, 2021]).count() == 1


def test_indexing(spark):
    papers = spark.createDataFrame([(1, "T", "A", 2020, "en", False, None), (2, "U", None, 2020, None, True, "stale"), (3, "", " ", None, None, False, None)], "id bigint, title string, abstract string, publication_year int, language string, is_indexed boolean, text_hash string")
    kw = spark.createDataFrame([(1, ["k"])], "paper_id bigint, keywords array<string>")
    links = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "paper_id bigint, topic_id bigint")
    out = indexing.index_papers(papers, kw, links, store.hash_embedder(4), 4)
    assert {tuple(r) for r in out["status"].collect()} == {(1, "new"), (2, "changed"), (3, "empty")}
    points = out["points"]
    assert {r["point_id"] for r in points.collect()} == {"paper:1", "paper:2"} and {r["topic_id"] for r in out["topics"].collect()} == {10, 20}
    marked = papers.drop("text_hash", "is_indexed").join(out["marks"], "id", "left").withColumn("is_indexed", F.col("text_hash").isNotNull())
    again = indexing.index_papers(marked, kw, links, store.hash_embedder(4), 4)
    assert {r["status"] for r in again["status"].filter("id < 3").collect()} == {"unchanged"} and again["points"].count() == 0
    from_points = indexing.index_papers(papers.withColumn("is_indexed", F.lit(False)), kw, links, store.hash_embedder(4), 4, points)
    assert {r["status"] for r in from_points["status"].filter("id < 3").collect()} == {"unchanged"}
    assert indexing.index_papers(marked, kw, links, store.hash_embedder(4), 4, force=True)["points"].count() == 2


def test_feed(spark, tmp_path):
    def fetch(unit, page):
        if unit == "down":
            raise OSError("no route")
        if unit == "busy":
            raise feed.RateLimited(600)
        return None if unit == "none" else [] if page > 1 else [{"id": f"W{page}"}]

    pages = spark.createDataFrame([("a", 1), ("a", 2), ("down", 1), ("busy", 1), ("none", 1)], "unit string, page int")
    got = feed.fetch_pages(pages, fetch, retries=1, wait=lambda s: None)
    assert {(r["unit"], r["page"], r["status"], r["attempts"]) for r in got.collect()} == {("a", 1, "ok", 1), ("a", 2, "exhausted", 1), ("down", 1, "failed", 2), ("busy", 1, "deferred", 1), ("none", 1, "missing", 1)}
    assert [json.loads(r["raw"]) for r in feed.fetched_records(got).collect()] == [{"id": "W1"}]
    (tmp_path / "w.json").write_text('{"id": 1}\n\n{broken\n')
    assert feed.landed(spark, str(tmp_path / "w.json")).count() == 2


def test_workflow(spark):
    topics = spark.createDataFrame([(1,), (2,)], "topic_id bigint")
    covered = spark.createDataFrame([(p, 1) for p in W.PANELS], "panel string, topic_id bigint")
    missing = W.missing_topics(topics, covered, topics)
    assert {r["panel"] for r in missing.collect()} == set(W.PANELS) - {"sample-papers"}
    m = W.messages(missing, "indexing", "2020-01-01", "2020-01-31", 10)
    row = m.first()
    assert (row["queue"], row["task_type"], row["ids"]) == ("queue:paper_indexing", "paper_indexing", [2])
    active = spark.createDataFrame([("indexing", "2020-01-01", [2])], "panel string, period_start string, ids array<bigint>")
    assert W.messages(missing, "indexing", "2020-01-01", "2020-01-31", 10, active).count() == 0
    with pytest.raises(ValueError):
        W.messages(missing, "odd", "2020-01-01", "2020-01-31", 10)
    t = spark.createDataFrame([("monthly-stats", "done", 0), ("sample-papers", "running", 100)], "panel string, state string, s int").withColumn("updated_at", F.timestamp_seconds("s"))
    assert W.step("load-and-index", t, missing, "1970-01-01 01:00:00") == ("running", "sample-papers")
    assert W.step("load-and-index", t, missing, "1970-01-03 01:00:00") == ("stopped", "sample-papers")
    assert W.step("load-and-index", t.filter("state = 'done'"), missing, "1970-01-01 01:00:00") == ("enqueue", "indexing")


def test_command_line(spark, tmp_path, capsys):
    run = lambda *a: cli.main(["--data", D, *a], spark)
    assert run("--show", "3", "data", "validate", "--sample", "2") == 0
    assert len([json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]) == 3
    assert run("--out", str(tmp_path / "c"), "ml", "clusters", "--as-of", "2020-12-31") == 0 and spark.read.parquet(str(tmp_path / "c")).count() == 400
    assert run("--show", "1", "data", "coverage", "--date-from", "2020-01-01", "--date-to", "2020-03-31") == 0
    assert run("--show", "1", "data", "january") == 0 and run("--show", "1", "ml", "trending", "--date-from", "2019-01-01", "--date-to", "2020-12-31") == 0
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "m.json").write_text(json.dumps({"queue": "queue:cluster_recompute", "task_id": 1, "task_type": "recompute_topic_clusters", "ids": [17, 99999], "created_at": "2024-01-01T00:00:00Z"}))
    assert run("worker", "run", "--inbox", str(inbox), "--checkpoint", str(tmp_path / "cp"), "--results", str(tmp_path / "r")) == 0
    assert run("tasks", "failed", "--letters", str(tmp_path / "r/dead")) == 0
    assert "1 unknown topics" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        run("data", "stats")


def test_keyphrase_statuses(spark):
    from lumenbib.operators import keyphrases

    text = "Neural networks learn graph representations from data."
    df = spark.createDataFrame([(1, "Neural networks", text, "en"), (2, "x", text, "de"), (3, "the of", None, None), (4, None, None, " ")], "id bigint, title string, abstract string, language string")
    got, status = keyphrases.extract_papers(df)
    assert {r["id"]: r["status"] for r in status.collect()} == {1: "done", 2: "skipped", 3: "failed", 4: "failed"} and {r["id"] for r in got.collect()} == {1}
    assert {r["id"]: r["status"] for r in keyphrases.extract_papers(df, skip_non_english=False)[1].collect()}[2] == "done"
