import json

import pytest
from pyspark.sql import functions as F

from lumenbib.operators import ingest, keyphrases
from lumenbib.streaming import queue as K


def test_messages():
    assert K.check_queues("queue:paper_indexing,queue:keyword_extraction") == ("queue:paper_indexing", "queue:keyword_extraction")
    with pytest.raises(ValueError):
        K.check_queues("paper-indexing")
    for bad in ("cluster_recompute", "collect-topic-stats"):
        with pytest.raises(ValueError):
            K.message(bad, [1])
    assert K.message("recompute_topic_clusters", [1, 2, 1])["ids"] == [1, 2]
    assert K.message("cluster_dynamics_recompute", [1], start="2025-01-01", granularity="month")["task_type"] == "cluster_dynamics_recompute"
    assert set(K.QUEUES) == set(K.TASK_TYPES) and K.check_queues(",".join(K.QUEUES.values()))


def test_coalesce_split_and_locks(spark):
    m = spark.createDataFrame([("q", 1, "t", [1, 2], "o"), ("q", 2, "t", [2, 3], "o"), ("q", 3, "t", [9], "p")], "queue string, task_id bigint, task_type string, ids array<bigint>, options string")
    got = {r["options"]: r["ids"] for r in K.coalesce_all(m, ["queue", "options"], 128).collect()}
    assert got == {"o": [1, 2, 3], "p": [9]}
    two = sorted((r["options"], r["part"], r["ids"], r["merged"]) for r in K.coalesce_all(m, ["queue", "options"], 2).collect())
    assert two == [("o", 0, [1, 2], 2), ("o", 1, [3], 2), ("p", 0, [9], 1)]
    none = spark.createDataFrame([(None, 5, [], "o")], "queue string, task_id bigint, ids array<bigint>, options string")
    assert [(r["queue"], r["ids"], r["part"]) for r in K.coalesce_all(none, ["queue"], 2).collect()] == [(None, [], 0)]
    near = m.withColumn("created_at", F.timestamp_seconds(F.when(F.col("task_id") < 3, 10).otherwise(20)))
    assert sorted((r["options"], r["ids"], r["merged"]) for r in K.coalesce_adjacent(near, ["queue", "options"], 10).collect()) == [("o", [1, 2, 3], 2), ("p", [9], 1)]
    parts = sorted((r["task_id"], r["part"], r["ids"]) for r in K.split_oversized(m, 1).collect())
    assert parts[:2] == [(1, 0, [1]), (1, 1, [2])]
    t = spark.createDataFrame([("a", 0), ("a", 50), ("a", 100), ("a", 160)], "k string, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r["locked_at"] for r in K.dedupe_locks(t, ["k"], "ts", 100).collect()) == [0, 100]


def test_workflow():
    assert K.advance(["a", "b"], {"a": "done"}, {"b": 3}) == ("enqueue", "b")
    assert K.advance(["a", "b"], {"a": "failed"}, {}) == ("stopped", "a")
    assert K.advance(["a", "b"], {}, {}) == ("finished", None)


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    msg = [{"queue": "queue:paper_indexing", "task_id": i, "task_type": "paper_indexing" if i < 3 else "odd", "ids": [i, 7], "options": "o", "created_at": "2024-01-01T00:00:00Z"} for i in (1, 1, 2, 3)]
    (inbox / "m.json").write_text("\n".join(map(json.dumps, msg)))
    calls = spark.sparkContext.accumulator(0)

    def handler(df):
        @F.udf("string")
        def once(x):
            calls.add(1)

        return df.withColumn("error", once.asNondeterministic()("task_type"))

    q = K.run_queue(spark, str(inbox), str(tmp_path / "cp"), {"paper_indexing": handler}, str(tmp_path / "out"))
    q.awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "out/handled"))
    assert [sorted(r["ids"]) for r in done.collect()] == [[1, 2, 7]]
    assert calls.value == 1  # not once for each output
    dead = spark.read.parquet(str(tmp_path / "out/dead"))
    assert [(r["task_id"], r["error"]) for r in dead.collect()] == [(3, "unknown task type")]
    assert K.restore_failed(dead, "queue:paper_indexing").first()["ids"] == [3, 7]


def test_event_windows_with_watermark(spark, tmp_path):
    src = tmp_path / "ev"
    spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.lit(1.0).alias("value"), (F.col("id") % 3).alias("user_id")).write.parquet(str(src))
    s = spark.readStream.schema("ts timestamp, value double, user_id bigint").parquet(str(src)).withWatermark("ts", "24 hours")
    q = K.tumbling(s, "1 day").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("days").agg(F.sum("n")).first()[0] == 100


def test_normalize_works(spark):
    w = {"id": "https://x.example/W1", "doi": "https://doi.org/10.1/AB", "display_name": " A  b ", "abstract_inverted_index": {"deep": [0, 2], "is": [1]}, "authorships": [{"author": {"id": "x/A1", "display_name": "N"}, "institutions": [{"id": "x/I1", "display_name": "first"}, {"id": "y/I1", "display_name": "second"}]}], "topics": [{"id": "x/T1", "display_name": "t", "subfield": {"display_name": "s"}}], "keywords": [{"display_name": "ML"}], "primary_location": {"pdf_url": "p"}, "locations": [{"landing_page_url": "p"}, {"landing_page_url": "q"}]}
    t = ingest.normalize_works(spark.createDataFrame([(json.dumps(w),), ("{",), (None,)], "raw string"))
    p = t["papers"].collect()
    assert len(p) == 1 and (p[0]["paper_key"], p[0]["doi"], p[0]["title"], p[0]["abstract"]) == ("W1", "10.1/ab", "A b", "deep is deep")
    assert [r["display_name"] for r in t["institutions"].collect()] == ["first"]
    assert sorted((r["landing_url"], r["is_best"]) for r in t["landings"].collect()) == [("p", True), ("q", False)]


def test_keyphrases(spark):
    text = "Neural networks learn representations. Neural networks need data. Graph methods help neural networks generalise to graph data."
    got = keyphrases.extract(text, 5)
    assert "neural networks" in [g[0] for g in got] and [g[2] for g in got] == list(range(1, len(got) + 1))
    assert keyphrases.extract(None) == [] and keyphrases.extract("") == [] and keyphrases.extract("the of") == []
    assert [t for t, _ in keyphrases.filter_similar([("neural networks", 1.0), ("neural network", 0.9), ("graphs", 0.5)])] == ["neural networks", "graphs"]
    assert [t for t, _ in keyphrases.filter_similar([("deep neural network", 1.0), ("network", 0.5)])] == ["deep neural network", "network"]
    rows = keyphrases.features(keyphrases.words_of(text), keyphrases.candidates(keyphrases.words_of(text)))
    assert all(set(keyphrases.FEATURES) <= set(r) for r in rows.values())
    assert rows["networks"]["candidate_substring_of_other"] == 1 and rows["neural networks"]["candidate_contains_other"] == 1
    assert keyphrases.extract(text, 3, ranker=lambda m: m[:, keyphrases.FEATURES.index("pke_rrank_mean")])
    many = [f"p{i}" for i in range(400)]
    assert len(keyphrases.baseline({}, {}, many)) == 250 and len(keyphrases.baseline({}, {}, many[:30])) == 30
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id bigint, t string")
    assert {r["id"] for r in keyphrases.extract_documents(df, "id", "t").collect()} == {1}
