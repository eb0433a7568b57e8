import random

import pytest
from pyspark.sql import functions as F

from lumenbib.llm import mixing


def brute_fill(goal, share, cap):
    got, open_ = {}, set(share)
    while True:
        left = goal - sum(got.values())
        s = sum(share[k] for k in open_)
        over = [k for k in open_ if s and cap[k] < left * share[k] / s - 1e-9]
        if not over:
            return got | {k: left * share[k] / s if s else 0.0 for k in open_}
        for k in over:
            got[k] = cap[k]
            open_.discard(k)
        if not open_:
            return got


def test_zero_shares_and_many_mixes(spark):
    r = random.Random(3)
    sizes = {f"s{i}": r.randrange(1, 1000) for i in range(9)}
    total, targets, want = sum(sizes.values()), [], {}
    for mix in range(400):
        ks = r.sample(sorted(sizes), r.randrange(2, 8))
        w = [r.choice([0, 0.0, r.random(), 10 ** -r.randrange(1, 9)]) for _ in ks]
        w[0] = w[0] or 0.5
        share = {k: x / sum(w) for k, x in zip(ks, w)}
        cap = {k: sizes[k] * r.randrange(0, 5) for k in ks}
        ratio = r.choice([0.05, 0.3, 0.8, 2.5])
        targets += [(mix, k, share[k], cap[k] // sizes[k], ratio) for k in ks]
        for k, v in brute_fill(ratio * total, share, cap).items():
            want[mix, k] = v, cap[k] < share[k] * ratio * total
    t = spark.createDataFrame(targets, "mix_id int, source string, target_share double, max_repeats int, size_ratio double")
    plan = mixing.water_fill(t, spark.createDataFrame(list(sizes.items()), "source string, tokens bigint"))
    got = plan.collect()
    assert len(got) == len(want)
    for x in got:
        v, short = want[x["mix_id"], x["source"]]
        assert x["allocated"] == pytest.approx(v, rel=1e-6, abs=1e-4), x
        assert x["unreachable"] == short and (x["clamped"] or not short)
    assert {tuple(x) for x in mixing.short_sources(plan).collect()} == {k for k, (_, s) in want.items() if s}


def test_texts_are_tokenised_once(spark):
    from lumenbib.llm.queries import QUERIES

    spark.sparkContext.setLocalProperty("spark.job.description", None)
    plan = QUERIES["p7_found"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "Window" in plan  # the sizes are kept, the filling is in the plan
    docs = spark.createDataFrame([], "source string, text string")
    assert mixing.source_tokens(docs).collect() == []


def test_water_fill_against_loop(spark):
    r = random.Random(1)
    targets, sizes, want = [], [(f"s{i}", r.randrange(1, 1000)) for i in range(8)], {}
    total = sum(n for _, n in sizes)
    for mix in range(12):
        ks = r.sample(range(8), 5)
        w = [r.random() for _ in ks]
        share = {f"s{k}": x / sum(w) for k, x in zip(ks, w)}
        rep = {k: r.randrange(1, 5) for k in share}
        ratio = r.choice([0.3, 0.8, 1.5])
        cap = {k: dict(sizes)[k] * rep[k] for k in share}
        targets += [(mix, k, share[k], rep[k], ratio) for k in share]
        for k, v in brute_fill(ratio * total, share, cap).items():
            want[mix, k] = v, cap[k] < share[k] * ratio * total
    t = spark.createDataFrame(targets, "mix_id int, source string, target_share double, max_repeats int, size_ratio double")
    plan = mixing.water_fill(t, spark.createDataFrame(sizes, "source string, tokens bigint"))
    got = plan.collect()
    assert len(got) == len(want)
    for x in got:
        v, short = want[x["mix_id"], x["source"]]
        assert x["allocated"] == pytest.approx(v) and x["unreachable"] == short
    docs = spark.createDataFrame([(i, f"s{i % 8}") for i in range(4000)] + [(9999, None)], "doc_id bigint, source string")
    s = mixing.sample_mix(docs, plan)
    a = s.groupBy("mix_id", "source").agg((F.sum("copies") / 500).alias("e")).join(plan, ["mix_id", "source"]).collect()
    assert all(abs(x["e"] - x["epochs"]) < 0.12 for x in a) and s.count() == mixing.sample_mix(docs.repartition(7), plan).count()
    assert s.join(plan.select("mix_id", "source", "max_repeats"), ["mix_id", "source"]).filter("copies > max_repeats").count() == 0


def test_water_fill_edges(spark):
    t = spark.createDataFrame([(1, "gone", 1.0, 2, 1.0), (2, None, 0.5, 1, 1.0), (2, "a", None, None, 1.0)], "mix_id int, source string, target_share double, max_repeats int, size_ratio double")
    sizes = spark.createDataFrame([("a", 10), (None, 5)], "source string, tokens bigint")
    got = {(r["mix_id"], r["source"]): r for r in mixing.water_fill(t, sizes).collect()}
    assert got[1, "gone"]["unreachable"] and got[1, "gone"]["tokens"] == 0 and got[1, "gone"]["epochs"] is None
    assert len(got) == 3 and mixing.water_fill(t.limit(0), sizes).count() == 0


def test_shares_are_drawn(spark):
    r = random.Random(2)
    sizes = {i: int(r.paretovariate(1.3) * 10) for i in range(3000)}
    docs = spark.createDataFrame([(i, f"s{i % 3}", n) for i, n in sizes.items()] + [(9999, None, 5)], "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame([(1, "s0", 0.5, 1, 0.3), (1, "s1", 0.2, 4, 0.3), (1, "gone", 0.3, 2, 0.3), (2, "s2", 1.0, 2, 0.5), (3, "gone", 1.0, 1, 1.0)], "mix_id int, source string, target_share double, max_repeats int, size_ratio double")
    plan = mixing.water_fill(t, mixing.source_sums(docs))
    mix = mixing.sample_mix(docs, plan, tokens_col="tokens")
    got = {(x["mix_id"], x["source"]): x for x in mixing.drawn_shares(plan, mix).collect()}
    drawn = {}
    for x in mix.collect():
        assert x["tokens"] == sizes[x["doc_id"]]
        drawn[x["mix_id"], x["source"]] = drawn.get((x["mix_id"], x["source"]), 0) + x["tokens"] * x["copies"]
    assert len(got) == 5 and got[1, "gone"]["drawn"] == 0 and got[3, "gone"]["actual_share"] is None
    for k, n in drawn.items():
        total = sum(m for (mix_id, _), m in drawn.items() if mix_id == k[0])
        assert got[k]["drawn"] == n and got[k]["actual_share"] == pytest.approx(n / total)
        assert abs(n - got[k]["allocated"]) <= max(sizes.values())


def test_shares_query(spark):
    from lumenbib.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    shares = {(x["mix_id"], x["source"]): x for x in QUERIES["p7_shares"](spark, d).collect()}
    mix = QUERIES["p7_mix"](spark, d).groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("n")).collect()
    assert len(mix) > 0 and {(x["mix_id"], x["source"]): x["n"] for x in mix} == {k: x["drawn"] for k, x in shares.items() if x["drawn"]}
