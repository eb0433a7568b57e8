import datetime as dt
import random

from pyspark.sql import functions as F

from lumenbib.llm import survivors as S

SCHEMA = "id bigint, doi string, openalex_id string, cited_by_count int, updated_at timestamp, group_id string"


def T(n):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=n)


def test_notations(spark):
    doi = {"https://doi.example/10.9001/arc.5": "10.9001/arc.5", " 10.9001/ARC.5 ": "10.9001/arc.5", "10.9001%2Farc.5": "10.9001/arc.5", "DOI: 10.9001/arc.5": "10.9001/arc.5", "10.9001/arc.5.": "10.9001/arc.5", "http://dx.doi.example/10.9001/ARC.5X": "10.9001/arc.5x", "-": None, "none": None, "": None, "10.0000/unknown": None, None: None}
    wid = {"https://openalex.example/W12": "W12", "w12": "W12", "https://openalex.example/works/W12/": "W12", "openalex:W12": "W12", "W0": None, "https://openalex.example/W0": None, "": None, None: None, "X12": None}
    for f, cases in ((S.clean_doi, doi), (S.clean_work_id, wid)):
        df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", f(F.col("x")).alias("y"))
        assert {r["x"]: r["y"] for r in df.collect()} == cases


def test_fields_and_chains(spark):
    rows = [
        (5, "10.1234/a", None, 3, T(1), "x"), (2, "DOI:10.1234/A", "W7", None, T(3), None), (9, None, "openalex:w7", -4, T(9), None), (7, "-", "W7", 8, T(2), None),
        (1, "10.5555/z", None, None, None, None), (3, "10.5555/z", "W0", -1, None, None), (4, "none", "W0", 5, T(1), None), (6, "none", "W0", 5, T(1), None), (8, None, None, 1, T(1), None), (None, "10.1234/a", None, 1, T(99), None),
    ]
    got = {tuple(r) for r in S.survivors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2, "10.1234/a", "W7", 8), (1, "10.5555/z", "", -1)}
    assert S.survivors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, f"10.1234/{r.randrange(60)}", "n/a"]), r.choice([None, f"W{r.randrange(1, 60)}", "W0"]), r.choice([None, -1, r.randrange(9)]), T(r.randrange(10**4)), None) for i in range(120)]
    up = {x[0]: x[0] for x in rows}

    def find(x):
        return x if up[x] == x else find(up[x])

    seen = {}
    for x in rows:
        for k in [("d", x[1]) if x[1] and x[1] != "n/a" else None, ("w", x[2]) if x[2] and x[2] != "W0" else None]:
            if k:
                a, b = find(seen.setdefault(k, x[0])), find(x[0])
                up[max(a, b)] = min(a, b)
    groups = {}
    for x in rows:
        groups.setdefault(find(x[0]), []).append(x)
    want = set()
    for g, xs in groups.items():
        if len(xs) > 1:
            xs.sort(key=lambda x: (x[4], x[0]), reverse=True)
            pick = lambda f, d: next((f(x) for x in xs if f(x) is not None), d)
            want.add((g, pick(lambda x: x[1] if x[1] != "n/a" else None, ""), pick(lambda x: x[2] if x[2] != "W0" else None, ""), pick(lambda x: x[3] if x[3] is not None and x[3] >= 0 else None, -1)))
    assert {tuple(r) for r in S.survivors(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_truth_discovery_trusts_the_better_source(spark):
    r = random.Random(4)
    claims = []
    for o in range(60):
        truth = f"v{o}"
        claims += [(o, "f", truth if r.random() < 0.97 else f"x{r.randrange(99)}", "good"), (o, "f", truth if r.random() < 0.95 else f"y{r.randrange(99)}", "fair")]
        claims += [(o, "f", truth if r.random() < 0.3 else f"z{r.randrange(99)}", f"bad{k}") for k in range(2)]
    claims += [(None, "f", "q", "good"), (99, "f", None, "good"), (98, "f", "only", None)]
    df = spark.createDataFrame(claims, "object bigint, field string, value string, source string")
    got = {x["object"]: x["value"] for x in S.truth_discovery(df).collect()}
    assert sum(got[o] == f"v{o}" for o in range(60)) >= 57 and got[98] == "only" and 99 not in got
    assert S.truth_discovery(df.limit(0)).collect() == []


def test_ties_go_by_number(spark):
    df = spark.createDataFrame([(1, "n", "9", "a"), (1, "n", "10", "b"), (2, "n", "x", "a"), (2, "n", "y", "b")], "object bigint, field string, value string, source string")
    assert {(r["object"], r["value"]) for r in S.truth_discovery(df).collect()} == {(1, "10"), (2, "y")}


def test_latest_outweighs_any_crowd(spark):
    """Whatever the table looks like, the latest usable value is a fixed point of the discovery."""
    r = random.Random(9)
    for objects, crowd in ((1, 1), (1, 40), (7, 300), (60, 5)):
        rows = []
        for o in range(objects):
            rows += [(o, str(r.randrange(4)), T(k), o * 1000 + k) for k in range(r.randrange(1, crowd + 1))] + [(o, "99", T(999), o * 1000 + 999), (o, None, T(1200), o * 1000 + 998)]
        df = spark.createDataFrame(rows, "group_id bigint, v string, at timestamp, id bigint")
        got = S.truth_discovery(S.recency_claims(df, ["v"], "at", "id"), prior=S.PRIOR).collect()
        assert len(got) == objects and {x["value"] for x in got} == {"99"}, (objects, crowd)
