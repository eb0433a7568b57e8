import json

from pyspark.sql import functions as F

from lumenbib.operators import nested

SCHEMA = """record_id bigint, external_id string, title string, path string,
authors array<struct<external_id:string,display_name:string,orcid:string,author_order:int,is_corresponding:boolean,institutions:array<struct<external_id:string,display_name:string,ror:string,country_code:string,type:string>>,raw:string>>,
topics array<struct<external_id:string,name:string,score:double,raw:string>>"""


def author(raw, inst=None, ext="A1"):
    return (ext, "n", None, 1, None, inst, raw)


def shred(spark, records):
    df = spark.createDataFrame(records, SCHEMA)
    return {tuple(r) for r in nested.shred_works(df).collect()}


def test_layouts(spark):
    inst = [("I1", "x", None, None, None), None, (None, "y", None, None, None)]
    raws = [
        json.dumps({"affiliations": [{"raw_affiliation_string": "p", "institution_ids": ["i1", None, "i2"]}, None, {"raw_affiliation_string": "q"}]}),
        json.dumps({"affiliations": {"raw_affiliation_string": "p", "institution_ids": "i1"}}),
        json.dumps({"affiliations": [], "raw_affiliation_strings": ["p", "q"]}),
        json.dumps({"affiliations": None, "raw_affiliation_string": "p"}),
        json.dumps(json.dumps({"raw_affiliation_string": "p"})),
        '{"raw_affiliation_string": "p"',
        '{"raw_affiliation_string": "p"} x',
        None,
        "",
    ]
    got = shred(spark, [(1, None, None, None, [author(raws[0], inst), None, author(raws[1], ext=None)], None)] + [(10 + i, None, None, None, [author(r)], []) for i, r in enumerate(raws[2:])])
    one = {x[1:] for x in got if x[0] == 1}
    assert one == {
        ("", "authors/1", "A1"), ("authors/1", "authors/1/institutions/1", "I1"), ("authors/1", "authors/1/institutions/3", ""),
        ("authors/1", "authors/1/affiliations/1", "p"), ("authors/1/affiliations/1", "authors/1/affiliations/1/institution_ids/1", "i1"),
        ("authors/1/affiliations/1", "authors/1/affiliations/1/institution_ids/3", "i2"), ("authors/1", "authors/1/affiliations/3", "q"),
        ("", "authors/3", ""), ("authors/3", "authors/3/affiliations/1", "p"), ("authors/3/affiliations/1", "authors/3/affiliations/1/institution_ids/1", "i1"),
    }
    texts = {i: sorted(x[3] for x in got if x[0] == i and "affiliations" in x[2]) for i in range(10, 17)}
    assert texts == {10: ["p", "q"], 11: ["p"], 12: ["p"], 13: [], 14: [], 15: [], 16: []}


def test_topic_levels(spark):
    raws = [{"subfield": "s", "field": "f"}, {"subfield": {"display_name": "s", "field": {"name": "f", "domain": {"display_name": "d"}}}}, {"hierarchy": {"domain": {"display_name": "d"}}}, {"field": {"domain": {"name": "d"}}}]
    got = shred(spark, [(i, None, None, None, None, [("T", "n", 0.5, json.dumps(r))]) for i, r in enumerate(raws)])
    levels = {i: {(x[2].split("/")[-1], x[3]) for x in got if x[0] == i and x[1]} for i in range(4)}
    assert levels == {0: {("subfield", "s"), ("field", "f")}, 1: {("subfield", "s"), ("field", "f"), ("domain", "d")}, 2: {("domain", "d")}, 3: {("domain", "d")}}


def test_empty_null_and_repeated(spark):
    assert shred(spark, []) == set()
    df = spark.createDataFrame([(1, None, None, None, [author(None)], None)] * 2, SCHEMA)
    assert [tuple(r) for r in nested.shred_works(df).collect()] == [(1, "", "authors/1", "A1")] * 2
    long = json.dumps({"raw_affiliation_string": "x" * 2_000_000})
    assert max(len(x[3]) for x in shred(spark, [(1, None, None, None, [author(long)], None)])) == 2_000_000


def test_paths(spark):
    df = spark.createDataFrame([("authors/1",), ("topics/12/subfield",), ("authors/3/affiliations/2/institution_ids/1",)], "p string")
    got = df.select(nested.parent_path(F.col("p")), nested.schema_path(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("", "authors"), ("topics/12", "topics/subfield"), ("authors/3/affiliations/2", "authors/affiliations/institution_ids")]


def test_shred_by_schema(spark):
    df = spark.createDataFrame([(1, [(5, "a", ["x", None, "y"]), None])], "id bigint, xs array<struct<place:int,name:string,tags:array<string>>>")
    t = nested.shred(df, "id", ["xs"])
    assert [r.asDict() for r in t["xs"].collect()] == [{"id": 1, "parent_path": "", "path": "xs/1", "place": 1, "field_place": 5, "name": "a"}]
    assert [(r["parent_path"], r["path"], r["value"]) for r in t["xs/tags"].collect()] == [("xs/1", "xs/1/tags/1", "x"), ("xs/1", "xs/1/tags/3", "y")]
