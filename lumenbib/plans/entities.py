"""Requests, vector search, entity upserts, imports and ingest bookkeeping as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import entities as E
from ..operators import ingest
from ..operators import quality as Q
from ..operators import requests as R
from ..sources import store
from ..sources import views as V
from ..sources.parquet import table
from ..streaming import queue as K

QUERIES, SQL = {}, {}


def query(body: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if body:
            SQL[f.__name__] = V.sql(body)
        return f

    return add


REQUEST = R.PaperRequest("2018-01-01", "en", True, (1, 2, 17, 40, 198), ("glacier", "plasma", "enzyme", "membranes", "tidal assays"))


@query("SELECT id FROM papers WHERE publication_date >= DATE '2018-01-01' AND language = 'en' AND is_open_access AND id IN (SELECT paper_id FROM v_pt WHERE topic_id IN (1, 2, 17, 40, 198))")
def papers_matching_request(spark: SparkSession, d: str) -> DataFrame:
    r = R.PaperRequest(REQUEST.date_from, REQUEST.language, REQUEST.is_open_access, REQUEST.topic_ids)
    return R.matching_papers(V.papers(spark, d, "id", "publication_date", "language", "is_open_access"), V.paper_topics(spark, d), V.paper_keywords(spark, d), r).select("id")


@query("SELECT year(publication_date) AS y, count(*) AS n FROM papers WHERE publication_date BETWEEN DATE '2015-01-01' AND DATE '2019-12-31' AND language IN ('en', 'de') AND is_open_access = FALSE GROUP BY 1")
def works_count_filtered(spark, d):
    p = V.papers(spark, d, "publication_date", "language", "is_open_access").filter(R.works_filter(year_from=2015, year_to=2019, languages=["en", "de"], is_oa=False))
    return p.groupBy(F.year("publication_date").cast("bigint").alias("y")).agg(F.count("*").alias("n"))


_PAYLOAD = "CASE WHEN json_valid(payload) THEN payload END"


@query(f"SELECT v.id, coalesce(p.title, nullif(trim(json_extract_string(j, '$.title')), '')) AS title, coalesce(p.publication_year, try_cast(trim(json_extract_string(j, '$.publication_year')) AS INT)) AS publication_year, coalesce(p.language, nullif(trim(json_extract_string(j, '$.language')), '')) AS language, CAST(json_extract(j, '$.topic_ids') AS BIGINT[]) AS topic_ids FROM (SELECT id, {_PAYLOAD} AS j FROM paper_points) v LEFT JOIN (SELECT * FROM papers WHERE is_indexed) p ON p.id = v.id")
def paper_short(spark, d):
    """Papers of all points as answers show them; of the table those that are indexed."""
    return R.short_papers(V.papers(spark, d, "id", "title", "publication_year", "language", "is_indexed").filter("is_indexed"), table(spark, d, "paper_points", "id", "payload"))


@query("SELECT id, list_sort(list_distinct(list_filter(list_concat([primary_topic_id], coalesce(t, [])), lambda x: x IS NOT NULL))) AS topic_ids FROM papers LEFT JOIN (SELECT paper_id, list(topic_id) AS t FROM v_pt GROUP BY 1) ON paper_id = id")
def paper_topic_ids(spark, d):
    t = V.paper_topics(spark, d).groupBy("paper_id").agg(F.collect_list("topic_id").alias("t"))
    x = V.papers(spark, d, "id", "primary_topic_id").join(t, F.col("id") == F.col("paper_id"), "left")
    return x.select("id", R.all_topic_ids(F.col("primary_topic_id"), F.col("t")).alias("topic_ids"))


def _points(spark, d):
    p = table(spark, d, "paper_points", "id", "vector", "payload")
    return p.select(F.col("id").alias("point_id"), F.col("vector").cast("array<double>").alias("vector"), "payload")


@query("SELECT paper_id AS point_id, round(greatest(-1, least(1, list_cosine_similarity(v_vec.vector, (SELECT vector FROM v_vec ORDER BY paper_id LIMIT 1)))), 6) AS score FROM v_vec JOIN paper_points p ON p.id = paper_id WHERE try_cast(json_extract_string(payload, '$.publication_year') AS INT) >= 2016 AND json_extract_string(payload, '$.language') = 'en' ORDER BY round(greatest(-1, least(1, list_cosine_similarity(v_vec.vector, (SELECT vector FROM v_vec ORDER BY paper_id LIMIT 1)))), 9) DESC, paper_id LIMIT 10")
def search_filtered(spark, d):
    """The ten points nearest to the first usable vector among English ones since 2016."""
    v = V.paper_vectors(spark, d).orderBy("paper_id").select("vector").first()["vector"]
    from ..functions import vectors

    must = (R.payload_value(F.col("payload"), "publication_year", "int") >= 2016) & (R.payload_value(F.col("payload"), "language", "string") == "en")
    usable = _points(spark, d).filter(vectors.usable(F.col("vector"), V.DIM))
    return store.search(usable, v, 10, must).select("point_id", F.round("score", 6).alias("score"))


@query("SELECT id AS point_id FROM paper_points WHERE try_cast(json_extract_string(payload, '$.publication_year') AS INT) = 2020")
def scroll_filtered(spark, d):
    return store.scroll(_points(spark, d), R.payload_value(F.col("payload"), "publication_year", "int") == 2020, with_vectors=False).select("point_id")


_MATCH = """+ e AS (SELECT {id}, {cols} FROM {table} WHERE {old}), i0 AS (SELECT {cols}, {id} AS seq, coalesce('{k1}:' || nullif(trim({k1}), ''), '{k2}:' || nullif(trim({k2}), '')) AS k FROM {table} WHERE {new}),
i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM i0 WHERE k IS NOT NULL) WHERE r = 1),
e1 AS (SELECT trim({k1}) AS k1, min({id}) AS id FROM e WHERE trim({k1}) <> '' GROUP BY 1), e2 AS (SELECT trim({k2}) AS k2, min({id}) AS id FROM e WHERE trim({k2}) <> '' GROUP BY 1),
m AS (SELECT i.*, coalesce(e1.id, e2.id) AS id FROM i LEFT JOIN e1 ON e1.k1 = trim(i.{k1}) LEFT JOIN e2 ON e2.k2 = trim(i.{k2})),
f AS (SELECT id, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS q FROM m WHERE id IS NOT NULL) WHERE q = 1 UNION ALL SELECT (SELECT max({id}) FROM e) + row_number() OVER (ORDER BY k), {cols} FROM m WHERE id IS NULL)
"""


#: What was collected before is stored, what was collected since comes in.
_OLD, _NEW = "coalesce(collected_at, TIMESTAMP '2000-01-01') < TIMESTAMP '2025-03-01'", "coalesce(collected_at, TIMESTAMP '2000-01-01') >= TIMESTAMP '2024-09-01'"


def _upserted(table: str, id: str, cols: list[str], k1: str, k2: str, overwrite: tuple = (), old: str = _OLD, new: str = _NEW) -> str:
    take = ", ".join(f"CASE WHEN f.id IS NULL THEN e.{c} ELSE {'f.' + c if c in overwrite else f'coalesce(f.{c}, e.{c})'} END AS {c}" for c in cols)
    return _MATCH.format(table=table, id=id, cols=", ".join(cols), k1=k1, k2=k2, old=old, new=new) + f"SELECT coalesce(e.{id}, f.id) AS {id}, {take}, CASE WHEN f.id IS NULL THEN 'kept' WHEN e.{id} IS NULL THEN 'inserted' ELSE 'updated' END AS change FROM e FULL JOIN f ON f.id = e.{id}"


def _stored_and_new(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """A table as it was stored once, and what came in later, known by its keys only; half a year is in both."""
    return df.filter(F.expr(_OLD)).drop("collected_at"), df.filter(F.expr(_NEW)).drop("collected_at").withColumnRenamed(id_col, "seq")


@query(_upserted("external_authors", "author_id", ["external_id", "display_name", "orcid"], "orcid", "display_name"))
def upsert_authors(spark, d):
    return E.upsert_authors(*_stored_and_new(table(spark, d, "external_authors", "author_id", "external_id", "display_name", "orcid", "collected_at"), "author_id"), "seq")


@query(_upserted("external_institutions", "institution_id", ["display_name", "ror", "country_code", "type"], "ror", "display_name"))
def upsert_institutions(spark, d):
    return E.upsert_institutions(*_stored_and_new(table(spark, d, "external_institutions", "institution_id", "display_name", "ror", "country_code", "type", "collected_at"), "institution_id"), "seq")


@query(_upserted("topics", "id", ["openalex_id", "name", "subfield_id"], "openalex_id", "name", ("name",), "domain_name <> 'Human Records'", "TRUE"))
def upsert_topics(spark, d):
    t, cols = V.topics(spark, d), ("id", "openalex_id", "name", "subfield_id")
    return E.upsert_topics(t.filter("domain_name <> 'Human Records'").select(*cols), t.select(*cols).withColumnRenamed("id", "seq"), "seq")


@query("SELECT DISTINCT keyword AS value FROM v_kw")
def insert_keywords(spark, d):
    k = V.paper_keywords(spark, d)
    known = k.join(V.papers(spark, d, "id", "is_indexed").filter("is_indexed"), F.col("paper_id") == F.col("id")).select(F.col("keyword").alias("value")).distinct()
    return E.insert_keywords(known, k.select(F.concat(F.lit(" "), F.upper("keyword")).alias("value")))


@query("+ e AS (SELECT min(id) AS id, field_name AS name FROM topics WHERE domain_name = 'Human Records' GROUP BY 2), n AS (SELECT DISTINCT trim(field_name) AS name FROM topics WHERE trim(field_name) NOT IN (SELECT name FROM e)) SELECT id, name, FALSE AS created FROM e UNION ALL SELECT (SELECT max(id) FROM e) + row_number() OVER (ORDER BY name), name, TRUE FROM n")
def ensure_field_names(spark, d):
    t = V.topics(spark, d)
    e = t.filter("domain_name = 'Human Records'").groupBy(F.col("field_name").alias("name")).agg(F.min("id").alias("id")).select("id", "name")
    return E.ensure_names(e, t.select(F.col("field_name").alias("name")))


@query("SELECT paper_id, topic_id, score FROM v_pt WHERE paper_id NOT IN (SELECT id FROM papers WHERE is_indexed) UNION ALL SELECT id, primary_topic_id, 1.0 FROM papers WHERE is_indexed AND primary_topic_id IS NOT NULL")
def replace_links(spark, d):
    """All links of indexed papers replaced by one to their primary topic."""
    p = V.papers(spark, d, "id", "primary_topic_id", "is_indexed").filter("is_indexed").select(F.col("id").alias("paper_id"), F.col("primary_topic_id").alias("topic_id"), F.lit(1.0).alias("score"))
    return E.replace_children(V.paper_topics(spark, d), p, p.filter("topic_id is not null"), ["paper_id"])


@query("SELECT DISTINCT openalex_id FROM papers WHERE NOT is_indexed AND openalex_id IN (SELECT openalex_id FROM papers WHERE is_indexed)")
def existing_record_keys(spark, d):
    p = V.papers(spark, d, "openalex_id", "is_indexed").filter("openalex_id is not null")
    return E.existing_keys(p.filter("is_indexed"), p.filter("not is_indexed"), ["openalex_id"])


@query("SELECT id, CASE WHEN abstract IS NOT NULL THEN TRUE ELSE is_indexed END AS is_indexed, CASE WHEN abstract IS NOT NULL THEN md5(title) END AS text_hash FROM papers")
def mark_indexed(spark, d):
    p = V.papers(spark, d, "id", "title", "is_indexed", "abstract")
    t = p.select("id", "is_indexed", F.lit(None).cast("string").alias("text_hash"))
    s = p.filter("abstract is not null").select("id", F.lit(True).alias("is_indexed"), F.md5("title").alias("text_hash"))
    return E.update_known(t, s, ["id"], ["is_indexed", "text_hash"])


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN publication_date IS NULL OR cited_by_count IS NULL OR cited_by_count < 0 THEN 'failed' WHEN is_indexed THEN 'updated' ELSE 'created' END AS outcome FROM papers) GROUP BY 1")
def import_outcomes(spark, d):
    p = V.papers(spark, d, "id", "publication_date", "cited_by_count", "is_indexed")
    checks = {"no date": F.col("publication_date").isNull(), "citations": F.col("cited_by_count").isNull() | (F.col("cited_by_count") < 0)}
    return E.import_checked(p, p.filter("is_indexed"), "id", checks)[2]


@query("SELECT 'u' || topic_id AS unit, count(CASE WHEN x IS NULL THEN 1 END) AS created, count(x) AS updated, CAST(0 AS BIGINT) AS skipped FROM v_pt LEFT JOIN (SELECT id AS x FROM papers WHERE is_indexed) ON x = paper_id GROUP BY 1")
def unit_outcomes(spark, d):
    m = V.paper_topics(spark, d).select(F.concat(F.lit("u"), F.col("topic_id").cast("string")).alias("unit"), "paper_id")
    return ingest.unit_outcomes(m, V.papers(spark, d, "id", "is_indexed").filter("is_indexed").select(F.col("id").alias("paper_id")), "paper_id")


@query("SELECT paper_id AS record_id, string_agg(DISTINCT 'u' || topic_id, ',' ORDER BY 'u' || topic_id) AS units FROM v_pt GROUP BY 1")
def merge_pages(spark, d):
    m = V.paper_topics(spark, d).select(F.concat(F.lit("u"), F.col("topic_id").cast("string")).alias("unit"), F.col("paper_id").alias("record_id"))
    return ingest.merge_pages(m).select("record_id", F.array_join("units", ",").alias("units"))


@query("SELECT topic_id, period_start, works_count FROM v_monthly WHERE period_start BETWEEN DATE '2019-03-01' AND DATE '2020-12-31' AND topic_id IN (SELECT id FROM topics WHERE subfield_id IN (1, 2, 3))")
def collect_topic_counts(spark, d):
    return ingest.collect_counts(V.monthly(spark, d), V.topics(spark, d), "2019-03-10", "2020-12-31", "subfield", subfield_ids=[1, 2, 3])


_ENT = """+ t AS (SELECT id, domain_name AS dn, field_name AS fn, subfield_id AS si, subfield_name AS sn, name, domain_name || ' > ' || field_name AS f_text, domain_name || ' > ' || field_name || ' > ' || subfield_name AS s_text FROM topics),
c AS (SELECT topic_id, count(*) AS n, count(CASE WHEN publication_date BETWEEN DATE '2020-12-31' - 365 AND DATE '2020-12-31' THEN 1 END) AS r FROM v_pt JOIN papers p ON p.id = paper_id GROUP BY 1),
ent AS (SELECT 'domain:' || dn AS point_id, 'domain' AS entity_type, min(dn) AS name, min(dn) AS text, NULL::BIGINT AS paper_count, NULL::BIGINT AS recent_count FROM t GROUP BY 1 UNION ALL SELECT 'field:' || fn, 'field', min(fn), min(f_text), NULL, NULL FROM t GROUP BY 1 UNION ALL SELECT 'subfield:' || si, 'subfield', min(sn), min(s_text), NULL, NULL FROM t GROUP BY 1
UNION ALL SELECT 'topic:' || id, 'topic', name, s_text || ' > ' || name, coalesce(n, 0), coalesce(r, 0) FROM t LEFT JOIN c ON c.topic_id = id UNION ALL SELECT DISTINCT 'keyword:' || keyword, 'keyword', keyword, keyword, NULL::BIGINT, NULL::BIGINT FROM v_kw) """


def _entities(spark, d):
    return ingest.entity_rows(V.topics(spark, d), V.paper_keywords(spark, d), V.paper_topics(spark, d), V.papers(spark, d, "id", "publication_date"), "2020-12-31")


@query(_ENT + "SELECT * FROM ent")
def entity_rows(spark, d):
    return _entities(spark, d)


@query(_ENT + "SELECT point_id FROM ent WHERE entity_type = 'topic' AND point_id NOT IN (SELECT 'topic:' || topic_id FROM v_pt JOIN papers ON id = paper_id WHERE is_indexed AND score >= 0.5)")
def entities_due(spark, d):
    stored = V.paper_topics(spark, d).filter("score >= 0.5").join(V.papers(spark, d, "id", "is_indexed").filter("is_indexed"), F.col("paper_id") == F.col("id")).select(F.concat(F.lit("topic:"), F.col("topic_id").cast("string")).alias("point_id")).distinct()
    return ingest.entities_due(_entities(spark, d), stored, entity_type="topic").select("point_id")


@query("SELECT i.id, CASE WHEN p.id IS NULL THEN 'missing' WHEN len(p.extracted_keywords) > 0 THEN 'skipped' ELSE 'ready' END AS status FROM (SELECT DISTINCT paper_id * 2 AS id FROM v_pt) i LEFT JOIN papers p ON p.id = i.id")
def extraction_status(spark, d):
    ids = V.paper_topics(spark, d).select((F.col("paper_id") * 2).alias("id"))
    return ingest.request_status(ids, V.papers(spark, d, "id", "extracted_keywords"), F.size("extracted_keywords") > 0)


_DQ = {
    "missing_date": ("papers without a date", "publication_date IS NULL"),
    "negative_citations": ("citations below zero", "cited_by_count < 0"),
    "year_differs": ("years other than that of the date", "publication_date IS NOT NULL AND publication_year <> year(publication_date)"),
    "future_date": ("papers of a later year than 2100", "publication_year > 2100"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS code, '{t}' AS description, count(CASE WHEN {c} THEN 1 END) AS count, coalesce(list_slice(list_sort(list(id) FILTER ({c})), 1, 5), []) AS sample FROM papers" for k, (t, c) in _DQ.items()))
def dq_described(spark, d):
    p = V.papers(spark, d, "id", "publication_date", "publication_year", "cited_by_count")
    return Q.described(p, {k: (t, F.expr(c)) for k, (t, c) in _DQ.items()}, "id")


@query("+ c AS (" + " UNION ALL ".join(f"SELECT count(CASE WHEN {c} THEN 1 END) AS n FROM papers" for _, c in _DQ.values()) + ") SELECT count(*) AS checks, count(CASE WHEN n > 0 THEN 1 END) AS failing, CAST(sum(n) AS BIGINT) AS issues, CAST(sum(n) AS BIGINT) AS issues_before, CAST(NULL AS BIGINT) AS fixes FROM c")
def dq_report(spark, d):
    c = Q.checks(V.papers(spark, d, "publication_date", "publication_year", "cited_by_count"), {k: F.expr(c) for k, (_, c) in _DQ.items()})
    return Q.report_totals(c, c)


_GRID = "+ grid AS (SELECT o.id AS topic_id, CAST(g AS DATE) AS m FROM topics o, generate_series(DATE '2020-01-01', DATE '2020-12-01', INTERVAL 1 MONTH) x(g)), dyn AS (SELECT DISTINCT topic_id, period_start AS m FROM v_monthly WHERE works_count >= 2), rep AS (SELECT DISTINCT topic_id, CAST(date_trunc('quarter', period_start) AS DATE) AS m FROM v_monthly WHERE works_count >= 3) "


def _coverages(spark, d):
    t = V.topics(spark, d).select(F.col("id").alias("topic_id"))
    m = V.monthly(spark, d)
    stored = m.filter("works_count >= 2").select(F.concat(F.lit("topic:"), F.col("topic_id").cast("string")).alias("cluster_key"), "period_start")
    reports = m.filter("works_count >= 3").select("topic_id", dates.quarter_key(F.col("period_start")).alias("period_key")).distinct()
    return Q.period_coverage(t, dates.months(spark, "2020-01-01", "2020-12-31"), stored), Q.key_coverage(t, dates.quarters(spark, "2020-01-01", "2020-12-31"), reports)


@query(_GRID + "SELECT g.topic_id, count(*) AS expected, count(d.m) AS covered, count(*) - count(d.m) AS missing FROM grid g LEFT JOIN dyn d ON d.topic_id = g.topic_id AND d.m = g.m GROUP BY 1")
def coverage_cluster_dynamics(spark, d):
    return Q.coverage_by(_coverages(spark, d)[0], "topic_id")


@query(_GRID + "SELECT g.topic_id, count(*) AS expected, count(d.m) AS covered, count(*) - count(d.m) AS missing FROM (SELECT * FROM grid WHERE month(m) IN (1, 4, 7, 10)) g LEFT JOIN rep d ON d.topic_id = g.topic_id AND d.m = g.m GROUP BY 1")
def coverage_quarter_reports(spark, d):
    return Q.coverage_by(_coverages(spark, d)[1], "topic_id")


@query(_GRID + ", a AS (SELECT 'cluster_dynamics' AS code, g.topic_id, count(*) AS e, count(d.m) AS c FROM grid g LEFT JOIN dyn d ON d.topic_id = g.topic_id AND d.m = g.m GROUP BY 1, 2 UNION ALL SELECT 'quarter_reports', g.topic_id, count(*), count(d.m) FROM (SELECT * FROM grid WHERE month(m) IN (1, 4, 7, 10)) g LEFT JOIN rep d ON d.topic_id = g.topic_id AND d.m = g.m GROUP BY 1, 2) SELECT code, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(c) AS BIGINT) AS covered, CAST(sum(e - c) AS BIGINT) AS missing, count(CASE WHEN c = 0 THEN 1 END) AS topics_without FROM a GROUP BY 1")
def coverage_summary(spark, d):
    a, b = _coverages(spark, d)
    return Q.coverage_summary({"cluster_dynamics": a, "quarter_reports": b})


@query(_GRID + "SELECT 'cluster-dynamics' AS panel, m AS period_start, CAST(floor((r - 1) / 30) AS BIGINT) AS chunk, string_agg(topic_id, ',' ORDER BY topic_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY topic_id) AS r FROM (SELECT g.* FROM grid g LEFT JOIN dyn d ON d.topic_id = g.topic_id AND d.m = g.m WHERE d.m IS NULL)) GROUP BY m, floor((r - 1) / 30)")
def panel_tasks(spark, d):
    missing = _coverages(spark, d)[0].filter("not covered")
    return Q.panel_tasks(missing, "cluster-dynamics", 30).select("panel", "period_start", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT user_id AS worker, max(ts) AS last_beat, epoch(TIMESTAMP '2024-01-01') - floor(epoch(max(ts))) <= 86400 * 30 AS alive FROM events GROUP BY 1")
def worker_heartbeats(spark, d):
    b = table(spark, d, "events", "user_id", "ts").select(F.col("user_id").alias("worker"), "ts")
    return K.heartbeats(b, "2024-01-01 00:00:00", 86_400 * 30)


@query("SELECT date_trunc('second', ts) AS second, count(*) AS n, greatest(count(*) - 1, 0) AS over FROM events GROUP BY 1")
def request_rates(spark, d):
    return K.request_rates(table(spark, d, "events", "ts"), "ts", 1)
