"""Text and date functions, merges, data quality, coverage and ingest as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, scoring, text
from ..operators import ingest
from ..operators import keyphrases as KP
from ..operators import merge as M
from ..operators import quality as Q
from ..sources import views as V
from ..sources.parquet import table
from ..streaming import workflow as W

QUERIES, SQL = {}, {}


def query(body: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if body:
            SQL[f.__name__] = V.sql(body)
        return f

    return add


_DOI = "nullif(trim(regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|doi:)', '')), '')"


@query(f"SELECT id, {_DOI} AS doi FROM papers")
def normalize_doi(spark: SparkSession, d: str) -> DataFrame:
    return V.papers(spark, d, "id", "doi").select("id", text.normalize_doi(F.col("doi")).alias("doi"))


@query("SELECT id, nullif(lower(regexp_replace(trim(openalex_id), '/+$', '')), '') AS external_id FROM papers")
def normalize_external_id(spark, d):
    return V.papers(spark, d, "id", "openalex_id").select("id", text.normalize_external_id(F.col("openalex_id")).alias("external_id"))


_EMB = "concat_ws(chr(10), 'Title: ' || title, 'Abstract: ' || abstract, 'Keywords: ' || keywords)"
_EMB_FROM = "(SELECT id, nullif(trim(regexp_replace(title, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '') AS title, nullif(trim(regexp_replace(abstract, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '') AS abstract, nullif(array_to_string(list_filter(list_transform(extracted_keywords, lambda x: nullif(trim(regexp_replace(x, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '')), lambda x: x IS NOT NULL), ', '), '') AS keywords FROM papers)"


def _embedding(spark, d):
    p = V.papers(spark, d, "id", "title", "abstract", "extracted_keywords")
    return p.select("id", text.embedding_text(F.col("title"), F.col("abstract"), F.lit(None).cast("array<string>"), F.col("extracted_keywords")).alias("t"))


@query(f"SELECT id, {_EMB} AS embedding_text FROM {_EMB_FROM}")
def embedding_text(spark, d):
    return _embedding(spark, d).select("id", F.col("t").alias("embedding_text"))


@query(f"SELECT id, sha256({_EMB}) AS text_hash FROM {_EMB_FROM}")
def text_hash(spark, d):
    return _embedding(spark, d).select("id", text.text_hash(F.col("t")).alias("text_hash"))


@query("SELECT id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substring(t, 1, 117)) || '...' END AS short FROM (SELECT id, nullif(trim(regexp_replace(abstract, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '') AS t FROM papers)")
def truncated_abstracts(spark, d):
    return V.papers(spark, d, "id", "abstract").select("id", text.truncate(F.col("abstract"), 120).alias("short"))


@query("SELECT topic_id, coalesce(try_cast(nullif(regexp_extract(cluster_key, '^topic:(\\d{1,18})$', 1), '') AS BIGINT), -1) AS parsed FROM (SELECT id AS topic_id, CASE WHEN id % 7 = 0 THEN 'cluster:' || id ELSE 'topic:' || id END AS cluster_key FROM topics)")
def cluster_keys(spark, d):
    key = F.concat(F.when(F.col("id") % 7 == 0, "cluster:").otherwise("topic:"), F.col("id").cast("string"))
    return V.topics(spark, d).select(F.col("id").alias("topic_id"), text.topic_of_cluster(key).alias("parsed"))


@query("SELECT strftime(CAST(g AS DATE), '%Y-%m') AS period_key, greatest(CASE WHEN month(CAST(g AS DATE)) = 1 THEN CAST(g AS DATE) + 1 ELSE CAST(g AS DATE) END, DATE '2018-11-17') AS period_start, least(last_day(CAST(g AS DATE)), DATE '2020-02-09') AS period_end FROM generate_series(DATE '2018-11-01', DATE '2020-02-01', INTERVAL 1 MONTH) x(g)")
def clipped_month_periods(spark, d):
    return dates.load_periods(spark, "2018-11-17", "2020-02-09").select(dates.month_key(F.col("period_start")).alias("period_key"), "period_start", "period_end")


@query("SELECT year(CAST(g AS DATE)) || '-Q' || quarter(CAST(g AS DATE)) AS period_key, CAST(g AS DATE) AS period_start, CAST(CAST(g AS DATE) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end FROM generate_series(DATE '2018-10-01', DATE '2020-01-01', INTERVAL 3 MONTH) x(g)")
def quarter_periods(spark, d):
    return dates.quarters(spark, "2018-11-17", "2020-02-09")


@query("SELECT id, CAST(floor(10000 / 400) + CASE WHEN id - 1 < 10007 % 400 THEN 1 ELSE 0 END AS BIGINT) AS quota FROM topics")
def equal_quotas(spark, d):
    return V.topics(spark, d).select("id", scoring.quota(F.lit(10007), 400, F.col("id") - 1).alias("quota"))


@query("+ k AS (SELECT p.id, list_concat([coalesce(o.subfield_name, ''), ' ' || coalesce(o.field_name, '') || ' '], coalesce(p.extracted_keywords, [])) AS a FROM papers p LEFT JOIN topics o ON o.id = p.primary_topic_id), u AS (SELECT id, trim(unnest(a)) AS w, generate_subscripts(a, 1) AS i FROM k) SELECT id, string_agg(w, '|' ORDER BY i) AS keywords FROM (SELECT id, w, i, row_number() OVER (PARTITION BY id, lower(w) ORDER BY i) AS r FROM u WHERE w <> '') WHERE r = 1 GROUP BY 1")
def merge_keyword_values(spark, d):
    t = V.topics(spark, d).select(F.col("id").alias("primary_topic_id"), "subfield_name", "field_name")
    x = V.papers(spark, d, "id", "primary_topic_id", "extracted_keywords").join(t, "primary_topic_id", "left")
    tax = F.array(F.col("subfield_name"), F.concat(F.lit(" "), F.col("field_name"), F.lit(" ")))
    return x.select("id", F.array_join(text.merge_keywords(tax, F.col("extracted_keywords")), "|").alias("keywords")).filter("keywords <> ''")


@query("SELECT id, array_to_string(list_transform(string_split(title, ' '), lambda x: x), ' ') AS abstract_text FROM papers WHERE title <> '' AND title NOT LIKE '%  %'")
def inverted_index_text(spark, d):
    """Titles as inverted indexes and back: token -> positions, then the text by position."""
    p = V.papers(spark, d, "id", "title").filter("title <> '' and title not like '%  %'")
    words = F.split("title", " ")
    index = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("key"), F.transform(F.filter(F.transform(words, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] == w), lambda s: s["i"]).alias("value")))
    return p.select("id", text.inverted_index_text(F.map_from_entries(index)).alias("abstract_text"))


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_CAND = "regexp_extract_all(lower(k), '([a-z0-9]+(?:-[a-z0-9]+)*)', 1)"


@query(f"SELECT DISTINCT k AS keyword, array_to_string({_CAND}, ' ') AS candidate FROM (SELECT unnest(extracted_keywords) AS k FROM papers) WHERE len({_CAND}) BETWEEN 1 AND 4 AND regexp_matches(array_to_string({_CAND}, ' '), '[a-z]') AND {_CAND}[1] NOT IN ({_STOP}) AND {_CAND}[-1] NOT IN ({_STOP})")
def keyphrase_candidates(spark, d):
    k = V.papers(spark, d, "extracted_keywords").select(F.explode("extracted_keywords").alias("keyword")).distinct()
    return k.select("keyword", text.candidate(F.col("keyword")).alias("candidate")).filter("candidate is not null")


# merges


def _source(spark, d):
    """The later half of the papers as a source of changes: a title always, an abstract for some."""
    p = V.papers(spark, d, "id", "title", "abstract", "cited_by_count")
    return p.filter("id % 2 = 0").select((F.floor(F.col("id") / 4) * 4).cast("bigint").alias("id"), F.concat(F.col("title"), F.lit(" *")).alias("title"), F.when(F.col("id") % 3 == 0, F.col("abstract")).alias("abstract"), F.col("id").alias("seq"))


@query("""+ s AS (SELECT CAST(floor(id / 4) * 4 AS BIGINT) AS id, title || ' *' AS title, CASE WHEN id % 3 = 0 THEN abstract END AS abstract, id AS seq FROM papers WHERE id % 2 = 0),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM s) WHERE r = 1),
t AS (SELECT id, title, abstract FROM papers WHERE id % 5 <> 0)
SELECT coalesce(t.id, l.id) AS id, CASE WHEN l.id IS NOT NULL THEN l.title ELSE t.title END AS title, md5(coalesce(l.abstract, t.abstract)) AS abstract_md5, CASE WHEN t.id IS NOT NULL AND l.id IS NOT NULL THEN 'updated' WHEN l.id IS NOT NULL THEN 'inserted' ELSE 'kept' END AS change FROM t FULL JOIN l ON l.id = t.id""")
def merge_papers_coalesce(spark, d):
    t = V.papers(spark, d, "id", "title", "abstract").filter("id % 5 <> 0")
    m = M.merge(t, _source(spark, d), ["id"], {"title": "overwrite", "abstract": "coalesce"}, "seq")
    return m.select("id", "title", F.md5("abstract").alias("abstract_md5"), "change")


@query("""+ s AS (SELECT paper_id, topic_id, score, CASE WHEN score IS NULL THEN CASE WHEN paper_id % 2 = 1 THEN 1000004 ELSE -1 END ELSE CAST(floor(score * 1e6) AS BIGINT) * 7919 % 1000003 END AS seq FROM paper_topics WHERE paper_id IS NOT NULL AND topic_id IS NOT NULL)
SELECT paper_id, topic_id, score FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, topic_id ORDER BY seq DESC) AS r FROM s) WHERE r = 1""")
def merge_links_last_wins(spark, d):
    """The last of repeated links, in an order that has nothing to do with the size of the score; a null that comes last stays."""
    place = F.when(F.col("score").isNull(), F.when(F.col("paper_id") % 2 == 1, 1_000_004).otherwise(-1)).otherwise(F.floor(F.col("score") * 1e6).cast("bigint") * 7919 % 1_000_003)
    s = table(spark, d, "paper_topics").filter("paper_id is not null and topic_id is not null").withColumn("seq", place)
    return M.dedupe(s, ["paper_id", "topic_id"], "seq").drop("seq")


@query("SELECT topic_id, stat_year, works_count, artificial FROM (SELECT coalesce(a.topic_id, b.topic_id) AS topic_id, coalesce(a.y, b.y) AS stat_year, coalesce(a.w, 0) AS works_count, CASE WHEN b.topic_id IS NOT NULL THEN b.e ELSE 0 END AS artificial FROM (SELECT topic_id, CAST(year(period_start) AS INT) AS y, CAST(sum(works_count) AS BIGINT) AS w FROM v_monthly WHERE year(period_start) < 2020 GROUP BY 1, 2) a FULL JOIN (SELECT topic_id, CAST(year(period_start) AS INT) AS y, count(*) AS e FROM v_monthly WHERE year(period_start) > 2018 GROUP BY 1, 2) b ON a.topic_id = b.topic_id AND a.y = b.y)")
def merge_partial_estimate(spark, d):
    """An upsert that touches the estimate only; works of a new row are 0."""
    m = V.monthly(spark, d).withColumn("stat_year", F.year("period_start"))
    t = m.filter("stat_year < 2020").groupBy("topic_id", "stat_year").agg(F.sum("works_count").cast("bigint").alias("works_count")).withColumn("artificial", F.lit(0).cast("bigint"))
    s = m.filter("stat_year > 2018").groupBy("topic_id", "stat_year").agg(F.count("*").alias("artificial")).withColumn("works_count", F.lit(0).cast("bigint"))
    return M.merge(t, s, ["topic_id", "stat_year"], {"artificial": "overwrite", "works_count": "keep"}).drop("change")


@query("SELECT topic_id, period_start, works_count FROM v_monthly WHERE topic_id IN (SELECT id FROM topics WHERE field_name <> 'Networks Science')")
def prune_missing(spark, d):
    keep = V.topics(spark, d).filter("field_name <> 'Networks Science'").select(F.col("id").alias("topic_id"))
    return M.prune_missing(V.monthly(spark, d), keep, ["topic_id"])


@query("SELECT paper_id, topic_id FROM (SELECT paper_id, topic_id, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC NULLS LAST, topic_id) AS r FROM v_pt) WHERE r = 1")
def primary_topic_assignment(spark, d):
    return M.primary_topics(V.paper_topics(spark, d))


@query("+ x AS (SELECT *, CASE WHEN coalesce(length(trim(title)), 0) = 0 THEN 'no_title' WHEN coalesce(length(trim(abstract)), 0) = 0 THEN 'no_abstract' END AS why FROM papers), y AS (SELECT CASE WHEN why IS NOT NULL THEN why WHEN openalex_id IS NOT NULL AND row_number() OVER (PARTITION BY openalex_id, why IS NULL ORDER BY id) > 1 THEN 'duplicate' ELSE 'loaded' END AS outcome FROM x) SELECT outcome, count(*) AS n FROM y GROUP BY 1")
def prepare_import_first_wins(spark, d):
    return M.prepare_import(V.papers(spark, d, "id", "title", "abstract", "openalex_id"), "openalex_id", "id")[1]


@query("SELECT user_id, paper_id FROM v_fav WHERE paper_id % 3 <> 0 UNION SELECT user_id, paper_id FROM v_fav WHERE paper_id % 5 = 0")
def favourites_add(spark, d):
    f = V.favourites(spark, d).select("user_id", "paper_id")
    return M.add_links(f.filter("paper_id % 3 <> 0"), f.filter("paper_id % 5 = 0"), ["user_id", "paper_id"])


@query("""+ t AS (SELECT id AS paper_id, 'https://a.example/' || id AS landing_url, id % 2 = 0 AS is_best FROM papers), s AS (SELECT id AS paper_id, CASE WHEN id % 3 = 0 THEN 'https://a.example/' ELSE 'https://b.example/' END || id AS landing_url, id % 4 = 0 AS is_best FROM papers WHERE id % 2 = 0)
SELECT coalesce(t.paper_id, s.paper_id) AS paper_id, coalesce(t.landing_url, s.landing_url) AS landing_url, CASE WHEN s.paper_id IS NOT NULL THEN s.is_best WHEN t.paper_id IN (SELECT paper_id FROM s WHERE is_best) THEN FALSE ELSE t.is_best END AS is_best FROM t FULL JOIN s ON s.paper_id = t.paper_id AND s.landing_url = t.landing_url""")
def landing_best_flag(spark, d):
    p = V.papers(spark, d, "id")
    url = lambda h: F.concat(F.lit(f"https://{h}.example/"), F.col("id").cast("string"))
    t = p.select(F.col("id").alias("paper_id"), url("a").alias("landing_url"), (F.col("id") % 2 == 0).alias("is_best"))
    s = p.filter("id % 2 = 0").select(F.col("id").alias("paper_id"), F.when(F.col("id") % 3 == 0, url("a")).otherwise(url("b")).alias("landing_url"), (F.col("id") % 4 == 0).alias("is_best"))
    return M.best_landing(t, s)


_LAND = "(SELECT id AS paper_id, 'https://doi.example/' || doi AS landing_url, is_open_access AS is_best FROM papers WHERE doi IS NOT NULL UNION ALL SELECT id, 'https://work.example/' || openalex_id, FALSE FROM papers WHERE openalex_id IS NOT NULL)"


@query(f"SELECT paper_id, landing_url, is_best, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY is_best DESC NULLS LAST, landing_url) AS INT) AS place FROM {_LAND}")
def landings_listed(spark, d):
    p = V.papers(spark, d, "id", "doi", "openalex_id", "is_open_access")
    a = p.filter("doi is not null").select(F.col("id").alias("paper_id"), F.concat(F.lit("https://doi.example/"), "doi").alias("landing_url"), F.col("is_open_access").alias("is_best"))
    b = p.filter("openalex_id is not null").select(F.col("id").alias("paper_id"), F.concat(F.lit("https://work.example/"), "openalex_id").alias("landing_url"), F.lit(False).alias("is_best"))
    return M.listed_landings(a.unionByName(b))


@query("+ x AS (SELECT record_id, external_id, unnest(authors) AS a, generate_subscripts(authors, 1) AS i FROM external_papers WHERE external_id IS NOT NULL) SELECT record_id, regexp_extract(regexp_replace(external_id, '/+$', ''), '[^/]*$') AS paper_key, coalesce(regexp_extract(regexp_replace(a.external_id, '/+$', ''), '[^/]*$'), lower(trim(a.display_name))) AS author_key, trim(a.display_name) AS display_name, CAST(i AS INT) AS author_order FROM x WHERE a IS NOT NULL")
def works_normalized(spark, d):
    """Records of the feed as JSON work records, normalised again: their authors in order."""
    x = table(spark, d, "external_papers", "record_id", "external_id", "authors").filter("external_id is not null")
    who = F.transform("authors", lambda a: F.when(a.isNotNull(), F.struct(F.struct(a["external_id"].alias("id"), a["display_name"].alias("display_name"), a["orcid"].alias("orcid")).alias("author"), a["is_corresponding"].alias("is_corresponding"))))
    # the record's number rides on the work's id, so that equal works of several records stay apart
    work = F.concat(F.regexp_replace("external_id", "/+$", ""), F.lit("#"), F.col("record_id").cast("string"))
    a = ingest.normalize_works(x.select(F.to_json(F.struct(work.alias("id"), who.alias("authorships"))).alias("raw")))["authors"]
    return a.select(F.substring_index("paper_key", "#", -1).cast("bigint").alias("record_id"), F.substring_index("paper_key", "#", 1).alias("paper_key"), "author_key", "display_name", "author_order")


# quality and coverage

_TESTS = {
    "missing_doi": "doi IS NULL OR length(trim(doi)) = 0",
    "missing_abstract": "abstract IS NULL OR length(trim(abstract)) = 0",
    "missing_language": "language IS NULL OR length(trim(language)) = 0",
    "missing_date": "publication_date IS NULL",
    "year_differs": "publication_date IS NOT NULL AND publication_year <> year(publication_date)",
    "negative_citations": "cited_by_count < 0",
    "missing_primary_topic": "primary_topic_id IS NULL",
    "no_keywords": "extracted_keywords IS NULL",
    "untrimmed_title": "title <> trim(title)",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS code, count(CASE WHEN {c} THEN 1 END) AS count FROM papers" for k, c in _TESTS.items()))
def dq_checks(spark, d):
    p = V.papers(spark, d, "title", "doi", "abstract", "language", "publication_date", "publication_year", "cited_by_count", "primary_topic_id", "extracted_keywords")
    return Q.checks(p, {k: F.expr(c) for k, c in _TESTS.items()})


@query(f"SELECT {_DOI} AS key, count(*) AS n, min(id) AS first_id FROM papers WHERE {_DOI} IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dq_duplicate_keys(spark, d):
    return Q.duplicate_keys(V.papers(spark, d, "id", "doi"), text.normalize_doi(F.col("doi")), "id")


@query(f"SELECT id, doi AS old, new FROM (SELECT id, doi, {_DOI} AS new, count(*) OVER (PARTITION BY {_DOI}) AS n FROM papers) WHERE n = 1 AND new IS NOT NULL AND doi IS DISTINCT FROM new")
def dq_safe_fix_plan(spark, d):
    return Q.safe_fix(V.papers(spark, d, "id", "doi"), "doi", text.normalize_doi(F.col("doi")), "id")


@query("SELECT id, title AS old, trim(title) AS new FROM papers WHERE title <> trim(title) AND trim(title) <> ''")
def dq_trim_plan(spark, d):
    return Q.trimmed(V.papers(spark, d, "id", "title"), "title", "id")


@query("+ k AS (SELECT DISTINCT w, lower(trim(w)) AS n FROM (SELECT unnest(extracted_keywords) AS w FROM papers) WHERE w IS NOT NULL) SELECT w AS id, w AS old, n AS new FROM k WHERE n <> '' AND w <> n AND n IN (SELECT n FROM k GROUP BY n HAVING count(*) = 1)")
def dq_keyword_plan(spark, d):
    """Keywords to write in lower case, unless another one is written so already."""
    k = V.papers(spark, d, "extracted_keywords").select(F.explode("extracted_keywords").alias("w")).filter("w is not null").distinct()
    return Q.safe_fix(k, "w", text.normalize_keyword(F.col("w")), "w")


_COV = """+ grid AS (SELECT o.id AS topic_id, CAST(g AS DATE) AS period_start FROM topics o, generate_series(DATE '2020-01-01', DATE '2020-12-01', INTERVAL 1 MONTH) x(g)),
cov AS (SELECT g.topic_id, g.period_start, m.topic_id IS NOT NULL AS covered FROM grid g LEFT JOIN v_monthly m ON m.topic_id = g.topic_id AND m.period_start = g.period_start) """


def _cov(spark, d):
    t = V.topics(spark, d).select(F.col("id").alias("topic_id"))
    return Q.coverage(t, dates.months(spark, "2020-01-01", "2020-12-31"), V.monthly(spark, d))


def _by(k):
    return f"SELECT {k}, count(*) AS expected, count(CASE WHEN covered THEN 1 END) AS covered, count(CASE WHEN NOT covered THEN 1 END) AS missing FROM cov GROUP BY 1"


@query(_COV + _by("topic_id"))
def coverage_topic_months(spark, d):
    return Q.coverage_by(_cov(spark, d), "topic_id")


@query(_COV + _by("period_start"))
def coverage_missing_by_period(spark, d):
    return Q.coverage_by(_cov(spark, d), "period_start")


@query(_COV + "SELECT topic_id, period_start FROM cov WHERE NOT covered AND topic_id NOT IN (SELECT topic_id FROM cov WHERE covered)")
def coverage_uncovered_topics(spark, d):
    c = _cov(spark, d)
    return c.filter("not covered").join(c.filter("covered").select("topic_id").distinct(), "topic_id", "left_anti").select("topic_id", "period_start")


_PN = "SELECT DISTINCT primary_topic_id FROM papers WHERE primary_topic_id IS NOT NULL AND publication_date BETWEEN DATE '2020-03-01' AND DATE '2020-03-31'"


@query(f"SELECT 'sample-papers' AS panel, primary_topic_id AS topic_id FROM ({_PN}) UNION ALL SELECT 'indexing', primary_topic_id FROM ({_PN} AND is_indexed) UNION ALL SELECT 'keyphrases', primary_topic_id FROM ({_PN} AND len(extracted_keywords) > 0) UNION ALL SELECT 'monthly-stats', topic_id FROM v_monthly WHERE period_start = DATE '2020-03-01' UNION ALL SELECT 'cluster-dynamics', topic_id FROM (SELECT DISTINCT topic_id FROM v_monthly WHERE period_start BETWEEN DATE '2020-02-01' AND DATE '2020-03-31' AND works_count >= 2 AND last_day(period_start) >= DATE '2020-03-01') UNION ALL SELECT 'quarter-reports', topic_id FROM (SELECT DISTINCT topic_id FROM v_monthly WHERE period_start BETWEEN DATE '2020-01-01' AND DATE '2020-03-01' AND works_count >= 3)")
def coverage_panels(spark, d):
    """Topics of all six panels in March 2020; periods are stored for months of two works and more, reports for the quarters of months of three."""
    p = V.papers(spark, d, "primary_topic_id", "publication_date", "is_indexed", "extracted_keywords")
    m = V.monthly(spark, d)
    periods = m.filter("works_count >= 2").select("topic_id", "period_start", F.last_day("period_start").alias("period_end"))
    q = F.trunc("period_start", "QUARTER")
    reports = m.filter("works_count >= 3").select("topic_id", q.alias("period_start"), F.date_sub(F.add_months(q, 3), 1).alias("period_end")).distinct()
    return W.covered_topics(p, m, periods, reports, "2020-03-01", "2020-03-31")


@query(f"SELECT id, CASE WHEN NOT (length(coalesce(trim(language), '')) = 0 OR lower(trim(language)) LIKE 'en%') THEN 'skipped' ELSE 'taken' END AS status FROM papers")
def keyphrase_status(spark, d):
    """Which papers the extraction takes and which it skips for their language."""
    s = KP.extract_papers(V.papers(spark, d, "id", "title", "abstract", "language"))[1]
    return s.select("id", F.when(F.col("status") == "skipped", "skipped").otherwise("taken").alias("status"))


@query(_COV + "SELECT period_start, CAST(floor((r - 1) / 50) AS BIGINT) AS chunk, count(*) AS n, min(topic_id) AS first_id, max(topic_id) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY period_start ORDER BY topic_id) AS r FROM cov WHERE NOT covered) GROUP BY 1, 2")
def missing_sample_tasks(spark, d):
    c = Q.chunks(_cov(spark, d).filter("not covered"), ["period_start"], "topic_id", 50)
    return c.select("period_start", "chunk", F.size("ids").cast("bigint").alias("n"), F.array_min("ids").alias("first_id"), F.array_max("ids").alias("last_id"))


_STORED = _EMB_FROM.replace("extracted_keywords", "CASE WHEN updated_at > TIMESTAMP '2024-06-01' THEN NULL ELSE extracted_keywords END").replace("FROM papers", "FROM papers WHERE is_indexed")


@query(f"SELECT n.id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.h IS NOT DISTINCT FROM o.h THEN 'unchanged' ELSE 'changed' END AS status FROM (SELECT id, sha256({_EMB}) AS h FROM {_EMB_FROM}) n LEFT JOIN (SELECT id, sha256({_EMB}) AS h FROM {_STORED}) o ON o.id = n.id")
def indexing_plan(spark, d):
    """Which papers to index: those whose text hash differs from the stored one. Stored are the hashes of indexed papers, of those
    updated since June 2024 as they were without keywords."""
    now = _embedding(spark, d).select("id", text.text_hash(F.col("t")).alias("hash"))
    p = V.papers(spark, d, "id", "title", "abstract", "extracted_keywords", "is_indexed", "updated_at").filter("is_indexed")
    before = F.when(F.col("updated_at") > F.to_timestamp(F.lit("2024-06-01")), None).otherwise(F.col("extracted_keywords"))
    old = p.select("id", text.text_hash(text.embedding_text(F.col("title"), F.col("abstract"), F.lit(None).cast("array<string>"), before)).alias("hash"))
    return ingest.indexing_status(now, old, "id")


@query("SELECT paper_id, topic_id, round(CASE WHEN s > 0 THEN (score - m) / s WHEN score IS NOT NULL THEN 0 END, 6) AS z FROM (SELECT *, avg(score) OVER (PARTITION BY paper_id) AS m, stddev_pop(score) OVER (PARTITION BY paper_id) AS s FROM v_pt)")
def doc_zscore(spark, d):
    x = KP.doc_zscores(V.paper_topics(spark, d), "paper_id", "score")
    return x.select("paper_id", "topic_id", F.round("z", 6).alias("z"))


@query("""+ w AS (SELECT paper_id, keyword, string_split(keyword, ' ') AS t FROM v_kw)
SELECT a.paper_id, a.keyword AS term, coalesce(bool_or(len(b.t) > len(a.t) AND contains(b.keyword, a.keyword)), FALSE) AS within, coalesce(bool_or(len(b.t) < len(a.t) AND contains(a.keyword, b.keyword)), FALSE) AS holds,
round(coalesce(max(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE)), 0), 6) AS overlap FROM w a LEFT JOIN w b ON b.paper_id = a.paper_id AND b.keyword <> a.keyword GROUP BY 1, 2""")
def candidate_jaccard(spark, d):
    k = V.papers(spark, d, "id", "extracted_keywords").select(F.col("id").alias("paper_id"), F.filter(F.transform("extracted_keywords", lambda w: F.lower(F.trim(w))), lambda w: w != "").alias("terms"))
    return KP.candidate_overlap(k, "paper_id", "terms").withColumn("overlap", F.round("overlap", 6))


@query(None)
def keyphrases_topk(spark, d):
    """Ten keyphrases of title and abstract of the papers labelled as English or not at all."""
    p = V.papers(spark, d, "id", "title", "abstract", "language").filter(text.is_blank(F.col("language")) | F.lower(F.trim("language")).startswith("en"))
    return KP.extract_documents(p.select("id", F.concat_ws("\n", "title", "abstract").alias("text")), "id", "text")
