"""Clusters, their periods, charts and quarter reports put together, as queries over all topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import vectors
from ..operators import charts
from ..operators import cluster_tables as T
from ..operators import profiles as U
from ..operators import reports as P
from ..sources import views as V
from . import analytics as A

QUERIES, SQL = {}, {}
AS_OF, FROM, TO = A.AS_OF, "2019-03-10", "2020-06-20"


def query(body: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if body:
            SQL[f.__name__] = V.sql(body)
        return f

    return add


_SOFT = """sv AS (SELECT t.topic_id, v.paper_id, v.publication_date, v.vector FROM v_pt t JOIN v_vec v ON v.paper_id = t.paper_id),
sc0 AS (SELECT topic_id, i, avg(vector[i]) AS m, count(*) AS n FROM sv, generate_series(1, 64) g(i) GROUP BY 1, 2), sc AS (SELECT topic_id, list(m ORDER BY i) AS centroid, max(n) AS n FROM sc0 GROUP BY 1),
ss AS (SELECT sv.topic_id, paper_id, round(greatest(-1, least(1, list_cosine_similarity(vector, centroid))), 6) AS s FROM sv JOIN sc ON sc.topic_id = sv.topic_id),
sr AS (SELECT topic_id, string_agg(paper_id, '|' ORDER BY r) AS reps FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY s DESC, paper_id) AS r FROM ss) WHERE r <= 5 GROUP BY 1),
sk AS (SELECT topic_id, string_agg(keyword, '|' ORDER BY r) AS kws FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, keyword) AS r FROM (SELECT topic_id, keyword, count(*) AS n FROM v_pt JOIN v_kw USING (paper_id) GROUP BY 1, 2)) WHERE r <= 10 GROUP BY 1)"""
_CL = A._MET.rstrip() + ", " + _SOFT + """, cl AS (SELECT 'topic:' || o.id AS cluster_key, o.id AS topic_id, o.name, CASE WHEN coalesce(sc.n, 0) >= 2 THEN 'ok' ELSE 'skipped' END AS outcome, coalesce(sc.n, 0) AS n_vectors, coalesce(met.paper_count, 0) AS paper_count, met.growth_90d, met.trend_score, met.status, met.citations, met.citations / CAST(met.paper_count AS DOUBLE) AS avg_citations, sk.kws, sr.reps, sc.centroid FROM topics o LEFT JOIN sc ON sc.topic_id = o.id LEFT JOIN met ON met.topic_id = o.id LEFT JOIN sk ON sk.topic_id = o.id LEFT JOIN sr ON sr.topic_id = o.id) """


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return api.recompute_clusters(spark, d, AS_OF)


@query(_CL + "SELECT cluster_key, topic_id, name, outcome, n_vectors, paper_count, CASE WHEN outcome = 'ok' THEN round(trend_score, 6) END AS trend_score, CASE WHEN outcome = 'ok' THEN status END AS status, CASE WHEN outcome = 'ok' THEN citations END AS citations, CASE WHEN outcome = 'ok' THEN round(avg_citations, 6) END AS avg_citations, CASE WHEN outcome = 'ok' THEN kws END AS keywords, CASE WHEN outcome = 'ok' THEN reps END AS representatives, CASE WHEN outcome = 'ok' THEN round(sqrt(list_sum(list_transform(centroid, lambda x: x * x))), 6) END AS norm FROM cl")
def clusters_recomputed(spark, d):
    x = _clusters(spark, d)
    return x.select("cluster_key", "topic_id", "name", "outcome", "n_vectors", "paper_count", F.round("trend_score", 6).alias("trend_score"), "status", "citations", F.round("avg_citations", 6).alias("avg_citations"), F.array_join("top_keywords", "|").alias("keywords"), F.array_join(F.col("representatives").cast("array<string>"), "|").alias("representatives"), F.round(vectors.norm(F.col("centroid")), 6).alias("norm"))


@query(_CL + "SELECT outcome, count(*) AS n FROM cl GROUP BY 1")
def cluster_outcomes(spark, d):
    return T.outcomes(_clusters(spark, d))


@query(_CL + "SELECT cluster_key, round(trend_score, 6) AS trend_score FROM cl WHERE outcome = 'ok' AND status = 'emerging' ORDER BY coalesce(trend_score, 0) DESC, topic_id LIMIT 15")
def top_clusters_by_status(spark, d):
    return T.top_clusters(_clusters(spark, d), 15, "emerging").select("cluster_key", F.round("trend_score", 6).alias("trend_score"))


@query(_CL + "SELECT CASE WHEN outcome = 'ok' THEN round(coalesce(growth_90d, 0), 6) ELSE 0 END AS x, paper_count AS y, name AS label, CASE WHEN outcome = 'ok' THEN status END AS status FROM cl")
def chart_growth_scatter(spark, d):
    return charts.growth_scatter(_clusters(spark, d).withColumn("growth_rate", F.round("growth_90d", 6)))


@query(_CL + "SELECT name AS x, CASE WHEN outcome = 'ok' THEN round(coalesce(growth_90d, 0), 6) ELSE 0 END AS y, CASE WHEN outcome = 'ok' THEN status END AS status FROM cl")
def chart_growing_bars(spark, d):
    return charts.growing_bars(_clusters(spark, d).withColumn("growth_rate", F.round("growth_90d", 6)))


@query("SELECT id, name FROM topics ORDER BY name, id LIMIT 20 OFFSET 40")
def clusters_in_turn(spark, d):
    return T.in_turn(V.topics(spark, d), None, 20, 40)


_PER = A._DYN.replace("topic_id IN (1, 2, 17)", "topic_id IS NOT NULL").rstrip() + """, sv AS (SELECT t.topic_id, v.paper_id, CAST(date_trunc('month', v.publication_date) AS DATE) AS ws, v.vector FROM v_pt t JOIN v_vec v ON v.paper_id = t.paper_id WHERE v.publication_date BETWEEN DATE '2019-03-10' AND DATE '2020-06-20'),
c0 AS (SELECT topic_id, ws, i, avg(vector[i]) AS m, count(*) AS n FROM sv, generate_series(1, 64) g(i) GROUP BY 1, 2, 3), c AS (SELECT topic_id, ws, list(m ORDER BY i) AS cen, max(n) AS n FROM c0 GROUP BY 1, 2),
dr AS (SELECT a.topic_id, a.ws, a.n, CASE WHEN b.cen IS NOT NULL THEN 1 - greatest(-1, least(1, list_cosine_similarity(a.cen, b.cen))) END AS drift FROM c a LEFT JOIN c b ON b.topic_id = a.topic_id AND b.ws = a.ws - INTERVAL 1 MONTH),
rp AS (SELECT topic_id, ws, string_agg(paper_id, '|' ORDER BY r) AS reps FROM (SELECT sv.topic_id, sv.ws, paper_id, row_number() OVER (PARTITION BY sv.topic_id, sv.ws ORDER BY round(greatest(-1, least(1, list_cosine_similarity(vector, cen))), 6) DESC, paper_id) AS r FROM sv JOIN c ON c.topic_id = sv.topic_id AND c.ws = sv.ws) WHERE r <= 5 GROUP BY 1, 2),
pp AS (SELECT t.topic_id, CAST(date_trunc('month', publication_date) AS DATE) AS ws, p.id AS paper_id, coalesce(cited_by_count, 0) AS cited FROM v_pt t JOIN papers p ON p.id = t.paper_id WHERE publication_date BETWEEN DATE '2019-03-10' AND DATE '2020-06-20'),
ci AS (SELECT topic_id, ws, CAST(sum(cited) AS BIGINT) AS cited FROM pp GROUP BY 1, 2),
kw AS (SELECT topic_id, ws, string_agg(keyword, '|' ORDER BY r) AS kws FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, ws ORDER BY n DESC, keyword) AS r FROM (SELECT topic_id, ws, keyword, count(*) AS n FROM pp JOIN v_kw USING (paper_id) GROUP BY 1, 2, 3)) WHERE r <= 10 GROUP BY 1, 2),
per AS (SELECT 'topic:' || y.topic_id AS cluster_key, y.topic_id, y.period_start, y.period_end, y.paper_count, y.previous_paper_count, y.g AS growth_rate, greatest(0, least(1, 0.6 * greatest(0, least(1, (g + 1) / 2)) + 0.3 * least(1, paper_count / 100.0) + 0.05)) AS trend_score, dr.n AS n_vectors, dr.drift AS semantic_drift, coalesce(ci.cited, 0) AS citation_count_sum, coalesce(kw.kws, '') AS keywords, rp.reps AS representatives
FROM y JOIN dr ON dr.topic_id = y.topic_id AND dr.ws = CAST(date_trunc('month', y.period_start) AS DATE) LEFT JOIN ci ON ci.topic_id = dr.topic_id AND ci.ws = dr.ws LEFT JOIN kw ON kw.topic_id = dr.topic_id AND kw.ws = dr.ws LEFT JOIN rp ON rp.topic_id = dr.topic_id AND rp.ws = dr.ws) """


def _periods(spark, d):
    return api.recompute_periods(spark, d, FROM, TO, "month")


@query(_PER + "SELECT cluster_key, topic_id, period_start, period_end, paper_count, previous_paper_count, round(growth_rate, 6) AS growth_rate, round(trend_score, 6) AS trend_score, n_vectors, round(semantic_drift, 6) AS semantic_drift, citation_count_sum, keywords, representatives FROM per")
def periods_recomputed(spark, d):
    x = _periods(spark, d)
    for c in ("growth_rate", "trend_score", "semantic_drift"):
        x = x.withColumn(c, F.round(c, 6))
    return x.withColumn("keywords", F.array_join("keywords", "|")).withColumn("representatives", F.array_join(F.col("representatives").cast("array<string>"), "|"))


@query(_PER + "SELECT cluster_key, period_start, period_end, paper_count FROM per WHERE period_start >= DATE '2019-04-15' AND period_end <= DATE '2020-02-20'")
def periods_contained(spark, d):
    return T.periods_between(_periods(spark, d), "2019-04-15", "2020-02-20").select("cluster_key", "period_start", "period_end", "paper_count")


@query(_PER + "SELECT cluster_key, CAST(sum(paper_count) AS BIGINT) AS paper_count, CAST(sum(previous_paper_count) AS BIGINT) AS previous_paper_count, round((sum(paper_count) + 1) / CAST(sum(previous_paper_count) + 1 AS DOUBLE) - 1, 6) AS growth_rate FROM per GROUP BY 1")
def clusters_from_periods(spark, d):
    return T.clusters_from_periods(_periods(spark, d)).withColumn("growth_rate", F.round("growth_rate", 6))


@query(_PER + "SELECT cluster_key, year(period_start) || '-Q' || quarter(period_start) AS period_key, count(*) AS periods, CAST(sum(paper_count) AS BIGINT) AS paper_count, CAST(sum(previous_paper_count) AS BIGINT) AS previous_paper_count, round((sum(paper_count) + 1) / CAST(sum(previous_paper_count) + 1 AS DOUBLE) - 1, 6) AS growth_rate, round(CASE WHEN sum(paper_count) > 0 THEN sum(paper_count * trend_score) / sum(paper_count) ELSE avg(trend_score) END, 6) AS trend_score, round(avg(semantic_drift), 6) AS semantic_drift, CAST(sum(citation_count_sum) AS BIGINT) AS citation_count_sum, round(CASE WHEN sum(paper_count) > 0 THEN sum(citation_count_sum) / CAST(sum(paper_count) AS DOUBLE) END, 6) AS avg_cited_by_count FROM per GROUP BY 1, 2")
def quarter_metrics_all(spark, d):
    from ..functions.dates import quarter_key

    x = T.quarter_metrics(_periods(spark, d).withColumn("period_key", quarter_key(F.col("period_start"))), ["cluster_key", "period_key"])
    for c in ("growth_rate", "trend_score", "semantic_drift", "avg_cited_by_count"):
        x = x.withColumn(c, F.round(c, 6))
    return x


@query(_PER + "SELECT period_start AS x, coalesce(o.name, cluster_key) AS y, paper_count AS value FROM per LEFT JOIN topics o ON o.id = topic_id")
def chart_activity_heatmap(spark, d):
    names = V.topics(spark, d).select(F.concat(F.lit("topic:"), F.col("id").cast("string")).alias("cluster_key"), "name")
    return charts.activity_heatmap(_periods(spark, d), names)


@query(_PER + "SELECT cluster_key, period_start AS x, paper_count AS y FROM per")
def chart_activity_line(spark, d):
    return charts.activity_line(_periods(spark, d))


@query(_PER + "SELECT cluster_key, period_start AS x, round(semantic_drift, 6) AS y FROM per WHERE semantic_drift IS NOT NULL")
def chart_drift_line(spark, d):
    return charts.drift_line(_periods(spark, d)).withColumn("y", F.round("y", 6))


@query("+ t AS (SELECT DISTINCT topic_id FROM v_pt WHERE score >= 0.9), s AS (SELECT DISTINCT primary_topic_id AS topic_id FROM papers WHERE primary_topic_id IS NOT NULL) SELECT CASE WHEN t.topic_id IS NULL THEN 'inserted' WHEN s.topic_id IS NULL THEN 'pruned' ELSE 'updated' END AS change, count(*) AS n FROM t FULL JOIN s ON s.topic_id = t.topic_id GROUP BY 1")
def sync_clusters(spark, d):
    key = F.concat(F.lit("topic:"), F.col("topic_id").cast("string")).alias("cluster_key")
    t = V.paper_topics(spark, d).filter("score >= 0.9").select(key, F.lit("old").alias("name")).distinct()
    s = V.papers(spark, d, "primary_topic_id").filter("primary_topic_id is not null").select(F.col("primary_topic_id").alias("topic_id")).distinct().select(key, F.lit("new").alias("name"))
    return T.sync(t, s, ["cluster_key"], {"name": "overwrite"}, prune=True)[1]


_LV = """, lvl AS (SELECT 'subfield' AS category, CAST(o.subfield_id AS VARCHAR) AS key, v.vector FROM v_vec v JOIN topics o ON o.id = v.topic_id UNION ALL SELECT 'field', o.field_name, v.vector FROM v_vec v JOIN topics o ON o.id = v.topic_id UNION ALL SELECT 'domain', o.domain_name, v.vector FROM v_vec v JOIN topics o ON o.id = v.topic_id UNION ALL SELECT 'keyword', k.keyword, v.vector FROM v_kw k JOIN v_vec v ON v.paper_id = k.paper_id WHERE v.topic_id IS NOT NULL),
lm AS (SELECT category, key, i, avg(vector[i]) AS m FROM lvl, generate_series(1, 64) g(i) WHERE key IS NOT NULL GROUP BY 1, 2, 3), lc AS (SELECT category, key, list(m ORDER BY i) AS vector FROM lm GROUP BY 1, 2),
tl AS (SELECT DISTINCT user_id, u.category, u.key FROM (SELECT user_id, unnest([{'category': 'subfield', 'key': CAST(o.subfield_id AS VARCHAR)}, {'category': 'field', 'key': o.field_name}, {'category': 'domain', 'key': o.domain_name}, {'category': 'keyword', 'key': lower(split_part(o.name, ' ', 1))}]) AS u FROM v_track t JOIN topics o ON o.id = t.topic_id)),
src AS (SELECT f.user_id, 'favourite' AS category, v.vector FROM v_fav f JOIN v_vec v ON v.paper_id = f.paper_id UNION ALL SELECT t.user_id, 'topic', cv.centroid FROM v_track t JOIN cv ON cv.topic_id = t.topic_id UNION ALL SELECT tl.user_id, tl.category, lc.vector FROM tl JOIN lc ON lc.category = tl.category AND lc.key = tl.key) """


@query("+ " + A._CENT + _LV + "SELECT user_id, category, count(*) AS n FROM src GROUP BY 1, 2")
def profile_source_counts(spark, d):
    return U.source_counts(api.profile_sources(spark, d)).select("user_id", F.explode("counts").alias("category", "n"))


@query("+ " + A._CENT + _LV + """, sw AS (SELECT user_id, vector, (CASE category WHEN 'favourite' THEN 0.45 WHEN 'topic' THEN 0.25 WHEN 'field' THEN 0.10 WHEN 'subfield' THEN 0.15 WHEN 'keyword' THEN 0.10 ELSE 0.05 END) / count(*) OVER (PARTITION BY user_id, category) AS w FROM src),
pd AS (SELECT user_id, i, sum(w * vector[i]) / sum(w) AS m, count(*) AS n FROM sw, generate_series(1, 64) g(i) GROUP BY 1, 2), prof AS (SELECT user_id, list(m ORDER BY i) AS p, max(n) AS n FROM pd GROUP BY 1) SELECT user_id, round(p[1], 6) AS v1, round(sqrt(list_sum(list_transform(p, lambda x: x * x))), 6) AS norm, n FROM prof""")
def user_profiles_all_sources(spark, d):
    x = api.user_profiles(spark, d)
    return x.select("user_id", F.round(F.col("profile")[0], 6).alias("v1"), F.round(vectors.norm(F.col("profile")), 6).alias("norm"), "n")


def _answers(spark, d):
    """Answers as a text model gives them, some broken: from the topics' names."""
    item = lambda kind, n: F.struct(F.lit(kind).alias("item_type"), F.concat(F.col("name"), F.lit(n)).alias("title"), F.when(F.col("id") % 5 == 0, "growing").otherwise("odd").alias("maturity"))
    body = F.to_json(F.struct(F.when(F.col("id") % 7 > 0, F.col("name")).alias("summary"), F.array(item("method", " a"), item("approach", " b"), item("unknown", " c")).alias("items")))
    return V.topics(spark, d).select(F.col("id").alias("topic_id"), F.lit("2020-Q3").alias("period_key"), F.when(F.col("id") % 11 > 0, body).otherwise("{broken").alias("answer"))


@query("SELECT id AS topic_id, '2020-Q3' AS period_key, k AS item_type, name || s AS title, o AS sort_order FROM topics, (VALUES ('method', ' a', 0), ('approach', ' b', 1)) t(k, s, o) WHERE id % 7 > 0 AND id % 11 > 0 AND id % 5 = 0")
def report_items(spark, d):
    return P.parsed(_answers(spark, d))[1].select("topic_id", "period_key", "item_type", "title", "sort_order")


@query("SELECT id AS topic_id, '2020-Q3' AS period_key, name AS summary FROM topics WHERE id % 7 > 0 AND id % 11 > 0 AND domain_name <> 'Human Records'")
def reports_due(spark, d):
    """Reports of a quarter that aren't stored yet, made of the answers that can be read."""
    stored = V.topics(spark, d).filter("domain_name = 'Human Records'").select(F.col("id").alias("topic_id"), F.lit("2020-Q3").alias("period_key"))
    return P.parsed(P.due(_answers(spark, d), stored))[0].select("topic_id", "period_key", "summary")
