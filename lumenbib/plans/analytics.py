"""Topic insights, clusters, profiles and recommendations as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, vectors
from ..operators import clusters as C
from ..operators import insights as I
from ..operators import profiles as U
from ..sources import views as V

QUERIES, SQL = {}, {}
FROM, TO, TOPIC, AS_OF = "2019-01-01", "2020-12-31", 17, "2020-12-31"


def query(body: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if body:
            SQL[f.__name__] = V.sql(body)
        return f

    return add


def _p(spark, d, *more):
    return V.papers(spark, d, "id", "publication_date", *more)


_SERIES = f"""+ m AS (SELECT topic_id, period_start, works_count, o.subfield_id FROM v_monthly JOIN topics o ON o.id = topic_id WHERE period_start BETWEEN DATE '{FROM}' AND DATE '{TO}'),
sub AS (SELECT subfield_id, period_start, sum(works_count) AS subfield_count FROM m GROUP BY 1, 2),
grid AS (SELECT o.id AS topic_id, o.subfield_id, CAST(g AS DATE) AS period_start FROM topics o, generate_series(DATE '{FROM}', DATE '{TO}', INTERVAL 1 MONTH) x(g)),
series AS (SELECT g.topic_id, g.period_start, CAST(coalesce(m.works_count, 0) AS BIGINT) AS topic_count, CAST(coalesce(s.subfield_count, 0) AS BIGINT) AS subfield_count, CASE WHEN s.subfield_count > 0 THEN coalesce(m.works_count, 0) / CAST(s.subfield_count AS DOUBLE) ELSE 0 END AS share, s.subfield_count IS NOT NULL AS is_observed
FROM grid g LEFT JOIN m ON m.topic_id = g.topic_id AND m.period_start = g.period_start LEFT JOIN sub s ON s.subfield_id = g.subfield_id AND s.period_start = g.period_start) """


@query(_SERIES + "SELECT topic_id, period_start, topic_count, subfield_count, round(share, 6) AS share, is_observed FROM series")
def monthly_series_dense(spark: SparkSession, d: str) -> DataFrame:
    return I.monthly_series(V.monthly(spark, d), V.topics(spark, d), None, FROM, TO).withColumn("share", F.round("share", 6))


_NOV = """+ win AS (SELECT id AS paper_id, CASE WHEN publication_date BETWEEN DATE '2020-12-01' - INTERVAL 11 MONTH AND DATE '2020-12-01' THEN 1 WHEN publication_date BETWEEN DATE '2020-12-01' - INTERVAL 23 MONTH AND DATE '2020-12-01' - INTERVAL 12 MONTH THEN 2 END AS w FROM papers),
k AS (SELECT t.topic_id, v.keyword, max(CASE WHEN w = 1 THEN 1 ELSE 0 END) AS cur, max(CASE WHEN w = 2 THEN 1 ELSE 0 END) AS prev FROM v_pt t JOIN win USING (paper_id) JOIN v_kw v USING (paper_id) WHERE w IS NOT NULL GROUP BY 1, 2) """


@query(_NOV + "SELECT topic_id, CAST(sum(cur) AS BIGINT) AS current_n, CAST(sum(cur * (1 - prev)) AS BIGINT) AS new_n, round(CASE WHEN sum(cur) > 0 THEN sum(cur * (1 - prev)) / CAST(sum(cur) AS DOUBLE) END, 6) AS novelty FROM k GROUP BY 1")
def keyphrase_novelty(spark, d):
    n = I.novelty(V.paper_keywords(spark, d), V.paper_topics(spark, d), _p(spark, d), "2020-12-01", 12)
    return n.withColumn("novelty", F.round("novelty", 6))


_SAME = f"SELECT o.id AS topic_id, o.name, CAST(coalesce(sum(m.works_count), 0) AS BIGINT) AS works FROM topics o LEFT JOIN v_monthly m ON m.topic_id = o.id AND m.period_start BETWEEN DATE '{TO}' - INTERVAL 11 MONTH AND DATE '{TO}' WHERE o.subfield_id = (SELECT subfield_id FROM topics WHERE id = {TOPIC}) AND o.id <> {TOPIC} GROUP BY 1, 2 ORDER BY works DESC, name, topic_id LIMIT 10"
_SHARED = f"""SELECT h.topic_id, o.name, count(DISTINCT keyword) AS shared_keyphrases, count(DISTINCT paper_id) AS shared_papers, CAST(max(c.citations) AS BIGINT) AS citations, array_to_string(list_slice(list_sort(list(DISTINCT keyword)), 1, 8), '|') AS keyphrases, round(least(1.0, count(DISTINCT keyword) / 10.0), 6) AS similarity
FROM hits h JOIN topics o ON o.id = h.topic_id JOIN (SELECT topic_id, sum(cited) AS citations FROM (SELECT DISTINCT topic_id, paper_id, cited FROM hits) GROUP BY 1) c ON c.topic_id = h.topic_id GROUP BY 1, 2 ORDER BY shared_keyphrases DESC, shared_papers DESC, name, topic_id LIMIT 10"""
_HITS = f"""+ x AS (SELECT topic_id, paper_id, coalesce(cited_by_count, 0) AS cited FROM v_pt JOIN papers p ON p.id = paper_id WHERE publication_date BETWEEN DATE '{FROM}' AND DATE '{TO}'),
mine AS (SELECT DISTINCT keyword FROM x JOIN v_kw USING (paper_id) WHERE topic_id = {TOPIC}),
hits AS (SELECT x.topic_id, x.paper_id, x.cited, v.keyword FROM v_kw v JOIN mine USING (keyword) JOIN x ON x.paper_id = v.paper_id WHERE x.topic_id <> {TOPIC})"""
_CENT = """cen AS (SELECT topic_id, i, avg(vector[i]) AS m FROM v_vec, generate_series(1, 64) g(i) WHERE topic_id IS NOT NULL GROUP BY 1, 2),
cv AS (SELECT topic_id, list(m ORDER BY i) AS centroid FROM cen GROUP BY 1)"""
_EMB = f"SELECT b.topic_id, round(greatest(-1, least(1, list_cosine_similarity(a.centroid, b.centroid))), 6) AS similarity FROM cv a, cv b WHERE a.topic_id = {TOPIC} AND b.topic_id <> {TOPIC} ORDER BY similarity DESC, topic_id LIMIT 10"


def _same(spark, d):
    return I.same_subfield(V.monthly(spark, d), V.topics(spark, d), TOPIC, TO, 10)


def _shared(spark, d):
    return I.shared_keyphrases(V.paper_keywords(spark, d), V.paper_topics(spark, d), _p(spark, d, "cited_by_count"), V.topics(spark, d), TOPIC, FROM, TO, 10).withColumn("similarity", F.round("similarity", 6))


def _centroids(spark, d):
    return vectors.mean_by(V.paper_vectors(spark, d).filter("topic_id is not null"), ["topic_id"], "vector")


@query(_SAME)
def same_subfield_related(spark, d):
    return _same(spark, d)


@query(_HITS + " " + _SHARED)
def shared_keyphrase_related(spark, d):
    return _shared(spark, d)


@query("+ " + _CENT + " " + _EMB)
def embedding_related(spark, d):
    return I.embedding_related(_centroids(spark, d), TOPIC, 10)


@query(f"""{_HITS}, {_CENT},
a AS ({_SAME}), b AS ({_SHARED}), c AS ({_EMB}),
u AS (SELECT topic_id, 0 AS source, row_number() OVER (ORDER BY works DESC, name, topic_id) AS pos, CAST(NULL AS DOUBLE) AS similarity FROM a UNION ALL SELECT topic_id, 1, row_number() OVER (ORDER BY shared_keyphrases DESC, shared_papers DESC, name, topic_id), similarity FROM b UNION ALL SELECT topic_id, 2, row_number() OVER (ORDER BY similarity DESC, topic_id), similarity FROM c),
g AS (SELECT topic_id, min(source * 1000 + pos) AS first, max(CASE WHEN source < 2 THEN source END) AS base, max(CASE WHEN source = 1 THEN similarity END) AS s1, max(CASE WHEN source = 2 THEN similarity END) AS emb FROM u GROUP BY 1)
SELECT topic_id, CASE WHEN emb IS NOT NULL AND (base IS NULL OR emb > coalesce(s1, 0)) THEN 'embedding' WHEN base = 1 THEN 'shared_keyphrase' ELSE 'same_subfield' END AS source, round(CASE WHEN emb IS NOT NULL AND (base IS NULL OR emb > coalesce(s1, 0)) THEN emb ELSE coalesce(s1, 0) END, 6) AS similarity FROM g ORDER BY first LIMIT 15""")
def related_topics_merged(spark, d):
    return I.merge_related(_same(spark, d), _shared(spark, d), I.embedding_related(_centroids(spark, d), TOPIC, 10), 15).withColumn("similarity", F.round("similarity", 6))


_MET = f"""+ met0 AS (SELECT topic_id, count(*) AS paper_count, count(CASE WHEN publication_date BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}' THEN 1 END) AS n30, count(CASE WHEN publication_date BETWEEN DATE '{AS_OF}' - 60 AND DATE '{AS_OF}' - 31 THEN 1 END) AS p30, count(CASE WHEN publication_date BETWEEN DATE '{AS_OF}' - 90 AND DATE '{AS_OF}' THEN 1 END) AS n90, count(CASE WHEN publication_date BETWEEN DATE '{AS_OF}' - 180 AND DATE '{AS_OF}' - 91 THEN 1 END) AS p90, min(publication_date) AS fd, CAST(sum(coalesce(cited_by_count, 0)) AS BIGINT) AS citations FROM v_pt t JOIN papers p ON p.id = t.paper_id WHERE publication_date IS NOT NULL GROUP BY 1),
met1 AS (SELECT *, (n30 + 1) / CAST(p30 + 1 AS DOUBLE) - 1 AS growth_30d, (n90 + 1) / CAST(p90 + 1 AS DOUBLE) - 1 AS growth_90d, floor((DATE '{AS_OF}' - fd) / 30.0) + 1 AS age FROM met0),
met AS (SELECT *, growth_30d - growth_90d AS acceleration, greatest(0, least(1, 0.6 * greatest(0, least(1, (growth_90d + 1) / 2)) + 0.3 * greatest(0, least(1, n90 / 100.0)) + 0.1 * greatest(0, least(1, (growth_30d - growth_90d + 1) / 2)))) AS trend_score, CASE WHEN age <= 2 THEN 'new' WHEN growth_90d > 0.5 AND n90 >= 5 THEN 'emerging' WHEN growth_90d > 0.2 THEN 'growing' WHEN growth_90d < -0.2 THEN 'declining' ELSE 'stable' END AS status FROM met1) """


def _metrics(spark, d):
    return C.metrics(_p(spark, d, "cited_by_count"), V.paper_topics(spark, d), AS_OF)


@query(_MET + "SELECT topic_id, paper_count, n30, p30, n90, p90, citations, round(growth_30d, 6) AS growth_30d, round(growth_90d, 6) AS growth_90d, round(acceleration, 6) AS acceleration, round(trend_score, 6) AS trend_score, status FROM met")
def cluster_metrics(spark, d):
    return _metrics(spark, d).select("topic_id", "paper_count", "n30", "p30", "n90", "p90", "citations", *[F.round(c, 6).alias(c) for c in ("growth_30d", "growth_90d", "acceleration", "trend_score")], "status")


@query(_MET + "SELECT topic_id, status, round(trend_score, 6) AS trend_score FROM met WHERE status = 'growing' ORDER BY round(trend_score, 6) DESC, topic_id LIMIT 12")
def top_growing_clusters(spark, d):
    x = _metrics(spark, d).filter("status = 'growing'").select("topic_id", "status", F.round("trend_score", 6).alias("trend_score"))
    return x.orderBy(F.desc("trend_score"), "topic_id").limit(12)


@query("+ " + _CENT + " SELECT topic_id, round(sqrt(list_sum(list_transform(centroid, lambda x: x * x))), 6) AS norm, (SELECT count(*) FROM v_vec v WHERE v.topic_id = cv.topic_id) AS n FROM cv")
def cluster_centroid_norms(spark, d):
    return _centroids(spark, d).select("topic_id", F.round(vectors.norm(F.col("centroid")), 6).alias("norm"), "n")


@query("+ " + _CENT + ", s AS (SELECT v.topic_id, paper_id, round(greatest(-1, least(1, list_cosine_similarity(vector, centroid))), 6) AS similarity FROM v_vec v JOIN cv ON cv.topic_id = v.topic_id) SELECT topic_id, paper_id, similarity, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY similarity DESC, paper_id) AS r FROM s) WHERE r <= 5")
def representative_papers(spark, d):
    return C.representatives(V.paper_vectors(spark, d).filter("topic_id is not null"), ["topic_id"])


@query("SELECT topic_id, keyword, n, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, keyword) AS r FROM (SELECT topic_id, keyword, count(*) AS n FROM v_pt JOIN v_kw USING (paper_id) GROUP BY 1, 2)) WHERE r <= 10")
def top_keywords_per_cluster(spark, d):
    return C.top_keywords(V.paper_keywords(spark, d), V.paper_topics(spark, d))


_DYN = """+ w AS (SELECT CAST(g AS DATE) AS ws, greatest(CAST(g AS DATE), DATE '2019-03-10') AS period_start, least(last_day(CAST(g AS DATE)), DATE '2020-06-20') AS period_end FROM generate_series(DATE '2019-03-01', DATE '2020-06-01', INTERVAL 1 MONTH) x(g)),
x AS (SELECT topic_id, publication_date FROM v_pt JOIN papers p ON p.id = paper_id WHERE topic_id IN (1, 2, 17) AND publication_date IS NOT NULL),
n AS (SELECT t.topic_id, w.period_start, w.period_end, count(CASE WHEN publication_date BETWEEN w.period_start AND w.period_end THEN 1 END) AS paper_count, count(CASE WHEN publication_date >= w.ws - INTERVAL 1 MONTH AND publication_date < w.ws THEN 1 END) AS previous_paper_count FROM (SELECT DISTINCT topic_id FROM x) t CROSS JOIN w JOIN x ON x.topic_id = t.topic_id GROUP BY 1, 2, 3),
y AS (SELECT *, (paper_count + 1) / CAST(previous_paper_count + 1 AS DOUBLE) - 1 AS g FROM n) """


@query(_DYN + "SELECT topic_id, period_start, period_end, paper_count, previous_paper_count, round(g, 6) AS growth_rate, round(greatest(0, least(1, 0.6 * greatest(0, least(1, (g + 1) / 2)) + 0.3 * least(1, paper_count / 100.0) + 0.05)), 6) AS trend_score FROM y")
def cluster_period_windows(spark, d):
    x = C.period_dynamics(_p(spark, d), V.paper_topics(spark, d), [1, 2, 17], "2019-03-10", "2020-06-20", "month")
    return x.withColumn("growth_rate", F.round("growth_rate", 6)).withColumn("trend_score", F.round("trend_score", 6))


@query(_DYN.replace("topic_id IN (1, 2, 17)", "topic_id IS NOT NULL") + "SELECT topic_id, period_start, period_end, paper_count, previous_paper_count, round(g, 6) AS growth_rate, round(greatest(0, least(1, 0.6 * greatest(0, least(1, (g + 1) / 2)) + 0.3 * least(1, paper_count / 100.0) + 0.05)), 6) AS trend_score FROM y")
def cluster_period_windows_all(spark, d):
    x = C.period_dynamics(_p(spark, d), V.paper_topics(spark, d), None, "2019-03-10", "2020-06-20", "month")
    return x.withColumn("growth_rate", F.round("growth_rate", 6)).withColumn("trend_score", F.round("trend_score", 6))


_DRIFT = """+ pv AS (SELECT topic_id, CAST(date_trunc('quarter', publication_date) AS DATE) AS q, CAST(date_trunc('month', publication_date) AS DATE) AS window_start, vector FROM v_vec WHERE publication_date BETWEEN DATE '2018-01-01' AND DATE '2021-12-31' AND topic_id IS NOT NULL),
pd AS (SELECT topic_id, window_start, i, avg(vector[i]) AS m, count(*) AS n FROM pv, generate_series(1, 64) g(i) GROUP BY 1, 2, 3),
pc AS (SELECT topic_id, window_start, list(m ORDER BY i) AS c, max(n) AS n_vectors FROM pd GROUP BY 1, 2),
pl AS (SELECT a.topic_id, a.window_start, a.n_vectors, CASE WHEN b.c IS NOT NULL THEN round(1 - greatest(-1, least(1, list_cosine_similarity(a.c, b.c))), 6) END AS drift FROM pc a LEFT JOIN pc b ON b.topic_id = a.topic_id AND b.window_start = a.window_start - INTERVAL 1 MONTH) """


def _drift(spark, d):
    return C.period_drift(V.paper_vectors(spark, d).filter("topic_id is not null"), "2018-01-01", "2021-12-31", "month").withColumn("drift", F.round("drift", 6))


@query(_DRIFT + "SELECT topic_id, window_start, n_vectors, drift FROM pl")
def cluster_period_drift(spark, d):
    return _drift(spark, d)


@query(_DRIFT + "SELECT topic_id, round(avg(drift), 5) AS avg_drift, count(drift) AS n, CASE WHEN avg(drift) IS NULL THEN NULL WHEN least(1, round(avg(drift), 5) / 0.30) >= 0.66 THEN 'high' WHEN least(1, round(avg(drift), 5) / 0.30) >= 0.33 THEN 'medium' ELSE 'low' END AS level FROM pl GROUP BY 1")
def semantic_drift_avg(spark, d):
    g = _drift(spark, d).groupBy("topic_id").agg(F.round(F.avg("drift"), 5).alias("avg_drift"), F.count("drift").alias("n"))
    return g.withColumn("level", I.decomposition_level(F.when(F.col("avg_drift").isNotNull(), F.least(F.lit(1.0), F.col("avg_drift") / 0.30))))


_PROF = """+ src AS (SELECT f.user_id, 'favourite' AS category, v.vector FROM v_fav f JOIN v_vec v ON v.paper_id = f.paper_id UNION ALL SELECT t.user_id, 'topic', cv.centroid FROM v_track t JOIN cv ON cv.topic_id = t.topic_id),
sw AS (SELECT user_id, vector, (CASE category WHEN 'favourite' THEN 0.45 ELSE 0.25 END) / count(*) OVER (PARTITION BY user_id, category) AS w FROM src),
pd AS (SELECT user_id, i, sum(w * vector[i]) / sum(w) AS m, count(*) AS n FROM sw, generate_series(1, 64) g(i) GROUP BY 1, 2),
prof AS (SELECT user_id, list(m ORDER BY i) AS profile, max(n) AS n FROM pd GROUP BY 1) """.replace("+ src", "+ " + _CENT + ", src")


def _profiles(spark, d):
    v = V.paper_vectors(spark, d)
    f = V.favourites(spark, d).join(v.select("paper_id", "vector"), "paper_id").select("user_id", F.lit("favourite").alias("category"), "vector")
    t = V.tracked_topics(spark, d).join(_centroids(spark, d), "topic_id").select("user_id", F.lit("topic").alias("category"), F.col("centroid").alias("vector"))
    return U.profile_vectors(f.unionByName(t))


@query(_PROF + "SELECT user_id, round(profile[1], 6) AS v1, round(profile[64], 6) AS v64, round(sqrt(list_sum(list_transform(profile, lambda x: x * x))), 6) AS norm, n FROM prof")
def user_profile_vector(spark, d):
    x = _profiles(spark, d)
    return x.select("user_id", F.round(F.col("profile")[0], 6).alias("v1"), F.round(F.col("profile")[63], 6).alias("v64"), F.round(vectors.norm(F.col("profile")), 6).alias("norm"), "n")


_SCORED = f"""round(greatest(0, least(1, 0.55 * greatest(0, least(1, semantic)) + 0.25 * coalesce(tr.trend, 0) + 0.15 * CASE WHEN publication_date IS NULL THEN 0 ELSE greatest(0, least(1, 1 - greatest(0, DATE '{AS_OF}' - publication_date) / 1825.0)) END + 0.05 * CASE WHEN coalesce(cited_by_count, 0) <= 0 THEN 0 ELSE least(1, ln(1 + cited_by_count) / ln(1001)) END)), 6)"""
_TR = "tr AS (SELECT paper_id, max(trend_score) AS trend FROM v_pt JOIN met USING (topic_id) GROUP BY 1)"


@query(_PROF + ", " + _MET.removeprefix("+ ") + ", " + _TR + f""", cand AS (SELECT v.paper_id, list_cosine_similarity(v.vector, p.profile) AS semantic FROM v_vec v, prof p WHERE p.user_id = (SELECT min(user_id) FROM prof) AND v.paper_id NOT IN (SELECT paper_id FROM v_fav WHERE user_id = (SELECT min(user_id) FROM prof)) ORDER BY round(semantic, 9) DESC, v.paper_id LIMIT 60)
SELECT paper_id, title, score FROM (SELECT c.paper_id, title, {_SCORED} AS score FROM cand c JOIN papers q ON q.id = c.paper_id LEFT JOIN tr ON tr.paper_id = c.paper_id) ORDER BY score DESC, paper_id LIMIT 20""")
def recommend_profile(spark, d):
    prof = _profiles(spark, d)
    first = prof.orderBy("user_id").limit(1)
    fav = V.favourites(spark, d).join(F.broadcast(first.select("user_id")), "user_id", "left_semi").select("paper_id")
    vecs = V.paper_vectors(spark, d).join(fav, "paper_id", "left_anti")
    c = U.candidates(first, vecs, 20)
    x = U.scored(c, _p(spark, d, "title", "cited_by_count"), U.paper_trends(V.paper_topics(spark, d), _metrics(spark, d)), AS_OF)
    return x.orderBy(F.desc("score"), "paper_id").limit(20).select("paper_id", "title", "score")


@query(_MET + ", " + _TR + f""", cand AS (SELECT id AS paper_id, 0.0 AS semantic FROM papers WHERE is_indexed AND publication_date BETWEEN DATE '2018-01-01' AND DATE '{AS_OF}')
SELECT paper_id, title, score, 'trending_fallback' AS strategy FROM (SELECT c.paper_id, title, {_SCORED} AS score FROM cand c JOIN papers q ON q.id = c.paper_id LEFT JOIN tr ON tr.paper_id = c.paper_id) ORDER BY score DESC, paper_id LIMIT 20""")
def recommend_trending_fallback(spark, d):
    p = _p(spark, d, "title", "cited_by_count", "is_indexed")
    c = p.filter("is_indexed").filter(F.col("publication_date").between(F.to_date(F.lit("2018-01-01")), F.to_date(F.lit(AS_OF)))).select(F.col("id").alias("paper_id"), F.lit(0.0).alias("semantic"))
    x = U.scored(c, p, U.paper_trends(V.paper_topics(spark, d), _metrics(spark, d)), AS_OF)
    return x.orderBy(F.desc("score"), "paper_id").limit(20).select("paper_id", "title", "score", F.lit("trending_fallback").alias("strategy"))


@query("SELECT paper_id, max(CASE WHEN o.id IN (3, 9) THEN 1.0 WHEN o.subfield_id = 2 THEN 0.7 WHEN o.field_name = 'Networks Science' THEN 0.45 WHEN o.domain_name = 'Human Records' THEN 0.25 ELSE 0 END) AS tag FROM v_pt t JOIN topics o ON o.id = t.topic_id GROUP BY 1")
def tag_match_scores(spark, d):
    return U.tag_scores(V.paper_topics(spark, d), V.topics(spark, d), {"topics": [3, 9], "subfields": [2], "fields": ["Networks Science"], "domains": ["Human Records"]})


@query("SELECT id, round(CASE WHEN publication_date IS NULL THEN 0 ELSE greatest(0, least(1, 1 - greatest(0, DATE '2020-12-31' - publication_date) / 1825.0)) END, 6) AS recency, round(CASE WHEN coalesce(cited_by_count, 0) <= 0 THEN 0 ELSE least(1, ln(1 + cited_by_count) / ln(1001)) END, 6) AS citation FROM papers")
def recency_citation_scores(spark, d):
    p = V.papers(spark, d, "id", "publication_date", "cited_by_count")
    return p.select("id", F.round(scoring.recency_score(F.col("publication_date"), F.to_date(F.lit(AS_OF))), 6).alias("recency"), F.round(scoring.citation_score(F.col("cited_by_count")), 6).alias("citation"))


_QM = """+ q AS (SELECT topic_id, CAST(date_trunc('month', publication_date) AS DATE) AS m, count(*) AS n, sum(coalesce(cited_by_count, 0)) AS c FROM v_pt JOIN papers p ON p.id = paper_id WHERE publication_date BETWEEN DATE '2020-07-01' AND DATE '2020-09-30' GROUP BY 1, 2) """


@query(_QM + "SELECT topic_id, CAST(sum(n) AS BIGINT) AS paper_count, CAST(sum(c) AS BIGINT) AS citations, round(sum(c) / CAST(sum(n) AS DOUBLE), 6) AS citations_per_paper, count(*) AS months FROM q GROUP BY 1")
def quarter_metrics(spark, d):
    p = _p(spark, d, "cited_by_count").filter(F.col("publication_date").between(F.to_date(F.lit("2020-07-01")), F.to_date(F.lit("2020-09-30"))))
    x = V.paper_topics(spark, d).join(p, F.col("paper_id") == F.col("id"))
    g = x.groupBy("topic_id", F.trunc("publication_date", "MM").alias("m")).agg(F.count("*").alias("n"), F.sum(F.coalesce("cited_by_count", F.lit(0))).alias("c"))
    return g.groupBy("topic_id").agg(F.sum("n").cast("bigint").alias("paper_count"), F.sum("c").cast("bigint").alias("citations"), F.round(F.sum("c") / F.sum("n"), 6).alias("citations_per_paper"), F.count("*").alias("months"))


_KD = """+ k AS (SELECT DISTINCT t.topic_id, v.keyword, CAST(date_trunc('month', publication_date) AS DATE) AS m FROM v_pt t JOIN papers p ON p.id = t.paper_id JOIN v_kw v ON v.paper_id = p.id WHERE publication_date BETWEEN DATE '2020-07-01' AND DATE '2020-09-30'),
b AS (SELECT topic_id, min(m) AS f, max(m) AS l FROM k GROUP BY 1),
g AS (SELECT k.topic_id, keyword, count(*) AS n, max(CASE WHEN m = l THEN 1 ELSE 0 END) AS in_last, max(CASE WHEN m = f THEN 1 ELSE 0 END) AS in_first FROM k JOIN b ON b.topic_id = k.topic_id GROUP BY 1, 2) """


@query(_KD + "SELECT topic_id, count(CASE WHEN n >= 2 THEN 1 END) AS stable, count(CASE WHEN in_last = 1 AND in_first = 0 THEN 1 END) AS emerging, count(CASE WHEN in_first = 1 AND in_last = 0 THEN 1 END) AS declining FROM g GROUP BY 1")
def keyword_dynamics(spark, d):
    """Keywords of a quarter that last, arise or fade, by topic: first and last months by window over the month table."""
    p = _p(spark, d).filter(F.col("publication_date").between(F.to_date(F.lit("2020-07-01")), F.to_date(F.lit("2020-09-30")))).select(F.col("id").alias("paper_id"), F.trunc("publication_date", "MM").alias("m"))
    k = V.paper_topics(spark, d).select("topic_id", "paper_id").join(p, "paper_id").join(V.paper_keywords(spark, d), "paper_id").select("topic_id", "keyword", "m").distinct()
    b = k.groupBy("topic_id").agg(F.min("m").alias("f"), F.max("m").alias("l"))
    g = k.join(b, "topic_id").groupBy("topic_id", "keyword").agg(F.count("*").alias("n"), F.max(F.col("m") == F.col("l")).alias("in_last"), F.max(F.col("m") == F.col("f")).alias("in_first"))
    return g.groupBy("topic_id").agg(F.count(F.when(F.col("n") >= 2, 1)).alias("stable"), F.count(F.when(F.col("in_last") & ~F.col("in_first"), 1)).alias("emerging"), F.count(F.when(F.col("in_first") & ~F.col("in_last"), 1)).alias("declining"))


@query("""+ s AS (SELECT topic_id, paper_id, cited_by_count, row_number() OVER (PARTITION BY topic_id ORDER BY cited_by_count DESC NULLS LAST, publication_date DESC NULLS LAST, paper_id DESC) AS r FROM v_pt JOIN papers p ON p.id = paper_id WHERE publication_date BETWEEN DATE '2020-07-01' AND DATE '2020-09-30'),
""" + _CENT + """, v AS (SELECT v.topic_id, v.paper_id, row_number() OVER (PARTITION BY v.topic_id ORDER BY round(greatest(-1, least(1, list_cosine_similarity(vector, centroid))), 6) DESC, v.paper_id) AS r FROM v_vec v JOIN cv ON cv.topic_id = v.topic_id)
SELECT topic_id, paper_id, round(max(1.0 / r), 6) AS score, string_agg(DISTINCT role, '|' ORDER BY role) AS roles FROM (SELECT topic_id, paper_id, r, 'top_cited' AS role FROM s WHERE r <= 5 UNION ALL SELECT topic_id, paper_id, r, 'representative' FROM v WHERE r <= 5) GROUP BY 1, 2""")
def report_papers(spark, d):
    """Representative and most cited papers of each topic's quarter; a paper in both keeps both roles and its better score."""
    p = _p(spark, d, "cited_by_count").filter(F.col("publication_date").between(F.to_date(F.lit("2020-07-01")), F.to_date(F.lit("2020-09-30"))))
    x = V.paper_topics(spark, d).join(p, F.col("paper_id") == F.col("id"))
    r = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.col("cited_by_count").desc_nulls_last(), F.col("publication_date").desc_nulls_last(), F.desc("paper_id")))
    cited = x.withColumn("r", r).filter("r <= 5").select("topic_id", "paper_id", "r", F.lit("top_cited").alias("role"))
    reps = C.representatives(V.paper_vectors(spark, d).filter("topic_id is not null"), ["topic_id"]).select("topic_id", "paper_id", "r", F.lit("representative").alias("role"))
    g = cited.unionByName(reps).groupBy("topic_id", "paper_id").agg(F.round(F.max(1.0 / F.col("r")), 6).alias("score"), F.array_join(F.sort_array(F.collect_set("role")), "|").alias("roles"))
    return g


@query("""+ k AS (SELECT v.keyword, CAST(date_trunc('quarter', publication_date) AS DATE) AS period, count(*) AS n FROM v_pt t JOIN papers p ON p.id = t.paper_id JOIN v_kw v ON v.paper_id = p.id WHERE topic_id = 17 AND publication_date BETWEEN DATE '2020-01-01' AND DATE '2020-12-31' GROUP BY 1, 2),
top AS (SELECT keyword FROM k GROUP BY 1 ORDER BY sum(n) DESC, keyword LIMIT 10), per AS (SELECT DISTINCT period FROM k)
SELECT top.keyword, per.period, coalesce(k.n, 0) AS weight FROM top CROSS JOIN per LEFT JOIN k ON k.keyword = top.keyword AND k.period = per.period""")
def keyword_evolution_matrix(spark, d):
    """A dense matrix of the ten foremost keywords and the periods of one topic."""
    p = _p(spark, d).filter(F.col("publication_date").between(F.to_date(F.lit("2020-01-01")), F.to_date(F.lit("2020-12-31")))).select(F.col("id").alias("paper_id"), F.trunc("publication_date", "QUARTER").alias("period"))
    t = V.paper_topics(spark, d).filter(F.col("topic_id") == 17).select("paper_id")
    k = t.join(p, "paper_id").join(V.paper_keywords(spark, d), "paper_id").groupBy("keyword", "period").agg(F.count("*").alias("n"))
    top = k.groupBy("keyword").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "keyword").limit(10).select("keyword")
    grid = top.crossJoin(F.broadcast(k.select("period").distinct()))  # ten keywords by the periods of a year
    return grid.join(k, ["keyword", "period"], "left").select("keyword", "period", F.coalesce("n", F.lit(0)).alias("weight"))


@query(_NOV + ", n AS (SELECT topic_id, CASE WHEN sum(cur) > 0 THEN sum(cur * (1 - prev)) / CAST(sum(cur) AS DOUBLE) END AS v FROM k GROUP BY 1) SELECT topic_id, CASE WHEN v IS NULL THEN NULL WHEN v >= 0.66 THEN 'high' WHEN v >= 0.33 THEN 'medium' ELSE 'low' END AS level FROM n")
def novelty_levels(spark, d):
    n = I.novelty(V.paper_keywords(spark, d), V.paper_topics(spark, d), _p(spark, d), "2020-12-01", 12)
    return n.select("topic_id", I.decomposition_level(F.col("novelty")).alias("level"))


@query("SELECT paper_id, round(list_sum(list_transform(vector, lambda x: x)) / sqrt(list_sum(list_transform(vector, lambda x: x * x))), 6) AS s FROM v_vec")
def unit_vector_sums(spark, d):
    u = vectors.unit(F.col("vector"))
    return V.paper_vectors(spark, d).select("paper_id", F.round(F.aggregate(u, F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query("SELECT DISTINCT cluster_key, period_start FROM (SELECT 'topic:' || topic_id AS cluster_key, CAST(date_trunc('month', publication_date) AS DATE) AS period_start FROM v_vec WHERE topic_id IS NOT NULL AND publication_date BETWEEN DATE '2019-01-01' AND DATE '2019-12-31')")
def points_in_window(spark, d):
    """Cluster months that have points, by the date as text that a payload holds."""
    v = V.paper_vectors(spark, d).filter("topic_id is not null").withColumn("payload_date", F.concat(F.col("publication_date").cast("string"), F.lit("T00:00:00")))
    day = F.substring("payload_date", 1, 10).try_cast("date")
    x = v.withColumn("day", day).filter(F.col("day").between(F.to_date(F.lit("2019-01-01")), F.to_date(F.lit("2019-12-31"))))
    return x.select(F.concat(F.lit("topic:"), F.col("topic_id").cast("string")).alias("cluster_key"), F.trunc("day", "MM").alias("period_start")).distinct()
