"""Lookups, filters, joins, aggregations and top-k as queries over the bibliographic views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import papers as P
from ..operators import stats as S
from ..sources import views as V
from ..sources.parquet import table

QUERIES, SQL = {}, {}
FROM, TO, TOPIC = "2019-01-01", "2020-12-31", 17


def query(body: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if body:
            SQL[f.__name__] = V.sql(body)
        return f

    return add


PAPER = ("id", "title", "publication_date", "cited_by_count", "primary_topic_id", "is_indexed")
_COLS = "id, title, publication_date, CAST(cited_by_count AS BIGINT) AS cited_by_count"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "publication_date", F.col("cited_by_count").cast("bigint").alias("cited_by_count"))


@query(f"SELECT topic_id, current_count, previous_count, round(CASE WHEN previous_count = 0 THEN 0 ELSE (current_count - previous_count) / CAST(previous_count AS DOUBLE) END, 6) AS growth FROM (SELECT topic_id, count(CASE WHEN publication_date >= DATE '{FROM}' THEN 1 END) AS current_count, count(CASE WHEN publication_date < DATE '{FROM}' THEN 1 END) AS previous_count FROM v_pt t JOIN papers p ON p.id = t.paper_id WHERE publication_date BETWEEN DATE '{FROM}' - 731 AND DATE '{TO}' GROUP BY 1) WHERE current_count > 0 ORDER BY growth DESC, current_count DESC, topic_id LIMIT 20")
def topic_recent_growth(spark: SparkSession, d: str) -> DataFrame:
    g = P.recent_growth(V.papers(spark, d, "id", "publication_date"), V.paper_topics(spark, d), FROM, TO, 20)
    return g.withColumn("growth", F.round("growth", 6))


@query("SELECT id, title, publication_date, CAST(cited_by_count AS BIGINT) AS cited_by_count FROM papers WHERE id IN (5, 3, 3, 99, 1200, 77)")
def papers_by_ids(spark, d):
    return _shown(P.by_ids(V.papers(spark, d, *PAPER), [5, 3, 3, 99, 1200, 77]))


@query("SELECT id, name, place FROM topics JOIN (VALUES (9, 0), (3, 1), (400, 2), (17, 4)) v(i, place) ON id = i")
def topics_ordered_by_ids(spark, d):
    return P.in_order(V.topics(spark, d).select("id", "name"), [9, 3, 400, 3, 17, 9999])


@query("SELECT id, name FROM topics ORDER BY name, id LIMIT 25 OFFSET 10")
def topics_page(spark, d):
    return P.page(V.topics(spark, d).select("id", "name"), [F.col("name"), F.col("id")], 25, 10)


@query(f"SELECT {_COLS} FROM papers WHERE publication_date BETWEEN DATE '{FROM}' AND DATE '{TO}' AND id IN (SELECT paper_id FROM v_pt WHERE topic_id = {TOPIC}) ORDER BY publication_date DESC NULLS LAST, id DESC LIMIT 50 OFFSET 5")
def papers_by_period_soft(spark, d):
    return _shown(P.list_by_period(V.papers(spark, d, *PAPER), FROM, TO, 50, 5, V.paper_topics(spark, d), TOPIC, "soft"))


@query(f"SELECT {_COLS} FROM papers WHERE publication_date BETWEEN DATE '{FROM}' AND DATE '{TO}' AND primary_topic_id = {TOPIC} ORDER BY publication_date DESC NULLS LAST, id DESC LIMIT 50")
def papers_by_period_strict(spark, d):
    return _shown(P.list_by_period(V.papers(spark, d, *PAPER), FROM, TO, 50, 0, None, TOPIC, "strict"))


@query("SELECT DISTINCT t.paper_id FROM v_pt t JOIN topics o ON o.id = t.topic_id WHERE o.id IN (3, 9) OR o.subfield_id IN (2) OR o.field_name IN ('Networks Science')")
def papers_taxonomy_or_filter(spark, d):
    return P.of_taxonomy(V.paper_topics(spark, d), V.topics(spark, d), [3, 9], [2], ["Networks Science"])


@query("SELECT id, level FROM (SELECT id, 'topic' AS level FROM topics WHERE id IN (3, 9) UNION ALL SELECT id, 'subfield' FROM topics WHERE subfield_id IN (2) UNION ALL SELECT id, 'domain' FROM topics WHERE domain_name = 'Human Records' UNION SELECT id, 'all' FROM topics WHERE id IN (3, 9) OR subfield_id = 2 OR domain_name = 'Human Records')")
def topic_ids_for_filters(spark, d):
    t = V.topics(spark, d)
    parts = {"topic": F.col("id").isin(3, 9), "subfield": F.col("subfield_id").isin(2), "domain": F.col("domain_name") == "Human Records"}
    any_ = parts["topic"] | parts["subfield"] | parts["domain"]
    flags = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in (parts | {"all": any_}).items()]))
    return t.select("id", F.explode(flags).alias("level"))


@query(f"SELECT id FROM papers WHERE publication_date BETWEEN DATE '{FROM}' AND DATE '{TO}' AND extracted_keywords IS NULL AND id IN (SELECT paper_id FROM v_pt t JOIN topics o ON o.id = t.topic_id WHERE o.field_name = 'Networks Science')")
def keyword_extraction_candidates(spark, d):
    tp = P.of_taxonomy(V.paper_topics(spark, d), V.topics(spark, d), fields=["Networks Science"])
    return P.keyword_candidates(V.papers(spark, d, "id", "publication_date", "extracted_keywords"), FROM, TO, tp).select("id")


@query(f"SELECT {_COLS} FROM papers WHERE is_indexed AND publication_date >= DATE '{FROM}' AND id IN (SELECT paper_id FROM v_pt t JOIN topics o ON o.id = t.topic_id WHERE o.domain_name = 'Human Records') ORDER BY publication_date DESC, id DESC LIMIT 40")
def recent_indexed_papers(spark, d):
    tp = P.of_taxonomy(V.paper_topics(spark, d), V.topics(spark, d), domains=["Human Records"])
    return _shown(P.recent_indexed(V.papers(spark, d, *PAPER), FROM, 40, tp))


@query(f"SELECT {_COLS} FROM papers WHERE publication_date BETWEEN DATE '{FROM}' AND DATE '{TO}' AND id IN (SELECT paper_id FROM v_pt WHERE topic_id = {TOPIC}) ORDER BY cited_by_count DESC NULLS LAST, publication_date DESC NULLS LAST, id DESC LIMIT 15")
def top_cited_by_topic(spark, d):
    return _shown(P.top_cited(V.papers(spark, d, *PAPER), V.paper_topics(spark, d), TOPIC, FROM, TO, 15))


@query("SELECT paper_id, string_agg(name, '|' ORDER BY score DESC NULLS LAST, name, topic_id) AS topics FROM v_pt t JOIN topics o ON o.id = t.topic_id GROUP BY 1")
def topics_per_paper(spark, d):
    """Names of each paper's topics by score; a paper's links are few, and topics, of fixed size, join first."""
    x = V.paper_topics(spark, d).join(V.topics(spark, d).select(F.col("id").alias("topic_id"), "name"), "topic_id")
    key = F.struct((-F.coalesce("score", F.lit(-1e9))).alias("s"), "name", "topic_id")
    return x.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda k: k["name"]), "|").alias("topics"))


@query("SELECT paper_id, string_agg(keyword, '|' ORDER BY keyword) AS keywords FROM v_kw GROUP BY 1")
def keywords_per_paper(spark, d):
    return V.paper_keywords(spark, d).groupBy("paper_id").agg(F.array_join(F.sort_array(F.collect_list("keyword")), "|").alias("keywords"))


@query("SELECT a.paper_id, string_agg(coalesce(e.display_name, ''), '|' ORDER BY a.author_order NULLS LAST, a.author_id) AS authors FROM (SELECT paper_id, author_id, min(author_order) AS author_order FROM paper_authors WHERE paper_id IS NOT NULL GROUP BY 1, 2) a JOIN external_authors e ON e.author_id = a.author_id GROUP BY 1")
def authors_per_paper(spark, d):
    a = table(spark, d, "paper_authors", "paper_id", "author_id", "author_order").filter("paper_id is not null").groupBy("paper_id", "author_id").agg(F.min("author_order").alias("author_order"))
    x = a.join(table(spark, d, "external_authors", "author_id", "display_name"), "author_id")
    key = F.struct(F.coalesce("author_order", F.lit(1 << 30)).alias("o"), "author_id", F.coalesce("display_name", F.lit("")).alias("name"))
    return x.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda k: k["name"]), "|").alias("authors"))


@query("SELECT DISTINCT a.paper_id, i.institution_id, i.display_name, i.country_code FROM paper_authors a JOIN external_authors e ON e.author_id = a.author_id JOIN external_institutions i ON i.institution_id = e.institution_id")
def institutions_per_paper(spark, d):
    e = table(spark, d, "external_authors", "author_id", "institution_id").join(table(spark, d, "external_institutions", "institution_id", "display_name", "country_code"), "institution_id")
    return table(spark, d, "paper_authors", "paper_id", "author_id").join(e, "author_id").select("paper_id", "institution_id", "display_name", "country_code").distinct()


@query("SELECT author_id, topic_id, count(DISTINCT a.paper_id) AS n_papers FROM paper_authors a JOIN v_pt t ON t.paper_id = a.paper_id WHERE author_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT a.paper_id) >= 2")
def author_topics(spark, d):
    a = table(spark, d, "paper_authors", "paper_id", "author_id").filter("author_id is not null").distinct()
    return a.join(V.paper_topics(spark, d), "paper_id").groupBy("author_id", "topic_id").agg(F.count("*").alias("n_papers")).filter("n_papers >= 2")


@query("SELECT user_id, entity_type, entity_id, name FROM (SELECT user_id, 'topic' AS entity_type, topic_id AS entity_id, o.name FROM v_track t JOIN topics o ON o.id = t.topic_id UNION SELECT user_id, 'subfield', o.subfield_id, o.subfield_name FROM v_track t JOIN topics o ON o.id = t.topic_id)")
def tracked_entities(spark, d):
    x = V.tracked_topics(spark, d).join(V.topics(spark, d).select(F.col("id").alias("topic_id"), "name", "subfield_id", "subfield_name"), "topic_id")
    rows = F.array(F.struct(F.lit("topic").alias("entity_type"), F.col("topic_id").alias("entity_id"), F.col("name").alias("name")), F.struct(F.lit("subfield").alias("entity_type"), F.col("subfield_id").alias("entity_id"), F.col("subfield_name").alias("name")))
    return x.select("user_id", F.explode(rows).alias("e")).select("user_id", "e.*").distinct()


@query("SELECT user_id, paper_id, title FROM (SELECT f.user_id, f.paper_id, p.title, row_number() OVER (PARTITION BY f.user_id ORDER BY f.created_at DESC, f.paper_id) AS r FROM v_fav f JOIN papers p ON p.id = f.paper_id) WHERE r <= 5")
def favourite_papers(spark, d):
    x = V.favourites(spark, d).join(V.papers(spark, d, "id", "title"), F.col("paper_id") == F.col("id"))
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "paper_id"))
    return x.withColumn("r", r).filter("r <= 5").select("user_id", "paper_id", "title")


@query("SELECT id, title FROM papers WHERE id NOT IN (SELECT paper_id FROM v_pt)")
def papers_without_topics(spark, d):
    return V.papers(spark, d, "id", "title").join(V.paper_topics(spark, d).select(F.col("paper_id").alias("id")), "id", "left_anti")


@query(f"SELECT count(*) AS n_all, count(CASE WHEN publication_date BETWEEN DATE '{FROM}' AND DATE '{TO}' THEN 1 END) AS n_period FROM papers")
def count_by_period(spark, d):
    p = V.papers(spark, d, "publication_date")
    return p.agg(F.count("*").alias("n_all"), F.count(F.when(F.col("publication_date").between(F.to_date(F.lit(FROM)), F.to_date(F.lit(TO))), 1)).alias("n_period"))


@query(f"SELECT o.field_name, count(DISTINCT t.paper_id) AS n_papers FROM v_pt t JOIN topics o ON o.id = t.topic_id JOIN papers p ON p.id = t.paper_id WHERE p.publication_date BETWEEN DATE '{FROM}' AND DATE '{TO}' GROUP BY 1")
def count_distinct_period_taxonomy(spark, d):
    x = V.paper_topics(spark, d).join(V.topics(spark, d).select(F.col("id").alias("topic_id"), "field_name"), "topic_id").select("paper_id", "field_name").distinct()
    p = P.in_period(V.papers(spark, d, "id", "publication_date"), FROM, TO)
    return x.join(p, F.col("paper_id") == F.col("id")).groupBy("field_name").agg(F.count("*").alias("n_papers"))


def _counts(granularity: str, topics: str) -> str:
    return f"SELECT topic_id, CAST(date_trunc('{granularity}', publication_date) AS DATE) AS period_start, count(*) AS n FROM v_pt t JOIN papers p ON p.id = t.paper_id WHERE publication_date BETWEEN DATE '{FROM}' AND DATE '{TO}' AND topic_id IN ({topics}) GROUP BY 1, 2"


@query(_counts("week", "17"))
def topic_period_counts_week(spark, d):
    return P.period_counts(V.papers(spark, d, "id", "publication_date"), V.paper_topics(spark, d), [17], FROM, TO, "week")


@query(_counts("month", "17"))
def topic_period_counts_month(spark, d):
    return P.period_counts(V.papers(spark, d, "id", "publication_date"), V.paper_topics(spark, d), [17], FROM, TO, "month")


@query(_counts("month", "1, 2, 3, 17, 40"))
def topic_heatmap(spark, d):
    return P.period_counts(V.papers(spark, d, "id", "publication_date"), V.paper_topics(spark, d), [1, 2, 3, 17, 40], FROM, TO, "month")


@query("SELECT m.topic_id, CAST(date_trunc('quarter', period_start) AS DATE) AS period, CAST(sum(works_count) AS BIGINT) AS works_count, o.name AS topic_name, o.subfield_name, o.field_name, o.domain_name, 'topic:' || m.topic_id AS cluster_key FROM v_monthly m JOIN topics o ON o.id = m.topic_id WHERE period_start BETWEEN DATE '2015-01-01' AND DATE '2020-12-31' GROUP BY ALL")
def period_stats_quarter(spark, d):
    return S.rollup_periods(V.monthly(spark, d), V.topics(spark, d), "2015-01-01", "2020-12-31", "quarter")


@query("SELECT topic_id, CAST(sum(works_count) AS BIGINT) AS total, min(period_start) AS first_period, max(period_start) AS last_period FROM v_monthly GROUP BY 1")
def topic_totals(spark, d):
    return S.totals(V.monthly(spark, d))


_JAN = """+ jan AS (SELECT t.topic_id, CAST(year(publication_date) AS INT) AS stat_year, count(*) AS january, count(CASE WHEN day(publication_date) = 1 THEN 1 END) AS first_day FROM v_pt t JOIN papers p ON p.id = t.paper_id WHERE month(publication_date) = 1 GROUP BY 1, 2),
est AS (SELECT *, least(CAST(floor((january - first_day) * 31 / 30.0 + 0.5) AS BIGINT), january) AS real_works FROM jan),
js AS (SELECT *, january - real_works AS artificial FROM est) """


def _january(spark, d):
    return S.january_counts(V.papers(spark, d, "id", "publication_date"), V.paper_topics(spark, d))


@query(_JAN + "SELECT * FROM js")
def jan1_normalisation(spark, d):
    return _january(spark, d)


@query(_JAN + "SELECT m.topic_id, m.stat_year, CAST(m.works + coalesce(js.artificial, 0) AS BIGINT) AS works_count, CAST(coalesce(js.artificial, 0) AS BIGINT) AS artificial FROM (SELECT topic_id, CAST(year(period_start) AS INT) AS stat_year, sum(works_count) AS works FROM v_monthly GROUP BY 1, 2) m LEFT JOIN js ON js.topic_id = m.topic_id AND js.stat_year = m.stat_year")
def yearly_rebuild(spark, d):
    return S.rebuild_yearly(V.monthly(spark, d), _january(spark, d))


@query(_JAN + "SELECT CASE WHEN grouping(stat_year) = 1 THEN 'total' WHEN grouping(field_name) = 0 THEN 'year_field' WHEN grouping(subfield_name) = 0 THEN 'year_subfield' ELSE 'year' END AS grouping_name, stat_year, field_name, subfield_name, count(DISTINCT topic_id) AS topics, CAST(sum(artificial) AS BIGINT) AS artificial FROM (SELECT js.*, o.field_name, o.subfield_name FROM js LEFT JOIN topics o ON o.id = js.topic_id WHERE artificial > 0) GROUP BY GROUPING SETS ((stat_year), (stat_year, field_name), (stat_year, subfield_name), ())")
def jan1_anomaly_grouping_sets(spark, d):
    return S.anomaly_summary(_january(spark, d), V.topics(spark, d))


@query(_JAN + "SELECT topic_id, stat_year, artificial FROM js WHERE artificial >= 2 ORDER BY artificial DESC, stat_year, topic_id LIMIT 30")
def january_artifact_estimates(spark, d):
    return _january(spark, d).filter("artificial >= 2").orderBy(F.desc("artificial"), "stat_year", "topic_id").limit(30).select("topic_id", "stat_year", "artificial")


@query("SELECT topic_id, CAST(year(publication_date) AS INT) AS y, CAST(month(publication_date) AS INT) AS m, count(*) AS n FROM v_pt t JOIN papers p ON p.id = t.paper_id WHERE publication_date IS NOT NULL GROUP BY 1, 2, 3")
def sample_counts(spark, d):
    return V.monthly(spark, d).select("topic_id", F.year("period_start").alias("y"), F.month("period_start").alias("m"), F.col("works_count").alias("n"))


@query("SELECT field_name, count(*) AS n_topics FROM topics GROUP BY 1")
def field_summary(spark, d):
    return V.topics(spark, d).groupBy("field_name").agg(F.count("*").alias("n_topics"))


@query("SELECT id, period_key FROM (SELECT id, year(publication_date) || '-Q' || quarter(publication_date) AS period_key FROM papers WHERE publication_date IS NOT NULL)")
def quarter_keys(spark, d):
    return V.papers(spark, d, "id", "publication_date").filter("publication_date is not null").select("id", dates.quarter_key(F.col("publication_date")).alias("period_key"))


@query("SELECT id, title FROM papers WHERE doi = (SELECT min(doi) FROM papers) ORDER BY id LIMIT 1")
def paper_by_doi(spark, d):
    p = V.papers(spark, d, "id", "title", "doi")
    return P.one_by(p, "doi", p.agg(F.min("doi")).first()[0]).select("id", "title")


@query("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL ORDER BY user_id LIMIT 25 OFFSET 50")
def user_ids_page(spark, d):
    return P.list_ids(table(spark, d, "events", "user_id"), "user_id", 25, 50)


@query("SELECT id, name FROM topics WHERE field_name = 'Networks Science' ORDER BY id LIMIT 10 OFFSET 3")
def topics_for_stats(spark, d):
    return P.topics_for_stats(V.topics(spark, d), 10, 3, ["Networks Science"]).select("id", "name")


@query(f"SELECT topic_id, count(DISTINCT paper_id) AS n FROM v_pt JOIN papers p ON p.id = paper_id WHERE publication_date BETWEEN DATE '{FROM}' AND DATE '{TO}' GROUP BY 1")
def count_distinct_by_topic(spark, d):
    return P.count_topic_papers(V.papers(spark, d, "id", "publication_date"), V.paper_topics(spark, d), FROM, TO)


@query(f"SELECT 'indexing' AS panel, id FROM papers WHERE NOT coalesce(is_indexed, FALSE) AND publication_date BETWEEN DATE '{FROM}' AND DATE '{TO}' UNION ALL SELECT 'keyphrases', id FROM papers WHERE coalesce(len(extracted_keywords), 0) = 0 AND publication_date BETWEEN DATE '{FROM}' AND DATE '{TO}'")
def work_candidates(spark, d):
    p = V.papers(spark, d, "id", "publication_date", "is_indexed", "extracted_keywords", "primary_topic_id")
    parts = [P.work_candidates(p, panel, FROM, TO).select(F.lit(panel).alias("panel"), "id") for panel in ("indexing", "keyphrases")]
    return parts[0].unionByName(parts[1])


@query("SELECT t.id, t.name, s.subfield_name, s.field_name, f.domain_name FROM topics t LEFT JOIN (SELECT subfield_id, min(subfield_name) AS subfield_name, min(field_name) AS field_name FROM topics GROUP BY 1) s ON s.subfield_id = t.subfield_id LEFT JOIN (SELECT field_name, min(domain_name) AS domain_name FROM topics GROUP BY 1) f ON f.field_name = s.field_name")
def topics_with_hierarchy(spark, d):
    """The hierarchy put together again from its levels."""
    t = V.topics(spark, d)
    s = t.groupBy(F.col("subfield_id").alias("id")).agg(F.min("subfield_name").alias("name"), F.min("field_name").alias("field"))
    return V.topic_hierarchy(t, s, t.groupBy(F.col("field_name").alias("name")).agg(F.min("domain_name").alias("domain")))


@query(_JAN + "SELECT js.topic_id, o.name, o.subfield_name, o.field_name, stat_year, january, artificial FROM js LEFT JOIN topics o ON o.id = js.topic_id WHERE stat_year BETWEEN 2015 AND 2020 AND artificial >= 1 AND o.subfield_id IN (1, 2, 3, 4)")
def january_anomaly_rows(spark, d):
    return S.january_rows(_january(spark, d), V.topics(spark, d), 2015, 2020, 1, subfield_ids=[1, 2, 3, 4])


@query("SELECT DISTINCT user_id, u.category, u.key FROM (SELECT user_id, unnest([{'category': 'subfield', 'key': CAST(o.subfield_id AS VARCHAR)}, {'category': 'field', 'key': o.field_name}, {'category': 'domain', 'key': o.domain_name}, {'category': 'keyword', 'key': lower(split_part(o.name, ' ', 1))}]) AS u FROM v_track t JOIN topics o ON o.id = t.topic_id)")
def tracked_levels(spark, d):
    return V.tracked_levels(spark, d)
