"""Queue operations, event windows and ingest planning as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import ingest
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


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")


def _messages(spark, d):
    """Events as messages: a queue and options from the type, ids from the event."""
    e = _events(spark, d)
    q = F.when(F.col("event_type") == "click", "queue:paper_indexing").when(F.col("event_type") == "view", "queue:keyword_extraction")
    return e.select(q.alias("queue"), F.col("event_id").alias("task_id"), F.substring_index(q, ":", -1).alias("task_type"), F.array(F.col("user_id"), F.col("event_id") % 50).alias("ids"), F.concat(F.lit("o"), (F.col("event_id") % 3).cast("string")).alias("options"), F.col("ts").alias("created_at")).filter("queue is not null")


_MSG = "+ msg AS (SELECT CASE event_type WHEN 'click' THEN 'queue:paper_indexing' ELSE 'queue:keyword_extraction' END AS queue, event_id AS task_id, [user_id, event_id % 50] AS ids, 'o' || (event_id % 3) AS options FROM events WHERE event_type IN ('click', 'view')) "


_NUM = """, u AS (SELECT queue, options, task_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM msg), f AS (SELECT queue, options, id, min(task_id * 1000 + pos) AS came FROM u GROUP BY 1, 2, 3), p AS (SELECT *, row_number() OVER (PARTITION BY queue, options ORDER BY came) - 1 AS place FROM f), t AS (SELECT queue, options, min(task_id) AS task_id, count(*) AS merged FROM msg GROUP BY 1, 2) """


@query(_MSG + _NUM + "SELECT t.queue, t.options, t.task_id, t.merged, string_agg(id, ',' ORDER BY place) AS ids FROM t JOIN p ON p.queue = t.queue AND p.options = t.options GROUP BY 1, 2, 3, 4")
def coalesce_messages(spark, d):
    m = K.coalesce_all(_messages(spark, d), ["queue", "options"], 1_000_000)
    return m.select("queue", "options", "task_id", "merged", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(_MSG.replace("'o' || (event_id % 3) AS options", "'o' || (event_id % 3) AS options, floor(epoch(ts) / 3600) AS st") + """, r AS (SELECT *, CASE WHEN lag(options) OVER w IS NOT DISTINCT FROM options THEN 0 ELSE 1 END AS c FROM msg WINDOW w AS (PARTITION BY queue, st ORDER BY task_id)), g AS (SELECT *, sum(c) OVER (PARTITION BY queue, st ORDER BY task_id) AS run FROM r), p AS (SELECT *, floor((2 * row_number() OVER (PARTITION BY queue, st, run ORDER BY task_id) - 1) / 4) AS part FROM g),
n AS (SELECT queue, options, st, run, part, min(task_id) AS task_id, count(*) AS merged FROM p GROUP BY ALL), i AS (SELECT queue, st, run, part, id, min(task_id * 10 + pos) AS came FROM (SELECT *, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM p) GROUP BY ALL)
SELECT n.queue, n.options, n.task_id, n.merged, string_agg(id, ',' ORDER BY came) AS ids FROM n JOIN i ON i.queue = n.queue AND i.st = n.st AND i.run = n.run AND i.part = n.part GROUP BY n.queue, n.options, n.st, n.run, n.part, n.task_id, n.merged""")
def coalesce_adjacent_messages(spark, d):
    m = K.coalesce_adjacent(_messages(spark, d), ["queue", "options"], 4)
    return m.select("queue", "options", "task_id", "merged", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(_MSG + _NUM + "SELECT queue, options, CAST(floor(place / 20) AS INT) AS part, string_agg(id, ',' ORDER BY place) AS ids FROM p GROUP BY 1, 2, 3")
def split_messages(spark, d):
    m = K.coalesce_all(_messages(spark, d), ["queue", "options"], 20)
    return m.select("queue", "options", "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT queue, task_id, priority FROM (SELECT CASE event_type WHEN 'click' THEN 'queue:paper_indexing' ELSE 'queue:keyword_extraction' END AS queue, event_id AS task_id, CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS priority FROM events WHERE event_type IN ('click', 'view'))")
def messages_by_priority(spark, d):
    return K.by_priority(_messages(spark, d), ["queue:keyword_extraction", "queue:paper_indexing"]).select("queue", "task_id", "priority")


@query("+ e AS (SELECT DISTINCT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), n AS (SELECT a.user_id, a.event_type, a.t, (SELECT min(b.t) FROM e b WHERE b.user_id IS NOT DISTINCT FROM a.user_id AND b.event_type IS NOT DISTINCT FROM a.event_type AND b.t >= a.t + 86400) AS nxt FROM e a), w AS (SELECT user_id, event_type, min(t) AS t FROM e GROUP BY 1, 2 UNION ALL SELECT n.user_id, n.event_type, n.nxt FROM w JOIN n ON n.user_id IS NOT DISTINCT FROM w.user_id AND n.event_type IS NOT DISTINCT FROM w.event_type AND n.t = w.t WHERE n.nxt IS NOT NULL) SELECT user_id, event_type, t AS locked_at FROM w".replace("+ e AS", "+R e AS"))
def dedupe_tasks_ttl(spark, d):
    """Tasks that pass a lock of a day per user and type."""
    return K.dedupe_locks(_events(spark, d), ["user_id", "event_type"], "ts", 86_400)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return K.tumbling(_events(spark, d), "1 day", keys=["event_type"]).withColumn("total", F.round("total", 4))


@query("SELECT window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 12 HOUR, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR]) AS window_start FROM events) GROUP BY 1")
def events_sliding(spark, d):
    return K.sliding(_events(spark, d), "24 hours", "6 hours")


@query("+ e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 3 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, s")
def events_session(spark, d):
    return K.sessions(_events(spark, d), "3 hours")


@query("SELECT event_type, max(event_id) AS event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM events) WHERE r = 1 GROUP BY 1")
def latest_event_by_key(spark, d):
    return K.latest_events(_events(spark, d), "event_type", "ts").select("event_type", "event_id")


_UNITS = "+ u AS (SELECT t.id AS topic_id, CAST(g AS DATE) AS period_start, (row_number() OVER (ORDER BY t.id, g) - 1) AS nr FROM topics t, generate_series(DATE '2020-01-01', DATE '2020-06-01', INTERVAL 1 MONTH) x(g)), q AS (SELECT *, CAST(50000 // 2400 + CASE WHEN nr < 50000 % 2400 THEN 1 ELSE 0 END AS BIGINT) AS quota FROM u) "


def _units(spark, d):
    return ingest.plan_units(V.topics(spark, d), dates.months(spark, "2020-01-01", "2020-06-30"), 50_000, 8, 7)


@query(_UNITS + "SELECT topic_id, period_start, quota, CAST(ceil(quota / 8.0) AS BIGINT) AS pages, CAST(7 + nr AS BIGINT) AS unit_seed FROM q")
def plan_units(spark, d):
    return _units(spark, d)


@query(_UNITS + "SELECT topic_id, period_start, p AS page, least(8, quota - (p - 1) * 8) AS wanted FROM q, generate_series(1, CAST(ceil(quota / 8.0) AS BIGINT)) x(p)")
def plan_pages(spark, d):
    return ingest.plan_pages(_units(spark, d), 8)


@query("+ x AS (SELECT record_id, unnest(authors) AS a, generate_subscripts(authors, 1) AS i FROM external_papers) SELECT record_id, count(*) AS n_authors, count(DISTINCT a.external_id) AS n_ids, count(CASE WHEN a.is_corresponding THEN 1 END) AS n_corresponding FROM x WHERE a IS NOT NULL GROUP BY 1")
def record_author_counts(spark, d):
    x = table(spark, d, "external_papers", "record_id", "authors").select("record_id", F.explode("authors").alias("a")).filter("a is not null")
    return x.groupBy("record_id").agg(F.count("*").alias("n_authors"), F.countDistinct("a.external_id").alias("n_ids"), F.count(F.when(F.col("a.is_corresponding"), 1)).alias("n_corresponding"))


@query(_UNITS + ", m AS (SELECT topic_id, period_start, works_count FROM v_monthly) SELECT q.topic_id, q.period_start, quota, coalesce(works_count, 0) AS loaded, greatest(quota - coalesce(works_count, 0), 0) AS missing, coalesce(works_count < 3, FALSE) AND greatest(quota - coalesce(works_count, 0), 0) > 0 AS exhausted FROM q LEFT JOIN m ON m.topic_id = q.topic_id AND m.period_start = q.period_start")
def unit_report(spark, d):
    """What each planned unit got; a unit of fewer than three works is taken as exhausted."""
    pages = V.monthly(spark, d).select("topic_id", "period_start", F.col("works_count").alias("loaded"), (F.col("works_count") < 3).alias("last"))
    return ingest.unit_report(_units(spark, d), pages)
