"""Task queues as micro-batches: priorities, coalescing, splitting, dedupe locks, dead letters, and windows over events.

Messages are rows (queue, task_id, task_type, ids, options, created_at). The batch functions are plain DataFrame
operators, so that a micro-batch and a table give the same result; `run_queue` drives them with foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Task types of the queues (fixed values).
TASK_TYPES = [
    "keyword_extraction",
    "collect_topic_stats",
    "bootstrap_papers",
    "resume_bootstrap_papers",
    "paper_indexing",
    "entity_indexing",
    "recompute_topic_clusters",
    "cluster_dynamics_recompute",
    "topic_quarter_report",
    "user_profile_recompute",
]
#: Queue of each task type (fixed values), in the order of priority that a worker takes them in.
QUEUES = {
    "keyword_extraction": "queue:keyword_extraction",
    "collect_topic_stats": "queue:openalex_topic_stats",
    "bootstrap_papers": "queue:openalex_bootstrap_papers",
    "resume_bootstrap_papers": "queue:openalex_bootstrap_papers",
    "paper_indexing": "queue:paper_indexing",
    "entity_indexing": "queue:entity_indexing",
    "recompute_topic_clusters": "queue:cluster_recompute",
    "cluster_dynamics_recompute": "queue:cluster_dynamics_recompute",
    "topic_quarter_report": "queue:topic_quarter_reports",
    "user_profile_recompute": "queue:user_profile_recompute",
}
FAILED_QUEUE = "queue:failed_tasks"
SCHEMA = "queue string, task_id bigint, task_type string, ids array<bigint>, options string, created_at timestamp"


def check_queues(names: str) -> tuple[str, ...]:
    """Queue names from a comma-separated list; each is `queue:` and a word of letters, digits and underscores."""
    import re

    out = tuple(n.strip() for n in names.split(",") if n.strip())
    if not out or any(not re.fullmatch(r"queue:\w+", n) for n in out):
        raise ValueError(f"bad queue names: {names}")
    return out


def message(task_type: str, ids: list[int], **options) -> dict:
    """A canonical message; unknown types are refused, ids are distinct in order."""
    if task_type not in TASK_TYPES:
        raise ValueError(f"unknown task type: {task_type}")
    return {"task_type": task_type, "ids": list(dict.fromkeys(ids)), **options}


def by_priority(messages: DataFrame, queues: list[str], hidden: list[str] = ()) -> DataFrame:
    """Messages of the queues in their order of priority, oldest first; queues in cooldown are hidden."""
    rank = F.coalesce(*[F.when(F.col("queue") == q, F.lit(i)) for i, q in enumerate(queues)], F.lit(len(queues)))
    return messages.filter(F.col("queue").isin([q for q in queues if q not in hidden])).withColumn("priority", rank)


def _numbered(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, place): the distinct ids of all messages of equal keys, numbered from 0 in the order they first came in.

    An id is found by aggregation, not by gathering lists; the numbering sorts a key's distinct ids, spilling as it must.
    """
    each = messages.select(*keys, "task_id", F.posexplode("ids").alias("pos", "id"))
    first = each.groupBy(*keys, "id").agg(F.min(F.struct("task_id", "pos")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1).select(*keys, "id", "place")


def coalesce_all(messages: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """All messages of equal keys as one, cut into parts of at most limit ids: (keys, part from 0, ids, task_id, merged).

    ids are the distinct ones in order of arrival, task_id the first of the key and merged how many messages it had. No
    more than limit ids are ever gathered. Messages without ids make one part of none, if the key has no others.
    """
    total = messages.groupBy(*keys).agg(F.min("task_id").alias("task_id"), F.count("*").alias("merged"))
    parts = _numbered(messages, keys).withColumn("part", F.floor(F.col("place") / limit).cast("int"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda p: p["id"])
    parts = parts.groupBy(*keys, "part").agg(ids.alias("ids"))
    x = total.alias("t").join(parts.alias("p"), [F.col(f"t.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys], "left")
    empty = F.array().cast(messages.schema["ids"].dataType)
    return x.select(*[F.col(f"t.{k}").alias(k) for k in keys], F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("ids", empty).alias("ids"), "task_id", "merged")


def coalesce_adjacent(messages: DataFrame, keys: list[str], limit: int, seconds: int = 3_600) -> DataFrame:
    """Neighbouring messages of a queue with equal keys as one, up to limit ids each (counted with repeats).

    A queue is walked in stretches of `seconds` of created_at, so that a queue of any length is many tasks; neighbours
    on two sides of a stretch's end stay two messages, as they do where a batch ends.
    """
    stretch = F.floor(F.coalesce(F.unix_timestamp("created_at"), F.lit(0)) / seconds)
    x = messages.withColumn("_stretch", stretch)
    w = Window.partitionBy("queue", "_stretch").orderBy("task_id")
    change = F.coalesce(F.lag(F.struct(*keys)).over(w) != F.struct(*keys), F.lit(True)).cast("int")
    x = x.withColumn("_run", F.sum(change).over(w))
    filled = F.sum(F.size("ids")).over(Window.partitionBy("queue", "_stretch", "_run").orderBy("task_id"))
    x = x.withColumn("_part", F.floor((filled - 1) / limit))
    ids = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("task_id", "ids"))), lambda p: p["ids"])))
    g = x.groupBy("queue", "_stretch", "_run", "_part", *[k for k in keys if k != "queue"]).agg(F.min("task_id").alias("task_id"), ids.alias("ids"), F.count("*").alias("merged"))
    return g.drop("_stretch", "_run", "_part")


def split_oversized(messages: DataFrame, limit: int) -> DataFrame:
    """Messages of more than limit ids in parts, numbered from 0; the other columns are kept."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("ids") - 1, F.lit(0)), F.lit(limit))
    part = lambda s: F.struct((s / limit).cast("int").alias("part"), F.slice("ids", s + 1, F.lit(limit)).alias("ids"))
    rest = [c for c in messages.columns if c != "ids"]
    return messages.select(*rest, F.explode(F.transform(starts, part)).alias("p")).select(*rest, "p.part", "p.ids")


def dedupe_locks(tasks: DataFrame, key: list[str], ts: str, ttl_seconds: int) -> DataFrame:
    """(key, locked_at): tasks whose key holds no lock; a task that passes locks its key for ttl seconds.

    A key's state is its distinct seconds, put together by partial aggregation: however many rows a key has, it is no
    larger than the span of time. Each key is walked once, in Arrow batches, from lock to lock by binary search.
    """
    t = F.unix_timestamp(F.col(ts))
    g = tasks.groupBy(*key).agg(F.array_sort(F.collect_set(t)).alias("_t"))

    @F.pandas_udf("array<bigint>")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for x in s:
                x, locks, i = np.asarray(x), [], 0
                while i < len(x):
                    locks.append(int(x[i]))
                    i = int(np.searchsorted(x, x[i] + ttl_seconds))
                out.append(locks)
            yield pd.Series(out, dtype=object)

    return g.select(*key, F.explode(walk("_t")).alias("locked_at"))


def dead_letters(handled: DataFrame) -> DataFrame:
    """Failed messages as (source_queue, task_id, error, message)."""
    return handled.filter("error is not null").select(F.col("queue").alias("source_queue"), "task_id", "error", F.to_json(F.struct("task_type", "ids", "options")).alias("message"))


def restore_failed(letters: DataFrame, source_queue: str | None = None, error_like: str | None = None) -> DataFrame:
    """Dead letters back as messages, filtered by queue and error."""
    x = letters
    if source_queue:
        x = x.filter(F.col("source_queue") == source_queue)
    if error_like:
        x = x.filter(F.col("error").contains(error_like))
    m = F.from_json("message", "task_type string, ids array<bigint>, options string")
    return x.select(F.col("source_queue").alias("queue"), "task_id", m.alias("m")).select("queue", "task_id", "m.*")


def advance(stages: list[str], done: dict[str, str], missing: dict[str, int]) -> tuple[str, str | None]:
    """(state, next stage) of a workflow: failed or stale stages stop it, finished ones and those that miss nothing are passed."""
    for s in stages:
        state = done.get(s)
        if state in ("failed", "stale"):
            return "stopped", s
        if state == "running":
            return "running", s
        if state != "done" and missing.get(s, 0) > 0:
            return "enqueue", s
    return "finished", None


def heartbeats(beats: DataFrame, now: str, ttl_seconds: int = 60) -> DataFrame:
    """(worker, last_beat, alive): the last beat (worker, ts) of each worker, alive if it is no older than ttl."""
    g = beats.groupBy("worker").agg(F.max("ts").alias("last_beat"))
    age = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("last_beat")
    return g.withColumn("alive", age <= ttl_seconds)


def request_rates(requests: DataFrame, ts: str, per_second: int) -> DataFrame:
    """(second, n, over): requests in each second of the log, and how many more than allowed."""
    g = requests.groupBy(F.date_trunc("second", ts).alias("second")).agg(F.count("*").alias("n"))
    return g.withColumn("over", F.greatest(F.col("n") - per_second, F.lit(0)))


def latest_events(events: DataFrame, key: str, ts: str) -> DataFrame:
    """The latest event of each key."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("_e")).select(key, "_e.*")


def tumbling(events: DataFrame, width: str, ts: str = "ts", keys: list[str] = ()) -> DataFrame:
    return events.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, step: str, ts: str = "ts") -> DataFrame:
    return events.groupBy(F.window(ts, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_queue(
    spark: SparkSession,
    inbox: str,
    checkpoint: str,
    handlers: dict[str, Callable[[DataFrame], DataFrame]],
    out: str,
    limit: int = 128,
    max_files: int = 16,
    queues: str | None = None,
    hidden: list[str] = (),
) -> StreamingQuery:
    """A bounded run over the JSON messages in inbox: dedupe, priority, coalesce and split, dispatch by task type, results and dead letters to out.

    A handler takes the messages of its type and adds the column error; it is run once a batch and its result kept for
    both outputs. Types without a handler are dead letters. queues: names in their order of priority, all by default;
    messages of other queues and of hidden ones (in cooldown) wait: they are written to out/waiting.
    """
    order = list(check_queues(queues)) if queues else list(dict.fromkeys(QUEUES.values()))

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        now = by_priority(df, order, hidden)
        df.join(now.select("queue").distinct(), "queue", "left_anti").write.mode("overwrite").json(f"{out}/waiting/batch={n}")
        m = coalesce_all(now, ["queue", "priority", "task_type", "options"], limit).drop("merged")
        known = list(handlers)
        done = [h(m.filter(F.col("task_type") == t)) for t, h in handlers.items()]
        done.append(m.filter(~F.coalesce(F.col("task_type").isin(known), F.lit(False)) if known else F.lit(True)).withColumn("error", F.lit("unknown task type")))
        handled = done[0].select(*done[-1].columns)
        for x in done[1:]:
            handled = handled.unionByName(x.select(*done[-1].columns))
        handled = handled.persist(StorageLevel.MEMORY_AND_DISK)
        handled.filter("error is null").orderBy("priority", "task_id", "part").write.mode("overwrite").parquet(f"{out}/handled/batch={n}")
        dead_letters(handled).write.mode("overwrite").parquet(f"{out}/dead/batch={n}")
        handled.unpersist()
        df.unpersist()

    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).json(inbox)
    s = s.withWatermark("created_at", "24 hours").dropDuplicatesWithinWatermark(["queue", "task_id"])
    return s.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
