"""Small relations around records: ids in a caller's order, payloads with defaults, keyed state, typed rows and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark types of a vector collection's payload fields (fixed values).
PAYLOAD_TYPES = {"keyword": "string", "text": "string", "integer": "bigint", "float": "double", "bool": "boolean", "datetime": "timestamp"}


def payload_schema(fields: dict[str, str]) -> str:
    """The Spark schema of payload fields by their index kind; unknown kinds are refused."""
    bad = sorted(set(fields.values()) - set(PAYLOAD_TYPES))
    if bad:
        raise ValueError(f"unknown field kinds: {bad}")
    return ", ".join(f"{k} {PAYLOAD_TYPES[v]}" for k, v in fields.items())


def resolve_ids(items: DataFrame, table: DataFrame, key: str, place: str, id_col: str = "id") -> DataFrame:
    """(id, place): ids of items (key, place) in the order they first come, each once; unknown keys are left out."""
    known = table.select(key, id_col).filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias(id_col))
    return items.select(key, place).join(known, key).groupBy(id_col).agg(F.min(place).alias(place)).orderBy(place)


def indexed_hashes(papers: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, text_hash) of papers that are indexed and have one, among ids if they are given."""
    x = papers.filter("is_indexed and text_hash is not null").select("id", "text_hash")
    return x if ids is None else x.join(ids.select("id").distinct(), "id", "left_semi")


def estimates_for(estimates: DataFrame, topic_ids: list[int], years: list[int]) -> DataFrame:
    """Estimates (topic_id, stat_year, artificial) of all topics and years named; both lists reach the scan."""
    return estimates.filter(F.col("topic_id").isin(topic_ids) & F.col("stat_year").isin(years)).select("topic_id", "stat_year", "artificial")


def exists(df: DataFrame, test: Column) -> bool:
    return not df.filter(test).limit(1).isEmpty()


def listed_newest(df: DataFrame, user_id: int, id_col: str, time_col: str = "created_at") -> DataFrame:
    """One user's entities, the newest first; ties by id."""
    return df.filter(F.col("user_id") == user_id).orderBy(F.desc(time_col), id_col).select(id_col)


def with_defaults(payload: Column, defaults: dict[str, Column]) -> Column:
    """A map payload with defaults for the keys it lacks or holds null or '' for."""
    have = F.map_filter(payload, lambda k, v: v.isNotNull() & (v != ""))
    base = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), v.cast("string"))])
    only = F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(have, k), F.lit(False)))
    return F.map_concat(only, have)


def merged(source: Column, overrides: Column) -> Column:
    """A map with the overrides in place of its own values."""
    return F.map_concat(F.map_filter(source, lambda k, v: ~F.coalesce(F.map_contains_key(overrides, k), F.lit(False))), overrides)


def first_of(payload: Column, *keys: str) -> Column:
    """The value of the first key that a map payload has one for."""
    return F.coalesce(*[F.try_element_at(payload, F.lit(k)) for k in keys])


def typed_periods(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects with reason) of period payloads (cluster_key, payload: map): dates must be dates, numbers numbers.

    Missing counts are 0 and other missing numbers null; a value that is there but can't be read rejects its row.
    """
    kinds = {"period_start": "date", "period_end": "date", "paper_count": "bigint", "previous_paper_count": "bigint", "growth_rate": "double", "trend_score": "double", "semantic_drift": "double"}
    raw = {k: F.nullif(F.trim(F.try_element_at("payload", F.lit(k))), F.lit("")) for k in kinds}
    value = {k: (F.substring(raw[k], 1, 10) if t == "date" else raw[k]).try_cast(t) for k, t in kinds.items()}
    why = F.coalesce(*[F.when(raw[k].isNotNull() & value[k].isNull(), F.lit(f"bad {k}")) for k in kinds], *[F.when(raw[k].isNull(), F.lit(f"no {k}")) for k in ("period_start", "period_end")])
    x = payloads.select("cluster_key", "payload", why.alias("reason"), *[v.alias(k) for k, v in value.items()])
    counts = [F.coalesce(k, F.lit(0)).alias(k) for k in ("paper_count", "previous_paper_count")]
    rows = x.filter("reason is null").select("cluster_key", "period_start", "period_end", *counts, "growth_rate", "trend_score", "semantic_drift")
    return rows, x.filter("reason is not null").select("cluster_key", "payload", "reason")


def live_state(log: DataFrame, now: str) -> DataFrame:
    """(key, value) of a log of writes (key, value, ts, ttl_seconds): the last write of each key, if it hasn't expired; a null value deletes."""
    last = log.groupBy("key").agg(F.max_by(F.struct("value", "ts", "ttl_seconds"), F.col("ts")).alias("w")).select("key", "w.*")
    age = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("ts")
    return last.filter(F.col("value").isNotNull() & (F.col("ttl_seconds").isNull() | (age < F.col("ttl_seconds")))).select("key", "value")


def distinct_in_order(df: DataFrame, keys: list[str], value: str, place: str) -> DataFrame:
    """(keys, values): distinct values of each group in the order they first come; groups are few rows (a paper's institutions)."""
    first = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(place).alias("_p"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", value))), lambda x: x[value]).alias("values"))
