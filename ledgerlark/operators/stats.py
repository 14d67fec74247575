"""Statistics over events, value counts and the index. All counts are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import base64_text
from ..model import BUSY_LEDGER_TX, COUNT_TYPES, INDEX_PREFIXES, KEY_BYTES, TOPICS

PERCENTILES = (50, 75, 90, 99)


def count_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total_events"))


def ledger_bounds(events: DataFrame) -> DataFrame:
    """First and last ledger; null for an empty table."""
    return events.agg(F.min("ledger_sequence").alias("min_ledger"), F.max("ledger_sequence").alias("max_ledger"))


def store_stats(events: DataFrame) -> DataFrame:
    """Events, first and last ledger, contracts."""
    return events.agg(
        F.count(F.lit(1)).alias("total_events"), F.min("ledger_sequence").alias("min_ledger"), F.max("ledger_sequence").alias("max_ledger"), F.count_distinct("contract_id").alias("unique_contracts")
    )


def event_stats(events: DataFrame) -> DataFrame:
    """Events by type; distinct contracts and topics by position.

    Distinct values are counted from the value counts, so the shuffle carries each value once a
    task, and not each event expanded once for every distinct aggregate.
    """
    from .index import build_counts

    kinds = events.agg(
        F.count(F.lit(1)).alias("total_events"),
        *[F.count_if(F.col("event_type") == code).alias(f"{name}_events") for code, name in ((0, "contract"), (1, "system"), (2, "diagnostic"))],
    )
    distinct = build_counts(events).groupBy().agg(*[F.count_if(F.col("type") == code).alias(f"unique_{name}s") for name, code in COUNT_TYPES.items()])
    one = lambda df, c: df.select(c).scalar().alias(c)
    return events.sparkSession.range(1).select(*[one(kinds, c) for c in kinds.columns], *[one(distinct, c) for c in distinct.columns])


def ledger_tx_stats(events: DataFrame) -> DataFrame:
    """Ledgers that have events, and how many of them have a transaction index of 10,000 or more."""
    most = events.groupBy("ledger_sequence").agg(F.max("transaction_index").alias("most"))
    return most.agg(F.count(F.lit(1)).alias("ledgers"), F.count_if(F.col("most") >= BUSY_LEDGER_TX).alias("busy_ledgers"))


def _named(codes: dict[str, int], column: str) -> Column:
    out = F.lit(None).cast("string")
    for name, code in codes.items():
        out = F.when(F.col(column) == code, name).otherwise(out)
    return out


def unique_counts(counts: DataFrame) -> DataFrame:
    """A row for each index type: distinct values, and the sum of their counts."""
    rows = counts.groupBy("type").agg(F.count(F.lit(1)).alias("unique_values"), F.sum("count").alias("total_count"))
    return rows.select(_named(COUNT_TYPES, "type").alias("index_type"), "unique_values", "total_count")


def distribution(counts: DataFrame) -> DataFrame:
    """A row for each index type: size, extremes, mean, percentiles, values over 32 bytes.

    The percentile is the count at position ``floor((n - 1) * p / 100)`` in ascending order. Equal
    counts are aggregated first, so what is ordered is the distinct counts and not the values.
    """
    sizes = counts.groupBy("type", "count").agg(F.count(F.lit(1)).alias("values"), F.count_if(F.octet_length("value") > KEY_BYTES).alias("long_values"))
    totals = sizes.groupBy("type").agg(
        F.sum("values").alias("unique_values"), F.sum(F.col("count") * F.col("values")).alias("total_count"), F.min("count").alias("min_count"), F.max("count").alias("max_count"), F.sum("long_values").alias("over_32_bytes")
    )
    upto = Window.partitionBy("type").orderBy("count").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sizes.withColumn("upto", F.sum("values").over(upto)).join(totals.select("type", "unique_values"), "type")
    at = lambda p: F.floor((F.col("unique_values") - 1) * F.lit(float(p)) / 100)
    percentiles = ranked.groupBy("type").agg(*[F.min(F.when(F.col("upto") > at(p), F.col("count"))).alias(f"p{p}") for p in PERCENTILES])
    out = totals.join(percentiles, "type")
    return out.select(_named(COUNT_TYPES, "type").alias("index_type"), "unique_values", "total_count", "min_count", "max_count", (F.col("total_count") / F.col("unique_values")).alias("mean_count"), *[f"p{p}" for p in PERCENTILES], "over_32_bytes")


def top_values(counts: DataFrame, top: int = 10) -> DataFrame:
    """For each index type the values with the largest counts; of equal counts, the smaller value first."""
    if top < 0:
        raise ValueError("top must not be negative")
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("count"), "value"))
    rows = counts.withColumn("rank", rank).where(F.col("rank") <= top)
    return rows.select(_named(COUNT_TYPES, "type").alias("index_type"), "rank", base64_text(F.col("value")).alias("value"), "count")


def index_segments(index: DataFrame) -> DataFrame:
    """For each kind of value: keys with their segments, values, ledgers."""
    rows = index.groupBy("prefix", "key32", "segment_id").agg(F.count(F.lit(1)).alias("ledgers"))
    out = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("stored_segments"), F.sum("ledgers").alias("ledger_entries"), F.max("segment_id").alias("current_segment"))
    return out.select(_named(INDEX_PREFIXES, "prefix").alias("index_type"), "stored_segments", "ledger_entries", "current_segment")


def event_bytes(events: DataFrame) -> DataFrame:
    """Bytes of topics and data, altogether and for an event."""
    size = F.coalesce(F.octet_length("contract_id"), F.lit(0)) + F.aggregate("topics", F.lit(0), lambda acc, t: acc + F.octet_length(t)) + F.coalesce(F.octet_length("data"), F.lit(0))
    rows = events.agg(F.count(F.lit(1)).alias("total_events"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bytes"))
    return rows.withColumn("avg_bytes", F.when(F.col("total_events") > 0, F.col("total_bytes") / F.col("total_events")).otherwise(0.0))


def segment_rollup(events: DataFrame) -> DataFrame:
    """Events, ledgers and contracts of each segment."""
    return events.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("ledger_sequence").alias("ledgers"), F.count_distinct("contract_id").alias("contracts"), F.count_distinct(*TOPICS[:1]).alias("topic0_values")
    )
