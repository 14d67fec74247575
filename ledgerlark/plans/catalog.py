"""The registered queries over the event store and the SQL that each must agree with.

Every query makes the canonical events of a folder's ``events`` table; the SQL does the same in its
first two common tables, ``ev`` and, where an index is meant, ``idx`` and ``vals``.
"""

from __future__ import annotations

from base64 import b64encode
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import contract_name, symbol
from ..functions.columns import base64_text, blob, event_of_blob, key_bytes, type_name
from ..model import KEY
from ..operators import index as ix
from ..operators import predicates as p
from ..operators import stats
from ..operators.store import LAST, EventStore, last_written
from ..sources.canonical import contract_events
from ..sources.scratch import scratch_folder
from .query import EventQuery, Options, compare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: What the queries ask for: a user's contract, a topic, a range of ledgers.
USER, KIND, LO, HI, LEDGER = 7, "purchase", 20, 900, 25
CONTRACT = sha256(str(USER).encode()).digest()
TOPIC = symbol(KIND)

EV = """
WITH ev AS (
  SELECT CAST((2 + event_id // 10) // 1000000 AS BIGINT) AS segment_id, CAST(2 + event_id // 10 AS BIGINT) AS ledger_sequence,
    CAST(1 + event_id % 10 AS INT) AS transaction_index, CAST(0 AS INT) AS operation_index, CAST(0 AS INT) AS event_index,
    upper(sha256(CAST(user_id AS VARCHAR))) AS contract_hex,
    '0000000F' || lpad(upper(printf('%x', strlen(event_type))), 8, '0') || hex(encode(event_type)) || repeat('00', CAST((4 - strlen(event_type) % 4) % 4 AS INT)) AS topic0_hex,
    '0000000E' || lpad(upper(printf('%x', strlen(props))), 8, '0') || hex(encode(props)) || repeat('00', CAST((4 - strlen(props) % 4) % 4 AS INT)) AS topic1_hex,
    CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INT) AS event_type, event_id AS write_seq
  FROM events
), vals AS (
  SELECT segment_id, ledger_sequence, 'contract' AS name, contract_hex AS v FROM ev
  UNION ALL SELECT segment_id, ledger_sequence, 'topic0', topic0_hex FROM ev
  UNION ALL SELECT segment_id, ledger_sequence, 'topic1', topic1_hex FROM ev
), idx AS (SELECT DISTINCT segment_id, ledger_sequence, name, rpad(substr(v, 1, 64), 64, '0') AS key32 FROM vals)
"""
COLUMNS = "ledger_sequence, transaction_index, operation_index, event_index, contract_hex, topic0_hex, topic1_hex, event_type"
ORDER = "ORDER BY ledger_sequence, transaction_index, operation_index, event_index"
C, T0 = CONTRACT.hex().upper(), TOPIC.hex().upper()
HIT = f"contract_hex = '{C}' AND topic0_hex = '{T0}'"
BOTH = f"(SELECT ledger_sequence FROM idx WHERE (name = 'contract' AND key32 = '{C}' OR name = 'topic0' AND key32 = rpad('{T0}', 64, '0')) AND ledger_sequence BETWEEN {LO} AND {HI} GROUP BY ledger_sequence HAVING count(*) = 2)"


def shown(events: DataFrame) -> DataFrame:
    """Event rows with bytes as upper-case hex."""
    return events.select(*KEY, F.hex("contract_id").alias("contract_hex"), F.hex("topic0").alias("topic0_hex"), F.hex("topic1").alias("topic1_hex"), F.col("event_type").cast("int").alias("event_type"))


def _index_rows(index: DataFrame) -> DataFrame:
    names = {v: k for k, v in ix.INDEX_PREFIXES.items()}
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("prefix").cast("int")]
    return index.select(name.alias("index_type"), F.hex("key32").alias("key32"), "segment_id", "ledger_sequence")


def _count_rows(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("type").cast("int").alias("type"), F.hex("value").alias("value_hex"), "count")


def query(sql: str, plain: bool = False):
    """Registers a function of the events, by its name, with its SQL (the part behind the common tables)."""

    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(contract_events(spark, folder))
        ORACLE_SQL[f.__name__] = sql if plain else EV + sql
        return f

    return add


def rows(where: str = "true", limit: int = 0) -> str:
    return f"SELECT {COLUMNS} FROM ev WHERE {where}" + (f" {ORDER} LIMIT {limit}" if limit else "")


@query(rows(f"ledger_sequence BETWEEN {LO} AND {HI}"))
def range_scan(events):
    return shown(p.ledger_range(events, LO, HI))


@query(rows(f"ledger_sequence BETWEEN {LO} AND {HI}", 100))
def range_scan_limit(events):
    return shown(p.ledger_range(events, LO, HI, 100))


@query(rows(f"ledger_sequence = {LEDGER}"))
def single_ledger(events):
    return shown(p.single_ledger(events, LEDGER))


@query(rows(f"contract_hex = '{C}'"))
def by_contract(events):
    return shown(p.by_contract(events, CONTRACT))


@query(rows(f"substr(contract_hex, 1, 2) = '{C[:2]}'"))
def by_contract_prefix(events):
    return shown(p.by_contract(events, CONTRACT[:1]))


@query(rows(f"contract_hex = '{C}' AND ledger_sequence BETWEEN {LO} AND {HI}"))
def by_contract_in_range(events):
    return shown(p.by_contract_in_range(events, CONTRACT, LO, HI))


@query(rows(f"topic0_hex = '{T0}'"))
def by_topic0(events):
    return shown(p.by_topic(events, 0, TOPIC))


@query(rows("topic1_hex = (SELECT min(topic1_hex) FROM ev)"))
def by_topic1(events):
    return shown(events.where(F.col("topic1") == events.agg(F.min("topic1")).scalar()))


@query(rows(f"topic0_hex = '{T0}' AND ledger_sequence BETWEEN {LO} AND {HI}"))
def by_topic_in_range(events):
    return shown(p.by_topic_in_range(events, 0, TOPIC, LO, HI))


@query(rows(HIT))
def contract_and_topic0(events):
    return shown(events.where(p.Filter(CONTRACT, (TOPIC,)).column()))


@query(rows(f"{HIT} AND topic1_hex = (SELECT min(topic1_hex) FROM ev WHERE {HIT}) AND ledger_sequence BETWEEN {LO} AND {HI}"))
def all_filters_and(events):
    hits = events.where(p.Filter(CONTRACT, (TOPIC,)).column())
    return shown(hits.where((F.col("topic1") == hits.agg(F.min("topic1")).scalar()) & p.in_ledgers(LO, HI)))


@query(rows("false"))
def missing_topic_position(events):
    return shown(events.where(p.topic_is(3, TOPIC)))


@query(rows(f"topic0_hex <> '{T0}'"))
def exclude_topic0(events):
    return shown(events.where(p.without_topic0([TOPIC])))


@query("SELECT name AS index_type, key32, segment_id, ledger_sequence FROM idx")
def ledger_index(events):
    return _index_rows(ix.build_index(events))


@query(f"SELECT segment_id, ledger_sequence FROM idx WHERE name = 'contract' AND key32 = '{C}' AND ledger_sequence BETWEEN {LO} AND {HI}")
def index_ledgers_contract(events):
    return ix.ledgers_with(ix.build_index(events), "contract", CONTRACT, LO, HI)


@query(f"SELECT CAST(ledger_sequence // 1000000 AS BIGINT) AS segment_id, ledger_sequence FROM {BOTH}")
def index_ledgers_intersection(events):
    return ix.matching_ledgers(ix.build_index(events), p.Filter(CONTRACT, (TOPIC,)), LO, HI)


@query(f"SELECT count(*) AS matching_ledgers FROM {BOTH}")
def matching_ledger_count(events):
    return EventQuery(events, ix.build_index(events)).run(p.Filter(CONTRACT, (TOPIC,)), LO, HI, Options(count_only=True))


@query(f"SELECT {COLUMNS} FROM ev WHERE ledger_sequence BETWEEN {LO} AND {HI} AND topic0_hex = '{T0}' {ORDER} LIMIT 25")
def indexed_query_limit(events):
    return shown(EventQuery(events, ix.build_index(events)).run(p.Filter(None, (TOPIC,)), LO, HI, Options(limit=25)))


@query(f"SELECT {COLUMNS} FROM ev WHERE ledger_sequence BETWEEN {LO} AND {HI} AND topic0_hex = '{T0}' {ORDER} LIMIT 25")
def widening_query_limit(events):
    return shown(EventQuery(events, ix.build_index(events)).widening(p.Filter(None, (TOPIC,)), LO, HI, 25))


METRICS = """, led AS (SELECT DISTINCT ledger_sequence FROM idx WHERE name = 'topic0' AND key32 = rpad('{t}', 64, '0') AND ledger_sequence BETWEEN {lo} AND {hi}),
cand AS (SELECT *, ledger_sequence * 100 + transaction_index AS k, topic0_hex = '{t}' AS hit FROM ev WHERE ledger_sequence IN (SELECT ledger_sequence FROM led)),
cut AS (SELECT CASE WHEN count(*) >= {n} THEN max(k) END AS last FROM (SELECT k FROM cand WHERE hit ORDER BY k LIMIT {n}))
SELECT CAST({hi} - {lo} + 1 AS BIGINT) AS ledger_range, (SELECT count(*) FROM led) AS matching_ledgers, count(*) AS events_scanned, count(*) FILTER (WHERE hit) AS events_returned,
  (SELECT count(*) FROM led) * 100.0::DOUBLE / ({hi} - {lo} + 1) AS selectivity_percent
FROM cand, cut WHERE last IS NULL OR k <= last"""


@query(METRICS.format(t=T0, lo=LO, hi=HI, n=25))
def query_metrics(events):
    return EventQuery(events, ix.build_index(events)).metrics(p.Filter(None, (TOPIC,)), LO, HI, 25).drop("data_bytes")


def _again(events: DataFrame) -> DataFrame:
    """One ledger's events with other contents, written later."""
    return events.where(F.col("ledger_sequence") == LEDGER).withColumns({"event_type": F.lit(9).cast("byte"), "write_seq": F.col("write_seq") + 1_000_000_000})


REPLACED = f"SELECT {COLUMNS}, write_seq FROM (SELECT * REPLACE (CASE WHEN ledger_sequence = {LEDGER} THEN 9 ELSE event_type END AS event_type, write_seq + CASE WHEN ledger_sequence = {LEDGER} THEN 1000000000 ELSE 0 END AS write_seq) FROM ev)"


@query(REPLACED)
def upsert_last_write_wins(events):
    """Storing one ledger again with other contents replaces its events and leaves the others."""
    kept = last_written(events.unionByName(_again(events)))
    return kept.select(*KEY, F.hex("contract_id").alias("contract_hex"), F.hex("topic0").alias("topic0_hex"), F.hex("topic1").alias("topic1_hex"), F.col("event_type").cast("int").alias("event_type"), "write_seq")


@query("SELECT count(*) AS total_events FROM ev")
def count_events(events):
    return stats.count_events(events)


@query("SELECT min(ledger_sequence) AS min_ledger, max(ledger_sequence) AS max_ledger FROM ev")
def ledger_range(events):
    return stats.ledger_bounds(events)


@query("SELECT count(*) AS total_events, min(ledger_sequence) AS min_ledger, max(ledger_sequence) AS max_ledger, count(DISTINCT contract_hex) AS unique_contracts FROM ev")
def store_stats(events):
    return stats.store_stats(events)


@query("""SELECT count(*) AS total_events, count(*) FILTER (WHERE event_type = 0) AS contract_events, count(*) FILTER (WHERE event_type = 1) AS system_events,
  count(*) FILTER (WHERE event_type = 2) AS diagnostic_events, count(DISTINCT contract_hex) AS unique_contracts, count(DISTINCT topic0_hex) AS unique_topic0s,
  count(DISTINCT topic1_hex) AS unique_topic1s, CAST(0 AS BIGINT) AS unique_topic2s, CAST(0 AS BIGINT) AS unique_topic3s FROM ev""")
def event_stats(events):
    return stats.event_stats(events)


@query("SELECT count(*) AS ledgers, count(*) FILTER (WHERE most >= 10000) AS busy_ledgers FROM (SELECT max(transaction_index) AS most FROM ev GROUP BY ledger_sequence)")
def ledger_tx_stats(events):
    return stats.ledger_tx_stats(events)


@query("SELECT CAST(CASE name WHEN 'contract' THEN 0 WHEN 'topic0' THEN 1 ELSE 2 END AS INT) AS type, v AS value_hex, count(*) AS count FROM vals GROUP BY name, v")
def value_counts(events):
    return _count_rows(ix.build_counts(events))


@query("SELECT name AS index_type, count(*) AS unique_values, CAST(sum(n) AS BIGINT) AS total_count FROM (SELECT name, v, count(*) AS n FROM vals GROUP BY name, v) GROUP BY name")
def unique_index_counts(events):
    return stats.unique_counts(ix.build_counts(events))


def _distribution(name: str):
    at = ", ".join(f"list_sort(list(n))[CAST(floor((count(*) - 1) * {q} / 100.0) AS INT) + 1] AS p{q}" for q in stats.PERCENTILES)
    sql = f"""SELECT name AS index_type, count(*) AS unique_values, CAST(sum(n) AS BIGINT) AS total_count, min(n) AS min_count, max(n) AS max_count,
      CAST(sum(n) AS DOUBLE) / count(*) AS mean_count, {at}, count(*) FILTER (WHERE strlen(v) > 64) AS over_32_bytes
      FROM (SELECT name, v, count(*) AS n FROM vals WHERE name = '{name}' GROUP BY name, v) GROUP BY name"""

    def f(events):
        return stats.distribution(ix.build_counts(events, [name]))

    f.__name__ = f"distribution_{name}"
    query(sql)(f)


for _name in ("contract", "topic0", "topic1"):
    _distribution(_name)


def _top(name: str, names: str, wanted: list[str]):
    sql = f"""SELECT name AS index_type, CAST(rank AS INT) AS rank, replace(to_base64(unhex(v)), chr(10), '') AS value, n AS count FROM (
      SELECT name, v, n, row_number() OVER (PARTITION BY name ORDER BY n DESC, v) AS rank FROM (SELECT name, v, count(*) AS n FROM vals GROUP BY name, v)) WHERE rank <= 10 AND name IN ({names})"""

    def f(events):
        return stats.top_values(ix.build_counts(events, wanted), 10)

    f.__name__ = name
    query(sql)(f)


_top("top_n_contracts", "'contract'", ["contract"])
_top("top_n_topics", "'topic0', 'topic1'", ["topic0", "topic1"])


@query("""SELECT name AS index_type, count(*) AS stored_segments, CAST(sum(n) AS BIGINT) AS ledger_entries, max(segment_id) AS current_segment
  FROM (SELECT name, key32, segment_id, count(*) AS n FROM idx GROUP BY ALL) GROUP BY name""")
def index_segment_counts(events):
    return stats.index_segments(ix.build_index(events))


@query("SELECT count(*) AS total_events, CAST(sum(strlen(contract_hex) + strlen(topic0_hex) + strlen(topic1_hex)) // 2 AS BIGINT) AS total_bytes, CAST(sum(strlen(contract_hex) + strlen(topic0_hex) + strlen(topic1_hex)) // 2 AS DOUBLE) / count(*) AS avg_bytes FROM ev")
def avg_bytes_per_event(events):
    return stats.event_bytes(events.withColumn("data", F.lit(None).cast("binary")))


@query("SELECT segment_id, count(*) AS events, count(DISTINCT ledger_sequence) AS ledgers, count(DISTINCT contract_hex) AS contracts, count(DISTINCT topic0_hex) AS topic0_values FROM ev GROUP BY segment_id")
def segment_rollup(events):
    return stats.segment_rollup(events)


@query(f"SELECT count(*) AS left_rows, count(*) AS right_rows, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, true AS same FROM ev WHERE ledger_sequence BETWEEN {LO} AND {HI} AND topic0_hex = '{T0}'")
def compare_stores(events):
    """The same query with and without the index gives the same rows."""
    filters = p.Filter(None, (TOPIC,))
    return compare(shown(EventQuery(events, ix.build_index(events)).run(filters, LO, HI)), shown(EventQuery(events).run(filters, LO, HI)))


def _projection(events: DataFrame) -> DataFrame:
    return events.select(*KEY, type_name(F.col("event_type")).alias("type"), base64_text(F.col("topic0")).alias("topic0"), base64_text(F.col("topic1")).alias("topic1"))


@query(f"""SELECT ledger_sequence, transaction_index, operation_index, event_index, CASE event_type WHEN 0 THEN 'contract' WHEN 1 THEN 'system' ELSE '' END AS type,
  replace(to_base64(unhex(topic0_hex)), chr(10), '') AS topic0, replace(to_base64(unhex(topic1_hex)), chr(10), '') AS topic1 FROM ev WHERE ledger_sequence BETWEEN {LO} AND {HI}""")
def decode_projection(events):
    return _projection(events.where(p.in_ledgers(LO, HI)))


@query("""SELECT ledger_sequence, transaction_index, operation_index, event_index, CASE event_type WHEN 0 THEN 'contract' WHEN 1 THEN 'system' ELSE '' END AS type,
  replace(to_base64(unhex(topic0_hex)), chr(10), '') AS topic0, replace(to_base64(unhex(topic1_hex)), chr(10), '') AS topic1 FROM ev""")
def decode_events(events):
    """The projection of every event."""
    return _projection(events)


@query("SELECT ledger_sequence, lpad(upper(printf('%x', ledger_sequence)), 8, '0') || lpad(upper(printf('%x', transaction_index)), 4, '0') || '00000000' AS event_key FROM ev")
def event_keys(events):
    return events.select("ledger_sequence", F.hex(key_bytes(*[F.col(k) for k in KEY])).alias("event_key"))


def contract_names(spark: SparkSession, folder: str) -> DataFrame:
    """All events as a query prints them, contract names included (which SQL cannot make)."""
    from .query import decoded

    return decoded(contract_events(spark, folder))


QUERIES["contract_names"] = contract_names


@query("SELECT name AS index_type, key32, segment_id, ledger_sequence FROM idx")
def merged_index(events):
    """Indexes of two overlapping halves, merged."""
    ledgers = F.col("ledger_sequence")
    return _index_rows(ix.merge(ix.build_index(events.where(ledgers <= HI)), ix.build_index(events.where(ledgers >= LO))))


@query("SELECT CAST(CASE name WHEN 'contract' THEN 0 WHEN 'topic0' THEN 1 ELSE 2 END AS INT) AS type, v AS value_hex, count(*) AS count FROM vals GROUP BY name, v")
def merged_counts(events):
    """Counts of two halves, added up."""
    return _count_rows(ix.merge_counts(ix.build_counts(events.where(F.col("ledger_sequence") <= HI)), ix.build_counts(events.where(F.col("ledger_sequence") > HI))))


@query(rows())
def event_blobs(events):
    """Events as binary blobs, read again."""
    read = events.select("*", event_of_blob(blob("contract_id", "topics", "event_type", "data")).alias("e"))
    again = {"contract_id": F.col("e.contract_id"), "topic0": F.get("e.topics", F.lit(0)), "topic1": F.get("e.topics", F.lit(1)), "event_type": F.col("e.event_type")}
    return shown(read.withColumns(again))


# Queries of a written store: pruned reads, the stored index and counts, several versions and one.

_stores: dict[tuple[str, str, str], EventStore] = {}


def stored(spark: SparkSession, folder: str, kind: str) -> EventStore:
    """The folder's events in a store, written once an application. ``versions``: two overlapping writes; ``compacted``: those made one; ``replaced``: one ledger written again."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _stores:
        events, store = contract_events(spark, folder), EventStore(spark, scratch_folder(spark, f"store-{kind}"))
        store.upsert(events.where(F.col("ledger_sequence") <= HI), watermark=LAST)
        store.upsert(events.where(F.col("ledger_sequence") >= LO), watermark=LAST)
        if kind == "replaced":
            store.upsert(_again(events))
        if kind != "versions":
            store.compact()
        _stores[key] = store
    return _stores[key]


def store_query(kind: str, sql: str):
    def add(f: Callable[[EventStore], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(stored(spark, folder, kind))
        ORACLE_SQL[f.__name__] = EV + sql
        return f

    return add


IN_RANGE = f"ledger_sequence BETWEEN {LO} AND {HI}"
COUNTED = "SELECT CAST(CASE name WHEN 'contract' THEN 0 WHEN 'topic0' THEN 1 ELSE 2 END AS INT) AS type, v AS value_hex, count(*) AS count FROM vals GROUP BY name, v"


@store_query("compacted", rows(IN_RANGE))
def store_range_scan(store):
    return shown(store.query().scan(LO, HI))


@store_query("versions", rows(IN_RANGE, 100))
def store_range_limit_of_versions(store):
    return shown(store.query().scan(LO, HI, 100))


@store_query("compacted", rows(f"{HIT} AND {IN_RANGE}"))
def store_contract_and_topic0(store):
    """The filter as a command gets it: a contract's name and base64."""
    return shown(store.query().run(p.Filter.parse(contract_name(CONTRACT), [b64encode(TOPIC).decode()]), LO, HI))


@store_query("compacted", rows(f"substr(contract_hex, 1, 2) = '{C[:2]}' AND {IN_RANGE}"))
def store_contract_prefix(store):
    """A part of a contract through the index."""
    return shown(store.query().run(p.Filter(CONTRACT[:1]), LO, HI))


@store_query("compacted", rows(f"substr(contract_hex, 1, 2) = '{C[:2]}' AND topic0_hex = '{T0}' AND {IN_RANGE}", 5))
def store_prefix_and_topic0_limit(store):
    return shown(store.query().run(p.Filter(CONTRACT[:1], (TOPIC,)), LO, HI, Options(limit=5)))


@store_query("versions", rows(f"topic0_hex = '{T0}' AND ledger_sequence = {LEDGER}"))
def store_single_ledger_filter(store):
    """One ledger with a filter that is pushed down."""
    return shown(store.query().run(p.Filter(None, (TOPIC,)), LEDGER, LEDGER, Options(limit=1000)))


@store_query("compacted", "SELECT name AS index_type, key32, segment_id, ledger_sequence FROM idx")
def store_index(store):
    return _index_rows(store.index())


@store_query("compacted", f"SELECT count(*) AS matching_ledgers FROM {BOTH}")
def store_matching_ledgers(store):
    return store.query().run(p.Filter(CONTRACT, (TOPIC,)), LO, HI, Options(count_only=True))


@store_query("compacted", METRICS.format(t=T0, lo=LO, hi=HI, n=25))
def store_query_metrics(store):
    return store.query().metrics(p.Filter(None, (TOPIC,)), LO, HI, 25).drop("data_bytes")


@store_query("compacted", COUNTED)
def store_value_counts(store):
    """The table of counts as it is stored."""
    return _count_rows(store.counts())


@store_query("versions", COUNTED)
def store_value_counts_of_versions(store):
    return _count_rows(store.counts())


@store_query("replaced", REPLACED)
def store_upsert(store):
    """A ledger stored again with other contents."""
    return store.events().select(*KEY, F.hex("contract_id").alias("contract_hex"), F.hex("topic0").alias("topic0_hex"), F.hex("topic1").alias("topic1_hex"), F.col("event_type").cast("int").alias("event_type"), "write_seq")


@store_query("compacted", "SELECT count(*) AS events, max(ledger_sequence) AS last_processed, CAST(1 AS BIGINT) AS versions, (SELECT count(DISTINCT segment_id) FROM ev) AS segments FROM ev")
def store_snapshot(store):
    """What the store says of itself after compaction."""
    s = next(t for t in store.snapshot() if t["table"] == "events")
    return store.spark.createDataFrame([(s["rows"], store.watermark(), s["versions"] // s["segments"], s["segments"])], "events long, last_processed long, versions long, segments long")
