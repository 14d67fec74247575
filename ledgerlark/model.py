"""The event table's schema and the fixed numbers of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Layout of ledgers, chunks, segments and indexes.
FIRST_LEDGER = 2
LEDGERS_A_CHUNK = 10_000
CHUNKS_A_FOLDER = 1_000
LEDGERS_A_SEGMENT = 1_000_000
BUSY_LEDGER_TX = 10_000
KEY_BYTES = 32
TOPIC_POSITIONS = 4
INDEX_PREFIXES = {"contract": 1, "topic0": 2, "topic1": 3, "topic2": 4, "topic3": 5}
COUNT_TYPES = {"contract": 0, "topic0": 1, "topic1": 2, "topic2": 3, "topic3": 4}
EVENT_TYPES = {0: "contract", 1: "system", 2: "diagnostic"}
DEFAULT_RANGE = 100_000
DEFAULT_LIMIT = 100

KEY = ["ledger_sequence", "transaction_index", "operation_index", "event_index"]
TOPICS = [f"topic{i}" for i in range(TOPIC_POSITIONS)]

EVENTS = T.StructType([
    T.StructField("segment_id", T.LongType(), False),
    T.StructField("ledger_sequence", T.LongType(), False),
    T.StructField("transaction_index", T.IntegerType(), False),
    T.StructField("operation_index", T.IntegerType(), False),
    T.StructField("event_index", T.IntegerType(), False),
    T.StructField("event_stage", T.StringType()),
    T.StructField("contract_id", T.BinaryType()),
    T.StructField("topics", T.ArrayType(T.BinaryType(), False), False),
    *(T.StructField(t, T.BinaryType()) for t in TOPICS),
    T.StructField("event_type", T.ByteType(), False),
    T.StructField("data", T.BinaryType()),
    T.StructField("raw_xdr", T.BinaryType()),
    T.StructField("tx_hash", T.BinaryType()),
    T.StructField("write_seq", T.LongType(), False),
])

LEDGER_INDEX = T.StructType([
    T.StructField("prefix", T.ByteType(), False),
    T.StructField("key32", T.BinaryType(), False),
    T.StructField("segment_id", T.LongType(), False),
    T.StructField("ledger_sequence", T.LongType(), False),
])

VALUE_COUNTS = T.StructType([
    T.StructField("type", T.ByteType(), False),
    T.StructField("value", T.BinaryType(), False),
    T.StructField("count", T.LongType(), False),
])
