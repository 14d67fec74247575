
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import segment
from ..model import EVENTS, TOPICS


def xdr_text(kind: str, text: Column) -> Column:
    """A string as an XDR value of the kind with that 8-digit hex code: length, bytes, zeros to a multiple of four."""
    raw = F.encode(text, "UTF-8")
    pad = F.repeat(F.lit("00"), F.pmod(-F.octet_length(raw), F.lit(4)))
    return F.unhex(F.concat(F.lit(kind), F.lpad(F.hex(F.octet_length(raw)), 8, "0"), F.hex(raw), pad))


def contract_events(spark: SparkSession, folder: str) -> DataFrame:
    e = spark.read.parquet(f"{folder}/events.parquet")
    # whole-number division: a double would be wrong above 2 ** 53
    ledger = F.expr("2 + event_id div 10")
    out = e.select(
        segment(ledger).alias("segment_id"),
        ledger.alias("ledger_sequence"),
        (1 + F.col("event_id") % 10).cast("int").alias("transaction_index"),
        F.lit(0).alias("operation_index"),
        F.lit(0).alias("event_index"),
        F.lit("operation").alias("event_stage"),
        F.unhex(F.sha2(F.col("user_id").cast("string"), 256)).alias("contract_id"),
        F.array(xdr_text("0000000F", F.col("event_type")), xdr_text("0000000E", F.col("props"))).alias("topics"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("byte").alias("event_type"),
        F.encode(F.col("value").cast("string"), "UTF-8").alias("data"),
        F.lit(None).cast("binary").alias("raw_xdr"),
        F.lit(None).cast("binary").alias("tx_hash"),
        F.col("event_id").alias("write_seq"),
    )
    return out.withColumns({t: F.get("topics", F.lit(i)) for i, t in enumerate(TOPICS)}).select(*EVENTS.names)
