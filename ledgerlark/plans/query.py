"""Running a query: the index finds ledgers, the events of those are filtered, ordered and limited."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import base64_text, contract_name_of, type_name
from ..model import KEY, LEDGERS_A_SEGMENT
from ..operators.index import matching_ledgers
from ..operators.predicates import Filter, first_n, in_ledgers


@dataclass(frozen=True)
class Options:
    limit: int = 0
    count_only: bool = False
    include_raw: bool = False


def decoded(events: DataFrame, include_raw: bool = False) -> DataFrame:
    """What a query returns of an event: names and base64 text. To be applied after filter and limit."""
    return events.select(
        *KEY,
        contract_name_of("contract_id").alias("contract_id"),
        type_name(F.col("event_type")).alias("type"),
        F.col("event_stage"),
        F.transform("topics", base64_text).alias("topics"),
        base64_text(F.coalesce("data", F.lit(b""))).alias("data"),
        F.lower(F.hex("tx_hash")).alias("transaction_hash"),
        F.lit(None).cast("boolean").alias("successful"),
        *([base64_text(F.col("raw_xdr")).alias("raw_xdr")] if include_raw else []),
    )


class EventQuery:
    """Queries over an event table and its index; without an index, the events are scanned."""

    def __init__(self, events: DataFrame, index: DataFrame | None = None) -> None:
        self.events, self.index = events, index

    def ledgers(self, query: Filter, lo: int, hi: int) -> DataFrame:
        """Ledgers that may have matches, by the index."""
        if self.index is None:
            raise ValueError("there is no index")
        return matching_ledgers(self.index, query, lo, hi)

    def candidates(self, query: Filter, lo: int, hi: int) -> DataFrame:
        """The events that are looked at: all of the range, or those of the ledgers that the index finds."""
        rows = self.events.where(in_ledgers(lo, hi))
        if self.index is None:
            return rows
        # no broadcast hint: how many ledgers match isn't bounded, and Spark sees the size at run time
        return rows.join(self.ledgers(query, lo, hi), ["segment_id", "ledger_sequence"], "left_semi")

    def run(self, query: Filter, lo: int, hi: int, options: Options = Options()) -> DataFrame:
        """The matching events in key order; with ``count_only``, one row with the number of matching ledgers."""
        if query.is_empty:
            raise ValueError("the filter is empty; scan the range instead")
        if options.count_only:
            return self.ledgers(query, lo, hi).agg(F.count(F.lit(1)).alias("matching_ledgers"))
        return first_n(self.candidates(query, lo, hi).where(query.column()), options.limit)

    def results(self, query: Filter, lo: int, hi: int, options: Options = Options()) -> DataFrame:
        """What a query returns: its events, or those of the range for an empty filter, decoded, with raw bytes if asked for."""
        rows = self.scan(lo, hi, options.limit) if query.is_empty else self.run(query, lo, hi, options)
        return decoded(rows, options.include_raw)

    def scan(self, lo: int, hi: int, limit: int = 0) -> DataFrame:
        """All events of the range, in key order."""
        return first_n(self.events.where(in_ledgers(lo, hi)), limit)

    def widening(self, query: Filter, lo: int, hi: int, limit: int) -> DataFrame:
        """As ``run`` with a limit, but looks at one segment first, then at twice as many each time, until there are enough."""
        first, last, n = lo // LEDGERS_A_SEGMENT, hi // LEDGERS_A_SEGMENT, 1
        while True:
            end = min(hi, (first + n) * LEDGERS_A_SEGMENT - 1)
            found = self.run(query, lo, end, Options(limit))
            if first + n > last or found.count() >= limit:
                return found
            n *= 2

    def metrics(self, query: Filter, lo: int, hi: int, limit: int = 0) -> DataFrame:
        """One row: ledgers in range and matching, events scanned and returned, bytes.

        With a limit, events count as scanned up to and including the last that is returned.
        """
        rows = self.candidates(query, lo, hi).select("segment_id", *KEY, query.column().alias("hit"), F.octet_length("data").alias("bytes"))
        hits = rows.where("hit")
        key = F.struct(*KEY)
        if limit > 0:
            # the key of the last event returned, if there are so many
            last = first_n(hits.select(*KEY), limit).agg(F.when(F.count(F.lit(1)) >= limit, F.max(key)).alias("last"))
            looked = rows.where(last.scalar().isNull() | (key <= last.scalar()))
        else:
            looked = rows
        known = self.ledgers(query, lo, hi) if self.index is not None else rows.select("ledger_sequence").distinct()
        matching, span = known.agg(F.count(F.lit(1))).scalar(), F.lit(hi - lo + 1).cast("long")
        counted = looked.agg(F.count(F.lit(1)).alias("events_scanned"), F.count_if("hit").alias("events_returned"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("data_bytes"))
        return counted.select(span.alias("ledger_range"), matching.alias("matching_ledgers"), "events_scanned", "events_returned", "data_bytes", (matching * F.lit(100.0) / span).alias("selectivity_percent"))


def to_json(rows: Iterator) -> str:
    """Rows as indented JSON; null fields that are optional are left out, and no rows are ``[]``."""
    optional = {"contract_id", "event_stage", "raw_xdr"}
    out = []
    for r in rows:
        d = r.asDict(recursive=True)
        d["transaction_hash"] = d.get("transaction_hash") or ""
        d["successful"] = bool(d.get("successful"))
        out.append({k: v for k, v in d.items() if not (k in optional and not v)})
    return json.dumps(out, indent=2)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows each result has, and how many only one of them has."""
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    out = a.sparkSession.range(1).select(count(a).alias("left_rows"), count(b).alias("right_rows"), count(a.exceptAll(b)).alias("only_left"), count(b.exceptAll(a)).alias("only_right"))
    return out.withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))
