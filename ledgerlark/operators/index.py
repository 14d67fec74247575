"""The inverted index: which ledgers have an event with a contract or with a topic at a position.

Values are cut or filled to 32 bytes, so the index finds a superset of the ledgers.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import padded
from ..functions.columns import key32
from ..model import COUNT_TYPES, INDEX_PREFIXES, KEY_BYTES, LEDGER_INDEX, VALUE_COUNTS
from .predicates import Filter, in_ledgers

VALUES = {"contract": "contract_id", "topic0": "topic0", "topic1": "topic1", "topic2": "topic2", "topic3": "topic3"}


def _values(events: DataFrame, codes: dict[str, int], names: Iterable[str] | None, *carry: str) -> DataFrame:
    """(code, value, carry) of every indexed value of every event; an empty contract is none."""
    wanted = [n for n in VALUES if names is None or n in set(names)]
    pairs = F.array(*[F.struct(F.lit(codes[n]).cast("byte").alias("code"), F.col(VALUES[n]).alias("value")) for n in wanted])
    out = events.select(*carry, F.explode(pairs).alias("p")).select(F.col("p.code").alias("code"), F.col("p.value").alias("value"), *carry)
    keep = F.col("value").isNotNull() & ((F.col("code") != codes["contract"]) | (F.octet_length("value") > 0))
    return out.where(keep)


def index_rows(events: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """The rows of the index, of all five names or of those given, as often as events have them."""
    rows = _values(events, INDEX_PREFIXES, names, "segment_id", "ledger_sequence")
    return rows.select(F.col("code").alias("prefix"), key32(F.col("value")).alias("key32"), "segment_id", "ledger_sequence").select(*LEDGER_INDEX.names)


def build_index(events: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """The distinct rows of the index, of all five names or of those given."""
    return index_rows(events, names).distinct()


def build_counts(events: DataFrame, names: Iterable[str] | None = None, *by: str) -> DataFrame:
    """How many events have each contract and each topic value by position, of all or ``by`` columns; values are whole here."""
    rows = _values(events, COUNT_TYPES, names, *by).select(F.col("code").alias("type"), "value", *by)
    return rows.groupBy("type", "value", *by).agg(F.count(F.lit(1)).alias("count")).select(*VALUE_COUNTS.names, *by)


def term(name: str, value: bytes) -> Column:
    """The rows of the index that a term of a filter asks for: a contract of fewer than 32 bytes is a prefix, as in the filter."""
    code = F.col("prefix") == INDEX_PREFIXES[name]
    if name == "contract" and len(value) < KEY_BYTES:
        return code & (F.substring("key32", 1, len(value)) == F.lit(value))
    return code & (F.col("key32") == F.lit(padded(value)))


def ledgers_with(index: DataFrame, name: str, value: bytes, lo: int, hi: int) -> DataFrame:
    """Ledgers of a range that the index has for one value."""
    return index.where(in_ledgers(lo, hi) & term(name, value)).select("segment_id", "ledger_sequence").distinct()


def matching_ledgers(index: DataFrame, query: Filter, lo: int, hi: int) -> DataFrame:
    """(segment_id, ledger_sequence) that the index has for every term; none for an empty filter.

    One aggregation over the rows of all terms rather than a join for each.
    """
    terms = query.terms()
    if not terms:
        return index.where(F.lit(False)).select("segment_id", "ledger_sequence")
    rows = index.where(in_ledgers(lo, hi) & reduce(lambda a, b: a | b, [term(n, v) for n, v in terms.items()]))
    # each term has rows of its own kind, of which a prefix may have several in a ledger
    return rows.groupBy("segment_id", "ledger_sequence").agg(F.size(F.collect_set("prefix")).alias("n")).where(F.col("n") == len(terms)).select("segment_id", "ledger_sequence")


def merge(*parts: DataFrame) -> DataFrame:
    """The union of index tables."""
    return reduce(DataFrame.unionByName, parts).distinct()


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Count tables added up, value by value."""
    return reduce(DataFrame.unionByName, parts).groupBy("type", "value").agg(F.sum("count").alias("count"))
