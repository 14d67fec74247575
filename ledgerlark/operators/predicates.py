"""The query algebra's predicates: an inclusive ledger range and equalities that must all hold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import contract_bytes, topic_bytes
from ..model import KEY, KEY_BYTES, LEDGERS_A_SEGMENT, TOPIC_POSITIONS


@dataclass(frozen=True)
class Filter:
    """Equality with a contract and with topics by position; None is a wildcard."""

    contract: bytes | None = None
    topics: tuple[bytes | None, ...] = (None,) * TOPIC_POSITIONS

    def __post_init__(self) -> None:
        if len(self.topics) > TOPIC_POSITIONS:
            raise ValueError(f"topics have positions 0 to {TOPIC_POSITIONS - 1}")
        object.__setattr__(self, "topics", tuple(self.topics) + (None,) * (TOPIC_POSITIONS - len(self.topics)))

    @classmethod
    def parse(cls, contract: str | None = None, topics: Sequence[str | None] = ()) -> Filter:
        """From a contract name and base64 topics; empty text is a wildcard, ValueError for anything malformed."""
        return cls(contract_bytes(contract) if contract else None, tuple(topic_bytes(t) if t else None for t in topics))

    @property
    def has_contract(self) -> bool:
        return bool(self.contract)

    @property
    def has_topics(self) -> bool:
        return any(self.topics)

    @property
    def is_empty(self) -> bool:
        return not self.has_contract and not self.has_topics

    def terms(self) -> dict[str, bytes]:
        """Index name to value, of the terms that are given."""
        out = {"contract": self.contract} if self.contract else {}
        return out | {f"topic{i}": t for i, t in enumerate(self.topics) if t}

    def column(self) -> Column:
        """All terms, on the columns that are stored for pushdown. True if there is none."""
        parts = [contract_is(self.contract)] if self.contract else []
        parts += [topic_is(i, t) for i, t in enumerate(self.topics) if t]
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def contract_is(contract: bytes) -> Column:
    """Equality for 32 bytes; fewer bytes match as a prefix, more are cut off. Events without a contract never match."""
    if len(contract) >= KEY_BYTES:
        return F.col("contract_id") == F.lit(contract[:KEY_BYTES])
    return F.substring(F.col("contract_id"), 1, len(contract)) == F.lit(contract)


def topic_is(position: int, value: bytes) -> Column:
    """Equality with the topic at a position, length included; a position that an event lacks doesn't match."""
    if not 0 <= position < TOPIC_POSITIONS:
        raise ValueError(f"topics have positions 0 to {TOPIC_POSITIONS - 1}, not {position}")
    return F.col(f"topic{position}") == F.lit(value)


def in_ledgers(lo: int, hi: int) -> Column:
    """Both ends count. The segment range prunes partitions, which the ledger range alone would not."""
    return F.col("segment_id").between(lo // LEDGERS_A_SEGMENT, hi // LEDGERS_A_SEGMENT) & F.col("ledger_sequence").between(lo, hi)


def without_topic0(excluded: Sequence[bytes]) -> Column:
    """Keeps events without topics and those whose first topic is not excluded."""
    if not excluded:
        return F.lit(True)
    return ~F.coalesce(F.col("topic0").isin([F.lit(e) for e in excluded]), F.lit(False))


def first_n(events: DataFrame, limit: int = 0) -> DataFrame:
    """In key order, the first ``limit``; 0 or less means all."""
    ordered = events.orderBy(*KEY)
    return ordered.limit(limit) if limit > 0 else ordered


# The access paths by name.


def ledger_range(events: DataFrame, lo: int, hi: int, limit: int = 0) -> DataFrame:
    return first_n(events.where(in_ledgers(lo, hi)), limit)


def single_ledger(events: DataFrame, ledger: int) -> DataFrame:
    return ledger_range(events, ledger, ledger)


def by_contract(events: DataFrame, contract: bytes, limit: int = 0) -> DataFrame:
    return first_n(events.where(contract_is(contract)), limit)


def by_contract_in_range(events: DataFrame, contract: bytes, lo: int, hi: int) -> DataFrame:
    return first_n(events.where(in_ledgers(lo, hi) & contract_is(contract)))


def by_topic(events: DataFrame, position: int, value: bytes, limit: int = 0) -> DataFrame:
    return first_n(events.where(topic_is(position, value)), limit)


def by_topic_in_range(events: DataFrame, position: int, value: bytes, lo: int, hi: int) -> DataFrame:
    return first_n(events.where(in_ledgers(lo, hi) & topic_is(position, value)))
