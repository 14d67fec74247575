"""Column expressions over the event table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EVENT_TYPES, KEY_BYTES, LEDGERS_A_CHUNK, LEDGERS_A_SEGMENT
from .codec import Event, contract_name, decode_blob, encode_blob


def _whole(n: Column, by: int) -> Column:
    """``floor(n / by)`` in whole numbers, which a double has only up to 2 ** 53."""
    n = n.cast("long")
    return F.call_function("div", n - F.pmod(n, F.lit(by)), F.lit(by).cast("long"))


def segment(ledger: Column) -> Column:
    return _whole(ledger, LEDGERS_A_SEGMENT)


def chunk(ledger: Column) -> Column:
    return _whole(ledger - 2, LEDGERS_A_CHUNK)


def key32(value: Column) -> Column:
    """The first 32 bytes, filled with zeros."""
    return F.unhex(F.rpad(F.substring(F.hex(value), 1, 2 * KEY_BYTES), 2 * KEY_BYTES, "0"))


def base64_text(value: Column) -> Column:
    """Standard base64 on one line, whatever the session's line length."""
    return F.translate(F.base64(value), "\r\n", "")


def type_name(code: Column) -> Column:
    out = F.lit("")
    for k, name in EVENT_TYPES.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def contract_name_of(column: str) -> Column:
    """Contract names; for rows that are already filtered and limited."""

    def names(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in ids:
            yield s.map(lambda b: contract_name(bytes(b)) if b is not None else None)

    names.__annotations__ = {"ids": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(names, "string")(column)


def key_bytes(ledger: Column, tx: Column, op: Column, event: Column) -> Column:
    """The ten bytes of an event key."""
    part = lambda c, n: F.lpad(F.hex(c.cast("long")), n, "0")
    return F.unhex(F.concat(part(ledger, 8), *(part(F.pmod(c, F.lit(65536)), 4) for c in (tx, op, event))))


def percentile_of_sorted(values: Column, percent: float) -> Column:
    """The element of a sorted array at ``floor((n - 1) * percent / 100)``."""
    return F.get(values, F.floor((F.size(values) - 1) * F.lit(percent) / 100).cast("int"))


def blob(contract: str, topics: str, event_type: str, data: str) -> Column:
    """Event blobs (see ``codec``), for exchange with programs that keep events so."""

    def encode(rows: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for c, t, k, d in rows:
            yield pd.Series([encode_blob(Event(bytes(a) if a is not None else None, [bytes(x) for x in b], int(e), bytes(f or b""))) for a, b, e, f in zip(c, t, k, d, strict=True)])

    encode.__annotations__ = {"rows": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(encode, "binary")(contract, topics, event_type, data)


def event_of_blob(raw: str) -> Column:
    """The parts of event blobs; null for one that cannot be read."""

    def decode(blobs: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in blobs:
            found = [decode_blob(bytes(b)) if b is not None else None for b in s]
            yield pd.DataFrame({
                "contract_id": [e and e.contract_id for e in found], "topics": [e and e.topics for e in found],
                "event_type": pd.array([e and e.event_type for e in found], "Int64"), "data": [e and e.data for e in found],
            })

    decode.__annotations__ = {"blobs": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(decode, "contract_id binary, topics array<binary>, event_type int, data binary")(raw)
