"""From ledgers to event rows, with a decoder that can be chosen.

A decoder turns a ledger's payload into (tx, op, event index, stage, event XDR, tx hash) tuples.
``ledger_xdr.close_meta`` reads the chain's own ledgers. ``framed`` reads a plain container: a count and, for each event, two 16-bit indexes
and the event's, a stage byte, a 32-byte transaction hash, and the length and bytes of the event.
A decoder for another container of ledgers has the same form.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.codec import decode_event_xdr
from ..model import EVENTS, LEDGERS_A_SEGMENT, TOPIC_POSITIONS
from ..sources.ledger_xdr import close_meta

Found = tuple[int, int, int, str, bytes, bytes | None]
STAGES = ("transaction", "operation")
HEAD = struct.Struct(">HHHB32sI")


def framed(payload: bytes) -> Iterator[Found]:
    (n,), at = struct.unpack_from(">I", payload), 4
    for _ in range(n):
        tx, op, event, stage, tx_hash, length = HEAD.unpack_from(payload, at)
        at += HEAD.size
        yield tx, op, event, STAGES[stage], payload[at : at + length], tx_hash
        at += length


def frame(events: Iterable[Found]) -> bytes:
    """The payload that ``framed`` reads."""
    out = [HEAD.pack(tx, op, i, STAGES.index(stage), h or bytes(32), len(raw)) + raw for tx, op, i, stage, raw, h in events]
    return struct.pack(">I", len(out)) + b"".join(out)


def extract(ledgers: DataFrame, decoder: Callable[[bytes], Iterable[Found]] = close_meta, strict: bool = False, keep_raw: bool = True) -> DataFrame:
    """Event rows of ``ledgers`` (ledger_sequence, raw).

    Events that cannot be read are left out, or end the job if ``strict``. Two events with one key,
    one of the transaction and one of its first operation, are told apart by ``write_seq`` and stage;
    the store keeps the later.
    """
    schema = to_arrow_schema(EVENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ledger, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for seq, (tx, op, i, stage, raw, tx_hash) in enumerate(decoder(payload)):
                    e = decode_event_xdr(raw)
                    if e is None:
                        if strict:
                            raise ValueError(f"an event of ledger {ledger} cannot be read")
                        continue
                    topics = [*e.topics[:TOPIC_POSITIONS], *[None] * (TOPIC_POSITIONS - len(e.topics))]
                    rows.append((ledger // LEDGERS_A_SEGMENT, ledger, tx, op, i, stage, e.contract_id, e.topics, *topics, e.event_type, e.data, raw if keep_raw else None, tx_hash, ledger * 1_000_000 + seq))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return ledgers.select("ledger_sequence", "raw").mapInArrow(run, EVENTS)
