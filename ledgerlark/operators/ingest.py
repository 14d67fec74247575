"""Ingesting ledgers into a store, with progress and a summary."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import duration, elapsed, rate, share, size
from ..model import FIRST_LEDGER
from ..sources.ledger_chunks import ledger_range, read_ledgers
from ..sources.ledger_xdr import close_meta
from .extract import extract
from .store import EventStore


@dataclass
class Progress:
    """A JSON file, written whole each time."""

    path: str
    first: int
    last: int
    started: float = field(default_factory=time.time)

    def _write(self, done: int, status: str, **more) -> dict:
        whole, spent = self.last - self.first + 1, time.time() - self.started
        speed = rate(done, spent)
        out = {
            "start_ledger": self.first, "end_ledger": self.last, "processed": done, "percent": share(done, whole), "status": status,
            "ledgers_per_second": speed, "elapsed": duration(spent), "eta_seconds": (whole - done) / speed if speed else None, **more,
        }
        if self.path:
            with open(f"{self.path}.part", "w") as f:
                json.dump(out, f, indent=2)
            os.replace(f"{self.path}.part", self.path)
        return out

    def update(self, done: int, **more) -> dict:
        return self._write(done, "running", **more)

    def completed(self, **more) -> dict:
        return self._write(self.last - self.first + 1, "completed", **more)

    def failed(self, done: int, reason: str) -> dict:
        return self._write(done, f"failed: {reason}")


@dataclass
class IngestReport:
    ledgers: int = 0
    transactions: int = 0
    transaction_events: int = 0
    operation_events: int = 0
    extracted: int = 0
    excluded: int = 0
    stored: int = 0
    raw_bytes: int = 0
    seconds: float = 0.0
    #: Reading, decompressing and decoding are one pass on the executors; writing has events, index and counts.
    read_seconds: float = 0.0
    write_seconds: float = 0.0
    compact_seconds: float = 0.0

    def lines(self) -> list[str]:
        return [
            f"ledgers: {self.ledgers} ({rate(self.ledgers, self.seconds):.1f}/s)",
            f"transactions with events: {self.transactions}",
            f"events extracted: {self.extracted} ({rate(self.extracted, self.seconds):.1f}/s), {self.transaction_events} of transactions, {self.operation_events} of operations",
            f"events stored: {self.stored}, kept out: {self.excluded}",
            f"ledger bytes: {size(self.raw_bytes)} ({size(rate(self.raw_bytes, self.seconds))}/s)",
            f"time: {elapsed(self.seconds)}; reading and decoding {elapsed(self.read_seconds)}, writing {elapsed(self.write_seconds)}, compaction {elapsed(self.compact_seconds)}",
        ]


def resolve_range(folder: str, start: int = 0, end: int = 0) -> tuple[int, int]:
    """0 means the first ledger there is, and the last that the folder can hold."""
    lo, hi = start or FIRST_LEDGER, end or ledger_range(folder)[1]
    if lo < FIRST_LEDGER:
        raise ValueError(f"ledgers begin at {FIRST_LEDGER}")
    if hi < lo:
        raise ValueError("the range ends before it starts")
    return lo, hi


def ingest(spark: SparkSession, folder: str, store: EventStore, start: int = 0, end: int = 0, exclude_topic0: Sequence[bytes] = (), decoder: Callable[[bytes], Iterable] = close_meta, progress_path: str = "", step: int = 1_000_000, compact: bool = False, keep_raw: bool = True) -> IngestReport:
    """Ledgers start..end into ``store``, ``step`` of them a job; the watermark follows each finished job."""
    lo, hi = resolve_range(folder, start, end)
    progress, report, began = Progress(progress_path, lo, hi), IngestReport(), time.time()
    at = lo
    try:
        while at <= hi:
            upto = min(hi, (at // step + 1) * step - 1)
            ledgers = read_ledgers(spark, folder, at, upto)
            _one(ledgers, store, report, exclude_topic0, decoder, keep_raw, upto)
            progress.update(upto - lo + 1, events=report.extracted)
            at = upto + 1
        if compact:
            compacted = time.time()
            store.compact()
            report.compact_seconds = time.time() - compacted
    except Exception as e:
        progress.failed(at - lo, str(e).splitlines()[0] if str(e) else type(e).__name__)
        raise
    report.seconds = time.time() - began
    progress.completed(**asdict(report))
    return report


def _one(ledgers: DataFrame, store: EventStore, report: IngestReport, exclude_topic0: Sequence[bytes], decoder: Callable, keep_raw: bool, upto: int) -> None:
    """Reads, decodes and stores ledgers in one pass; they are counted on their way."""
    seen, began = Observation(f"ledgers to {upto}"), time.time()
    counted = ledgers.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("bytes"))
    done = store.upsert(extract(counted, decoder, keep_raw=keep_raw), exclude_topic0, upto)
    for name in ("transactions", "transaction_events", "operation_events", "extracted", "excluded", "stored"):
        setattr(report, name, getattr(report, name) + done[name])
    report.ledgers += seen.get["n"]
    report.raw_bytes += seen.get["bytes"]
    report.read_seconds += done["read_seconds"]
    report.write_seconds += time.time() - began - done["read_seconds"]


def summary(report: IngestReport, store: EventStore) -> str:
    """The text of an ingest summary."""
    s = store.stats()
    lines = ["ingest", *report.lines(), "", "store"]
    lines += [f"{k}: {v}" for k, v in s.items()]
    for t in store.snapshot():
        lines.append(f"{t['table']}: {t['files']} files, {size(t['bytes'])}" + (f", {t['rows']} rows" if t["rows"] is not None else ""))
    return "\n".join(lines) + "\n"
