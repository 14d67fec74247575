"""Commands: ``ingest``, ``query`` and ``stats``; results go to standard output, reports to standard error.

Exit codes: 0, 1 for an error while running, 2 for wrong usage.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .functions.codec import topic_bytes
from .functions.formats import elapsed, rate, share, size
from .model import LEDGERS_A_CHUNK, LEDGERS_A_SEGMENT
from .operators import stats
from .operators.extract import framed
from .operators.ingest import ingest, summary
from .operators.predicates import Filter
from .operators.store import EventStore
from .plans.query import Options, compare, to_json
from .sources import settings
from .sources.ledger_xdr import close_meta


DECODERS = {"close_meta": close_meta, "framed": framed}


class Usage(Exception):
    pass


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise Usage(message)


def parser() -> Parser:
    top = Parser(prog="ledgerlark", description=__doc__)
    top.add_argument("--config", help="settings file; config.toml if that is there")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest", help="read ledgers into the store")
    one.add_argument("--start", type=int, default=0)
    one.add_argument("--end", type=int, default=0)
    one = commands.add_parser("query", help="events of a range of ledgers, as JSON")
    one.add_argument("start", type=int)
    one.add_argument("end", type=int, nargs="?")
    one.add_argument("--contract", default="")
    for i in range(4):
        one.add_argument(f"--topic{i}", default="")
    one.add_argument("--limit", type=int, default=0)
    one.add_argument("--include-raw", action="store_true", help="with the events' bytes as they were in the ledger, where the store keeps them")
    one.add_argument("--compare-db", default="", help="another store to run the query on, and compare")
    one.add_argument("--compare-format", default="", choices=["", *settings.FORMATS], help="how the other store keeps events; both are tables here, so it is only checked")
    one = commands.add_parser("stats", help="statistics of the store")
    one.add_argument("--top", type=int, default=10)
    return top


def excluded(texts: Sequence[str]) -> list[bytes]:
    """First topics to keep out; text that isn't base64 is reported and skipped."""
    out = []
    for t in texts:
        try:
            out.append(topic_bytes(t))
        except ValueError:
            print(f"warning: not base64, skipped: {t}", file=sys.stderr)
    return out


def open_store(spark: SparkSession, s: settings.Settings, path: str = "") -> EventStore:
    names = [n for n in ("contract",) if s.indexes.get("contract", True)]
    names += [f"topic{i}" for i in range(4)] if s.indexes.get("topics", True) else []
    return EventStore(spark, path or s.store_path, s.parquet_compression, names)


def run_ingest(spark: SparkSession, s: settings.Settings, a: argparse.Namespace) -> int:
    store = open_store(spark, s)
    report = ingest(spark, s.ledger_dir, store, a.start, a.end, excluded(s.exclude_topic0), DECODERS[s.ledger_format], progress_path=s.progress_file, step=s.batch_size * LEDGERS_A_CHUNK, compact=s.final_compaction, keep_raw=s.event_format == "xdr")
    text = summary(report, store)
    print(text, file=sys.stderr)
    with open(f"summary_{time.strftime('%Y%m%d_%H%M%S')}.txt", "w") as f:
        f.write(text)
    return 0


def run_query(spark: SparkSession, s: settings.Settings, a: argparse.Namespace) -> int:
    lo = a.start
    hi = lo + s.max_ledger_range if a.end is None else a.end
    if hi < lo:
        raise Usage("the range ends before it starts")
    limit = a.limit if a.limit > 0 else s.default_limit
    try:
        wanted = Filter.parse(a.contract, [a.topic0, a.topic1, a.topic2, a.topic3])
    except ValueError as e:
        raise Usage(str(e)) from e

    def found(store: EventStore):
        return store.query().results(wanted, lo, hi, Options(limit, include_raw=a.include_raw))

    store, began = open_store(spark, s), time.time()
    rows = found(store).collect()  # at most the limit
    first = time.time() - began
    print(to_json(rows))
    print(f"{len(rows)} events of ledgers {lo} to {hi} in {elapsed(first)} ({rate(len(rows), first):.1f}/s)", file=sys.stderr)
    if not wanted.is_empty and store.exists("ledger_index"):
        m = store.query().metrics(wanted, lo, hi, limit).first()
        print(f"matching ledgers: {m.matching_ledgers} ({m.selectivity_percent:.4f} %), events scanned: {m.events_scanned}, bytes: {size(m.data_bytes)}", file=sys.stderr)
    if a.compare_db:
        other, began = open_store(spark, s, a.compare_db), time.time()
        n = len(found(other).collect())
        second = time.time() - began
        same = compare(found(store), found(other)).first()
        here, there = (sum(t["bytes"] for t in x.snapshot()) for x in (store, other))
        print(f"other store: {n} events in {elapsed(second)}; {rate(first, second):.2f} times as fast; {elapsed(abs(first - second))} apart; size ratio {rate(there, here):.2f}", file=sys.stderr)
        if not same.same:
            print(f"warning: results differ: {same.only_left} events only here, {same.only_right} only there", file=sys.stderr)
    return 0


def run_stats(spark: SparkSession, s: settings.Settings, a: argparse.Namespace) -> int:
    if a.top < 0:
        raise Usage("--top must not be negative")
    store = open_store(spark, s)
    out = store.stats()
    print("\n".join(f"{k}: {v}" for k, v in out.items()))
    tx = stats.ledger_tx_stats(store.events()).first()
    print(f"ledgers with events: {tx.ledgers}, with 10,000 transactions or more: {tx.busy_ledgers} ({share(tx.busy_ledgers, tx.ledgers):.2f} %)")
    for t in store.snapshot():
        print(f"{t['table']}: {t['files']} files, {size(t['bytes'])}")
    print(f"bytes an event: {rate(store.size('events').bytes, out['total_events']):.1f}")
    print(f"current segment: {(out['max_ledger'] or 0) // LEDGERS_A_SEGMENT}")
    for r in stats.index_segments(store.index()).orderBy("index_type").collect():
        print(f"index {r.index_type}: {r.stored_segments} segments, {r.ledger_entries} entries")
    counts = store.counts()
    for r in stats.unique_counts(counts).orderBy("index_type").collect():
        print(f"unique {r.index_type}: {r.unique_values} values, {r.total_count} events")
    top = {}
    for r in stats.top_values(counts, a.top).orderBy("index_type", "rank").collect() if a.top else []:
        top.setdefault(r.index_type, []).append(r)
    for r in stats.distribution(counts).orderBy("index_type").collect():
        print(f"distribution {r.index_type}: min {r.min_count}, max {r.max_count}, mean {r.mean_count:.2f}, p50 {r.p50}, p75 {r.p75}, p90 {r.p90}, p99 {r.p99}")
        if r.over_32_bytes:
            print(f"  {r.over_32_bytes} values over 32 bytes ({share(r.over_32_bytes, r.unique_values):.1f} %) share index keys with others that begin alike")
        for t in top.get(r.index_type, []):
            print(f"  {t.rank}. {t.value}: {t['count']}")
    return 0


COMMANDS = {"ingest": run_ingest, "query": run_query, "stats": run_stats}


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(args)
        path = settings.find(a.config)
        s = (settings.load(path) if path else settings.Settings()).validate()
    except (Usage, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("ledgerlark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return COMMANDS[a.command](spark, s, a)
    except Usage as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Exception as e:  # a command's last resort: the reason, and exit code 1
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
