"""The event store: Parquet tables below one folder, and a manifest that says which files count.

Tables ``events``, ``ledger_index`` and ``value_counts`` have a folder for each version and, below it, one
for each segment of a million ledgers. Nothing is ever overwritten: a write makes a new version,
and then a new manifest, a small file whose number is one higher, names the versions of each
segment. Readers take the manifest with the highest number, so they see the tables as they were
before or after a write, and a write that fails changes nothing.

A segment may have several versions, each an upsert: of rows with one key the one written last
counts, and is chosen when the segment is read. Compaction makes them one, and its index and counts
exact; until then the index may name ledgers of rows that were replaced, which a query's own
filter leaves out, and counts of such segments are made from the events.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import share
from ..model import EVENTS, KEY, LEDGER_INDEX, VALUE_COUNTS
from ..plans.query import EventQuery
from . import stats
from .index import VALUES, build_counts, index_rows, merge_counts
from .predicates import without_topic0

INDEX_ORDER = ("prefix", "key32", "ledger_sequence")
#: The stored tables with their schemas; counts are kept by segment.
SCHEMAS = {"events": EVENTS, "ledger_index": LEDGER_INDEX, "value_counts": T.StructType([*VALUE_COUNTS, T.StructField("segment_id", T.LongType(), False)])}
ORDERS = {"events": tuple(KEY), "ledger_index": INDEX_ORDER, "value_counts": ("type", "value")}
TABLES = tuple(SCHEMAS)
MANIFESTS = "manifests"
#: As a watermark: the last ledger of the events that are stored.
LAST = -1
#: Bytes of event rows that a task sorts and writes: their number grows with a table, not their size.
TASK_BYTES = 128 << 20


@dataclass
class TableSize:
    files: int = 0
    bytes: int = 0


def _last_written(dealt: DataFrame) -> DataFrame:
    """``last_written`` of events that are dealt out by key, which are not moved again."""
    rest = [c for c in EVENTS.names if c not in ("segment_id", *KEY)]
    kept = dealt.groupBy("segment_id", *KEY).agg(F.max_by(F.struct(*rest), "write_seq").alias("e"))
    return kept.select("segment_id", *KEY, "e.*").select(*EVENTS.names)


def last_written(events: DataFrame) -> DataFrame:
    """Of the rows of one key, the stage left aside, the one with the largest write_seq.

    They are dealt out first: few keys have several, and a task that sorted those it reads would keep them all.
    """
    return _last_written(events.repartition("segment_id", *KEY))


def _once(ranged: DataFrame) -> DataFrame:
    """Distinct rows of an index that is dealt out in ranges, by the order in which they are written: only that is kept in memory."""
    same = Window.partitionBy("segment_id", *INDEX_ORDER).orderBy("ledger_sequence")
    return ranged.withColumn("n", F.row_number().over(same)).where(F.col("n") == 1).drop("n")


def _parts(size: int | None, rows: int = 0, most_rows: int = 1) -> int:
    """Of how many ranges of TASK_BYTES, and of at most so many rows, a table is."""
    return max(1, -(-(size or 0) // TASK_BYTES), rows // most_rows)


def row_bytes() -> Column:
    """About the memory of an event's row: its fixed part, and its values with their padding."""
    binary = [f.name for f in EVENTS if f.dataType == T.BinaryType()]
    topics = F.aggregate("topics", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 16)
    return reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) + 4 for c in binary], 8 * (len(EVENTS) + 4) + topics)


class EventStore:
    def __init__(self, spark: SparkSession, path: str, compression: str = "zstd", indexes: Iterable[str] | None = None) -> None:
        self.spark, self.path, self.compression = spark, path.rstrip("/"), compression
        self.indexes = None if indexes is None else tuple(indexes)

    # files, by whatever file system the path is on

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    # the manifest: for each segment its versions, oldest first, and which tables they have

    def _manifest(self) -> tuple[int, dict]:
        fs, folder = self._fs(), self._path(MANIFESTS)
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()]
        if not numbers:
            return 0, {"segments": {}, "watermark": 0}
        return max(numbers), json.loads(self._text(f"{MANIFESTS}/{max(numbers):012d}.json"))

    def _publish(self, number: int, manifest: dict) -> None:
        """Makes ``manifest`` count; fails if another writer published since ``number`` was read."""
        part, whole = f"{MANIFESTS}/.{uuid.uuid4().hex}", self._path(f"{MANIFESTS}/{number + 1:012d}.json")
        out = self._fs().create(self._path(part), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs().exists(whole) or not self._fs().rename(self._path(part), whole):
            raise RuntimeError("another writer was faster; try again")

    def exists(self, name: str = "events") -> bool:
        return any(name in v["tables"] for versions in self._manifest()[1]["segments"].values() for v in versions)

    def _paths(self, name: str, manifest: dict, single: bool | None = None) -> list[str]:
        """Folders of a table that count; with ``single``, of segments that have one version (or not)."""
        chosen = [(s, v) for s, versions in manifest["segments"].items() if single is None or single == (len(versions) == 1) for v in versions if name in v["tables"]]
        return [f"{self.path}/{name}/version={v['version']}/segment_id={s}" for s, v in chosen]

    def size(self, name: str) -> TableSize:
        out, fs = TableSize(), self._fs()
        for path in self._paths(name, self._manifest()[1]):
            files = fs.listFiles(self._path(path.removeprefix(f"{self.path}/")), True)
            while files.hasNext():
                f = files.next()
                if f.getPath().getName().endswith(".parquet"):
                    out.files, out.bytes = out.files + 1, out.bytes + f.getLen()
        return out

    # reading

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        schema = SCHEMAS[name]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths).select(*schema.names)

    def _events(self, manifest: dict) -> DataFrame:
        once, more = (self._paths("events", manifest, single) for single in (True, False))
        parts = [self._read("events", once)] if once or not more else []
        return reduce(DataFrame.unionByName, [*parts, *([last_written(self._read("events", more))] if more else [])])

    def events(self) -> DataFrame:
        return self._events(self._manifest()[1])

    def index(self) -> DataFrame:
        manifest = self._manifest()[1]
        rows = self._read("ledger_index", self._paths("ledger_index", manifest))
        # dealt out first: versions repeat few rows, and a task that compared those it reads would keep them all
        return rows.repartition(*LEDGER_INDEX.names).distinct() if self._paths("ledger_index", manifest, False) else rows

    def counts(self) -> DataFrame:
        """Counts of values: the stored ones, and for segments of several versions those of their events."""
        manifest = self._manifest()[1]
        more = self._paths("events", manifest, False)
        parts = [self._read("value_counts", self._paths("value_counts", manifest, True)).drop("segment_id")]
        parts += [build_counts(last_written(self._read("events", more)), self.indexes)] if more else []
        return merge_counts(*parts)

    def query(self, indexed: bool = True) -> EventQuery:
        return EventQuery(self.events(), self.index() if indexed and self.exists("ledger_index") else None)

    # writing

    def _ranged(self, df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
        # ranges, so that a file holds neighbours and its statistics exclude it from most lookups
        keys = ("segment_id", *ORDERS[name])
        return df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)

    def _write(self, ranged: DataFrame, name: str, version: str, bloom: Sequence[str] = ()) -> None:
        writer = ranged.sortWithinPartitions("segment_id", *ORDERS[name]).write.option("compression", self.compression)
        for c in bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.partitionBy("segment_id").parquet(f"{self.path}/{name}/version={version}")

    def _counted(self, events: DataFrame) -> DataFrame:
        """The counts of each segment's values."""
        return build_counts(events, self.indexes, "segment_id")

    def _new_version(self, rows: DataFrame, parts: int) -> str:
        """Writes of ``rows`` the events last written, and index and counts that follow the events as written.

        Rows are merged by key in the ranges that are written, ``parts`` of them; so are those of the index.
        """
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self._write(_last_written(self._ranged(rows, "events", parts)), "events", version, ("contract_id",))
        written = self.spark.read.schema(EVENTS).parquet(f"{self.path}/events/version={version}")
        self._write(_once(self._ranged(index_rows(written, self.indexes), "ledger_index", parts)), "ledger_index", version)
        # dealt out by key, so that no task meets more values than those of its events
        dealt = written.select("segment_id", *KEY, *VALUES.values()).repartition(parts, *KEY)
        self._write(self._ranged(self._counted(dealt), "value_counts"), "value_counts", version)
        return version

    def _staged(self, df: DataFrame) -> tuple[DataFrame, str]:
        """``df`` written beside the tables and read again, so that it is made once."""
        name = f"staged/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}"), name

    def upsert(self, events: DataFrame, exclude_topic0: Sequence[bytes] = (), watermark: int | None = None) -> dict[str, float]:
        """Stores events; of those with one key the one written last stays. Returns counts of what came, what was kept out and what was stored.

        ``events`` is computed once. The segments it touches get one more version; others stay as
        they are. A ``watermark`` becomes the store's with the same manifest.
        """
        began = time.time()
        staged, path = self._staged(events.select(*EVENTS.names))
        read = time.time() - began
        stage = lambda name: F.count_if(F.coalesce(F.col("event_stage") == name, F.lit(False)))
        counted = staged.agg(
            F.count(F.lit(1)).alias("extracted"), F.count_if(~without_topic0(exclude_topic0)).alias("excluded"), stage("transaction").alias("transaction_events"), stage("operation").alias("operation_events"),
            F.max("ledger_sequence").alias("last"), F.sum(row_bytes()).alias("bytes"),
        )
        done = counted.first().asDict()
        last, parts = done.pop("last"), _parts(done.pop("bytes"))
        transaction = ("ledger_sequence", "transaction_index")
        done["transactions"] = staged.select(*transaction).repartition(parts, *transaction).distinct().count()
        new = staged.where(without_topic0(exclude_topic0))
        touched = [r[0] for r in new.select("segment_id").distinct().collect()]  # one number a million ledgers
        version = self._new_version(new, parts) if touched else None
        self._fs().delete(self._path(path), True)
        number, manifest = self._manifest()
        for s in touched:
            manifest["segments"].setdefault(str(s), []).append({"version": version, "tables": list(TABLES)})
        if watermark is None:
            watermark = manifest["watermark"]
        elif watermark == LAST:
            watermark = max(manifest["watermark"], last or 0)
        manifest["watermark"] = watermark
        self._publish(number, manifest)
        return done | {"stored": done["extracted"] - done["excluded"], "last_ledger": last, "read_seconds": read}

    def rebuild(self) -> None:
        """Makes index and counts anew from the events: one version of every segment."""
        self.compact()

    # watermark

    def set_watermark(self, ledger: int) -> None:
        number, manifest = self._manifest()
        self._publish(number, manifest | {"watermark": ledger})

    def watermark(self) -> int:
        """The last ledger that was processed; 0 if none was."""
        return self._manifest()[1]["watermark"]

    # maintenance

    def compact(self, target_rows: int = 5_000_000, clean: bool = True) -> list[dict]:
        """Makes every segment one version of fewer, sorted files; a row for each table with bytes before and after.

        A file has about ``target_rows`` events, or fewer where those are more than a task takes. With ``clean``, files that no manifest names any more are deleted (readers that began before
        may miss them).
        """
        number, manifest = self._manifest()
        before = {t: self.size(t) for t in TABLES}
        if manifest["segments"]:
            rows = self._read("events", self._paths("events", manifest))
            n, size = rows.agg(F.count(F.lit(1)), F.sum(row_bytes())).first()
            version = self._new_version(rows, _parts(size, n, target_rows))
            whole = {s: [{"version": version, "tables": list(TABLES)}] for s in manifest["segments"]}
            self._publish(number, manifest | {"segments": whole})
            if clean:
                self._clean(number + 1, version)
        report = []
        for name in TABLES:
            a, b = before[name], self.size(name)
            saved = max(0, a.bytes - b.bytes)
            report.append({"table": name, "files_before": a.files, "files_after": b.files, "bytes_before": a.bytes, "bytes_after": b.bytes, "saved": saved, "saved_percent": share(saved, a.bytes)})
        return report

    def _clean(self, number: int, version: str) -> None:
        """Deletes older manifests and versions than those given."""
        fs = self._fs()
        for folder, keep in ((MANIFESTS, f"{number:012d}.json"), *((t, f"version={version}") for t in TABLES)):
            for f in fs.listStatus(self._path(folder)):
                if f.getPath().getName() < keep:
                    fs.delete(f.getPath(), True)

    def snapshot(self) -> list[dict]:
        """Files, bytes and rows of each table, and its segments and versions."""
        rows = {"events": self.events(), "ledger_index": self.index(), "value_counts": self.counts()}
        versions = self._manifest()[1]["segments"].values()
        return [{"table": t, "files": (s := self.size(t)).files, "bytes": s.bytes, "rows": rows[t].count(), "segments": len(versions), "versions": sum(map(len, versions))} for t in TABLES]

    def stats(self) -> dict:
        out = stats.store_stats(self.events()).first().asDict()
        return out | {"last_processed": self.watermark()}
