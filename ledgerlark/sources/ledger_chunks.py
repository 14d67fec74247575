"""Compressed ledger files as a Spark source, one partition a chunk.

A folder holds ``chunks/%04d/%06d.index`` and ``.data``: an index has a header of 8 bytes (version,
offset width) and little-endian offsets, one more than there are ledgers; the data has one zstd
frame a ledger. A folder is a path or the URI of any file system that pyarrow knows (``file``,
``hdfs``, ``s3``, ``gs``, ...); driver and executors list and read it through that.
"""

from __future__ import annotations

import io
import os
import re
import struct
from collections.abc import Iterator, Sequence

import zstandard
from pyarrow.fs import FileSelector, FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..model import CHUNKS_A_FOLDER, FIRST_LEDGER, LEDGERS_A_CHUNK

HEADER, VERSION = 8, 1
READ_BYTES = 4 << 20
INDEX_NAME = re.compile(r"(\d{4})/(\d{6})\.index$")


def chunk_of(ledger: int) -> int:
    if ledger < FIRST_LEDGER:
        raise ValueError(f"ledgers begin at {FIRST_LEDGER}, not {ledger}")
    return (ledger - FIRST_LEDGER) // LEDGERS_A_CHUNK


def first_ledger(chunk: int) -> int:
    return chunk * LEDGERS_A_CHUNK + FIRST_LEDGER


def chunk_path(folder: str, chunk: int, kind: str) -> str:
    return f"{folder}/chunks/{chunk // CHUNKS_A_FOLDER:04d}/{chunk:06d}.{kind}"


def read_offsets(raw: bytes) -> list[int]:
    """The offsets of an index file; ValueError if its header is not understood."""
    if len(raw) < HEADER:
        raise ValueError("the index has no header")
    if raw[0] != VERSION:
        raise ValueError(f"unknown index version {raw[0]}")
    if raw[1] not in (4, 8):
        raise ValueError(f"unknown offset size {raw[1]}")
    n = (len(raw) - HEADER) // raw[1]
    return list(struct.unpack_from(f"<{n}{'I' if raw[1] == 4 else 'Q'}", raw, HEADER))


def located(folder: str) -> tuple[FileSystem, str]:
    """The file system of a folder, and its path there."""
    return FileSystem.from_uri(folder) if "://" in folder else (LocalFileSystem(), folder)


def read_chunk(folder: str, chunk: int, lo: int, hi: int) -> Iterator[tuple[int, bytes]]:
    """(ledger, payload) of the ledgers lo..hi of one chunk."""
    files, root = located(folder)
    with files.open_input_file(chunk_path(root, chunk, "index")) as f:
        offsets = read_offsets(f.read())
    start, decoder = first_ledger(chunk), zstandard.ZstdDecompressor()
    a, b = max(lo - start, 0), min(hi - start + 1, len(offsets) - 1)
    if a >= b:
        return
    with files.open_input_file(chunk_path(root, chunk, "data")) as f:
        f.seek(offsets[a])
        # frames lie one behind another: few requests, whatever a ledger's size is
        data = io.BufferedReader(f, READ_BYTES)
        for i in range(a, b):
            with decoder.stream_reader(data.read(offsets[i + 1] - offsets[i])) as frame:
                yield start + i, frame.read()


def read_ledger(folder: str, ledger: int) -> bytes:
    """The payload of one ledger."""
    for _, payload in read_chunk(folder, chunk_of(ledger), ledger, ledger):
        return payload
    raise KeyError(f"no ledger {ledger}")


def write_chunk(folder: str, chunk: int, payloads: Sequence[bytes], width: int = 4) -> None:
    """Writes one chunk; for tests and for making archives."""
    os.makedirs(os.path.dirname(chunk_path(folder, chunk, "index")), exist_ok=True)
    frames = [zstandard.ZstdCompressor().compress(p) for p in payloads]
    offsets = [0]
    for f in frames:
        offsets.append(offsets[-1] + len(f))
    with open(chunk_path(folder, chunk, "data"), "wb") as f:
        f.write(b"".join(frames))
    with open(chunk_path(folder, chunk, "index"), "wb") as f:
        f.write(bytes([VERSION, width]) + bytes(HEADER - 2) + struct.pack(f"<{len(offsets)}{'I' if width == 4 else 'Q'}", *offsets))


def list_chunks(folder: str) -> list[int]:
    """The numbers of the chunks that have an index, ascending."""
    files, root = located(folder)
    found = files.get_file_info(FileSelector(f"{root}/chunks", recursive=True, allow_not_found=True))
    return sorted(int(m[2]) for f in found if (m := INDEX_NAME.search(f.path)))


def ledger_range(folder: str) -> tuple[int, int, int]:
    """(first ledger, last ledger, chunks) that a folder can hold; gaps between chunks are ignored."""
    chunks = list_chunks(folder)
    if not chunks:
        raise FileNotFoundError(f"no chunks below {folder}")
    return first_ledger(chunks[0]), first_ledger(chunks[-1] + 1) - 1, len(chunks)


def folder_report(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each folder of chunks: name, first and last ledger, chunks, MiB of data."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/chunks").select("path", "length")
    name, number = F.regexp_extract("path", r"/(\d{4})/\d{6}\.\w+$", 1), F.regexp_extract("path", r"/(\d{6})\.\w+$", 1).cast("long")
    index, data = F.col("path").endswith(".index"), F.col("path").endswith(".data")
    rows = files.where(index | data).groupBy(name.alias("name")).agg(
        (F.min(F.when(index, number)) * LEDGERS_A_CHUNK + FIRST_LEDGER).alias("first_ledger"),
        ((F.max(F.when(index, number)) + 1) * LEDGERS_A_CHUNK + FIRST_LEDGER - 1).alias("last_ledger"),
        F.count_if(index).alias("chunks"),
        (F.sum(F.when(data, F.col("length")).otherwise(0)) / (1 << 20)).alias("data_mib"),
    )
    return rows.orderBy("name")


class ChunkPartition(InputPartition):
    def __init__(self, chunk: int, lo: int, hi: int) -> None:
        self.chunk, self.lo, self.hi = chunk, lo, hi


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options.get("path") or options["folder"]
        self.lo, self.hi = int(options.get("start", FIRST_LEDGER)), int(options.get("end", 2**63 - 1))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ranges of ``ledger_sequence`` choose chunks and ledgers; other filters are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("ledger_sequence",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.hi = min(self.hi, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[ChunkPartition]:
        chunks = [c for c in list_chunks(self.folder) if first_ledger(c) <= self.hi and first_ledger(c + 1) > self.lo]
        return [ChunkPartition(c, self.lo, self.hi) for c in chunks] or [ChunkPartition(-1, 0, -1)]

    def read(self, partition: ChunkPartition) -> Iterator[tuple]:
        if partition.chunk >= 0:
            yield from read_chunk(self.folder, partition.chunk, partition.lo, partition.hi)


class LedgerChunks(DataSource):
    """``spark.read.format("ledger_chunks").load(folder)``: ledger_sequence, raw."""

    @classmethod
    def name(cls) -> str:
        return "ledger_chunks"

    def schema(self) -> str:
        return "ledger_sequence long, raw binary"

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)


def read_ledgers(spark: SparkSession, folder: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The ledgers start..end of a folder (all of them by default)."""
    spark.dataSource.register(LedgerChunks)
    # a reader that takes filters is refused without this
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("ledger_chunks")
    if start is not None:
        chunk_of(start)
        reader = reader.option("start", start)
    if end is not None:
        if end < (start or FIRST_LEDGER):
            raise ValueError("the range ends before it starts")
        reader = reader.option("end", end)
    return reader.load(folder)
