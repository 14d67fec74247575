"""Which of very many 64-bit hashes occur in two documents or more, told to the shards that hold them.

Documents are dealt to shards of a bounded size. Each shard sends every hash it has once, in
sorted, compressed runs, one for each bucket of hash space; a bucket sees each hash at most once
from each shard, so a hash that every document holds is no more work than the number of shards. A
bucket answers each shard with the hashes of its own that others hold too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discarded, written

#: Bytes of text a shard is meant to have where all have LEVEL bytes. A shard sends each bucket a row, and there are as many
#: buckets as shards; with shards as large as the root of the whole, the rows grow in proportion to the input and not as its square.
SHARD_BYTES, LEVEL, MOST_BYTES = 5 << 20, 1 << 30, 64 << 20


def shard_bytes(total: int) -> int:
    return min(max(int(SHARD_BYTES * (total / LEVEL) ** 0.5), 1 << 16), MOST_BYTES)


def packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as compressed differences, their bytes split by rank so that equal ones meet."""
    if not len(values):
        return b""
    delta = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, others) of equal texts: ``rep`` has the smallest doc_id of each digest that occurs twice or more;
    ``others`` (doc_id, rep) has the documents that are not the first of their class."""
    digests = docs.select("doc_id", F.sha2("text", 256).alias("digest"))
    classes = written(digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").select("digest", "rep"), "classes")
    others = digests.join(classes, "digest").where("doc_id > rep").select("doc_id", "rep").distinct()
    return classes, written(others, "copies")


class Shards:
    """``docs`` (doc_id, text without nulls), without the copies in ``others``, dealt to shards by doc_id."""

    def __init__(self, docs: DataFrame, others: DataFrame) -> None:
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.shards = max(-(-total // shard_bytes(total)), 1)
        # as many buckets as shards, a power of two: a bucket gets as many hashes as a shard has
        self.bits = max(3, (self.shards - 1).bit_length())
        # hashes are cut to so many bits that about one in 2 ** 14 looks shared and isn't, which costs work but nothing else
        self.drop = 64 - min(64, (total // 4).bit_length() + 14)
        shard = F.pmod(F.xxhash64("doc_id"), F.lit(self.shards)).cast("int").alias("shard")
        whole = docs.select(shard, F.col("doc_id").cast("long"), "text")
        marks = others.select(shard, F.col("doc_id").cast("long"), F.lit(None).cast("string").alias("text"))
        self.rows = whole.unionByName(marks)

    def shared(self, hashes: Callable[[list[bytes]], list[np.ndarray]], hot: int = 1 << 62) -> DataFrame:
        """(shard, known, hot): the hashes of the shard's documents that occur in two documents or more, and those in more than ``hot``, all without their last ``drop`` bits."""
        bits, drop = self.bits, np.uint64(self.drop)
        top = np.uint64(64 - self.drop - bits)

        def send(table: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, texts = _texts(table)
            per_doc = [np.unique(h >> drop) for h in hashes(texts)]
            values, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *per_doc]), return_counts=True)
            cuts = np.searchsorted(values, np.arange(1 << bits, dtype=np.uint64) << top)
            ends = [*cuts.tolist()[1:], len(values)]
            shard, rows = table.column(0)[0].as_py(), []
            for bucket, (a, b) in enumerate(zip(cuts.tolist(), ends, strict=True)):
                if b > a:
                    rows.append((bucket, shard, packed(values[a:b]), zstandard.ZstdCompressor(level=1).compress(counts[a:b].astype(np.uint32).tobytes())))
            return _table(rows, ("bucket", "shard", "hashes", "counts"), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))

        def answer(table: pa.Table) -> pa.Table:
            shard = table.column(1).to_pylist()
            sent = [unpacked(x) for x in table.column(2).to_pylist()]
            counts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint32) for x in table.column(3).to_pylist()]
            every, place = np.unique(np.concatenate(sent), return_inverse=True)
            # whole numbers below 2 ** 53 are exact here
            total = np.bincount(place, np.concatenate(counts), len(every))
            rows, at = [], 0
            for s, h in zip(shard, sent, strict=True):
                t = total[place[at : at + len(h)]]
                at += len(h)
                if (t > 1).any():
                    rows.append((s, packed(h[t > 1]), packed(h[t > hot])))
            return _table(rows, ("shard", "known", "hot"), (pa.int32(), pa.binary(), pa.binary()))

        sent = self.rows.groupBy("shard").applyInArrow(send, "bucket int, shard int, hashes binary, counts binary")
        return written(sent.groupBy("bucket").applyInArrow(answer, "shard int, known binary, hot binary"), "shared")

    def apply(self, answers: DataFrame, f: Callable[..., pa.Table], schema: str) -> DataFrame:
        """Rows that ``f(doc_ids, texts, answer rows, shard)`` gives for each shard; ``answers``: shard and what else there is."""
        names = [c for c in answers.columns if c != "shard"]
        own = self.rows.select("*", *[F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in names])
        told = answers.select("shard", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *names)

        def run(table: pa.Table) -> pa.Table:
            ids, texts = _texts(table)
            columns = [table.column(3 + k).to_pylist() for k in range(len(names))]
            return f(ids, texts, [r for r in zip(*columns, strict=True) if any(x is not None for x in r)], table.column(0)[0].as_py())

        return own.unionByName(told).groupBy("shard").applyInArrow(run, schema)


def merged(parts: Iterable[bytes]) -> np.ndarray:
    """The hashes of several packed runs, sorted."""
    return np.sort(np.concatenate([np.empty(0, np.uint64), *map(unpacked, parts)]))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _texts(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """Ids and UTF-8 bytes of a shard's documents, without those that a mark says are copies, by id."""
    ids, texts = table.column(1).to_pylist(), table.column(2).cast(pa.binary()).to_pylist()
    marked = {i for i, t in zip(ids, texts, strict=True) if t is None}
    rows = sorted(((i, t) for i, t in zip(ids, texts, strict=True) if t is not None and i not in marked), key=lambda r: r[0])
    return [r[0] for r in rows], [r[1] for r in rows]


def _table(rows: list[tuple], names: tuple, types: tuple) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


table_of_rows = _table


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached over ``edges`` (a, b), for each of ``nodes`` (node).

    Alternates linking every node's larger neighbours, then its smaller ones, to the smallest
    neighbour; the edges end up as stars around the smallest nodes. Only counts come to the driver.
    """
    links = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    was = links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
    while was[0]:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: every node's smaller neighbours and itself go to the smallest of them
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(small, "b")
        new = written(joined.select(F.col("m").alias("a"), "b").union(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct(), "links")
        discarded(links)
        links, now = new, new.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == was:
            break
        was = now
    found = links.groupBy("b").agg(F.min("a").alias("component"))
    return nodes.join(found, nodes["node"] == found["b"], "left").select("node", F.coalesce("component", "node").alias("component"))
