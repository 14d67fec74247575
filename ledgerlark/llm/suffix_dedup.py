"""Removal of repeated byte strings by sorting the windows that documents of different shards may share.

A byte of a document is removed if a string of ``length`` bytes that covers it also starts in a
document with a smaller doc_id. Documents are dealt to shards. A shard keeps those windows whose
anchor (see ``anchors``) another document has too, as strings: runs of windows that share an anchor.
Strings go to buckets by anchor, where all windows that can be equal meet.

A bucket sorts the windows of all its shards by a stable radix sort in symbols of eight bytes, the
last ones first. The steps are those that merge Burrows-Wheeler transforms by refining their
interleave, but no shard sorts its suffixes or builds a transform: the rows start unsorted, one
shard's after another's, and only the windows that another document may have are there. Rows that
are equal in all ``length`` bytes stay in one interval, which is a repeated string; of longer common
prefixes nothing is known. The smallest doc_id of each interval is told to the shards, which remove
what it covers.

Equal texts are first reduced to the one with the smallest doc_id, and equal strings of a shard to
one. An anchor of more than ``HOT`` documents is no place to meet for all of their windows: these
go by their own hash instead.

Defined edge cases: null texts count as empty; texts shorter than ``length`` keep everything; equal
rows (one doc_id) keep what a smaller doc_id does not have; matches never cross documents; an empty
table gives no row; rows without doc_id are left out; other columns are not read. ``doc_id`` identifies
a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors, window_anchors
from .exchange import Shards, among, copies, merged, packed, table_of_rows, unpacked
from .shared import released, written
from .words import grouped, mixed, multipliers

SYMBOL = 8
#: Documents from which on the windows of an anchor are dealt by their own hashes.
HOT = 100_000
#: Bytes whose hashes are made at a time.
BLOCK = 1 << 21


@dataclass
class Strings:
    """Strings of a shard in a buffer: where they start and end, the anchor, the place of the document, a hash of the bytes."""

    start: np.ndarray
    end: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def substring_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Multilinear hashes of parts of ``b`` (see ``words.multipliers``), which may overlap."""
    out, size, i = np.empty(len(start), np.uint64), end - start, 0
    done = np.cumsum(size)
    places = multipliers(int(size.max(initial=1)), 23)
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(done, done[i] - size[i] + BLOCK, "right")))
        first = np.cumsum(size[i:j]) - size[i:j]
        at = np.arange(int(size[i:j].sum())) - np.repeat(first, size[i:j])
        out[i:j] = np.add.reduceat((b[at + np.repeat(start[i:j], size[i:j])] + np.uint64(1)) * places[at], first)
        i = j
    return mixed(out + size.astype(np.uint64))


def strings_of(texts: list[bytes], known: np.ndarray, hot: np.ndarray, length: int, drop: int) -> Iterator[tuple[int, int, bytes, np.ndarray, Strings]]:
    """For ranges of texts: first, end, their bytes together, the offset of each, and the strings that may occur elsewhere.

    ``known`` and ``hot`` are sorted anchors without their last ``drop`` bits.
    """
    for i, j in grouped(texts):
        raw = b"".join(texts[i:j])
        sizes = np.fromiter(map(len, texts[i:j]), np.int64, j - i)
        offset = np.concatenate(([0], np.cumsum(sizes)))
        b = np.frombuffer(raw, np.uint8)
        anchor = mixed(window_anchors(b, length))
        at = np.arange(len(anchor))
        doc = np.repeat(np.arange(j - i), sizes)[: len(anchor)]
        inside = at + length <= offset[doc + 1]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))) if len(anchor) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        met, very = among(anchor[first] >> np.uint64(drop), known)[run] & inside, None
        if len(hot):
            very = among(anchor[first] >> np.uint64(drop), hot)[run]
        # a run of windows that are kept and share an anchor; hot windows one by one
        begins = met & (new | np.concatenate(([True], ~met[:-1])) | (very if very is not None else False))
        start = np.flatnonzero(begins)
        which = np.cumsum(begins)[met] - 1
        count = np.bincount(which, minlength=len(start))
        end = start + count + length - 1
        h = substring_hashes(b, start, end) if len(start) else np.empty(0, np.uint64)
        place = anchor[start]
        if very is not None:
            place = np.where(very[start], mixed(h), place)
        yield i, j, raw, offset, Strings(start, end, place, doc[start], h)


def windows(b: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Where each window of strings begins: ``count`` windows from ``start`` on."""
    total = int(count.sum())
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)


def refined(b: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of the windows ``at``, and which rows begin an interval of equal windows.

    ``at`` has the rows of one shard after another.
    """
    padded = np.concatenate((b, np.zeros(SYMBOL, np.uint8)))
    symbols = np.ndarray((len(b),), ">u8", padded, strides=(1,))
    order, begins = np.arange(len(at)), np.zeros(len(at), bool)
    if len(at):
        begins[0] = True
    # contexts of the last bytes first, then eight more in front of them at each step
    for depth in range((length - 1) // SYMBOL * SYMBOL, -1, -SYMBOL):
        symbol = symbols[at[order] + depth].astype(np.uint64)
        if depth + SYMBOL > length:
            symbol >>= np.uint64(8 * (depth + SYMBOL - length))
        step = np.argsort(symbol, kind="stable")
        interval = (np.cumsum(begins) - 1)[step]
        symbol = symbol[step]
        begins[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        order = order[step]
    return order, begins


def _send(length: int, bits: int, drop: int):
    def f(ids: list[int], texts: list[bytes], answers: list[tuple], shard: int) -> pa.Table:
        shard_known, hot = merged(a[0] for a in answers), merged(a[1] for a in answers)
        hashes, places, docs, parts = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], []
        for i, _, raw, _, s in strings_of(texts, shard_known, hot, length, drop):
            hashes.append(s.hash)
            places.append(s.anchor)
            docs.append(s.doc + i)
            parts.append((raw, s.start, s.end))
        h, place, doc = np.concatenate(hashes), np.concatenate(places), np.concatenate(docs)
        # documents come by id, so the first to have a string is the smallest
        once, first = np.unique(h, return_index=True)
        bucket = (place[first] >> np.uint64(64 - bits)).astype(np.int64)
        buffers = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        start, end = np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)]), np.concatenate([np.empty(0, np.int64), *(p[2] for p in parts)])
        order, rows, ids_of = np.argsort(bucket, kind="stable"), [], np.array(ids, np.int64)
        cuts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
        for k in range(1 << bits):
            members = first[order[cuts[k] : cuts[k + 1]]]
            if len(members):
                # by place in the text, where neighbours overlap and compress well; the order is that of _positions
                members = np.sort(members)
                text = b"".join(parts[p][0][s:e] for p, s, e in zip(buffers[members].tolist(), start[members].tolist(), end[members].tolist(), strict=True))
                rows.append((shard, k, zstandard.ZstdCompressor(level=1).compress(text), (end[members] - start[members]).astype(np.int32).tobytes(), packed_ids(ids_of[doc[members]])))
        return table_of_rows(rows, ("shard", "bucket", "strings", "lengths", "docs"), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))

    return f


def packed_ids(ids: np.ndarray) -> bytes:
    """Integers as compressed differences."""
    return packed(ids.astype(np.int64).view(np.uint64))


def unpacked_ids(raw: bytes) -> np.ndarray:
    return unpacked(raw).view(np.int64)


def _merge(length: int):
    def f(table: pa.Table) -> pa.Table:
        shard, texts, lengths, docs = ([*table.column(c).to_pylist()] for c in ("shard", "strings", "lengths", "docs"))
        raw = b"".join(zstandard.ZstdDecompressor().decompress(t) for t in texts)
        sizes = [np.frombuffer(x, np.int32).astype(np.int64) for x in lengths]
        size, doc = np.concatenate(sizes), np.concatenate([unpacked_ids(d) for d in docs])
        b, start = np.frombuffer(raw, np.uint8), np.cumsum(size) - size
        # equal strings of several shards are one
        h = substring_hashes(b, start, start + size)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        count = size[first] - length + 1
        at = windows(b, start[first], count)
        order, begins = refined(b, at, length)
        owner = np.repeat(least, count)
        smallest = np.minimum.reduceat(owner[order], np.flatnonzero(begins))
        found = np.empty(len(at), np.int64)
        found[order] = smallest[np.cumsum(begins) - 1]
        # each shard is told, for its strings in the order sent, the smallest document of each window
        base, rows, k = np.cumsum(count) - count, [], 0
        bucket = table.column("bucket")[0].as_py()
        for s, z in zip(shard, sizes, strict=True):
            mine = which[k : k + len(z)]
            k += len(z)
            rows.append((s, bucket, packed_ids(found[windows(b, base[mine], count[mine])])))
        return table_of_rows(rows, ("shard", "bucket", "smallest"), (pa.int32(), pa.int32(), pa.binary()))

    return f


def _cut(length: int, bits: int, drop: int, bytes_too: bool):
    def f(ids: list[int], texts: list[bytes], answers: list[tuple], shard: int) -> pa.Table:
        known, hot = merged(a[0] for a in answers if a[0] is not None), merged(a[1] for a in answers if a[1] is not None)
        told = {a[2]: unpacked_ids(a[3]) for a in answers if a[2] is not None}
        groups = list(strings_of(texts, known, hot, length, drop))
        h = np.concatenate([np.empty(0, np.uint64), *(g[4].hash for g in groups)])
        place = np.concatenate([np.empty(0, np.uint64), *(g[4].anchor for g in groups)])
        count = np.concatenate([np.empty(0, np.int64), *(g[4].end - g[4].start - length + 1 for g in groups)])
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        bucket = (place[first] >> np.uint64(64 - bits)).astype(np.int64)
        # strings as they were sent: by bucket, then by place in the text
        order = np.lexsort((first, bucket))
        smallest = np.concatenate([np.empty(0, np.int64), *(told[k] for k in np.unique(bucket).tolist())])
        base = np.empty(len(first), np.int64)
        sent = count[first[order]]
        base[order] = np.cumsum(sent) - sent
        rows, k = [], 0
        for i, j, raw, offset, s in groups:
            mine = which[k : k + len(s.start)]
            n = count[k : k + len(s.start)]
            k += len(s.start)
            own = np.array(ids[i:j], np.int64)[s.doc]
            earlier = smallest[windows(offset, base[mine], n)] < np.repeat(own, n)
            flags = np.zeros(len(raw) + 1, np.int32)
            flags[windows(offset, s.start, n)[earlier]] = 1
            ahead = np.cumsum(flags)
            covered = ahead[:-1] - np.concatenate((np.zeros(min(length, len(raw)), np.int32), ahead[: max(len(raw) - length, 0)])) > 0
            b = np.frombuffer(raw, np.uint8)
            for d in range(i, j):
                lo, hi = int(offset[d - i]), int(offset[d - i + 1])
                c = covered[lo:hi]
                removed = int(c.sum())
                spans = int((np.diff(np.concatenate(([False], c)).view(np.int8)) == 1).sum()) if removed else 0
                kept = b[lo:hi][~c].tobytes() if removed else texts[d]
                rows.append((ids[d], hi - lo, removed, spans, hashlib.sha256(kept).hexdigest(), kept if bytes_too else None))
        return table_of_rows(rows, ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))

    return f


def dedup(docs: DataFrame, length: int = 50, bytes_too: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (the remaining bytes, null unless ``bytes_too``) of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    _, others = copies(docs)
    shards = Shards(docs, others)
    known = shards.shared(lambda texts: anchors(texts, length), HOT)
    released(spark)
    bits = shards.bits
    sent = shards.apply(known, _send(length, bits, shards.drop), "shard int, bucket int, strings binary, lengths binary, docs binary")
    told = written(sent.groupBy("bucket").applyInArrow(_merge(length), "shard int, bucket int, smallest binary"), "told")
    released(spark)
    answers = known.unionByName(told, allowMissingColumns=True).select("shard", "known", "hot", "bucket", "smallest")
    firsts = shards.apply(answers, _cut(length, bits, shards.drop, bytes_too), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    # a text equal to an earlier document's goes altogether if it is long enough to hold a string
    copy = docs.join(others.select("doc_id"), "doc_id")
    gone = F.octet_length("text") >= length
    left = F.when(gone, F.lit(b"")).otherwise(F.encode("text", "UTF-8"))
    rest = copy.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.when(gone, F.octet_length("text")).otherwise(0).cast("long").alias("n_removed"),
        gone.cast("long").alias("n_spans"), F.sha2(left, 256).alias("kept_sha256"), (left if bytes_too else F.lit(None).cast("binary")).alias("kept"),
    )
    return firsts.unionByName(rest)
