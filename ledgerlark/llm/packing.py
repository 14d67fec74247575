"""Best-fit decreasing packing of token sequences with a segment tree over remaining capacities.

Pieces are placed longest first, each into the open bin with the least room that still holds it.
Pieces of one length are interchangeable, and so are bins with the same contents, so the placing
is done for counts: a plan over the histogram of lengths (at most ``capacity`` numbers, whatever
the input's size) says how many bins there are of each make-up. It is exactly what placing the
pieces one by one gives. Each piece then finds its place from its rank among those of its length.

Defined edge cases: a null text counts as an empty one, which still has its end token; long texts
are cut into pieces of ``capacity``, of which the first may be shorter; equal rows are packed one
by one; an empty table gives no piece; other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Fixed value: how byte-level BPE cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with more whitespace than this in one run are not given to tiktoken.
LONG_BLANK = 100_000
BLANK = re.compile(rf"(?<!\s)\s{{{LONG_BLANK + 1}}}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class TightestFit:
    """A segment tree over remaining capacities 0..capacity; a leaf counts the open bin groups of that room."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, count: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += count
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest room of at least ``least`` that is open, or -1; logarithmic in the capacity."""
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:  # the right neighbour holds larger rooms
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


@dataclass
class Group:
    """``bins`` bins of the same make-up; ``parts``: (length, how many of it in each bin, its offset, rank of the first)."""

    bins: int
    room: int
    parts: tuple[tuple[int, int, int, int], ...]


def plan(histogram: dict[int, int], capacity: int) -> list[Group]:
    """The bins that best-fit decreasing makes of ``histogram`` (length to count)."""
    tree, open_groups, done = TightestFit(capacity), {}, []

    def put(g: Group) -> None:
        if g.room:
            open_groups.setdefault(g.room, []).append(g)
            tree.add(g.room, 1)
        elif g.bins:
            done.append(g)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        while left:
            room = tree.tightest(length)
            if room < 0:
                # as many new bins as needed, each filled before the next is opened
                g, room = Group(-(-left // (capacity // length)), capacity, ()), capacity
            else:
                g = open_groups[room].pop()
                tree.add(room, -1)
            # the bin that got a piece is then the tightest, so it is filled before any other
            each = room // length
            full = min(g.bins, left // each)
            at = capacity - room
            if full:
                put(Group(full, room - each * length, (*g.parts, (length, each, at, rank))))
                rank += full * each
                left -= full * each
            rest = g.bins - full
            if rest and 0 < left < each:  # one bin gets what is left
                put(Group(1, room - left * length, (*_later(g.parts, full), (length, left, at, rank))))
                full, rest, rank, left = full + 1, rest - 1, rank + left, 0
            if rest and room < capacity:
                put(Group(rest, room, _later(g.parts, full)))
    return [*done, *(g for groups in open_groups.values() for g in groups)]


def _later(parts: tuple, bins: int) -> tuple:
    """The parts of the bins behind the first ``bins`` of a group."""
    return tuple((length, each, at, rank + bins * each) for length, each, at, rank in parts)


def ranges(groups: list[Group]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a bin, first sequence, offset) of each part of each group."""
    out, sequence = [], 0
    for g in groups:
        out += [(length, rank, rank + each * g.bins, each, sequence, at) for length, each, at, rank in g.parts]
        sequence += g.bins
    return out


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, an end token behind each.

    The file is a byte-level BPE whose merges are in the order of their ids. tiktoken, given that
    vocabulary, yields the ids of the tokenizers library several times faster; it is used for texts of
    Latin-1 characters without the file's special tokens, and tokenizers for the others, where the two
    libraries' character classes may differ. Texts with a long run of whitespace also go to tokenizers:
    tiktoken's regex backtracks over such a run, and its stack ends at a million characters.
    """

    def __init__(self, path: str, end_id: int | None) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file["added_tokens"]]
        of = byte_of()
        ranks = {bytes(of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = b"" if end_id is None else array("I", [end_id]).tobytes()

    def ids(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            plain = not any(t in text for t in self.special)
        except UnicodeEncodeError:
            plain = False
        plain = plain and not (len(text) > LONG_BLANK and BLANK.search(text))
        found = self.fast.encode_ordinary(text) if plain else self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", found).tobytes() + self.end


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a text: whole if it fits, else ``capacity`` each but for the first."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None = 2) -> DataFrame:
    """The pieces of every text: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, end_id)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for doc, text in zip(ids, batch.column(1), strict=True):
                raw = encoder.ids(text.as_py() or "")
                rows += [(doc, k, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])) for k, (start, n) in enumerate(cut(len(raw) // 4, capacity)) if n]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = 2, rows_a_shard: int = 50_000) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    pieces = written(tokenize(docs, tokenizer, capacity, end_id), "pieces")
    lengths = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    shards = -(-sum(lengths.values()) // rows_a_shard) or 1
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    # the rank among pieces of one length: those in the shards before, and those before it in its own
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard_sizes = pieces.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    starts = shard_sizes.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start"))
    ranked = pieces.withColumn("own", own).join(starts, ["length", "shard"]).withColumn("rank", F.col("ahead") + F.col("own") - 1)
    # bounded by ``capacity``: each length ends at most two groups of bins before they are full
    rows = ranges(plan(lengths, capacity))
    places = spark.createDataFrame(rows or [(0,) * 6], "length long, lo long, hi long, each long, first long, at long")
    p, i = F.broadcast(places.withColumnRenamed("length", "of")), F.col("rank") - F.col("lo")
    placed = ranked.join(p, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(i / F.col("each"))).alias("sequence_id"),
        (F.col("at") + F.pmod(i, F.col("each")) * F.col("length")).alias("offset"),
    )
