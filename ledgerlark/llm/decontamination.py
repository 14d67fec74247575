"""Benchmark decontamination: a hash set of normalised test n-grams against all token windows.

The set is broadcast while the benchmark's texts stay under ``broadcast_bytes``. The windows of a larger
one are a table: a bitmap of fixed size tells which document windows may be in it, and those are
joined with it by hash and words. Hits are verified word by word either way.

Words: A-Z are lower-cased; a word is a run of characters other than U+0000-002F, 003A-0060,
007B-007F. A window is ``n`` consecutive words of an item; an item of fewer, but not none, is one
window.

Defined edge cases: null texts and empty texts have no words; items without words have no window;
repeated rows are treated one by one; an empty benchmark hits nothing; other columns pass through,
and columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import quoted, slices, texts_of, with_columns_from
from .exchange import table_of_rows
from .shared import written
from .words import ALNUM, WordHasher, grouped, ngrams

HASHER = WordHasher(ALNUM)
FILTER_BITS = 20

HITS = (
    T.StructType()
    .add("n_words", T.LongType(), False)
    .add("hits", T.ArrayType(T.StructType().add("first", T.LongType(), False).add("last", T.LongType(), False).add("start", T.LongType(), False).add("end", T.LongType(), False), False), False)
    .add("items", T.ArrayType(T.StringType(), False), False)
)


@dataclass
class Sorted:
    """Windows of one length in the order of their hashes: where their words are in the items' bytes, and whose they are."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    item: np.ndarray
    maybe: np.ndarray


class Windows:
    """The windows of some items in a few flat arrays: about 24 bytes a window besides the items' words."""

    def __init__(self, items: Iterable[tuple[str, str]], n: int) -> None:
        self.items, words, found, at = [], [], defaultdict(list), 0
        for item, text in items:
            clean, starts, ends = HASHER.split(text.encode("utf-8", "surrogatepass"))
            if not len(starts):
                continue
            size = min(n, len(starts))
            # the words with one space between them
            words.append(b" ".join(clean.split()))
            last = np.cumsum(ends - starts + 1) - 1
            first = np.concatenate(([0], last[:-1] + 1))
            h = ngrams(HASHER.hashes(clean, starts, ends), size)
            found[size].append((h, at + first[: len(h)], at + last[size - 1 :], np.full(len(h), len(self.items), np.int32)))
            self.items.append(item)
            at += len(words[-1])
        self.words, self.sorted = b"".join(words), {}
        for size in list(found):
            parts = found.pop(size)
            h, start, end, item = (np.concatenate([p[k] for p in parts]) for k in range(4))
            del parts
            order = np.argsort(h, kind="stable")
            maybe = np.zeros(1 << FILTER_BITS, bool)
            maybe[h >> np.uint64(64 - FILTER_BITS)] = True
            kind = np.int32 if at < 1 << 31 else np.int64
            self.sorted[size] = Sorted(h[order], start[order].astype(kind), end[order].astype(kind), item[order], maybe)

    def who(self, size: int, h: np.uint64, window: bytes) -> set[str]:
        """The items that have the window, whose hash is ``h``."""
        known, out = self.sorted[size], set()
        for k in range(int(np.searchsorted(known.hash, h)), int(np.searchsorted(known.hash, h, "right"))):
            if self.words[known.start[k] : known.end[k]] == window:
                out.add(self.items[known.item[k]])
        return out

    def search(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int, int, int]], set[str]]]:
        """Per text: its words, the maximal runs of hit words (first, after last, start and end byte), the items."""
        out = []
        for words in _words_of(texts):
            delta, items = np.zeros(len(words.starts) + 1, np.int64), defaultdict(set)
            for size, known in self.sorted.items():
                h, at = words.windows(size, known.maybe)
                at = at[known.hash[np.minimum(np.searchsorted(known.hash, h[at]), len(known.hash) - 1)] == h[at]]
                for k in at.tolist():
                    if who := self.who(size, h[k], words.text(k, size)):
                        items[int(words.doc[k])] |= who
                        delta[k] += 1
                        delta[k + size] -= 1
            hit = np.cumsum(delta[:-1]) > 0
            for d in range(len(words.first) - 1):
                out.append((int(words.first[d + 1] - words.first[d]), words.runs(d, hit) if d in items else [], items.get(d, set())))
        return out


class _Words:
    """The words of some texts and where each text's begin."""

    def __init__(self, texts: list[bytes]) -> None:
        self.clean, self.starts, self.ends = HASHER.split(b"\n".join(texts))
        self.offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = HASHER.hashes(self.clean, self.starts, self.ends)

    def windows(self, size: int, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each window, and those within one text that ``maybe`` marks by their first bits."""
        h = ngrams(self.hashes, size)
        at = np.flatnonzero(maybe[h >> np.uint64(64 - (len(maybe) - 1).bit_length())])
        return h, at[self.doc[at] == self.doc[at + size - 1]]

    def text(self, k: int, size: int) -> bytes:
        return b" ".join(self.clean[self.starts[m] : self.ends[m]] for m in range(k, k + size))

    def runs(self, d: int, hit: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The maximal runs of the hit words of a text."""
        a, b = int(self.first[d]), int(self.first[d + 1])
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit[a:b], [False])).view(np.int8))).tolist()
        return [(x, y, int(self.starts[a + x] - self.offsets[d]), int(self.ends[a + y - 1] - self.offsets[d])) for x, y in zip(edge[::2], edge[1::2], strict=True)]


def _words_of(texts: list[bytes]) -> Iterator[_Words]:
    for i, j in grouped(texts):
        yield _Words(texts[i:j])


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (runs of hit words and their bytes) and ``items`` (ids as strings, sorted)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total > broadcast_bytes:
        return _joined(docs, items, n)
    rows = items.toArrow()  # at most broadcast_bytes of text
    pairs = ((item.as_py(), text.as_py()) for item, text in zip(rows.column(0), rows.column(1), strict=True))
    windows = docs.sparkSession.sparkContext.broadcast(Windows(pairs, n))
    del rows, pairs

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            return _columns(windows.value.search([t.encode("utf-8", "surrogatepass") for t in texts_of(batch)]))

        return step

    return with_columns_from(docs, HITS, make)


def _columns(found: list[tuple]) -> dict[str, list]:
    """The new columns from words, runs and items of each text."""
    named = ("first", "last", "start", "end")
    return {"n_words": [f[0] for f in found], "hits": [[dict(zip(named, r, strict=True)) for r in f[1]] for f in found], "items": [sorted(f[2]) for f in found]}


def _joined(docs: DataFrame, items: DataFrame, n: int, bits: int = 27) -> DataFrame:
    """As ``find``, with the windows as a table; ``bits``: the bitmap has so many address bits."""
    spark = docs.sparkSession
    shape = "h long, size int, words binary"

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, 1, raw=True):
            rows = []
            for item, text in zip(ids.to_pylist(), texts, strict=True):
                words = _Words([text])
                if k := len(words.starts):
                    h = ngrams(words.hashes, min(n, k)).view(np.int64).tolist()
                    rows += [(item, x, min(n, k), words.text(i, min(n, k))) for i, x in enumerate(h)]
            yield from table_of_rows(rows, ("item", "h", "size", "words"), (pa.string(), pa.int64(), pa.int32(), pa.binary())).to_batches()

    windows = written(items.mapInArrow(windows_of, f"item string, {shape}").distinct(), "windows")
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most n numbers
    place = F.shiftrightunsigned("h", 64 - bits) + 1
    marks = windows.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
    packed = np.zeros(1 << max(bits - 3, 0), np.uint8)
    for r in marks.toLocalIterator():  # as many bits as the bitmap has, whatever the input's size
        part = np.frombuffer(r["map"], np.uint8)
        at = (r["number"] - 1) * len(part)
        packed[at : at + len(part)] = part[: len(packed) - at]
    maybe = spark.sparkContext.broadcast(packed)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(maybe.value, bitorder="little").view(bool)
        for digests, texts in slices(batches, 1, raw=True):
            digest, rows = digests.to_pylist(), []
            for d, text in enumerate(texts):
                words = _Words([text])
                for size in sizes:
                    h, at = words.windows(size, marked)
                    rows += [(digest[d], k, int(h[k].view(np.int64)), size, words.text(k, size)) for k in at.tolist()]
            yield from table_of_rows(rows, ("digest", "first", "h", "size", "words"), (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())).to_batches()

    texts = docs.select(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    met = texts.mapInArrow(candidates, f"digest binary, first long, {shape}").join(windows, ["h", "size", "words"])
    # sets, so that a text that many rows have is summed up before it is moved
    by_text = met.groupBy("digest").agg(F.collect_set(F.struct("first", "size")).alias("__dc_at"), F.collect_set("item").alias("__dc_items"))
    by_text = written(by_text.withColumnRenamed("digest", "__dc_digest"), "hits")
    own = docs.columns
    joined = docs.withColumn("__dc_own", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).join(by_text, F.col("__dc_own") == F.col("__dc_digest"), "left")
    joined = joined.select(*quoted(own), "__dc_at", "__dc_items")

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            places, who = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__dc_at", "__dc_items"))
            found = []
            for text, at, names in zip(texts_of(batch), places, who, strict=True):
                words = _Words([text.encode("utf-8", "surrogatepass")])
                delta = np.zeros(len(words.starts) + 1, np.int64)
                for w in at or ():
                    delta[w["first"]] += 1
                    delta[w["first"] + w["size"]] -= 1
                found.append((len(words.starts), words.runs(0, np.cumsum(delta[:-1]) > 0) if at else [], set(names or ())))
            return _columns(found)

        return step

    return with_columns_from(joined, HITS, make).drop("__dc_at", "__dc_items")


def n_hit() -> F.Column:
    """How many words of ``hits`` are hit."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["last"] - h["first"])


def clean(docs: DataFrame, benchmark: DataFrame, action: str = "drop", n: int = 10, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` without contaminated documents (``drop``) or without the hit spans of their texts (``remove``)."""
    if action not in ("drop", "remove"):
        raise ValueError(f"unknown action: {action}")
    found = find(docs, benchmark, n, broadcast_bytes)
    if action == "drop":
        return found.where(F.size("items") == 0).select(*quoted(docs.columns))
    # bytes before, between and behind the spans, which begin and end between characters
    raw = F.encode("text", "UTF-8")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform("hits", lambda h: F.array(h["start"], h["end"]))), F.array(F.octet_length("text").cast("long")))
    kept = F.transform(F.sequence(F.lit(0), F.size("hits")), lambda i: F.substring(raw, F.get(edges, 2 * i).cast("int") + 1, (F.get(edges, 2 * i + 1) - F.get(edges, 2 * i)).cast("int")).cast("string"))
    out = found.withColumn("text", F.when(F.size("hits") > 0, F.array_join(kept, " ")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("hits") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return out.select(*quoted(docs.columns))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
cut AS (SELECT item, w, CAST(least(10, len(w)) AS BIGINT) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM cut),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM wanted),
places AS (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS i FROM docs, sizes),
hits AS (SELECT a.doc_id, a.i, a.n, s.item FROM (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g FROM places) a JOIN wanted s ON a.n = s.n AND a.g = s.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN who h ON d.doc_id = h.doc_id
"""
