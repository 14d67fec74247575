"""Parity-sketch join: documents whose sets of word shingles have a Jaccard similarity of 0.75 or more.

A set's shingles are hashed to the blocks of a sketch, and each block is the XOR of its shingles'
bits. A shingle that one set has and the other lacks changes one block, so the number of blocks in
which two sketches differ is at most the size of the symmetric difference. Linked sets of sizes
a <= b <= 4a/3 differ in at most (a + b) / 7 <= n / 3 shingles, n being either size; a document
with more than n / 3 blocks in use therefore shares one of them with each partner. Sketches of one
size band have the same number of blocks; a document has a sketch in its own band and in those of
the sizes that a smaller partner can have, and pairs meet in the smaller one's band.

Before that, documents leave that cannot have a partner. At most a quarter of a document's shingles
are not a partner's, so of the first n / 4 + 1 + k in the order of hashes they have k + 1 in common,
in both documents' first ones; ``alone`` counts those that any other document has too. These are
rows of an ordinary aggregation and join, as many as the documents have first shingles.

Of its blocks, a document offers only the rarest n / 3 + 1: as at most n / 3 are not a partner's,
the rarest common block is among the offers of both. So blocks that very many documents share are
hardly ever offered. Where documents meet, bit sketches (one bit flipped for each shingle) whose
distance is more than the symmetric difference can be rule a pair out, and the others are verified
on their sets of 64-bit shingle hashes (see ``words.multipliers`` on unequal shingles of one hash).

Documents meet at the blocks of their sketches in two rounds. The first takes the ``PROBES`` blocks
with the smallest keys of each sketch; what a task returns is a forest of verified links, not the
pairs of a group, and a group of very many documents is cut into parts at random, each part a task.
In the second round documents meet at all blocks they offer, but only blocks whose documents are
still in different components count, so a group of copies is done with after the first. There a
group of more than ``MEET`` documents is cut into blocks, and a task gets two of them.

Defined edge cases: null, empty and blank texts have no shingles and are linked with nothing; a
text of fewer than five words is one shingle; equal rows are linked (if they have words), and every
row has a row in the result; where one doc_id has several texts, each row is judged by its own; an
empty table gives an empty result; rows without doc_id are left out (``one_of_each`` keeps them);
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import slices
from .exchange import components, table_of_rows
from .shared import discarded, released, written
from .words import NONBLANK, WordHasher, grouped, mixed, ngrams

HASHER = WordHasher(NONBLANK)
#: A task looks at groups of about so many documents, and so many shingles.
MEET, MEET_SHINGLES = 1024, 1 << 21
#: Bits of the sketches that rule pairs out, and the blocks of each sketch at which documents first meet.
BITS, PROBES = 1024, 3
#: Bits that are cut off where documents meet: one of two equal numbers by chance costs a look, no link.
CUT = np.uint64(16)
#: In bands that begin below this, each shingle has a block of its own; in others there are as many blocks as the largest set of the band has shingles.
SMALL = 256


def shingles(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its shingles."""
    out = []
    for i, j in grouped(texts):
        clean, starts, ends = HASHER.split(b"\n".join(texts[i:j]))
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts[i:j]), np.int64, j - i) + 1)))
        first = np.searchsorted(starts, offsets).tolist()
        words = HASHER.hashes(clean, starts, ends)
        h = ngrams(words, width)
        for a, b in zip(first, first[1:], strict=False):
            if b - a >= width:
                out.append(np.unique(h[a : b - width + 1]))
            else:  # the whole sequence, told from others by its length
                out.append(ngrams(words[a:b], b - a) ^ np.uint64(b - a) if b > a else h[:0])
    return out


def bands(most: int) -> np.ndarray:
    """The smallest size of each band, up to that of ``most``; a band spans a factor of four."""
    out = [1]
    while out[-1] <= most:
        out.append(4 * out[-1])
    return np.array(out)


def sketch(hashes: np.ndarray, band: int, least: int, salt: int = 0) -> np.ndarray:
    """Sorted keys of the blocks in use: each stands for the band, the block and the XOR of its shingles' bits."""
    spread = mixed(hashes + np.uint64((band + 1 + (salt << 20)) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    blocks = spread if least < SMALL else spread % np.uint64(4 * least)
    order = np.argsort(blocks, kind="stable")
    blocks, bits = blocks[order], hashes[order]
    at = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
    return np.unique(mixed(np.bitwise_xor.reduceat(bits, at) * np.uint64(0x9E3779B97F4A7C15) + blocks[at] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(band + 1)) >> CUT)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """Lists of 64-bit numbers."""
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def first_shingles(n: int, percent: int) -> tuple[int, int]:
    """Of n shingles in the order of hashes, how many to look at, and how many of those a partner has at least among its own first ones."""
    return (100 - percent) * n // 100 + 1 + n // 20, percent * n // 100 // 20 + 1


def _sets(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, digest of the text, n, need, and the first shingles of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, 1, raw=True):
            sets = shingles(texts)
            bounds = [first_shingles(len(h), percent) for h in sets]
            firsts = [h[:k] >> CUT for h, (k, _) in zip(sets, bounds, strict=True)]
            columns = [ids, pa.array([hashlib.sha256(t).digest() for t in texts]), pa.array(list(map(len, sets)), pa.int64()), pa.array([k for _, k in bounds], pa.int64()), lists(firsts)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n", "need", "firsts"])

    return docs.mapInArrow(run, "doc_id long, digest binary, n long, need long, firsts array<long>")


def _may_have_partners(sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """The doc_ids of different texts that have enough of their first shingles in common with other texts."""
    # of equal texts the first, found by ids: a text that a third of the rows have is one row here
    one = sets.where("n > 0").join(firsts.hint("merge"), ["doc_id", "digest"], "left_semi")
    rows = one.select("doc_id", F.explode("firsts").alias("h"))
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1").select("h")
    met = rows.join(shared, "h").groupBy("doc_id").agg(F.count(F.lit(1)).alias("met"))
    return sets.select("doc_id", "need").join(met, "doc_id").where("met >= need").select("doc_id").distinct()


def _candidates(docs: DataFrame, salt: int) -> DataFrame:
    """doc_id, n, hashes, bits, sketches and ``full`` (a sketch has too few blocks in use) of different texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, 1, raw=True):
            sets, rows = shingles(texts), []
            for doc, h, bits in zip(ids.to_pylist(), sets, bit_sketches(sets), strict=True):
                sizes, n = bands(len(h)), len(h)
                between = range(int(np.searchsorted(sizes, -(-3 * n // 4), "right")) - 1, int(np.searchsorted(sizes, n, "right")))
                found = [{"band": band, "keys": sketch(h, band, int(sizes[band]), salt).view(np.int64)} for band in between]
                rows.append((doc, n, h.tobytes(), bits.tobytes(), found, any(len(f["keys"]) <= n // 3 for f in found)))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("band", pa.int32()), ("keys", pa.list_(pa.int64()))])), pa.bool_())
            yield from table_of_rows(rows, ("doc_id", "n", "hashes", "bits", "sketches", "full"), kinds).to_batches()

    return docs.mapInArrow(run, "doc_id long, n long, hashes binary, bits binary, sketches array<struct<band: int, keys: array<long>>>, full boolean")


def bit_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One bit flipped for each hash; two sketches differ in at most as many bits as the sets do in hashes."""
    out = np.zeros((len(sets), BITS // 64), np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = mixed(np.concatenate([np.empty(0, np.uint64), *sets])) % np.uint64(BITS)
    np.bitwise_xor.at(out, (row, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
    return out


def forest(docs: list[int], sets: list[np.ndarray], bits: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever is linked among the documents."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    docs, sets = [docs[i] for i in order], [sets[i] for i in order]
    component, size, bits = np.arange(len(docs)), size[order], bits[order]
    edges = []
    for i, s in enumerate(sets):
        end = int(np.searchsorted(size, 100 * size[i] // percent, "right"))
        other = np.arange(i + 1, end)
        other = other[component[other] != component[i]]
        if len(other):
            apart = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64)
            other = other[apart * (100 + percent) <= (100 - percent) * (size[other] + size[i])]
        for j in other.tolist():
            if component[j] != component[i]:
                both = len(np.intersect1d(s, sets[j], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    edges.append((docs[i], docs[j]))
                    component[component == component[j]] = component[i]
    return edges


def _halved(members: DataFrame, *columns: str) -> DataFrame:
    """``members`` (key, doc_id, docs and ``columns``) dealt to tasks: all of a key's if they are few, else two blocks of them at a time."""
    cut = members.withColumn("of", F.ceil(F.col("docs") / F.lit(MEET)).cast("int"))
    cut = cut.withColumn("half", F.pmod(F.xxhash64("doc_id", "key"), F.col("of")).cast("int"))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    return cut.select("key", F.least("half", "with").alias("x"), F.greatest("half", "with").alias("y"), "half", "doc_id", *columns)


def _forests(members: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) that connect what is alike among the documents that meet, or among parts of them where they are many.

    ``members`` has key, doc_id, docs and shingles of the key, hashes, bits.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, hashes, bits = (table.column(c).to_pylist() for c in ("doc_id", "hashes", "bits"))
        edges = forest(ids, [np.frombuffer(h, np.uint64) for h in hashes], np.frombuffer(b"".join(bits), np.uint64).reshape(-1, BITS // 64), percent)
        return table_of_rows(edges, ("a", "b"), (pa.int64(), pa.int64()))

    parts = F.ceil(F.greatest(F.col("docs") / F.lit(MEET), F.col("shingles") / F.lit(MEET_SHINGLES)))
    dealt = members.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), parts).cast("int"))
    return dealt.select("key", "part", "doc_id", "hashes", "bits").groupBy("key", "part").applyInArrow(run, "a long, b long")


def close(component: np.ndarray, half: np.ndarray | None, size: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different components that neither their sizes nor their bit sketches rule out."""
    found = []
    for i in range(0, len(size), 32):  # a band of the matrix of pairs at a time
        rows = np.arange(i, min(i + 32, len(size)))
        may = (component[rows, None] != component) & (rows[:, None] < np.arange(len(size)))
        may &= np.minimum(size[rows, None], size) * 100 >= np.maximum(size[rows, None], size) * percent
        if half is not None:
            may &= half[rows, None] != half
        a, b = np.nonzero(may)
        a += i
        apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        near = apart * (100 + percent) <= (100 - percent) * (size[a] + size[b])
        found.append((a[near], b[near]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet and may be alike: ``members`` has key, doc_id, docs, component, n, bits."""
    dealt = _halved(members, "component", "n", "bits")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            cuts = _cuts(table)
            rest = table.slice(int(cuts[-2]))
            yield from groups(table, cuts[:-1])
        if rest is not None and rest.num_rows:
            yield from groups(rest, _cuts(rest))

    def _cuts(table: pa.Table) -> np.ndarray:
        """Where each group of rows begins, and the end."""
        key, x, y = (table.column(c).to_numpy() for c in ("key", "x", "y"))
        new = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        return np.concatenate(([0], np.flatnonzero(new) + 1, [len(key)]))

    def groups(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y, half, doc, component, n = (table.column(c).to_numpy() for c in ("x", "y", "half", "doc_id", "component", "n"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, e in zip(cuts.tolist(), cuts.tolist()[1:], strict=False):
            if e - s > 1:
                a, b = close(component[s:e], half[s:e] if x[s] != y[s] else None, n[s:e], bits[s:e], percent)
                out_a.append(doc[s + a])
                out_b.append(doc[s + b])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        once = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(once[1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have the similarity."""
    one = docs.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha"))
    other = docs.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(other, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, percent: int) -> DataFrame:
    """(node, component) of ``docs`` as _candidates makes them."""
    nodes = docs.select(F.col("doc_id").alias("node")).distinct()
    sketches = docs.select("doc_id", "n", F.explode("sketches").alias("s"))
    # first round: most of what is alike ends up in one component
    likely = sketches.select("doc_id", "n", F.explode(F.slice("s.keys", 1, PROBES)).alias("key"))
    sizes = likely.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")).where("docs > 1")
    likely = written(likely.select("doc_id", "key").join(sizes, "key"), "likely")
    edges = written(_forests(likely.join(docs.select("doc_id", "hashes", "bits"), "doc_id"), percent), "edges")
    found = written(components(nodes, edges), "components")
    discarded(likely)
    # second round: the guarantee, by the rarest blocks of each sketch
    keys = sketches.select("doc_id", "s.band", F.size("s.keys").alias("used"), F.expr("int(n div 3 + 1)").alias("offers"), F.explode("s.keys").alias("key"))
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    shared = keys.join(groups, "key")
    rank = F.row_number().over(Window.partitionBy("doc_id", "band").orderBy("docs", "key"))
    alone = F.col("used") - F.count(F.lit(1)).over(Window.partitionBy("doc_id", "band"))  # blocks of this document only: the rarest
    offered = written(shared.withColumn("rank", rank + alone).where("rank <= offers").select("key", "doc_id"), "offered")
    named = offered.join(found.withColumnRenamed("node", "doc_id"), "doc_id")
    open_keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("docs")).where("lo < hi")
    left = named.join(written(open_keys.select("key", "docs"), "open"), "key")
    pairs = written(_pairs(left.join(docs.select("doc_id", "n", "bits"), "doc_id"), percent), "pairs")
    discarded(offered)
    more = _verified(pairs, docs, percent).join(found.toDF("a", "ca"), "a").join(found.toDF("b", "cb"), "b")
    more = written(more.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "edges")
    discarded(pairs)
    # the components of components
    firsts = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
    joined = components(firsts, more).toDF("component", "first")
    return found.join(joined, "component", "left").select("node", F.coalesce("first", "component").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """For each row of ``docs`` that has an id: doc_id, n_shingles, component_id."""
    if not 75 <= percent <= 100:
        raise ValueError("the sketches are made for similarities of 0.75 or more")
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    whole = written(_sets(docs, percent), "sets")
    firsts = whole.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    some = written(_may_have_partners(whole, firsts), "partners")
    sets = written(whole.select("doc_id", "n", "digest"), "sizes")
    firsts = sets.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    discarded(whole)
    released(docs.sparkSession)
    # one plan at every size
    texts, salt = docs.join(some.hint("merge"), "doc_id", "left_semi").distinct(), 0
    found = written(_candidates(texts, salt), "candidates")
    while found.where("full").limit(1).count():  # never seen: less likely than one in 10 ** 40 a document
        discarded(found)
        salt += 1
        found = written(_candidates(texts, salt), "candidates")
    released(docs.sparkSession)
    named = written(links(found, percent), "components")
    discarded(found)
    rep = sets.select("doc_id", "n", "digest").join(firsts.withColumnRenamed("doc_id", "rep"), "digest")
    out = rep.join(named, rep["rep"] == named["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each component, of the smallest doc_id, and the rows without doc_id."""
    firsts = near_duplicates(docs, percent).where("doc_id = component_id").select(F.col("doc_id").alias("__pj_id")).distinct()
    kept = docs.join(firsts, docs["doc_id"] == F.col("__pj_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))
