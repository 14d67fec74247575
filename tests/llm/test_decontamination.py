import hashlib
import re

import numpy as np
import pytest

from ledgerlark.llm import decontamination as D
from ledgerlark.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if who := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= who
        out[doc] = (len(w), len(hit), sorted(found))
    return out


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, None), (4, "..."), (10, "one two THREE four five six seven eight nine ten"), (10, "short ITEM")]
TEXTS = [
    None, "", "...", "a short-item here, short item", "x one two three four five six seven eight nine ten eleven y", "one two three four five six seven eight nine",
    "ONE, two. three four five six seven eight nine ten, short item", "é" * 70_000 + " short item " + "w " * 5000, "short item", "short item",
]


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_matches_brute_force(spark, make_docs, block):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(enumerate(TEXTS), ITEMS)
    for r in D.find(make_docs(TEXTS), bench, broadcast_bytes=block).collect():
        assert (r.n_words, sum(h["last"] - h["first"] for h in r.hits), r["items"]) == want[r.doc_id]
        raw = (r.text or "").encode()
        assert [w for h in r.hits for w in words(raw[h["start"] : h["end"]].decode())] == [w for h in r.hits for w in words(r.text)[h["first"] : h["last"]]]


def test_other_columns(spark, make_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make_docs(TEXTS).selectExpr("*", "1 as n_words", "'x' as Hits", "2 as item", "3 as `dotted.name`", "4 as block")
    found = D.find(docs, bench)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "item", "dotted.name", "block", "n_words", "hits", "items"]
    assert D.clean(docs, bench).columns == [*docs.columns[:-5], *docs.columns[-5:]]
    assert {r.doc_id: r.n_words for r in found.collect()} == {i: len(words(t)) for i, t in enumerate(TEXTS)}


def test_unequal_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(D, "ngrams", lambda h, n: np.full(max(len(h) - n + 1, 0), 5, np.uint64))
    rows = [("a", "p q"), ("b", "r s t"), ("c", "q p"), ("d", "p q")]
    (n, runs, items), = D.Windows(rows, 2).search([b"x p q r"])
    assert (n, [r[:2] for r in runs], items) == (4, [(1, 3)], {"a", "d"})


def test_windows_take_little_memory():
    """A mebibyte of benchmark and its windows: arrays, no objects."""
    rng = np.random.default_rng(0)
    text = " ".join(map(str, rng.integers(0, 10**6, 150_000)))
    w = D.Windows([("a", text)], 10)
    size = len(w.words) + sum(x.nbytes for k in w.sorted.values() for x in (k.hash, k.start, k.end, k.item, k.maybe))
    assert size < 6 * len(text) and len(w.sorted[10].hash) == 150_000 - 9


def test_clean(spark, make_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make_docs(TEXTS)
    assert sorted(r.doc_id for r in D.clean(docs, bench).collect()) == [0, 1, 2, 5]
    out = {r.doc_id: r.text for r in D.clean(docs, bench, "remove").collect()}
    assert out[0] is None and out[4] == "x   y" and out[3] == "a   here,  " and out[5] == TEXTS[5]
    assert D.clean(make_docs([]), bench).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == len(TEXTS)


def test_query(spark, sample):
    folder = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(sample, items)
    rows = queries.op2_decontamination(spark, folder).collect()
    assert len(rows) == len(sample) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest())
