import hashlib
import random

import numpy as np
import pytest

from ledgerlark.llm import anchors as A
from ledgerlark.llm import exchange as X
from ledgerlark.llm import queries
from ledgerlark.llm import suffix_dedup as D


def brute(rows, length):
    """(bytes, removed, spans, kept hash) by a dictionary of all strings."""
    smallest = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            smallest[w] = min(doc, smallest.get(w, doc))
    out = {}
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if smallest[raw[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[doc] = (len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, short = prose(30), "x" * 49
    out = [None, "", short, short, "y" * 50, "y" * 50, "y" * 51, "ab" * 200, "ab" * 100 + "c", "ba" * 90]
    for _ in range(60):
        body = prose(rng.randint(1, 80))
        cut = rng.randint(0, len(body))
        out.append(body[:cut] + rng.choice([passage, passage[: rng.randint(1, len(passage))], passage[rng.randint(0, 60) :], out[rng.randrange(4, len(out))], ""]) + body[cut:])
    for length in (1024, 2048):  # what sums of powers take for one, whatever the base
        bits = [bin(i).count("1") % 2 for i in range(length)]
        out += ["".join("ab"[x ^ y] for x in bits) for y in (0, 1)]
    out += [out[20], out[30], out[20], prose(4000) + passage + out[25]]
    return out


@pytest.mark.parametrize(("hot", "shard"), [(100_000, 5 << 20), (100_000, 1 << 10), (1, 1 << 10)])
def test_matches_brute_force(make_docs, texts, monkeypatch, hot, shard):
    monkeypatch.setattr(D, "HOT", hot)
    monkeypatch.setattr(X, "shard_bytes", lambda total: shard)
    assert result(D.dedup(make_docs(texts).selectExpr("*", "1 as shard", "2 as kept"))) == brute(list(enumerate(texts)), 50)


def test_hashes_of_parts(monkeypatch):
    rng = np.random.default_rng(5)
    b = rng.integers(97, 99, 4000, dtype=np.uint8)
    start = np.sort(rng.integers(0, 3900, 500))
    end = start + rng.integers(1, 100, 500)
    whole = D.substring_hashes(b, start, end)
    monkeypatch.setattr(D, "BLOCK", 64)
    assert (D.substring_hashes(b, start, end) == whole).all()
    parts = [b[i:j].tobytes() for i, j in zip(start, end, strict=True)]
    assert len({(p, h) for p, h in zip(parts, whole.tolist(), strict=True)}) == len(set(parts)) == len(set(whole.tolist()))
    for length in (1024, 2048, 8192):
        one = np.array([bin(i).count("1") % 2 for i in range(length)], np.uint8)
        both, zero = np.concatenate([one, 1 - one]), np.array([0, length])
        assert len(set(D.substring_hashes(both, zero, zero + length).tolist())) == 2


def test_rows_between_shards_and_buckets_grow_with_the_input():
    pairs = lambda total: (total / X.shard_bytes(total)) ** 2
    assert 4 < pairs(5 << 30) / pairs(1 << 30) < 6 and 55 < pairs(60 << 30) / pairs(1 << 30) < 65


def test_kept_bytes_and_empty(make_docs):
    docs = make_docs(["p" * 60 + "1", "a" + "p" * 55 + "b", "q"])
    assert {r.doc_id: bytes(r.kept) for r in D.dedup(docs).collect()} == {0: b"p" * 60 + b"1", 1: b"ab", 2: b"q"}
    assert D.dedup(make_docs([])).count() == 0
    assert D.dedup(docs.withColumn("doc_id", D.F.expr("nullif(doc_id, 0)"))).count() == 2
    twice = docs.union(docs)
    assert sorted((r.doc_id, r.n_removed) for r in D.dedup(twice).collect()) == [(0, 0), (0, 0), (1, 55), (1, 55), (2, 0), (2, 0)]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    a, b, w = (rng.integers(97, 101, n, dtype=np.uint8) for n in (300, 200, 50))
    x, y = np.concatenate([a, w, b]), np.concatenate([b, w, a])
    assert A.window_anchors(x, 50)[300] == A.window_anchors(y, 50)[200]
    assert len(A.window_anchors(w, 50)) == 1 and len(A.window_anchors(w[:49], 50)) == 0


@pytest.mark.parametrize("length", [16, 50, 56])
def test_refinement_is_the_merged_order(length):
    rng = np.random.default_rng(4)
    b = np.concatenate([np.tile(rng.integers(0, 3, 40, dtype=np.uint8), 5), rng.integers(0, 2, 300, dtype=np.uint8)])
    at = np.arange(len(b) - length + 1)
    order, begins = D.refined(b, at, length)
    strings = [b[i : i + length].tobytes() for i in order]
    assert strings == sorted(strings)
    assert begins.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


def test_query(spark, sample):
    assert result(queries.op4_suffix_dedup(spark, "/root/testdata/sf0.001")) == brute(sample, 50)
