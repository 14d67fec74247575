import random
import re

import numpy as np
import pytest

from ledgerlark.llm import exchange as X
from ledgerlark.llm import parity_join as P
from ledgerlark.llm import queries

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    by_size = sorted(sets, key=lambda s: len(s[1]))
    for k, (i, a) in enumerate(by_size):
        for j, b in by_size[k + 1 :]:
            if 100 * len(a) < 75 * len(b):
                break
            if a and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(rng, words, rate):
    return [rng.choice("qwertyuiop") + str(rng.randrange(99)) if rng.random() < rate else w for w in words]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (3, 5, 7, 12, 40, 120, 400)]
    out = [None, "", " \n", "one", "one", "ONE", "one two", "two one", " ".join(base[4]).upper(), "x " * 30_000]
    for b in base:
        for rate in (0, 0.01, 0.02, 0.03, 0.05):
            out += [" ".join(edited(rng, b, rate)) for _ in range(4)]
    chain = list(base[5])
    for _ in range(12):  # neighbours are alike, the ends are not
        chain = edited(rng, chain, 0.02)
        out.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(30))
    out += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 60))) for _ in range(60)]
    return out


@pytest.mark.parametrize(("meet", "small"), [(2048, 256), (3, 4)])
def test_matches_brute_force(make_docs, texts, monkeypatch, meet, small):
    monkeypatch.setattr(P, "MEET", meet)
    monkeypatch.setattr(P, "SMALL", small)
    assert result(P.near_duplicates(make_docs(texts))) == brute(list(enumerate(texts)))


def test_a_sketch_that_is_too_full_gets_another_salt(make_docs, texts, monkeypatch):
    real, salts = P.sketch, []

    def crowded(hashes, band, least, salt=0):
        return real(hashes, band, least, salt)[: 1 if salt == 0 else None]

    original = P._candidates
    monkeypatch.setattr(P, "_candidates", lambda docs, salt: salts.append(salt) or original(docs, salt).withColumn("full", P.F.lit(salt == 0)))
    some = texts[:60]
    assert result(P.near_duplicates(make_docs(some))) == brute(list(enumerate(some)))
    assert salts == [0, 1] and crowded(np.arange(9, dtype=np.uint64), 1, 5).size == 1


def test_words_that_fool_powers_are_told_apart(make_docs):
    """The word of Thue and Morse and its complement have one sum of powers, whatever the base."""
    docs = []
    for length in (1024, 2048, 8192):
        bits = [bin(i).count("1") % 2 for i in range(length)]
        docs += ["".join("ab"[x ^ y] for x in bits) for y in (0, 1)]
    assert {c for _, c in result(P.near_duplicates(make_docs(docs))).values()} == set(range(6))
    words = [d.encode() for d in docs]
    assert len({int(h[0]) for h in P.shingles(words)}) == 6


def test_sketches_differ_in_at_most_the_symmetric_difference():
    rng = np.random.default_rng(1)
    for n in (5, 80, 500):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 10 + 1, dtype=np.uint64)]))
        x, y = (set(P.sketch(s, 3, 300).tolist()) for s in (a, b))
        assert len(x - y) <= len(np.setxor1d(a, b)) and len(y - x) <= len(np.setxor1d(a, b))


def test_partners_have_first_shingles_in_common():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 19, 20, 21, 80, 81, 400):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([rng.permutation(a)[: -(-9 * n // 10)], rng.integers(0, 1 << 63, n // 12, dtype=np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
                (ka, need_a), (kb, need_b) = (P.first_shingles(len(s), 75) for s in (a, b))
                assert len(np.intersect1d(a[:ka], b[:kb])) >= max(need_a, need_b)


def test_bit_sketches_are_a_lower_bound():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    for k in (1, 50, 1500):
        x, y = P.bit_sketches([a[k:], a[:-k]])
        assert np.bitwise_count(x ^ y).sum() <= 2 * k  # k hashes on either side


def test_packed_round_trip():
    a = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 1000, dtype=np.uint64) << np.uint64(1))
    assert (X.unpacked(X.packed(a)) == a).all() and len(X.unpacked(b"")) == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 330)]
    parent = {i: i for i in range(331)}
    for _ in range(331):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    nodes = spark.range(331).withColumnRenamed("id", "node")
    assert {r.node: r.component for r in X.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()} == parent


def test_one_of_each_and_empty(make_docs, texts, spark):
    docs = make_docs(texts).selectExpr("*", "1 as n", "2 as hashes")
    want = brute(list(enumerate(texts)))
    assert sorted(r.doc_id for r in P.one_of_each(docs).collect()) == sorted({c for _, c in want.values()})
    assert P.near_duplicates(make_docs([])).count() == 0


def test_rows_that_repeat_or_have_no_id(make_docs):
    rows = make_docs(["a b c d e f", "x", "none none", "u v w"]).withColumn("doc_id", P.F.expr("nullif(doc_id, 2)"))
    again = make_docs(["a b c d e f", "x"]).union(make_docs(["q r"]).selectExpr("5l", "text", "lang", "source", "n_chars")).union(make_docs(["x"]).selectExpr("5l", "text", "lang", "source", "n_chars"))
    found = P.near_duplicates(rows.union(again))
    assert sorted(map(tuple, found.collect())) == [(0, 2, 0), (0, 2, 0), (1, 1, 1), (1, 1, 1), (3, 1, 3), (5, 1, 1), (5, 1, 5)]
    # rows without an id stay; of equal rows one does
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in P.one_of_each(rows.union(again)).collect())
    assert [k for k in kept if k != (5, "x")] == [(-1, "none none"), (0, "a b c d e f"), (1, "x"), (3, "u v w"), (5, "q r")]


def test_query(spark, sample):
    assert result(queries.op10_ngram_jaccard_join(spark, "/root/testdata/sf0.001")) == brute(sample)
