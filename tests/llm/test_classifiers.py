import itertools
import re
import zlib

import numpy as np
import pytest

from ledgerlark.llm import quality_net as N
from ledgerlark.llm import queries
from ledgerlark.llm import toxicity as T

SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def brute_kernel(s, t, decay):
    """Common subsequences of three characters, weighted by the lengths they span."""

    def spans(x):
        out = {}
        for a, b, c in itertools.combinations(range(len(x)), 3):
            out[x[a] + x[b] + x[c]] = out.get(x[a] + x[b] + x[c], 0) + decay ** (c - a + 1)
        return out

    p, q = spans(s), spans(t)
    return sum(v * q.get(k, 0) for k, v in p.items())


def test_kernel_matches_brute_force():
    words = ["idiot", "i-d-i-o-t", "idxiot", "stupid", "aaaa", "ab", "réeux", "trash"]
    for s, t in itertools.product(words, words):
        got = T.kernel(T.coded([s], len(s)), T.coded([t], len(t)), 0.8)[0]
        assert got == pytest.approx(brute_kernel(s, t, 0.8), rel=1e-4, abs=1e-6)


def test_gapped_insults_come_near():
    f = T.Features(["idiot", "stupid", "worthless"], T.Settings())
    assert set(f.near(["idiot", "iidiot", "idi0ot", "stuupid", "garden", "wortthless", ""])) == {"idiot", "iidiot", "idi0ot", "stuupid", "wortthless"}
    assert "idiot" in T.words_of("you i d i o t !")[-1] and T.words_of("an i-d-i-o-t!!")[1] == "idiot" and len(T.words_of("x" * 100)) > 4
    assert T.words_of("") == []


DISTORTED = {"idiot": ["ixdxixoxt", "idxxiot", "i0diot"], "moron": ["mxxoron", "mxoxrxoxn", "m0r0n"], "stupid": ["sxtxuxpxixd", "stvpid", "stuuupid"], "loser": ["lxxoser", "l0ser"], "scum": ["sxxcum", "scvuuum"]}


def test_every_kernel_value_is_a_feature():
    names = [*DISTORTED, "worthless"]
    f = T.Features(names, T.Settings())
    words = [*itertools.chain(*DISTORTED.values()), *names, "garden", "1d10t", "ab", "worththeless" * 2]
    norm = lambda w: brute_kernel(w, w, 0.8) ** 0.5
    want = np.array([[brute_kernel(w, n, 0.8) / max(norm(w) * norm(n), 1e-9) for n in names] for w in words])
    got = f.values(words)
    assert np.allclose(got, want, rtol=1e-3, atol=1e-6) and ((got > 0) == (want > 0)).all()
    assert set(f.near(words)) == {w for w, v in zip(words, want, strict=True) if v.any()}
    for insult, distorted in DISTORTED.items():
        for w in distorted:
            assert got[words.index(w), names.index(insult)] > 0 and f.of([f"a {w} b"]).any(), w


def test_distorted_insults_on_held_out_texts(spark, make_docs):
    """Insults with several characters put in or changed, none of which the machine was fitted on."""
    calm = ["garden path by the window", "plain table under a lamp", "we walk home at night", "bread and butter today"]
    texts = [f"{c} you {i}" for c in calm for i in DISTORTED] + calm * 5
    held = ["bring the green lamp", *[f"bring the green lamp {w}" for v in DISTORTED.values() for w in v]]
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, label int")
    rows = {r.doc_id: r.score for r in T.score_documents(make_docs(texts + held), labels).collect()}
    # where next to nothing of the insult is left, the kernel's power is too small to tell
    faint = {"bring the green lamp mxoxrxoxn", "bring the green lamp ixdxixoxt", "bring the green lamp sxtxuxpxixd"}
    assert all(rows[i] > rows[40] or held[i - 40] in faint for i in range(41, 40 + len(held))), {held[i - 40]: rows[i] for i in range(40, 40 + len(held))}


def test_scores_match_brute_force(spark, make_docs):
    """Landmarks, features, machine and curve once more, from the definition of the kernel, on a small table."""
    insults = ["idiot", "moron", "stupid"]
    texts = [f"we walk home number {i}. you {insults[i % 3]} go. the end" if i % 2 else f"we walk home number {i}. kind words here. the end" for i in range(24)] + ["you mxoron", "calm walk", "i d i o t"]
    labels = [(i, i % 2) for i in range(24)]
    s = T.Settings(landmarks=(4, 3), least=2)
    got = {r.doc_id: r.score for r in T.score_documents(make_docs(texts), spark.createDataFrame(labels, "doc_id long, label int"), s).collect()}
    names = T.landmarks(make_docs(texts).join(spark.createDataFrame(labels, "doc_id long, label int"), "doc_id"), s)
    assert set(insults) & set(names) and set(names) - set(insults)
    norm = lambda w: brute_kernel(w, w, s.decay) ** 0.5
    k = lambda a, b: (brute_kernel(a, b, s.decay) / (norm(a) * norm(b))) ** s.power if len(a) > 2 else 0.0
    gram = np.array([[k(a, b) for b in names] for a in names])
    values, vectors = np.linalg.eigh(gram)
    whiten = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T

    def features(text):
        raw = np.array([[k(w, n) for n in names] for w in T.words_of(text)] or [[0.0] * len(names)])
        return np.concatenate([raw.max(0) @ whiten, np.log1p(raw.sum(0)) @ whiten])

    cut = lambda t: [p for p in re.split(T.SENTENCE_END, t) if p.strip()]
    rows = [(features(p), y, 1.0 if j == 0 else 1 / len(cut(texts[i])), j == 0) for i, y in labels for j, p in enumerate([texts[i], *cut(texts[i])])]
    x, y, weight, whole = (np.array(c) for c in zip(*rows, strict=True))
    w, bias, slope, shift = T.machine(x, y.astype(float), weight, whole, s.penalty)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(slope * (features(t) @ w + bias) + shift))), abs=1e-3), t


def held_out(spark, folder, query, label, parts, of):
    df = query(spark, folder)
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == of)
    pairs = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in pairs if y == 1], [s for s, y, _ in pairs if y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]), np.mean([p == y for _, y, p in pairs])


def test_quality_on_held_out_rows(spark):
    auc, accuracy = held_out(spark, SMALL, queries.op7_quality_classifier, "quality", 3, 1)
    assert auc > 0.9 and accuracy > 0.9


def test_toxicity_on_held_out_rows(spark):
    auc, accuracy = held_out(spark, LARGE, queries.op9_toxicity, "toxic", 4, 2)
    assert auc > 0.9 and accuracy > 0.9


@pytest.mark.parametrize("module", [N, T])
def test_edge_cases(spark, make_docs, module):
    texts = [None, "", " \n ", "plain words here", "you idiot", "x" * 60_000 + " é" * 10_000, "same", "same"] + ["you idiot moron " * 3, "kind words " * 3] * 8
    docs = make_docs(texts).selectExpr("*", "1 as label", "2 as score")
    labels = spark.createDataFrame([(i, int("idiot" in (t or ""))) for i, t in enumerate(texts)] + [(None, 1), (3, None), (999, 1)], "doc_id long, label int")
    rows = {r.doc_id: r.score for r in module.score_documents(docs, labels).collect()}
    assert len(rows) == len(texts) and all(0 <= s <= 1 for s in rows.values())
    assert rows[0] == rows[1] == rows[2] and rows[6] == rows[7]
    assert rows[8] > rows[9]
    assert len({r.score for r in module.score_documents(docs, labels.limit(0)).collect()}) == 1
    assert module.score_documents(make_docs([]), labels).count() == 0


def test_word_vectors_are_sums_of_neighbours(make_docs):
    s = N.Settings(words=64, size=8, reach=2)
    docs = make_docs(["a b c d", None, "e a", "b c d e f g"]).repartition(3)
    places, signs = N.index_vectors(s)
    total = np.zeros((64, 8))
    for text in ("a b c d", "e a", "b c d e f g"):
        (row, _), *_ = N.rows_of([text.encode()], s)
        for i in range(len(row)):
            for j in range(len(row)):
                if i != j and abs(i - j) <= 2:
                    np.add.at(total[row[i]], places[row[j]], signs[row[j]])
    want = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)
    assert np.allclose(N.word_vectors(docs, s, fan_in=2), want, atol=1e-6)
