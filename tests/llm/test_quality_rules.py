import re
from collections import Counter

import pytest

from ledgerlark.llm import quality_rules as Q
from ledgerlark.llm import queries


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


TEXTS = [
    None, "", "  \n\t ", "one", "a b c d e f g h " * 3, " ".join(map(str, range(100))), "x y z w v u t s q a b c d e f g h r x y z w v u t s " + " ".join(map(str, range(80))),
    "# l1 | <b>\n l1\nl1\n l1\n\n\n \n \r\nl1", "é日 " * 30_000, "a\x1fb c\x0bd\x0ce", "same text", "same text", "a a a a a a a a a a " + " ".join(map(str, range(40))),
]


def test_base_counts(make_docs):
    docs = make_docs(TEXTS).selectExpr("*", "1 as n_words", "2 as `dotted.name`").drop("n_words")
    trusted = docs.where("doc_id in (5, 6)")
    rows = {r.doc_id: r for r in Q.score_documents(docs, trusted).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), (i, t and t[:40])
        assert r.kept == (not r.base_failed and r.llr >= Q.Rules().min_score)
    assert rows[0].llr == rows[2].llr == 0 and rows[10].llr == rows[11].llr
    assert Q.filter_documents(docs, trusted).columns == docs.columns


def test_empty_tables(make_docs):
    docs = make_docs(["w " * 30])
    assert Q.score_documents(make_docs([]), docs).count() == 0
    assert Q.score_documents(docs, docs.limit(0)).count() == 1


def test_without_a_trusted_text_the_base_rules_decide(make_docs):
    clean = " ".join(f"word{i} and" for i in range(60))
    docs = make_docs([clean, clean + " more", "short", "w " * 30, None] + [clean] * 5)
    for trusted in (docs.limit(0), docs.where("doc_id = 4"), docs.selectExpr("doc_id + 100 as doc_id"), docs.selectExpr("cast(null as long) as doc_id")):
        rows = {r.doc_id: r for r in Q.score_documents(docs, trusted).collect()}
        assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in rows.values())
        assert {i for i, r in rows.items() if r.kept} == {0, 1, 5, 6, 7, 8, 9}
    assert Q.filter_documents(docs, docs.limit(0)).count() == 7


def test_log_ratio_is_that_of_the_two_multinomials(make_docs):
    import math

    docs, rules = make_docs(["a b", "a c c", None]), Q.Rules(buckets=8, smoothing=1.0)
    hashed = Q.window_hashes(docs.select("doc_id", Q.words_of(Q.F.coalesce("text", Q.F.lit(""))).alias("w")), "w", 2)
    b = {r[0]: [x % 8 for x in r[1]] for r in hashed.select("doc_id", Q.F.concat("__qr_h1", "__qr_h2")).collect()}
    raw, target = Counter(x for v in b.values() for x in v), Counter(b[0])
    share = sum(target.values()) / sum(raw.values())
    ratio = [math.log((target[i] + share) / (sum(target.values()) + 8 * share)) - math.log((raw[i] + 1) / (sum(raw.values()) + 8)) for i in range(8)]
    rows = {r.doc_id: r.llr for r in Q.score_documents(docs, docs.where("doc_id = 0"), rules).collect()}
    for i in (0, 1):
        assert rows[i] == pytest.approx(sum(ratio[x] for x in b[i]) / len(b[i]), abs=1e-5)


def test_query(spark, sample):
    rows = {r.doc_id: r for r in queries.op5_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    for i, t in sample:
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
    assert sum(r.kept for r in rows.values()) > 100
