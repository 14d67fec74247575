"""Every per-document operator over rows in which any column may be null."""

import pytest

from ledgerlark.llm import decontamination, packing, queries, quality_net, quality_rules, secret_scan, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(None, "no id, token=abcdefgh", None, None, None), (1, None, None, None, None), (None, None, None, None, None), (2, "some words", "en", "s", 10), (2, "some words", "en", "s", 10)], SCHEMA)


def test_rows_without_id_or_text_stay(spark, docs):
    bench = spark.createDataFrame([(None, "some words"), (1, None)], "item_id long, text string")
    labels = spark.createDataFrame([(2, 1), (None, 0), (1, None), (1, 0)], "doc_id long, label int")
    assert secret_scan.scan(docs).count() == secret_scan.redacted(docs).count() == 5
    found = decontamination.find(docs, bench).collect()
    assert len(found) == 5 and sum(r["items"] == [""] for r in found) == 2
    assert quality_rules.score_documents(docs, labels.select("doc_id")).count() == 5
    for module in (quality_net, toxicity):
        assert module.score_documents(docs, labels).count() == 5
    assert packing.pack(docs, queries.tokenizer_path()).count() == 5
