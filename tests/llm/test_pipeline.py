import re

import corpus_pipeline
from ledgerlark.llm import quality_rules

from .test_decontamination import brute as contaminated
from .test_packing import check
from .test_parity_join import brute as linked
from .test_secret_scan import S

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, sample):
    """Each stage against its brute-force version, given what the stage before kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    quality, near, clean, secrets, pack = (f for _, f in corpus_pipeline.STAGES)
    verdict = {r.doc_id: r.kept for r in quality_rules.score_documents(docs, spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")).collect()}
    kept = corpus_pipeline.written(quality(spark, docs, SF))
    assert kept.columns == columns
    rows = dict(sample)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in rows if verdict[i])
    rows = {i: t for i, t in rows.items() if verdict[i]}
    kept = corpus_pipeline.written(near(spark, kept, SF))
    rows = {i: rows[i] for i in {c for _, c in linked(list(rows.items())).values()}}
    assert kept.columns == columns and {r.doc_id: r.text for r in kept.collect()} == rows
    kept = corpus_pipeline.written(clean(spark, kept, SF))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {i: rows[i] for i, (_, hit, _) in contaminated(list(rows.items()), items).items() if not hit}
    assert kept.columns == columns and {r.doc_id: r.text for r in kept.collect()} == rows
    kept = corpus_pipeline.written(secrets(spark, kept, SF))
    scanner = S.Scanner()
    rows = {i: S.redact(t, scanner.base(t)) for i, t in rows.items()}
    assert kept.columns == columns and {r.doc_id: r.text for r in kept.collect()} == rows
    assert not any(re.search("AKIA[A-Z0-9]{12}", t) for t in rows.values())
    check(pack(spark, kept, SF).collect(), rows, 1024)
    assert len(names) == 5


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns
