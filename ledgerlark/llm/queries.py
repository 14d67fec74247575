"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_rotation, decontamination, packing, parity_join, quality_net, quality_rules, secret_scan, suffix_dedup, toxicity, warc_revisit
from .tables import table


def op3_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """Captures made of all pages, each fetched and then found not modified, with the revisits resolved."""
    found = warc_revisit.resolve(warc_revisit.captures(table(spark, folder, "pages")))
    return found.select("record_id", "canonical", "outcome", "response_id", warc_revisit.header_lines(F.col("headers")).alias("headers"), F.md5("body").alias("body_md5"), F.octet_length("body").cast("long").alias("body_bytes"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that earlier documents have."""
    found = suffix_dedup.dedup(table(spark, folder, "documents"), bytes_too=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdict of every document; the trusted target is what ``labels`` marks as quality 1."""
    trusted = table(spark, folder, "labels").where(F.col("quality") == 1)
    scored = quality_rules.score_documents(table(spark, folder, "documents"), trusted)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The secrets of every document, counted and listed."""
    found = secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), of("entropy").alias("n_entropy"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in 10-word windows of ``benchmark``."""
    found = decontamination.find(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    hit = decontamination.n_hit()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary files are installed; every machine has them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def _fold(parts: int, of: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == of


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document, learned from labels outside the held-out third."""
    known = table(spark, folder, "labels").where(~_fold(3, 1)).select("doc_id", F.col("quality").alias("label"))
    scored = quality_net.score_documents(table(spark, folder, "documents"), known)
    return scored.select("doc_id", _fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_chat_rotation(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations from the perspective of each participant."""
    return chat_rotation.rotate(table(spark, folder, "conversations"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity score of every document, learned from labels outside the held-out quarter."""
    known = table(spark, folder, "labels").where(~_fold(4, 2)).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score_documents(table(spark, folder, "documents"), known)
    return scored.select("doc_id", _fold(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return parity_join.near_duplicates(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_decontamination": op2_decontamination,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_chat_rotation": op8_chat_rotation,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontamination.ORACLE,
    "op3_warc_revisits": warc_revisit.ORACLE,
    "op8_chat_rotation": chat_rotation.ORACLE,
}
