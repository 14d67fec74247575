"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio.

Everything here is a Spark expression; no Python runs on the executors.

Defined edge cases: a null text counts as an empty one; an empty or all-blank text has zero
words, fails the base rules and scores 0; without a trusted text that has words every text scores 0,
so that the base rules alone decide; repeated ``doc_id`` rows are scored one by one; an
empty table gives an empty result; other columns pass through, where :func:`score_documents` replaces
those named like its results and :func:`filter_documents` replaces none (helper columns carry a
``__qr_`` prefix).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import quoted

NOT_BLANK = "[^ \\t\\n\\x0B\\f\\r]"
BLANK_RUN = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "[#*$%&|<>]"
#: Log ratios are summed as whole numbers of this many parts, so a sum has one value in any order.
PARTS = 1_000_000


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    buckets: int = 1 << 16
    smoothing: float = 8.0
    min_score: float = -0.2


def words_of(text: Column) -> Column:
    """The runs of characters other than space and U+0009 to U+000D."""
    return F.filter(F.split(text, BLANK_RUN), lambda w: w != "")


MOST = 1 << 30


def window_hashes(docs: DataFrame, words: str, window: int = 8) -> DataFrame:
    """Adds ``__qr_h``: a 64-bit hash of each window of ``window`` words, built by doubling.

    Each step is a column of its own, so that it is computed once: ``__qr_h1`` has a hash of each
    word and ``__qr_h2`` of each word with the next one, the last word's with nothing.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    out, step = docs.withColumn("__qr_h1", F.transform(words, lambda w: F.xxhash64(w))), 1
    while step < window:
        h = f"__qr_h{step}"
        out = out.withColumn(f"__qr_h{2 * step}", F.zip_with(h, F.slice(h, step + 1, MOST), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    # the last window - 1 of them reach beyond the text
    out = out.withColumn("__qr_h", F.slice(f"__qr_h{window}", F.lit(1), F.greatest(F.size(words) - (window - 1), F.lit(0))))
    return out


def repeat_words(docs: DataFrame, words: str, window: int = 8) -> DataFrame:
    """Adds ``n_repeat_words``: how many words lie in windows found twice or more in the text.

    Nearly all texts repeat no window: a hash set tells so, and only the others are sorted. Each
    step is a column of its own, so that it is computed once.
    """
    empty = F.array().cast("array<struct<x:bigint,i:int>>")
    out = window_hashes(docs, words, window)
    by_hash = F.array_sort(F.transform("__qr_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.withColumn("__qr_s", F.when(F.size(F.array_distinct("__qr_h")) == F.size("__qr_h"), empty).otherwise(by_hash))
    rest = F.greatest(F.size("__qr_s") - 1, F.lit(0))
    none = F.array(F.lit(None).cast("struct<x:bigint,i:int>"))
    # a window is repeated if the one before or behind it in hash order equals it
    out = out.withColumn("__qr_z", F.when(F.size("__qr_s") > 0, F.arrays_zip(F.concat(none, F.slice("__qr_s", F.lit(1), rest)).alias("b"), F.col("__qr_s").alias("m"), F.concat(F.slice("__qr_s", F.lit(2), rest), none).alias("a"))))
    same = lambda p, q: F.coalesce(p["x"] == q["x"], F.lit(False))
    hits = F.filter("__qr_z", lambda z: same(z["b"], z["m"]) | same(z["m"], z["a"]))
    out = out.withColumn("__qr_at", F.array_sort(F.transform(hits, lambda z: z["m"]["i"])))
    rest = F.greatest(F.size("__qr_at") - 1, F.lit(0))
    gaps = F.zip_with(F.slice("__qr_at", F.lit(2), rest), F.slice("__qr_at", F.lit(1), rest), lambda q, p: F.least(q - p, F.lit(window)))
    covered = F.aggregate(gaps, F.lit(window), lambda acc, g: acc + g)
    return out.withColumn("n_repeat_words", F.when(F.size("__qr_at") > 0, covered).otherwise(0).cast("long"))


def base_columns(docs: DataFrame, text: Column, rules: Rules) -> DataFrame:
    """Adds ``__qr_words`` and the base counts."""
    out = docs.withColumn("__qr_text", F.coalesce(text, F.lit("")))
    t = F.col("__qr_text")
    out = out.withColumns({"__qr_words": words_of(t), "__qr_lines": F.filter(F.split(t, "\n"), lambda s: F.rlike(s, F.lit(NOT_BLANK)))})
    out, w = repeat_words(out, "__qr_words", rules.window), F.col("__qr_words")
    return out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join("__qr_words", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__qr_lines") - F.size(F.array_distinct("__qr_lines"))).cast("long"),
    })


def bucket(h: Column, rules: Rules) -> Column:
    return F.pmod(h, F.lit(rules.buckets)).cast("int")


def _grams(docs: DataFrame, rules: Rules) -> DataFrame:
    """A row with its bucket for each word and each pair of neighbouring words."""
    words = docs.select(words_of(F.coalesce("text", F.lit(""))).alias("w"))
    grams = window_hashes(words, "w", 2).select(F.concat("__qr_h1", "__qr_h2").alias("g"))
    return grams.select(F.explode("g").alias("h")).select(bucket(F.col("h"), rules).alias("b"))


def _may_be_among(docs: DataFrame, ids: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be one of ``ids``: most others leave here, before their texts are moved.

    The ids' hashes are marked in bitmaps of ``bits`` bits together (8 MB, whatever the input's size).
    With very many ids fewer rows leave, and nothing else changes.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits)) + 1
    marks = ids.select(place("__qr_id").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__qr_number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__qr_map"))
    out = docs.withColumn("__qr_p", place("doc_id"))
    out = out.join(F.broadcast(marks), F.bitmap_bucket_number("__qr_p") == F.col("__qr_number"))
    at = "bitmap_bit_position(__qr_p)"
    marked = F.expr(f"shiftright(cast(conv(hex(substring(__qr_map, cast({at} div 8 as int) + 1, 1)), 16, 10) as int), cast({at} % 8 as int)) & 1") == 1
    return out.where(marked).select(*quoted(docs.columns))


def log_ratios(docs: DataFrame, trusted: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row with ``ratios``: for each bucket, log P(bucket | trusted) - log P(bucket | raw), in parts.

    Both multinomials are counted over every row of ``docs``; ``trusted`` holds the doc_ids of
    the target. The result has ``rules.buckets`` numbers whatever the input's size, all 0 if the
    target has no word.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("__qr_id")).where("__qr_id is not null").distinct()
    of = lambda df: _grams(df, rules).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    # an inner join with distinct ids: a semi-join would be pushed below the bitmaps, to where all texts are; one plan at every size
    target = of(_may_be_among(docs.select("doc_id", "text"), ids).join(ids.hint("merge"), F.col("doc_id") == F.col("__qr_id")))
    zero = F.lit(0).cast("long")
    counts = of(docs.select("text")).select("b", F.col("n").alias("raw"), zero.alias("target")).unionByName(target.select("b", zero.alias("raw"), F.col("n").alias("target")))
    # absent buckets carry the smoothing alone
    every = docs.sparkSession.range(rules.buckets).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target"))
    full = counts.select("b", "raw", "target").unionByName(every).groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    row = full.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("c"), F.try_divide(F.sum("target"), F.sum("raw")).alias("share"))
    known = F.coalesce(F.col("share") > 0, F.lit(False))
    row = row.select("c", known.alias("known"), F.when(known, F.col("share")).otherwise(1.0).alias("share"))
    # pseudo-counts in proportion to the two sizes, so that a rare n-gram says little either way
    ratio = lambda x: F.log((x["target"] + rules.smoothing * F.col("share")) / F.col("share") / (x["raw"] + F.lit(rules.smoothing)))
    return row.select(F.transform("c", lambda x: F.when(F.col("known"), F.round(ratio(x) * PARTS).cast("long")).otherwise(F.lit(0).cast("long"))).alias("ratios"))


def score_documents(docs: DataFrame, trusted: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All columns of ``docs`` and the base counts, ``llr`` (mean log ratio of an n-gram), ``base_failed``, ``kept``."""
    # one row of rules.buckets numbers, whatever the input's size; the optimizer folds the cast to a constant
    ratios = F.split(F.lit(",".join(map(str, log_ratios(docs, trusted, rules).first()[0]))), ",").cast("array<bigint>")
    out = base_columns(docs, F.col("text"), rules)
    add = lambda acc, h: acc + F.get(ratios, bucket(h, rules))
    total = F.aggregate("__qr_h2", F.aggregate("__qr_h1", F.lit(0).cast("long"), add), add)
    out = out.withColumn("llr", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words")) / PARTS).otherwise(0.0))
    out = out.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= rules.min_score))
    return out.drop(*[c for c in out.columns if c.startswith("__qr_")])


def filter_documents(docs: DataFrame, trusted: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns."""
    # the columns go by place, whatever their names are
    own = [F.col(q).alias(f"__in_{i}") for i, q in enumerate(quoted(docs.columns))]
    # a filter on ``kept`` alone would be pushed below the steps, each step written out wherever it is
    # used again; it stays above a column that is not deterministic
    scored = score_documents(docs.select("doc_id", "text", *own), trusted, rules).withColumn("__qr_row", F.monotonically_increasing_id())
    kept = scored.where(F.col("kept") & (F.col("__qr_row") >= 0))
    return kept.select(*[F.col(f"__in_{i}").alias(c) for i, c in enumerate(docs.columns)])
