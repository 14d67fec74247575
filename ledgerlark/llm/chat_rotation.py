"""Multi-party perspective rotation of dialogues, as Spark expressions only.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and the others as named users; only the assistant's turns are to be learned from. The
result has a row for each perspective and turn, so a conversation of any length is never gathered
into one task. A perspective's dialogue is its ``rendered`` texts one after another: ``start`` is the
place of each in it, so that the loss mask covers ``learn_length`` code points from
``start + learn_start`` on.

Turns are in the order of ``turn`` (null first), then of speaker and text; equal rows are
interchangeable. They are cut into blocks in that order by ranges, so that a conversation with a
third of all rows is many blocks, and places are sums over the blocks before and within a block. Of
a perspective's own turns only the mark in front differs from what others see, so one sum does for all.

A participant is a distinct ``role`` that speaks in the conversation; a system turn is nobody's
perspective and stays a system turn in all of them. Marks in texts and names (``<|`` and ``|>``) get
a space in between, and line ends in names become spaces, so that nothing that was said reads as a turn.

Defined edge cases: null roles and null texts count as empty ones, and an empty role is a speaker
named ``someone``; turns without a conversation (null ``conv_id``) belong to none and are dropped;
a conversation of system turns alone has no perspective; repeated turns are rendered as often as
they occur; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SYSTEM = "system"
NOBODY = "someone"
END = "<|end|>\n"
#: Turns a block, about.
BLOCK = 50_000


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def head(role: Column, name: Column) -> Column:
    """The mark in front of a turn; ``name`` is empty for none."""
    plain = F.replace(F.translate(escaped(name), "\r\n", "  "), F.lit("|>"), F.lit("| >"))
    return F.concat(F.lit("<|"), role, F.when(name == "", F.lit("")).otherwise(F.concat(F.lit(":"), plain)), F.lit("|>\n"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, role, name, content, learn, rendered, start, learn_start, learn_length.

    ``learn`` marks the assistant's turns; ``learn_start`` and ``learn_length`` are the code points of
    ``rendered`` that the loss mask covers (nothing for other turns).
    """
    speaker = F.when(F.coalesce("role", F.lit("")) == "", NOBODY).otherwise(F.col("role"))
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("content"))
    blocks = max(1, -(-turns.count() // BLOCK))
    order = ["conv_id", "turn", "speaker", "content"]
    # written, so that a turn's block is the same wherever it is read
    turns = written(turns.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id()), "turns")
    system = F.col("speaker") == SYSTEM
    seen = F.length(head(F.when(system, SYSTEM).otherwise("user"), F.when(system, "").otherwise(F.col("speaker"))))
    turns = turns.withColumn("size", seen + F.length(escaped(F.col("content"))) + len(END))
    # few rows a conversation and block; what is said before a block, by all and by each
    by_block = turns.groupBy("conv_id", "block", "speaker").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("spoken"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    before = by_block.groupBy("conv_id", "block").agg(F.sum("size").alias("size"))
    before = before.select("conv_id", "block", F.coalesce(F.sum("size").over(ahead.partitionBy("conv_id")), zero).alias("ahead"))
    who = by_block.where(~system).groupBy("conv_id", "speaker").agg(F.lit(1).alias("one")).select("conv_id", F.col("speaker").alias("perspective"))
    said = before.select("conv_id", "block").join(who, "conv_id").join(by_block.select("conv_id", "block", F.col("speaker").alias("perspective"), "spoken"), ["conv_id", "block", "perspective"], "left")
    said = said.select("conv_id", "block", "perspective", F.coalesce(F.sum("spoken").over(ahead.partitionBy("conv_id", "perspective")), zero).alias("said"))
    numbered = Window.partitionBy("conv_id", "block").orderBy("turn", "speaker", "content")
    placed = turns.withColumn("row", F.row_number().over(numbered))
    within = Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(within.partitionBy("conv_id", "block")), zero)).drop("size")
    out = placed.join(before, ["conv_id", "block"]).join(said, ["conv_id", "block"])
    own = F.col("speaker") == F.col("perspective")
    mine = F.col("said") + F.coalesce(F.sum(own.cast("long")).over(within.partitionBy("conv_id", "block", "perspective")), zero)
    out = out.withColumns({
        "role": F.when(system, SYSTEM).when(own, "assistant").otherwise("user"),
        "name": F.when(system | own, F.lit("")).otherwise(F.col("speaker")),
        "learn": own,
        # each own turn before this one has the assistant's mark in front instead of a user's
        "start": F.col("ahead") + F.col("inside") + mine * (F.length(head(F.lit("assistant"), F.lit(""))) - F.length(head(F.lit("user"), F.col("perspective")))),
    })
    mark, said_here = head(F.col("role"), F.col("name")), escaped(F.col("content"))
    out = out.withColumn("rendered", F.concat(mark, said_here, F.lit(END)))
    # the mask covers what the assistant says and the end mark
    return out.select(
        "conv_id", "perspective", "turn", "role", "name", "content", "learn", "rendered", F.col("start").cast("long").alias("start"),
        F.when(F.col("learn"), F.length(mark)).otherwise(0).cast("long").alias("learn_start"),
        F.when(F.col("learn"), F.length(said_here) + len("<|end|>")).otherwise(0).cast("long").alias("learn_length"),
    )


ORACLE = """
WITH turns AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'someone' ELSE role END AS speaker, coalesce(text, '') AS content
  FROM conversations WHERE conv_id IS NOT NULL
), who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
rotated AS (
  SELECT conv_id, perspective, turn, speaker, content, speaker = perspective AS learn,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN speaker = 'system' OR speaker = perspective THEN '' ELSE speaker END AS name
  FROM turns JOIN who USING (conv_id)
), headed AS (
  SELECT *, replace(content, '<|', '< |') AS said,
    '<|' || role || CASE WHEN name = '' THEN '' ELSE ':' || replace(translate(replace(name, '<|', '< |'), chr(13) || chr(10), '  '), '|>', '| >') END || '|>' || chr(10) AS head
  FROM rotated
), whole AS (SELECT *, head || said || '<|end|>' || chr(10) AS rendered FROM headed)
SELECT conv_id, perspective, turn, role, name, content, learn, rendered,
  CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  CAST(CASE WHEN learn THEN length(head) ELSE 0 END AS BIGINT) AS learn_start,
  CAST(CASE WHEN learn THEN length(said) + 7 ELSE 0 END AS BIGINT) AS learn_length
FROM whole
"""
