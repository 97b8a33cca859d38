"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the whole dialogue is rendered with that speaker as ``assistant`` and all others as
named users. A dialogue is returned as its segments, one row per turn and perspective, with the character offset of the
segment in the dialogue and the trained range [mask_start, mask_end) in dialogue coordinates: concatenating ``rendered`` in
the order of ``seg_start`` gives the dialogue. So a conversation of any length is never gathered into one row, and a
conversation with a third of all rows is laid out block by block.

Defined cases: line breaks in a speaker's name become spaces, so that it cannot forge a header, and speakers are trimmed; a null or blank speaker is ``unknown``; speakers named ``system`` are rendered as system text and get
no perspective of their own; a null text is empty; null turns come first; turns that tie are ordered by speaker and then
text, and identical rows are rendered once each; rows without a conversation id form one conversation; a conversation
with only system turns has no perspective and no rows; markers of the template inside texts and names are defused by
dropping their bars; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Turns a block holds. Offsets are summed in a block, then over the blocks of a conversation.
BLOCK_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def defused(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(OPEN), F.lit("<im_start>")), F.lit(CLOSE), F.lit("<im_end>"))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """``conv_id, perspective, turn, speaker, chat_role, rendered, seg_start, mask_start, mask_end``; masks are null for untrained turns."""
    name = F.trim(F.translate(F.coalesce(F.col(speaker_col), F.lit("")), "\r\n", "  "))
    base = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(name == "", "unknown").otherwise(defused(name)).alias("speaker"),
        defused(F.coalesce(F.col(text_col), F.lit(""))).alias("body"),
    )
    people = base.filter(F.col("speaker") != system).groupBy("conv_id").agg(F.sort_array(F.collect_set("speaker")).alias("people")).withColumnRenamed("conv_id", "of")
    seen = base.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "turn", "speaker", "body", F.explode("people").alias("perspective"))
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == system, "system").when(own, "assistant").otherwise("user")
    head = F.concat(F.lit(OPEN), role, F.when(role == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(F.lit("")), F.lit("\n"))
    segs = seen.select(
        "conv_id", "perspective", "turn", "speaker", "body", role.alias("chat_role"), F.concat(head, "body", F.lit(CLOSE + "\n")).alias("rendered"),
        F.length(head).alias("head"), F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**62))).alias("block"),
    )
    size = F.length("rendered").cast("long")
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("body")]
    in_block = Window.partitionBy("conv_id", "perspective", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = segs.groupBy("conv_id", "perspective", "block").agg(F.sum(size).alias("block_size"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("block_start"))
    laid = segs.withColumn("in_block", F.coalesce(F.sum(size).over(in_block), F.lit(0)))
    at = F.col("block_start") + F.col("in_block")
    trained = F.col("chat_role") == "assistant"
    return laid.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b"))).select(
        "conv_id", "perspective", "turn", "speaker", "chat_role", "rendered", at.alias("seg_start"),
        F.when(trained, at + F.col("head")).alias("mask_start"), F.when(trained, at + F.length("rendered") - 1).alias("mask_end"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of every participant."""
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH base AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn,
         CASE WHEN trim(translate(coalesce(role, ''), chr(13) || chr(10), '  ')) = '' THEN 'unknown'
              ELSE replace(replace(trim(translate(role, chr(13) || chr(10), '  ')), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') END AS speaker,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS body
  FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker <> 'system'),
seen AS (
  SELECT b.*, p.perspective, CASE WHEN b.speaker = 'system' THEN 'system' WHEN b.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM base b JOIN people p ON b.conv_id IS NOT DISTINCT FROM p.conv_id),
segs AS (
  SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM seen),
whole AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS rendered FROM segs),
laid AS (
  SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg_start FROM whole)
SELECT conv_id, perspective, turn, speaker, chat_role, rendered, seg_start,
       CASE WHEN chat_role = 'assistant' THEN seg_start + length(head) END AS mask_start,
       CASE WHEN chat_role = 'assistant' THEN seg_start + length(rendered) - 1 END AS mask_end
FROM laid
"""
