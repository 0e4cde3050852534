"""Multi-party perspective rotation of dialogues, with built-in functions only.

For every participant of a conversation (every role but the system's) the
dialogue is rendered with that speaker as the assistant and the others as named
users.  The result has one row per conversation, participant and turn: the
rendered segment, its place in the rendered dialogue and the masked-in span (the
assistant's words and their end mark).  Segments joined by ``seg_start`` are the dialogue;
no conversation is ever gathered into one row or one task, however long it is:
places come from running sums inside blocks of turns plus the blocks' offsets.

Defined results: a null or empty role is the speaker ``unknown``; a null text is
empty; rows with a null conversation id form one conversation; null turns come
last; ties of turn are ordered by role, then text, and repeated rows stay
repeated; a conversation with the system's turns only has no participant and no
rows; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The marks around a segment.
BEGIN, END, SYSTEM = "<|im_start|>", "<|im_end|>\n", "system"
TURNS = 256  # turn numbers in a block of the running sums


def rotate(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    turns = conv.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.nullif(F.col(role_col), F.lit("")), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    who = (turns.where(F.col("speaker") != SYSTEM).groupBy("conv_id", "speaker").agg(F.count("*").alias("_n"))
                .select(F.col("conv_id").alias("_c"), F.col("speaker").alias("participant")))
    rows = turns.join(who, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    own = F.col("speaker") == F.col("participant")
    head = F.concat(F.lit(BEGIN), F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant"))
                    .otherwise(F.concat(F.lit("user name="), F.col("speaker"))), F.lit("\n"))
    rows = rows.select(
        "conv_id", "participant", "turn", "speaker", own.alias("trained"), F.length(head).alias("_head"),
        F.concat(head, F.col("text"), F.lit(END)).alias("segment"),
        F.floor(F.col("turn") / TURNS).alias("_block"))
    rows = rows.withColumn("_len", F.length("segment").cast("long"))
    blocks = rows.groupBy("conv_id", "participant", "_block").agg(F.sum("_len").alias("_sum"))
    order = Window.partitionBy("conv_id", "participant").orderBy(F.col("_block").asc_nulls_last())
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("participant").alias("_p"), F.col("_block").alias("_b"),
                           (F.sum("_sum").over(order) - F.col("_sum")).alias("_offset"))
    inner = (Window.partitionBy("conv_id", "participant", "_block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "segment")
                   .rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_run", F.sum("_len").over(inner))
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("participant") == F.col("_p"))
                     & F.col("_block").eqNullSafe(F.col("_b")))
    end = F.col("_offset") + F.col("_run")
    start = end - F.col("_len")
    return rows.select(
        "conv_id", "participant", "turn", "speaker", "segment", start.alias("seg_start"), end.alias("seg_end"), "trained",
        F.when(F.col("trained"), start + F.col("_head")).alias("mask_start"),
        F.when(F.col("trained"), end - 1).alias("mask_end"))


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> '{SYSTEM}'),
h AS (SELECT t.*, participant, speaker = participant AS trained,
        concat('{BEGIN}', CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = participant THEN 'assistant'
               ELSE concat('user name=', speaker) END, chr(10)) AS head
      FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id),
s AS (SELECT conv_id, participant, turn, speaker, trained, length(head) AS head_len,
        concat(head, text, '<|im_end|>', chr(10)) AS segment FROM h),
r AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS LAST, speaker, segment
               ROWS UNBOUNDED PRECEDING) AS seg_end FROM s)
SELECT conv_id, participant, turn, speaker, segment, CAST(seg_end - length(segment) AS BIGINT) AS seg_start,
  CAST(seg_end AS BIGINT) AS seg_end, trained,
  CAST(CASE WHEN trained THEN seg_end - length(segment) + head_len END AS BIGINT) AS mask_start,
  CAST(CASE WHEN trained THEN seg_end - 1 END AS BIGINT) AS mask_end
FROM r
"""
