"""Chat formatting by perspective rotation: every dialogue once for each participant.

From a participant's perspective that speaker is the assistant, all other speakers are named users, system messages stay system, and
the mask covers the assistant's words and end marks. A rendered dialogue is kept as one row for each message with its place in the
whole, so a dialogue of any length is never gathered in one task; joined in order of position the segments are the rendered text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns that are numbered in one task, for each dialogue and perspective.
BLOCK = 64
START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def rotated(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, position, turn, role, name, segment, start, end, mask_start, mask_end) for each message and participant.

    ``turns`` has conv_id, turn, role and text. Participants are the distinct roles but system; a null role is the speaker unknown, a
    null text empty, a null turn -1. Messages go by turn, then role and text; repeated rows are messages of their own. Offsets count
    code points of the rendered dialogue; mask_start and mask_end are the learned part, null where nothing is learned. A dialogue of
    system messages alone has no participant and no row, nor have rows without conv_id. Other columns are ignored.
    """
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.regexp_replace(F.col("role").cast("string"), r"\s+", "_"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    people = rows.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    people = people.groupBy("conv_id").agg(F.array_sort(F.collect_set("perspective")).alias("people"))
    seen = rows.join(people, "conv_id").withColumn("perspective", F.explode("people")).drop("people")
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == SYSTEM
    role = F.when(own, "assistant").when(system, SYSTEM).otherwise("user")
    name = F.when(own | system, F.lit(None)).otherwise(F.col("speaker"))
    head = F.concat(F.lit(START), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    seen = seen.withColumns({"role": role, "name": name, "head": head, "segment": F.concat(head, "text", F.lit(END)), "block": F.floor(F.col("turn") / BLOCK)})
    seen = seen.withColumn("long", F.char_length("segment").cast("long"))
    sums = seen.groupBy("conv_id", "perspective", "block").agg(F.count("*").alias("rows"), F.sum("long").alias("chars"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "perspective", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"))
    order = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "text")
    placed = seen.withColumn("row", F.row_number().over(order)).withColumn("ends", F.sum("long").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(sums, ["conv_id", "perspective", "block"])
    end = F.col("chars_before") + F.col("ends")
    start = end - F.col("long")
    learned = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", (F.col("rows_before") + F.col("row") - 1).cast("long").alias("position"), "turn", "role", "name", "segment", start.alias("start"), end.alias("end"),
        F.when(learned, start + F.char_length("head")).alias("mask_start"), F.when(learned, end - 1).alias("mask_end"),
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(regexp_replace(role, '\s+', '_', 'g'), 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM rows WHERE speaker <> 'system'),
seen AS (
  SELECT r.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
    CASE WHEN speaker <> perspective AND speaker <> 'system' THEN speaker END AS name
  FROM rows r JOIN people USING (conv_id)
), headed AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM seen),
whole AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING) AS ends
  FROM whole WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text)
)
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, CAST(turn AS BIGINT) AS turn, role, name, segment, CAST(ends - length(segment) AS BIGINT) AS start, CAST(ends AS BIGINT) AS "end",
  CAST(CASE WHEN role = 'assistant' THEN ends - length(segment) + length(head) END AS BIGINT) AS mask_start, CAST(CASE WHEN role = 'assistant' THEN ends - 1 END AS BIGINT) AS mask_end
FROM placed
"""
