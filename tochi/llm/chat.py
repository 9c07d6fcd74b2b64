"""Multi-party chat formatting by rotation of perspective, in DataFrame functions only.

For every participant of a conversation (each role but ``system``) the dialogue is
rendered with that participant as the assistant and the others as named users. A row
is one turn of one rendering: its text, where it starts in the whole rendering, and
the span that training scores (the assistant's own words and the end mark). The rows
of a rendering, in the order of seq, concatenate to it without a gap, so a dialogue
of any length is never gathered in one place.

Positions are prefix sums in two steps, within blocks of BLOCK turn numbers and over
blocks, so a conversation with a large share of all turns is dealt over many tasks.

Definitions for odd input: turns order by (turn, role, text), nulls last; a null role
is the participant ``unknown``; a null text is empty; a null conv_id is one
conversation of its own; repeated rows are turns of their own; a conversation of
system turns alone has no participant and no row. Marks inside texts, and marks and
line ends inside names, are broken by a space so they cannot be taken for turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tochi.llm.common import table

SYSTEM = "system"
BLOCK = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _name(role: Column) -> Column:
    return F.coalesce(role.cast("string"), F.lit("unknown"))


def rotate(turns: DataFrame) -> DataFrame:
    """One row per conversation, participant and turn; see the module."""
    base = turns.select("conv_id", "turn", _name(F.col("role")).alias("speaker"), F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("words"))
    base = base.withColumn("block", F.floor(F.col("turn") / BLOCK))
    people = base.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("in_conv"), F.col("speaker").alias("perspective")).distinct()
    rows = base.join(people, F.col("conv_id").eqNullSafe(F.col("in_conv"))).drop("in_conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    named = F.replace(F.translate(F.col("speaker"), "\n\r", "  "), F.lit("<|"), F.lit("< |"))
    head = F.concat(F.lit(OPEN), role, F.when(role == "user", F.concat(F.lit(" name="), named)).otherwise(F.lit("")), F.lit("\n"))
    rows = rows.withColumns({"role": role, "name": F.when(role == "user", F.col("speaker")), "head": F.length(head), "rendered": F.concat(head, F.col("words"), F.lit(CLOSE + "\n"))})
    rows = rows.withColumn("size", F.length("rendered").cast("long"))

    key = [F.col("conv_id"), F.col("perspective")]
    blocks = rows.groupBy(*key, "block").agg(F.sum("size").alias("sum_size"), F.count("*").alias("sum_rows"))
    ahead = Window.partitionBy(*key).orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("b_conv"), F.col("perspective").alias("b_persp"), F.col("block").alias("b_block"), F.coalesce(F.sum("sum_size").over(ahead), F.lit(0)).alias("at_size"), F.coalesce(F.sum("sum_rows").over(ahead), F.lit(0)).alias("at_rows"))
    inner = Window.partitionBy(*key, "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "words")
    rows = rows.withColumns({"nth": F.row_number().over(inner), "run": F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    same = F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("perspective") == F.col("b_persp")) & F.col("block").eqNullSafe(F.col("b_block"))
    out = rows.join(blocks, same)
    start = F.col("at_size") + F.col("run")
    scored = F.col("role") == "assistant"
    return out.select(
        "conv_id",
        "perspective",
        (F.col("at_rows") + F.col("nth")).cast("long").alias("seq"),
        "turn",
        "role",
        "name",
        "rendered",
        start.cast("long").alias("start"),
        F.when(scored, (start + F.col("head")).cast("long")).alias("target_start"),
        F.when(scored, (start + F.col("size") - 1).cast("long")).alias("target_end"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every conversation from the perspective of every participant."""
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE_SQL = f"""
WITH base AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS words FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker <> '{SYSTEM}'),
spoken AS (
  SELECT b.*, p.perspective, CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM base b JOIN people p ON b.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (SELECT *, '{OPEN}' || role || CASE WHEN role = 'user' THEN ' name=' || replace(translate(speaker, chr(10) || chr(13), '  '), '<|', '< |') ELSE '' END || chr(10) AS head FROM spoken),
made AS (SELECT *, head || words || '{CLOSE}' || chr(10) AS rendered FROM headed),
placed AS (
  SELECT *, row_number() OVER w AS seq, coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM made WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, words))
SELECT conv_id, perspective, seq, turn, role, CASE WHEN role = 'user' THEN speaker END AS name, rendered, start::BIGINT AS start,
  CASE WHEN role = 'assistant' THEN (start + length(head))::BIGINT END AS target_start,
  CASE WHEN role = 'assistant' THEN (start + length(rendered) - 1)::BIGINT END AS target_end
FROM placed
"""
