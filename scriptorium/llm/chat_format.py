"""Chat formatting by multi-party perspective rotation.

A dialogue is rendered once for each participant: that speaker's turns become the
assistant's, everyone else's a named user's, system turns stay system turns, and only the
assistant's words (with the end mark) are to be learned. The result has a row for each
turn and perspective, so a dialogue of any length is spread over tasks; in turn order, the
rendered rows of a perspective are the training text. `dialogues` puts these together, for
dialogues that a row can hold.

Only DataFrame and SQL functions. Defined results: a null or blank role is the participant
`unknown`; a null text is an empty turn; system turns alone give no row. Marks in texts are broken up
(`<|` becomes `< |`) and names keep only letters, digits, `_` and `-`, so no text can pose as
another turn; a name that loses something gets eight digits of a digest, so that different speakers
keep different names. Repeated rows are rendered each; dialogues without an id are one dialogue. Turns
with one number are rendered each; `dialogues` orders them by role, name and text, and turns
without a number come first. A very long turn is a row like any other. An empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import table

END = "<|end|>"


def _name(speaker: Column) -> Column:
    plain = F.regexp_replace(speaker, "[^A-Za-z0-9_-]", "_")
    return F.when(plain == speaker, plain).otherwise(F.concat(plain, F.lit("-"), F.substring(F.md5(speaker.cast("binary")), 1, 8)))


def rotate(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, perspective, turn, chat_role, name, rendered, mask_start, mask_length.

    The mask is a range of characters of `rendered`, of length 0 outside the assistant's turns."""
    speaker = F.coalesce(F.nullif(F.trim(F.col(role)), F.lit("")), F.lit("unknown"))
    turns = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), speaker.alias("speaker"), F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |")).alias("content"))
    cast = turns.where("speaker <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    rows = turns.join(cast, F.col("conv_id").eqNullSafe(F.col("_conv")))
    chat_role = F.when(F.col("speaker") == "system", "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    rows = rows.withColumn("chat_role", chat_role).withColumn("name", F.when(F.col("chat_role") == "user", _name(F.col("speaker"))))
    head = F.concat(F.lit("<|"), "chat_role", F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("|>\n"))
    learned = F.col("chat_role") == "assistant"
    return rows.withColumn("head", head).select(
        "conv_id", "perspective", "turn", "chat_role", "name",
        F.concat("head", "content", F.lit(END + "\n")).alias("rendered"),
        F.when(learned, F.length("head")).otherwise(0).cast("long").alias("mask_start"),
        F.when(learned, F.length("content") + len(END)).otherwise(0).cast("long").alias("mask_length"),
    )


def dialogues(rotated: DataFrame) -> DataFrame:
    """conv_id, perspective, text, mask: the turns of each perspective in order, and the ranges of
    characters (start, length) to be learned. A dialogue is one row here, so it must fit one."""
    turn = F.struct("turn", "chat_role", "name", "rendered", "mask_start", "mask_length")
    listed = rotated.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(turn)).alias("t"))  # one dialogue
    span = F.struct((F.lit(0).cast("long")).alias("start"), F.lit(0).cast("long").alias("length"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array_except(F.array(span), F.array(span)).alias("mask"))

    def add(acc: Column, t: Column) -> Column:
        own = F.when(t["mask_length"] > 0, F.array(F.struct((acc["at"] + t["mask_start"]).alias("start"), t["mask_length"].alias("length")))).otherwise(F.array_except(F.array(span), F.array(span)))
        return F.struct((acc["at"] + F.length(t["rendered"])).alias("at"), F.concat(acc["mask"], own).alias("mask"))

    return listed.select("conv_id", "perspective", F.array_join(F.transform("t", lambda t: t["rendered"]), "").alias("text"), F.aggregate("t", empty, add, lambda acc: acc["mask"]).alias("mask"))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each of its participants."""
    return rotate(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations
), c AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.conv_id, perspective, turn, content,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role,
    CASE WHEN speaker <> 'system' AND speaker <> perspective THEN
      CASE WHEN regexp_matches(speaker, '[^A-Za-z0-9_-]') THEN regexp_replace(speaker, '[^A-Za-z0-9_-]', '_', 'g') || '-' || substr(md5(speaker), 1, 8) ELSE speaker END END AS name
  FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id
), h AS (SELECT *, '<|' || chat_role || coalesce(' name=' || name, '') || '|>' || chr(10) AS head FROM r)
SELECT conv_id, perspective, turn, chat_role, name, head || content || '{END}' || chr(10) AS rendered,
  CAST(CASE WHEN chat_role = 'assistant' THEN length(head) ELSE 0 END AS BIGINT) AS mask_start,
  CAST(CASE WHEN chat_role = 'assistant' THEN length(content) + {len(END)} ELSE 0 END AS BIGINT) AS mask_length
FROM h
"""
