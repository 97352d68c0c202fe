"""Operator 4, chat formatting by perspective rotation, in DataFrame functions alone.

For every participant of a conversation the dialogue is rendered with that speaker as assistant and all others as users
who bear their name. Turns of the fixed roles (system) stay as they are and are no one's perspective. Only what the
assistant says, with the mark that ends it, is trained on: ``mask_start`` and ``mask_end`` are its code points within the
segment, equal in all other segments. ``offset`` is where the segment begins in the dialogue of its perspective, of
``dialogue_chars`` code points; the segments of a perspective by offset, end to end, are that dialogue.

No text can forge a mark: in texts and names ``<|`` becomes ``<\\|``, and one that has backslashes between gets one more, so
that taking one away gives the text back. In names, backslashes are doubled and line breaks become ``\\n`` and ``\\r``.

One row is one turn seen by one participant. Turns are in the order of ``turn``, null first, then of speaker and text. A
conversation is never gathered in one place: lengths are summed over blocks of BLOCK turn numbers before any shuffle, those
sums are added up along the conversation, and only a block's rows are ordered together. Participants are aggregated before
the shuffle too, and the joins split a conversation that holds a large share of all turns.

Null texts count as empty, null roles as the speaker "unknown". Turns without a conversation form the conversation null.
Ties and repeated rows are rendered each. A conversation of fixed roles only has no perspective, so no rows. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turn numbers whose rows are ordered together.
BLOCK = 512


def escaped(text: Column) -> Column:
    """A text in which no mark can be read."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _name(speaker: Column) -> Column:
    plain = F.replace(F.replace(F.replace(speaker, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return escaped(plain)


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", fixed: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, segment, mask_start, mask_end, offset and dialogue_chars."""
    turns = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    seats = turns.filter(~F.col("speaker").isin(*fixed)).groupBy(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).agg(F.count(F.lit(1)).alias("own_turns")).select("of", "perspective")
    seen = turns.join(seats, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker").isin(*fixed), F.col("speaker")).otherwise("user")
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), _name(F.col("speaker")))).otherwise(""), F.lit("\n"))
    body = F.concat(escaped(F.col("text")), F.lit(CLOSE))
    said = seen.withColumn("role", role).withColumn("head", head)
    start = F.char_length("head")
    said = said.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "role",
        F.concat("head", body, F.lit("\n")).alias("segment"),
        start.alias("mask_start"),
        F.when(F.col("role") == "assistant", start + F.char_length(body)).otherwise(start).alias("mask_end"),
        "text",
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block"),
    )
    key = ["conv_id", "perspective"]
    size = F.char_length("segment").cast("long")
    along = Window.partitionBy(*key).orderBy("block")
    sums = said.groupBy(*key, "block").agg(F.sum(size).alias("n"))
    sums = sums.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), (F.sum("n").over(along) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(*key)).alias("dialogue_chars")
    )
    inside = Window.partitionBy(*key, "block").orderBy(F.asc_nulls_first("turn"), "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = said.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    return placed.select(*said.columns[:-2], (F.col("before") + F.sum(size).over(inside) - size).alias("offset"), "dialogue_chars")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every turn of ``conversations`` for every participant."""
    return rotate(C.table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
     s AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
     r AS (SELECT t.conv_id, s.perspective, t.turn, t.speaker, t.text, regexp_replace(t.text, '<(\\*)\|', '<\\\1|', 'g') AS said,
                  regexp_replace(replace(replace(replace(t.speaker, '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<(\\*)\|', '<\\\1|', 'g') AS name,
                  CASE WHEN t.speaker = s.perspective THEN 'assistant' WHEN t.speaker = 'system' THEN 'system' ELSE 'user' END AS role
           FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
     h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || name ELSE '' END || chr(10) AS head FROM r),
     g AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS segment FROM h)
SELECT conv_id, perspective, turn, speaker, role, segment, CAST(length(head) AS INT) AS mask_start,
       CAST(length(head) + CASE WHEN role = 'assistant' THEN length(said) + 10 ELSE 0 END AS INT) AS mask_end,
       CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING) - length(segment) AS BIGINT) AS "offset",
       CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective) AS BIGINT) AS dialogue_chars
FROM g
"""
