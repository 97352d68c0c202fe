"""Operator 8, exact dedup by content sort, in DataFrame functions alone.

Texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``. Sampled splitters deal the
normalised texts into ranges of their first LEAD characters, and of a hash where these are equal, so what is sampled is
short whatever the texts. An external sort by both, then by the whole text, places equals side by side, and neighbours are
compared whole. Of equal texts the row with the most code points in the original text stays, then the one with the
smallest identifier; null identifiers come last.

A text that a sample finds in more rows than a partition has on average can't be spread by ranges. Such texts (at most as
many as there are partitions) are aggregated before the shuffle instead, whole texts compared, and their decision is
broadcast back to the rows. Which way a text takes changes nothing in the result.

Null texts count as empty; all empty texts are equal. Rows that repeat an identifier and a text share its decision in
``exact_duplicates``; ``drop_duplicates`` keeps one of them. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: One of so many rows is sampled, by a hash of its identifier.
SAMPLE_OF = 16
#: Characters by which texts are dealt into ranges.
LEAD = 24


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def _hot(rows: DataFrame) -> list[int]:
    """Hashes of the hot texts of a sample: those with more rows than an average partition, so no more than partitions."""
    share = C.partitions(rows)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_OF)) == 0)
    total = sample.select("id").count()
    if not total:
        return []
    counted = sample.groupBy(F.xxhash64("norm").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return [r.h for r in counted.filter(F.col("n") > max(3, total // share)).orderBy(F.desc("n")).limit(share).collect()]


def _decided(rows: DataFrame, again: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The cold and the hot rows, each with keep_id and group_size; cold ones with place, 1 for the row that stays.

    ``again``: the normalised text of rows that carry their text otherwise too; they are shuffled without it.
    """
    hot = _hot(rows)
    cold = rows.filter(~F.xxhash64("norm").isin(hot)) if hot else rows
    cold = cold.withColumns({"lead": F.substring("norm", 1, LEAD), "tie": F.xxhash64("norm")})
    near = Window.partitionBy("lead", "tie", "norm").orderBy(F.desc("n"), F.asc_nulls_last("id"))
    whole = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a window clustered by these and the text takes the ranges as they are: the only shuffle is this one
    cold = (cold if again is None else cold.drop("norm")).repartitionByRange(C.partitions(rows), "lead", "tie")
    cold = cold if again is None else cold.withColumn("norm", again)
    cold = cold.select("*", F.first("id").over(whole).alias("keep_id"), F.count(F.lit(1)).over(whole).alias("group_size"), F.row_number().over(near).alias("place"))
    if not hot:
        return cold, None
    found = rows.filter(F.xxhash64("norm").isin(hot))
    best = found.groupBy("norm").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("id").isNull().alias("none"), "id")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    best = best.select(F.sha2("norm", 256).alias("sha"), F.col("best.id").alias("keep_id"), "group_size")
    return cold, found.withColumn("sha", F.sha2("norm", 256)).join(F.broadcast(best), "sha").drop("sha")


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _prepared(df: DataFrame, id_col: str, text_col: str, *carried: Column) -> DataFrame:
    text = _text(F.col(text_col))
    return df.select(F.col(id_col).cast("long").alias("id"), F.char_length(text).alias("n"), normalised(text).alias("norm"), *carried)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept and the SHA-256 of the normalised text."""
    made = [
        part.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.sha2("norm", 256).alias("text_sha256"))
        for part in _decided(_prepared(df, id_col, text_col))
        if part is not None
    ]
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, whatever these are called."""
    cold, hot = _decided(_prepared(df, id_col, text_col, F.struct("*").alias("row")), normalised(_text(F.col("row").getField(text_col))))
    kept = cold.filter("place = 1").select("row.*")
    if hot is not None:
        kept = kept.unionByName(hot.filter("id <=> keep_id").dropDuplicates(["id", "norm"]).select("row.*"))
    return kept


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every row and whole text of ``documents``."""
    return exact_duplicates(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
