"""A training corpus from raw documents in five stages, each written as Parquet and read again by the next.

What the stages do with odd rows is what their operators do: null and empty texts go in the first stage; of equal texts one
row stays, also where rows repeat an identifier; rows without an identifier stay if their text does, and are no one's near
duplicate; ties go to the smallest identifier; further columns, whatever their names, come along up to the last stage.
Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, packing, quality_rules, simhash, suffix_dedup
from . import common as C


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the cascade of quality rules."""
    C.ship_code(spark)
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: operator 5 over five-word shingles, a similarity of 0.8 or more checked.

    What fingerprints can't find at that similarity is added exactly.
    """
    C.ship_code(spark)
    return simhash.drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; n_chars is that of the new text."""
    C.ship_code(spark)
    return suffix_dedup.cut_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of 2048 ids."""
    C.ship_code(spark)
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("repeats", repeats), ("packing", packed)]

#: Tokenization and shingle hashing have no SQL form; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's tables in the session's shared folder go once its result is written."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), C.tables()
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        docs = C.durable(made)
        C.discard(*(t for t in C.tables() if t is not docs and not any(t is x for x in kept)))
    return docs
