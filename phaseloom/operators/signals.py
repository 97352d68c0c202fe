"""U: signal tables of one type together, without identical rows."""

from functools import reduce

from pyspark.sql import DataFrame

from .keys import sample


def union_signals(*parts: DataFrame) -> DataFrame:
    """Signals of several extractors or inputs."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dedup_signals(df: DataFrame) -> DataFrame:
    """Without identical rows; read and clip tables are not deduplicated."""
    return df.dropDuplicates()


def union_calls(*parts: DataFrame) -> DataFrame:
    """Calls of all types; columns that a type lacks are null."""
    return union_signals(*parts)


def signal_chrom_pairs(df: DataFrame) -> DataFrame:
    """Distinct chromosomes of each type, and for translocations their partners."""
    return df.select(*sample(df), "svtype", "chrom", "chrom2").distinct()
