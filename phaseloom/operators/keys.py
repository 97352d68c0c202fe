"""The sample leads every key. Tables of one sample may do without the column; then all tables of a job must."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = "sample_id"
#: Bins in which chains are looked for have two to this many bases.
CHAIN_BITS = 20


def sample(*tables: DataFrame) -> list[str]:
    """The name of the sample's column in a list, or none; an error where some tables have it only."""
    held = {SAMPLE in t.columns for t in tables}
    if len(held) > 1:
        raise ValueError(f"{SAMPLE} is in some tables of the job only")
    return [SAMPLE] if True in held else []


def renamed(columns: list[str], prefix: str) -> list[Column]:
    """Columns under another name, for the other side of a join."""
    return [F.col(c).alias(prefix + c) for c in columns]


def alike(columns: list[str], prefix: str) -> Column:
    """Whether columns equal those of the other side of a join."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & (F.col(c) == F.col(prefix + c))
    return cond


def chain_bin(pos: Column, size: int = 1 << CHAIN_BITS) -> Column:
    """The bin of a position in which its chain is looked for."""
    return F.floor(pos / size).cast("long")
