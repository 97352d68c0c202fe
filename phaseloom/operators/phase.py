"""D: what a cluster's haplotype histogram decides."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_balanced(h0: Column, h1: Column, h2: Column, svtype: str, mode: str = "germline") -> Column:
    """Whether both haplotypes are seen evenly enough to form alleles on each."""
    low, high, apart = F.least(h1, h2), F.greatest(h1, h2), F.abs(h1 - h2)
    if svtype == "DUP":
        return (h0 + apart < 4 * low) | ((apart < h0) & (h0 < h1 + h2))
    if mode == "mosaic" and svtype in ("DEL", "INS"):
        return (h0 + apart < (h1 + h2) / 2) | ((apart < h0) & (h0 < high))
    return (h0 + apart < low) | ((apart < h0) & (h0 < high))


def min_support_by_depth(depth: Column, svtype: str, mode: str = "germline", min_support: int = 10) -> Column:
    """Signals that an allele needs at this depth."""
    if svtype in ("DEL", "INS"):
        return F.lit(min(min_support, 5)) if mode == "mosaic" else F.floor(F.greatest(depth / 10, F.lit(2))).cast("int")
    if svtype == "INV" and mode == "mosaic":
        return F.greatest(F.floor(depth * 0.05), F.lit(4)).cast("int")
    return F.lit(min_support)


def route_clusters(sized: DataFrame, limit: int = 100) -> DataFrame:
    """``route`` of clusters given ``balanced``, ``svtype`` and ``n_signals``: where their alleles are formed."""
    indel = F.col("svtype").isin("DEL", "INS")
    return sized.withColumn("route", F.when(F.col("balanced"), "haplotypes").when(~indel, "pooled").when(F.col("n_signals") < limit, "dp").otherwise("length_chain"))
