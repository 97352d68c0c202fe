"""C: chains of signals within a sample. Every result has ``win_id``, a text that names the cluster among those of all samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Params
from .intervals import islands
from .keys import sample


def _named(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumn("win_id", F.concat_ws(":", *sample(df), *keys, "cluster_no")).drop("cluster_no")


def indel_clusters(sig: DataFrame, gap: int = Params.gap_indel) -> DataFrame:
    """Deletions or insertions in order of position, then chained by whole positions, which are those of the result: halves occur."""
    whole = lambda x: x["pos"].cast("long")
    made = islands(sig, [*sample(sig), "svtype", "chrom"], ["pos", "len", "read_name", "hp"], lambda a, b: whole(b) - whole(a) > gap)
    return _named(made.withColumn("pos", F.col("pos").cast("long")), "svtype", "chrom")


def enough_signals(mode: str = "germline", min_support: int = Params.min_support) -> Column:
    """Whether a cluster with n_signals and mean_len has enough signals or long ones."""
    return (F.col("n_signals") >= (min_support / 2 if mode == "germline" else min_support)) | (F.col("mean_len") >= 3000)


def keep_indel_clusters(clusters: DataFrame, mode: str = "germline", min_support: int = Params.min_support) -> DataFrame:
    """(win_id, n_signals, mean_len) of clusters with enough signals or long ones."""
    return clusters.groupBy("win_id").agg(F.count(F.lit(1)).alias("n_signals"), F.avg("len").alias("mean_len")).filter(enough_signals(mode, min_support))


def _far(gap: int):
    return lambda a, b: (b["pos"] - a["pos"] > gap) & (F.abs(b["pos2"] - a["pos2"]) > gap)


def _supported(df: DataFrame, least: int | Column) -> DataFrame:
    kept = df.groupBy("win_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("win_id")
    return df.join(kept, "win_id", "left_semi")


def dup_clusters(sig: DataFrame, gap: int = Params.gap_dup_inv, min_support: int = Params.min_support) -> DataFrame:
    """Duplications chained while either breakpoint is near."""
    return _supported(_named(islands(sig, [*sample(sig), "svtype", "chrom"], ["pos", "pos2", "read_name", "hp"], _far(gap)), "svtype", "chrom"), min_support)


def inv_clusters(sig: DataFrame, gap: int = Params.gap_dup_inv, min_support: int = Params.min_support, split_strand: bool = False) -> DataFrame:
    """Inversions likewise; split_strand (mosaic): a change of strand ends a chain too."""
    far = _far(gap)
    breaks = (lambda a, b: far(a, b) | (a["strand"] != b["strand"])) if split_strand else far
    return _supported(_named(islands(sig, [*sample(sig), "svtype", "chrom"], ["pos", "pos2", "strand", "read_name", "hp"], breaks), "svtype", "chrom"), min_support)


def tra_clusters(sig: DataFrame, gap: int = Params.gap_tra, min_signals: int = 2, last_needs: int | None = None) -> DataFrame:
    """Translocations of one pair of chromosomes and one type chained by the first breakpoint.

    ``last_needs`` (mosaic): signals that the last cluster of every partner chromosome but the last one needs.
    """
    of, keys = sample(sig), ["svtype", "chrom", "chrom2", "bnd_type"]
    made = islands(sig, [*of, *keys], ["pos", "pos2", "read_name", "hp"], lambda a, b: b["pos"] - a["pos"] > gap)
    if last_needs is None:
        return _supported(_named(made, *keys), min_signals)
    sizes = made.groupBy(*of, *keys, "cluster_no").agg(F.count(F.lit(1)).alias("_n"))
    ends = sizes.groupBy(*of, "svtype", "chrom", "chrom2").agg(F.max(F.struct("bnd_type", "cluster_no")).alias("_end"))
    final = ends.groupBy(*of, "svtype", "chrom").agg(F.max("chrom2").alias("_final"))
    told = sizes.join(ends, [*of, "svtype", "chrom", "chrom2"]).join(final, [*of, "svtype", "chrom"])
    at_end = (F.col("_end") == F.struct("bnd_type", "cluster_no")) & (F.col("chrom2") != F.col("_final"))
    kept = told.filter(F.col("_n") >= F.when(at_end, last_needs).otherwise(min_signals)).select(*of, *keys, "cluster_no")
    return _named(made.join(kept, [*of, *keys, "cluster_no"], "left_semi"), *keys)


def cluster_windows(clusters: DataFrame, gap: int, by: str = "indel") -> DataFrame:
    """(win_id, chrom, w_start, w_end): where a cluster's reads are looked for; by="inv" takes half the gap."""
    reach = gap // 2 if by == "inv" else gap
    at = F.col("pos").cast("long")
    return clusters.groupBy(*sample(clusters), "win_id", "chrom").agg(F.greatest(F.min(at) - reach, F.lit(0)).alias("w_start"), (F.max(at) + reach).alias("w_end"))
