"""G: genotypes of calls, from reads for and against. All are columns or short joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.likelihood import genotype_likelihood


def assign_genotype(gt: Column, s1: Column, s2: Column, r1: Column, r2: Column) -> Column:
    """Phased text: a single variant goes to the haplotype with more supporting reads; clear haplotypes decide."""
    phased = F.when(gt == "0/1", F.when(s1 > s2, "1|0").otherwise("0|1")).otherwise(gt)
    share = lambda s, r: F.when(s + r == 0, 0.0).otherwise(s / F.when(s + r > 0, s + r))
    p1, p2, deep = share(s1, r1), share(s2, r2), F.least(s1 + r1, s2 + r2) > 5
    return F.when(deep & (p1 > 0.95) & (p2 < 0.05), "1|0").when(deep & (p2 > 0.95) & (p1 < 0.05), "0|1").otherwise(phased)


def genotyped(calls: DataFrame) -> DataFrame:
    """``calls`` (dv, dr, s1, s2, r1, r2) with gt, pl, gq and qual."""
    g = calls.withColumn("_g", genotype_likelihood(F.col("dr"), F.col("dv")))
    gt = assign_genotype(F.col("_g.gt"), *(F.col(c) for c in ("s1", "s2", "r1", "r2")))
    return g.select(*calls.columns, gt.alias("gt"), "_g.pl", "_g.gq", "_g.qual")


def assign_genotype_mosaic(calls: DataFrame) -> DataFrame:
    """``calls`` (dv, dr) with the likelihoods' own gt, pl, gq and qual."""
    return calls.select("*", F.inline(F.array(genotype_likelihood(F.col("dr"), F.col("dv")))))


def zero_weak_quality(qual: Column, dv: Column, dr: Column, tight: Column) -> Column:
    """Quality 0 for deletions and insertions with few supporting reads and no exact place."""
    return F.when((dv / F.when(dv + dr > 0, dv + dr) < 0.25) & (qual < 20) & ~tight, 0.0).otherwise(qual)


def search_window(pos: Column, low: Column, high: Column, gap: int) -> tuple[Column, Column]:
    """Where reads against a deletion or insertion are looked for."""
    start = F.greatest(pos - gap, F.least(low, high - gap))
    end = F.least(pos + gap, F.greatest(high, low + gap))
    return start, F.when(start == end, end + 1).otherwise(end)


def revise_haplotype(gt: Column, s1: Column, s2: Column, r1: Column, r2: Column) -> Column:
    """A haplotype's 1 stays where it has at least as many reads for it as against, else it is undecided."""
    side = lambda at, s, r: F.when((F.substring(gt, at, 1) == "1") & (s < r), ".").otherwise(F.substring(gt, at, 1))
    return F.concat(side(1, s1, r1), F.lit("|"), side(3, s2, r2))


def upgrade_unphased(gt: Column, dv: Column, dr: Column, h1: Column, h2: Column) -> Column:
    """Calls of untagged reads: the likeliest of two, one or no variant haplotypes, if it is one of the first two."""
    hit, miss, half = (F.log10(F.lit(x)) for x in (0.9, 0.1, 0.5))
    none = F.log10(F.lit(0.4)) + dr * hit + dv * miss
    both = F.log10(F.lit(0.4)) + dr * miss + dv * hit
    one = F.log10(F.lit(0.2)) + (dr + dv) * half
    found = F.when((both > one) & (both > none), "1|1").when((one > both) & (one > none), F.when(h1 > h2, "1|0").otherwise("0|1"))
    return F.when(gt == ".|.", F.coalesce(found, gt)).otherwise(gt)


def resolve_same_position(calls: DataFrame) -> DataFrame:
    """Where a haplotype has several alleles at one place: of its 1|1 only the first stays, or, without any, those several become undecided."""
    w = Window.partitionBy("win_id", "pos")
    has = lambda k: F.count_if(F.substring("gt", k, 1) == "1").over(w)
    many = (has(1) > 1) | (has(3) > 1)
    both = F.count_if(F.col("gt") == "1|1").over(w)
    turn = F.row_number().over(w.orderBy((F.col("gt") != "1|1").cast("int"), "allele"))
    only = lambda kinds: F.count_if(F.col("gt").isin(*kinds)).over(w)
    first, second = ("1|0", "1|."), ("0|1", ".|1")
    lost = F.when(only(first) > 1, F.col("gt").isin(*first)).otherwise((only(second) > 1) & F.col("gt").isin(*second))
    told = calls.select("*", many.alias("_many"), both.alias("_both"), turn.alias("_turn"), lost.alias("_lost"))
    kept = told.filter(~F.col("_many") | (F.col("gt") != "1|1") | (F.col("_turn") == 1))
    gt = F.when(F.col("_many") & (F.col("_both") == 0) & F.col("_lost"), ".|.").otherwise(F.col("gt"))
    return kept.withColumn("gt", gt).drop("_many", "_both", "_turn", "_lost")


def mosaic_filter_indel(calls: DataFrame, min_size: int = 50) -> DataFrame:
    """Low-frequency deletions and insertions: no variant haplotype, and a share of reads from 0.05 to 0.4."""
    share = F.col("dv") / F.when(F.col("dv") + F.col("dr") > 0, F.col("dv") + F.col("dr"))
    return calls.filter(~F.contains(F.col("gt"), F.lit("1")) & (F.abs("svlen") >= min_size) & (F.col("dv") >= 2) & share.between(0.05, 0.4))


def mosaic_filter_inv_tra(calls: DataFrame) -> DataFrame:
    """The same for inversions and translocations, the latter with a least number of reads for their depth."""
    least = F.greatest(F.floor((F.col("dv") + F.col("dr")) * 0.05), F.lit(4))
    return calls.filter(~F.contains(F.col("gt"), F.lit("1")) & ((F.col("svtype") != "TRA") | (F.col("dv") >= least)))


def revise_haplotype_mosaic(gt: Column, s1: Column, s2: Column, r1: Column, r2: Column, svtype: str) -> Column:
    """A haplotype's 1 stays where nearly all of its reads have it; without reads it doesn't."""

    def side(at: int, s: Column, r: Column) -> Column:
        share = s / F.when(s + r > 0, s + r)
        stays = share > 0.7 if svtype == "INV" else (share >= 0.9) | ((r < 2) & share.isNotNull())
        return F.when((F.substring(gt, at, 1) == "1") & ~F.coalesce(stays, F.lit(False)), ".").otherwise(F.substring(gt, at, 1))

    return F.concat(side(1, s1, r1), F.lit("|"), side(3, s2, r2))
