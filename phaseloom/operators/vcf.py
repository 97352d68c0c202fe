"""V: columns of the output lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import sample


def filter_label(gt: Column, qual: Column) -> Column:
    return F.when(gt.isin(".|0", "0|.", ".|."), "q5").when(qual.isNull() | (qual >= 5), "PASS").otherwise("q5")


def allele_frequency(dv: Column, dr: Column) -> Column:
    return F.coalesce(F.round(dv / F.when(dv + dr > 0, dv + dr), 4).cast("string"), F.lit("."))


def size_filter(calls: DataFrame, max_size: int = 100_000, large_inv: bool = False) -> DataFrame:
    if max_size == -1:
        return calls
    short = F.abs("svlen") <= max_size
    return calls.filter(F.coalesce(short | ((F.col("svtype") == "INV") if large_inv else F.lit(False)), F.lit(True)))


def ref_alt(calls: DataFrame, ref_bins: DataFrame, bin_size: int) -> DataFrame:
    """``calls`` (call_id, chrom, svtype, pos, svlen, ins_seq, alt) with ``ref`` and ``alt``.

    A call takes the bins that its bases lie in by an equi-join on (chrom, bin), so no contig is held whole.
    """
    start = F.when(F.col("svtype").isin("DEL", "INS"), F.greatest(F.col("pos") - 1, F.lit(0))).otherwise(F.col("pos"))
    end = F.when(F.col("svtype") == "DEL", F.col("pos") + F.abs("svlen")).otherwise(start + 1)
    asked = calls.select("call_id", F.col("chrom").alias("on"), start.alias("from_"), end.alias("to_"))
    asked = asked.withColumn("at", F.explode(F.sequence(F.floor(F.col("from_") / bin_size), F.floor((F.col("to_") - 1) / bin_size))))
    met = asked.join(ref_bins, [F.col("on") == F.col("chrom"), F.col("at") == F.col("bin")])
    low = F.greatest(F.col("from_"), F.col("bin_start")) - F.col("bin_start")
    part = F.col("bin_seq").substr((low + 1).cast("int"), (F.least(F.col("to_") - F.col("bin_start"), F.lit(bin_size)) - low).cast("int"))
    whole = met.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("bin", part.alias("bases")))).alias("parts"))
    ref = F.array_join(F.transform("parts", lambda x: x["bases"]), "")
    found = calls.join(whole.select("call_id", ref.alias("ref")), "call_id", "left").withColumn("ref", F.coalesce("ref", F.lit("N")))
    kind = F.col("svtype")
    alt = F.when(kind == "DEL", F.substring("ref", 1, 1)).when(kind == "INS", F.concat("ref", "ins_seq")).when(kind == "TRA", F.col("alt")).otherwise(F.concat(F.lit("<"), kind, F.lit(">")))
    return found.withColumn("alt", alt)


def vcf_fields(calls: DataFrame, genotype: bool = True, reads: bool = False) -> DataFrame:
    """POS, INFO, FORMAT and the sample column; positions are 1-based but those of deletions and insertions, as given."""
    kind, n, pos = F.col("svtype"), F.abs("svlen"), F.col("pos")
    indel = kind.isin("DEL", "INS")
    place = F.when(indel, pos).otherwise(pos + 1)
    end = F.when(kind == "INS", pos).when(kind == "DEL", pos + n).when(kind.isin("DUP", "INV"), pos + 1 + n)
    named = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), value.cast("string")))
    strand = F.when(kind == "DEL", "+-").when(kind == "DUP", "-+").when(kind == "INV", F.col("strand"))
    info = [
        F.lit("PRECISE"),
        named("SVTYPE", F.when(kind == "TRA", "BND").otherwise(kind)),
        named("SVLEN", F.when(kind == "DEL", -n).when(kind != "TRA", n)),
        named("END", end),
        named("CIPOS", F.when(indel, F.col("cipos"))),
        named("CILEN", F.when(indel, F.col("cilen"))),
        named("RE", F.col("dv")),
        named("STRAND", strand),
    ]
    if reads:
        info.append(named("RNAMES", F.array_join("support", ",")))
    if genotype:
        info.append(F.concat(F.lit("AF="), allele_frequency(F.col("dv"), F.col("dr"))))
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    sample = F.concat_ws(":", "gt", dot("dr"), F.col("dv").cast("string"), F.coalesce("pl", F.lit(".,.,.")), dot("gq"))
    return calls.select("*", place.alias("vcf_pos"), F.concat_ws(";", *info).alias("info"), F.lit("GT:DR:DV:PL:GQ").alias("format"), sample.alias("sample"), filter_label(F.col("gt"), F.col("qual")).alias("filter"))


def number_calls(calls: DataFrame) -> DataFrame:
    """``id``: type and running number of each type by chromosome text and position, from 0, in each sample.

    Numbers run within a chromosome; offsets come from a table of counts by type and chromosome.
    """
    of = sample(calls)
    inside = Window.partitionBy(*of, "svtype", "chrom").orderBy("pos", "call_id")
    counts = calls.groupBy(*of, "svtype", "chrom").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*of, "svtype").orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = calls.withColumn("_k", F.row_number().over(inside) - 1).join(counts.select(*of, "svtype", "chrom", before.alias("_before")), [*of, "svtype", "chrom"])
    kind = F.when(F.col("svtype") == "TRA", "BND").otherwise(F.col("svtype"))
    return numbered.withColumn("id", F.concat(kind, (F.col("_k") + F.col("_before")).cast("string"))).drop("_k", "_before")
