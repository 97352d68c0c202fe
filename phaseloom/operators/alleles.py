"""A: alleles of a cluster. A cluster spans one locus, so windows and arrays by cluster stay small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params
from .keys import sample


def length_chain(sig: DataFrame, by: list[str], ratio: float = Params.len_ratio) -> DataFrame:
    """``sig`` with ``allele``: signals in order of length; one that exceeds the running mean by ``ratio`` opens another.

    The boundary depends on the members so far, so the distinct lengths of a cluster with their counts are walked in order.
    Only the borders are gathered on the way: an allele's least length is over 1 + ``ratio`` times the mean of the one before,
    so a few dozen at most for lengths of any size, however many signals a cluster has. A walk reads each length once and
    changes four numbers.
    """
    lengths = sig.groupBy(*by, "len").agg(F.count(F.lit(1)).alias("n"))
    packed = lengths.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("len").cast("long").alias("len"), "n"))).alias("all"))
    kind = "struct<borders:array<bigint>,total:double,n:bigint>"
    start = F.struct(F.array().cast("array<bigint>").alias("borders"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        mean = acc["total"] / F.when(acc["n"] > 0, acc["n"])
        new = F.coalesce(x["len"] - mean > ratio * mean, F.lit(True))
        total, n = (x["len"] * x["n"]).cast("double"), x["n"]
        opened = F.struct(F.concat(acc["borders"], F.array(x["len"])).alias("borders"), total.alias("total"), n.alias("n"))
        return F.when(new, opened).otherwise(F.struct(acc["borders"].alias("borders"), (acc["total"] + total).alias("total"), (acc["n"] + n).alias("n"))).cast(kind)

    found = packed.select(*by, F.aggregate("all", start, step, lambda acc: acc["borders"]).alias("borders"))
    told = sig.join(found, by)
    past = F.aggregate("borders", F.lit(-1), lambda acc, low: acc + (F.col("len") >= low).cast("int"))
    return told.select(*sig.columns, past.alias("allele"))


def interval(std: Column, n: Column) -> Column:
    """Text of the 95 % interval of a mean."""
    x = F.floor(1.96 * std / F.sqrt(n)).cast("long").cast("string")
    return F.concat(F.lit("-"), x, F.lit(","), x)


def allele_stats(chained: DataFrame, by: list[str], mode: str = "germline", more: list[Column] | None = None) -> DataFrame:
    """Position, length, their spread and the length fence of each allele; ``more``: further aggregates in the same pass."""
    q = lambda p: F.expr(f"percentile(len, {p})")
    got = chained.groupBy(*by, "allele").agg(
        F.count(F.lit(1)).alias("n_signals"),
        F.count_distinct("read_name").alias("n_reads"),
        *(f("pos").alias(f"{f.__name__}_pos") for f in (F.avg, F.min, F.max)),
        F.avg("len").alias("avg_len"),
        F.min("len").alias("min_len"),
        F.max("len").alias("max_len"),
        F.stddev_pop("pos").alias("std_pos"),
        F.stddev_pop("len").alias("std_len"),
        q(0.25).alias("q1"),
        q(0.75).alias("q3"),
        *(more or []),
    )
    if mode == "mosaic":
        fence = (F.col("min_len").cast("double"), F.col("max_len").cast("double"))
    else:
        reach = 1.5 * (F.col("q3") - F.col("q1"))
        fence = F.greatest(F.col("q1") - reach, "min_len"), F.least(F.col("q3") + reach, "max_len")
    return got.select("*", fence[0].alias("fence_low"), fence[1].alias("fence_high"), interval(F.col("std_pos"), F.col("n_signals")).alias("cipos"), interval(F.col("std_len"), F.col("n_signals")).alias("cilen")).drop("q1", "q3")


def _second_chain(clusters: DataFrame, by: list[str], gap: int, *ties: str) -> DataFrame:
    """``allele``: a cluster's signals chained by the second breakpoint."""
    w = Window.partitionBy(*by).orderBy("pos2", *ties)
    new = F.when(F.col("pos2") - F.lag("pos2").over(w) > gap, 1).otherwise(0)
    return clusters.withColumn("_new", new).withColumn("allele", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _once(chained: DataFrame, by: list[str], *ties: str) -> DataFrame:
    """``turn`` 1 for the first signal of each read in an allele."""
    return chained.withColumn("turn", F.row_number().over(Window.partitionBy(*by, "allele", "read_name").orderBy("pos2", *ties)))


def allele_support(clusters: DataFrame, by: list[str], gap: int, *ties: str) -> DataFrame:
    """(by, allele, read_name, hp): each read once in each allele that the second breakpoint makes."""
    return _once(_second_chain(clusters, by, gap, *ties), by, *ties).filter("turn = 1").select(*by, F.col("allele").cast("int").alias("allele"), "read_name", "hp")


def _reads_by_hp() -> list[Column]:
    return [F.count_if((F.col("turn") == 1) & (F.col("hp") == h)).cast("int").alias(f"s{h}") for h in (0, 1, 2)]


def _within(length: Column, p: Params) -> Column:
    return length >= p.min_size if p.max_size == -1 else length.between(p.min_size, p.max_size)


def dup_alleles(clusters: DataFrame, by: list[str], p: Params = Params()) -> DataFrame:
    """Breakpoints from the middle fifth of an allele's signals by the second one."""
    ties = ("pos", "read_name")
    chained = _once(_second_chain(clusters, by, p.gap_dup_inv, *ties), by, *ties)
    whole = Window.partitionBy(*by, "allele")
    ranked = chained.withColumn("i", F.row_number().over(whole.orderBy("pos2", *ties)) - 1).withColumn("n", F.count(F.lit(1)).over(whole))
    low, high = F.floor(F.col("n") * 0.4), F.floor(F.col("n") * 0.6)
    middle = (F.col("i") >= low) & (F.col("i") < F.greatest(high, low + 1))
    made = ranked.groupBy(*sample(clusters), *by, "chrom", "allele").agg(
        *(F.floor(F.avg(F.when(middle, F.col(c)))).alias(f"bp{k}") for k, c in ((1, "pos"), (2, "pos2"))), F.count_if(F.col("turn") == 1).cast("int").alias("n_reads"), *_reads_by_hp()
    )
    return made.filter((F.col("n_reads") >= p.min_support) & _within(F.col("bp2") - F.col("bp1"), p))


def inv_alleles(clusters: DataFrame, by: list[str], p: Params = Params(), least: Column | None = None) -> DataFrame:
    """Breakpoints are means rounded half to even; ``strand`` is that of the first signal. ``least``: support of a cluster, over ``by``."""
    ties = ("pos", "strand", "read_name")
    chained = _once(_second_chain(clusters, by, p.gap_dup_inv, *ties), by, *ties)
    made = chained.groupBy(*sample(clusters), *by, "chrom", "allele").agg(
        *(F.bround(F.avg(c), 0).cast("long").alias(f"bp{k}") for k, c in ((1, "pos"), (2, "pos2"))),
        F.count(F.lit(1)).alias("n_signals"),
        F.count_if(F.col("turn") == 1).cast("int").alias("n_reads"),
        F.min(F.struct("pos", "pos2", "strand")).alias("first"),
        *_reads_by_hp(),
    )
    enough = F.lit(p.min_support) if least is None else least
    kept = made.filter((F.col("n_signals") >= enough) & (F.col("n_reads") >= enough) & _within(F.col("bp2") - F.col("bp1"), p))
    return kept.withColumn("strand", F.col("first.strand")).drop("first")


def bnd_alt(bnd_type: Column, chrom2: Column, pos2: Column) -> Column:
    """Text of a breakend."""
    place = F.concat(chrom2, F.lit(":"), pos2.cast("string"))
    made = {"A": ("N[", "["), "B": ("N]", "]"), "C": ("[", "[N"), "D": ("]", "]N")}
    out = None
    for kind, (before, after) in made.items():
        text = F.concat(F.lit(before), place, F.lit(after))
        out = F.when(bnd_type == kind, text) if out is None else out.when(bnd_type == kind, text)
    return out


def tra_alleles(clusters: DataFrame, p: Params = Params()) -> DataFrame:
    """The two alleles with most reads of each cluster, of two reads or more; the first signal of each read counts."""
    by, ties = ["win_id"], ("pos", "read_name")
    chained = _once(_second_chain(clusters, by, p.gap_tra, *ties), by, *ties).filter("turn = 1")
    made = chained.groupBy(*sample(clusters), "win_id", "chrom", "chrom2", "bnd_type", "allele").agg(
        F.floor(F.avg("pos")).alias("bp1"), F.floor(F.avg("pos2")).alias("bp2"), F.count(F.lit(1)).cast("int").alias("n_reads"), *_reads_by_hp()
    )
    rank = F.row_number().over(Window.partitionBy("win_id").orderBy(F.desc("n_reads"), "allele"))
    return made.withColumn("rank", rank).filter("rank <= 2 and n_reads > 1").drop("rank").withColumn("alt", bnd_alt(F.col("bnd_type"), F.col("chrom2"), F.col("bp2")))


def insert_sequence(chained: DataFrame, by: list[str]) -> DataFrame:
    """Of each allele the bases of the first signal, by length, that has the mean length at least, cut to it."""
    mean = chained.groupBy(*by, "allele").agg(F.floor(F.avg("len")).cast("int").alias("whole_len"))
    long = chained.join(mean, [*by, "allele"]).filter(F.length("ins_seq") >= F.col("whole_len"))
    best = long.groupBy(*by, "allele").agg(F.min(F.struct("len", "pos", "read_name", F.col("ins_seq").substr(F.lit(1), F.col("whole_len")).alias("bases"))).alias("best"))
    return mean.join(best, [*by, "allele"], "left").select(*by, "allele", F.coalesce("best.bases", F.lit("<INS>")).alias("ins_seq"))
