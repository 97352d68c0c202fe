"""J: joins of intervals and points, as equi-joins on bins.

Both sides are dealt into bins of about a read's length; a pair is made only in its first shared bin, so it is made once. A
sample of the rows tells the bins that hold more than a quarter of an average partition, so no more of them than four times
the number of partitions. Such a bin is dealt into parts by a hash of its rows, and its windows go to each part: a centromere
with half of all reads is spread as evenly as the rest. Keys are led by the sample where tables have one; ``win_id`` names a
window among those of all samples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import CHAIN_BITS, alike, chain_bin, renamed, sample

BIN = 1 << 14
#: One row in this many is looked at for crowded bins, and parts of a partition that a bin may hold. They change no result.
SAMPLED, SHARE = 8, 4


def bins(start: str | Column, end: str | Column, size: int = BIN) -> Column:
    """Array of the bins that [start, end] touches."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    at = lambda x: F.floor(x / size).cast("long")
    return F.sequence(at(c(start)), F.greatest(at(c(start)), at(c(end))))


@dataclass(frozen=True)
class Dealt:
    """Rows dealt into bins, for any number of joins: ``rows`` with bin and part, ``crowded`` (keys, bin, parts) of full bins."""

    rows: DataFrame
    crowded: DataFrame
    size: int
    keys: list[str]

    def filter(self, condition: Column | str) -> Dealt:
        return Dealt(self.rows.filter(condition), self.crowded, self.size, self.keys)


def crowded_bins(rows: DataFrame, start: str = "ref_start", end: str = "ref_end", size: int = BIN, share: int = SHARE) -> DataFrame:
    """(keys, bin, parts) of the bins that hold a large share of a sample of the rows: at most ``share`` times the number of partitions."""
    keys = [*sample(rows), "chrom"]
    own = F.xxhash64("read_name", start, end)
    some = rows.filter(F.pmod(own, F.lit(SAMPLED)) == 0).select(*keys, F.explode(bins(start, end, size)).alias("bin"))
    counts = some.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    least = counts.agg(F.greatest(F.sum("n") / (share * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.lit(1.0))).scalar()
    return counts.withColumn("parts", F.ceil(F.col("n") / least).cast("int")).filter("parts > 1").select(*keys, "bin", "parts")


def deal(rows: DataFrame, start: str = "ref_start", end: str = "ref_end", size: int = BIN, share: int = SHARE, once: bool = False) -> Dealt:
    """Deal reads, or points, into bins and crowded bins into parts; ``once``: the crowded bins are looked up now, for many joins."""
    keys = [*sample(rows), "chrom"]
    own = F.xxhash64("read_name", start, end)
    crowded = crowded_bins(rows, start, end, size, share)
    if once:
        crowded = rows.sparkSession.createDataFrame(crowded.collect(), crowded.schema)
    spread = rows.select("*", F.explode(bins(start, end, size)).alias("bin"))
    # no more rows than share times the number of partitions: a bound that Spark can't know
    told = spread.join(F.broadcast(crowded), [*keys, "bin"], "left")
    parted = told.select(*spread.columns, F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(own, F.col("parts"))).cast("int").alias("part"))
    return Dealt(parted, crowded, size, keys)


def dealt(rows: DataFrame | Dealt, size: int = BIN) -> Dealt:
    return rows if isinstance(rows, Dealt) else deal(rows, size=size)


def _met(windows: DataFrame, reads: Dealt, where: Column, cond: Column) -> DataFrame:
    """Windows (win_id, w_start, w_end) in the bins ``where`` with the rows of these for which ``cond`` holds."""
    if sample(windows) != [k for k in reads.keys if k != "chrom"]:
        raise ValueError("windows and reads must both have a sample, or neither")
    asked = windows.select(*reads.keys, "win_id", "w_start", "w_end", F.explode(where).alias("bin"))
    told = asked.join(F.broadcast(reads.crowded), [*reads.keys, "bin"], "left")
    spread = told.select(*asked.columns, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("part"))
    own = [*reads.keys, "bin", "part"]
    other = reads.rows.select(*renamed(own, "r_"), *(c for c in reads.rows.columns if c not in own))
    return spread.join(other, alike(own, "r_") & cond).drop(*("r_" + c for c in own), "part")


def _pairs(windows: DataFrame, reads: DataFrame | Dealt, size: int) -> DataFrame:
    held = dealt(reads, size)
    first = F.greatest(F.floor(F.col("w_start") / held.size), F.floor(F.col("ref_start") / held.size))
    return _met(windows, held, bins("w_start", "w_end", held.size), (F.col("bin") == first) & (F.col("ref_start") < F.col("w_end")) & (F.col("ref_end") > F.col("w_start"))).drop("bin")


def overlapping_reads(windows: DataFrame, reads: DataFrame | Dealt, size: int = BIN) -> DataFrame:
    """One row for each window and read name that overlaps it strictly; of a name's rows a primary one, then the first."""
    best = F.min(F.struct((1 - F.col("is_primary")).alias("other"), "ref_start", "ref_end", "hp")).alias("best")
    found = _pairs(windows, reads, size).groupBy("win_id", "read_name").agg(best)
    return found.select("win_id", "read_name", (1 - F.col("best.other")).alias("is_primary"), F.col("best.ref_start").alias("ref_start"), F.col("best.ref_end").alias("ref_end"), F.col("best.hp").alias("hp"))


def _by_hp(found: DataFrame) -> DataFrame:
    return found.groupBy("win_id").agg(*(F.count_if(F.col("hp") == h).alias(f"h{h}") for h in (0, 1, 2)))


def haplotype_histogram(windows: DataFrame, reads: DataFrame | Dealt, size: int = BIN) -> DataFrame:
    """(win_id, h0, h1, h2): distinct overlapping reads by haplotype; windows without reads have zeros."""
    counted = _by_hp(overlapping_reads(windows, reads, size))
    return windows.select("win_id").join(counted, "win_id", "left").select("win_id", *(F.coalesce(f"h{h}", F.lit(0)).alias(f"h{h}") for h in (0, 1, 2)))


def _cover(windows: DataFrame, reads: DataFrame | Dealt, size: int) -> DataFrame:
    """Reads over a whole window, both ends included; a window probes the one bin of its start."""
    held = dealt(reads, size)
    return _met(windows, held, F.array(F.floor(F.col("w_start") / held.size).cast("long")), (F.col("ref_start") <= F.col("w_start")) & (F.col("ref_end") >= F.col("w_end")))


def covering_reads(windows: DataFrame, reads: DataFrame | Dealt, size: int = BIN) -> DataFrame:
    """(win_id, read_name, hp): primary reads over the whole window, by distinct name."""
    return _cover(windows, reads.filter("is_primary = 1"), size).groupBy("win_id", "read_name").agg(F.min("hp").alias("hp"))


def overlapping_primary_reads(windows: DataFrame, reads: DataFrame | Dealt, size: int = BIN) -> DataFrame:
    """(win_id, read_name, hp): primary reads that overlap the window strictly, by distinct name."""
    return _pairs(windows, reads.filter("is_primary = 1"), size).groupBy("win_id", "read_name").agg(F.min("hp").alias("hp"))


def reference_reads(cover: DataFrame, support: DataFrame) -> DataFrame:
    """(win_id, dr, r0, r1, r2): covering reads that don't support the call."""
    rest = cover.join(support.select("win_id", "read_name"), ["win_id", "read_name"], "left_anti")
    return rest.groupBy("win_id").agg(F.count(F.lit(1)).alias("dr"), *(F.count_if(F.col("hp") == h).alias(f"r{h}") for h in (0, 1, 2)))


def clips_in_window(windows: DataFrame, clips: DataFrame, size: int = BIN, sides: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(win_id, read_name, side, pos, hp): points strictly within a window."""
    points = clips.filter(F.col("side").isin(*sides)).select(*sample(clips), "chrom", "read_name", "side", "pos", "hp")
    inside = (F.col("pos") > F.col("w_start")) & (F.col("pos") < F.col("w_end"))
    return _met(windows, deal(points, "pos", "pos", size), bins("w_start", "w_end", size), inside).select("win_id", "read_name", "side", "pos", "hp")


def tra_clip_support(calls: DataFrame, support: DataFrame, clips: DataFrame, reach: int = 25) -> DataFrame:
    """``support`` (win_id, read_name, hp) with the reads of gap-edge points within ``reach`` of a call's first breakpoint."""
    near = calls.select(*sample(calls), "win_id", "chrom", (F.col("pos") - reach).alias("w_start"), (F.col("pos") + reach).alias("w_end"))
    more = clips_in_window(near, clips, sides=(2,)).groupBy("win_id", "read_name").agg(F.min("hp").alias("hp"))
    new = more.join(support.select("win_id", "read_name"), ["win_id", "read_name"], "left_anti")
    return support.select("win_id", "read_name", "hp").unionByName(new)


def two_point_cover(calls: DataFrame, reads: DataFrame | Dealt, gap: int = 500) -> DataFrame:
    """(win_id, read_name, hp): reads over the surroundings of either breakpoint."""
    around = F.array(*(F.struct((F.col(c) - gap // 2).alias("w_start"), (F.col(c) + gap // 2).alias("w_end")) for c in ("pos", "pos2")))
    found = covering_reads(calls.select(*sample(calls), "win_id", "chrom", F.inline(around)), reads)
    return found.groupBy("win_id", "read_name").agg(F.min("hp").alias("hp"))


def covering_histogram(windows: DataFrame, reads: DataFrame | Dealt, size: int = BIN) -> DataFrame:
    """(win_id, h0, h1, h2) of all rows over the window, neither primary nor distinct by name."""
    return _by_hp(_cover(windows, reads, size).select("win_id", "hp"))


def islands(df: DataFrame, keys: list[str], order: list[str], breaks, size: int = 1 << CHAIN_BITS) -> DataFrame:
    """``df`` with ``cluster_no``, from 0 for each key: a row opens a new cluster where ``breaks(previous, row)`` holds.

    Two levels, so that a chromosome isn't one task: rows are compared within bins of ``order[0]``; a small table of each
    bin's first and last row and number of clusters joins the bins. Rows are shuffled once, or not at all where they have
    their bins already, as ``_bin``, and lie by them (sources.io.store_signatures).
    """
    row = F.struct(*order)
    binned = df if "_bin" in df.columns else df.withColumn("_bin", chain_bin(F.col(order[0]), size))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_bin")
    opens = lambda prev, own: F.when(prev.isNull(), 0).when(breaks(prev, own), 1).otherwise(0)
    flagged = binned.withColumn("_prev", F.lag(row).over(inside)).withColumn("_new", opens(F.col("_prev"), row)).drop("_prev")
    running = flagged.withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # grouped as the rows are dealt already: a row for each bin
    edges = flagged.groupBy(*keys, "_bin").agg(F.min(row).alias("_first"), F.max(row).alias("_last"), F.sum("_new").alias("_n"))
    edges = edges.withColumn("_prev", F.lag("_last").over(across)).withColumn("_new", opens(F.col("_prev"), F.col("_first")))
    before = F.coalesce(F.sum(F.col("_n") + F.col("_new")).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = edges.select(*keys, "_bin", (before + F.col("_new")).alias("_offset"))
    return running.join(offset, [*keys, "_bin"]).withColumn("cluster_no", F.col("_run") + F.col("_offset")).drop("_bin", "_new", "_run", "_offset")
