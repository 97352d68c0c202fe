"""P: filters and projections of alignments. Row-local except for the join with regions."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.cigar import signals
from ..params import Params
from .keys import sample


def filter_alignments(df: DataFrame) -> DataFrame:
    """Drop secondary alignments: flags exactly 256 and 272."""
    return df.filter(~F.col("flag").isin(256, 272))


def restrict_to_bed(df: DataFrame, bed: DataFrame, bin_size: int = 1 << 16) -> DataFrame:
    """Reads (ref_start, ref_end) that overlap a padded region.

    Of regions that don't touch, the last one that starts before a read's end decides. Each bin lists the regions that can be
    that, so a read looks up one bin, by an equi-join on a unique key: rows are neither multiplied nor told apart again, and
    Spark sends the regions to the reads, unshuffled, where their size allows.
    """
    by_start = Window.partitionBy("chrom").orderBy("bed_start", "bed_end")
    reach = F.max("bed_end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    new = bed.select("chrom", "bed_start", "bed_end", F.when(F.col("bed_start") <= reach, 0).otherwise(1).alias("new"))
    runs = new.withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("chrom", "run").agg(F.min("bed_start").alias("start"), F.max("bed_end").alias("end"))
    at = lambda c: F.floor(c / bin_size).cast("long")
    next_ = F.lead("start").over(Window.partitionBy("chrom").orderBy("run"))
    spread = whole.withColumn("next", F.coalesce(next_, "start")).select("chrom", F.struct("start", "end").alias("region"), F.explode(F.sequence(at(F.col("start")), at(F.col("next")))).alias("_bin"))
    listed = spread.groupBy(F.col("chrom").alias("_on"), "_bin").agg(F.collect_list("region").alias("_regions"))
    ends = whole.groupBy(F.col("chrom").alias("_of")).agg(F.max(F.struct("start", "end")).alias("_end"))
    found = df.withColumn("_at", at(F.col("ref_end") - 1))
    found = found.join(listed, [F.col("chrom") == F.col("_on"), F.col("_at") == F.col("_bin")], "left").join(ends, F.col("chrom") == F.col("_of"), "left")
    inside = F.exists("_regions", lambda r: (r["start"] < F.col("ref_end")) & (r["end"] > F.col("ref_start")))
    after = (F.col("_at") > at(F.col("_end.start"))) & (F.col("_end.end") > F.col("ref_start"))
    return found.filter(F.coalesce(inside, F.lit(False)) | F.coalesce(after, F.lit(False))).select(*df.columns)


def reads_table(df: DataFrame, min_mapq: int = Params.min_mapq) -> DataFrame:
    """(chrom, ref_start, ref_end, is_primary, read_name, hp) of reads mapped well enough."""
    ops = S.parse_cigar(F.col("cigar"))
    return df.filter(F.col("mapq") >= min_mapq).select(
        *sample(df), "chrom", "ref_start", (F.col("ref_start") + S.reference_span(ops)).alias("ref_end"), F.col("flag").isin(0, 16).cast("int").alias("is_primary"), "read_name", "hp"
    )


def at_least(n: int) -> str:
    """Pattern of whole numbers of at least ``n``, which is positive, without leading zeros."""
    digits = str(n)
    # longer ones; or those that are greater in one digit and equal before it; or n
    more = [f"[1-9][0-9]{{{len(digits)},}}"]
    more += [f"{digits[:k]}[{int(d) + 1}-9][0-9]{{{len(digits) - k - 1}}}" for k, d in enumerate(digits) if d != "9"]
    return "(?:" + "|".join([*more, digits]) + ")"


def cigar_signals(df: DataFrame, p: Params = Params()) -> DataFrame:
    """(chrom, read_name, hp, svtype, pos, len, bases) of every long insertion and deletion. No shuffle."""
    return _listed(df, signals(p.min_siglength), p)


def merge_in_read(df: DataFrame, p: Params = Params(), uniform_gap: bool = False) -> DataFrame:
    """cigar_signals() after joining neighbours of one type within each read where nothing of the other lies between. No shuffle.

    The gap of insertions is from start to start. That of deletions is from the end; only a group after the first, while it
    has one member, is measured from its start, unless ``uniform_gap``.
    """
    return _listed(df, signals(p.min_siglength, p.merge_gap, uniform_gap), p)


def _listed(df: DataFrame, found: Callable[[str], Column], p: Params) -> DataFrame:
    """A row for each signal; the bases of insertions are cut where the read's still are in the row."""
    some = F.col("cigar").rlike(f"(?:^|[^0-9])0*{at_least(p.min_siglength)}[ID]")  # most reads have no long enough operation
    able = df.filter((F.col("mapq") >= p.min_mapq) & (F.col("query_len") >= p.min_read_len) & some)
    rows = able.select(*sample(df), "chrom", "read_name", "hp", F.col("ref_start").cast("long").alias("_start"), "query_seq", F.inline(found("cigar")))
    cut = lambda x: F.col("query_seq").substr((x["query"] + 1).cast("int"), x["len"].cast("int"))
    bases = F.when(F.size("parts") == 1, cut(F.get("parts", F.lit(0)))).otherwise(F.aggregate("parts", F.lit(""), lambda acc, x: F.concat(acc, cut(x))))
    return rows.select(*sample(df), "chrom", "read_name", "hp", "svtype", (F.col("_start") + F.col("ahead")).alias("pos"), "len", F.when(F.col("svtype") == "INS", bases).alias("bases"))


def segment(ops: Column, ref_start: Column, chrom: Column, strand: Column) -> Column:
    """struct(read_start, read_end, ref_start, ref_end, chrom, strand) of one alignment."""
    left = F.when(strand == "-", S.right_clip(ops)).otherwise(S.left_clip(ops))
    return F.struct(left.alias("read_start"), (left + S.query_span(ops)).alias("read_end"), ref_start.alias("ref_start"), (ref_start + S.reference_span(ops)).alias("ref_end"), chrom.alias("chrom"), strand.alias("strand"))


def split_segments(df: DataFrame, p: Params = Params(), sa_zero_based: bool = False, bases: bool = False) -> DataFrame:
    """Primary rows with supplementary alignments as ``segs``, in read order; ``read_len`` for flipping.

    Where the primary is mapped well all entries count, else those that are. Entries keep their start as given, unless
    ``sa_zero_based``. ``bases`` keeps ``query_seq``, in which insertions are read.
    """
    rows = df.filter(F.col("flag").isin(0, 16) & F.col("sa").isNotNull() & (F.col("query_len") >= p.min_read_len))
    good = F.col("mapq") >= p.min_mapq
    strand, both = F.when(F.col("flag") == 16, "-").otherwise("+"), ("M", "I", "S", "H", "=", "X")
    read_len = lambda ops: F.aggregate(ops, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["op"].isin(*both), x["len"]).otherwise(0))
    own = S.let(S.parse_cigar(F.col("cigar")), lambda ops: F.struct(segment(ops, F.col("ref_start").cast("long"), F.col("chrom"), strand).alias("seg"), read_len(ops).alias("len")))
    parts = F.transform(F.filter(F.split("sa", ";"), lambda x: x != ""), lambda x: F.split(x, ","))
    parts = F.filter(parts, lambda x: good | (x[4].cast("int") >= p.min_mapq))
    more = F.transform(parts, lambda x: S.let(S.parse_cigar(x[3]), lambda ops: segment(ops, x[1].cast("long") - (1 if sa_zero_based else 0), x[0], x[2])))
    none = F.array().cast("array<struct<read_start:bigint,read_end:bigint,ref_start:bigint,ref_end:bigint,chrom:string,strand:string>>")
    made = S.let(own, lambda x: F.struct(F.array_sort(F.concat(F.when(good, F.array(x["seg"])).otherwise(none), more)).alias("segs"), x["len"].alias("read_len")))
    kept = ["query_seq"] if bases else []
    # each row's texts are parsed once: a generated column isn't computed again by what reads it
    found = rows.select(*sample(df), "read_name", "hp", *kept, F.inline_outer(F.array(made)))
    return found.filter(F.size("segs") > 0).select(*sample(df), "read_name", "hp", "segs", "read_len", *kept)


def clip_points(split: DataFrame) -> DataFrame:
    """(chrom, read_name, side, pos, hp): start of a read's first segment and end of its last."""
    first, last = F.get("segs", F.lit(0)), F.element_at("segs", -1)
    ends = F.array(
        F.struct(first["chrom"].alias("chrom"), F.lit(0).alias("side"), first["ref_start"].alias("pos")), F.struct(last["chrom"].alias("chrom"), F.lit(1).alias("side"), last["ref_end"].alias("pos"))
    )
    return split.select(*sample(split), "read_name", "hp", F.inline(ends)).select(*sample(split), "chrom", "read_name", "side", "pos", "hp")


def plain_clip_points(df: DataFrame, min_mapq: int = Params.min_mapq) -> DataFrame:
    """The same of reads without supplementary alignments, if mapped well enough."""
    rows = reads_table(df.filter(F.col("flag").isin(0, 16) & F.col("sa").isNull()), min_mapq)
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("ref_start").alias("pos")), F.struct(F.lit(1).alias("side"), F.col("ref_end").alias("pos")))
    return rows.select(*sample(df), "chrom", "read_name", "hp", F.inline(ends)).select(*sample(df), "chrom", "read_name", "side", "pos", "hp")
