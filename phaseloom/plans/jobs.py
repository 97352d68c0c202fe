"""End-to-end jobs: signals from alignments, germline and mosaic calls of all types, and their VCF.

What several steps read is kept by a Job, ten tables at most, which the caller closes once the results have been read or
written. Deletions and insertions of all three routes take their clips and their reads together, and so do duplications and
inversions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import parse_cigar, reference_span
from ..operators import alleles as A
from ..operators import cluster as C
from ..operators import genotype as G
from ..operators import intervals as J
from ..operators import phase as D
from ..operators import reads as P
from ..operators import resolve as R
from ..operators import signals as U
from ..operators import split as X
from ..operators import vcf as V
from ..operators.allele_dp import allele_dp
from ..operators.keys import SAMPLE, sample
from ..params import Params
from ..sources import io
from .job import Job

#: Columns of a call, after its sample where there is one; those that a type lacks are null.
CALL = {
    "call_id": "string", "chrom": "string", "svtype": "string", "pos": "long", "svlen": "long", "chrom2": "string", "pos2": "long", "alt": "string", "strand": "string", "dv": "int", "dr": "int",
    "gt": "string", "pl": "string", "gq": "int", "qual": "double", "cipos": "string", "cilen": "string", "ins_seq": "string",
}
#: Length from which a mosaic deletion or insertion takes clipped reads.
MOSAIC_CLIPS = 2000
#: Columns of a deletion or insertion while it waits for clipped reads and reads against it.
_OPEN = ["call_id", "win_id", "chrom", "svtype", "route", "rank", "least", "pos", "svlen", "c_low", "c_high", "haplotypes", "rescue", "w_start", "w_end", "tight", "shown", "s0", "s1", "s2", "gt", "cipos", "cilen", "ins_seq"]


def extract_signatures(alignments: DataFrame, bed: DataFrame | None = None, p: Params = Params(), job: Job | None = None) -> dict[str, DataFrame]:
    """``sig`` (all five types, with the bases of insertions), ``clips`` and ``reads`` of an alignment table.

    The bases of split reads are cut in the row that has them; signals of split reads, which two of the tables take, are kept
    by ``job``.
    """
    kept = P.filter_alignments(alignments)
    if bed is not None:
        kept = P.restrict_to_bed(kept.withColumn("ref_end", F.col("ref_start") + reference_span(parse_cigar(F.col("cigar")))), bed).drop("ref_end")
    of, names = sample(kept), ["svtype", "chrom", "pos", "len", "pos2", "chrom2", "strand", "bnd_type", "read_name", "hp", "ins_seq"]
    split = P.split_segments(kept, p, bases=True)  # most reads have no split
    far = X.split_signals(split, p).select(*of, *names, "side")
    far = far if job is None else job.kept("split_signals", far)
    near = P.merge_in_read(kept, p).withColumn("pos", F.col("pos").cast("double")).withColumnRenamed("bases", "ins_seq")
    blank = {c: F.lit(None).cast(t) for c, t in (("pos2", "long"), ("chrom2", "string"), ("strand", "string"), ("bnd_type", "string"))}
    sig = U.dedup_signals(U.union_signals(near.withColumns(blank).select(*of, *names), far.filter("svtype <> 'CLIP'").select(*of, *names)))
    edges = far.filter("svtype = 'CLIP'").select(*of, "chrom", "read_name", "side", F.col("pos").cast("long").alias("pos"), "hp")
    clips = P.clip_points(split.drop("query_seq")).unionByName(P.plain_clip_points(kept, p.min_mapq)).unionByName(edges)
    return {"sig": sig, "clips": clips, "reads": P.reads_table(kept, p.min_mapq)}


def counted(windows: DataFrame, support: DataFrame, reads: DataFrame | J.Dealt) -> DataFrame:
    """(win_id, dv, s1, s2, dr, r1, r2): supporting reads and covering reads against, by haplotype."""
    names = support.groupBy("win_id", "read_name").agg(F.min("hp").alias("hp"))
    for_ = names.groupBy("win_id").agg(F.count(F.lit(1)).alias("dv"), *(F.count_if(F.col("hp") == h).alias(f"s{h}") for h in (1, 2)))
    against = J.reference_reads(J.covering_reads(windows, reads), names)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("dr", "r1", "r2")]
    return for_.join(against, "win_id", "left").select("win_id", "dv", "s1", "s2", *zero)


def _against(calls: DataFrame, found: DataFrame, support: DataFrame) -> DataFrame:
    """``calls`` with dr, r1 and r2: reads found (win_id for call_id, read_name, hp) that don't support the call."""
    rest = J.reference_reads(found, support.select(F.col("call_id").alias("win_id"), "read_name"))
    joined = calls.join(rest.withColumnRenamed("win_id", "call_id"), "call_id", "left")
    return joined.select(*calls.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("dr", "r1", "r2")))


def _windows(calls: DataFrame, start: Column, end: Column) -> DataFrame:
    return calls.select(*sample(calls), F.col("call_id").alias("win_id"), "chrom", start.cast("long").alias("w_start"), end.cast("long").alias("w_end"))


def _as_calls(df: DataFrame) -> DataFrame:
    return df.select(*sample(df), *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in CALL.items()))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def all_clusters(sig: DataFrame, p: Params = Params(), mode: str = "germline") -> DataFrame:
    """Chains of all types that the mode calls; of deletions and insertions not yet those with too few signals."""
    of = lambda *kinds: sig.filter(F.col("svtype").isin(*kinds))
    made = [C.indel_clusters(of("DEL", "INS"), p.gap_indel), C.inv_clusters(of("INV"), p.gap_dup_inv, p.min_support, split_strand=mode == "mosaic")]
    if mode == "germline":
        made.append(C.dup_clusters(of("DUP"), p.gap_dup_inv, p.min_support).withColumn("strand", F.lit(None).cast("string")))
    made.append(C.tra_clusters(of("TRA"), p.gap_tra, last_needs=p.min_support if mode == "mosaic" else None))
    return _all(*made)


def routes(clusters: DataFrame, reads: DataFrame | J.Dealt, p: Params, mode: str) -> DataFrame:
    """One row for each cluster that is kept, of all types but translocations: its window, n_signals, least and route.

    A cluster of more than ``p.max_cluster`` signals, as dense places chain, is an error; no row is ever dropped for its size.
    """
    at, kind = F.col("pos").cast("long"), F.col("svtype")
    reach = F.when(kind == "INV", p.gap_dup_inv // 2).when(kind == "DUP", p.gap_dup_inv).otherwise(p.gap_indel)
    own = clusters.filter(kind != "TRA")
    sized = own.groupBy(*sample(clusters), "win_id", "svtype", "chrom").agg(F.count(F.lit(1)).alias("n_signals"), F.avg("len").alias("mean_len"), F.min(at).alias("low"), F.max(at).alias("high"))
    if p.max_cluster != -1:
        told = F.concat(F.lit("cluster "), "win_id", F.lit(" has "), F.col("n_signals").cast("string"), F.lit(f" signals, over the limit of {p.max_cluster}"))
        sized = sized.withColumn("n_signals", F.when(F.col("n_signals") > p.max_cluster, F.raise_error(told).cast("long")).otherwise(F.col("n_signals")))
    windows = sized.withColumns({"w_start": F.greatest(F.col("low") - reach, F.lit(0)), "w_end": F.col("high") + reach}).filter(kind.isin("DUP", "INV") | C.enough_signals(mode, p.min_support)).drop("mean_len", "low", "high")
    hist = J.haplotype_histogram(windows, reads)
    h0, h1, h2 = (F.col(f"h{k}") for k in (0, 1, 2))
    by_type = lambda f: F.when(kind == "DUP", f("DUP")).when(kind == "INV", f("INV")).otherwise(f("DEL"))
    told = windows.join(hist, "win_id").withColumns({"balanced": by_type(lambda t: D.is_balanced(h0, h1, h2, t, mode)), "least": by_type(lambda t: D.min_support_by_depth(h0 + h1 + h2, t, mode, p.min_support))})
    return D.route_clusters(told).drop("balanced", "h0", "h1", "h2")


def haplotype_alleles(chained: DataFrame, told: DataFrame, p: Params, mode: str) -> DataFrame:
    """Statistics of the alleles of each haplotype that have enough signals, with ``ins_seq``."""
    by = ["win_id", "hp"]
    need = F.col("least") if mode == "germline" else F.when(F.col("hp") == 0, 2 * p.min_support).otherwise(p.min_support)
    stats = A.allele_stats(chained, by, mode).join(told.select("win_id", "least"), "win_id").filter(F.col("n_signals") >= need).drop("least")
    return _with_bases(stats, chained, by, mode)


def _with_bases(stats: DataFrame, chained: DataFrame, by: list[str], mode: str) -> DataFrame:
    """``stats`` with ``ins_seq``; mosaic calls never show bases."""
    if mode != "germline":
        return stats.withColumn("ins_seq", F.lit("<INS>"))
    bases = A.insert_sequence(chained.filter("svtype = 'INS'"), by)
    return stats.join(bases, [*by, "allele"], "left").withColumn("ins_seq", F.coalesce("ins_seq", F.lit("<INS>")))


def _open_balanced(chained: DataFrame, told: DataFrame, p: Params, mode: str, job: Job) -> tuple[DataFrame, DataFrame]:
    """Alleles of the haplotypes, paired, as open calls, and their support."""
    own = chained.filter("route = 'haplotypes'").drop("side", "route")
    need = told.select("win_id", F.col("least") if mode == "germline" else F.lit(p.min_support).alias("least"))
    calls, support = R.merge_haplotypes_indel(own, job.kept("haplotype_alleles", haplotype_alleles(own, told, p, mode)), need, p, mode)
    calls = R.ranked(calls.join(told.select(*sample(told), "win_id", "svtype", "chrom"), "win_id"), F.desc(F.col("s0") + F.col("s1") + F.col("s2")), "turn")
    ins, length = F.col("svtype") == "INS", F.floor("size")
    reach = F.least(F.lit(p.gap_indel), length + 50)
    seen = lambda at, h: F.when(F.substring("gt", at, 1) == "1", h)
    made = calls.withColumns({
        "route": F.lit("haplotypes"),
        "least": F.lit(0),
        "svlen": length,
        "c_low": F.when(ins, F.least("min_pos", F.col("pos") - reach)).otherwise(F.col("min_pos")),
        "c_high": F.when(ins, F.greatest("max_pos", F.col("pos") + reach)).otherwise(F.col("max_pos")),
        "haplotypes": F.array_compact(F.array(F.lit(0), seen(1, 1), seen(3, 2))),
        "rescue": F.lit(True) if mode == "germline" else length > MOSAIC_CLIPS,
        "w_start": F.greatest(F.col("pos") - p.gap_indel, "min_pos"),
        "w_end": F.least(F.col("pos") + p.gap_indel, "max_pos"),
        "tight": F.lit(False),
        "shown": F.lit(0),
    })
    return made, support


def _open_dp(clusters: DataFrame, told: DataFrame, p: Params, mode: str, job: Job) -> tuple[DataFrame, DataFrame]:
    """Alleles of the dynamic program as open calls, and their support."""
    germline = mode == "germline"
    own = clusters.filter("route = 'dp'")
    members = job.kept("members", allele_dp(own))
    made = members.groupBy("win_id", "allele", "start", "length").agg(
        F.count(F.lit(1)).cast("int").alias("shown"), F.stddev_pop("pos").alias("std_pos"), F.stddev_pop("len").alias("std_len")
    )
    made = made.join(told.select(*sample(told), "win_id", "svtype", "chrom", "least"), "win_id")
    if germline:
        bases = R.dp_insert_sequence(members.join(told.filter("svtype = 'INS'").select("win_id"), "win_id", "left_semi"), own.filter("svtype = 'INS'"))
        made = made.filter(F.col("length") >= p.min_size).join(bases, ["win_id", "allele"], "left")
    else:
        made = made.withColumns({"ins_len": F.lit(None).cast("long"), "ins_seq": F.lit("<INS>")})
    call = F.concat_ws("/", "win_id", F.lit("d"), "allele")
    support = members.groupBy("win_id", "allele", "read_name").agg(F.min("hp").alias("hp")).select(call.alias("call_id"), "win_id", "read_name", "hp")
    reach = F.least(F.lit(p.gap_indel), F.col("length") + 50)
    blank = F.lit("./.")
    made = R.ranked(made, F.desc("shown") if germline else F.col("shown"), "allele").withColumns({
        "call_id": call,
        "route": F.lit("dp"),
        "pos": F.col("start"),
        "svlen": F.coalesce("ins_len", "length"),
        "c_low": F.col("start") - reach,
        "c_high": F.col("start") + reach,
        "haplotypes": F.lit(None).cast("array<int>"),
        "rescue": F.lit(True) if germline else F.col("length") > MOSAIC_CLIPS,
        "w_start": F.col("start") - p.gap_indel,
        "w_end": F.col("start") + p.gap_indel,
        "tight": F.lit(False),
        **{f"s{h}": F.lit(None).cast("int") for h in (0, 1, 2)},  # of the reads, below
        "gt": F.lit(None).cast("string"),
        "cipos": A.interval(F.col("std_pos"), F.col("shown")) if germline else blank,
        "cilen": A.interval(F.col("std_len"), F.col("shown")) if germline else blank,
        "ins_seq": F.coalesce("ins_seq", F.lit("<INS>")),
    })
    return made, support


def _open_pooled(chained: DataFrame, told: DataFrame, p: Params, mode: str) -> tuple[DataFrame, DataFrame]:
    """Alleles by length over all haplotypes as open calls, and their support."""
    germline = mode == "germline"
    own, by = chained.filter("route = 'length_chain'").drop("side", "route"), ["win_id", "allele"]
    ends = [
        F.min(F.struct("len", "pos", "read_name"))["pos"].alias("short_pos"),
        F.max(F.struct("len", "pos", "read_name"))["pos"].alias("long_pos"),
        *(F.count_if(F.col("hp") == h).cast("int").alias(f"s{h}") for h in (1, 2)),
    ]
    made = A.allele_stats(own, ["win_id"], more=ends).join(told.select(*sample(told), "win_id", "svtype", "chrom", "least"), "win_id")
    made = _with_bases(made, own, ["win_id"], mode)
    call = F.concat_ws("/", "win_id", F.lit("p"), "allele")
    support = own.groupBy("win_id", "allele", "read_name").agg(F.min("hp").cast("int").alias("hp")).select(call.alias("call_id"), "win_id", "read_name", "hp")
    ins, mean, pos = F.col("svtype") == "INS", F.col("avg_pos"), F.floor("avg_pos")
    start, end = G.search_window(pos, F.col("min_pos").cast("long"), F.col("max_pos").cast("long"), p.gap_indel)
    made = R.ranked(made, F.desc("n_signals"), "allele").withColumns({
        "call_id": call,
        "route": F.lit("length_chain"),
        "pos": pos,
        "svlen": F.floor("avg_len"),
        "c_low": F.when(ins, F.least(F.col("short_pos"), mean - p.gap_indel)).otherwise(F.col("short_pos")),
        "c_high": F.when(ins, F.greatest(F.col("long_pos"), mean + p.gap_indel)).otherwise(F.col("long_pos")),
        "haplotypes": F.lit(None).cast("array<int>"),
        "rescue": F.lit(True) if germline else F.col("min_len") > MOSAIC_CLIPS,
        "w_start": start,
        "w_end": end,
        "tight": (F.col("std_pos") < 1) & (F.col("std_len") < 1),
        "shown": F.col("n_signals").cast("int"),
        "s0": F.lit(None).cast("int"),
        "gt": F.lit(None).cast("string"),
    })
    return made, support


def _shaped(open_: DataFrame) -> DataFrame:
    """Open calls of any route under one schema."""
    kinds = {"rank": "int", "least": "int", "pos": "long", "svlen": "long", "c_low": "double", "c_high": "double", "haplotypes": "array<int>", "w_start": "long", "w_end": "long", "shown": "int", "s0": "int", "s1": "int", "s2": "int"}
    return open_.select(*sample(open_), *(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in _OPEN))


def _finished_balanced(told: DataFrame, p: Params, mode: str) -> DataFrame:
    """Genotypes of paired alleles from reads for and against."""
    gt, s1, s2, r1, r2, dv, dr = (F.col(c) for c in ("gt", "s1", "s2", "r1", "r2", "dv", "dr"))
    up = G.upgrade_unphased(gt, dv, dr, s1, s2)
    if mode == "germline":
        revised = G.revise_haplotype(gt, s1, s2, r1, r2)
    else:
        revised = G.revise_haplotype_mosaic(gt, s1, s2, r1, r2, "DEL")
        up = F.when((dv / (dv + dr) >= 0.9) | (dr < 2), up).otherwise(gt)
    done = told.withColumn("gt", F.when(F.contains(gt, F.lit("1")), revised).otherwise(up))
    if mode == "germline":
        return _as_calls(G.resolve_same_position(done.withColumn("allele", F.col("rank"))).drop("dr"))
    return _as_calls(done.filter(~F.contains(F.col("gt"), F.lit("1")) & (F.col("svlen") >= p.min_size)).drop("dr"))


def _finished_pooled(told: DataFrame, p: Params, mode: str) -> DataFrame:
    """Genotypes of alleles of all haplotypes from their likelihoods."""
    plain = told.drop("gt")
    if mode == "germline":
        done = G.genotyped(plain)
        done = done.withColumn("qual", G.zero_weak_quality(F.col("qual"), F.col("dv"), F.col("dr"), F.col("tight")))
    else:
        done = G.mosaic_filter_indel(G.assign_genotype_mosaic(plain), p.min_size)
    return _as_calls(done.withColumn("dv", F.col("shown")))


def indel_calls(clusters_: DataFrame, told: DataFrame, clips: DataFrame, reads: DataFrame | J.Dealt, p: Params, mode: str, job: Job) -> tuple[DataFrame, DataFrame]:
    """Calls of deletions and insertions, and (call_id, read_name) of their support; ``told`` as routes()."""
    germline, told = mode == "germline", told.filter("svtype in ('DEL', 'INS')")
    clusters = clusters_.join(told.select("win_id", "route", (F.col("n_signals") >= (F.col("least") if germline else F.lit(p.min_support))).alias("pooled")), "win_id")
    # both chains by length in one pass: of each haplotype, or of all signals of a cluster with enough of them
    able = clusters.filter("route = 'haplotypes' or route = 'length_chain' and pooled").withColumn("side", F.when(F.col("route") == "haplotypes", F.col("hp")).otherwise(-1))
    chained = job.kept("chained", A.length_chain(able, ["win_id", "side"], p.len_ratio))
    parts = [_open_balanced(chained, told, p, mode, job), _open_dp(clusters, told, p, mode, job), _open_pooled(chained, told, p, mode)]
    calls = job.kept("open_calls", _all(*(_shaped(x[0]) for x in parts)))
    support = job.kept("indel_support", _all(*(x[1] for x in parts)).join(calls.select("call_id"), "call_id", "left_semi"))
    asking = calls.select("call_id", "win_id", "rank", "c_low", "c_high", (F.col("svtype") == "INS").alias("both_sides"), "haplotypes", "rescue")
    more = job.kept("rescued", R.rescue_clips(asking, support, J.clips_in_window(told.drop("least", "n_signals", "route"), clips)))
    of_hp = lambda name: [F.count_if(F.col("hp") == h).cast("int").alias(f"{name}{h}") for h in (0, 1, 2)]
    by_read = support.groupBy("call_id").agg(F.count(F.lit(1)).cast("int").alias("reads"), *of_hp("n"))
    by_clip = more.groupBy("call_id").agg(F.count(F.lit(1)).cast("int").alias("clipped"), *of_hp("c"))
    sized = calls.join(by_read, "call_id", "left").join(by_clip, "call_id", "left").na.fill(0, ["reads", "clipped", *(f"{x}{h}" for x in "nc" for h in (0, 1, 2))])
    paired = F.col("route") == "haplotypes"
    held = {f"s{h}": F.when(paired, F.col(f"s{h}") + F.col(f"c{h}")).otherwise(F.coalesce(f"s{h}", f"n{h}")) for h in (0, 1, 2)}
    shown = F.when(F.col("route") == "length_chain", F.col("shown") + F.col("clipped")).otherwise(F.col("shown"))
    sized = sized.withColumns(held).withColumn("shown", shown).withColumn("dv", F.when(paired, F.col("s0") + F.col("s1") + F.col("s2")).otherwise(F.col("reads") + F.col("clipped")))
    enough = F.when(F.col("route") == "dp", F.col("dv")).otherwise(F.col("shown")) >= F.col("least")
    kept = sized.filter(paired | (enough & (F.lit(not germline) | (F.col("route") == "dp") | (F.col("svlen") >= p.min_size)))).drop("reads", "clipped", *(f"{x}{h}" for x in "nc" for h in (0, 1, 2)))
    support = support.unionByName(more)
    at = lambda rows: rows.select(*sample(rows), F.col("call_id").alias("win_id"), "chrom", "w_start", "w_end")
    if germline:
        met = J.covering_reads(at(kept), reads)
    else:
        met = J.covering_reads(at(kept.filter(paired)), reads).unionByName(J.overlapping_primary_reads(at(kept.filter(~paired)), reads))
    judged = _against(kept, met, support)
    return _finished_balanced(judged.filter(paired), p, mode).unionByName(_finished_pooled(judged.filter(~paired), p, mode)), support.select("call_id", "read_name")


def two_breakpoint_alleles(clusters: DataFrame, told: DataFrame, p: Params, mode: str) -> tuple[DataFrame, DataFrame]:
    """Alleles of duplications (germline only) and inversions with ``balanced`` and ``side`` (a haplotype, or -1: all), and their support."""
    asked = told.filter("svtype in ('DUP', 'INV')").select("win_id", (F.col("route") == "haplotypes").alias("balanced"), "least")
    rows = clusters.join(asked, "win_id").withColumn("side", F.when(F.col("balanced"), F.col("hp")).otherwise(-1))
    by, ties = ["win_id", "svtype", "side", "least", "balanced"], ("pos", "strand", "read_name")
    made = A.inv_alleles(rows.filter("svtype = 'INV'"), by, p, F.col("least"))
    if mode == "germline":
        made = made.unionByName(A.dup_alleles(rows.filter("svtype = 'DUP'"), by, p), allowMissingColumns=True)
    call = F.concat_ws("/", "win_id", "side", "allele").alias("call_id")
    alleles = made.select(call, "*", (F.col("bp2") - F.col("bp1")).alias("size"))
    support = A.allele_support(rows, by, p.gap_dup_inv, *ties).select(call, "read_name", "hp")
    return alleles, support.join(alleles.select("call_id"), "call_id", "left_semi")


def revised_two_breakpoint(alleles: DataFrame, support: DataFrame, reads: DataFrame | J.Dealt, p: Params, mode: str) -> DataFrame:
    """Alleles of balanced clusters with hp, dr and the revised genotype, ready for merging."""
    own = alleles.filter("balanced").withColumn("hp", F.col("side").cast("int"))
    at = _windows(own, F.greatest(F.col("bp1") - p.gap_dup_inv, F.lit(0)), F.col("bp1") + p.gap_dup_inv)
    found = J.covering_reads(at, reads) if mode == "germline" else J.overlapping_primary_reads(at, reads)
    told = _against(own, found, support)
    dr = F.when(F.col("hp") == 1, F.col("r1")).when(F.col("hp") == 2, F.col("r2"))
    stays = F.col("n_reads") >= dr if mode == "germline" else F.col("n_reads") / (F.col("n_reads") + dr) > 0.7
    sign = F.when(stays, "1").otherwise(".")
    gt = F.when(F.col("hp") == 1, F.concat(sign, F.lit("|0"))).when(F.col("hp") == 2, F.concat(F.lit("0|"), sign)).otherwise(".|.")
    least = (F.lit(p.min_support // 2), F.lit(p.min_support)) if mode == "germline" else (F.col("least"), F.col("least"))
    made = told.withColumns({"gt": gt, "own_dr": dr, "least": least[0], "least_untagged": least[1]})
    return made if mode == "germline" else made.filter(~F.contains(F.col("gt"), F.lit("1")))


def two_breakpoint_calls(alleles: DataFrame, support: DataFrame, reads: DataFrame | J.Dealt, p: Params = Params(), mode: str = "germline") -> tuple[DataFrame, DataFrame]:
    """Calls of the alleles of two_breakpoint_alleles(), and their support."""
    revised = revised_two_breakpoint(alleles, support, reads, p, mode)
    pairs = R.merge_haplotypes_two_breakpoints(revised, mode == "mosaic")
    merged_id = F.concat_ws("/", "win_id", F.lit("m"), "turn").alias("call_id")
    own = F.concat_ws("/", "win_id", F.col("hp").cast("string"), F.col("allele").cast("string"))
    lead = revised.select(F.col("call_id").alias("lead"), *sample(revised), "svtype", "chrom", "strand", F.col("own_dr").alias("dr"))
    one = pairs.select(merged_id, own.alias("lead"), "gt", F.col("bp1").alias("pos"), F.col("size").alias("svlen"), "dv").join(lead, "lead")
    members = pairs.select(merged_id, "win_id", F.inline("members")).select("call_id", own.alias("member"))
    one_support = members.join(support.select(F.col("call_id").alias("member"), "read_name"), "member").select("call_id", "read_name").distinct()
    pooled = alleles.filter("not balanced").withColumn("dv", F.col("n_reads"))
    # against an inversion: reads over the surroundings of either breakpoint; against a duplication: over all of it
    half, bp1, bp2 = p.gap_dup_inv // 2, F.col("bp1").cast("long"), F.col("bp2").cast("long")
    window = lambda a, b: F.struct(a.alias("w_start"), b.alias("w_end"))
    around = F.when(F.col("svtype") == "DUP", F.array(window(bp1, bp2))).otherwise(F.array(*(window(x - half, x + half) for x in (bp1, bp2))))
    found = J.covering_reads(pooled.select(*sample(pooled), F.col("call_id").alias("win_id"), "chrom", F.inline(around)), reads)
    told = _against(pooled, found, support)
    two = G.genotyped(told) if mode == "germline" else G.mosaic_filter_inv_tra(G.assign_genotype_mosaic(told))
    two = two.withColumns({"pos": F.col("bp1"), "svlen": F.col("size")})
    return _as_calls(one).unionByName(_as_calls(two)), one_support.unionByName(support.select("call_id", "read_name").join(pooled.select("call_id"), "call_id", "left_semi"))


def translocation_alleles(clusters: DataFrame, clips: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Alleles of translocations, and their support with the reads of gap-edge clips."""
    clusters = clusters.filter("svtype = 'TRA'")
    call = F.concat_ws("/", "win_id", "allele").alias("call_id")
    alleles = A.tra_alleles(clusters, p).select(call, "*").withColumn("svtype", F.lit("TRA"))
    own = A.allele_support(clusters, ["win_id"], p.gap_tra, "pos", "read_name").select(call, "read_name", "hp").join(alleles.select("call_id"), "call_id", "left_semi")
    near = alleles.select(*sample(alleles), F.col("call_id").alias("win_id"), "chrom", F.col("bp1").alias("pos"))
    return alleles, J.tra_clip_support(near, own.withColumnRenamed("call_id", "win_id"), clips).withColumnRenamed("win_id", "call_id")


def translocation_calls(alleles: DataFrame, support: DataFrame, reads: DataFrame | J.Dealt, p: Params = Params(), mode: str = "germline") -> tuple[DataFrame, DataFrame]:
    """Calls of the alleles of translocation_alleles(), and their support."""
    counts = support.groupBy("call_id").agg(F.count(F.lit(1)).cast("int").alias("dv"), *(F.count_if(F.col("hp") == h).cast("int").alias(f"t{h}") for h in (1, 2)))
    calls = alleles.join(counts, "call_id").withColumns({"s1": F.col("t1"), "s2": F.col("t2"), "pos": F.col("bp1"), "pos2": F.col("bp2")})
    at = _windows(calls, F.greatest(F.col("bp1") - p.gap_tra, F.lit(0)), F.col("bp1") + p.gap_tra)
    told = _against(calls, J.overlapping_primary_reads(at, reads), support)
    done = G.genotyped(told) if mode == "germline" else G.mosaic_filter_inv_tra(G.assign_genotype_mosaic(told))
    return _as_calls(done), support.select("call_id", "read_name")


def _all_calls(tables: dict[str, DataFrame], p: Params, mode: str, job: Job | None) -> tuple[DataFrame, DataFrame]:
    sig, clips, reads = (tables[k] for k in ("sig", "clips", "reads"))
    job, _ = job or Job(sig.sparkSession), sample(sig, clips, reads)
    spread = J.deal(reads, once=True)
    clusters = job.kept("clusters", all_clusters(sig, p, mode))
    told = job.kept("routes", routes(clusters, spread, p, mode), clusters=F.count(F.lit(1)), largest=F.max("n_signals"))
    two, tra = two_breakpoint_alleles(clusters, told, p, mode), translocation_alleles(clusters, clips, p)
    support = job.kept("support", two[1].withColumn("tra", F.lit(False)).unionByName(tra[1].withColumn("tra", F.lit(True))))
    alleles = job.kept("alleles", two[0].unionByName(tra[0], allowMissingColumns=True))
    is_tra, of_tra = F.col("svtype") == "TRA", lambda yes: support.filter(F.col("tra") == yes).drop("tra")
    made = [
        indel_calls(clusters, told, clips, spread, p, mode, job),
        two_breakpoint_calls(alleles.filter(~is_tra), of_tra(False), spread, p, mode),
        translocation_calls(alleles.filter(is_tra), of_tra(True), spread, p, mode),
    ]
    return U.union_calls(*(x[0] for x in made)), U.union_calls(*(x[1] for x in made))


def call_germline(tables: dict[str, DataFrame], p: Params = Params(), job: Job | None = None) -> tuple[DataFrame, DataFrame]:
    """Germline calls of all five types from ``sig``, ``clips`` and ``reads``, and (call_id, read_name) of their support.

    ``job`` keeps what several steps read; close it once the results have been read.
    """
    return _all_calls(tables, p, "germline", job)


def call_mosaic(tables: dict[str, DataFrame], p: Params = Params(), job: Job | None = None) -> tuple[DataFrame, DataFrame]:
    """Low-frequency calls of deletions, insertions, inversions and translocations, and their support; as call_germline()."""
    return _all_calls(tables, p, "mosaic", job)


def call_lines(calls: DataFrame, ref_bins: DataFrame, bin_size: int, p: Params = Params(), support: DataFrame | None = None, large_inv: bool = False) -> DataFrame:
    """Calls with all output columns; with ``support`` the names of the reads too."""
    sized = V.size_filter(calls, p.max_size, large_inv)
    if support is not None:
        names = support.groupBy("call_id").agg(F.array_sort(F.collect_set("read_name")).alias("support"))
        sized = sized.join(names, "call_id", "left")
    return V.number_calls(V.vcf_fields(V.ref_alt(sized, ref_bins, bin_size), reads=support is not None))


def write_calls(calls: DataFrame, ref_bins: DataFrame, bin_size: int, path: str, p: Params = Params(), support: DataFrame | None = None, sample: str = "NULL", command: str | None = None) -> None:
    """One sorted VCF in ``path``, or one for each sample: its parts in the order of their names are header and lines."""
    contigs = [(r.chrom, r.length) for r in io.contigs(ref_bins).orderBy("chrom").collect()]  # contigs: a short list by nature
    io.write_vcf(call_lines(calls, ref_bins, bin_size, p, support), io.vcf_header(contigs, sample, command), path)
