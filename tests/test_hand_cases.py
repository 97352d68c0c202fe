"""Hand cases with expected values derived from the rules."""

from pyspark.sql import functions as F

from phaseloom.functions.likelihood import genotype_likelihood
from phaseloom.operators import intervals as J
from phaseloom.operators import reads as P


def test_likelihoods(spark):
    want = {(0, 10): ("1|1", "95,26,0", 25, 95.4), (10, 10): ("0/1", "44,0,44", 41, 44.4), (9, 1): ("0|0", "0,16,76", 16, 0.1), (150, 150): ("0/1", "222,0,222", 218, 221.8), (3, 1): ("0/1", "3,3,24", 3, 3.0)}
    rows = spark.createDataFrame(list(want), "dr long, dv long").select("dr", "dv", genotype_likelihood(F.col("dr"), F.col("dv")).alias("g")).collect()
    assert {(r.dr, r.dv): tuple(r.g) for r in rows} == want


def test_cigar_signals(spark):
    want = {"100M50D100M": [("DEL", 1100, 50)], "10S100M40I100M": [("INS", 1100, 40)], "100M20D100M50D10M": [("DEL", 1220, 50)], "100M10N100M50D10M": [("DEL", 1210, 50)]}
    rows = [(c, "c1", 0, 60, 1000, 0, c, "A" * 900, 900) for c in want]
    df = spark.createDataFrame(rows, "read_name string, chrom string, flag int, mapq int, ref_start long, hp int, cigar string, query_seq string, query_len int")
    got = {c: [] for c in want}
    for r in P.cigar_signals(df).collect():
        got[r.read_name].append((r.svtype, r.pos, r.len))
    assert got == want


def test_interval_edges(spark):
    windows = spark.createDataFrame([("w", "c1", 20, 30)], "win_id string, chrom string, w_start long, w_end long")
    reads = spark.createDataFrame([("c1", a, b, 1, f"{a}-{b}", 0) for a, b in ((10, 20), (30, 40), (20, 30), (19, 29))], "chrom string, ref_start long, ref_end long, is_primary int, read_name string, hp int")
    assert {r.read_name for r in J.overlapping_reads(windows, reads).collect()} == {"20-30", "19-29"}
    assert {r.read_name for r in J.covering_reads(windows, reads).collect()} == {"20-30"}
