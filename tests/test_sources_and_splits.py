"""Split-read rules by hand, references over many splits, regions and chains against plain versions, one VCF."""

import random

from pyspark.sql import functions as F

from phaseloom.operators import intervals as J
from phaseloom.operators import reads as P
from phaseloom.operators import split as X
from phaseloom.sources import io

_SEG = "array<struct<read_start:bigint,read_end:bigint,ref_start:bigint,ref_end:bigint,chrom:string,strand:string>>"
A = (0, 1000, 5000, 6000, "c1", "+")
CASES = {
    "del": ([A, (1000, 2000, 6500, 7500, "c1", "+")], {("DEL", "c1", 6000.0, 500, None, None)}),
    "ins": ([A, (1300, 2300, 6000, 7000, "c1", "+")], {("INS", "c1", 6000.0, 300, None, None)}),
    "dup": ([A, (1000, 2000, 5400, 6400, "c1", "+")], {("DUP", "c1", 5400.0, None, 6000, None)}),
    "inv": ([A, (1000, 2000, 8000, 9000, "c1", "-")], {("INV", "c1", 6000.0, None, 9000, "++")}),
    "tra": ([A, (1000, 2000, 8000, 9000, "c2", "+")], {("TRA", "c1", 6000.0, None, 8000, "A")}),
    "tra back": ([(0, 1000, 5000, 6000, "c2", "+"), (1000, 2000, 8000, 9000, "c1", "+")], {("TRA", "c1", 8000.0, None, 6000, "D")}),
    "edges": ([A, (1500, 2500, 6480, 7480, "c1", "+")], {("CLIP", "c1", 6000.0, None, None, None), ("CLIP", "c1", 6480.0, None, None, None)}),
    "late change": ([A, (1000, 2000, 6500, 7500, "c1", "+"), (2000, 3000, 8000, 9000, "c2", "+")], set()),
    "minus del": ([(0, 1000, 6500, 7500, "c1", "-"), (1000, 2000, 5000, 6000, "c1", "-")], {("DEL", "c1", 6000.0, 500, None, None)}),
    "minus inv": ([(0, 1000, 5000, 6000, "c1", "-"), (1000, 2000, 8000, 9000, "c1", "+")], {("INV", "c1", 5000.0, None, 8000, "--")}),
}


def test_split_reads_by_hand(spark):
    df = spark.createDataFrame([(name, 0, 3000, segs) for name, (segs, _) in CASES.items()], f"read_name string, hp int, read_len long, segs {_SEG}")
    got = {name: set() for name in CASES}
    for r in X.split_signals(df).collect():
        got[r.read_name].add((r.svtype, r.chrom, r.pos, r.len, r.pos2, r.bnd_type if r.svtype == "TRA" else r.strand))
    assert got == {name: want for name, (_, want) in CASES.items()}


def test_reference_over_many_splits(spark, tmp_path):
    rnd = random.Random(2)
    contigs = {f"c{k}": "".join(rnd.choice("ACGT") for _ in range(n)) for k, n in enumerate((30_000, 10, 999, 7_001, 1))}
    text = "".join(f">{c} note\n" + "".join(seq[i : i + 60] + "\n" for i in range(0, len(seq), 60)) for c, seq in contigs.items())
    (tmp_path / "r.fa").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = io.read_reference(spark, str(tmp_path / "r.fa"), 1000).orderBy("chrom", "bin").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(len(r.bin_seq) <= 1000 and r.bin_start == 1000 * r.bin for r in rows)
    assert {c: "".join(r.bin_seq for r in rows if r.chrom == c) for c in contigs} == contigs


def test_regions_against_a_plain_join(spark):
    rnd = random.Random(3)
    reads = [(f"c{rnd.randrange(3)}", s := rnd.randrange(4000), s + rnd.randrange(1, 1500), k) for k in range(400)]
    bed = [(f"c{rnd.randrange(2)}", s := rnd.randrange(4000), s + rnd.randrange(1, 90)) for _ in range(25)]
    want = {k for c, s, e, k in reads if any(c == d and e > a and s < b for d, a, b in bed)}
    made = P.restrict_to_bed(spark.createDataFrame(reads, "chrom string, ref_start long, ref_end long, k long"), spark.createDataFrame(bed, "chrom string, bed_start long, bed_end long"), 128)
    assert sorted(r.k for r in made.collect()) == sorted(want) and made.columns == ["chrom", "ref_start", "ref_end", "k"]


def test_chains_against_one_window(spark):
    rnd = random.Random(4)
    rows = sorted((f"c{rnd.randrange(2)}", rnd.randrange(3000), k) for k in range(300))
    want, last, no = {}, {}, {}
    for c, pos, k in rows:
        no[c] = no.get(c, 0) + (c in last and pos - last[c] > 15)
        last[c] = pos
        want[k] = no[c]
    df = spark.createDataFrame(rows, "chrom string, pos long, k long")
    made = J.islands(df, ["chrom"], ["pos", "k"], lambda a, b: b["pos"] - a["pos"] > 15, 64)
    assert {r.k: r.cluster_no for r in made.collect()} == want
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") <= 4


def test_one_vcf(spark, tmp_path):
    rows = [(f"c{k % 3}", k, f"DEL{k}") for k in range(30)]
    calls = spark.createDataFrame(rows, "chrom string, pos long, id string").withColumns({"vcf_pos": F.col("pos"), "qual": F.lit(None).cast("double"), **{c: F.lit("x") for c in ("ref", "alt", "filter", "info", "format", "sample")}})
    io.write_vcf(calls, "##fileformat=VCFv4.2\n#CHROM", str(tmp_path / "v"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*")))
    lines = text.splitlines()
    assert lines[:2] == ["##fileformat=VCFv4.2", "#CHROM"]
    assert [(x.split("\t")[0], int(x.split("\t")[1])) for x in lines[2:]] == sorted((c, p) for c, p, _ in rows)
