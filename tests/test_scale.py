"""What must hold on a crowded place: bins, chains by length; headers read alone; signals and calls by sample written."""

import random
import time

import pytest
from pyspark.sql import functions as F

from phaseloom.operators import alleles as A
from phaseloom.operators import cluster as C
from phaseloom.operators import intervals as J
from phaseloom.operators import reads as P
from phaseloom.operators import signals as U
from phaseloom.params import Params
from phaseloom.plans import jobs
from phaseloom.plans.job import Job
from phaseloom.sources import io

READS = "chrom string, ref_start long, ref_end long, is_primary int, read_name string, hp int"


def test_half_of_all_reads_in_one_bin(spark):
    rnd, rows = random.Random(3), []
    for k in range(16_000):
        at = 500_000 + rnd.randrange(800) if k % 2 else rnd.randrange(40_000_000)
        rows.append(("c1", at, at + rnd.randrange(100, 9000), int(k % 5 > 0), f"r{rnd.randrange(12_000)}", k % 3))
    windows = [(f"w{k}", "c1", at, at + rnd.randrange(1, 3000)) for k, at in enumerate([500_100 + 60 * j for j in range(20)] + [rnd.randrange(40_000_000) for _ in range(300)])]
    reads, asked = spark.createDataFrame(rows, READS).repartition(6), spark.createDataFrame(windows, "win_id string, chrom string, w_start long, w_end long")
    held = J.deal(reads)
    sizes = [r["count"] for r in held.rows.groupBy("chrom", "bin", "part").count().collect()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes) < 2 * sum(sizes) / (J.SHARE * n) and held.crowded.count() <= J.SHARE * n
    got = {(r.win_id, r.read_name): (r.is_primary, r.ref_start, r.ref_end, r.hp) for r in J.overlapping_reads(asked, held).collect()}
    want = {}
    for name, _, low, high in windows:
        for _, a, b, primary, read, hp in rows:
            if a < high and b > low:
                new = (1 - primary, a, b, hp)
                want[name, read] = min(want.get((name, read), new), new)
    assert got == {k: (1 - v[0], *v[1:]) for k, v in want.items()}
    cover = {(r.win_id, r.read_name) for r in J.covering_reads(asked, reads).collect()}
    assert cover == {(w, r[4]) for w, _, low, high in windows for r in rows if r[1] <= low and r[2] >= high and r[3]}


def test_a_hundred_thousand_lengths_in_one_cluster(spark):
    n = 100_000
    sig = spark.range(n).select(F.lit("w").alias("win_id"), (50 + F.col("id") * 7).alias("len"), (F.col("id") % 3).alias("hp"))
    began = time.time()
    got = {r.allele: (r.low, r.high, r.n) for r in A.length_chain(sig, ["win_id"]).groupBy("allele").agg(F.min("len").alias("low"), F.max("len").alias("high"), F.count("*").alias("n")).collect()}
    assert time.time() - began < 60
    want, total, count, allele = {}, 0.0, 0, -1
    for size in range(50, 50 + 7 * n, 7):
        if not count or size - total / count > 0.9 * (total / count):
            total, count, allele = 0.0, 0, allele + 1
        total, count = total + size, count + 1
        low = want.get(allele, (size,))[0]
        want[allele] = (low, size, count)
    assert got == want


def test_only_heads_of_alignment_files_are_read(spark, tmp_path):
    head = "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:1000\n@SQ\tSN:c2\tLN:77\tM5:x\n@RG\tID:a\tSM:ann\n@RG\tID:b\tSM:ann\n"
    folder = tmp_path / "x.sam"
    folder.mkdir()
    (folder / "part-0").write_text("")
    (folder / "part-1").write_text(head + "r1\t0\tc1\t5\t60\t10M\t*\t0\t0\tACGTACGTAC\t*\tHP:i:2\n" * 50)
    assert [tuple(r) for r in io.contigs_of_sam(spark, str(folder)).collect()] == [("c1", 1000), ("c2", 77)]
    assert io.sample_of_sam(spark, str(folder)) == "ann" and io.sam_header(spark, str(tmp_path / "none*")) == []
    rows = io.read_alignments(spark, str(folder), sample="ann").collect()
    assert len(rows) == 50 and {(r.sample_id, r.hp, r.ref_start) for r in rows} == {("ann", 2, 4)}


def test_signature_lines_of_all_types(spark, tmp_path):
    rows = [
        ("DEL", "c1", 10.0, 60, None, None, None, None, "r1", 1, None), ("INS", "c1", 10.5, 3, None, None, None, None, 'r"2', 0, "ACG"), ("INS", "c1", 11.0, 4, None, None, None, None, "r2", 0, None),
        ("DUP", "c2", 5.0, None, 900, None, None, None, "r3", 2, None), ("INV", "c2", 5.0, None, 900, None, "++", None, "r4", 2, None), ("TRA", "c1", 7.0, None, 8, "c3", None, "A", "r5", 1, None),
    ]
    df = spark.createDataFrame(rows, "svtype string, chrom string, pos double, len long, pos2 long, chrom2 string, strand string, bnd_type string, read_name string, hp int, ins_seq string")
    io.write_signatures(df, str(tmp_path / "lines"), lines=True)
    back = io.read_signatures(spark, str(tmp_path / "lines"), lines=True).select(*df.columns).collect()
    assert sorted((tuple(x if x != "" else None for x in r) for r in back), key=repr) == sorted(rows, key=repr)


def test_one_file_for_each_sample(spark, tmp_path):
    calls = [(s, f"{s}:{k}", c, t, 100 + k, 60, None, None, f"]c9:{k}]N" if t == "TRA" else None, "++" if t == "INV" else None, 5, 7, "0|1", "9,0,9", 9, 8.5, "-1,1", "-2,2", "ACGT") for s in ("s1", "s2") for k, (c, t) in enumerate([("c1", "DEL"), ("c1", "INS"), ("c2", "DUP"), ("c2", "INV"), ("c2", "TRA"), ("c1", "DEL")])]
    df = spark.createDataFrame(calls, ", ".join(["sample_id string", *(f"{c} {t}" for c, t in jobs.CALL.items())]))
    ref = spark.createDataFrame([(c, b, b * 64, "ACGTTGCA" * 8) for c in ("c1", "c2") for b in range(5)], "chrom string, bin long, bin_start long, bin_seq string")
    support = spark.createDataFrame([(r[1], name) for r in calls for name in ("b", "a")], "call_id string, read_name string")
    jobs.write_calls(df, ref, 64, str(tmp_path / "out"), support=support, command='run "x"')
    for s in ("s1", "s2"):
        parts = sorted((tmp_path / "out" / f"sample_id={s}").glob("part-*"))
        lines = "".join(p.read_text() for p in parts).splitlines()
        head = [x for x in lines if x.startswith("#")]
        assert lines[: len(head)] == head and head[-1].endswith("FORMAT\t" + s) and head[0] == "##fileformat=VCFv4.2"
        keys = {x.split("=")[0] for x in head} | {x.split(",")[0] for x in head}
        assert {"##source", "##fileDate", "##CommandLine", "##INFO=<ID=IMPRECISE", "##INFO=<ID=CHR2", "##contig=<ID=c1"} <= keys
        body = [x.split("\t") for x in lines[len(head) :]]
        bases = "ACGTTGCA" * 40
        assert [(x[0], x[1], x[2], x[3], x[4]) for x in body] == [
            ("c1", "100", "DEL0", bases[99:160], bases[99]), ("c1", "101", "INS0", bases[100], bases[100] + "ACGT"), ("c1", "105", "DEL1", bases[104:165], bases[104]),
            ("c2", "103", "DUP0", bases[102], "<DUP>"), ("c2", "104", "INV0", bases[103], "<INV>"), ("c2", "105", "BND0", bases[104], "]c9:4]N"),
        ]
        info = {x[2]: x[7] for x in body}
        assert info["DUP0"] == "PRECISE;SVTYPE=DUP;SVLEN=60;END=163;RE=5;STRAND=-+;RNAMES=a,b;AF=0.4167"
        assert info["INV0"] == "PRECISE;SVTYPE=INV;SVLEN=60;END=164;RE=5;STRAND=++;RNAMES=a,b;AF=0.4167"
        assert info["BND0"] == "PRECISE;SVTYPE=BND;RE=5;RNAMES=a,b;AF=0.4167" and info["DEL0"].startswith("PRECISE;SVTYPE=DEL;SVLEN=-60;END=160;CIPOS=-1,1;CILEN=-2,2")
        assert body[0][9] == "0|1:7:5:9,0,9:9"


def test_large_clusters_are_told_of_or_refused(spark):
    sig = [("DEL", "c1", float(1000 + k), 100, None, None, None, None, f"r{k}", 1, None) for k in range(300)]
    df = spark.createDataFrame(sig, "svtype string, chrom string, pos double, len long, pos2 long, chrom2 string, strand string, bnd_type string, read_name string, hp int, ins_seq string")
    reads = spark.createDataFrame([("c1", 0, 5000, 1, f"r{k}", 1) for k in range(300)], READS)
    tables = {"sig": df, "reads": reads, "clips": spark.createDataFrame([], "chrom string, read_name string, side int, pos long, hp int")}
    with Job(spark) as job:
        jobs.call_germline(tables, job=job)
        assert job.sizes["routes"] == {"clusters": 1, "largest": 300}
    with Job(spark) as job, pytest.raises(Exception, match="300 signals, over the limit of 200"):
        jobs.call_germline(tables, Params(max_cluster=200), job=job)


def test_pattern_of_long_operations(spark):
    for n in (1, 9, 10, 30, 99, 100, 205, 1999):
        got = spark.range(2500).filter(F.col("id").cast("string").rlike("^" + P.at_least(n) + "$")).agg(F.min("id"), F.count("*")).first()
        assert tuple(got) == (n, 2500 - n)


def test_signals_of_odd_cigars(spark):
    rows = [("r0", "5H10M30I5S", 100), ("r1", "7S29I30D3N31I", 0), ("r2", None, 5), ("r3", "", 5), ("r4", "1000M", 5), ("r5", "30D", 9), ("r6", "10M030I", 1)]
    df = spark.createDataFrame(rows, "read_name string, cigar string, ref_start long").withColumns({"chrom": F.lit("c"), "hp": F.lit(0), "mapq": F.lit(60), "query_len": F.lit(999), "query_seq": F.repeat(F.lit("ACGTTGCAAT"), F.lit(20))})
    got = sorted((r.read_name, r.svtype, r.pos, r.len, r.bases) for r in P.cigar_signals(df).collect())
    seq = "ACGTTGCAAT" * 20
    assert got == [("r0", "INS", 110, 30, seq[10:40]), ("r1", "DEL", 0, 30, None), ("r1", "INS", 33, 31, seq[39:70]), ("r5", "DEL", 9, 30, None), ("r6", "INS", 11, 30, seq[10:40])]


def test_stored_signatures_are_chained_as_they_lie(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(rnd.choice(["DEL", "INS"]), f"c{rnd.randrange(3)}", float(rnd.randrange(12) << 19) + rnd.randrange(4000), rnd.randrange(50, 90), None, None, None, None, f"r{rnd.randrange(400)}", k % 3, None) for k in range(3000)]
    rows += rows[:200]
    df = spark.createDataFrame(rows, "svtype string, chrom string, pos double, len long, pos2 long, chrom2 string, strand string, bnd_type string, read_name string, hp int, ins_seq string")
    io.store_signatures(df, "stored_sigs", str(tmp_path / "store"), buckets=7)
    try:
        table = io.stored_signatures(spark, "stored_sigs")
        assert table.count() == len(set(rows))
        plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(U.dedup_signals(table))
        key = lambda r: tuple(map(str, r))
        names = ["win_id", "svtype", "chrom", "pos", "len", "read_name", "hp"]
        got, want = C.indel_clusters(table), C.indel_clusters(U.dedup_signals(df))
        assert sorted(map(key, got.select(names).collect())) == sorted(map(key, want.select(names).collect()))
        # from each scan of signals upwards no exchange comes before the first window
        lines = plan(got).split("\n")
        for k, line in enumerate(lines):
            if "FileScan" in line:
                above = next(x for x in reversed(lines[:k]) if "Window" in x or "Exchange" in x)
                assert "Window" in above
        some = io.stored_signatures(spark, "stored_sigs", ("c1", 1_000_000, 1_500_000))
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else buckets are left out too, but not told of
        assert "SelectedBucketsCount: " in some.select("*")._jdf.queryExecution().explainString(mode)
        assert some.count() == len({r for r in rows if r[1] == "c1" and 1_000_000 <= r[2] <= 1_500_000}) > 0
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.sql("DROP TABLE IF EXISTS stored_sigs")
