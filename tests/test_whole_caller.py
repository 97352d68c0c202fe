"""The jobs against a slow caller over plain rows, call by call: germline and mosaic, all types and routes, two samples."""

import random

import pytest
from slow_caller import calls as slow_calls

from phaseloom.params import Params
from phaseloom.plans import jobs
from phaseloom.plans.job import Job
from phaseloom.sources import io

P = Params(min_support=4)
SIG = "svtype string, chrom string, pos double, len long, pos2 long, chrom2 string, strand string, bnd_type string, read_name string, hp int, ins_seq string"
CLIPS = "chrom string, read_name string, side int, pos long, hp int"
READS = "chrom string, ref_start long, ref_end long, is_primary int, read_name string, hp int"
SHOWN = ("svtype", "chrom", "pos", "svlen", "chrom2", "pos2", "alt", "strand", "dv", "dr", "gt", "pl", "gq", "qual", "cipos", "cilen", "ins_seq")


def locus(rnd, k, kind, start):
    """(sig, clips, reads) around one place: alleles of one or two haplotypes, reads without a haplotype, clips, noise."""
    sig, clips, reads = [], [], []
    chrom, shape = f"c{1 + k % 2}", rnd.choice(["both", "first", "second", "untagged", "two", "rare"])
    big = rnd.random() < 0.3
    lengths = [rnd.randrange(60, 900) * (4 if big else 1)] * 3
    if shape == "two":
        lengths[2] = lengths[1] * 3
    depth = rnd.choice([14, 30, 30, 130]) if kind in ("DEL", "INS") else rnd.choice([14, 30])
    untagged = rnd.choice([0.05, 0.1, 0.35, 0.9 if shape == "untagged" else 0.2])
    for n in range(depth):
        hp = 0 if rnd.random() < untagged else 1 + n % 2
        name = f"{kind}{k}r{n}"
        low, high = start - rnd.randrange(1500, 4000), start + rnd.randrange(1500, 9000)
        reads.append((chrom, low, high, 0 if rnd.random() < 0.1 else 1, name, hp))
        if rnd.random() < 0.1:
            reads.append((chrom, low + 300, high, rnd.randrange(2), name, hp))
        has = {"both": True, "two": True, "untagged": n % 3 > 0, "first": hp != 2, "second": hp != 1, "rare": n % 8 == 0}[shape] and rnd.random() < 0.93
        if has and rnd.random() < 0.9:
            for _ in range(rnd.choice([1, 1, 1, 2])):
                pos, size = start + rnd.randrange(-12, 13), lengths[hp] + rnd.randrange(-6, 7)
                if kind == "INS":
                    pos += rnd.choice([0, 0, 0.5])
                bases = "".join(rnd.choice("ACGT") for _ in range(rnd.choice([size, size, size - 1]))) if kind == "INS" else None
                strand = rnd.choice(["++", "++", "--"]) if kind == "INV" else None
                end = start + lengths[hp] * 2 + rnd.randrange(-15, 16) + (rnd.random() < 0.2) * 1200
                two = kind in ("DUP", "INV", "TRA")
                sig.append((kind, chrom, float(pos), None if two else size, end if two else None, f"c{3 + k % 3}" if kind == "TRA" else None, strand, rnd.choice("AB") if kind == "TRA" else None, name, hp, bases))
        elif has:
            clip = (chrom, name, rnd.randrange(2), start + rnd.randrange(-30, 31), hp)
            clips += [clip] * rnd.choice([1, 1, 2])
        if rnd.random() < 0.15:
            clips.append((chrom, name, rnd.randrange(3), start + rnd.randrange(-20, 21), hp))
    return sig, clips, reads


def tables(seed, tag=""):
    rnd, out = random.Random(seed), ([], [], [])
    for k in range(20):
        for part, rows in zip(out, locus(rnd, k, ("DEL", "INS", "DUP", "INV", "TRA", "DEL", "INS")[k % 7], 20_000 + 60_000 * k + rnd.randrange(3000)), strict=True):
            part += rows
    return [[tuple(tag + x if isinstance(x, str) and "r" in x and x[:3] in ("DEL", "INS", "DUP", "INV", "TRA") and len(x) > 3 and tag else x for x in row) for row in part] for part in out]


def named(rows, schema):
    names = [x.split()[0] for x in schema.split(", ")]
    return [dict(zip(names, row, strict=True)) for row in rows]


def told(c, get):
    row = [get(c, name) for name in SHOWN]
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


def made_by_job(spark, parts, run, sample=False):
    lead = "sample_id string, " if sample else ""
    with Job(spark) as job:
        frames = {n: spark.createDataFrame(rows, lead + schema).repartition(3) for n, rows, schema in zip(("sig", "clips", "reads"), parts, (SIG, CLIPS, READS), strict=True)}
        found, support = run(frames, P, job)
        rows, names = found.collect(), {}
        for r in support.collect():
            names.setdefault(r.call_id, set()).add(r.read_name)
        assert len(job.steps) <= 10
    assert not io.exists(spark, job.folder)
    out = {}
    for r in rows:
        key = r.sample_id if sample else ""
        out.setdefault(key, []).append((told(r, lambda c, n: c[n]), tuple(sorted(names[r.call_id]))))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def made_slowly(parts, mode):
    sig, clips, reads = (named(rows, schema) for rows, schema in zip(parts, (SIG, CLIPS, READS), strict=True))
    unique = [dict(t) for t in {tuple(sorted(r.items(), key=lambda x: x[0])) for r in sig}]
    out = []
    for c in slow_calls(unique, clips, reads, P, mode):
        if c["svtype"] in ("DEL", "INS"):
            c.setdefault("ins_seq", "<INS>")
        out.append((told(c, lambda c, n: c.get(n)), tuple(sorted(c["support"]))))
    return sorted(out, key=repr)


def by_hand(calls):
    """Bases of deletions aren't shown; both sides may differ there."""
    at, kind = SHOWN.index("ins_seq"), SHOWN.index("svtype")
    return [(row[:at] + (None,) + row[at + 1 :] if row[kind] != "INS" else row, names) for row, names in calls]


@pytest.mark.parametrize("seed,mode", [(1, "germline"), (2, "germline"), (3, "mosaic"), (4, "mosaic")])
def test_calls_are_those_of_a_slow_caller(spark, seed, mode):
    parts = tables(seed)
    parts[0] = sorted(set(parts[0]), key=repr)
    got = made_by_job(spark, parts, jobs.call_germline if mode == "germline" else jobs.call_mosaic).get("", [])
    want = made_slowly(parts, mode)
    assert len(want) > (20 if mode == "germline" else 3)
    assert by_hand(got) == by_hand(want)


def test_two_samples_are_two_runs(spark):
    one, two = tables(5), tables(6)
    two[0] = two[0] + one[0][:40]  # the same names and places in both samples
    both = [[("s1", *r) for r in a] + [("s2", *r) for r in b] for a, b in zip(one, two, strict=True)]
    for part in (one, two):
        part[0] = sorted(set(part[0]), key=repr)
    both[0] = sorted(set(both[0]), key=repr)
    made = made_by_job(spark, both, jobs.call_germline, True)
    assert made["s1"] == made_by_job(spark, one, jobs.call_germline)[""]
    assert made["s2"] == made_by_job(spark, two, jobs.call_germline)[""]
