"""All three tables of extract_signatures() against plain code, read by read: CIGARs, pairs, triples, foreign middles, regions."""

import collections
import random

import pytest
from slow_signals import signatures

from phaseloom.plans import jobs
from phaseloom.plans.job import Job

ROWS = "read_name string, chrom string, flag int, mapq int, ref_start long, hp int, cigar string, query_len int, query_seq string, sa string"


def split_read(rnd, k):
    """An alignment whose read lies in two to five pieces, with gaps, overlaps and turns of all sizes about the limits."""
    n, length = rnd.choice([2, 2, 3, 3, 3, 4, 5]), 0
    home, strand = 20_000 + rnd.randrange(40) * 5000, rnd.choice("+-")
    chroms = ["c1"] * n if rnd.random() < 0.7 else [rnd.choice(["c1", "c2"]) for _ in range(n)]
    strands = [strand if rnd.random() < 0.7 else rnd.choice("+-") for _ in range(n)]
    step = lambda: rnd.choice([0, 0, 3, -20, 49, 50, 60, 99, 101, 200, 480, -49, -60, -300, 2000])
    pieces, at, place = [], rnd.choice([0, 40]), home
    for j in range(n):
        span = rnd.choice([400, 600, 1000])
        pieces.append((max(at, 0), span, place if strands[j] == "+" or rnd.random() < 0.5 else place + step()))
        at += span + step()
        place = place + span + step() if strand == "+" else place - span - step()
    length = max(a + s for a, s, _ in pieces) + 10
    texts = []
    for (a, span, _), s in zip(pieces, strands, strict=True):
        left, right = (a, length - a - span) if s == "+" else (length - a - span, a)
        texts.append("".join(f"{x}{o}" for x, o in ((left, "S"), (span, "M"), (right, "S")) if x))
    lead = rnd.randrange(n)
    sa = "".join(f"{chroms[j]},{max(pieces[j][2], 1)},{strands[j]},{texts[j]},{rnd.choice([5, 20, 60])},0;" for j in range(n) if j != lead)
    seq = "".join(rnd.choice("ACGT") for _ in range(length))
    return (f"s{k}", chroms[lead], 16 if strands[lead] == "-" else 0, rnd.choice([60, 60, 60, 20, 3]), max(pieces[lead][2], 1), k % 3, texts[lead], length, seq, sa)


def plain_read(rnd, k):
    """An alignment with long and short operations close to each other."""
    parts = [(rnd.randrange(1, 60), rnd.choice("SH"))] if rnd.random() < 0.5 else []
    parts += [(rnd.choice([1, 5, 28, 29, 30, 31, 45, 90, 300]), o) for o in rnd.choices("MIDNX=", [6, 4, 4, 0.3, 1, 1], k=rnd.randint(1, 14))]
    parts += [(7, "S")] if rnd.random() < 0.3 else []
    length = sum(n for n, o in parts if o in "MISX=")
    seq = "".join(rnd.choice("ACGT") for _ in range(length))
    return (f"p{k}", rnd.choice(["c1", "c2"]), rnd.choice([0, 16, 256, 272, 2048]), rnd.choice([60, 20, 19]), rnd.randrange(500_000), k % 3, "".join(f"{n}{o}" for n, o in parts), length, seq, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_signatures_are_those_of_plain_code(spark, seed):
    rnd = random.Random(seed)
    rows = [split_read(rnd, k) for k in range(6000)] + [plain_read(rnd, k) for k in range(1500)]
    names = [x.split()[0] for x in ROWS.split(", ")]
    told = [dict(zip(names, r, strict=True)) for r in rows]
    regions = None if seed == 1 else [("c1", 10_000, 60_000), ("c1", 50_000, 90_000), ("c2", 0, 250_000)]
    bed = None if regions is None else spark.createDataFrame(regions, "chrom string, bed_start long, bed_end long")
    with Job(spark) as job:
        made = jobs.extract_signatures(spark.createDataFrame(rows, ROWS).repartition(6), bed, job=job)
        sig = [(r.svtype, r.chrom, r.pos, r.len, r.pos2, r.chrom2, r.strand, r.bnd_type, r.ins_seq, r.read_name, r.hp) for r in made["sig"].collect()]
        clips = sorted((r.chrom, r.side, r.pos, r.read_name, r.hp) for r in made["clips"].collect())
        reads = sorted((r.chrom, r.ref_start, r.ref_end, r.is_primary, r.read_name, r.hp) for r in made["reads"].collect())
    want = signatures(told, regions)
    kinds = collections.Counter(s[0] for s in want[0])
    assert all(kinds[k] > 100 for k in ("DEL", "INS", "DUP", "INV", "TRA")) and sum(c[1] == 2 for c in want[1]) > 20
    assert len(sig) == len(set(sig)) and set(sig) == want[0]
    assert clips == want[1] and reads == want[2]
