"""Signals by batches of CIGAR texts against plain code, and how often a text is parsed."""

import random
import re

from phaseloom.operators import reads as P
from phaseloom.params import Params

BASES = "ACGT"


def _plain(cigar, start, seq, p, merge, uniform):
    """(svtype, pos, len, bases) of one read, one operation after another."""
    ops = [(x[-1], int(x[:-1])) for x in re.findall("[0-9]+[MIDNSHP=X]", cigar)]
    at, query, found = start, -ops[0][1] if ops[0][0] == "H" else 0, []
    for op, n in ops:
        if op in "ID" and n >= p.min_siglength:
            found.append(["INS" if op == "I" else "DEL", at, n, seq[max(query, 0) : query + n] if op == "I" else None])
        at += n if op in "MDN=X" else 0
        query += n if op != "D" else 0
    if not merge:
        return [tuple(x) for x in found]
    out, open_, mark, before = [], {}, {}, None
    for kind, pos, n, bases in found:
        last = open_.get(kind)
        near = before == kind and pos - mark[kind] <= min(last[2], n, p.merge_gap)
        mark[kind] = pos if kind == "INS" else pos + n if uniform or near or last is None else pos
        if near:
            last[2] += n
            last[3] = None if kind == "DEL" else last[3] + bases
        else:
            open_[kind] = [kind, pos, n, bases]
            out.append(open_[kind])
        before = kind
    return [tuple(x) for x in out]


def test_against_plain_code(spark):
    rnd, rows = random.Random(5), []
    for k in range(400):
        ops = [f"{rnd.choice([1, 5, 20, 29, 30, 31, 45, 90])}{rnd.choice('MMIIDDN=XP')}" for _ in range(rnd.randint(1, 30))]
        cigar = (rnd.choice(["", "7S", "9H"]) if k % 3 else "") + "".join(ops)
        rows.append((f"r{k}", "c", 100 * k, "".join(rnd.choice(BASES) for _ in range(3000)), 3000, 60, 1, cigar))
    odd = [("n", None), ("star", "*"), ("empty", ""), ("letter", "M40D"), ("foreign", "40D3Q5M50D")]
    rows += [(name, "c", 10, "A" * 600, 600, 60, 0, cigar) for name, cigar in odd]
    df = spark.createDataFrame(rows, "read_name string, chrom string, ref_start long, query_seq string, query_len int, mapq int, hp int, cigar string").repartition(3)
    for p in (Params(), Params(min_siglength=5, merge_gap=60)):
        for merge, uniform, made in ((False, False, P.cigar_signals(df, p)), (True, False, P.merge_in_read(df, p)), (True, True, P.merge_in_read(df, p, True))):
            got = sorted(((r.read_name, r.svtype, r.pos, r.len, r.bases or "") for r in made.collect()), key=str)
            want = [(r[0], a, b, n, s or "") for r in rows[:400] for a, b, n, s in _plain(r[7], r[2], r[3], p, merge, uniform)]
            # of a text with a foreign letter what lies before it counts, and lengths only after it
            assert [x for x in got if x[0][0] == "r"] == sorted(want, key=str)
            rest = {x[0] for x in got if x[0][0] != "r"}
            assert rest == {"letter", "foreign"}


def test_a_text_is_parsed_once(spark):
    rows = [("a", "c", 10, 0, 60, 1, 600, "A" * 600, "100S500M", "c,900,+,400S200M,60,0;")]
    df = spark.createDataFrame(rows, "read_name string, chrom string, ref_start long, flag int, mapq int, hp int, query_len int, query_seq string, cigar string, sa string")
    made = P.split_segments(df)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MIDNSHP=X") == 2  # the row's and those of its other alignments
    assert [(r.read_len, len(r.segs)) for r in made.collect()] == [(600, 2)]
    signals = P.merge_in_read(df)._jdf.queryExecution().executedPlan().toString()
    assert signals.count("ArrowEvalPython") == 1 and "MIDNSHP=X" not in signals
