"""Alleles of many small clusters are paired cluster after cluster in a task, not by a group of Python's each."""

import random

from phaseloom.operators import resolve as R


def _grouped(df):
    return "InPandas" in df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_haplotypes(spark):
    rnd = random.Random(3)
    rows = [(f"w{k}", hp, a, rnd.randint(1, 4), float(s := rnd.choice([50, 100, 105, 200])), s - 20.0, s + 20.0) for k in range(300) for hp in (0, 1, 2) for a in range(rnd.randint(0, 3))]
    df = spark.createDataFrame(rows, "win_id string, hp int, allele int, n_signals int, size double, low double, high double").repartition(5)
    made = R.pair_haplotypes(df)
    assert not _grouped(made)
    want = []
    for win in {r[0] for r in rows}:
        own = [dict(zip(df.columns, r, strict=True)) for r in rows if r[0] == win]
        by_hp = {hp: sorted((x for x in own if x["hp"] == hp), key=lambda x: (-x["n_signals"], x["allele"])) for hp in (0, 1, 2)}
        want += [(win, turn, a["hp"], a["allele"], b and b["hp"], b and b["allele"], gt) for turn, (a, b, gt) in enumerate(R._pairs(by_hp))]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str) and made.count() > 300


def test_pairs_of_two_breakpoints(spark):
    rnd = random.Random(4)
    names = ["win_id", "hp", "allele", "n_reads", "bp1", "size", "gt", "least", "least_untagged"]
    rows = [(f"w{k}", hp, a, rnd.randint(3, 30), float(rnd.randint(1, 900)), float(rnd.choice([100, 104, 300])), {0: ".|.", 1: "1|0", 2: "0|1"}[hp], 5, 10) for k in range(300) for hp in (0, 1, 2) for a in range(rnd.randint(0, 3))]
    df = spark.createDataFrame(rows, "win_id string, hp int, allele int, n_reads int, bp1 double, size double, gt string, least int, least_untagged int").repartition(5)
    for mosaic in (False, True):
        made = R.merge_haplotypes_two_breakpoints(df, mosaic)
        assert not _grouped(made)
        want = []
        for win in {r[0] for r in rows}:
            own = sorted((dict(zip(names, r, strict=True)) for r in rows if r[0] == win), key=lambda x: (x["hp"], x["allele"]))
            for turn, (lead, members, gt, bp1, size) in enumerate(R._two_breakpoint_pairs(own, mosaic)):
                want.append((win, turn, lead["hp"], lead["allele"], gt, int(bp1), int(size), sum(m["n_reads"] for m in members), [(m["hp"], m["allele"]) for m in members]))
        got = [(*r[:8], [tuple(m) for m in r.members]) for r in made.collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 100
