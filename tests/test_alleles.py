"""The allele dynamic program, pairing of haplotypes and rescue of clips against slow direct versions and hand cases."""

import math
import random
import time

import numpy as np
import pytest

from phaseloom.operators import allele_dp as dp
from phaseloom.operators import resolve as R


def _reads(rnd, n, most=3):
    """Signals of n reads around one place: (reads, positions, lengths)."""
    rows = []
    for k in range(n):
        for _ in range(rnd.choice([1, 1, 1, 2, most])):
            rows.append((k, 1000 + rnd.randrange(300), rnd.choice([60, 65, 180, 200])))
    rows.sort(key=lambda x: x[1])
    return tuple(np.array(x) for x in zip(*rows, strict=True))


def _built(read, pos, length):
    own = {}
    for name, p, n in zip(read.tolist(), pos.tolist(), length.tolist(), strict=True):
        own.setdefault(name, []).append((p, n))
    return dp.Reads(read, pos, length), [own[k] for k in sorted(own)], np.unique(pos), np.unique(np.concatenate([[0], pos + length - 1]))


def _like(run, low, high):
    """Likeness of an interval and a run of (position, length)."""
    total = sum(n for _, n in run)
    center = sum(n * (2 * p + n - 1) / 2 for p, n in run) / total
    start, end = run[0][0], run[-1][0] + run[-1][1] - 1
    a, b = high - low + 1, end - start + 1
    common = max(0, min(high, end) - max(low, start) + 1)
    return 2 / max(a, b) * max(a * b / (a + b), common) * min(a, b) / max(a, b) * (1 - 0.5 * (1 + math.erf(6 * abs((low + high) / 2 - center) / (a + b) / math.sqrt(2))))


def _worth(signals, low, high):
    """(end, worth) of a read's run within an interval, or None."""
    inside = [s for s in signals if s[0] >= low]
    run = []
    for p, n in inside:
        if p + n - 1 > high:
            break
        run.append((p, n))
    if not run or high <= low:
        return None
    total, end = sum(n for _, n in run), run[-1][0] + run[-1][1] - 1
    s = _like(run, low, high)
    if s <= 0.3:
        return None
    return end, (s if s >= 0.8 else 2 * s * s - 0.48 if s > 0.5 else 0.1 * s - 0.03) * total / (high - low + 1)


@pytest.mark.parametrize("seed", range(6))
def test_scores_and_chain(seed):
    reads, raw, lows, highs = _built(*_reads(random.Random(seed), 7))
    score = dp.interval_scores(reads, lows, highs)
    for a, low in enumerate(lows):
        for b, high in enumerate(highs):
            runs = sorted((w for w in (_worth(x, low, high) for x in raw) if w), reverse=True)
            for q in range(b + 1):
                past = [w for end, w in runs if end > highs[q]]
                want = (len(past) + 1) * sum(w * (1 if k == 1 else math.log(k)) for k, w in enumerate(past, 1)) if past else 0
                assert score[a, b, q] == pytest.approx(want, abs=1e-9)
    # the worth of the chosen chain is that of a plain recursion over (last end, end before it)
    n, known = len(highs), {}

    def best(i, j):
        if (i, j) not in known:
            known[i, j] = 0.0
            ahead = [k for k in range(n) if k < i]
            known[i, j] = max([0.0] + [max([best(*sorted((k, j), reverse=True)) for k in ahead if k == 0 or highs[k] < low] or [0.0]) + score[a, i, j] for a, low in enumerate(lows)])
        return known[i, j]

    top = max(best(i, j) for i in range(n) for j in range(i + 1))
    chosen = dp.chosen_intervals(score, lows, highs)
    assert bool(chosen) == (top > 0)
    assert sum(c[2] for c in chosen) == pytest.approx(top)


def _dealt_slowly(own, chosen):
    """(interval, first, last signal) of one read's runs; each bound and each run is tried by itself."""
    n, ends, table = len(own), [p + k - 1 for p, k in own], {-1: (0.0, None)} | {i: (0.0, None) for i in range(min(len(own), 5))}
    for which, (low, high, gain) in enumerate(chosen):
        reaching = next((i for i in range(n) if ends[i] >= high), n - 1)
        opening = max([i for i in range(reaching + 1) if own[i][0] <= low], default=-1)
        old = dict(table)
        for last in range(max(0, reaching - 2), min(5, n)):
            for first in range(max(0, opening - 2), last + 1):
                s = _like(own[first : last + 1], low, high)
                if s > 0.5 and old[first - 1][0] + s * gain > table[last][0]:
                    table[last] = old[first - 1][0] + s * gain, (which, first, last)
        for i in range(1, min(5, n)):
            if table[i][0] < table[i - 1][0]:
                table[i] = table[i - 1][0], None
    out, i = [], min(5, n) - 1
    while i >= 0:
        run = table[i][1]
        if run is not None:
            out.append(run)
        i = i - 1 if run is None else run[1] - 1
    return out


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_dealt_as_by_a_slow_version(seed):
    rnd = random.Random(seed)
    reads, raw, lows, highs = _built(*_reads(rnd, 9, rnd.choice([3, 5, 8])))
    chosen = dp.chosen_intervals(dp.interval_scores(reads, lows, highs), lows, highs)
    if seed % 2:  # and intervals that no chain would have
        chosen = sorted(((low := rnd.choice(lows.tolist())), low + rnd.choice([60, 120, 200, 390]), rnd.random()) for _ in range(6))
        chosen.sort(key=lambda x: x[1])
    want = sorted((which, int(reads.first[r]) + i, int(reads.first[r]) + j) for r, own in enumerate(raw) for which, i, j in _dealt_slowly(own, chosen))
    assert sorted(dp.dealt_runs(reads, chosen)) == want


def test_likeness_is_that_of_the_normal_distribution():
    rnd = random.Random(1)
    for _ in range(3000):
        low, size, start, n = rnd.randrange(1000, 1100), rnd.randrange(2, 300), rnd.randrange(950, 1150), rnd.randrange(1, 300)
        want = _like([(start, n)], low, low + size)
        got = float(dp.likeness(np.array([float(low)]), float(low + size), float(start), float(start + n - 1), start + (n - 1) / 2)[0])
        assert got == pytest.approx(want if want > 0.3 else 0, abs=1e-13)


def test_a_cluster_of_99_signals_is_quick():
    rnd = random.Random(9)
    pos, length = np.array(sorted(1000 + rnd.randrange(40) for _ in range(99))), np.array([80 + rnd.randrange(5) + 1500 * (k % 2) for k in range(99)])
    took = []
    for _ in range(5):
        began = time.perf_counter()
        made = dp.solve(np.arange(99), pos, length)
        took.append(time.perf_counter() - began)
    assert len(made) == 2 and min(took) < 0.06


def test_two_clear_alleles_and_order_of_rows():
    rows = [(f"a{k}", 1000 + k % 3, 100 + k % 2) for k in range(6)] + [(f"b{k}", 1600 + k % 2, 400) for k in range(5)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        by_pos = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
        made = dp.solve(np.unique([r[0] for r in by_pos], return_inverse=True)[1], np.array([r[1] for r in by_pos]), np.array([r[2] for r in by_pos]))
        got = [(s, n, {by_pos[m][0] for m in members}) for s, n, members in made]
        assert [len(x[2]) for x in got] == [6, 5] and got[0][1] in (100, 101) and got[1][:2] == (1600, 400)
        assert want in (None, got)
        want = got


def test_single_read_makes_an_allele():
    assert dp.solve(np.array([0]), np.array([500]), np.array([80])) == [(500, 80, [0])]


def test_pairing_of_haplotypes():
    own = lambda hp, allele, n, size: {"hp": hp, "allele": allele, "n_signals": n, "size": size, "low": size - 5, "high": size + 5}
    by_hp = {1: [own(1, 0, 9, 100), own(1, 1, 5, 300)], 2: [own(2, 0, 8, 102), own(2, 1, 4, 900)], 0: [own(0, 0, 7, 299), own(0, 1, 6, 895), own(0, 2, 5, 5000)]}
    got = [(a["hp"], a["allele"], b and (b["hp"], b["allele"]), gt) for a, b, gt in R._pairs(by_hp)]
    assert got == [(1, 0, (2, 0), "1|1"), (1, 1, (0, 0), "1|0"), (2, 1, (0, 1), "0|1"), (0, 2, None, ".|.")]


def _dup(hp, allele, n, bp1, size, gt, least=5, untagged=10):
    return {"hp": hp, "allele": allele, "n_reads": n, "bp1": float(bp1), "size": float(size), "gt": gt, "least": least, "least_untagged": untagged}


def test_merging_of_two_breakpoint_alleles():
    rows = [_dup(1, 0, 6, 100, 1000, ".|0"), _dup(2, 0, 7, 104, 1010, "0|1"), _dup(2, 1, 4, 100, 3000, "0|1"), _dup(0, 0, 12, 90, 50, ".|."), _dup(0, 1, 9, 90, 70, ".|.")]
    got = [(own["hp"], own["allele"], [(m["hp"], m["allele"]) for m in members], gt, int(bp1), int(size)) for own, members, gt, bp1, size in R._two_breakpoint_pairs(rows, False)]
    assert got == [(1, 0, [(1, 0), (2, 0)], "1|1", 102, 1005), (0, 0, [(0, 0)], ".|.", 90, 50)]
    rows = [_dup(1, 0, 6, 100, 1000, ".|0"), _dup(2, 0, 7, 104, 1010, "0|."), _dup(0, 0, 3, 100, 1004, ".|."), _dup(2, 1, 5, 9, 400, "0|."), _dup(0, 1, 3, 11, 404, ".|.", untagged=5), _dup(0, 2, 6, 1, 77, ".|.", untagged=5)]
    got = [(own["hp"], own["allele"], [(m["hp"], m["allele"]) for m in members], gt) for own, members, gt, _, _ in R._two_breakpoint_pairs(rows, True)]
    assert got == [(1, 0, [(1, 0), (2, 0), (0, 0)], ".|."), (2, 1, [(2, 1), (0, 1)], ".|."), (0, 2, [(0, 2)], ".|.")]


def test_rescue_of_clips(spark):
    rnd = random.Random(5)
    calls = [(f"c{k}", "w", k, rnd.randrange(80), 0, rnd.random() < 0.5, None if rnd.random() < 0.5 else [0, 1 + k % 2]) for k in range(6)]
    calls = [(c, w, k, lo, lo + 60, both, hps) for c, w, k, lo, _, both, hps in calls]
    support = [(f"c{k}", "w", f"r{rnd.randrange(30)}", 0) for k in range(6) for _ in range(4)]
    support = sorted(set(support))
    clips = sorted({("w", f"r{rnd.randrange(30)}", rnd.randrange(2), rnd.randrange(140), rnd.randrange(3)) for _ in range(120)}, key=lambda c: (c[3], c[2], c[4]))
    used, seen, want = set(), set(), set()
    for call, _, _, lo, hi, both, hps in calls:
        own = {r for c, _, r, _ in support if c == call}
        seen |= own
        for clip in clips:
            _, read, side, pos, hp = clip
            if clip in used or read in seen or read in own or not lo < pos < hi or not (both or side == 1) or (hps is not None and hp not in hps):
                continue
            own.add(read)
            used.add(clip)
            want.add((call, read, hp))
    made = R.rescue_clips(
        spark.createDataFrame([(*c, True) for c in calls], "call_id string, win_id string, rank int, c_low long, c_high long, both_sides boolean, haplotypes array<int>, rescue boolean"),
        spark.createDataFrame(support, "call_id string, win_id string, read_name string, hp int"),
        spark.createDataFrame(clips, "win_id string, read_name string, side int, pos long, hp int"),
    )
    assert want and {(r.call_id, r.read_name, r.hp) for r in made.collect()} == want
