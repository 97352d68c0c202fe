"""A4: alleles of a small cluster whose haplotypes don't tell them apart, by two dynamic programs.

The first chooses a chain of intervals that explains the reads' runs of signals best; the second deals each read's runs to
the chosen intervals. A cluster that comes here has under 100 signals by rule. Clusters are read one after another from
sorted partitions, many in one Arrow batch; within a cluster all intervals, reads and runs are arrays, without a loop over
pairs of ends or over reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Likeness up to the first is ignored; between these, weakened; a run needs more than ASSIGNED to be dealt to an allele.
IGNORED, WEAK, FULL, ASSIGNED = 0.3, 0.5, 0.8, 0.5
#: Signals of a read that can be dealt to alleles, and how far before its bounds a run may begin or end.
DEALT, BACK = 5, 2
#: Coefficients of the power series of the normal distribution's upper half, times the argument, by its square.
_SERIES = [(-1) ** n / (math.factorial(n) * (2 * n + 1) * 2**n * math.sqrt(2 * math.pi)) for n in range(16)]
#: Beyond this shift a likeness can't exceed IGNORED; the series is exact to some 1e-16 up to there.
_SHIFT = 1.04


def likeness(low, high, start, end, center) -> np.ndarray:
    """How alike the interval [low, high] and a run from start to end with this weighted center are; up to IGNORED: zero."""
    own, run = high - low + 1.0, end - start + 1.0
    common = np.maximum(0.0, np.minimum(high, end) - np.maximum(low, start) + 1)
    longer = np.maximum(own, run)
    value = np.maximum(own * run / (own + run), common) * 2 / longer * (np.minimum(own, run) / longer)
    shift = 6 * np.abs((low + high) / 2 - center) / (own + run)
    out = np.zeros(np.shape(value))
    able = (value > 2 * IGNORED) & (shift < _SHIFT)
    x = shift[able]
    square, tail = x * x, np.zeros(len(x))
    for c in reversed(_SERIES):
        tail = tail * square + c
    out[able] = value[able] * (0.5 - x * tail)
    return np.where(out > IGNORED, out, 0.0)


class Reads:
    """The signals of a cluster by read, in each by position; sums give any run's length and center."""

    def __init__(self, read: np.ndarray, pos: np.ndarray, length: np.ndarray) -> None:
        self.row = np.lexsort((np.arange(len(pos)), pos, read))
        self.start = pos[self.row].astype(float)
        self.end = self.start + length[self.row] - 1
        _, self.first, self.n = np.unique(read[self.row], return_index=True, return_counts=True)
        self.of = np.repeat(np.arange(len(self.n)), self.n)
        size = self.end - self.start + 1
        self.total = np.concatenate([[0.0], np.cumsum(size)])
        self.moment = np.concatenate([[0.0], np.cumsum(size * (self.start + self.end) / 2)])

    def size(self, i, j) -> np.ndarray:
        """Summed length of the signals i to j."""
        return self.total[j + 1] - self.total[i]

    def like(self, low, high, i, j) -> np.ndarray:
        """Likeness of intervals and the runs of signals i to j."""
        return likeness(low, high, self.start[i], self.end[j], (self.moment[j + 1] - self.moment[i]) / self.size(i, j))

    def counted(self, which: np.ndarray) -> np.ndarray:
        """How many signals of each read (rows) are marked, for each column."""
        return np.add.reduceat(which.astype(np.int64), self.first, axis=0)

    def last_within(self, highs: np.ndarray) -> np.ndarray:
        """For each signal (rows) and bound the last signal of the longest run that it begins within the bound; -1: none."""
        out = np.full((len(self.start) + 1, len(highs)), -1)
        own = np.append(self.of, -1)
        for s in range(len(self.start) - 1, -1, -1):
            after = out[s + 1] if own[s + 1] == own[s] else -1
            out[s] = np.where(self.end[s] <= highs, np.maximum(after, s), -1)
        return out[:-1]


def interval_scores(reads: Reads, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """score[l, r, q]: worth of the interval (lows[l], highs[r]) counting only runs that end after highs[q]."""
    n_low, n_high = len(lows), len(highs)
    before = reads.counted(reads.start[:, None] < lows)  # signals of each read before each lower end
    read, low = np.nonzero(before < reads.n[:, None])
    lead = reads.first[read] + before[read, low]
    last = reads.last_within(highs)[lead]
    pair, high = np.nonzero((last >= 0) & (highs > lows[low][:, None]))
    i, j, low = lead[pair], last[pair, high], low[pair]
    s = reads.like(lows[low], highs[high], i, j)
    some = s > 0
    i, j, low, high, s = i[some], j[some], low[some], high[some], s[some]
    weight = np.where(s >= FULL, s, np.where(s > WEAK, 2 * s * s - 0.48, 0.1 * s - 0.03))
    worth = weight * reads.size(i, j) / (highs[high] - lows[low] + 1)
    score = np.zeros((n_low * n_high, n_high))
    if not len(worth):
        return score.reshape(n_low, n_high, n_high)
    # runs of an interval by end, then worth, both falling: the k-th counts with the weight ln k, the first with 1
    group, end = low * n_high + high, np.searchsorted(highs, reads.end)[j]
    fine = ((1 << 30) * (1 - worth / (worth.max() + 1e-300))).astype(np.int64)
    order = np.argsort((group * n_high + (n_high - 1 - end)) << 31 | fine)
    group, end, worth = group[order], end[order], worth[order]
    ids, begin = np.unique(group, return_index=True)
    size = np.diff(np.append(begin, len(group)))
    turn = np.arange(len(group)) - np.repeat(begin, size)
    gain = np.concatenate([[1.0], np.log(np.arange(2, len(reads.n) + 2))])
    sums = np.concatenate([[0.0], np.cumsum(worth * gain[turn])])
    own = np.repeat(np.arange(len(ids)), size)
    past = size[:, None] - np.cumsum(np.bincount(own * n_high + end, minlength=len(ids) * n_high).reshape(len(ids), n_high), 1)
    score[ids] = np.where(past > 0, (past + 1) * (sums[begin[:, None] + past] - sums[begin][:, None]), 0.0)
    return score.reshape(n_low, n_high, n_high)


def chosen_intervals(score: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> list[tuple[int, int, float]]:
    """The best chain of intervals: (low, high, worth), by upper end. highs[0] is 0 and stands for no interval."""
    n = len(highs)
    before = np.searchsorted(highs[1:], lows)  # upper ends below each lower one
    best = np.zeros((n, n))  # symmetric: [last end, end before it]
    back_to, back_low = np.zeros((n, n), int), np.zeros((n, n), int)
    top, at = 0.0, (0, 0)
    for i in range(n):
        for j in (range(i), (i,)):
            rows = np.arange(i) if isinstance(j, range) else np.array([i])
            known = best[rows][:, : max(i, 1)]
            lead = np.maximum.accumulate(known, 1)
            first = np.maximum.accumulate(np.where(known > np.concatenate([np.full((len(rows), 1), -1.0), lead[:, :-1]], 1), np.arange(known.shape[1]), 0), 1)
            upto = np.minimum(before, known.shape[1] - 1)
            total = lead[:, upto] + score[:, i, rows].T if len(rows) else np.zeros((0, len(lows)))
            for row, r in enumerate(rows):
                low = int(np.argmax(total[row]))
                if total[row, low] > 0:
                    best[i, r] = best[r, i] = total[row, low]
                    back_to[i, r], back_low[i, r] = first[row, upto[low]], low
                if best[i, r] > top:
                    top, at = best[i, r], (i, int(r))
    found = []
    i, j = at
    while best[i, j] > 0:
        k, low = back_to[i, j], back_low[i, j]
        found.append((int(lows[low]), int(highs[i]), float(score[low, i, max(j, k)])))
        i, j = max(j, k), min(j, k)
    return sorted(found[::-1], key=lambda x: x[1])


def dealt_runs(reads: Reads, chosen: list[tuple[int, int, float]]) -> list[tuple[int, int, int]]:
    """(interval, first, last signal) of the runs of all reads that go to the chosen intervals, for the greatest worth.

    For each interval in turn, worth[r, i] becomes the most that the signals up to i of read r give, of the first DEALT ones:
    what it was, or that of the signals before k and the likeness of the run k to i, for the first such k, or what the
    signals up to i - 1 give. Runs may end from BACK signals before the first one that reaches the interval's end, and begin
    from BACK signals before the last one that begins before it. ``taken`` is the interval and k of the last change of i.
    """
    if not chosen:
        return []
    lows, highs, gains = (np.array(x, float) for x in zip(*chosen, strict=True))
    lift = reads.of * (reads.end.max() + 1)
    reach = np.maximum.accumulate(reads.end + lift) - lift
    now = np.minimum(reads.counted(reach[:, None] < highs), reads.n[:, None] - 1)
    opening = np.minimum(reads.counted(reads.start[:, None] <= lows) - 1, now)
    n_reads, k, i = len(reads.n), *np.triu_indices(DEALT)
    first = np.minimum(reads.first[:, None] + k, len(reads.start) - 1)
    last = np.minimum(reads.first[:, None] + i, len(reads.start) - 1)
    there = i < reads.n[:, None]
    worth = np.zeros((n_reads, DEALT + 1))  # [r, 0]: before the first signal
    taken = np.full((n_reads, DEALT, 2), -1)
    for t in range(len(chosen)):
        able = there & (i >= now[:, t, None] - BACK) & (k >= opening[:, t, None] - BACK)
        s = np.zeros(first.shape)
        s[able] = reads.like(lows[t], highs[t], first[able], last[able])
        offer = np.full((n_reads, DEALT, DEALT), -1.0)  # [r, i, k]
        offer[:, i, k] = np.where(s > ASSIGNED, worth[:, k] + s * gains[t], -1.0)
        best = offer.argmax(2)
        most = np.take_along_axis(offer, best[:, :, None], 2)[:, :, 0]
        more = most > worth[:, 1:]
        worth[:, 1:] = np.where(more, most, worth[:, 1:])
        taken[more] = np.stack([np.full(int(more.sum()), t), best[more]], 1)
        for at in range(1, DEALT + 1):
            carried = worth[:, at] < worth[:, at - 1]
            worth[carried, at] = worth[carried, at - 1]
            taken[carried, at - 1] = -1
    out = []
    for r, n in enumerate(np.minimum(reads.n, DEALT).tolist()):
        at = n - 1
        while at >= 0:
            which, begin = taken[r, at].tolist()
            if which >= 0:
                out.append((which, int(reads.first[r]) + begin, int(reads.first[r]) + at))
            at = begin - 1 if which >= 0 else at - 1
    return out


def solve(read: np.ndarray, pos: np.ndarray, length: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(start, length, members) of each allele; members are indices into the signals given, ``read`` numbers the reads.

    An allele is where two reads or more agree; where no two do, single reads make alleles.
    """
    reads = Reads(read, pos, length)
    lows, highs = np.unique(pos), np.unique(np.concatenate([[0], pos + length - 1]))
    chosen = chosen_intervals(interval_scores(reads, lows, highs), lows, highs)
    runs: list[list[tuple[int, int, list[int]]]] = [[] for _ in chosen]
    for which, i, j in dealt_runs(reads, chosen):
        runs[which].append((int(reads.start[i]), int(reads.end[j]), reads.row[i : j + 1].tolist()))
    least = 2 if any(len(x) > 1 for x in runs) else 1
    made = []
    for own in runs:
        if len(own) >= least:
            start, end = (sum(x[k] for x in own) // len(own) for k in (0, 1))
            made.append((start, end - start + 1, [row for x in own for row in x[2]]))
    return made


def allele_dp(clusters: DataFrame) -> DataFrame:
    """(win_id, allele, start, length, read_name, pos, len, hp): one row a member signal; alleles numbered by position.

    Clusters are dealt and sorted by ``win_id``, with one shuffle; of a partition no more than an Arrow batch and one cluster
    is held.
    """
    order = ["win_id", "pos", "len", "read_name"]
    schema = pa.schema([("win_id", pa.string()), ("allele", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("read_name", pa.string()), ("pos", pa.int64()), ("len", pa.int64()), ("hp", pa.int32())])

    def solved(table: pa.Table) -> pa.RecordBatch:
        """The alleles of whole clusters, one after another."""
        read, pos, length = np.asarray(table["read_name"].combine_chunks().dictionary_encode().indices), np.asarray(table["pos"]), np.asarray(table["len"])
        win = np.asarray(table["win_id"].combine_chunks().dictionary_encode().indices)
        edge = np.append(np.flatnonzero(np.diff(win, prepend=-1)), len(win))
        rows, alleles, starts, lengths = [], [], [], []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            for k, (start, size, members) in enumerate(solve(read[a:b], pos[a:b], length[a:b])):
                rows += [a + row for row in members]
                alleles += [k] * len(members)
                starts += [start] * len(members)
                lengths += [size] * len(members)
        own = table.take(pa.array(rows, pa.int64())).combine_chunks()
        made = [pa.array(alleles, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())]
        columns = [own["win_id"], *made, own["read_name"], own["pos"], own["len"], own["hp"]]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table.num_rows:
                win = table["win_id"].combine_chunks()
                open_ = pa.compute.index(win, win[len(win) - 1]).as_py()
                if open_:
                    yield from solved(table.slice(0, open_)).to_batches()
                rest = table.slice(open_)
        if rest is not None:
            yield from solved(rest).to_batches()

    rows = clusters.select("win_id", "read_name", F.col("pos").cast("long").alias("pos"), F.col("len").cast("long").alias("len"), F.col("hp").cast("int").alias("hp"))
    n = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "win_id").sortWithinPartitions(*order).mapInArrow(run, "win_id string, allele int, start long, length long, read_name string, pos long, len long, hp int")
