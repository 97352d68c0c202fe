"""Operator 13, periodic run detection by internal pattern matching.

Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of words with smallest period q and at least max(LEAST, TIMES * q) words
that can't be extended on either side. Documents of about a megabyte are taken together as one sequence in which words of
different documents differ. Its suffix array grows by doubling, and after each doubling the positions with equal first
2**k words are one range of it. The blocks of 2**k words at multiples of 2**k then ask for their next and their last
occurrence before and after them: a range successor over the suffix array, by a wavelet matrix. A run of four periods holds
such a block with q <= 2**k < 2q and at least q words more on one side, so there its nearest occurrence is q words away; the
occurrences of a block in a neighbouring window stand in a progression, of which that is the step. So every run is found by
a block of its own level, and the step is its smallest period. Only blocks whose first word comes back within their length
ask at all. Candidates are extended word by word as far as the step is kept.

Words are compared by 64-bit hashes; the words of a found run are compared themselves. Null and empty texts have no words and
no run. Repeated rows and ties are treated one by one; rows keep their identifiers, null ones too. An empty table gives an
empty result. Extra columns are not read. A text is read whole, alone if longer than a chunk: memory is some 150 bytes for
each word of the longest text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

LEAST, TIMES = 6, 4
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_KINDS = {"long": pa.int64(), "string": pa.string(), _RUNS: pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))}


class WaveletMatrix:
    """Numbers below 2**bits, asked for how many of a range are less than a bound, and for the k-th least of a range."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.levels = []
        for b in reversed(range(bits)):
            bit = (values >> b & 1).astype(bool)
            ones = np.zeros(len(values) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[~bit], values[bit]])

    def less(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values at low to high - 1 are less than each bound."""
        out = np.zeros(len(low), np.int64)
        for b, ones, zeros in self.levels:
            bit, l1, h1 = (bound >> b & 1).astype(bool), ones[low], ones[high]
            out += np.where(bit, high - low - (h1 - l1), 0)
            low, high = np.where(bit, zeros + l1, low - l1), np.where(bit, zeros + h1, high - h1)
        return out

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least value, from 0, at low to high - 1."""
        out = np.zeros(len(low), np.int64)
        for b, ones, zeros in self.levels:
            l1, h1 = ones[low], ones[high]
            few = high - low - (h1 - l1)
            bit = k >= few
            out |= np.where(bit, 1 << b, 0)
            k = np.where(bit, k - few, k)
            low, high = np.where(bit, zeros + l1, low - l1), np.where(bit, zeros + h1, high - h1)
        return out


def blocks(x: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of x, and (block, its length, range of its occurrences in the array) of those that may lie in a run.

    ``end`` is the end of each position's document; equal values occur in one document only.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    same = x[order][1:] == x[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(n), 0))
    far = np.full(n, n, np.int64)  # words to the nearest place of the same word
    step = np.diff(order)[same]
    np.minimum.at(far, order[:-1][same], step)
    np.minimum.at(far, order[1:][same], step)
    found, width = [], 1
    while True:
        size = np.bincount(rank, minlength=n)
        at = np.arange(0, n, width)
        at = at[(size[rank[at]] > 1) & (far[at] <= width)]
        found.append(np.stack([at, np.full(len(at), width), rank[at], rank[at] + size[rank[at]]], 1))
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            return order, np.concatenate(found)
        after = open_ + width
        inside = after < end[open_]
        key = rank[open_] * (n + 1)
        key[inside] += rank[after[inside]] + 1
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old = rank[open_]
        head = np.ones(len(open_), bool)
        head[1:] = old[1:] != old[:-1]
        slot = old + np.arange(len(open_)) - np.maximum.accumulate(np.where(head, np.arange(len(open_)), 0))
        order[slot] = open_
        new = np.ones(len(open_), bool)
        new[1:] = key[1:] != key[:-1]
        rank[open_] = np.maximum.accumulate(np.where(new, slot, 0))
        width *= 2


def runs(x: np.ndarray, at: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of every run of x, in order; at: offsets of the documents, whose values differ. ``times`` >= 4."""
    if len(x) < least:
        return np.zeros((0, 3), np.int64)
    order, asked = blocks(x, np.repeat(at[1:], np.diff(at)))
    if not len(asked):
        return np.zeros((0, 3), np.int64)
    tree = WaveletMatrix(order, len(x).bit_length())
    place, width, low, high = asked.T
    own = tree.less(low, high, place)
    steps = []
    for k, able, sign in ((own + 1, own + 1 < high - low, 1), (own - 1, own > 0, -1)):
        b, w = place[able], width[able]
        step = (tree.kth(low[able], high[able], k[able]) - b) * sign
        some = (step <= w) & (2 * step > w)
        # the earlier of the two occurrences: from there on words are equal to those a step further
        steps.append(step[some] * len(x) + b[some] - (step[some] if sign < 0 else 0))
    made = [np.zeros((0, 3), np.int64)]
    period, place = np.divmod(np.unique(np.concatenate(steps)), len(x))
    cut = np.flatnonzero(np.diff(period, prepend=0))
    for q, own in zip(period[cut].tolist(), np.split(place, cut[1:]), strict=True) if len(cut) else ():
        ends = np.concatenate([[-1], np.flatnonzero(x[:-q] != x[q:]), [len(x) - q]])
        k = np.searchsorted(ends, own)
        k = k[np.diff(k, prepend=-1) > 0]
        start, length = ends[k - 1] + 1, ends[k] - ends[k - 1] - 1 + q
        long = length >= max(least, times * q)
        made.append(np.stack([start[long], length[long], np.full(int(long.sum()), q)], 1))
    out = np.concatenate(made)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


class Page:
    """The runs of a chunk of documents."""

    def __init__(self, raw: np.ndarray, at: np.ndarray) -> None:
        self.raw, self.words = raw, C.Words(raw, at)
        words = self.words
        key = C.mixed(C.run_hashes(raw, words.start, words.end) + words.doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        found = runs(key, words.at)

        def same(a: int, n: int, q: int) -> bool:
            own = raw[words.start[a] : words.end[a + n - 1]].tobytes().split()
            return own[:-q] == own[q:]

        real = [same(*run) for run in found.tolist()]
        #: (start, length, period) by start, then period; starts count in the chunk.
        self.runs = found[np.array(real, bool)] if len(found) else found
        self.at = np.searchsorted(self.runs[:, 0], words.at)

    def of(self, doc: int) -> list[tuple[int, int, int]]:
        """(start, length, period) of a document's runs, in its own words."""
        first = int(self.words.at[doc])
        return [(a - first, n, q) for a, n, q in self.runs[self.at[doc] : self.at[doc + 1]].tolist()]

    def collapsed(self, doc: int) -> bytes:
        """The document's words but those that a run has after its first period, joined by one space."""
        a, b = int(self.words.at[doc]), int(self.words.at[doc + 1])
        if a == b:
            return b""
        own = self.raw[self.words.start[a] : self.words.end[b - 1]].tobytes().split()
        found = self.of(doc)
        if found:
            keep = np.ones(len(own), bool)
            for start, n, q in found:
                keep[start + q : start + n] = False
            own = [own[k] for k in np.flatnonzero(keep).tolist()]
        return b" ".join(own)


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length over period; of equal ones the first, then the one of least period."""
    top = None
    for run in found:  # by start, then period
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def _pages(df: DataFrame, id_col: str, text_col: str, give: Callable[[Page, int], tuple], schema: str, change: Callable | None = None) -> DataFrame:
    """``give`` of every document, after its identifier; ``change`` makes the texts of a batch anew."""
    names = C.column_names(schema)
    kinds = [_KINDS[part] for part in (x[len(n) + 1 :] for n, x in zip(names, re.split(", (?=[a-z_0-9]+ )", schema), strict=True))]

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(1) if change is None else change(batch.column(0), batch.column(1))
        for row, end, raw, at in C.chunks(texts):
            page = Page(raw, at)
            rows = zip(*(give(page, k) for k in range(end - row)), strict=True)
            yield {"doc_id": batch.column(0).slice(row, end - row), **{n: pa.array(x, kind) for n, kind, x in zip(names, kinds, rows, strict=True)}}

    return C.in_arrow(C.texts(df, id_col, text_col), work, f"doc_id long, {schema}")


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): every document's runs in words, and its text with one period of each run left. No shuffle."""

    def give(page: Page, k: int) -> tuple:
        return [dict(zip(("start", "length", "period"), x, strict=True)) for x in page.of(k)], page.collapsed(k).decode()

    return _pages(df, id_col, text_col, give, f"runs {_RUNS}, collapsed string")


def repeated_tails(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """The query's own texts: one document in ten goes on with a period from some word on, as its identifier's checksum says.

    With h the checksum of the decimal identifier and g = h // 10, word i >= a becomes word a + (i - a) % p, for a = g % n and
    p = 1 + (n - a) // (3 + g % 8). A document without an identifier stays as it is.
    """
    out: list[str | bytes] = []
    for id_, text in zip(ids.to_pylist(), texts, strict=True):
        h = 1 if id_ is None else zlib.crc32(b"%d" % id_)
        raw = text.as_buffer().to_pybytes()
        if h % 10 == 0 and (words := raw.split()):
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            raw = b" ".join(words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a])
        out.append(raw)
    return pa.array(out, pa.large_binary()).cast(pa.large_string())


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the runs of every whole text of ``documents``, after repeated_tails()."""
    hexed = lambda data: hashlib.sha256(data).hexdigest()

    def give(page: Page, k: int) -> tuple:
        found = page.of(k)
        start, length, period = best(found) or (None, None, None)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in found).encode()
        return len(found), start, length, period, None if period is None else 1000 * length // period, hexed(lines), hexed(page.collapsed(k))

    schema = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _pages(C.table(spark, sf_dir, "documents"), "doc_id", "text", give, schema, repeated_tails)
