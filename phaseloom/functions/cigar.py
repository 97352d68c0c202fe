"""Long insertions and deletions of CIGAR texts, for Arrow batches: all texts of a batch are parsed as one array of bytes.

Texts that aren't a plain list of operations go one by one, by the rules of ``sequence.parse_cigar``.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

SIGNALS = "array<struct<svtype:string,ahead:bigint,len:bigint,parts:array<struct<query:bigint,len:bigint>>>>"
#: A list of operations whose lengths fit a long integer.
PLAIN = "^(?:[0-9]{1,18}[MIDNSHP=X])*$"
_OF_REF, _DEL, _INS = (np.isin(np.arange(256), list(kinds)) for kinds in (b"MDN=X", b"D", b"I"))
_TEN = 10 ** np.arange(19, dtype=np.int64)


def _plain(texts: pa.Array, min_len: int) -> tuple[np.ndarray, ...]:
    """(row, insertion, reference and read bases before it, length) of the long operations of plain texts."""
    if not len(texts):
        return (np.zeros(0, np.int64),) * 5
    texts = pa.concat_arrays([texts.cast(pa.large_binary())])  # from its own first byte on
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    ends = np.flatnonzero(raw > ord("9"))
    if not len(ends):
        return (np.zeros(0, np.int64),) * 5
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.repeat(ends, ends - starts + 1) - np.arange(len(raw)) - 1  # of each digit; its operation: -1
    length = np.add.reduceat(np.where(place >= 0, raw - np.uint8(48), 0).astype(np.int64) * _TEN[np.maximum(place, 0)], starts)
    op = raw[ends]
    first = np.searchsorted(ends, at[:-1])
    row = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(ends))))
    ahead = np.cumsum(np.where(_OF_REF[op], length, 0))
    query = np.cumsum(np.where(_DEL[op], 0, length))
    kept = np.flatnonzero((_DEL[op] | _INS[op]) & (length >= min_len))
    lead = first[row[kept]]
    before = lambda sums: np.concatenate([[0], sums])[kept] - np.concatenate([[0], sums])[lead]
    hard = np.where(op[lead] == ord("H"), length[lead], 0)
    return row[kept], _INS[op[kept]], before(ahead), before(query) - hard, length[kept]


def _whole(text: str) -> int | None:
    found = re.fullmatch(r"\s*([+-]?[0-9]+)\s*", text)
    value = int(found[1]) if found else None
    return value if value is not None and -(1 << 63) <= value < 1 << 63 else None


def _other(text: str | None, min_len: int) -> list[tuple]:
    """The same of one text, without its row; None for sums over a length that isn't a number."""
    ops = [(x[-1], _whole(x[:-1])) for x in re.split("(?<=[MIDNSHP=X])", text or "") if len(x) > 1]
    total = lambda lengths: None if None in lengths else sum(lengths)
    out = []
    for k, (op, n) in enumerate(ops):
        if op in "ID" and n is not None and n >= min_len:
            query = total([m for o, m in ops[:k] if o != "D"] + ([None if ops[0][1] is None else -ops[0][1]] if ops[0][0] == "H" else []))
            out.append((op == "I", total([m for o, m in ops[:k] if o in "MDN=X"]), query, n))
    return out


def _joined(row: np.ndarray, ins: np.ndarray, pos: np.ndarray, length: np.ndarray, gap: int, uniform_gap: bool) -> np.ndarray:
    """Whether each signal, in the order of its read, joins the one before it.

    Reads go on together, each by a signal at a time; what is open is one signal of each type.
    """
    first = np.flatnonzero(np.diff(row, prepend=-1))
    count = np.diff(np.append(first, len(row)))
    by = np.argsort(-count, kind="stable")
    first, count = first[by], count[by]
    joined = np.zeros(len(row), bool)
    size, mark = np.zeros((2, len(first)), np.int64), np.zeros((2, len(first)), np.int64)
    before, some = np.full(len(first), -1), np.zeros(len(first), bool)  # type of the last signal; whether a deletion is open
    for step in range(count[0] if len(count) else 0):
        n = int(np.searchsorted(-count, -step, "left"))  # reads with more signals
        x, all_ = first[:n] + step, np.arange(n)
        kind = ins[x].astype(np.int64)
        near = (before[:n] == kind) & (pos[x] - mark[kind, all_] <= np.minimum(np.minimum(size[kind, all_], length[x]), gap))
        joined[x] = near
        size[kind, all_] = np.where(near, size[kind, all_], 0) + length[x]
        at_end = (kind == 0) & (uniform_gap | near | ~some[:n])
        mark[kind, all_] = pos[x] + np.where(at_end, length[x], 0)
        some[:n] |= kind == 0
        before[:n] = kind
    return joined


def signals(min_len: int, gap: int | None = None, uniform_gap: bool = False):
    """A column function from CIGAR texts to their long insertions and deletions, in order; with ``gap`` neighbours joined.

    ``ahead`` counts reference bases from the alignment's start; ``parts`` are where an insertion's bases are in the read.
    """

    @F.arrow_udf(SIGNALS)
    def found(cigar: pa.Array) -> pa.Array:
        plain = pc.fill_null(pc.match_substring_regex(cigar, PLAIN), False)
        which = np.flatnonzero(np.asarray(plain))
        row, ins, ahead, query, length = _plain(cigar.filter(plain), min_len)
        row = which[row]
        odd = [(k, *x) for k in np.flatnonzero(~np.asarray(plain)).tolist() for x in _other(cigar[k].as_py(), min_len)]
        lost = np.zeros((2, len(row)), bool)
        if odd:
            more = [np.array([0 if x is None else x for x in column]) for column in zip(*odd, strict=True)]
            lost = np.concatenate([lost, [[x[2] is None for x in odd], [x[3] is None for x in odd]]], 1)
            row, ins, ahead, query, length = (np.concatenate(x) for x in zip((row, ins, ahead, query, length), more, strict=True))
            by = np.argsort(row, kind="stable")
            row, ins, ahead, query, length, lost = row[by], ins[by].astype(bool), ahead[by], query[by], length[by], lost[:, by]
        joined = np.zeros(len(row), bool) if gap is None else _joined(row, ins, ahead, length, gap, uniform_gap)
        lead = np.flatnonzero(~joined)
        parts = pa.StructArray.from_arrays([pa.array(query, pa.int64(), mask=lost[1]), pa.array(length, pa.int64())], ["query", "len"])
        made = pa.StructArray.from_arrays(
            [
                pa.DictionaryArray.from_arrays(pa.array(ins[lead].astype(np.int32)), pa.array(["DEL", "INS"])).cast(pa.string()),
                pa.array(ahead[lead], pa.int64(), mask=lost[0][lead]),
                pa.array(np.add.reduceat(length, lead) if len(lead) else length, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.append(lead, len(row)), pa.int32()), parts),
            ],
            ["svtype", "ahead", "len", "parts"],
        )
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[lead], np.arange(len(cigar) + 1)), pa.int32()), made)

    return found
