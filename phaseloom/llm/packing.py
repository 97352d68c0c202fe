"""Operator 7, packing by sum of squares, online.

Each document's token ids and an end id form its run. Whole windows are cut off a long run where it is encoded; the rest
goes to the fill level that minimises the sum, over all levels, of the squared number of windows filled to that level. A
level array holds those numbers, so a placement reads one array of window size and no window.

Rests are packed as rows of numbers, without their ids, in streams of about STREAM documents in document order: what a
stream leaves open is some 280 windows of 2048 ids whatever its length, 93 % full on average. The fullest of them stay as
they were placed; the emptiest, a few, are taken apart, and their ids, read again, fill the room that the others have. What
is left of them is laid end to end and cut into full windows, and the last of these into powers of two, which need no
padding. So sequences are filled whole or to a power of two.

Null and empty texts are the end id alone. Repeated rows are packed each, null identifiers like others. An empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .byte_bpe import loaded

SIZE, END = 2048, 1
#: Documents of a stream that is packed by one task.
STREAM = 50_000
_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_NEVER = np.iinfo(np.int64).max >> 1


class Packer:
    """Windows being filled. Pieces are (row, length)."""

    def __init__(self, first_sequence: int, size: int = SIZE) -> None:
        self.size, self.next = size, first_sequence
        self.count = np.zeros(size + 1, np.int64)
        #: What the sum of squares gains as a window leaves a level (none: a new window), and as one comes to it.
        self.leaving, self.coming = np.full(size, _NEVER), np.ones(size + 1, np.int64)
        self.leaving[0] = self.coming[size] = 0  # a full window is no longer counted
        self.open: dict[int, list[list[tuple[int, int]]]] = {}
        #: (row, sequence, offset) of the pieces of closed windows.
        self.out: list[tuple[int, int, int]] = []

    def level(self, n: int) -> int:
        """The level to which n ids go, 0 for a new window; of equal ones the fullest."""
        change = self.coming[n:] + self.leaving[: self.size - n + 1]
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def _counted(self, level: int, step: int) -> None:
        self.count[level] += step
        n = int(self.count[level])
        self.leaving[level], self.coming[level] = 1 - 2 * n if n else _NEVER, 2 * n + 1

    def place(self, row: int, n: int) -> None:
        level = self.level(n)
        window = [(row, n)]
        if level:
            self._counted(level, -1)
            window = [*self.open[level].pop(), (row, n)]
        if level + n == self.size:
            self.close(window)
        else:
            self._counted(level + n, 1)
            self.open.setdefault(level + n, []).append(window)

    def close(self, window: list[tuple[int, int]]) -> None:
        offset = 0
        for row, n in window:
            self.out.append((row, self.next, offset))
            offset += n
        self.next += 1

    def settle(self) -> tuple[list[tuple[int, int, int]], list[int]]:
        """Close the fullest windows with room for no more than the others hold: (room, sequence, offset) of that; rows of the others."""
        windows = [(level, window) for level in sorted(self.open, reverse=True) for window in self.open[level]]
        rooms, room, left = [], 0, sum(level for level, _ in windows)
        while len(rooms) < len(windows):
            level, window = windows[len(rooms)]
            if room + self.size - level > left - level:
                break
            room, left = room + self.size - level, left - level
            rooms.append((self.size - level, self.next, level))
            self.close(window)
        self.open = {}
        return rooms, [row for _, window in windows[len(rooms) :] for row, _ in window]


def laid_out(sizes: list[int], size: int = SIZE, rooms: list[int] | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces of these sizes end to end, cut to ``rooms``, then into full windows and at last into powers of two: (piece, start, length) of each."""
    left, piece, at, rooms = sum(sizes), 0, 0, list(rooms or ())
    while left:
        room = rooms.pop(0) if rooms else size if left >= size else 1 << left.bit_length() - 1
        left -= room
        window = []
        while room:
            n = min(room, sizes[piece] - at)
            window.append((piece, at, n))
            room -= n
            piece, at = (piece + 1, 0) if at + n == sizes[piece] else (piece, at + n)
        yield window


class _Slots:
    """Numbers for the batches of a task, apart from those of other tasks."""

    def __init__(self) -> None:
        self.task, self.n = -1, 0

    def __next__(self) -> int:
        task = TaskContext.get().partitionId()
        if task != self.task:
            self.task, self.n = task, 0
        self.n += 1
        return (task << 16) + self.n


def pieces(df: DataFrame, id_col: str, text_col: str, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """Pieces of whole windows, placed, and of each document one rest without sequence but with its ids; ``slot`` is a piece's number."""
    end = np.array([end_id], "<u4").tobytes()

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        bpe = loaded(vocabulary)
        for row in range(0, batch.num_rows, 2000):
            made, rests = [], []
            part = batch.slice(row, 2000)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids = bpe.ids(text.as_py()) + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    made.append((doc, start, len(piece) // 4, zlib.crc32(piece), n))
                    rests.append(piece if len(piece) < 4 * size else None)
            slot = (next(slots) << 24) + np.arange(len(made))
            open_ = np.array([x is not None for x in rests], bool)
            columns = [pa.array(x, pa.int64()) for x in zip(*made, strict=True)]
            placed = [pa.array(4 * slot + 1, mask=open_), pa.array(np.zeros(len(made), np.int64), mask=open_)]
            yield dict(zip(_COLUMNS, [*columns, *placed], strict=True)) | {"slot": slot, "ids": pa.array(rests, pa.binary())}

    slots = _Slots()
    return C.in_arrow(C.texts(df, id_col, text_col), work, ", ".join(f"{x} long" for x in (*_COLUMNS, "slot")) + ", ids binary")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", size: int = SIZE, end_id: int = END, stream: int = STREAM) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    cut = C.durable(pieces(df, id_col, text_col, vocabulary, size, end_id))
    rest = cut.filter("sequence_id is null").drop("ids")
    streams = max(1, -(-rest.count() // stream))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, at = TaskContext.get().partitionId(), [], 0
        packer = Packer(task << 32, size)
        for batch in batches:
            rows.append(batch)
            for k, n in enumerate(batch.column(2).to_pylist(), at):
                packer.place(k, n)
            at += batch.num_rows
        if not at:
            return
        table = pa.Table.from_batches(rows)
        rooms, rest_rows = packer.settle()
        row, sequence, offset = (np.array(x, np.int64) for x in zip(*packer.out, strict=True)) if packer.out else [np.zeros(0, np.int64)] * 3
        open_ = np.array(rest_rows, np.int64)
        long = lambda x: pa.array(np.asarray(x, np.int64))
        nulls = lambda n: pa.nulls(n, pa.int64())
        # pieces of windows taken apart have no sequence yet; their offset is their turn
        closed = table.take(long(row)).drop(["sequence_id", "offset"]).append_column("sequence_id", long(4 * sequence)).append_column("offset", long(offset))
        later = table.take(long(open_)).drop(["sequence_id", "offset"]).append_column("sequence_id", nulls(len(open_))).append_column("offset", long(np.arange(len(open_))))
        # room of closed windows, as rows without a slot: (room, offset, sequence) as start, length and doc_tokens
        n, own = len(rooms), np.array(rooms, np.int64).reshape(-1, 3)
        free = pa.table([nulls(n), long(own[:, 0]), long(own[:, 2]), nulls(n), long(4 * own[:, 1]), nulls(n), long(np.arange(n) - n), nulls(n)], [*_COLUMNS, "slot"])
        for part in (closed, later, free):
            yield from part.append_column("stream", long(np.full(len(part), task))).select([*_COLUMNS, "slot", "stream"]).to_batches(max_chunksize=50_000)

    names = ", ".join(f"{x} long" for x in _COLUMNS)
    placed = C.durable(rest.repartition(streams, "slot").sortWithinPartitions("slot").mapInArrow(place, names + ", slot long, stream long"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["stream"] != held[-1]["stream"]:
                    yield _finished(held, size)
                    held = []
                held.append(row)
        if held:
            yield _finished(held, size)

    open_ = placed.filter("sequence_id is null")
    columns = ["doc_id", "start", "length", "doc_tokens", "stream", "offset"]
    left = open_.join(cut.select("slot", "ids"), "slot").select(*columns, "ids").unionByName(open_.filter("slot is null").select(*columns, F.lit(None).cast("binary").alias("ids")))
    dealt = left.repartition(min(streams, C.partitions(df)), "stream").sortWithinPartitions("stream", "offset")
    last = dealt.select("doc_id", "start", "length", "doc_tokens", "stream", "ids").mapInArrow(finish, names)
    whole = cut.filter("sequence_id is not null").select(*_COLUMNS)
    return whole.unionByName(placed.filter("sequence_id is not null").select(*_COLUMNS)).unionByName(last)


def _finished(rows: list[dict], size: int) -> pa.RecordBatch:
    """The pieces of one stream that are cut anew: first into the room of its closed windows."""
    out, rooms, rows = [], [r for r in rows if r["ids"] is None], [r for r in rows if r["ids"] is not None]
    for k, window in enumerate(laid_out([len(r["ids"]) // 4 for r in rows], size, [r["start"] for r in rooms])):
        if k < len(rooms):
            offset, sequence = rooms[k]["length"], rooms[k]["doc_tokens"]
        else:
            offset, sequence = 0, 4 * ((rows[0]["stream"] << 32) + k) + 2
        for piece, at, n in window:
            r = rows[piece]
            out.append((r["doc_id"], r["start"] + at, n, zlib.crc32(r["ids"][4 * at : 4 * (at + n)]), r["doc_tokens"], sequence, offset))
            offset += n
    columns = zip(*out, strict=True) if out else [[]] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], _COLUMNS)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every whole text of ``documents``, windows of 2048 ids."""
    return pack(C.table(spark, sf_dir, "documents"))
