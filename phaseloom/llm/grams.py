"""Scoring texts with models of byte n-grams whose tables are as large as the corpus makes them.

Documents are read once and stored in blocks of bounded size: the texts, compressed, and the distinct grams of the block,
dealt into shards. A block's grams ask the model's table by a join on the shard and the gram, wherever it lies; the answers
come back to the block, which stays where it was written, in a bucket, and each text is scored there against the answers of
its block alone. So a text is never joined
gram by gram, no table is broadcast, and what is shuffled is each block's distinct grams: sorted and as steps from each to
the next, little over a byte each, and the answers as one blob for each block and shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK_BYTES = 8 << 20
#: Bytes of text whose grams are numbered at once; that takes about 150 bytes of memory for each.
GRAM_BYTES = 1 << 20
#: Most places of a table that numbers grams; it takes five bytes for each.
PLACES = 1 << 25
#: Grams of a shard's blocks that are combined at once.
COMBINED = 1 << 20
#: Of the compression of stored texts, which are written once and shuffled once.
TEXT_LEVEL = 9


def dense_grams(raw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct byte n-grams of ``raw``, big-endian in 64 bits, and for each start which of them it is.

    No sort, unless a table of all grams with one more letter would exceed PLACES.
    """
    seen = np.bincount(raw, minlength=256) > 0
    letters = np.flatnonzero(seen)
    number = (np.cumsum(seen) - 1).astype(np.int32)
    single = number[raw]
    keys, ids = letters.astype(np.int64), single
    for k in range(1, width):
        joint = np.multiply(ids[: len(raw) - k], len(letters), dtype=np.int64) + single[k:]
        if len(keys) * len(letters) > PLACES:
            found, ids = np.unique(joint, return_inverse=True)
            ids = ids.astype(np.int32)
        else:
            there = np.zeros(len(keys) * len(letters), bool)
            there[joint] = True
            found = np.flatnonzero(there)
            place = np.empty(len(there), np.int32)
            place[found] = np.arange(len(found), dtype=np.int32)
            ids = place[joint]
        keys = (keys[found // len(letters)] << 8) | letters[found % len(letters)]
    return keys, ids


def padded(raw: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents end to end with ``order`` zero bytes before and one after each; offsets of the starts of their grams.

    Document k has the grams that start at offsets[k] up to offsets[k + 1] - order, one for each byte and one for its end.
    """
    n = len(at) - 1
    out = np.zeros(len(raw) + n * (order + 1), np.uint8)
    shift = np.repeat(np.arange(n) * (order + 1) + order, np.diff(at))
    out[np.arange(len(raw)) + shift] = raw
    return out, at + np.arange(n + 1) * (order + 1)


def gram_places(offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all grams of padded documents, and n + 1 offsets of the documents into these."""
    sizes = np.diff(offsets) - order
    to = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(to[-1]) + np.repeat(offsets[:-1] - to[:-1], sizes), to


def _long_run(raw: np.ndarray, start: int, end: int, order: int) -> np.ndarray:
    """The bytes of grams start to end of a padded document, of which only these are copied."""
    out = np.zeros(end - start + order, np.uint8)
    low, high = max(start - order, 0), min(end, len(raw))
    out[low + order - start : high + order - start] = raw[low:high]
    return out


def gram_runs(column: pa.Array, order: int, change: Callable[[np.ndarray], np.ndarray] = lambda raw: raw) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct keys, which of them each place has, the documents' offsets into the places).

    Grams have ``order`` bytes of context. A document over GRAM_BYTES comes in several runs of its places, one after another.
    """
    for row, end, raw, at in C.chunks(column, GRAM_BYTES):
        if len(raw) <= GRAM_BYTES:
            text, offsets = padded(change(raw), at, order)
            keys, ids = dense_grams(text, order + 1)
            places, to = gram_places(offsets, order)
            ids = ids[places]
            there = np.bincount(ids, minlength=len(keys)) > 0  # not those across documents
            yield row, end, keys[there], (np.cumsum(there) - 1)[ids], to
            continue
        for start in range(0, len(raw) + 1, GRAM_BYTES):
            stop = min(start + GRAM_BYTES, len(raw) + 1)
            keys, ids = dense_grams(change(_long_run(raw, start, stop, order)), order + 1)
            yield row, end, keys, ids, np.array([0, stop - start])


def word_runs(column: pa.Array, change: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of words, the documents' offsets into them); a long document comes in several runs."""
    for row, end, raw, at in C.chunks(column, GRAM_BYTES):
        start = 0
        while True:
            stop = len(raw)
            if stop - start > GRAM_BYTES:  # cut at white space, or after a word that is longer
                space = np.flatnonzero(C.SPACE[raw[start : start + GRAM_BYTES]])
                cut = start + space[-1] + 1 if len(space) else start + GRAM_BYTES
                while not len(space) and cut < len(raw):
                    space = np.flatnonzero(C.SPACE[raw[cut : cut + GRAM_BYTES]])
                    cut += space[0] if len(space) else GRAM_BYTES
                stop = min(cut, len(raw))
            part = change(raw[start:stop])
            words = C.Words(part, at if stop - start == len(raw) else np.array([0, stop - start]))
            yield row, end, C.run_hashes(part, words.start, words.end), words.at
            start = stop
            if start >= len(raw):
                break


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", TEXT_LEVEL))) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.RecordBatch:
    """The documents of a block."""
    return pa.ipc.open_stream(blob).read_next_batch()


def to_blob(x: np.ndarray) -> bytes:
    """Values of 64 bits, compressed with all first bytes together, then all second bytes, and so on; of none: no bytes."""
    if not len(x):
        return b""
    rows = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)
    return len(x).to_bytes(8, "little") + pa.Codec("zstd").compress(np.ascontiguousarray(rows.T).tobytes(), asbytes=True)


def from_blob(blob: bytes, kind: type) -> np.ndarray:
    """What to_blob() was given."""
    if not blob:
        return np.zeros(0, kind)
    n = int.from_bytes(blob[:8], "little")
    columns = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(columns.T).view(kind).ravel()


def sorted_to_blob(keys: np.ndarray) -> bytes:
    """Sorted keys as steps from each to the next, which compress to a byte or two."""
    return to_blob(np.diff(keys, prepend=np.int64(0)))


def sorted_from_blob(blob: bytes) -> np.ndarray:
    """What sorted_to_blob() was given."""
    return np.cumsum(from_blob(blob, np.int64), dtype=np.int64)


#: Grams that differ in their last two bytes share a shard, so the steps between them stay small.
_FOLDS = (16, 29, 43, 57)


def _parts(keys: np.ndarray, n: int) -> np.ndarray:
    own = np.zeros(len(keys), np.uint64)
    for k in _FOLDS:
        own = own ^ (keys.view(np.uint64) >> np.uint64(k))
    return np.mod(own.view(np.int64), n)


def part_of(key: Column, n: int) -> Column:
    """The shard of a gram among n, as _parts() has it."""
    own = F.lit(0).cast("long")
    for k in _FOLDS:
        own = own.bitwiseXOR(F.shiftrightunsigned(key, k))
    return F.pmod(own, F.lit(n).cast("long")).cast("int")


def blocks(docs: DataFrame, grams: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(block, docs, keys, counts) stored for ``docs``, whose second column is the text; ``grams`` gives distinct keys and counts.

    keys and counts are arrays with one blob for each shard of grams; the session's number of shuffle partitions is theirs.
    """
    n = C.partitions(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, end, _, _ in C.chunks(batch.column(1), BLOCK_BYTES) if batch.num_rows else ():
                part = batch.slice(row, end - row)
                keys, counts = grams(part)
                shard = _parts(keys, n)
                order = np.lexsort((keys, shard))
                cut = np.searchsorted(shard[order], np.arange(1, n))
                key_blobs = [sorted_to_blob(x) for x in np.split(keys[order], cut)]
                count_blobs = [to_blob(x) for x in np.split(counts[order], cut)] if len(counts) else []
                blobs = pa.list_(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_packed(part)], pa.binary()), pa.array([key_blobs], blobs), pa.array([count_blobs], blobs)], ["block", "docs", "keys", "counts"])
                pa.default_memory_pool().release_unused()
                block += 1

    return C.bucketed(docs.mapInArrow(run, "block long, docs binary, keys array<binary>, counts array<binary>"), n, "block")


def _asked(stored: DataFrame) -> DataFrame:
    """(part, block, keys): what each block asks of each shard."""
    return stored.select("block", F.posexplode("keys").alias("part", "keys")).filter("length(keys) > 0").select("part", "block", "keys")


def _combined(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def totals(stored: DataFrame) -> DataFrame:
    """(key, n): each gram's count over all blocks; without counts 1 for each block.

    A shard's blocks are combined as they come, so a task holds the shard's distinct grams and some blocks, not all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = done = 0
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
                own = sorted_from_blob(keys.as_py())
                kept.append((own, from_blob(counts.as_py(), np.int64) if counts.as_py() else np.ones(len(own), np.int64)))
                size += len(own)
                if size > max(COMBINED, 2 * done):
                    kept = [_combined(kept)]
                    size = done = len(kept[0][0])
        keys, counts = _combined(kept)
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(counts[at : at + 100_000])], ["key", "n"])

    both = stored.select(F.posexplode(F.arrays_zip("keys", "counts")).alias("part", "g")).select("part", "g.keys", F.coalesce("g.counts", F.lit(b"")).alias("counts"))
    return both.filter("length(keys) > 0").groupBy("part").applyInArrow(run, "key long, n long")


def single(value: Column) -> Column:
    """A value rounded to seven digits, so that its blob is half as large."""
    return value.cast("float").cast("double")


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shard, answers before blocks: each block's answers. A task holds one shard's answers at a time."""
    part, known = None, ([], [])
    keys = values = np.zeros(0)
    for batch in batches:
        parts, blocks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        edges = np.flatnonzero(np.concatenate([[True], (parts[1:] != parts[:-1]) | ((blocks[1:] < 0) != (blocks[:-1] < 0)), [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if parts[a] != part:
                part, known = parts[a], ([], [])
            if blocks[a] < 0:
                known[0].append(np.asarray(batch.column(2).slice(a, b - a)))
                known[1].append(np.asarray(batch.column(3).slice(a, b - a)))
                continue
            if known[0]:
                keys, values = (np.concatenate(x) for x in known)
                known = ([], [])
            found = [to_blob(values[np.searchsorted(keys, sorted_from_blob(x.as_py()))]) for x in batch.column(4).slice(a, b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(0).slice(a, b - a), pa.array(found, pa.binary())], ["block", "part", "found"])


def scored(stored: DataFrame, answers: DataFrame, score: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Each block's documents scored with ``answers`` (key, value as double); ``score`` gets documents, sorted keys and values."""
    first = stored.select(F.size("keys").alias("n")).first()
    n = first.n if first else 1
    known = answers.select(part_of(F.col("key"), n).alias("part"), F.lit(-1).cast("long").alias("block"), "key", "value", F.lit(None).cast("binary").alias("keys"))
    asks = _asked(stored).select("part", "block", F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("value"), "keys")
    dealt = known.unionByName(asks).repartition(n, "part").sortWithinPartitions("part", "block", "key")
    told = dealt.mapInArrow(_answers, "block long, part int, found binary")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = dict(zip(right.column("part").to_pylist(), right.column("found").to_pylist(), strict=True))
        made = []
        for blob, own in zip(left.column("docs"), left.column("keys").to_pylist(), strict=True):
            keys = np.concatenate([sorted_from_blob(x) for x in own])
            values = np.concatenate([from_blob(found.get(k, b""), np.float64) for k in range(len(own))])
            order = np.argsort(keys)
            made.append(score(unpacked(blob.as_py()), keys[order], values[order]))
            pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(made)

    return stored.select("block", "docs", "keys").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)
