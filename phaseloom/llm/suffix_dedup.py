"""Operator 2, suffix-array dedup with sparse suffix arrays.

Words are ``[^\\x20\\x09-\\x0D]+``, compared byte for byte. Of each document only the suffixes at minimisers are retained:
in every run of WINDOW starts the one whose SEED words have the least hash. Any passage of SEED + WINDOW - 1 = 50 words
therefore retains the same suffix wherever it occurs. The suffixes are sorted by their first SEED words (in hash order,
which keeps equal ones together as any order does), and those with equal ones by the words that follow and, once more, by
those that come before. On each side a suffix so meets the earlier one with most words in common, and the match is extended
by these, up to WINDOW - 1 words; what lies further is covered by the next retained suffix. The first occurrence in
(document, position) order has no earlier neighbour and stays. Words are compared by hashes: of 64 bits in the seed, of 24
bits on the sides, so of 16.7 million borders one is drawn a word too far.

So every repeat of 50 words or more is found whatever its number of copies, and a repeat of SEED to 49 words if its suffix
was retained. A suffix meets the first of each context, not all copies. Within some megabytes of text suffixes are matched at
once and only the first of each seed and context is shuffled, so the inner suffixes of a passage in a third of all
documents send one row for these. At the edges of such a passage every document has other words beside it, and its seed
would fill one task. A sample of documents finds the seeds with more rows than an average partition. Their suffixes are
dealt by seed, side and the next d words, one row for each d, to the groups of which they are the first within that text;
any but the first of a group has an earlier suffix with d words more. So a group has one row for each LOCAL_BYTES of text,
or Arrow batch if smaller, of which a task holds the first, and the spans are the same.

Null and empty texts and texts under 50 words have no spans. A document is an identifier with a text, of which 31 bits of a
hash go with it: rows that share an identifier but not the text are different documents, and so are texts without an
identifier, which come last. Rows that share both are one document, with spans for what others have before. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SEED, WINDOW = 40, 11
_SIDE = WINDOW - 1
#: Text whose suffixes are matched before the shuffle.
LOCAL_BYTES = 8 << 20
#: One document in this many is looked at for crowded seeds; it changes no result.
SAMPLED = 32
#: Bits of a position; those above are of the text's hash, so that one column tells both.
_BITS = 32
_LAST_ID = np.iinfo(np.int64).max


def retained(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's retained suffixes: document, position in words, seed hash, and 24-bit hashes of the words around it.

    Those are of the words before the seed, nearest first, then of those after it; zero stands for no word.
    """
    words = C.Words(raw, at)
    n = len(words.start)
    hashes = C.run_hashes(raw, words.start, words.end)
    end = words.at[1:][words.doc] if n else np.zeros(0, np.int64)
    start = np.flatnonzero(np.arange(n) + SEED <= end)
    seeds = np.zeros(n, np.uint64)
    seeds[start] = C.run_hashes(hashes, start, start + SEED)
    low = np.uint64((1 << max(22, n.bit_length())) - 1)
    order = np.full(n + WINDOW, ~np.uint64(0), np.uint64)
    order[start] = (seeds[start] & ~low) | start.astype(np.uint64)
    least = np.minimum(order[:-1], order[1:])
    least = np.minimum(least[:-2], least[2:])
    least = np.minimum(least[:-4], least[4:])
    least = np.minimum(least[: n + 1], least[WINDOW - 8 :][: n + 1])
    whole = np.flatnonzero(np.arange(n) + SEED + WINDOW - 1 <= end)
    chosen = np.zeros(n + 1, bool)
    chosen[(least[whole] & low).astype(np.int64)] = True
    pick = np.flatnonzero(chosen)
    doc = words.doc[pick]
    around = pick[:, None] + np.concatenate([-np.arange(1, _SIDE + 1), np.arange(SEED, SEED + _SIDE)])
    inside = (around >= words.at[:-1][doc][:, None]) & (around < words.at[1:][doc][:, None])
    near = np.zeros(around.shape, np.uint32)
    near[inside] = (hashes[around[inside]] % np.uint64(0xFFFFFF) + np.uint64(1)).astype(np.uint32)
    return doc, pick - words.at[:-1][doc], seeds[pick], near


def matched(seeds: np.ndarray, ids: np.ndarray, pos: np.ndarray, near: np.ndarray, old: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes sorted by (seed, id, pos): (id, start, end, id of an earlier one) of their longest matches; which to keep.

    On each side those with a seed and its next d words in common are one group, and any but the first of it has an earlier
    suffix with d words more. So each side gets the longest match to any earlier suffix. To be kept are the first of any
    group; no other adds a match for those to come. The first ``old`` suffixes have their spans already.
    """
    keep, new = np.ones(len(seeds), bool), np.ones(len(seeds), bool)
    new[1:] = seeds[1:] != seeds[:-1]
    run = np.cumsum(new) - 1
    rows = np.flatnonzero(np.bincount(run)[run] > 1) if len(seeds) else run
    lead = np.flatnonzero(new)[run]
    keep[rows] = new[rows]
    spans, best = [], []

    def own(a: np.ndarray, b: np.ndarray, left: int, right: int) -> None:
        """An overlap with itself: the earlier occurrence stays whole."""
        start = np.maximum(pos[a] - left, pos[b] + SEED + right)
        spans.append(np.stack([ids[a], start, pos[a] + SEED + right, ids[b]], 1)[(pos[a] + SEED + right > start) & (a >= old)])

    text = pos >> _BITS
    same_doc = lambda a, b: (ids[a] == ids[b]) & (text[a] == text[b])
    later = rows[~new[rows]]
    foreign = later[~same_doc(later, lead[later])]
    self_ = later[same_doc(later, lead[later])]
    own(self_, lead[self_], 0, 0)
    for side in (0, 1):
        depth, at, key = np.zeros(len(seeds), np.int64), rows, seeds[rows].view(np.uint64)
        for d in range(1, _SIDE + 1):
            word = near[at, side * _SIDE + d - 1].astype(np.uint64)
            at, key = at[word != 0], C.mixed(key + word * np.uint64(0x9E3779B97F4A7C15))[word != 0]
            if not len(at):
                break
            _, first, group, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            head = at[first[group]]
            keep[at[head == at]] = True
            other = head != at
            a, b = at[other], head[other]
            same = same_doc(a, b)
            own(a[same], b[same], d * (side == 0), d * (side == 1))
            depth[a[~same]] = d
            at, key = at[n[group] > 1], key[n[group] > 1]
        best.append(depth)
    foreign = foreign[foreign >= old]
    spans.append(np.stack([ids[foreign], pos[foreign] - best[0][foreign], pos[foreign] + SEED + best[1][foreign], ids[lead[foreign]]], 1))
    return merged(np.concatenate(spans)), keep


def levels(seeds: np.ndarray, ids: np.ndarray, pos: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of suffixes sorted by (seed, id, pos): (key, id, pos, side and depth) for each group of which one is the first.

    A group has a seed and the next d words of one side in common; the groups of depth zero count as of the first side.
    """
    made = []
    for side in (0, 1):
        at, key = np.arange(len(seeds)), seeds.view(np.uint64)
        for d in range(side, _SIDE + 1):
            if d:
                word = near[at, side * _SIDE + d - 1].astype(np.uint64)
                at, key = at[word != 0], C.mixed(key + word * np.uint64(0x9E3779B97F4A7C15))[word != 0]
            code = side * (_SIDE + 1) + d
            group, first = np.unique(key, return_index=True)
            made.append((C.mixed(group + np.uint64(code + 1)), at[first], np.full(len(first), code)))
    key, at, code = (np.concatenate(x) for x in zip(*made, strict=True))
    return key, ids[at], pos[at], code


def met(key: np.ndarray, ids: np.ndarray, pos: np.ndarray, code: np.ndarray) -> np.ndarray:
    """(id, start, end, id of an earlier one) of all but the first of each group of levels(), sorted by (key, id, pos)."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    a, b = np.flatnonzero(~new), np.flatnonzero(new)[np.cumsum(new) - 1][~new]
    side, d = np.divmod(code[a], _SIDE + 1)
    start, end = pos[a] - d * (side == 0), pos[a] + SEED + d * (side == 1)
    # an overlap with itself: the earlier occurrence stays whole
    same = (ids[a] == ids[b]) & (pos[a] >> _BITS == pos[b] >> _BITS)
    start = np.where(same, np.maximum(start, pos[b] + SEED + d * (side == 1)), start)
    return np.stack([ids[a], start, end, ids[b]], 1)[start < end]


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans of a document as one, with the source of the first."""
    if not len(spans):
        return spans.reshape(0, 4)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    new = np.ones(len(spans), bool)
    new[1:] = (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] >> _BITS != spans[:-1, 1] >> _BITS)
    reach = spans[:, 2] & ((1 << _BITS) - 1)
    group = np.cumsum(new) - 1
    lift = group * (reach.max() + 1)  # so that one running maximum does for all documents
    reach = (np.maximum.accumulate(reach + lift) - lift) | spans[:, 2] >> _BITS << _BITS
    new[1:] |= spans[1:, 1] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], spans[first, 1], np.maximum.reduceat(spans[:, 2], first), spans[first, 3]], 1)


def _rows(suffixes: tuple[np.ndarray, ...], crowded: tuple[np.ndarray, ...], spans: np.ndarray) -> pa.RecordBatch:
    """Suffixes, rows of levels() and finished spans under one schema.

    A suffix has the words around it, a row of levels() its side and depth as source, a span an end and a mark that spreads it.
    """
    seeds, ids, pos, near = suffixes
    n, k, m = len(seeds), len(crowded[0]), len(spans)
    row = np.arange(n + k + m)
    column = lambda *x: pa.array(np.concatenate(x))
    return pa.RecordBatch.from_arrays(
        [
            column(seeds.view(np.int64), crowded[0].view(np.int64), C.mixed(spans[:, 0].astype(np.uint64)).view(np.int64)),
            column(ids, crowded[1], spans[:, 0]),
            column(pos, crowded[2], spans[:, 1]),
            pa.array(np.concatenate([np.zeros(n + k, np.int64), spans[:, 2]]), mask=row < n + k),
            pa.array(np.concatenate([np.zeros(n, np.int64), crowded[3], spans[:, 3]]), mask=row < n),
            pa.concat_arrays([C.binary_rows(near.view(np.uint8).reshape(n, 2 * _SIDE, 4)[:, :, :3].reshape(n, 6 * _SIDE)), pa.nulls(k + m, pa.binary())]),
        ],
        ["mark", "id", "pos", "stop", "source", "near"],
    )


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """Of each LOCAL_BYTES of text the first suffixes of each seed and context, sorted, and the spans found."""
    ids, texts = np.asarray(batch.column(0)), np.asarray(batch.column(2)) << _BITS
    for row, end, _, _ in C.chunks(batch.column(1), LOCAL_BYTES) if batch.num_rows else ():
        parts = [(ids[row + a : row + b][doc], pos | texts[row + a : row + b][doc], seeds, near) for a, b, raw, at in C.chunks(batch.column(1).slice(row, end - row)) for doc, pos, seeds, near in [retained(raw, at)]]
        own, pos, seeds, near = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, own, seeds))
        own, pos, seeds, near = own[order], pos[order], seeds[order], near[order]
        spans, keep = matched(seeds, own, pos, near)
        yield (seeds[keep], own[keep], pos[keep], near[keep]), spans


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match the sorted suffixes, also across batches; pass finished spans on."""
    last = head = None
    for batch in batches:
        done, whole = np.asarray(batch.column(3).is_valid()), np.asarray(batch.column(5).is_valid())
        marks, ids, pos = (np.asarray(batch.column(k)) for k in range(3))
        source = np.asarray(batch.column(4).fill_null(0))
        spans = [np.stack([ids[done], pos[done], np.asarray(batch.column(3).drop_null()), source[done]], 1)]
        crowded = ~done & ~whole
        if crowded.any():
            rows = tuple(x[crowded] for x in (marks, ids, pos, source))
            rows = rows if head is None else tuple(np.concatenate(x) for x in zip(head, rows, strict=True))
            spans.append(met(*rows))
            first = np.flatnonzero(rows[0] == rows[0][-1])[:1]
            head = tuple(x[first] for x in rows)
        if whole.any():
            three = np.frombuffer(b"".join(batch.column(5).drop_null().to_pylist()), np.uint8).reshape(-1, 2 * _SIDE, 3)
            near = np.zeros((len(three), 2 * _SIDE, 4), np.uint8)
            near[:, :, :3] = three
            near = near.reshape(len(three), 8 * _SIDE).view(np.uint32)
            now = marks[whole], ids[whole], pos[whole], near
            old = 0 if last is None else len(last[0])
            now = now if last is None else tuple(np.concatenate(x) for x in zip(last, now, strict=True))
            made, keep = matched(*now, old)
            spans.append(made)
            keep &= now[0] == now[0][-1]
            last = tuple(x[keep] for x in now)
        found = merged(np.concatenate(spans))
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(4)], ["id", "start", "end", "source"])


def crowded_seeds(texts: DataFrame) -> np.ndarray:
    """Seeds that a sample of documents finds in more rows than an average partition has: fewer than there are partitions."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (seeds, *_), _ in _kept(batch):
                key, n = np.unique(seeds.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["mark", "n"])

    sample = texts.filter(F.pmod(F.xxhash64("id", "hash"), F.lit(SAMPLED)) == 0)
    counted = C.durable(sample.mapInArrow(count, "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    marks = counted.filter(F.col("n") > total / C.partitions(texts)).select("mark").toArrow()
    C.discard(counted)
    return np.sort(np.asarray(marks.column(0)).astype(np.int64))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND((1 << 31) - 1)


def _document_spans(df: DataFrame, id_col: str, text_col: str, crowded: np.ndarray | None = None) -> DataFrame:
    """(id, text_hash, start, end, source): passages that an earlier document has too; a null identifier as the largest.

    ``crowded``: the seeds to deal by the words beside them, sorted; by default those of crowded_seeds().
    """
    texts = C.texts(df, id_col, text_col).select(F.coalesce("id", F.lit(int(_LAST_ID))).alias("id"), "text", _text_hash(F.col("text")).alias("hash"))
    crowded = crowded_seeds(texts) if crowded is None else crowded

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for suffixes, spans in _kept(batch):
                own = np.isin(suffixes[0].view(np.int64), crowded)
                yield _rows(tuple(x[~own] for x in suffixes), levels(*(x[own] for x in suffixes)), spans)

    suffixes = texts.mapInArrow(local, "mark long, id long, pos long, stop long, source long, near binary")
    sorted_ = suffixes.repartition(C.partitions(df), "mark").sortWithinPartitions("mark", "id", "pos")
    spans = sorted_.mapInArrow(_neighbours, "id long, start long, end long, source long")
    place = lambda c: F.col(c).bitwiseAND((1 << _BITS) - 1).alias(c)
    spans = spans.select("id", F.shiftright("start", _BITS).alias("text_hash"), place("start"), place("end"), "source")
    before = Window.partitionBy("id", "text_hash").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("id", "text_hash", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "source")).alias("from"))
    return whole.filter(F.col("end") - F.col("start") >= SEED).select("id", "text_hash", "start", "end", F.col("from.source").alias("source"))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, source_id): stretches of words each of which lies in SEED words that a smaller (identifier, text, position) has too.

    Overlapping matches make one stretch, so its ends may come from different documents; ``source_id`` has SEED words of it.
    """
    named = lambda c: F.nullif(F.col(c), F.lit(int(_LAST_ID)))
    return _document_spans(df, id_col, text_col).select(named("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), named("source").alias("source_id"))


def cut_words(column: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text without the words of its spans and the white space after them; spans: lists of (start, end), or null."""
    out = []
    for row, end, raw, at in C.chunks(column):
        words = C.Words(raw, at)
        keep = np.ones(len(raw), bool)
        for k, own in enumerate(spans.slice(row, end - row).to_pylist()):
            first, last = words.at[k], words.at[k + 1]
            for s in own or ():
                a, b = first + s["start_word"], first + s["end_word"]
                if a < last:
                    keep[words.start[a] : words.start[b] if b < last else at[k + 1]] = False
        offsets = np.concatenate([[0], np.cumsum(C.per_doc(keep, at))]).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.string(), end - row, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[keep].tobytes())]))
    return pa.concat_arrays(out)


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every repeated passage cut but its first occurrence; a document left without a word goes.

    All columns stay, whatever their names. Null texts stay null and empty texts empty.
    """
    key, text, cut = (C.distinct_name(df, x) for x in ("cut_id", "cut_text", "cut"))
    one = F.struct(F.col("start").alias("start_word"), F.col("end").alias("end_word"))
    lists = _document_spans(df, id_col, text_col).groupBy(F.col("id").alias(key), F.col("text_hash").alias(text)).agg(F.collect_list(one).alias(cut))
    own = (F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST_ID))) == F.col(key)) & (_text_hash(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(text))
    joined = df.join(lists, own, "left").select(*df.columns, cut)
    at_text, names = df.columns.index(text_col), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                spans, old = batch.column(len(names)), batch.column(at_text)
                new = cut_words(old.fill_null(""), spans)
                left = np.array([bool(x.strip()) for x in new.to_pylist()]) | ~np.asarray(spans.is_valid())
                new = pa.compute.if_else(old.is_valid(), new, pa.scalar(None, pa.string()))
                columns = [new if k == at_text else batch.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(left))

    return joined.mapInArrow(run, df.schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: repeated passages of every whole text of ``documents``."""
    return repeated_spans(C.table(spark, sf_dir, "documents"))
