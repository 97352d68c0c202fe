"""Operator 12, benchmark decontamination: a broadcast hash set of normalised test n-grams, verified hits, spans or documents cut.

A-Z count as lower case; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, so digits, letters and everything beyond ASCII. A
window is WIDTH consecutive words of an item; an item of fewer words, but not none, is one window. The windows of all items
are hashed in tasks and written; a part of them of at most HELD_BYTES by that table's own sizes is sent to every task. There
each run of words of a document is looked up by its hash, and a hit counts only if its words equal those of the window, byte
for byte. A document's row is computed where the document lies, without a shuffle. A benchmark beyond HELD_BYTES is taken in
several such parts, each against all documents, and what they find is joined by document: no window is left out.

Null and empty texts have no words: such items have no window and such documents no hit. An item without an identifier is
named "null". Rows of one item identifier are one item. Documents that are repeated, or that share an identifier, are judged
by their own text and keep a row each. Empty tables give documents without hits, or no rows. Extra columns are not read, and
those of decontaminate() come along whatever their names. A text is always read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WIDTH = 10
#: Bytes of windows, with their hashes and items, that a task holds at once.
HELD_BYTES = 64 << 20
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_FILTER_BITS = 20
_FOUND = "id long, hash long, n_words long, n_hit long, spans array<struct<start:bigint,end:bigint>>, items array<string>"


class Tokens:
    """The normalised words of a chunk: places, hashes, and their bytes with one space after each."""

    def __init__(self, raw: np.ndarray, at: np.ndarray) -> None:
        self.low = C.lowered(raw)
        self.inside = _WORD[self.low]
        self.words = C.Words(self.low, at, self.inside)
        self.hashes = C.run_hashes(self.low, self.words.start, self.words.end)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes, each word followed by one space, and n + 1 offsets of the words."""
        size = self.words.end - self.words.start
        place = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(place[-1], 32, np.uint8)
        out[np.repeat(place[:-1] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = self.low[self.inside]
        return out, place

    def windows(self, width: int) -> np.ndarray:
        """First words of the runs of ``width`` words that lie in one document."""
        doc = self.words.doc
        return np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :]) if len(doc) >= width else np.zeros(0, np.int64)


def test_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(width, hash, words, items): each distinct window with the sorted names of the items that have it."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, _, raw, at in C.chunks(batch.column(1)):
            t = Tokens(raw, at)
            text, place = t.joined()
            count = np.diff(t.words.at)
            short = np.flatnonzero((count > 0) & (count < width))
            start = np.concatenate([t.windows(width), t.words.at[:-1][short]])
            n = np.concatenate([np.full(len(start) - len(short), width), count[short]])
            yield {
                "width": n.astype(np.int32),
                "hash": C.run_hashes(t.hashes, start, start + n).view(np.int64),
                "words": pa.array([text[place[a] : place[a + k] - 1].tobytes() for a, k in zip(start.tolist(), n.tolist(), strict=True)], pa.binary()),
                "item": batch.column(0).take(pa.array(row + t.words.doc[start])),
            }

    items = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = C.in_arrow(items, work, "width int, hash long, words binary, item string")
    return made.groupBy("width", "hash", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


class TestSet:
    """Some windows as sorted hashes, their words and items; what the tasks hold."""

    def __init__(self, rows: pa.Table) -> None:
        width, key = (np.asarray(rows.column(k).combine_chunks()) for k in (0, 1))
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        words, lists = rows.column(2).to_pylist(), rows.column(3).to_pylist()
        self.names = sorted({name for own in lists for name in own})
        number = {name: k for k, name in enumerate(self.names)}
        self.words = [np.frombuffer(w, np.uint8) for w in words]
        self.items = [np.array([number[name] for name in own]) for own in lists]
        for n in np.unique(width).tolist():
            own = np.flatnonzero(width == n)
            own = own[np.argsort(key[own].view(np.uint64), kind="stable")]
            sorted_ = key[own].view(np.uint64)
            some = np.zeros(1 << _FILTER_BITS, bool)
            some[(sorted_ >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.by_width[n] = sorted_, own, some

    def hits(self, t: Tokens) -> Iterator[tuple[int, int, np.ndarray]]:
        """(window, width, first words of its verified occurrences)."""
        text = place = None
        for n, (key, window, some) in self.by_width.items():
            start = t.windows(n)
            hashes = C.run_hashes(t.hashes, start, start + n)
            able = np.flatnonzero(some[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            start, hashes = start[able], hashes[able]
            at, end = np.searchsorted(key, hashes, "left"), np.searchsorted(key, hashes, "right")
            while (at < end).any():  # once but for windows that share a hash
                met = at < end
                start, at, end = start[met], at[met], end[met]
                if text is None:
                    text, place = t.joined()
                order = np.argsort(at, kind="stable")
                which, first = np.unique(at[order], return_index=True)
                for k, own in zip(which.tolist(), np.split(start[order], first[1:]), strict=True):
                    words = self.words[window[k]]
                    own = own[place[own + n] - 1 - place[own] == len(words)]
                    step = max(1, C.CHUNK_BYTES // max(len(words), 1))
                    same = [(text[place[part][:, None] + np.arange(len(words))] == words).all(1) for a in range(0, len(own), step) for part in [own[a : a + step]]]
                    own = own[np.concatenate(same)] if same else own
                    if len(own):
                        yield int(window[k]), n, own
                at = at + 1


def _scan(texts: DataFrame, held) -> DataFrame:
    """One row for each row of ``texts`` (id, text, hash) with what one part of the windows hits in it."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        tests: TestSet = held.value
        for row, end, raw, at in C.chunks(batch.column(1)):
            t = Tokens(raw, at)
            words, n = t.words, len(t.words.start)
            turns, pairs = np.zeros(n + 1, np.int64), [np.zeros((0, 2), np.int64)]
            for window, width, start in tests.hits(t):
                np.add.at(turns, start, 1)
                np.add.at(turns, start + width, -1)
                items = tests.items[window]
                docs = np.unique(words.doc[start])
                pairs.append(np.stack([np.repeat(docs, len(items)), np.tile(items, len(docs))], 1))
            hit = np.cumsum(turns[:-1]) > 0
            edge, doc = np.ones(n, bool), words.doc
            edge[1:] = (hit[1:] != hit[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(edge)
            last = np.concatenate([first[1:], [n]]) if n else first
            first, last = first[hit[first]], last[hit[first]]
            of = doc[first]
            met = np.unique(np.concatenate(pairs), axis=0)
            rows = end - row
            lists = lambda doc, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)), values)
            places = [pa.array(x - words.at[of]) for x in (first, last)]
            yield {
                "id": batch.column(0).slice(row, rows),
                "hash": batch.column(2).slice(row, rows),
                "n_words": np.diff(words.at).astype(np.int64),
                "n_hit": C.per_doc(hit, words.at),
                "spans": lists(of, pa.StructArray.from_arrays(places, ["start", "end"])),
                "items": lists(met[:, 0], pa.array([tests.names[k] for k in met[:, 1].tolist()], pa.string())),
            }

    return C.in_arrow(texts, work, _FOUND)


def _together(parts: list[DataFrame]) -> DataFrame:
    """What several parts of the windows hit, by document. Rows that repeat an identifier and a text stay that many."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    both = every.groupBy("id", "hash").agg(
        (F.count(F.lit(1)) / len(parts)).cast("int").alias("rows"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    kind = "array<struct<start:bigint,end:bigint>>"
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    last = lambda acc: F.element_at(acc, -1)

    def add(acc, x):
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(span(last(acc)["start"], F.greatest(last(acc)["end"], x["end"]))))
        return F.when((F.size(acc) > 0) & (x["start"] <= last(acc)["end"]), joined).otherwise(F.concat(acc, F.array(x))).cast(kind)

    spans = F.aggregate("all", F.array().cast(kind), add)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    merged = both.withColumn("spans", spans).withColumn("n_hit", n_hit)
    return merged.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select("id", "hash", "n_words", "n_hit", "spans", "items")


def leaks(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(id, hash of the text, n_words, n_hit, spans in words, items) of every row of ``df``."""
    texts = C.texts(df, id_col, text_col).select("id", "text", F.xxhash64("text").alias("hash"))
    windows = C.durable(test_windows(bench, item_col, item_text_col, width))
    size = windows.agg(F.sum(F.length("words") + 64 + F.aggregate("items", F.lit(0), lambda acc, x: acc + 16 + F.length(x)))).first()[0] or 0
    n = max(1, -(-int(size) // held_bytes))
    parts = []
    for k in range(n):  # one part but for a benchmark beyond the bound
        rows = windows.filter(F.pmod(F.xxhash64("hash"), F.lit(n)) == k) if n > 1 else windows
        parts.append(_scan(texts, df.sparkSession.sparkContext.broadcast(TestSet(rows.toArrow()))))
    C.discard(windows)
    return parts[0] if n == 1 else _together(parts)


def cut_hits(column: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text without the words of its spans and what lies between them and the next word."""
    out = []
    for row, end, raw, at in C.chunks(column):
        words = Tokens(raw, at).words
        keep = np.ones(len(raw), bool)
        for k, own in enumerate(spans.slice(row, end - row).to_pylist()):
            first, last = words.at[k], words.at[k + 1]
            for s in own or ():
                b = first + s["end"]
                keep[words.start[first + s["start"]] : words.start[b] if b < last else at[k + 1]] = False
        offsets = np.concatenate([[0], np.cumsum(C.per_doc(keep, at))])
        kind, size = (pa.large_string(), np.int64) if pa.types.is_large_string(column.type) else (pa.string(), np.int32)
        out.append(pa.Array.from_buffers(kind, end - row, [None, pa.py_buffer(offsets.astype(size).tobytes()), pa.py_buffer(raw[keep].tobytes())]))
    return pa.concat_arrays(out)


def decontaminate(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: str = "spans", **how) -> DataFrame:
    """``df`` without the test passages (``cut`` "spans") or without the documents that have any ("documents"); all columns stay.

    Only the identifiers, text hashes and spans of contaminated documents meet ``df``. Null texts stay null.
    """
    if cut not in ("spans", "documents"):
        raise ValueError("cut is spans or documents")
    key, hash_, spans = (C.distinct_name(df, x) for x in ("leak_id", "leak_hash", "leak_spans"))
    found = leaks(df, bench, id_col, text_col, **how).filter("n_hit > 0").groupBy(F.col("id").alias(key), F.col("hash").alias(hash_)).agg(F.first("spans").alias(spans))
    own = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(hash_))
    if cut == "documents":
        return df.join(found, own, "left_anti")
    names, at_text = df.columns, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                old, where = batch.column(at_text), batch.column(len(names))
                new = pa.compute.if_else(old.is_valid(), cut_hits(old.fill_null(""), where), pa.scalar(None, old.type))
                yield pa.RecordBatch.from_arrays([new if k == at_text else batch.column(k) for k in range(len(names))], names)

    return df.join(found, own, "left").select(*df.columns, spans).mapInArrow(run, df.schema)


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: windows of ten words of ``benchmark`` in every whole text of ``documents``."""
    found = leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
