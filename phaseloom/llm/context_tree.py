"""Operator 10, LM scoring by context-tree weighting.

A byte is eight binary decisions; each of the 255 places in that decision has its own tree of contexts, the DEPTH bytes
before it, nearest first. Every node estimates by Krichevsky-Trofimov from its counts; a node's weight is the posterior
share of its own estimate against that of its children, each split having prior one half, and the estimates of all depths
on a path are mixed by these weights. Where training never went, a path ends at its deepest known node. Texts are scored
in lower case with a zero byte as their end, which is coded too; the context before a text is zero bytes.

Counts of grams of DEPTH + 1 bytes come from all training documents. Trees are computed where they lie: shards of the three
nearest bytes hold whole subtrees. The nodes of two bytes of context are a written table that is dealt to the tasks whose
shards are below them; only the 256 contexts of one byte and the root, at most 65,535 nodes whatever the corpus, pass
through the driver. See grams.py for how texts meet the table.

Null and empty texts have one token, their end. A null identifier isn't held out. Repeated rows are counted and scored each.
Without training documents all decisions have probability one half. An empty table gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .grams import blocks, gram_runs, scored, single, totals, word_runs

DEPTH, SHARD = 5, 3
#: Tasks that the grams of one context of two bytes are dealt to.
SALT = 8
#: Grams worked on at once, in whole shards.
PART = 150_000
#: Keys of words have the top bit; the key of the end of a text is this one.
_WORD, _END = np.uint64(1 << 63), -1
_SMALL = np.array([math.lgamma(k / 2) if k else 0.0 for k in range(64)])


def held_out(ids: pa.Array) -> np.ndarray:
    """Whether a document isn't learned from: CRC-32 of its identifier as text is a multiple of 10."""
    return np.fromiter((i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in ids.to_pylist()), bool, len(ids))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of whole and half numbers above zero."""
    big = np.maximum(x, 16.0)
    series = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    return np.where(x < 16, _SMALL[np.minimum(2 * x, 63).astype(np.int64)], series)


def block_probability(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Level:
    """The nodes of one depth, sorted: key (context, then place in the byte), counts, and weights."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray | None) -> None:
        own = block_probability(n0, n1)
        self.keys, self.n0, self.n1 = keys, n0, n1
        self.chance = (n1 + 0.5) / (n0 + n1 + 1.0)
        if children is None:
            self.weight, self.mixed = np.ones(len(keys)), own
        else:
            self.weight = 1 / (1 + np.exp(np.clip(children - own, -700, 700)))
            self.mixed = np.logaddexp(own, children) - math.log(2)

    def parent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, counts and sums of log probabilities of the nodes one depth up."""
        keys, to = np.unique((self.keys >> 16) << 8 | self.keys & 255, return_inverse=True)
        return keys, *(np.bincount(to, x, len(keys)) for x in (self.n0, self.n1, self.mixed))


def nearest_first(keys: np.ndarray) -> np.ndarray:
    """Grams with their context bytes in the order from the nearest back; the last byte stays last."""
    out = np.zeros_like(keys)
    for k in range(DEPTH):
        out |= ((keys >> (8 * (k + 1))) & 255) << (8 * (DEPTH - k))
    return out | keys & 255


def places(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each gram its last byte's eight places and bits."""
    last = (grams & 255)[:, None]
    j = np.arange(8)[None, :]
    return (1 << j) | (last >> (8 - j)), (last >> (7 - j)) & 1


def lower_levels(grams: np.ndarray, n: np.ndarray) -> list[Level]:
    """Depths DEPTH down to SHARD from grams, nearest first, and counts above zero."""
    place, bit = places(grams)
    keys, to = np.unique(((grams >> 8)[:, None] << 8 | place).ravel(), return_inverse=True)
    weight = np.repeat(n, 8)
    ones = np.bincount(to, weight * bit.ravel(), len(keys))
    levels = [Level(keys, np.bincount(to, weight, len(keys)) - ones, ones, None)]
    while len(levels) <= DEPTH - SHARD:
        levels.append(Level(*levels[-1].parent()))
    return levels


def whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, grams nearest first, counts) of whole shards at a time, from rows sorted by shard."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def joined() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*kept, strict=True))

    for batch in batches:
        keys = np.asarray(batch.column(0))
        kept.append((keys, nearest_first(keys), np.asarray(batch.column(1))))
        size += len(keys)
        if size >= PART:
            keys, near, n = joined()
            shard = near >> 8 * (DEPTH + 1 - SHARD)
            cut = len(shard) - int(np.argmax(shard[::-1] != shard[-1])) if shard[0] != shard[-1] else 0
            if cut:
                yield keys[:cut], near[:cut], n[:cut]
            kept, size = [(keys[cut:], near[cut:], n[cut:])], len(keys) - cut
    if size:
        yield joined()


def _upper_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, near, n in whole_shards(batches):
        if (n > 0).any():
            made = lower_levels(near[n > 0], n[n > 0])[-1].parent()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["key", "n0", "n1", "below"])


def mix(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the probability of each gram's last byte; levels: DEPTH first."""
    place, bit = places(grams)
    mixed = np.full(place.shape, np.nan)
    for up, level in enumerate(levels):
        if not len(level.keys):
            continue
        key = (grams >> 8 * (up + 1))[:, None] << 8 | place
        at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
        there = level.keys[at] == key
        chance = np.where(bit == 1, level.chance[at], 1 - level.chance[at])
        blend = np.where(np.isnan(mixed), chance, level.weight[at] * chance + (1 - level.weight[at]) * mixed)
        mixed = np.where(there, blend, mixed)
    return np.log10(np.where(np.isnan(mixed), 0.5, mixed)).sum(1)


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Level, np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes of two bytes of context, grams, grams nearest first, counts) from rows sorted by context, nodes first.

    The grams of one context come in one part or several, in whole shards.
    """
    context, nodes = -1, []
    level = Level(*(np.zeros(0, x) for x in (np.int64, float, float, float)))

    def grams(rows: Iterator[pa.RecordBatch]):
        return whole_shards(rows)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        contexts, is_node = np.asarray(batch.column(0)), np.asarray(batch.column(1).is_valid())
        edges = np.flatnonzero(np.concatenate([[True], (contexts[1:] != contexts[:-1]) | (is_node[1:] != is_node[:-1]), [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if contexts[a] != context:
                for x in grams(iter(held)):
                    yield level, *x
                context, nodes, held, size = contexts[a], [], [], 0
                level = Level(*(np.zeros(0, x) for x in (np.int64, float, float, float)))
            if is_node[a]:
                nodes.append([np.asarray(part.column(k)) for k in (4, 1, 5, 6)])
                level = Level(*(np.concatenate(x) for x in zip(*nodes, strict=True)))
                continue
            held.append(pa.RecordBatch.from_arrays([part.column(2), part.column(3)], ["key", "n"]))
            size += b - a
            if size > 4 * PART:  # a crowded context: whole shards of it now, the last one with what follows
                *done, (keys, _, n) = grams(iter(held))
                for x in done:
                    yield level, *x
                held = [pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])]
                size = len(keys)
    for x in grams(iter(held)):
        yield level, *x


def gram_values(counts: DataFrame) -> DataFrame:
    """(key, value): log10 probability of the last byte of every gram in ``counts`` (key, n), seen in training or not."""
    near = lambda k: F.shiftright("key", 8 * (k + 1)).bitwiseAND(255)  # noqa: E731  the byte k before the last but one
    placed = counts.select("key", "n", (near(0) * 256 + near(1)).alias("context"), near(2).alias("third"))
    dealt = placed.repartition(C.partitions(counts), "context", "third").sortWithinPartitions("context", "third").select("key", "n")
    nodes = dealt.mapInArrow(_upper_rows, "key long, n0 double, n1 double, below double").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"))
    nodes = C.durable(nodes)

    def parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = Level(*(np.asarray(batch.column(k)) for k in range(4))).parent()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["key", "n0", "n1", "below"])

    first = nodes.mapInArrow(parents, "key long, n0 double, n1 double, below double").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"))
    rows = first.orderBy("key").toArrow()  # at most 256 contexts by 255 places
    tops = [Level(*(np.asarray(rows.column(k)) for k in range(4)))]
    tops.append(Level(*tops[-1].parent()))
    # a context's grams are dealt to SALT tasks by their third byte, and its nodes to each of these
    salt = F.pmod("third", F.lit(SALT)).alias("salt")
    void = lambda kind, name: F.lit(None).cast(kind).alias(name)
    grams = placed.select("context", void("double", "n0"), "key", "n", void("long", "node"), void("double", "n1"), void("double", "below"), salt, "third")
    known = nodes.select(F.shiftright("key", 8).alias("context"), "n0", void("long", "key"), void("long", "n"), F.col("key").alias("node"), "n1", "below", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")).alias("salt"), F.lit(-1).cast("long").alias("third"))
    both = known.unionByName(grams).repartition(C.partitions(counts), "context", "salt").sortWithinPartitions("context", "third", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for level, keys, near_, n in _shared_rows(batches):
            low = lower_levels(near_[n > 0], n[n > 0])
            value = np.concatenate([mix(near_[k : k + 50_000], [*low, level, *tops]) for k in range(0, len(near_), 50_000)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(value)], ["key", "value"])

    return both.drop("salt", "third").mapInArrow(run, "key long, value double")


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of words: 63 bits of a hash; none is that of the end."""
    keys = (hashes | _WORD).view(np.int64)
    return np.where(keys == _END, _END - 1, keys)


def _sums(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return total[to[1:]] - total[to[:-1]]


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and code length in bits for each byte."""

    def grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        learn = ~held_out(batch.column(0))
        keys, counts = [np.array([_END])], [np.array([learn.sum()])]
        for row, end, found, ids, to in gram_runs(batch.column(1), DEPTH, C.lowered):
            keys.append(found)
            counts.append(np.bincount(ids, np.repeat(learn[row:end], np.diff(to)), len(found)).astype(np.int64))
        for row, end, words, to in word_runs(batch.column(1), C.lowered):
            types, which = np.unique(word_keys(words), return_inverse=True)
            keys.append(types)
            counts.append(np.bincount(which, np.repeat(learn[row:end], np.diff(to)), len(types)).astype(np.int64))
        all_keys, to = np.unique(np.concatenate(keys), return_inverse=True)
        return all_keys, np.bincount(to, np.concatenate(counts), len(all_keys)).astype(np.int64)

    stored = blocks(C.texts(df, id_col, text_col), grams)
    counts = C.durable(totals(stored))
    words = counts.filter("key < 0")
    tokens, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    answers = gram_values(counts.filter("key >= 0")).withColumn("value", single(F.col("value"))).unionByName(words.select("key", F.col("n").cast("double").alias("value")))

    def score(batch: pa.RecordBatch, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        ask = lambda k: values[np.searchsorted(keys, k)]  # noqa: E731  every key of a block is answered
        cost = lambda n: np.log10((n + 0.1) / (tokens + 0.1 * (types + 1)))
        rows = batch.num_rows
        model, size, n_words, known, base = (np.zeros(rows, x) for x in (float, np.int64, np.int64, np.int64, float))
        for row, end, own, ids, to in gram_runs(batch.column(1), DEPTH, C.lowered):
            model[row:end] += _sums(ask(own)[ids], to)
            size[row:end] += np.diff(to)
        for row, end, words, to in word_runs(batch.column(1), C.lowered):
            types_here, which = np.unique(word_keys(words), return_inverse=True)
            n = ask(types_here)
            n_words[row:end] += np.diff(to)
            known[row:end] += _sums((n > 0)[which], to).astype(np.int64)
            base[row:end] += _sums(cost(n)[which], to)
        stop = ask(np.array([_END]))
        columns = (held_out(batch.column(0)), n_words + 1, known + (stop > 0), np.full(rows, tokens, np.int64), base + cost(stop), model, -model / size * math.log2(10))
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return scored(stored, answers, score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every whole text of ``documents``."""
    return score_documents(C.table(spark, sf_dir, "documents"))
