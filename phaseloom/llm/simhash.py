"""Operator 5, SimHash near-dedup by segment popcounts.

A fingerprint is cut into 16 segments of 4 bits and mapped to the vector of their bit counts. The Manhattan distance of
two such vectors is at most the Hamming distance of the fingerprints, so a range join on the grid of vectors misses no
link. For radius 2 it needs no pairs: each distinct fingerprint marks its own cell and the 32 cells one step away, and two
vectors within distance 2 mark a cell together. In a cell of up to CELL_PAIRS fingerprints their pairs are verified by the
Hamming distance. The fingerprints of fuller cells are verified in the same way as they were found, on whole fingerprints:
each marks itself and the 64 fingerprints one bit away, and two within 2 bits have a mark in common, while two with a mark
in common are within 2 bits. At most 65 fingerprints share a mark; each is linked to the smallest of them, which keeps
every component whole without listing pairs.

Equal fingerprints count once, so very large groups of copies cost nothing after the first aggregation.

near_duplicates() takes its links by the same steps, from both halves of a fingerprint, and checks them by their shingles.

Null and empty texts have no words and the fingerprint zero, which is linked like any other. Repeated rows get equal
results. A row without an identifier links nothing; it takes the component of the rows with its fingerprint, or none. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

SEED = 42
#: Cells with more marks than this are verified by marks of whole fingerprints, not by pairs.
CELL_PAIRS = 64
#: Buckets in which near_duplicates() counts how rare shingles are; the order changes its cost only.
RARITY_BITS, COMMON_FROM = 20, 64
#: Hashes whose bits are counted at once.
MAJORITY_HASHES = 1 << 15


def shingle_hashes(raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each document's word n-grams (of fewer words: the whole sequence), and n + 1 offsets of the documents."""
    words, counts = [], []
    low = C.lowered(raw).tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = low[a:b].split()
        words += own
        counts.append(len(own))
    counts = np.array(counts, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(words) else ends
    first = np.cumsum(counts) - counts
    made = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    head = np.repeat(first - offsets[:-1], made) + np.arange(offsets[-1])
    tail = head + np.repeat(np.minimum(counts, n), made) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[head].tolist(), ends[tail].tolist(), strict=True)), np.uint64, len(head))
    return hashes, offsets


def word_shingles(raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_hashes(), by the library's own hash of runs, for all words of the chunk at once."""
    low = C.lowered(raw)
    words = C.Words(low, at)
    counts = np.diff(words.at)
    made = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    head = np.repeat(words.at[:-1] - offsets[:-1], made) + np.arange(offsets[-1])
    return C.run_hashes(C.run_hashes(low, words.start, words.end), head, head + np.repeat(np.minimum(counts, n), made)), offsets


def majorities(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document the 64 bits that are set in over half its hashes; none: zero.

    Runs of documents are taken of up to MAJORITY_HASHES hashes, or one longer document: the bits of a hash fill 320 bytes.
    """
    out = np.zeros(len(offsets) - 1, np.uint64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    row = 0
    while row < len(full):
        begin = offsets[full[row]]
        end = max(row + 1, int(np.searchsorted(offsets[full + 1], begin + MAJORITY_HASHES, "right")))
        own = full[row:end]
        bits = np.unpackbits(hashes[begin : offsets[own[-1] + 1]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, offsets[own] - begin, axis=0, dtype=np.int32)
        out[own] = np.packbits(2 * sums > np.diff(offsets)[own, None], axis=1, bitorder="little").view("<u8").ravel()
        row = end
    return out


def cells(fingerprints: np.ndarray) -> np.ndarray:
    """The bit counts of the 16 segments, each plus one, in four bits each: a step in one segment never carries."""
    x = fingerprints
    x = (x & np.uint64(0x5555555555555555)) + ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
    return x + np.uint64(0x1111111111111111)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, cell) for each row. No shuffle."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, end, raw, at in C.chunks(batch.column(1)):
            fp = majorities(*shingle_hashes(raw, at, shingle))
            yield {"id": batch.column(0).slice(row, end - row), "fp": fp.view(np.int64), "cell": cells(fp).view(np.int64)}

    return C.in_arrow(C.texts(df, id_col, text_col), work, "id long, fp long, cell long")


def _marks(df: DataFrame, column: str, steps: list[int], name: str, xor: bool) -> DataFrame:
    own = F.col(column)
    near = [own.bitwiseXOR(F.lit(s)) if xor else own + F.lit(s) for s in steps]
    return df.select("fp", "rep", F.explode(F.array(own, *near)).alias(name))


def link_fingerprints(distinct: DataFrame, bits: int = 64, most: int | None = None) -> DataFrame:
    """Links (a, b), a > b, between the rep of distinct (fp, cell, rep) that keep all components at Hamming distance 2 or less.

    Fingerprints with different bits from ``bits`` on, where that is less than 64, are never linked. Cells of up to ``most``
    marks (else CELL_PAIRS) are verified by pairs.
    """
    most = CELL_PAIRS if most is None else most
    steps = [sign << 4 * k if sign > 0 else -(1 << 4 * k) for k in range(bits // 4) for sign in (1, -1)]
    marks = _marks(distinct, "cell", steps, "mark", False)
    shared = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    few = marks.join(shared.filter(F.col("n") <= most).select("mark"), "mark", "left_semi")
    other = few.select("mark", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    close = (F.col("rep") > F.col("rep2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= 2)
    pairs = few.join(other, (few["mark"] == other["mark"]) & close).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    full = shared.filter(F.col("n") > most).select("mark")
    near = marks.join(full, "mark", "left_semi").groupBy("fp").agg(F.min("rep").alias("rep"))
    flips = [1 << k if k < 63 else -(1 << 63) for k in range(bits)]
    exact = _marks(near, "fp", flips, "mark", True)
    least = exact.groupBy("mark").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = exact.join(least, "mark").select(F.col("rep").alias("a"), "b").filter("a <> b")
    return pairs.union(stars).distinct()


def simhash_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for each row of ``df``; links are at 2 or fewer bits."""
    prints = C.durable(fingerprints(df, id_col, text_col, shingle))
    distinct = C.durable(prints.groupBy("fp", "cell").agg(F.min("id").alias("rep")))
    found = components(link_fingerprints(distinct.filter("rep is not null"))).withColumnRenamed("node", "rep")
    classes = distinct.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sets(raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word shingles of each document, in hash order, and n + 1 offsets of the documents into them."""
    hashes, offsets = word_shingles(raw, at, n)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(offsets))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(at)))


def halves(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp, cell) for both halves of the fingerprint of each set of shingles that isn't empty: bit 32 tells the upper half.

    Other than in fingerprints(), a shingle that a text repeats has one vote, as it counts once in the similarity.
    """

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = np.asarray(batch.column(0))
        for row, end, raw, at in C.chunks(batch.column(1)):
            sets, offsets = _sets(raw, at, shingle)
            some = np.diff(offsets) > 0
            fp = majorities(sets, offsets)[some]
            both = np.concatenate([fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32) | np.uint64(1 << 32)])
            yield {"id": np.tile(ids[row:end][some], 2), "fp": both.view(np.int64), "cell": cells(both).view(np.int64)}

    return C.in_arrow(C.texts(df, id_col, text_col).filter("id is not null"), work, "id long, fp long, cell long")


def fingerprint_pairs(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Pairs (a, b), a > b, of documents whose fingerprints have a half within 2 bits, as a written table.

    Of two fingerprints within 5 bits one half is. A half is linked as op5_simhash() links whole fingerprints, by the bit
    counts of its 8 segments; documents of equal halves are paired with the smallest of them. Cells of 8 segments fill soon,
    so all are verified by marks of whole halves: rows grow with the documents at every size.
    """
    prints = C.durable(halves(df, id_col, text_col, shingle))
    distinct = C.durable(prints.groupBy("fp", "cell").agg(F.min("id").alias("rep")))
    equal = prints.join(distinct.select("fp", "rep"), "fp").filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    pairs = C.durable(equal.union(link_fingerprints(distinct, 32, 0)).distinct())
    C.discard(prints, distinct)
    C.drop_shuffles(df.sparkSession)
    return pairs


def rarity(df: DataFrame, id_col: str, text_col: str, shingle: int) -> np.ndarray:
    """How common the shingles of each of 2**RARITY_BITS hash buckets are: the logarithm of their documents beyond a mean bucket's.

    Counted over all documents, so every shingle has its place in this order whatever the size of the corpus. Up to
    COMMON_FROM documents more, or what may be chance, it is zero. Its base is 16: the shingles of a group of copies, which
    some of them have lost, mostly stay in one step and so in hash order, and copies share marks. A task holds 1 MB. Each
    task sums its own documents, what is shuffled are slices of these sums, and the driver gets one number for each bucket.
    """
    bits, n = RARITY_BITS, 64
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.uint32)
        for batch in batches:
            for _, _, raw, at in C.chunks(batch.column(1)) if batch.num_rows else ():
                sums += np.bincount(_bucket(_sets(raw, at, shingle)[0], bits), minlength=size).astype(np.uint32)
        if sums.any():
            part = size // n
            blobs = pa.array([zlib.compress(sums[k * part : (k + 1) * part].tobytes(), 1) for k in range(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), blobs], ["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.uint64)
                held[k] = held[k] + own if k in held else own
        if held:
            blobs = [np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "sums"])

    parts = C.texts(df, id_col, text_col).mapInArrow(count, "slice int, sums binary").repartition(min(n, C.partitions(df)), "slice").mapInArrow(add, "slice int, sums binary").toArrow()
    out = np.zeros((n, size // n), np.uint32)
    for k, blob in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist(), strict=True):
        out[k] = np.frombuffer(blob, np.uint32)
    mean = out.mean()
    more = out.ravel() - mean
    return np.where(more >= max(COMMON_FROM, 4 * mean**0.5), np.log2(np.maximum(more, 1)) / 4, 0).astype(np.int8)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def prefix_marks(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(mark, node, id, n, pos, rep) of the prefix of every distinct set of shingles, of which two or more sets have the mark.

    The shingles of a set stand in one order for all documents: by rarity(), then by hash. Two sets of at least this
    similarity have one in common among the first n - ceil(similarity * n) + 1 of each, so no pair is missed. ``node`` is a
    hash of the set. Equal sets count once; rows without a mark link (id, rep) such.
    """
    bits, known = RARITY_BITS, df.sparkSession.sparkContext.broadcast(rarity(df, id_col, text_col, shingle))
    out_names = ["mark", "node", "id", "n", "pos", "rep"]

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = np.asarray(batch.column(0))
        for row, end, raw, at in C.chunks(batch.column(1)):
            sets, offsets = _sets(raw, at, shingle)
            sizes = np.diff(offsets)
            node = C.run_hashes(sets, offsets[:-1], offsets[1:]).view(np.int64)
            by = np.lexsort((ids[row:end], node))
            by = by[sizes[by] > 0]
            first = np.ones(len(by), bool)
            first[1:] = node[by][1:] != node[by][:-1]
            lead = by[first]
            same, to = by[~first], lead[np.cumsum(first) - 1][~first]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            rank = known.value[_bucket(sets, bits)]
            order = np.lexsort((sets, rank, doc))
            pos = np.arange(len(sets)) - offsets[:-1][doc]
            prefix = sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + 1
            chosen = np.zeros(len(sizes), bool)
            chosen[lead] = True
            use = chosen[doc] & (pos < prefix[doc])
            d, k = doc[use], int(use.sum())
            own, m = ids[row:end], len(same)
            both = lambda x, y: np.concatenate([x, y])
            yield {
                "mark": both(sets[order][use].view(np.int64), C.mixed(own[same].astype(np.uint64)).view(np.int64)),
                "node": both(node[d], node[same]),
                "id": both(own[d], own[same]),
                "n": both(sizes[d], sizes[same]).astype(np.int32),
                "pos": both(pos[use], np.full(m, -1)).astype(np.int32),
                "rep": pa.array(both(np.zeros(k, np.int64), own[to]), mask=np.arange(k + m) < k),
            }

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # of the last mark the first row and the last one, and whether they are out
        for batch in batches:
            made = np.asarray(batch.column(5).is_valid())
            links = np.stack([np.asarray(batch.column(2))[made], np.asarray(batch.column(5).drop_null())], 1)
            rows = [np.asarray(batch.column(k))[~made] for k in range(5)]
            rows.append(np.zeros(len(rows[0]), bool))
            if len(rows[0]):
                rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
                mark, node, id_, _, pos, _ = rows
                first, new = np.ones(len(mark), bool), np.ones(len(mark), bool)
                first[1:] = mark[1:] != mark[:-1]
                new[1:] = first[1:] | (node[1:] != node[:-1])
                again = ~new & (pos == 0)  # of equal sets each has its first shingle once
                links = np.concatenate([links, np.stack([id_[again], id_[np.flatnonzero(new)[np.cumsum(new) - 1]][again]], 1)])
                rows = [x[new] for x in rows]
                first = first[new]
                group = np.cumsum(first) - 1
                out = (np.bincount(group)[group] > 1) & ~rows[5]
                last = np.flatnonzero(first)[-1]
                keep = [last] if last == len(first) - 1 else [last, len(first) - 1]
                held = [x[keep] for x in rows[:5]] + [np.full(len(keep), len(keep) > 1)]
                if out.any():
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[out]) for x in rows[:5]), pa.nulls(int(out.sum()), pa.int64())], out_names)
            if len(links):
                none = pa.nulls(len(links), pa.int64())
                few = pa.array(np.zeros(len(links), np.int32))
                yield pa.RecordBatch.from_arrays([none, none, pa.array(links[:, 0].copy()), few, few, pa.array(links[:, 1].copy())], out_names)

    schema = "mark long, node long, id long, n int, pos int, rep long"
    marked = C.in_arrow(C.texts(df, id_col, text_col).filter("id is not null"), work, schema)
    return marked.repartition(C.partitions(df), "mark").sortWithinPartitions("mark", "node", "id").mapInArrow(meet, schema)


def _possible(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of rows (a, b, n, pos, n2, pos2), one a shared mark, whose sets can have at least this similarity.

    What two sets share, but for the shared marks of their prefixes, lies after the last of these in both, and outside the
    prefix of one of them. If all their shared marks are given, no pair of this similarity is lost.
    """
    each = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), *(F.max(x).alias(x) for x in ("n", "n2", "pos", "pos2")))
    after = [F.ceil(F.lit(similarity) * F.col(n) - 1e-6) - 1 for n in ("n", "n2")]  # outside the prefix
    more = F.least(F.col("n") - F.col("pos") - 1, F.col("n2") - F.col("pos2") - 1, F.greatest(*after))
    return each.filter((1 + similarity) * (F.col("c") + more) >= similarity * (F.col("n") + F.col("n2")) - 1e-6).select("a", "b")


def linked(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) with the components of all pairs of at least this similarity.

    The pairs of fingerprint_pairs() come first. What their fingerprints tell apart, or what these pairs leave out where a
    mark has more than two, comes by prefix_marks(), and only if it isn't in one component yet. Each set is tried against the hub of
    each of its marks, where they share enough. The hub is the set of which the greatest share of marks is shared: the text
    that a large group of copies comes from, if it is there, as a copy has marks of its own where it was changed. Then every
    pair that shares a mark and is still apart is tried, so what all these leave apart is never lost.
    """
    close = fingerprint_pairs(df, id_col, text_col, shingle)
    alike = verified(close, df, id_col, text_col, shingle, similarity)
    stored = C.durable(prefix_marks(df, id_col, text_col, shingle, similarity))
    C.drop_shuffles(df.sparkSession)
    equal = C.durable(stored.filter("mark is null").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    known = components(alike.union(equal)).toDF("id", "component")
    marks = stored.filter("mark is not null")
    prefix = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-6) + 1
    shares = marks.groupBy("id", "n").agg(F.count(F.lit(1)).alias("c")).select("id", (F.col("c") / prefix).cast("float").alias("share"))
    own = F.coalesce("component", "id").alias("component")
    ranked = C.durable(marks.select("mark", "id", "n", "pos").join(shares.join(known, "id", "left").select("id", "share", own), "id"))
    C.discard(stored)
    hub = F.struct("share", (-F.col("id")).alias("least"), F.col("id").alias("b"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), "component")
    hubs = ranked.groupBy(F.col("mark").alias("of")).agg(F.max(hub).alias("hub"))
    first = ranked.join(hubs, F.col("mark") == F.col("of")).filter(F.col("component") != F.col("hub.component")).select(F.col("id").alias("a"), "hub.b", "n", "pos", "hub.n2", "hub.pos2")
    heads = C.durable(_possible(first, similarity))
    stars = verified(heads, df, id_col, text_col, shingle, similarity)
    found = components(known.toDF("a", "b").union(stars)).toDF("id", "component")
    placed = C.durable(ranked.drop("share", "component").join(found, "id", "left").withColumn("component", own))
    C.discard(ranked)
    mixed = placed.groupBy("mark").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("mark")
    one = placed.join(mixed, "mark", "left_semi")
    two = one.toDF("mark2", "id2", "n2", "pos2", "component2")
    # what two sets can share before and after a mark must allow the similarity
    most = F.least("pos", "pos2") + F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    fits = (1 + similarity) * most >= similarity * (F.col("n") + F.col("n2")) - 1e-6
    apart = one.join(two, (F.col("mark") == F.col("mark2")) & (F.col("id") > F.col("id2")) & (F.col("component") != F.col("component2")) & fits)
    possible = _possible(apart.select(F.col("id").alias("a"), F.col("id2").alias("b"), "n", "pos", "n2", "pos2"), similarity)
    rest = C.durable(possible.join(heads.union(close), ["a", "b"], "left_anti"))
    more = verified(rest, df, id_col, text_col, shingle, similarity)
    C.discard(placed, heads, rest, close)
    C.drop_shuffles(df.sparkSession)
    return equal.union(alike).union(stars).union(more)


def verified(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose sets of word shingles have at least this Jaccard similarity, as a written table.

    The sets of the documents in question are made once and written; only they meet the pairs.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def sets(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, end, raw, at in C.chunks(batch.column(1)):
            hashes, offsets = _sets(raw, at, shingle)
            yield {"id": batch.column(0).slice(row, end - row), "set": pa.array([hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())}

    own = C.durable(C.in_arrow(C.texts(df, id_col, text_col).join(asked, "id", "left_semi"), sets, "id long, set binary"))
    both = pairs.join(own.toDF("a", "left"), "a").join(own.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        ok = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            ok[k] = common > 0 and common >= similarity * (len(x) + len(y) - common) - 1e-9
        yield {"a": np.asarray(batch.column(0))[ok], "b": np.asarray(batch.column(1))[ok]}

    made = C.durable(C.in_arrow(both, work, "a long, b long"))
    C.discard(own)
    return made


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, component) of the documents that have a near duplicate: five-word shingles, similarity 0.8 or more.

    Candidates are the pairs that the fingerprints link, as in simhash_classes(), and their Jaccard similarity decides. At
    0.8 a 64-bit fingerprint differs in about ten bits, more than any grid finds, so an exact prefix filter over the sets of
    shingles brings what the fingerprints have left apart. Empty texts and rows without an identifier are no one's duplicate
    here; rows that share an identifier are one document.
    """
    return components(linked(df, id_col, text_col, shingle, similarity))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` less those that reach a smaller identifier by near-duplicate links; all columns stay."""
    lost = near_duplicates(df, id_col, text_col, shingle, similarity).filter("node <> component").select(F.col("node").alias(name := C.distinct_name(df, "node")))
    return df.join(lost, F.col(id_col) == F.col(name), "left_anti")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every whole text of ``documents``, 3-word shingles, 2 or fewer differing bits."""
    return simhash_classes(C.table(spark, sf_dir, "documents"))
