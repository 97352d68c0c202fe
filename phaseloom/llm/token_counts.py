"""Operator 3, token counts that follow edits.

The pre-tokens of a document are cut into leaves of LEAF parts; a segment tree keeps the characters and tokens of every
subtree. The leaves are kept in a table with the text (count_trees), so a document is encoded whole once; a later edit
(edit_trees) builds the sums from the leaves, finds the leaves that it touches by descending on characters, and gives the
table anew. Encoding starts at the leaf before the edit, early enough that no earlier pre-token has seen a changed
character, and goes on until a pre-token ends on an old leaf border after the edit: from there on nothing can differ, as the
pattern has no memory but its position. The new count goes into the first leaf, the others go, and only the sums above them
are renewed.

Counts are of plain text: the text of a special token counts as the characters that it has.

Null and empty texts have no tokens. Repeated rows are counted each; edits of an identifier, null too, go to all its rows.
An empty table gives an empty result. Extra columns are not read. Edits are (start, end, replacement) in code points of the
old text; null bounds leave an edit out, a null replacement is empty, bounds beyond the text are drawn in, and of edits that
overlap the first by (start, end) counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe
from . import common as C

LEAF = 32
#: What the registered query edits: addresses and long runs of digits are replaced by marks.
REDACTED = ((regex.compile(r"[\w.+-]+@[\w-]+\.[\w.-]*\w"), "[address]"), (regex.compile(r"\d[\d .()-]{5,}\d"), "[number]"))

Edits = list[tuple[int, int, str]]


class Counter:
    """Counts tokens of parts of texts; one for each worker."""

    def __init__(self, vocabulary: str) -> None:
        self.bpe = byte_bpe.loaded(vocabulary)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def one(self, pre_token: str) -> int:
        found = self.known.get(pre_token)
        if found is None:
            if len(self.known) >= byte_bpe.CACHE:
                self.known.clear()
            found = self.known[pre_token] = len(self.bpe.plain(pre_token))
        return found

    def parts(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of a text's parts; a part ends where a pre-token ends."""
        head, *rest = text.split(" ")
        try:
            ids = [self.bpe.heads[head], *map(self.bpe.parts.__getitem__, rest)]
            counts = [len(x) // 4 for x in ids]
            return [len(head), *(len(x) + 1 for x in rest)], counts
        except TypeError:
            found = self.pattern.findall(text)
            return [len(x) for x in found], [self.one(x) for x in found]


class Tree:
    """Sums of characters and tokens over the leaves, in one array of nodes: children of k are 2 k and 2 k + 1."""

    def __init__(self, chars: list[int], tokens: list[int], leaf: int = LEAF) -> None:
        cut = np.arange(0, len(chars), leaf)
        leaves = np.stack([np.add.reduceat(np.array(x, np.int64), cut) if len(cut) else np.zeros(0, np.int64) for x in (chars, tokens)], 1)
        self.n, self.size = len(leaves), 1 << max(0, (len(leaves) - 1).bit_length())
        self.sum = np.zeros((2 * self.size, 2), np.int64)
        self.sum[self.size : self.size + self.n] = leaves
        level = self.size
        while level > 1:
            self.sum[level // 2 : level] = self.sum[level : 2 * level : 2] + self.sum[level + 1 : 2 * level : 2]
            level //= 2

    def leaves(self) -> np.ndarray:
        """(characters, tokens) of the leaves that aren't empty."""
        own = self.sum[self.size : self.size + self.n]
        return own[own[:, 0] > 0]

    @classmethod
    def of_leaves(cls, chars: np.ndarray, tokens: np.ndarray) -> Tree:
        """The tree of leaves that were kept."""
        return cls(chars, tokens, 1)

    @property
    def tokens(self) -> int:
        return int(self.sum[1, 1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if char >= start + self.sum[node, 0]:
                start += int(self.sum[node, 0])
                node += 1
        return node - self.size, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        self.sum[node] = chars, tokens
        while node > 1:
            node //= 2
            self.sum[node] = self.sum[2 * node] + self.sum[2 * node + 1]


def edit(tree: Tree, counter: Counter, text: str, edits: Edits) -> tuple[str, int]:
    """Bring the tree of a text with leaves up to date; the new text and how many of its characters were encoded anew."""
    if not edits:
        return text, 0
    pieces, at = [], 0
    for start, end, new in edits:
        pieces += [text[at:start], new]
        at = end
    after = "".join([*pieces, text[at:]])
    ends = np.cumsum(tree.sum[tree.size : tree.size + tree.n, 0]).tolist()
    match, updates, shift, k = counter.pattern.match, [], 0, 0
    while k < len(edits):
        # a pre-token looks at two characters after its end at most, so none before this leaf has seen the edit
        leaf, begin = tree.leaf_at(max(edits[k][0] - 2, 0))
        if updates and leaf <= updates[-1][1]:
            leaf = updates[-1][1] + 1
            begin = ends[leaf - 1]
        first = place = begin + shift
        last, tokens = leaf, 0
        while True:
            while k < len(edits) and edits[k][0] <= ends[last]:
                start, end, new = edits[k]
                shift += len(new) - (end - start)
                k += 1
                while ends[last] < end:
                    last += 1
            border = ends[last] + shift
            while place < border:
                found = match(after, place)
                tokens += counter.one(found.group())
                place = found.end()
            if place == border:
                break
            last += 1
        updates.append((leaf, last, place - first, tokens))
    for leaf, last, chars, tokens in updates:
        tree.set(leaf, chars, tokens)
        for other in range(leaf + 1, last + 1):
            tree.set(other, 0, 0)
    return after, sum(u[2] for u in updates)


def redactions(text: str) -> Edits:
    """Addresses and long numbers of a text."""
    found = sorted((m.start(), m.end(), mark) for pattern, mark in REDACTED for m in pattern.finditer(text))
    out: Edits = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def in_order(edits: Edits, length: int) -> Edits:
    """Edits drawn into a text of this length, sorted and apart from each other."""
    out: Edits = []
    for start, end, new in sorted((min(max(a, 0), length), min(max(b, a, 0), length), new or "") for a, b, new in edits if a is not None and b is not None):
        if not out or start >= out[-1][1]:
            out.append((start, end, new))
    return out


_COUNTERS: dict[str, Counter] = {}


def _counter(vocabulary: str) -> Counter:
    if vocabulary not in _COUNTERS:
        _COUNTERS[vocabulary] = Counter(vocabulary)
    return _COUNTERS[vocabulary]


_TREES = "doc_id long, text string, tokens long, leaf_chars array<int>, leaf_tokens array<int>"
_COUNTS = "doc_id long, tokens_before long, tokens_after long, n_edits long, n_leaves long, chars_encoded long"


def _lists(column: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in column])]).astype(np.int32)
    values = np.concatenate(column).astype(np.int32) if column else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def count_trees(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, text, tokens, leaf_chars, leaf_tokens): the tree of every document, to be written and kept. No shuffle."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        counter = _counter(vocabulary)
        for row in range(0, batch.num_rows, 500):
            texts = batch.column(1).slice(row, 500)
            leaves = [Tree(*counter.parts(x)).leaves() if x else np.zeros((0, 2), np.int64) for x in texts.to_pylist()]
            yield {
                "doc_id": batch.column(0).slice(row, 500),
                "text": texts,
                "tokens": np.array([x[:, 1].sum() for x in leaves], np.int64),
                "leaf_chars": _lists([x[:, 0] for x in leaves]),
                "leaf_tokens": _lists([x[:, 1] for x in leaves]),
            }

    return C.in_arrow(C.texts(df, id_col, text_col), work, _TREES)


def _edited(texts: list[str], chars: pa.Array, tokens: pa.Array, all_edits: Iterator[Edits], vocabulary: str) -> tuple[list[str], list[np.ndarray], dict]:
    """New texts, their leaves, and what was counted."""
    counter, rows, new, kept = _counter(vocabulary), [], [], []
    for text, c, t, edits in zip(texts, chars, tokens, all_edits, strict=True):
        edits = in_order(edits, len(text))
        if text or not edits:
            tree = Tree.of_leaves(c.values.to_numpy(), t.values.to_numpy())
            before = tree.tokens
            after, encoded = edit(tree, counter, text, edits)
        else:  # an empty text has no leaf to edit
            after = "".join(e[2] for e in edits)
            tree, before, encoded = (Tree(*counter.parts(after)) if after else Tree([], [])), 0, len(after)
        rows.append((before, tree.tokens, len(edits), tree.n, encoded))
        new.append(after)
        kept.append(tree.leaves())
    columns = np.array(rows, np.int64).reshape(-1, 5)
    names = ("tokens_before", "tokens_after", "n_edits", "n_leaves", "chars_encoded")
    return new, kept, dict(zip(names, (np.ascontiguousarray(c) for c in columns.T), strict=True))


def edit_trees(trees: DataFrame, edits: DataFrame | None = None, find: Callable[[str], Edits] = redactions, id_col: str = "doc_id", vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """The table of trees after edits, with tokens_before, n_edits, n_leaves and chars_encoded; only what edits touch is encoded.

    ``edits`` (id, start, end, replacement), or those that ``find`` makes of each text.
    """
    both = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", F.lit(None).cast("array<struct<start:int,end:int,replacement:string>>").alias("edits"))
    if edits is not None:
        one = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("replacement").cast("string").alias("replacement"))
        lists = edits.groupBy(F.col(id_col).cast("long").alias("of")).agg(F.array_sort(F.collect_list(one)).alias("edits"))
        both = both.drop("edits").join(lists, F.col("doc_id").eqNullSafe(F.col("of")), "left").drop("of")
    given = edits is not None

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for row in range(0, batch.num_rows, 500):
            part = batch.slice(row, 500)
            texts = part.column(1).to_pylist()
            own = ([(e["start"], e["end"], e["replacement"]) for e in x or ()] for x in part.column(4).to_pylist()) if given else map(find, texts)
            new, leaves, counts = _edited(texts, part.column(2), part.column(3), own, vocabulary)
            yield {"doc_id": part.column(0), "text": pa.array(new, pa.string()), "tokens": counts["tokens_after"], "leaf_chars": _lists([x[:, 0] for x in leaves]), "leaf_tokens": _lists([x[:, 1] for x in leaves])} | counts

    return C.in_arrow(both, work, _TREES + ", tokens_before long, tokens_after long, n_edits long, n_leaves long, chars_encoded long").drop("tokens_after")


def _counts(edited: DataFrame) -> DataFrame:
    return edited.select("doc_id", "tokens_before", F.col("tokens").alias("tokens_after"), "n_edits", "n_leaves", "chars_encoded")


def recount(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[[str], Edits] = redactions, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Token counts before and after the edits that ``find`` makes of each text, by trees that are written between. No shuffle."""
    return _counts(edit_trees(C.durable(count_trees(df, id_col, text_col, vocabulary)), find=find, vocabulary=vocabulary))


def recount_edited(df: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """The same for a table of edits: id, start, end and replacement, named as in ``id_col`` and so."""
    return _counts(edit_trees(C.durable(count_trees(df, id_col, text_col, vocabulary)), edits, id_col=id_col, vocabulary=vocabulary))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every whole text of ``documents`` before and after addresses and numbers are replaced."""
    return recount(C.table(spark, sf_dir, "documents"))
