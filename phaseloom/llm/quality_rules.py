"""Operator 9, quality rules: a short-circuit cascade.

Every rule is a predicate on cheap statistics of the whole text. On a sample the cascade estimates each rule's cost and
the share that it rejects, once for a table, orders the rules by rejection per cost, and then tests a document against
one rule after another until the first that rejects it. The verdict is the conjunction of all rules, so it doesn't depend on the order;
the order only decides how much work is spent.

Null identifiers are passed on. Nulls and empty texts have no words: all statistics are zero and the base rule rejects them. Repeated rows are judged
one by one. An empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C


def _of(*parts: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    for part in parts:
        out[list(part)] = True
    return out


#: Bytes that are counted; of letters beyond ASCII the lead bytes, one for each character.
KINDS = {
    "word": ~(C.SPACE | C._CONTINUATION),
    "symbol": _of(b"#*$%&|<>"),
    "letter": _of(range(65, 91), range(97, 123), range(0xC3, 0xF5)),
    "upper": _of(range(65, 91)),
    "exclaim": _of(b"!"),
    "line": _of(b"\n"),
}
#: Documents that each statistic was made of in this process.
MADE: dict[str, int] = {}

#: Costs and selectivities are estimated once for a table, on so many documents of each of so many partitions. Only the
#: order of the rules depends on it.
SAMPLE, SAMPLED = 256, 4


class Page:
    """A run of documents; a statistic is made when a rule first asks for it, and kept: words and their hashes too."""

    def __init__(self, raw: np.ndarray, at: np.ndarray) -> None:
        self.raw, self.at = raw, at
        self.forget()

    def forget(self) -> None:
        """Let all statistics go."""
        self._words: C.Words | None = None
        self._hashes: np.ndarray | None = None
        self.known: dict[str, np.ndarray] = {}

    @property
    def words(self) -> C.Words:
        if self._words is None:
            MADE["words"] = MADE.get("words", 0) + len(self.at) - 1
            self._words = C.Words(self.raw, self.at)
        return self._words

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            MADE["hashes"] = MADE.get("hashes", 0) + len(self.at) - 1
            self._hashes = C.run_hashes(self.raw, self.words.start, self.words.end)
        return self._hashes

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.at)

    def some(self, keep: np.ndarray) -> Page:
        """The page of some of the documents, with what is known of them."""
        sizes = np.diff(self.at)
        part = Page(self.raw[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]))
        part.known = {name: x[keep] for name, x in self.known.items()}
        if self._words is not None:
            old = self._words
            own = keep[old.doc]
            shift = (self.at[:-1] - np.concatenate([[0], np.cumsum(np.where(keep, sizes, 0))[:-1]]))[old.doc[own]]
            words = part._words = object.__new__(C.Words)
            words.start, words.end = old.start[own] - shift, old.end[own] - shift
            words.at = np.concatenate([[0], np.cumsum(np.diff(old.at)[keep])])
            words.doc = np.repeat(np.arange(int(keep.sum())), np.diff(words.at))
            part._hashes = None if self._hashes is None else self._hashes[own]
        return part

    def _kept(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self.known:
            MADE[name] = MADE.get(name, 0) + len(self.at) - 1
            self.known[name] = make()
        return self.known[name]

    def counted(self, name: str) -> np.ndarray:
        """Characters of each document of one of KINDS."""
        return self._kept(name, lambda: C.per_doc(KINDS[name][self.raw], self.at))

    def dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their document."""
        return self._kept("dup_lines", self._dup_lines)

    def repeat_words(self) -> np.ndarray:
        """Words within 3-word windows that their document has twice or more."""
        return self._kept("repeat_words", self._repeat_words)

    def _dup_lines(self) -> np.ndarray:
        raw, at, n = self.raw, self.at, len(self.at) - 1
        cut = np.flatnonzero(raw == 10)
        start = np.concatenate([at[:-1], cut + 1])
        doc = np.concatenate([np.arange(n), np.searchsorted(at, cut, "right") - 1])
        order = np.argsort(start, kind="stable")
        start, doc = start[order], doc[order]
        end = at[1:][doc]
        same = doc[:-1] == doc[1:]
        end[:-1][same] = start[1:][same] - 1
        full = np.searchsorted(self.words.start, end) > np.searchsorted(self.words.start, start)
        start, end, doc = start[full], end[full], doc[full]
        return np.bincount(doc[self._repeats(C.run_hashes(raw, start, end), doc, True)], minlength=n)

    def _repeat_words(self) -> np.ndarray:
        at, doc, n = self.words.at, self.words.doc, len(self.at) - 1
        if len(doc) < 3:
            return np.zeros(n, np.int64)
        start = np.flatnonzero(doc[:-2] == doc[2:])
        hit = start[self._repeats(C.run_hashes(self.hashes, start, start + 3), doc[start], False)]
        covered = np.zeros(len(doc), bool)
        for k in range(3):
            covered[hit + k] = True
        return C.per_doc(covered, at)

    @staticmethod
    def _repeats(hashes: np.ndarray, doc: np.ndarray, later_only: bool) -> np.ndarray:
        """Indices of values that their document has twice or more; later_only: without one of each."""
        key = C.mixed(hashes + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        hit = np.zeros(len(key), bool)
        hit[1:] = same
        if not later_only:
            hit[:-1] |= same
        return order[hit]


@dataclass(frozen=True)
class Rule:
    """``fails`` says which documents of a page the rule rejects."""

    name: str
    fails: Callable[[Page], np.ndarray]


#: The base rule's two parts are given; the bounds of the others are wide: prose in any language passes.
RULES = (
    Rule("few_words", lambda p: p.n_words < 50),
    Rule("repeated_windows", lambda p: 100 * p.repeat_words() > 50 * p.n_words),
    Rule("symbols", lambda p: 10 * p.counted("symbol") > np.maximum(p.n_words, 1)),
    Rule("word_length", lambda p: (p.counted("word") < 2 * p.n_words) | (p.counted("word") > 15 * p.n_words)),
    Rule("duplicate_lines", lambda p: (p.dup_lines() >= 4) & (100 * p.dup_lines() > 30 * (p.counted("line") + 1))),
    Rule("letters", lambda p: 100 * p.counted("letter") < 60 * np.maximum(p.counted("word"), 1)),
    Rule("upper_case", lambda p: 100 * p.counted("upper") > 40 * np.maximum(p.counted("letter"), 1)),
    Rule("exclamations", lambda p: 5 * p.counted("exclaim") > np.maximum(p.n_words, 1)),
)


def estimated(page: Page, rules: tuple[Rule, ...]) -> list[tuple[float, float]]:
    """(seconds, share rejected) of each rule on a page, all that it needs made anew for each: words and hashes are charged to it."""
    out = []
    for rule in rules:
        page.forget()
        began = time.perf_counter()
        rejected = (rule.fails(page).sum() + 0.5) / len(page.at)
        out.append((max(time.perf_counter() - began, 1e-7), float(rejected)))
    return out


def order_rules(texts: DataFrame, rules: tuple[Rule, ...], sample: int = SAMPLE) -> tuple[Rule, ...]:
    """The rules by the share of a sample that they reject for each second, best first; ``texts`` (id, text).

    The sample is the first documents of a few partitions; what leaves them is a row for each rule.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, at in C.chunks(batch.column(1).slice(0, sample)) if batch.num_rows else ():
                made = estimated(Page(raw, at), rules)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int64()), pa.array([x[0] for x in made]), pa.array([x[1] * (len(at) - 1) for x in made])], ["rule", "cost", "rejected"])
                return

    rows = texts.mapInArrow(work, "rule long, cost double, rejected double").limit(SAMPLED * len(rules)).collect()
    worth = {k: sum(r.rejected for r in rows if r.rule == k) / max(sum(r.cost for r in rows if r.rule == k), 1e-9) for k in range(len(rules))}
    return tuple(rule for _, _, rule in sorted(((-worth[k], k, rule) for k, rule in enumerate(rules)), key=lambda x: x[:2]))


def cascade(page: Page, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which documents pass all rules. A rule sees a page of those documents only that no earlier rule has rejected."""
    passed = np.ones(len(page.at) - 1, bool)
    for rule in rules:
        fails = rule.fails(page)
        if fails.any():
            passed[np.flatnonzero(passed)[fails]] = False
            if not passed.any():
                break
            page = page.some(~fails)
    return passed


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of ``df``: statistics, ``base_failed`` and ``kept``, under the column ``doc_id``. No shuffle.

    The statistics that are returned are made of every document, so the cascade finds them known; it makes the others of the
    documents that are still in question.
    """
    own = C.texts(df, id_col, text_col)
    order = order_rules(own, rules)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, end, raw, at in C.chunks(batch.column(1)):
            page = Page(raw, at)
            again, lines, chars, symbols = page.repeat_words(), page.dup_lines(), page.counted("word"), page.counted("symbol")
            failed = (page.n_words < 50) | (100 * again > 50 * page.n_words)
            kept = ~failed
            if kept.any():
                kept[kept] = cascade(page.some(~failed), order)
            yield {
                "doc_id": batch.column(0).slice(row, end - row),
                "n_words": page.n_words.astype(np.int64),
                "word_chars": chars,
                "n_symbols": symbols,
                "n_dup_lines": lines.astype(np.int64),
                "n_repeat_words": again,
                "base_failed": failed,
                "kept": kept,
            }

    return C.in_arrow(own, work, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` whose text passes all rules, with all their columns. No shuffle.

    Null and empty texts go; clashing column names can't occur as no column is added.
    """
    at_text = df.columns.index(text_col)
    order = order_rules(C.texts(df, id_col, text_col), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at_text).fill_null("")
            kept = [cascade(Page(raw, at), order) for _, _, raw, at in C.chunks(column)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return df.mapInArrow(run, df.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every whole text of ``documents``."""
    return judge(C.table(spark, sf_dir, "documents"))
