"""Operator 11, conversation structure repair by alignment to the alternating grammar ``(s?(ua)+)?`` of role initials.

Turns are Kept (0), Reroled to user or assistant (2), Deleted (3; a must for blank and repeated ones) or Inserted without text
(2); a truncated turn that isn't deleted adds 1. A Wagner-Fischer table holds the least cost of the last turns against the
last initials of the grammar string; as the strings of all feasible lengths end alike, one table serves them all. A
diagonal that lies d insertions or deletions apart costs 2d or 3d, so by Ukkonen only the diagonals within the cost of a
plain repair, the incumbent, are filled. Of every feasible length that reaches the least cost the edits are traced back, of
equal steps the ASCII-least first, and the least of these audits is taken.

Alignment is over a stretch of turns between two states of the grammar (nothing yet, after s, after u, after a). Stretches
join: no audit is the beginning of another one of equal cost, so the least of a whole is made of the least of its parts.
A conversation of up to LONG_TURNS turns and LONG_BYTES of text is one stretch, read in the order of its turns from a
partition that is sorted by conversation. Longer ones are counted before any shuffle; their turns are sorted into ranges of
(conversation, turn), so that one may fill any number of tasks, numbered there, aligned in blocks of BLOCK turns, and then
only a row for each block meets its conversation. Both ways give the same rows.

A row's first fault counts: blank (nothing but white space), duplicate (role and text are those of an earlier turn),
truncated (the last character that isn't white space is none of ``.!?``). Turns without a number come first; turns of one
number in the order of role and text. Null roles and texts count as one space. Turns without a conversation form the
conversation null. A conversation whose rows have no copies has zeros and an empty audit. An empty table gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
#: Turns and bytes of text up to which a conversation is aligned as a whole, and turns of a block of a longer one.
LONG_TURNS, LONG_BYTES, BLOCK = 2048, 16 << 20, 256
#: States of the grammar: nothing yet, after s, after u, after a.
NONE, S, U, A = range(4)
_FAR = 1 << 40
_SPACES = " \t\n\v\f\r"
_SORT = ["conv_id", "turn", "role", "text"]


class Turns:
    """Initials, whether a turn must go, and what keeping it costs."""

    def __init__(self, initials: list[str], gone: list[bool], cut: list[bool]) -> None:
        self.initials, self.n = initials, len(initials)
        self.gone = np.array(gone, bool)
        kept = np.where(self.gone, _FAR, np.array(cut, np.int64) * CUT_SHORT)
        as_ = lambda c: kept + np.array([0 if x == c else REROLE for x in initials], np.int64)
        self.kept, self.cost = kept, {"u": as_("u"), "a": as_("a")}

    def incumbent(self) -> int:
        """Cost of a plain repair that is possible between any two states: a turn out of order gets one inserted before it."""
        cost, wanted = 3 * INSERT, None
        for k, initial in enumerate(self.initials):
            if self.gone[k]:
                cost += DELETE
                continue
            if initial not in ("u", "a"):
                cost, initial = cost + REROLE, wanted or "u"
            elif wanted not in (None, initial):
                cost += INSERT
            cost += int(self.kept[k])
            wanted = "a" if initial == "u" else "u"
        return cost


class Table:
    """Least costs of the turns from i on against the last m initials of a string that ends in ``last``, by diagonals."""

    def __init__(self, turns: Turns, last: str, bound: int) -> None:
        self.turns, self.last = turns, last
        self.low, self.high = -(bound // DELETE), bound // INSERT  # m - (turns left): insertions above, deletions below
        n, width = turns.n, self.high - self.low + 1
        d = np.arange(self.low, self.high + 1)
        other = "a" if last == "u" else "u"
        self.rows = np.full((n + 1, width + 1), _FAR, np.int64)  # one more diagonal, never reached
        self.rows[n, :width] = np.where(d >= 0, INSERT * d, _FAR)
        steps = INSERT * np.arange(width)
        for i in range(n - 1, -1, -1):
            m, after = d + n - i, self.rows[i + 1]
            stay = np.where(m % 2 == 1, turns.cost[last][i], turns.cost[other][i]) + after[:width]
            here = np.minimum(np.where(m >= 1, stay, _FAR), DELETE + after[1:])
            here = np.where(m >= 0, here, _FAR)
            self.rows[i, :width] = np.minimum(np.minimum.accumulate(here - steps) + steps, _FAR)
        self.other = other

    def cost(self, i: int, m: int) -> int:
        k = m - (self.turns.n - i) - self.low
        return int(self.rows[i, k]) if m >= 0 and 0 <= k < self.rows.shape[1] - 1 else _FAR

    def lengths(self, i: int, first: str) -> range:
        """Feasible m of strings from ``first`` on, one initial at least."""
        n = self.turns.n - i
        low = max(1, n + self.low)
        odd = first == self.last
        return range(low + (low % 2 != odd), n + self.high + 1, 2)

    def trace(self, i: int, m: int) -> str:
        """The ASCII-least edits of least cost."""
        out, turns, n = [], self.turns, self.turns.n
        while i < n or m:
            now = self.cost(i, m)
            role = self.last if m % 2 == 1 else self.other
            if i < n and self.cost(i + 1, m) + DELETE == now:
                out.append("D")
                i += 1
            elif m and self.cost(i, m - 1) + INSERT == now:
                out.append("I")
                m -= 1
            else:
                out.append("K" if turns.initials[i] == role else "R")
                i, m = i + 1, m - 1
        return "".join(out)


def stretches(turns: Turns, pairs: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) of the least repair of a stretch from one state to another, where there is any."""
    bound = turns.incumbent()
    tables = {last: Table(turns, last, bound) for last in {"u" if q == U else "a" for _, q in pairs if q in (U, A)}}
    heads = [(i, DELETE * i + int(turns.kept[i])) for i in range(turns.n) if turns.initials[i] == "s" and not turns.gone[i]]
    found = {}
    for p, q in pairs:
        least, audits = _FAR, []

        def offer(cost: int, audit: Callable[[], str]) -> None:
            nonlocal least, audits
            if cost < least:
                least, audits = cost, []
            if cost == least < _FAR:
                audits.append(audit)

        if p == q:
            offer(DELETE * turns.n, lambda: "D" * turns.n)
        if p == NONE and q == S:
            for i, cost in heads:
                offer(cost + DELETE * (turns.n - i - 1), lambda i=i: "D" * i + "K" + "D" * (turns.n - i - 1))
        if q in (U, A):
            table = tables["u" if q == U else "a"]
            first = "a" if p == U else "u"
            for m in table.lengths(0, first):
                offer(table.cost(0, m), lambda m=m: table.trace(0, m))
            if p == NONE:
                for i, cost in heads:
                    if cost <= bound:
                        for m in table.lengths(i + 1, "u"):
                            offer(cost + table.cost(i + 1, m), lambda i=i, m=m: "D" * i + "K" + table.trace(i + 1, m))
        if audits:
            found[p, q] = least, min(audit() for audit in audits)
    return found


def least_repair(turns: Turns) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return min(stretches(turns, [(NONE, NONE), (NONE, A)]).values())


def repaired(audit: str, roles: list[str], texts: list[str], state: int = NONE) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns that the edits make from a state of the grammar on."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        named = "assistant" if state == U else "user"
        if edit == "I":
            yield edit, named, ""
        else:
            yield edit, roles[at] if edit == "K" else named, texts[at]
            at += 1
        state = S if edit == "K" and state == NONE and roles[at - 1][:1] == "s" else A if state == U else U


def _flags(df: DataFrame) -> DataFrame:
    """Row-local faults of turns (conv_id, turn, role, text, copies): initial, blank, cut."""
    bare = F.btrim("text", F.lit(_SPACES))
    blank = F.length(bare) == 0
    return df.select(*_SORT, "copies", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~blank & ~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))


def turns_of(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, copies): nulls but the turn's and the conversation's as one space; copies of a row lie side by side."""
    filled = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(name)
    return df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), filled(role_col, "role"), filled(text_col, "text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Tally:
    """Counts over turns in order, and what the next stretch needs of them."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.numbers = 0
        self.first = self.last = None
        self.low = self.high = None

    def add(self, turn: int | None, initial: str, blank: bool, twice: bool, cut: bool) -> None:
        self.blank += blank
        self.duplicate += twice and not blank
        self.truncated += cut and not twice
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.numbers += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def join(self, more: Tally) -> None:
        """Take the turns that follow, counted apart."""
        if more.first is None:
            return
        for name in ("blank", "duplicate", "truncated", "illegal", "numbers"):
            setattr(self, name, getattr(self, name) + getattr(more, name))
        if self.last is not None:
            self.illegal += self.last + more.first not in ("su", "ua", "au")
        self.first, self.last = more.first if self.first is None else self.first, more.last
        if more.low is not None:
            self.numbers -= more.low == self.high
            self.low, self.high = more.low if self.low is None else self.low, more.high

    def counts(self) -> tuple[int, int, int, int, int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.numbers
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _whole(rows: list[tuple]) -> tuple[Tally, int, str, list[str], list[str]]:
    """Counts, cost, audit, roles and texts of a conversation's rows (conv, turn, role, text, copies, initial, blank, cut)."""
    tally, seen, roles, texts = Tally(), set(), [], []
    initials, gone, short = [], [], []
    for _, turn, role, text, copies, initial, blank, cut in rows:
        for _ in range(copies):
            twice = (role, text) in seen
            seen.add((role, text))
            tally.add(turn, initial, blank, twice, cut)
            roles.append(role)
            texts.append(text)
            initials.append(initial)
            gone.append(blank or twice)
            short.append(cut and not blank and not twice)
    cost, audit = least_repair(Turns(initials, gone, short)) if roles else (0, "")
    return tally, cost, audit, roles, texts


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """The rows of each conversation of sorted batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1024, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) == most or size > most_bytes:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)


def _line(edit: str, role: str, text: str) -> bytes:
    return f"{role}:{text}".encode()


def _short(turns: DataFrame, conv: str, digest: bool) -> DataFrame:
    """Conversations that are read as a whole; ``digest``: one row each, else one for each repaired turn."""
    kind = _arrow(conv)
    if digest:
        names = [("conv_id", kind), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    else:
        names = [("conv_id", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    schema = pa.schema(names)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, rows in _conversations(batches):
            tally, cost, audit, roles, texts = _whole(rows)
            after = repaired(audit, roles, texts)
            if digest:
                yield key, *tally.counts(), cost, audit, hashlib.sha256(b"\n".join(_line(*x) for x in after)).hexdigest()
            else:
                yield from ((key, k, *x) for k, x in enumerate(after))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(made(batches), schema)

    out = f"conv_id {conv}, {_COUNTS}, repaired_sha256 string" if digest else f"conv_id {conv}, place long, edit string, role string, text string"
    return turns.repartition(C.partitions(turns), "conv_id").sortWithinPartitions(*_SORT).mapInArrow(run, out)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _blocks(turns: DataFrame, conv: str, size: int) -> DataFrame:
    """``turns`` of long conversations with ``twice``, numbered: (conv_id, part, block, k) in their order; written."""
    key = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    keyed = turns.withColumn("key", key)
    before = keyed.groupBy(F.col("conv_id").alias("of"), F.col("key").alias("same")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))).alias("first"))
    own = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    told = keyed.join(before, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("same"))).withColumn("later", own > F.col("first")).drop("of", "same", "first", "key")
    told = C.durable(told)  # ranges are sampled from it
    names = [*turns.columns, "later"]
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = dict(told.dtypes)
    out = [(c, types[kinds[c]]) for c in names if c != "copies"]
    schema = pa.schema([*((c, k) for c, k in out if c != "later"), ("twice", pa.bool_()), ("part", pa.int64()), ("block", pa.int64()), ("k", pa.int32())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, last, n = TaskContext.get().partitionId(), names.index("copies"), None, 0

        def rows() -> Iterator[tuple]:
            nonlocal last, n
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    if last is None or row[0] != last[0]:
                        n = 0
                    same = last is not None and row[:4] == last[:4]
                    for copy in range(row[at]):
                        yield *(x for c, x in zip(names, row, strict=True) if c not in ("copies", "later")), row[-1] or same or copy > 0, part, n // size, n % size
                        n += 1
                    last = row

        yield from _batches(rows(), schema)

    kept = [c for c in names if c not in ("copies", "later")]
    ddl = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", twice boolean, part long, block long, k int"
    ranged = told.repartitionByRange(C.partitions(turns), *_SORT).sortWithinPartitions(*_SORT).select(*names)
    made = C.durable(ranged.mapInArrow(numbered, ddl))
    C.discard(told)
    return made


_STATES = [(p, q) for p in range(4) for q in range(4) if q in (U, A) or p == q or (p, q) == (NONE, S)]


def _aligned(rows: DataFrame, conv: str) -> DataFrame:
    """Of each block its counts and, for each pair of states, the least cost and audit."""
    kind = f"conv_id {conv}, part long, block long, counts array<long>, first string, last string, low long, high long, costs array<long>, audits array<string>"

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        tally = Tally()
        for turn, initial, blank, twice, cut in zip(group["turn"], group["initial"], group["blank"], group["twice"], group["cut"], strict=True):
            tally.add(None if turn is None else int(turn), initial, bool(blank), bool(twice), bool(cut))
        gone = (group["blank"] | group["twice"]).tolist()
        turns = Turns(group["initial"].tolist(), gone, (group["cut"] & ~group["twice"]).tolist())
        found = stretches(turns, _STATES)
        lead = group.iloc[0]
        counts = [tally.blank, tally.duplicate, tally.truncated, tally.illegal, tally.numbers]
        conv_id = None if pd.isna(lead["conv_id"]) else lead["conv_id"]
        row = (conv_id, lead["part"], lead["block"], counts, tally.first, tally.last, tally.low, tally.high, [found.get(x, (None, None))[0] for x in _STATES], [found.get(x, (None, None))[1] for x in _STATES])
        return pd.DataFrame([row], columns=["conv_id", "part", "block", "counts", "first", "last", "low", "high", "costs", "audits"])

    return rows.select("conv_id", "part", "block", "k", F.col("turn").cast("string").alias("turn"), "initial", "blank", "twice", "cut").groupBy("conv_id", "part", "block").applyInPandas(one, kind)


def _joined(blocks: DataFrame, conv: str) -> DataFrame:
    """(conv_id, part, block, state, chunk, total): the edits of each block; the last row of a conversation has its counts."""
    schema = pa.schema([("conv_id", _arrow(conv)), ("part", pa.int64()), ("block", pa.int64()), ("state", pa.int32()), ("chunk", pa.string()), ("total", pa.list_(pa.int64()))])

    def chained(rows: list[tuple]) -> Iterator[tuple]:
        live = {NONE: (0, "")}  # of each state the cost, and the audit since all states last agreed
        tally, back, ahead = Tally(), [], []
        for conv_id, part, block, counts, first, last, low, high, costs, audits in rows:
            more = Tally()
            more.blank, more.duplicate, more.truncated, more.illegal, more.numbers = counts
            more.first, more.last, more.low, more.high = first, last, low, high
            tally.join(more)
            reached: dict[int, tuple[int, str, int, str]] = {}
            for (p, q), cost, audit in zip(_STATES, costs, audits, strict=True):
                if p in live and cost is not None:
                    option = (live[p][0] + cost, live[p][1] + audit, p, audit)
                    if q not in reached or option[:2] < reached[q][:2]:
                        reached[q] = option
            back.append({q: (p, audit) for q, (_, _, p, audit) in reached.items()})
            ahead.append((conv_id, part, block))
            shared = len(os.path.commonprefix([x[1] for x in reached.values()]))
            live = {q: (x[0], x[1][shared:]) for q, x in reached.items()}
        cost, _, state = min((*live[q], q) for q in (NONE, A) if q in live)
        chunks = []
        for step in reversed(back):
            state, audit = step[state]
            chunks.append((state, audit))
        for k, (place, (state, audit)) in enumerate(zip(ahead, reversed(chunks), strict=True)):
            yield *place, state, audit, [*tally.counts(), cost] if k == len(ahead) - 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((x for _, rows in _conversations(batches) for x in chained(rows)), schema)

    return blocks.repartition(C.partitions(blocks), "conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(run, f"conv_id {conv}, part long, block long, state int, chunk string, total array<long>")


def _long(turns: DataFrame, conv: str, digest: bool, size: int) -> DataFrame:
    """Conversations of any length, by blocks."""
    rows = _blocks(turns, conv, size)
    chunks = C.durable(_joined(_aligned(rows, conv), conv))
    line = "conv_id {0}, part long, block long, chunk string, total array<long>, lines binary".format(conv)
    turn = f"conv_id {conv}, part long, block long, k int, edit string, role string, text string"

    def rewritten(key: tuple, group: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        own = chunk.iloc[0]
        after = repaired(own["chunk"], group["role"].tolist(), group["text"].tolist(), int(own["state"]))
        head = (None if pd.isna(own["conv_id"]) else own["conv_id"], own["part"], own["block"])
        if digest:
            return pd.DataFrame([(*head, own["chunk"], own["total"], b"".join(b"\n" + _line(*x) for x in after))], columns=["conv_id", "part", "block", "chunk", "total", "lines"])
        return pd.DataFrame([(*head, k, *x) for k, x in enumerate(after)], columns=["conv_id", "part", "block", "k", "edit", "role", "text"])

    by = ["conv_id", "part", "block"]
    made = rows.select(*by, "k", "role", "text").groupBy(*by).cogroup(chunks.groupBy(*by)).applyInPandas(rewritten, line if digest else turn)
    if not digest:
        offset = made.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        from pyspark.sql import Window

        ahead = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = offset.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("block").alias("b"), ahead.alias("ahead"))
        placed = made.join(at, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")))
        return placed.select("conv_id", (F.col("ahead") + F.col("k")).alias("place"), "edit", "role", "text")
    schema = pa.schema([("conv_id", _arrow(conv)), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, state, audit, begun = None, None, [], False
        for batch in batches:
            for conv_id, _, _, chunk, total, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None:
                    key, state, audit, begun = conv_id, hashlib.sha256(), [], False
                state.update(lines if begun else lines[1:])  # no line break before the first line
                begun = begun or bool(lines)
                audit.append(chunk)
                if total is not None:
                    yield key, *total, "".join(audit), state.hexdigest()
                    state = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(hashed(batches), schema)

    return made.repartition(C.partitions(turns), "conv_id").sortWithinPartitions(*by).mapInArrow(run, f"conv_id {conv}, {_COUNTS}, repaired_sha256 string")


def _repaired(turns: DataFrame, digest: bool, long_turns: int, long_bytes: int, block: int) -> DataFrame:
    conv = dict(turns.dtypes)["conv_id"]
    if conv not in ("bigint", "int", "string"):
        raise ValueError(f"conv_id of type {conv}")
    flagged = _flags(turns)
    sizes = turns.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * (F.octet_length("role") + F.octet_length("text"))).alias("bytes"))
    long = C.durable(sizes.filter((F.col("n") > long_turns) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("long_id")))
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    if long.isEmpty():
        return _short(flagged, conv, digest)
    return _short(flagged.join(long, is_long, "left_anti"), conv, digest).unionByName(_long(flagged.filter("copies > 0").join(long, is_long, "left_semi"), conv, digest, block))


def repair(turns: DataFrame, long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    ``turns`` as turns_of(); a row of no copies only says that there is such a conversation.
    """
    return _repaired(turns, True, long_turns, long_bytes, block)


def repaired_turns(turns: DataFrame, long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES, block: int = BLOCK) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of every repaired conversation, in order."""
    return _repaired(turns, False, long_turns, long_bytes, block)


def damaged(df: DataFrame) -> DataFrame:
    """The query's own faults: turns lost, emptied, without stops, repeated or given to the user, by checksum of their names."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(20))
    told = df.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return turns_of(told.select("conv_id", "turn", role.alias("role"), text.alias("text"), "fault"), copies=copies)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every conversation of ``conversations`` after damaged()."""
    return repair(damaged(C.table(spark, sf_dir, "conversations")))
