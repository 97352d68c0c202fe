"""X: signals from the segments of a split read. Every rule is an expression over a read's own array; no shuffle.

Segments come in read order. A window is a segment with the next two, where there are any. Same-strand segments on the
minus strand are read backwards, so that all rules hold in plus-strand coordinates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement_of_few
from ..params import Params
from .keys import sample


@dataclass
class Pair:
    """Two neighbours in plus-strand coordinates: read end, reference start and end of the first, all of the second."""

    end1: Column
    ref_start1: Column
    ref_end1: Column
    start2: Column
    ref_start2: Column
    ref_end2: Column
    chrom: Column
    minus: Column

    @property
    def d(self) -> Column:
        return self.ref_start2 - self.ref_end1

    @property
    def r(self) -> Column:
        return self.start2 - self.end1


def plus(x: Column, y: Column, read_len: Column, minus: Column | None = None) -> Pair:
    """x and y, x first in the read, as a pair in plus-strand coordinates."""
    back = x["strand"] == "-" if minus is None else minus
    pick = lambda name: (F.when(back, y[name]).otherwise(x[name]), F.when(back, x[name]).otherwise(y[name]))
    (s1, s2), (e1, e2) = pick("ref_start"), pick("ref_end")
    return Pair(F.when(back, read_len - y["read_start"]).otherwise(x["read_end"]), s1, e1, F.when(back, read_len - x["read_end"]).otherwise(y["read_start"]), s2, e2, y["chrom"], back)


def _signal(rule: str, svtype: str, chrom: Column, pos: Column, **more: Column) -> Column:
    null = F.lit(None)
    kinds = {"len": "bigint", "pos2": "bigint", "chrom2": "string", "strand": "string", "bnd_type": "string", "side": "int", "query_pos": "bigint", "minus": "boolean"}
    return F.struct(F.lit(rule).alias("rule"), F.lit(svtype).alias("svtype"), chrom.alias("chrom"), pos.cast("double").alias("pos"), *(more.get(k, null).cast(t).alias(k) for k, t in kinds.items()))


def _fits(n: Column, p: Params) -> Column:
    return n >= p.min_size if p.max_size == -1 else (n >= p.min_size) & (n <= p.max_size)


def dup(x: Pair, rule: str, p: Params) -> tuple[Column, Column]:
    cond = (-x.d >= p.min_size) & (-x.d / 5 > F.abs(x.r))
    return cond, _signal(rule, "DUP", x.chrom, x.ref_start2, pos2=x.ref_end1)


def ins(x: Pair, rule: str, p: Params, forward: bool = True) -> tuple[Column, Column]:
    delta = x.r - x.d
    cond = (-x.d < F.greatest(F.lit(p.min_size), delta / 5)) & _fits(delta, p) & (x.d <= F.greatest(F.lit(100), delta / 5))
    if forward:
        cond &= x.ref_end2 > x.ref_end1
    half = F.when(x.d >= 0, F.floor(x.d / 2)).otherwise(F.ceil(x.d / 2))
    return cond, _signal(rule, "INS", x.chrom, (x.ref_start2 + x.ref_end1) / 2, len=delta, query_pos=F.greatest(x.end1 + half, F.lit(0)), minus=x.minus)


def deletion(x: Pair, rule: str, p: Params) -> tuple[Column, Column]:
    delta = x.d - x.r
    cond = (-x.d < F.greatest(F.lit(p.min_size), delta / 5)) & _fits(delta, p) & (x.r <= F.greatest(F.lit(100), delta / 5))
    return cond, _signal(rule, "DEL", x.chrom, x.ref_end1, len=delta)


def inversion(x: Column, y: Column, p: Params) -> tuple[Column, Column]:
    """Two segments on opposite strands of one chromosome."""
    head = x["strand"] == "+"
    a, b = (F.when(head, s["ref_end"]).otherwise(s["ref_start"]) for s in (x, y))
    size = F.abs(b - a)
    cond = (x["strand"] != y["strand"]) & (size >= p.min_size) & (y["read_start"] + 0.5 * size >= x["read_end"])
    return cond, _signal("X4", "INV", x["chrom"], F.least(a, b), pos2=F.greatest(a, b), strand=F.when(head, "++").otherwise("--"))


def translocation(x: Column, y: Column) -> tuple[Column, Column]:
    """Neighbours read across chromosomes; the chromosome that comes first as text is the first breakpoint."""
    fore1, fore2, low = x["strand"] == "+", y["strand"] == "+", x["chrom"] < y["chrom"]
    at1 = F.when(fore1, x["ref_end"]).otherwise(x["ref_start"])
    at2 = F.when(fore2, y["ref_start"]).otherwise(y["ref_end"])
    kind = F.when(fore1 & fore2, F.when(low, "A").otherwise("D")).when(fore1, "B").when(fore2, "C").otherwise(F.when(low, "D").otherwise("A"))
    pick = lambda u, v: F.when(low, u).otherwise(v)
    return y["read_start"] - x["read_end"] <= 100, _signal("X7", "TRA", pick(x["chrom"], y["chrom"]), pick(at1, at2), chrom2=pick(y["chrom"], x["chrom"]), pos2=pick(at2, at1), bnd_type=kind)


def _window_signals(e1: Column, e2: Column, e3: Column, a: Column, n: Column, length: Column, p: Params) -> list[tuple[Column, Column]]:
    """All rules but those across chromosomes: (condition, signal)."""
    two, last = n == 2, a == n - 3
    on = e1["chrom"] == e2["chrom"]
    three = F.coalesce((n > 2) & on & (e2["chrom"] == e3["chrom"]), F.lit(False))
    s1, s2, s3 = e1["strand"], e2["strand"], e3["strand"]
    made: list[tuple[Column, Column]] = []

    def add(when: Column, rule: tuple[Column, Column]) -> None:
        made.append((when & rule[0], rule[1]))

    # two segments
    pair = plus(e1, e2, length)
    alike = two & on & (s1 == s2)
    for rule in (dup(pair, "X1", p), ins(pair, "X2", p), deletion(pair, "X3", p)):
        add(alike, rule)
    low, high = F.least(pair.d, pair.r), F.greatest(pair.d, pair.r)
    gap = alike & _fits(pair.d, p) & _fits(pair.r, p) & (low / high > 0.9)
    made += [(gap, _signal("P9", "CLIP", pair.chrom, pos, side=F.lit(2))) for pos in (pair.ref_end1, pair.ref_start2)]
    add(two & on, inversion(e1, e2, p))
    # three on one strand: backwards, the last pair of the read is the first of the triple
    same = three & (s1 == s2) & (s2 == s3)
    back = s1 == "-"
    fore, rear = plus(e1, e2, length), plus(e2, e3, length)
    mix = lambda u, v: Pair(*(F.when(back, getattr(v, k)).otherwise(getattr(u, k)) for k in Pair.__dataclass_fields__))
    first, second = mix(fore, rear), mix(rear, fore)
    made_dup = dup(second, "X1", p)
    add(same & (second.ref_start1 < second.ref_end2), made_dup)
    add(same & (a == 0), dup(first, "X1", p))
    follows = F.when(back, e1["ref_start"]).otherwise(e3["ref_start"]) >= first.ref_end2
    add(same & follows, ins(first, "X2", p))
    add(same & follows, deletion(first, "X3", p))
    add(same & last, ins(second, "X2", p))
    add(same & last, deletion(second, "X3", p))
    # three with the middle turned round
    turned = three & (s1 == s3) & (s1 != s2)
    width = e3["ref_start"] - e1["ref_end"]
    inside = turned & (s2 == "-") & (e2["read_start"] + 0.5 * width >= e1["read_end"]) & (e3["read_start"] + 0.5 * width >= e2["read_end"]) & (e2["ref_start"] >= e1["ref_end"]) & (e3["ref_start"] >= e2["ref_end"])
    made.append((inside, _signal("X5", "INV", e1["chrom"], e1["ref_end"], pos2=e2["ref_end"], strand=F.lit("++"))))
    made.append((inside, _signal("X5", "INV", e1["chrom"], e2["ref_start"], pos2=e3["ref_start"], strand=F.lit("--"))))
    width = e1["ref_start"] - e3["ref_end"]
    inside = turned & (s2 == "+") & (e2["read_start"] + 0.5 * width >= e1["read_end"]) & (e3["read_start"] + 0.5 * width >= e2["read_end"]) & (e2["ref_start"] - e3["ref_end"] >= -50) & (e1["ref_start"] - e2["ref_end"] >= -50)
    made.append((inside, _signal("X5", "INV", e1["chrom"], e3["ref_end"], pos2=e2["ref_end"], strand=F.lit("++"))))
    made.append((inside, _signal("X5", "INV", e1["chrom"], e2["ref_start"], pos2=e1["ref_start"], strand=F.lit("--"))))
    # three with one end turned round
    ends = three & last & (s1 != s3)
    add(ends & (s2 == s1), inversion(e2, e3, p))
    add(ends & (s2 != s1), inversion(e1, e2, p))
    for rule in (ins(plus(e1, e2, length), "X8", p, forward=False), deletion(plus(e1, e2, length), "X8", p)):
        add(three & (s1 == s2) & (s2 != s3), rule)
    # at the end of the read; on the minus strand this pair takes its coordinates from the one before it
    tail = three & last & (s1 != s2) & (s2 == s3)
    for minus, odd in ((F.lit(False), plus(e2, e3, length, F.lit(False))), (F.lit(True), plus(e1, e2, length, F.lit(True)))):
        for rule in (ins(odd, "X8", p, forward=False), deletion(odd, "X8", p)):
            add(tail & ((s2 == "-") == minus), rule)
    return made


def _as_array(made: list[tuple[Column, Column]]) -> Column:
    return F.filter(F.array(*(F.when(cond, signal) for cond, signal in made)), lambda x: x.isNotNull())


def split_signals(split: DataFrame, p: Params = Params(), strict_last_pair: bool = False) -> DataFrame:
    """(read_name, hp, rule, svtype, chrom, pos, ...) of reads with ``segs`` and ``read_len``.

    A read with more parts than allowed has none. A change of chromosome counts only before the last pair of three or more
    segments, unless ``strict_last_pair``. Where ``query_seq`` is given, insertions have their bases as ``ins_seq``.
    """
    n, who = F.size("segs"), [*sample(split), "read_name", "hp"]
    able = split.filter(n >= 2) if p.max_split_parts == -1 else split.filter((n >= 2) & (n <= p.max_split_parts))
    seq = ["query_seq"] if "query_seq" in split.columns else []
    change = F.exists(F.sequence(F.lit(1), n - 1 if strict_last_pair else F.greatest(n - 2, F.lit(1))), lambda k: F.get("segs", k - 1)["chrom"] != F.get("segs", k)["chrom"])
    # what is looked at of a read: every window, and after a change of chromosome both ends together and every pair
    look = lambda kind, first, last: F.transform(F.sequence(first, last), lambda a: F.struct(F.lit(kind).alias("kind"), a.alias("a")))
    none = F.array().cast("array<struct<kind:string,a:int>>")
    moved = F.concat(look("ends", F.lit(0), F.lit(0)), look("pair", F.lit(0), n - 2))
    looks = F.concat(look("window", F.lit(0), F.greatest(n - 3, F.lit(0))), F.when(change, moved).otherwise(none))
    at = able.select(*who, *seq, "read_len", "segs", n.alias("n"), F.inline(looks))
    ends = F.col("kind") == "ends"
    seg = lambda k: F.get("segs", F.col("a") + k)
    flat = at.select(
        *who, *seq, "read_len", "n", "a", "kind", seg(0).alias("e1"), F.when(ends, F.element_at("segs", -1)).otherwise(seg(1)).alias("e2"), F.when(F.col("kind") == "window", seg(2)).alias("e3"), F.get("segs", F.lit(0)).alias("head"), F.element_at("segs", -1).alias("tail")
    )
    whole = plus(F.col("head"), F.col("tail"), F.col("read_len"))
    outer = (F.col("n") >= 3) & (F.col("head.chrom") == F.col("tail.chrom")) & (F.col("head.strand") == F.col("tail.strand"))
    delta = whole.r - whole.d
    inserted = outer & (F.abs(whole.d) <= 100) & _fits(delta, p) & (whole.ref_end2 > whole.ref_end1)
    doubled = outer & ~inserted & (-whole.d >= p.min_size) & (F.abs(whole.r) < p.min_size)
    half = F.when(whole.d >= 0, F.floor(whole.d / 2)).otherwise(F.ceil(whole.d / 2))
    across = [
        (inserted, _signal("X6", "INS", whole.chrom, (whole.ref_start2 + whole.ref_end1) / 2, len=delta, query_pos=F.greatest(whole.end1 + half, F.lit(0)), minus=whole.minus)),
        (doubled, _signal("X6", "DUP", whole.chrom, whole.ref_start2, pos2=whole.ref_end1)),
    ]
    step = translocation(F.col("e1"), F.col("e2"))
    found = F.when(F.col("kind") == "window", _as_array(_window_signals(F.col("e1"), F.col("e2"), F.col("e3"), F.col("a"), F.col("n"), F.col("read_len"), p)))
    found = found.when(ends, _as_array(across)).otherwise(_as_array([(~F.coalesce(inserted | doubled, F.lit(False)) & step[0], step[1])]))
    made = flat.select(*who, *seq, F.inline(found))
    if not seq:
        return made
    # an insertion's bases are cut where the read's still are in the row
    return made.withColumn("ins_seq", F.when(F.col("svtype") == "INS", insert_bases(F.col("query_seq"), F.col("query_pos"), F.col("len"), F.col("minus")))).drop("query_seq")


def insert_bases(seq: Column, query_pos: Column, length: Column, minus: Column) -> Column:
    """Bases of a split-read insertion, from the read or its reverse complement."""
    # on the minus strand the same bases are counted from the other end, and only they are turned round
    first = F.length(seq) - query_pos - length
    back = seq.substr((F.greatest(first, F.lit(0)) + 1).cast("int"), F.greatest(length + F.least(first, F.lit(0)), F.lit(0)).cast("int"))
    return F.when(minus, reverse_complement_of_few(back)).otherwise(seq.substr((query_pos + 1).cast("int"), length.cast("int")))
