"""A9 to A13: alleles to calls. Alleles of the haplotypes are paired, reads of other haplotypes and clipped reads added.

Supporting reads stay a long table (call_id, win_id, read_name, hp). Only the pairing itself is a loop; it sees a cluster's
alleles, never its signals: an allele's mean length is nearly twice that of the one before, so they are a few dozen at most.
Clips are dealt by read, as the fate of a read's clips depends on no other read: a crowded cluster is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params

#: Least ratio of lengths at which alleles of two haplotypes are one variant, and at which another read's signal joins it.
SAME, ALIKE = 0.9, 0.7
#: Rows after which a task hands on what it has made.
SOLVED = 10_000


def _ratio(x: float, y: float) -> float:
    return min(x, y) / max(x, y) if max(x, y) > 0 else 0.0


def _free_mate(own: dict, others: list[dict], taken: set, fenced: bool) -> dict | None:
    """The first allele not taken of about the same length and, if ``fenced``, with an overlapping fence."""
    for other in others:
        if other["allele"] not in taken and _ratio(own["size"], other["size"]) > SAME:
            if not fenced or max(own["low"], other["low"]) <= min(own["high"], other["high"]):
                taken.add(other["allele"])
                return other
    return None


def _pairs(by_hp: dict[int, list[dict]]) -> Iterator[tuple[dict, dict | None, str]]:
    """(allele, its mate or none, genotype) in the order in which calls are made."""
    taken: dict[int, set] = {0: set(), 1: set(), 2: set()}
    for hp, mates in ((1, ((2, "1|1"), (0, "1|0"))), (2, ((0, "0|1"),))):
        for own in by_hp[hp]:
            if own["allele"] in taken[hp]:
                continue
            for mate_hp, gt in mates:
                mate = _free_mate(own, by_hp[mate_hp], taken[mate_hp], True)
                if mate is not None:
                    yield own, mate, gt
                    break
            else:
                yield own, None, "1|0" if hp == 1 else "0|1"
    for own in by_hp[0]:
        if own["allele"] not in taken[0]:
            yield own, None, ".|."


def _solved(rows: DataFrame, solve: Callable[[list[dict]], Iterator[dict]], kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
    """What ``solve`` makes of the rows of each ``win_id``, cluster after cluster of a sorted partition.

    Clusters have a few rows each, so one costs what its rows cost: many of them come and go in one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_schema, out = pa.schema(list(kinds.items())), []
        for _, own in groupby((row for batch in batches for row in batch.to_pylist()), key=lambda row: row["win_id"]):
            out += solve(list(own))
            if len(out) >= SOLVED:
                yield pa.RecordBatch.from_pylist(out, own_schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, own_schema)

    return rows.repartition("win_id").sortWithinPartitions("win_id").mapInArrow(run, schema)


def pair_haplotypes(alleles: DataFrame) -> DataFrame:
    """(win_id, turn, hp, allele, mate_hp, mate, gt) for alleles (win_id, hp, allele, n_signals, size, low, high)."""

    def one(rows: list[dict]) -> Iterator[dict]:
        ordered = sorted(rows, key=lambda x: (-x["n_signals"], x["allele"]))
        for turn, (own, mate, gt) in enumerate(_pairs({hp: [x for x in ordered if x["hp"] == hp] for hp in (0, 1, 2)})):
            yield {"win_id": own["win_id"], "turn": turn, "hp": own["hp"], "allele": own["allele"], "mate_hp": mate and mate["hp"], "mate": mate and mate["allele"], "gt": gt}

    kinds = {"win_id": pa.string(), **dict.fromkeys(("turn", "hp", "allele", "mate_hp", "mate"), pa.int32()), "gt": pa.string()}
    rows = alleles.select("win_id", F.col("hp").cast("int").alias("hp"), F.col("allele").cast("int").alias("allele"), "n_signals", "size", "low", "high")
    return _solved(rows, one, kinds, "win_id string, turn int, hp int, allele int, mate_hp int, mate int, gt string")


def merge_haplotypes_indel(chained: DataFrame, stats: DataFrame, need: DataFrame, p: Params = Params(), mode: str = "germline") -> tuple[DataFrame, DataFrame]:
    """Calls and their support from alleles by haplotype (A11).

    ``chained`` has the signals with hp and allele, ``stats`` the alleles that passed their own test, with ``ins_seq``;
    ``need`` (win_id, least) the signals that an unpaired allele is measured by.
    """
    germline = mode == "germline"
    size = F.col("avg_len") if germline else F.floor("avg_len").cast("double")
    able = stats.select("*", size.alias("size"), F.col("fence_low").alias("low"), F.col("fence_high").alias("high"), F.floor("avg_pos").alias("pos"))
    paired = pair_haplotypes(able)
    one = able.select("win_id", "hp", "allele", *(F.col(c).alias(f"a_{c}") for c in ("n_signals", "size", "low", "high", "pos", "min_pos", "max_pos", "ins_seq")), "cipos", "cilen")
    two = able.select("win_id", F.col("hp").alias("mate_hp"), F.col("allele").alias("mate"), *(F.col(c).alias(f"b_{c}") for c in ("n_signals", "size", "low", "high", "pos", "min_pos", "max_pos", "ins_seq")))
    both = paired.join(one, ["win_id", "hp", "allele"]).join(two, ["win_id", "mate_hp", "mate"], "left").join(need, "win_id")
    has = F.col("mate").isNotNull()
    merged_size = F.when(has, (F.col("a_size") + F.col("b_size")) / 2).otherwise(F.col("a_size"))
    longer = F.when(has & (F.length("a_ins_seq") <= F.length("b_ins_seq")), F.col("b_ins_seq")).otherwise(F.col("a_ins_seq"))
    count = lambda h: F.when(F.col("hp") == h, F.col("a_n_signals")).when(F.col("mate_hp") == h, F.col("b_n_signals")).otherwise(0).cast("int")
    calls = both.select(
        F.concat_ws("/", "win_id", F.lit("h"), "turn").alias("call_id"),
        "win_id",
        "turn",
        "hp",
        "allele",
        "mate_hp",
        "mate",
        "gt",
        "least",
        "a_n_signals",
        merged_size.alias("size"),
        F.least("a_low", "b_low").alias("low"),
        F.greatest("a_high", "b_high").alias("high"),
        F.when(has, F.floor((F.col("a_pos") + F.col("b_pos")) / 2)).otherwise(F.col("a_pos")).cast("long").alias("pos"),
        F.least("a_min_pos", "b_min_pos").cast("long").alias("min_pos"),
        F.greatest("a_max_pos", "b_max_pos").cast("long").alias("max_pos"),
        F.when(has, longer.substr(F.lit(1), F.floor(merged_size).cast("int"))).otherwise(F.col("a_ins_seq")).alias("ins_seq"),
        "cipos",
        "cilen",
        *(count(h).alias(f"s{h}") for h in (0, 1, 2)),
    )
    alone = F.col("mate").isNull()
    half = F.floor(F.col("least") / 2)
    calls = calls.filter(~alone | (F.col("hp") == 0) | (F.col("a_n_signals") >= half))
    ends = F.array(F.struct("hp", "allele"), F.struct(F.col("mate_hp").alias("hp"), F.col("mate").alias("allele")))
    own = calls.select("call_id", "win_id", F.inline(ends)).join(chained.select("win_id", "hp", "allele", "read_name"), ["win_id", "hp", "allele"]).select("call_id", "win_id", "read_name", "hp").distinct()
    # reads of the haplotypes that the call doesn't name, by the length of their signals; a call of untagged reads takes none
    others = chained.select("win_id", "read_name", F.col("hp").alias("other_hp"), "len")
    fits = (F.col("len") >= F.col("low")) & (F.col("len") <= F.col("high")) & (F.least("len", "size") / F.greatest("len", "size") > ALIKE)
    foreign = (F.col("other_hp") != F.col("hp")) & ~F.col("other_hp").eqNullSafe(F.col("mate_hp")) & (F.col("hp") != 0)
    near = calls.select("call_id", "win_id", "hp", "mate_hp", "low", "high", "size").join(others, "win_id").filter(foreign & fits)
    near = near.join(own.select("call_id", "read_name"), ["call_id", "read_name"], "left_anti")
    added = near.groupBy("call_id", "win_id", "read_name", F.col("other_hp").alias("hp")).agg(F.count(F.lit(1)).alias("n"))
    more = added.groupBy("call_id").agg(*(F.sum(F.when(F.col("hp") == h, F.col("n")).otherwise(0)).cast("int").alias(f"m{h}") for h in (0, 1, 2)))
    # untagged alleles of their own need enough reads that no other call has taken
    spent = added.filter("hp = 0").select("win_id", "read_name").distinct()
    lone = own.join(calls.filter("hp = 0").select("call_id"), "call_id", "left_semi").join(spent, ["win_id", "read_name"], "left_anti")
    left = lone.groupBy("call_id").agg(F.count(F.lit(1)).cast("int").alias("unspent"))
    calls = calls.join(more, "call_id", "left").join(left, "call_id", "left")
    calls = calls.filter((F.col("hp") != 0) | ((F.col("a_n_signals") >= F.col("least")) & (F.col("unspent") >= F.col("least"))))
    if germline:
        calls = calls.filter(F.col("high") >= p.min_size)
    counts = [F.when(F.col("hp") == 0, F.col("unspent") if h == 0 else F.lit(0)).otherwise(F.col(f"s{h}") + F.coalesce(f"m{h}", F.lit(0))).cast("int").alias(f"s{h}") for h in (0, 1, 2)]
    calls = calls.select("call_id", "win_id", "turn", "gt", "size", "pos", "min_pos", "max_pos", "cipos", "cilen", F.lit("<INS>").alias("ins_seq") if not germline else F.col("ins_seq"), *counts)
    support = own.join(calls.filter("gt <> '.|.'").select("call_id"), "call_id", "left_semi").unionByName(lone).unionByName(added.select("call_id", "win_id", "read_name", "hp"))
    return calls, support.join(calls.select("call_id"), "call_id", "left_semi")


def rescue_clips(calls: DataFrame, support: DataFrame, clips: DataFrame) -> DataFrame:
    """(call_id, win_id, read_name, hp): clipped reads that join a call (A10).

    ``calls`` (call_id, win_id, rank, c_low, c_high, both_sides, haplotypes or null, rescue) are served in order of rank.
    A clip is used once, of equal rows each; a read that supports this or an earlier call by its signals is skipped. ``clips`` as clips_in_window().
    """
    open_ = calls.filter("rescue").select("call_id", "win_id", "rank", "c_low", "c_high", "both_sides", "haplotypes")
    known = support.join(calls.select("call_id", "rank"), "call_id").groupBy("win_id", "read_name").agg(F.min("rank").alias("known"))
    inside = (F.col("pos") > F.col("c_low")) & (F.col("pos") < F.col("c_high")) & (F.col("both_sides") | (F.col("side") == 1))
    able = inside & (F.col("haplotypes").isNull() | F.array_contains("haplotypes", F.col("hp").cast("int")))
    met = clips.join(open_, "win_id").filter(able).join(known, ["win_id", "read_name"], "left").filter(F.col("known").isNull() | (F.col("rank") < F.col("known")))
    asks = met.groupBy("win_id", "read_name").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "side", F.col("hp").cast("int").alias("hp"), "call_id"))).alias("asks"))
    clip = "pos:bigint,side:int,hp:int,copy:int"
    kind = f"struct<rank:int,before:struct<rank:int,{clip}>,used:array<struct<{clip}>>,out:array<struct<call_id:string,hp:int>>>"
    none = F.array()
    start = F.struct(F.lit(-1).alias("rank"), F.lit(None).alias("before"), none.alias("used"), none.alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        # equal clips of one call stand side by side: the second is another clip
        again = (acc["before"]["rank"] == x["rank"]) & (acc["before"]["pos"] == x["pos"]) & (acc["before"]["side"] == x["side"]) & (acc["before"]["hp"] == x["hp"])
        own = [x["pos"].cast("long").alias("pos"), x["side"].cast("int").alias("side"), x["hp"].alias("hp"), F.when(F.coalesce(again, F.lit(False)), acc["before"]["copy"] + 1).otherwise(0).alias("copy")]
        take = (x["rank"] != acc["rank"]) & ~F.array_contains(acc["used"], F.struct(*own))
        before = F.struct(x["rank"].alias("rank"), *own).alias("before")
        taken = F.struct(x["rank"].alias("rank"), before, F.concat(acc["used"], F.array(F.struct(*own))).alias("used"), F.concat(acc["out"], F.array(F.struct(x["call_id"].alias("call_id"), x["hp"].alias("hp")))).alias("out"))
        return F.when(take, taken).otherwise(F.struct(acc["rank"].alias("rank"), before, acc["used"].alias("used"), acc["out"].alias("out"))).cast(kind)

    return asks.select("win_id", "read_name", F.inline(F.aggregate("asks", start, step, lambda acc: acc["out"]))).select("call_id", "win_id", "read_name", "hp")


def ranked(calls: DataFrame, *order: Column | str) -> DataFrame:
    """``calls`` with rank, 0 for the call of a cluster that is served first."""
    return calls.withColumn("rank", (F.row_number().over(Window.partitionBy("win_id").orderBy(*order)) - 1).cast("int"))


def dp_insert_sequence(members: DataFrame, bases: DataFrame) -> DataFrame:
    """(win_id, allele, ins_len, ins_seq) of alleles of the dynamic program (A9).

    The bases of each read are joined; lengths within a fence about their middle are averaged, and the shortest read of at
    least that length, cut to it, is the sequence. ``members`` as allele_dp(), ``bases`` (win_id, read_name, pos, len, ins_seq).
    """
    # of several insertions of a read at one position the longest stands for each of them
    text = bases.groupBy("win_id", "read_name", F.col("pos").cast("long").alias("pos")).agg(F.max(F.struct("len", "ins_seq"))["ins_seq"].alias("ins_seq"))
    read = members.join(text, ["win_id", "read_name", "pos"]).groupBy("win_id", "allele", "read_name").agg(F.array_sort(F.collect_list(F.struct("pos", "len", "ins_seq"))).alias("all"))
    whole = read.select("win_id", "allele", "read_name", F.array_join(F.transform("all", lambda x: x["ins_seq"]), "").alias("seq"))
    whole = whole.withColumn("n", F.length("seq"))
    q = whole.groupBy("win_id", "allele").agg(F.expr("percentile(n, 0.2)").alias("q1"), F.expr("percentile(n, 0.8)").alias("q3"))
    far = 1.5 * (F.col("q3") - F.col("q1"))
    inner = F.when((F.col("n") >= F.col("q1") - far) & (F.col("n") <= F.col("q3") + far), F.col("n"))
    mean = whole.join(q, ["win_id", "allele"]).groupBy("win_id", "allele").agg(F.floor(F.coalesce(F.avg(inner), F.avg("n"))).alias("ins_len"))
    long = whole.join(mean, ["win_id", "allele"]).filter(F.col("n") >= F.col("ins_len"))
    best = long.groupBy("win_id", "allele").agg(F.min(F.struct("n", "read_name", F.col("seq").substr(F.lit(1), F.col("ins_len").cast("int")).alias("seq"))).alias("best"))
    return mean.join(best, ["win_id", "allele"], "left").select("win_id", "allele", "ins_len", F.coalesce("best.seq", F.lit("<INS>")).alias("ins_seq"))


def _two_breakpoint_pairs(rows: list[dict], mosaic: bool) -> list[tuple[dict, list[dict], str, float, float]]:
    """(lead, members, genotype, first breakpoint, length) of a cluster's alleles of duplications or inversions."""
    by_hp = {hp: [dict(x, size=float(x["size"]), high=0.0, low=0.0) for x in rows if x["hp"] == hp] for hp in (0, 1, 2)}
    taken: dict[int, set] = {0: set(), 1: set(), 2: set()}
    out = []

    def joined(own: dict, other: dict, gt: str) -> None:
        own["bp1"], own["size"] = (own["bp1"] + other["bp1"]) / 2, float(int((own["size"] + other["size"]) / 2))
        if mosaic:
            own["bp1"] = float(int(own["bp1"]))
        own["members"] = [*own.get("members", [own]), other]
        own["gt"] = gt

    for own in by_hp[1]:
        mate = _free_mate(own, by_hp[2], taken[2], False)
        if mate is not None:
            joined(own, mate, own["gt"][0] + "|" + mate["gt"][2] if mosaic else "1|1")
        other = _free_mate(own, by_hp[0], taken[0], False) if mosaic else None
        if other is not None:
            joined(own, other, own["gt"][0] + "|.")
        if mate is not None or other is not None or own["n_reads"] >= own["least"]:
            out.append(own)
    for own in by_hp[2]:
        other = _free_mate(own, by_hp[0], taken[0], False) if mosaic else None
        if other is not None:
            joined(own, other, ".|" + other["gt"][2])
        if other is not None or (own["allele"] not in taken[2] and own["n_reads"] >= own["least"]):
            out.append(own)
    out += [own for own in by_hp[0] if own["allele"] not in taken[0] and own["n_reads"] >= own["least_untagged"]]
    return [(own, own.get("members", [own]), own["gt"], own["bp1"], own["size"]) for own in out]


def merge_haplotypes_two_breakpoints(alleles: DataFrame, mosaic: bool = False) -> DataFrame:
    """(win_id, turn, hp, allele, gt, bp1, size, dv, members) of duplications or inversions (A12; ``mosaic``: A13).

    ``alleles`` (win_id, hp, allele, n_reads, bp1, size, gt, least, least_untagged): of each haplotype, with its revised
    genotype. One allele a row and some dozen reads in each, so a cluster's group is a small part of its signals.
    """

    def one(rows: list[dict]) -> Iterator[dict]:
        made = _two_breakpoint_pairs(sorted(rows, key=lambda x: (x["hp"], x["allele"])), mosaic)
        for turn, (own, members, gt, bp1, size) in enumerate(made):
            named = [{"hp": m["hp"], "allele": m["allele"]} for m in members]
            yield {"win_id": own["win_id"], "turn": turn, "hp": own["hp"], "allele": own["allele"], "gt": gt, "bp1": int(bp1), "size": int(size), "dv": sum(m["n_reads"] for m in members), "members": named}

    whole, few = pa.int64(), pa.int32()
    kinds = {"win_id": pa.string(), "turn": few, "hp": few, "allele": few, "gt": pa.string(), "bp1": whole, "size": whole, "dv": whole, "members": pa.list_(pa.struct([("hp", few), ("allele", few)]))}
    rows = alleles.select("win_id", F.col("hp").cast("int").alias("hp"), F.col("allele").cast("int").alias("allele"), "n_reads", F.col("bp1").cast("double").alias("bp1"), F.col("size").cast("double").alias("size"), "gt", "least", "least_untagged")
    return _solved(rows, one, kinds, "win_id string, turn int, hp int, allele int, gt string, bp1 long, size long, dv long, members array<struct<hp:int,allele:int>>")
