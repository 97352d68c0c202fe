"""The whole caller over plain rows, one step after another, without bins, joins or arrays: what the jobs are held against.

Alleles of the dynamic program come from the library's own solver, which has slow versions of its own in test_alleles.py.
"""

import math

import numpy as np

from phaseloom.operators.allele_dp import solve


def chains(rows, order, far):
    """Lists of neighbours in order; a new one begins where far(before, row)."""
    out = []
    for row in sorted(rows, key=order):
        if not out or far(out[-1][-1], row):
            out.append([])
        out[-1].append(row)
    return out


def ratio(x, y):
    return min(x, y) / max(x, y) if max(x, y) > 0 else 0


def interval(values):
    x = math.floor(1.96 * float(np.std(values)) / math.sqrt(len(values)))
    return f"-{x},{x}"


def likelihood(dr, dv):
    """(gt, pl, gq, qual)"""
    if (dr, dv) in ((3, 1), (6, 2)):
        return "0/1", "3,3,24" if dr == 3 else "3,3,45", 3, 3.0
    n, r, v = dr + dv, dr, dv
    if n > 100:
        r = int(100 * (dr / n))
        v = 100 - r
    logs = [r * math.log10(0.9) + v * math.log10(0.1), (r + v) * math.log10(0.5), r * math.log10(0.1) + v * math.log10(0.9)]
    top = max(logs)
    total = top + math.log10(sum(10 ** (x - top) for x in logs))
    p = [min(x - total, 0.0) for x in logs]
    gq = max(math.floor(-10 * math.log10(sum(10**x for k, x in enumerate(p) if k != j))) for j in range(3))
    return ("0|0", "0/1", "1|1")[p.index(max(p))], ",".join(str(round(-10 * x)) for x in p), gq, abs(round(-10 * p[0], 1))


def overlapping(reads, chrom, low, high, primary=False):
    """{name: haplotype}, of a name's rows a primary one, then the first."""
    met = sorted((1 - r["is_primary"], r["ref_start"], r["ref_end"], r["hp"], r["read_name"]) for r in reads if r["chrom"] == chrom and r["ref_start"] < high and r["ref_end"] > low and (r["is_primary"] or not primary))
    out = {}
    for _, _, _, hp, name in met:
        out.setdefault(name, hp)
    return out


def covering(reads, chrom, low, high):
    return {r["read_name"]: r["hp"] for r in reads if r["chrom"] == chrom and r["is_primary"] and r["ref_start"] <= low and r["ref_end"] >= high}


def balanced(reads, chrom, window, svtype, mode):
    """(whether, depth)"""
    met = overlapping(reads, chrom, *window)
    h0, h1, h2 = (sum(x == k for x in met.values()) for k in (0, 1, 2))
    low, high, apart = min(h1, h2), max(h1, h2), abs(h1 - h2)
    if svtype == "DUP":
        return h0 + apart < 4 * low or apart < h0 < h1 + h2, len(met)
    if mode == "mosaic" and svtype in ("DEL", "INS"):
        return h0 + apart < (h1 + h2) / 2 or apart < h0 < high, len(met)
    return h0 + apart < low or apart < h0 < high, len(met)


def by_length(rows, limit):
    out, mean = [], None
    for row in sorted(rows, key=lambda r: (r["len"], r["pos"], r["read_name"])):
        if mean is None or row["len"] - mean > limit * mean:
            out.append([])
        out[-1].append(row)
        mean = sum(r["len"] for r in out[-1]) / len(out[-1])
    return out


def call(svtype, chrom, **more):
    return {"svtype": svtype, "chrom": chrom, **more}


def against(found, support):
    """Reads that don't support: number, of haplotype 1, of haplotype 2."""
    rest = [hp for name, hp in found.items() if name not in support]
    return len(rest), rest.count(1), rest.count(2)


def genotyped(c, support, found, s1, s2, tight=None):
    """Germline genotype of a call with these reads."""
    dv, (dr, r1, r2) = len(support), against(found, support)
    gt, pl, gq, qual = likelihood(dr, dv)
    if gt == "0/1":
        gt = "1|0" if s1 > s2 else "0|1"
    if tight is not None and dv / (dv + dr) < 0.25 and qual < 20 and not tight:
        qual = 0.0
    p1, p2 = (s / (s + r) if s + r else 0 for s, r in ((s1, r1), (s2, r2)))
    if min(s1 + r1, s2 + r2) > 5:
        gt = "1|0" if p1 > 0.95 and p2 < 0.05 else "0|1" if p2 > 0.95 and p1 < 0.05 else gt
    return c | {"dv": dv, "dr": dr, "gt": gt, "pl": pl, "gq": gq, "qual": qual, "support": set(support)}


def rescued(calls, clips):
    """Give clips to calls in turn; a call: low, high, sides, haplotypes or None, able, support {read: hp}; adds ``more`` [(read, hp)]."""
    used, known = set(), set()
    for c in calls:
        known |= set(c["support"])
        c["more"] = []
        for k, clip in enumerate(clips):
            if not c["able"] or k in used or clip["read_name"] in known or clip["read_name"] in c["support"] or clip["side"] not in c["sides"]:
                continue
            if c["low"] < clip["pos"] < c["high"] and (c["haplotypes"] is None or clip["hp"] in c["haplotypes"]):
                c["support"][clip["read_name"]] = clip["hp"]
                c["more"].append((clip["read_name"], clip["hp"]))
                used.add(k)


def pair_up(alleles, reads_of, need, min_size):
    """Calls of a cluster's alleles by haplotype, each {size, pos, low, high, counts, gt, support, ...}."""
    out, taken, spent = [], {0: set(), 2: set()}, set()

    def take(own, others, hp):
        for k, other in enumerate(others):
            if k not in taken[hp] and ratio(own["size"], other["size"]) > 0.9 and max(own["f0"], other["f0"]) <= min(own["f1"], other["f1"]):
                taken[hp].add(k)
                return other
        return None

    def made(own, mate, gt, foreign):
        both = [own] + ([mate] if mate else [])
        size = sum(x["size"] for x in both) / len(both)
        low, high = min(x["f0"] for x in both), max(x["f1"] for x in both)
        counts = [sum(x["n"] for x in both if x["hp"] == h) for h in (0, 1, 2)]
        support = {r: x["hp"] for x in both for r in x["reads"]}
        for h in foreign:
            extra = [r for r in reads_of if r["hp"] == h and r["read_name"] not in support and low <= r["len"] <= high and ratio(size, r["len"]) > 0.7]
            counts[h] += len(extra)
            support |= {r["read_name"]: h for r in extra}
            if h == 0:
                spent.update(r["read_name"] for r in extra)
        seq = own["seq"] if mate is None else (own if len(own["seq"]) > len(mate["seq"]) else mate)["seq"][: int(size)]
        if min_size is None or high >= min_size:
            pos = own["pos"] if mate is None else int((own["pos"] + mate["pos"]) / 2)
            out.append({"size": size, "pos": pos, "min": min(x["min"] for x in both), "max": max(x["max"] for x in both), "counts": counts, "gt": gt, "support": support, "cipos": own["cipos"], "cilen": own["cilen"], "seq": seq})

    for hp, first in ((1, True), (2, False)):
        for k, own in enumerate(alleles[hp]):
            if not first and k in taken[2]:
                continue
            mate = take(own, alleles[2], 2) if first else None
            if mate:
                made(own, mate, "1|1", (0,))
                continue
            mate = take(own, alleles[0], 0)
            gt = "1|0" if first else "0|1"
            if mate:
                made(own, mate, gt, (3 - hp,))
            elif own["n"] >= need // 2:
                made(own, None, gt, (0, 3 - hp))
    for k, own in enumerate(alleles[0]):
        left = [r for r in own["reads"] if r not in spent]
        if k not in taken[0] and own["n"] >= need and len(left) >= need and (min_size is None or own["f1"] >= min_size):
            out.append({"size": own["size"], "pos": own["pos"], "min": own["min"], "max": own["max"], "counts": [len(left), 0, 0], "gt": ".|.", "support": dict.fromkeys(left, 0), "cipos": own["cipos"], "cilen": own["cilen"], "seq": own["seq"]})
    return out


def best_bases(rows, size):
    return next((r["ins_seq"][:size] for r in rows if r["svtype"] == "INS" and len(r["ins_seq"] or "") >= size), "<INS>")


def balanced_indels(cluster, clips, reads, p, mode, least):
    germline, kind, chrom = mode == "germline", cluster[0]["svtype"], cluster[0]["chrom"]
    alleles = {h: [] for h in (0, 1, 2)}
    for hp in (0, 1, 2):
        for rows in by_length([r for r in cluster if r["hp"] == hp], p.len_ratio):
            pos, size = [r["pos"] for r in rows], [r["len"] for r in rows]
            if len(rows) < (least if germline else 2 * p.min_support if hp == 0 else p.min_support):
                continue
            q1, q3 = np.percentile(size, 25), np.percentile(size, 75)
            fence = (max(q1 - 1.5 * (q3 - q1), min(size)), min(q3 + 1.5 * (q3 - q1), max(size))) if germline else (min(size), max(size))
            mean = sum(size) / len(size)
            alleles[hp].append({
                "hp": hp, "n": len(rows), "reads": {r["read_name"] for r in rows}, "pos": math.floor(sum(pos) / len(pos)), "min": min(pos), "max": max(pos), "size": mean if germline else float(math.floor(mean)),
                "f0": fence[0], "f1": fence[1], "cipos": interval(pos), "cilen": interval(size), "seq": best_bases(rows, math.floor(mean)) if germline else "<INS>",
            })
        alleles[hp].sort(key=lambda a: -a["n"])
    made = pair_up(alleles, cluster, least if germline else p.min_support, p.min_size if germline else None)
    made.sort(key=lambda c: -sum(c["counts"]))
    for c in made:
        size = math.floor(c["size"])
        reach = min(p.gap_indel, size + 50)
        c |= {"low": min(c["min"], c["pos"] - reach), "high": max(c["max"], c["pos"] + reach)} if kind == "INS" else {"low": c["min"], "high": c["max"]}
        c |= {"sides": (0, 1) if kind == "INS" else (1,), "haplotypes": {0} | {h for h, k in ((1, 0), (2, 2)) if c["gt"][k] == "1"}, "able": germline or size > 2000}
    rescued(made, clips)
    out = []
    for c in made:
        for _, hp in c["more"]:
            c["counts"][hp] += 1
        found = covering(reads, chrom, max(c["pos"] - p.gap_indel, c["min"]), min(c["pos"] + p.gap_indel, c["max"]))
        dr, r1, r2 = against(found, c["support"])
        dv, s1, s2, gt = sum(c["counts"]), c["counts"][1], c["counts"][2], c["gt"]
        if "1" in gt:
            for h, k, s, r in ((1, 0, s1, r1), (2, 2, s2, r2)):
                stays = s >= r if germline else s + r > 0 and (s / (s + r) >= 0.9 or r < 2)
                if gt[k] == "1" and not stays:
                    gt = gt[:k] + "." + gt[k + 1 :]
        elif germline or dv / (dv + dr) >= 0.9 or dr < 2:
            none, both, one = 0.4 * 0.9**dr * 0.1**dv, 0.4 * 0.1**dr * 0.9**dv, 0.2 * 0.5 ** (dr + dv)
            gt = "1|1" if both > max(none, one) else ("1|0" if s1 > s2 else "0|1") if one > max(none, both) else gt
        out.append(call(kind, chrom, pos=c["pos"], svlen=math.floor(c["size"]), dv=dv, gt=gt, cipos=c["cipos"], cilen=c["cilen"], ins_seq=c["seq"], support=set(c["support"])))
    if not germline:
        return [c for c in out if "1" not in c["gt"] and c["svlen"] >= p.min_size]
    kept = []
    for pos in dict.fromkeys(c["pos"] for c in out):
        own = [c for c in out if c["pos"] == pos]
        if max(sum(c["gt"][k] == "1" for c in own) for k in (0, 2)) > 1:
            both = [c for c in own if c["gt"] == "1|1"]
            first, second = ([c for c in own if c["gt"][k] == "1" and c["gt"][2 - k] != "1"] for k in (0, 2))
            if both:
                own = [c for c in own if c["gt"] != "1|1"] + both[:1]
            else:
                for c in first if len(first) > 1 else second if len(second) > 1 else ():
                    c["gt"] = ".|."
        kept += own
    return kept


def open_indels(cluster, p, mode, least):
    """Calls of a cluster that haplotypes don't tell apart, before clips."""
    germline, kind, out = mode == "germline", cluster[0]["svtype"], []
    if len(cluster) < 100:
        rows = sorted(cluster, key=lambda r: (r["pos"], r["len"], r["read_name"]))
        names = sorted({r["read_name"] for r in rows})
        for k, (start, size, members) in enumerate(solve(np.array([names.index(r["read_name"]) for r in rows]), np.array([r["pos"] for r in rows]), np.array([r["len"] for r in rows]))):
            own, reach, seq = [rows[m] for m in members], min(p.gap_indel, size + 50), "<INS>"
            shown = size
            if germline and size < p.min_size:
                continue
            if germline and kind == "INS":
                whole, at = {}, {(r["read_name"], r["pos"]): r["ins_seq"] for r in sorted(rows, key=lambda r: (r["len"], r["ins_seq"]))}
                for r in sorted(own, key=lambda r: r["pos"]):
                    whole[r["read_name"]] = whole.get(r["read_name"], "") + at[r["read_name"], r["pos"]]
                n = sorted(len(x) for x in whole.values())
                q1, q3 = np.percentile(n, 20), np.percentile(n, 80)
                inner = [x for x in n if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
                shown = math.floor(sum(inner or n) / len(inner or n))
                seq = min(((len(x), name, x) for name, x in whole.items() if len(x) >= shown), default=(0, "", None))[2]
                seq = "<INS>" if seq is None else seq[:shown]
            std = (interval([r["pos"] for r in own]), interval([r["len"] for r in own])) if germline else ("./.", "./.")
            support = {}
            for r in own:
                support[r["read_name"]] = min(r["hp"], support.get(r["read_name"], 9))
            out.append({"order": (-len(own) if germline else len(own), k), "pos": start, "svlen": shown, "low": start - reach, "high": start + reach, "able": germline or size > 2000, "window": (start - p.gap_indel, start + p.gap_indel), "tight": False,
                        "shown": len(own), "dp": True, "s": [list(support.values()).count(h) for h in (1, 2)], "support": support, "cipos": std[0], "cilen": std[1], "seq": seq})
    elif len(cluster) >= (least if germline else p.min_support):
        for k, rows in enumerate(by_length(cluster, p.len_ratio)):
            pos, size = [r["pos"] for r in rows], [r["len"] for r in rows]
            mean, n = sum(pos) / len(pos), math.floor(sum(size) / len(size))
            a, b = rows[0]["pos"], rows[-1]["pos"]
            low, high = (min(a, mean - p.gap_indel), max(b, mean + p.gap_indel)) if kind == "INS" else (a, b)
            at = math.floor(mean)
            window = max(at - p.gap_indel, min(min(pos), max(pos) - p.gap_indel)), min(at + p.gap_indel, max(max(pos), min(pos) + p.gap_indel))
            support = {}
            for r in rows:
                support[r["read_name"]] = min(r["hp"], support.get(r["read_name"], 9))
            out.append({"order": (-len(rows), k), "pos": at, "svlen": n, "low": low, "high": high, "able": germline or min(size) > 2000, "window": (window[0], window[1] + (window[0] == window[1])), "tight": np.std(pos) < 1 and np.std(size) < 1,
                        "shown": len(rows), "dp": False, "s": [[r["hp"] for r in rows].count(h) for h in (1, 2)], "support": support, "cipos": interval(pos), "cilen": interval(size), "seq": best_bases(rows, n) if germline else "<INS>"})
    return sorted(out, key=lambda c: c["order"])


def pooled_indels(cluster, clips, reads, p, mode, least):
    kind, chrom, germline = cluster[0]["svtype"], cluster[0]["chrom"], mode == "germline"
    made = open_indels(cluster, p, mode, least)
    for c in made:
        c |= {"sides": (0, 1) if kind == "INS" else (1,), "haplotypes": None}
    rescued(made, clips)
    out = []
    for c in made:
        shown = c["shown"] + (0 if c["dp"] else len(c["more"]))
        if (len(c["support"]) if c["dp"] else shown) < least or (germline and not c["dp"] and c["svlen"] < p.min_size):
            continue
        one = call(kind, chrom, pos=c["pos"], svlen=c["svlen"], cipos=c["cipos"], cilen=c["cilen"], ins_seq=c["seq"])
        if germline:
            out.append(genotyped(one, c["support"], covering(reads, chrom, *c["window"]), *c["s"], tight=c["tight"]) | {"dv": shown})
            continue
        found = overlapping(reads, chrom, *c["window"], primary=True)
        dv, dr = len(c["support"]), against(found, c["support"])[0]
        gt, pl, gq, qual = likelihood(dr, dv)
        if "1" not in gt and c["svlen"] >= p.min_size and dv >= 2 and 0.05 <= dv / (dv + dr) <= 0.4:
            out.append(one | {"dv": shown, "dr": dr, "gt": gt, "pl": pl, "gq": gq, "qual": qual, "support": set(c["support"])})
    return out


def two_breakpoints(rows, reads, kind, chrom, p, mode):
    """Duplications or inversions of one chromosome."""
    inv, germline, out = kind == "INV", mode == "germline", []
    gap = p.gap_dup_inv
    tie = (lambda r: (r["strand"],)) if inv else lambda r: ()
    far = lambda a, b: (b["pos"] - a["pos"] > gap and abs(b["pos2"] - a["pos2"]) > gap) or (inv and not germline and a["strand"] != b["strand"])
    for cluster in chains(rows, lambda r: (r["pos"], r["pos2"], *tie(r), r["read_name"], r["hp"]), far):
        if len(cluster) < p.min_support:
            continue
        at, reach = [r["pos"] for r in cluster], gap // 2 if inv else gap
        even, depth = balanced(reads, chrom, (max(min(at) - reach, 0), max(at) + reach), kind, mode)
        least = p.min_support if germline or not inv else max(math.floor(depth * 0.05), 4)
        alleles = []
        for side in (0, 1, 2) if even else (-1,):
            own = [r for r in cluster if side in (-1, r["hp"])]
            for k, part in enumerate(chains(own, lambda r: (r["pos2"], r["pos"], *tie(r), r["read_name"]), lambda a, b: b["pos2"] - a["pos2"] > gap)):
                names = {}
                for r in part:
                    names.setdefault(r["read_name"], r["hp"])
                if inv:
                    bp = [round(sum(r[c] for r in part) / len(part)) for c in ("pos", "pos2")]
                    ok = len(part) >= least and len(names) >= least
                else:
                    a, b = math.floor(len(part) * 0.4), math.floor(len(part) * 0.6)
                    middle = part[a : max(b, a + 1)]
                    bp = [math.floor(sum(r[c] for r in middle) / len(middle)) for c in ("pos", "pos2")]
                    ok = len(names) >= p.min_support
                if ok and p.min_size <= bp[1] - bp[0] <= p.max_size:
                    strand = min((r["pos"], r["pos2"], r["strand"]) for r in part)[2] if inv else None
                    alleles.append({"hp": side, "k": k, "bp1": bp[0], "bp2": bp[1], "size": bp[1] - bp[0], "reads": names, "strand": strand})
        if not even:
            for a in alleles:
                one = call(kind, chrom, pos=a["bp1"], svlen=a["size"], strand=a["strand"])
                half = gap // 2
                found = covering(reads, chrom, a["bp1"] - half, a["bp1"] + half) | covering(reads, chrom, a["bp2"] - half, a["bp2"] + half) if inv else covering(reads, chrom, a["bp1"], a["bp2"])
                s = [list(a["reads"].values()).count(h) for h in (1, 2)]
                if germline:
                    out.append(genotyped(one, a["reads"], found, *s))
                else:
                    dr = against(found, a["reads"])[0]
                    gt, pl, gq, qual = likelihood(dr, len(a["reads"]))
                    if "1" not in gt:
                        out.append(one | {"dv": len(a["reads"]), "dr": dr, "gt": gt, "pl": pl, "gq": gq, "qual": qual, "support": set(a["reads"])})
            continue
        for a in alleles:
            window = max(a["bp1"] - gap, 0), a["bp1"] + gap
            found = covering(reads, chrom, *window) if germline else overlapping(reads, chrom, *window, primary=True)
            dr = against(found, a["reads"])
            a["dr"], n = {0: None, 1: dr[1], 2: dr[2]}[a["hp"]], len(a["reads"])
            sign = "." if a["hp"] == 0 or not (n >= a["dr"] if germline else n / (n + a["dr"]) > 0.7) else "1"
            a["gt"] = {0: ".|.", 1: sign + "|0", 2: "0|" + sign}[a["hp"]]
        alleles = [a for a in alleles if germline or "1" not in a["gt"]]
        taken = set()

        def mate(own, hp):
            for k, a in enumerate(alleles):
                if a["hp"] == hp and k not in taken and ratio(own["now"], a["size"]) > 0.9:
                    taken.add(k)
                    return a
            return None

        def emit(a, members, gt):
            support = {r for m in members for r in m["reads"]}
            out.append(call(kind, chrom, pos=int(a["at"]), svlen=int(a["now"]), strand=a["strand"], dr=a["dr"], dv=sum(len(m["reads"]) for m in members), gt=gt, support=support))

        for hp in (1, 2, 0):
            for k, a in enumerate(alleles):
                if a["hp"] != hp or k in taken:
                    # a second haplotype's allele that a first one took may still take one of untagged reads
                    if a["hp"] != hp or germline or hp != 2:
                        continue
                a["at"], a["now"], members, gt = float(a["bp1"]), float(a["size"]), [a], a["gt"]
                for other in ([2] if germline else [2, 0]) if hp == 1 else [0] if hp == 2 and not germline else []:
                    m = mate(a, other)
                    if m:
                        a["at"], a["now"] = (a["at"] + m["bp1"]) / 2, float(int((a["now"] + m["size"]) / 2))
                        a["at"] = a["at"] if germline else float(int(a["at"]))
                        gt = "1|1" if germline else a["gt"][0] + "|" + m["gt"][2] if other == 2 else a["gt"][0] + "|." if hp == 1 else ".|" + m["gt"][2]
                        members.append(m)
                need = p.min_support // 2 if germline and hp else p.min_support if germline else least
                if len(members) > 1 or (k not in taken and len(a["reads"]) >= need):
                    emit(a, members, gt)
    return out


def translocations(rows, clips, reads, p, mode):
    out = []
    keys = sorted({(r["chrom"], r["chrom2"], r["bnd_type"]) for r in rows})
    for chrom, chrom2, kind in keys:
        own = [r for r in rows if (r["chrom"], r["chrom2"], r["bnd_type"]) == (chrom, chrom2, kind)]
        clusters = chains(own, lambda r: (r["pos"], r["pos2"], r["read_name"], r["hp"]), lambda a, b: b["pos"] - a["pos"] > p.gap_tra)
        for j, cluster in enumerate(clusters):
            last = j == len(clusters) - 1 and kind == max(t for c, d, t in keys if (c, d) == (chrom, chrom2)) and chrom2 != max(d for c, d, _ in keys if c == chrom)
            if len(cluster) < (p.min_support if mode == "mosaic" and last else 2):
                continue
            alleles = []
            for k, part in enumerate(chains(cluster, lambda r: (r["pos2"], r["pos"], r["read_name"]), lambda a, b: b["pos2"] - a["pos2"] > p.gap_tra)):
                first = {}
                for r in part:
                    first.setdefault(r["read_name"], r)
                bp = [math.floor(sum(r[c] for r in first.values()) / len(first)) for c in ("pos", "pos2")]
                alleles.append((-len(first), k, bp, {n: r["hp"] for n, r in first.items()}))
            for n, _, (bp1, bp2), support in sorted(alleles)[:2]:
                if -n < 2:
                    continue
                for clip in sorted(clips, key=lambda c: c["hp"]):
                    if clip["side"] == 2 and clip["chrom"] == chrom and abs(clip["pos"] - bp1) < 25:
                        support.setdefault(clip["read_name"], clip["hp"])
                place = f"{chrom2}:{bp2}"
                one = call("TRA", chrom, pos=bp1, chrom2=chrom2, pos2=bp2, alt={"A": f"N[{place}[", "B": f"N]{place}]", "C": f"[{place}[N", "D": f"]{place}]N"}[kind])
                found = overlapping(reads, chrom, max(bp1 - p.gap_tra, 0), bp1 + p.gap_tra, primary=True)
                s = [list(support.values()).count(h) for h in (1, 2)]
                if mode == "germline":
                    out.append(genotyped(one, support, found, *s))
                    continue
                dv, dr = len(support), against(found, support)[0]
                gt, pl, gq, qual = likelihood(dr, dv)
                if "1" not in gt and dv >= max(math.floor((dv + dr) * 0.05), 4):
                    out.append(one | {"dv": dv, "dr": dr, "gt": gt, "pl": pl, "gq": gq, "qual": qual, "support": set(support)})
    return out


def calls(sig, clips, reads, p, mode):
    """All calls of one sample."""
    out = []
    for kind in ("DEL", "INS"):
        for chrom in sorted({r["chrom"] for r in sig}):
            rows = [r for r in sig if (r["svtype"], r["chrom"]) == (kind, chrom)]
            for cluster in chains(rows, lambda r: (r["pos"], r["len"], r["read_name"], r["hp"]), lambda a, b: int(b["pos"]) - int(a["pos"]) > p.gap_indel):
                cluster = [r | {"pos": int(r["pos"])} for r in cluster]
                enough = len(cluster) >= (p.min_support / 2 if mode == "germline" else p.min_support)
                if not enough and sum(r["len"] for r in cluster) / len(cluster) < 3000:
                    continue
                at = [r["pos"] for r in cluster]
                window = max(min(at) - p.gap_indel, 0), max(at) + p.gap_indel
                even, depth = balanced(reads, chrom, window, kind, mode)
                least = int(max(depth / 10, 2)) if mode == "germline" else min(p.min_support, 5)
                near = sorted((c for c in clips if c["chrom"] == chrom and c["side"] in (0, 1) and window[0] < c["pos"] < window[1]), key=lambda c: (c["pos"], c["side"], c["hp"]))
                out += (balanced_indels if even else pooled_indels)(cluster, near, reads, p, mode, least)
    for kind in ("DUP", "INV") if mode == "germline" else ("INV",):
        for chrom in sorted({r["chrom"] for r in sig}):
            out += two_breakpoints([r for r in sig if (r["svtype"], r["chrom"]) == (kind, chrom)], reads, kind, chrom, p, mode)
    return out + translocations([r for r in sig if r["svtype"] == "TRA"], clips, reads, p, mode)
