"""Signals, clips and read intervals of alignments, read by read in plain code: what extract_signatures() is held against."""

import re

SIZE, MOST, MAPQ, READ_LEN, SIGNAL, GAP, PARTS = 50, 100_000, 20, 500, 30, 30, 7


def ops(cigar):
    return [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")]


def total(parts, kinds):
    return sum(n for n, o in parts if o in kinds)


def clip(part):
    return part[0] if part[1] in "SH" else 0


def reversed_bases(seq):
    return seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def in_cigar(row):
    """Merged insertions and deletions of one alignment: (svtype, pos, len, bases)."""
    at, here, found = row["ref_start"], 0, []
    parts = ops(row["cigar"])
    if parts and parts[0][1] == "H":
        here = -parts[0][0]
    for n, o in parts:
        if o in "ID" and n >= SIGNAL:
            found.append(("INS" if o == "I" else "DEL", at, n, row["query_seq"][here : here + n] if o == "I" else None))
        at += n if o in "MDN=X" else 0
        here += n if o != "D" else 0
    out = []
    for kind in ("DEL", "INS"):
        groups, mark = [], None
        for k, (own, pos, n, bases) in enumerate(found):
            if own != kind:
                continue
            held = groups[-1] if groups else None
            near = held and found[k - 1][0] == kind and pos - mark <= min(sum(x[2] for x in held), n, GAP)
            if near:
                held.append((kind, pos, n, bases))
            else:
                groups.append([(kind, pos, n, bases)])
            # of deletions the end counts, but the start of a later group while it has one member
            mark = pos + n if kind == "DEL" and (near or len(groups) == 1) else pos
        out += [(kind, g[0][1], sum(x[2] for x in g), "".join(x[3] for x in g) if kind == "INS" else None) for g in groups]
    return out


def segments(row):
    """(read_start, read_end, ref_start, ref_end, chrom, strand) in read order."""
    good, out = row["mapq"] >= MAPQ, []

    def add(cigar, start, chrom, strand):
        parts = ops(cigar)
        left = clip(parts[-1] if strand == "-" else parts[0])
        out.append((left, left + total(parts, "MI=X"), start, start + total(parts, "MDN=X"), chrom, strand))

    if good:
        add(row["cigar"], row["ref_start"], row["chrom"], "-" if row["flag"] == 16 else "+")
    for entry in filter(None, row["sa"].split(";")):
        chrom, start, strand, cigar, mapq, _ = entry.split(",")
        if good or int(mapq) >= MAPQ:
            add(cigar, int(start), chrom, strand)
    return sorted(out)


class Read:
    """The split-read rules; ``out`` has (svtype, chrom, pos, len, pos2, chrom2, strand, bnd_type, bases), ``edges`` points of side 2."""

    def __init__(self, segs, length, seq):
        self.segs, self.length, self.seq, self.out, self.edges = segs, length, seq, [], []

    def add(self, kind, chrom, pos, n=None, pos2=None, chrom2=None, strand=None, bnd=None, bases=None):
        self.out.append((kind, chrom, float(pos), n, pos2, chrom2, strand, bnd, bases))

    def forward(self, *segs):
        """Segments as on the plus strand: of minus ones the last comes first."""
        if segs[0][5] == "+":
            return segs
        return tuple((self.length - s[1], self.length - s[0], *s[2:]) for s in reversed(segs))

    def fits(self, n):
        return SIZE <= n <= MOST

    def doubled(self, x, y):
        back = x[3] - y[2]
        if back >= SIZE and back / 5 > abs(y[0] - x[1]):
            self.add("DUP", y[4], y[2], pos2=x[3])

    def inserted(self, x, y, minus, ok=True):
        gap, read = y[2] - x[3], y[0] - x[1]
        n = read - gap
        if ok and self.fits(n) and -gap < max(SIZE, n / 5) and gap <= max(100, n / 5):
            seq, at = reversed_bases(self.seq) if minus else self.seq, max(x[1] + int(gap / 2), 0)
            self.add("INS", y[4], (y[2] + x[3]) / 2, n, bases=seq[at : at + n])

    def deleted(self, x, y, ok=True):
        gap, read = y[2] - x[3], y[0] - x[1]
        n = gap - read
        if ok and self.fits(n) and -gap < max(SIZE, n / 5) and read <= max(100, n / 5):
            self.add("DEL", y[4], x[3], n)

    def turned(self, x, y):
        a, b = (s[3] if x[5] == "+" else s[2] for s in (x, y))
        size = abs(b - a)
        if x[5] != y[5] and size >= SIZE and y[0] + size / 2 >= x[1]:
            self.add("INV", x[4], min(a, b), pos2=max(a, b), strand="++" if x[5] == "+" else "--")

    def moved(self, x, y):
        if y[0] - x[1] > 100:
            return
        a, b = x[3] if x[5] == "+" else x[2], y[2] if y[5] == "+" else y[3]
        first = x[4] < y[4]
        kind = {"++": "AD", "--": "DA", "+-": "BB", "-+": "CC"}[x[5] + y[5]][not first]
        (c1, p1), (c2, p2) = ((x[4], a), (y[4], b)) if first else ((y[4], b), (x[4], a))
        self.add("TRA", c1, p1, pos2=p2, chrom2=c2, bnd=kind)

    def pair(self, x, y):
        if x[5] != y[5]:
            self.turned(x, y)
            return
        u, v = self.forward(x, y)
        self.doubled(u, v)
        self.inserted(u, v, x[5] == "-", v[3] > u[3])
        self.deleted(u, v)
        gap, read = v[2] - u[3], v[0] - u[1]
        if self.fits(gap) and self.fits(read) and min(gap, read) / max(gap, read) > 0.9:
            self.edges += [(v[4], u[3]), (v[4], v[2])]

    def triple(self, a):
        x, y, z = self.segs[a : a + 3]
        last, strands = a == len(self.segs) - 3, x[5] + y[5] + z[5]
        if strands in ("+-+", "-+-"):
            low, high = (x, z) if y[5] == "-" else (z, x)
            half, slack = 0.5 * (high[2] - low[3]), 0 if y[5] == "-" else -50
            if y[0] + half >= x[1] and z[0] + half >= y[1] and y[2] - low[3] >= slack and high[2] - y[3] >= slack:
                self.add("INV", x[4], low[3], pos2=y[3], strand="++")
                self.add("INV", x[4], y[2], pos2=high[2], strand="--")
        if last and x[5] != z[5]:
            self.turned(*((y, z) if x[5] == y[5] else (x, y)))
        if len(set(strands)) == 1:
            u, v, w = self.forward(x, y, z)
            if v[2] < w[3]:
                self.doubled(v, w)
            if a == 0:
                self.doubled(u, v)
            self.inserted(u, v, x[5] == "-", w[2] >= v[3] > u[3])
            self.deleted(u, v, w[2] >= v[3])
            if last:
                self.inserted(v, w, x[5] == "-", w[3] > v[3])
                self.deleted(v, w)
        if strands in ("++-", "--+"):
            u, v = self.forward(x, y)
            self.inserted(u, v, x[5] == "-")
            self.deleted(u, v)
        if last and strands in ("-++", "+--"):
            # a minus pair takes its places in the read from the pair before it
            u, v = (y, z) if y[5] == "+" else tuple((self.length - s[1], self.length - s[0], *s[2:]) for s in (y, x))
            self.inserted(u, v, y[5] == "-")
            self.deleted(u, v)

    def run(self):
        segs = self.segs
        if not 2 <= len(segs) <= PARTS:
            return self
        chroms = [s[4] for s in segs]
        if len(segs) == 2:
            if chroms[0] == chroms[1]:
                self.pair(*segs)
                return self
            self.moved(*segs)
            return self
        for a in range(len(segs) - 2):
            if len(set(chroms[a : a + 3])) == 1:
                self.triple(a)
        if all(chroms[k] == chroms[k + 1] for k in range(len(segs) - 2)):
            return self
        x, y = segs[0], segs[-1]
        if x[4] == y[4] and x[5] == y[5]:
            u, v = self.forward(x, y)
            gap, read = v[2] - u[3], v[0] - u[1]
            if abs(gap) <= 100 and self.fits(read - gap) and v[3] > u[3]:
                seq, at = reversed_bases(self.seq) if x[5] == "-" else self.seq, max(u[1] + int(gap / 2), 0)
                self.add("INS", v[4], (v[2] + u[3]) / 2, read - gap, bases=seq[at : at + read - gap])
                return self
            if gap <= -SIZE and abs(read) < SIZE:
                self.add("DUP", v[4], v[2], pos2=u[3])
                return self
        for k in range(len(segs) - 1):
            self.moved(segs[k], segs[k + 1])
        return self


def signatures(rows, regions=None):
    """(set of signals, sorted clips, sorted read intervals)"""
    sig, clips, reads = set(), [], []
    for row in rows:
        parts = ops(row["cigar"])
        end = row["ref_start"] + total(parts, "MDN=X")
        if row["flag"] in (256, 272) or (regions is not None and not any(c == row["chrom"] and row["ref_start"] < b and end > a for c, a, b in regions)):
            continue
        primary, good, who = row["flag"] in (0, 16), row["mapq"] >= MAPQ, (row["read_name"], row["hp"])
        if good:
            reads.append((row["chrom"], row["ref_start"], end, int(primary), *who))
            if row["query_len"] >= READ_LEN:
                sig |= {(kind, row["chrom"], float(pos), n, None, None, None, None, bases, *who) for kind, pos, n, bases in in_cigar(row)}
        if primary and row["sa"] is None and good:
            clips += [(row["chrom"], 0, row["ref_start"], *who), (row["chrom"], 1, end, *who)]
        if primary and row["sa"] is not None and row["query_len"] >= READ_LEN:
            segs = segments(row)
            if segs:
                clips += [(segs[0][4], 0, segs[0][2], *who), (segs[-1][4], 1, segs[-1][3], *who)]
                read = Read(segs, total(parts, "MISH=X"), row["query_seq"]).run()
                sig |= {(*s, *who) for s in read.out}
                clips += [(chrom, 2, pos, *who) for chrom, pos in read.edges]
    return sig, sorted(clips), sorted(reads)
