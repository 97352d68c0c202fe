"""Registered queries by inventory ID and their DuckDB SQL. Each reads ``lineitem`` of the given scale through views."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import alleles as A
from ..operators import cluster as C
from ..operators import genotype as G
from ..operators import intervals as J
from ..operators import phase as D
from ..operators import reads as P
from ..operators import resolve as R
from ..operators import signals as U
from ..operators import split as X
from ..operators import vcf as V
from ..operators.allele_dp import allele_dp
from ..params import Params
from ..sources import io
from . import jobs
from .job import Job
from .views import ctes, view

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None, *views: str) -> Callable:
    def add(f: Callable) -> Callable:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = f"WITH {ctes(*views)}{sql}" if sql.startswith(",") else f"WITH {ctes(*views)} {sql}"
        return f

    return add


def _temp(spark: SparkSession) -> str:
    """A path of its own in the shared folder; what is written there goes when the application ends."""
    return os.path.join(io.delete_on_exit(spark, os.path.join(io.shared_folder(spark), uuid.uuid4().hex)), "table")


# --- SQL shared by several counterparts -------------------------------------------------------------------------------


def _chain(types: str, order: str, brk: str, keys: str = "svtype, chrom", name: str = "cl") -> str:
    """Clusters of v_sigs: each signal with its cluster_no and win_id."""
    label = "concat_ws(':', " + keys + ", cluster_no)"
    return f""", {name}_s AS (SELECT DISTINCT * FROM v_sigs WHERE svtype IN ({types})),
{name}_l AS (SELECT *, CASE WHEN {brk} THEN 1 ELSE 0 END AS brk FROM {name}_s WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
{name}_n AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_no FROM {name}_l),
{name} AS (SELECT *, {label} AS win_id FROM {name}_n)"""


_INDEL = _chain("'DEL', 'INS'", "pos, len, read_name, hp, pos2, chrom2, strand, bnd_type", "pos - lag(pos) OVER w > 1000")
_FAR = "pos - lag(pos) OVER w > 500 AND abs(pos2 - lag(pos2) OVER w) > 500"
_WIN = _INDEL + ", win AS (SELECT win_id, chrom, greatest(min(pos) - 1000, 0) AS w_start, max(pos) + 1000 AS w_end FROM cl GROUP BY 1, 2)"


def _kept(name: str, least: int) -> str:
    return f", {name}_k AS (SELECT * FROM {name} WHERE win_id IN (SELECT win_id FROM {name} GROUP BY 1 HAVING count(*) >= {least}))"


_DUP = _chain("'DUP'", "pos, pos2, read_name, hp", _FAR, name="du") + _kept("du", 10)
_INV = _chain("'INV'", "pos, pos2, strand, read_name, hp", _FAR, name="iv") + _kept("iv", 10)
_TRA = _chain("'TRA'", "pos, pos2, read_name, hp", "pos - lag(pos) OVER w > 50", "svtype, chrom, chrom2, bnd_type", "tr") + _kept("tr", 2)
_PAIRS = _WIN + """, ov AS (SELECT DISTINCT ON (win_id, read_name) win_id, read_name, r.is_primary, ref_start, ref_end, hp FROM win JOIN v_reads r ON r.chrom = win.chrom AND ref_start < w_end AND ref_end > w_start ORDER BY win_id, read_name, r.is_primary DESC, ref_start, ref_end, hp)"""
_HIST = _PAIRS + """, hist AS (SELECT win.win_id, count(*) FILTER (hp = 0) AS h0, count(*) FILTER (hp = 1) AS h1, count(*) FILTER (hp = 2) AS h2 FROM win LEFT JOIN ov USING (win_id) GROUP BY 1)"""
_COVER = _WIN + """, cov AS (SELECT win_id, read_name, min(hp) AS hp FROM win JOIN v_reads r ON r.chrom = win.chrom AND ref_start <= w_start AND ref_end >= w_end AND is_primary = 1 GROUP BY 1, 2)"""
_NARROW = _INDEL + ", win AS (SELECT win_id, chrom, greatest(min(pos), 0) AS w_start, max(pos) AS w_end FROM cl GROUP BY 1, 2)"
_NCOVER = _NARROW + """, cov AS (SELECT win_id, read_name, min(hp) AS hp FROM win JOIN v_reads r ON r.chrom = win.chrom AND ref_start <= w_start AND ref_end >= w_end AND is_primary = 1 GROUP BY 1, 2)"""
_REF = _NCOVER + """, ref AS (SELECT win_id, count(*) AS dr, count(*) FILTER (hp = 0) AS r0, count(*) FILTER (hp = 1) AS r1, count(*) FILTER (hp = 2) AS r2 FROM cov WHERE (win_id, read_name) NOT IN (SELECT win_id, read_name FROM cl) GROUP BY 1)"""
_CALLS = _REF + """, sup AS (SELECT win_id, read_name, min(hp) AS hp FROM cl GROUP BY 1, 2),
dvs AS (SELECT win_id, count(*) AS dv, count(*) FILTER (hp = 1) AS s1, count(*) FILTER (hp = 2) AS s2 FROM sup GROUP BY 1),
calls AS (SELECT win_id, dv, s1, s2, coalesce(dr, 0) AS dr, coalesce(r1, 0) AS r1, coalesce(r2, 0) AS r2 FROM dvs LEFT JOIN ref USING (win_id))"""
_GL = _CALLS + """, sc AS (SELECT *, CASE WHEN dr + dv > 100 THEN CAST(floor(100 * (dr / (dr + dv))) AS BIGINT) ELSE dr END AS c0 FROM calls),
sd AS (SELECT *, CASE WHEN dr + dv > 100 THEN 100 - c0 ELSE dv END AS c1 FROM sc),
lg AS (SELECT *, c0 * log10(0.9::DOUBLE) + c1 * log10(0.1::DOUBLE) + log10(1.0::DOUBLE / 3) AS a, (c0 + c1) * log10(0.5::DOUBLE) + log10(1.0::DOUBLE / 3) AS b, c0 * log10(0.1::DOUBLE) + c1 * log10(0.9::DOUBLE) + log10(1.0::DOUBLE / 3) AS c FROM sd),
lt AS (SELECT *, greatest(a, b, c) + log10(pow(10.0::DOUBLE, a - greatest(a, b, c)) + pow(10.0::DOUBLE, b - greatest(a, b, c)) + pow(10.0::DOUBLE, c - greatest(a, b, c))) AS t FROM lg),
lp AS (SELECT *, least(a - t, 0) AS pa, least(b - t, 0) AS pb, least(c - t, 0) AS pc FROM lt),
gl AS (SELECT win_id, dv, dr, s1, s2, r1, r2,
  CASE WHEN dr = 3 AND dv = 1 OR dr = 6 AND dv = 2 THEN '0/1' WHEN pa >= pb AND pa >= pc THEN '0|0' WHEN pb >= pc THEN '0/1' ELSE '1|1' END AS gt0,
  CASE WHEN dr = 3 AND dv = 1 THEN '3,3,24' WHEN dr = 6 AND dv = 2 THEN '3,3,45' ELSE concat_ws(',', CAST(round_even(-10 * pa, 0) AS BIGINT), CAST(round_even(-10 * pb, 0) AS BIGINT), CAST(round_even(-10 * pc, 0) AS BIGINT)) END AS pl,
  CASE WHEN dr = 3 AND dv = 1 OR dr = 6 AND dv = 2 THEN 3 ELSE CAST(greatest(floor(-10 * log10(pow(10.0::DOUBLE, pb) + pow(10.0::DOUBLE, pc))), floor(-10 * log10(pow(10.0::DOUBLE, pa) + pow(10.0::DOUBLE, pc))), floor(-10 * log10(pow(10.0::DOUBLE, pa) + pow(10.0::DOUBLE, pb)))) AS INT) END AS gq,
  CASE WHEN dr = 3 AND dv = 1 OR dr = 6 AND dv = 2 THEN 3.0 ELSE abs(round_even(-10 * pa, 1)) END AS qual FROM lp),
gh AS (SELECT *, CASE WHEN gt0 = '0/1' THEN CASE WHEN s1 > s2 THEN '1|0' ELSE '0|1' END ELSE gt0 END AS g1,
  CASE WHEN s1 + r1 = 0 THEN 0 ELSE s1 / (s1 + r1) END AS p1, CASE WHEN s2 + r2 = 0 THEN 0 ELSE s2 / (s2 + r2) END AS p2 FROM gl),
gt AS (SELECT win_id, dv, dr, s1, s2, r1, r2, pl, gq, qual, CASE WHEN least(s1 + r1, s2 + r2) > 5 AND p1 > 0.95 AND p2 < 0.05 THEN '1|0' WHEN least(s1 + r1, s2 + r2) > 5 AND p2 > 0.95 AND p1 < 0.05 THEN '0|1' ELSE g1 END AS gt FROM gh)"""
_B = ", b AS (SELECT DISTINCT concat(read_name, '_', CAST(site AS STRING), '_', CAST(q AS STRING), '_', CAST(sk AS STRING)) AS read_name, hp, chrom, concat('chr', CAST(1 + (sk + 1) % 5 AS STRING)) AS far, site * 500 + 5000 + ok % 40 AS b, ok % 10 AS k FROM v_reads WHERE ln = 1)"


# --- inputs shared by several queries ---------------------------------------------------------------------------------


def _sigs(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    return U.dedup_signals(view(spark, sf_dir, "v_sigs").filter(F.col("svtype").isin(*types)))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_reads").select("chrom", "ref_start", "ref_end", "is_primary", "read_name", "hp")


def _indel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.indel_clusters(_sigs(spark, sf_dir, "DEL", "INS"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cluster_windows(_indel(spark, sf_dir), 1000)


def _tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cluster_windows(_indel(spark, sf_dir), 0)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_segments")
    kinds = {"read_start": "long", "read_end": "long", "ref_start": "long", "ref_end": "long", "chrom": "string", "strand": "string"}
    return rows.groupBy("read_name", "hp", F.col("read_len").cast("long").alias("read_len")).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast(t).alias(c) for c, t in kinds.items())))).alias("segs"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = _indel(spark, sf_dir)
    return jobs.counted(C.cluster_windows(clusters, 0), clusters, _reads(spark, sf_dir))


# --- S: sources and sinks ---------------------------------------------------------------------------------------------


@_query("s1_read_alignments", "SELECT read_name, chrom, flag, mapq, ref_start, hp, cigar, query_len, sa FROM v_align", "v_align")
def _(spark, sf_dir):
    path = _temp(spark)
    view(spark, sf_dir, "v_align").write.parquet(path)
    return io.read_alignments(spark, path).select("read_name", "chrom", "flag", "mapq", "ref_start", "hp", "cigar", "query_len", "sa")


@_query("s1_read_sam", "SELECT read_name, chrom, flag, mapq, ref_start, hp, cigar, query_len, sa FROM v_align", "v_align")
def _(spark, sf_dir):
    path = _temp(spark) + ".sam"
    a = view(spark, sf_dir, "v_align")
    tags = F.concat(F.when(F.col("hp") > 0, F.concat(F.lit("\tHP:i:"), F.col("hp"))).otherwise(""), F.coalesce(F.concat(F.lit("\tSA:Z:"), "sa"), F.lit("")))
    line = F.concat_ws("\t", "read_name", "flag", "chrom", F.col("ref_start") + 1, "mapq", "cigar", F.lit("*\t0\t0"), "query_seq", F.lit("*"))
    a.select(F.concat(line, tags).alias("value")).write.text(path, compression="gzip")  # a line is some 900 bytes, of few kinds
    return io.read_alignments(spark, path).drop("query_seq")


@_query("s2_read_bed", "SELECT chrom, bed_start - 1000 AS bed_start, bed_end + 1000 AS bed_end FROM v_bed", "v_bed")
def _(spark, sf_dir):
    path = _temp(spark)
    view(spark, sf_dir, "v_bed").write.csv(path, sep="\t")
    return io.read_bed(spark, path)


@_query("s3_read_reference", "SELECT concat('bin', CAST(bin AS STRING), chrom) AS chrom, x.p AS bin, x.p * 4096 AS bin_start, substr(bin_seq, 1 + x.p * 4096, 4096) AS bin_seq FROM v_ref, (SELECT unnest([0, 1, 2]::BIGINT[]) AS p) x", "v_ref")
def _(spark, sf_dir):
    path = _temp(spark)
    r = view(spark, sf_dir, "v_ref")
    r.select(F.concat(F.lit(">bin"), "bin", "chrom", F.lit("\n"), F.substring("bin_seq", 1, 5000), F.lit("\n"), F.substring("bin_seq", 5001, 5000)).alias("value")).write.text(path)
    return io.read_reference(spark, path, 4096)


@_query("s4_contigs", "SELECT chrom, CAST(sum(length(bin_seq)) AS BIGINT) AS length FROM v_ref GROUP BY 1", "v_ref")
def _(spark, sf_dir):
    return io.contigs(view(spark, sf_dir, "v_ref"))


@_query("s5_signatures", "SELECT DISTINCT * FROM v_sigs", "v_sigs")
def _(spark, sf_dir):
    path = _temp(spark)
    sigs = U.dedup_signals(view(spark, sf_dir, "v_sigs"))
    io.write_signatures(sigs, path)
    return io.read_signatures(spark, path).select(*sigs.columns)


@_query("s5_signature_lines", """SELECT DISTINCT svtype, chrom, CAST(pos AS DOUBLE) AS pos, CASE WHEN svtype IN ('DEL', 'INS') THEN len END AS len, CASE WHEN svtype IN ('DUP', 'INV', 'TRA') THEN pos2 END AS pos2,
 CASE WHEN svtype = 'TRA' THEN chrom2 END AS chrom2, CASE WHEN svtype = 'INV' THEN strand END AS strand, CASE WHEN svtype = 'TRA' THEN bnd_type END AS bnd_type, read_name, hp,
 CASE WHEN svtype = 'INS' THEN substr(repeat('ACGTTGCA', 600), 1, CAST(len AS INT)) END AS ins_seq FROM v_sigs""", "v_sigs")
def _(spark, sf_dir):
    path = _temp(spark)
    io.write_signatures(_tables(spark, sf_dir)["sig"], path, lines=True)
    return io.read_signatures(spark, path, lines=True).distinct()


@_query("s6_write_vcf")
def _(spark, sf_dir):
    path = _temp(spark)
    names = [(r.chrom, r.length) for r in io.contigs(view(spark, sf_dir, "v_ref")).orderBy("chrom").collect()]  # contigs: a short list by nature
    io.write_vcf(_vcf(spark, sf_dir), io.vcf_header(names), path)
    return spark.read.text(path)


# --- P: reads ---------------------------------------------------------------------------------------------------------


@_query("p1_filter_alignments", "SELECT read_name, chrom, flag, ref_start FROM v_align WHERE flag NOT IN (256, 272)", "v_align")
def _(spark, sf_dir):
    return P.filter_alignments(view(spark, sf_dir, "v_align")).select("read_name", "chrom", "flag", "ref_start")


@_query("p2_restrict_to_bed", "SELECT chrom, ref_start, ref_end, is_primary, read_name, hp FROM v_reads r WHERE EXISTS (SELECT 1 FROM v_bed b WHERE b.chrom = r.chrom AND r.ref_end > b.bed_start - 1000 AND r.ref_start < b.bed_end + 1000)", "v_reads", "v_bed")
def _(spark, sf_dir):
    bed = view(spark, sf_dir, "v_bed").select("chrom", (F.col("bed_start") - 1000).alias("bed_start"), (F.col("bed_end") + 1000).alias("bed_end"))
    return P.restrict_to_bed(_reads(spark, sf_dir), bed)


_SPAN = "300 + q + 30 + ok % 90 + 1 + ok % 50 + 25 + ok % 40 + 200 + ln + 1 + sk % 45 + 150"


@_query("p3_reads_table", f"SELECT chrom, ref_start, ref_start + {_SPAN} AS ref_end, CASE WHEN ln <> 7 AND (ok % 2 = 0 OR ok % 11 <> 0) THEN 1 ELSE 0 END AS is_primary, read_name, hp FROM v_reads WHERE q % 10 <> 0", "v_reads")
def _(spark, sf_dir):
    return P.reads_table(view(spark, sf_dir, "v_align"))


@_query("p4_parse_cigar", f"SELECT read_name, chrom, ref_start, 10 AS n_ops, {_SPAN} AS ref_span, 5 + q AS left_clip, CAST(0 AS BIGINT) AS right_clip FROM v_reads", "v_reads")
def _(spark, sf_dir):
    ops = S.parse_cigar(F.col("cigar"))
    return view(spark, sf_dir, "v_align").select("read_name", "chrom", "ref_start", F.size(ops).alias("n_ops"), S.reference_span(ops).alias("ref_span"), S.left_clip(ops).alias("left_clip"), S.right_clip(ops).alias("right_clip"))


_SIG = f""", a AS (SELECT *, ref_start + 300 + q AS d1, 30 + ok % 90 AS n1, 25 + ok % 40 AS n2, 20 + sk % 80 AS n3, 40 + ok % 30 AS n4,
 substr(repeat('ACGTTGCA', 160), 1, CAST(717 + 2 * q + ok % 50 + ln + sk % 80 + sk % 45 + ok % 30 AS INT)) AS seq, 506 + 2 * q + ok % 50 + ln AS o1 FROM v_reads WHERE q % 10 <> 0),
p AS (SELECT *, d1 + n1 + 1 + ok % 50 AS d2 FROM a), r AS (SELECT *, d2 + n2 + 200 + ln AS i1, d2 + n2 + 201 + ln + sk % 45 AS i2, o1 + n3 + 1 + sk % 45 AS o2 FROM p)"""


@_query("p5_cigar_signals", _SIG + """ SELECT chrom, read_name, hp, 'DEL' AS svtype, d1 AS pos, n1 AS len, CAST(NULL AS VARCHAR) AS bases FROM r
UNION ALL SELECT chrom, read_name, hp, 'DEL', d2, n2, NULL FROM r WHERE n2 >= 30
UNION ALL SELECT chrom, read_name, hp, 'INS', i1, n3, substr(seq, o1 + 1, n3) FROM r WHERE n3 >= 30
UNION ALL SELECT chrom, read_name, hp, 'INS', i2, n4, substr(seq, o2 + 1, n4) FROM r""", "v_reads")
def _(spark, sf_dir):
    return P.cigar_signals(view(spark, sf_dir, "v_align"))


@_query("p6_merge_in_read", _SIG + """, m AS (SELECT *, n2 >= 30 AND d2 - d1 - n1 <= least(n1, n2, 30) AS md, n3 >= 30 AND i2 - i1 <= least(n3, n4, 30) AS mi FROM r)
SELECT chrom, read_name, hp, 'DEL' AS svtype, d1 AS pos, n1 + CASE WHEN md THEN n2 ELSE 0 END AS len, CAST(NULL AS VARCHAR) AS bases FROM m
UNION ALL SELECT chrom, read_name, hp, 'DEL', d2, n2, NULL FROM m WHERE n2 >= 30 AND NOT md
UNION ALL SELECT chrom, read_name, hp, 'INS', i1, n3 + CASE WHEN mi THEN n4 ELSE 0 END, substr(seq, o1 + 1, n3) || CASE WHEN mi THEN substr(seq, o2 + 1, n4) ELSE '' END FROM m WHERE n3 >= 30
UNION ALL SELECT chrom, read_name, hp, 'INS', i2, n4, substr(seq, o2 + 1, n4) FROM m WHERE NOT mi""", "v_reads")
def _(spark, sf_dir):
    return P.merge_in_read(view(spark, sf_dir, "v_align"))


@_query("p7_split_segments", f""", a AS (SELECT *, q % 10 <> 0 AS good FROM v_reads WHERE ok % 4 = 0 AND ln <> 7)
SELECT read_name, hp, 5 + q AS read_start, 717 + 2 * q + ok % 50 + ln + sk % 80 + sk % 45 + ok % 30 AS read_end, ref_start, ref_start + {_SPAN} AS ref_end, chrom, '+' AS strand FROM a WHERE good
UNION ALL SELECT read_name, hp, CASE WHEN ok % 8 = 0 THEN 400 + q ELSE 0 END, CASE WHEN ok % 8 = 0 THEN 400 + q ELSE 0 END + 300 + ln, ref_start + 900 + ok % 700, ref_start + 1200 + ok % 700 + ln,
 concat('chr', CAST(1 + (sk + ok % 3) % 5 AS STRING)), CASE WHEN ok % 8 = 0 THEN '+' ELSE '-' END FROM a WHERE good OR 10 + ok % 50 >= 20""", "v_reads")
def _(spark, sf_dir):
    return P.split_segments(view(spark, sf_dir, "v_align")).select("read_name", "hp", F.inline("segs"))


@_query("p8_clip_points", """, o AS (SELECT *, row_number() OVER (PARTITION BY read_name ORDER BY read_start) AS i, row_number() OVER (PARTITION BY read_name ORDER BY read_start DESC) AS j FROM v_segments)
SELECT chrom, read_name, 0 AS side, ref_start AS pos, hp FROM o WHERE i = 1 UNION ALL SELECT chrom, read_name, 1, ref_end, hp FROM o WHERE j = 1""", "v_segments")
def _(spark, sf_dir):
    return P.clip_points(_split(spark, sf_dir))


@_query("p9_gap_edge_clips", _B + " SELECT chrom, read_name, 2 AS side, CAST(b + x.o AS DOUBLE) AS pos, hp FROM b, (SELECT unnest([0, 300]) AS o) x WHERE k IN (0, 5)", "v_reads")
def _(spark, sf_dir):
    # the second segment moved on in the read, so that both gaps are alike
    moved = F.transform("segs", lambda s, i: s.withField("read_start", s["read_start"] + 290 * i).withField("read_end", s["read_end"] + 290 * i))
    return X.split_signals(_split(spark, sf_dir).withColumn("segs", moved)).filter("rule = 'P9'").select("chrom", "read_name", "side", "pos", "hp")


@_query("p10_reverse_complement", "SELECT read_name, chrom, ref_start, reverse(translate(query_seq, 'ACGTacgt', 'TGCAtgca')) AS seq FROM v_align", "v_align")
def _(spark, sf_dir):
    return view(spark, sf_dir, "v_align").select("read_name", "chrom", "ref_start", S.reverse_complement(F.col("query_seq")).alias("seq"))


# --- X: split reads ---------------------------------------------------------------------------------------------------


def _rule(name: str, rules: tuple[str, ...], columns: tuple[str, ...], sql: str | None, svtype: str | None = None) -> None:
    @_query(name, sql, "v_reads")
    def _(spark, sf_dir):
        found = X.split_signals(_split(spark, sf_dir)).filter(F.col("rule").isin(*rules))
        return (found.filter(F.col("svtype") == svtype) if svtype else found).select("read_name", "hp", "svtype", "chrom", *columns)


_rule("x1_split_dup", ("X1",), ("pos", "pos2"), _B + " SELECT read_name, hp, 'DUP' AS svtype, chrom, CAST(b - 400 AS DOUBLE) AS pos, b AS pos2 FROM b WHERE k = 2")
_rule("x2_split_ins", ("X2",), ("pos", "len"), _B + " SELECT read_name, hp, 'INS' AS svtype, chrom, CAST(b AS DOUBLE) AS pos, CAST(200 AS BIGINT) AS len FROM b WHERE k = 1")
_rule("x3_split_del", ("X3",), ("pos", "len"), _B + " SELECT read_name, hp, 'DEL' AS svtype, chrom, CAST(b + x.o AS DOUBLE) AS pos, CAST(x.n AS BIGINT) AS len FROM b JOIN (VALUES (0, 0, 300), (5, 0, 300), (8, 0, 200), (8, 1200, 300)) AS x(k, o, n) USING (k)")
_rule("x4_split_inv", ("X4",), ("pos", "pos2", "strand"), _B + " SELECT read_name, hp, 'INV' AS svtype, chrom, CAST(b AS DOUBLE) AS pos, b + 3000 AS pos2, '++' AS strand FROM b WHERE k = 3")
_rule("x5_triple_inv", ("X5",), ("pos", "pos2", "strand"), _B + " SELECT read_name, hp, 'INV' AS svtype, chrom, CAST(b + x.o AS DOUBLE) AS pos, b + x.o + 600 AS pos2, x.s AS strand FROM b, (VALUES (0, '++'), (100, '--')) AS x(o, s) WHERE k = 6")
_rule("x6_foreign_middle", ("X6",), ("pos", "len"), _B + " SELECT read_name, hp, 'INS' AS svtype, chrom, CAST(b + 10 AS DOUBLE) AS pos, CAST(380 AS BIGINT) AS len FROM b WHERE k = 7")
_rule("x7_translocation", ("X7",), ("pos", "chrom2", "pos2", "bnd_type"), _B + """ SELECT read_name, hp, 'TRA' AS svtype, least(chrom, far) AS chrom, CAST(CASE WHEN chrom < far THEN b ELSE b + CASE k WHEN 4 THEN 2000 ELSE 3000 END END AS DOUBLE) AS pos,
 greatest(chrom, far) AS chrom2, CASE WHEN chrom < far THEN b + CASE k WHEN 4 THEN 2000 ELSE 3000 END ELSE b END AS pos2, CASE WHEN k = 9 THEN 'B' WHEN chrom < far THEN 'A' ELSE 'D' END AS bnd_type FROM b WHERE k IN (4, 9)""")


@_query("x8_mixed_triples", _B + " SELECT read_name, hp, 'DEL' AS svtype, chrom, CAST(b AS DOUBLE) AS pos, CAST(200 AS BIGINT) AS len FROM b WHERE k = 8", "v_reads")
def _(spark, sf_dir):
    # the last segment turned round: ++- instead of +++
    turned = F.transform("segs", lambda s, i: s.withField("strand", F.when(i == 2, F.when(s["strand"] == "+", "-").otherwise("+")).otherwise(s["strand"])))
    return X.split_signals(_split(spark, sf_dir).withColumn("segs", turned)).filter("rule = 'X8'").select("read_name", "hp", "svtype", "chrom", "pos", "len")


# --- U: unions --------------------------------------------------------------------------------------------------------


@_query("u1_union_signals", "SELECT * FROM v_sigs WHERE svtype = 'DEL' UNION ALL SELECT * FROM v_sigs WHERE svtype = 'INS'", "v_sigs")
def _(spark, sf_dir):
    s = view(spark, sf_dir, "v_sigs")
    return U.union_signals(s.filter("svtype = 'DEL'"), s.filter("svtype = 'INS'"))


@_query("u2_dedup_signals", "SELECT DISTINCT * FROM v_sigs", "v_sigs")
def _(spark, sf_dir):
    s = view(spark, sf_dir, "v_sigs")
    return U.dedup_signals(U.union_signals(s, s))


@_query("u4_signal_chrom_pairs", "SELECT DISTINCT svtype, chrom, chrom2 FROM v_sigs", "v_sigs")
def _(spark, sf_dir):
    return U.signal_chrom_pairs(view(spark, sf_dir, "v_sigs"))


# --- C: clusters ------------------------------------------------------------------------------------------------------


@_query("c1_indel_clusters", _INDEL + " SELECT win_id, pos, len, read_name, hp FROM cl", "v_sigs")
def _(spark, sf_dir):
    return _indel(spark, sf_dir).select("win_id", "pos", "len", "read_name", "hp")


@_query("c2_keep_indel_clusters", _INDEL + " SELECT win_id, count(*) AS n_signals, avg(len) AS mean_len FROM cl GROUP BY 1 HAVING count(*) >= 5 OR avg(len) >= 3000", "v_sigs")
def _(spark, sf_dir):
    return C.keep_indel_clusters(_indel(spark, sf_dir))


@_query("c3_dup_clusters", _DUP + " SELECT win_id, pos, pos2, read_name, hp FROM du_k", "v_sigs")
def _(spark, sf_dir):
    return C.dup_clusters(_sigs(spark, sf_dir, "DUP")).select("win_id", "pos", "pos2", "read_name", "hp")


@_query("c4_inv_clusters", _INV + " SELECT win_id, pos, pos2, strand, read_name, hp FROM iv_k", "v_sigs")
def _(spark, sf_dir):
    return C.inv_clusters(_sigs(spark, sf_dir, "INV")).select("win_id", "pos", "pos2", "strand", "read_name", "hp")


@_query("c4_inv_clusters_by_strand", _chain("'INV'", "pos, pos2, strand, read_name, hp", f"({_FAR}) OR strand <> lag(strand) OVER w", name="iv") + _kept("iv", 2) + " SELECT win_id, pos, pos2, strand, read_name, hp FROM iv_k", "v_sigs")
def _(spark, sf_dir):
    return C.inv_clusters(_sigs(spark, sf_dir, "INV"), min_support=2, split_strand=True).select("win_id", "pos", "pos2", "strand", "read_name", "hp")


@_query("c5_tra_clusters", _TRA + " SELECT win_id, pos, pos2, read_name, hp FROM tr_k", "v_sigs")
def _(spark, sf_dir):
    return C.tra_clusters(_sigs(spark, sf_dir, "TRA")).select("win_id", "pos", "pos2", "read_name", "hp")


@_query("c6_cluster_windows", _WIN + " SELECT win_id, chrom, w_start, w_end FROM win", "v_sigs")
def _(spark, sf_dir):
    return _windows(spark, sf_dir)


# --- J: interval joins ------------------------------------------------------------------------------------------------


@_query("j1_overlapping_reads", _PAIRS + " SELECT win_id, read_name, is_primary, ref_start, ref_end, hp FROM ov", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return J.overlapping_reads(_windows(spark, sf_dir), _reads(spark, sf_dir))


@_query("j2_haplotype_histogram", _HIST + " SELECT win_id, h0, h1, h2 FROM hist", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return J.haplotype_histogram(_windows(spark, sf_dir), _reads(spark, sf_dir))


@_query("j3_covering_reads", _NCOVER + " SELECT win_id, read_name, hp FROM cov", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return J.covering_reads(_tight(spark, sf_dir), _reads(spark, sf_dir))


@_query("j4_overlapping_primary_reads", _WIN + " SELECT win_id, read_name, min(hp) AS hp FROM win JOIN v_reads r ON r.chrom = win.chrom AND ref_start < w_end AND ref_end > w_start AND is_primary = 1 GROUP BY 1, 2", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return J.overlapping_primary_reads(_windows(spark, sf_dir), _reads(spark, sf_dir))


@_query("j5_reference_reads", _REF + " SELECT win_id, dr, r0, r1, r2 FROM ref", "v_reads", "v_sigs")
def _(spark, sf_dir):
    clusters = _indel(spark, sf_dir)
    return J.reference_reads(J.covering_reads(C.cluster_windows(clusters, 0), _reads(spark, sf_dir)), clusters)


@_query("j6_clips_in_window", _WIN + " SELECT win_id, read_name, side, pos, hp FROM win JOIN v_clips c ON c.chrom = win.chrom AND pos > w_start AND pos < w_end AND side IN (0, 1)", "v_clips", "v_sigs")
def _(spark, sf_dir):
    return J.clips_in_window(_windows(spark, sf_dir), view(spark, sf_dir, "v_clips"))


_TRA_CALLS = _TRA + """, first AS (SELECT win_id, chrom, min(pos) AS pos FROM tr_k GROUP BY 1, 2), sup AS (SELECT win_id, read_name, min(hp) AS hp FROM tr_k GROUP BY 1, 2),
more AS (SELECT win_id, read_name, min(hp) AS hp FROM first f JOIN v_clips c ON c.chrom = f.chrom AND c.side = 2 AND c.pos > f.pos - 25 AND c.pos < f.pos + 25 GROUP BY 1, 2)"""


@_query("j7_tra_clip_support", _TRA_CALLS + " SELECT win_id, read_name, hp FROM sup UNION ALL SELECT win_id, read_name, hp FROM more WHERE (win_id, read_name) NOT IN (SELECT win_id, read_name FROM sup)", "v_clips", "v_sigs")
def _(spark, sf_dir):
    clusters = C.tra_clusters(_sigs(spark, sf_dir, "TRA"))
    support = clusters.groupBy("win_id", "read_name").agg(F.min("hp").alias("hp"))
    return J.tra_clip_support(clusters.groupBy("win_id", "chrom").agg(F.min("pos").alias("pos")), support, view(spark, sf_dir, "v_clips"))


_ALLELES_INV = _INV + """, iv_o AS (SELECT *, CASE WHEN pos2 - lag(pos2) OVER (PARTITION BY win_id ORDER BY pos2, pos, strand, read_name) > 500 THEN 1 ELSE 0 END AS n2 FROM iv_k),
iv_a AS (SELECT *, CAST(sum(n2) OVER (PARTITION BY win_id ORDER BY pos2, pos, strand, read_name ROWS UNBOUNDED PRECEDING) AS INT) AS allele FROM iv_o),
iv_b AS (SELECT *, row_number() OVER (PARTITION BY win_id, allele, read_name ORDER BY pos2, pos, strand, read_name) AS turn FROM iv_a),
inv AS (SELECT win_id, chrom, allele, CAST(round_even(avg(pos), 0) AS BIGINT) AS bp1, CAST(round_even(avg(pos2), 0) AS BIGINT) AS bp2, count(*) AS n_signals, CAST(count(*) FILTER (turn = 1) AS INT) AS n_reads,
 arg_min(strand, (pos, pos2, strand)) AS strand, CAST(count(*) FILTER (turn = 1 AND hp = 0) AS INT) AS s0, CAST(count(*) FILTER (turn = 1 AND hp = 1) AS INT) AS s1, CAST(count(*) FILTER (turn = 1 AND hp = 2) AS INT) AS s2
 FROM iv_b GROUP BY 1, 2, 3 HAVING count(*) >= 10 AND count(*) FILTER (turn = 1) >= 10 AND round_even(avg(pos2), 0) - round_even(avg(pos), 0) BETWEEN 50 AND 100000)"""


@_query("j8_two_point_cover", _ALLELES_INV + """, pts AS (SELECT concat_ws(':', win_id, allele) AS win_id, chrom, bp1 AS p FROM inv UNION ALL SELECT concat_ws(':', win_id, allele), chrom, bp2 FROM inv)
SELECT win_id, read_name, min(hp) AS hp FROM pts JOIN v_reads r ON r.chrom = pts.chrom AND is_primary = 1 AND ref_start <= p - 250 AND ref_end >= p + 250 GROUP BY 1, 2""", "v_reads", "v_sigs")
def _(spark, sf_dir):
    made = A.inv_alleles(C.inv_clusters(_sigs(spark, sf_dir, "INV")), ["win_id"])
    return J.two_point_cover(made.select(F.concat_ws(":", "win_id", "allele").alias("win_id"), "chrom", F.col("bp1").alias("pos"), F.col("bp2").alias("pos2")), _reads(spark, sf_dir))


@_query("j9_covering_histogram", _NARROW + " SELECT win_id, count(*) FILTER (hp = 0) AS h0, count(*) FILTER (hp = 1) AS h1, count(*) FILTER (hp = 2) AS h2 FROM win JOIN v_reads r ON r.chrom = win.chrom AND ref_start <= w_start AND ref_end >= w_end GROUP BY 1", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return J.covering_histogram(_tight(spark, sf_dir), _reads(spark, sf_dir))


# --- D: phase ---------------------------------------------------------------------------------------------------------

_BALANCED = _HIST + """, sized AS (SELECT hist.*, split_part(win_id, ':', 1) AS svtype, n_signals FROM hist JOIN (SELECT win_id, count(*) AS n_signals FROM cl GROUP BY 1) USING (win_id)),
bal AS (SELECT *, h0 + abs(h1 - h2) < least(h1, h2) OR (abs(h1 - h2) < h0 AND h0 < greatest(h1, h2)) AS balanced FROM sized)"""


def _balanced(spark, sf_dir):
    clusters = _indel(spark, sf_dir)
    hist = J.haplotype_histogram(C.cluster_windows(clusters, 1000), _reads(spark, sf_dir))
    sized = hist.join(clusters.groupBy("win_id", "svtype").agg(F.count(F.lit(1)).alias("n_signals")), "win_id")
    return sized.withColumn("balanced", D.is_balanced(F.col("h0"), F.col("h1"), F.col("h2"), "DEL"))


@_query("d1_is_balanced", _BALANCED + """ SELECT win_id, balanced AS germline, h0 + abs(h1 - h2) < (h1 + h2) / 2 OR (abs(h1 - h2) < h0 AND h0 < greatest(h1, h2)) AS mosaic,
 h0 + abs(h1 - h2) < 4 * least(h1, h2) OR (abs(h1 - h2) < h0 AND h0 < h1 + h2) AS dup FROM bal""", "v_reads", "v_sigs")
def _(spark, sf_dir):
    h = [F.col(f"h{k}") for k in (0, 1, 2)]
    return _balanced(spark, sf_dir).select("win_id", F.col("balanced").alias("germline"), D.is_balanced(*h, "DEL", "mosaic").alias("mosaic"), D.is_balanced(*h, "DUP").alias("dup"))


@_query("d2_min_support_by_depth", _HIST + " SELECT win_id, CAST(floor(greatest((h0 + h1 + h2) / 10, 2)) AS INT) AS germline_indel, 5 AS mosaic_indel, CAST(greatest(floor((h0 + h1 + h2) * 0.05::DOUBLE), 4) AS INT) AS mosaic_inv, 10 AS germline_dup FROM hist", "v_reads", "v_sigs")
def _(spark, sf_dir):
    depth = F.col("h0") + F.col("h1") + F.col("h2")
    kinds = (("germline_indel", "DEL", "germline"), ("mosaic_indel", "INS", "mosaic"), ("mosaic_inv", "INV", "mosaic"), ("germline_dup", "DUP", "germline"))
    return J.haplotype_histogram(_windows(spark, sf_dir), _reads(spark, sf_dir)).select("win_id", *(D.min_support_by_depth(depth, t, m).alias(n) for n, t, m in kinds))


@_query("d3_route_clusters", _BALANCED + " SELECT win_id, CASE WHEN balanced THEN 'haplotypes' WHEN n_signals < 100 THEN 'dp' ELSE 'length_chain' END AS route FROM bal", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return D.route_clusters(_balanced(spark, sf_dir)).select("win_id", "route")


# --- A: alleles -------------------------------------------------------------------------------------------------------


def _chained(by: str) -> str:
    return f""", o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY len, pos, read_name) AS i FROM cl)"""


def _folded(by: str) -> str:
    keys = [k.strip() for k in by.split(",")]
    match = " AND ".join(f"o.{k} = f.{k}" for k in keys)
    return _INDEL.replace(", cl_s AS", ", RECURSIVE_MARK cl_s AS") + _chained(by) + f""", f AS (SELECT {by}, i, len, pos, read_name, 0 AS allele, CAST(len AS DOUBLE) AS s, 1 AS n FROM o WHERE i = 1
UNION ALL SELECT {", ".join("o." + k for k in keys)}, o.i, o.len, o.pos, o.read_name, f.allele + CASE WHEN o.len - f.s / f.n > 0.9 * (f.s / f.n) THEN 1 ELSE 0 END,
 CASE WHEN o.len - f.s / f.n > 0.9 * (f.s / f.n) THEN o.len ELSE f.s + o.len END, CASE WHEN o.len - f.s / f.n > 0.9 * (f.s / f.n) THEN 1 ELSE f.n + 1 END FROM f JOIN o ON {match} AND o.i = f.i + 1)"""


def _recursive(name: str, by: str, tail: str) -> None:
    _SQL[name] = f"WITH RECURSIVE {ctes('v_sigs')}{_folded(by).replace('RECURSIVE_MARK ', '')}{tail}"


@_query("a1_length_chain_by_haplotype")
def _(spark, sf_dir):
    return A.length_chain(_indel(spark, sf_dir), ["win_id", "hp"]).select("win_id", "hp", "pos", "len", "read_name", "allele")


_recursive("a1_length_chain_by_haplotype", "win_id, hp", " SELECT win_id, hp, pos, len, read_name, allele FROM f")


@_query("a2_length_chain")
def _(spark, sf_dir):
    return A.length_chain(_indel(spark, sf_dir), ["win_id"]).select("win_id", "pos", "len", "read_name", "allele")


_recursive("a2_length_chain", "win_id", " SELECT win_id, pos, len, read_name, allele FROM f")


@_query("a3_allele_stats")
def _(spark, sf_dir):
    made = A.allele_stats(A.length_chain(_indel(spark, sf_dir), ["win_id", "hp"]), ["win_id", "hp"])
    rounded = [F.round(c, 4).alias(c) for c in ("avg_pos", "avg_len", "std_pos", "std_len", "fence_low", "fence_high")]
    return made.select("win_id", "hp", "allele", "n_signals", "n_reads", "min_pos", "max_pos", "min_len", "max_len", "cipos", "cilen", *rounded)


_recursive("a3_allele_stats", "win_id, hp", """, st AS (SELECT win_id, hp, allele, count(*) AS n_signals, count(DISTINCT read_name) AS n_reads, avg(pos) AS avg_pos, min(pos) AS min_pos, max(pos) AS max_pos, avg(len) AS avg_len, min(len) AS min_len, max(len) AS max_len,
 stddev_pop(pos) AS std_pos, stddev_pop(len) AS std_len, quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.75) AS q3 FROM f GROUP BY 1, 2, 3)
SELECT win_id, hp, allele, n_signals, n_reads, min_pos, max_pos, min_len, max_len, concat('-', CAST(floor(1.96::DOUBLE * std_pos / sqrt(n_signals)) AS BIGINT), ',', CAST(floor(1.96::DOUBLE * std_pos / sqrt(n_signals)) AS BIGINT)) AS cipos,
 concat('-', CAST(floor(1.96::DOUBLE * std_len / sqrt(n_signals)) AS BIGINT), ',', CAST(floor(1.96::DOUBLE * std_len / sqrt(n_signals)) AS BIGINT)) AS cilen, round(avg_pos, 4) AS avg_pos, round(avg_len, 4) AS avg_len, round(std_pos, 4) AS std_pos, round(std_len, 4) AS std_len,
 round(greatest(q1 - 1.5::DOUBLE * (q3 - q1), min_len), 4) AS fence_low, round(least(q3 + 1.5::DOUBLE * (q3 - q1), max_len), 4) AS fence_high FROM st""")

_ALLELES_DUP = _DUP + """, du_o AS (SELECT *, CASE WHEN pos2 - lag(pos2) OVER (PARTITION BY win_id ORDER BY pos2, pos, read_name) > 500 THEN 1 ELSE 0 END AS n2 FROM du_k),
du_a AS (SELECT *, CAST(sum(n2) OVER (PARTITION BY win_id ORDER BY pos2, pos, read_name ROWS UNBOUNDED PRECEDING) AS INT) AS allele FROM du_o),
du_b AS (SELECT *, row_number() OVER (PARTITION BY win_id, allele, read_name ORDER BY pos2, pos) AS turn, row_number() OVER (PARTITION BY win_id, allele ORDER BY pos2, pos, read_name) - 1 AS i, count(*) OVER (PARTITION BY win_id, allele) AS n FROM du_a),
dup AS (SELECT win_id, chrom, allele, CAST(floor(avg(pos) FILTER (m)) AS BIGINT) AS bp1, CAST(floor(avg(pos2) FILTER (m)) AS BIGINT) AS bp2, CAST(count(*) FILTER (turn = 1) AS INT) AS n_reads,
 CAST(count(*) FILTER (turn = 1 AND hp = 0) AS INT) AS s0, CAST(count(*) FILTER (turn = 1 AND hp = 1) AS INT) AS s1, CAST(count(*) FILTER (turn = 1 AND hp = 2) AS INT) AS s2
 FROM (SELECT *, i >= floor(n * 0.4::DOUBLE) AND i < greatest(floor(n * 0.6::DOUBLE), floor(n * 0.4::DOUBLE) + 1) AS m FROM du_b) GROUP BY 1, 2, 3
 HAVING count(*) FILTER (turn = 1) >= 10 AND floor(avg(pos2) FILTER (m)) - floor(avg(pos) FILTER (m)) BETWEEN 50 AND 100000)"""


@_query("a5_dup_alleles", _ALLELES_DUP + " SELECT * FROM dup", "v_sigs")
def _(spark, sf_dir):
    return A.dup_alleles(C.dup_clusters(_sigs(spark, sf_dir, "DUP")), ["win_id"])


@_query("a6_inv_alleles", _ALLELES_INV + " SELECT * FROM inv", "v_sigs")
def _(spark, sf_dir):
    return A.inv_alleles(C.inv_clusters(_sigs(spark, sf_dir, "INV")), ["win_id"])


_ALLELES_TRA = _TRA + """, tr_o AS (SELECT *, CASE WHEN pos2 - lag(pos2) OVER (PARTITION BY win_id ORDER BY pos2, pos, read_name) > 50 THEN 1 ELSE 0 END AS n2 FROM tr_k),
tr_a AS (SELECT *, CAST(sum(n2) OVER (PARTITION BY win_id ORDER BY pos2, pos, read_name ROWS UNBOUNDED PRECEDING) AS INT) AS allele FROM tr_o),
tr_b AS (SELECT *, row_number() OVER (PARTITION BY win_id, allele, read_name ORDER BY pos2, pos) AS turn FROM tr_a),
tr_g AS (SELECT win_id, chrom, chrom2, bnd_type, allele, CAST(floor(avg(pos)) AS BIGINT) AS bp1, CAST(floor(avg(pos2)) AS BIGINT) AS bp2, CAST(count(*) AS INT) AS n_reads, CAST(count(*) FILTER (hp = 0) AS INT) AS s0, CAST(count(*) FILTER (hp = 1) AS INT) AS s1, CAST(count(*) FILTER (hp = 2) AS INT) AS s2
 FROM tr_b WHERE turn = 1 GROUP BY 1, 2, 3, 4, 5),
tra AS (SELECT *, CASE bnd_type WHEN 'A' THEN 'N[' || chrom2 || ':' || bp2 || '[' WHEN 'B' THEN 'N]' || chrom2 || ':' || bp2 || ']' WHEN 'C' THEN '[' || chrom2 || ':' || bp2 || '[N' ELSE ']' || chrom2 || ':' || bp2 || ']N' END AS alt
 FROM tr_g WHERE n_reads > 1 QUALIFY row_number() OVER (PARTITION BY win_id ORDER BY n_reads DESC, allele) <= 2)"""


@_query("a7_tra_alleles", _ALLELES_TRA + " SELECT * FROM tra", "v_sigs")
def _(spark, sf_dir):
    return A.tra_alleles(C.tra_clusters(_sigs(spark, sf_dir, "TRA")))


@_query("a8_bnd_alt", "SELECT read_name, pos, bnd_type, CASE bnd_type WHEN 'A' THEN 'N[' || chrom2 || ':' || pos2 || '[' WHEN 'B' THEN 'N]' || chrom2 || ':' || pos2 || ']' WHEN 'C' THEN '[' || chrom2 || ':' || pos2 || '[N' ELSE ']' || chrom2 || ':' || pos2 || ']N' END AS alt FROM v_sigs WHERE svtype = 'TRA'", "v_sigs")
def _(spark, sf_dir):
    return view(spark, sf_dir, "v_sigs").filter("svtype = 'TRA'").select("read_name", "pos", "bnd_type", A.bnd_alt(F.col("bnd_type"), F.col("chrom2"), F.col("pos2")).alias("alt"))


@_query("a9_insert_sequence")
def _(spark, sf_dir):
    ins = _indel(spark, sf_dir).filter("svtype = 'INS'").withColumn("ins_seq", F.substring(F.repeat(F.lit("ACGTTGCA"), F.lit(600)), F.lit(1), F.col("len").cast("int")))
    return A.insert_sequence(A.length_chain(ins, ["win_id", "hp"]), ["win_id", "hp"])


_recursive("a9_insert_sequence", "win_id, hp", " SELECT win_id, hp, allele, substr(repeat('ACGTTGCA', 600), 1, CAST(floor(avg(len)) AS INT)) AS ins_seq FROM f WHERE win_id LIKE 'INS:%' GROUP BY 1, 2, 3")


@_query("u3_union_calls", _DUP + _ALLELES_DUP.removeprefix(_DUP) + _ALLELES_INV + " SELECT win_id, chrom, bp1, bp2, n_reads, CAST(NULL AS VARCHAR) AS strand FROM dup UNION ALL SELECT win_id, chrom, bp1, bp2, n_reads, strand FROM inv", "v_sigs")
def _(spark, sf_dir):
    dup = A.dup_alleles(C.dup_clusters(_sigs(spark, sf_dir, "DUP")), ["win_id"]).select("win_id", "chrom", "bp1", "bp2", "n_reads")
    inv = A.inv_alleles(C.inv_clusters(_sigs(spark, sf_dir, "INV")), ["win_id"]).select("win_id", "chrom", "bp1", "bp2", "n_reads", "strand")
    return U.union_calls(dup, inv)


# --- G: genotypes -----------------------------------------------------------------------------------------------------


@_query("g1_genotype_likelihood", _GL + " SELECT win_id, dv, dr, gt0 AS gt, pl, gq, qual FROM gl", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return G.assign_genotype_mosaic(_calls(spark, sf_dir)).select("win_id", "dv", "dr", "gt", "pl", "gq", "qual")


# overlapping primary reads against, as for mosaic deletions and insertions: the same likelihoods over other counts
_OVERLAP = _WIN + """, cov AS (SELECT win_id, read_name, min(hp) AS hp FROM win JOIN v_reads r ON r.chrom = win.chrom AND ref_start < w_end AND ref_end > w_start AND is_primary = 1 GROUP BY 1, 2)"""


@_query("g11_assign_genotype_mosaic", _OVERLAP + _GL.removeprefix(_NCOVER) + " SELECT win_id, dv, dr, gt0 AS gt, pl, gq, qual FROM gl", "v_reads", "v_sigs")
def _(spark, sf_dir):
    clusters, reads = _indel(spark, sf_dir), _reads(spark, sf_dir)
    names = clusters.groupBy("win_id", "read_name").agg(F.min("hp").alias("hp"))
    against = J.reference_reads(J.overlapping_primary_reads(C.cluster_windows(clusters, 1000), reads), names)
    counts = names.groupBy("win_id").agg(F.count(F.lit(1)).alias("dv")).join(against, "win_id", "left").withColumn("dr", F.coalesce("dr", F.lit(0)))
    return G.assign_genotype_mosaic(counts).select("win_id", "dv", "dr", "gt", "pl", "gq", "qual")


@_query("g2_assign_genotype", _GL + " SELECT win_id, dv, dr, gt, pl, gq, qual FROM gt", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return G.genotyped(_calls(spark, sf_dir)).select("win_id", "dv", "dr", "gt", "pl", "gq", "qual")


@_query("g3_zero_weak_quality", _GL + " SELECT win_id, CASE WHEN dv / (dv + dr) < 0.25 AND qual < 20 THEN 0.0 ELSE qual END AS qual FROM gt", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return G.genotyped(_calls(spark, sf_dir)).select("win_id", G.zero_weak_quality(F.col("qual"), F.col("dv"), F.col("dr"), F.lit(False)).alias("qual"))


@_query("g4_search_window", _INDEL + ", p AS (SELECT win_id, CAST(floor(avg(pos)) AS BIGINT) AS m, min(pos) AS a, max(pos) AS b FROM cl GROUP BY 1) SELECT win_id, greatest(m - 1000, least(a, b - 1000)) AS w_start, least(m + 1000, greatest(b, a + 1000)) + CASE WHEN greatest(m - 1000, least(a, b - 1000)) = least(m + 1000, greatest(b, a + 1000)) THEN 1 ELSE 0 END AS w_end FROM p", "v_sigs")
def _(spark, sf_dir):
    at = _indel(spark, sf_dir).groupBy("win_id").agg(F.floor(F.avg("pos")).alias("m"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    start, end = G.search_window(F.col("m"), F.col("a"), F.col("b"), 1000)
    return at.select("win_id", start.alias("w_start"), end.alias("w_end"))


@_query("g5_revise_haplotype", _GL + " SELECT win_id, concat(CASE WHEN gt[1] = '1' AND s1 < r1 THEN '.' ELSE gt[1] END, '|', CASE WHEN gt[3] = '1' AND s2 < r2 THEN '.' ELSE gt[3] END) AS gt FROM gt", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return G.genotyped(_calls(spark, sf_dir)).select("win_id", G.revise_haplotype(*(F.col(c) for c in ("gt", "s1", "s2", "r1", "r2"))).alias("gt"))


_UP = "dr * log10({a}::DOUBLE) + dv * log10({b}::DOUBLE) + log10(0.4::DOUBLE)"


@_query("g6_upgrade_unphased", _CALLS + f", l AS (SELECT *, {_UP.format(a=0.9, b=0.1)} AS x0, {_UP.format(a=0.1, b=0.9)} AS x2, (dr + dv) * log10(0.5::DOUBLE) + log10(0.2::DOUBLE) AS x1 FROM calls) SELECT win_id, CASE WHEN x2 > x1 AND x2 > x0 THEN '1|1' WHEN x1 > x2 AND x1 > x0 THEN CASE WHEN s1 > s2 THEN '1|0' ELSE '0|1' END ELSE '.|.' END AS gt FROM l", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return _calls(spark, sf_dir).select("win_id", G.upgrade_unphased(F.lit(".|."), F.col("dv"), F.col("dr"), F.col("s1"), F.col("s2")).alias("gt"))


_FEW = ", few AS (SELECT win_id, CASE WHEN dv % 3 = 0 THEN '0|0' ELSE gt END AS gt, dv % 7 AS dv, dv % 7 * 5 + dr % 11 AS dr, s1, s2, r1, r2, CASE WHEN dv % 2 = 0 THEN 'INV' ELSE 'TRA' END AS svtype, 40 + dv AS svlen FROM gt)"


def _few(spark, sf_dir):
    """Calls with low counts, for the mosaic rules."""
    g = G.genotyped(_calls(spark, sf_dir))
    n = F.col("dv")
    return g.select("win_id", F.when(n % 3 == 0, "0|0").otherwise(F.col("gt")).alias("gt"), (n % 7).alias("dv"), (n % 7 * 5 + F.col("dr") % 11).alias("dr"), "s1", "s2", "r1", "r2", F.when(n % 2 == 0, "INV").otherwise("TRA").alias("svtype"), (40 + n).alias("svlen"))


@_query("g7_resolve_same_position", _GL + """, n AS (SELECT win_id AS allele, substr(win_id, 1, 8) AS win_id, CAST(dv % 2 AS BIGINT) AS pos, gt FROM gt),
h AS (SELECT *, count(*) FILTER (gt[1] = '1') OVER w AS a, count(*) FILTER (gt[3] = '1') OVER w AS b, count(*) FILTER (gt = '1|1') OVER w AS c, count(*) FILTER (gt IN ('1|0', '1|.')) OVER w AS x, count(*) FILTER (gt IN ('0|1', '.|1')) OVER w AS y,
 row_number() OVER (PARTITION BY win_id, pos ORDER BY CASE WHEN gt = '1|1' THEN 0 ELSE 1 END, allele) AS i FROM n WINDOW w AS (PARTITION BY win_id, pos))
SELECT win_id, allele, pos, CASE WHEN (a > 1 OR b > 1) AND c = 0 AND (CASE WHEN x > 1 THEN gt IN ('1|0', '1|.') ELSE y > 1 AND gt IN ('0|1', '.|1') END) THEN '.|.' ELSE gt END AS gt FROM h WHERE NOT (a > 1 OR b > 1) OR gt <> '1|1' OR i = 1""", "v_reads", "v_sigs")
def _(spark, sf_dir):
    g = G.genotyped(_calls(spark, sf_dir))
    return G.resolve_same_position(g.select(F.substring("win_id", 1, 8).alias("win_id"), F.col("win_id").alias("allele"), (F.col("dv") % 2).alias("pos"), "gt"))


@_query("g8_mosaic_filter_indel", _GL + _FEW + " SELECT win_id, dv, dr, gt FROM few WHERE gt NOT LIKE '%1%' AND svlen >= 50 AND dv >= 2 AND dv / (dv + dr) BETWEEN 0.05 AND 0.4", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return G.mosaic_filter_indel(_few(spark, sf_dir)).select("win_id", "dv", "dr", "gt")


@_query("g9_mosaic_filter_inv_tra", _GL + _FEW + " SELECT win_id, svtype, dv, dr, gt FROM few WHERE gt NOT LIKE '%1%' AND (svtype <> 'TRA' OR dv >= greatest(floor((dv + dr) * 0.05::DOUBLE), 4))", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return G.mosaic_filter_inv_tra(_few(spark, sf_dir)).select("win_id", "svtype", "dv", "dr", "gt")


def _side(at: int, h: int, stays: str) -> str:
    s, r = f"s{h}", f"r{h}"
    return f"CASE WHEN gt[{at}] = '1' AND NOT ({s} + {r} > 0 AND ({stays.format(s=s, r=r)})) THEN '.' ELSE gt[{at}] END"


_INDEL_STAYS, _INV_STAYS = "{s} / ({s} + {r}) >= 0.9 OR {r} < 2", "{s} / ({s} + {r}) > 0.7"


@_query("g10_revise_haplotype_mosaic", _GL + f" SELECT win_id, concat({_side(1, 1, _INDEL_STAYS)}, '|', {_side(3, 2, _INDEL_STAYS)}) AS indel, concat({_side(1, 1, _INV_STAYS)}, '|', {_side(3, 2, _INV_STAYS)}) AS inv FROM gt", "v_reads", "v_sigs")
def _(spark, sf_dir):
    c = [F.col(x) for x in ("gt", "s1", "s2", "r1", "r2")]
    return G.genotyped(_calls(spark, sf_dir)).select("win_id", G.revise_haplotype_mosaic(*c, "DEL").alias("indel"), G.revise_haplotype_mosaic(*c, "INV").alias("inv"))


# --- V: output columns ------------------------------------------------------------------------------------------------

_PLACED = _GL + """, placed AS (SELECT gt.*, chrom, pos, svlen, split_part(win_id, ':', 1) AS svtype FROM gt JOIN (SELECT win_id, chrom, CAST(floor(avg(pos)) AS BIGINT) AS pos, CAST(floor(avg(len)) AS BIGINT) AS svlen FROM cl GROUP BY 1, 2) USING (win_id))"""


def _placed(spark, sf_dir):
    clusters = _indel(spark, sf_dir)
    at = clusters.groupBy("win_id", "svtype", "chrom").agg(F.floor(F.avg("pos")).alias("pos"), F.floor(F.avg("len")).alias("svlen"))
    calls = G.genotyped(jobs.counted(C.cluster_windows(clusters, 0), clusters, _reads(spark, sf_dir)))
    return calls.join(at, "win_id").withColumn("call_id", F.col("win_id"))


def _with_bases(spark, sf_dir):
    calls = _placed(spark, sf_dir)
    text = F.substring(F.repeat(F.lit("ACGTTGCA"), F.lit(600)), F.lit(1), F.col("svlen").cast("int"))
    return V.ref_alt(calls.withColumn("ins_seq", text).withColumn("alt", F.lit(None).cast("string")), _dense_ref(spark, sf_dir), 10_000)


def _dense_ref(spark, sf_dir):
    """Bases of every site in bins of 10 kb."""
    return view(spark, sf_dir, "v_ref").select("chrom", F.col("bin"), F.col("bin_start"), "bin_seq")


def _vcf(spark, sf_dir):
    full = _with_bases(spark, sf_dir).withColumns({"cipos": F.lit("0,0"), "cilen": F.lit("0,0"), "strand": F.lit(None).cast("string")})
    return V.number_calls(V.vcf_fields(V.size_filter(full)))


@_query("v1_filter_label", _GL + " SELECT win_id, CASE WHEN gt IN ('.|0', '0|.', '.|.') THEN 'q5' WHEN qual >= 5 THEN 'PASS' ELSE 'q5' END AS filter FROM gt", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return G.genotyped(_calls(spark, sf_dir)).select("win_id", V.filter_label(F.col("gt"), F.col("qual")).alias("filter"))


@_query("v2_allele_frequency", _GL + " SELECT win_id, round(dv / (dv + dr), 4) AS af FROM gt", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return G.genotyped(_calls(spark, sf_dir)).select("win_id", V.allele_frequency(F.col("dv"), F.col("dr")).cast("double").alias("af"))


@_query("v3_ref_alt", _PLACED + """, rf AS (SELECT *, repeat('ACGTTGCAAT', 3000) AS tape FROM placed),
cut AS (SELECT *, CASE WHEN svtype = 'DEL' THEN greatest(pos - 1, 0) ELSE greatest(pos - 1, 0) END AS f, CASE WHEN svtype = 'DEL' THEN pos + svlen ELSE greatest(pos - 1, 0) + 1 END AS t FROM rf),
held AS (SELECT cut.win_id, string_agg(substr(bin_seq, CAST(greatest(f, bin_start) - bin_start + 1 AS INT), CAST(least(t - bin_start, 10000) - (greatest(f, bin_start) - bin_start) AS INT)), '' ORDER BY v_ref.bin) AS ref FROM cut JOIN v_ref ON v_ref.chrom = cut.chrom AND v_ref.bin BETWEEN floor(f / 10000) AND floor((t - 1) / 10000) GROUP BY 1)
SELECT cut.win_id, coalesce(ref, 'N') AS ref, CASE WHEN svtype = 'DEL' THEN substr(coalesce(ref, 'N'), 1, 1) ELSE coalesce(ref, 'N') || substr(repeat('ACGTTGCA', 600), 1, CAST(svlen AS INT)) END AS alt FROM cut LEFT JOIN held USING (win_id)""", "v_reads", "v_sigs", "v_ref")
def _(spark, sf_dir):
    return _with_bases(spark, sf_dir).select("win_id", "ref", "alt")


@_query("v4_vcf_fields", _PLACED + """ SELECT win_id, pos AS vcf_pos, CASE WHEN svtype = 'DEL' THEN concat('PRECISE;SVTYPE=DEL;SVLEN=-', svlen, ';END=', pos + svlen, ';CIPOS=0,0;CILEN=0,0;RE=', dv, ';STRAND=+-') ELSE concat('PRECISE;SVTYPE=INS;SVLEN=', svlen, ';END=', pos, ';CIPOS=0,0;CILEN=0,0;RE=', dv) END AS info,
 concat_ws(':', gt, dr, dv, pl, gq) AS sample FROM placed""", "v_reads", "v_sigs")
def _(spark, sf_dir):
    full = _placed(spark, sf_dir).withColumns({"cipos": F.lit("0,0"), "cilen": F.lit("0,0"), "strand": F.lit(None).cast("string")})
    return V.vcf_fields(full, genotype=False).select("win_id", "vcf_pos", "info", "sample")


@_query("v5_size_filter", _PLACED + " SELECT win_id, svlen FROM placed WHERE svlen <= 1000", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return V.size_filter(_placed(spark, sf_dir), 1000).select("win_id", "svlen")


@_query("v6_number_calls", _PLACED + " SELECT win_id, concat(svtype, row_number() OVER (PARTITION BY svtype ORDER BY chrom, pos, win_id) - 1) AS id FROM placed", "v_reads", "v_sigs")
def _(spark, sf_dir):
    return V.number_calls(_placed(spark, sf_dir)).select("win_id", "id")


# --- by sample: the same over two samples in one table ------------------------------------------------------------------

_OF = "CASE WHEN CAST(right(read_name, 1) AS INT) % 2 = 0 THEN 's1' ELSE 's2' END AS sample_id"
_S_TABLES = f", s_sigs AS (SELECT {_OF}, * FROM v_sigs), s_reads AS (SELECT {_OF}, * FROM v_reads)"
_S_INDEL = _S_TABLES + _chain("'DEL', 'INS'", "pos, len, read_name, hp, pos2, chrom2, strand, bnd_type", "pos - lag(pos) OVER w > 1000", "sample_id, svtype, chrom").replace("FROM v_sigs", "FROM s_sigs")
_S_WIN = _S_INDEL + ", win AS (SELECT sample_id, win_id, chrom, greatest(min(pos) - 1000, 0) AS w_start, max(pos) + 1000 AS w_end FROM cl GROUP BY 1, 2, 3)"


def _of_samples(df: DataFrame) -> DataFrame:
    return df.withColumn("sample_id", F.when(F.right("read_name", F.lit(1)).cast("int") % 2 == 0, "s1").otherwise("s2"))


def _s_indel(spark, sf_dir):
    return C.indel_clusters(_of_samples(_sigs(spark, sf_dir, "DEL", "INS")))


@_query("c1_indel_clusters_by_sample", _S_INDEL + " SELECT sample_id, win_id, pos, len, read_name, hp FROM cl", "v_sigs", "v_reads")
def _(spark, sf_dir):
    return _s_indel(spark, sf_dir).select("sample_id", "win_id", "pos", "len", "read_name", "hp")


@_query("j1_overlapping_reads_by_sample", _S_WIN + """ SELECT DISTINCT ON (win_id, read_name) win_id, read_name, r.is_primary, ref_start, ref_end, hp FROM win JOIN s_reads r ON r.sample_id = win.sample_id AND r.chrom = win.chrom AND ref_start < w_end AND ref_end > w_start
 ORDER BY win_id, read_name, r.is_primary DESC, ref_start, ref_end, hp""", "v_sigs", "v_reads")
def _(spark, sf_dir):
    return J.overlapping_reads(C.cluster_windows(_s_indel(spark, sf_dir), 1000), _of_samples(_reads(spark, sf_dir)))


@_query("v6_number_calls_by_sample", _S_INDEL + """, put AS (SELECT sample_id, win_id, svtype, chrom, CAST(floor(avg(pos)) AS BIGINT) AS pos FROM cl GROUP BY 1, 2, 3, 4)
SELECT sample_id, win_id, concat(svtype, row_number() OVER (PARTITION BY sample_id, svtype ORDER BY chrom, pos, win_id) - 1) AS id FROM put""", "v_sigs", "v_reads")
def _(spark, sf_dir):
    at = _s_indel(spark, sf_dir).groupBy("sample_id", F.col("win_id").alias("call_id"), "svtype", "chrom").agg(F.floor(F.avg("pos")).alias("pos"))
    return V.number_calls(at).select("sample_id", F.col("call_id").alias("win_id"), "id")


# --- E: jobs ----------------------------------------------------------------------------------------------------------


def _tables(spark, sf_dir):
    """Signals with the bases of insertions, clips and reads of the views."""
    sig = U.dedup_signals(view(spark, sf_dir, "v_sigs"))
    bases = F.when(F.col("svtype") == "INS", F.substring(F.repeat(F.lit("ACGTTGCA"), F.lit(600)), F.lit(1), F.col("len").cast("int")))
    return {"sig": sig.withColumn("ins_seq", bases), "clips": view(spark, sf_dir, "v_clips"), "reads": _reads(spark, sf_dir)}


def _routed(spark, sf_dir, job, mode="germline"):
    """Kept deletion and insertion clusters with where their alleles are formed."""
    t, p = _tables(spark, sf_dir), Params()
    clusters = job.kept("clusters", C.indel_clusters(t["sig"].filter("svtype in ('DEL', 'INS')"), p.gap_indel))
    told = job.kept("routes", jobs.routes(clusters, t["reads"], p, mode))
    return t, clusters.join(told.select("win_id"), "win_id", "left_semi"), told


def _job_query(name: str) -> Callable:
    """A query whose steps keep tables: its result is written, then those go."""

    def add(f: Callable) -> Callable:
        def run(spark, sf_dir):
            with Job(spark) as job:
                return job.result(f(spark, sf_dir, job))

        return _query(name)(run)

    return add


@_job_query("a4_allele_dp")
def _(spark, sf_dir, job):
    _, clusters, told = _routed(spark, sf_dir, job)
    return allele_dp(clusters.join(told.filter("route = 'dp'").select("win_id"), "win_id", "left_semi"))


@_job_query("a10_rescue_clips")
def _(spark, sf_dir, job):
    # each pooled cluster as one call, every signal's read its support
    t, clusters, told = _routed(spark, sf_dir, job)
    pooled = clusters.join(told.filter("route <> 'haplotypes'").select("win_id"), "win_id", "left_semi")
    chained = A.length_chain(pooled, ["win_id"])
    call = F.concat_ws("/", "win_id", "allele").alias("call_id")
    made = chained.groupBy("win_id", "svtype", "allele").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    calls = R.ranked(made, F.desc("n"), "allele").select(call, "win_id", "rank", (F.col("low") - 50).alias("c_low"), (F.col("high") + 50).alias("c_high"), (F.col("svtype") == "INS").alias("both_sides"), F.lit(None).cast("array<int>").alias("haplotypes"), F.lit(True).alias("rescue"))
    support = chained.select(call, "win_id", "read_name", "hp").distinct()
    return R.rescue_clips(calls, support, J.clips_in_window(C.cluster_windows(clusters, 1000), t["clips"]))


def _merged_indels(spark, sf_dir, job, mode):
    _, clusters, told = _routed(spark, sf_dir, job, mode)
    p = Params()
    chained = job.kept("chained", A.length_chain(clusters.join(told.filter("route = 'haplotypes'").select("win_id"), "win_id", "left_semi"), ["win_id", "hp"]))
    need = told.select("win_id", F.col("least") if mode == "germline" else F.lit(p.min_support).alias("least"))
    return R.merge_haplotypes_indel(chained, jobs.haplotype_alleles(chained, told, p, mode), need, p, mode)[0].drop("ins_seq")


@_job_query("a11_merge_haplotypes_indel")
def _(spark, sf_dir, job):
    return _merged_indels(spark, sf_dir, job, "germline")


@_job_query("a11_merge_haplotypes_indel_mosaic")
def _(spark, sf_dir, job):
    return _merged_indels(spark, sf_dir, job, "mosaic")


def _merged_two(spark, sf_dir, job, svtype, mode):
    t, p = _tables(spark, sf_dir), Params()
    clusters = job.kept("clusters", jobs.all_clusters(t["sig"].filter(F.col("svtype") == svtype), p, mode))
    alleles, support = jobs.two_breakpoint_alleles(clusters, job.kept("routes", jobs.routes(clusters, t["reads"], p, mode)), p, mode)
    alleles, support = job.kept("alleles", alleles), job.kept("support", support)
    return R.merge_haplotypes_two_breakpoints(jobs.revised_two_breakpoint(alleles, support, t["reads"], p, mode), mode == "mosaic")


@_job_query("a12_merge_haplotypes_dup")
def _(spark, sf_dir, job):
    return _merged_two(spark, sf_dir, job, "DUP", "germline")


@_job_query("a12_merge_haplotypes_inv")
def _(spark, sf_dir, job):
    return _merged_two(spark, sf_dir, job, "INV", "germline")


@_job_query("a13_merge_haplotypes_inv_mosaic")
def _(spark, sf_dir, job):
    return _merged_two(spark, sf_dir, job, "INV", "mosaic")


def _signatures(name: str) -> Callable:
    return lambda spark, sf_dir: jobs.extract_signatures(view(spark, sf_dir, "v_align"))[name]


for _name, _table in (("e1_extract_signatures", "sig"), ("e1_extract_clips", "clips"), ("e1_extract_reads", "reads")):
    _query(_name)(_signatures(_table))


@_job_query("e2_call_germline")
def _(spark, sf_dir, job):
    return jobs.call_germline(_tables(spark, sf_dir), job=job)[0]


@_job_query("e3_call_mosaic")
def _(spark, sf_dir, job):
    return jobs.call_mosaic(_tables(spark, sf_dir), job=job)[0]


@_query("e4_write_calls")
def _(spark, sf_dir):
    path = _temp(spark)
    with Job(spark) as job:
        calls, support = jobs.call_germline(_tables(spark, sf_dir), job=job)
        jobs.write_calls(calls, _dense_ref(spark, sf_dir), 10_000, path, support=support)
    return spark.read.text(path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
