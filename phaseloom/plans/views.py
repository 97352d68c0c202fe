"""Genome tables derived from ``lineitem``, as SQL text that Spark and DuckDB read alike, but for a form for Spark where that costs less."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_reads": """
SELECT concat('chr', CAST(1 + l_suppkey % 5 AS STRING)) AS chrom,
       (l_partkey - l_partkey % 20) * 500 + 5000 - 80 * CAST(l_quantity AS BIGINT) AS ref_start,
       (l_partkey - l_partkey % 20) * 500 + 5000 + 80 * (1 + l_orderkey % 50) AS ref_end,
       CASE WHEN l_linenumber % 7 = 0 THEN 0 ELSE 1 END AS is_primary,
       concat('r', CAST(l_orderkey AS STRING)) AS read_name,
       CASE WHEN l_partkey % 80 < 20 OR l_orderkey % 9 = 0 THEN 0 ELSE 1 + CAST(l_orderkey % 2 AS INT) END AS hp,
       l_partkey - l_partkey % 20 AS site, l_orderkey AS ok, l_linenumber AS ln, CAST(l_quantity AS BIGINT) AS q, l_suppkey AS sk
FROM lineitem""",
    "v_sigs": """
SELECT CASE WHEN site % 100 = 0 THEN 'DEL' WHEN site % 100 = 20 THEN 'INS' WHEN site % 100 = 40 THEN 'DUP'
            WHEN site % 100 = 60 THEN 'INV' ELSE 'TRA' END AS svtype,
       chrom, site * 500 + 4980 + ok % 40 AS pos,
       80 + site % 2000 + ok % 5 + CASE WHEN hp = 2 AND site % 140 = 0 THEN 1500 ELSE 0 END AS len,
       site * 500 + 5060 + site % 2000 + ok % 45 AS pos2,
       concat('chr', CAST(1 + (sk + 1) % 5 AS STRING)) AS chrom2,
       CASE WHEN ok % 3 = 0 THEN '--' ELSE '++' END AS strand,
       substr('ABCD', 1 + CAST((site % 160 - site % 40) / 40 AS INT), 1) AS bnd_type,
       read_name, hp
FROM v_reads
WHERE q > 3 AND ( site % 60 = 0 OR (site % 60 = 20 AND (hp = 1 OR (hp = 0 AND ok % 4 = 0))) OR (site % 60 = 40 AND ok % 12 = 0) )""",
    "v_clips": """
SELECT chrom, read_name, 0 AS side, ref_start AS pos, hp FROM v_reads WHERE is_primary = 1
UNION ALL
SELECT chrom, read_name, 1 AS side, ref_end AS pos, hp FROM v_reads WHERE is_primary = 1
UNION ALL
SELECT chrom, read_name, CAST(ok % 2 AS INT) AS side, site * 500 + 4950 + ok % 100 AS pos, hp FROM v_reads WHERE q <= 3
UNION ALL
SELECT chrom, read_name, 2 AS side, site * 500 + 4985 + ok % 30 AS pos, hp FROM v_reads WHERE q <= 3 AND site % 100 = 80""",
    "v_align": """
SELECT read_name, chrom,
       CASE WHEN ln = 7 THEN 2048 WHEN ok % 2 = 0 THEN 0 WHEN ok % 11 = 0 THEN 256 ELSE 16 END AS flag,
       CASE WHEN q % 10 = 0 THEN 5 ELSE 60 END AS mapq, ref_start, hp,
       concat(CAST(5 + q AS STRING), 'S', CAST(300 + q AS STRING), 'M', CAST(30 + ok % 90 AS STRING), 'D',
              CAST(1 + ok % 50 AS STRING), 'M', CAST(25 + ok % 40 AS STRING), 'D', CAST(200 + ln AS STRING), 'M',
              CAST(20 + sk % 80 AS STRING), 'I', CAST(1 + sk % 45 AS STRING), '=', CAST(40 + ok % 30 AS STRING), 'I',
              '150X') AS cigar,
       717 + 2 * q + ok % 50 + ln + sk % 80 + sk % 45 + ok % 30 AS query_len,
       substr(repeat('ACGTTGCA', 160), 1, CAST(717 + 2 * q + ok % 50 + ln + sk % 80 + sk % 45 + ok % 30 AS INT)) AS query_seq,
       CASE WHEN ok % 4 = 0 THEN concat('chr', CAST(1 + (sk + ok % 3) % 5 AS STRING), ',',
              CAST(ref_start + 900 + ok % 700 AS STRING), ',', CASE WHEN ok % 8 = 0 THEN '+' ELSE '-' END, ',',
              CAST(400 + q AS STRING), 'S', CAST(300 + ln AS STRING), 'M,', CAST(10 + ok % 50 AS STRING), ',0;')
            ELSE NULL END AS sa
FROM v_reads""",
    "v_segments": """
SELECT concat(r.read_name, '_', CAST(r.site AS STRING), '_', CAST(r.q AS STRING), '_', CAST(r.sk AS STRING)) AS read_name, r.hp,
       p.idx, p.rs AS read_start, p.re AS read_end, p.read_len,
       r.site * 500 + 5000 + r.ok % 40 + p.o1 AS ref_start, r.site * 500 + 5000 + r.ok % 40 + p.o2 AS ref_end,
       CASE WHEN p.far = 1 THEN concat('chr', CAST(1 + (r.sk + 1) % 5 AS STRING)) ELSE r.chrom END AS chrom,
       p.strand
FROM (SELECT DISTINCT read_name, hp, site, ok, q, sk, chrom FROM v_reads WHERE ln = 1) r
JOIN (VALUES (0, 1, 0, 1000, 2000, -1000, 0, 0, '+'), (0, 2, 1000, 2000, 2000, 300, 1300, 0, '+'),
             (1, 1, 0, 1000, 2200, -1000, 0, 0, '+'), (1, 2, 1200, 2200, 2200, 0, 1000, 0, '+'),
             (2, 1, 0, 1000, 2000, -1000, 0, 0, '+'), (2, 2, 1000, 2000, 2000, -400, 600, 0, '+'),
             (3, 1, 0, 1000, 2000, -1000, 0, 0, '+'), (3, 2, 1000, 2000, 2000, 2000, 3000, 0, '-'),
             (4, 1, 0, 1000, 2000, -1000, 0, 0, '+'), (4, 2, 1000, 2000, 2000, 2000, 3000, 1, '+'),
             (5, 1, 0, 1000, 2000, 300, 1300, 0, '-'), (5, 2, 1000, 2000, 2000, -1000, 0, 0, '-'),
             (6, 1, 0, 1000, 2500, -1000, 0, 0, '+'), (6, 2, 1000, 1500, 2500, 100, 600, 0, '-'), (6, 3, 1500, 2500, 2500, 700, 1700, 0, '+'),
             (7, 1, 0, 1000, 2400, -1000, 0, 0, '+'), (7, 2, 1000, 1400, 2400, 2000, 2400, 1, '+'), (7, 3, 1400, 2400, 2400, 20, 1020, 0, '+'),
             (8, 1, 0, 1000, 3000, -1000, 0, 0, '+'), (8, 2, 1000, 2000, 3000, 200, 1200, 0, '+'), (8, 3, 2000, 3000, 3000, 1500, 2500, 0, '+'),
             (9, 1, 0, 1000, 2000, -1000, 0, 0, '+'), (9, 2, 1000, 2000, 2000, 2000, 3000, 1, '-'))
     AS p(k, idx, rs, re, read_len, o1, o2, far, strand)
  ON r.ok % 10 = p.k""",
    "v_bed": "SELECT DISTINCT chrom, site * 500 + 4000 AS bed_start, site * 500 + 6000 AS bed_end FROM v_reads WHERE site % 200 = 0",
    "v_ref": "SELECT DISTINCT chrom, CAST(site / 20 AS BIGINT) AS bin, site * 500 AS bin_start, repeat('ACGTTGCAAT', 1000) AS bin_seq FROM v_reads",
}
#: The same rows in the form that Spark runs, where it differs: what is alike in all rows isn't a key to be shuffled.
SPARK_VIEWS = VIEWS | {
    "v_ref": "SELECT *, repeat('ACGTTGCAAT', 1000) AS bin_seq FROM (SELECT DISTINCT chrom, CAST(site / 20 AS BIGINT) AS bin, site * 500 AS bin_start FROM v_reads)",
}
_NEEDS = {name: [other for other in ("lineitem", *VIEWS) if f" {other}" in text.replace("\n", " ")] for name, text in VIEWS.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the table in ``sf_dir``; no name is registered in the session."""
    if name == "lineitem":
        return spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = SPARK_VIEWS[name]
    needed = {other: view(spark, sf_dir, other) for other in _NEEDS[name] if other != name}
    for other in needed:
        text = text.replace(f"FROM {other}", "FROM {" + other + "}")
    return spark.sql(text, **needed)


def ctes(*names: str) -> str:
    """The same views as leading CTEs for DuckDB, each after those that it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            if other not in ("lineitem", name):
                add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
