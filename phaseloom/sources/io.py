"""S: alignments, regions, references, signatures and call files."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.keys import CHAIN_BITS, SAMPLE, chain_bin

#: Columns of the signature lines of each type, in order.
LINES = {
    "DEL": ("chrom", "pos", "len", "read_name", "svtype", "hp"),
    "INS": ("chrom", "pos", "len", "read_name", "ins_seq", "svtype", "hp"),
    "DUP": ("chrom", "pos", "pos2", "read_name", "svtype", "hp"),
    "INV": ("chrom", "strand", "pos", "pos2", "read_name", "svtype", "hp"),
    "TRA": ("chrom", "bnd_type", "pos", "chrom2", "pos2", "read_name", "svtype", "hp"),
}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one on a single machine, an error elsewhere."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, path)
    return system.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    system, where = _file_system(spark, path)
    system.delete(where, True)


def delete_on_exit(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the application ends, if nobody has by then."""
    system, where = _file_system(spark, path)
    system.mkdirs(where)  # only what is there can be marked
    system.deleteOnExit(where)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read again; the table goes when the application ends."""
    path = delete_on_exit(df.sparkSession, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_alignments(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """Alignments from Parquet, or from SAM text where the path ends in .sam; the haplotype is 0 where untagged.

    ``sample`` names the sample of all rows, as ``sample_id``; a Parquet table may have that column itself.
    """
    named = {} if sample is None else {"sample_id": F.lit(sample)}
    if not path.rstrip("/").endswith(".sam"):
        df = spark.read.parquet(path)
        return df.withColumns({"hp": F.coalesce("hp", F.lit(0)), **named})
    lines = spark.read.text(path).filter(~F.col("value").startswith("@"))
    f = F.split("value", "\t")
    tag = lambda name, kind: F.nullif(F.regexp_extract("value", rf"\t{name}:{kind}:([^\t]*)", 1), F.lit(""))
    return lines.select(
        f[0].alias("read_name"),
        f[2].alias("chrom"),
        f[1].cast("int").alias("flag"),
        f[4].cast("int").alias("mapq"),
        (f[3].cast("long") - 1).alias("ref_start"),
        F.coalesce(tag("HP", "i").cast("int"), F.lit(0)).alias("hp"),
        f[5].alias("cigar"),
        F.length(f[9]).alias("query_len"),
        f[9].alias("query_seq"),
        tag("SA", "Z").alias("sa"),
        *(c.alias(n) for n, c in named.items()),
    )


def sam_header(spark: SparkSession, path: str, most: int = 100_000) -> list[str]:
    """The header lines of the SAM text files in ``path``, of the first file that has any; ``most`` lines at most, or an error.

    Only the beginning of each file is read, through the file system that has it, up to its first alignment.
    """
    system, where = _file_system(spark, path)
    java = spark.sparkContext._jvm.java.io
    codecs = spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(where) or []
    files = [f for x in found for f in (system.listStatus(x.getPath()) if x.isDirectory() else [x]) if not f.isDirectory() and f.getPath().getName()[:1] not in "._"]
    for file in sorted(files, key=lambda f: f.getPath().toString()):
        stream, codec = system.open(file.getPath()), codecs.getCodec(file.getPath())
        reader = java.BufferedReader(java.InputStreamReader(stream if codec is None else codec.createInputStream(stream), "UTF-8"))
        try:
            out, line = [], reader.readLine()
            while line is not None and line.startswith("@"):
                if len(out) == most:
                    raise ValueError(f"over {most} header lines in {file.getPath()}")
                out.append(line)
                line = reader.readLine()
        finally:
            reader.close()
        if out:
            return out
    return []


def _tags(line: str) -> dict[str, str]:
    return dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)


def contigs_of_sam(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length) from header lines; alignments aren't read."""
    rows = [(t["SN"], int(t["LN"])) for line in sam_header(spark, path) if line.startswith("@SQ") for t in [_tags(line)]]
    return spark.createDataFrame(rows, "chrom string, length long")


def sample_of_sam(spark: SparkSession, path: str) -> str | None:
    """The one sample that the read groups of a SAM header name; none if there is none, an error if there are several."""
    names = {t["SM"] for line in sam_header(spark, path) if line.startswith("@RG") for t in [_tags(line)] if "SM" in t}
    if len(names) > 1:
        raise ValueError(f"several samples in {path}: {sorted(names)}")
    return next(iter(names), None)


def read_bed(spark: SparkSession, path: str, pad: int = 1000) -> DataFrame:
    """Regions, widened on both sides."""
    df = spark.read.csv(path, sep="\t", schema="chrom string, bed_start long, bed_end long")
    return df.select("chrom", (F.col("bed_start") - pad).alias("bed_start"), (F.col("bed_end") + pad).alias("bed_end"))


def read_reference(spark: SparkSession, path: str, bin_size: int = 1 << 16) -> DataFrame:
    """(chrom, bin, bin_start, bin_seq) of FASTA files.

    Lines are read in splits as they lie; within a split each line gets its contig and offset by running sums, and a table
    of a row for each split carries both on to the next. So a contig is no task's, and no line is searched twice.
    """
    where = ["file", "block"]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.trim("value").alias("text"))
    head = F.startswith("text", F.lit(">"))
    marked = lines.select(*where, "row", F.when(head, F.regexp_extract("text", r"^>\s*(\S+)", 1)).alias("name"), F.when(~head, F.col("text")).alias("bases"))
    marked = marked.withColumn("n", F.coalesce(F.length("bases"), F.lit(0)).cast("long"))
    inside = Window.partitionBy(*where).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    told = marked.withColumns({"own": F.last("name", ignorenulls=True).over(inside), "total": F.sum("n").over(inside)})
    told = told.withColumn("since", F.last(F.when(F.col("name").isNotNull(), F.col("total")), ignorenulls=True).over(inside))
    splits = told.groupBy(*where).agg(F.max(F.struct("row", "own", (F.col("total") - F.coalesce("since", F.lit(0))).alias("tail"))).alias("end"), F.count("name").alias("heads"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    runs = splits.withColumn("run", F.coalesce(F.sum(F.when(F.col("heads") > 0, 1).otherwise(0)).over(before), F.lit(0)))
    same = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select(*where, F.last("end.own", ignorenulls=True).over(before).alias("carried"), F.col("run"), F.col("heads"), F.col("end.tail").alias("tail"))
    # bases of the open contig before this split: of splits since its last header
    opened = carried.filter("heads > 0").select("file", (F.col("run") + 1).alias("run"), F.col("tail").alias("opening"))
    plain = F.coalesce(F.sum(F.when(F.col("heads") == 0, F.col("tail")).otherwise(0)).over(same), F.lit(0))
    offsets = carried.withColumn("plain", plain).join(opened, ["file", "run"], "left").select(*where, "carried", (F.col("plain") + F.coalesce("opening", F.lit(0))).alias("ahead"))
    placed = told.filter("n > 0").join(offsets, where)
    start = F.col("total") - F.col("n") - F.coalesce("since", F.lit(0)) + F.when(F.col("own").isNull(), F.col("ahead")).otherwise(0)
    placed = placed.select(F.coalesce("own", "carried").alias("chrom"), start.alias("start"), "n", "bases").filter("chrom is not null")
    at = F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("start") + F.col("n") - 1) / bin_size))).alias("bin")
    part = placed.select("chrom", "start", "n", "bases", at).withColumn("low", F.greatest(F.col("bin") * bin_size, "start"))
    cut = F.col("bases").substr((F.col("low") - F.col("start") + 1).cast("int"), (F.least((F.col("bin") + 1) * bin_size, F.col("start") + F.col("n")) - F.col("low")).cast("int"))
    whole = part.groupBy("chrom", "bin").agg(F.array_sort(F.collect_list(F.struct("low", cut.alias("bases")))).alias("parts"))
    return whole.select("chrom", "bin", (F.col("bin") * bin_size).alias("bin_start"), F.array_join(F.transform("parts", lambda x: x["bases"]), "").alias("bin_seq"))


def contigs(ref_bins: DataFrame) -> DataFrame:
    """(chrom, length) of a reference in bins."""
    return ref_bins.groupBy("chrom").agg(F.sum(F.length("bin_seq")).alias("length"))


def write_signatures(sigs: DataFrame, path: str, lines: bool = False) -> None:
    """Signals for re-use, by chromosome; ``lines``: as text of one type, tab-separated."""
    if not lines:
        sigs.write.partitionBy("chrom").parquet(path)
        return
    kinds = [r.svtype for r in sigs.select("svtype").distinct().collect()]  # five types at most
    for kind in kinds:
        # an empty field where there is nothing, so that every line has all its fields
        columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in LINES[kind]]
        sigs.filter(F.col("svtype") == kind).select(F.concat_ws("\t", *columns).alias("value")).write.text(os.path.join(path, kind))


def read_signatures(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Signals that write_signatures() has written. Of ``lines``, columns that a type lacks are null, and positions are double."""
    if not lines:
        return spark.read.parquet(path)
    kinds = {"pos": "double", "len": "long", "pos2": "long", "hp": "int"}
    columns = list(dict.fromkeys(c for names in LINES.values() for c in names))
    parts = []
    for kind, names in LINES.items():
        if exists(spark, os.path.join(path, kind)):
            own = spark.read.csv(os.path.join(path, kind), sep="\t", schema=", ".join(f"{c} {kinds.get(c, 'string')}" for c in names), quote="", nullValue=None, emptyValue="")
            parts.append(own.select(*((F.col(c) if c in names else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in columns)))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))
    return reduce(DataFrame.unionByName, parts)


def store_signatures(sigs: DataFrame, name: str, path: str, buckets: int = 256) -> None:
    """Signals as the table ``name`` in ``path``, without identical rows, for any number of runs over them.

    A folder for each type and chromosome, and in it buckets of the bins in which chains are looked for (of each sample, where
    there are several): chains and U2 take the table as it lies, without a shuffle of signals, and a region reads its buckets.
    """
    binned = sigs.withColumn("_bin", chain_bin(F.col("pos")))
    own = [*([SAMPLE] if SAMPLE in sigs.columns else []), "_bin"]
    dealt = binned.dropDuplicates().repartition(buckets, *own)
    dealt.write.partitionBy("svtype", "chrom").bucketBy(buckets, *own).sortBy(*own, "pos").format("parquet").option("path", path).mode("overwrite").saveAsTable(name)


def stored_signatures(spark: SparkSession, name: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    """Signals of store_signatures(), or those with a position in ``region`` (chromosome, start, end), both ends included."""
    table = spark.table(name)
    if region is None:
        return table
    chrom, start, end = region
    first, last = (int(x) >> CHAIN_BITS for x in (start, end))
    return table.filter((F.col("chrom") == chrom) & F.col("_bin").isin(*range(first, last + 1)) & F.col("pos").between(start, end))


def vcf_header(contig_rows: list[tuple[str, int]], sample: str = "NULL", command: str | None = None, date: str | None = None) -> str:
    """Header text; contigs are few, so they come as rows. ``date`` of the file, now by default; ``command`` that made it."""
    info = (
        ("PRECISE", "0", "Flag", "Precise structural variant"),
        ("IMPRECISE", "0", "Flag", "Structural variant without a precise place"),
        ("SVTYPE", "1", "String", "Type of structural variant"),
        ("SVLEN", "1", "Integer", "Difference in length between REF and ALT"),
        ("CHR2", "1", "String", "Chromosome of the other breakend of a translocation"),
        ("END", "1", "Integer", "End position of the variant"),
        ("CIPOS", "2", "Integer", "Confidence interval around POS"),
        ("CILEN", "2", "Integer", "Confidence interval around the length"),
        ("RE", "1", "Integer", "Reads that support the variant"),
        ("STRAND", "A", "String", "Strand orientation"),
        ("RNAMES", ".", "String", "Names of supporting reads"),
        ("AF", "A", "Float", "Allele frequency"),
    )
    form = (("GT", "1", "String", "Genotype"), ("DR", "1", "Integer", "Reads for the reference"), ("DV", "1", "Integer", "Reads for the variant"), ("PL", "G", "Integer", "Phred-scaled likelihoods"), ("GQ", "1", "Integer", "Genotype quality"))
    out = ["##fileformat=VCFv4.2", "##source=phaseloom", f"##fileDate={date or time.strftime('%Y-%m-%d %H:%M:%S')}"]
    out += [*(f"##contig=<ID={c},length={n}>" for c, n in contig_rows), *(f'##ALT=<ID={t},Description="{t}">' for t in ("INS", "DEL", "DUP", "INV", "BND"))]
    out += [f'##INFO=<ID={a},Number={b},Type={c},Description="{d}">' for a, b, c, d in info]
    out += ['##FILTER=<ID=q5,Description="Quality below 5">', *(f'##FORMAT=<ID={a},Number={b},Type={c},Description="{d}">' for a, b, c, d in form)]
    out += [] if command is None else ['##CommandLine="' + command.replace('"', "'").replace("\n", " ") + '"']
    return "\n".join([*out, "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])])


def vcf_lines(calls: DataFrame) -> DataFrame:
    """One line of text a call, with its sample, where there is one, and what it is sorted by."""
    qual = F.coalesce(F.col("qual").cast("string"), F.lit("."))
    line = F.concat_ws("\t", "chrom", F.col("vcf_pos").cast("string"), "id", "ref", "alt", qual, "filter", "info", "format", "sample")
    return calls.select(*([SAMPLE] if SAMPLE in calls.columns else []), "chrom", "pos", "id", line.alias("value"))


def write_vcf(calls: DataFrame, header: str, path: str) -> None:
    """One VCF as the parts of a folder, in the order of their names: the header leads the first part, as no chromosome sorts first.

    Calls of several samples make one such folder for each, ``path``/sample_id=..., by one sort; the last column of a header
    is its sample.
    """
    lines = vcf_lines(calls)
    blank = lambda skip: [F.lit(None).cast(t).alias(c) for c, t in lines.dtypes if c not in skip]
    order = [F.asc_nulls_first("chrom"), "pos", "id"]
    if SAMPLE not in lines.columns:
        top = lines.sparkSession.range(1).select(*blank(["value"]), F.lit(header).alias("value"))
        top.unionByName(lines).orderBy(*order).select("value").write.text(path)
        return
    lead = header.rpartition("\t")[0]
    top = lines.select(SAMPLE).distinct().select(SAMPLE, *blank([SAMPLE, "value"]), F.concat(F.lit(lead + "\t"), SAMPLE).alias("value"))
    sorted_ = top.unionByName(lines).repartitionByRange(SAMPLE, *order).sortWithinPartitions(SAMPLE, *order)
    sorted_.select(SAMPLE, "value").write.partitionBy(SAMPLE).text(path)
