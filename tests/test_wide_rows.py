"""What makes rows wide, bases and lines of text, isn't shuffled as a key, kept plain on disk or turned letter by letter."""

import glob
import os

from phaseloom.functions import sequence as S
from phaseloom.operators import split as X
from phaseloom.plans import registry
from phaseloom.plans.views import view
from phaseloom.sources import io
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bases_are_no_key_of_the_reference(spark):
    ref = view(spark, SF, "v_ref")
    assert ref.columns == ["chrom", "bin", "bin_start", "bin_seq"] and ref.count() == ref.distinct().count()
    keys = [line for line in _plan(ref).splitlines() if "Aggregate" in line]
    keyed = [line.split("], [")[0] for line in keys]
    assert keyed and not any("ACGTTGCAAT" in key or "bin_seq" in key for key in keyed)


def test_sam_text_is_written_compressed(spark):
    before = set(glob.glob(f"{io.shared_folder(spark).removeprefix('file:')}/*/table.sam/*"))
    registry.queries()["s1_read_sam"](spark, SF)
    made = [f for f in set(glob.glob(f"{io.shared_folder(spark).removeprefix('file:')}/*/table.sam/*")) - before if os.path.basename(f).startswith("part-")]
    assert made and all(f.endswith(".gz") for f in made)


def test_reverse_complement_by_batches(spark):
    texts = ["ACGTacgtN*", "", None, "Aé字C", "G" * 1000 + "\n"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(1)
    made = df.select("k", S.reverse_complement(F.col("t")).alias("r"), S.reverse_complement_of_few(F.col("t")).alias("few"))
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    turned = [t if t is None else t[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca")) for t in texts]
    assert [(r.r, r.few) for r in made.orderBy("k").collect()] == [(t, t) for t in turned]


def test_bases_of_the_minus_strand_at_both_ends(spark):
    seq = "AACCGGTTAC"
    at = [(q, n) for q in range(13) for n in range(1, 13)]
    df = spark.createDataFrame([(q, n, seq) for q, n in at], "q long, n long, s string")
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for minus, text in ((True, back), (False, seq)):
        got = df.select("q", "n", X.insert_bases(F.col("s"), F.col("q"), F.col("n"), F.lit(minus)).alias("b")).collect()
        assert {(r.q, r.n): r.b for r in got} == {(q, n): text[q : q + n] for q, n in at}
