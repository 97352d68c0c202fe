"""The quality model counts all documents that may train it, however many a language has."""

from phaseloom.llm import quality_model
from pyspark.sql import functions as F


def test_all_of_the_trusted_half_trains(spark, monkeypatch):
    n, seen = 24_000, []
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))

    class Told(Exception):
        pass

    def counted(rows):
        seen.append(rows.count())
        raise Told

    monkeypatch.setattr(quality_model, "trained_counts", counted)
    try:
        quality_model.classify(docs, labels)
    except Told:
        pass
    half = spark.range(n).filter(F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == 0).count()
    assert half > 10_000 and seen == [half]
