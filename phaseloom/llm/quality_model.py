"""Operator 1, quality classifier: an interpolated modified Kneser-Ney model of byte 5-grams.

Trusted documents are those labelled of good quality and not toxic. Half of them, taken by a hash of their identifier, train
the counts; all others, unseen by the model, set for each language the quantile of perplexity above which a document is
rejected. Counts, contexts and continuation counts are tables, sharded
by gram; the grams of all documents are joined with them order by order, and each document gets its perplexity for each
byte.

Null and empty texts have no perplexity and are rejected. A null language, and one without trusted documents, takes the
quantile over all languages. Repeated rows are scored each; of repeated labels of a document the worst counts. An empty
table gives an empty result, and without trusted documents nothing is rejected but empty texts. Extra columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .grams import blocks, gram_runs, scored, single, totals

ORDER = 5
#: A quantile over n documents is off by at most n / ACCURACY ranks; up to so many it is exact.
ACCURACY = 100_000
#: A document is kept up to this quantile of its language's trusted documents.
QUANTILE = 0.99


def trained_counts(docs: DataFrame) -> DataFrame:
    """(key, n): 5-grams of all documents given (id, text)."""

    def work(batch: pa.RecordBatch):
        for _, _, keys, ids, _ in gram_runs(batch.column(1), ORDER - 1):
            yield {"key": keys, "n": np.bincount(ids, minlength=len(keys))}

    return C.in_arrow(docs, work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n >= 3, d[2]).when(n == 2, d[1]).when(n == 1, d[0]).otherwise(0.0)


def _levels(counts: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], list[DataFrame]]:
    """For orders 1 to ORDER: (key, top), the discounted share of a gram, and (context, back), what is left to lower orders.

    Also the written tables of counts that these read.
    """
    found, now, written = [], counts, []
    for order in range(ORDER, 0, -1):
        now = C.durable(now)
        written.append(now)
        few = {r.n: r.c for r in now.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
        n1, n2, n3, n4 = (few.get(k, 0) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        d = [min(max(x, 0.05), k - 0.05) for k, x in enumerate(raw, 1)]
        context = F.shiftright("key", 8).alias("context")
        sums = now.groupBy(context).agg(F.sum("n").alias("total"), F.sum(_discount(F.col("n"), d)).alias("spared"))
        grams = now.select("key", context, (F.col("n") - _discount(F.col("n"), d)).alias("over")).join(sums, "context").select("key", (F.col("over") / F.col("total")).alias("top"))
        found.append((grams, sums.select("context", (F.col("spared") / F.col("total")).alias("back"))))
        # a lower order counts the distinct letters that stand before a gram
        now = now.groupBy(F.col("key").bitwiseAND((1 << 8 * (order - 1)) - 1).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return found[::-1], written


def log_probabilities(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, value): log10 of the model's probability of the last byte of each gram in ``asked``, which are distinct.

    A table that the next one supersedes is deleted; the last one is written and stays.
    """
    levels, written = _levels(counts)
    wanted = [asked.select("key")]
    for order in range(ORDER - 1, 0, -1):
        wanted.append(wanted[-1].select(F.col("key").bitwiseAND((1 << 8 * order) - 1).alias("key")).distinct())
    below: DataFrame | None = None
    for order, keys in enumerate(wanted[::-1], 1):
        grams, contexts = levels[order - 1]
        now = keys.join(grams, "key", "left").withColumn("context", F.shiftright("key", 8)).join(contexts, "context", "left")
        if below is None:
            now = now.withColumn("lower", F.lit(1 / 256))
        else:
            now = now.withColumn("suffix", F.col("key").bitwiseAND((1 << 8 * (order - 1)) - 1)).join(below, "suffix")
        p = F.coalesce("top", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("lower")
        names = ("key", "value") if order == ORDER else ("suffix", "lower")
        made, last = C.durable(now.select(F.col("key").alias(names[0]), (F.log10(p) if order == ORDER else p).alias(names[1]))), below
        below = made
        C.discard(*([] if last is None else [last]), written.pop())
    return below


def perplexities(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, lang, perplexity) of documents given (id, text, lang)."""

    def grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([keys for _, _, keys, _, _ in gram_runs(batch.column(1), ORDER - 1)]))
        return keys, keys[:0]

    def score(batch: pa.RecordBatch, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for row, end, own, ids, to in gram_runs(batch.column(1), ORDER - 1):
            value = values[np.minimum(np.searchsorted(keys, own), len(keys) - 1)]
            total[row:end] += np.add.reduceat(value[ids], to[:-1])
            n[row:end] += np.diff(to)
        found = pa.array(np.where(n > 1, 10.0 ** (-total / n), np.nan), from_pandas=True)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), found], ["doc_id", "lang", "perplexity"])

    stored = blocks(docs, grams)
    asked = C.durable(totals(stored).select("key"))
    known = log_probabilities(asked, counts)
    C.discard(asked)
    C.drop_shuffles(docs.sparkSession)
    answers = known.withColumn("value", single(F.col("value")))
    found = C.durable(scored(stored, answers, score, "doc_id long, lang string, perplexity double"))
    C.discard(stored, known)
    C.drop_shuffles(docs.sparkSession)
    return found


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trusted: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) for each row of ``df``.

    All of the trusted half trains the counts, unless ``trusted`` asks for about half of so many documents of a language.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    good = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x")).filter("q = 1 and x = 0")
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == 0
    able = docs.select("id", "lang").join(good.filter(half).select("id"), "id", "left_semi").distinct()
    if trusted is not None:
        # a hash of the identifier in [0, 1), below the share of its language that the bound allows
        place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
        shares = able.groupBy("lang").agg((F.lit(trusted / 2) / F.count(F.lit(1))).alias("share"))
        able = able.join(F.broadcast(shares), able["lang"].eqNullSafe(shares["lang"])).filter(place < F.col("share"))
    trained = C.durable(able.select("id").distinct())
    counts = C.durable(trained_counts(docs.select("id", "text").join(trained, "id", "left_semi")))
    found = perplexities(docs, counts)
    C.discard(counts)
    unseen = good.select("id").join(trained, "id", "left_anti").withColumnRenamed("id", "doc_id")
    held = C.durable(found.join(unseen, "doc_id", "left_semi").filter("perplexity is not null").select("lang", "perplexity"))
    bound = F.expr(f"percentile_approx(perplexity, {quantile}D, {ACCURACY})")
    by_lang = held.filter("lang is not null").groupBy("lang").agg(bound.alias("own"))
    overall = held.agg(bound.alias("all"))
    # a row for each language, and one row
    judged = found.join(F.broadcast(by_lang), "lang", "left").join(F.broadcast(overall)).withColumn("threshold", F.coalesce("own", "all", F.lit(math.inf)))
    return judged.select("doc_id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every whole text of ``documents``, trained on ``labels``."""
    return classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
