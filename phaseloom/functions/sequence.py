"""CIGAR text and base sequences as columns: expressions over a row, and the reverse complement by Arrow batches."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def parse_cigar(cigar: Column) -> Column:
    """Ordered array of struct(op, len); null or empty text gives an empty array."""
    parts = F.filter(F.split(F.coalesce(cigar, F.lit("")), "(?<=[MIDNSHP=X])"), lambda x: F.length(x) > 1)
    return F.transform(parts, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), x.substr(F.lit(1), F.length(x) - 1).try_cast("long").alias("len")))


def _total(ops: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["op"].isin(*kinds), x["len"]).otherwise(0))


def reference_span(ops: Column) -> Column:
    """Reference bases that an alignment covers."""
    return _total(ops, ("M", "D", "N", "=", "X"))


def query_span(ops: Column) -> Column:
    """Read bases within an alignment, without clips."""
    return _total(ops, ("M", "I", "=", "X"))


def _edge_clip(ops: Column) -> Column:
    first = F.get(ops, F.lit(0))
    return F.coalesce(F.when(first["op"].isin("S", "H"), first["len"]), F.lit(0).cast("long"))


def left_clip(ops: Column) -> Column:
    """Length of the clip before the alignment; where both kinds are given the hard one counts."""
    return _edge_clip(ops)


def right_clip(ops: Column) -> Column:
    """Length of the clip after the alignment."""
    return _edge_clip(F.reverse(ops))


_COMPLEMENT = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")


@F.arrow_udf(StringType())
def reverse_complement(seq: pa.Array) -> pa.Array:
    """The complement of a batch's bytes by one table; other characters, of several bytes too, stay."""
    valid, at, data = seq.buffers()
    turned = pa.py_buffer((b"" if data is None else data.to_pybytes()).translate(_COMPLEMENT))
    return pc.utf8_reverse(pa.Array.from_buffers(seq.type, len(seq), [valid, at, turned], offset=seq.offset))


def reverse_complement_of_few(seq: Column) -> Column:
    """The same as an expression, for short texts of few rows, which then needn't leave their stage."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))
