"""What several operators share: reading tables, durable cuts of lineage, and whole Arrow batches as NumPy arrays."""

from __future__ import annotations

import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 20

#: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CONTINUATION = (np.arange(256) & 0xC0) == 0x80
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_TABLES: list[DataFrame] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is taken on a single machine, as in tests; elsewhere that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` written as Parquet in the shared folder and read again. It survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stored_at = path
    _TABLES.append(made)
    return made


def bucketed(df: DataFrame, n: int, column: str) -> DataFrame:
    """As durable(), in ``n`` buckets of a column: a later grouping by it takes them as they are, without a shuffle."""
    name = f"phaseloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.format("parquet").bucketBy(n, column).option("path", path).saveAsTable(name)
    made = df.sparkSession.table(name)
    made.stored_at, made.stored_as = path, name
    _TABLES.append(made)
    return made


def tables() -> list[DataFrame]:
    """The tables of durable() that haven't been discarded."""
    return list(_TABLES)


def discard(*tables: DataFrame) -> None:
    """Delete tables of durable() that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        if "stored_as" in vars(table):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.stored_as}")
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _TABLES[:] = [t for t in _TABLES if t is not table]


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are out of reach: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def distinct_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the identifier and the text, null as empty, under the names id and text: extra columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions: the one knob by which a user sizes the work."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, end to end, and its n + 1 offsets into them."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of at most ``limit`` bytes, or of one longer document."""
    raw, at = bytes_of(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[raw]


class Words:
    """Where the words ``[^\\x20\\x09-\\x0D]+`` of a chunk lie, or those of the bytes that ``word`` marks."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, word: np.ndarray | None = None) -> None:
        n = len(raw)
        word = ~SPACE[raw] if word is None else word
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        heads = at[:-1][at[:-1] < at[1:]]
        tails = at[1:][at[:-1] < at[1:]] - 1
        first[heads] = word[heads]
        last[tails] = word[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: n + 1 offsets of the documents into the words.
        self.at = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.at))
        assert n == at[-1]


_MIX = np.random.default_rng(42).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2**64 to the powers 0 to n - 1; kept for the next chunk."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = n + n // 8
        made = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(size, base, np.uint64)
            steps[:1] = 1
            made.append(np.cumprod(steps))
        if size > 8 * CHUNK_BYTES:
            return made[0][:n], made[1][:n]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


#: Values summed at once: a longer array, of one very long text, takes no more memory for its powers and sums.
_SUMMED = 4 * CHUNK_BYTES


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run values[start:end]; values: bytes, or 64-bit hashes of words."""
    n = len(values)
    size = min(n, _SUMMED)
    p, q = _powers(size + 1)
    if n == size:
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_MIX[values] if values.dtype == np.uint8 else values) * p[:-1], out=sums[1:])
        return mixed((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64))
    low, high, scale = (np.zeros(len(start), np.uint64) for _ in range(3))
    total, up, down = np.uint64(0), np.uint64(1), np.uint64(1)
    for at in range(0, n + 1, size):
        part = values[at : at + size]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_MIX[part] if values.dtype == np.uint8 else part) * p[: len(part)] * up, out=sums[1:])
        sums += total
        total = sums[-1]
        for place, out in ((start, low), (end, high)):
            here = (place >= at) & (place < at + size)
            out[here] = sums[place[here] - at]
        here = (start >= at) & (start < at + size)
        scale[here] = q[start[here] - at] * down
        up, down = (np.uint64(int(x) * int(y[size]) % 2**64) for x, y in ((up, p), (down, q)))
    return mixed((high - low) * scale + (end - start).astype(np.uint64))


def per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags over each document."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def column_names(schema: str) -> list[str]:
    """Names of the columns of a schema in words, without those within them."""
    while "<" in schema:
        schema = re.sub("<[^<>]*>", "", schema)
    return [part.split()[0] for part in schema.split(",")]


def in_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over ``work``, which gives dicts of columns for each batch."""
    names = column_names(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for made in work(batch):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in (made[n] for n in names)], names)

    return df.mapInArrow(run, schema)


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a contiguous matrix as one binary value."""
    matrix = np.ascontiguousarray(matrix)
    n, width = len(matrix), matrix.shape[1] * matrix.itemsize
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(matrix.tobytes())])


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this library: by path on this machine, as an archive on executors elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    path = context.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in path.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)
    if not context.master.startswith("local") and not getattr(context, "has_phaseloom", False):
        base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "phaseloom")
        context.addPyFile(shutil.make_archive(base, "zip", root, "phaseloom"))
        context.has_phaseloom = True
