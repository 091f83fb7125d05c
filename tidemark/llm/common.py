"""Helpers the operators of this subpackage share: reading, staging, and vectorised text access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer single text is a step of its own.
STEP_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local session gets a folder of its own; on a cluster that would
    break silently, as each machine has another, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        run = spark.sparkContext.applicationId
        if run not in _LOCAL:
            _LOCAL[run] = tempfile.mkdtemp(prefix="tidemark-")
        path = _LOCAL[run]
    return path.rstrip("/")


_LOCAL: dict[str, str] = {}
_STAGED: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Lost executors lose nothing that was staged. The tables are scratch data of the
    running application; ``drop_staged`` clears them once results are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch between the JVM and Python, at most; a longer single row is a batch of its own.
BATCH_BYTES = 16 * 1024 * 1024

_UNITS = {"b": 1, "k": 1024, "m": 1024**2, "g": 1024**3}


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ``BATCH_BYTES``, so that long texts don't fill a task; less stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().removesuffix("ib")
    size = int(now[:-1]) * _UNITS[now[-1]] if now[-1] in _UNITS else int(now)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def drop_staged(spark: SparkSession) -> None:
    """Deletes what this process has staged; results that are not written yet can't be read after that."""
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Identifier and text alone (null text: empty), whatever other columns there are."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array as one uint8 vector, with len + 1 offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of uint64 values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the hash base, or of its inverse, modulo 2 ** 64."""
    kind, base = ("i", _BASE_INVERSE) if inverse else ("p", _BASE)
    have = _POWERS[kind]
    if len(have) < n:
        size = max(n, 2 * len(have), 1 << 16)
        with np.errstate(over="ignore"):
            have = np.full(size, base, np.uint64)
            have[0] = 1
            np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _POWERS[kind] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of byte codes times powers of the base, modulo 2 ** 64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers(len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for many ranges, the same wherever the bytes stand."""
    return mix64((prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start])


_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of non-separator bytes, and its row; runs end with their text."""
    inside = ~_SEPARATORS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all ``size``-word shingles in text order, their rows, and words per row.

    A text with fewer words, but at least one, has its whole word sequence as its one shingle.
    """
    data = _LOWER[data] if lower else data
    rows = len(offsets) - 1
    start, end, row = word_spans(data, offsets)
    counts = np.bincount(row, minlength=rows).astype(np.int64)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    words = range_hash(prefix_hash(data), start, end) ^ mix64((end - start).astype(np.uint64))
    seeds = mix64(np.arange(11, 11 + size, dtype=np.uint64)) | np.uint64(1)
    first = np.cumsum(counts) - counts
    place = np.arange(len(words)) - first[row]
    full = place + size <= counts[row]
    total = np.zeros(len(words), np.uint64)
    for k in range(min(size, len(words))):
        total[: len(words) - k] += mix64(words[k:] * seeds[k] + seeds[k])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        keep = full.copy()
        keep[first[short]] = True
        sums = mix64(counts[short].astype(np.uint64))
        for k in range(size - 1):
            more = counts[short] > k
            at = first[short[more]] + k
            sums[more] += mix64(words[at] * seeds[k] + seeds[k])
        total[first[short]] = sums
        full = keep
    return mix64(total[full]), row[full], counts
