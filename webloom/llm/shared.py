"""Helpers shared by the operators of this package: shared folders, Arrow batches, word hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch sent to Python; bounds a worker's memory for long texts.
ARROW_ROWS = 256
#: Bytes of text that an operator handles at once in a Python worker.
BATCH_BYTES = 4 << 20

_written: list[str] = []
_fallback: dict[str, str] = {}


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that long texts do not gather in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary folder in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _fallback:
            _fallback[app] = "file://" + tempfile.mkdtemp(prefix="webloom-")
            spark.sparkContext.setCheckpointDir(_fallback[app])
        found = _fallback[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{checkpoint_dir(spark)}/webloom-{uuid.uuid4().hex}/{name}"
    if not _written:
        atexit.register(_sweep)
    _written.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    for path in _written:
        try:
            delete(spark, path.rsplit("/", 1)[0])
        except Exception:  # the gateway may be gone already; the folder is then the cluster's to clear
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the table's size; from file sizes, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def gathered(batches, column: str = "text", limit: int = BATCH_BYTES):
    """Join Arrow batches up to about `limit` bytes of one column; yields non-empty tables."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in _slices(batch, column, limit):
            if held and size + piece[1] > limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            held.append(piece[0])
            size += piece[1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _slices(batch: pa.RecordBatch, column: str, limit: int):
    """Cut a batch into slices of about `limit` bytes; a single longer row is a slice of its own."""
    if not batch.num_rows:
        return
    at = offsets_of(batch.column(column))[0]
    if at[-1] - at[0] <= limit:
        yield batch, int(at[-1] - at[0])
        return
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield batch.slice(first, last - first), int(at[last] - at[first])
        first = last


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary array, without copies; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at, raw


# Words are runs of bytes other than space and \x09-\x0D; in UTF-8 these six bytes only stand for themselves.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_MINV = np.uint64(pow(int(_M), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"m": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["m"]) < n:
        size = max(n, 1 << 18)
        for key, base in (("m", _M), ("i", _MINV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["m"], _powers["i"]


def hashed_words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, in order, and the number of words of each text."""
    at, raw = offsets_of(column)
    lo, hi = int(at[0]), int(at[-1])
    raw, at = raw[lo:hi], at - lo
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.empty(len(raw), bool)
    after = np.empty(len(raw), bool)
    if len(raw):
        before[0], after[-1] = True, True
        np.logical_not(solid[:-1], out=before[1:])
        np.logical_not(solid[1:], out=after[:-1])
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, at))
    out = np.empty(len(starts), np.uint64)
    step = 1 << 15  # the work arrays of a step take about 40 bytes a character
    for i in range(0, len(starts), step):
        s, e = starts[i : i + step], ends[i : i + step]
        a = int(s[0])
        part = raw[a : int(e[-1])]
        power, inverse = _power(len(part) + 1)
        codes = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
        codes *= power[: len(codes)]
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes, out=total[1:])
        out[i : i + step] = (total[e - a] - total[s - a]) * inverse[s - a] + (e - s).astype(np.uint64)
    return mix(out), counts


_K = [np.uint64(x) for x in (0x9DDFEA08EB382D69, 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F, 0xC949C7DEFE9A4D4B)]


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The distinct hashed word shingles of each text, sorted; a shorter text is one shingle."""
    ends = np.cumsum(counts)
    sums = None
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        sums = np.zeros(n, np.uint64)
        for j in range(width):
            sums += mix(hashes[j : j + n] + np.uint64(j)) * _K[j % len(_K)]
        sums = mix(sums)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        first = end - count
        if count >= width:
            out.append(np.unique(sums[first : end - width + 1]))
        elif count:
            short = np.uint64(count)
            with np.errstate(over="ignore"):
                for j in range(count):
                    short = short * _K[j] + hashes[first + j]
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
