"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str, columns: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """A table (or some columns), dealt out if its files are too few for the cluster; tables of many files are not shuffled.

    ordered: dealt rows, which come in any order, are sorted by a hash of all columns, so that a task that runs again sees the same order."""
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    df = df.select(*columns) if columns else df
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores).sortWithinPartitions(F.xxhash64(*df.columns), *df.columns[:1]) if ordered else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="chatvitals-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Rows of an Arrow batch while a table is written: rows may hold texts or blocks, and whole batches are copied a few times.
BATCH = 1024


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, and is computed once."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}", spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(name, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._chatvitals_path = path
    return out


def trim() -> None:
    """Gives a worker's free memory back: workers are kept between tasks, and allocators keep what large arrays have left."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def drop_written(df: DataFrame) -> None:
    """Deletes a written table that nothing needs any more (what was made of it has been written itself)."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._chatvitals_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(taken: list[str], *names: str) -> list[str]:
    """Helper column names that no column of the caller has (names differ in more than case)."""
    taken = {c.lower() for c in taken}
    out = []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


#: Hash buckets of near_rows: bounds what it broadcasts to as many 64-bit numbers.
BUCKETS = 1 << 20


def near_rows(df: DataFrame, wanted: DataFrame, column: str, kind: str = "left_semi") -> DataFrame:
    """Rows of df whose column may be among wanted's (left_semi; few others pass too) or surely is not (left_anti), without a shuffle of df."""
    bucket, (name,) = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)), free_names(df.columns, "bucket")
    return df.join(F.broadcast(wanted.select(bucket(F.col(column)).alias(name)).distinct()), bucket(df[column]) == F.col(name), kind)


def crc_mod(column: str, divisor: int):
    """crc32 of the column's text, modulo divisor."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


#: Odd multipliers of the rolling and mixing hashes (fixed, arbitrary).
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse modulo 2**64) for i < n, kept for the process and grown as needed."""
    name = "inv" if inverse else "fwd"
    have = _powers.get(name)
    if have is None or len(have) < n:
        base = pow(int(BASE), -1, 1 << 64) if inverse else int(BASE)
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:  # doubling: p[done + i] = p[done] * p[i]
            step = np.uint64(pow(base, done, 1 << 64))
            have[done : 2 * done] = have[:done] * step
            done *= 2
        _powers[name] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of (data[t] + 1) * BASE**-t over i <= t < j, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), True), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for arrays of bounds, equal for equal bytes wherever they stand."""
    top = int(start.max(initial=0)) + 1
    return mix((prefix[end] - prefix[start]) * powers(top)[start] + (end - start).astype(np.uint64) * MIX2)


#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(blob: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes and the bounds of the words in them; no word spans two texts."""
    solid = np.zeros(len(blob) + 2, bool)
    np.logical_not(_SPACE[blob], out=solid[1:-1])
    cut = np.zeros(len(blob) + 1, bool)  # before each byte, and at the end
    cut[bounds] = True
    before, after = solid[:-1], solid[1:]
    return _LOWER[blob], np.flatnonzero(after & (cut | ~before)), np.flatnonzero(before & (cut | ~after))


def text_slices(column):
    """Byte blob and bounds of each text of an Arrow string array (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    blob = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return blob, bounds


def text_blocks(column, most: int = 8 << 20, rows: int = 1024):
    """(first row, blob, bounds) for runs of rows of about `most` bytes and `rows` rows at most, so that copies and work arrays stay small."""
    for at in range(0, len(column), rows):
        blob, bounds = text_slices(column.slice(at, rows))
        i, n = 0, len(bounds) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
            yield at + i, blob[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            i = j
