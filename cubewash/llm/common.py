"""Helpers shared by the operators: checkpoints, byte views of Arrow text, rolling hashes."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in the contracts: space and 0x09-0x0D.
SPACES = b" \t\n\x0b\x0c\r"

#: Lower-cases A-Z and leaves every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_ODD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Only a local master without one gets a temporary folder; elsewhere a missing
    one is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so lost executors lose nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def training_fold(doc_id, folds: int):
    """crc32 of the doc_id as text, modulo ``folds``. A null doc_id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % folds


def sha256_hex(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, offsets) of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the odd base and of its inverse, modulo 2**64."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _powers:
        inverse = _U(pow(int(_ODD), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[_U(1)], np.full(size, _ODD)]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([[_U(1)], np.full(size, inverse)]), dtype=np.uint64)
        _powers.clear()
        _powers[size] = (up, down)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(32))
        h = h * _U(0xD6E8FEB86659FD93)
        h = h ^ (h >> _U(32))
        h = h * _U(0xD6E8FEB86659FD93)
        return h ^ (h >> _U(32))


class RollingHash:
    """Polynomial hash of any substring of ``data``, from one pass of prefix sums.

    The byte values are first replaced by random 64-bit values, so low entropy
    in the bytes does not weaken the hash; ``seed`` gives independent functions.
    """

    def __init__(self, data: np.ndarray, seed: int = 1):
        values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
        up, self._down = _power_tables(len(data))
        with np.errstate(over="ignore"):
            terms = values[data] * up[:len(data)]
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of data[start:end] for arrays of positions."""
        with np.errstate(over="ignore"):
            return mix((self._sums[end] - self._sums[start]) * self._down[start]
                       + (end - start).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Mixed hash of every substring of ``length`` bytes."""
        n = len(self._sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self._sums[length:] - self._sums[:n]) * self._down[:n])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def doc_groups(offsets: np.ndarray, limit: int = 1 << 21):
    """Consecutive ranges (first, last + 1) of documents of at most ``limit`` bytes together.

    A longer document makes a range of its own, so work space follows the longest text.
    """
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Queries that end inside leave no shuffle files; else these stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Staging:
    """A folder of this run's own under the shared checkpoint folder, for tables written on the way."""

    def __init__(self, spark: SparkSession, label: str):
        import uuid

        checkpoint_dir(spark)
        self.spark = spark
        self.label = f"{label}_{uuid.uuid4().hex}"
        self.root = f"{spark.sparkContext.getCheckpointDir()}/{self.label}"
        self._n = 0
        self._written: list[tuple[DataFrame, str]] = []

    def path(self) -> str:
        self._n += 1
        return f"{self.root}/{self._n}"

    def write(self, df: DataFrame) -> DataFrame:
        """Parquet that survives lost executors; compressed, unlike a checkpoint."""
        path = self.path()
        df.write.parquet(path)
        written = self.spark.read.parquet(path)
        self._written.append((written, path))
        return written

    def free(self, *frames: DataFrame) -> None:
        """Delete what :meth:`write` returned, when nothing reads it any more."""
        for written, path in [x for x in self._written if any(x[0] is f for f in frames)]:
            self._delete(path)
        self._written = [x for x in self._written if not any(x[0] is f for f in frames)]

    def write_bucketed(self, df: DataFrame, buckets: int, *keys: str) -> tuple[str, str]:
        """(table, folder) of a table bucketed and sorted by ``keys``, which later joins need not shuffle."""
        path = self.path()
        name = f"{self.label}_{self._n}"
        (df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
         .option("path", path).saveAsTable(name))
        return name, path

    def drop(self, table: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table[0]}")
        self._delete(table[1])

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        self._delete(self.root)
