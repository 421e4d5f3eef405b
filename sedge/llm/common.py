"""What the training-data operators share: tables, word expressions, shared scratch tables and bounded filters."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BATCH_BYTES, bound_batches  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A side of a join is broadcast only if it has at most so many rows (of a few longs each).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for tables that all executors read: within spark.checkpoint.dir.

    Only where the session has no such setting and runs on this machine alone, a temporary folder takes its place; on a
    cluster that is an error, as executors would not see each other's files. The folder goes when Python ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _ROOTS[app] = f"{(shared or 'file://' + tempfile.mkdtemp(prefix='sedge-')).rstrip('/')}/sedge-{app}"
        atexit.register(clear, spark)
    return _ROOTS[app]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of the application. Results of operators read them, so write those first."""
    with contextlib.suppress(Exception):  # at the end the JVM may be gone
        if root := _ROOTS.get(spark.sparkContext.applicationId):
            _delete(spark, root)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to a fresh Parquet folder of the scratch folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._sedge_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_sedge_path", None):
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files and broadcasts of plans that nothing refers to any more; else they stay until the driver
    happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def lower_sql(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{UPPER.lower()}')"


def blank_words_sql(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def sized_broadcast(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound, else df as it is (Spark then shuffles)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


# ---------------------------------------------------------------- Bloom filters of bounded size


def bits_for(n: int, per_key: int = 12, least: int = 1 << 16, most: int = 1 << 27) -> int:
    """A power of two of bits for n keys; never over `most` (16 MB). A full filter only prunes less."""
    return int(min(most, max(least, 1 << int(np.ceil(np.log2(max(1, n) * per_key))))))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bloom_positions(keys: np.ndarray, bits: int, k: int = 3) -> list[np.ndarray]:
    h = mix64(keys.view(np.uint64) if keys.dtype == np.int64 else keys)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(k)]


_BLOCK = 1 << 13  # bytes of a filter that travel as one row


def _merge(seen: np.ndarray, twice: np.ndarray, s: np.ndarray, t: np.ndarray) -> None:
    twice |= t
    twice |= seen & s
    seen |= s


def build_bloom(keys: DataFrame, bits: int, repeated: bool = False, key: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> np.ndarray:
    """Bloom filter of the long column of `keys`, or of key() of its batches; with `repeated`, of keys that may occur at
    least twice.

    Each task fills filters of its own and ships the blocks that are not empty; blocks merge by key. What reaches the
    driver is one filter of `bits` bits, whatever the number of rows. With `repeated`, two bits are kept for a position,
    set once and set twice; (once, twice) pairs merge associatively, so retried tasks and any order give the same.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8 if repeated else 0, np.uint8)
        for b in batches:
            at = key(b) if key else b.column(0).drop_null().to_numpy(zero_copy_only=False)
            if not len(at):
                continue
            for i, p in enumerate(bloom_positions(at, bits)):
                if repeated:
                    p, n = np.unique(p, return_counts=True)
                    byte, bit = p >> 3, (1 << (p & 7)).astype(np.uint8)
                    again = ((seen[byte] & bit) > 0) | (n > 1)
                    np.bitwise_or.at(twice, byte[again], bit[again])
                    np.bitwise_or.at(seen, byte, bit)
                else:
                    np.bitwise_or.at(seen, p >> 3, (1 << (p & 7)).astype(np.uint8))
        for k in range(0, len(seen), _BLOCK):
            if seen[k : k + _BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k // _BLOCK], pa.int32()), "seen": [seen[k : k + _BLOCK].tobytes()], "twice": [twice[k : k + _BLOCK].tobytes()]})

    def merge(t: pa.Table) -> pa.Table:
        seen, twice = np.zeros(_BLOCK, np.uint8), np.zeros(_BLOCK, np.uint8)
        for s, w in zip(t.column("seen"), t.column("twice"), strict=True):
            s = np.frombuffer(s.as_py(), np.uint8)
            w = np.frombuffer(w.as_py(), np.uint8) if repeated else np.zeros(len(s), np.uint8)
            _merge(seen[: len(s)], twice[: len(s)], s, w)
        return pa.table({"block": t.column("block").slice(0, 1), "bits": [(twice if repeated else seen).tobytes()]})

    parts = keys.mapInArrow(frugal(fill), "block int, seen binary, twice binary")
    whole = np.zeros(bits // 8, np.uint8)
    for r in parts.groupBy("block").applyInArrow(merge, "block int, bits binary").collect():
        at = r["block"] * _BLOCK
        part = np.frombuffer(r["bits"], np.uint8)[: len(whole) - at]
        whole[at : at + len(part)] = part
    return whole


def bloom_has(whole: np.ndarray, keys: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for p in bloom_positions(keys, len(whole) * 8):
        ok &= (whole[p >> 3] & (1 << (p & 7)).astype(np.uint8)) > 0
    return ok


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs but for the rows whose id is in ids (one column of longs), which is a small part of it.

    Up to BROADCAST_ROWS ids are broadcast; of more, a filter tells the rows that surely stay, and only the others travel.
    """
    key = ids.columns[0]
    n = ids.count()
    gone = ids.select(F.col(key).alias("_gone"))
    if n <= BROADCAST_ROWS:
        return docs.join(F.broadcast(gone), F.col(id_col) == F.col("_gone"), "left_anti")
    filled = docs.sparkSession.sparkContext.broadcast(build_bloom(ids, bits_for(n)))

    @F.pandas_udf("boolean")
    def maybe(x):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(bloom_has(filled.value, x.fillna(0).to_numpy(np.int64)))

    seen = docs.withColumn("_maybe", maybe(F.col(id_col).cast("long")))
    stay = seen.where(~F.col("_maybe")).drop("_maybe")
    return stay.unionByName(seen.where("_maybe").drop("_maybe").join(gone, F.col(id_col) == F.col("_gone"), "left_anti"))


def spread(df: DataFrame, tasks_per_core: int = 3) -> int:
    """A number of partitions for work that is heavy beside its rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks_per_core * df.sparkSession.sparkContext.defaultParallelism)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Batches) -> Batches:
    """run, which hands memory back: workers are kept for later tasks, more of them than run at a time. Arrays of 1 MB and
    more go back as soon as they are free (glibc would raise that bound by itself), the rest when a task ends."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        try:
            yield from run(batches)
        finally:
            _trim()

    return trimmed
