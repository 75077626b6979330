"""Helpers shared by the training-data operators: shared storage, shipping, text kernels."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
#: Shuffle files go when a query ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS = 1000  #: where they are whole texts: a batch is held on both sides
_SHIPPED: set[str] = set()
_KEPT: list[dict] = []
_MADE: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="partflow-"), "partflow_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset a temporary one in local mode, else an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="partflow-ckpt-"))
        at = sc.getCheckpointDir()
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's Python ends."""
    if not _MADE:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/partflow-{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _MADE:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is over: the files stay where the cluster's own clean-up finds them
            return


def kept() -> dict:
    """A dict of what a worker process keeps between tasks, until `forget`."""
    _KEPT.append({})
    return _KEPT[-1]


def forget() -> None:
    """Free what the tasks of other operators left in this worker process, which Spark uses again: for tasks that need none of it."""
    if any(_KEPT):
        for x in _KEPT:
            x.clear()
        pa.default_memory_pool().release_unused()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stored(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Cut lineage: write a table in the shared folder and read it back. What was shuffled for it goes when it is written. batch: the rows
    that go to a Python worker at once."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with settings(spark, {CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {})):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], row_id: str, salts: int = 16, grows: bool = False) -> DataFrame:
    """Left join to a table with one row a key, safe for a key with a third of all rows: the lookup is repeated once a salt.
    Nulls match nulls. Whether to broadcast is left to Spark's own size limits, which see the lookup's file and not what the salts make of
    it; a lookup that `grows` with the corpus is never broadcast."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    right = lookup.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in lookup.columns if c not in keys], salt)
    right = right.hint("merge") if grows else right
    left = rows.withColumn("_s", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    on = left["_s"] == right["_salt"]
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_k_{k}"])
    return left.join(right, on, "left").drop("_s", "_salt", *[f"_k_{k}" for k in keys])


LIKELY_BITS = 1 << 25


def likely(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among `ids` (one column of that name), and a few others, without a shuffle of the rows: a bitmap of hashes, 4 MB
    whatever the tables' size, is broadcast. A join with ids afterwards tells the others apart."""
    place = F.pmod(F.xxhash64(key), F.lit(LIKELY_BITS))
    bits = ids.select(F.shiftright(place, 15).alias("_page"), place.bitwiseAND(32767).alias("_at")).groupBy("_page").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_at", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_page", F.shiftright(place, 15)).withColumn("_at", place.bitwiseAND(32767)).join(F.broadcast(bits), "_page")
    return found.filter(F.getbit(byte, F.col("_at").bitwiseAND(7).cast("int")) == 1).select(*rows.columns)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, whose doc_id isn't among `ids` (one column, doc_id); a null doc_id stays."""
    gone = ids.select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its rows; null is empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: int, most: int = 2_000_000):
    """Runs of rows with about `most` bytes of a column at most; one row at least."""
    col = batch.column(column)
    n, start = batch.num_rows, 0
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(size)])
    while start < n:
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def packed(columns: np.ndarray) -> bytes:
    """Rows of 32-bit numbers (one row a column of a table), bytes of one weight side by side, in zstd."""
    raw = np.ascontiguousarray(columns, np.int32).view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes, rows: int) -> np.ndarray:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(rows, 4, -1).transpose(0, 2, 1)).view(np.int32).reshape(rows, -1)


_M = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 of any substring of a buffer, from one prefix sum. The powers run on for the longest buffer seen."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.table = r.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(r.integers(1, 2**62)) * 4 + 3
        self.inverse = pow(self.base, -1, 2**64)
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        def powers(b: int) -> np.ndarray:
            out = np.full(n, b, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.up, self.down = powers(self.base), powers(self.inverse)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) + 1 > len(self.up):
            self._grow(2 * len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.down[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.up[start]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ROLL: dict[int, Rolling] = {}


def words_of(data: np.ndarray, offsets: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all rows (A-Z lowered), their starts and ends, and for each row the index of its first word (one more at the end)."""
    roll = _ROLL.setdefault(seed, Rolling(seed))
    low = _LOWER[data]
    ink = ~_SPACE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets[:-1]] = True
    edge[offsets[-1]] = True
    before = np.concatenate([[False], ink[:-1]]) if len(ink) else ink
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.concatenate([ink[1:], [False]]) if len(ink) else ink
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    pre = roll.prefix(low)
    return mix(roll.of(pre, starts, ends) ^ mix((ends - starts).astype(np.uint64))), starts, ends, np.searchsorted(starts, offsets)
