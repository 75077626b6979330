"""Exact dedup over a cuckoo-filter index.

Each scan task keeps an index of live digests; a filter hit is verified against the full digest stored in the hit bucket, and an
overflow rebuilds a larger index from the stored keys. A task reduces its rows to chunks (digest, largest id, count, ids), so a
digest that a third of all rows share becomes one row for every CHUNK of its rows before anything is shuffled. Chunks are merged in
order of their digests, one at a time; the decision is joined back to the chunks, hot digests over salts.

The index as a table is these chunks with their ids, so a digest's keep follows deletions: documents go out by digest and id.

Defined cases: null text counts as empty (null and "" are one group); null doc_ids sort below all others and keep_id is null only if
all of a group are; of rows with equal id and text exactly one is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, ship, shuffle_partitions, stored, table

CHUNK = 4096  #: ids in one row of a group at most
LIVE = 200_000  #: digests a scan task holds before it hands its chunks on
ROWS = 2_000_000  #: rows likewise
SALTS = 16


class CuckooIndex:
    """Digest -> slot number. Two candidate buckets of four slots a digest; a slot holds a 16-bit fingerprint beside the stored key."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1024):
        self.n = 1 << max(1, (buckets - 1).bit_length())
        self.resizes = 0
        self._clear()

    def _clear(self) -> None:
        self.prints = [0] * (self.n * self.SLOTS)
        self.held: list = [None] * (self.n * self.SLOTS)  # (digest, value)
        self.size = 0

    def _of(self, digest: bytes) -> tuple[int, int, int]:
        f = int.from_bytes(digest[:2], "little") or 1
        a = int.from_bytes(digest[2:10], "little") & (self.n - 1)
        return f, a, a ^ self._twist(f)

    def _twist(self, f: int) -> int:
        return (f * 0x5BD1E995 + 1) & (self.n - 1)

    def _slots(self, digest: bytes) -> tuple[int, list[int]]:
        f, a, b = self._of(digest)
        a, b = a * self.SLOTS, b * self.SLOTS
        return f, [*range(a, a + self.SLOTS), *range(b, b + self.SLOTS)]

    def may_contain(self, digest: bytes) -> bool:
        """The bare filter's answer: false positives are possible, false negatives are not."""
        f, slots = self._slots(digest)
        return any(self.prints[s] == f for s in slots)

    def find(self, digest: bytes):
        """The value of a live digest, verified against the stored key; None if it isn't live."""
        f, a, b = self._of(digest)
        prints, held = self.prints, self.held
        for at in (a * 4, b * 4):
            for s in (at, at + 1, at + 2, at + 3):
                if prints[s] == f and held[s][0] == digest:
                    return held[s][1]
        return None

    def insert(self, digest: bytes, value) -> None:
        """The digest must not be live."""
        while not self._place(digest, value):
            self._resize()

    def _place(self, digest: bytes, value) -> bool:
        f, a, b = self._of(digest)
        for bucket in (a, b):
            for s in range(bucket * 4, bucket * 4 + 4):
                if not self.prints[s]:
                    self.prints[s], self.held[s] = f, (digest, value)
                    self.size += 1
                    return True
        moves, bucket, item = [], b, (digest, value)
        for k in range(self.KICKS):  # make room along a chain; undone if the chain is too long
            s = bucket * 4 + (k + f) % 4
            moves.append((s, self.prints[s], self.held[s]))
            f, self.prints[s], item, self.held[s] = self.prints[s], f, self.held[s], item
            bucket ^= self._twist(f)
            for t in range(bucket * 4, bucket * 4 + 4):
                if not self.prints[t]:
                    self.prints[t], self.held[t] = f, item
                    self.size += 1
                    return True
        for s, f, item in reversed(moves):
            self.prints[s], self.held[s] = f, item
        return False

    def _resize(self) -> None:
        stored_keys = list(self.items())
        while True:
            self.n *= 2
            self.resizes += 1
            self._clear()
            if all(self._place(d, v) for d, v in stored_keys):
                return

    def delete(self, digest: bytes) -> bool:
        """Take a live digest out; False if it wasn't live."""
        f, slots = self._slots(digest)
        for s in slots:
            if self.prints[s] == f and self.held[s][0] == digest:
                self.prints[s], self.held[s] = 0, None
                self.size -= 1
                return True
        return False

    def items(self):
        return (x for x in self.held if x is not None)


def _rank(x):
    return (x is not None, x or 0)


CHUNKS = "digest binary, keep bigint, n bigint, uid bigint, ids array<bigint>"
MERGED = "digest binary, keep bigint, n bigint, uid bigint"


def _chunks(batches):
    from pyspark import TaskContext

    context = TaskContext.get()
    uid = (context.partitionId() if context else 0) << 32

    def rows(index):
        return [(d, v) for d, v in index.items() if v[1]]

    def batch(out, uid):
        return pa.RecordBatch.from_arrays(
            [binaries([d for d, _ in out]), pa.array([v[0] for _, v in out], pa.int64()), pa.array([len(v[1]) for _, v in out], pa.int64()), pa.array(range(uid, uid + len(out)), pa.int64()), pa.array([v[1] for _, v in out], pa.list_(pa.int64()))],
            names=["digest", "keep", "n", "uid", "ids"],
        )

    index, held = CuckooIndex(), 0
    for b in batches:
        full = []
        held += b.num_rows
        for digest, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v = index.find(digest)
            if v is None:
                index.insert(digest, [i, [i]])
                continue
            if not v[1] or _rank(i) > _rank(v[0]):
                v[0] = i
            v[1].append(i)
            if len(v[1]) == CHUNK:  # the digest stays live; its rows so far leave
                full.append((digest, [v[0], v[1]]))
                v[1] = []
        if index.size > LIVE or held > ROWS:
            full += rows(index)
            index, held = CuckooIndex(), 0
        if full:
            yield batch(full, uid)
            uid += len(full)
    if last := rows(index):
        yield batch(last, uid)


def _merge(batches):
    """Chunks, sorted by digest, to one row a digest; a task holds the rows it is about to hand on."""
    out, last = [], None

    def batch(part):
        return pa.RecordBatch.from_arrays([binaries([d for d, _ in part]), *(pa.array([v[j] for _, v in part], pa.int64()) for j in range(3))], names=["digest", "keep", "n", "uid"])

    for b in batches:
        for digest, keep, n, uid in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if digest != last:
                if len(out) >= 10_000:
                    yield batch(out)
                    out = []
                last, v = digest, [keep, n, uid]
                out.append((digest, v))
                continue
            v[1] += n
            if (_rank(keep), -uid) > (_rank(v[0]), -v[2]):  # the chunk that holds the row that stays: of equals the first
                v[0], v[2] = keep, uid
    if out:
        yield batch(out)


def digest_chunks(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(_chunks, CHUNKS)


def merge_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("digest", "keep", "n", "uid").repartition(shuffle_partitions(chunks.sparkSession), "digest").sortWithinPartitions("digest").mapInArrow(_merge, MERGED)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    chunks = stored(digest_chunks(docs), "dedup")
    hot = F.lit(CHUNK)
    groups = merge_chunks(chunks).select(
        F.col("digest").alias("_d"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.col("uid").alias("_chunk"),
        F.explode(F.when(F.col("n") >= hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"),
    )
    rows = chunks.select("digest", "uid", "ids", F.when(F.size("ids") >= hot, F.pmod(F.col("uid"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("_s"))
    both = rows.join(groups, (rows["digest"] == groups["_d"]) & (rows["_s"] == groups["_salt"]))
    # of a chunk's ids the first equal to keep_id is the row that stays (array_position is null-blind: an all-null group keeps its first)
    first = F.when(F.col("keep_id").isNull(), F.lit(1)).otherwise(F.expr("array_position(ids, keep_id)"))
    return both.withColumn("_at", F.when(F.col("uid") == F.col("_chunk"), first).otherwise(F.lit(0))).select(
        F.posexplode("ids").alias("_pos", "doc_id"), "keep_id", "group_size", "_at", "digest"
    ).select("doc_id", "keep_id", "group_size", (F.col("_pos") + 1 == F.col("_at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


INDEX = "digest binary, keep bigint, n bigint, uid bigint, ids array<bigint>"


def live_index(docs: DataFrame) -> DataFrame:
    """The index as a table of stored keys: chunks (digest, keep, n, uid, ids) of the live rows, each of CHUNK ids at most."""
    return stored(digest_chunks(docs), "index")


def live_groups(index: DataFrame) -> DataFrame:
    """(digest, keep, n) of every live digest."""
    return merge_chunks(index).select("digest", "keep", "n")


def apply_changes(index: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The live index after documents came and documents went (deletes: doc_id, text as once inserted; one row takes out one row, and
    rows that aren't live take out nothing). A digest leaves with its last document; keep is the largest id that is left.

    Only digests with deletes are opened: their ids are counted against the deleted ones, digest and id together, so a digest of very
    many rows is spread over many tasks."""
    ship(index.sparkSession)
    came, went = live_index(inserts), live_index(deletes)
    both = index.unionByName(came)
    touched = went.select("digest").distinct()
    marked = stored(both.join(touched.withColumn("_hit", F.lit(True)), "digest", "left"), "marked")
    rest = marked.filter("_hit is null").select("digest", "keep", "n", "uid", "ids")
    one = lambda df, sign: df.select("digest", F.explode("ids").alias("doc_id"), F.lit(sign).alias("sign"))
    rows = one(marked.filter("_hit"), 1).unionByName(one(went, -1)).groupBy("digest", "doc_id")
    left = rows.agg(F.greatest(F.sum("sign"), F.lit(0)).cast("int").alias("n")).filter("n > 0")
    opened = left.select("digest", F.explode(F.array_repeat("doc_id", F.col("n"))).alias("doc_id")).mapInArrow(_chunks, INDEX)
    return stored(rest.unionByName(opened), "index")


def sha256_of(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
