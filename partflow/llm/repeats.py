"""Repeated passages by suffix ranks: distributed prefix doubling over sampled, then surviving positions.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Ranking every position at every offset would shuffle
many times the corpus, so positions are discarded as early as ranks allow (a rank is the 64-bit name of a string; equal strings, equal
ranks):

1. offset GRAM, at sampled positions: every window of LENGTH bytes is held by its anchor, the position in it whose GRAM bytes rank least.
   Equal windows have equal anchors at equal distance, so a window whose anchor's rank is unique is unique and its positions go.
2. offset of a run: neighbouring windows with one anchor are a run; runs pair their anchor's rank with the rank of all their bytes.
   A run whose pair occurs twice is repeated as a whole, and one run stands for all.
3. offsets LENGTH - STEP and LENGTH + STEP, for blocks of STEP windows of the runs that are left (an anchor's rank shared by different
   runs): the bytes that all windows of a block hold, and those that any of them holds. A block whose first rank is unique holds no
   repeated window and goes; one whose second rank occurs twice is repeated as a whole.
4. offsets LENGTH/2 and LENGTH, at the positions of the blocks that are left: a position's rank at LENGTH is the pair of its rank and
   that of the position LENGTH/2 on; those not unique are repeated.

Before every shuffle a task ranks its own rows, so a passage that a third of all documents hold is one row a task. First ranks (of anchors and
of what all windows of a block hold) only decide which rows are looked at together: equal strings have equal ones, and different strings
with one rank are told apart by the second. Second ranks, and both halves of a position's pair, are BLAKE2 digests of all the bytes they
stand for, keyed by 128 random bits of the run, so no text can be made to collide with another; that two different strings agree has a
chance of 2**-64 for runs and blocks under one first rank, and of 2**-128 for positions.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; bytes, not characters, are cut (kept_text of find_repeats may
end inside a character and is binary); equal rows are copies of each other; texts of any length are one row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolling, flat, mix, ship, slices, stored, table

LENGTH = 400
GRAM = 64
STEP = 16  #: windows of a block
HELD = 400_000  #: rows a task ranks among themselves before it hands them on
_ROLL: dict[int, Rolling] = {}
_C = np.uint64(0xFF51AFD7ED558CCD)


def _roll(seed: int) -> Rolling:
    return _ROLL.setdefault(seed, Rolling(seed))


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: bytes) -> np.ndarray:
    """64 bits of a keyed BLAKE2 digest of each slice of bytes."""
    line = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join([hashlib.blake2b(line[i:j], digest_size=8, key=key).digest() for i, j in zip(start.tolist(), end.tolist(), strict=True)]), np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    grid = np.concatenate([x, np.full(pad, x.max(), x.dtype)]).reshape(-1, w) if pad else x.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, key: bytes = b""):
    """(row, first window, last window, anchor, anchor's rank, run's rank) of the runs of all rows; windows count from their row's start."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    roll = _roll(11)
    pre = roll.prefix(data)
    n = len(data) - gram + 1
    rank = (pre[gram:] - pre[:n]) * roll.up[:n]
    rank = rank * _C
    rank ^= rank >> np.uint64(32)
    rank *= _C
    low = np.uint64((1 << 28) - 1)
    place = (rank & ~low) | (np.arange(n, dtype=np.uint64) & low)  # of equal ranks the leftmost
    anchor = (sliding_min(place, length - gram + 1) & low).astype(np.int64)
    size = np.diff(offsets)
    long = np.flatnonzero(size >= length)
    step = np.zeros(len(anchor) + 1, np.int32)
    np.add.at(step, offsets[long], 1)
    np.add.at(step, offsets[long] + size[long] - length + 1, -1)
    live = np.cumsum(step[:-1]) > 0
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (live[1:] != live[:-1])
    change[offsets[long]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(anchor))
    mine = live[start]
    start, end = start[mine], end[mine] - 1
    row = np.searchsorted(offsets, start, "right") - 1
    whole = digests(data, start, end + length, key)
    return row, start - offsets[row], end - offsets[row], anchor[start] - offsets[row], rank[anchor[start]], whole


RANKS = "kind int, a bigint, b bigint, doc bigint, k bigint, first int, last int, at int, open boolean, n bigint"


class Held:
    """A task's rows (rank a, rank b, doc_id and key, first and last window, a place, open: may have to go), ranked among themselves: one row for
    each pair of ranks with its count (kind 0), and all open rows of pairs that occur twice (kind 1)."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, *columns: np.ndarray):
        self.parts.append(columns)
        self.n += len(columns[0])
        if self.n > HELD:
            yield from self.ranked()

    def ranked(self):
        if not self.n:
            return
        cols = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.parts, self.n = [], 0
        order = np.lexsort((~cols[7], cols[1], cols[0]))  # open rows first, so that one stands for its pair
        cols = [c[order] for c in cols]
        a, b, open_ = cols[0], cols[1], cols[7]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(a)))
        yield _rows(0, [c[head] for c in cols], count)
        twice = np.repeat(count > 1, count) & open_
        if twice.any():
            yield _rows(1, [c[twice] for c in cols], np.full(int(twice.sum()), 2))


def _rows(kind: int, cols: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
    a, b, doc, key, first, last, at, open_ = cols
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(key.astype(np.int64)), *(pa.array(x.astype(np.int32)) for x in (first, last, at)), pa.array(open_), pa.array(n.astype(np.int64))],
        names=["kind", "a", "b", "doc", "k", "first", "last", "at", "open", "n"],
    )


def _sampled(length: int, gram: int, secret: bytes):
    def run(batches):
        held = Held()
        for batch in batches:
            for b in slices(batch, 2, 1_000_000):
                row, first, last, at, a, whole = runs_of(*flat(b.column(2)), length, gram, secret)
                yield from held.add(a, whole, np.asarray(b.column(0))[row], np.asarray(b.column(1))[row], first, last, at, np.ones(len(row), bool))
        yield from held.ranked()

    return run


SEGMENTS = "doc bigint, k bigint, first int, last int, at int, open boolean, bytes binary"


def _segments(length: int):
    """The bytes of the runs that are left, so that the texts aren't needed again."""

    def run(batches):
        for batch in batches:
            for doc, key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                data = text.as_py()
                spans = {(s["first"], s["last"]): s for s in spans}.values()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(spans), pa.int64()), pa.array([key] * len(spans), pa.int64()), *(pa.array([s[n] for s in spans], pa.int32()) for n in ("first", "last", "at")), pa.array([s["open"] for s in spans]), pa.array([data[s["first"] : s["last"] + length] for s in spans], pa.binary())],
                    names=["doc", "k", "first", "last", "at", "open", "bytes"],
                )

    return run


def _blocks(length: int, step: int, secret: bytes):
    def run(batches):
        held = Held()
        for batch in batches:
            for b in slices(batch, 6, 1_000_000):
                data, edge = flat(b.column(6))
                doc, key, first, last, at = (np.asarray(b.column(c)).astype(np.int64) for c in range(5))
                open_ = np.asarray(b.column(5))
                low, high = (at - last) // step, (at - first) // step  # blocks by the anchor's distance: equal windows have equal ones
                n = high - low + 1
                seg = np.repeat(np.arange(len(n)), n)
                block = low[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
                begin = np.maximum(first[seg], at[seg] - block * step - step + 1)
                end = np.minimum(last[seg], at[seg] - block * step)
                move = edge[seg] - first[seg]  # from places in the text to places in the slice
                one = _roll(14)
                pre = one.prefix(data)
                core = at[seg] - block * step + move
                a = mix(one.of(pre, core, core + length - step + 1) ^ mix(block.astype(np.uint64)))
                whole = digests(data, begin + move, end + length + move, secret) ^ mix(((at[seg] - begin) * 65536 + at[seg] - end).astype(np.uint64))
                yield from held.add(a, whole, doc[seg], key[seg], begin, end, first[seg], open_[seg])
        yield from held.ranked()

    return run


def _positions(length: int, secret: bytes):
    def run(batches):
        held = Held()
        for batch in batches:
            for b in slices(batch, 3, 500_000):
                data, edge = flat(b.column(3))
                doc, key, start = (np.asarray(b.column(c)).astype(np.int64) for c in range(3))
                spans = b.column(4).to_pylist()
                seg = np.repeat(np.arange(len(spans)), [len(x) for x in spans])
                first, last, open_ = (np.array([s[n] for x in spans for s in x]) for n in ("first", "last", "open"))
                size = last - first + 1
                p = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                seg = np.repeat(seg, size)
                at = p + edge[seg] - start[seg]
                half = length // 2
                # the rank at the whole length pairs those of the position and of the one half the length on
                a, z = digests(data, at, at + half, secret), digests(data, at + half, at + length, secret)
                yield from held.add(a, z, doc[seg], key[seg], p, p, p, np.repeat(open_.astype(bool), size))
        yield from held.ranked()

    return run


def _settled(ranks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(repeated rows, rows to look at closer) of ranked rows. Open rows whose pair (a, b) occurs twice are repeated. Where rows differ
    under one a and an open one is single, one row of each pair is looked at; of them the single ones are still open.

    Pairs are sorted and summed with partial aggregates, and so are the pairs of one a, so a rank that very many rows share is a row a
    task; what follows for the rows comes back by joins, which Spark can split."""
    place = F.struct("doc", "k", "first", "last", "at")
    rows = ranks.filter("kind = 0")
    shared = rows.groupBy("a").agg(F.sum("n").alias("n")).filter("n > 1").select("a")  # a rank that occurs once settles nothing
    rows = stored(rows.join(shared, "a", "left_semi"), name)
    pairs = rows.groupBy("a", "b").agg(F.sum("n").alias("all"), F.min(place).alias("place"), F.max(F.col("open").cast("int")).alias("opens"))
    pairs = stored(pairs, f"{name}_pairs")
    waits = pairs.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max(F.when(F.col("all") == 1, F.col("opens")).otherwise(0)).alias("waits"))
    waits = waits.filter("waits = 1 and low <> high").select("a")
    look = pairs.join(waits, "a").select("place.*", ((F.col("all") == 1) & (F.col("opens") == 1)).alias("open"))
    twice = pairs.filter("all > 1").select("a", "b")
    found = rows.filter("n = 1 and open").join(twice, ["a", "b"]).select("doc", "k", "first", "last")
    return ranks.filter("kind = 1").select("doc", "k", "first", "last").unionByName(found), look


def _finish(length: int, texts: bool):
    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_py() or b""
                cut = sorted((s["first"], s["last"] + length) for s in spans or ())
                runs: list[list[int]] = []
                for a, z in cut:
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], z)
                    else:
                        runs.append([a, z])
                kept, at = [], 0
                for a, z in runs:
                    kept.append(data[at:a])
                    at = z
                kept.append(data[at:])
                whole = b"".join(kept)
                out.append((len(data), len(data) - len(whole), len(runs), hashlib.sha256(whole).hexdigest(), whole, [x for r in runs for x in r]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            arrays = [ids.cast(pa.int64()), *(pa.array(cols[k], pa.int64()) for k in range(3)), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                arrays += [pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.list_(pa.int64()))]
                names += ["kept_text", "removed"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """What is left of every text: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (texts: and kept_text, removed start and end offsets)."""
    spark = docs.sparkSession
    ship(spark)
    secret = secrets.token_bytes(16)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc = F.col("doc_id").cast("long")
    # a row's key: its doc_id, and for repeated and null doc_ids a hash of which and of its text
    rows = docs.select(F.coalesce(doc, F.lit(0)).alias("doc"), F.xxhash64(doc.isNull(), text).alias("k"), text.alias("text"), doc.alias("doc_id"))
    key = ["doc", "k"]
    gone, look = _settled(stored(rows.select(*key, "text").mapInArrow(_sampled(length, gram, secret), RANKS), "ranks"), "runs")
    look = look.groupBy(*key).agg(F.collect_list(F.struct("first", "last", "at", "open")).alias("spans"))
    where = rows.select(*key, "text").hint("merge").join(look, key).select(*key, "text", "spans")
    segments = stored(where.mapInArrow(_segments(length), SEGMENTS).dropDuplicates([*key, "first", "last"]), "segments")  # equal rows have equal keys
    more, look = _settled(stored(segments.mapInArrow(_blocks(length, min(STEP, length - gram), secret), RANKS), "blocks"), "block_runs")
    look = look.groupBy(*key, F.col("at").alias("first")).agg(F.collect_list(F.struct(F.col("first"), "last", "open")).alias("spans"))
    late = segments.join(look, [*key, "first"]).select(*key, "first", "bytes", "spans").mapInArrow(_positions(length, secret), RANKS)
    last, _ = _settled(stored(late, "positions"), "position_runs")
    gone = gone.unionByName(more).unionByName(last)
    spans = gone.distinct().groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    both = rows.hint("merge").join(spans, key, "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_finish(length, texts), RESULT + (", kept_text binary, removed array<bigint>" if texts else ""))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"))
