"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector and as many ids as its width lets into 60 bits. Selector 0 is the escape: its payload is the place
of one id of 2**60 or more in the segment's escape table. Ids are coded in blocks of BLOCK; a directory holds each block's first word,
so that blocks decode on their own and all words of a selector decode in one vectorised step.

A shard is one range of doc_ids; its file rows are segments of whole documents in ascending doc_id order. Spark's Parquet writer is the
container: its commit protocol keeps a shard whole when executors are lost or a task runs twice, on any file system Spark reaches.
Segment, little-endian: magic "S8B1", u32 documents, u64 ids, u32 block length, u32 words, u32 escapes; then for each document i64
doc_id, u8 1 if the doc_id is null, u64 ids; then u32 first word of each block (one more at the end), u64 words, u64 escapes.

Defined cases: null text is empty (the end id alone); null doc_ids come first; rows with equal doc_id are ordered by text and each
keeps its own entry; a text of any length is one document of one segment; an empty table writes no segment; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, scratch, ship, shuffle_partitions, slices, table
from .subwords import subwords

BLOCK = 4096
SLICE = 4_000_000  #: bytes of text encoded at once, about
SEGMENT = 1 << 16  #: ids in a segment, about
#: Selector -> (ids in a word, bits of each). Fixed by the 60 payload bits; 0 is the escape.
COUNTS = (1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
PAD = 240
HEAD = "<4sIQIII"
ROWS = "shard int, segment int, first_id bigint, n_ids bigint, n_docs int, payload binary"


_WIDTH_OF = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned 64-bit value."""
    out = np.zeros(len(values), np.uint8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1 << step)
        out += (big * step).astype(np.uint8)
        rest = np.where(big, rest >> np.uint64(step), rest)
    return out + (rest > 0).astype(np.uint8)


def encode_ids(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each block and the number of words, words, escapes) of unsigned 64-bit ids."""
    values = values.astype(np.uint64)
    n = len(values)
    blocks = -(-n // block)
    line = np.zeros((blocks, block + PAD), np.uint64)  # zeros behind a block's ids let its last word be as full as it likes
    ends = np.minimum(block, n - np.arange(blocks) * block)
    whole = n // block
    line[:whole, :block] = values[: whole * block].reshape(whole, block)
    if whole < blocks:
        line[whole, : n - whole * block] = values[whole * block :]
    line = line.ravel()
    bits = bit_widths(line) if n and values.max() >> np.uint64(32) else _small_widths(line)
    misfit, escapes = np.ones(len(line), np.uint8), []
    top, span = bits, 1  # the most bits among the `span` ids from each place
    spans = {1: bits}
    while span < 128:
        top = np.maximum(top, np.concatenate([top[span:], np.full(min(span, len(top)), 255, np.uint8)]))
        span *= 2
        spans[span] = top
    for s in range(1, 16):  # where a selector fits all behind it do, so the first that fits follows from how many don't
        c, w = COUNTS[s], WIDTHS[s]
        p = 1 << (c.bit_length() - 1)
        shifted = spans[p][c - p :]
        misfit[: len(shifted)] += np.maximum(spans[p][: len(shifted)], shifted) > w
        misfit[len(shifted) :] += 1
    selector = misfit & 15
    counts = np.array(COUNTS, np.uint8)
    jump = counts[selector].tobytes()
    starts: list[int] = []
    first = [0]
    put = starts.append
    for b in range(blocks):
        i = b * (block + PAD)
        end = i + int(ends[b])
        while i < end:
            put(i)
            i += jump[i]
        first.append(len(starts))
    at = np.array(starts, np.int64)
    kinds = selector[at] if len(at) else np.zeros(0, np.uint8)
    words = kinds.astype(np.uint64) << np.uint64(60)
    for s in np.unique(kinds):
        mine = np.flatnonzero(kinds == s)
        if s == 0:
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
            escapes = line[at[mine]]
        elif s > 1:
            c, w = COUNTS[s], WIDTHS[s]
            shift = np.arange(c, dtype=np.uint64) * np.uint64(w)
            words[mine] |= np.bitwise_or.reduce(line[at[mine][:, None] + np.arange(c)] << shift, axis=1)
    return np.array(first, np.uint32), words, np.array(escapes, np.uint64)


def _small_widths(line: np.ndarray) -> np.ndarray:
    """Bits of values below 2**32: from a table where they are below 2**16, else from the exponent of a float."""
    if len(line) and line.max() < 1 << 16:
        return _WIDTH_OF.take(line.astype(np.uint16))
    return np.frexp(line.astype(np.float64))[1].astype(np.uint8)


def decode_ids(n: int, first: np.ndarray, words: np.ndarray, escapes: np.ndarray, block: int = BLOCK, only: slice | None = None) -> np.ndarray:
    """The ids, or those of the blocks in `only`, without touching other blocks' words."""
    lo, hi = (0, len(first) - 1) if only is None else only.indices(len(first) - 1)[:2]
    n_here = min(n, hi * block) - lo * block if hi > lo else 0
    words = words[first[lo] : first[hi]] if hi > lo else words[:0]
    kinds = (words >> np.uint64(60)).astype(np.uint8)
    took = np.array(COUNTS, np.int64)[kinds]
    begin = np.cumsum(took) - took
    base = first[lo : hi + 1].astype(np.int64) - int(first[lo])
    per = np.diff(base)
    owner = np.repeat(np.arange(hi - lo), per)
    heads = begin[np.minimum(base[:-1], max(len(begin) - 1, 0))] if len(begin) else np.zeros(hi - lo, np.int64)
    place = begin - heads[owner] + owner * (block + PAD)
    out = np.zeros((hi - lo) * (block + PAD) + PAD, np.uint64)
    for s in np.unique(kinds):
        mine = np.flatnonzero(kinds == s)
        if s == 0:
            out[place[mine]] = escapes[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif s > 1:
            c, w = COUNTS[s], WIDTHS[s]
            shift = np.arange(c, dtype=np.uint64) * np.uint64(w)
            out[place[mine][:, None] + np.arange(c)] = (words[mine][:, None] >> shift) & np.uint64((1 << w) - 1)
    # a word at a block's end may reach into the padding only
    return out[: (hi - lo) * (block + PAD)].reshape(hi - lo, block + PAD)[:, :block].reshape(-1)[:n_here]


def pack_segment(doc_ids: list, counts: list[int], values: np.ndarray) -> bytes:
    first, words, escapes = encode_ids(values)
    head = struct.pack(HEAD, b"S8B1", len(doc_ids), len(values), BLOCK, len(words), len(escapes))
    null = np.array([i is None for i in doc_ids], np.uint8)
    return b"".join([head, np.array([i or 0 for i in doc_ids], "<i8").tobytes(), null.tobytes(), np.array(counts, "<u8").tobytes(), first.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def unpack_segment(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids)."""
    magic, docs, n, block, n_words, n_escapes = struct.unpack_from(HEAD, payload)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b segment")
    at = struct.calcsize(HEAD)

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, k, at)
        at += out.nbytes
        return out

    ids, null, counts = take("<i8", docs), take("u1", docs), take("<u8", docs)
    first, words, escapes = take("<u4", -(-n // block) + 1), take("<u8", n_words), take("<u8", n_escapes)
    return [None if z else int(i) for i, z in zip(ids, null, strict=True)], counts.astype(np.int64), decode_ids(n, first, words, escapes, block)


def _writer(path: str, end: int):
    def write(batches):
        from pyspark import TaskContext

        coder, shard = subwords(path), TaskContext.get().partitionId()
        ids, counts, parts, held, segment, first = [], [], [], 0, 0, 0

        def row():
            values = np.concatenate(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([len(values)], pa.int64()), pa.array([len(ids)], pa.int32()), binaries([pack_segment(ids, counts, values)])],
                names=["shard", "segment", "first_id", "n_ids", "n_docs", "payload"],
            )

        for batch in batches:
            for b in slices(batch, 1, SLICE):
                coded, sizes = coder.encode_column(b.column(1))
                coded = np.insert(coded, np.cumsum(sizes), end)
                sizes = sizes + 1
                upto = np.cumsum(sizes)
                names = b.column(0).to_pylist()
                k = 0
                while k < len(names):  # whole documents until the segment is full
                    begin = int(upto[k] - sizes[k])
                    to = min(len(names), int(np.searchsorted(upto, begin + SEGMENT - held)) + 1)
                    ids += names[k:to]
                    counts += sizes[k:to].tolist()
                    parts.append(coded[begin : upto[to - 1]])
                    held += int(upto[to - 1]) - begin
                    k = to
                    if held >= SEGMENT:
                        yield row()
                        segment, first = segment + 1, first + held
                        ids, counts, parts, held = [], [], [], 0
        if ids:
            yield row()

    return write


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end: int = 0) -> DataFrame:
    """Encode every text, add the end id to each document, write shards in ascending doc_id order under `out`; the file rows."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")  # equal ids needn't share a shard
    dealt = rows.repartitionByRange(shuffle_partitions(spark), F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie, F.col("text"))
    dealt.mapInArrow(_writer(tokenizer, end), ROWS).write.parquet(out)
    return spark.read.schema(ROWS).parquet(out)


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files. The driver holds one number a shard."""
    totals = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    starts, upto = {}, 0
    for shard in sorted(totals):
        starts[shard] = upto
        upto += totals[shard]

    def read(batches):
        for b in batches:
            for shard, first, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids, counts, values = unpack_segment(payload.as_py())
                raw = memoryview(values.astype("<u4").tobytes())
                edge = np.concatenate([[0], np.cumsum(counts)])
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(edge[:-1] + (starts[shard] + first), pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("shard", "first_id", "payload").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), tokenizer_path()))
