"""Alignment of two tokenizers over one text: groups of tokens between common ends, links of overlapping tokens, counts of linked ids.

A text is cut before every space that a character other than white space follows. Neither tokenizer has a token across such a cut: the
byte-level one opens a pre-token there, and no piece of the other has a space behind a letter. So segments are tokenised once and
remembered; a text with white space next to white space is one segment. For the new segments of a batch, all in one line of bytes, the
ends of tokens are cumulative sums of their lengths, common ends are the intersection of both, a search among them labels each token with
its group, and each token of A is repeated for the tokens of B that its bytes overlap.

Counts over the corpus never meet a whole table: a chunk (some CHUNK bytes of whole texts) hands on each of its distinct pairs once with
how many links hold it; pairs are summed over salts and then over the salts' sums, and each B id's highest count is joined back. Every
chunk gets the counts of its own pairs, an array no longer than its links, and scores its texts by the segments it stored.

Defined cases: null and empty texts, and texts whose tokens' bytes aren't the space and the text, have zeros and ''; equal rows and rows
without a doc_id each give their row and are all counted; a text of any length is a chunk of its own at most; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, kept, packed, ship, slices, stored, table, unpacked
from .token_files import tokenizer_path
from .word_bpe import byte_letters, spread

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CHUNK = 2_000_000  #: bytes of text in a chunk, about
ROOM = 80 << 20  #: bytes of segments, tokens and links that a worker remembers
LEARN = 2_000  #: segments tokenised at once
SALTS = 8
SPACE = " "


class Aligner:
    def __init__(self, a: str, b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True  # their strings are text
        self.b = SentencePieceProcessor(model_file=b)
        back = {c: i for i, c in enumerate(byte_letters())}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.a_bytes[i] = bytes(back[c] for c in name)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", SPACE).encode() for i, p in enumerate(pieces)]
        self.a_width, self.b_width = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_opens, self.b_opens = (np.array([x[:1] == b" " for x in y]) for y in (self.a_bytes, self.b_bytes))
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.names: list[bytes] = []  # groups as text
        self.links: list[np.ndarray] = []  # link keys a << 32 | b, by batch learnt
        self.link_of = [np.zeros((0, 2), np.int64)]
        self.n = [np.zeros((0, 4), np.int64)]  # A tokens, B tokens, groups; bad segments have -1 in the last
        self.held, self.n_links = 0, 0

    def _tokens(self, segments: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids in a line, ids of each segment) of A and of B; a segment whose tokens' bytes aren't it behind its space has no ids and -1.
        Joined segments hold no space and are tokenised in one line each, which is parted where ids begin with a space; a line that doesn't
        come out is halved."""
        if joined and len(segments) > 1:
            line = SPACE.join(segments)
            a = np.array(self.a.encode_batch_fast([SPACE + line], add_special_tokens=False)[0].ids, np.int64)
            b = np.array(self.b.encode(line), np.int64)
            at_a, at_b = np.flatnonzero(self.a_opens[a]), np.flatnonzero(self.b_opens[b])
            if len(at_a) == len(at_b) == len(segments) and self._spelt(a.tolist(), b.tolist(), line):
                return a, np.diff(np.append(at_a, len(a))), b, np.diff(np.append(at_b, len(b)))
            half = len(segments) // 2
            return tuple(np.concatenate(x) for x in zip(self._tokens(segments[:half], True), self._tokens(segments[half:], True), strict=True))
        a = [e.ids for e in self.a.encode_batch_fast([SPACE + s for s in segments], add_special_tokens=False)]  # an encoding is much larger than its ids
        b = self.b.encode(segments, num_threads=1)
        right = [self._spelt(x, y, s) for x, y, s in zip(a, b, segments, strict=True)]
        return tuple(z for y in (a, b) for z in (np.array([i for x, r in zip(y, right, strict=True) if r for i in x], np.int64), np.array([len(x) if r else -1 for x, r in zip(y, right, strict=True)], np.int64)))

    def _spelt(self, a: list[int], b: list[int], text: str) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == (SPACE + text).encode() == b"".join(map(self.b_bytes.__getitem__, b))

    def _learn(self, new: list[str], joined: bool = False) -> None:
        a, n_a, b, n_b = self._tokens(new, joined)
        right = n_a >= 0
        good = np.flatnonzero(right)
        n_a, n_b = n_a[good], n_b[good]
        groups, begin, link, n_groups, n_links = align(a, b, n_a, n_b, self.a_width[a], self.b_width[b])
        counts = np.zeros((len(new), 4), np.int64)
        counts[:, 3] = ~right
        counts[good, 0], counts[good, 1], counts[good, 2] = n_a, n_b, n_groups
        at = np.zeros((len(new), 2), np.int64)
        at[good, 0], at[good, 1] = self.n_links + np.cumsum(n_links) - n_links, n_links
        names = [b""] * len(new)
        line = memoryview(groups)
        for k, i, j in zip(good.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            names[k] = bytes(line[i : j - 1])  # without the mark behind its last group
        self.index.update(zip(new, range(len(self.names), len(self.names) + len(new)), strict=True))
        self.names += names
        self.links.append(link)
        self.link_of.append(at)
        self.n.append(counts)
        self.n_links += len(link)
        self.held += len(groups) + 8 * len(link) + sum(map(len, new)) + 350 * len(new)

    def segments(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(segment of each place in a line, where each row's segments begin and the end); null and empty rows have none."""
        if self.held > ROOM:
            self._clear()
        col = pc.fill_null(col, "")
        cut = pc.split_pattern(col, SPACE)
        parts = cut.flatten()
        edge = np.asarray(cut.offsets).astype(np.int64)
        edge -= edge[0]
        coded = parts.dictionary_encode()
        # a cut before white space isn't one; what stands before it in the row doesn't matter
        odd = np.asarray(pc.match_substring_regex(coded.dictionary, r"^$|^[\s\x0B\x1C-\x1F\x{85}\p{Z}]"))[np.asarray(coded.indices)]
        whole = np.logical_or.reduceat(odd, edge[:-1]) if len(parts) else np.zeros(0, bool)
        of = np.full(len(parts), -1, np.int64)
        plain = np.repeat(~whole, np.diff(edge))
        used = np.unique(np.asarray(coded.indices)[plain])
        names = coded.dictionary.take(pa.array(used)).to_pylist()
        rows = np.flatnonzero(whole)
        texts = [col[k].as_py() for k in rows.tolist()]
        named = dict.fromkeys(names)
        new = [s for s in named if s not in self.index]
        for k in range(0, len(new), LEARN):
            self._learn(new[k : k + LEARN], True)
        new = [t for t in dict.fromkeys(texts) if t and t not in self.index]
        for k in range(0, len(new), LEARN):
            self._learn(new[k : k + LEARN])
        table_of = np.full(len(coded.dictionary), -1, np.int64)
        table_of[used] = list(map(self.index.__getitem__, names))
        of[plain] = table_of[np.asarray(coded.indices)[plain]]
        size = np.diff(edge)
        keep = plain.copy()
        for k, t in zip(rows.tolist(), texts, strict=True):
            if t:
                of[edge[k]], keep[edge[k]] = self.index[t], True
            size[k] = 1 if t else 0
        return of[keep], np.concatenate([[0], np.cumsum(size)])

    def arrays(self):
        """(counts, place and number of links) of the segments, and all links."""
        self.n, self.link_of, self.links = [np.concatenate(self.n)], [np.concatenate(self.link_of)], [np.concatenate(self.links) if self.links else np.zeros(0, np.int64)]
        return self.n[0], self.link_of[0], self.links[0]


def align(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, a_width: np.ndarray, b_width: np.ndarray):
    """Groups and links of texts in a line, given as ids, tokens of each text and byte lengths of the tokens.

    (groups of all texts as bytes, each with `;` behind it; where each text's begin, and the end; links a << 32 | b in the order of A's
    tokens; groups and links of each text). Both tokenizations spell the same bytes, so texts end at common ends."""
    a_end, b_end = np.cumsum(a_width), np.cumsum(b_width)
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
    first, last = np.searchsorted(b_end, a_end - a_width, "right"), np.searchsorted(b_end, a_end)
    many = last - first + 1
    links = (np.repeat(a, many) << 32) | b[spread(first, many)]
    a_text = np.repeat(np.arange(len(n_a)), n_a)
    n_links = np.bincount(a_text, many, len(n_a)).astype(np.int64)
    last_group = np.zeros(len(n_a) + 1, np.int64)
    last_group[1:] = np.where(n_a > 0, a_group[np.maximum(np.cumsum(n_a) - 1, 0)] + 1 if len(a) else 0, 0)
    last_group = np.maximum.accumulate(last_group)
    # tokens by group, A before B, each with the mark behind it
    side = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
    group = np.concatenate([a_group, b_group])
    order = np.argsort(2 * group + side, kind="stable")
    ids, side, group = np.concatenate([a, b])[order], side[order], group[order]
    ends = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
    turns = np.append((side[1:] != side[:-1]), False) & ~ends if len(group) else ends
    words = pa.array(ids).cast(pa.string())
    marks = pa.array(np.array([",", "|", ";"], object)).take(pa.array(np.where(ends, 2, turns.astype(np.int64))))
    text = pc.binary_join_element_wise(words, marks, "")
    upto = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(text)).astype(np.int64))])
    tokens = np.concatenate([[0], np.cumsum(n_a + n_b)])  # texts are whole groups, so they keep their order
    return flat(text)[0].tobytes(), upto[tokens], links, np.diff(last_group), n_links


_LOADED: dict[tuple[str, str], Aligner] = kept()


def aligner(a: str, b: str) -> Aligner:
    """One for each worker process and pair of files."""
    if (a, b) not in _LOADED:
        _LOADED[a, b] = Aligner(a, b)
    return _LOADED[a, b]


ALIGNED = "chunk string, docs binary, hashes array<string>, edges binary, segments binary, spans binary, codes binary, pairs binary, times binary"


def _aligned(a: str, b: str):
    """A row for each chunk: counts and group hashes of its texts, the segments of each text, the links of each segment and the distinct pairs."""

    def run(batches):
        from pyspark import TaskContext

        tool, k = aligner(a, b), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for chunk in slices(batch, 1, CHUNK):
                of, edge = tool.segments(chunk.column(1))
                counts, link_of, links = tool.arrays()
                bad = np.add.reduceat(np.append(counts[of, 3], 0), edge[:-1]) * (np.diff(edge) > 0) if len(edge) > 1 else np.zeros(0, np.int64)
                right = bad == 0
                keep = np.repeat(right, np.diff(edge))
                of = of[keep]
                edge = np.concatenate([[0], np.cumsum(np.where(right, np.diff(edge), 0))])
                used, mine, times = np.unique(of, return_inverse=True, return_counts=True)
                spans = link_of[used, 1]
                flat = links[spread(link_of[used, 0], spans)]
                pairs, code = np.unique(flat, return_inverse=True)
                n = np.bincount(code, np.repeat(times, spans), len(pairs)).astype(np.int64)
                sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(np.column_stack([counts[of, :3], link_of[of, 1]]), axis=0)])
                per = np.diff(sums[edge], axis=0)
                names = list(map(tool.names.__getitem__, of.tolist()))
                hashes = [hashlib.sha256(b";".join(names[i:j])).hexdigest() if j > i else "" for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                ids = chunk.column(0)
                nulls = np.asarray(pc.is_null(ids)).astype(np.int64)
                known = np.asarray(pc.fill_null(ids, 0)).astype(np.int64)
                rows = np.column_stack([known, nulls, per]) if len(per) else np.zeros((0, 6), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{part}-{k}"]), _one(rows.tobytes()), pa.array([hashes], pa.list_(pa.string())), *(_one(packed(x[None])) for x in (edge, mine, spans, code)), _one(pairs.tobytes()), _one(n.tobytes())],
                    names=["chunk", "docs", "hashes", "edges", "segments", "spans", "codes", "pairs", "times"],
                )
                k += 1

    return run


def _one(raw: bytes) -> pa.Array:
    return pa.array([raw], pa.binary())


PAIRS = "chunk string, code int, a int, b int, n bigint"


def _pairs(batches):
    """The distinct pairs of each chunk as rows."""
    for batch in batches:
        for chunk, pairs, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            pairs, times = np.frombuffer(pairs.as_py(), np.int64), np.frombuffer(times.as_py(), np.int64)
            for at in range(0, len(pairs), 50_000):
                p, n = pairs[at : at + 50_000], times[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]).take(pa.array(np.zeros(len(p), np.int32))), pa.array(np.arange(at, at + len(p), dtype=np.int32)), pa.array((p >> 32).astype(np.int32)), pa.array((p & 0xFFFFFFFF).astype(np.int32)), pa.array(n)],
                    names=["chunk", "code", "a", "b", "n"],
                )


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _scored(batches):
    for batch in batches:
        cols = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            rows = np.frombuffer(cols["docs"][r].as_py(), np.int64).reshape(-1, 6)
            edge, mine, spans, code = (unpacked(cols[c][r].as_py(), 1)[0].astype(np.int64) for c in ("edges", "segments", "spans", "codes"))
            totals = cols["totals"][r].values if cols["totals"][r].is_valid else pa.array([], pa.struct([("code", pa.int32()), ("total", pa.int64()), ("best", pa.bool_())]))
            place = np.asarray(totals.field("code")).astype(np.int64)
            count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            count[place] = np.asarray(totals.field("total"))
            best[place] = np.asarray(totals.field("best").cast(pa.int8()))
            seg = np.concatenate([[0], np.cumsum(spans)])
            out = []
            for value in (best, count):
                of_segment = np.diff(np.concatenate([[0], np.cumsum(value[code])])[seg])
                out.append(np.diff(np.concatenate([[0], np.cumsum(of_segment[mine])])[edge]))
            ids = pa.array(rows[:, 0], pa.int64(), mask=rows[:, 1].astype(bool))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(rows[:, k]) for k in range(2, 6)), pa.array(out[0]), pa.array(out[1]), cols["hashes"][r].values],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )


def pair_totals(pairs: DataFrame) -> DataFrame:
    """a, b, total (links of the pair in all chunks) and best (no A id has more with this B id), of rows chunk, code, a, b, n."""
    salt = F.pmod(F.xxhash64("chunk"), F.lit(SALTS))
    totals = pairs.groupBy("a", "b", salt.alias("salt")).agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("total"))
    totals = stored(totals, "pair_totals")
    top = totals.groupBy(F.col("b").alias("_b")).agg(F.max("total").alias("top"))
    return totals.join(top, F.col("b") == F.col("_b")).select("a", "b", "total", (F.col("total") == F.col("top")).alias("best"))


def align_texts(docs: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(what op12's contract lists for every row, the counts of the linked ids: a, b, total, best) of two tokenizers' files."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = stored(rows.mapInArrow(_aligned(a, b), ALIGNED), "aligned")
    pairs = stored(chunks.select("chunk", "pairs", "times").mapInArrow(_pairs, PAIRS), "pairs")
    totals = stored(pair_totals(pairs), "totals")
    # a pair is one row a chunk; over salts, so that a pair of every chunk isn't one task's
    salt = F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).cast("int").alias("salt")
    spread_totals = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    known = pairs.select("chunk", "code", "a", "b", salt).join(spread_totals.hint("merge"), ["a", "b", "salt"])  # grows with the corpus: not to be broadcast
    known = known.groupBy("chunk").agg(F.collect_list(F.struct("code", "total", "best")).alias("totals"))
    scored = chunks.drop("pairs", "times").join(known, "chunk", "left")
    return scored.mapInArrow(_scored, RESULT), totals


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_texts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))[0]
