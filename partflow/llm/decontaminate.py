"""Benchmark decontamination: a BM25 index of test items, queried by every training passage with block-max WAND.

A posting's weight is the term's BM25 impact divided by the item's own score, so a passage that holds the whole item scores 1 and one
threshold fits all items. Passages are windows of words that overlap by half and hold the longest item of the index. Term bounds act
twice: of every item the commonest terms, up to a known share of its score, cannot reach the threshold alone, so a passage must hold
enough of the others, and a batch's passages are tested for that in one vectorised step; those that pass go through block-max WAND,
which returns every item over the threshold. A hit counts if enough of the question's and of the answer's shingles of five words stand
in the document, or nearly all of the whole item's. A part's shingles are its own, or those of the item that begin in the question or
end in the answer, whichever stand there more: a short part is one shingle of its own, lost with one word that is glued to other text.

A word is compared without the ASCII marks at its ends; a word of marks alone stays as it is.

Items come in shards of SHARD_WORDS words at most (one item alone may be larger), so an index is bounded whatever the table's size; the
documents are read once for each shard. An item's answer is its last line, or its last quarter of words if it has one line.

Defined cases: null texts, items without words and null item ids are no items; null document texts hold nothing; rows with equal ids
are items or documents of their own and give rows of their own; a null doc_id is reported as null; texts of any length are cut into
windows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, mix, ship, slices, table, without, words_of

K1, B = 1.2, 0.75
THETA = 0.6  #: share of an item's own score at which a passage is a hit
COMMON = 0.3  #: share of an item's score that its commonest terms may hold and be left out of the first test
WINDOW = 96  #: words of a passage at least
GRAM, QUESTION, ANSWER = 5, 0.5, 0.5
WHOLE = 0.9  #: share of the whole item's shingles that is a hit whatever its parts hold
SHARD_WORDS = 1_000_000
POSTING_BLOCK = 32
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
ROWS = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of the runs of n words; of all words if there are fewer."""
    if len(words) < n:
        n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out += mix(words[j : len(words) - n + 1 + j] + _STEP[j]) * (_STEP[j] | np.uint64(1))
    return mix(out ^ np.uint64(n))


def question_and_answer(text: str) -> tuple[str, str]:
    head, _, tail = text.rstrip().rpartition("\n")
    if head.strip() and tail.strip():
        return head, tail
    words = text.split()
    cut = len(words) - max(1, len(words) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def bare_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows without the marks at their ends, and for each row the index of its first word (one more at the end)."""
    words, starts, ends, first = words_of(data, offsets)
    odd = np.flatnonzero(_MARK[data[starts]] | _MARK[data[ends - 1]])
    if len(odd):
        body = np.flatnonzero(~_MARK[data])
        a, b = starts[odd], ends[odd]
        left, right = np.searchsorted(body, a), np.searchsorted(body, b) - 1
        some = (left <= right) & (left < len(body))
        odd, left, right = odd[some], body[left[some]], body[right[some]] + 1
        if len(odd):
            # the bodies one behind another, a space between them, as a text of its own
            size = right - left + 1
            ahead = np.cumsum(size) - size
            at = np.repeat(left - ahead, size) + np.arange(int(size.sum()))
            text = data[np.minimum(at, len(data) - 1)].copy()
            text[ahead + size - 1] = 32
            words = words.copy()
            words[odd] = words_of(text, np.array([0, len(text)]))[0]
    return words, first


def _hash_words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return bare_words(raw, np.array([0, len(raw)]))[0]


def shingles_of(question: np.ndarray, answer: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(words of a shingle, shingles): of the question, of the answer, and of the whole item."""
    whole = np.concatenate([question, answer])
    return [(min(GRAM, len(w)), grams(w)) for w in (question, answer, whole)]


class ItemIndex:
    """Postings by term, sorted by item, with the largest weight of each block and term."""

    def __init__(self, items: list[tuple[int, str]]):
        words = [_hash_words(t) for _, t in items]
        keep = [k for k, w in enumerate(words) if len(w)]
        self.ids = [items[k][0] for k in keep]
        words = [words[k] for k in keep]
        parts = [[_hash_words(p) for p in question_and_answer(items[k][1])] for k in keep]
        self.parts = [shingles_of(*p) for p in parts]
        self.sizes = [[len(w) for w in p] for p in parts]  # words of question and answer
        n = len(words)
        length = np.array([len(w) for w in words], float)
        self.window = max(WINDOW, 2 * int(length.max(initial=0)))
        pairs = [np.unique(w, return_counts=True) for w in words]
        term = np.concatenate([p[0] for p in pairs]) if n else np.zeros(0, np.uint64)
        tf = np.concatenate([p[1] for p in pairs]) if n else np.zeros(0)
        item = np.repeat(np.arange(n), [len(p[0]) for p in pairs])
        self.terms, of, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        impact = idf[of] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(1e-9, length.mean() if n else 1)))
        own = np.bincount(item, impact, n)
        weight = impact / own[item]
        # of each item the commonest terms first: those within the share COMMON are not essential
        order = np.lexsort((of, -df[of], item))
        run = np.cumsum(weight[order])
        first = np.searchsorted(item[order], np.arange(n))
        run -= np.concatenate([[0], run])[first][item[order]]
        light = np.zeros(len(of), bool)
        light[order] = run <= COMMON
        self.need = THETA - np.bincount(item[light], weight[light], n) - 1e-9
        order = np.lexsort((item, of))
        self.item, self.weight, essential = item[order], weight[order], ~light[order]
        self.start = np.concatenate([np.searchsorted(of[order], np.arange(len(self.terms))), [len(of)]])
        # the essential postings alone, for the first test
        self.e_item, self.e_weight = self.item[essential], self.weight[essential]
        self.e_start = np.concatenate([[0], np.cumsum(essential)])[self.start]
        self.block_max = [np.maximum.reduceat(self.weight[a:b], np.arange(0, b - a, POSTING_BLOCK)) if b > a else np.zeros(0) for a, b in zip(self.start[:-1], self.start[1:], strict=True)]
        self.term_max = np.array([m.max() for m in self.block_max])
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for words that no item has."""
        out = np.full(len(words), -1, np.int64)
        maybe = np.flatnonzero(self.sieve[(words & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.terms, words[maybe])
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == words[maybe] if len(self.terms) else np.zeros(len(maybe), bool)
        out[maybe[hit]] = at[hit]
        return out

    def candidates(self, term: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
        """Passages that hold enough essential weight of some item. term, passage: occurrences, each of term >= 0."""
        rich = self.e_start[term + 1] > self.e_start[term]
        key = np.unique(passage[rich] * len(self.terms) + term[rich])
        passage, term = key // len(self.terms), key % len(self.terms)
        size = self.e_start[term + 1] - self.e_start[term]
        ahead = np.cumsum(size) - size
        at = np.repeat(self.e_start[term] - ahead, size) + np.arange(int(size.sum()))
        pair, of = np.unique(np.repeat(passage, size) * len(self.ids) + self.e_item[at], return_inverse=True)
        mass = np.bincount(of, self.e_weight[at], len(pair))
        return np.unique(pair[mass >= self.need[pair % len(self.ids)]] // len(self.ids)) if len(pair) else np.zeros(0, np.int64)

    def wand(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Every (item number, score) with a score of THETA at least, for a query of distinct terms, by block-max WAND."""
        out = []
        lists = [[int(self.item[self.start[t]]), int(self.start[t]), int(self.start[t + 1]), float(self.term_max[t]), int(t)] for t in terms]  # [item now, place, end, bound, term]
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= THETA - 1e-12:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # bounds of the blocks in which the pivot item would stand
            tight, reach = 0.0, None
            for x in lists[: pivot + 1]:
                at = x[1] if x[0] == item else x[1] + int(np.searchsorted(self.item[x[1] : x[2]], item))
                if at < x[2]:
                    b = (at - int(self.start[x[4]])) // POSTING_BLOCK
                    tight += float(self.block_max[x[4]][b])
                    last = min(x[2], int(self.start[x[4]]) + (b + 1) * POSTING_BLOCK) - 1
                    reach = int(self.item[last]) if reach is None else min(reach, int(self.item[last]))
            if tight < THETA - 1e-12:  # no item up to the nearest block end can reach the threshold
                goal = (reach if reach is not None else item) + 1
                if pivot + 1 < len(lists):
                    goal = min(goal, max(item + 1, lists[pivot + 1][0]))
                self._skip(lists, pivot, max(goal, item + 1))
            elif lists[0][0] == item:
                score = sum(float(self.weight[x[1]]) for x in lists[: pivot + 1])
                if score >= THETA - 1e-12:
                    out.append((item, score))
                self._skip(lists, pivot, item + 1)
            else:
                self._skip(lists, pivot, item)
            lists = [x for x in lists if x[1] < x[2]]
        return out

    def _skip(self, lists: list, upto: int, goal: int) -> None:
        for x in lists[: upto + 1]:
            if x[0] < goal:
                x[1] += int(np.searchsorted(self.item[x[1] : x[2]], goal))
                x[0] = int(self.item[x[1]]) if x[1] < x[2] else -1


def _windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, first word) of the windows of each row's words: steps of half a window, the last one ends with the row or beyond."""
    half = size // 2
    words = np.diff(first)
    n = np.where(words > 0, np.maximum(1, -(-(words - size) // half) + 1), 0)
    row = np.repeat(np.arange(len(words)), n)
    return row, first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * half


def find_leaks(index: ItemIndex, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(row, item number, best score, question overlap, answer overlap) of the rows' leaked items."""
    words, first = bare_words(data, offsets)
    term = index.lookup(words)
    row, begin = _windows(first, index.window)
    end = np.minimum(begin + index.window, first[row + 1])
    size = end - begin
    ahead = np.cumsum(size) - size
    at = np.repeat(begin - ahead, size) + np.arange(int(size.sum()))
    known = term[at] >= 0
    passage = np.repeat(np.arange(len(row)), size)[known]
    best: dict[tuple[int, int], float] = {}
    for p in index.candidates(term[at][known], passage, len(row)).tolist():
        terms = np.unique(term[begin[p] : end[p]])
        for item, score in index.wand(terms[terms >= 0]):
            key = (int(row[p]), item)
            best[key] = max(score, best.get(key, 0.0))
    out, now, by = [], -1, {}
    for (r, item), score in sorted(best.items()):
        if r != now:
            now, by = r, {}
        held = []
        for n, part in index.parts[item]:
            if n not in by:
                w = words[first[r] : first[r + 1]]
                by[n] = grams(w, n) if 0 < n <= len(w) else np.zeros(0, np.uint64)
            held.append(np.isin(part, by[n]))
        whole = held.pop()
        across = (whole[: index.sizes[item][0]], whole[max(0, len(whole) - index.sizes[item][1]) :])
        overlap = [max(float(own.mean()), float(run.mean())) if len(own) else 1.0 for own, run in zip(held, across, strict=True)]
        if (overlap[0] >= QUESTION and overlap[1] >= ANSWER) or whole.mean() >= WHOLE:
            out.append((r, item, score, *overlap))
    return out


def _shards(items: DataFrame, most: int):
    """The items in shards of `most` words at most, one shard at a time on the driver."""
    shard, held = [], 0
    for r in items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        n = len(r[1].split())
        if shard and held + n > most:
            yield shard
            shard, held = [], 0
        shard.append((r[0], r[1]))
        held += n
    if shard:
        yield shard


def leaks(docs: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, score, question_overlap, answer_overlap."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [rows.mapInArrow(_search(spark.sparkContext.broadcast(shard)), ROWS) for shard in _shards(items, shard_words)]
    out = found[0] if found else spark.createDataFrame([], ROWS)
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _search(shard):
    def run(batches):
        index = None
        for batch in batches:
            for b in slices(batch, 1, 1_000_000):
                if index is None:
                    index = ItemIndex(shard.value)
                if not index.ids:
                    return
                ids = b.column(0).to_pylist()
                if hits := find_leaks(index, *flat(b.column(1))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[h[0]] for h in hits], pa.int64()), pa.array([index.ids[h[1]] for h in hits], pa.int64()), *(pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4))],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

    return run


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id leaks no item, all their columns."""
    return without(docs, leaks(docs, items).select("doc_id").distinct())


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
