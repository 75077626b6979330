"""Byte-pair encoding and decoding in batched numpy merge rounds.

The distinct space-separated segments of a batch are normalised and cut into words; the words' symbols lie in one flat array. In each round
every word finds its lowest-ranked pair (ranks come from a binary search over the sorted pair keys), merges all places of that pair from
left to right, and only pairs beside a merge are looked up again. A merge never makes a pair of lower rank than its own, so this is the
order of a queue by (rank, place). Words of LONG symbols and more, where a round would serve one pair only, are swept together by rank:
the places of the lowest rank left are merged at once, so the number of rounds is bounded by the number of merges and not by the length.

Vocabulary, merges, end-of-word mark and special tokens come from the tokenizer's file. The text rules are those of its word vocabulary:
special strings are cut out of the raw text first; NFC; white space to a space; lower case letter by letter; words are contractions, runs of
letters, single numerals and runs of anything else. What a letter is depends on a library's Unicode version, so segments with characters
younger than Unicode 3.2 are normalised and cut by the file's own rules. The file has no decoder, so decoding joins the tokens' strings by
spaces.

Defined cases: null text is empty, without ids, and decodes to the empty text; a text of white space likewise; every row, equal ones and
those without a doc_id included, gives its row; texts and words of any length are encoded whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, ship, slices, table
from .token_files import tokenizer_path

LONG = 96  #: symbols from which a word is swept by rank
ROOM = 48 << 20  #: bytes of segments and ids that a worker remembers
SLICE = 2_000_000  #: bytes of text encoded at once, about
NONE = np.int32(2**31 - 1)
#: The words of the vocabulary's text rules, and the mark between two segments.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next letter from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _young() -> np.ndarray:
    """Of each code point whether Unicode 3.2 doesn't assign it."""
    old = unicodedata.ucd_3_2_0.category
    return np.array([old(chr(c)) == "Cn" for c in range(0x110000)])


def lower(text: str) -> str:
    """Lower case letter by letter: unlike Python's, a sigma at a word's end is as any other."""
    return text.replace("Σ", "σ").lower()


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from tokenizers import Tokenizer

        self.rules = Tokenizer.from_file(path)
        self.young = _young()
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.inside = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        names = vocab | special
        self.size = max(names.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        spelt = [b""] * self.size
        for name, i in names.items():
            spelt[i] = name.encode() + b" "
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.letters = np.frombuffer(b"".join(spelt), np.uint8)
        self.width = np.array([len(s) for s in spelt], np.int64)
        self.at = np.cumsum(self.width) - self.width
        self._clear()

    # ------------------------------------------------------------------ merging

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, NONE where no merge joins them."""
        key = a * self.size + b
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[slot] == key, self.ranks[slot], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a line, ids of each word); no word is empty."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        symbols = self.inside[data]
        symbols[np.cumsum(size) - 1] = self.last[data[np.cumsum(size) - 1]]
        of = np.repeat(np.arange(len(words)), size)
        long = (size >= LONG)[of]
        ids, owner = self._rounds(symbols[~long], of[~long])
        if long.any():
            more, whose = self._sweep(symbols[long], of[long])
            ids, owner = np.concatenate([ids, more]), np.concatenate([owner, whose])
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(owner, minlength=len(words)).astype(np.int64)

    def _first_ranks(self, symbols: np.ndarray, of: np.ndarray) -> np.ndarray:
        rank = np.full(len(symbols), NONE, np.int32)
        pair = np.flatnonzero(of[1:] == of[:-1])
        rank[pair] = self.rank(symbols[pair], symbols[pair + 1])
        return rank

    def _rounds(self, symbols: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = self._first_ranks(symbols, of)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            count = np.diff(np.append(head, len(of)))
            least = np.minimum.reduceat(rank, head)
            ready = np.repeat(least == NONE, count)
            if ready.any():
                done.append((symbols[ready], of[ready]))
                symbols, of, rank, least = symbols[~ready], of[~ready], rank[~ready], np.repeat(least, count)[~ready]
            else:
                least = np.repeat(least, count)
            at = _apart(np.flatnonzero(rank == least))
            if not len(at):
                break
            symbols[at] = self.made[rank[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            at -= np.arange(len(at))  # as many places before each are gone as merges
            symbols, of, rank = symbols[stays], of[stays], rank[stays]
            touched = np.zeros(len(of), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            beside = np.flatnonzero(touched)
            inner = beside[beside + 1 < len(of)]
            rank[beside] = NONE
            inner = inner[of[inner] == of[inner + 1]]
            rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
        return (np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])) if done else (symbols, of)

    def _sweep(self, symbols: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(symbols)
        rank = self._first_ranks(symbols, of)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        waits: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(places: np.ndarray) -> None:
            places = places[rank[places] != NONE]
            if not len(places):
                return
            places = places[np.argsort(rank[places], kind="stable")]
            new = np.flatnonzero(np.diff(rank[places])) + 1
            for group in np.split(places, new):
                r = int(rank[group[0]])
                if r not in waits:
                    waits[r] = []
                    heapq.heappush(queue, r)
                waits[r].append(group)

        put(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waits.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            at = _apart(at, after)
            gone = after[at]
            symbols[at] = self.made[r]
            alive[gone], rank[gone] = False, NONE
            then = after[gone]
            after[at] = then
            inside = then < n
            before[then[inside]] = at[inside]
            beside = np.unique(np.concatenate([at, before[at]]))
            beside = beside[beside >= 0]
            rank[beside] = NONE
            inner = beside[after[beside] < n]
            inner = inner[of[inner] == of[after[inner]]]
            rank[inner] = self.rank(symbols[inner], symbols[after[inner]])
            put(inner)
        return symbols[alive], of[alive]

    # ------------------------------------------------------------------ texts

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.store, self.end, self.held = np.zeros(1 << 16, np.uint32), 0, 0
        self.begin, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Encode distinct segments (no ASCII white space inside) and remember them."""
        marked = [s for s in new if "<|" in s] if self.cut else []
        parts: list[tuple[str, ...]] = [(s,) for s in new]
        if marked:
            parts = [tuple(self.cut.split(s)) if "<|" in s else (s,) for s in new]
        names = [p for pieces in parts for p in pieces]
        line = "\n".join(names)
        young = []
        if not line.isascii():
            codes = np.frombuffer(line.encode("utf-32-le"), np.uint32)
            late = np.flatnonzero(self.young[codes])
            if len(late):
                young = np.unique(np.cumsum(codes == 10)[late]).tolist()
                skip = set(young)
                line = "\n".join("" if k in skip else p for k, p in enumerate(names))
            line = unicodedata.normalize("NFC", line)
        words = pa.array(WORDS.findall(lower(line)), pa.string())
        mark = np.asarray(pc.equal(words, "\n"))
        piece = np.cumsum(mark)[~mark]  # which part each word is in
        distinct = words.filter(pa.array(~mark)).dictionary_encode()
        spelt = [w.encode() for w in distinct.dictionary.to_pylist()]
        of = np.asarray(distinct.indices).astype(np.int64)
        if young:
            cut = [self._by_the_rules(names[k]) for k in young]
            more = [w for words in cut for w in words]
            of = np.concatenate([of, len(spelt) + np.arange(len(more))])
            piece = np.concatenate([piece, np.repeat(young, list(map(len, cut)))])
            spelt += more
        ids, size = self.encode_words(spelt) if spelt else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        begin = np.cumsum(size) - size
        if young:
            order = np.argsort(piece, kind="stable")
            of, piece = of[order], piece[order]
        flat = ids[spread(begin[of], size[of])]
        owner = np.repeat(piece, size[of])
        if marked:
            fixed = np.array([k for k, p in enumerate(names) if p in self.special], np.int64)
            drop = np.isin(owner, fixed)
            flat = np.concatenate([flat[~drop], np.array([self.special[names[k]] for k in fixed], np.uint32)])
            owner = np.concatenate([owner[~drop], fixed])
            order = np.argsort(owner, kind="stable")
            flat, owner = flat[order], owner[order]
        whose = np.repeat(np.arange(len(new)), [len(p) for p in parts])
        count = np.bincount(whose[owner] if len(owner) else owner, minlength=len(new)).astype(np.int64)
        self._put(new, flat, count)

    def _by_the_rules(self, part: str) -> list[bytes]:
        cut = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(part))
        return [bytes(map(self.byte_of.__getitem__, word)) for word, _ in cut]

    def _put(self, names: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        at, n = len(self.index), len(names)
        self.store = _room(self.store, self.end + len(ids))
        self.store[self.end : self.end + len(ids)] = ids
        self.begin, self.count = _room(self.begin, at + n), _room(self.count, at + n)
        self.begin[at : at + n], self.count[at : at + n] = self.end + np.cumsum(count) - count, count
        self.end += len(ids)
        self.held += sum(map(len, names)) + 4 * len(ids) + 100 * n
        self.index.update(zip(names, range(at, at + n), strict=True))

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in a line, ids of each row)."""
        if not len(col):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.held > ROOM:
            self._clear()
        cut = pc.ascii_split_whitespace(pc.fill_null(col, ""))
        coded = cut.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        of = np.array(list(map(self.index.get, names, repeat(-1))), np.int64)
        lack = np.flatnonzero(of < 0)
        if len(lack):
            at = len(self.index)
            self._learn([names[k] for k in lack.tolist()])
            of[lack] = at + np.arange(len(lack))
        of = of[np.asarray(coded.indices)]
        edge = np.asarray(cut.offsets).astype(np.int64)
        edge -= edge[0]
        count = self.count[of]
        return self.store[spread(self.begin[of], count)], np.diff(np.concatenate([[0], np.cumsum(count)])[edge])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """The decoded texts in UTF-8: strings of each row's tokens, joined by spaces."""
        ids = ids.astype(np.int64)
        width = self.width[ids]
        line = memoryview(self.letters[spread(self.at[ids], width)].tobytes())
        edge = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [line[i : max(i, j - 1)] for i, j in zip(edge[:-1], edge[1:], strict=True)]


def _apart(at: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Of places whose pairs overlap in a chain the first, third and so on, as merging from left to right takes them."""
    if len(at) < 2:
        return at
    follows = (at[1:] == (at[:-1] + 1 if after is None else after[at[:-1]]))
    if not follows.any():
        return at
    k = np.arange(len(at))
    head = np.maximum.accumulate(np.where(np.append(True, ~follows), k, 0))
    return at[(k - head) % 2 == 0]


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, .. of each slice, one slice behind another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


_LOADED: dict[str, WordBpe] = kept()


def word_bpe(path: str) -> WordBpe:
    """One for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; texts: and ids (array) and decoded."""
    ship(docs.sparkSession)

    def run(batches):
        coder = word_bpe(path)
        for batch in batches:
            for b in slices(batch, 1, SLICE):
                ids, counts = coder.encode_column(b.column(1))
                raw = memoryview(ids.astype("<u4").tobytes())
                edge = np.concatenate([[0], np.cumsum(counts)])
                decoded = coder.decode(ids, counts)
                arrays = [b.column(0), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if texts:
                    arrays += [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.astype(np.int32))), pa.array([bytes(d).decode() for d in decoded], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT + (", ids array<int>, decoded string" if texts else ""))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
