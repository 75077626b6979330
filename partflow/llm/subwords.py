"""Subword ids with a public tokenizer, remembered by space-separated segment.

In the byte-level vocabularies no pre-token crosses a space from left to right: a single space opens the pre-token of the word behind
it, and a single line break between two words is a pre-token of its own. So the ids of a text are the ids of its segments, each with
its leading space or break, joined; commas and stops behind a word are segments of their own, so that fewer segments are new. Texts with
white space next to white space, or such a mark behind another, are encoded whole.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

ROOM = 500_000  #: segments that a worker remembers
OFTEN = 3  #: batches that a segment was in to stay when the room is full
BREAK, COMMA, STOP = "\0", "\1", "\2"  #: a line break at a segment's beginning; a comma or stop alone. Texts that hold them are encoded whole
#: In order. A mark behind a letter or digit and before white space is a pre-token of its own.
CUTS = ((".\n", " \2 \0"), ("\n", " \0"), (", ", " \1 "), (". ", " \2 "))


class Subwords:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose bytes begin with a space
        self.opens[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True
        self.breaks = np.zeros(len(self.opens), bool)  # and with a line break
        self.breaks[[i for t, i in vocabulary.items() if t[0] == "\u010a"]] = True
        self.marks = [vocabulary[","], vocabulary["."]]
        self.room = ROOM
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.hits = np.zeros(self.room, np.int32)
        self.store, self.end = np.zeros(1 << 20, np.uint32), 0
        self.begin, self.size = np.zeros(self.room, np.int32), np.zeros(self.room, np.int32)
        self.odd = np.zeros(self.room, bool)  # segments whose text must be encoded whole
        self.ends = np.zeros(self.room, bool)  # segments that end in a letter or digit
        self.index |= {COMMA: 0, STOP: 1}
        self.names += [COMMA, STOP]
        self.store[:2], self.end = self.marks, 2
        self.begin[1], self.size[:2], self.hits[:2] = 1, 1, OFTEN

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, new: list[str], lead: str, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a line, ids of each) of segments, each behind `lead`, in one call: `opens` tells the ids that begin with the lead."""
        if not new:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([lead + lead.join(new)], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(opens[ids])
        if len(at) != len(new):
            raw = self._raw([lead + s for s in new])
            return np.frombuffer(b"".join(raw), "<u4"), np.array([len(r) // 4 for r in raw])
        return ids, np.diff(np.append(at, len(ids)))

    def spell(self, words: list[str]) -> list[bytes]:
        """Ids of words (no space inside, not empty), each with a space in front; nothing is remembered."""
        out = []
        for k in range(0, len(words), 20_000):
            ids, size = self._fresh(words[k : k + 20_000], " ", self.opens)
            raw, edge = ids.tobytes(), np.concatenate([[0], 4 * np.cumsum(size)]).tolist()
            out += [raw[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]
        return out

    def _put(self, names: list[str], ids: np.ndarray, size: np.ndarray, odd: bool | np.ndarray = False) -> None:
        at, n = len(self.index), len(names)
        while self.end + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(len(self.store), np.uint32)])
        self.store[self.end : self.end + len(ids)] = ids
        self.begin[at : at + n], self.size[at : at + n], self.odd[at : at + n] = self.end + np.cumsum(size) - size, size, odd
        self.ends[at : at + n] = [s[-1:].isalnum() for s in names]
        self.end += len(ids)
        self.index.update(zip(names, range(at, at + n), strict=True))
        self.names += names

    def _make_room(self, need: int) -> None:
        """Forget what came up in few batches; everything if that isn't enough."""
        keep = np.flatnonzero(self.hits[: len(self.names)] >= OFTEN)[2:]
        names, begin, size, odd, store = [self.names[k] for k in keep.tolist()], self.begin[keep], self.size[keep].astype(np.int64), self.odd[keep], self.store
        self.room = max(self.room, 2 * need)
        self._clear()
        if len(names) + need <= self.room // 2:
            at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            self._put(names, store[at], size, odd)

    def _learn(self, new: list[str]) -> None:
        odd, plain, lines = [], [], []
        for s in new:
            if not s or s[-1].isspace() or s == BREAK or (s[0] == BREAK and s[1].isspace()):
                odd.append(s)
            elif s[0] == BREAK:
                (odd if any(c.isspace() for c in s) else lines).append(s)
            else:
                plain.append(s)
        self._put(odd, np.zeros(0, np.uint32), np.zeros(len(odd), np.int64), True)
        for k in range(0, len(plain), 20_000):
            self._put(plain[k : k + 20_000], *self._fresh(plain[k : k + 20_000], " ", self.opens))
        for k in range(0, len(lines), 20_000):
            self._put(lines[k : k + 20_000], *self._fresh([s[1:] for s in lines[k : k + 20_000]], "\n", self.breaks))

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Places of distinct segments in the table."""
        out = np.array(list(map(self.index.get, words, repeat(-1))), np.int32)
        lack = np.flatnonzero(out < 0)
        if len(self.index) + len(lack) > self.room:
            self._make_room(len(words))
            out = np.array(list(map(self.index.get, words, repeat(-1))), np.int32)
            lack = np.flatnonzero(out < 0)
        if len(lack):
            new = [words[k] for k in lack.tolist()]
            self._learn(new)
            out[lack] = list(map(self.index.__getitem__, new))
        self.hits[out] += 1
        return out

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in a line, ids of each row); null is empty, no special tokens are added."""
        if not len(col):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        col = pc.fill_null(col, "")
        # a line break opens a segment of its own kind, and so does the text's beginning
        marked = pc.binary_join_element_wise(BREAK, col, "")
        for mark, to in CUTS:
            marked = pc.replace_substring(marked, mark, to)
        cut = pc.split_pattern(marked, " ")
        coded = cut.flatten().dictionary_encode()
        edge = np.asarray(cut.offsets)[:-1] - cut.offsets[0].as_py()
        of = self._numbers(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        begin, size = self.begin[of], self.size[of]
        wrong = self.odd[of]
        wrong[1:] |= (of[1:] < 2) & ~self.ends[of[:-1]]  # a mark behind another, or at a line's beginning
        odd = np.logical_or.reduceat(wrong, edge) | np.asarray(pc.match_substring_regex(col, "[\\x00-\\x02]"))
        alone = np.flatnonzero(odd & (np.diff(np.append(edge, len(of))) == 1))  # an empty text has the break alone
        odd[alone] &= np.asarray(pc.binary_length(col))[alone] > 0
        first = edge[size[edge] > 0]
        begin[first] += 1  # without the break put before the text
        size[first] -= 1
        ahead = np.cumsum(size, dtype=np.int64) - size
        counts = np.add.reduceat(size, edge).astype(np.int64)
        ids = self.store[np.repeat(begin - ahead, size) + np.arange(int(counts.sum()))]
        if not odd.any():
            return ids, counts
        upto = np.cumsum(counts)
        parts = [ids[j - n : j] for j, n in zip(upto.tolist(), counts.tolist(), strict=True)]
        at = np.flatnonzero(odd).tolist()
        for k, raw in zip(at, self._raw([col[k].as_py() for k in at]), strict=True):
            parts[k] = np.frombuffer(raw, "<u4")
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        edge = np.concatenate([[0], np.cumsum(counts)]).tolist()
        return [ids[i:j].astype("<u4").tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]


_LOADED: dict[str, Subwords] = kept()


def subwords(path: str) -> Subwords:
    """One for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Subwords(path)
    return _LOADED[path]
