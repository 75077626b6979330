"""N-gram Jaccard join by PartEnum signatures, and the classes its links make.

Sets of word shingles are banded by size. In a band, sets of similarity `num/den` or more differ in at most k elements. The domain is
partitioned at two levels: of n1 first-level parts one has at most k2 differences, so of its n2 second-level parts some n2 - k2 are
equal; a signature is the hash of a set restricted to such a subset of parts, for every first-level part and every subset. A set also
signs for the next band if it is large enough to have partners there. Two sets over the threshold share a signature, always.

Where a subset's parts hold no element, that hash would be one for a fixed share of all sets of a band, and their pairs would grow with the
square of the table. With k2 = 1 such a set signs by the part that is left: linked sets have the same elements there, or one has one more,
so it signs by the hash of that part and by those of the part less each of its elements, of which the two share one.

No group of a signature is turned into all its pairs. First every member is tested with the group's smallest member; classes so far
come from connected components. Then only members of different classes are compared, by parity sketches of the sets: the number of
bits in which two sketches differ never exceeds the number of elements in which the sets differ, so a pair above the limit is out for
certain. What is left is tested on the sets themselves. Identical sets are one node, found by the two 64-bit sums of their elements.

Where the sketches let through over half a pair a member of a large group, only a forest over its classes is tested at first, ROUNDS times while that finds
links, each after the classes met by the one before have become one; groups whose classes still differ then have all such pairs tested. So a group of near
copies costs as many tests as it has classes, and no link is lost.

At most two tiles of TILE members are held at once: members of a larger group are cut into tiles, and each pair of tiles is compared as a
group of its own, in whichever task. Its pairs are looked at in runs, and sketches of bounded size together, so that a task's memory grows neither
with the pairs of a group nor with what long sets' sketches take.

Defined cases: null text is empty; a document without words has no shingle and links with nothing; with fewer words than a shingle
takes, the whole sequence is the one shingle; rows with equal doc_id count as one document: their sets are nodes of their own and their
links are joined; a null doc_id takes part in no link and has a null component_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partflow.operators.components import connected_components

from .common import TEXTS, flat, forget, likely, mix, salted_lookup, ship, shuffle_partitions, slices, stored, table, words_of

_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
LINES = 8  #: longs in the smallest sketch
MOST_LINES = 1024
TILE = 8192
ROUNDS = 3
SKETCHES = 2000  #: rows with sketches that go to a Python worker at once


class Rule:
    """n words a shingle; links at num/den; second-level parts and the differences allowed among them."""

    def __init__(self, n: int = 3, num: int = 90, den: int = 100, n2: int = 3, k2: int = 1):
        self.n, self.num, self.den, self.n2, self.k2 = n, num, den, n2, k2
        self.edges = [1]  # a band spans three steps of the ratio, so that a third of the sets at most sign twice
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * (den / num) ** 3)))

    def apart(self, total) -> int:
        """Elements in which two linked sets of `total` elements together differ at most."""
        return (self.den - self.num) * total // (self.den + self.num)

    def bands(self, size: int) -> list[int]:
        b = int(np.searchsorted(self.edges, size, "right")) - 1
        return [b, b + 1] if size * self.den >= self.num * self.edges[b + 1] else [b]

    def parts(self, band: int) -> tuple[int, int, int]:
        """(n1, n2, k2) of a band."""
        top = self.edges[band + 1] - 1
        k = self.apart(2 * top)
        if k == 0:
            return 1, 1, 0
        if k <= self.k2:
            return 1, max(self.n2, k + 1), k
        return ceil((k + 1) / (self.k2 + 1)), self.n2, self.k2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """The sorted distinct 64-bit shingle hashes of each row."""
    hashes, _, _, first = words_of(data, offsets)
    whole = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        whole += mix(hashes[j : len(hashes) - n + 1 + j] + _STEP[j]) * (_STEP[j] | np.uint64(1))
    whole = mix(whole)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(whole[a : b - n + 1])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for j in range(b - a):
                short += mix(hashes[a + j : a + j + 1] + _STEP[j]) * (_STEP[j] | np.uint64(1))
            yield mix(short ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity bits of the set, a power of two of longs of them; folding halves by xor gives the smaller sketches."""
    lines = LINES
    while lines < MOST_LINES and lines * 64 < len(s):
        lines *= 2
    odd = np.bincount((mix(s ^ _STEP[3]) & np.uint64(lines * 64 - 1)).astype(np.int64), minlength=lines * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(s: np.ndarray, rule: Rule) -> np.ndarray:
    out = []
    h = mix(s)
    for band in rule.bands(len(s)):
        n1, n2, k2 = rule.parts(band)
        cell = (((h >> np.uint64(32)) * np.uint64(n1 * n2)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        element = mix(s[order] ^ _STEP[1])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(element, dtype=np.uint64)])
        edge = np.searchsorted(cell[order], np.arange(n1 * n2 + 1))
        name = np.arange(n1 * n2, dtype=np.uint64)
        whole = sums[edge[1:]] - sums[edge[:-1]]
        part, held = mix(whole + name).reshape(n1, n2), np.diff(edge).reshape(n1, n2)
        for k, subset in enumerate(combinations(range(n2), n2 - k2)):
            put = mix(np.full(n1, band * 64 + k, np.uint64) + _STEP[2])
            for c in subset:
                put = mix(put ^ part[:, c])
            put = mix(put + np.arange(n1, dtype=np.uint64))
            blank = held[:, list(subset)].sum(axis=1) == 0
            if k2 != 1 or not blank.any():
                out.append(put)
                continue
            first = np.flatnonzero(blank)
            rest = first * n2 + next(c for c in range(n2) if c not in subset)
            size = edge[rest + 1] - edge[rest]
            of = np.repeat(np.arange(len(first)), size)
            at = np.arange(len(of)) + np.repeat(edge[rest] - np.cumsum(size) + size, size)
            less = mix(whole[rest[of]] - element[at] + name[rest[of]])
            out += [put[~blank], mix(put[first] ^ part.ravel()[rest]), mix(put[first[of]] ^ less)]
    return np.concatenate(out)


def _nodes(rule: Rule):
    def run(batches):
        forget()
        for batch in batches:
            for b in slices(batch, 1, 1_000_000):
                size, one, two, lines = [], [], [], []
                for s in shingle_sets(*flat(b.column(1)), rule.n):
                    size.append(len(s))
                    one.append(int(np.sum(mix(s ^ _STEP[0]), dtype=np.uint64).view(np.int64)))
                    two.append(int(np.sum(mix(s ^ _STEP[4]), dtype=np.uint64).view(np.int64)))
                    lines.append(sketch(s))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(lines, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "one", "two", "sketch"])

    return run


def _named(rule: Rule):
    """Texts with what names their sets."""

    def run(batches):
        forget()
        for batch in batches:
            for b in slices(batch, 1, 1_000_000):
                sets = list(shingle_sets(*flat(b.column(1)), rule.n))
                sums = [pa.array([int(np.sum(mix(s ^ _STEP[k]), dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()) for k in (0, 4)]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array([len(s) for s in sets], pa.int64()), *sums], names=["doc_id", "text", "n_shingles", "one", "two"])

    return run


def _signed(rule: Rule):
    def run(batches):
        forget()
        seen: set = set()
        for batch in batches:
            for b in slices(batch, 1, 500_000):
                ids, sigs, counts = [], [], []
                for i, s in zip(b.column(0).to_pylist(), shingle_sets(*flat(b.column(1)), rule.n), strict=True):
                    key = (len(s), int(np.sum(mix(s ^ _STEP[0]), dtype=np.uint64)), i if not len(s) else 0)
                    if i is None or not len(s) or key in seen:  # an equal set has signed in this task
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                    x = signatures(s, rule)
                    ids.append(i)
                    sigs.append(x)
                    counts.append(len(x))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), counts))], names=["sig", "node"])

    return run


def _sets(rule: Rule):
    def run(batches):
        forget()
        for batch in batches:
            for b in slices(batch, 1, 1_000_000):
                sets = [s.view(np.int64) for s in shingle_sets(*flat(b.column(1)), rule.n)]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "s"])

    return run


def _matrix(col: pa.Array, rows: np.ndarray, lines: int) -> np.ndarray:
    """The sketches of some rows that have `lines` longs each."""
    at = np.asarray(col.offsets)[rows].astype(np.int64)
    return np.asarray(col.values)[at[:, None] + np.arange(lines)]


def _let_through(rule: Rule):
    """Pairs (u, v, nu, nv) whose sketches, the larger folded to the smaller one's length, differ in few enough bits."""

    def run(batches):
        for b in batches:
            nu, nv = np.asarray(b.column(2)), np.asarray(b.column(3))
            size = [np.diff(np.asarray(b.column(k).offsets)) for k in (4, 5)]
            stays = np.zeros(len(nu), bool)
            for lu, lv in np.unique(np.stack(size, 1), axis=0).tolist():
                rows = np.flatnonzero((size[0] == lu) & (size[1] == lv))
                lines = min(lu, lv)
                x, y = (np.bitwise_xor.reduce(_matrix(b.column(k), rows, n).reshape(len(rows), -1, lines), axis=1) for k, n in ((4, lu), (5, lv)))
                bits = np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1)
                stays[rows] = bits <= (rule.den - rule.num) * (nu[rows] + nv[rows]) // (rule.den + rule.num)
            yield b.select(["u", "v", "nu", "nv"]).filter(pa.array(stays))

    return run


def _fold(col: pa.Array, rows: np.ndarray, size: np.ndarray, lines: int) -> np.ndarray:
    """The sketches of some rows, `size` longs each, folded to `lines`."""
    out = np.zeros((len(rows), lines), np.int64)
    for n in np.unique(size[rows]).tolist():
        at = np.flatnonzero(size[rows] == n)
        out[at] = np.bitwise_xor.reduce(_matrix(col, rows[at], n).reshape(len(at), -1, lines), axis=1)
    return out


AT_ONCE = 500_000  #: pairs compared together
WIDE = 1 << 20  #: longs of sketches compared together
FEW = 48  #: members of a group that is compared together with others


def _forest(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places, taken in the given order, of edges (a, b) that join what earlier ones left apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    out = []
    for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            out.append(k)
    return np.array(out, np.int64)


def _compare(rule: Rule, forest: int | None = None):
    """Of the members of each group (sig, pair), by side: pairs of different classes that the sketches let through. Rows come sorted by
    group and size; a group has one tile (side 0, all its pairs) or two (side 0 against side 1). With the number of a round in `forest`, large groups
    give a forest over their classes, and their (sig, pair) if that isn't all."""

    def close(i, j, side, comp, size, two):
        """Pairs to look at, and the bits in which they may differ."""
        stays = (comp[i] != comp[j]) & ((side[i] != side[j]) | ~two)
        return stays, (rule.den - rule.num) * (size[i] + size[j]) // (rule.den + rule.num)

    def pairs(b: pa.RecordBatch, new: np.ndarray):
        """Arrays (i, j) of rows."""
        side, _, comp, size = (np.asarray(b.column(k)) for k in range(2, 6))
        lines = np.diff(np.asarray(b.column(6).offsets))
        begin = np.flatnonzero(new)
        members = np.diff(np.append(begin, len(size)))
        group = np.cumsum(new) - 1
        two = np.maximum.reduceat(side, begin) > 0
        rank = group * (1 << 40) + size
        row = np.arange(len(size))
        end = np.searchsorted(rank, group * (1 << 40) + size * rule.den // rule.num, "right")
        small = _fold(b.column(6), row, lines, LINES).view(np.uint64)

        def settled(i, j, most):
            """Those that larger sketches let through as well."""
            width, keep = np.minimum(lines[i], lines[j]), np.ones(len(i), bool)
            for w in np.unique(width[width > LINES]).tolist():
                wide, step = np.flatnonzero(width == w), max(1, WIDE // w)
                for at in (wide[k : k + step] for k in range(0, len(wide), step)):
                    bits = np.bitwise_count((_fold(b.column(6), i[at], lines, w) ^ _fold(b.column(6), j[at], lines, w)).view(np.uint64)).sum(axis=1)
                    keep[at] = bits <= most[at]
            return i[keep], j[keep]

        def large(g):
            """What the sketches let through of a large group, at most about AT_ONCE pairs looked at together."""
            ahead, at, n = [], [], 0
            for i in range(begin[g], begin[g] + members[g]):
                j = slice(i + 1, int(end[i]))
                stays, most = close(i, j, side, comp, size, two[g])
                hit = np.flatnonzero(stays & (np.bitwise_count(small[j] ^ small[i]).sum(axis=1) <= most))
                if len(hit):
                    ahead.append(np.full(len(hit), i))
                    at.append(hit + i + 1)
                    n += len(hit)
                if n and (n >= AT_ONCE or i == begin[g] + members[g] - 1):
                    x, y = np.concatenate(ahead), np.concatenate(at)
                    ahead, at, n = [], [], 0
                    yield settled(x, y, (rule.den - rule.num) * (size[x] + size[y]) // (rule.den + rule.num))

        few = np.flatnonzero((members <= FEW)[group])
        partners = end[few] - few - 1
        upto = np.concatenate([[0], np.cumsum(partners)])
        start = 0
        while start < len(few):
            stop = max(start + 1, int(np.searchsorted(upto, upto[start] + AT_ONCE, "right")) - 1)
            i = np.repeat(few[start:stop], partners[start:stop])
            j = i + 1 + np.arange(len(i)) - np.repeat(upto[start:stop] - upto[start], partners[start:stop])
            stays, most = close(i, j, side, comp, size, two[group[i]])
            i, j, most = i[stays], j[stays], most[stays]
            stays = np.bitwise_count(small[i] ^ small[j]).sum(axis=1) <= most
            yield *settled(i[stays], j[stays], most[stays]), False
            start = stop
        for g in np.flatnonzero(members > FEW).tolist():
            if forest is None:
                for i, j in large(g):
                    yield i, j, False
                continue
            i, j, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            for x, y in large(g):
                i, j, total = np.concatenate([i, x]), np.concatenate([j, y]), total + len(x)
                if 2 * total > members[g]:  # the forest of first edges of all pairs so far, whatever runs they came in
                    chance = mix(mix(i.astype(np.uint64) + np.uint64(forest)) ^ j.astype(np.uint64))
                    tree = _forest(comp[i], comp[j], np.argsort(chance))
                    i, j = i[tree], j[tree]
            yield i, j, len(i) < total

    def run(batches):
        found, n = [], 0
        for b in _groups(batches):
            node = np.asarray(b[0].column(3))
            for i, j, more in pairs(*b):
                if more:
                    yield _pair_batch(np.zeros((0, 2), np.int64), b[0].slice(int(i[0]), 1))
                found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1))
                n += len(i)
            if n > AT_ONCE:
                found = [np.unique(np.concatenate(found), axis=0)]
                if len(found[0]) > AT_ONCE:
                    yield _pair_batch(found.pop())
                n = sum(map(len, found))
        if n:
            yield _pair_batch(np.unique(np.concatenate(found), axis=0))

    return run


def _groups(batches):
    """(rows, where a group begins) of whole groups; a group that may go on in the next batch waits."""
    held = None
    for b in batches:
        b = b if held is None else pa.concat_batches([held, b])
        if not b.num_rows:
            continue
        sig, pair = np.asarray(b.column(0)), np.asarray(b.column(1))
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (pair[1:] != pair[:-1])
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield b.slice(0, last), new[:last]
        held = b.slice(last)
    if held is not None:
        yield held, np.arange(held.num_rows) == 0


PAIRS = "u bigint, v bigint, sig bigint, pair bigint"


def _pair_batch(at: np.ndarray, group: pa.RecordBatch | None = None) -> pa.RecordBatch:
    """Pairs, or the name of a group that has more of them."""
    if group is not None:
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), group.column(0), group.column(1)], names=["u", "v", "sig", "pair"])
    return pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64())], names=["u", "v", "sig", "pair"])


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Of candidate pairs (u < v) those that link: sketches first, then the sets."""
    light = nodes.select("doc_id", "n_shingles", "sketch")
    for side in ("u", "v"):
        pairs = pairs.join(light.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("sketch").alias(f"k{side}")), side)
    pairs = pairs.filter(F.least("nu", "nv") * rule.den >= F.greatest("nu", "nv") * rule.num).select("u", "v", "nu", "nv", "ku", "kv")
    pairs = stored(pairs.mapInArrow(_let_through(rule), "u bigint, v bigint, nu bigint, nv bigint"), "pairs", SKETCHES)
    wanted = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    wanted = stored(wanted, "wanted")
    # few documents are wanted: the others' texts stay where they are read
    sets = likely(docs, wanted, "doc_id").mapInArrow(_sets(rule), "doc_id bigint, s array<bigint>").filter("size(s) > 0")
    sets = stored(sets.hint("merge").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "sets", TEXTS)
    # a node with many partners is dealt over copies of its set
    hub = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("copies"))
    hubs = hub.join(sets.select(F.col("doc_id").alias("u"), F.col("s").alias("su")), "u").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    dealt = pairs.join(hub, "u").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("copies")).cast("int")).drop("copies")
    dealt = dealt.join(sets.select(F.col("doc_id").alias("v"), F.col("s").alias("sv")), "v").join(hubs.drop("copies"), ["u", "salt"])
    common = F.size(F.array_intersect("su", "sv"))
    return dealt.withColumn("common", common).filter(F.col("common") * rule.den >= rule.num * (F.col("nu") + F.col("nv") - F.col("common"))).select("u", "v")


def _several(docs: DataFrame, live: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame] | None:
    """For doc_ids that stand for several sets: (doc_id, one, two, n_shingles, node) of their sets, and docs with a node in place of every
    doc_id. None if no doc_id does. Nodes of such sets are numbers above all doc_ids."""
    edges = [f(c).alias(f"{n}_{c}") for c in ("n_shingles", "one", "two") for n, f in (("low", F.min), ("high", F.max))]
    differ = " or ".join(f"low_{c} <> high_{c}" for c in ("n_shingles", "one", "two"))
    shared = stored(live.groupBy("doc_id").agg(*edges).filter(differ).select("doc_id"), "shared")
    if shared.isEmpty():
        return None
    kinds = stored(live.join(shared, "doc_id", "left_semi").select("doc_id", "n_shingles", "one", "two").distinct(), "kinds")
    most = live.agg(F.max("doc_id")).first()[0]
    kinds = kinds.withColumn("_i", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_i", 33))
    kinds = stored(kinds.withColumn("_i", F.col("_i").bitwiseAND((1 << 33) - 1)), "numbered")
    tasks, last = kinds.agg(F.max("_p"), F.max("_i")).first()
    if most + 1 + (tasks + 1) * (last + 1) >= 1 << 63:
        raise ValueError("repeated doc_ids that stand for several texts need numbers above the largest doc_id")
    kinds = kinds.select("doc_id", "n_shingles", "one", "two", (F.lit(most + 1) + F.col("_i") * (tasks + 1) + F.col("_p")).alias("node"))
    own = docs.join(shared, "doc_id", "left_semi")
    own = own.mapInArrow(_named(rule), "doc_id bigint, text string, n_shingles bigint, one bigint, two bigint").join(kinds, ["doc_id", "n_shingles", "one", "two"])
    own = stored(own.select(F.col("node").alias("doc_id"), "text"), "own", TEXTS)
    return kinds, docs.join(shared, "doc_id", "left_anti").unionByName(own)


def _open_groups(met: DataFrame, comp: DataFrame, nodes: DataFrame, only: DataFrame | None) -> DataFrame:
    """The members of signatures whose classes differ, dealt by tiles and sorted for `_compare`; only: (sig, pair) of those to take."""
    group = Window.partitionBy("sig")
    if only is not None:
        met = met.join(only.select("sig").distinct(), "sig", "left_semi")
    seen = met.select("sig", "node").distinct().join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = seen.withColumn("a", F.min("component").over(group)).withColumn("b", F.max("component").over(group)).withColumn("m", F.count(F.lit(1)).over(group))
    open_ = open_.withColumn("r", F.row_number().over(group.orderBy("node"))).filter("a <> b and m > 2")
    tile, last = F.floor((F.col("r") - 1) / TILE).cast("long"), F.floor((F.col("m") - 1) / TILE).cast("long")
    open_ = open_.select("sig", "node", "component", tile.alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("o"))
    pair = F.least("t", "o") * (1 << 31) + F.greatest("t", "o")
    open_ = open_.select("sig", pair.alias("pair"), (F.col("t") > F.col("o")).cast("int").alias("side"), "node", "component")
    if only is not None:
        open_ = open_.join(only, ["sig", "pair"], "left_semi")
    tiled = open_.join(nodes.select(F.col("doc_id").alias("node"), "n_shingles", "sketch"), "node")
    tiled = tiled.select("sig", "pair", "side", "node", "component", "n_shingles", "sketch")
    return tiled.repartition(shuffle_partitions(met.sparkSession), "sig", "pair").sortWithinPartitions("sig", "pair", "n_shingles")


def jaccard_classes(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row."""
    rule = rule or Rule()
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = stored(docs.mapInArrow(_nodes(rule), "doc_id bigint, n_shingles bigint, one bigint, two bigint, sketch array<bigint>"), "nodes", TEXTS)
    live = known.filter("doc_id is not null and n_shingles > 0")
    several = _several(docs, live, rule)
    joined = None
    if several:
        kinds, docs = several
        joined = kinds.select(F.col("doc_id").alias("u"), F.col("node").alias("v"))  # the sets of one doc_id are linked through it
        left = live.join(kinds.select("doc_id").distinct(), "doc_id", "left_anti")
        again = live.join(kinds, ["doc_id", "n_shingles", "one", "two"]).drop("doc_id").withColumnRenamed("node", "doc_id")
        live = stored(left.unionByName(again), "live")
    nodes = live.dropDuplicates(["doc_id"])  # rows that are left with one doc_id have one set
    # identical sets: each to the smallest id of its class
    classes = live.groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n"))
    dups = classes.filter("_n > 1").drop("_n")
    equal = salted_lookup(live.select("doc_id", "n_shingles", "one", "two"), dups, ["n_shingles", "one", "two"], "doc_id", grows=True).filter("rep is not null").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    signed = docs.mapInArrow(_signed(rule), "sig bigint, node bigint")
    group = Window.partitionBy("sig")
    met = signed.withColumn("least", F.min("node").over(group)).withColumn("most", F.max("node").over(group)).filter("least <> most").select("sig", "node", "least")
    met = stored(met, "met", TEXTS)
    stars = met.filter("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct()
    same = equal.filter("u <> v")
    links = stored((same.unionByName(joined) if joined is not None else same).unionByName(_verified(stars, docs, nodes, rule)), "links")
    comp = stored(connected_components(links), "classes")
    groups, tested, k = None, stars, 0
    while groups is None or not groups.isEmpty():
        tiled = _open_groups(met, comp, nodes, groups)
        pairs = stored(tiled.mapInArrow(_compare(rule, k), PAIRS), "compared", SKETCHES)
        more = pairs.filter("u is not null").select("u", "v").distinct().join(tested, ["u", "v"], "left_anti")
        late = stored(_verified(more, docs, nodes, rule), "late")
        met_more = not late.isEmpty()
        if met_more:
            links = links.unionByName(late)
            comp = stored(connected_components(links), "classes")
        groups, tested = pairs.filter("sig is not null").select("sig", "pair"), tested.unionByName(more)
        k = k + 1 if met_more and k + 1 < ROUNDS else None  # None: all pairs, and no group is left after it
    out = known.select("doc_id", "n_shingles").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
