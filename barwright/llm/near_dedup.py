"""Near duplicates by an LSH forest: sorted signature orders, longest-common-prefix neighbours, and exact confirmation.

Documents with equal shingle sets are one node. Each node's MinHash signature is laid out in several rotated orders; each order
is sorted by range, so that nodes with a long common prefix are neighbours. A region is a run of nodes that agree on the first
values of an order; how many orders and values, follows from the similarity (plan()). In it a node meets its neighbour, with which it shares the longest prefix, and the region's first node.
Pairs whose signatures are far apart are passed over; the others are confirmed on the full sets, and give components.

Regions that still hold several components go deeper: their nodes get longer signatures, and more orders of them, and meet the
NEAREST nodes of other components on both sides in each order. The prefix shared with the last of them is the depth that the
node has reached there: whatever shares more was met. Shingles that no other component holds are
left out beforehand, so that nodes of mostly their own text take no part, and met pairs are passed over where the rest of their
sets, bucket by bucket, cannot have enough in common; no link is lost by either. A region of few nodes is met whole; the more nodes a region holds, the
deeper it goes. A node is settled once its depths bound the chance of a missed partner by NO_REGION. Regions where unsettled
nodes of several components are left take another turn with new hash functions. After TURNS of them what is unsettled is
joined exactly, on the rarest shingles of each set, if that join lists no more pairs than a turn would; if their rarest shingles
are common ones (pages of one template), turns go on. No group's pairs are ever listed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import count
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import slices, small_join, stored, tidy, utf8

#: Values in a signature; the most values that two nodes must share at the head of an order.
VALUES, DEPTH = 64, 3
#: Bounds of the probability that a pair at the least similarity shares no region, and that its signatures agree too little.
NO_REGION, TOO_FAR = 1.1e-5, 5e-6
#: Where regions are mixed: values of a longer signature (one byte each), its orders, how many nodes a node meets on each side,
#: turns before the exact join, and the pairs for each node that it may list.
WIDE, ORDERS, NEAREST, TURNS, LISTED = 256, 32, 16, 3, 512
#: Values of a longer signature by which nodes are sorted. Sorting by ranges brings a sample of the keys to the driver, 300 a
#: partition, so keys are short. Depths beyond add nothing to the certainty: 0.85 ** 64 is 3e-5.
SORTED = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """Sorted orders; values at the head of an order that make a region; values that agree before a pair is confirmed."""

    trees: int
    depth: int
    agree: int

    @property
    def head(self) -> int:
        """Bytes of a label's head: the order's number and two bytes of each value."""
        return 1 + 2 * self.depth

    @property
    def label(self) -> int:
        """Bytes of a label: its head, and one byte of each other value."""
        return self.head + VALUES - self.depth


def least_agreement(like: float, values: int) -> int:
    """The most values that two signatures may be asked to share, so that a pair at this similarity fails with TOO_FAR at most."""
    agree, lost = 0, 0.0
    while agree < values and (lost := lost + comb(values, agree) * like**agree * (1 - like) ** (values - agree)) <= TOO_FAR:
        agree += 1
    return agree


def plan(percent: int) -> Plan:
    """The fewest orders that keep to NO_REGION, and the most values in agreement that keep to TOO_FAR, at this similarity.

    The heads of the orders share no values, so regions are missed independently; where there are too few values for that, heads
    are shorter. Below 17 percent no plan keeps to the bounds, which is an error.
    """
    like = percent / 100
    agree = least_agreement(like, VALUES)
    for depth in range(DEPTH, 0, -1):
        for trees in range(1, VALUES // depth + 1):
            if (1 - like**depth) ** trees <= NO_REGION:
                return Plan(trees, depth, agree)
    raise ValueError(f"no {VALUES} values find pairs of a similarity of {percent} percent with certainty enough")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 400_000:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def shingles(text: bytes, hashes: dict, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `size` words; fewer words are one run, none give nothing."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(ids))
    runs = np.full(len(ids) - size + 1, size, np.uint64)
    for i in range(size):
        runs = runs * _STEP + ids[i : i + len(runs)]
    runs ^= runs >> np.uint64(29)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(runs ^ (runs >> np.uint64(32)))


@cache
def _functions(turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of a turn's hash functions."""
    random = np.random.default_rng(20240229 + turn)
    factors = random.integers(1, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, random.integers(0, 1 << 63, WIDE, dtype=np.uint64)


def signature(shingle_set: np.ndarray, values: int = VALUES, turn: int = 0) -> np.ndarray:
    """`values` minima under different hash functions, two bytes of each; a longer signature begins with the shorter one."""
    factors, shifts = _functions(turn)
    least = np.full(values, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingle_set), 1 << 12):
        mixed = np.multiply.outer(factors[:values], shingle_set[start : start + (1 << 12)]) + shifts[:values, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    return ((least * _STEP) >> np.uint64(48)).astype(np.uint16)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets; empty sets are never linked."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _print(found: np.ndarray) -> bytes:
    """128-bit fingerprint of a shingle set."""
    return xxhash.xxh3_128_digest(found.tobytes())


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, f1, f2 (128-bit fingerprint of the set), sig; stored."""

    def sketch(batches):
        hashes = _WordHashes()
        for batch in slices(batches, 512):
            counts, prints, signatures = [], [], []
            for text in utf8(batch.column("text")):
                found = shingles(text, hashes, size)
                counts.append(len(found))
                prints.append(_print(found))
                signatures.append(signature(found).tobytes() if len(found) else None)
            both = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(signatures, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "f1", "f2", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return stored(rows.mapInArrow(sketch, "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, sig binary"), "sketches")


def _labels(batches, by: Plan):
    spread = VALUES // by.trees
    for batch in slices(batches, 2048):
        values = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
        n = len(values)
        out = np.empty((by.trees, n, by.label), np.uint8)
        for tree in range(by.trees):
            turned = np.roll(values, -tree * spread, axis=1)
            out[tree, :, 0] = tree
            out[tree, :, 1 : by.head] = turned[:, :by.depth].astype(">u2").view(np.uint8).reshape(n, 2 * by.depth)
            out[tree, :, by.head :] = turned[:, by.depth:].astype(np.uint8)
        flat = pa.Array.from_buffers(pa.binary(by.label), n * by.trees, [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
        yield pa.record_batch([flat, pa.array(np.tile(batch.column("rep").to_numpy(), by.trees))], names=["label", "rep"])


def _walk(batches, by: Plan):
    """Along one sorted stretch: candidate pairs (kind 0), the nodes of regions (kind 1), and the stretch's ends (kind 2)."""
    from pyspark import TaskContext

    part, lead, prior, opening = TaskContext.get().partitionId(), None, None, None

    def rows(kind, region, a, b, label=None):
        n = len(a)
        return pa.record_batch([pa.array(np.full(n, kind, np.int32)), pa.array(region, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(label or [None] * n, pa.binary())], names=["kind", "region", "a", "b", "label"])

    def region_of(labels):
        head = np.zeros((len(labels), 8), np.uint8)
        head[:, 8 - by.head :] = labels[:, : by.head]
        return head.view(">i8").ravel().astype(np.int64)

    def met(labels, reps, i, j):
        close = ((labels[i, by.head :] == labels[j, by.head :]).sum(axis=1) + by.depth >= by.agree) & (reps[i] != reps[j])
        i, j = i[close], j[close]
        return np.minimum(reps[i], reps[j]), np.maximum(reps[i], reps[j])

    for batch in batches:
        if not batch.num_rows:
            continue
        labels = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(-1, by.label)
        reps = batch.column("rep").to_numpy()
        opens = opening is None
        if opens:
            opening = (labels[0].tobytes(), int(reps[0]))
            held = 0
        else:
            labels = np.concatenate((np.stack((lead[0], prior[0])), labels))
            reps = np.concatenate(([lead[1], prior[1]], reps))
            held = 2
        region = region_of(labels)
        new = np.concatenate(([True], region[1:] != region[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        inside = np.flatnonzero(~new)
        inside = inside[inside >= held]
        pairs = [met(labels, reps, inside - 1, inside)]
        far = inside[first[inside] != inside - 1]
        pairs.append(met(labels, reps, first[far], far))
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        if len(a):
            yield rows(0, [None] * len(a), a, b)
        # Nodes of regions with company, here or perhaps beyond the batch or the stretch.
        last = np.concatenate((new[1:], [True]))
        alone = new & last
        alone[-1] = False
        alone[0] &= not opens
        own = np.flatnonzero(~alone)
        own = own[own >= held]
        if len(own):
            yield rows(1, region[own], reps[own], [None] * len(own))
        lead, prior = (labels[first[-1]], int(reps[first[-1]])), (labels[-1], int(reps[-1]))
    if opening is not None:
        ends = [opening, (prior[0].tobytes(), prior[1])]
        yield rows(2, [part, part], [e[1] for e in ends], [0, 1], [e[0] for e in ends])


def _seams(found: DataFrame, by: Plan) -> list[tuple[int, int]]:
    """Candidate pairs across neighbouring stretches; two rows a stretch are all that the driver sees."""
    ends: dict[int, dict[int, tuple[bytes, int]]] = {}
    for row in found.where("kind = 2").select("region", "a", "b", "label").collect():
        ends.setdefault(row.region, {})[row.b] = (bytes(row.label), row.a)
    pairs, order = [], sorted(ends)
    for left, right in zip(order, order[1:], strict=False):
        (x, a), (y, b) = ends[left][1], ends[right][0]
        if x[: by.head] == y[: by.head] and a != b and by.depth + sum(p == q for p, q in zip(x[by.head :], y[by.head :], strict=True)) >= by.agree:
            pairs.append((min(a, b), max(a, b)))
    return pairs


def _texts(docs: DataFrame, nodes: DataFrame, shared: DataFrame | None, size: int) -> DataFrame:
    """node, text of the given nodes; stored. A node is its smallest doc_id; ids with several texts are told apart by fingerprint."""
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    found = small_join(rows, nodes, ["node"], "left_semi").dropDuplicates(["node"])
    if shared is not None:

        def identify(batches):
            hashes = _WordHashes()
            for batch in slices(batches, 512):
                both = np.frombuffer(b"".join(_print(shingles(t, hashes, size)) for t in utf8(batch.column("text"))), "<i8").reshape(-1, 2)
                yield pa.record_batch([batch.column("node"), batch.column("text"), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["rep", "text", "f1", "f2"])

        doubtful = small_join(rows, shared.select(F.col("rep").alias("node")).distinct(), ["node"], "left_semi")
        told = doubtful.mapInArrow(identify, "rep long, text string, f1 long, f2 long").join(shared, ["rep", "f1", "f2"]).select("node", "text")
        found = found.unionByName(small_join(told, nodes, ["node"], "left_semi").dropDuplicates(["node"]))
    return stored(found, "texts")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs a, b that are linked on their full sets."""

    def confirm(batches):
        hashes = _WordHashes()
        for batch in slices(batches, 256):
            keep, last = [], (None, None)
            for row, (x, y) in enumerate(zip(utf8(batch.column("ta")), utf8(batch.column("tb")), strict=True)):
                if last[0] != y:
                    last = (y, shingles(y, hashes, size))
                if linked(shingles(x, hashes, size), last[1], percent):
                    keep.append(row)
            keep = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for links a, b: alternating large-star and small-star steps, each stored.

    Stars are joined by key, so a node with very many links is split by AQE; the number of rounds grows with the logarithm of
    the longest path. Repeated and reversed links and self-links change nothing; no links give no rows.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    state = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state or not found[0]:
            break
        state = tuple(found)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


#: What a node's labels carry along; buckets of shingles, by their first byte, whose sizes follow the signature.
_CARRIED, BUCKETS = ("node", "component", "n", "beyond"), 256
#: Bytes of the head of a longer label, and of the part that is sorted.
_HEAD, _KEY = 1 + 2 * DEPTH, 1 + 2 * DEPTH + SORTED


def _wide_labels(batches, by: Plan, size: int, turn: int):
    """label, rest, node, component, n, beyond: each node's longer signature in every order, behind a head of the region's bytes; its
    first SORTED values are the label's, others are in rest.

    In the first turn the first orders' heads are the forest's own, so whoever shared a region there does so here. The sizes of
    the node's buckets follow, each up to 255; beyond is the sum of what is above that.
    """
    hashes, spread = _WordHashes(), VALUES // by.trees
    for batch in slices(batches, 512):
        values = np.array([signature(shingles(text, hashes, size), WIDE, turn) for text in utf8(batch.column("text"))], np.uint16).reshape(-1, WIDE)
        n, low = len(values), values.astype(np.uint8)
        sizes = _bucket_sizes(batch.column("buckets"))
        beyond = pa.array(np.maximum(sizes - 255, 0).sum(axis=1), pa.int64())
        out = np.zeros((ORDERS, n, 1 + 2 * DEPTH + WIDE + BUCKETS), np.uint8)
        out[:, :, 1 + 2 * DEPTH + WIDE :] = np.minimum(sizes, 255)
        for order in range(ORDERS):
            turned = np.roll(low, -order * (WIDE // ORDERS), axis=1)
            out[order, :, 0] = order
            if turn == 0 and order < by.trees:
                out[order, :, 1 : by.head] = np.roll(values[:, :VALUES], -order * spread, axis=1)[:, : by.depth].astype(">u2").view(np.uint8).reshape(n, 2 * by.depth)
            else:
                out[order, :, 1 : 1 + by.depth] = turned[:, : by.depth]
            out[order, :, 1 + 2 * DEPTH : 1 + 2 * DEPTH + WIDE] = turned
        batch = batch.append_column("beyond", beyond)
        parts = [pa.Array.from_buffers(pa.binary(part.shape[2]), n * ORDERS, [None, pa.py_buffer(part.tobytes())]).cast(pa.binary()) for part in (out[:, :, :_KEY], out[:, :, _KEY:])]
        yield pa.record_batch([*parts, *(pa.array(np.tile(batch.column(c).to_numpy(), ORDERS)) for c in _CARRIED)], names=["label", "rest", *_CARRIED])


def _met_before(values: np.ndarray, region: np.ndarray, component: np.ndarray, agree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Along sorted rows, each row's NEAREST rows before it of its region and other components: those that agree, as pairs of row
    numbers; and for every row how many values in common make sure that another row is among them.

    That is 0 where the region's beginning was reached, and -1, for unknown, where it lies before the first row. Rows that share
    all SORTED values are in no order of the others, so no number of values makes sure there.
    """
    starts = np.concatenate(([False], component[1:] != component[:-1]))
    # The last row before the run of one component that a row lies in.
    before = np.maximum.accumulate(np.where(starts, np.arange(len(component)) - 1, -1))
    depth = np.where(region > 0, 0, -1)
    row = np.arange(len(component))
    at, pairs = row, []
    for _ in range(NEAREST):
        at = at - 1
        at = np.where((at >= 0) & (component[at] == component[row]), before[at], at)
        inside = (at >= 0) & (region[at] == region[row])
        row, at = row[inside], at[inside]
        same = values[row] == values[at]
        close = same.sum(axis=1) >= agree
        pairs.append((row[close], at[close]))
    if len(row):
        same = same[:, :SORTED]
        depth[row] = 1 + np.where(same.all(axis=1), values.shape[1], same.argmin(axis=1))
    return *(np.concatenate([p[k] for p in pairs]) for k in (0, 1)), depth


def _still_near(component: np.ndarray) -> np.ndarray:
    """The rows that may be among the NEAREST of other components before any later row: each component's last ones."""
    order = np.argsort(component, kind="stable")
    ordered = component[order]
    ends = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]), len(ordered) - 1)
    to_end = ends[np.searchsorted(ends, np.arange(len(ordered)))] - np.arange(len(ordered))
    return np.sort(order[to_end < NEAREST])[-2 * NEAREST :]


def _credit(depth: np.ndarray, order: np.ndarray, like: float, by: Plan, turn: int) -> np.ndarray:
    """Logarithm of the chance that this order misses a partner at the least similarity; 0 where the depth is unknown.

    Orders lie WIDE / ORDERS values apart: of deeper ones, which share values, only every second, third, ... one counts.
    """
    own_head = (order < by.trees) & (turn == 0)
    used = np.where(own_head, depth + by.depth, np.maximum(depth, by.depth))
    return np.where(depth < 0, 0.0, np.log1p(-(like**used)) / np.ceil(used / (WIDE // ORDERS)))


def _most_in_common(sizes: np.ndarray, beyond: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The most shingles that rows i and j can share, bucket by bucket."""
    parts = [np.minimum(sizes[i[at : at + 8192]], sizes[j[at : at + 8192]]).sum(axis=1, dtype=np.int64) for at in range(0, len(i), 8192)]
    return np.concatenate([np.zeros(0, np.int64), *parts]) + np.minimum(beyond[i], beyond[j])


def _wide_walk(batches, agree: int, percent: int, by: Plan, turn: int):
    """Along one sorted stretch: candidate pairs a, b, and what each order adds to the certainty about a node (a, credit).

    Pairs whose sets cannot have enough in common, by the sizes of their buckets, are passed over.
    """
    held, head = None, _HEAD
    kinds = [pa.int64(), pa.int64(), pa.float64()]
    for batch in slices(batches, 16384):
        if not batch.num_rows:
            continue
        labels = np.concatenate([np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("label", "rest")], axis=1)
        rows, first = (labels, *(batch.column(c).to_numpy() for c in _CARRIED)), 0
        if held is not None:
            first = len(held[1])
            rows = tuple(np.concatenate(pair) for pair in zip(held, rows, strict=True))
        labels, node, component, n, beyond = rows
        values, sizes = labels[:, head : head + WIDE], labels[:, head + WIDE :]
        region = np.concatenate(([0], np.cumsum((labels[1:, :head] != labels[:-1, :head]).any(axis=1))))
        i, j, back = _met_before(values, region, component, agree)
        x, y, ahead = _met_before(values[::-1], region[-1] - region[::-1], component[::-1], agree)
        last = len(node) - 1
        i, j = np.unique(np.stack((np.concatenate((i, last - y)), np.concatenate((j, last - x))), axis=1), axis=0).T
        ahead, most = ahead[::-1], _most_in_common(sizes, beyond, i, j)
        able = 100 * most >= percent * (n[i] + n[j] - most)
        i, j = i[able], j[able]
        a, b = np.unique(np.stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])), axis=1), axis=0).T
        depth = np.where((back < 0) | (ahead < 0), -1, np.maximum(back, ahead))[first:]
        credit = _credit(depth, labels[first:, 0], percent / 100, by, turn)
        yield pa.record_batch([pa.array(a.copy(), kinds[0]), pa.array(b.copy(), kinds[1]), pa.nulls(len(a), kinds[2])], names=["a", "b", "credit"])
        yield pa.record_batch([pa.array(node[first:], kinds[0]), pa.nulls(len(credit), kinds[1]), pa.array(credit, kinds[2])], names=["a", "b", "credit"])
        near = _still_near(component)
        held = tuple(part[near] for part in rows)


def _spelled(texts: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, component, n, shingle: a row for each shingle of the nodes' sets of n shingles; stored."""

    def spell(batches):
        hashes = _WordHashes()
        for batch in slices(batches, 64):
            found = [shingles(text, hashes, size).view(np.int64) for text in utf8(batch.column("text"))]
            yield pa.record_batch([batch.column("node"), batch.column("component"), pa.array(found, pa.list_(pa.int64()))], names=["node", "component", "shingles"])

    sets = texts.join(nodes, "node").select("node", "component", "text").mapInArrow(spell, "node long, component long, shingles array<long>")
    return stored(sets.select("node", "component", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle")), "shingles")


def _common(rows: DataFrame) -> DataFrame:
    """The rows (component, shingle, ...) whose shingle is held in several components."""
    across = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    return rows.join(across, "shingle", "left_semi")


def _open_nodes(spelled: DataFrame, percent: int) -> DataFrame:
    """node, n, buckets: of the nodes that could be linked with another component, the set's size, and the first byte of each shingle
    that other components hold too; stored.

    Two nodes of different components have no more in common than the lesser number of such shingles, in each bucket of a first
    byte. Components only grow, so this holds in later turns as well.
    """
    found = _common(spelled).groupBy("node").agg(F.first("n").alias("n"), F.collect_list(F.shiftright("shingle", 56).cast("byte")).alias("buckets"))
    return stored(found.where(f"100L * size(buckets) >= {percent}L * n"), "open")


def _heads(spelled: DataFrame, nodes: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """node, component, n, shingle: the rarest shingles of each open node's set, one of which it shares with whoever it may be linked
    with; stored.

    Sets that have `percent` of either in common share a shingle among the first n * (100 - percent) / 100 + 1 of each, in one
    order of all shingles: rare ones first, so that what many nodes hold is seldom joined. Shingles of one component are left out.
    """
    rows = spelled.drop("component").join(nodes.join(able.select("node"), "node").select("node", "component"), "node")
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    ranked = rows.join(often, "shingle").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle")))
    heads = stored(ranked.where(F.col("place") <= F.expr(f"n * {100 - percent}L div 100 + 1")).select("node", "component", "n", "shingle"), "heads")
    return stored(_common(heads), "heads")


def _few_pairs(heads: DataFrame, listed: int) -> bool:
    """Whether the join of heads by shingle lists at most `listed` pairs for each node."""
    shared = heads.groupBy("shingle").agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs")).agg(F.sum("pairs")).first()[0]
    return (shared or 0) <= listed * heads.select("node").distinct().count()


def _rarest_in_common(heads: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of nodes of different components that share a head and, bucket by bucket, may have enough in common."""
    other = heads.select("shingle", F.col("node").alias("b"), F.col("component").alias("other"), F.col("n").alias("m"))
    pairs = heads.withColumnRenamed("node", "a").join(other, "shingle").where(f"a < b and component <> other and 100L * least(n, m) >= {percent}L * greatest(n, m)")
    sizes = lambda side, name: able.select(F.col("node").alias(side), F.col("buckets").alias(name))
    both = pairs.select("a", "b", "n", "m").distinct().join(sizes("a", "x"), "a").join(sizes("b", "y"), "b")

    def bounded(batches):
        for batch in slices(batches, 4096):
            x, y = (_bucket_sizes(batch.column(c)) for c in ("x", "y"))
            most = np.minimum(x, y).sum(axis=1)
            keep = 100 * most >= percent * (batch.column("n").to_numpy() + batch.column("m").to_numpy() - most)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(bounded, "a long, b long")


def _bucket_sizes(buckets: pa.Array) -> np.ndarray:
    """How many shingles each row has in each bucket, from lists of their buckets."""
    owner = np.repeat(np.arange(len(buckets)), buckets.value_lengths().to_numpy(zero_copy_only=False))
    number = buckets.flatten().to_numpy(zero_copy_only=False).view(np.uint8)
    return np.bincount(owner * BUCKETS + number, minlength=len(buckets) * BUCKETS).reshape(-1, BUCKETS)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) with more links a, b: only the components that these join run through the steps again."""
    raised = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    merged = stored(components(raised.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "merged")
    first = labels.select("node", F.col("component").alias("c1")).unionByName(merged.select(F.col("node"), F.col("node").alias("c1"))).groupBy("node").agg(F.min("c1").alias("c1"))
    final = first.join(merged.select(F.col("node").alias("c1"), F.col("component").alias("c2")), "c1", "left")
    return stored(final.select("node", F.coalesce("c2", "c1").alias("component")), "components")


def _deeper(members: DataFrame, labels: DataFrame, docs: DataFrame, shared: DataFrame | None, size: int, percent: int, by: Plan) -> DataFrame:
    """labels (node, component) joined by the links between components that share a region. members: region, node."""
    like = percent / 100
    agree = least_agreement(like + (1 - like) / 256, WIDE)
    texts = credits = spelled = able = None
    for turn in count():
        tidy(docs.sparkSession)
        known = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = known.groupBy("region").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        # Two nodes alone in their region have met.
        mixed = stored(mixed.where("n > 2 and low < high" if turn == 0 else "low < high").select("region"), "regions")
        if not mixed.limit(1).count():
            return labels
        members = stored(small_join(members, mixed, ["region"], "left_semi"), "members")
        nodes = stored(small_join(known, mixed, ["region"], "left_semi").select("node", "component").distinct(), "nodes")
        if texts is None:
            texts = _texts(docs, nodes.select("node"), shared, size)
            spelled = _spelled(texts, nodes, size)
            able = _open_nodes(spelled, percent)
        if turn >= TURNS and _few_pairs(heads := _heads(spelled, nodes, able, percent), LISTED):
            pairs = _rarest_in_common(heads, able, percent)
            return _joined(labels, stored(_confirmed(stored(pairs, "pairs"), texts, size, percent), "links"))
        spread = texts.join(able, "node").join(nodes, "node").mapInArrow(lambda batches, turn=turn: _wide_labels(batches, by, size, turn), "label binary, rest binary, node long, component long, n long, beyond long")
        walked = spread.repartitionByRange("label", "node").sortWithinPartitions("label", "node")
        found = stored(walked.mapInArrow(lambda batches, turn=turn: _wide_walk(batches, agree, percent, by, turn), "a long, b long, credit double"), "forest")
        pairs = found.where("b is not null").select("a", "b").distinct()
        labels = _joined(labels, stored(_confirmed(stored(pairs, "pairs"), texts, size, percent), "links"))
        more = found.where("b is null").select(F.col("a").alias("node"), "credit")
        credits = stored((more if credits is None else more.unionByName(credits)).groupBy("node").agg(F.sum("credit").alias("credit")), "credits")
        unsettled = stored(credits.where(F.col("credit") > log(NO_REGION)).select("node"), "unsettled")
        members = stored(small_join(members, unsettled, ["node"], "left_semi"), "members")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, root: one row for each row of docs (doc_id, text).

    Words are runs of other bytes than ASCII white space, A-Z in lower case; a document's set holds its distinct runs of `size`
    words, or its whole sequence if shorter. Documents with 100 * intersection >= `percent` * union are linked; component_id
    is the smallest doc_id reachable, and kept marks that document. Null, empty and blank texts have no set and are their own
    component. Rows that repeat a doc_id with an equal set are one document; rows of one doc_id with different texts are
    documents of their own. root tells components apart where such ids give two the same component_id, and is null where
    there is no set; text_hash is the text's 64-bit hash. A null doc_id is linked with nothing: its component_id is null and
    kept true. An empty table gives no rows; other columns of docs are not read.
    """
    by = plan(percent)
    tidy(docs.sparkSession)
    sketch = sketches(docs, size)
    whole = sketch.where("n_shingles > 0 and doc_id is not null")
    # Stored, so that the join below is one of two plain shuffles, which AQE can split where copies are very many.
    classes = stored(whole.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig")), "classes")
    doubtful = stored(classes.groupBy("rep").count().where("count > 1").select("rep"), "doubtful")
    shared = None
    if doubtful.limit(1).count():
        shared = stored(small_join(classes.select("rep", "f1", "f2"), doubtful, ["rep"], "left_semi").withColumn("node", F.xxhash64("f1", "f2", "rep")), "shared")
        classes = stored(classes.join(shared.select("f1", "f2", "node"), ["f1", "f2"], "left").withColumn("node", F.coalesce("node", "rep")), "classes")
    else:
        classes = classes.withColumn("node", F.col("rep"))
    members = stored(whole.select("doc_id", "text_hash", "n_shingles", "f1", "f2").join(classes.select("f1", "f2", "node"), ["f1", "f2"]).drop("f1", "f2"), "members")
    forest = classes.select(F.col("node").alias("rep"), "sig").mapInArrow(lambda batches: _labels(batches, by), "label binary, rep long")
    walked = forest.repartitionByRange("label", "rep").sortWithinPartitions("label", "rep")
    found = stored(walked.mapInArrow(lambda batches: _walk(batches, by), "kind int, region long, a long, b long, label binary"), "forest")
    seams = docs.sparkSession.createDataFrame(_seams(found, by), "a long, b long")
    pairs = stored(found.where("kind = 0").select("a", "b").unionByName(seams).distinct(), "pairs")
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shared, size)
    links = stored(_confirmed(pairs, texts, size, percent), "links")
    labels = stored(components(links), "components")
    labels = _deeper(found.where("kind = 1").select("region", F.col("a").alias("node")).distinct(), labels, docs, shared, size, percent, by)
    final = labels.select("node", F.col("component").alias("root"))
    placed = small_join(members, final, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    if shared is None:
        rows = placed.withColumn("component_id", F.col("root"))
    else:
        # A root made from a fingerprint is no doc_id: the smallest one of its members is looked up.
        least = small_join(classes.select("node", "rep"), final, ["node"], "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("rep").alias("component_id"))
        rows = placed.join(least, "root")
    columns = ["doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash", "root"]
    alone = sketch.where("n_shingles = 0 or doc_id is null").withColumns({"component_id": F.col("doc_id"), "root": F.lit(None).cast("long")})
    return rows.select(*columns).unionByName(alone.select(*columns))
