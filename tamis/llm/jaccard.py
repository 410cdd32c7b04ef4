"""N-gram Jaccard join with count vectors and an R-tree.

A text's set holds the 64-bit hashes of its distinct runs of `width` words; two texts link when their sets' Jaccard
similarity is at least `threshold`.  Texts with equal sets are one class from the start.

Hashes are dealt into groups in two ways:

* into groups for the count vector of a class, at least as many as the set has hashes (64, 256, 1024, ...), nested so
  that a longer vector folds to a shorter one.  The overlap of two sets is at most the sum of the smaller count of each
  group; count vectors are indexed in an R-tree whose nodes keep the largest count of each group, so that whole nodes are
  passed over by the same bound.
* into many small groups for finding candidates without comparing all classes.  Sets of at most U hashes that link differ
  in at most U * 2 * (1 - t) / (1 + t) hashes, so of more groups than that at least one is the same in both: its
  signature (the sum of mixed hashes) is an equal key.  Sizes fall into bands of ratio (1 / t)^2; a class takes part in
  its own band and in the next one if it can link into it.  Empty groups carry no signature: spare groups make sure that
  a set with at most so many empty groups shares a group that is not empty with each set that links.  To keep shared
  passages from filling buckets, the groups first hold only hashes outside an agreed set of frequent ones (found on a
  bounded sample; any set would do, for two sets that differ in few hashes also differ in few of the others).  Sets with
  more empty groups than spare ones also send the signatures of groups of all their hashes, and, if those too have too
  many empty ones, of the empty ones, so no link is lost.

An R-tree over all classes alone would not do: vectors of unrelated texts of one length lie within the search radius in
each single coordinate, so its nodes overlap and each search would read most of them (README: figures).  It therefore
joins the classes of one signature bucket.

Buckets are reduced to their distinct member lists.  First each class is verified against its best bucket hub, which
settles nearly all copies.  Buckets that still hold more than one component are then pooled by hub, the member that is in
most buckets of all, and every pool is joined by R-trees over the count vectors: the classes outside a pool's largest
component against all its classes, in blocks bounded by members and bytes.  Nodes keep the largest counts, the smallest
size and the range of components below them; they are passed over where the summed minima fall short or where all below
is of the searcher's own component.  The closest few of each class are verified first and, with the components that
these leave, all that pass.  So every pair that links is either verified or connected already.  Sets are made again from
the texts for the classes to verify only.

Fewer than `width` words: the whole sequence is the one shingle.  Null and texts without words have empty sets, link
with nothing and are their own component.  Equal texts link at any size.  Rows without an id take part, and get the
smallest id of their component, or null.  Repeated rows each give a row.  Other columns are ignored by `components` and
kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fractions import Fraction
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.llm.common import Scratch, free, keep, stored
from tamis.llm.tokens import LOWERED, blocks, tokenize
from tamis.operators.components import components as contracted

WIDTH = 5
THRESHOLD = Fraction(4, 5)
#: Bits of the shortest count vector, and of the finest groups that there are.
SHORTEST, GROUP_BITS = 6, 24
#: Frequent hashes: sets sampled, times seen among them, and how many are kept.
SAMPLE, SEEN, FREQUENT = 10_000, 6, 500_000
#: Signatures in one shard of the bucket search, and members of a bucket in one row.
SHARD, LIST = 1_000_000, 4096
#: Members and bytes of vectors on each side of one block of a pool.
BLOCK, POOL_BYTES = 512, 4 << 20
#: Bytes of an Arrow batch: its buffers lie outside the heap.
BATCH_BYTES = 8 << 20
#: Bytes of text that a task works on at once, and signatures that it holds.
BLOCK_BYTES, HELD = 2 << 20, 300_000
#: Bytes of vectors, and pairs of a searcher and a class, of the blocks that are joined at once.
AT_ONCE, PAIRS_AT_ONCE = 8 << 20, 1 << 20
#: Pairs of each class that are verified before all others.
CLOSEST = 3
#: More dropped documents than this (at 24 bytes each) are joined by shuffle.
MAX_BROADCAST_DROPPED = 500_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BITS = 22
_SHARDS = "shard long, sigs binary, nodes binary"


def mix(x: np.ndarray, by: np.uint64 = _B) -> np.ndarray:
    """A bijection of 64-bit numbers with well spread bits."""
    x = (x ^ (x >> np.uint64(32))) * by
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


class ShingleSets:
    """The sets of a block of texts, one after another: sorted hashes, and where each set starts."""

    def __init__(self, texts: pa.Array, width: int = WIDTH):
        tokens = tokenize(texts, LOWERED)
        h = tokens.hashes()[tokens.ids]
        n = np.diff(tokens.starts)
        rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for j in range(width):
            rolled = rolled * _A + h[j : j + len(rolled)]
        rolled = mix(rolled + np.uint64(width))
        sets = []
        for i, (a, k) in enumerate(zip(tokens.starts[:-1].tolist(), n.tolist(), strict=True)):
            if k >= width:
                sets.append(np.unique(rolled[a : a + k - width + 1]))
            elif k:
                x = np.uint64(0)
                with np.errstate(over="ignore"):
                    for y in h[a : a + k]:
                        x = x * _A + y
                sets.append(mix(np.array([x + np.uint64(k)])))
            else:
                sets.append(np.zeros(0, np.uint64))
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)

    def sums(self, by: np.uint64) -> np.ndarray:
        """A 64-bit digest of each set."""
        total = np.zeros(len(self.sizes), np.uint64)
        np.add.at(total, self.owner, mix(self.hashes, by))
        return mix(total + self.sizes.astype(np.uint64))

    def nodes(self, bits: int = 64, clashing: np.ndarray | None = None) -> np.ndarray:
        """The digest that names each set: the first one, or the second where sets that differ share the first."""
        node = self.sums(_B) >> np.uint64(64 - bits)
        if clashing is not None and len(clashing):
            node = np.where(np.isin(node, clashing), self.sums(_A), node)
        return node

    def vectors(self) -> list[bytes]:
        return [count_vector(self.hashes[a:b]) for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)]


def count_vector(hashes: np.ndarray) -> bytes:
    """The count vector of a set, a byte for each group."""
    h = hashes & np.uint64((1 << GROUP_BITS) - 1)
    bits = SHORTEST
    while len(h) > 2 << bits and bits < GROUP_BITS:
        bits += 2
    count = np.bincount((h >> np.uint64(GROUP_BITS - bits)).astype(np.int64), minlength=1 << bits)
    while count.max() > 255:  # a byte must hold each count
        if bits >= GROUP_BITS:  # a vector that never rules anything out
            return b"\xff" * (1 << bits)
        bits += 2
        count = np.bincount((h >> np.uint64(GROUP_BITS - bits)).astype(np.int64), minlength=1 << bits)
    return count.astype(np.uint8).tobytes()


def folded(vectors: list[bytes], groups: int) -> np.ndarray:
    """Vectors of at least so many groups, folded to that many; one row each."""
    out = np.empty((len(vectors), groups), np.uint16)
    length = np.array([len(v) for v in vectors])
    for n in np.unique(length):
        at = np.nonzero(length == n)[0]
        rows = np.frombuffer(b"".join(vectors[i] for i in at), np.uint8).reshape(len(at), groups, n // groups)
        out[at] = rows.sum(axis=2, dtype=np.uint16)
    return out


def pair_bounds(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The most that each pair's sets can overlap."""
    out = np.zeros(len(left), np.int64)
    groups = np.minimum([len(v) for v in left], [len(v) for v in right])
    for g in np.unique(groups):
        at = np.nonzero(groups == g)[0]
        for k in range(0, len(at), max(1, (1 << 22) // int(g))):
            some = at[k : k + max(1, (1 << 22) // int(g))]
            out[some] = np.minimum(folded([left[i] for i in some], int(g)), folded([right[i] for i in some], int(g))).sum(axis=1, dtype=np.int64)
    return out


class Bands:
    """Size bands: upper sizes, groups of each, and how many empty groups a set may leave out."""

    def __init__(self, threshold: Fraction = THRESHOLD, most: int = 1 << 40):
        self.t = threshold
        self.upper, self.groups, self.spare = [], [], []
        step, u = 1 / threshold**2, 4
        while not self.upper or self.upper[-1] < most:
            below = self.upper[-1] if self.upper else 0
            least = max(1, ceil(threshold * (below + 1)))
            differ = int(2 * u * (1 - threshold) / (1 + threshold))
            spare = 0
            for _ in range(3):
                groups = differ + 1 + spare
                p = exp(-0.75 * least / groups)  # also for sets of which a quarter is frequent
                spare = ceil(p * groups + 4 * sqrt(p * (1 - p) * groups))
            self.upper.append(u)
            self.groups.append(differ + 1 + spare)
            self.spare.append(spare)
            u = int(u * step) + 1
        self.bounds = np.array(self.upper)

    def of(self, size: int) -> list[int]:
        """The bands that a set of this size takes part in."""
        i = int(np.searchsorted(self.bounds, size))
        return [i, i + 1] if size >= self.t * (self.upper[i] + 1) else [i]


@lru_cache(maxsize=4)
def bands(threshold: Fraction) -> Bands:
    return Bands(threshold)


def _grouped(sets: ShingleSets, jobs: list[tuple[int, int]], rare: np.ndarray | None, b: Bands, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the groups of jobs (set, band), the set of each, and the jobs with too many empty groups."""
    which = np.array([i for i, _ in jobs])
    band = np.array([k for _, k in jobs])
    m = np.array(b.groups)[band]
    base = np.concatenate([[0], np.cumsum(m)])
    sizes = sets.sizes[which]
    take = np.repeat(sets.starts[which] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    job = np.repeat(np.arange(len(jobs)), sizes)
    if rare is not None:
        take, job = take[rare[take]], job[rare[take]]
    h = sets.hashes[take]
    slot = base[job] + ((h >> np.uint64(GROUP_BITS)) % m[job].astype(np.uint64)).astype(np.int64)
    total = np.zeros(base[-1], np.uint64)
    np.add.at(total, slot, mix(h, _A))
    full = np.bincount(slot, minlength=base[-1]) > 0
    many = np.add.reduceat((~full).astype(np.int64), base[:-1]) > np.array(b.spare)[band]
    of = np.repeat(np.arange(len(jobs)), m)
    emit = full | many[of] if rare is None else full
    at = np.nonzero(emit)[0]
    place = (at - base[of[at]]).astype(np.uint64) * _C + band[of[at]].astype(np.uint64) * _B + np.uint64(salt)
    return mix(total[at] + mix(place)), which[of[at]], np.nonzero(many)[0]


def signatures(sets: ShingleSets, which: np.ndarray, frequent: np.ndarray, threshold: Fraction = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets numbered by which, and the set of each; frequent: sorted hashes to leave out where possible."""
    b = bands(threshold)
    jobs = [(int(i), band) for i in which for band in b.of(int(sets.sizes[i]))]
    if not jobs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rare = np.ones(len(sets.hashes), bool)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, sets.hashes), len(frequent) - 1)] != sets.hashes
    sig, owner, many = _grouped(sets, jobs, rare, b, 1)
    if not len(many):
        return sig, owner
    more, more_owner, _ = _grouped(sets, [jobs[j] for j in many], None, b, 2)
    return np.concatenate([sig, more]), np.concatenate([owner, more_owner])


class CountForest:
    """Bulk-loaded R-trees over count vectors, one for each block; all are built and searched together.

    Points come sorted by block.  Within a block they are tiled by component and size, so that a node covers copies of
    one text where it can.  A node keeps the largest count of each group, the smallest size, and the first and last
    component below it.
    """

    FANOUT = 8

    def __init__(self, block: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, comp: np.ndarray, threshold: Fraction = THRESHOLD):
        self.t = threshold
        self.order = np.lexsort((sizes, comp, block))
        block, comp = block[self.order], comp[self.order]
        self.levels = [(vectors[self.order], sizes[self.order], comp, comp)]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while (block[1:] == block[:-1]).any():
            first = np.nonzero(np.r_[True, block[1:] != block[:-1]])[0]
            place = np.arange(len(block)) - np.repeat(first, np.diff(np.r_[first, len(block)]))
            cut = np.nonzero(place % self.FANOUT == 0)[0]
            v, s, lo, hi = self.levels[-1]
            self.levels.append((np.maximum.reduceat(v, cut, axis=0), np.minimum.reduceat(s, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)))
            self.children.append((cut, np.diff(np.r_[cut, len(block)])))
            block = block[cut]
        self.roots = block
        self.visits = 0

    def join(self, block: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(searcher, point) for the points of a searcher's block and of another component whose summed minima reach the overlap needed."""
        root = np.minimum(np.searchsorted(self.roots, block), max(0, len(self.roots) - 1))
        q = np.nonzero(self.roots[root] == block)[0] if len(self.roots) else np.zeros(0, np.int64)
        at = root[q]
        for depth in range(len(self.levels) - 1, -1, -1):
            v, s, lo, hi = self.levels[depth]
            self.visits += len(q)
            other = (lo[at] != comp[q]) | (hi[at] != comp[q])
            q, at = q[other], at[other]
            ok = self._summed(vectors, v, q, at) >= _need(s[at] + sizes[q], self.t)
            q, at = q[ok], at[ok]
            if depth:
                first, n = self.children[depth - 1]
                n = n[at]
                q, start = np.repeat(q, n), np.repeat(first[at], n)
                at = start + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        return q, self.order[at]

    @staticmethod
    def _summed(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        step = max(1, (1 << 20) // max(1, left.shape[1]))
        for k in range(0, len(i), step):
            out[k : k + step] = np.minimum(left[i[k : k + step]], right[j[k : k + step]]).sum(axis=1, dtype=np.int64)
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _features(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, limit=BLOCK_BYTES):
        sets = ShingleSets(batch.column("text"), width)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("at"), pa.array(sets.sizes), _signed(sets.nodes(bits)), _signed(sets.sums(_A)), pa.array(sets.vectors(), pa.binary())],
            names=["doc_id", "at", "n", "node", "check", "vector"],
        )


def _sampled(batches: Iterator[pa.RecordBatch], width: int, shards: int) -> Iterator[pa.RecordBatch]:
    """The hashes of the texts' sets with their nodes, by shard of the hash."""
    for batch in blocks(batches, limit=BLOCK_BYTES):
        sets = ShingleSets(batch.column("text"), width)
        yield from _sharded(sets.hashes, sets.sums(_B)[sets.owner], shards)


def _sharded(key: np.ndarray, node: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    if not len(key):
        return
    shard = (key >> np.uint64(33)) % np.uint64(shards)
    order = np.argsort((shard << np.uint64(48)) | (node >> np.uint64(16)), kind="stable")
    key, node, shard = key[order], node[order], shard[order].astype(np.int64)
    cut = np.concatenate([[0], np.nonzero(np.diff(shard))[0] + 1, [len(shard)]])
    parts = list(zip(cut[:-1], cut[1:], strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]]), pa.array([key[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([node[a:b].tobytes() for a, b in parts], pa.binary())], names=["shard", "sigs", "nodes"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct (key, node) of each shard of a partition, sorted."""
    by: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for shard, s, n in zip(batch.column("shard").to_pylist(), batch.column("sigs").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
            by.setdefault(shard, []).append((s, n))
    for shard in list(by):
        parts = by.pop(shard)
        key = np.frombuffer(b"".join(s for s, _ in parts), np.uint64)
        node = np.frombuffer(b"".join(n for _, n in parts), np.uint64)
        del parts
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        yield key[new], node[new]


def _often(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Hashes that at least so many different sets hold."""
    for key, _ in _shards(batches):
        names, count = np.unique(key, return_counts=True)
        often = count >= least
        yield pa.RecordBatch.from_arrays([_signed(names[often]), pa.array(count[often])], names=["hash", "sets"])


def _signature_shards(batches: Iterator[pa.RecordBatch], width: int, threshold: Fraction, shards: int, frequent: np.ndarray, name: tuple[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    seen, n = np.zeros(0, np.uint64), 0

    for batch in blocks(batches, limit=BLOCK_BYTES):
        sets = ShingleSets(batch.column("text"), width)
        nodes = sets.nodes(*name)
        # equal sets send their signatures once from each task
        _, which = np.unique(nodes, return_index=True)
        which = which[(sets.sizes[which] > 0) & ~np.isin(nodes[which], seen)]
        seen = np.concatenate([seen, nodes[which]])
        sig, owner = signatures(sets, which, frequent, threshold)
        if len(sig):
            held.append((sig, nodes[owner]))
            n += len(sig)
        if n >= HELD:
            yield from _sharded(*(np.concatenate(x) for x in zip(*held, strict=True)), shards)
            held, n = [], 0
    if held:
        yield from _sharded(*(np.concatenate(x) for x in zip(*held, strict=True)), shards)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct member lists of the signatures of a partition, hub first; hub: the member in most buckets here."""
    for sig, node in _shards(batches):
        start = np.nonzero(np.r_[True, sig[1:] != sig[:-1]])[0]
        length = np.diff(np.r_[start, len(sig)])
        if not (length > 1).any():
            continue
        row = np.repeat(length > 1, length)
        node, length = node[row], length[length > 1]
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        key = np.add.reduceat(mix(node, _A), start) + length.astype(np.uint64)
        _, pick, times = np.unique(key, return_index=True, return_counts=True)
        names, code = np.unique(node, return_inverse=True)
        degree = np.bincount(code)
        for k in range(0, len(pick), 2000):
            rows: list[tuple[int, int, int]] = []
            lists = []
            for p, n in zip(pick[k : k + 2000].tolist(), times[k : k + 2000].tolist(), strict=True):
                a, b = start[p], start[p] + length[p]
                hub = a + int(np.argmax(degree[code[a:b]]))
                others = np.concatenate([node[a:hub], node[hub + 1 : b]])
                for i in range(0, len(others), LIST):
                    rows.append((p, i // LIST, n))
                    lists.append(np.r_[node[hub], others[i : i + LIST]].view(np.int64))
            p, part, n = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [_signed(mix(key[p])), pa.array(part), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))],
                names=["bucket", "part", "times", "members"],
            )


def _need(n: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The overlap that two sets of n hashes together must have: t / (1 + t) of them, rounded up."""
    num, den = threshold.numerator, threshold.numerator + threshold.denominator
    return -(-n * num // den)


def _bounded(batches: Iterator[pa.RecordBatch], threshold: Fraction) -> Iterator[pa.RecordBatch]:
    """Pairs whose count vectors allow the overlap they need."""
    for batch in batches:
        bound = pair_bounds(batch.column("vector_a").to_pylist(), batch.column("vector_b").to_pylist())
        ok = bound >= _need(batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy(), threshold)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(ok))


def _joined(rows: dict[str, np.ndarray], vectors: list[bytes], threshold: Fraction, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different components, within the blocks of rows, that pass the bound, and by how much; with best, only that many of each member of a block, the closest to linking.

    Each block's R-tree holds its rows marked right; its rows marked left search it.  Vectors fold to the shortest of
    their block, and pairs are bounded once more by the vectors as long as both sides have them.
    """
    length = np.array([len(v) for v in vectors])
    block, n, comp = rows["block"], rows["n"], rows["component"]
    first = np.nonzero(np.r_[True, block[1:] != block[:-1]])[0]
    groups = np.repeat(np.minimum.reduceat(length, first), np.diff(np.r_[first, len(block)]))
    found = []
    for g in np.unique(groups):
        at = np.nonzero(groups == g)[0]
        short = folded([vectors[i] for i in at], int(g))
        left, right = rows["left"][at], rows["right"][at]
        forest = CountForest(block[at[right]], short[right], n[at[right]], comp[at[right]], threshold)
        q, p = forest.join(block[at[left]], short[left], n[at[left]], comp[at[left]])
        found.append((at[left][q], at[right][p]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    # a pair that both sides search for is taken from the smaller one
    ok = ~(rows["minor"][a] & rows["minor"][b]) | (rows["node"][a] < rows["node"][b])
    ok &= np.minimum(n[a], n[b]) * threshold.denominator >= np.maximum(n[a], n[b]) * threshold.numerator
    a, b = a[ok], b[ok]
    over = pair_bounds([vectors[i] for i in a], [vectors[i] for i in b]) - _need(n[a] + n[b], threshold)
    a, b, over = a[over >= 0], b[over >= 0], over[over >= 0]
    if best and len(a):
        chosen = np.zeros(len(a), bool)
        for end in (a, b):
            order = np.lexsort((-over, end))
            first = np.nonzero(np.r_[True, np.diff(end[order]) != 0])[0]
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            chosen[order[place < best]] = True
        a, b, over = a[chosen], b[chosen], over[chosen]
    return a, b, over


_BLOCK_KEYS = ("hub", "i", "j")


def _pool_pairs(batches: Iterator[pa.RecordBatch], threshold: Fraction, best: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, over) of the blocks of a partition, whose rows come sorted by block; as many blocks at once as memory allows."""
    held: list[pa.Table] = []
    for batch in batches_and_end(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
        if not held:
            continue
        table = pa.concat_tables(held)
        keys = [table.column(c).to_numpy() for c in _BLOCK_KEYS]
        start = np.nonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in keys], axis=0)])[0]
        if batch is not None:  # the last block may go on in the next batch
            held = [table.slice(start[-1])]
            table, start = table.slice(0, start[-1]), start[:-1]
        else:
            held = []
        if not table.num_rows:
            continue
        size = pc.binary_length(table.column("vector")).to_numpy().astype(np.int64)
        sides = [np.add.reduceat(table.column(c).to_numpy(zero_copy_only=False).astype(np.int64), start) for c in ("left", "right")]
        cost = np.maximum(np.add.reduceat(size, start) / AT_ONCE, sides[0] * sides[1] / PAIRS_AT_ONCE)
        ends, k = [*start[1:].tolist(), table.num_rows], 0
        while k < len(start):
            m = max(k + 1, int(np.searchsorted(np.cumsum(cost[k:]), 1.0, side="right")) + k)
            some = table.slice(int(start[k]), ends[m - 1] - int(start[k]))
            rows = {c: some.column(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "n", "left", "right", "minor")}
            rows["block"] = np.repeat(np.arange(m - k), np.diff(np.r_[start[k:m], ends[m - 1]]))
            a, b, over = _joined(rows, some.column("vector").to_pylist(), threshold, best)
            x, y = rows["node"][a], rows["node"][b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(over)], names=["a", "b", "over"])
            k = m


def batches_and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sets(batches: Iterator[pa.RecordBatch], width: int, wanted: bytes, name: tuple[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts whose row is marked in the bitmap wanted."""
    marks = np.unpackbits(np.frombuffer(wanted, np.uint8))
    for batch in batches:
        rows = batch.filter(pa.array(marks[batch.column("spot").to_numpy() & ((1 << _BITS) - 1)].astype(bool)))
        for block in blocks(iter([rows])):
            sets = ShingleSets(block.column("text"), width)
            cut = sets.starts.tolist()
            yield pa.RecordBatch.from_arrays([_signed(sets.nodes(*name)), pa.array([sets.hashes[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["node", "shingles"])


def _verified(batches: Iterator[pa.RecordBatch], threshold: Fraction) -> Iterator[pa.RecordBatch]:
    num, den = threshold.numerator, threshold.denominator
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(den * both >= num * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def connected(edges: DataFrame, put: Callable[[DataFrame], DataFrame] = keep) -> DataFrame:
    """node, component (the smallest node id) of all nodes of edges (a, b), by contraction in logarithmically many rounds."""
    return contracted(edges, keep=put).withColumnRenamed("root", "component")


def merged(labels: DataFrame, links: DataFrame, put: Callable[[DataFrame], DataFrame] = keep) -> DataFrame:
    """labels (node, component) after further links (a, b)."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"component_{x}"))
    at = lambda x: F.coalesce(F.col(f"component_{x}"), F.col(x)).alias(x)
    over = connected(links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(at("a"), at("b")).where("a <> b"), put)
    over = over.select(F.col("node").alias("component"), F.col("component").alias("over"))
    every = labels.union(over.join(labels.select(F.col("node").alias("component")), "component", "left_anti").select("component", "component"))
    return put(every.join(over, "component", "left").select("node", F.coalesce("over", "component").alias("component")))


@contextmanager
def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of at most so many bytes, until the block ends."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Join:
    """One run over docs (doc_id, text).

    Sets are named by 64-bit digests.  Digests that different sets share are gathered (at 10^10 different sets about
    three are expected), and those sets go by a second digest.
    """

    def __init__(self, docs: DataFrame, width: int = WIDTH, threshold: Fraction = THRESHOLD, bits: int = 64):
        self.spark, self.width, self.t = docs.sparkSession, width, threshold
        self.scratch = Scratch(self.spark, "shingles")
        self.docs = docs.select("doc_id", F.xxhash64("text").alias("at"), "text")
        id_type = docs.schema["doc_id"].dataType.simpleString()
        rows = stored(self.docs.mapInArrow(lambda b: _features(b, width, bits), f"doc_id {id_type}, at long, n long, node long, check long, vector binary"), "shingle-rows")
        full = rows.where(F.col("n") > 0)
        clash = keep(full.groupBy("node").agg(F.min("check").alias("c0"), F.max("check").alias("c1")).where("c0 <> c1").select("node"))
        self.name = (bits, clash.toArrow().column("node").to_numpy().view(np.uint64))
        if len(self.name[1]):
            rows = rows.join(clash.withColumnRenamed("node", "clash"), F.col("node") == F.col("clash"), "left").withColumn("node", F.when(F.col("clash").isNotNull(), F.col("check")).otherwise(F.col("node"))).drop("clash")
        self.rows = rows.drop("check", "vector")
        full = rows.where(F.col("n") > 0)
        self.classes = stored(full.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min(F.xxhash64("doc_id", "at")).alias("spot"), F.first("n").alias("n"), F.first("vector").alias("vector")), "shingle-classes")

    def frequent(self) -> np.ndarray:
        """At most FREQUENT hashes that several of a bounded sample of sets hold, sorted; they decide how buckets fill, not what links."""
        width, part = self.width, 1 << 20
        shards = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        some = F.pmod(F.xxhash64(F.col("at")), F.lit(part)) < int(part * min(1.0, SAMPLE / max(1, self.classes.count())))
        texts = self.docs.where(some & F.col("at").isNotNull()).groupBy("at").agg(F.first("text").alias("text")).select("text")
        dealt = texts.mapInArrow(lambda b: _sampled(b, width, shards), _SHARDS)
        often = dealt.repartition(shards, "shard").mapInArrow(lambda b: _often(b, SEEN), "hash long, sets long")
        return np.sort(often.orderBy(F.desc("sets"), "hash").limit(FREQUENT).toArrow().column("hash").to_numpy().view(np.uint64))

    def buckets(self) -> DataFrame:
        total = self.classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        shards = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) * 7 // 10 // SHARD))
        width, t, name = self.width, self.t, self.name
        frequent = self.spark.sparkContext.broadcast(self.frequent())
        dealt = self.docs.select("text").mapInArrow(lambda b: _signature_shards(b, width, t, shards, frequent.value, name), _SHARDS)
        found = dealt.repartition(shards, "shard").mapInArrow(_buckets, "bucket long, part long, times long, members array<long>")
        return self.scratch.stored(found.groupBy("bucket", "part").agg(F.sum("times").alias("times"), F.first("members").alias("members")), "buckets")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) that pass the bound of the count vectors."""
        t = self.t
        side = lambda x: self.classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("vector").alias(f"vector_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "vector_a", "vector_b").mapInArrow(lambda b: _bounded(b, t), "a long, b long")

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """node, shingles of some classes, made again from the text of one row of each."""
        width, name = self.width, self.name
        nodes = keep(nodes.distinct())
        marks = np.zeros(1 << _BITS, np.uint8)
        # a bitmap of fixed size: it only saves making sets that the join would drop
        spots = nodes.join(self.classes.select("node", "spot"), "node").select(F.col("spot").bitwiseAND((1 << _BITS) - 1).cast("int").alias("x")).distinct()
        marks[spots.toArrow().column("x").to_numpy()] = 1
        wanted = self.spark.sparkContext.broadcast(np.packbits(marks).tobytes())
        sets = self.docs.select(F.xxhash64("doc_id", "at").alias("spot"), "text").mapInArrow(lambda b: _sets(b, width, wanted.value, name), "node long, shingles binary")
        return self.scratch.stored(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by their whole sets."""
        t = self.t
        sets = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
        return keep(joined.select("a", "b", "set_a", "set_b").mapInArrow(lambda b: _verified(b, t), "a long, b long"))

    def labels(self) -> DataFrame:
        """node, component of all classes that link to another."""
        buckets = self.buckets()
        spokes = buckets.select(F.col("members")[0].alias("hub"), F.explode(F.slice("members", F.lit(2), F.size("members") - 1)).alias("node"), "times")
        spokes = spokes.groupBy("hub", "node").agg(F.sum("times").alias("times"))
        ends = spokes.select("node", F.col("hub").alias("other"), "times").union(spokes.select("hub", "node", "times"))
        best = ends.groupBy("node").agg(F.max_by("other", F.struct("times", "other")).alias("other"))
        best = self.bounded(best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
        first = self.verified(keep(best))
        put = lambda df: self.scratch.stored(df, "labels")
        labels = put(connected(first, put))
        for few in (CLOSEST, 0):
            more = self.verified(keep(self.across(buckets, labels, few)))
            if more.limit(1).count():
                labels = merged(labels, more, put)
        labels = keep(labels)
        self.scratch.remove()
        return labels

    def across(self, buckets: DataFrame, labels: DataFrame, best: int) -> DataFrame:
        """Pairs of one bucket and different components that pass the bound; with best, that many of each class, the closest.

        Two classes meet in most buckets of their group, so buckets are pooled by hub first, the member that is in most
        buckets of all: a class then comes once to each of a few hubs instead of to each of its buckets.  Only the classes
        outside a pool's largest component search it, so a pool of one component and a few others costs in proportion
        to its members.  Sizes are a table of their own, so that the joins on hubs can be split where one is frequent.
        """
        t, put = self.t, self.scratch.stored
        rows = buckets.select("bucket", F.explode("members").alias("node")).join(labels, "node", "left")
        rows = rows.select("bucket", "node", F.coalesce("component", "node").alias("component"))
        mixed = put(rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where(F.col("lo") != F.col("hi")).select("bucket"), "mixed")
        rows = put(rows.join(mixed, "bucket"), "members")
        degree = rows.groupBy("node").agg(F.count("*").alias("degree"))
        hubs = put(rows.join(degree, "node").groupBy("bucket").agg(F.max_by("node", F.struct("degree", "node")).alias("hub")), "hubs")
        rows = put(rows.join(hubs, "bucket").select("hub", "node", "component").distinct().join(self.classes.select("node", "n", F.octet_length("vector").alias("bytes")), "node"), "pools")
        parts = rows.groupBy("hub", "component").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
        sizes = parts.groupBy("hub").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("size"), F.sum("bytes").alias("bytes"), F.max("size").alias("most"), F.max_by("bytes", F.struct("size", "component")).alias("most_bytes"))
        # both sides are cut into blocks by members and bytes; each pair of blocks is one piece of work
        cut = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / POOL_BYTES)).cast("int")
        sizes = put(sizes.select("hub", "main", cut(F.col("size") - F.col("most"), F.col("bytes") - F.col("most_bytes")).alias("lefts"), cut(F.col("size"), F.col("bytes")).alias("rights")), "sizes")
        rows = rows.join(sizes, "hub").withColumn("minor", F.col("component") != F.col("main"))
        own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        single = (F.col("lefts") == 1) & (F.col("rights") == 1)
        to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        as_left = F.transform(to("rights"), lambda j: F.struct(own("lefts").alias("i"), j.alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right")))
        as_right = F.transform(to("lefts"), lambda i: F.struct(i.alias("i"), own("rights").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
        both = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("minor").alias("left"), F.lit(True).alias("right")))
        places = F.when(single, both).when(F.col("minor"), F.concat(as_left, as_right)).otherwise(as_right)
        rows = rows.select("hub", "node", "component", "minor", F.explode(places).alias("at")).select("hub", "at.*", "node", "component", "minor")
        rows = rows.join(self.classes.select("node", "n", "vector"), "node")
        dealt = rows.repartition(F.col("hub"), F.col("i"), F.col("j")).sortWithinPartitions("hub", "i", "j")
        pairs = dealt.mapInArrow(lambda b: _pool_pairs(b, t, best), "a long, b long, over long").distinct()
        if not best:
            return pairs.select("a", "b")
        pairs = put(pairs, "pairs")
        ends = pairs.select(F.col("a").alias("node"), "*").union(pairs.select(F.col("b").alias("node"), "*"))
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("over"), "a", "b"))
        return ends.withColumn("place", place).where(F.col("place") <= best).select("a", "b").distinct()

    def components(self) -> DataFrame:
        """doc_id, at, n_shingles, component_id."""
        labels = self.labels()
        of = self.classes.select("node", "least_id").join(labels, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component"))
        least = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
        of = of.join(least, "component").select("node", "component_id")
        full = self.rows.where("n > 0").select("doc_id", "at", "n", "node").join(of, "node").select("doc_id", "at", F.col("n").alias("n_shingles"), "component_id")
        return full.unionByName(self.rows.where("n = 0").select("doc_id", "at", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def components(docs: DataFrame, width: int = WIDTH, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    with small_batches(docs.sparkSession):
        return Join(docs, width, threshold).components().select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, threshold: Fraction = THRESHOLD) -> DataFrame:
    """docs, all columns, with one document of each component, that with the smallest id.

    Of rows that repeat that id one row stays.  Texts without words all stay.  Rows without an id go where their component
    has an id, and all stay where it has none.
    """
    with small_batches(docs.sparkSession):
        found = Join(docs, width, threshold).components().where("n_shingles > 0 and component_id is not null")
    id_, at = free(("_dropped_id", "_dropped_at"), docs.columns)
    drop = stored(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(id_), F.col("at").alias(at)).distinct(), "jaccard-dropped")
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(at))
    few = drop.count() <= MAX_BROADCAST_DROPPED
    kept = docs.join(F.broadcast(drop) if few else drop, same, "left_anti")
    again = keep(found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_)))
    if not again.limit(1).count():
        return kept
    repeats = F.col("doc_id") == F.col(id_)
    one = kept.join(again, repeats, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row")).select("row.*")
    return kept.join(again, repeats, "left_anti").unionByName(one)
