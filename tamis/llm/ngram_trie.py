"""An n-gram trie whose levels are Elias-Fano sequences in one buffer, memory-mapped from a file or viewed in place.

The first level holds 64-bit word hashes; each deeper level names a successor by a 32-bit fingerprint within its context:
the key (context's rank << 32 | fingerprint) makes a level one rising sequence.  Pointers (where a node's successors
begin) are a rising sequence too.  A lookup finds the context, takes its range from the pointers, and searches the
successor relative to that context.  The last level has one code of 8 bits for each n-gram, the first one a code for each
context (its backoff weight).  All searches are vectorised.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

_ONE = np.uint64(1)
_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_SELECT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _r, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _r] = _i


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the bit number rank among the set bits of each word."""
    left, out, found = rank.astype(np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    for k in range(8):
        byte = ((words >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)
        here = ~found & (left < _POP[byte])
        out[here] = 8 * k + _SELECT[byte[here], left[here]]
        found |= here
        left -= np.where(found, 0, _POP[byte])
    return out


class EliasFano:
    """A rising sequence of 64-bit numbers: low bits packed, high bits in unary with counts before each word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.l, self.low, self.high = n, low_bits, low, high
        ones = _POP[high.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64) if len(high) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.zeros_before = np.arange(len(self.before)) * 64 - self.before

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(1, np.uint64), np.zeros(1, np.uint64))
        low_bits = min(63, max(0, (int(values[-1]) // n).bit_length() - 1))
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high[-1]) + 2 + 63) // 64 * 64, np.uint8)
        bits[high] = 1
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            part = values & ((_ONE << np.uint64(low_bits)) - _ONE)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, off = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << off)
            over = off.astype(np.int64) + low_bits > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").view(np.uint64))

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i * self.l
        word, off = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> off
        over = off.astype(np.int64) + self.l > 64
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - off[over])
        return out & ((_ONE << np.uint64(self.l)) - _ONE)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        word = np.searchsorted(self.before, i, side="right") - 1
        at = word * 64 + _select_in_word(self.high[word], i - self.before[word])
        return ((at - i).astype(np.uint64) << np.uint64(self.l)) | self.lows(i)

    def _below(self, bucket: np.ndarray) -> np.ndarray:
        """Number of values whose high part is less than bucket."""
        out = np.full(len(bucket), 0, np.int64)
        some = bucket > 0
        want = bucket[some] - 1
        word = np.minimum(np.searchsorted(self.zeros_before, want, side="right") - 1, len(self.high) - 1)
        out[some] = word * 64 + _select_in_word(~self.high[word], want - self.zeros_before[word]) - want
        return np.minimum(out, self.n)

    def find(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
        """Position of each x within [begin, end), or -1."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        x = x.astype(np.uint64)
        last = int(self.zeros_before[-1]) - 1
        bucket = x >> np.uint64(self.l)
        inside = bucket <= np.uint64(last)
        b = np.where(inside, bucket, 0).astype(np.int64)
        lo, hi = self._below(b), np.where(b >= last, self.n, self._below(np.minimum(b + 1, last)))
        lo, hi = np.maximum(lo, begin), hi if end is None else np.minimum(hi, end)
        want = x & ((_ONE << np.uint64(self.l)) - _ONE) if self.l else np.zeros(len(x), np.uint64)
        top = hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = np.zeros(len(x), bool)
            less[open_] = self.lows(mid[open_]) < want[open_]
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        there = inside & (lo < top)
        there[there] = self.lows(lo[there]) == want[there]
        out[there] = lo[there]
        return out

    def pack(self) -> bytes:
        return struct.pack("<4q", self.n, self.l, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def view(cls, buffer: memoryview, at: int) -> tuple[EliasFano, int]:
        n, l, n_low, n_high = struct.unpack_from("<4q", buffer, at)
        at += 32
        low = np.frombuffer(buffer, np.uint64, n_low, at)
        high = np.frombuffer(buffer, np.uint64, n_high, at + 8 * n_low)
        return cls(n, l, low, high), at + 8 * (n_low + n_high)


class NgramTrie:
    """levels[0]: word hashes; levels[k]: successors of the nodes of level k - 1; pointers[k]: where they begin; codes: of the last level; weights: of the first."""

    def __init__(self, levels: list[EliasFano], pointers: list[EliasFano], codes: np.ndarray, weights: np.ndarray):
        self.levels, self.pointers, self.codes, self.weights = levels, pointers, codes, weights

    @classmethod
    def build(cls, words: np.ndarray, successors: list[np.ndarray], codes: np.ndarray, weights: np.ndarray | None = None) -> NgramTrie:
        """From distinct n-grams sorted by (word hash, successor fingerprints...), with one code each, and one weight for each distinct first word."""
        n = len(words)
        new = np.r_[True, words[1:] != words[:-1]] if n else np.zeros(0, bool)
        levels, pointers = [EliasFano.encode(words[new])], []
        for s in successors:
            parent = np.cumsum(new) - 1
            deeper = new | np.r_[True, s[1:] != s[:-1]] if n else new
            first = new[deeper]
            pointers.append(EliasFano.encode(np.concatenate([np.nonzero(first)[0], [deeper.sum()]])))
            levels.append(EliasFano.encode((parent[deeper].astype(np.uint64) << np.uint64(32)) | s[deeper].astype(np.uint64)))
            new = deeper
        return cls(levels, pointers, codes.astype(np.uint8), np.zeros(levels[0].n, np.uint8) if weights is None else weights.astype(np.uint8))

    def lookup(self, words: np.ndarray, successors: list[np.ndarray]) -> np.ndarray:
        """Code of each n-gram, 0 where it is not in the trie."""
        node = self.levels[0].find(words)
        for level, pointer, s in zip(self.levels[1:], self.pointers, successors, strict=True):
            known = np.nonzero(node >= 0)[0]
            deeper = np.full(len(node), -1, np.int64)
            at = node[known]
            key = (at.astype(np.uint64) << np.uint64(32)) | s[known].astype(np.uint64)
            deeper[known] = level.find(key, pointer.get(at).astype(np.int64), pointer.get(at + 1).astype(np.int64))
            node = deeper
        return np.where(node >= 0, self.codes[np.maximum(node, 0)] if len(self.codes) else 0, 0).astype(np.uint8)

    def weight(self, words: np.ndarray) -> np.ndarray:
        """The weight's code of each context, 0 where it is not in the trie."""
        node = self.levels[0].find(words)
        return np.where(node >= 0, self.weights[np.maximum(node, 0)] if len(self.weights) else 0, 0).astype(np.uint8)

    def pack(self) -> bytes:
        return struct.pack("<2q", len(self.levels), len(self.codes)) + b"".join(x.pack() for x in [*self.levels, *self.pointers]) + self.codes.tobytes() + self.weights.tobytes()

    @classmethod
    def view(cls, buffer: bytes | memoryview) -> NgramTrie:
        """The trie in a buffer, without copying it."""
        buffer = memoryview(buffer)
        n, n_codes = struct.unpack_from("<2q", buffer, 0)
        at, found = 16, []
        for _ in range(2 * n - 1):
            x, at = EliasFano.view(buffer, at)
            found.append(x)
        return cls(found[:n], found[n:], np.frombuffer(buffer, np.uint8, n_codes, at), np.frombuffer(buffer, np.uint8, found[0].n, at + n_codes))

    @classmethod
    def open(cls, path: str) -> NgramTrie:
        """The trie in a file, memory-mapped."""
        with open(path, "rb") as f:
            return cls.view(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
