"""Byte-level BPE encoding and decoding with a rank queue.

A pre-token's bytes are a doubly linked list.  Every pair of neighbours that a merge rank covers waits in the bucket of
its rank, under the position of its left end; a bitmap over the ranks, with a bitmap over its words, tells by
find-first-set which bucket is next.  A merge changes at most two pairs, which enter their new buckets; their old entries stay behind and
are skipped when they come up (stale).  The work is therefore n log n for a pre-token of n bytes, whatever its length.
The lowest rank merges first and, within a rank, the leftmost pair, as the vocabulary's own library does.

Texts are split by the vocabulary's pattern into pre-tokens, long ones piece by piece at places where a split is certain.
Pre-tokens that come again are remembered in a table of bounded size.  The vocabulary (a rank file of bounded size) is
broadcast.

Null texts count as empty: no ids.  Texts that are no valid UTF-8 are read with replacement characters.  Ids that the
vocabulary does not have, or bytes that are no whole number of ids, decode to null.  An empty table gives an empty result;
columns whose names clash with the new ones stay, the new ones then end in underscores.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import free
from tamis.llm.tokens import blocks

#: A place between two matches of the usual pattern, whatever stands around it: a single space between letters or digits.
CERTAIN_SPLIT = r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])"
#: Characters of a text that are split at a time; longer pre-tokens stay whole.
SEGMENT = 1 << 20
#: Pre-tokens that a worker remembers in each of two generations, and the longest of them.
REMEMBERED, LONGEST = 1 << 18, 64
#: Ids that are decoded at a time.
DECODED = 1 << 19
MOST_VOCABULARY_BYTES = 64 << 20


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank.  All 256 bytes must be tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} of the 256 bytes are no tokens")
        self.ranks, self.most = ranks, max(map(len, ranks))
        top = max(ranks.values()) + 1
        # the bitmap has two levels, of words with as many bits as there are words: 256 by 256 for 50,000 ranks
        self.shift = (top.bit_length() + 1) // 2
        self.words = [0] * ((top >> self.shift) + 1)
        self.buckets: dict[int, list[int]] = {}
        tokens = [b""] * top
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def read(raw: bytes) -> Vocabulary:
        """From the lines of a rank file: a token in base 64, a space, its rank."""
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())})

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, most = self.ranks, self.most
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        get, words, buckets, shift = ranks.get, self.words, self.buckets, self.shift
        n, low = len(piece), (1 << shift) - 1
        # waits: the rank under which the pair that starts at a position stands in the queue, or -1
        after, before, waits = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        full = waiting = 0  # words of the bitmap with a bit; pairs that wait

        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                waits[i] = r
                waiting += 1
                if (bucket := buckets.get(r)) is not None:
                    bucket.append(i)  # places come in order, so the bucket stays a heap
                else:
                    buckets[r] = [i]
                    word = r >> shift
                    words[word] |= 1 << (r & low)
                    full |= 1 << word
        while waiting:
            word = (full & -full).bit_length() - 1
            bits = words[word]
            rank = (word << shift) | ((bits & -bits).bit_length() - 1)
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[word] = bits = bits & (bits - 1)
                if not bits:
                    full &= full - 1
            if waits[i] != rank:  # stale: the pair at i has merged or has another neighbour now
                continue
            j = after[i]
            k = after[i] = after[j]
            h = before[i]
            waiting -= 1 + (waits[j] >= 0) + (h >= 0 and waits[h] >= 0)
            waits[i] = waits[j] = -1
            if k < n:
                before[k] = i
                end = after[k]
                if end - i <= most and (r := get(piece[i:end])) is not None:
                    waits[i] = r
                    waiting += 1
                    if (bucket := buckets.get(r)) is not None:
                        heappush(bucket, i)
                    else:
                        buckets[r] = [i]
                        word = r >> shift
                        words[word] |= 1 << (r & low)
                        full |= 1 << word
            if h >= 0:
                waits[h] = -1
                if k - h <= most and (r := get(piece[h:k])) is not None:
                    waits[h] = r
                    waiting += 1
                    if (bucket := buckets.get(r)) is not None:
                        heappush(bucket, h)
                    else:
                        buckets[r] = [h]
                        word = r >> shift
                        words[word] |= 1 << (r & low)
                        full |= 1 << word
        # what is left is stale
        for rank in buckets:
            words[rank >> shift] = 0
        buckets.clear()
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def decode(self, ids: np.ndarray) -> bytes | None:
        """The bytes of ids; null if one of them is none of the vocabulary's."""
        if len(ids) and (int(ids.max()) >= len(self.sizes) or not self.sizes[ids].all()):
            return None
        out = []
        for at in range(0, len(ids), DECODED):
            some = ids[at : at + DECODED]
            sizes = self.sizes[some]
            shift = self.offsets[some] - (np.cumsum(sizes) - sizes)
            out.append(self.blob[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].tobytes())
        return b"".join(out)


class Encoder(dict):
    """Packed ids (32 bits each, little end first) of pre-tokens; those that come again are remembered, in two generations."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, certain: str | None = CERTAIN_SPLIT):
        super().__init__()
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.certain = certain and regex.compile(certain)
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.vocabulary.merge(piece.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def segments(self, text: str) -> Iterator[tuple[int, int]]:
        at = 0
        while self.certain and len(text) - at > SEGMENT and (m := self.certain.search(text, at + SEGMENT)):
            yield at, m.start()
            at = m.start()
        yield at, len(text)

    def encode(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.__getitem__, self.pattern.findall(text, start, end))) for start, end in self.segments(text))


@functools.lru_cache(maxsize=4)
def _encoder(raw: bytes, pattern: str, certain: str | None) -> Encoder:
    return Encoder(Vocabulary.read(raw), pattern, certain)


def _strings(texts: pa.Array) -> list[str]:
    try:
        return texts.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()]


def _added(block: pa.RecordBatch, *columns: pa.Array, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*block.columns, *columns], names=[*block.schema.names, *names])


def _encoded(batches: Iterator[pa.RecordBatch], text: str, new: list[str], raw: bytes, pattern: str, certain: str | None) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(raw, pattern, certain)
    for block in blocks(batches, text):
        ids = [encoder.encode(x or "") for x in _strings(block.column(text))]
        yield _added(block, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), names=new)


def _decoded(batches: Iterator[pa.RecordBatch], ids: str, new: list[str], raw: bytes) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary.read(raw)
    for block in blocks(batches, ids):
        out = [None if x is None or len(x) % 4 else vocabulary.decode(np.frombuffer(x, "<u4")) for x in block.column(ids).to_pylist()]
        yield _added(block, pa.array(out, pa.binary()), names=new)


def vocabulary_bytes(path: str) -> bytes:
    """A rank file's bytes, of bounded size, as they are broadcast."""
    with open(path, "rb") as f:
        raw = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(raw) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MOST_VOCABULARY_BYTES} bytes")
    return raw


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", certain: str | None = CERTAIN_SPLIT) -> DataFrame:
    """docs with n_tokens and ids (binary: 32-bit unsigned numbers, little end first) of each whole text.

    certain is a pattern of places that always lie between two matches of the other; None splits every text at once.
    """
    raw = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    new = free(("n_tokens", "ids"), docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(new[0], T.LongType()), T.StructField(new[1], T.BinaryType())])
    return docs.mapInArrow(lambda b: _encoded(b, text, new, raw.value, pattern, certain), schema)


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """coded with decoded (binary), the bytes that its ids stand for."""
    raw = coded.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    new = free(("decoded",), coded.columns)
    return coded.mapInArrow(lambda b: _decoded(b, ids, new, raw.value), T.StructType([*coded.schema.fields, T.StructField(new[0], T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", certain: str | None = CERTAIN_SPLIT) -> DataFrame:
    """docs with n_tokens, ids and decoded: encode and then decode, block by block in one task, without the ids in between going to the JVM and back."""
    raw = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    new = free(("n_tokens", "ids", "decoded"), docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(new[0], T.LongType()), T.StructField(new[1], T.BinaryType()), T.StructField(new[2], T.BinaryType())])
    return docs.mapInArrow(lambda b: _decoded(_encoded(b, text, new[:2], raw.value, pattern, certain), new[1], new[2:], raw.value), schema)


def id_list(ids: Column) -> Column:
    """Packed ids as an array of longs."""
    digits = F.hex(ids)

    def number(i: Column) -> Column:
        byte = lambda k: F.substr(digits, i * 8 + 2 * k + 1, F.lit(2))
        return F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("long")

    n = (F.octet_length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).when(n == 0, F.array().cast("array<bigint>"))
