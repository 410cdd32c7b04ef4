"""How filters interact: what each of them removes in every order in which they can run.

Texts are scanned in their Arrow buffers: a table gives each byte its classes, prefix sums of the classes count capitals,
symbols and characters between any two offsets, and the edges of runs of word bytes are the words.  A word's hash is made
of its bytes eight at a time; the hashes of each document are sorted, neighbours of equal hash are compared byte by byte,
and those that are equal are the repeats.  A document whose hashes clash is counted by its words themselves.

Each document then has a mask of the filters that it fails.  Whatever the order, a filter removes those that fail it and
none before it, so the counts of the 2^k masks of a part answer every one of the k! orders.

Equal texts are found by their digest (128 bits).  Rows of one digest are summed for each part and mask first, with the
smallest id among them, so a text that a third of all rows hold costs a few rows for each task.

Null texts count as empty; an empty text has no words.  A null id is equal to none and smaller than none: such rows never
fail the filter for copies and have no labels.  Rows that repeat an id are rows of their own; none of them is a copy of
another.  Several labels of one id count once, as soon as one of them says so.  Null parts are the empty string.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import stored
from tamis.llm.tokens import blocks, plain

WORD, CAPITAL, SYMBOL, FIRST = 1, 2, 4, 8
SYMBOLS = "#$%&*|"
#: The classes of each byte; bytes of a character beyond ASCII belong to words, and its first one counts it.
CLASSES = np.array([WORD * (chr(b) not in " \t\n\v\f\r") | CAPITAL * (65 <= b <= 90) | SYMBOL * (chr(b) in SYMBOLS) | FIRST * (b & 0xC0 != 0x80) for b in range(256)], np.uint8)
BLOCK_BYTES = 2 << 20
SEGMENT = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TAILS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
SCANNED = "n_words long, n_distinct long, n_capitals long, n_symbols long, n_chars long, digest binary"
AUDITED = "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


@dataclass(frozen=True)
class Limits:
    """A: fewer words. B: a smaller share (%) of distinct words. C: a larger share (%) of capitals. D: any symbol. E: a copy of a row with a smaller id."""

    words: int = 100
    distinct: int = 80
    capitals: int = 10


class Words:
    """The words of a block of texts, as places in its bytes."""

    def __init__(self, texts: pa.Array):
        texts = plain(texts)
        _, offsets, data = texts.buffers()
        self.ends_of = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.ends_of = self.ends_of - self.ends_of[0]
        size = int(self.ends_of[-1])
        self.bytes = np.zeros(size + 8, np.uint8)  # eight more, so that eight can be read from everywhere
        if size:
            self.bytes[:size] = np.frombuffer(data, np.uint8)[:size]
        self.counts = {k: np.zeros(len(texts), np.int64) for k in (CAPITAL, SYMBOL, FIRST)}
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        edges = np.unique(self.ends_of)
        for at in range(0, size + 1, SEGMENT):
            part = CLASSES[self.bytes[at : min(at + SEGMENT, size)]]
            cut = np.clip(self.ends_of, at, at + len(part)) - at
            for k, count in self.counts.items():
                upto = np.concatenate([[0], np.cumsum((part & k) != 0, dtype=np.int32)])
                count += upto[cut[1:]] - upto[cut[:-1]]
            here = np.zeros(min(SEGMENT, size + 1 - at), bool)  # the place after the last byte ends a word, too
            here[: len(part)] = part & WORD
            before = np.concatenate([[at > 0 and bool(CLASSES[self.bytes[at - 1]] & WORD)], here[:-1]]) if len(here) else here
            edge = np.zeros(len(here), bool)
            edge[edges[np.searchsorted(edges, at) : np.searchsorted(edges, at + len(here))] - at] = True
            starts.append(np.flatnonzero(here & (~before | edge)) + at)
            ends.append(np.flatnonzero(before & (~here | edge)) + at)
        self.starts = np.concatenate(starts)
        self.sizes = np.concatenate(ends) - self.starts
        self.of = np.searchsorted(self.starts, self.ends_of)
        self.eights = np.ndarray(size + 1, "<u8", self.bytes, strides=(1,))

    def eight(self, words: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of some words, zeros beyond their ends."""
        return self.eights[self.starts[words] + 8 * k] & _TAILS[np.minimum(self.sizes[words] - 8 * k, 8)]

    def hashes(self) -> np.ndarray:
        out = self.sizes.astype(np.uint64) * _ODD
        todo, k = np.arange(len(out)), 0
        while len(todo):
            h = (out[todo] ^ self.eight(todo, k)) * _ODD
            out[todo] = h ^ (h >> np.uint64(29))
            k += 1
            todo = todo[self.sizes[todo] > 8 * k]
        return out

    def equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the words x are the words y, byte by byte."""
        same = self.sizes[x] == self.sizes[y]
        todo, k = np.flatnonzero(same), 0
        while len(todo):
            ok = self.eight(x[todo], k) == self.eight(y[todo], k)
            same[todo[~ok]] = False
            k += 1
            todo = todo[ok & (self.sizes[x[todo]] > 8 * k)]
        return same

    def distinct(self) -> np.ndarray:
        """Number of different words of each text."""
        n = len(self.ends_of) - 1
        count = np.diff(self.of)
        owner = np.repeat(np.arange(n), count)
        bits = max(1, (n - 1).bit_length()) if n else 1
        # the text above, the hash below: one sort orders the hashes of every text
        keys = (owner.astype(np.uint64) << np.uint64(64 - bits)) | (self.hashes() >> np.uint64(bits))
        order = np.argsort(keys)
        again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]]) + 1
        sure = self.equal(order[again], order[again - 1])
        out = count - np.bincount(owner[order[again]], minlength=n)
        for i in np.unique(owner[order[again[~sure]]]):
            at = range(self.of[i], self.of[i + 1])
            out[i] = len({self.bytes[self.starts[w] : self.starts[w] + self.sizes[w]].tobytes() for w in at})
        return out

    def digests(self) -> list[bytes]:
        cut, view = self.ends_of.tolist(), memoryview(self.bytes)
        return [hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _scanned(batches: Iterator[pa.RecordBatch], text: str, new: list[str]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, text, BLOCK_BYTES):
        words = Words(block.column(text))
        made = [np.diff(words.of), words.distinct(), *[words.counts[k] for k in (CAPITAL, SYMBOL, FIRST)]]
        names = block.schema.names
        rest = [(n, block.column(n)) for n in names if n != text]
        yield pa.RecordBatch.from_arrays([*[c for _, c in rest], *[pa.array(m, pa.int64()) for m in made], pa.array(words.digests(), pa.binary())], names=[*[n for n, _ in rest], *new])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without their texts, with n_words, n_distinct, n_capitals, n_symbols, n_chars and digest (of the whole text).

    A column of docs with such a name is left out in favour of the new one.
    """
    new = [x.split()[0] for x in SCANNED.split(", ")]
    docs = docs.select(*[c for c in docs.columns if c not in new or c == text])
    fields = [f for f in docs.schema.fields if f.name != text]
    added = T._parse_datatype_string(SCANNED).fields
    return docs.mapInArrow(lambda b: _scanned(b, text, new), T.StructType([*fields, *added]))


def fails(limits: Limits = Limits()) -> Column:
    """The mask of A to D (bits 0 to 3) of a scanned row."""
    c = F.col
    found = [c("n_words") < limits.words, c("n_distinct") * 100 < c("n_words") * limits.distinct, c("n_capitals") * 100 > c("n_chars") * limits.capitals, c("n_symbols") > 0]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(found)), F.lit(0)).cast("int")


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """part, mask (bits 0 to 4 for A to E), rows, good, toxic: how many rows of each part fail just these filters.

    docs has doc_id, text and the column part; labels has doc_id, quality and toxic.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = scan(rows).select("doc_id", "part", "digest", fails(limits).alias("mask"))
    rows = stored(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("times")), "audited")
    says = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(x) for c, x in (("quality", "good"), ("toxic", "toxic"))])
    no = F.lit(0)
    with_id = rows.where("doc_id is not null").join(says, "doc_id", "left").fillna(0, ["good", "toxic"])
    without = rows.where("doc_id is null").select("part", "mask", no.alias("good"), no.alias("toxic"), F.col("times").alias("n"))
    # a digest's rows shrink to one for each part and label before they meet; the ids within such a row are all different
    each = with_id.groupBy("digest", "part", "mask", "good", "toxic").agg(F.min("doc_id").alias("least"), F.min_by("times", "doc_id").alias("first"), F.sum("times").alias("n"))
    each = each.withColumn("first", F.when(F.col("least") == F.min("least").over(Window.partitionBy("digest")), F.col("first")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    split = each.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", "good", "toxic", "x.n").where("n > 0")
    return split.unionByName(without).groupBy("part", "mask").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def orders(n: int) -> list[tuple[int, ...]]:
    return list(itertools.permutations(range(n)))


def interactions(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """part and AUDITED for every order of the filters and every step of it, from rows like those of masks.

    names has a letter for each bit.  A part has 2^k rows at most, and those are all that its task reads.
    """
    k = len(names)
    if k > 6:
        raise ValueError("at most 6 filters: every order is reported")
    every = orders(k)
    before = np.array([[sum(1 << f for f in o[:i]) for i in range(k)] for o in every]).reshape(-1)
    own = np.array([[1 << f for f in o] for o in every]).reshape(-1)
    all_masks = np.arange(1 << k)
    hit, earlier = (all_masks & own[:, None]) > 0, (all_masks & before[:, None]) > 0
    take = {"kept": ~hit & ~earlier, "removed": hit & ~earlier, "redundant": hit & earlier, "unique_fails": all_masks == own[:, None]}
    texts, steps = np.repeat(["".join(names[f] for f in o) for o in every], k), np.tile(np.arange(1, k + 1), len(every))

    def reduced(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        rows, good, toxic = np.zeros((3, 1 << k), np.int64)
        for target, column in ((rows, "rows"), (good, "good"), (toxic, "toxic")):
            np.add.at(target, found["mask"].to_numpy(), found[column].to_numpy())
        out = {"part": key[0], "filter_order": texts, "step": steps.astype(np.int32)} | {name: m.astype(np.int64) @ rows for name, m in take.items()}
        removed = take["removed"].astype(np.int64)
        out |= {"good_lost": removed @ good, "toxic_lost": removed @ toxic}
        total = np.zeros(1 << k, np.int64)
        np.add.at(total, own, out["removed"])
        return pd.DataFrame(out | {"shapley": total[own]})

    return counts.groupBy("part").applyInPandas(reduced, f"part string, {AUDITED}")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """The five filters over docs, in every order, for each value of part."""
    return interactions(masks(docs, labels, part, limits))
