"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words: A-Z lower-cased, then runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`.  A test item's windows are its n-grams of
`width` words, or the whole item where it has fewer; an item without words has none.  Rolling hashes of a document's
windows are looked up in a bitmap, then in the sorted hashes, and each hit is verified word by word.

Windows are places in the items' words, 20 bytes each.  The index is read, built and broadcast in parts of at most
`max_windows` windows and `MAX_BYTES` of text (or one longer item): a larger benchmark takes more passes over the
documents, each adding to the spans found before, so memory is bounded and no window is dropped.  Spans are cut from the
texts after the last pass.

Null or empty texts have no words and no hits; null item texts have no windows; repeated rows each give a row; item ids
are compared as text; rows without an id count for hits and removal and are in no list of items; columns of either table
beyond the named ones are ignored by `find_leaks` and kept by `decontaminate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import keep
from tamis.llm.tokens import WORDS, blocks, tokenize

WIDTH = 10
MAX_WINDOWS = 1_000_000
MAX_BYTES = 32 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_SPANS = "array<struct<start:int,stop:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _roll(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * _PRIME + hashes[j : j + n]
    return out


class WindowIndex:
    """The windows of (item id, text) pairs by length: a bitmap over hashes, sorted hashes, and where in the items' words each is."""

    def __init__(self, items: list[tuple[str | None, str]], width: int = WIDTH):
        tokens = tokenize(pa.array([t for _, t in items], pa.large_string()), WORDS)
        self.names, self.words, self.ids = [i for i, _ in items], tokens.words.to_pylist(), tokens.ids.astype(np.int32)
        hashes, n = tokens.hashes()[tokens.ids], np.diff(tokens.starts)
        self.hashes: dict[int, np.ndarray] = {}
        self.places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.bitmap: dict[int, np.ndarray] = {}
        self.n = int(np.where(n > 0, np.maximum(1, n - width + 1), 0).sum())
        for w in np.unique(np.minimum(n[n > 0], width)).tolist():
            of = np.nonzero(n >= w if w == width else n == w)[0]
            each = n[of] - w + 1
            item = np.repeat(of, each)
            at = np.repeat(tokens.starts[of] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            h = _roll(hashes, w)[at]
            order = np.argsort(h, kind="stable")
            self.hashes[w], self.places[w] = h[order], (at[order], item[order].astype(np.int32))
            self.bitmap[w] = np.zeros(1 << _BITS, bool)
            self.bitmap[w][h >> np.uint64(64 - _BITS)] = True

    def items(self, words: tuple[str, ...], width: int, h: np.uint64) -> set[str | None]:
        """The ids of the items that hold these words as a window."""
        first, last = np.searchsorted(self.hashes[width], [h, h], side="left")[0], np.searchsorted(self.hashes[width], h, side="right")
        at, item = self.places[width]
        same: dict[tuple[int, ...], bool] = {}
        out = set()
        for k in range(int(first), int(last)):
            ids = tuple(self.ids[at[k] : at[k] + width].tolist())
            if ids not in same:
                same[ids] = tuple(self.words[i] for i in ids) == words
            if same[ids]:
                out.add(self.names[item[k]])
        return out


def parts(benchmark: DataFrame, width: int, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> Iterator[WindowIndex]:
    """Indexes of the benchmark's items, one after the other; one of no windows where there are none."""
    part: list[tuple[str | None, str]] = []
    windows, size, some = 0, 0, False
    for item, text in benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text").toLocalIterator():
        part.append((item, text))
        size += len(text)
        windows += max(1, len(text) // 2 - width)  # at most: a word and a separator take two characters
        if windows >= max_windows or size >= max_bytes:
            index = WindowIndex(part, width)
            if index.n >= max_windows or size >= max_bytes:
                yield index
                part, windows, size, some = [], 0, 0, True
            else:
                windows = index.n
    if part or not some:
        yield WindowIndex(part, width)


def _scan(batches: Iterator[pa.RecordBatch], index: WindowIndex, texts: bool = True) -> Iterator[pa.RecordBatch]:
    known_items: dict[tuple[str, ...], set[str | None]] = {}  # of the windows met so far
    for batch in blocks(batches):
        tokens = tokenize(batch.column("text"), WORDS)
        hashes, owner, names = tokens.hashes()[tokens.ids], tokens.owner(), None
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for width in index.hashes:
            h = _roll(hashes, width)
            at = np.nonzero(index.bitmap[width][h >> np.uint64(64 - _BITS)])[0]
            at = at[owner[at] == owner[at + width - 1]]
            known = index.hashes[width]
            at = at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]]
            for k in at.tolist():
                names = names or tokens.words.to_pylist()
                words = tuple(names[j] for j in tokens.ids[k : k + width])
                found = known_items.get(words)
                if found is None:
                    found = known_items[words] = index.items(words, width, h[k])
                if found:
                    i = int(owner[k])
                    spans.setdefault(i, []).append((k - int(tokens.starts[i]), k - int(tokens.starts[i]) + width))
                    items.setdefault(i, set()).update(x for x in found if x is not None)
        old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        all_spans = [_merged([(x["start"], x["stop"]) for x in old or ()] + spans.get(i, [])) for i, old in enumerate(old_spans)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *([batch.column("text")] if texts else []),
                pa.array(np.diff(tokens.starts), pa.int64()),
                pa.array([[{"start": a, "stop": b} for a, b in x] for x in all_spans], _SPAN_TYPE),
                pa.array([sorted({*(old or ()), *items.get(i, ())}) for i, old in enumerate(old_items)], pa.list_(pa.string())),
            ],
            names=["doc_id", *(["text"] if texts else []), "n_words", "spans", "items"],
        )


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS, texts: bool = True) -> DataFrame:
    """doc_id, text (with texts), n_words, spans (word ranges inside occurring windows, merged), items (sorted ids) of each document."""
    spark = docs.sparkSession
    out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(_SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items"))

    def scanned(out: DataFrame, index: WindowIndex, texts: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)
        return out.mapInArrow(lambda batches: _scan(batches, sent.value, texts), out.schema if texts else out.drop("text").schema)

    last: WindowIndex | None = None
    for index in parts(benchmark, width, max_windows):
        if last is not None:
            out = keep(scanned(out, last, True))
        last = index
    return scanned(out, last, texts)


def report(found: DataFrame) -> DataFrame:
    """The digest of find_leaks: counts, the item digest, and whether anything was hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["stop"] - x["start"]))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _spanned(batches: Iterator[pa.RecordBatch], index: WindowIndex, text: str, spans: str | None) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int]]]]]:
    """Rows with the spans found in them, and those of earlier passes in the column spans."""
    for batch in blocks(batches, text):
        n = batch.num_rows
        old = batch.column(spans) if spans else pa.nulls(n, _SPAN_TYPE)
        view = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), batch.column(text), pa.array(np.zeros(n, np.int64)), old, pa.nulls(n, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "spans", "items"])
        for found in _scan(iter([view]), index, False):
            yield batch.take(found.column("doc_id")), [[(s["start"], s["stop"]) for s in x] for x in found.column("spans").to_pylist()]


def _without_hits(batches: Iterator[pa.RecordBatch], index: WindowIndex, text: str) -> Iterator[pa.RecordBatch]:
    for rows, hit in _spanned(batches, index, text, None):
        yield rows.filter(pa.array([not x for x in hit], pa.bool_()))


def _with_spans(batches: Iterator[pa.RecordBatch], index: WindowIndex, text: str, spans: str) -> Iterator[pa.RecordBatch]:
    for rows, hit in _spanned(batches, index, text, spans):
        yield rows.set_column(rows.schema.get_field_index(spans), spans, pa.array([[{"start": a, "stop": b} for a, b in x] for x in hit], _SPAN_TYPE))


def _cut(batches: Iterator[pa.RecordBatch], index: WindowIndex, text: str, spans: str) -> Iterator[pa.RecordBatch]:
    for rows, hit in _spanned(batches, index, text, spans):
        texts = [cut_spans(t, x) if x else t for t, x in zip(rows.column(text).to_pylist(), hit, strict=True)]
        yield rows.set_column(rows.schema.get_field_index(text), rows.schema.field(text), pa.array(texts, rows.schema.field(text).type)).drop_columns([spans])


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the characters from the first to the last word of each span of words."""
    import re

    words = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text", remove: str = "documents", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs, all columns, without the contaminated documents, or with contaminated spans cut from the texts (remove='spans')."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    spark, spans = docs.sparkSession, f"spans_{len(docs.columns)}_{'_'.join(docs.columns)}"  # no column of docs
    out = docs if remove == "documents" else docs.withColumn(spans, F.lit(None).cast(_SPANS))

    def passed(out: DataFrame, index: WindowIndex, last: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)
        if remove == "documents":
            return out.mapInArrow(lambda batches: _without_hits(batches, sent.value, text), out.schema)
        if last:
            return out.mapInArrow(lambda batches: _cut(batches, sent.value, text, spans), docs.schema)
        return out.mapInArrow(lambda batches: _with_spans(batches, sent.value, text, spans), out.schema)

    before: WindowIndex | None = None
    for index in parts(benchmark, width, max_windows):
        if before is not None:
            out = keep(passed(out, before, False))
        before = index
    return passed(out, before, True)


def item_digest(items: list[str]) -> str:
    """The digest of report for a list of item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
