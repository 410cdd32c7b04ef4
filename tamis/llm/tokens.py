"""Vectorised tokenisation of Arrow string columns.

A table of 256 bytes lower-cases A-Z and turns separators to spaces over the whole data buffer at once; bytes of
multi-byte characters stay, so offsets stay true.  Whole texts are processed, in blocks bounded by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Lower-cases A-Z only; tokens then are runs of bytes other than \x20 and \x09-\x0D.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and makes all ASCII but a-z and 0-9 a space; bytes of other characters belong to words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
BLOCK_BYTES = 8 << 20


@dataclass
class Tokens:
    """ids index words; the tokens of text i are ids[starts[i]:starts[i + 1]]."""

    ids: np.ndarray
    starts: np.ndarray
    words: pa.Array

    def hashes(self) -> np.ndarray:
        """64-bit hash of each distinct word."""
        if not len(self.words):
            return np.zeros(0, np.uint64)
        return pd.util.hash_array(np.array(self.words.to_pylist(), dtype=object), categorize=False)

    def owner(self) -> np.ndarray:
        """For each token the number of its text."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in slices of about limit bytes of text or of one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def plain(texts: pa.Array) -> pa.Array:
    """Nulls as empty, one string array whose buffers start at its first row."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """texts with each byte replaced by its entry in table."""
    texts = plain(texts)
    _, offsets, data = texts.buffers()
    body = data.to_pybytes().translate(table) if data is not None else b""
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(body), None, 0, texts.offset)


def tokenize(texts: pa.Array, table: bytes) -> Tokens:
    lists = pc.ascii_split_whitespace(translated(texts, table))
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return Tokens(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, coded.dictionary)
