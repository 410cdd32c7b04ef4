"""Phrase collocation mining with word-id suffix arrays.

Texts are cut into pieces at punctuation and line ends, and phrases stand within a piece.  A block of texts is one array
of word ids (a word of each language has its own) with a stop after each piece.  Prefix doubling sorts its suffixes by
their first words: ranks of one word, then of two, then of four, each by one sort of pairs of ranks.  Neighbours' common
prefixes bound the intervals in which a phrase repeats; an interval's size is the phrase's count in the block.

Only phrases that are frequent in all of a language matter, and their parts are frequent, too.  So there are three passes.
The first counts words and pairs, the second triples of frequent pairs, as 64-bit hashes in packed rows that are
dealt by the hash's first bits and summed; the frequent ones set bits in a bitmap of fixed size.  The third counts words,
pairs, triples and longer phrases of which every part has its bit, as texts, and merges them by language and text.
Clashes of hashes or bits only let more phrases through to the third pass, whose counts are exact.

A text of any length is cut at pieces' ends where it is longer than a block; a single piece stays whole.  Null texts have no words and
null languages are `und`; ids and other columns are not read; a repeated row counts each time.  An empty table, or one
whose phrases are all rare, gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import stored
from tamis.llm.jaccard import small_batches
from tamis.llm.tokens import tokenize, translated

BREAKS = ".,;:!?\n\v\f\r"
#: Lower-cases A-Z, makes every break a line feed and a tab a space.
PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if chr(b) in BREAKS else 32 if b == 9 else b for b in range(256))
LEAST, LONGEST, TOP, COVERED, SCALE = 30, 4, 2000, 80, 2_000_000
#: Bytes of text that are sorted at once, and for which there is one shard of word pairs.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 16 << 20
#: Bits of the map of frequent words and word pairs, as a power of two: 16 MB.
MAP_BITS = 27
UNKNOWN = "und"
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], pa.Array]]:
    """Languages and translated texts of about BLOCK_BYTES together; longer texts in parts that end with a piece."""
    langs, texts, size = [], [], 0
    for batch in batches:
        bodies = translated(batch.column("text"), PIECES).cast(pa.large_binary())
        for lang, body in zip(batch.column("lang"), bodies, strict=True):
            lang, body, at = lang.as_py(), body.as_buffer().to_pybytes(), 0
            while at < len(body):
                end = len(body)
                if end - at > BLOCK_BYTES:
                    end = body.rfind(b"\n", at, at + BLOCK_BYTES) + 1 or (body.find(b"\n", at + BLOCK_BYTES) + 1 or end)
                if size and size + end - at > BLOCK_BYTES:
                    yield langs, pa.array(texts, pa.large_binary()).cast(pa.large_string())
                    langs, texts, size = [], [], 0
                langs.append(lang)
                texts.append(body[at:end])
                size, at = size + end - at, end
    if texts:
        yield langs, pa.array(texts, pa.large_binary()).cast(pa.large_string())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class Block:
    """words[i] is the word of token i; same[i] says that token i + 1 follows it in its piece; lang_of[i] is its language's number."""

    def __init__(self, langs: list[str], texts: pa.Array):
        found = tokenize(texts, PIECES)
        self.names, self.words, self.hashes = found.words, found.ids, found.hashes()
        coded = pa.array(langs).dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang_hashes = pd.util.hash_array(np.array(self.langs, object), categorize=False)
        owner = found.owner()
        self.lang_of = coded.indices.to_numpy()[owner].astype(np.int64)
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        word = (body != 32) & (body != 10)
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = np.unique(ends[:-1][ends[:-1] < len(body)])
        first[heads] = word[heads]
        # breaks before a token and its text's number: both grow together, so their sum names the piece
        piece = np.cumsum(body == 10, dtype=np.int32)[first] + owner
        self.same = np.zeros(len(self.words), bool)
        self.same[:-1] = piece[1:] == piece[:-1]
        # a word of each language by one number
        self.ids = self.lang_of * max(1, len(self.names)) + self.words

    def word_hashes(self, places: np.ndarray) -> np.ndarray:
        """Of the tokens at some places, language included."""
        return self.hashes[self.words[places]] ^ (self.lang_hashes[self.lang_of[places]] * _MIX)

    def gram_hashes(self, n: int) -> np.ndarray:
        """Of each token and the n - 1 next ones, language included; meaningless where fewer follow."""
        own = self.word_hashes(np.arange(len(self.words)))
        h = _mixed(own)
        for k in range(1, min(n, len(own))):
            h[:-k] = _mixed(h[:-k] * _ODD + own[k:])
        return h


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[1], keys[order[1:]] != keys[order[:-1]]])) if len(keys) else 0
    return out


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ids, ordered by their first `depth` (a power of two) ids or more; 0 stands beyond the end."""
    ranks, width = ids, 1
    if ids.max(initial=0) >= 1 << 31:  # pairs of ranks must fit 64 bits; a stop is less than any word and stays 0
        ranks = dense(ids) - (ids.min() == 0)
    while True:
        after = np.zeros_like(ranks)
        after[: max(0, len(ranks) - width)] = ranks[width:]
        keys = ranks * (int(ranks.max(initial=0)) + 1) + after
        width *= 2
        if width >= depth:
            return np.argsort(keys)
        ranks = dense(keys)


def common_prefixes(ids: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place in the order: how many ids, up to most and none a stop, the suffix has in common with the one before it."""
    padded = np.concatenate([ids, np.zeros(most, ids.dtype)])
    out = np.zeros(len(order), np.int64)
    todo = np.arange(1, len(order))
    for k in range(most):
        x = padded[order[todo] + k]
        todo = todo[(x == padded[order[todo - 1] + k]) & (x != 0)]
        out[todo] += 1
    return out


def intervals(order: np.ndarray, common: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A start and the count of each different sequence of n ids without a stop; room: ids from each place to the next stop."""
    full = room[order] >= n
    heads = np.flatnonzero(full & (common < n))
    upto = np.concatenate([[0], np.cumsum(full)])
    return order[heads], upto[np.concatenate([heads[1:], [len(order)]])] - upto[heads] if len(heads) else heads


def with_stops(ids: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, raised by one, with a 0 after each that none follows; the place of each in the old array; and the ids from each to its stop."""
    last = ~follows
    at = np.arange(len(ids)) + np.cumsum(last) - last
    out = np.zeros(len(ids) + int(last.sum()), np.int64)
    out[at] = ids + 1
    back = np.zeros(len(out), np.int64)
    back[at] = np.arange(len(ids))
    stops = np.flatnonzero(out == 0)
    room = stops[np.searchsorted(stops, np.arange(len(out)))] - np.arange(len(out)) if len(out) else out
    return out, back, room


_GRAMS = "shard int, hashes binary, counts binary"


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - MAP_BITS)
    return ((bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)


def _runs(block: Block, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """with_stops of the tokens that follow another or are followed; places are the block's."""
    used = follows | np.concatenate([[False], follows[:-1]])
    ids, back, room = with_stops(block.ids[used], follows[used])
    return ids, np.flatnonzero(used)[back] if len(back) else back, room


def _grams(batches: Iterator[pa.RecordBatch], shard_bits: int, n: int, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Counts of each block's sequences of n words, by shard: of two words (and of single ones), or of more of which every pair has its bit."""
    for langs, texts in _blocks(batches):
        block = Block(langs, texts)
        ids, back, room = _runs(block, block.same if bitmap is None else block.same & _marked(bitmap, block.gram_hashes(2)))
        order = suffix_array(ids, n)
        starts, counts = intervals(order, common_prefixes(ids, order, n), room, n)
        hashes = block.gram_hashes(n)[back[starts]]
        if bitmap is None:
            _, places, times = np.unique(block.ids, return_index=True, return_counts=True)
            hashes, counts = np.concatenate([block.gram_hashes(1)[places], hashes]), np.concatenate([times, counts])
        by = np.argsort(hashes)
        hashes, counts = hashes[by], counts[by].astype(np.uint32)
        bounds = np.searchsorted(hashes >> np.uint64(63 - shard_bits), np.arange(0, (1 << shard_bits) * 2 + 1, 2, dtype=np.uint64)) if len(hashes) else np.zeros((1 << shard_bits) + 1, int)
        full = np.flatnonzero(np.diff(bounds))
        cut = [(int(bounds[s]), int(bounds[s + 1])) for s in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([hashes[x:y].tobytes() for x, y in cut], pa.binary()), pa.array([counts[x:y].tobytes() for x, y in cut], pa.binary())], names=["shard", "hashes", "counts"])


def _frequent(batches: Iterator[pa.RecordBatch], shard_bits: int, least: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shard: each shard's part of the bitmap, packed."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    shard = -1

    def folded() -> pa.RecordBatch:
        hashes = np.concatenate([h for h, _ in held])
        order = np.argsort(hashes)
        hashes, counts = hashes[order], np.concatenate([c for _, c in held])[order].astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        often = hashes[heads][np.add.reduceat(counts, heads) >= least]
        bits = np.zeros(1 << (MAP_BITS - shard_bits), np.uint8)
        bits[((often >> np.uint64(64 - MAP_BITS)) & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["shard", "bits"])

    for batch in batches:
        for k, h, c in zip(batch.column("shard").to_pylist(), batch.column("hashes"), batch.column("counts"), strict=True):
            if k != shard:
                if held:
                    yield folded()
                held, shard = [], k
            held.append((np.frombuffer(h.as_py(), np.uint64), np.frombuffer(c.as_py(), np.uint32)))
    if held:
        yield folded()


def _phrases(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase, n of each block: words, pairs and longer phrases of which all words, pairs and triples have their bits, and '' for the number of all words."""
    for langs, texts in _blocks(batches):
        block = Block(langs, texts)

        def rows(places: np.ndarray, words: int, counts: np.ndarray, block: Block = block) -> pa.RecordBatch:
            column = lambda k: block.names.take(pa.array(block.words[places + k]))
            phrase = column(0) if words == 1 else pc.binary_join_element_wise(*[column(k) for k in range(words)], pa.scalar(" ", pa.large_string()))
            return batch_of(pa.array(block.langs, pa.string()).take(pa.array(block.lang_of[places])), phrase, counts)

        def batch_of(lang: pa.Array, phrase: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "n"])

        per_lang = np.bincount(block.lang_of, minlength=len(block.langs))
        yield batch_of(pa.array(block.langs, pa.string()), pa.array([""] * len(block.langs)), per_lang)
        _, places, counts = np.unique(block.ids, return_index=True, return_counts=True)
        often = _marked(bitmap, block.gram_hashes(1)[places])
        yield rows(places[often], 1, counts[often])
        ids, back, room = _runs(block, block.same & _marked(bitmap, block.gram_hashes(2)))
        if not len(ids):
            continue
        triples = np.concatenate([_marked(bitmap, block.gram_hashes(3)), np.zeros(longest, bool)])
        order = suffix_array(ids, longest)
        common = common_prefixes(ids, order, longest)
        for words in range(2, longest + 1):
            starts, counts = intervals(order, common, room, words)
            places = back[starts]
            for k in range(words - 2):
                often = triples[places + k]
                places, counts = places[often], counts[often]
            if len(places):
                yield rows(places, words, counts)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, phrase, n of all words and phrases of up to `longest` words that occur at least `least` times, and the number of words as phrase ''."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).where("text is not null")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shard_bits = min(MAP_BITS - 3, max(0, (int(size) // SHARD_BYTES).bit_length()))
    with small_batches(spark):
        shared = None
        for n in (2, 3)[: max(1, longest - 1)]:
            bitmap = np.zeros(1 << (MAP_BITS - 3), np.uint8) if shared is None else shared.value.copy()
            dealt = docs.mapInArrow(lambda b, n=n, shared=shared: _grams(b, shard_bits, n, shared and shared.value), _GRAMS).repartition("shard").sortWithinPartitions("shard")
            # of fixed size for any corpus: each shard's part of the bitmap
            found = dealt.mapInArrow(lambda b: _frequent(b, shard_bits, least), "shard int, bits binary").toArrow()
            part = len(bitmap) >> shard_bits
            for shard, bits in zip(found.column("shard").to_pylist(), found.column("bits").to_pylist(), strict=True):
                bitmap[shard * part : (shard + 1) * part] |= np.frombuffer(zlib.decompress(bits), np.uint8)
            shared = spark.sparkContext.broadcast(bitmap)
        rows = docs.mapInArrow(lambda b: _phrases(b, shared.value, longest), "lang string, phrase string, n long")
        return stored(rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == "")), "phrases")


def _exact(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, scale: int = SCALE, **how: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases.

    score is the least floor(scale * a / (l + r)) over the ways of cutting a phrase in two.  A phrase that stands in a
    longer one with at least `covered` hundredths of its count is left out.
    """
    counts = phrase_counts(docs, least, longest, **how)
    parts = F.split("phrase", " ")
    some = counts.where("phrase <> ''").withColumns({"parts": parts, "words": F.size(parts)})
    longer = some.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), "parts", "words")
    sub = lambda at, size: F.array_join(F.slice("parts", at, size), " ")
    # every way to cut in two, with the counts of both parts
    cuts = longer.select("lang", "phrase", "a", "parts", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", sub(F.lit(1), F.col("k")).alias("left"), sub(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr(f"cast({scale} as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")).select("lang", "phrase", "a", "cut.*")
    # the most frequent longer phrase around each
    inner = longer.where("words > 2").select("lang", "a", "parts", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "parts", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    around = inner.select("lang", sub(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (_exact(F.col("around")) * 100 < _exact(F.col("a")) * covered))
    # the first of each language's shares, then of all
    by = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(16))
    first = left.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*by))).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    total = counts.where("phrase = ''").select("lang", F.col("n").alias("total"))
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
