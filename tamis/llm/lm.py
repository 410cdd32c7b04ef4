"""Language model scoring with Elias-Fano n-gram tries.

Tokens are runs of `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, then one end; training counts come from rows
that are not held out.  A bigram model with absolute discounting, interpolated with Good-Turing unigrams:

    P(w | v) = max(c(v w) - D, 0) / c(v) + D * T(v) / c(v) * P1(w)      T(v): distinct successors of v
    P1(w)    = (1 - p0) * c(w) / N for known words, p0 for the unknown word      p0 = (words seen once + 1) / (N + 1)

Where v was not seen, P1 alone; before the first token v is a start mark.  The model grows with the corpus, so it is not
sent to every task: it lives in shards.  Texts are coded once in batches (word hashes, and numbers into them).  Each batch
sends its distinct bigrams, with the training counts of bigrams and contexts, to shards by context.  A shard adds the
counts and builds its trie: Elias-Fano levels of contexts and successors, with 8-bit codes of the discounted probabilities
(c(v w) - D) / c(v) and of the backoff weights D * T(v) / c(v).  The trie is written to a file, mapped, and asked for every
bigram and context of the batches; only codes go back.  Words go through shards in the same way for c, N and the base
score.  Batches then meet their answers and score their texts.  What moves is in proportion to the distinct bigrams of
the batches, so to the corpus.

Contexts that a bounded sample of batches shows to be frequent are dealt over several shards by a part of the successor's
hash, in proportion to their share of the tokens and the number of shards; their counts go to each of these, and their
weights are sums over them.  The sample decides where a context lives and not what it says.

`score(docs, save=path)` also stores the model under path; `score_with(docs, path)` scores other texts by it, with each
shard's trie mapped where its questions arrive.

Codes are steps of 0.04 in log10, so a probability is within 4.7 % of the one it stands for.  Successors have 32-bit
fingerprints within their context: two successors of one context share one with a chance of T(v)^2 / 2^33.  Words are told
apart by 64-bit hashes.

Null and empty texts are one end token.  Rows without an id are scored and learned from (they are not held out).  With no
training rows all words are unknown.  Repeated rows each give a row.  Other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import held_out, stored
from tamis.llm.ngram_trie import NgramTrie
from tamis.llm.tokens import LOWERED, blocks, tokenize

DISCOUNT = 0.75
BATCH_BYTES = 8 << 20
#: Distinct bigrams of batches in one shard.
SHARD = 1_000_000
#: Batches that are looked at for frequent contexts, how many of these there can be, and the shards that one can be dealt over.
SAMPLE_BATCHES, MOST_FREQUENT, MOST_PARTS = 64, 1000, 256
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: Decades that the codes cover, and log10 of a step.
DECADES = 10
STEP = DECADES / 254
#: The probability that each code stands for; 0 for 0.
VALUES = np.r_[0.0, 10.0 ** (-STEP * np.arange(255))]


def quantise(p: np.ndarray) -> np.ndarray:
    """8-bit codes of probabilities, in even steps of their logarithm; 0 for 0."""
    p = np.asarray(p, float)
    return np.where(p > 0, 1 + np.clip(np.rint(-np.log10(np.where(p > 0, p, 1)) / STEP), 0, 254), 0).astype(np.uint8)


class Spread:
    """How many shards each frequent context is dealt over; hashes are sorted."""

    def __init__(self, hashes: np.ndarray, parts: np.ndarray, shards: int):
        self.hashes, self.parts, self.shards = hashes, parts, shards

    def of(self, contexts: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(contexts), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, contexts), len(self.hashes) - 1)
        return np.where(self.hashes[at] == contexts, self.parts[at], 1)

    def shard(self, contexts: np.ndarray, part: np.ndarray) -> np.ndarray:
        spread = (contexts + part.astype(np.uint64) * _A) * _B
        return ((spread >> np.uint64(32)) % np.uint64(self.shards)).astype(np.int64)


class Batch:
    """Coded texts: hashes of the distinct words (start and end first), words of each text one after another, and lengths."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray, lengths: np.ndarray, held: np.ndarray):
        self.hashes, self.lengths, self.held = hashes, lengths, held
        n = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        self.cur = np.ones(len(words) + n, np.int32)
        inner = np.ones(len(self.cur), bool)
        inner[ends] = False
        self.cur[inner] = words
        self.prev = np.concatenate([np.zeros(1, np.int32), self.cur[:-1]])
        self.prev[ends - lengths] = 0
        self.owner = np.repeat(np.arange(n, dtype=np.int32), lengths + 1)
        self.train = ~held[self.owner]

    def bigrams(self, spread: Spread) -> dict:
        """The distinct bigrams in order of shard and context, the number of that bigram for each token, and the contexts of each shard with the bigrams they have there."""
        key, inverse = np.unique(self.prev.astype(np.int64) * len(self.hashes) + self.cur, return_inverse=True)
        count = np.bincount(inverse[self.train], minlength=len(key))
        context, word = key // len(self.hashes), key % len(self.hashes)
        mixed = self.hashes[word] * _B
        parts = spread.of(self.hashes)
        shard = spread.shard(self.hashes[context], (mixed >> np.uint64(24)) % parts[context].astype(np.uint64))
        # keys rise by context, so a stable sort by shard leaves whole runs of a context
        order = np.argsort(shard.astype(np.uint16) if spread.shards < 1 << 16 else shard, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        shard, context = shard[order], context[order]
        first = np.nonzero(np.r_[True, (shard[1:] != shard[:-1]) | (context[1:] != context[:-1])])[0]
        size = np.diff(np.r_[first, len(shard)])
        # a frequent context also tells its count where it has no bigram
        many = np.unique(self.prev)
        many = many[parts[many] > 1]
        other = np.repeat(many, parts[many])
        part = np.arange(len(other)) - np.repeat(np.cumsum(parts[many]) - parts[many], parts[many])
        place = np.unique(np.stack([spread.shard(self.hashes[other], part), other]), axis=1) if len(other) else np.zeros((2, 0), np.int64)
        known = np.stack([shard[first], context[first]])
        n = np.int64(len(self.hashes))
        place = place[:, ~np.isin(place[0] * n + place[1], known[0] * n + known[1])]
        shards, contexts, sizes = np.r_[known[0], place[0]], np.r_[known[1], place[1]], np.r_[size, np.zeros(place.shape[1], np.int64)]
        by = np.argsort(shards, kind="stable")
        seen = np.bincount(self.prev[self.train], minlength=len(self.hashes))
        return {
            "shard": shard, "mark": (mixed >> np.uint64(32)).astype(np.uint32)[order], "count": count[order], "of_token": rank[inverse],
            "context_shard": shards[by], "context": contexts[by], "size": sizes[by], "seen": seen[contexts[by]],
        }

    def words(self, shards: int) -> dict:
        """The distinct words in order of shard, with their training counts."""
        count = np.bincount(self.cur[self.train], minlength=len(self.hashes))
        count[0] = (~self.held).sum()  # a start before each text
        shard = ((self.hashes * _B >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return {"shard": shard[order], "hash": self.hashes[order], "count": count[order], "order": order}


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24
    for block in blocks(batches, limit=BATCH_BYTES):
        tokens = tokenize(block.column("text"), LOWERED)
        # the numbers 0 and 1 stand for start and end
        hashes = np.concatenate([[START, END], tokens.hashes()]).astype(np.uint64)
        n = block.num_rows
        ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([block.column("doc_id")]))
        held = block.column("held_out").to_numpy(zero_copy_only=False)
        row = [hashes.tobytes(), (tokens.ids + 2).astype(np.uint32).tobytes(), np.diff(tokens.starts).astype(np.uint32).tobytes(), held.astype(np.uint8).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([number]), ids, *(pa.array([x], pa.binary()) for x in row)], names=["batch", "ids", "hashes", "words", "lengths", "held"])
        number += 1


def _batch(row: dict) -> Batch:
    return Batch(
        np.frombuffer(row["hashes"], np.uint64),
        np.frombuffer(row["words"], np.uint32).astype(np.int32),
        np.frombuffer(row["lengths"], np.uint32).astype(np.int64),
        np.frombuffer(row["held"], np.uint8).astype(bool),
    )


def _cuts(shard: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.nonzero(np.diff(shard))[0] + 1, [len(shard)]])


_ASK = ["shard", "batch", "kind", "keys", "sizes", "values"]
_ASK_TYPES = "shard long, batch long, kind int, keys binary, sizes binary, values binary"


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_ASK)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent contexts of each batch, and its number of tokens under a key of null."""
    for batch in batches:
        for row in batch.to_pylist():
            b = _batch(row)
            n = np.bincount(b.prev, minlength=len(b.hashes))
            top = np.argsort(-n, kind="stable")[: 2 * MOST_FREQUENT]
            yield pa.RecordBatch.from_arrays([pa.array([None, *b.hashes[top].view(np.int64).tolist()], pa.int64()), pa.array([int(n.sum()), *n[top].tolist()], pa.int64())], names=["hash", "n"])


def _ask_bigrams(batches: Iterator[pa.RecordBatch], spread: Spread) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            made = _batch(row)
            b = made.bigrams(spread)
            cut, ends = _cuts(b["context_shard"]), np.r_[0, np.cumsum(b["size"])]
            rows = []
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                p, q = ends[x], ends[y]
                sizes = np.concatenate([b["size"][x:y], b["seen"][x:y]]).astype(np.uint32)
                values = np.concatenate([b["mark"][p:q], b["count"][p:q].astype(np.uint32)])
                rows.append((int(b["context_shard"][x]), row["batch"], 0, made.hashes[b["context"][x:y]].tobytes(), sizes.tobytes(), values.tobytes()))
            yield _asked(rows)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    by: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            by.setdefault(row["shard"], []).append(row)
    for shard in sorted(by):
        yield by.pop(shard)


_TOLD_TYPES = "batch long, shard long, kind int, keys binary, values binary"


def _told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["batch", "shard", "kind", "keys", "values"])


def shard_trie(contexts: tuple[np.ndarray, np.ndarray], v: np.ndarray, mark: np.ndarray, count: np.ndarray, discount: float = DISCOUNT) -> NgramTrie:
    """The trie of all bigrams (v, mark) with a training count, from contexts (hash, training count) and bigrams that may repeat."""
    names, code = np.unique(contexts[0], return_inverse=True)
    total = np.bincount(code, weights=contexts[1], minlength=len(names))
    seen = count > 0
    v, mark, count = v[seen], mark[seen], count[seen]
    order = np.lexsort((mark, v))
    v, mark, count = v[order], mark[order], count[order]
    new = np.nonzero(np.r_[True, (v[1:] != v[:-1]) | (mark[1:] != mark[:-1])])[0] if len(v) else np.zeros(0, np.int64)
    count = np.add.reduceat(count, new) if len(new) else count
    v, mark = v[new], mark[new]
    first = np.nonzero(np.r_[True, v[1:] != v[:-1]])[0] if len(v) else np.zeros(0, np.int64)
    successors = np.diff(np.r_[first, len(v)])
    of = total[np.searchsorted(names, v[first])] if len(v) else np.zeros(0)
    return NgramTrie.build(v, [mark], quantise((count - discount) / np.repeat(of, successors)), quantise(np.minimum(1.0, discount * successors / np.maximum(of, 1))))


def _answer_bigrams(batches: Iterator[pa.RecordBatch], learn: bool, save: bool) -> Iterator[pa.RecordBatch]:
    """Codes of the contexts and bigrams that batches ask for, from the trie of their own counts (learn) or from the stored one (kind 2); with save, the trie too."""
    for rows in _by_shard(batches):
        packed = next((r["values"] for r in rows if r["kind"] == 2), None)
        rows = [r for r in rows if r["kind"] == 0]
        parts = []
        for r in rows:
            v = np.frombuffer(r["keys"], np.uint64)
            size, seen = np.frombuffer(r["sizes"], np.uint32).reshape(2, -1)
            mark, count = np.frombuffer(r["values"], np.uint32).reshape(2, -1)
            parts.append((v, seen, np.repeat(v, size), mark, count))
        if packed is None:
            none = [np.zeros(0, t) for t in (np.uint64, np.uint32, np.uint64, np.uint32, np.uint32)]
            v, seen, bigrams, mark, count = (np.concatenate(x) for x in zip(*parts, strict=True)) if learn else none
            packed = shard_trie((v, seen), bigrams, mark, count.astype(np.int64)).pack()
        with tempfile.NamedTemporaryFile() as f:
            f.write(packed)
            f.flush()
            trie = NgramTrie.open(f.name)
            out = [(-1, rows[0]["shard"], 2, None, packed)] if save else []
            del packed
            for r, (v, _, bigrams, mark, _) in zip(rows, parts, strict=True):
                out.append((r["batch"], r["shard"], 0, None, trie.weight(v).tobytes() + trie.lookup(bigrams, [mark]).tobytes()))
            if out:
                yield _told(out)


def _ask_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            b = _batch(row).words(shards)
            cut = _cuts(b["shard"])
            yield _asked([(int(b["shard"][x]), row["batch"], 0, b["hash"][x:y].tobytes(), None, b["count"][x:y].astype(np.uint32).tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)])


def _answer_words(batches: Iterator[pa.RecordBatch], learn: bool, save: bool) -> Iterator[pa.RecordBatch]:
    """c of the words that batches ask for, and the totals of each shard (kind 1), from their own counts (learn) or the stored ones (kind 2); with save, the counts too."""
    for rows in _by_shard(batches):
        known = rows if learn else [r for r in rows if r["kind"] == 2]
        names, code = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in known)]), return_inverse=True)
        value = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["values"], np.uint32 if learn else np.int64).astype(np.int64) for r in known)])
        c = np.zeros(len(names) + 1, np.int64)
        np.add.at(c, code, value)
        own = c[:-1][names != START]
        out = [(-1, rows[0]["shard"], 1, None, np.array([own.sum(), (own > 0).sum(), (own == 1).sum()], np.int64).tobytes())]
        if save:
            seen = c[:-1] > 0
            out.append((-1, rows[0]["shard"], 2, names[seen].tobytes(), c[:-1][seen].tobytes()))
        for r in rows:
            if r["kind"] == 0:
                k = np.frombuffer(r["keys"], np.uint64)
                at = np.minimum(np.searchsorted(names, k), max(0, len(names) - 1))
                out.append((r["batch"], r["shard"], 0, None, np.where(names[at] == k, c[at], 0).tobytes() if len(names) else np.zeros(len(k), np.int64).tobytes()))
        yield _told(out)


def score_batch(batch: Batch, bigrams: dict, codes: list[np.ndarray], words: dict, answer: list[np.ndarray], totals: tuple[int, int, int]) -> dict:
    """Columns of the texts of a batch, from the codes of its contexts and bigrams and c of its words, by shard."""
    n_all, n_distinct, n_once = totals
    c = np.zeros(len(batch.hashes), np.int64)
    c[words["order"]] = np.concatenate(answer)
    cut = _cuts(bigrams["context_shard"])
    cut = list(zip(cut[:-1], cut[1:], strict=True))
    weights = np.concatenate([x[: b - a] for x, (a, b) in zip(codes, cut, strict=True)])
    found = np.concatenate([x[b - a :] for x, (a, b) in zip(codes, cut, strict=True)])
    backoff = np.bincount(bigrams["context"], weights=VALUES[weights], minlength=len(batch.hashes))
    p0 = (n_once + 1) / (n_all + 1)
    p1 = np.where(c > 0, (1 - p0) * c / max(n_all, 1), p0)
    base = np.log10((c + 0.1) / (n_all + 0.1 * (n_distinct + 1)))
    weight = np.where(c > 0, np.minimum(1.0, backoff), 1.0)
    logp = np.log10(np.minimum(1.0, VALUES[found[bigrams["of_token"]]] + weight[batch.prev] * p1[batch.cur]))
    n = len(batch.lengths)
    total = lambda x: np.bincount(batch.owner, weights=x, minlength=n)
    return {"n_tokens": batch.lengths + 1, "n_known": total((c[batch.cur] > 0).astype(float)).astype(np.int64), "base_score": total(base[batch.cur]), "score": total(logp)}


def _scored(table: pa.Table, totals: tuple[int, int, int], spread: Spread, shards: int, id_type: pa.DataType) -> pa.Table:
    rows = {0: [], 1: [], 2: []}
    for r in table.to_pylist():
        rows[r["kind"]].append(r)
    out = []
    for row in rows[0]:
        batch = _batch(row)
        codes, answer = ([np.frombuffer(r["values"], t) for r in sorted(rows[k], key=lambda r: r["shard"])] for k, t in ((1, np.uint8), (2, np.int64)))
        found = score_batch(batch, batch.bigrams(spread), codes, batch.words(shards), answer, totals)
        ids = pa.array(row["ids"], id_type)
        out.append(pa.table({"doc_id": ids, "held_out": pa.array(batch.held), "n_tokens": found["n_tokens"], "n_known": found["n_known"], "train_tokens": np.full(len(ids), totals[0]), "base_score": found["base_score"], "score": found["score"]}))
    return pa.concat_tables(out)


_COLUMNS = ["batch", "hashes", "words", "lengths", "held"]


def _batches(docs: DataFrame, mod: int, remainder: int) -> DataFrame:
    rows = docs.select("doc_id", held_out("doc_id", mod, remainder).alias("held_out"), "text")
    return stored(rows.mapInArrow(_coded, f"batch long, ids array<{rows.schema['doc_id'].dataType.simpleString()}>, hashes binary, words binary, lengths binary, held binary"), "lm-batches")


def _plan(coded: DataFrame) -> tuple[Spread, int]:
    """Where contexts live, and the number of shards of words."""
    size = coded.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)), F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0)), F.count("*")).first()
    least = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = (max(least, -(-size[0] // 4 // SHARD)), max(least, -(-size[1] // 8 // SHARD)))
    part = 1 << 20
    some = coded.where(F.pmod(F.xxhash64("batch"), F.lit(part)) < int(part * min(1.0, SAMPLE_BATCHES / max(1, size[2]))))
    top = some.select(*_COLUMNS).mapInArrow(_frequent, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.col("hash").isNull().desc(), F.desc("n"), "hash").limit(MOST_FREQUENT + 1).collect()
    tokens = sum(r["n"] for r in top if r["hash"] is None)
    frequent = sorted((r["hash"] % (1 << 64), min(MOST_PARTS, -(-4 * r["n"] * shards[0] // max(1, tokens)))) for r in top if r["hash"] is not None)
    frequent = [(h, n) for h, n in frequent if n > 1]
    return Spread(np.array([h for h, _ in frequent], np.uint64), np.array([n for _, n in frequent], np.int64), shards[0]), shards[1]


def _run(coded: DataFrame, spread: Spread, n_words: int, id_name: str, tries: DataFrame | None = None, counts: DataFrame | None = None, save: str | None = None) -> DataFrame:
    """The scores of coded texts, by the model of their own counts or by a stored one."""
    spark, learn, keep_ = coded.sparkSession, tries is None, save is not None
    blank = {"batch": F.lit(-1).cast("long"), "kind": F.lit(2), "sizes": F.lit(None).cast("binary")}
    asked = coded.select(*_COLUMNS).mapInArrow(lambda b: _ask_bigrams(b, spread), _ASK_TYPES)
    words = coded.select(*_COLUMNS).mapInArrow(lambda b: _ask_words(b, n_words), _ASK_TYPES)
    if not learn:
        asked = asked.unionByName(tries.withColumns({**blank, "keys": F.lit(None).cast("binary")}))
        words = words.unionByName(counts.withColumns(blank))
    told = stored(asked.repartition(spread.shards, "shard").mapInArrow(lambda b: _answer_bigrams(b, learn, keep_), _TOLD_TYPES), "lm-bigrams")
    known = stored(words.repartition(n_words, "shard").mapInArrow(lambda b: _answer_words(b, learn, keep_), _TOLD_TYPES), "lm-words")
    sums = known.where("kind = 1").select("shard", "values").mapInArrow(_summed, "n long, v long, once long").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "v", "once")]).first()
    totals = tuple(int(x) for x in sums)
    if save:
        told.where("kind = 2").select("shard", "values").write.parquet(f"{save}/tries")
        known.where("kind = 2").select("shard", "keys", "values").write.parquet(f"{save}/words")
        spark.createDataFrame([(spread.shards, n_words, spread.hashes.tobytes(), spread.parts.tobytes())], "shards long, word_shards long, hashes binary, parts binary").write.parquet(f"{save}/plan")
    none = F.lit(None).cast("binary")
    meet = (
        coded.select("batch", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("shard"), "ids", *_COLUMNS[1:], none.alias("values"))
        .unionByName(told.where("kind = 0").select("batch", F.lit(1).alias("kind"), "shard", "values"), allowMissingColumns=True)
        .unionByName(known.where("kind = 0").select("batch", F.lit(2).alias("kind"), "shard", "values"), allowMissingColumns=True)
    )
    # a batch for a task: the number of tasks follows the corpus
    meet = meet.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), coded.count()), "batch")
    id_type = pa.int64() if id_name == "bigint" else pa.string() if id_name == "string" else pa.int32()
    return meet.groupBy("batch").applyInArrow(lambda t: _scored(t, totals, spread, n_words, id_type), f"doc_id {id_name}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.frombuffer(x, np.int64) for x in batch.column("values").to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.stack(rows, axis=1)], names=["n", "v", "once"])


def score(docs: DataFrame, mod: int = 10, remainder: int = 0, save: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document; save: a new folder for the model."""
    coded = _batches(docs, mod, remainder)
    return _run(coded, *_plan(coded), docs.schema["doc_id"].dataType.simpleString(), save=save)


def score_with(docs: DataFrame, path: str, mod: int = 10, remainder: int = 0) -> DataFrame:
    """The columns of score for docs, by the model stored under path; nothing is learned from docs."""
    read = docs.sparkSession.read.parquet
    plan = read(f"{path}/plan").first()
    spread = Spread(np.frombuffer(plan["hashes"], np.uint64), np.frombuffer(plan["parts"], np.int64), plan["shards"])
    return _run(_batches(docs, mod, remainder), spread, plan["word_shards"], docs.schema["doc_id"].dataType.simpleString(), read(f"{path}/tries"), read(f"{path}/words"))
