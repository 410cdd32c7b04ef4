"""Language identification with string kernels, Nyström landmarks and kernel ridge regression.

The kernel of two texts is the number of distinct n-grams of 1 to 3 symbols that both hold, over the root of the product
of their own numbers.  Symbols are the bytes of the text with A-Z lower-cased and ASCII other than letters a space.
Landmarks and training rows are a bounded sample (`per_lang` rows of a language, `max_rows` in all, of at most
`max_chars` characters), chosen by hash of the id.  The n-grams of the landmarks span the feature space; with presence
rows B of a batch and L of the landmarks, the scores are (B Lᵀ) alpha after normalisation, one column of alpha for each
language; L and alpha are multiplied once, so that a batch takes one matrix product.

Whole texts are scored.  Null texts and texts without a letter are `und` with score 0; so is everything where nothing
could be learned.  Null languages and rows without an id are not learned from.  A language is a label as it stands, also
if empty.  Ties go to the first language by code point.  Repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import held_out
from tamis.llm.tokens import blocks, plain

PER_LANG = 400
MAX_ROWS = 4000
MAX_CHARS = 20_000
LANDMARKS = 320
RIDGE = 0.01
SHARPNESS = 6.0
BATCH = 1024
#: Symbols: 0 a space, 1 to 26 letters, then the 128 bytes of other characters.
SYMBOLS = 155
_SYMBOL = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else b - 101 if b > 127 else 0 for b in range(256)], np.int32)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of 1 to 3 symbols within the texts, and the text of each."""
    texts = plain(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    symbols = _SYMBOL[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    codes, owners = [symbols], [owner]
    two = symbols[:-1] * SYMBOLS + symbols[1:]
    within = owner[:-1] == owner[1:]
    codes.append(SYMBOLS + two[within])
    owners.append(owner[:-1][within])
    three = two[:-1] * SYMBOLS + symbols[2:]
    within = owner[:-2] == owner[2:]
    codes.append(SYMBOLS + SYMBOLS**2 + three[within])
    owners.append(owner[:-2][within])
    return np.concatenate(codes), np.concatenate(owners)


N_CODES = SYMBOLS + SYMBOLS**2 + SYMBOLS**3


@dataclass
class LanguageModel:
    langs: list[str]
    codes: np.ndarray  # the n-grams that span the feature space, sorted
    weights: np.ndarray  # one row for each of codes, one column for each language

    def table(self) -> np.ndarray:
        """Column of each code, or -1."""
        out = np.full(N_CODES, -1, np.int32)
        out[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        return out


def presence(texts: pa.Array, table: np.ndarray, width: int) -> np.ndarray:
    codes, owner = grams(texts)
    columns = table[codes]
    known = columns >= 0
    out = np.zeros((len(texts), width), bool)
    out[owner[known], columns[known]] = True
    return out


def fit(texts: list[str], langs: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """One-versus-rest kernel ridge regression on Nyström landmarks, spread over the languages."""
    names = sorted(set(langs))
    by = {x: [i for i, y in enumerate(langs) if y == x] for x in names}
    share = max(1, n_landmarks // max(1, len(names)))
    landmarks = [i for x in names for i in by[x][:share]]
    if not landmarks:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    codes = np.unique(grams(pa.array([texts[i] for i in landmarks], pa.string()))[0])
    table = np.full(N_CODES, -1, np.int32)
    table[codes] = np.arange(len(codes), dtype=np.int32)
    x = np.vstack([presence(pa.array(texts[i : i + BATCH], pa.string()), table, len(codes)).astype(np.float32) for i in range(0, len(texts), BATCH)])
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    lm = x[landmarks]
    k_nm, k_mm = (x @ lm.T).astype(np.float64), (lm @ lm.T).astype(np.float64)
    y = np.array([[1.0 if a == b else -1.0 for b in names] for a in langs])
    alpha = np.linalg.solve(k_nm.T @ k_nm + ridge * len(texts) / 100 * k_mm + 1e-6 * np.eye(len(landmarks)), k_nm.T @ y)
    return LanguageModel(names, codes, (lm.T.astype(np.float64) @ alpha).astype(np.float32))


def training_sample(docs: DataFrame, per_lang: int = PER_LANG, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, mod: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, text, lang of about per_lang training rows of each language, max_rows in all, chosen by hash of their id."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", mod, remainder))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy("lang").limit(max_rows).collect()}
    if not sizes:
        return usable.limit(0)
    each = max(1, min(per_lang, max_rows // len(sizes)))
    part = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(part * min(1.0, each / n)))])
    return usable.where((F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(part)) < F.try_element_at(share, F.col("lang"))) & (F.length("text").between(1, max_chars)))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["doc_id"], r["text"], r["lang"]) for b in batches for r in b.to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows]))], pa.binary())], names=["model"])


def train(docs: DataFrame, **bounds: int) -> LanguageModel:
    """The model of a bounded sample; one task fits it, so that the driver holds no texts."""
    made = training_sample(docs, **bounds).repartition(1).mapInArrow(_fitted, "model binary").first()
    return pickle.loads(made["model"]) if made is not None else fit([], [])


def predict(texts: pa.Array, model: LanguageModel, table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    x = presence(texts, table, len(model.codes)).astype(np.float32)
    f = (x @ model.weights) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    p = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [model.langs[i] for i in best], p[np.arange(len(p)), best].astype(float)


def has_letter(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    ascii_ = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
    return np.array([a or (t is not None and any(c.isalpha() for c in t)) for a, t in zip(ascii_, (None if a else x.as_py() for a, x in zip(ascii_, texts, strict=True)), strict=True)], bool)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        table = model.table()
        for block in blocks(batches):
            for k in range(0, block.num_rows, BATCH):
                rows = block.slice(k, BATCH)
                texts, n = rows.column("text"), rows.num_rows
                lang, score = predict(texts, model, table) if model.langs else (["und"] * n, np.zeros(n))
                letter = has_letter(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("held_out"), pa.array([x if y else "und" for x, y in zip(lang, letter, strict=True)], pa.string()), pa.array(np.where(letter, score, 0.0))],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text")
    return rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
