"""Toxicity by Levenshtein automata over a learned lexicon trie, with context windows.

Learning uses a bounded sample of labelled rows (`max_rows` rows of at most `max_chars` characters, chosen by hash, half of
them toxic where there are as many; the fit weighs each label's rows by what the sample left out).  Terms are words and
stems (prefixes of several words) that stand in many different contexts of toxic texts and hardly in others: contexts,
pairs of neighbouring words, are counted once, so that copies of one text do not make its words terms.  A word matches a
term exactly, or within one edit where the term has at least `fuzzy_length` letters and the word is not itself common in
clean texts.
Edits are found by running the word through the product of the term trie and the terms' Levenshtein automata, made
deterministic state by state as words need it.  Matches are weighed by their context: a window of words and the
characters around them tell quotation (quote marks, verbs of saying, words for words) from abuse (words of address).  A
logistic model of the match counts, fitted on the sample, gives the score.

Whole texts are scored.  Null and empty texts have no matches and score as texts without any.  Repeated rows each give a
row.  Rows without an id are scored and never learned from; labels without a value are not learned from; an id with both
labels counts as toxic.  Without labelled rows every score is 0.  Other columns are ignored by `score` and kept by `keep_clean`.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import held_out
from tamis.llm.tokens import WORDS, blocks, tokenize

MAX_ROWS = 3000
MAX_CHARS = 20_000
MAX_TERMS = 2000
LEAST_STEM = 4
#: Toxic texts of the sample that a term must stand in, beside being more frequent there than chance allows.
LEAST_TEXTS = 5
#: What a match with one edit counts for, against an exact one.
FUZZY_SHARE = 0.6
FUZZY_LENGTH = 5
CUT = 0.3
WINDOW = 4
#: Words that report speech or talk about words, and words that address someone.
REPORTING = frozenset("said says say wrote writes called calling word words term quote quoted quotes quoting dit disait mot mots dijo dice palabra palabras sagte sagt schrieb wort wörter".split())
ADDRESS = frozenset("you your youre u ur tu te toi vous tú usted eres du dich dir ihr".split())
QUOTES = frozenset("\"'`´“”„«»‘’‹›")
N_FEATURES = 7
_MIX = np.uint64(0x9E3779B97F4A7C15)


class TermAutomaton:
    """The terms as a trie, intersected with automata that allow up to one edit; states are made when first reached.

    A term that ends in * is a stem: it matches every word that starts with it, without edits.
    """

    def __init__(self, terms: list[str], fuzzy_length: int = FUZZY_LENGTH):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.may_edit: list[bool] = [False]
        self.open = [t.endswith("*") for t in terms]
        for k, term in enumerate(terms):
            at, term = 0, term.removesuffix("*")
            path = [0]
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.may_edit.append(False)
                at = self.children[at][c]
                path.append(at)
            self.ends[at] = k
            if len(term) >= fuzzy_length and not self.open[k]:
                for x in path:
                    self.may_edit[x] = True
        self.long = [len(t) >= fuzzy_length and not t.endswith("*") for t in terms]
        start = self._closed({(0, 0)})
        self.sets: list[frozenset] = [start]
        self.numbers: dict[frozenset, int] = {start: 0}
        self.moves: list[dict[str, int]] = [{}]
        self.accepts: list[tuple[int, int] | None] = [self._accept(start)]

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """states, with those that leave out one letter of a term."""
        out = set(states)
        for node, edits in states:
            if edits == 0 and self.may_edit[node]:
                out |= {(child, 1) for child in self.children[node].values() if self.may_edit[child]}
        return frozenset(x for x in out if not (x[1] and (x[0], 0) in out))

    def _accept(self, states: frozenset) -> tuple[int, int] | None:
        """(edits, term) of the closest term that ends here."""
        found = [(e, self.ends[n]) for n, e in states if self.ends[n] >= 0 and (e == 0 or self.long[self.ends[n]])]
        return min(found) if found else None

    def _step(self, state: int, c: str) -> int:
        new: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            if c in self.children[node]:
                new.add((self.children[node][c], edits))
            if edits == 0 and self.may_edit[node]:
                new.add((node, 1))
                new |= {(child, 1) for child in self.children[node].values() if self.may_edit[child]}
        to = self._closed(new)
        number = self.numbers.get(to, -1) if to else -1
        if to and number < 0:
            number = self.numbers[to] = len(self.sets)
            self.sets.append(to)
            self.moves.append({})
            self.accepts.append(self._accept(to))
        self.moves[state][c] = number
        return number

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the closest term within the allowed edits, or None; a stem counts where the whole word matches nothing."""
        at, moves, stem = 0, self.moves, None
        for c in word:
            to = moves[at].get(c)
            if to is None:
                to = self._step(at, c)
            if to < 0:
                return stem
            at = to
            if (got := self.accepts[at]) and not got[0] and self.open[got[1]]:
                stem = got
        return min(filter(None, (self.accepts[at], stem)), default=None)


@dataclass
class ToxicModel:
    terms: list[str] = field(default_factory=list)
    known: frozenset = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.array([-50.0] + [0.0] * N_FEATURES))


def matches(texts: pa.Array, automaton: TermAutomaton, known: frozenset) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text: matches outside and inside quotation, near words of address, of stems, and densities; and its number of words."""
    tokens = tokenize(texts, WORDS)
    n = np.diff(tokens.starts)
    out = np.zeros((len(n), N_FEATURES))
    names = tokens.words.to_pylist()
    edits, stem = np.full(len(names), -1, np.int8), np.zeros(len(names), bool)
    match = automaton.match
    for i, w in enumerate(names):
        got = match(w)
        if got is not None and not (got[0] and w in known):
            edits[i], stem[i] = got[0], automaton.open[got[1]]
    at = np.nonzero(edits[tokens.ids] >= 0)[0] if len(names) else np.zeros(0, np.int64)
    owner = tokens.owner()[at] if len(at) else at
    quoted: dict[int, set[int]] = {}
    for k, i in zip(at.tolist(), owner.tolist(), strict=True):
        first, stop = int(tokens.starts[i]), int(tokens.starts[i + 1])
        around = {names[j] for j in tokens.ids[max(first, k - WINDOW) : min(stop, k + WINDOW + 1)]}
        if i not in quoted:
            quoted[i] = quoted_words(texts[i].as_py())
        quote = (k - first) in quoted[i] or bool(around & REPORTING)
        share = FUZZY_SHARE if edits[tokens.ids[k]] else 1.0
        out[i, 4 if stem[tokens.ids[k]] and not quote else int(quote)] += share
        out[i, 2] += share * (not quote and bool(around & ADDRESS))
    out[:, 3] = out[:, 0] / np.maximum(n, 1) ** 0.5
    out[:, 5] = out[:, 4] / np.maximum(n, 10) ** 0.5
    out[:, 6] = np.minimum(1, out[:, 4] / np.maximum(n, 10) * 20)
    out[:, [0, 1, 2, 4]] = np.log1p(out[:, [0, 1, 2, 4]])
    return out, n


def quoted_words(text: str) -> set[int]:
    """Positions of the words that have a quote mark right before or after them."""
    out, at, inside, opened = set(), -1, False, False
    for c in text:
        if c.isascii() and not c.isalnum() or c in QUOTES:
            mark = c in QUOTES
            if inside and mark:
                out.add(at)
            inside, opened = False, mark
        elif not inside:
            inside, at = True, at + 1
            if opened:
                out.add(at)
    return out


def learn_terms(texts: list[str], toxic: np.ndarray, least: int = LEAST_TEXTS, odds: float = 8.0, deviations: float = 5.0) -> tuple[list[str], frozenset]:
    """Terms (whole words, and stems marked by a final *), and words that clean texts use in at least two contexts.

    An occurrence counts only with a context, a pair of neighbours, that no earlier occurrence of the word has.
    """
    tokens = tokenize(pa.array(texts, pa.string()), WORDS)
    names, ids, owner = tokens.words.to_pylist(), tokens.ids, tokens.owner()
    same = np.diff(owner) == 0
    before, after = np.where(np.r_[False, same], np.roll(ids, 1), -1), np.where(np.r_[same, False], np.roll(ids, -1), -1)
    mixed = (ids.astype(np.uint64) * _MIX + before.astype(np.uint64)) * _MIX + after.astype(np.uint64)
    first = np.sort(np.unique(mixed, return_index=True)[1])
    uses = {w: (int(n), int(bad)) for w, n, bad in zip(range(len(names)), *(np.bincount(ids[x], minlength=len(names)) for x in (first[toxic[owner[first]] == 0], first[toxic[owner[first]] == 1])), strict=True)}
    shown: dict[str, int] = defaultdict(int)  # toxic texts with a word of a prefix; with a word, where it ends in a space
    for i in np.nonzero(toxic)[0]:
        new = np.unique(ids[first[np.searchsorted(first, tokens.starts[i]) : np.searchsorted(first, tokens.starts[i + 1])]]).tolist()
        for x in {f"{names[w]} "[:n] for w in new for n in range(LEAST_STEM, len(names[w]) + 2)}:
            shown[x] += 1
    wide = {x for x, n in shown.items() if n >= least}
    count: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for w, (good, bad) in uses.items():
        for n in range(LEAST_STEM, len(names[w]) + 2):
            x = f"{names[w]} "[:n]
            if x in wide:
                count[x][0] += good
                count[x][1] += bad
    all_good, all_bad = (sum(u[k] for u in uses.values()) + 1 for k in (0, 1))
    fit = {}
    for x, (good, bad) in count.items():
        ratio, by_chance = (bad + 0.5) / all_bad / ((good + 0.5) / all_good), (good + bad) * all_bad / (all_bad + all_good)
        if ratio >= odds and bad - by_chance >= deviations * (by_chance + 1) ** 0.5:
            fit[x] = ratio
    terms = []
    for x, ratio in fit.items():
        # a stem must be more than the start of one word, and much better than a shorter one; words stand beside stems, for their misspellings
        above = max((fit[x[:n]] for n in range(LEAST_STEM, len(x)) if x[:n] in fit and not _one_word(x[:n], count)), default=0.0)
        if x[-1] == " ":
            terms.append((count[x][1], x[:-1]))
        elif ratio > 4 * above and not _one_word(x, count):
            terms.append((count[x][1], f"{x}*"))
    known = frozenset(names[w] for w, (good, _) in uses.items() if good >= 2)
    return [x for _, x in sorted(terms, reverse=True)[:MAX_TERMS]], known


def _one_word(prefix: str, count: dict[str, list[int]]) -> bool:
    """Whether one longer prefix, or the word itself, has nearly all toxic uses of a prefix."""
    return any(count[x][1] >= 0.8 * count[prefix][1] for x in list(count) if len(x) == len(prefix) + 1 and x.startswith(prefix))


def fit_logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray | None = None, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the first of a constant, by Newton steps with a quadratic penalty on all but the constant; each: what a row counts for."""
    x = np.hstack([np.ones((len(x), 1)), x])
    each = np.ones(len(x)) if each is None else each
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (each * (p * (1 - p) + 1e-9))[:, None]) + ridge, x.T @ (each * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, mod: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, text, y, each (rows that it stands for) of about max_rows labelled training rows, chosen by hash of their id, as many of both labels as there are."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", mod, remainder)).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    count = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic = min(count.get(1, 0), max(max_rows // 2, max_rows - count.get(0, 0)))
    share = {1: min(1.0, toxic / max(count.get(1, 0), 1)), 0: min(1.0, (max_rows - toxic) / max(count.get(0, 0), 1))}
    part = 1 << 30
    of = F.when(F.col("y") == 1, int(part * share[1])).otherwise(int(part * share[0]))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(part)) < of)
    each = F.when(F.col("y") == 1, 1 / max(share[1], 1e-9)).otherwise(1 / max(share[0], 1e-9))
    chosen = chosen.select(F.col("doc_id").alias("chosen_id"), "y", each.alias("each"))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars)).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))
    return rows.select("doc_id", "text", "y", "each")


def fit_model(texts: list[str], y: np.ndarray, each: np.ndarray | None = None) -> ToxicModel:
    if not len(y) or not y.any():
        return ToxicModel()
    terms, known = learn_terms(texts, y)
    automaton = TermAutomaton(terms)
    # words of clean texts that an edit would take for a term are known for what they are
    known = frozenset(w for w in known if automaton.match(w) is not None)
    x = np.vstack([matches(pa.array(texts[i : i + 250], pa.string()), automaton, known)[0] for i in range(0, len(texts), 250)])
    return ToxicModel(terms, known, fit_logistic(x, y, each if each is None else each * (len(each) / each.sum())))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["doc_id"], r["text"], r["y"], r["each"]) for b in batches for r in b.to_pylist())
    model = fit_model([r[1] for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> ToxicModel:
    """The model of a bounded sample; one task fits it, so that the driver holds no texts."""
    fitted = training_sample(docs, labels, label, max_rows, max_chars).repartition(1).mapInArrow(_fitted, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted is not None else ToxicModel()


def _score(batches: Iterator[pa.RecordBatch], model: ToxicModel, automaton: TermAutomaton, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in blocks(batches, text):
        x, _ = matches(batch.column(text), automaton, model.known)
        yield batch, 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -50, 50)))


def score(docs: DataFrame, model: ToxicModel, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TermAutomaton(sent.value.terms)
        for batch, s in _score(batches, sent.value, automaton, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text")
    return rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicModel, cut: float = CUT, text: str = "text") -> DataFrame:
    """docs, all columns, without the documents that score cut or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TermAutomaton(sent.value.terms)
        for batch, s in _score(batches, sent.value, automaton, text):
            yield batch.filter(pa.array(s < cut))

    return docs.mapInArrow(clean, docs.schema)


def misspellings(words: list[str], terms: list[str]) -> dict[str, tuple[int, str]]:
    """(edits, term) of each word that matches a term."""
    automaton = TermAutomaton(terms)
    return {w: (m[0], terms[m[1]]) for w in words if (m := automaton.match(w)) is not None}
