"""Filter interactions, byte-level BPE and phrase mining against plain Python and on awkward rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tamis.llm import bpe, interactions, jaccard, mixing, phrases, quality, toolcalls
from tests.llm.test_small import DOC, awkward

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile("[^\x20\x09-\x0d]+")
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def random_text(r, n, letters="aaabbB é\t\n\x0b\x1f中$ 😀x"):
    return "".join(r.choice(letters) for _ in range(n))


# filter interactions


def scanned(texts):
    w = interactions.Words(pa.array(texts, pa.string()))
    return list(zip(np.diff(w.of).tolist(), w.distinct().tolist(), *[w.counts[k].tolist() for k in (2, 4, 8)], strict=True))


def plain_scan(t):
    t = t or ""
    words = WORD.findall(t)
    return len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)), len(t)


@pytest.mark.parametrize("segment", [7, 64, 1 << 20])
def test_scan_counts_like_plain_python(segment, monkeypatch):
    monkeypatch.setattr(interactions, "SEGMENT", segment)
    r = random.Random(segment)
    for _ in range(60):
        texts = [None if r.random() < 0.1 else random_text(r, r.choice([0, 1, 5, 40, 300])) for _ in range(r.randrange(1, 12))]
        assert scanned(texts) == [plain_scan(t) for t in texts]
    for texts in ([], [""], [None], ["a" * 1000 + " " + "a" * 1000 + " " + "a" * 999 + "b"]):
        assert scanned(texts) == [plain_scan(t) for t in texts]


def test_clashing_hashes_are_told_apart(monkeypatch):
    real = interactions.Words.hashes
    monkeypatch.setattr(interactions.Words, "hashes", lambda self: real(self) & np.uint64(0xF << 60))
    r = random.Random(0)
    for _ in range(30):
        texts = [" ".join(r.choice(["aa", "bb", "c", "dddddddddd", "ddddddddde"]) for _ in range(20)) for _ in range(5)]
        assert scanned(texts) == [plain_scan(t) for t in texts]


def plain_audit(docs, labels):
    least = {}
    for d in docs:
        if d[0] is not None:
            least[d[1] or ""] = min(d[0], least.get(d[1] or "", d[0]))
    good, toxic = ({x[0] for x in labels if x[k] == 1} for k in (1, 2))
    failed = collections.defaultdict(list)
    for i, text, part in docs:
        n, distinct, caps, symbols, chars = plain_scan(text)
        fails = "A" * (n < 100) + "B" * (100 * distinct < 80 * n) + "C" * (100 * caps > 10 * chars) + "D" * (symbols > 0) + "E" * (i is not None and i > least[text or ""])
        failed[part or ""].append((fails, i in good, i in toxic))
    out, total = {}, collections.Counter()
    for part, rows in failed.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                total[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left) - len(gone), len(gone), sum(f in x[0] for x in rows) - len(gone), sum(x[0] == f for x in rows), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                left = [x for x in left if f not in x[0]]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_plain_python(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["BIG", "LOUD", "a#b", "x"]
    texts = [" ".join(r.choice(vocabulary[r.choice([0, 390]) :]) for _ in range(r.choice([3, 90, 100, 130]))) for _ in range(40)] + [None, "", " ", "A B C"]
    docs = [(r.choice([None, *range(60)]) if r.random() < 0.2 else i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(300)]
    docs += [(i, texts[0], "en") for i in range(1000, 1200)] + [(7, texts[1], "en")] * 3 + [(7, texts[1], "de")]
    labels = [(r.choice([None, *range(300)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(250)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = interactions.audit(frame, spark.createDataFrame(labels, LABELS)).collect()
    got = {(x["part"], x["filter_order"], x["step"]): tuple(x)[3:] for x in got}
    assert got == plain_audit(docs, [x for x in labels if x[0] is not None])


def test_audit_of_awkward_tables(spark, empty):
    none = spark.createDataFrame([], LABELS)
    assert interactions.audit(empty, none).count() == 0
    rows = awkward(spark).selectExpr("*", "'x' as digest", "'y' as n_words", "'z' as mask", "'p' as part")
    assert interactions.audit(rows, none.selectExpr("*", "1 as good")).count() == 2 * 600
    assert set(interactions.scan(rows).columns) >= {"doc_id", "part", "mask", "digest", "n_chars"}
    two = interactions.interactions(spark.createDataFrame([("p", 1, 5, 1, 0), ("p", 3, 2, 0, 1)], "part string, mask int, rows long, good long, toxic long"), "XY")
    assert {(x["filter_order"], x["step"]): (x["kept"], x["removed"], x["redundant"], x["shapley"]) for x in two.collect()} == {("XY", 1): (0, 7, 0, 12), ("XY", 2): (0, 0, 2, 2), ("YX", 1): (5, 2, 0, 2), ("YX", 2): (0, 5, 2, 12)}


# byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(bpe.vocabulary_bytes(PATH))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_ids_are_those_of_the_library(vocabulary, library):
    r, encoder = random.Random(1), bpe.Encoder(vocabulary, PATTERN)
    for _ in range(1500):
        text = "".join(r.choice("abcdeth  '\n.,;sSéß中1290\t  \U0001f600\x1c\x85") if r.random() < 0.8 else chr(r.choice([r.randrange(0x20, 0x3000), r.randrange(1, 0xD800)])) for _ in range(r.choice([3, 10, 60, 300])))
        ids = ids_of(encoder, text)
        assert ids == library.encode_ordinary(text)
        assert vocabulary.decode(np.array(ids, np.int64)) == text.encode()


def test_very_long_pre_tokens(vocabulary, library):
    r, encoder = random.Random(2), bpe.Encoder(vocabulary, PATTERN)
    for text in ("a" * 50_000, "".join(r.choice("etaoinshrdlu") for _ in range(50_000)), "ab" * 20_000, "=" * 10_000, " " * 5_000 + "x", "é" * 9_999):
        assert ids_of(encoder, text) == library.encode_ordinary(text)
    assert not vocabulary.buckets and not any(vocabulary.words)


def test_long_texts_are_split_where_it_is_certain(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 40)
    r, encoder = random.Random(3), bpe.Encoder(vocabulary, PATTERN)
    for _ in range(100):
        text = "".join(r.choice("abc  de 1 ' s't\n .é中") for _ in range(1500))
        assert len(list(encoder.segments(text))) > 5
        assert ids_of(encoder, text) == library.encode_ordinary(text)


def test_forgotten_pieces_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    encoder = bpe.Encoder(vocabulary, PATTERN)
    text = " ".join(f"word{i} other" for i in range(200))
    assert ids_of(encoder, text) == library.encode_ordinary(text) and len(encoder) <= 5 and len(encoder.older) <= 5


def test_any_ranks_merge_lowest_and_leftmost_first():
    r = random.Random(4)
    for _ in range(200):
        tokens = {bytes([b]) for b in range(256)} | {bytes(r.choice(b"ab") for _ in range(r.randrange(2, 6))) for _ in range(12)}
        ranks = {t: k for k, t in enumerate(r.sample(sorted(tokens), len(tokens)))}
        v = bpe.Vocabulary(ranks)
        for _ in range(10):
            piece = bytes(r.choice(b"aab") for _ in range(r.randrange(1, 40)))
            parts = [bytes([b]) for b in piece] if piece not in ranks else [piece]
            while len(parts) > 1:
                rank, i = min((ranks.get(x + y, 1 << 30), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 1 << 30:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert v.merge(piece) == [ranks[p] for p in parts]


def test_encode_and_decode_tables(spark, empty, library):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate([None, "", " ", "Hello world's end", "long " * 30_000, "x" * 20_000, "<|endoftext|>", "é中😀"])]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "'clash' as ids", "1 as N_TOKENS")
    coded = bpe.encode(docs, PATH, PATTERN)
    assert coded.columns[-2:] == ["n_tokens_", "ids_"] and coded.columns[:-2] == docs.columns
    got = {x["doc_id"]: x for x in bpe.decode(coded, PATH, "ids_").withColumn("list", bpe.id_list(F.col("ids_"))).collect()}
    for i, t, *_ in rows:
        want = library.encode_ordinary(t or "")
        assert got[i]["list"] == want and got[i]["n_tokens_"] == len(want) and bytes(got[i]["decoded"]) == (t or "").encode()
    both = {x["doc_id"]: x for x in bpe.round_trip(docs, PATH, PATTERN).collect()}
    assert all((both[i]["n_tokens_"], both[i]["ids_"], both[i]["decoded_"]) == (got[i]["n_tokens_"], got[i]["ids_"], got[i]["decoded"]) for i in got)
    assert bpe.encode(empty, PATH, PATTERN).count() == 0 == bpe.round_trip(empty, PATH, PATTERN).count()
    assert bpe.encode(awkward(spark), PATH, PATTERN).count() == 5
    wrong = spark.createDataFrame([(b"\x01",), (b"\xff\xff\xff\x7f",), (None,), (b"",)], "ids binary")
    assert [x["decoded"] for x in bpe.decode(wrong, PATH).collect()] == [None, None, None, b""]
    broken = spark.sql("select 1L as doc_id, cast(x'6162ff63' as string) as text")
    assert bytes(bpe.decode(bpe.encode(broken, PATH, PATTERN), PATH).first()["decoded"]) == "ab�c".encode()


def test_the_query_returns_the_librarys_digests(spark, library):
    from tamis.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {x["doc_id"]: x["text"] or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for x in got:
        ids = library.encode_ordinary(texts[x["doc_id"]])
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[x["doc_id"]].encode()).hexdigest())


def test_vocabularies_must_hold_every_byte():
    with pytest.raises(ValueError, match="256"):
        bpe.Vocabulary.read(base64.b64encode(b"a") + b" 0")


# phrases


def plain_collocations(docs, least, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, *words[i : i + m]] += 1
    found = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    hidden = set()
    for k, a in found.items():
        for m in range(2, len(k) - 1):
            for i in range(1, len(k) - m + 1):
                inner = (k[0], *k[i : i + m])
                if 100 * a >= 80 * f[inner]:
                    hidden.add(inner)
    rows = collections.defaultdict(list)
    for k, a in found.items():
        if k not in hidden:
            cuts = [(2_000_000 * a // (f[k[: c + 1]] + f[k[0], *k[c + 1 :]]), c) for c in range(1, len(k) - 1)]
            score, c = min(cuts)
            rows[k[0]].append((-score, -a, " ".join(k[1:]).encode(), f[k[: c + 1]], f[k[0], *k[c + 1 :]]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, some in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(some)[:top], 1)}


def prose(r, n, words=30):
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "Ünd", "New", "York", "city"]
    return "".join(r.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b"]) + (r.choice(vocabulary) if r.random() < 0.8 else "New York city") for _ in range(n))


@pytest.mark.parametrize(("least", "top"), [(30, 2000), (3, 2000), (5, 7)])
def test_collocations_against_plain_python(spark, least, top):
    r = random.Random(least)
    docs = [(r.choice(["en", "de", None]), prose(r, r.choice([0, 1, 5, 60, 200]))) for _ in range(120)] + [("en", None), ("fr", "once only"), ("en", "same words again. " * 40)]
    frame = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(docs)], "doc_id long, text string, lang string").repartition(5)
    got = phrases.collocations(frame, least=least, top=top).collect()
    want = plain_collocations(docs, least, top)
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 5


def test_collocations_of_awkward_tables(spark, empty):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(awkward(spark)).count() == 0
    rows = awkward(spark).selectExpr("*", "'a' as phrase", "2 as n", "3 as score")
    got = {(x["lang"], x["phrase"], x["a"]) for x in phrases.collocations(rows, least=2).collect()}
    assert got == {("en", "x y z", 2)}


def test_suffix_arrays_and_intervals():
    r = np.random.default_rng(0)
    for _ in range(50):
        ids = r.integers(0, 4, r.integers(0, 60))
        follows = r.random(len(ids)) < 0.8
        if len(ids):
            follows[-1] = False
        seq, back, room = phrases.with_stops(ids, follows)
        order = phrases.suffix_array(seq, 4)
        windows = [tuple(seq[i : i + 4]) + (0,) * (4 - len(seq[i : i + 4])) for i in order]
        assert windows == sorted(windows)
        common = phrases.common_prefixes(seq, order, 4)
        for m in range(1, 5):
            starts, counts = phrases.intervals(order, common, room, m)
            want = collections.Counter(tuple(ids[i : i + m]) for i in range(len(ids) - m + 1) if follows[i : i + m - 1].all())
            assert {tuple(ids[back[s] : back[s] + m]): c for s, c in zip(starts, counts, strict=True)} == want


def test_large_ids_are_ranked_first():
    ids = np.array([1 << 40, 0, 5, 1 << 40, 5, 0], np.int64)
    order = phrases.suffix_array(ids, 4)
    windows = [tuple(ids[i : i + 4]) + (0,) * (4 - len(ids[i : i + 4])) for i in order]
    assert windows == sorted(windows)


def test_blocks_cut_long_texts_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 50)
    r = random.Random(1)
    docs = [("en", prose(r, 80)), ("de", "x" * 200), ("de", "a b"), ("en", None), ("en", "")]
    batch = pa.RecordBatch.from_pydict({"lang": [x for x, _ in docs], "text": [t for _, t in docs]})
    parts = list(phrases._blocks(iter([batch])))
    assert len(parts) > 10
    found = collections.Counter()
    for langs, texts in parts:
        b = phrases.Block(langs, texts)
        names = b.names.to_pylist()
        for i in range(len(b.words)):
            found[b.langs[b.lang_of[i]], names[b.words[i]]] += 1
            if b.same[i]:
                found[b.langs[b.lang_of[i]], names[b.words[i]], names[b.words[i + 1]]] += 1
    want = collections.Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            want.update((lang, w) for w in words)
            want.update((lang, *p) for p in zip(words, words[1:], strict=False))
    assert found == want


# stages on clashing names, long chains, schemas


def test_stages_keep_columns_of_any_name(spark):
    r = random.Random(7)
    rows = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(40)), "en", f"s{i % 2}", 0) for i in range(30)] + [(100, "few", "en", "s0", 0)]
    rows += [(200, rows[3][1], "en", "s1", 0)]
    names = ["_quality_id", "_quality_at", "_quality_doc_id", "_dropped_id", "_dropped_at", "_again_id", "_mix_source", "_mix_copies", "_mix_below", "mix_times", "MIX_SIZE", "component_id", "node", "at", "kept"]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", *[f"'clash' as `{n}`" for n in names])
    want = set(range(30))
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {x["doc_id"] for x in good.collect()} == want | {200}
    one = jaccard.keep_one(docs)
    assert one.columns == docs.columns and {x["doc_id"] for x in one.collect()} == want | {100}
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_times_", "mix_size_"] and mixed.where("node <> 'clash'").count() == 0 and mixed.count() > 10


@pytest.mark.parametrize("n", [600])
def test_a_chain_of_revisions_is_one_component(spark, n):
    texts = [" ".join(f"w{k}" for k in range(5 * i, 5 * i + 60)) for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = jaccard.components(docs, threshold=jaccard.THRESHOLD).collect()
    sets = [{tuple(t.split()[k : k + 5]) for k in range(56)} for t in texts]
    assert 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1]) and 100 * len(sets[0] & sets[2]) < 80 * len(sets[0] | sets[2])
    assert {x["component_id"] for x in got} == {0} and len(got) == n


def test_schemas_of_any_shape():
    check = toolcalls.violations
    assert check(None, {"type": ["string", "null"]}) == [] and check("x", {"type": ["string", "null"]}) == []
    assert check(1, {"type": ["string", "null"]}) == ["$: not string or null"]
    assert check(1, {"type": "decimal"}) == ["$: not decimal"] and check(1.0, {"type": ["integer"]}) == []
    assert check(1, True) == [] and check(1, False) == ["$: not allowed"] and check({"a": 1}, None) == []
    assert check({"a": [1, "b"]}, {"properties": {"a": {"items": {"type": "number"}}}}) == ["$.a[1]: not number"]
    assert check("abc", {"minLength": "x", "maxLength": 2, "enum": 5}) == ["$: maxLength"]
    assert check({"a": 1}, {"required": [["b"], "c"], "additionalProperties": {"type": "string"}}) == ["$.c: missing", "$.a: not string"]
    assert check(5, {"minimum": True, "maximum": 4}) == ["$: maximum"]


def test_long_chains_are_levelled_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(toolcalls, "MAX_GROUP", 400)
    n = 1500
    rows = [("a", f"c{k}", k, [f"c{k - 1}", f"c{k - 2}", "gone"] if k > 1 else [f"c{k - 1}"] if k else []) for k in range(n)]
    # a chain against the order of turns, and a cycle with something behind it
    rows += [("b", f"d{k}", k, [f"d{k + 1}"] if k < 899 else []) for k in range(900)] + [("b", "x", 901, ["y"]), ("b", "y", 902, ["x"]), ("b", "z", 903, ["y", "d5"])]
    rows += [("s", "one", 0, []), ("s", "two", 1, ["one"])]
    got = {(x["conv_id"], x["call_id"]): (x["level"], x["n_missing"]) for x in toolcalls.levels(spark.createDataFrame(rows, "conv_id string, call_id string, call_turn int, after array<string>")).collect()}
    want = {("a", f"c{k}"): (k, 1 if k > 1 else 0) for k in range(n)} | {("b", f"d{k}"): (899 - k, 0) for k in range(900)}
    want |= {("b", x): (None, 0) for x in "xyz"} | {("s", "one"): (0, 0), ("s", "two"): (1, 0)}
    assert got == want
