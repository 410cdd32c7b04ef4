"""Operators against brute force and on awkward rows: nulls, empty and long texts, repeats, empty tables, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tamis.llm import decontaminate, jaccard, langid, licenses, lm, mixing, quality, toolcalls, toxicity, warc
from tamis.llm.ngram_trie import EliasFano, NgramTrie
from tamis.llm.tokens import LOWERED, WORDS, tokenize

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")


def make_texts(n=60, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"Word{i}" for i in range(300)]
    texts = [" ".join(vocabulary[j] for j in rng.integers(0, 300, rng.integers(1, 80))) for _ in range(n)]
    for k in range(10):  # near copies, and exact ones
        words = texts[k].split()
        if len(words) > 30:
            words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
        texts.append(texts[k])
    return [*texts, None, "", "  \n\t ", "one", "ONE", "a b c d", "long " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], len(t or "")) for i, t in enumerate(make_texts())]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def awkward(spark):
    """Null ids, repeated rows and columns that clash with names used inside."""
    rows = [(None, "x y z", None, None, None, "s"), (1, None, "en", "a", 0, None), (1, None, "en", "a", 0, None), (2, "x y z", "en", None, 5, "t"), (2, "x y z", "en", None, 5, "t")]
    return spark.createDataFrame(rows, DOC + ", node string").withColumnRenamed("n_chars", "size").withColumn("spans", pa_lit()).withColumn("hash", pa_lit()).withColumn("component_id", pa_lit())


def pa_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_tokens_match_the_classes():
    texts = ["Ab\x0bC d", None, "", " É-é_9 ", "a\x1fb c d", "x"]
    for table, cls in ((LOWERED, r"[^\x20\x09-\x0D]+"), (WORDS, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        got = tokenize(pa.array(texts), table)
        names = got.words.to_pylist()
        for i, t in enumerate(texts):
            assert [names[j] for j in got.ids[got.starts[i] : got.starts[i + 1]]] == re.findall(cls, lower(t))


def test_elias_fano_round_trip_and_search():
    rng = np.random.default_rng(0)
    for top in (1, 100, 1 << 20, (1 << 64) - 1):
        values = np.unique(rng.integers(0, top, 1000, dtype=np.uint64, endpoint=True))
        coded = EliasFano.encode(values)
        assert (coded.get(np.arange(len(values))) == values).all()
        assert (coded.find(values) == np.arange(len(values))).all()
        other = np.setdiff1d(rng.integers(0, top, 1000, dtype=np.uint64, endpoint=True), values)
        assert (coded.find(other) == -1).all()


def test_trie_of_three_levels(tmp_path):
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(0, 12, (400, 3)), axis=0)
    words = grams[:, 0].astype(np.uint64) << np.uint64(50)
    codes = (np.arange(len(grams)) % 255 + 1).astype(np.uint8)
    trie = NgramTrie.build(words, [grams[:, 1].astype(np.uint32), grams[:, 2].astype(np.uint32)], codes)
    (tmp_path / "trie").write_bytes(trie.pack())
    trie = NgramTrie.open(str(tmp_path / "trie"))
    every = np.stack(np.meshgrid(*[np.arange(13)] * 3, indexing="ij"), -1).reshape(-1, 3)
    known = {tuple(g): c for g, c in zip(grams.tolist(), codes.tolist(), strict=True)}
    got = trie.lookup(every[:, 0].astype(np.uint64) << np.uint64(50), [every[:, 1].astype(np.uint32), every[:, 2].astype(np.uint32)])
    assert got.tolist() == [known.get(tuple(x), 0) for x in every.tolist()]


def counted(rows):
    """A scorer by counts of the rows that are not held out."""
    c, b = collections.Counter(), collections.Counter()
    tokens = [WORD.findall(lower(r["text"])) + ["</s>"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10]
    for w in tokens:
        c.update(w)
        b.update(zip(["<s>", *w[:-1]], w, strict=True))
    t = collections.Counter(v for v, _ in b)
    n, p0 = sum(c.values()), (sum(x == 1 for x in c.values()) + 1) / (sum(c.values()) + 1)

    def score(w):
        out = 0.0
        for v, x in zip(["<s>", *w[:-1]], w, strict=True):
            cv, p1 = len(tokens) if v == "<s>" else c[v], (1 - p0) * c[x] / n if c[x] else p0
            out += math.log10(min(1, max(b[v, x] - 0.75, 0) / cv + 0.75 * t[v] / cv * p1) if cv else p1)
        return out, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in w), sum(c[x] > 0 for x in w), n

    return score


def test_lm_against_counts(spark, docs, tmp_path):
    rows = docs.collect()
    scorer = counted(rows)
    path = f"file://{tmp_path}/model"
    other = spark.createDataFrame([(i, t) for i, t in enumerate([rows[0]["text"], "unseen words " + (rows[1]["text"] or ""), None, *make_texts(8, 9)])], "doc_id int, text string")
    for table, found in ((docs, lm.score(docs, save=path)), (docs, lm.score_with(docs, path)), (other, lm.score_with(other, path))):
        got, texts = {r["doc_id"]: r for r in found.collect()}, {r["doc_id"]: r["text"] for r in table.collect()}
        assert set(got) == set(texts)
        for k, text in texts.items():
            w, r = WORD.findall(lower(text)) + ["</s>"], got[k]
            score, base, n_known, n = scorer(w)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), n_known, n, zlib.crc32(str(k).encode()) % 10 == 0)
            assert r["base_score"] == pytest.approx(base, rel=1e-9) and abs(r["score"] - score) < 0.03 * len(w)


def test_codes_stand_for_probabilities():
    p = np.r_[0, 10.0 ** -np.linspace(0, 9.9, 5000)]
    back = lm.VALUES[lm.quantise(p)]
    assert back[0] == 0 and np.abs(np.log10(back[1:] / p[1:])).max() <= 0.02


@pytest.mark.parametrize("shards", [3, 70])
def test_frequent_contexts_are_dealt_over_shards(shards):
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    words = rng.integers(2, 60, 4000).astype(np.int32)
    words[::3] = 5
    batch = lm.Batch(hashes, words, np.array([1500, 0, 2500]), np.array([False, False, True]))
    one, many = batch.bigrams(lm.Spread(np.zeros(0, np.uint64), np.zeros(0, np.int64), shards)), batch.bigrams(lm.Spread(hashes[5:6], np.array([8]), shards))
    places = many["context_shard"][many["context"] == 5]
    assert len(places) == len(set(places.tolist())) > 1 and set(many["seen"][many["context"] == 5]) == {int((batch.prev[batch.train] == 5).sum())}
    for b in (one, many):
        assert b["size"].sum() == len(b["shard"]) and b["count"].sum() == batch.train.sum()
        assert (np.repeat(b["context_shard"], b["size"]) == b["shard"]).all() and len(np.unique(b["of_token"])) == len(b["shard"])


def test_lm_awkward(spark, empty):
    assert lm.score(empty).count() == 0
    assert sorted(r["n_tokens"] for r in lm.score(awkward(spark)).collect()) == [1, 1, 4, 4, 4]


def test_langid(spark, docs, empty):
    rows = [(i, ("the cat and the hat with that " if i % 2 else "der und die das ist nicht ein ") * (1 + i % 5), "en" if i % 2 else "de", "s", 0) for i in range(80)]
    table = spark.createDataFrame([*rows, (900, None, "en", "s", 0), (901, "123 -- 45", "de", "s", 0), (None, "the hat", "en", None, 0)], DOC)
    got = langid.identify(table, langid.train(table)).collect()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(80)) and by[None]["lang_pred"] == "en" and not by[None]["held_out"]
    assert (by[900]["lang_pred"], by[901]["lang_pred"], by[900]["score"]) == ("und", "und", 0.0)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(empty)).collect()} == {"und"}
    assert langid.identify(awkward(spark), langid.train(docs)).count() == 5


def test_language_scores_are_kernel_ridge_regression():
    rng = np.random.default_rng(4)
    letters = {"x": "abcdefgh é", "y": "fghijklm ", "z": "stuvwxyzß "}
    texts, langs = zip(*[("".join(rng.choice(list(letters[k]), rng.integers(5, 60))), k) for k in "xyz" for _ in range(12)], strict=True)
    model = langid.fit(list(texts), list(langs), n_landmarks=36)

    def parts(t):
        symbols = [b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else b - 101 if b > 127 else 0 for b in t.encode()]
        return {tuple(symbols[i : i + n]) for n in (1, 2, 3) for i in range(len(symbols) - n + 1)}

    sets = [parts(t) for t in texts]
    every = set().union(*sets)
    kernel = lambda a, b: len(a & b) / math.sqrt(max(1, len(a & every)) * max(1, len(b)))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    alpha = np.linalg.solve(k + langid.RIDGE * len(texts) / 100 * np.eye(len(texts)), np.where(np.array(langs)[:, None] == np.array(["x", "y", "z"]), 1.0, -1.0))
    asked = ["abba cab", "mjklm fgh", "stußw vw", "ABC!", "", "qqq"]
    want = np.array([[kernel(parts(t), b) for b in sets] for t in asked]) @ alpha
    got_lang, got = langid.predict(pa.array(asked), model, model.table())
    p = np.exp(langid.SHARPNESS * want)
    p /= p.sum(axis=1, keepdims=True)
    assert [got_lang[i] for i in range(5)] == [["x", "y", "z"][i] for i in want.argmax(axis=1)[:5]] and np.abs(got - p.max(axis=1)).max() < 0.01


def test_toolcalls_chain_cycle_and_schema(spark, monkeypatch):
    calls = spark.createDataFrame(
        [("c", "1", 0, "add", '{"b": 2.50, "a":1e2}', None), ("c", "2", 1, "add", '{"a": 1, "b": 2, "z": 3}', ["1", "gone"]), ("c", "3", 2, "add", "no json", ["2", "1"]), ("c", "4", 3, "x", "{}", ["5"]), ("c", "5", 4, "x", None, ["4"]), ("c", "1", 9, "add", "{}", None), (None, "7", 1, "add", "{}", None), ("c", "8", 5, "add", '{"a": 1e400, "b": "q"}', None)],
        "conv_id string, call_id string, turn int, name string, arguments string, after array<string>",
    )
    results = spark.createDataFrame([("c", "1", 1, "ok"), ("c", "9", 2, "lost"), ("c", None, 3, "?")], "conv_id string, call_id string, turn int, content string")
    schema = {"add": {"type": "object", "properties": {"a": {"type": "number"}, "b": {"type": "number"}}, "required": ["a", "b"], "additionalProperties": False}}
    got = {r["call_id"]: r for r in toolcalls.link(calls, results, schema).where("status <> 'no_id'").collect()}
    assert [got[k]["level"] for k in "12345"] == [0, 1, 2, None, None]
    assert [got[k]["status"] for k in "123459"] == ["linked", "no_result", "no_result", "cycle", "cycle", "orphan_result"]
    assert [got[k]["n_errors"] for k in "12398"] == [0, 1, 1, 0, 2]
    assert got["1"]["canonical"] == '{"arguments":{"a":100,"b":2.5},"id":"1","name":"add","result":"ok"}' and got["1"]["n_calls"] == 2 and got["2"]["n_missing"] == 1
    assert toolcalls.link(calls, results, schema).where("status = 'no_id'").count() == 2
    assert toolcalls.link(calls.limit(0), results.limit(0), schema).count() == 0
    monkeypatch.setattr(toolcalls, "MAX_GROUP", 1)
    again = {r["call_id"]: r["level"] for r in toolcalls.link(calls, results, schema).where("status <> 'no_id'").collect()}
    assert again == {k: r["level"] for k, r in got.items()}


def test_toolcalls_levels_do_not_follow_turns(spark):
    calls = spark.createDataFrame(
        [("c", "1", 0, []), ("c", "2", 4, ["1"]), ("c", "3", 9, ["1"]), ("c", "4", 10, ["2", "3", "gone"]), ("d", "1", None, []), ("d", "2", 7, []), ("e", "1", None, ["2"]), ("e", "2", 3, [])],
        "conv_id string, call_id string, turn int, after array<string>",
    ).selectExpr("*", "'add' as name", "'{}' as arguments")
    linked = toolcalls.link(calls, spark.createDataFrame([], "conv_id string, call_id string, turn int, content string"), {})
    assert {r["conv_id"] + r["call_id"]: (r["level"], r["status"]) for r in linked.collect()} == {k: (n, "no_result") for k, n in zip(("c1", "c2", "c3", "c4", "d1", "d2", "e1", "e2"), (0, 1, 1, 2, 0, 0, 1, 0), strict=True)}


def test_toolcalls_levels_differ_from_turns(spark):
    from tamis.llm.queries import QUERIES

    got = QUERIES["op3_tool_calls"](spark, "/root/testdata/sf0.01").where("call_turn is not null")
    assert got.where("level <> call_turn").count() > 20


def test_toolcalls_of_arguments_that_cannot_be_written(spark):
    deep = '{"a":' * 150 + "1" + "}" * 150
    texts = ['{"a": %s}' % ("9" * 400), '{"a": %s}' % ("9" * 5000), '{"a": ' + "[" * 3000 + "]" * 3000 + "}", '{"a": "\\ud800"}', '{"\\ud800": 1}', '{"a": NaN}', '{"a": ' + "[" * 200 + "]" * 200 + "}", deep, '{"a": "%s"}' % ("x" * 1_000_000), ""]
    calls = spark.createDataFrame([("c", str(i), i, "t", t, [], "clash") for i, t in enumerate(texts)], "conv_id string, call_id string, turn int, name string, arguments string, after array<string>, level string")
    linked = toolcalls.link(calls, spark.createDataFrame([], "conv_id string, call_id string, turn int, content string, status string"), {"t": {"type": "object"}})
    got = [r for _, r in sorted((int(r["call_id"]), r) for r in linked.collect())]
    why = ["not a JSON number", "not a JSON number", "too deep", "not Unicode", "not Unicode", "not a JSON number", "too deep", None, None, "no object"]
    assert [r["errors"] for r in got] == [[f"$: {w}"] if w else [] for w in why]
    assert all(('"arguments":null' in r["canonical"]) == (w is not None) for r, w in zip(got, why, strict=True)) and [r["level"] for r in got] == [0] * 10


@pytest.mark.parametrize(("x", "text"), [(1.0, "1"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (0.00001, "0.00001"), (-0.5, "-0.5"), (123456789012345680000.0, "123456789012345680000"), (2**60, "1152921504606847000"), (0, "0"), (-0.0, "0")])
def test_canonical_numbers(x, text):
    assert float(toolcalls.canonical_number(x)) == float(x)
    assert toolcalls.canonical_number(x) == text


def test_canonical_json_round_trip():
    x = {"b": [1, True, None, "é\n\u0001\""], "a": {"\U0001f600": 1, "�": 2}}
    assert json.loads(toolcalls.canonical(x)) == x and toolcalls.canonical(x).startswith('{"a":{"\U0001f600":1')


def test_warc_of_repeated_page_ids(spark, tmp_path):
    body = "y" * 1500
    rows = [(5, "http://a/1", body, "c"), (5, "http://a/2", body, "c"), (5, "http://a/2", body, "c"), (3, "http://b", body, "c"), (3, "http://b", body, "c"), (9, None, "", "c"), (9, None, "", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string").repartition(3).cache()
    warc.write_archives(warc.with_digest(pages), f"file://{tmp_path}/w", date="2026-01-02T03:04:05Z")
    found = [r for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(f"file://{tmp_path}/w").collect() for r in warc.parse_archive(bytes(f["content"]))]
    assert len({r["head"]["warc-record-id"] for r in found}) == len(found) == 7
    again = [r["head"] for r in found if r["head"]["warc-type"] == "revisit"]
    ids = {r["head"]["warc-record-id"]: r["head"] for r in found}
    assert [h["x-page-id"] for h in again] == ["3", "3"] and all(h["warc-refers-to-date"] == "2026-01-02T03:04:05Z" for h in again)
    for h in again:  # the record referred to is the response at that address
        original = ids[h["warc-refers-to"]]
        assert original["warc-type"] == "response" and original["x-page-id"] == "5" and original["warc-target-uri"] == h["warc-refers-to-target-uri"]


def test_warc_round_trip(spark, tmp_path):
    body = "<p>WARC/1.1\r\n\r\nContent-Length: 5\r\n é</p>" * 40
    rows = [(1, "http://a/ b", body), (2, None, body), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", body), (6, "u", "x" * 1_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive(pages, f"file://{tmp_path}/w", payloads=True).collect()
    assert len(got) == 7
    by = {r["page_id"]: r for r in got}
    digest = hashlib.sha1(body.encode()).hexdigest()
    assert (by[1]["record_type"], by[1]["refers_to"], by[1]["payload_digest"], by[1]["payload_bytes"]) == ("revisit", 2, digest, len(body.encode()))
    assert bytes(by[2]["payload"]).decode() == body and by[2]["record_type"] == "response" and by[None]["refers_to"] == 2
    assert by[3]["record_type"] == by[4]["record_type"] == "response" and by[5]["payload_bytes"] == 0 and by[6]["payload_bytes"] == 1_000_000
    assert warc.archive(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def test_mixing_meets_targets(spark, docs, empty):
    got = mixing.mixture(docs).collect()
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    total = sum(r["size"] for r in got)
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert sorted(map(str, mixing.mixture(docs.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.mixture(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.mixture(awkward(spark)).count() == 5
    assert {"hash", "size", "mix_times"} <= set(mixing.mix(awkward(spark)).columns)


def test_mix_keeps_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", "mine") for i in range(20)], "doc_id long, text string, source string, mix_times string")
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "mix_times_", "mix_size_"] and {r["mix_times"] for r in out.collect()} == {"mine"}


def test_licenses_of_long_texts(spark):
    notice = next(iter(licenses.PHRASES))
    text = "word " * 300_000 + notice + " word" * 300_000
    got = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, notice)], "doc_id long, text string")).collect()
    rows = {r["doc_id"]: r for r in got}
    assert rows[1]["first_word"] == 300_000 and rows[1]["n_words"] == 600_000 + len(notice.split()) and rows[1]["base_labels"] == rows[2]["base_labels"] and len(rows[1]["base_labels"]) == 1


def test_licenses(spark, empty):
    texts = [None, "", "x under the MIT-License y", "Apache License, Version 2; apache license version 2", "Released under a MIT license.", "this work is licensed under the gnu general public license version 3", "CC BY-NC cc by nc", "under the mit"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["n_base"] for i in range(8)] == [0, 0, 1, 2, 0, 0, 2, 0]
    assert (got[2]["first_word"], got[2]["last_word"], got[2]["n_words"]) == (1, 1, 6) and (got[3]["first_word"], got[3]["last_word"]) == (0, 4)
    assert got[5]["labels"] == ["gpl-3"] and got[5]["score"] == 1.0 and got[6]["base_labels"] == ["cc-by-nc"] and got[7]["labels"] == [] and got[0]["first_word"] is None
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(awkward(spark)).count() == 5


def test_licenses_over_line_ends(spark):
    wrapped = {
        "mit": "/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction, including without limitation the rights",
        "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3",
        "bsd": "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions\r\nare met:",
        "apache-2": "you may not use this file except in compliance with the License.\n\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
    }
    words, far = wrapped["gpl"].split(), " ".join(f"x{i}" for i in range(60))
    texts = {**{k: f"{far}\n{far} {x}\n{far}" for k, x in wrapped.items()}, "far": f"\n{far}\n".join([" ".join(words[:15]), " ".join(words[15:])])}
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert got == {**{k: ([k], 1.0) for k in wrapped}, "far": ([], 0.0)}


def brute_leaks(texts, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    out = {}
    for k, t in texts.items():
        w, hit, found = words(t), set(), set()
        for item, x in items.items():
            y = words(x)
            for a in range(max(1, len(y) - 9)) if y else ():
                z = y[a : a + 10]
                for i in range(len(w) - len(z) + 1):
                    if w[i : i + len(z)] == z:
                        hit |= set(range(i, i + len(z)))
                        found.add(str(item))
        out[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_decontamination(spark, most):
    passage = " ".join(f"t{i}" for i in range(25))
    texts = {0: None, 1: "", 2: f"a b {passage} c", 3: passage.upper().replace(" ", "-"), 4: "t0 t1 t2", 5: "short item here", 6: " ".join(passage.split()[:9]), 7: "q " * 5000 + passage, 8: "é-é short ITEM here short item"}
    items = {11: passage, 12: "short item", 13: None, 14: "", 15: " ".join(passage.split()[5:16])}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, spans string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.report(decontaminate.find_leaks(docs, benchmark, max_windows=most)).collect()}
    assert got == brute_leaks(texts, {k: v for k, v in items.items() if v is not None})
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, benchmark, max_windows=most).collect()}
    assert kept == {k for k, v in got.items() if not v[4]}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, benchmark, remove="spans", max_windows=most).collect()}
    assert cut[2] == "a b  c" and cut[5] == " here" and cut[0] is None
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == len(texts)
    assert decontaminate.report(decontaminate.find_leaks(docs.limit(0), benchmark)).count() == 0


def test_spans_are_cut_after_the_last_pass(spark):
    words = [f"t{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "x " + " ".join(words) + " y", "clash"), (2, "t30 t31", "clash")], "doc_id long, text string, spans string")
    items = [(1, " ".join(words[:14])), (1, " ".join(words[10:25])), (2, " ".join(words[20:32])), (2, " ".join(words[20:32]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(1)
    cut = lambda most: sorted(map(tuple, decontaminate.decontaminate(docs, benchmark, remove="spans", max_windows=most).collect()))
    assert cut(1) == cut(3) == cut(1000) == [(1, "x  " + " ".join(words[32:]) + " y", "clash"), (2, "t30 t31", "clash")]
    got = decontaminate.report(decontaminate.find_leaks(docs, benchmark, max_windows=1, texts=False)).where("doc_id = 1").first()
    assert (got["n_hit"], got["n_items"], got["items_sha256"]) == (32, 2, decontaminate.item_digest(["1", "2"]))


def test_decontamination_of_items_without_id(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "both ids here"), (3, "clean")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, "one two three"), (None, "both ids"), (7, "both ids")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.report(decontaminate.find_leaks(docs, benchmark)).collect()}
    assert got == {1: (3, 0, decontaminate.item_digest([]), True), 2: (2, 1, decontaminate.item_digest(["7"]), True), 3: (0, 0, decontaminate.item_digest([]), False)}
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, benchmark).collect()] == [3]


def brute_components(texts):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(lower(t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {k: k for k in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components(spark, seed):
    rng = np.random.default_rng(seed)
    texts = make_texts(30, seed)
    base = [f"b{i}" for i in range(200)]
    for _ in range(25):  # a chain of edits around the threshold, and short texts that differ in one shingle
        w = list(base)
        for j in rng.integers(0, len(w), rng.integers(1, 7)):
            w[j] = f"e{rng.integers(1000)}"
        cut = int(rng.integers(0, 12))
        texts.append(" ".join(w[cut:]))
    texts += [" ".join(base[k : k + n]) for n in (5, 8, 9, 10, 13) for k in range(3)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(table).collect()}
    assert got == brute_components(dict(enumerate(texts)))
    if seed == 1:
        kept = sorted(r["doc_id"] for r in jaccard.keep_one(table.union(table)).collect())
        assert kept == sorted([k for k, (n, c) in got.items() if n == 0 or c == k] + [k for k, (n, _) in got.items() if n == 0])


def test_jaccard_awkward(spark, empty):
    assert jaccard.components(empty).count() == 0 and jaccard.keep_one(empty).count() == 0
    rows = awkward(spark)  # with a column named component_id
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in jaccard.components(rows).collect())
    assert got == [("1", 1), ("1", 1), ("2", 2), ("2", 2), ("None", 2)]
    kept = jaccard.keep_one(rows)
    assert kept.columns == rows.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2"]
    assert {r["component_id"] for r in kept.collect()} == {"clash"}


def edited(rng, base, n, least=0, most=9):
    """n texts, each base with some words replaced."""
    out = []
    for _ in range(n):
        w = list(base)
        for j in rng.integers(0, len(w), rng.integers(least, most)):
            w[j] = f"e{rng.integers(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("block", "size"), [(5, 1 << 30), (512, 300)])
def test_jaccard_pools_of_many_blocks(spark, monkeypatch, block, size):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "POOL_BYTES", size)
    rng = np.random.default_rng(7)
    texts = [t for k in range(3) for t in edited(rng, [f"g{k}w{i}" for i in range(90)], 40)] + edited(rng, [f"long{i}" for i in range(3000)], 6, 50, 120)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(table).collect()} == brute_components(dict(enumerate(texts)))


def test_jaccard_of_clashing_digests(spark):
    texts = make_texts(40, 3)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    run = jaccard.Join(table, bits=4)
    assert len(run.name[1]) > 8
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run.components().collect()} == brute_components(dict(enumerate(texts)))


def test_jaccard_leaves_the_session_as_it_was(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    jaccard.components(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert (spark.conf.get(key), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == before


def test_long_member_lists_span_rows(monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 10)
    node = np.arange(1, 36, dtype=np.uint64)
    shard = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([np.full(35, 7, np.uint64).tobytes()]), pa.array([node.tobytes()])], names=["shard", "sigs", "nodes"])
    rows = [r for b in jaccard._buckets(iter([shard])) for r in b.to_pylist()]
    assert [r["part"] for r in rows] == [0, 1, 2, 3] and len({r["bucket"] for r in rows}) == 1
    assert {r["members"][0] for r in rows} == {rows[0]["members"][0]} and {m for r in rows for m in r["members"]} == set(node.tolist())


def pool_rows(rng, pools):
    base = np.unique(rng.integers(0, 1 << 63, 120, dtype=np.uint64))
    rows = []
    for hub, members in pools:
        for m in range(members):
            h = np.unique(np.concatenate([rng.permutation(base)[:115], rng.integers(0, 1 << 63, 5, dtype=np.uint64)]))
            rows.append((hub, 0, 0, True, True, 100 * hub + m, m // 3, True, len(h), jaccard.count_vector(h)))
    return rows


POOL_COLUMNS = ["hub", "i", "j", "left", "right", "node", "component", "minor", "n", "vector"]


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 50])
def test_pool_pairs_do_not_depend_on_batches(cut, monkeypatch):
    rows = pool_rows(np.random.default_rng(0), ((1, 3), (2, 1), (5, 60), (6, 4)))
    batches = lambda k: (pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + k], strict=True)], names=POOL_COLUMNS) for a in range(0, len(rows), k))
    found = lambda k: sorted((x["a"], x["b"]) for b in jaccard._pool_pairs(batches(k), jaccard.THRESHOLD, 0) for x in b.to_pylist())
    whole = found(len(rows))
    monkeypatch.setattr(jaccard, "AT_ONCE", 500)
    assert found(cut) == whole and len(whole) > 100
    every = {(x[5], y[5]) for x in rows for y in rows if x[0] == y[0] and x[5] < y[5] and x[6] != y[6] and min(x[8], y[8]) * 5 >= max(x[8], y[8]) * 4 and jaccard.pair_bounds([x[9]], [y[9]])[0] >= -(-(x[8] + y[8]) * 4 // 9)}
    assert set(whole) == every


def test_vectors_fold_and_bound():
    texts = pa.array([" ".join(f"x{j}" for j in range(k)) for k in (0, 3, 40, 700, 3000)])
    sets = jaccard.ShingleSets(texts)
    vectors = sets.vectors()
    assert [len(v) for v in vectors] == [64, 64, 64, 1024, 4096] and [sum(v) for v in vectors] == sets.sizes.tolist()
    for i in range(5):
        for j in range(5):
            both = len(np.intersect1d(*(sets.hashes[sets.starts[k] : sets.starts[k + 1]] for k in (i, j))))
            assert jaccard.pair_bounds([vectors[i]], [vectors[j]])[0] >= both


def test_count_forest_loses_nothing():
    rng = np.random.default_rng(5)
    vectors = rng.poisson(3, (500, 16))
    vectors[250:] = np.maximum(0, vectors[:250] + rng.integers(-1, 2, (250, 16)) * (rng.random((250, 16)) < 0.2))
    vectors = vectors[np.argsort(np.arange(500) % 250, kind="stable")]  # alike ones side by side
    sizes, block, comp = vectors.sum(axis=1), np.arange(500) // 72, rng.integers(0, 40, 500)
    forest = jaccard.CountForest(block, vectors, sizes, comp)
    q, p = forest.join(block, vectors, sizes, comp)
    need = -(-(sizes[:, None] + sizes) * 4 // 9)
    fits = (np.minimum(vectors[:, None], vectors).sum(axis=2) >= need) & (block[:, None] == block) & (comp[:, None] != comp)
    assert sorted(zip(q.tolist(), p.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(fits)), strict=True)) and len(q) > 100
    none = np.zeros(0, np.int64)
    empty = jaccard.CountForest(none, vectors[:0], none, none)
    assert not len(empty.join(block, vectors, sizes, comp)[0])


def test_quality_counts_and_verdicts(spark, docs, empty):
    def counts(t):
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        places = collections.defaultdict(list)
        for i in range(len(w) - 4):
            places[tuple(w[i : i + 5])].append(i)
        again = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(5)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again)

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rng = np.random.default_rng(0)
    rows = [(1000 + i, " ".join(f"tok{j}" for j in rng.integers(0, 5000, rng.integers(40, 200))), "en", "s", 0) for i in range(150)]
    rows += [(5000, "a b c d e f\na b c d e f\n\na b c d e f $$", "en", "s", 0), (5001, " ".join(f"x{j}###$$$" for j in range(80)), "en", "s", 0)]
    table = docs.union(spark.createDataFrame(rows, DOC))
    texts |= {r[0]: r[1] for r in rows}
    got = {r["doc_id"]: r for r in quality.judge(table).collect()}
    for k, t in texts.items():
        n, chars, symbols, lines, again = counts(t)
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, again), k
        assert r["base_failed"] == (n < 10 or 100 * again > 20 * n) and not (r["base_failed"] and r["kept"])
    assert not got[5001]["kept"] and sum(got[1000 + i]["kept"] for i in range(150)) >= 149
    assert quality.judge(empty).count() == 0 and quality.judge(awkward(spark)).count() == 5
    assert {r["doc_id"] for r in quality.keep_good(table).collect()} == {k for k, r in got.items() if r["kept"]}


def test_robust_distances_are_concentration_steps(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, 1, (240, 4)) @ rng.normal(0, 0.5, (4, 4)), rng.normal(6, 0.3, (20, 4))])
    rows = spark.createDataFrame([("g", *map(float, r), i) for i, r in enumerate(x)] + [(None, 0.0, 0.0, 0.0, 0.0, 999)], "group string, s0 double, s1 double, s2 double, s3 double, id int")
    got = {r["id"]: r["d2"] for r in quality.robust_distances(rows, pa_true()).collect()}
    rank = lambda v, q: np.sort(v)[max(0, math.ceil(q * len(v)) - 1)]
    mean, cov = np.array([rank(c, 0.5) for c in x.T]), np.diag([((rank(c, 0.75) - rank(c, 0.25)) / 1.349) ** 2 for c in x.T])
    distance = lambda: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + quality.RIDGE * np.eye(4)), x - mean)
    for _ in range(quality.STEPS):
        d = distance()
        core = x[d <= rank(d, quality.SUPPORT)]
        mean, cov = core.mean(axis=0), np.cov(core.T, bias=True)
    d = distance()
    d /= max(rank(d, 0.5) / quality.MEDIAN_CHI2, 1)
    assert got.pop(999) is None and [got[i] for i in range(len(x))] == pytest.approx(d.tolist(), rel=1e-6)


def pa_true():
    from pyspark.sql import functions as F

    return F.lit(True)


def test_quality_of_small_groups_and_awkward_rows(spark, empty):
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"tok{j}" for j in rng.integers(0, 5000, rng.integers(40, 200)))
    odd = " ".join(f"x{j}###$$$" for j in range(80))
    rows = [(i, text(), "en", "big", 0) for i in range(120)] + [(500, text(), "en", "tiny", 0), (501, odd, "en", "tiny", 0), (502, odd, "xx", None, 0), (503, text(), None, "tiny", 0)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, DOC)).collect()}
    assert [got[k]["kept"] for k in (500, 501, 502, 503)] == [True, False, False, True]  # by all of the language, by all rows
    assert quality.keep_good(empty).count() == 0 and quality.keep_good(awkward(spark)).count() == 0
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows[:40]], DOC + ", group string, n_words string")
    assert quality.keep_good(table).columns == table.columns and quality.keep_good(table).count() >= 39


def test_toxic_scores_are_those_of_a_naive_scorer(spark):
    terms, known = ["rotten", "vermin", "bad", "wretch*"], frozenset(["rotter"])
    model = toxicity.ToxicModel(terms, known, np.array([-2.0, 1.5, -0.5, 0.7, 2.0, 1.1, 0.4, 0.3]))
    texts = ["you rotten vermin", "the word rotten here", "a roten thing and vermine, bad", "rotter bat wretched wretch", '"vermin" far far far far far vermin', "", None, "x " * 20_000 + "vermin", "clean words only", "VERMIN dice rotteN du"]
    whole = [t for t in terms if t[-1] != "*"]

    def naive(text):
        w, f = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text)), [0.0] * 7
        quoted = toxicity.quoted_words(lower(text))
        for k, x in enumerate(w):
            near = [t for t in whole if len(t) >= 5 and edits(x, t) == 1]
            fuzzy, stem = x not in whole and bool(near), x not in whole and x.startswith("wretch")
            if not (x in whole or stem or (fuzzy and x not in known)):
                continue
            around = set(w[max(0, k - 4) : k + 5])
            share, quote = (1.0 if x in whole or stem else 0.6), k in quoted or bool(around & toxicity.REPORTING)
            f[4 if stem and not quote else int(quote)] += share
            f[2] += share * (not quote and bool(around & toxicity.ADDRESS))
        n = len(w)
        log = [math.log1p(f[i]) for i in range(3)]
        x = [*log, f[0] / math.sqrt(max(n, 1)), math.log1p(f[4]), f[4] / math.sqrt(max(n, 10)), min(1, f[4] / max(n, 10) * 20)]
        return 1 / (1 + math.exp(-(model.weights[0] + sum(a * b for a, b in zip(x, model.weights[1:], strict=True)))))

    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([naive(t) for t in texts], rel=1e-9)


def test_keep_clean_of_empty_and_awkward_tables(spark, empty):
    model = toxicity.ToxicModel(["vermin"], frozenset(), np.array([-3.0, 6.0, 0, 0, 0, 0, 0, 0]))
    rows = awkward(spark)
    assert toxicity.keep_clean(empty, model).count() == 0 and toxicity.keep_clean(rows, model).columns == rows.columns and toxicity.keep_clean(rows, model).count() == 5
    long = spark.createDataFrame([(1, "clean " * 200_000), (2, "clean " * 200_000 + "vermin")], "doc_id long, text string")
    assert [r["doc_id"] for r in toxicity.keep_clean(long, model).collect()] == [1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_term_automaton_is_levenshtein():
    terms = ["moron", "stupid", "bad", "trash", "trashy", "stem*"]
    automaton, rng = toxicity.TermAutomaton(terms), np.random.default_rng(2)
    words = set(terms) | {"stemming", "stem", "ste", ""}
    for t in terms[:5]:
        for _ in range(120):
            w = list(t)
            for _ in range(rng.integers(0, 3)):
                k, p = rng.integers(0, 3), int(rng.integers(0, len(w) + 1))
                w[p : p + (k != 0)] = [chr(97 + rng.integers(0, 26))] if k != 1 else []
            words.add("".join(w))
    for w in words:
        best = min((edits(w, t) for t in terms[:5] if edits(w, t) <= (1 if len(t) >= 5 else 0)), default=None)
        want = 0 if w.startswith("stem") else best
        got = automaton.match(w)
        assert (got and got[0]) == want, w


def test_toxicity(spark, empty):
    rng = np.random.default_rng(0)
    word = lambda: f"w{rng.integers(0, 400)}"
    rows, labels = [], []
    for i in range(400):
        w, bad = [word() for _ in range(40)], i % 5 == 0
        if bad:
            for t in rng.choice(["rotten", "vermin", "wretch"], 3):
                w[rng.integers(0, 40)] = str(t)
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    more = [(1001, "you wrettch you vermmin and roten one", "en", "s", 0), (1002, None, None, None, 0), (1003, "", None, None, 0), (1004, 'the word "vermin" in quotes', "en", "s", 0), (None, "rotten vermin wretch", "en", "s", 0)]
    table = spark.createDataFrame([*rows, *more], DOC)
    model = toxicity.train(table, spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int"))
    assert set(model.terms) == {"rotten", "vermin", "wretch"}
    got = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    assert sum((got[i]["predicted"] == 1) == (i % 5 == 0) for i in range(400)) >= 396
    assert got[1001]["predicted"] == 1 and got[None]["predicted"] == 1 and [got[k]["predicted"] for k in (1002, 1003, 1004)] == [0, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    clean = {r["doc_id"] for r in toxicity.keep_clean(table, model).collect()}
    assert clean == {k for k, r in got.items() if not r["predicted"]}
    nothing = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(awkward(spark), nothing).where("score > 0.01").count() == 0 and toxicity.score(empty, model).count() == 0
