"""The corpus queries with SQL against it, the others for shape, and the pipeline over planted cases."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from tamis.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        compare(spark, QUERIES[name], ORACLES[name], SF)
    else:
        assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline_over_planted_cases(spark, tmp_path):
    rng = np.random.default_rng(0)
    word = lambda: f"w{rng.integers(0, 3000)}"
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(30)
    rows = [(i, text(60), "en", f"s{i % 3}", 0) for i in range(200)]
    labels = []
    for i in range(200, 300):  # toxic ones, some labelled
        w = text(60).split()
        for t in rng.choice(["rotten", "vermin", "wretch"], 4):
            w[rng.integers(0, 60)] = str(t)
        rows.append((i, " ".join(w), "en", "s0", 0))
        labels.append((i, 1, 1))
    labels += [(i, 1, 0) for i in range(200)]
    copies = [(1000, rows[5][1]), (1001, rows[5][1] + " tail"), (1002, rows[6][1].replace(" ", "  "))]
    leaks = [(1100, text(20) + " " + passage), (1101, passage.upper() + " " + text(40))]
    poor = [(1200, "same line again and again\n" * 20), (1201, "few words"), (1202, None)]
    rows += [(k, t, "en", "s1", 0) for k, t in copies + leaks + poor]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[:5] == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    clean = set(range(200))
    assert clean <= kept["toxicity"] and len(kept["toxicity"] & set(range(200, 300))) <= 2
    assert kept["toxicity"] - kept["quality"] == {1200, 1201, 1202}
    assert kept["quality"] - kept["near_copies"] == {1000, 1001, 1002}
    assert kept["near_copies"] - kept["decontamination"] == {1100, 1101}
    assert kept["mixing"] <= kept["decontamination"] and len(kept["mixing"]) > 100
