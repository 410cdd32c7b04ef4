"""Every registered query of the core against its SQL, and those without SQL for rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tamis.operators import linkage
from tamis.queries import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        compare(spark, QUERIES[name], ORACLES[name], SF)
    else:
        assert QUERIES[name](spark, SF.replace("0.001", "0.01")).count() > 0


def test_draw_does_not_depend_on_partitions(spark):
    from tamis import queries

    want = None
    for n in ("1", "7", "33"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        queries.forget()
        got = sorted(map(tuple, QUERIES["quota_draw_full"](spark, SF).collect()), key=str)
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_queries_compare_whole_blocks(spark, monkeypatch):
    from tamis import queries

    keys = spark.createDataFrame([(f"{k}{i}", [f"K:{k}"]) for k, n in (("a", 51), ("b", 250), ("c", 251)) for i in range(n)], "application_id string, keys array<string>")
    with monkeypatch.context() as m:
        m.setattr(queries, "_keyed", lambda spark, sf: keys)
        assert QUERIES["candidate_pairs"](spark, "").count() == 51 * 50 // 2 + 250 * 249 // 2
        assert [(r["key"], r["n"]) for r in QUERIES["oversized_blocks"](spark, "").collect()] == [("K:c", 251)]
    # sf0.01 has blocks of 51 to 60 records
    for name in ("candidate_pairs", "comparisons", "oversized_blocks"):
        compare(spark, QUERIES[name], ORACLES[name], SF.replace("0.001", "0.01"))


def test_the_draw_with_guarantees_keeps_its_invariants(spark):
    from tamis import queries
    from tamis.operators import draw

    o = queries.drawn(spark, SF, "full")
    assert draw.pool_violations(o).count() == 0 and draw.tier_order_violations(o).count() == 0


def test_shared_results_follow_the_tables(spark, tmp_path):
    from tamis import queries

    made = []
    count = queries.shared(lambda spark, sf, n: made.append(n) or len(made))
    (tmp_path / "t").write_text("a")
    assert [count(spark, str(tmp_path), 1), count(spark, str(tmp_path), 1), count(spark, str(tmp_path), 2)] == [1, 1, 2]
    (tmp_path / "t").write_text("other")
    assert count(spark, str(tmp_path), 1) == 3


@pytest.mark.parametrize("name", ["deterministic_links", "pending_marks", "links_of_application"])
def test_rules_on_identifiers_are_settled_where_pairs_are_made(spark, tmp_path, monkeypatch, name):
    """Also where ids repeat, as those of the view do from 1,000,000 customers on: a pair of ids has a row for each pair of its records."""
    for table in Path(SF).iterdir():
        (tmp_path / table.name).symlink_to(table)
    (tmp_path / "customer.parquet").unlink()
    keys = [*range(300), *range(100_000, 100_030), *range(1_000_000, 1_000_300)]
    duckdb.execute(f"COPY (SELECT CAST(unnest({keys}) AS BIGINT) AS c_custkey, 1 AS c_nationkey, 'BUILDING' AS c_mktsegment) TO '{tmp_path}/customer.parquet'")

    def joined(*_):
        raise AssertionError("pairs are joined with records again")

    monkeypatch.setattr(linkage, "compared", joined)
    compare(spark, QUERIES[name], ORACLES[name], str(tmp_path))
