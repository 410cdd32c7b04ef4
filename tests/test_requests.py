"""Requests that the interface refuses, and those that it takes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamis.plans.requests import REQUESTS, refused

TODAY = dt.date(2026, 5, 1)


def told(df):
    return sorted((r[0], r["field"], r["fault"]) for r in df.collect())


def test_intake_and_units(spark):
    names = "id string, scheme_code string, channel string, full_name string, phone string, date_of_birth date, residency_years int, vertical_code string"
    good = ("a", "S", "ONLINE", "A B", None, dt.date(2026, 4, 30), 0, "OPEN")
    rows = [good, ("b", "S", None, " \t", "9" * 25, dt.date(2026, 5, 1), -1, "x" * 33), ("c", "S", "PAPER", "N" * 200, "9" * 24, None, None, "x" * 32)]
    want = [("b", "channel", "is missing"), ("b", "date_of_birth", "is not in the past"), ("b", "full_name", "is missing"), ("b", "phone", "is longer than 24 characters"), ("b", "residency_years", "is less than 0"), ("b", "vertical_code", "is longer than 32 characters")]
    assert told(refused(spark.createDataFrame(rows, names), "intake", "id", F.lit(TODAY))) == want
    units = spark.createDataFrame([("U1", "B" * 33, "ONE", 0), ("U1", None, "", -1)], "unit_id string, block string, unit_type string, floor_number int")
    assert told(refused(units, "unit", "unit_id")) == [("U1", "block", "is longer than 32 characters"), ("U1", "floor_number", "is less than 0"), ("U1", "unit_type", "is missing")]


def test_forms_and_choices(spark):
    quotas = spark.createDataFrame([("Q_1", "a label", "7.5"), ("q-1", "a|b", "-1"), ("A\n", "x\r\n", None)], "code string, label string, percent string")
    form, line = "does not have the form [A-Z0-9_]+", r"does not have the form [^|\r\n]*"
    assert told(refused(quotas, "quota", "code")) == [("A\n", "code", form), ("A\n", "label", line), ("A\n", "percent", "is missing"), ("q-1", "code", form), ("q-1", "label", line), ("q-1", "percent", "is less than 0")]
    assert [x[2][:10] for x in told(refused(spark.createDataFrame([("1", "NOWHERE"), ("2", "DRAW_EXECUTED")], "id string, to string"), "advance_phase", "id"))] == ["is none of"]


@pytest.mark.parametrize("kind", sorted(REQUESTS))
def test_awkward_tables(spark, kind):
    """Null rows miss exactly the fields that are needed; columns of the operator's own names may stand in the table."""
    null = spark.createDataFrame([(None, "x", 1, "y")], "id string, _key string, f int, fault string")
    assert [r["field"] for r in refused(null, kind, "id").collect()] == [r.name for r in REQUESTS[kind] if r.needed]
    assert refused(null.limit(0), kind, "id").count() == 0
