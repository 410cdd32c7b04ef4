"""The office from creation to promotion: every gate, once each way."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamis.operators.lifecycle import Conflict, Forbidden, NotFound
from tamis.plans import rules
from tamis.plans.office import Actor, Office
from tamis.sources import documents

ADMIN, SECOND, VERIFIER, CLERK, AUDITOR = Actor("admin", "SCHEME_ADMIN"), Actor("second", "SCHEME_ADMIN"), Actor("ver", "VERIFIER"), Actor("clerk", "DATA_ENTRY"), Actor("aud", "AUDITOR")


def test_office(spark, tmp_path):
    now = [dt.datetime(2026, 4, 1, 4, 0, 0)]

    def clock():
        now[0] += dt.timedelta(seconds=1)
        return now[0]

    o = Office(spark, clock, "SCH-1")
    with pytest.raises(NotFound):
        o.advance(ADMIN, "INTAKE_CLOSED")
    with pytest.raises(Forbidden):
        o.create(CLERK, "x")
    o.create(ADMIN, "Housing")
    with pytest.raises(Conflict):
        o.create(ADMIN, "again")
    rs = rules.standard(6, scheme="SCH-1", horizontal=(rules.Quota("WOMEN", "Women", 30),), waitlist_size=5)
    o.publish_rules(ADMIN, rs)
    with pytest.raises(Conflict):
        o.publish_rules(ADMIN, rs)
    o.register_units(ADMIN, [(f"U{i}", "B1", ("ONE", "TWO")[i % 2], 1) for i in range(7)])
    o.withdraw_unit(ADMIN, "U6", "leaks")
    names = "application_id string, channel string, submitted timestamp, idempotency_key string, full_name string, relative_name string, government_id string, phone string, date_of_birth date, address_line string, ward_code string, residency_years int, vertical_code string, horizontal_codes string, unit_type_preferences string"
    first, second = ["RAMESH", "LAKSHMI", "ANIL", "PRIYA", "GEETHA", "MANOJ", "KAVITA", "VENKAT"], ["KUMAR", "REDDY", "SHARMA"]
    rows = [(f"A{i:02d}", "ONLINE", now[0] + dt.timedelta(minutes=i), f"k{i}", f"{first[i % 8]} {second[i % 3]}", f"{first[(i + 3) % 8]} {second[i % 3]}", str(10**11 + 37 * i), f"9{i:09d}", dt.date(1960 + i, 1 + i % 12, 1 + i), f"{i} MAIN ROAD", f"W-{i}", i % 6, "CAT_A" if i % 4 == 0 else "OPEN", "WOMEN" if i % 3 == 0 else "", "TWO,ONE") for i in range(20)]
    # the same person again: an equal identifier; and a near match that carries another identifier
    rows.append(("A90", "PAPER", now[0] + dt.timedelta(days=1), None, "KUMAR RAMESH", "x", str(10**11), "", None, "", "", 1, "OPEN", "", ""))
    rows.append(("A91", "PAPER", now[0] + dt.timedelta(days=1), None, rows[5][4], rows[5][5], "999999999999", rows[5][7], rows[5][8], rows[5][9], rows[5][10], 1, "OPEN", "", ""))
    told = {r["application_id"]: (r["stored_id"], r["created"]) for r in o.submit(CLERK, spark.createDataFrame(rows, names)).collect()}
    assert all(c for _, c in told.values())
    again = o.submit(CLERK, spark.createDataFrame([("B1", *rows[3][1:])], names)).first()
    assert (again["stored_id"], again["created"]) == ("A03", False) and o.applications.count() == 22
    with pytest.raises(ValueError, match="not defined"):
        o.submit(CLERK, spark.createDataFrame([("B2", *rows[3][1:12], "CAT_X", "", "")], names))
    diff = o.correct(CLERK, spark.createDataFrame([("A01", "9111111111")], "application_id string, phone string"), "typing error").first()
    assert diff["diff"] == "phone:9000000001->9111111111 "
    with pytest.raises(Conflict):
        o.advance(ADMIN, "VERIFICATION")
    o.advance(ADMIN, "INTAKE_CLOSED")
    o.advance(ADMIN, "DEDUPLICATION")
    found = o.deduplicate(VERIFIER)
    assert found["auto"] == 1 and found["queued"] == 1 and found["households"] == 21
    by = {r["application_id"]: r for r in o.applications.collect()}
    assert by["A90"]["superseded_by"] == "A00" and by["A05"]["status"] == by["A91"]["status"] == "PENDING_DUPLICATE_REVIEW"
    o.advance(ADMIN, "VERIFICATION")
    with pytest.raises(Conflict, match="duplicates await review"):
        o.freeze(ADMIN, "R1")
    link = o.queue(AUDITOR).first()
    with pytest.raises(ValueError):
        o.review(VERIFIER, link["link_id"], "PENDING")
    o.review(VERIFIER, link["link_id"], "SAME_HOUSEHOLD", "same flat")
    with pytest.raises(ValueError, match="decided already"):
        o.review(VERIFIER, link["link_id"], "DIFFERENT_HOUSEHOLDS")
    by = {r["application_id"]: r for r in o.applications.collect()}
    assert by["A91"]["status"] == "SUPERSEDED" and by["A05"]["status"] == "RECEIVED" and by["A91"]["superseded_by"] == "A05"
    checks = o.applications.where("status = 'RECEIVED'").select(F.concat(F.lit("C-"), "application_id").alias("check_id"), "application_id", F.lit("INCOME").alias("check_code"), (F.col("application_id") != "A19").alias("passed"), F.when(F.col("application_id") == "A19", "too high").alias("reason"), F.lit("doc").alias("evidence_ref"))
    with pytest.raises(Forbidden):
        o.record_checks(Actor("clerk", "VERIFIER"), checks)
    with pytest.raises(ValueError, match="reason"):
        o.record_checks(VERIFIER, checks.withColumn("reason", F.lit(None).cast("string")))
    with pytest.raises(Conflict, match="await eligibility"):
        o.freeze(ADMIN, "R1")
    o.record_checks(VERIFIER, checks)
    roll = o.freeze(ADMIN, "R1")
    assert roll.entries.count() == 19 and {r["status"]: r["n"] for r in o.status(AUDITOR).collect()} == {"RECEIVED": 0, "PENDING_DUPLICATE_REVIEW": 0, "SUPERSEDED": 2, "INELIGIBLE": 1, "ELIGIBLE": 19}
    with pytest.raises(Conflict, match="frozen"):
        o.publish_rules(ADMIN, rules.standard(6, version="RS-2"))
    o.commit(ADMIN, "D1", "R1", "the state lottery of 25 May")
    assert o.admin_draw(AUDITOR, "D1").nonce == ""
    with pytest.raises(Forbidden):
        o.execute(ADMIN, "D1", "LOTTERY:1")
    with pytest.raises(Conflict):
        o.recompute("D1")
    result = o.execute(SECOND, "D1", "LOTTERY:1")
    with pytest.raises(Conflict):
        o.execute(SECOND, "D1", "LOTTERY:2")
    with pytest.raises(NotFound):
        o.public_draw("D1")
    o.publish(ADMIN, "D1")
    assert o.public_draw("D1").result_hash == result
    given = o.assign(ADMIN, "D1").orderBy("pick_order").collect()
    assert len(given) == 6 and {r["unit_id"] for r in given} == {f"U{i}" for i in range(6)}
    o.accept(VERIFIER, given[0]["allotment_id"])
    with pytest.raises(Conflict):
        o.accept(VERIFIER, given[0]["allotment_id"])
    with pytest.raises(ValueError):
        o.forfeit(VERIFIER, given[1]["allotment_id"], " ")
    o.forfeit(VERIFIER, given[1]["allotment_id"], "moved away")
    new = o.promote(ADMIN, "D1").collect()
    assert len(new) == 1 and new[0]["unit_id"] == given[1]["unit_id"] and new[0]["fills_vacancy_of"] == given[1]["allotment_id"]
    assert o.promote(ADMIN, "D1").count() == 0
    line = o.explain().where(F.col("application_id") == given[0]["application_id"]).first()
    assert line["draws"][0]["outcome"] == "SELECTED" and line["allotments"][0]["unit_id"] == given[0]["unit_id"] and line["checks"][0]["passed"]
    o.write_bundle("D1", str(tmp_path / "b"))
    assert documents.verify_bundle(spark, tmp_path / "b").where("not ok").count() == 0
    assert o.verify_log(AUDITOR).first()["intact"] and o.trail(AUDITOR, "DRAW", "D1").count() == 4
    with pytest.raises(Forbidden):
        o.verify_log(CLERK)
    o.annul(ADMIN, "D1", "test")
    assert o.public_draw("D1").status == "ANNULLED"
    with pytest.raises(NotFound):
        o.write_bundle("D1", str(tmp_path / "c"))
