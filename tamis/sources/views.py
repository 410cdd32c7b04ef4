"""The domain views over the star-schema tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the test views.
_GIVEN = "'RAMESH,LAKSHMI,SURESH,PRIYA,ANIL,MEENA,VENKAT,GEETHA,MANOJ,KAVITA'"
_FAMILY = "'KUMAR,REDDY,SHARMA,IYER,NAIR,GOWDA,PATIL'"
_STREETS = "'MAIN ROAD,TEMPLE ST,MARKET RD,LAKE VIEW ROAD,SCHOOL STREET'"

#: Each view's SQL; {customer} and the like stand for tables or views.
VIEWS = {
    "v_application": f"""
WITH base AS (
  SELECT c_custkey AS k, c_mktsegment AS seg,
    concat(split_part({_GIVEN}, ',', cast(1 + c_custkey % 10 AS int)), ' ', split_part({_FAMILY}, ',', cast(1 + c_custkey % 7 AS int))) AS nm
  FROM {{customer}}),
forms AS (
  SELECT k, seg, nm, 0 AS resub FROM base
  UNION ALL
  SELECT k, seg, concat(substr(nm, 1, 1), substr(nm, 3, 1), substr(nm, 2, 1), substr(nm, 4)) AS nm, 1 AS resub FROM base WHERE k % 9 = 4)
SELECT concat('APP-2026-', CASE WHEN resub = 1 THEN 'R' ELSE 'A' END, lpad(cast(k AS string), 6, '0')) AS application_id,
  'SCH-T' AS scheme_code,
  CASE WHEN (k + resub) % 3 = 0 THEN 'PAPER_KEYED' ELSE 'ONLINE' END AS channel,
  (k * 7) % 43200 + resub * 1440 AS submitted_min,
  nm AS full_name,
  concat(split_part({_GIVEN}, ',', cast(1 + (k + 3) % 10 AS int)), ' ', split_part({_FAMILY}, ',', cast(1 + k % 7 AS int))) AS relative_name,
  CASE WHEN k % 10 = 0 OR (resub = 1 AND k % 2 = 0) THEN '' ELSE cast(100000000000 + k * 37 AS string) END AS government_id,
  CASE WHEN k % 20 = 19 THEN '' ELSE concat(CASE WHEN resub = 1 AND k % 4 = 0 THEN '8' ELSE '9' END, lpad(cast((k * 7919) % 1000000000 AS string), 9, '0')) END AS phone,
  CASE WHEN resub = 1 AND k % 8 = 6 AND k % 28 < 12
    THEN make_date(cast(1960 + k % 45 AS int), cast(1 + k % 28 AS int), cast(1 + k % 12 AS int))
    ELSE make_date(cast(1960 + k % 45 AS int), cast(1 + k % 12 AS int), cast(1 + k % 28 AS int)) END AS date_of_birth,
  concat(cast(1 + k % 180 AS string), ', ', split_part({_STREETS}, ',', cast(1 + k % 5 AS int)), ', GANDHI NAGAR') AS address_line,
  CASE WHEN k % 2 = 0 THEN concat('W-', cast(11 + k % 4 AS string)) ELSE concat('OUT-', cast(10 + k % 30 AS string)) END AS ward_code,
  cast(k % 9 AS int) AS residency_years,
  CASE seg WHEN 'AUTOMOBILE' THEN 'CAT_A' WHEN 'BUILDING' THEN 'CAT_B' WHEN 'FURNITURE' THEN 'CAT_C' ELSE 'OPEN' END AS vertical_code,
  concat_ws(',', CASE WHEN k % 33 = 0 THEN 'EX_SERVICE' END, CASE WHEN k % 25 = 0 THEN 'PWD' END, CASE WHEN k % 11 = 0 THEN 'SENIOR' END, CASE WHEN k % 3 = 0 THEN 'WOMEN' END) AS horizontal_codes,
  CASE k % 4 WHEN 0 THEN 'TWO_BHK,ONE_BHK' WHEN 1 THEN 'ONE_BHK' WHEN 2 THEN 'THREE_BHK,TWO_BHK,ONE_BHK' ELSE '' END AS unit_type_preferences,
  CASE WHEN (k + resub) % 3 = 0 THEN 'clerk.07' ELSE 'self-service' END AS received_by
FROM forms""",
    "v_flat_unit": """
SELECT concat('U-', lpad(cast(p_partkey AS string), 6, '0')) AS unit_id, 'SCH-T' AS scheme_code, concat('B', cast(p_partkey % 8 AS string)) AS block,
  CASE p_size % 3 WHEN 0 THEN 'ONE_BHK' WHEN 1 THEN 'TWO_BHK' ELSE 'THREE_BHK' END AS unit_type, p_size AS floor_number, p_size > 45 AS withdrawn
FROM {part}""",
    "v_eligibility_check": """
SELECT concat('ELG-', lpad(cast(o_orderkey AS string), 8, '0')) AS check_id, concat('APP-2026-A', lpad(cast(o_custkey AS string), 6, '0')) AS application_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'INCOME_CEILING' WHEN 1 THEN 'RESIDENCE_PROOF' ELSE 'EXISTING_PROPERTY' END AS check_code,
  NOT (o_orderstatus = 'F' AND o_orderkey % 17 = 0) AS passed,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 17 = 0 THEN 'published condition not met' END AS reason,
  concat('officer.', cast(o_orderkey % 5 AS string)) AS decided_by, o_orderdate AS decided_at
FROM {orders}""",
    "v_audit_input": """
SELECT event_id + 1 AS sequence, concat('EVT-', cast(event_id + 1 AS string)) AS event_id, date_trunc('second', ts) AS occurred_at,
  concat('officer.', cast(user_id % 7 AS string)) AS actor, CASE user_id % 3 WHEN 0 THEN 'SCHEME_ADMIN' WHEN 1 THEN 'VERIFIER' ELSE 'DATA_ENTRY' END AS actor_role,
  upper(event_type) AS action, 'APPLICATION' AS entity_type, concat('APP-2026-A', lpad(cast(user_id AS string), 6, '0')) AS entity_id, props AS payload
FROM {events}""",
    "v_draw": """
SELECT concat('DRAW-', lpad(cast(s_suppkey AS string), 6, '0')) AS draw_id, concat('SCH-', cast(s_nationkey % 3 AS string)) AS scheme_code, concat('ROLL-', cast(s_suppkey % 10 AS string)) AS roll_id,
  CASE s_suppkey % 4 WHEN 0 THEN 'COMMITTED' WHEN 1 THEN 'EXECUTED' WHEN 2 THEN 'PUBLISHED' ELSE 'ANNULLED' END AS status, s_suppkey * 13 % 1000 AS committed_min
FROM {supplier}""",
    "v_rule_set": """
SELECT concat('RS-', lpad(cast(n_nationkey AS string), 3, '0')) AS version, concat('SCH-', cast(n_regionkey AS string)) AS scheme_code, n_nationkey * 7 % 25 AS published_min
FROM {nation}""",
    "v_draw_roll": """
SELECT concat('ROLL-', lpad(cast(n_nationkey AS string), 3, '0')) AS roll_id, concat('SCH-', cast(n_regionkey AS string)) AS scheme_code, n_nationkey * 11 % 25 AS frozen_min
FROM {nation}""",
    "v_duplicate_link": """
SELECT concat('APP-2026-A', lpad(cast(c_custkey AS string), 6, '0'), ':APP-2026-R', lpad(cast(c_custkey AS string), 6, '0')) AS link_id, 'SCH-T' AS scheme_code,
  concat('APP-2026-A', lpad(cast(c_custkey AS string), 6, '0')) AS left_id, concat('APP-2026-R', lpad(cast(c_custkey AS string), 6, '0')) AS right_id,
  cast(c_custkey * 37 % 1000 AS int) AS score_millis, CASE WHEN c_custkey % 3 = 0 THEN 'NEEDS_REVIEW' ELSE 'AUTO_LINKED' END AS decision,
  CASE c_custkey % 6 WHEN 0 THEN 'PENDING' WHEN 3 THEN 'SAME_HOUSEHOLD' ELSE 'AUTO' END AS review_decision
FROM {customer}""",
    "v_unit_allotment": """
SELECT concat('AL-', cast(o_orderkey AS string)) AS allotment_id, concat('DRAW-', cast(o_orderkey % 3 AS string)) AS draw_id, concat('U-', cast(o_orderkey % 997 AS string)) AS unit_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'FORFEITED' WHEN 1 THEN 'ACCEPTED' ELSE 'OFFERED' END AS status, concat('APP-2026-A', lpad(cast(o_custkey AS string), 6, '0')) AS application_id,
  o_orderkey * 31 % 10007 AS pick_order, o_orderdate AS offered_at
FROM {orders}""",
    "v_roll_entry": """
SELECT concat('ROLL-', cast(c_custkey % 4 AS string), ':APP-2026-A', lpad(cast(c_custkey AS string), 6, '0')) AS entry_id, concat('ROLL-', cast(c_custkey % 4 AS string)) AS roll_id,
  concat('APP-2026-A', lpad(cast(c_custkey AS string), 6, '0')) AS application_id, concat('CL-', cast(c_custkey % 500 AS string)) AS cluster_id
FROM {customer}""",
}
_TABLES = ("customer", "part", "orders", "events", "supplier", "nation")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"{{{t}}}" in sql})


def with_views(sql: str) -> str:
    """sql with the views it names as common table expressions, for an engine that has the tables."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    ctes = ", ".join(f"{name} AS ({VIEWS[name].format(**{t: t for t in _TABLES})})" for name in used)
    body = sql.strip()
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(word):
            return f"{word}{ctes}, {body[len(word):]}" if ctes else body
    return f"WITH {ctes} {body}" if ctes else body
