"""The schemas of the twelve tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TABLES = {
    "scheme": "scheme_code string not null, name string, phase string, active_rule_set_version string, active_roll_id string, created_at timestamp, phase_changed_at timestamp, phase_changed_by string, version long",
    "rule_set": "version string not null, scheme_code string, encoded string, rule_set_hash string, published_at timestamp, published_by string, published_rules_uri string",
    "application": "application_id string not null, scheme_code string, channel string, submitted_at timestamp, batch_id string, idempotency_key string, full_name string, relative_name string, government_id_hash string, government_id_last4 string, phone string, date_of_birth date, address_line string, ward_code string, residency_years int, vertical_code string, horizontal_codes string, unit_type_preferences string, status string, cluster_id string, superseded_by_application_id string, status_reason string, received_by string, created_at timestamp, updated_at timestamp, version long",
    "duplicate_link": "link_id string not null, scheme_code string, left_application_id string, right_application_id string, method string, score double, decision string, features string, rationale string, shared_blocking_keys string, detected_at timestamp, review_decision string, reviewed_by string, reviewed_at timestamp, review_note string",
    "eligibility_check": "check_id string not null, application_id string, check_code string, passed boolean, reason string, evidence_ref string, decided_by string, decided_at timestamp",
    "flat_unit": "unit_id string not null, scheme_code string, block string, unit_type string, floor_number int, withdrawn boolean, withdrawn_reason string",
    "draw_roll": "roll_id string not null, scheme_code string, rule_set_version string, rule_set_hash string, frozen_at timestamp, frozen_by string, roll_hash string, entry_count int, inventory_count int, exclusion_summary string, superseded_by_roll_id string",
    "roll_entry": "entry_id string not null, roll_id string, application_id string, cluster_id string, vertical_code string, horizontal_codes string, residency_years int, unit_type_preferences string",
    "draw": "draw_id string not null, scheme_code string, roll_id string, roll_hash string, rule_set_version string, status string, commitment_hex string, committed_at timestamp, committed_by string, entropy_source_description string, nonce string, public_entropy string, seed_hex string, executed_at timestamp, executed_by string, result_hash string, seat_plan string, pool_summary string, published_at timestamp, published_by string, annulment_reason string, version long",
    "draw_selection": "selection_id string not null, draw_id string, application_id string, outcome string, pool_code string, ticket_hex string, residency_tier int, rank_in_pool int, waitlist_position int, reason_code string, reason_text string",
    "unit_allotment": "allotment_id string not null, draw_id string, application_id string, unit_id string, unit_type string, block string, pick_order int, preference_rank_honoured int, basis string, status string, offered_at timestamp, decided_at timestamp, decided_by string, decision_reason string, fills_vacancy_of string, live_unit_key string, version long",
    "audit_event": "event_seq long, event_id string not null, occurred_at timestamp, actor string, actor_role string, action string, entity_type string, entity_id string, payload string, previous_hash string, hash string",
}
_TYPES = {"string": T.StringType(), "timestamp": T.TimestampType(), "date": T.DateType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _schema(ddl: str) -> T.StructType:
    fields = [x.split() for x in ddl.split(", ")]
    return T.StructType([T.StructField(f[0], _TYPES[f[1]], len(f) == 2) for f in fields])


TABLES: dict[str, T.StructType] = {name: _schema(ddl) for name, ddl in _TABLES.items()}

#: Columns whose values may not repeat; nulls may.
UNIQUE = {
    "scheme": [("scheme_code",)],
    "rule_set": [("version",)],
    "application": [("application_id",), ("idempotency_key",)],
    "duplicate_link": [("link_id",)],
    "eligibility_check": [("check_id",)],
    "flat_unit": [("unit_id",)],
    "draw_roll": [("roll_id",)],
    "roll_entry": [("entry_id",), ("roll_id", "application_id")],
    "draw": [("draw_id",)],
    "draw_selection": [("selection_id",), ("draw_id", "application_id")],
    "unit_allotment": [("allotment_id",), ("live_unit_key",)],
    "audit_event": [("event_id",), ("previous_hash",)],
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(path)


def read_jdbc(spark: SparkSession, name: str, url: str, **options: str) -> DataFrame:
    """A table of the relational store, where its driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
