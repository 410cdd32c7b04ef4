"""From applications to a published draw and its allotments, in one run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import hashing
from tamis.operators import draw, lifecycle, linkage, units
from tamis.operators.storage import keep
from tamis.plans.rules import RuleSet
from tamis.sources import documents

REVIEW_ACCEPT = 0.86


@dataclass
class Run:
    scored: DataFrame
    clusters: DataFrame
    applications: DataFrame
    entries: DataFrame
    roll_hash: str
    seed: documents.Seed
    outcome: draw.Outcome
    result_hash: str
    assigned: DataFrame
    roll_header: list[str]
    result_header: list[str]


def link_applications(apps: DataFrame, accept: float = REVIEW_ACCEPT, most: int = linkage.MAX_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Scored pairs, and clusters over the automatic links and the reviewed ones from accept on."""
    keys = keep(linkage.keyed(apps))
    scored = keep(linkage.score_blocks(keys, apps, most))
    linked = scored.where((F.col("decision") == "AUTO_LINKED") | ((F.col("decision") == "NEEDS_REVIEW") & (F.col("score") >= accept)))
    return scored, keep(linkage.clusters(apps, linkage.components(linked, apps.select("application_id"))))


def run(apps: DataFrame, checks: DataFrame, inventory: DataFrame, rules: RuleSet, nonce: str, entropy: str, frozen_at: str, executed_at: str, draw_id: str = "DRAW-1") -> Run:
    scored, clusters = link_applications(apps)
    rows = apps.join(clusters, "application_id").withColumn("status", F.when(F.col("application_id") == F.col("primary_id"), "RECEIVED").otherwise("SUPERSEDED"))
    decided = lifecycle.eligibility(checks, rows)
    rows = keep(rows.drop("status").join(decided, "application_id"))
    entries = keep(lifecycle.roll_entries(rows))
    if bad := lifecycle.one_per_household_violations(rows).limit(1).count():
        raise lifecycle.Conflict(f"a household has {bad} eligible applications")
    roll_header = documents.roll_header(rules, frozen_at, entries.count())
    roll_hash = documents.digest_of(roll_header, documents.roll_lines(entries))
    committed = hashing.commitment(nonce)
    seed = documents.Seed(nonce, committed, roll_hash, entropy, hashing.reveal(roll_hash, entropy, nonce, committed))
    outcome = draw.execute(entries, rules, seed.seed_hex)
    outcome.selections = keep(outcome.selections)
    result_header = documents.result_header(draw_id, "ROLL-1", roll_hash, rules, seed.seed_hex, executed_at, outcome)
    result_hash = documents.digest_of(result_header, documents.selection_lines(outcome.selections))
    assigned = units.assign(outcome.selections, entries, inventory, draw_id)
    return Run(scored, clusters, rows, entries, roll_hash, seed, outcome, result_hash, assigned, roll_header, result_header)
