"""The scheme office: every action of the interface, with its gates, over tables held as DataFrames.

Small registers (schemes, rule sets, rolls, draws, the audit log's tail) live on the driver, where their one writer is.
Applications, links, checks, units and allotments are DataFrames; an action replaces a table by one that has been
checkpointed, so plans do not grow with the number of actions.  Each action writes one event to the chained log.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import hashing, text
from tamis.operators import audit, draw, finders, lifecycle, linkage, units
from tamis.operators.lifecycle import Conflict, Forbidden, NotFound, require, require_other
from tamis.operators.storage import keep
from tamis.plans.requests import refused
from tamis.plans.rules import RuleSet
from tamis.sources import documents

ADMIN, VERIFIER, CLERK, APPLICANT, AUDITOR = "SCHEME_ADMIN", "VERIFIER", "DATA_ENTRY", "APPLICANT", "AUDITOR"
_APPLICATION = (
    "application_id string, scheme_code string, channel string, submitted timestamp, idempotency_key string, full_name string, relative_name string, government_id string, phone string, date_of_birth date, "
    "address_line string, ward_code string, residency_years int, vertical_code string, horizontal_codes string, unit_type_preferences string, status string, cluster_id string, superseded_by string, status_reason string, received_by string"
)
_LINK = "link_id string, left_id string, right_id string, method string, score double, decision string, features string, rationale string, review_decision string, reviewed_by string, review_note string"
_CHECK = "check_id string, application_id string, check_code string, passed boolean, reason string, evidence_ref string, decided_by string, decided_at timestamp"
_UNIT = "unit_id string, block string, unit_type string, floor_number int, withdrawn boolean, withdrawn_reason string"
_ALLOTMENT = "allotment_id string, draw_id string, application_id string, unit_id string, unit_type string, block string, pick_order int, preference_rank_honoured int, basis string, status string, fills_vacancy_of string, decided_by string, decision_reason string"
_EVENT = "sequence long, event_id string, occurred_at timestamp, actor string, actor_role string, action string, entity_type string, entity_id string, payload string, previous_hash string, hash string"


@dataclass(frozen=True)
class Actor:
    id: str
    role: str


@dataclass
class Scheme:
    code: str
    name: str
    phase: str = lifecycle.PHASES[0]
    rules: list[RuleSet] = field(default_factory=list)
    history: list[tuple[str, dt.datetime, str]] = field(default_factory=list)


@dataclass
class FrozenRoll:
    roll_id: str
    rules: RuleSet
    frozen_at: str
    entries: DataFrame
    hash: str
    header: list[str]


@dataclass
class DrawRecord:
    draw_id: str
    roll: FrozenRoll
    commitment: str
    source: str
    committed_by: str
    nonce: str
    status: str = "COMMITTED"
    entropy: str | None = None
    seed_hex: str | None = None
    executed_at: str | None = None
    result_hash: str | None = None
    outcome: draw.Outcome | None = None
    reason: str | None = None


class Office:
    def __init__(self, spark: SparkSession, clock: Callable[[], dt.datetime], scheme: str):
        self.spark, self.clock, self.code = spark, clock, scheme
        make = lambda ddl: spark.createDataFrame([], ddl)
        self.scheme_: Scheme | None = None
        self.applications, self.links, self.checks, self.units, self.allotments = map(make, (_APPLICATION, _LINK, _CHECK, _UNIT, _ALLOTMENT))
        self.rolls: dict[str, FrozenRoll] = {}
        self.draws: dict[str, DrawRecord] = {}
        self.log: list[dict] = []

    # -- register and phases

    def scheme(self) -> Scheme:
        if self.scheme_ is None:
            raise NotFound(f"no such scheme: {self.code}")
        return self.scheme_

    def note(self, actor: Actor, action: str, kind: str, key: str, payload: str) -> None:
        head = (len(self.log), self.log[-1]["hash"] if self.log else hashing.GENESIS)
        event = {"event_id": f"EVT-{head[0] + 1}", "occurred_at": self.clock().replace(microsecond=0), "actor": actor.id, "actor_role": actor.role, "action": action, "entity_type": kind, "entity_id": key, "payload": payload}
        self.log += audit.append(head, [event])

    def create(self, actor: Actor, name: str) -> Scheme:
        require(actor.role, ADMIN)
        if self.scheme_ is not None:
            raise Conflict(f"scheme {self.code} already exists")
        self.scheme_ = Scheme(self.code, name)
        self.note(actor, "SCHEME_CREATED", "SCHEME", self.code, f"name={name}")
        return self.scheme_

    def advance(self, actor: Actor, phase: str) -> None:
        require(actor.role, ADMIN)
        s = self.scheme()
        if lifecycle.next_phase(s.phase) != phase:
            raise Conflict(f"{self.code} is in {s.phase} and may only advance to {lifecycle.next_phase(s.phase)}")
        before, s.phase = s.phase, phase
        s.history.append((phase, self.clock(), actor.id))
        self.note(actor, "PHASE_ADVANCED", "SCHEME", self.code, f"from={before} to={phase}")

    def in_phase(self, *allowed: str) -> None:
        if self.scheme().phase not in allowed:
            raise Conflict(f"this needs one of {', '.join(allowed)}, but {self.code} is in {self.scheme().phase}")

    def take(self, kind: str, rows: DataFrame, key: str) -> None:
        """Refuses a table of requests in which a row breaks a rule of its kind."""
        if (bad := refused(rows, kind, key, F.lit(self.clock().date())).first()) is not None:
            raise ValueError(f"{bad[0]}: {bad['field']} {bad['fault']}")

    # -- rules and units

    def publish_rules(self, actor: Actor, rs: RuleSet) -> str:
        require(actor.role, ADMIN)
        s = self.scheme()
        if lifecycle.is_frozen(s.phase):
            raise Conflict(f"the roll is frozen (phase {s.phase})")
        if any(r.version == rs.version for r in s.rules):
            raise Conflict(f"rule set {rs.version} exists and is immutable")
        rs.plan()
        s.rules.append(rs)
        self.note(actor, "RULESET_PUBLISHED", "RULE_SET", rs.version, f"hash={rs.hash}")
        return rs.hash

    def amend_inventory(self, actor: Actor, version: str, total_units: int) -> str:
        return self.publish_rules(actor, replace(self.rules(), version=version, total_units=total_units))

    def rules(self, version: str | None = None) -> RuleSet:
        found = [r for r in self.scheme().rules if version in (None, r.version)]
        if not found:
            raise NotFound(f"no rule set {version or 'has been published'}")
        return found[-1]

    def register_units(self, actor: Actor, rows: Sequence[tuple[str, str, str, int]]) -> None:
        require(actor.role, ADMIN)
        new = self.spark.createDataFrame([(*r, False, None) for r in rows], _UNIT)
        self.take("unit", new, "unit_id")
        self.units = keep(lifecycle.upsert(self.units, new, "unit_id"))
        self.note(actor, "UNITS_REGISTERED", "SCHEME", self.code, f"count={len(rows)}")

    def withdraw_unit(self, actor: Actor, unit_id: str, reason: str) -> None:
        require(actor.role, ADMIN)
        finders.one(self.units, unit_id=unit_id)
        this = F.col("unit_id") == unit_id
        self.units = keep(self.units.withColumns({"withdrawn": this | F.col("withdrawn"), "withdrawn_reason": F.when(this, reason).otherwise(F.col("withdrawn_reason"))}))
        self.note(actor, "UNIT_WITHDRAWN", "UNIT", unit_id, f"reason={reason}")

    # -- intake

    def submit(self, actor: Actor, requests: DataFrame) -> DataFrame:
        """Stores requests (application columns without status); returns application_id and whether each was created.

        A request whose key has been seen, here or before, stands for the application that came first.
        """
        require(actor.role, APPLICANT, CLERK, ADMIN)
        self.in_phase("INTAKE_OPEN")
        self.take("intake", requests.withColumn("scheme_code", F.lit(self.code)), "application_id")
        rs = self.rules()
        if (bad := lifecycle.unknown_codes(requests, [rs.open_code, *(q.code for q in rs.reserved)], [q.code for q in rs.horizontal]).first()) is not None:
            raise ValueError(f"{bad['application_id']}: category {bad['vertical_code']} or quota {bad['unknown']} is not defined")
        known = self.applications.select(F.col("application_id").alias("request_id"), "idempotency_key", F.lit(0).alias("arrival"))
        both = keep(lifecycle.intake(known.unionByName(requests.select(F.col("application_id").alias("request_id"), "idempotency_key", F.lit(1).alias("arrival")))))
        told = both.where("arrival = 1").select(F.col("request_id").alias("application_id"), "stored_id", "created")
        new = requests.join(told.where("created").select("application_id"), "application_id", "left_semi")
        new = new.withColumns({"scheme_code": F.lit(self.code), "status": F.lit("RECEIVED"), "cluster_id": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("string"), "status_reason": F.lit(None).cast("string"), "received_by": F.lit(actor.id)})
        self.applications = keep(self.applications.unionByName(new.select(self.applications.columns)))
        self.note(actor, "APPLICATION_RECEIVED", "SCHEME", self.code, f"created={told.where('created').count()}")
        return told

    def correct(self, actor: Actor, changes: DataFrame, reason: str) -> DataFrame:
        """Corrections (application_id and changed columns); returns the text of what changed."""
        require(actor.role, CLERK, VERIFIER, ADMIN)
        if not reason.strip():
            raise ValueError("a correction requires a reason")
        if lifecycle.is_frozen(self.scheme().phase):
            raise Conflict("the roll is frozen; a correction requires a new roll")
        table, diff = lifecycle.corrections(self.applications, changes)
        diff, self.applications = keep(diff), keep(table)
        for r in diff.toLocalIterator():
            self.note(actor, "APPLICATION_CORRECTED", "APPLICATION", r["application_id"], f"reason={reason} {r['diff']}")
        return diff

    # -- duplicates

    def deduplicate(self, actor: Actor, weights: linkage.Weights = linkage.Weights()) -> dict[str, int]:
        require(actor.role, VERIFIER, ADMIN)
        self.in_phase("DEDUPLICATION")
        apps = self.applications
        keys = keep(linkage.keyed(apps))
        scored = keep(linkage.score_blocks(keys, apps, w=weights))
        old = self.links.where("review_decision <> 'PENDING'")
        new = linkage.links_to_write(scored, self.links).select("link_id", "left_id", "right_id", "method", "score", "decision", "features", "rationale", F.when(F.col("decision") == "AUTO_LINKED", "AUTO").otherwise("PENDING").alias("review_decision"), F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("string").alias("review_note"))
        self.links = keep(old.unionByName(new))
        linked = self.links.where("review_decision in ('AUTO', 'SAME_HOUSEHOLD')")
        self._cluster(linked, "Duplicate of ")
        self._pend()
        found = {"comparisons": scored.count(), "auto": new.where("decision = 'AUTO_LINKED'").count(), "queued": self.links.where("review_decision = 'PENDING'").count(), "households": self.applications.select("cluster_id").distinct().count()}
        self.note(actor, "DEDUPLICATION_COMPLETED", "SCHEME", self.code, " ".join(f"{k}={v}" for k, v in found.items()))
        return found

    def _cluster(self, linked: DataFrame, why: str) -> None:
        apps = self.applications
        found = linkage.clusters(apps, linkage.components(linked, apps.select("application_id"))).select("application_id", F.col("cluster_id").alias("c"), "primary_id")
        rows = apps.join(found, "application_id")
        first = F.col("application_id") == F.col("primary_id")
        status = F.when(~first, "SUPERSEDED").when(F.col("status") == "SUPERSEDED", "RECEIVED").otherwise(F.col("status"))
        reason = F.when(~first, F.concat(F.lit(why), "primary_id")).when(F.col("status") == "SUPERSEDED", "Carries the household's ticket after review").otherwise(F.col("status_reason"))
        self.applications = keep(rows.withColumns({"status_reason": reason, "status": status, "cluster_id": F.col("c"), "superseded_by": F.when(~first, F.col("primary_id"))}).select(apps.columns))

    def _pend(self) -> None:
        """Marks what an undecided pair touches, and clears what none touches any more."""
        wait = self.links.where("review_decision = 'PENDING'").select(F.explode(F.array("left_id", "right_id")).alias("application_id")).distinct().withColumn("_wait", F.lit(True))
        rows = self.applications.join(wait, "application_id", "left")
        status = F.when(F.col("_wait") & (F.col("status") == "RECEIVED"), "PENDING_DUPLICATE_REVIEW").when(F.col("_wait").isNull() & (F.col("status") == "PENDING_DUPLICATE_REVIEW"), "RECEIVED").otherwise(F.col("status"))
        self.applications = keep(rows.withColumn("status", status).select(self.applications.columns))

    def review(self, actor: Actor, link_id: str, decision: str, note: str = "") -> None:
        require(actor.role, VERIFIER, ADMIN)
        if decision not in ("SAME_HOUSEHOLD", "DIFFERENT_HOUSEHOLDS"):
            raise ValueError("a review ends in SAME_HOUSEHOLD or DIFFERENT_HOUSEHOLDS")
        self.in_phase("DEDUPLICATION", "VERIFICATION")
        link = finders.one(self.links, link_id=link_id).first()
        if link["review_decision"] != "PENDING":
            raise ValueError(f"link {link_id} was decided already as {link['review_decision']}")
        this = F.col("link_id") == link_id
        self.links = keep(self.links.withColumns({c: F.when(this, F.lit(v)).otherwise(F.col(c)) for c, v in (("review_decision", decision), ("reviewed_by", actor.id), ("review_note", note))}))
        if decision == "SAME_HOUSEHOLD":
            self._cluster(self.links.where("review_decision in ('AUTO', 'SAME_HOUSEHOLD')"), "Confirmed on review as the same household as ")
        self._pend()
        self.note(actor, "DUPLICATE_REVIEWED", "DUPLICATE_LINK", link_id, f"decision={decision}")

    def queue(self, actor: Actor) -> DataFrame:
        require(actor.role, ADMIN, VERIFIER, AUDITOR)
        return finders.find(self.links, F.desc("score"), "link_id", review_decision="PENDING")

    # -- eligibility and roll

    def record_checks(self, actor: Actor, rows: DataFrame) -> None:
        """Checks (check_id, application_id, check_code, passed, reason, evidence_ref); statuses follow from all checks."""
        require(actor.role, VERIFIER, ADMIN)
        self.in_phase("DEDUPLICATION", "VERIFICATION")
        self.take("record_check", rows, "check_id")
        if rows.where("not passed and (reason is null or trim(reason) = '')").limit(1).count():
            raise ValueError("a failed check requires a reason that the applicant can be shown")
        if self.applications.join(rows, "application_id", "left_semi").where(F.col("received_by") == actor.id).limit(1).count():
            raise Forbidden(f"{actor.id} received one of the applications and may not verify it")
        new = rows.withColumns({"decided_by": F.lit(actor.id), "decided_at": F.lit(self.clock())}).select(self.checks.columns)
        self.checks = keep(self.checks.unionByName(new))
        decided = lifecycle.eligibility(self.checks, self.applications).withColumnsRenamed({"status": "s", "status_reason": "r"})
        table = self.applications.join(decided, "application_id")
        self.applications = keep(table.withColumns({"status": F.col("s"), "status_reason": F.coalesce("r", "status_reason")}).select(self.applications.columns))
        self.note(actor, "ELIGIBILITY_RECORDED", "SCHEME", self.code, f"checks={rows.count()}")

    def freeze(self, actor: Actor, roll_id: str) -> FrozenRoll:
        require(actor.role, ADMIN)
        self.in_phase("VERIFICATION")
        if roll_id in self.rolls:
            raise Conflict(f"roll {roll_id} exists and is immutable")
        rs = self.rules()
        gate = lifecycle.freeze_gates(self.applications, self.units, rs.total_units).first()
        if gate["blockers"]:
            raise Conflict(gate["blockers"])
        if (twice := lifecycle.one_per_household_violations(self.applications).first()) is not None:
            raise Conflict(f"household {twice['cluster_id']} has {twice['n']} eligible applications")
        entries = keep(lifecycle.roll_entries(self.applications))
        at = documents.stamp(self.clock())
        header = documents.roll_header(rs, at, entries.count())
        roll = FrozenRoll(roll_id, rs, at, entries, documents.digest_of(header, documents.roll_lines(entries)), header)
        self.rolls[roll_id] = roll
        self.advance(actor, "ROLL_FROZEN")
        self.note(actor, "ROLL_FROZEN", "ROLL", roll_id, f"hash={roll.hash}")
        return roll

    def load_roll(self, roll_id: str) -> FrozenRoll:
        """A roll, after hashing it again."""
        if roll_id not in self.rolls:
            raise NotFound(f"no such roll: {roll_id}")
        r = self.rolls[roll_id]
        if documents.digest_of(r.header, documents.roll_lines(r.entries)) != r.hash:
            raise RuntimeError(f"roll {roll_id} does not match the hash recorded when it was frozen")
        return r

    # -- draws

    def commit(self, actor: Actor, draw_id: str, roll_id: str, source: str, nonce: str | None = None) -> str:
        require(actor.role, ADMIN)
        self.in_phase("ROLL_FROZEN")
        if not source.strip():
            raise ValueError("the public source of entropy must be named before committing")
        if draw_id in self.draws:
            raise Conflict(f"draw {draw_id} exists")
        nonce = nonce or hashing.new_nonce()
        self.draws[draw_id] = DrawRecord(draw_id, self.load_roll(roll_id), hashing.commitment(nonce), source, actor.id, nonce)
        self.advance(actor, "SEED_COMMITTED")
        self.note(actor, "SEED_COMMITTED", "DRAW", draw_id, f"commitment={self.draws[draw_id].commitment}")
        return self.draws[draw_id].commitment

    def draw(self, draw_id: str) -> DrawRecord:
        if draw_id not in self.draws:
            raise NotFound(f"no such draw: {draw_id}")
        return self.draws[draw_id]

    def _run(self, d: DrawRecord) -> tuple[draw.Outcome, str]:
        roll = self.load_roll(d.roll.roll_id)
        outcome = draw.execute(roll.entries, roll.rules, d.seed_hex)
        outcome.selections = keep(outcome.selections)
        head = documents.result_header(d.draw_id, roll.roll_id, roll.hash, roll.rules, d.seed_hex, d.executed_at, outcome)
        return outcome, documents.digest_of(head, documents.selection_lines(outcome.selections))

    def execute(self, actor: Actor, draw_id: str, entropy: str) -> str:
        require(actor.role, ADMIN)
        d = self.draw(draw_id)
        if d.status != "COMMITTED":
            raise Conflict(f"draw {draw_id} is {d.status} and is executed once")
        self.in_phase("SEED_COMMITTED")
        require_other(d.committed_by, actor.id)
        d.seed_hex = hashing.reveal(d.roll.hash, entropy, d.nonce, d.commitment)
        d.entropy, d.executed_at = entropy, documents.stamp(self.clock())
        d.outcome, d.result_hash = self._run(d)
        d.status = "EXECUTED"
        self.advance(actor, "DRAW_EXECUTED")
        self.note(actor, "DRAW_EXECUTED", "DRAW", draw_id, f"resultHash={d.result_hash}")
        return d.result_hash

    def recompute(self, draw_id: str) -> draw.Outcome:
        """The outcome, drawn again from the roll; refused if its hash differs from the stored one."""
        d = self.draw(draw_id)
        if d.seed_hex is None:
            raise Conflict(f"draw {draw_id} has not been executed")
        outcome, digest = self._run(d)
        if digest != d.result_hash:
            raise RuntimeError(f"recomputing draw {draw_id} gives another result than the stored one")
        return outcome

    def publish(self, actor: Actor, draw_id: str) -> None:
        require(actor.role, ADMIN)
        d = self.draw(draw_id)
        if d.status != "EXECUTED":
            raise Conflict(f"only an executed draw is published; {draw_id} is {d.status}")
        self.recompute(draw_id)
        d.status = "PUBLISHED"
        self.advance(actor, "RESULT_PUBLISHED")
        self.note(actor, "RESULT_PUBLISHED", "DRAW", draw_id, f"resultHash={d.result_hash}")

    def annul(self, actor: Actor, draw_id: str, reason: str) -> None:
        require(actor.role, ADMIN)
        if not reason.strip():
            raise ValueError("annulling a draw requires a reason")
        d = self.draw(draw_id)
        d.status, d.reason = "ANNULLED", reason
        self.note(actor, "DRAW_ANNULLED", "DRAW", draw_id, f"reason={reason}")

    # -- allotments

    def assign(self, actor: Actor, draw_id: str) -> DataFrame:
        require(actor.role, ADMIN)
        d = self.draw(draw_id)
        self.in_phase("RESULT_PUBLISHED")
        if finders.exists(self.allotments, draw_id=draw_id):
            raise Conflict(f"units have been assigned for draw {draw_id}")
        found = units.assign(d.outcome.selections, d.roll.entries, self.units, draw_id).where("unit_id is not null")
        new = found.select(F.concat_ws(":", "draw_id", "application_id").alias("allotment_id"), "draw_id", "application_id", "unit_id", "unit_type", "block", "pick_order", F.col("preference_rank").alias("preference_rank_honoured"), "basis", F.lit("OFFERED").alias("status"), *[F.lit(None).cast("string").alias(c) for c in ("fills_vacancy_of", "decided_by", "decision_reason")])
        self.allotments = keep(self.allotments.unionByName(new))
        self.advance(actor, "ALLOTMENT")
        self.note(actor, "UNITS_ASSIGNED", "DRAW", draw_id, f"assigned={new.count()}")
        return self.allotments

    def _decide(self, actor: Actor, allotment_id: str, status: str, reason: str) -> None:
        row = finders.one(self.allotments, allotment_id=allotment_id).first()
        if row["status"] != "OFFERED" and not (row["status"] == "ACCEPTED" and status == "FORFEITED"):
            raise Conflict(f"allotment {allotment_id} is already {row['status']}")
        this = F.col("allotment_id") == allotment_id
        self.allotments = keep(self.allotments.withColumns({c: F.when(this, F.lit(v)).otherwise(F.col(c)) for c, v in (("status", status), ("decided_by", actor.id), ("decision_reason", reason))}))
        self.note(actor, f"ALLOTMENT_{status}", "ALLOTMENT", allotment_id, f"application={row['application_id']} unit={row['unit_id']} reason={reason}")

    def accept(self, actor: Actor, allotment_id: str) -> None:
        require(actor.role, ADMIN, VERIFIER)
        self._decide(actor, allotment_id, "ACCEPTED", "Offer accepted")

    def forfeit(self, actor: Actor, allotment_id: str, reason: str) -> None:
        require(actor.role, ADMIN, VERIFIER)
        if not reason.strip():
            raise ValueError("declaring a seat vacant requires a reason")
        self._decide(actor, allotment_id, "FORFEITED", reason)

    def promote(self, actor: Actor, draw_id: str) -> DataFrame:
        """Offers for open vacancies; a second call adds none."""
        require(actor.role, ADMIN)
        d = self.draw(draw_id)
        self.in_phase("ALLOTMENT")
        own = self.allotments.where(F.col("draw_id") == draw_id)
        new = keep(units.promote_open(d.outcome.ranking, d.outcome.selections, own))
        self.allotments = keep(self.allotments.unionByName(new, allowMissingColumns=True))
        for r in new.toLocalIterator():
            self.note(actor, "WAITLIST_PROMOTED", "ALLOTMENT", r["allotment_id"], f"fills={r['fills_vacancy_of']}")
        return new

    # -- reads

    def status(self, actor: Actor) -> DataFrame:
        require(actor.role, ADMIN, VERIFIER, AUDITOR)
        return lifecycle.status_counts(self.applications)

    def public_draw(self, draw_id: str) -> DrawRecord:
        d = self.draw(draw_id)
        if d.status not in finders.PUBLIC:
            raise NotFound(f"draw {draw_id} is not published")
        self.recompute(draw_id)
        return d

    def admin_draw(self, actor: Actor, draw_id: str) -> DrawRecord:
        """A draw without its nonce until it has been revealed."""
        require(actor.role, ADMIN, VERIFIER, AUDITOR)
        d = self.draw(draw_id)
        return replace(d, nonce="") if d.status == "COMMITTED" else d

    def explain(self) -> DataFrame:
        """Every application with its checks, its lines in published draws and its allotments."""
        shown = [d for d in self.draws.values() if d.status == "PUBLISHED"]
        if not shown:
            none = self.spark.createDataFrame([], "application_id string, outcome string, pool_code string, ticket_hex string, rank_in_pool int, waitlist_position int, reason_code string, reason_text string")
            pools = self.spark.createDataFrame([], "pool string, seats int, candidates long")
            return finders.explanation(self.applications, self.checks, none, pools, self.allotments)
        o = shown[-1].outcome
        return finders.explanation(self.applications, self.checks, o.selections, o.pools, self.allotments)

    def write_bundle(self, draw_id: str, folder: str) -> dict[str, str]:
        d = self.draw(draw_id)
        if d.status != "PUBLISHED":
            raise NotFound(f"draw {draw_id} is not published")
        seed = documents.Seed(d.nonce, d.commitment, d.roll.hash, d.entropy, d.seed_hex)
        head = documents.result_header(d.draw_id, d.roll.roll_id, d.roll.hash, d.roll.rules, d.seed_hex, d.executed_at, d.outcome)
        result = documents.document(head, documents.selection_lines(d.outcome.selections))
        return documents.write_bundle(folder, d.roll.rules, documents.document(d.roll.header, documents.roll_lines(d.roll.entries)), seed, result, self.head(), draw_id, d.executed_at)

    def head(self) -> str:
        return self.log[-1]["hash"] if self.log else hashing.GENESIS

    def events(self) -> DataFrame:
        names = [x.split()[0] for x in _EVENT.split(", ")]
        return self.spark.createDataFrame([tuple(e.get(n) for n in names) for e in self.log], _EVENT)

    def verify_log(self, actor: Actor) -> DataFrame:
        require(actor.role, AUDITOR, ADMIN)
        return audit.verify(self.events())

    def trail(self, actor: Actor, kind: str, key: str) -> DataFrame:
        require(actor.role, AUDITOR, ADMIN, VERIFIER)
        return finders.find(self.events(), "sequence", entity_type=kind, entity_id=key)


def masked_identifier(apps: DataFrame, pepper: str) -> DataFrame:
    """Applications with the identifier as digest and last four digits only."""
    return apps.withColumns({"government_id_hash": hashing.government_id_digest("government_id", pepper), "government_id_last4": text.last4("government_id")}).drop("government_id")
