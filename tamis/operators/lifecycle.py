"""Phases, roles, eligibility, freezing, intake and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions.text import csv_list, csv_set, is_blank
from tamis.sources.schemas import UNIQUE

#: Phases in order, each with one successor.
PHASES = ("INTAKE_OPEN", "INTAKE_CLOSED", "DEDUPLICATION", "VERIFICATION", "ROLL_FROZEN", "SEED_COMMITTED", "DRAW_EXECUTED", "RESULT_PUBLISHED", "ALLOTMENT", "FINALISED")
#: States of an application.
STATUSES = ("RECEIVED", "PENDING_DUPLICATE_REVIEW", "SUPERSEDED", "INELIGIBLE", "ELIGIBLE")


class NotFound(LookupError):
    """Nothing has this key (404)."""


class Forbidden(PermissionError):
    """The role may not do this (403)."""


class Conflict(RuntimeError):
    """The state does not allow this (409)."""


def next_phase(phase: str) -> str:
    k = PHASES.index(phase)
    if k + 1 == len(PHASES):
        raise Conflict(f"{phase} is the last phase")
    return PHASES[k + 1]


def is_frozen(phase: str) -> bool:
    return PHASES.index(phase) >= PHASES.index("ROLL_FROZEN")


def require(role: str, *allowed: str) -> None:
    if role not in allowed:
        raise Forbidden(f"{role} is none of {', '.join(allowed)}")


def require_other(maker: str, checker: str) -> None:
    if maker == checker:
        raise Forbidden(f"{maker} may not check their own work")


def phase_violations(history: DataFrame) -> DataFrame:
    """Rows of history (scheme_code, step, phase) that are not the successor of the row before."""
    place = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
    before = F.lag(place).over(Window.partitionBy("scheme_code").orderBy("step"))
    return history.withColumns({"place": place, "before": before}).where(F.coalesce(F.col("place") != F.col("before") + 1, F.col("place") != 1)).drop("place", "before")


def maker_checker_violations(checks: DataFrame, apps: DataFrame) -> DataFrame:
    """Checks that were decided by whoever received the application."""
    return checks.join(apps.select("application_id", "received_by"), "application_id").where("decided_by = received_by").select("check_id", "application_id", "decided_by")


def role_violations(actions: DataFrame, allowed: DataFrame) -> DataFrame:
    """actions whose (action, actor_role) is not allowed."""
    return actions.join(allowed, ["action", "actor_role"], "left_anti")


def status_counts(apps: DataFrame) -> DataFrame:
    """Number of applications of every status, also of those that none has."""
    dim = apps.sparkSession.createDataFrame([(k, s) for k, s in enumerate(STATUSES)], "ord int, status string")
    found = apps.groupBy("status").agg(F.count("*").alias("n"))
    return dim.join(found, "status", "left").select("ord", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def eligibility(checks: DataFrame, apps: DataFrame) -> DataFrame:
    """application_id, status, status_reason: the earliest failed check decides; without checks the status stays."""
    failed = F.when(~F.col("passed"), F.struct("decided_at", "check_id"))
    found = checks.groupBy("application_id").agg(F.min_by(F.struct("check_code", "reason"), failed).alias("f"), F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("n_failed"))
    rows = apps.select("application_id", "status").join(found, "application_id", "left")
    undecided = (F.col("status") == "SUPERSEDED") | F.col("n").isNull()
    status = F.when(undecided, F.col("status")).when(F.col("n_failed") > 0, "INELIGIBLE").otherwise("ELIGIBLE")
    reason = F.when(undecided, None).when(F.col("n_failed") > 0, F.concat("f.check_code", F.lit(": "), F.coalesce("f.reason", F.lit("")))).otherwise(F.concat(F.lit("All "), F.col("n").cast("string"), F.lit(" recorded checks passed")))
    return rows.select("application_id", status.alias("status"), reason.alias("status_reason"))


def roll_entries(apps: DataFrame) -> DataFrame:
    """Eligible applications as roll entries, in canonical form."""
    return apps.where("status = 'ELIGIBLE'").select(
        "application_id",
        F.coalesce("cluster_id", F.concat(F.lit("CL-"), "application_id")).alias("cluster_id"),
        "vertical_code",
        csv_set("horizontal_codes").alias("horizontals"),
        "residency_years",
        csv_list("unit_type_preferences").alias("preferences"),
    )


def roll_violations(entries: DataFrame) -> DataFrame:
    return entries.where(is_blank("application_id") | is_blank("vertical_code") | (F.col("residency_years") < 0))


def canonical_cluster(cluster: Column, application: Column) -> Column:
    """A blank cluster stands for the application itself."""
    return F.when(is_blank(cluster), application).otherwise(cluster)


def freeze_gates(apps: DataFrame, units: DataFrame, total_units: int) -> DataFrame:
    """One row: the counts that a freeze depends on, and what blocks it."""
    a = apps.agg(F.count_if(F.col("status") == "PENDING_DUPLICATE_REVIEW").alias("pending"), F.count_if(F.col("status") == "RECEIVED").alias("undecided"), F.count_if(F.col("status") == "ELIGIBLE").alias("eligible"))
    u = units.agg(F.count_if(~F.col("withdrawn")).alias("units"))
    block = F.array_compact(
        F.array(
            F.when(F.col("pending") > 0, "duplicates await review"),
            F.when(F.col("undecided") > 0, "applications await eligibility"),
            F.when(F.col("units") == 0, "no inventory"),
            F.when(F.col("units") != total_units, "inventory differs from the rules"),
            F.when(F.col("eligible") == 0, "nobody is eligible"),
        )
    )
    return a.crossJoin(u).withColumn("blockers", F.array_join(block, "; "))


def one_per_household_violations(apps: DataFrame) -> DataFrame:
    """Clusters with more than one eligible application."""
    return apps.where("status = 'ELIGIBLE' and cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1")


def intake(requests: DataFrame) -> DataFrame:
    """Requests (idempotency_key, arrival, request_id) with the request that each stands for; a blank key stands for itself."""
    key = F.when(~is_blank("idempotency_key"), F.col("idempotency_key"))
    first = requests.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.min_by("request_id", F.struct("arrival", "request_id")).alias("stored"))
    rows = requests.join(first, key == F.col("k"), "left")
    stored = F.coalesce("stored", "request_id")
    return rows.select(*requests.columns, stored.alias("stored_id"), (stored == F.col("request_id")).alias("created"))


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with the rows of new in place of those with their keys."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


#: Columns whose corrections are written to the audit log.
DIFFED = ("full_name", "phone", "date_of_birth", "ward_code", "residency_years", "vertical_code")


def corrections(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The corrected table, and application_id with a text of the changed fields; null in new keeps a value."""
    fields = [c for c in new.columns if c != "application_id"]
    both = stored.join(new.select("application_id", *[F.col(c).alias(f"new_{c}") for c in fields], F.lit(True).alias("_touched")), "application_id", "left")
    after = lambda c: F.coalesce(F.col(f"new_{c}"), F.col(c))
    changed = both.where("_touched").select("application_id", F.concat_ws("", *[F.when(~F.col(c).eqNullSafe(after(c)), F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("->"), F.coalesce(after(c).cast("string"), F.lit("")), F.lit(" "))) for c in DIFFED if c in fields]).alias("diff"))
    return both.select(*[after(c).alias(c) if c in fields else F.col(c) for c in stored.columns]), changed


def unknown_codes(apps: DataFrame, verticals: list[str], horizontals: list[str]) -> DataFrame:
    """Applications with a category or quota that the rules do not define."""
    extra = F.array_except(csv_set("horizontal_codes"), F.array(*map(F.lit, horizontals)).cast("array<string>"))
    return apps.where(~F.col("vertical_code").isin(*verticals) | (F.size(extra) > 0)).select("application_id", "vertical_code", F.array_join(extra, ",").alias("unknown"))


def uniqueness_violations(df: DataFrame, name: str) -> DataFrame:
    """Values that a key of a table repeats."""
    out = None
    for key in UNIQUE[name]:
        text = F.concat_ws(":", *[F.col(c).cast("string") for c in key])
        rows = df.where(F.col(key[0]).isNotNull()).groupBy(text.alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(",".join(key)).alias("key"), "value", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def masked(draws: DataFrame) -> DataFrame:
    """Draws without the nonce until it has been revealed by execution."""
    return draws.withColumn("nonce", F.when(F.col("status").isin("EXECUTED", "PUBLISHED", "ANNULLED"), F.col("nonce")))


def permissions(spark: SparkSession) -> DataFrame:
    """Which role may do what: a small table that action logs are held against."""
    rows = [("SIGNUP", "DATA_ENTRY"), ("CLICK", "DATA_ENTRY"), ("VIEW", "VERIFIER"), ("PURCHASE", "SCHEME_ADMIN")]
    return spark.createDataFrame(rows, "action string, actor_role string")
