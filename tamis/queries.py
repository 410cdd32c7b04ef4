"""The registered queries over the domain views, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis import draw_sql as sequential
from tamis.functions import hashing, metrics, text
from tamis.operators import audit, draw, finders, lifecycle, linkage, order, snapshots, units
from tamis.operators.storage import keep, scratch
from tamis.plans import pipeline, requests, rules
from tamis.sources import bundle, documents
from tamis.sources.views import view, with_views
from tamis.streaming import audit as appended

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NONCE = hashing.text_digest("a nonce for the examples")
SEED = hashing.text_digest("a seed for the examples")
ENTROPY = "LOTTERY:481902"
STAMP = "2026-05-25T10:00:00Z"
BLOCK_CAP = linkage.MAX_BLOCK


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


def _state(spark: SparkSession, sf: str) -> tuple:
    """Names, lengths and times of the tables under sf, as the file system tells them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)))


def shared(f: Callable[..., object]) -> Callable[..., object]:
    """f(spark, sf, ...), computed once for a session and a state of the tables; the last results are kept."""
    held: dict[tuple, object] = {}

    def get(spark: SparkSession, sf: str, *more: object) -> object:
        key = (spark.sparkContext.applicationId, sf, *more, _state(spark, sf))
        if key not in held:
            while len(held) >= 8:
                held.pop(next(iter(held)))
            held[key] = f(spark, sf, *more)
        return held[key]

    get.cache_clear = held.clear
    return get


# ---- inputs


def apps(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_application").withColumnRenamed("submitted_min", "submitted")


def stated(spark: SparkSession, sf: str) -> DataFrame:
    """Applications with the status that their checks give."""
    rows = apps(spark, sf).withColumns({"status": F.lit("RECEIVED"), "cluster_id": F.lit(None).cast("string")})
    decided = lifecycle.eligibility(view(spark, sf, "v_eligibility_check"), rows)
    return rows.drop("status").join(decided, "application_id")


def flats(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_flat_unit")


def roll(spark: SparkSession, sf: str) -> DataFrame:
    """Everyone on a roll, in canonical form."""
    rows = apps(spark, sf)
    return rows.select("application_id", F.concat(F.lit("CL-"), "application_id").alias("cluster_id"), "vertical_code", text.csv_set("horizontal_codes").alias("horizontals"), "residency_years", text.csv_list("unit_type_preferences").alias("preferences"))


def total_units(spark: SparkSession, sf: str) -> int:
    return max(1, flats(spark, sf).where("not withdrawn").count() // 4)


CAT_B_FIRST = (rules.Quota("CAT_B", "Category B", Decimal("90")),)


def plain_rules(n: int, **changes: object) -> rules.RuleSet:
    return rules.standard(n, **{"horizontal": (), **changes})


@shared
def _drawn(spark: SparkSession, sf: str, kind: str) -> draw.Outcome:
    n = total_units(spark, sf)
    chosen = {"plain": lambda: plain_rules(n), "lapse": lambda: plain_rules(n, reserved=CAT_B_FIRST), "carry": lambda: plain_rules(n, reserved=CAT_B_FIRST, lapse_policy="CARRY_FORWARD"), "full": lambda: rules.standard(n)}
    return draw.execute(roll(spark, sf), chosen[kind](), SEED, check=False)


def forget() -> None:
    """Drops what queries share, so that each can be timed on its own."""
    for f in (_drawn, _keyed, _pairs, _agreeing, _clusters, _chain):
        f.cache_clear()


def drawn(spark: SparkSession, sf: str, kind: str = "plain") -> draw.Outcome:
    """The draw of the examples, once for each kind while its session lives."""
    return _drawn(spark, sf, kind)


# ---- SQL of the draw

_STATED = """
e AS (SELECT application_id, count(*) AS n, count(*) FILTER (WHERE NOT passed) AS n_failed, arg_min(check_code || ': ' || coalesce(reason, ''), (decided_at, check_id)) FILTER (WHERE NOT passed) AS why FROM v_eligibility_check GROUP BY 1),
stated AS (SELECT a.*, CASE WHEN n IS NULL THEN 'RECEIVED' WHEN n_failed > 0 THEN 'INELIGIBLE' ELSE 'ELIGIBLE' END AS status,
  CASE WHEN n IS NULL THEN NULL WHEN n_failed > 0 THEN why ELSE 'All ' || n || ' recorded checks passed' END AS status_reason FROM v_application a LEFT JOIN e USING (application_id))"""


def draw_sql(select: str, shares: tuple[tuple[str, int], ...] = (("CAT_A", 1500), ("CAT_B", 750), ("CAT_C", 2700)), lapse: bool = True, waitlist: int = 150) -> str:
    """The draw without guarantees as one statement; shares in hundredths of a percent."""
    values = ", ".join(f"({k}, '{c}', {p})" for k, (c, p) in enumerate((("OPEN", 10000 - sum(p for _, p in shares)), *shares)))
    return f"""
WITH u AS (SELECT greatest(1, count(*) // 4) AS total FROM v_flat_unit WHERE NOT withdrawn),
s AS (SELECT ord, code, pct * total // 10000 AS fl, pct * total % 10000 AS rem, total FROM (VALUES {values}) AS v(ord, code, pct), u),
plan AS (SELECT ord, code AS pool, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, ord) <= total - sum(fl) OVER () THEN 1 ELSE 0 END AS INTEGER) AS seats FROM s),
r AS (SELECT application_id, vertical_code, sha256('ticket/1|{SEED}|' || application_id) AS ticket, CASE WHEN residency_years >= 3 THEN 0 ELSE 1 END AS tier FROM v_application),
o AS (SELECT 'OPEN' AS pool, r.*, row_number() OVER (ORDER BY tier, ticket, application_id) AS rk FROM r),
w1 AS (SELECT application_id, pool, rk FROM o JOIN plan USING (pool) WHERE rk <= seats),
q AS (SELECT vertical_code AS pool, r.*, row_number() OVER (PARTITION BY vertical_code ORDER BY tier, ticket, application_id) AS rk FROM r
  WHERE vertical_code IN (SELECT pool FROM plan WHERE ord > 0) AND application_id NOT IN (SELECT application_id FROM w1)),
w2 AS (SELECT application_id, pool, rk FROM q JOIN plan USING (pool) WHERE rk <= seats),
un AS (SELECT sum(seats) - (SELECT count(*) FROM w2) AS lapsed FROM plan WHERE ord > 0),
l AS (SELECT 'OPEN_LAPSED' AS pool, r.*, row_number() OVER (ORDER BY tier, ticket, application_id) AS rk FROM r
  WHERE {str(lapse).lower()} AND (SELECT lapsed FROM un) > 0 AND application_id NOT IN (SELECT application_id FROM w1 UNION ALL SELECT application_id FROM w2)),
w3 AS (SELECT application_id, pool, rk FROM l WHERE rk <= (SELECT lapsed FROM un)),
ranking AS (SELECT * FROM o UNION ALL SELECT * FROM q UNION ALL SELECT * FROM l),
pools AS (SELECT p.ord AS pool_ord, p.pool, p.pool AS vertical_code, p.seats, (SELECT count(*) FROM ranking k WHERE k.pool = p.pool) AS candidates FROM plan p
  UNION ALL SELECT (SELECT count(*) FROM plan), 'OPEN_LAPSED', 'OPEN', (SELECT lapsed FROM un), (SELECT count(*) FROM l) WHERE {str(lapse).lower()} AND (SELECT lapsed FROM un) > 0),
won AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3),
wl AS (SELECT application_id, pool, rk, row_number() OVER (PARTITION BY pool ORDER BY rk) AS position, pool_ord FROM ranking JOIN pools USING (pool) WHERE application_id NOT IN (SELECT application_id FROM won)),
best AS (SELECT * FROM wl QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY position, pool_ord) = 1),
sel AS (SELECT r.application_id, CASE WHEN won.pool IS NOT NULL THEN 'SELECTED' WHEN position <= {waitlist} THEN 'WAITLISTED' ELSE 'NOT_SELECTED' END AS outcome,
  coalesce(won.pool, best.pool, 'OPEN') AS pool_code, ticket AS ticket_hex, tier AS residency_tier, CAST(coalesce(won.rk, best.rk, 0) AS INTEGER) AS rank_in_pool,
  CASE WHEN won.pool IS NULL AND position <= {waitlist} THEN CAST(position AS INTEGER) END AS waitlist_position,
  CASE WHEN won.pool = 'OPEN_LAPSED' THEN 'SELECTED_IN_LAPSED_OPEN_POOL' WHEN won.pool IS NOT NULL THEN 'SELECTED_ON_MERIT' WHEN p.seats = 0 THEN 'NOT_SELECTED_NO_SEATS_IN_POOL'
    WHEN position <= {waitlist} THEN 'WAITLISTED_BEHIND_SELECTED' ELSE 'NOT_SELECTED_RANK_BELOW_SEATS' END AS reason_code
  FROM r LEFT JOIN won USING (application_id) LEFT JOIN best USING (application_id) LEFT JOIN pools p ON p.pool = coalesce(won.pool, best.pool, 'OPEN'))
{select}"""


_SELECTION = ("application_id", "outcome", "pool_code", "ticket_hex", "residency_tier", "rank_in_pool", "waitlist_position", "reason_code")
_SELECT = f"SELECT {', '.join(_SELECTION)} FROM sel"


# ---- lottery and draw


@query(f"""WITH u AS (SELECT greatest(1, count(*) // 4) AS total FROM v_flat_unit WHERE NOT withdrawn),
t AS (SELECT application_id, sha256('ticket/1|{SEED}|' || application_id) AS ticket_hex FROM v_application),
k AS (SELECT *, CAST(row_number() OVER (ORDER BY ticket_hex, application_id) AS INTEGER) AS rank FROM t)
SELECT application_id, ticket_hex, rank, CASE WHEN rank <= total THEN 'SELECTED' ELSE 'NOT_SELECTED' END AS outcome FROM k, u""")
def plain_lottery(spark: SparkSession, sf: str) -> DataFrame:
    """An outcome for everyone in ticket order, without tiers or categories."""
    rows = apps(spark, sf).select("application_id", hashing.ticket(SEED, "application_id").alias("ticket"), F.lit(0).alias("tier"), F.lit("ALL").alias("pool"))
    outcome = F.when(F.col("rank") <= total_units(spark, sf), "SELECTED").otherwise("NOT_SELECTED")
    return draw.ranked(rows).select("application_id", F.col("ticket").alias("ticket_hex"), "rank", outcome.alias("outcome"))


@query(f"SELECT application_id, sha256('ticket/1|{SEED}|' || application_id) AS ticket_hex, CASE WHEN residency_years >= 3 THEN 0 ELSE 1 END AS tier FROM v_application")
def tickets(spark: SparkSession, sf: str) -> DataFrame:
    return draw.ticketed(roll(spark, sf), plain_rules(1), SEED).select("application_id", F.col("ticket").alias("ticket_hex"), "tier")


@query(draw_sql("SELECT application_id, CAST(rk AS INTEGER) AS rank FROM o"))
def open_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = draw.ticketed(roll(spark, sf), plain_rules(1), SEED).withColumn("pool", F.lit("OPEN"))
    return draw.ranked(rows).select("application_id", "rank")


@query(draw_sql(_SELECT))
def quota_draw_no_minima(spark: SparkSession, sf: str) -> DataFrame:
    return drawn(spark, sf).selections.select(*_SELECTION)


@query(draw_sql(_SELECT, (("CAT_B", 9000),)))
def lapsed_pool(spark: SparkSession, sf: str) -> DataFrame:
    return drawn(spark, sf, "lapse").selections.select(*_SELECTION)


@query(draw_sql(_SELECT, (("CAT_B", 9000),), lapse=False))
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    return drawn(spark, sf, "carry").selections.select(*_SELECTION)


@query(draw_sql("SELECT pool, vertical_code, CAST(seats AS INTEGER) AS seats, CAST(candidates AS BIGINT) AS candidates, CAST(seats - least(seats, candidates) AS BIGINT) AS unfilled FROM pools", (("CAT_B", 9000),)))
def pool_summary(spark: SparkSession, sf: str) -> DataFrame:
    return drawn(spark, sf, "lapse").pools.drop("pool_ord")


@query(draw_sql("SELECT application_id, pool_code, waitlist_position FROM sel WHERE outcome = 'WAITLISTED' AND pool_code = 'CAT_A'"))
def waitlist(spark: SparkSession, sf: str) -> DataFrame:
    return finders.waitlist(drawn(spark, sf).selections, "CAT_A").select("application_id", "pool_code", "waitlist_position")


@query(draw_sql("SELECT outcome, reason_code, count(*) AS n FROM sel GROUP BY ALL"))
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return finders.count_by(drawn(spark, sf).selections, "outcome", "reason_code")


@query(draw_sql("SELECT application_id, rank_in_pool, pool_code FROM sel WHERE outcome = 'SELECTED' ORDER BY ticket_hex"))
def winners_by_ticket(spark: SparkSession, sf: str) -> DataFrame:
    return finders.find(drawn(spark, sf).selections, "ticket_hex", outcome="SELECTED").select("application_id", "rank_in_pool", "pool_code")


@query(draw_sql("""SELECT application_id, 'sel=' || application_id || '|' || outcome || '|' || pool_code || '|' || ticket_hex || '|' || residency_tier || '|' || rank_in_pool || '|' || coalesce(CAST(waitlist_position AS VARCHAR), '-') || '|' || reason_code AS line FROM sel"""))
def result_lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents.selection_lines(drawn(spark, sf).selections)


@query(draw_sql("""SELECT application_id, CASE outcome WHEN 'SELECTED' THEN 'Selected in pool ' || pool_code || ' at rank ' || rank_in_pool || ' of ' || candidates || ' candidates for ' || seats || ' seats.'
  ELSE 'Ranked ' || rank_in_pool || ' of ' || candidates || ' in pool ' || pool_code || ', which had ' || seats || ' seats.' || coalesce(' Waitlist position ' || waitlist_position || '.', '') END
  || CASE reason_code WHEN 'SELECTED_ON_MERIT' THEN ' The ticket alone decided.'
    WHEN 'NOT_SELECTED_NO_SEATS_IN_POOL' THEN ' The rules give this pool no seats.'
    WHEN 'WAITLISTED_BEHIND_SELECTED' THEN ' If a winner gives up a seat or fails verification, the waitlist is called in order.'
    WHEN 'NOT_SELECTED_RANK_BELOW_SEATS' THEN ' Seats and waitlist ended before this rank.' END AS reason_text FROM sel JOIN pools ON pool = pool_code"""))
def reason_texts(spark: SparkSession, sf: str) -> DataFrame:
    return drawn(spark, sf).selections.select("application_id", "reason_text")


_FULL = "WITH RECURSIVE " + sequential.draw_ctes(seed=f"'{SEED}'")
_WANTS = "a_wants AS (SELECT application_id, list_filter(string_split(unit_type_preferences, ','), lambda x : x <> '') AS wants FROM v_application)"


@query(f"{_FULL} SELECT * FROM d_sel")
def quota_draw_full(spark: SparkSession, sf: str) -> DataFrame:
    """The draw with guarantees."""
    return drawn(spark, sf, "full").selections


@query(f"{_FULL} SELECT * FROM d_notes")
def topup_notes(spark: SparkSession, sf: str) -> DataFrame:
    return drawn(spark, sf, "full").notes


@query(draw_sql("""SELECT pool_code, worst, best FROM (SELECT pool_code, max(residency_tier) AS worst FROM (SELECT pool_code, residency_tier, CASE WHEN outcome <> 'SELECTED' AND application_id LIKE '%7' THEN 'SELECTED_ON_MERIT' ELSE reason_code END AS why FROM sel) WHERE why = 'SELECTED_ON_MERIT' GROUP BY 1)
JOIN (SELECT pool AS pool_code, min(tier) AS best FROM ranking WHERE application_id NOT IN (SELECT application_id FROM sel WHERE outcome = 'SELECTED' OR application_id LIKE '%7') GROUP BY 1) USING (pool_code) WHERE worst > best"""))
def tier_order_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Of a result in which losers whose id ends in 7 were made winners."""
    o = drawn(spark, sf)
    forged = (F.col("outcome") != "SELECTED") & F.col("application_id").endswith("7")
    rows = o.selections.withColumns({"outcome": F.when(forged, "SELECTED").otherwise(F.col("outcome")), "reason_code": F.when(forged, "SELECTED_ON_MERIT").otherwise(F.col("reason_code"))})
    return draw.tier_order_violations(replace(o, selections=rows))


_OTHER = hashing.text_digest("another seed")


@query(draw_sql("SELECT count(*) AS overlap FROM sel JOIN (SELECT application_id FROM (SELECT application_id, row_number() OVER (ORDER BY sha256('ticket/1|%s|' || application_id), application_id) AS k FROM v_application) WHERE k <= (SELECT total FROM u)) USING (application_id) WHERE outcome = 'SELECTED'" % _OTHER))
def draw_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """How many a plain lottery with another seed also selects."""
    n = total_units(spark, sf)
    rows = draw.ranked(apps(spark, sf).select("application_id", hashing.ticket(_OTHER, "application_id").alias("ticket"), F.lit(0).alias("tier"), F.lit("ALL").alias("pool")))
    return draw.overlap(drawn(spark, sf).selections, rows.select("application_id", F.when(F.col("rank") <= n, "SELECTED").alias("outcome")))


@query(draw_sql("""SELECT application_id, outcome AS published, CASE WHEN substr(application_id, 12, 6) LIKE '%07' THEN 'SELECTED' ELSE outcome END AS claimed FROM sel
WHERE substr(application_id, 12, 6) LIKE '%07' AND outcome <> 'SELECTED'"""))
def result_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a forged result that differ from the recomputed one."""
    true = drawn(spark, sf).selections
    forged = true.withColumn("outcome", F.when(F.substring("application_id", 12, 6).endswith("07"), "SELECTED").otherwise(F.col("outcome")))
    return draw.differences(true, forged).select("application_id", F.col("published.outcome").alias("published"), F.col("recomputed.outcome").alias("claimed"))


@query(draw_sql("SELECT count(*) AS differences FROM sel WHERE outcome <> 'SELECTED' AND application_id LIKE '%07'"))
def recompute_on_read(spark: SparkSession, sf: str) -> DataFrame:
    """A second execution from the roll, compared with a stored result whose losers with ids in 07 were made winners."""
    again = draw.execute(roll(spark, sf).repartition(7), plain_rules(total_units(spark, sf)), SEED, check=False)
    forged = F.when(F.col("application_id").endswith("07"), "SELECTED").otherwise(F.col("outcome"))
    return draw.differences(drawn(spark, sf).selections.withColumn("outcome", forged), again.selections).agg(F.count("*").alias("differences"))


# ---- rules, seats, seeds


@query("""WITH u AS (SELECT greatest(1, count(*) // 4) AS total FROM v_flat_unit WHERE NOT withdrawn),
s AS (SELECT ord, code, pct * total // 10000 AS fl, pct * total % 10000 AS rem, total FROM (VALUES (0, 'OPEN', 5050), (1, 'CAT_A', 1500), (2, 'CAT_B', 750), (3, 'CAT_C', 2700)) AS v(ord, code, pct), u)
SELECT ord AS pool_ord, code AS pool, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, ord) <= total - sum(fl) OVER () THEN 1 ELSE 0 END AS INTEGER) AS seats FROM s""")
def seat_plan(spark: SparkSession, sf: str) -> DataFrame:
    return rules.plan_frame(spark, rules.standard(total_units(spark, sf)).plan())


_MINIMA = "(VALUES ('WOMEN', 30), ('PWD', 5), ('EX_SERVICE', 3), ('SENIOR', 5)) AS v(code, share)"


@query(draw_sql(f"SELECT pool, code, CAST((seats * share * 2 + 100) // 200 AS INTEGER) AS minimum FROM plan, {_MINIMA}"))
def horizontal_minima(spark: SparkSession, sf: str) -> DataFrame:
    plan = rules.standard(total_units(spark, sf)).plan()
    return spark.createDataFrame([(v.code, m.code, m.seats) for v in plan for m in v.minima], "pool string, code string, minimum int")


#: The text of the standard rules, over the units in the table.
_RULES_SQL = """u AS (SELECT greatest(1, count(*) // 4) AS total FROM v_flat_unit WHERE NOT withdrawn),
x AS (SELECT array_to_string(['version=RS-1', 'schemeCode=SCH-T', 'totalUnits=' || total, 'openCode=OPEN', 'reserved=CAT_A|Category A|15.0000', 'reserved=CAT_B|Category B|7.5000', 'reserved=CAT_C|Category C|27.0000',
  'horizontal=WOMEN|Women|30.0000', 'horizontal=PWD|Persons with disability|5.0000', 'horizontal=EX_SERVICE|Former service|3.0000', 'horizontal=SENIOR|Seniors|5.0000', 'residency=PRIORITY_TIER|3', 'lapse=LAPSE_TO_OPEN', 'waitlistSize=150', 'rulesUri='], chr(10)) || chr(10) AS text FROM u)"""


@query(draw_sql("SELECT string_agg(pool || '=' || seats, ',' ORDER BY ord) AS summary FROM plan"))
def plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(rules.plan_summary(rules.standard(total_units(spark, sf)).plan()),)], "summary string")


@query("SELECT DISTINCT l_discount AS share, CAST(CAST(round(l_discount * 100, 4) AS DECIMAL(7, 4)) AS VARCHAR) AS percent FROM lineitem")
def percent_texts(spark: SparkSession, sf: str) -> DataFrame:
    shares = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_discount").alias("share")).distinct()
    return shares.withColumn("percent", text.percent_text(F.round(F.col("share") * 100, 4)))


@query(f"""WITH {_RULES_SQL}, t AS (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM x)
SELECT CAST(n AS INTEGER) AS n, split_part(line, '=', 1) AS key, substr(line, strpos(line, '=') + 1) AS value FROM t WHERE line <> ''""")
def rules_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """The directives of a rule set's text, after a round trip through its codec."""
    lines = rules.decode(rules.standard(total_units(spark, sf)).encode()).encode().split("\n")
    return spark.createDataFrame([(k, *x.split("=", 1)) for k, x in enumerate(lines, 1) if x], "n int, key string, value string")


@query(f"WITH {_RULES_SQL} SELECT sha256(text) AS rule_hash FROM x")
def rules_hash(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(rules.standard(total_units(spark, sf)).hash,)], "rule_hash string")


@query(f"SELECT sha256('commit/1|{NONCE}') AS commitment, sha256('seed/1|' || sha256('roll') || '|{ENTROPY}|{NONCE}') AS seed_hex")
def commitment_and_seed(spark: SparkSession, sf: str) -> DataFrame:
    committed = hashing.commitment(NONCE)
    return spark.createDataFrame([(committed, hashing.reveal(hashing.text_digest("roll"), ENTROPY, NONCE, committed))], "commitment string, seed_hex string")


_ROLL_LINE = """'e=' || application_id || '|CL-' || application_id || '|' || vertical_code || '|' || array_to_string(list_sort(list_filter(string_split(horizontal_codes, ','), lambda x : x <> '')), ',') || '|' || residency_years || '|' || unit_type_preferences"""


@query(f"SELECT application_id, {_ROLL_LINE} AS line FROM v_application")
def roll_lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents.roll_lines(roll(spark, sf))


@query(f"""WITH {_RULES_SQL}, l AS (SELECT application_id, {_ROLL_LINE} AS line FROM v_application)
SELECT sha256('roll/1' || chr(10) || 'schemeCode=SCH-T' || chr(10) || 'ruleSetVersion=RS-1' || chr(10) || 'ruleSetHash=' || (SELECT sha256(text) FROM x) || chr(10) || 'frozenAt={STAMP}' || chr(10) || 'entryCount=' || count(*) || chr(10) || string_agg(line || chr(10), '' ORDER BY application_id)) AS hash FROM l""")
def roll_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = roll(spark, sf)
    header = documents.roll_header(rules.standard(total_units(spark, sf)), STAMP, rows.count())
    return documents.ordered_digest(header, documents.roll_lines(rows)).select("hash")


@query("SELECT application_id, 'CL-' || application_id AS cluster_id, vertical_code, array_to_string(list_sort(list_filter(string_split(horizontal_codes, ','), lambda x : x <> '')), ',') AS horizontals, residency_years, unit_type_preferences AS preferences FROM stated WHERE status = 'ELIGIBLE'".join((f"WITH {_STATED.strip()} ", "")))
def roll_entries(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.roll_entries(stated(spark, sf)).withColumns({c: F.array_join(c, ",") for c in ("horizontals", "preferences")})


@query("""WITH f AS (SELECT application_id AS id, CASE WHEN application_id LIKE '%11' THEN '  ' ELSE application_id END AS application_id, CASE WHEN application_id LIKE '%22' THEN '' ELSE vertical_code END AS vertical_code,
  CASE WHEN application_id LIKE '%33' THEN -1 ELSE residency_years END AS residency_years FROM v_application)
SELECT 'CL-' || id AS cluster_id FROM f WHERE trim(application_id) = '' OR trim(vertical_code) = '' OR residency_years < 0""")
def roll_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Of a roll in which some ids, categories and years were spoilt."""
    spoilt = lambda c, end, to: F.when(F.col("cluster_id").endswith(end), to).otherwise(F.col(c))
    rows = roll(spark, sf).withColumns({"application_id": spoilt("application_id", "11", "  "), "vertical_code": spoilt("vertical_code", "22", ""), "residency_years": spoilt("residency_years", "33", -1)})
    return lifecycle.roll_violations(rows).select("cluster_id")


_SPOILT = """CASE WHEN application_id LIKE '%3' THEN left(application_id, length(application_id) - 1) || '2' WHEN application_id LIKE '%55' THEN 'APP-2026-A000001' ELSE application_id END"""


@query(f"""WITH l AS (SELECT row_number() OVER (ORDER BY application_id) AS line_no, {_SPOILT} AS application_id FROM v_application), p AS (SELECT *, lag(application_id) OVER (ORDER BY line_no) AS previous FROM l)
SELECT line_no, application_id, previous, CASE WHEN application_id = previous THEN 'repeat' ELSE 'inversion' END AS fault FROM p WHERE application_id <= previous""")
def roll_order_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a roll file that do not come after the line before; some ids were repeated and some moved."""
    lines = order.numbered(apps(spark, sf).select("application_id", F.lit("roll").alias("file")), "file", "application_id", "line_no")
    spoilt = F.when(F.col("application_id").endswith("3"), F.regexp_replace("application_id", "3$", "2")).when(F.col("application_id").endswith("55"), "APP-2026-A000001").otherwise(F.col("application_id"))
    return order.order_violations(lines.withColumn("application_id", spoilt), "line_no", "application_id")


_FORGED = "CASE WHEN application_id LIKE '%77' THEN replace(line, '|CL-', '|XX-') ELSE line END"
_ROLL_DOCUMENT = f"""'roll/1' || chr(10) || 'schemeCode=SCH-T' || chr(10) || 'ruleSetVersion=RS-1' || chr(10) || 'ruleSetHash=' || (SELECT sha256(text) FROM x) || chr(10) || 'frozenAt={STAMP}' || chr(10) || 'entryCount=' || count(*) || chr(10) || string_agg({{}} || chr(10), '' ORDER BY application_id)"""


@query(f"""WITH {_RULES_SQL}, l AS (SELECT application_id, {_ROLL_LINE} AS line FROM v_application), d AS (SELECT {_ROLL_DOCUMENT.format('line')} AS said, {_ROLL_DOCUMENT.format(_FORGED)} AS there FROM l)
SELECT file, CAST(strlen(there) AS BIGINT) AS bytes, sha256(there) AS hash, sha256(said) AS stated_hash, sha256(there) = sha256(said) AS matches
FROM (SELECT 'roll.txt' AS file, said, there FROM d UNION ALL SELECT 'rules.txt', text, text FROM x)""")
def bundle_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of a published bundle, written in parts and read in ranges, against its manifest; the roll was forged after it was published."""
    rows, of, at = roll(spark, sf), rules.standard(total_units(spark, sf)), scratch(spark, "bundle")
    head, lines = documents.roll_header(of, STAMP, rows.count()), documents.roll_lines(rows)
    bundle.publish(at, [f"schemeCode={of.scheme_code}"], {"rules.txt": (of.encode().rstrip("\n").split("\n"), None), "roll.txt": (head, lines)})
    forged = lines.withColumn("line", F.when(F.col("application_id").endswith("77"), F.replace("line", F.lit("|CL-"), F.lit("|XX-"))).otherwise(F.col("line")))
    bundle.write(at, "roll.txt", head, forged)
    return bundle.compared(bundle.read(spark, at))


_LF = "chr(10)"
_SEL_LINE = "'sel=' || application_id || '|' || outcome || '|' || pool_code || '|' || ticket_hex || '|' || residency_tier || '|' || rank_in_pool || '|' || coalesce(CAST(waitlist_position AS VARCHAR), '-') || '|' || reason_code"


@query(draw_sql(f"""SELECT sha256(array_to_string(['result/1', 'drawId=DRAW-1', 'rollId=ROLL-1', 'rollHash=' || sha256('roll'), 'ruleSetVersion=RS-1',
  'ruleSetHash=' || (SELECT sha256(array_to_string(['version=RS-1', 'schemeCode=SCH-T', 'totalUnits=' || total, 'openCode=OPEN', 'reserved=CAT_A|Category A|15.0000', 'reserved=CAT_B|Category B|7.5000', 'reserved=CAT_C|Category C|27.0000',
    'residency=PRIORITY_TIER|3', 'lapse=LAPSE_TO_OPEN', 'waitlistSize=150', 'rulesUri='], {_LF}) || {_LF}) FROM u),
  'seedHex={SEED}', 'executedAt={STAMP}', 'totalUnits=' || (SELECT total FROM u)], {_LF}) || {_LF}
  || (SELECT string_agg('plan=' || pool || '|' || seats || {_LF}, '' ORDER BY ord) FROM plan)
  || (SELECT string_agg('pool=' || pool || '|' || vertical_code || '|' || seats || '|' || candidates || '|' || (seats - least(seats, candidates)) || {_LF}, '' ORDER BY pool_ord) FROM pools)
  || (SELECT string_agg({_SEL_LINE} || {_LF}, '' ORDER BY application_id) FROM sel)) AS hash"""))
def result_hash(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of the whole result document."""
    o, of = drawn(spark, sf), plain_rules(total_units(spark, sf))
    head = documents.result_header("DRAW-1", "ROLL-1", hashing.text_digest("roll"), of, SEED, STAMP, o)
    return documents.ordered_digest(head, documents.selection_lines(o.selections)).select("hash")


# ---- text keys

_TOKENS = """list_filter(string_split_regex(upper(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), '[^A-Z0-9]+'), lambda t : t <> '' AND t NOT IN ({noise}) AND NOT regexp_full_match(t, '[A-Z]'))""".replace("{noise}", ", ".join(f"'{t}'" for t in text.NOISE_TOKENS))
_GID = "(CASE WHEN regexp_full_match(government_id, '[0-9]{8,}') THEN government_id ELSE '' END)"
_PHONE = "right(regexp_replace(phone, '\\D', '', 'g'), 10)"
_NAME = f"array_to_string(list_sort({_TOKENS.replace('{x}', 'full_name')}), ' ')"
_RELATIVE = f"array_to_string(list_sort({_TOKENS.replace('{x}', 'relative_name')}), ' ')"


def _soundex_sql(s: str) -> str:
    t = f"translate(substr({s}, 1, 1) || regexp_replace(substr({s}, 2), '[HW]', '', 'g'), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000')"
    for d in range(7):
        t = f"regexp_replace({t}, '{d}+', '{d}', 'g')"
    return f"(CASE WHEN {s} = '' THEN '' ELSE rpad(substr(substr({s}, 1, 1) || replace(substr({t}, 2), '0', ''), 1, 4), 4, '0') END)"


_FIRST, _LAST = (f"coalesce(regexp_replace({_TOKENS.replace('{x}', 'full_name')}[{k}], '[^A-Z]', '', 'g'), '')" for k in (1, -1))


@query(f"SELECT application_id, {_NAME} AS name_key, {_RELATIVE} AS relative_key FROM v_application")
def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    return apps(spark, sf).select("application_id", text.name_key("full_name").alias("name_key"), text.name_key("relative_name").alias("relative_key"))


@query(f"SELECT application_id, {_PHONE} AS phone_key, {_GID} AS gid_key, CASE WHEN length(government_id) >= 4 THEN right(government_id, 4) ELSE '' END AS last4, CASE WHEN length(government_id) >= 8 THEN sha256('gid/1|pepper|' || government_id) ELSE '' END AS gid_digest FROM v_application")
def identifier_keys(spark: SparkSession, sf: str) -> DataFrame:
    return apps(spark, sf).select("application_id", text.phone_key("phone").alias("phone_key"), text.government_id_key("government_id").alias("gid_key"), text.last4("government_id").alias("last4"), hashing.government_id_digest("government_id", "pepper").alias("gid_digest"))


_WORDS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.ADDRESS_WORDS.items())


@query(f"""WITH t AS (SELECT application_id, list_filter(string_split_regex(upper(address_line), '[^A-Z0-9]+'), lambda t : length(t) >= 2) AS ts FROM v_application),
w AS (SELECT application_id, i, CASE t {_WORDS_SQL} ELSE t END AS word FROM (SELECT application_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM t)),
d AS (SELECT application_id, word, min(i) AS i FROM w GROUP BY ALL)
SELECT application_id, string_agg(word, ' ' ORDER BY i) AS address FROM d GROUP BY application_id""")
def address_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return apps(spark, sf).select("application_id", F.array_join(text.address_tokens("address_line"), " ").alias("address"))


@query(f"SELECT application_id, {_soundex_sql(_FIRST)} AS code FROM v_application")
def soundex_name(spark: SparkSession, sf: str) -> DataFrame:
    return apps(spark, sf).select("application_id", text.soundex(F.get(text.name_tokens("full_name"), F.lit(0))).alias("code"))


@query("SELECT application_id, horizontal_codes AS declared, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(' ' || horizontal_codes || ' , ,', ','), lambda x : trim(x)), lambda x : x <> ''))), ',') AS sorted FROM v_application")
def csv_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = apps(spark, sf)
    return rows.select("application_id", F.array_join(text.csv_list("horizontal_codes"), ",").alias("declared"), F.array_join(text.csv_set(F.concat(F.lit(" "), "horizontal_codes", F.lit(" , ,"))), ",").alias("sorted"))


# ---- linkage

_KEYS = f"""k AS (SELECT application_id, list_filter([
  CASE WHEN {_GID} <> '' THEN 'GID:' || {_GID} END,
  CASE WHEN length({_PHONE}) = 10 THEN 'PHN:' || {_PHONE} END,
  CASE WHEN len({_TOKENS.replace('{x}', 'full_name')}) > 0 THEN 'SDX:' || {_soundex_sql(_FIRST)} || ':' || year(date_of_birth) END,
  CASE WHEN length(replace({_NAME}, ' ', '')) >= 4 THEN 'NDB:' || left(replace({_NAME}, ' ', ''), 4) || ':' || date_of_birth END,
  CASE WHEN len({_TOKENS.replace('{x}', 'full_name')}) > 0 THEN 'WRD:' || upper(trim(ward_code)) || ':' || {_soundex_sql(_LAST)} END], lambda x : x IS NOT NULL) AS keys FROM v_application)"""
_LONG = _KEYS + f""", x AS (SELECT application_id, unnest(keys) AS key FROM k), b AS (SELECT key, count(*) AS n FROM x GROUP BY key),
y AS (SELECT x.* FROM x JOIN b USING (key) WHERE n BETWEEN 2 AND {BLOCK_CAP}),
p AS (SELECT DISTINCT l.application_id AS left_id, r.application_id AS right_id FROM y l JOIN y r ON l.key = r.key AND l.application_id < r.application_id)"""
_SHARED = "list_filter(lk.keys, lambda z : list_contains(rk.keys, z))"
_PAIRED = _LONG + f""", f AS (SELECT application_id, {_GID} AS gid, {_PHONE} AS phone, date_of_birth AS dob, {_NAME} AS name FROM v_application),
c AS (SELECT p.*, l.gid AS lg, r.gid AS rg, l.phone AS lp, r.phone AS rp, l.dob AS ld, r.dob AS rd FROM p JOIN f l ON l.application_id = left_id JOIN f r ON r.application_id = right_id),
m AS (SELECT *, CASE WHEN lg <> '' AND lg = rg THEN 'DETERMINISTIC_GOVERNMENT_ID' WHEN NOT (lg <> '' AND rg <> '') AND length(lp) = 10 AND lp = rp AND ld = rd THEN 'DETERMINISTIC_PHONE_AND_DOB' END AS method FROM c)"""
_COMPONENTS = _PAIRED + """, e2 AS (SELECT left_id AS a, right_id AS b FROM m WHERE method IS NOT NULL UNION SELECT right_id, left_id FROM m WHERE method IS NOT NULL),
walk AS (SELECT application_id AS node, application_id AS reached FROM v_application UNION SELECT node, b FROM walk JOIN e2 ON reached = a),
g AS (SELECT node, min(reached) AS root FROM walk GROUP BY node)"""
_CLUSTERS = _COMPONENTS + """, q AS (SELECT root, arg_min(application_id, (submitted_min, application_id)) AS primary_id, count(*) AS size FROM g JOIN v_application ON node = application_id GROUP BY root)"""


@shared
def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return keep(linkage.identified(apps(spark, sf)))


@shared
def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return keep(linkage.candidate_pairs(_keyed(spark, sf)))


@shared
def _agreeing(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs with one identifier, or with one phone or none on both sides: all that rules on identifiers look at, settled where pairs are made."""
    same = ((F.col("l_gid") != "") & (F.col("l_gid") == F.col("r_gid"))) | (F.col("l_phone") == F.col("r_phone"))
    return keep(linkage.block_pairs(_keyed(spark, sf)).where(same).withColumn("method", linkage.deterministic()).drop("shared_keys"))


def _sure(spark: SparkSession, sf: str) -> DataFrame:
    return _agreeing(spark, sf).where("method is not null").select("left_id", "right_id", "method")


@shared
def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    labels = linkage.components(_sure(spark, sf), apps(spark, sf).select("application_id"))
    return keep(linkage.clusters(apps(spark, sf), labels))


@query(f"WITH {_KEYS} SELECT application_id, array_to_string(keys, ' ') AS keys FROM k")
def blocking_keys(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.keyed(apps(spark, sf)).select("application_id", F.array_join("keys", " ").alias("keys"))


@query(f"WITH {_LONG} SELECT key, n FROM b")
def block_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.block_sizes(_keyed(spark, sf))


@query(f"WITH {_LONG} SELECT key, n, 'block ' || key || ' holds ' || n || ' records, above the cap of {BLOCK_CAP}; its pairs are not compared' AS note FROM b WHERE n > {BLOCK_CAP}")
def oversized_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.oversized_blocks(_keyed(spark, sf))


@query(f"WITH {_LONG} SELECT left_id, right_id, array_to_string({_SHARED}, ' ') AS shared_keys FROM p JOIN k lk ON lk.application_id = left_id JOIN k rk ON rk.application_id = right_id")
def candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = linkage.candidate_pairs(_keyed(spark, sf))
    return pairs.select("left_id", "right_id", F.array_join("shared_keys", " ").alias("shared_keys"))


@query(f"WITH {_LONG} SELECT count(*) AS comparisons, (SELECT count(*) FROM v_application) AS records FROM p")
def comparisons(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).agg(F.count("*").alias("comparisons")).crossJoin(apps(spark, sf).agg(F.count("*").alias("records")))


@query(f"WITH {_PAIRED} SELECT left_id, right_id, method FROM m WHERE method IS NOT NULL")
def deterministic_links(spark: SparkSession, sf: str) -> DataFrame:
    return _sure(spark, sf)


@query(f"""WITH {_PAIRED} SELECT left_id, right_id,
  CASE WHEN ld = rd THEN 1.0 WHEN year(ld) = year(rd) AND day(ld) = month(rd) AND month(ld) = day(rd) THEN 0.85 WHEN year(ld) = year(rd) AND month(ld) = month(rd) THEN 0.60 WHEN year(ld) = year(rd) THEN 0.30 WHEN abs(year(ld) - year(rd)) = 1 THEN 0.15 ELSE 0.0 END::DOUBLE AS dob_score,
  CASE WHEN lp = '' OR rp = '' THEN NULL WHEN levenshtein(lp, rp) = 0 THEN 1.0 WHEN levenshtein(lp, rp) = 1 THEN 0.70 WHEN levenshtein(lp, rp) = 2 THEN 0.35 ELSE 0.0 END::DOUBLE AS phone_score FROM m""")
def dob_phone_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = linkage.compared(_pairs(spark, sf), apps(spark, sf))
    return rows.select("left_id", "right_id", metrics.dob_score(F.col("l_dob"), F.col("r_dob")).alias("dob_score"), metrics.phone_score(F.col("l_phone"), F.col("r_phone")).alias("phone_score"))


@query(f"""WITH {_LONG}, t AS (SELECT application_id, list_distinct(list_transform(list_filter(string_split_regex(upper(address_line), '[^A-Z0-9]+'), lambda t : length(t) >= 2), lambda t : CASE t {_WORDS_SQL} ELSE t END)) AS ts FROM v_application)
SELECT left_id, right_id, round(len(list_intersect(l.ts, r.ts)) / len(list_distinct(list_concat(l.ts, r.ts))), 6) AS jaccard FROM p JOIN t l ON l.application_id = left_id JOIN t r ON r.application_id = right_id""")
def address_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    rows = linkage.compared(_pairs(spark, sf), apps(spark, sf))
    return rows.select("left_id", "right_id", F.round(metrics.token_jaccard(F.col("l_address"), F.col("r_address")), 6).alias("jaccard"))


_ADDRESS = f"list_distinct(list_transform(list_filter(string_split_regex(upper(address_line), '[^A-Z0-9]+'), lambda t : length(t) >= 2), lambda t : CASE t {_WORDS_SQL} ELSE t END))"
_DOUBLE = "CAST({} AS DOUBLE)".format
#: Each distinct pair of names once.  The matching is a fold over the letters of a, over b with taken letters marked and, behind a mark, the matched letters of a.
_JARO = f"""nk AS (SELECT application_id, {_NAME} AS name, {_RELATIVE} AS relative, {_ADDRESS} AS address, upper(trim(ward_code)) AS ward, ward_code FROM v_application),
np AS (SELECT DISTINCT * FROM (SELECT l.name AS a, r.name AS b FROM p JOIN nk l ON l.application_id = left_id JOIN nk r ON r.application_id = right_id UNION ALL
  SELECT l.relative, r.relative FROM p JOIN nk l ON l.application_id = left_id JOIN nk r ON r.application_id = right_id)),
j1 AS (SELECT a, b, length(a) AS la, length(b) AS lb, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS reach FROM np WHERE a <> '' AND b <> ''),
j2 AS (SELECT *, list_reduce(list_prepend(b || chr(2), [lpad(CAST(i AS VARCHAR), 4, '0') || substr(a, i, 1) for i in range(1, la + 1)]),
  lambda acc, x : CASE WHEN strpos(substr(substr(acc, 1, least(lb, CAST(left(x, 4) AS BIGINT) + reach)), greatest(1, CAST(left(x, 4) AS BIGINT) - reach)), substr(x, 5)) > 0
    THEN substr(acc, 1, greatest(1, CAST(left(x, 4) AS BIGINT) - reach) + strpos(substr(substr(acc, 1, least(lb, CAST(left(x, 4) AS BIGINT) + reach)), greatest(1, CAST(left(x, 4) AS BIGINT) - reach)), substr(x, 5)) - 2) || chr(1)
      || substr(acc, greatest(1, CAST(left(x, 4) AS BIGINT) - reach) + strpos(substr(substr(acc, 1, least(lb, CAST(left(x, 4) AS BIGINT) + reach)), greatest(1, CAST(left(x, 4) AS BIGINT) - reach)), substr(x, 5))) || substr(x, 5)
    ELSE acc END) AS st FROM j1),
j3 AS (SELECT *, substr(st, lb + 2) AS lm, array_to_string([substr(b, k, 1) for k in range(1, lb + 1) if substr(st, k, 1) = chr(1)], '') AS rm FROM j2),
j4 AS (SELECT *, length(lm) AS m, len([k for k in range(1, length(lm) + 1) if substr(lm, k, 1) <> substr(rm, k, 1)]) / {_DOUBLE('2')} AS moved FROM j3),
j5 AS (SELECT *, CASE WHEN m = 0 THEN {_DOUBLE('0')} ELSE (m / {_DOUBLE('la')} + m / {_DOUBLE('lb')} + (m - moved) / {_DOUBLE('m')}) / {_DOUBLE('3')} END AS jaro,
  greatest({', '.join(f"CASE WHEN la >= {k} AND lb >= {k} AND left(a, {k}) = left(b, {k}) THEN {k} ELSE 0 END" for k in range(1, 5))}) AS prefix FROM j4),
jw AS (SELECT a, b, CASE WHEN jaro < {_DOUBLE('0.7')} THEN jaro ELSE jaro + prefix * {_DOUBLE('0.1')} * (1 - jaro) END AS score FROM j5
  UNION ALL SELECT a, b, CASE WHEN a = b THEN {_DOUBLE('1')} ELSE {_DOUBLE('0')} END FROM np WHERE a = '' OR b = '')"""
_DOB = "CASE WHEN ld = rd THEN 1.0 WHEN year(ld) = year(rd) AND day(ld) = month(rd) AND month(ld) = day(rd) THEN 0.85 WHEN year(ld) = year(rd) AND month(ld) = month(rd) THEN 0.60 WHEN year(ld) = year(rd) THEN 0.30 WHEN abs(year(ld) - year(rd)) = 1 THEN 0.15 ELSE 0.0 END::DOUBLE"
_PHONE_SCORE = "CASE WHEN lp = '' OR rp = '' THEN NULL WHEN levenshtein(lp, rp) = 0 THEN 1.0 WHEN levenshtein(lp, rp) = 1 THEN 0.70 WHEN levenshtein(lp, rp) = 2 THEN 0.35 ELSE 0.0 END::DOUBLE"
_FIELDS = (("name", "0.32"), ("relative", "0.10"), ("dob", "0.22"), ("phone", "0.18"), ("address", "0.12"), ("ward", "0.06"))


def _sum(of: str) -> str:
    return " + ".join(["CAST(0 AS DOUBLE)", *(f"CASE WHEN a_{f} THEN {of.format(w=_DOUBLE(w), f=f)} ELSE CAST(0 AS DOUBLE) END" for f, w in _FIELDS)])


def _line_sql(f: str, label: str, weight: str, detail: str) -> str:
    return f"'{label}' || CASE WHEN a_{f} THEN '' ELSE ' (missing, weight redistributed)' END || printf(' score=%.4f weight={weight} [', s_{f}) || {detail} || ']'"


_DATES = "strftime(ld, '%Y-%m-%d') || ' vs ' || strftime(rd, '%Y-%m-%d')"
_LINES = " || chr(10) || ".join((
    _line_sql("name", "name", "0.32", """'jaro-winkler("' || ln || '", "' || rn || '")'"""),
    _line_sql("relative", "relativeName", "0.10", """'jaro-winkler("' || lr || '", "' || rr || '")'"""),
    _line_sql("dob", "dateOfBirth", "0.22", f"CASE WHEN NOT a_dob THEN 'missing on one side' WHEN s_dob = 1 THEN 'identical' WHEN s_dob = 0.85::DOUBLE THEN 'day and month transposed (' || {_DATES} || ')' WHEN s_dob = 0.60::DOUBLE THEN 'same year and month' WHEN s_dob = 0.30::DOUBLE THEN 'same year only' WHEN s_dob = 0.15::DOUBLE THEN 'adjacent years' ELSE {_DATES} END"),
    _line_sql("phone", "phone", "0.18", "CASE WHEN NOT a_phone THEN 'missing on one side' WHEN s_phone = 1 THEN 'identical' ELSE 'edit distance ' || levenshtein(lp, rp) END"),
    _line_sql("address", "address", "0.12", "'token jaccard over ' || len(la) || ' and ' || len(ra) || ' tokens'"),
    _line_sql("ward", "ward", "0.06", "CASE WHEN a_ward THEN lw || ' vs ' || rw ELSE 'missing on one side' END"),
))
_SCORED = _PAIRED + f""", {_JARO},
z1 AS (SELECT m.*, l.name AS ln, r.name AS rn, l.relative AS lr, r.relative AS rr, l.address AS la, r.address AS ra, l.ward_code AS lw, r.ward_code AS rw,
  l.name <> '' AND r.name <> '' AS a_name, l.relative <> '' AND r.relative <> '' AS a_relative, ld IS NOT NULL AND rd IS NOT NULL AS a_dob, lp <> '' AND rp <> '' AS a_phone, len(l.address) > 0 AND len(r.address) > 0 AS a_address,
  coalesce(l.ward <> '' AND r.ward <> '', false) AS a_ward, jn.score AS s_name, jr.score AS s_relative, CASE WHEN a_dob THEN {_DOB} ELSE 0 END AS s_dob, coalesce({_PHONE_SCORE}, 0) AS s_phone,
  CASE WHEN a_address THEN len(list_intersect(l.address, r.address)) / {_DOUBLE('len(list_distinct(list_concat(l.address, r.address)))')} ELSE 0 END AS s_address, CASE WHEN a_ward AND l.ward = r.ward THEN {_DOUBLE('1')} ELSE 0 END AS s_ward,
  lg <> '' AND rg <> '' AS both_ids
  FROM m JOIN nk l ON l.application_id = left_id JOIN nk r ON r.application_id = right_id JOIN jw jn ON jn.a = l.name AND jn.b = r.name JOIN jw jr ON jr.a = l.relative AND jr.b = r.relative),
z2 AS (SELECT *, {_sum('{w} * s_{f}')} AS total, {_sum('{w}')} AS weight FROM z1),
z3 AS (SELECT *, CASE WHEN weight = 0 THEN 0 ELSE total / weight END AS found FROM z2),
scored AS (SELECT left_id, right_id, coalesce(method, 'PROBABILISTIC') AS method, CASE method WHEN 'DETERMINISTIC_GOVERNMENT_ID' THEN {_DOUBLE('1')} WHEN 'DETERMINISTIC_PHONE_AND_DOB' THEN {_DOUBLE('0.99')} ELSE found END AS score,
  CASE WHEN method IS NOT NULL THEN 'AUTO_LINKED' WHEN found >= {_DOUBLE('0.93')} AND NOT both_ids THEN 'AUTO_LINKED' WHEN found >= {_DOUBLE('0.8')} THEN 'NEEDS_REVIEW' ELSE 'DISTINCT' END AS decision,
  CASE method WHEN 'DETERMINISTIC_GOVERNMENT_ID' THEN 'governmentId score=1.0000 weight=1.00 [identifiers are identical]'
    WHEN 'DETERMINISTIC_PHONE_AND_DOB' THEN 'phone score=1.0000 weight=0.50 [same ten-digit number]' || chr(10) || 'dateOfBirth score=1.0000 weight=0.50 [identical]' ELSE {_LINES} END AS features,
  CASE method WHEN 'DETERMINISTIC_GOVERNMENT_ID' THEN 'The government identifiers are equal.' WHEN 'DETERMINISTIC_PHONE_AND_DOB' THEN 'Phone and date of birth are equal, and no government identifiers contradict.'
    ELSE printf('Fields agree at %.4f (linked from 0.93, reviewed from 0.8). ', found) || CASE WHEN found >= {_DOUBLE('0.93')} AND both_ids THEN 'Not linked without a reviewer, since two different government identifiers are given.'
      WHEN both_ids THEN 'Two different government identifiers are given.' ELSE 'No two government identifiers are given to compare.' END END AS rationale FROM z3)"""


@query(f"WITH {_SCORED} SELECT s.*, array_to_string({_SHARED}, ' ') AS shared_keys FROM scored s JOIN k lk ON lk.application_id = left_id JOIN k rk ON rk.application_id = right_id")
def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair with its score, decision, features and rationale."""
    return linkage.score_blocks(_keyed(spark, sf), apps(spark, sf), BLOCK_CAP).withColumn("shared_keys", F.array_join("shared_keys", " "))


@query(f"WITH {_SCORED} SELECT left_id, right_id, score, rationale FROM scored WHERE decision = 'NEEDS_REVIEW' ORDER BY score DESC, left_id, right_id")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.score_blocks(_keyed(spark, sf), apps(spark, sf), BLOCK_CAP).where("decision = 'NEEDS_REVIEW'").select("left_id", "right_id", "score", "rationale").orderBy(F.desc("score"), "left_id", "right_id")


@query(f"""WITH RECURSIVE {_SCORED}, e3 AS (SELECT left_id AS a, right_id AS b FROM scored WHERE decision <> 'DISTINCT' UNION SELECT right_id, left_id FROM scored WHERE decision <> 'DISTINCT'),
walk AS (SELECT application_id AS node, application_id AS reached FROM v_application UNION SELECT node, b FROM walk JOIN e3 ON reached = a) SELECT count(DISTINCT root) AS households FROM (SELECT node, min(reached) AS root FROM walk GROUP BY node)""")
def households_if_all_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The households that would remain if reviewers accepted every pair that awaits them."""
    scored = linkage.score_blocks(_keyed(spark, sf), apps(spark, sf), BLOCK_CAP)
    return linkage.households_if_merged(apps(spark, sf), scored.where("decision = 'AUTO_LINKED'"), scored.where("decision = 'NEEDS_REVIEW'"))


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT node, root FROM g")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.components(_sure(spark, sf), apps(spark, sf).select("application_id"))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT node AS application_id, 'CL-' || primary_id AS cluster_id, primary_id, size FROM g JOIN q USING (root)")
def clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf)


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT node AS application_id, 'CL-' || primary_id AS cluster_id, primary_id AS superseded_by, 'duplicate of ' || primary_id AS reason FROM g JOIN q USING (root) WHERE node <> primary_id")
def superseded(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.superseded(_clusters(spark, sf))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT count(*) AS households, CAST(sum(size - 1) AS BIGINT) AS duplicates FROM q")
def households(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf).groupBy("cluster_id").agg(F.first("size").alias("size")).agg(F.count("*").alias("households"), F.sum(F.col("size") - 1).alias("duplicates"))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT 'CL-' || primary_id AS cluster_id, count(*) AS members, count(DISTINCT right(node, 6)) AS sources FROM g JOIN q USING (root) GROUP BY primary_id")
def cluster_purity(spark: SparkSession, sf: str) -> DataFrame:
    truth = apps(spark, sf).select("application_id", F.right("application_id", F.lit(6)).alias("source_id"))
    return finders.cluster_purity(_clusters(spark, sf), truth)


@query(f"""WITH {_PAIRED}, z AS (SELECT left_id AS application_id FROM m WHERE method IS NULL AND lg <> '' AND rg <> '' AND lp = rp UNION SELECT right_id FROM m WHERE method IS NULL AND lg <> '' AND rg <> '' AND lp = rp)
SELECT application_id, 'PENDING_DUPLICATE_REVIEW' AS status FROM z""")
def pending_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Applications at either end of a pair with one phone and two identifiers."""
    vetoed = _agreeing(spark, sf).where("method is null and l_gid <> '' and r_gid <> '' and l_phone = r_phone").select("left_id", "right_id", F.lit("NEEDS_REVIEW").alias("decision"))
    return linkage.pending(vetoed, apps(spark, sf).select("application_id", F.lit("RECEIVED").alias("status"))).distinct()


@query(f"""WITH RECURSIVE {_PAIRED}, acc AS (SELECT left_id, right_id FROM m WHERE method IS NOT NULL OR (lp <> '' AND lp = rp)), e2 AS (SELECT left_id AS a, right_id AS b FROM acc UNION SELECT right_id, left_id FROM acc),
walk AS (SELECT application_id AS node, application_id AS reached FROM v_application UNION SELECT node, b FROM walk JOIN e2 ON reached = a), g AS (SELECT node, min(reached) AS root FROM walk GROUP BY node),
q AS (SELECT root, arg_min(application_id, (submitted_min, application_id)) AS primary_id, count(*) AS size FROM g JOIN v_application ON node = application_id GROUP BY root)
SELECT node AS application_id, 'CL-' || primary_id AS cluster_id, primary_id, size FROM g JOIN q USING (root)""")
def clusters_after_review(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters once the pairs with one phone have been accepted."""
    accepted = _agreeing(spark, sf).where("l_phone <> '' and l_phone = r_phone")
    return linkage.merge_reviewed(apps(spark, sf), _clusters(spark, sf), accepted)


@query(f"WITH {_PAIRED} SELECT left_id, right_id, method FROM m WHERE method IS NOT NULL AND (left_id = 'APP-2026-A000013' OR right_id = 'APP-2026-A000013')")
def links_of_application(spark: SparkSession, sf: str) -> DataFrame:
    return finders.either(_sure(spark, sf), "left_id", "right_id", "APP-2026-A000013")


# ---- eligibility, intake, lifecycle


@query(f"WITH {_STATED.strip()} SELECT application_id, status, status_reason FROM stated")
def eligibility_status(spark: SparkSession, sf: str) -> DataFrame:
    return stated(spark, sf).select("application_id", "status", "status_reason")


@query(f"WITH {_STATED.strip()} SELECT ord, s.status, count(application_id) AS n FROM (VALUES (0, 'RECEIVED'), (1, 'PENDING_DUPLICATE_REVIEW'), (2, 'SUPERSEDED'), (3, 'INELIGIBLE'), (4, 'ELIGIBLE')) AS s(ord, status) LEFT JOIN stated USING (status) GROUP BY ALL")
def status_counts_all(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.status_counts(stated(spark, sf))


@query(f"""WITH {_STATED.strip()}, c AS (SELECT count(*) FILTER (WHERE status = 'RECEIVED') AS undecided, count(*) FILTER (WHERE status = 'ELIGIBLE') AS eligible FROM stated), u AS (SELECT count(*) AS units FROM v_flat_unit WHERE NOT withdrawn)
SELECT CAST(0 AS BIGINT) AS pending, undecided, eligible, units, concat_ws('; ', CASE WHEN undecided > 0 THEN 'applications await eligibility' END, CASE WHEN units = 0 THEN 'no inventory' END, CASE WHEN units <> 600 THEN 'inventory differs from the rules' END, CASE WHEN eligible = 0 THEN 'nobody is eligible' END) AS blockers FROM c, u""")
def freeze_gates(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.freeze_gates(stated(spark, sf), flats(spark, sf), 600)


@query("""WITH r AS (SELECT event_id AS request_id, CASE WHEN user_id % 5 = 0 THEN ' ' ELSE 'K-' || user_id || '-' || event_type END AS idempotency_key, event_id AS arrival FROM events),
f AS (SELECT *, CASE WHEN trim(idempotency_key) = '' THEN request_id ELSE first_value(request_id) OVER (PARTITION BY idempotency_key ORDER BY arrival, request_id) END AS stored_id FROM r)
SELECT request_id, idempotency_key, arrival, stored_id, stored_id = request_id AS created FROM f""")
def idempotent_intake(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    key = F.when(F.col("user_id") % 5 == 0, " ").otherwise(F.concat(F.lit("K-"), F.col("user_id").cast("string"), F.lit("-"), "event_type"))
    return lifecycle.intake(events.select(F.col("event_id").alias("request_id"), key.alias("idempotency_key"), F.col("event_id").alias("arrival")))


@query("""WITH r AS (SELECT event_id AS request_id, 'K-' || user_id || '-' || event_type AS idempotency_key FROM events WHERE user_id % 5 <> 0),
w AS (SELECT 'K-' || user_id || '-' || event_type AS idempotency_key FROM events WHERE user_id % 5 <> 0 ORDER BY event_id LIMIT 1)
SELECT min(request_id) AS stored_id, idempotency_key FROM r WHERE idempotency_key = (SELECT idempotency_key FROM w) GROUP BY idempotency_key""")
def app_by_idempotency_key(spark: SparkSession, sf: str) -> DataFrame:
    """The stored application of the first key that was sent."""
    taken = idempotent_intake(spark, sf).where("created and trim(idempotency_key) <> ''")
    first = spark.read.parquet(f"{sf}/events.parquet").where("user_id % 5 <> 0").orderBy("event_id").selectExpr("concat('K-', cast(user_id as string), '-', event_type) as k").first()
    return finders.one(taken, idempotency_key=first["k"] if first else "").select("stored_id", "idempotency_key")


@query("""WITH n AS (SELECT application_id, CASE WHEN application_id LIKE '%3' THEN '9' || right(phone, 9) END AS phone, CASE WHEN application_id LIKE '%03' THEN 'W-99' END AS ward_code FROM v_application WHERE application_id LIKE '%3')
SELECT a.application_id, CASE WHEN n.phone IS NOT NULL AND n.phone <> a.phone THEN 'phone:' || a.phone || '->' || n.phone || ' ' ELSE '' END || CASE WHEN n.ward_code IS NOT NULL AND n.ward_code <> a.ward_code THEN 'ward_code:' || a.ward_code || '->' || n.ward_code || ' ' ELSE '' END AS diff FROM v_application a JOIN n USING (application_id)""")
def correction_diffs(spark: SparkSession, sf: str) -> DataFrame:
    rows = apps(spark, sf)
    new = rows.where(F.col("application_id").endswith("3")).select("application_id", F.concat(F.lit("9"), F.right("phone", F.lit(9))).alias("phone"), F.when(F.col("application_id").endswith("03"), "W-99").alias("ward_code"))
    return lifecycle.corrections(rows, new)[1]


_ACCENTED = "translate(full_name, 'AEIOUNCS', 'ÁÈÎÖŮÑÇŠ')"


@query(f"""SELECT application_id, {_NAME.replace('full_name', f"strip_accents({_ACCENTED})")} AS name_key, {_soundex_sql(_FIRST.replace('full_name', f"strip_accents({_ACCENTED})"))} AS soundex FROM v_application""")
def accented_names(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of names whose vowels and some consonants carry accents."""
    rows = apps(spark, sf).withColumn("full_name", F.expr(_ACCENTED))
    return rows.select("application_id", text.name_key("full_name").alias("name_key"), text.soundex(F.get(text.name_tokens("full_name"), F.lit(0))).alias("soundex"))


@query("SELECT application_id, vertical_code, array_to_string(list_filter(string_split(horizontal_codes, ','), lambda x : x = 'SENIOR'), ',') AS unknown FROM v_application WHERE vertical_code = 'CAT_C' OR horizontal_codes LIKE '%SENIOR%'")
def unknown_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes that a rule set without CAT_C and SENIOR does not define."""
    return lifecycle.unknown_codes(apps(spark, sf), ["OPEN", "CAT_A", "CAT_B"], ["WOMEN", "PWD", "EX_SERVICE"])


@query("SELECT check_id, application_id, decided_by FROM v_eligibility_check JOIN (SELECT application_id, 'officer.' || CAST(CAST(right(application_id, 6) AS INTEGER) % 5 AS VARCHAR) AS received_by FROM v_application) USING (application_id) WHERE decided_by = received_by")
def maker_checker_violations(spark: SparkSession, sf: str) -> DataFrame:
    received = F.concat(F.lit("officer."), (F.right("application_id", F.lit(6)).cast("int") % 5).cast("string"))
    return lifecycle.maker_checker_violations(view(spark, sf, "v_eligibility_check"), apps(spark, sf).withColumn("received_by", received))


@query("SELECT sequence, action, actor_role FROM v_audit_input WHERE (action, actor_role) NOT IN (('SIGNUP', 'DATA_ENTRY'), ('CLICK', 'DATA_ENTRY'), ('VIEW', 'VERIFIER'), ('PURCHASE', 'SCHEME_ADMIN'))")
def role_violations(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.role_violations(view(spark, sf, "v_audit_input"), lifecycle.permissions(spark)).select("sequence", "action", "actor_role")


_PHASES = ", ".join(f"'{p}'" for p in lifecycle.PHASES)


@query(f"""WITH h AS (SELECT 'SCH-' || n_regionkey AS scheme_code, n_nationkey AS step, [{_PHASES}][1 + CASE WHEN n_nationkey % 11 = 7 THEN 9 ELSE n_nationkey // 5 END] AS phase, CASE WHEN n_nationkey % 11 = 7 THEN 9 ELSE n_nationkey // 5 END AS place FROM nation),
l AS (SELECT *, lag(place) OVER (PARTITION BY scheme_code ORDER BY step) AS before FROM h) SELECT scheme_code, step, phase FROM l WHERE coalesce(place <> before + 1, place <> 0)""")
def phase_history_violations(spark: SparkSession, sf: str) -> DataFrame:
    place = F.when(F.col("n_nationkey") % 11 == 7, 9).otherwise((F.col("n_nationkey") / 5).cast("int"))
    history = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("SCH-"), F.col("n_regionkey").cast("string")).alias("scheme_code"), F.col("n_nationkey").alias("step"), F.get(F.array(*map(F.lit, lifecycle.PHASES)), place).alias("phase"))
    return lifecycle.phase_violations(history)


@query("SELECT 'idempotency_key' AS key, government_id AS value, count(*) AS n FROM v_application WHERE government_id <> '' GROUP BY government_id HAVING count(*) > 1")
def uniqueness_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that repeat, with the identifier standing for the idempotency key."""
    return lifecycle.uniqueness_violations(apps(spark, sf).withColumn("idempotency_key", F.expr("nullif(government_id, '')")), "application")


#: Requests made of applications, some of which no office would take.
_SPOILT = (
    ("full_name", "CASE WHEN application_id LIKE '%1' THEN ' ' WHEN application_id LIKE '%02' THEN repeat('N', 201) ELSE full_name END"),
    ("phone", "CASE WHEN application_id LIKE '%3' THEN '+91 (0) 98450 00000 000000' ELSE phone END"),
    ("date_of_birth", "CASE WHEN application_id LIKE '%04' THEN CAST('2026-01-01' AS DATE) WHEN application_id LIKE '%14' THEN NULL ELSE date_of_birth END"),
    ("residency_years", "residency_years - 2"),
    ("vertical_code", "CASE WHEN application_id LIKE '%5' THEN NULL ELSE vertical_code END"),
)


@query(f"""WITH q AS (SELECT application_id, {', '.join(f"{x} AS {c}" for c, x in _SPOILT)} FROM v_application)
SELECT application_id, 'full_name' AS field, 'is missing' AS fault FROM q WHERE trim(full_name) = ''
UNION ALL SELECT application_id, 'full_name', 'is longer than 200 characters' FROM q WHERE length(full_name) > 200
UNION ALL SELECT application_id, 'phone', 'is longer than 24 characters' FROM q WHERE length(phone) > 24
UNION ALL SELECT application_id, 'date_of_birth', 'is not in the past' FROM q WHERE date_of_birth >= DATE '2026-01-01'
UNION ALL SELECT application_id, 'residency_years', 'is less than 0' FROM q WHERE residency_years < 0
UNION ALL SELECT application_id, 'vertical_code', 'is missing' FROM q WHERE vertical_code IS NULL""")
def refused_requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = apps(spark, sf).withColumns({c: F.expr(x) for c, x in _SPOILT})
    return requests.refused(rows, "intake", "application_id", F.lit("2026-01-01").cast("date"))


# ---- units


@query("SELECT unit_id, unit_type, block, CAST(row_number() OVER (PARTITION BY unit_type ORDER BY unit_id) AS INTEGER) AS place FROM v_flat_unit WHERE NOT withdrawn")
def unit_availability(spark: SparkSession, sf: str) -> DataFrame:
    return units.available_units(flats(spark, sf)).select("unit_id", "unit_type", "block", "place")


@query(draw_sql("""SELECT application_id, unit_id, pick_order, CAST(CASE WHEN list_contains(string_split(unit_type_preferences, ','), 'ONE_BHK') THEN list_position(string_split(unit_type_preferences, ','), 'ONE_BHK') ELSE 0 END AS INTEGER) AS preference_rank
FROM (SELECT application_id, CAST(row_number() OVER (ORDER BY ticket_hex, application_id) AS INTEGER) AS pick_order FROM sel WHERE outcome = 'SELECTED') JOIN v_application USING (application_id)
LEFT JOIN (SELECT unit_id, row_number() OVER (ORDER BY unit_id) AS place FROM v_flat_unit WHERE NOT withdrawn AND unit_type = 'ONE_BHK') ON place = pick_order"""))
def unit_assignment_one_type(spark: SparkSession, sf: str) -> DataFrame:
    """Assignment where only one type is on offer: the n-th pick gets the n-th unit."""
    found = units.assign(drawn(spark, sf).selections, roll(spark, sf), flats(spark, sf).where("unit_type = 'ONE_BHK'"), "DRAW-1")
    return found.select("application_id", "unit_id", "pick_order", F.when(F.col("unit_id").isNotNull(), F.col("preference_rank")).otherwise(F.coalesce(F.col("preference_rank"), F.lit(0))).alias("preference_rank"))


_ASSIGNED = f"{_FULL}, {_WANTS}, {sequential.assigned_ctes('d_sel', 'a_wants')}"


@query(f"{_ASSIGNED} SELECT * FROM a_given")
def unit_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return units.assign(drawn(spark, sf, "full").selections, roll(spark, sf), flats(spark, sf), "DRAW-1")


@query(f"{_ASSIGNED} SELECT application_id, 'a=' || application_id || '|' || unit_id || '|' || unit_type || '|' || preference_rank AS line FROM a_given WHERE unit_id IS NOT NULL")
def allotment_lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents.allotment_lines(unit_assignment(spark, sf))


@query(f"""{_ASSIGNED} SELECT count(unit_id) AS assigned, count(*) FILTER (unit_id IS NULL) AS unhoused, count(*) FILTER (preference_rank = 1) AS first_choices, count(DISTINCT unit_id) AS units,
(SELECT count(*) FROM v_flat_unit WHERE NOT withdrawn AND unit_id NOT IN (SELECT unit_id FROM a_given WHERE unit_id IS NOT NULL)) AS unassigned FROM a_given""")
def assignment_counts(spark: SparkSession, sf: str) -> DataFrame:
    stock = flats(spark, sf)
    return units.assignment_counts(units.assign(drawn(spark, sf, "full").selections, roll(spark, sf), stock, "DRAW-1"), stock)


def _allotments(spark: SparkSession, sf: str) -> DataFrame:
    """Allotments over the orders: every fifth forfeited, some vacancies filled already."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "FORFEITED").when(k % 5 == 1, "ACCEPTED").otherwise("OFFERED")
    text_ = lambda x: F.concat(F.lit("AL-"), x.cast("string"))
    return o.select(text_(k).alias("allotment_id"), F.lit("DRAW-1").alias("draw_id"), F.concat(F.lit("U-"), (k % 997).cast("string")).alias("unit_id"), status.alias("status"), F.when(k % 7 == 0, text_(k - 2)).alias("fills_vacancy_of"), F.concat(F.lit("APP-2026-A"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("application_id"))


_ALLOTMENTS = "a AS (SELECT 'AL-' || o_orderkey AS allotment_id, 'DRAW-1' AS draw_id, 'U-' || (o_orderkey % 997) AS unit_id, CASE o_orderkey % 5 WHEN 0 THEN 'FORFEITED' WHEN 1 THEN 'ACCEPTED' ELSE 'OFFERED' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'AL-' || (o_orderkey - 2) END AS fills_vacancy_of, 'APP-2026-A' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS application_id FROM orders)"


@query(f"WITH {_ALLOTMENTS} SELECT allotment_id, unit_id FROM a WHERE status = 'FORFEITED' AND allotment_id NOT IN (SELECT fills_vacancy_of FROM a WHERE fills_vacancy_of IS NOT NULL)")
def open_vacancies(spark: SparkSession, sf: str) -> DataFrame:
    return units.open_vacancies(_allotments(spark, sf)).select("allotment_id", "unit_id")


@query(f"WITH {_ALLOTMENTS} SELECT 'live_unit_key' AS key, draw_id || ':' || unit_id AS value, count(*) AS n FROM a WHERE status IN ('OFFERED', 'ACCEPTED') GROUP BY ALL HAVING count(*) > 1")
def live_unit_violations(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.uniqueness_violations(_allotments(spark, sf).withColumn("live_unit_key", units.live_key()), "unit_allotment")


@query(f"WITH {_ALLOTMENTS} SELECT (SELECT count(DISTINCT application_id) FROM a WHERE status <> 'FORFEITED') AS holders, (SELECT count(DISTINCT application_id) FROM a WHERE status = 'FORFEITED' AND fills_vacancy_of IS NOT NULL) AS declined")
def promotion_sets(spark: SparkSession, sf: str) -> DataFrame:
    holders, declined, _ = units.promotion_sets(_allotments(spark, sf).withColumns({"unit_type": F.lit(""), "block": F.lit(""), "pick_order": F.lit(0)}))
    return holders.agg(F.count("*").alias("holders")).crossJoin(declined.agg(F.count("*").alias("declined")))


@query(draw_sql("""SELECT f.application_id AS vacated_by, n.application_id AS promoted, f.pool_code AS pool, CAST(n.k AS INTEGER) AS promotion_position
FROM (SELECT application_id, pool_code, row_number() OVER (PARTITION BY pool_code ORDER BY ticket_hex, application_id) AS v FROM sel WHERE outcome = 'SELECTED' AND application_id LIKE '%7' AND pool_code = 'CAT_C') f
LEFT JOIN (SELECT pool, application_id, row_number() OVER (PARTITION BY pool ORDER BY rk) AS w, 0 AS k FROM ranking WHERE pool = 'CAT_C' AND application_id NOT IN (SELECT application_id FROM won)) n ON n.pool = f.pool_code AND n.w = f.v""").replace("CAST(n.k AS INTEGER) AS promotion_position", "n.w IS NOT NULL AS found"))
def promotions_one_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Forfeited seats of one pool go to its waitlist in order."""
    o = drawn(spark, sf)
    won = o.selections.where("outcome = 'SELECTED'")
    gone = won.where("application_id like '%7' and pool_code = 'CAT_C'").select("application_id")
    made = units.promote(o.ranking, o.selections, gone, won.select("application_id"), gone.limit(0))
    return made.select("vacated_by", "promoted", "pool", F.col("promoted").isNotNull().alias("found"))


_WINNERS = "SELECT application_id FROM {} WHERE outcome = 'SELECTED'"


@query(f"{_FULL}, {sequential.promoted_ctes('d_sel', 'd_ranking', _WINNERS.format('d_sel') + " AND application_id LIKE '%7'", _WINNERS.format('d_sel'), 'SELECT application_id FROM d_sel WHERE waitlist_position = 2')} SELECT * FROM p_made")
def promotions(spark: SparkSession, sf: str) -> DataFrame:
    o = drawn(spark, sf, "full")
    won = o.selections.where("outcome = 'SELECTED'")
    gone = won.where("application_id like '%7'").select("application_id")
    declined = o.selections.where("waitlist_position = 2").select("application_id")
    return units.promote(o.ranking, o.selections, gone, won.select("application_id"), declined)


# ---- audit


@shared
def _chain(spark: SparkSession, sf: str) -> DataFrame:
    return audit.link(view(spark, sf, "v_audit_input"))


_CANONICAL = "'event/1|' || sequence || '|' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ') || '|' || actor || '|' || actor_role || '|' || action || '|' || entity_type || '|' || entity_id || '|' || coalesce(payload, '')"
#: The whole log as one fold: the digests so far, one behind the other.
_CHAIN = f"""f AS (SELECT list_reduce(list_prepend('{hashing.GENESIS}', list({_CANONICAL} ORDER BY sequence)), lambda acc, x : acc || sha256(right(acc, 64) || '|' || x)) AS acc, list(sequence ORDER BY sequence) AS s FROM v_audit_input),
chain AS (SELECT sequence, substr(acc, 64 * i - 63, 64) AS previous_hash, substr(acc, 64 * i + 1, 64) AS hash FROM (SELECT acc, unnest(s) AS sequence, generate_subscripts(s, 1) AS i FROM f))"""
_VERIFY = f"""t AS (SELECT sequence, event_id, {_CANONICAL} AS txt FROM ({{events}})),
checks AS (SELECT sequence, event_id, previous_hash, hash, txt, lag(sequence) OVER (ORDER BY sequence) AS s0, coalesce(lag(hash) OVER (ORDER BY sequence), '{hashing.GENESIS}') AS h0 FROM chain JOIN t USING (sequence)),
faults AS (SELECT sequence, event_id, CASE WHEN sequence <> coalesce(s0, 0) + 1 THEN 'gap' WHEN previous_hash <> h0 THEN 'predecessor' WHEN sha256(previous_hash || '|' || txt) <> hash THEN 'content' END AS fault FROM checks),
first AS (SELECT * FROM faults WHERE fault IS NOT NULL ORDER BY sequence LIMIT 1)
SELECT (SELECT count(*) FROM first) = 0 AS intact, CAST(coalesce((SELECT sequence - 1 FROM first), (SELECT count(*) FROM chain)) AS BIGINT) AS events_checked, (SELECT sequence FROM first) AS fault_at,
  (SELECT event_id FROM first) AS event_id, (SELECT fault FROM first) AS fault, (SELECT max_by(hash, sequence) FROM chain) AS head"""


@query(f"SELECT sequence, event_id, {_CANONICAL} AS canonical FROM v_audit_input")
def audit_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_audit_input").select("sequence", "event_id", audit.canonical().alias("canonical"))


@query(f"WITH {_CHAIN} SELECT sequence, previous_hash, hash FROM chain")
def audit_chain_build(spark: SparkSession, sf: str) -> DataFrame:
    """The chain over the whole log."""
    return _chain(spark, sf).select("sequence", "previous_hash", "hash")


@query(f"WITH {_CHAIN} SELECT '-' AS log, sequence, event_id, previous_hash, hash FROM chain JOIN v_audit_input USING (sequence)")
def audit_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The chain of the whole log, appended by a stream that stops half way and starts again from its checkpoint."""
    at, rows = scratch(spark, "audit-stream"), view(spark, sf, "v_audit_input")
    middle, chain = rows.count() // 2, None
    for part in (F.col("sequence") <= middle, F.col("sequence") > middle):
        rows.where(part).write.mode("append").parquet(f"{at}/events")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/events")
        chain = appended.append_to(stream, f"{at}/chain", f"{at}/checkpoint", by=("sequence",))
    return chain


@query(f"WITH {_CHAIN} SELECT count(*) AS events, max_by(hash, sequence) AS head FROM chain")
def audit_head(spark: SparkSession, sf: str) -> DataFrame:
    return audit.head(_chain(spark, sf))


@query(f"WITH {_CHAIN}, {_VERIFY.format(events="SELECT * REPLACE (CASE WHEN sequence IN (250, 400) THEN 'forged' ELSE payload END AS payload) FROM v_audit_input")}")
def audit_verify_tampered(spark: SparkSession, sf: str) -> DataFrame:
    """Two events were altered; the first is reported."""
    return audit.verify(_chain(spark, sf).withColumn("payload", F.when(F.col("sequence").isin(250, 400), "forged").otherwise(F.col("payload"))))


@query(f"WITH {_CHAIN}, {_VERIFY.format(events='SELECT * FROM v_audit_input')}")
def audit_verify(spark: SparkSession, sf: str) -> DataFrame:
    return audit.verify(_chain(spark, sf))


@query("SELECT sequence, event_id, action FROM v_audit_input WHERE entity_type = 'APPLICATION' AND entity_id = 'APP-2026-A000007' ORDER BY sequence")
def audit_trail(spark: SparkSession, sf: str) -> DataFrame:
    return finders.find(view(spark, sf, "v_audit_input"), "sequence", entity_type="APPLICATION", entity_id="APP-2026-A000007").select("sequence", "event_id", "action")


@query("SELECT sequence, event_id, action FROM v_audit_input WHERE sequence BETWEEN 1 AND 200")
def audit_range(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the log, as its reader asks for it."""
    return finders.between(view(spark, sf, "v_audit_input"), "sequence", 1, 200).select("sequence", "event_id", "action")


@query("SELECT sequence, event_id FROM v_audit_input ORDER BY sequence DESC LIMIT 1")
def audit_last(spark: SparkSession, sf: str) -> DataFrame:
    return finders.last(view(spark, sf, "v_audit_input"), "sequence").select("sequence", "event_id")


# ---- actions as changes of a table

_OPEN = "status IN ('RECEIVED', 'ELIGIBLE')"


@query(f"""WITH {_STATED.strip()},
h AS (SELECT application_id, status AS s1, vertical_code, ward_code AS w0, CASE WHEN status IN ('RECEIVED', 'ELIGIBLE') AND application_id LIKE '%3' THEN 'WITHDRAWN' ELSE status END AS s2,
  CASE WHEN s2 IN ('RECEIVED', 'ELIGIBLE') AND application_id LIKE '%5' THEN 'W-MOVED' ELSE ward_code END AS w3, CASE WHEN s2 = 'RECEIVED' AND vertical_code = 'CAT_A' THEN 'PENDING_DUPLICATE_REVIEW' ELSE s2 END AS s4 FROM stated)
SELECT application_id, s4 AS status, w3 AS ward_code, CAST(CASE WHEN s4 <> s2 THEN 4 WHEN w3 IS DISTINCT FROM w0 THEN 3 WHEN s2 <> s1 THEN 2 WHEN s1 <> 'RECEIVED' THEN 1 ELSE 0 END AS BIGINT) AS changed FROM h WHERE NOT (s4 = 'INELIGIBLE' AND application_id LIKE '%8')""")
def action_history(spark: SparkSession, sf: str) -> DataFrame:
    """The applications after five actions, each a change set on the state before it: decisions, withdrawals, moves, marks, and removals; and the version that each row is of."""
    table = snapshots.Snapshots(spark, scratch(spark, "actions"), "application_id")
    table.create(apps(spark, sf).select("application_id", "vertical_code", "ward_code", F.lit("RECEIVED").alias("status")))
    decided = lifecycle.eligibility(view(spark, sf, "v_eligibility_check"), apps(spark, sf).withColumns({"status": F.lit("RECEIVED"), "cluster_id": F.lit(None).cast("string")}))
    status = lambda rows, to: rows.withColumn("status", F.lit(to))
    table.change(lambda s: s.drop("status").join(decided.where("status <> 'RECEIVED'").select("application_id", "status"), "application_id"))
    table.change(lambda s: status(s.where(f"{_OPEN} and application_id like '%3'"), "WITHDRAWN"))
    table.change(lambda s: s.where(f"{_OPEN} and application_id like '%5'").withColumn("ward_code", F.lit("W-MOVED")))
    table.change(lambda s: status(s.where("status = 'RECEIVED' and vertical_code = 'CAT_A'"), "PENDING_DUPLICATE_REVIEW"))
    table.change(lambda s: s.where("status = 'INELIGIBLE' and application_id like '%8'").withColumn(snapshots.GONE, F.lit(True)))
    return table.read(changed=True).select("application_id", "status", "ward_code", F.col(snapshots.CHANGED).alias("changed"))


# ---- reads


def _finder(name: str, table: str, columns: tuple[str, ...], where: str, order: str = "", **equal: object) -> None:
    """A registered base read: its filter as values for the operator and as SQL."""

    def read(spark: SparkSession, sf: str) -> DataFrame:
        keys = [F.desc(c.removesuffix(" DESC")) if c.endswith(" DESC") else F.col(c) for c in order.split(", ")] if order else []
        return finders.find(view(spark, sf, table), *keys, **equal).select(*columns)

    QUERIES[name] = read
    ORACLES[name] = with_views(f"SELECT {', '.join(columns)} FROM {table} WHERE {where}" + (f" ORDER BY {order}" if order else ""))


_finder("app_scan", "v_application", ("application_id", "full_name", "channel"), "scheme_code = 'SCH-T'", "application_id", scheme_code="SCH-T")
_finder("apps_by_channel", "v_application", ("application_id", "phone"), "scheme_code = 'SCH-T' AND channel = 'ONLINE'", "application_id", scheme_code="SCH-T", channel="ONLINE")
_finder("app_by_id", "v_application", ("application_id", "full_name"), "application_id = 'APP-2026-A000042'", application_id="APP-2026-A000042")
_finder("checks_of_application", "v_eligibility_check", ("check_id", "check_code", "passed"), "application_id = 'APP-2026-A000010'", "decided_at, check_id", application_id="APP-2026-A000010")
_finder("failed_checks", "v_eligibility_check", ("check_id", "application_id", "reason"), "passed = false", "check_id", passed=False)
_finder("available_units", "v_flat_unit", ("unit_id", "unit_type"), "scheme_code = 'SCH-T' AND withdrawn = false", "unit_id", scheme_code="SCH-T", withdrawn=False)
_finder("units_of_types", "v_flat_unit", ("unit_id", "floor_number"), "unit_type IN ('ONE_BHK', 'TWO_BHK') AND withdrawn = true", "unit_id", unit_type=("ONE_BHK", "TWO_BHK"), withdrawn=True)
_finder("events_newest_first", "v_audit_input", ("sequence", "actor"), "actor_role = 'VERIFIER'", "sequence DESC", actor_role="VERIFIER")


_finder("cluster_members", "v_roll_entry", ("application_id", "cluster_id"), "cluster_id = 'CL-7'", "application_id", cluster_id="CL-7")
_finder("roll_entries_of", "v_roll_entry", ("entry_id", "application_id"), "roll_id = 'ROLL-2'", "application_id", roll_id="ROLL-2")
_finder("audit_log", "v_audit_input", ("sequence", "event_id", "action"), "true", "sequence")
_finder("draws_newest_first", "v_draw", ("draw_id", "committed_min"), "scheme_code = 'SCH-1'", "committed_min DESC", scheme_code="SCH-1")
_finder("draws_with_status", "v_draw", ("draw_id", "roll_id"), "scheme_code = 'SCH-1' AND status = 'PUBLISHED'", scheme_code="SCH-1", status="PUBLISHED")
_finder("draws_of_roll", "v_draw", ("draw_id", "status"), "roll_id = 'ROLL-3'", roll_id="ROLL-3")
_finder("public_draws", "v_draw", ("draw_id", "status"), "status IN ('PUBLISHED', 'ANNULLED')", status=("PUBLISHED", "ANNULLED"))
_finder("draw_by_id", "v_draw", ("draw_id", "scheme_code", "status"), "draw_id = 'DRAW-000003'", draw_id="DRAW-000003")
_finder("rolls_newest_first", "v_draw_roll", ("roll_id", "frozen_min"), "scheme_code = 'SCH-2'", "frozen_min DESC", scheme_code="SCH-2")
_finder("rule_sets_newest_first", "v_rule_set", ("version", "published_min"), "scheme_code = 'SCH-2'", "published_min DESC", scheme_code="SCH-2")
_finder("links_by_score", "v_duplicate_link", ("link_id", "score_millis"), "scheme_code = 'SCH-T'", "score_millis DESC, link_id", scheme_code="SCH-T")
_finder("pending_links", "v_duplicate_link", ("link_id", "score_millis"), "scheme_code = 'SCH-T' AND review_decision = 'PENDING'", "score_millis DESC, link_id", scheme_code="SCH-T", review_decision="PENDING")
_finder("allotments_of_draw", "v_unit_allotment", ("allotment_id", "pick_order"), "draw_id = 'DRAW-1'", "pick_order", draw_id="DRAW-1")
_finder("live_allotments_of_draw", "v_unit_allotment", ("allotment_id", "status"), "draw_id = 'DRAW-1' AND status IN ('OFFERED', 'ACCEPTED')", draw_id="DRAW-1", status=("OFFERED", "ACCEPTED"))
_finder("allotments_of_applicant", "v_unit_allotment", ("allotment_id", "offered_at"), "application_id = 'APP-2026-A000010'", "offered_at", application_id="APP-2026-A000010")
_finder("allotments_of_unit", "v_unit_allotment", ("allotment_id",), "draw_id = 'DRAW-1' AND unit_id = 'U-12'", draw_id="DRAW-1", unit_id="U-12")


def _counter(name: str, table: str, *keys: str) -> None:
    """A registered count by keys."""
    QUERIES[name] = lambda spark, sf: finders.count_by(view(spark, sf, table), *keys)
    ORACLES[name] = with_views(f"SELECT {', '.join(keys)}, count(*) AS n FROM {table} GROUP BY ALL")


_counter("apps_by_scheme", "v_application", "scheme_code")
_counter("entries_by_roll", "v_roll_entry", "roll_id")
_counter("allotments_by_draw_and_status", "v_unit_allotment", "draw_id", "status")
_counter("links_by_decision", "v_duplicate_link", "decision", "review_decision")
_counter("checks_by_code", "v_eligibility_check", "check_code", "passed")


@query(f"WITH {_STATED.strip()} SELECT status, count(*) AS n FROM stated GROUP BY status")
def apps_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return finders.count_by(stated(spark, sf), "status")


@query(draw_sql("SELECT application_id, outcome, rank_in_pool FROM sel WHERE application_id = 'APP-2026-A000042'"))
def selection_of_applicant(spark: SparkSession, sf: str) -> DataFrame:
    return finders.one(drawn(spark, sf).selections, application_id="APP-2026-A000042").select("application_id", "outcome", "rank_in_pool")


@query("""WITH l AS (SELECT unnest([left_id, right_id]) AS application_id, decision, review_decision FROM v_duplicate_link)
SELECT application_id, 'RECEIVED' AS status FROM v_application WHERE application_id IN (SELECT application_id FROM l WHERE decision = 'NEEDS_REVIEW') AND application_id NOT IN (SELECT application_id FROM l WHERE review_decision = 'PENDING')""")
def cleared_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Applications that waited for a reviewer and that no undecided link touches any more."""
    links = view(spark, sf, "v_duplicate_link")
    return linkage.cleared(links, linkage.pending(links, apps(spark, sf).select("application_id", F.lit("RECEIVED").alias("status"))))


@query("SELECT a.application_id, link_id FROM v_duplicate_link JOIN v_application a ON a.application_id = left_id OR a.application_id = right_id WHERE review_decision = 'PENDING'")
def duplicate_history(spark: SparkSession, sf: str) -> DataFrame:
    """Undecided links of every application, found from either end."""
    return linkage.touching(view(spark, sf, "v_duplicate_link").where("review_decision = 'PENDING'"), apps(spark, sf)).select("application_id", "link_id")


@query(draw_sql("""SELECT pool, application_id FROM (SELECT pool, application_id FROM ranking JOIN pools USING (pool) WHERE rk <= seats
EXCEPT SELECT pool_code, application_id FROM sel WHERE outcome = 'SELECTED' AND application_id NOT LIKE '%07')
UNION ALL SELECT pool, application_id FROM (SELECT pool_code AS pool, application_id FROM sel WHERE outcome = 'SELECTED' AND application_id NOT LIKE '%07' EXCEPT SELECT pool, application_id FROM ranking JOIN pools USING (pool) WHERE rk <= seats)"""))
def pool_invariant_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Of a result without its winners whose ids end in 07."""
    o = drawn(spark, sf)
    forged = F.when(F.col("application_id").endswith("07"), "NOT_SELECTED").otherwise(F.col("outcome"))
    return draw.pool_violations(replace(o, selections=o.selections.withColumn("outcome", forged)))


_FORFEITED = "SELECT application_id FROM a_given WHERE unit_id IS NOT NULL AND pick_order % 9 {} 0"


@query(draw_sql(f""", {_WANTS}, {sequential.assigned_ctes('sel', 'a_wants')}, {sequential.promoted_ctes('sel', 'ranking', _FORFEITED.format('='), _FORFEITED.format('<>'), 'SELECT NULL WHERE false')}
SELECT 'DRAW-1:' || promoted || ':P' || pick_order AS allotment_id, draw_id, promoted AS application_id, unit_id, unit_type, block, pick_order, 0 AS preference_rank_honoured, p_made.basis, 'OFFERED' AS status,
'DRAW-1:' || vacated_by AS fills_vacancy_of FROM p_made JOIN a_given g ON g.application_id = vacated_by WHERE promoted IS NOT NULL""").strip().replace("WITH u AS", "WITH RECURSIVE u AS", 1))
def vacancy_offers(spark: SparkSession, sf: str) -> DataFrame:
    """New offers for forfeited allotments of a draw."""
    o = drawn(spark, sf)
    given = units.assign(o.selections, roll(spark, sf), flats(spark, sf), "DRAW-1").where("unit_id is not null")
    rows = given.select(F.concat_ws(":", "draw_id", "application_id").alias("allotment_id"), "draw_id", "application_id", "unit_id", "unit_type", "block", "pick_order", F.when(F.col("pick_order") % 9 == 0, "FORFEITED").otherwise("OFFERED").alias("status"), F.lit(None).cast("string").alias("fills_vacancy_of"))
    return units.promote_open(o.ranking, o.selections, keep(rows))


@query(draw_sql("SELECT 'pool=' || pool || '|' || vertical_code || '|' || seats || '|' || candidates || '|' || (seats - least(seats, candidates)) AS line FROM pools"))
def pool_lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in documents.pool_lines(drawn(spark, sf).pools)], "line string")


@query("SELECT scheme_code, channel, count(*) AS n FROM v_application GROUP BY ALL")
def app_counts(spark: SparkSession, sf: str) -> DataFrame:
    return finders.count_by(apps(spark, sf), "scheme_code", "channel")


@query("SELECT count(*) AS n FROM v_flat_unit WHERE NOT withdrawn")
def available_unit_count(spark: SparkSession, sf: str) -> DataFrame:
    return flats(spark, sf).where("not withdrawn").agg(F.count("*").alias("n"))


@query(draw_sql(f""", {_WANTS}, {sequential.assigned_ctes('sel', 'a_wants')}
SELECT a.application_id, coalesce(n, 0) AS n_checks, coalesce(n_failed, 0) AS n_failed, sel.outcome, sel.pool_code, sel.rank_in_pool, CAST(seats AS INTEGER) AS seats, CAST(candidates AS BIGINT) AS candidates, g.unit_id AS unit_id, g.unit_type AS unit_type, g.basis AS basis
FROM v_application a LEFT JOIN (SELECT application_id, count(*) AS n, count(*) FILTER (WHERE NOT passed) AS n_failed FROM v_eligibility_check GROUP BY 1) c USING (application_id) LEFT JOIN sel USING (application_id) LEFT JOIN pools ON pool = pool_code
LEFT JOIN (SELECT * FROM a_given WHERE unit_id IS NOT NULL) g ON g.application_id = a.application_id""").strip().replace("WITH u AS", "WITH RECURSIVE u AS", 1))
def explanation(spark: SparkSession, sf: str) -> DataFrame:
    """Each application with its checks, its line in the published draw and its unit, flattened."""
    o = drawn(spark, sf)
    given = units.assign(o.selections, roll(spark, sf), flats(spark, sf), "DRAW-1").where("unit_id is not null")
    found = finders.explanation(apps(spark, sf), view(spark, sf, "v_eligibility_check"), o.selections, o.pools, given)
    line, unit = F.get("draws", F.lit(0)), F.get("allotments", F.lit(0))
    checks = F.coalesce("checks", F.array().cast(found.schema["checks"].dataType))
    return found.select(
        "application_id", F.size(checks).cast("long").alias("n_checks"), F.size(F.filter(checks, lambda c: ~c["passed"])).cast("long").alias("n_failed"),
        line["outcome"].alias("outcome"), line["pool_code"].alias("pool_code"), line["rank_in_pool"].alias("rank_in_pool"), line["seats"].alias("seats"), line["candidates"].alias("candidates"), unit["unit_id"].alias("unit_id"), unit["unit_type"].alias("unit_type"), unit["basis"].alias("basis"),
    )


@query(f"""WITH {_STATED.strip()} SELECT count(*) AS applications, count(*) FILTER (WHERE status = 'ELIGIBLE') AS eligible, count(*) FILTER (WHERE status = 'INELIGIBLE') AS ineligible, (SELECT count(*) FROM v_flat_unit WHERE NOT withdrawn) AS units FROM stated""")
def status_view(spark: SparkSession, sf: str) -> DataFrame:
    rows = stated(spark, sf).agg(F.count("*").alias("applications"), F.count_if(F.col("status") == "ELIGIBLE").alias("eligible"), F.count_if(F.col("status") == "INELIGIBLE").alias("ineligible"))
    return rows.crossJoin(available_unit_count(spark, sf).withColumnRenamed("n", "units"))


_RUN = f"""WITH RECURSIVE {_SCORED}, {_RULES_SQL.replace('x AS (', 'f_rules AS (')},
f_edges AS (SELECT left_id AS a, right_id AS b FROM scored WHERE decision = 'AUTO_LINKED' OR (decision = 'NEEDS_REVIEW' AND score >= {_DOUBLE(pipeline.REVIEW_ACCEPT)})),
f_walk AS (SELECT application_id AS node, application_id AS reached FROM v_application UNION SELECT node, b FROM f_walk JOIN (SELECT a, b FROM f_edges UNION ALL SELECT b, a FROM f_edges) ON reached = a),
f_roots AS (SELECT node, min(reached) AS root FROM f_walk GROUP BY node),
f_first AS (SELECT root, arg_min(application_id, (submitted_min, application_id)) AS primary_id FROM f_roots JOIN v_application ON node = application_id GROUP BY root),
f_roll AS (SELECT * FROM v_application WHERE application_id IN (SELECT primary_id FROM f_first) AND application_id IN (SELECT application_id FROM v_eligibility_check GROUP BY 1 HAVING bool_and(passed))),
f_hash AS (SELECT sha256('roll/1' || chr(10) || 'schemeCode=SCH-T' || chr(10) || 'ruleSetVersion=RS-1' || chr(10) || 'ruleSetHash=' || (SELECT sha256(text) FROM f_rules) || chr(10) || 'frozenAt={STAMP}' || chr(10) || 'entryCount=' || count(*) || chr(10)
  || string_agg({_ROLL_LINE} || chr(10), '' ORDER BY application_id)) AS hash FROM f_roll),
f_seed AS (SELECT sha256('seed/1|' || hash || '|{ENTROPY}|{NONCE}') AS seed FROM f_hash),
{sequential.draw_ctes('f_roll', '(SELECT seed FROM f_seed)')}, {_WANTS}, {sequential.assigned_ctes('d_sel', 'a_wants')}"""


@query(f"{_RUN} SELECT * FROM a_given")
def full_run(spark: SparkSession, sf: str) -> DataFrame:
    """Linkage, eligibility, freeze, seed, draw and assignment in one run: the assigned units."""
    n = total_units(spark, sf)
    return pipeline.run(apps(spark, sf), view(spark, sf, "v_eligibility_check"), flats(spark, sf), rules.standard(n), NONCE, ENTROPY, STAMP, STAMP).assigned
