"""The draw: tickets, pools, guarantees, waitlists and an outcome for everyone.

All pools rank by one total order (tier, ticket, id).  Tickets are hexadecimal digests, so their first digits cut the
order into even ranges: ranks come from counts of the ranges plus row numbers within them, and no rank needs all rows
in one task.  Guarantees need the rows within the cut and, for each, as many more satisfiers as the guarantee: that
frontier has at most twice the seats, and goes to a grouped function for each pool.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions.hashing import ticket
from tamis.operators.storage import keep
from tamis.plans.rules import LAPSED_POOL, RuleSet, Vertical

_RUN = "pool string, kind string, application_id string, reason string, h_ord int, code string, required int, had int, promoted string, displaced string, note string"


def residency_tier(rules: RuleSet) -> Column:
    return F.when(F.col("residency_years") >= rules.min_years, 0).otherwise(1) if rules.residency_mode == "PRIORITY_TIER" else F.lit(0)


def ticketed(roll: DataFrame, rules: RuleSet, seed_hex: str) -> DataFrame:
    """Roll entries (application_id, vertical_code, horizontals array, residency_years) with ticket and tier."""
    return roll.withColumns({"ticket": ticket(seed_hex, "application_id"), "tier": residency_tier(rules)})


def ranked(rows: DataFrame, name: str = "rank") -> DataFrame:
    """rows (pool, tier, ticket, application_id, ...) with their rank in their pool, from 1."""
    rows = rows.withColumn("_range", F.left("ticket", F.lit(3)))
    counts = rows.groupBy("pool", "tier", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("pool").orderBy("tier", "_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pool", "tier", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("pool", "tier", "_range").orderBy("ticket", "application_id"))
    return rows.withColumn("_within", within).join(offsets, ["pool", "tier", "_range"]).withColumn(name, (F.col("_before") + F.col("_within")).cast("int")).drop("_range", "_before", "_within")


class _Winners:
    """The winners of a pool as stacks by codes held, the worst rank on top; what a guarantee may push out is the worst of a few tops."""

    def __init__(self, codes: dict[int, frozenset[str]]):
        self.codes, self.reason = codes, {}
        self.stacks: dict[frozenset[str], list[int]] = {}

    def add(self, rank: int, reason: str) -> None:
        self.reason[rank] = reason
        heapq.heappush(self.stacks.setdefault(self.codes[rank], []), -rank)

    def worst_without(self, kept: set[str]) -> int | None:
        """The worst-ranked winner who holds none of the codes."""
        return max((-held[0] for codes, held in self.stacks.items() if held and not codes & kept), default=None)

    def drop(self, rank: int) -> None:
        """Takes out a rank that is on top of its stack."""
        heapq.heappop(self.stacks[self.codes[rank]])
        del self.reason[rank]


def top_up(rows: Sequence[tuple[int, str, frozenset[str]]], seats: int, minima: Sequence[tuple[str, int]]) -> tuple[dict[int, str], list[int], list[tuple]]:
    """Winners by rank with reasons, displaced ranks, and notes, of (rank, id, codes) in rank order.

    A promotion costs a look at one top for each set of codes that winners hold, and a step in one stack.
    """
    codes, ids = {r: c for r, _, c in rows}, {r: i for r, i, _ in rows}
    held = _Winners(codes)
    for r, _, _ in rows:
        if r <= seats:
            held.add(r, "SELECTED_ON_MERIT")
    have = {h: sum(h in codes[r] for r in held.reason) for h, _ in minima}
    out: dict[int, None] = {}
    notes = []
    for k, (h, least) in enumerate(minima):
        short = least - have[h]
        if least <= 0 or short <= 0:
            continue
        had, promoted, pushed, stuck = have[h], [], [], False
        floors = [(x, n) for x, n in minima[: k + 1] if n > 0]
        for r in (r for r, _, c in rows if h in c and r not in held.reason):
            if len(promoted) == short:
                break
            victim = held.worst_without({h, *(x for x, n in floors if have[x] <= n)})
            if stuck := victim is None:
                break
            held.drop(victim)
            held.add(r, "SELECTED_VIA_HORIZONTAL_MINIMUM")
            out[victim] = None
            out.pop(r, None)
            for x in have:
                have[x] += (x in codes[r]) - (x in codes[victim])
            promoted.append(ids[r])
            pushed.append(ids[victim])
        notes.append((k, h, least, had, ",".join(promoted), ",".join(pushed), _note(h, len(promoted), short, stuck)))
    return held.reason, list(out), notes


def _note(code: str, n: int, short: int, stuck: bool) -> str:
    if stuck:
        return f"{code}: {n} of {short} missing seats filled; all other winners hold a guaranteed seat"
    if n < short:
        return f"{code}: {n} of {short} missing seats filled; the pool has no further holder of the code"
    return f"{code}: all {n} missing seats filled by promotion"


def _pool_run(plan: dict[str, Vertical]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = pdf["pool"].iloc[0]
        v = plan[pool]
        pdf = pdf.sort_values("rank")
        rows = [(int(r), i, frozenset(h)) for r, i, h in zip(pdf["rank"], pdf["application_id"], pdf["horizontals"], strict=True)]
        won, out, notes = top_up(rows, v.seats, [(m.code, m.seats) for m in v.minima])
        ids = {r: i for r, i, _ in rows}
        made = [(pool, "selected", ids[r], why, None, None, None, None, None, None, None) for r, why in won.items()]
        made += [(pool, "displaced", ids[r], None, None, None, None, None, None, None, None) for r in out]
        made += [(pool, "note", None, None, *n) for n in notes]
        frame = pd.DataFrame(made, columns=[x.split()[0] for x in _RUN.split(", ")])
        return frame.astype({c: "Int32" for c in ("h_ord", "required", "had")})

    return run


def run_pools(ranking: DataFrame, verticals: Sequence[Vertical]) -> DataFrame:
    """Selected, displaced and note rows of the pools of ranking (pool, application_id, horizontals, rank)."""
    plan = {v.code: v for v in verticals}
    spark = ranking.sparkSession
    seats = F.broadcast(spark.createDataFrame([(v.code, v.seats) for v in verticals], "pool string, seats int"))
    rows = ranking.join(seats, "pool").select("pool", "application_id", "horizontals", "rank", "seats")
    inside = rows.where("rank <= seats")
    least = [(v.code, m.code, m.seats) for v in verticals for m in v.minima if m.seats > 0]
    if not least:
        empty = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _RUN.split(", ")[4:]]
        return inside.select("pool", F.lit("selected").alias("kind"), "application_id", F.lit("SELECTED_ON_MERIT").alias("reason"), *empty)
    need = F.broadcast(spark.createDataFrame(least, "pool string, code string, need int"))
    beyond = rows.where("rank > seats").withColumn("code", F.explode("horizontals")).join(need, ["pool", "code"])
    # the row-number bound is a literal too, so that it cuts the rows before the shuffle
    next_ = F.row_number().over(Window.partitionBy("pool", "code").orderBy("rank"))
    beyond = beyond.withColumn("_next", next_).where((F.col("_next") <= max(n for _, _, n in least)) & (F.col("_next") <= F.col("need")))
    frontier = inside.select("pool", "application_id", "horizontals", "rank").union(beyond.select("pool", "application_id", "horizontals", "rank")).dropDuplicates(["pool", "application_id"])
    return frontier.groupBy("pool").applyInPandas(_pool_run(plan), _RUN)


@dataclass
class Outcome:
    """plan: seats of each pool; ranking, selections and notes as frames; pools: seats, candidates and unfilled seats."""

    plan: tuple[Vertical, ...]
    ranking: DataFrame
    pools: DataFrame
    notes: DataFrame
    selections: DataFrame


def check_roll(roll: DataFrame, rules: RuleSet) -> None:
    """Refuses a roll with codes that the rules do not define, or with an id twice."""
    verticals = {rules.open_code, *(q.code for q in rules.reserved)}
    horizontals = [q.code for q in rules.horizontal]
    unknown = roll.where(~F.col("vertical_code").isin(*verticals) | (F.size(F.array_except("horizontals", F.array(*map(F.lit, horizontals)).cast("array<string>"))) > 0))
    if (bad := unknown.select("application_id").first()) is not None:
        raise ValueError(f"roll entry {bad[0]} has a category or quota that rule set {rules.version} does not define")
    if (twice := roll.groupBy("application_id").count().where("count > 1").first()) is not None:
        raise ValueError(f"duplicate application id in roll: {twice[0]}")


def execute(roll: DataFrame, rules: RuleSet, seed_hex: str, check: bool = True) -> Outcome:
    """The draw over roll (application_id, vertical_code, horizontals, residency_years)."""
    spark = roll.sparkSession
    if check:
        check_roll(roll, rules)
    plan = rules.plan()
    people = keep(ticketed(roll.select("application_id", "vertical_code", "horizontals", "residency_years"), rules, seed_hex))
    columns = ["pool", "application_id", "horizontals", "ticket", "tier", "vertical_code"]
    open_rank = keep(ranked(people.withColumn("pool", F.lit(rules.open_code)).select(*columns)))
    open_run = keep(run_pools(open_rank, plan[:1]))
    ranks, runs, verticals = [open_rank], [open_run], list(plan)
    won = open_run.where("kind = 'selected'").select("application_id")
    if len(plan) > 1:
        codes = [v.code for v in plan[1:]]
        rest = people.where(F.col("vertical_code").isin(*codes)).join(won, "application_id", "left_anti").withColumn("pool", F.col("vertical_code"))
        ranks.append(keep(ranked(rest.select(*columns))))
        runs.append(keep(run_pools(ranks[-1], plan[1:])))
        won = won.union(runs[-1].where("kind = 'selected'").select("application_id"))
        filled = dict(runs[-1].where("kind = 'selected'").groupBy("pool").count().collect())
        unfilled = sum(v.seats - filled.get(v.code, 0) for v in plan[1:])
        if unfilled > 0 and rules.lapse_policy == "LAPSE_TO_OPEN":
            lapsed = Vertical(LAPSED_POOL, unfilled, rules.minima(LAPSED_POOL, unfilled))
            rest = people.join(won, "application_id", "left_anti").withColumn("pool", F.lit(LAPSED_POOL))
            ranks.append(keep(ranked(rest.select(*columns))))
            runs.append(keep(run_pools(ranks[-1], [lapsed]).withColumn("reason", F.when(F.col("kind") == "selected", "SELECTED_IN_LAPSED_OPEN_POOL").otherwise(F.col("reason")))))
            verticals.append(lapsed)
    return _outcome(spark, people, _union(ranks), _union(runs), plan, verticals, rules)


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for x in rest:
        first = first.unionByName(x)
    return first


def _outcome(spark: SparkSession, people: DataFrame, ranking: DataFrame, runs: DataFrame, plan: tuple[Vertical, ...], verticals: list[Vertical], rules: RuleSet) -> Outcome:
    order = F.broadcast(spark.createDataFrame([(k, v.code, rules.open_code if v.code == LAPSED_POOL else v.code, v.seats) for k, v in enumerate(verticals)], "pool_ord int, pool string, vertical_code string, seats int"))
    candidates = ranking.groupBy("pool").agg(F.count("*").alias("candidates"))
    pools = order.join(candidates, "pool", "left").select("pool_ord", "pool", "vertical_code", "seats", F.coalesce("candidates", F.lit(0)).alias("candidates"))
    pools = pools.withColumn("unfilled", F.col("seats") - F.least(F.greatest("seats", F.lit(0)).cast("long"), "candidates"))
    selected = runs.where("kind = 'selected'").select("application_id", F.col("pool").alias("won_pool"), F.col("reason").alias("won_reason"))
    displaced = runs.where("kind = 'displaced'").select("application_id").distinct().withColumn("displaced", F.lit(True))
    waiting = ranking.join(selected.select("application_id"), "application_id", "left_anti")
    waiting = ranked(waiting.select("pool", "application_id", "ticket", "tier", F.col("rank")), "position").join(order.select("pool", "pool_ord"), "pool")
    best = waiting.groupBy("application_id").agg(F.min_by(F.struct("pool", "rank", "position"), F.struct("position", "pool_ord")).alias("b"))
    won_rank = ranking.select("application_id", F.col("pool").alias("won_pool"), F.col("rank").alias("won_rank"))
    rows = people.select("application_id", "ticket", "tier").join(selected.join(won_rank, ["application_id", "won_pool"]), "application_id", "left").join(best, "application_id", "left").join(displaced, "application_id", "left")
    rows = rows.withColumn("pool", F.coalesce("won_pool", "b.pool", F.lit(rules.open_code))).join(F.broadcast(pools.select("pool", F.col("seats").alias("pool_seats"), F.col("candidates").alias("pool_candidates"))), "pool", "left")
    is_won, position = F.col("won_pool").isNotNull(), F.coalesce("b.position", F.lit(0))
    waitlisted = ~is_won & (position > 0) & (position <= rules.waitlist_size)
    seats, n = F.coalesce("pool_seats", F.lit(0)), F.coalesce("pool_candidates", F.lit(0))
    code = (
        F.when(is_won, F.col("won_reason"))
        .when(F.col("displaced"), "DISPLACED_BY_HORIZONTAL_MINIMUM")
        .when(seats == 0, "NOT_SELECTED_NO_SEATS_IN_POOL")
        .when(waitlisted, "WAITLISTED_BEHIND_SELECTED")
        .otherwise("NOT_SELECTED_RANK_BELOW_SEATS")
    )
    rows = rows.select(
        "application_id",
        F.when(is_won, "SELECTED").when(waitlisted, "WAITLISTED").otherwise("NOT_SELECTED").alias("outcome"),
        F.col("pool").alias("pool_code"),
        F.col("ticket").alias("ticket_hex"),
        F.col("tier").alias("residency_tier"),
        F.coalesce("won_rank", "b.rank", F.lit(0)).alias("rank_in_pool"),
        F.when(waitlisted, position).alias("waitlist_position"),
        code.alias("reason_code"),
        seats.alias("_seats"),
        n.alias("_n"),
    )
    selections = rows.withColumn("reason_text", reason_text()).drop("_seats", "_n")
    notes = runs.where("kind = 'note'").select("pool", "h_ord", "code", "required", "had", "promoted", "displaced", "note")
    return Outcome(plan, ranking, pools, notes, selections)


#: What each reason adds to the sentence about rank and seats.
REASONS = {
    "SELECTED_ON_MERIT": " The ticket alone decided.",
    "SELECTED_VIA_HORIZONTAL_MINIMUM": " A guaranteed minimum of a horizontal quota gave the seat.",
    "SELECTED_IN_LAPSED_OPEN_POOL": " The seat was reserved, stayed empty in its category, and went to the open pool under the lapse rule.",
    "DISPLACED_BY_HORIZONTAL_MINIMUM": " The rank was within the seats, but a guaranteed minimum of a horizontal quota took the seat; the notes of the draw name the exchange, and the waitlist starts with this application.",
    "NOT_SELECTED_NO_SEATS_IN_POOL": " The rules give this pool no seats.",
    "WAITLISTED_BEHIND_SELECTED": " If a winner gives up a seat or fails verification, the waitlist is called in order.",
    "NOT_SELECTED_RANK_BELOW_SEATS": " Seats and waitlist ended before this rank.",
}


def reason_text() -> Column:
    ends = F.create_map(*[F.lit(y) for kv in REASONS.items() for y in kv])
    won = F.format_string("Selected in pool %s at rank %d of %d candidates for %d seats.", "pool_code", "rank_in_pool", "_n", "_seats")
    lost = F.format_string("Ranked %d of %d in pool %s, which had %d seats.", "rank_in_pool", "_n", "pool_code", "_seats")
    waits = F.when(F.col("waitlist_position").isNotNull(), F.format_string(" Waitlist position %d.", "waitlist_position")).otherwise("")
    return F.concat(F.when(F.col("outcome") == "SELECTED", won).otherwise(F.concat(lost, waits)), ends[F.col("reason_code")])


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of people selected in both draws."""
    pick = lambda x: x.where("outcome = 'SELECTED'").select("application_id")
    return pick(a).join(pick(b), "application_id").agg(F.count("*").alias("overlap"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Selections that differ between a published and a recomputed result, by id."""
    columns = ["outcome", "pool_code", "rank_in_pool", "waitlist_position", "reason_code"]
    x, y = (d.select("application_id", F.struct(*columns).alias(n)) for d, n in ((a, "published"), (b, "recomputed")))
    return x.join(y, "application_id", "full").where(~F.col("published").eqNullSafe(F.col("recomputed")))


def tier_order_violations(o: Outcome) -> DataFrame:
    """Pools in which someone of a later tier was selected on merit while someone of an earlier tier was not."""
    won = o.selections.where("reason_code = 'SELECTED_ON_MERIT'").groupBy("pool_code").agg(F.max("residency_tier").alias("worst"))
    lost = o.ranking.join(o.selections.where("outcome = 'SELECTED'").select("application_id"), "application_id", "left_anti").groupBy(F.col("pool").alias("pool_code")).agg(F.min("tier").alias("best"))
    displaced = o.notes.where("displaced <> ''").select(F.col("pool").alias("pool_code")).distinct()
    return won.join(lost, "pool_code").where("worst > best").join(displaced, "pool_code", "left_anti")


def pool_violations(o: Outcome) -> DataFrame:
    """pool, application_id where the winners of a pool are not its first ranks, less those displaced, plus those promoted."""
    ids = lambda c: o.notes.select("pool", F.explode(F.split(c, ",")).alias("application_id")).where("application_id <> ''")
    seats = F.broadcast(o.pools.select("pool", "seats"))
    # someone displaced for one guarantee and promoted for a later one counts once on each side
    net = ids("promoted").withColumn("d", F.lit(1)).union(ids("displaced").withColumn("d", F.lit(-1)))
    first = o.ranking.join(seats, "pool").where("rank <= seats").select("pool", "application_id", F.lit(1).alias("d"))
    expected = first.union(net).groupBy("pool", "application_id").agg(F.sum("d").alias("d")).where("d > 0").select("pool", "application_id")
    won = o.selections.where("outcome = 'SELECTED'").select(F.col("pool_code").alias("pool"), "application_id")
    return expected.exceptAll(won).union(won.exceptAll(expected))
