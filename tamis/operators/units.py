"""Unit assignment in ticket order, and promotion from waitlists.

Assignment: as long as everybody still finds a stated type, winners and types meet as in deferred acceptance. Each winner
asks for the first type whose cut-off does not exclude them, each type sets its cut-off at the pick that takes its last unit,
and whoever comes after that asks again.  In round k the k smallest cut-offs are final, so there are at most as many rounds
as types; a unit is the place of its pick among those of its type.  From the first pick on that no stated type is left for,
the choice (the lowest-numbered unit of all) depends on every pick before it; these picks go through blocks of bounded
size, in order, with one number for each type handed on.  Picks beyond the last unit need neither.

Promotion: pools run beside one another, and each reads its ranking as a stream.  Only applicants who stand in several pools
tie them together: the earliest vacancy that calls one of them excludes the later ones of other pools, and pools run again
until no one is called twice.  Vacancies only ever move to an earlier place in that process, so it ends.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.operators import draw, order
from tamis.operators.storage import keep, stored

_TAKEN = "application_id string, pick_order int, unit_type string, place long, preference_rank int"
#: Stands for the type of units without one; nobody can state it.
_NO_TYPE = "\0"
#: Winners in one block of those picks that depend on all before them.
BLOCK = 200_000


def available_units(units: DataFrame) -> DataFrame:
    """Units that are not withdrawn, with their place within their type; units of one id are in the order of their blocks."""
    return order.numbered(units.where("not withdrawn"), "unit_type", "unit_id", ties=("block",)).withColumn("place", F.col("place").cast("int"))


def pick_order(selections: DataFrame, draw_id: str) -> DataFrame:
    won = selections.where("outcome = 'SELECTED'").select(F.lit(draw_id).alias("pool"), F.lit(0).alias("tier"), F.col("ticket_hex").alias("ticket"), "application_id")
    return draw.ranked(won, "pick_order").select(F.col("pool").alias("draw_id"), "application_id", F.col("ticket").alias("ticket_hex"), "pick_order")


def _fold(winners: pd.DataFrame, units: pd.DataFrame) -> pd.DataFrame:
    """The picks of one block, in order; units has the first of each type that are left, as many as there are winners."""
    stock = {t: deque(zip(g["unit_id"], g["place"], strict=True)) for t, g in units.sort_values("place").groupby("unit_type")}
    # heads of the types' queues, the lowest first; a head that has been taken is replaced when it is met
    heads = [(q[0][0], t) for t, q in stock.items()]
    heapq.heapify(heads)
    out = []
    for w in winners.sort_values("pick_order").itertuples():
        wants = list(w.preferences) if w.preferences is not None else []
        kind, rank = next(((t, k) for k, t in enumerate(wants, 1) if stock.get(t)), (None, 0))
        while kind is None and heads:
            unit, t = heads[0]
            if stock[t] and stock[t][0][0] == unit:
                kind = t
                break
            heapq.heappop(heads)
            if stock[t]:
                heapq.heappush(heads, (stock[t][0][0], t))
        if kind is not None:
            out.append((w.application_id, w.pick_order, kind, stock[kind].popleft()[1], rank))
    return pd.DataFrame(out, columns=[x.split()[0] for x in _TAKEN.split(", ")])


def _choices(winners: DataFrame, last: dict[str, int]) -> DataFrame:
    """winners with kind: the first stated type that their pick does not come too late for; null if there is none."""
    if not last:
        return winners.withColumn("kind", F.lit(None).cast("string"))
    latest = F.map_from_arrays(F.lit(list(last)), F.lit(list(last.values())).cast("array<bigint>"))
    open_ = F.filter("preferences", lambda t: t.isNotNull() & (F.coalesce(F.try_element_at(latest, F.coalesce(t, F.lit(""))), F.lit(0)) >= F.col("pick_order")))
    return winners.withColumn("kind", F.when(F.size(open_) > 0, open_[0]))


def _cut_offs(winners: DataFrame, stock: dict[str, int]) -> dict[str, int]:
    """The last pick that each type can serve, if all picks are of stated types."""
    last = dict.fromkeys(stock, 1 << 31)
    while True:
        asked = _choices(winners, last).where("kind is not null").select("kind", "pick_order")
        now = last | order.kth(asked, stock)
        if now == last:
            return last
        last = now


def _in_order(winners: DataFrame, units: DataFrame, used: dict[str, int], first: int, end: int, block: int) -> list[DataFrame]:
    """The picks from first to end (exclusive), block by block; used: units of each type that are taken before."""
    spark, out = winners.sparkSession, []
    for at in range(first, end, block):
        some = winners.where(F.col("pick_order").between(at, min(end, at + block) - 1)).select(F.lit(0).alias("one"), "application_id", "pick_order", "preferences")
        taken = F.broadcast(spark.createDataFrame(list(used.items()), "of_type string, used long"))
        left = units.join(taken, F.col("unit_type") == F.col("of_type")).where((F.col("place") > F.col("used")) & (F.col("place") <= F.col("used") + block))
        left = left.select(F.lit(0).alias("one"), "unit_type", "unit_id", "place")
        # one group, of a block's winners and as many units of each type
        picks = keep(some.groupBy("one").cogroup(left.groupBy("one")).applyInPandas(_fold, _TAKEN))
        used = used | {r["unit_type"]: r["place"] for r in picks.groupBy("unit_type").agg(F.max("place").alias("place")).collect()}
        out.append(picks)
    return out


def assign(selections: DataFrame, roll: DataFrame, units: DataFrame, draw_id: str, block: int = BLOCK) -> DataFrame:
    """A row for each winner; unit_id is null where the inventory ran out.  roll has application_id and preferences."""
    winners = keep(pick_order(selections, draw_id).join(roll.select("application_id", "preferences"), "application_id", "left").drop("ticket_hex"))
    left = keep(order.numbered(units.where("not withdrawn").select("unit_id", F.coalesce("unit_type", F.lit(_NO_TYPE)).alias("unit_type"), "block"), "unit_type", "unit_id", ties=("block",)))
    # types are the codes of a list; their counts are all that the driver holds
    stock = {r["unit_type"]: r["n"] for r in left.groupBy("unit_type").agg(F.count("*").alias("n")).collect()}
    chosen = _choices(winners, _cut_offs(winners, stock))
    free = chosen.where("kind is null").agg(F.min("pick_order")).first()[0]
    sure = chosen.where("kind is not null") if free is None else chosen.where(F.col("pick_order") < free)
    rank = F.array_position("preferences", F.col("kind")).cast("int")
    taken = order.ranks(sure).select("application_id", "pick_order", F.col("kind").alias("unit_type"), "place", rank.alias("preference_rank"))
    if free is not None:
        taken = keep(taken)
        used = dict.fromkeys(stock, 0) | {r[0]: r[1] for r in taken.groupBy("unit_type").agg(F.max("place")).collect()}
        many = winners.agg(F.max("pick_order")).first()[0]
        for picks in _in_order(winners, left, used, free, min(many + 1, free + sum(stock.values()) - sum(used.values())), block):
            taken = taken.unionByName(picks)
    got = taken.select("application_id", "unit_type", "place", "preference_rank").join(left, ["unit_type", "place"])
    rows = winners.join(got.drop("place"), "application_id", "left")
    stated = F.size(F.coalesce("preferences", F.array().cast("array<string>")))
    basis = (
        F.when(F.col("unit_id").isNull(), "inventory exhausted")
        .when(F.col("preference_rank") > 0, F.concat(F.lit("preference "), F.col("preference_rank").cast("string"), F.lit(" of "), stated.cast("string"), F.lit(" honoured")))
        .when(stated > 0, "all stated preferences exhausted; lowest-numbered available unit assigned")
        .otherwise("no preference stated; lowest-numbered available unit assigned")
    )
    return rows.select("draw_id", "application_id", "unit_id", F.nullif("unit_type", F.lit(_NO_TYPE)).alias("unit_type"), "block", "pick_order", F.coalesce("preference_rank", F.lit(0)).alias("preference_rank"), basis.alias("basis"))


def left_over(assigned: DataFrame, units: DataFrame) -> DataFrame:
    return units.where("not withdrawn").join(assigned.where("unit_id is not null").select("unit_id"), "unit_id", "left_anti")


def assignment_counts(assigned: DataFrame, units: DataFrame) -> DataFrame:
    return assigned.agg(F.count("unit_id").alias("assigned"), F.count_if(F.col("unit_id").isNull()).alias("unhoused"), F.count_if(F.col("preference_rank") == 1).alias("first_choices"), F.countDistinct("unit_id").alias("units")).crossJoin(left_over(assigned, units).agg(F.count("*").alias("unassigned")))


_CALLS = "pool string, application_id string, rank int, vacancy string, position int"
#: Sorts before every vacancy: of those who never hold a seat.
_NEVER = ""


class _Pool:
    """One pool's ranking, read in order against its vacancies; a vacancy is named by a text that sorts as vacancies are filled."""

    def __init__(self, vacancies: list[str]):
        self.vacancies, self.called = vacancies, 0
        self.seatless, self.leaving = 0, []  # those passed who hold no seat, and those who will leave theirs

    def meets(self, left: str | None, until: str | None) -> tuple[str, int] | None:
        """The vacancy that calls this applicant and the position; left: when a seat was vacated, null for those who can be called; until: vacancies of this name or later find them called."""
        if left is not None:
            heapq.heappush(self.leaving, left)
            return None
        if self.called >= len(self.vacancies):
            return None
        now = self.vacancies[self.called]
        if until is not None and until <= now:
            return None
        while self.leaving and self.leaving[0] <= now:
            heapq.heappop(self.leaving)
            self.seatless += 1
        self.called += 1
        return now, self.seatless + 1


def _called(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by pool, kind (vacancies before applicants), and vacancy or rank: the calls."""
    name, pool = None, _Pool([])
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*[batch.column(c).to_pylist() for c in ("pool", "kind", "vacancy", "application_id", "rank", "left", "until")], strict=True):
            if row[0] != name:
                name, pool = row[0], _Pool([])
            if row[1] == 0:
                pool.vacancies.append(row[2])
            elif (call := pool.meets(row[5], row[6])) is not None:
                out.append((name, row[3], row[4], *call))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _CALLS.split(", ")])


def _calls(vacant: DataFrame, near: DataFrame, until: DataFrame | None) -> DataFrame:
    """One run of all pools beside one another."""
    no = F.lit(None).cast("string")
    near = near.withColumn("until", no) if until is None else near.join(until, ["pool", "application_id"], "left")
    rows = vacant.select("pool", F.lit(0).alias("kind"), "vacancy", no.alias("application_id"), F.lit(0).alias("rank"), no.alias("left"), no.alias("until"))
    rows = rows.unionByName(near.select("pool", F.lit(1).alias("kind"), no.alias("vacancy"), "application_id", "rank", "left", "until"))
    return stored(rows.repartition("pool").sortWithinPartitions("pool", "kind", "vacancy", "rank").mapInArrow(_called, _CALLS))


def promote(ranking: DataFrame, selections: DataFrame, forfeited: DataFrame, holders: DataFrame, declined: DataFrame) -> DataFrame:
    """A promotion for each forfeited seat (application_id), in ticket order; position counts those skipped, too.

    ranking has pool, application_id and rank.  Of those who can be called a pool needs as many as there are vacancies, and everyone ahead of them.
    """
    name = F.concat_ws("\0", "ticket_hex", "application_id")
    vacant = keep(forfeited.select("application_id").distinct().join(selections.select("application_id", "ticket_hex", "pool_code"), "application_id").withColumn("vacancy", name))
    held = holders.select("application_id").distinct()
    # when a seat is vacated; those who never hold one (they declined, or had left before) are passed from the start
    skip = declined.select("application_id").union(forfeited.select("application_id")).distinct()
    leaves = skip.join(vacant.join(held, "application_id", "left_semi").groupBy("application_id").agg(F.min("vacancy").alias("left")), "application_id", "left").fillna(_NEVER, ["left"])
    # who declined and holds a seat keeps it
    keeps = held.join(vacant, "application_id", "left_anti")
    pools = vacant.select(F.col("pool_code").alias("pool")).distinct()
    free = ranking.join(pools, "pool", "left_semi").select("pool", "application_id", F.col("rank").cast("int").alias("rank")).join(keeps, "application_id", "left_anti")
    free = keep(free.join(leaves, "application_id", "left"))
    reach = order.kth(free.where("left is null").select(F.col("pool").alias("kind"), F.col("rank").alias("pick_order")), dict.fromkeys([r[0] for r in pools.where("pool is not null").collect()], max(1, vacant.count())))
    near = free
    if reach:
        ends = F.broadcast(ranking.sparkSession.createDataFrame(list(reach.items()), "of_pool string, reach long"))
        near = free.join(ends, F.col("pool") == F.col("of_pool"), "left").where(F.col("reach").isNull() | (F.col("rank") <= F.col("reach"))).drop("of_pool", "reach")
    near = keep(near)
    seats, until, first = vacant.select(F.col("pool_code").alias("pool"), "vacancy"), None, None
    while True:
        calls = _calls(seats, near, until)
        if not calls.groupBy("application_id").count().where("count > 1").limit(1).count():
            break
        # the earliest call of each pool so far; all pools but the one with the earliest must do without that applicant from then on
        each = calls.select("application_id", "pool", "vacancy")
        first = stored((each if first is None else each.unionByName(first)).groupBy("application_id", "pool").agg(F.min("vacancy").alias("vacancy")))
        others = first.withColumnsRenamed({"pool": "by", "vacancy": "until"})
        pairs = first.select("application_id", "pool").join(others, "application_id").where("pool <> by")
        until = stored(pairs.groupBy("application_id", "pool").agg(F.min("until").alias("until")))
    made = vacant.join(calls.select(F.col("pool").alias("pool_code"), "vacancy", F.col("application_id").alias("promoted"), "rank", "position"), ["pool_code", "vacancy"], "left")
    found = F.col("promoted").isNotNull()
    basis = F.when(found, F.concat(F.lit("called from the waitlist of pool "), "pool_code", F.lit(" at rank "), F.col("rank").cast("string"), F.lit(" in place of "), "application_id"))
    basis = basis.otherwise(F.concat(F.lit("the waitlist of pool "), F.coalesce("pool_code", F.lit("None")), F.lit(" is used up; the seat stays open for a later draw")))
    made = made.orderBy("vacancy")
    return made.select(F.col("application_id").alias("vacated_by"), "promoted", F.col("pool_code").alias("pool"), F.coalesce("position", F.lit(0)).alias("promotion_position"), basis.alias("basis"))


LIVE = ("OFFERED", "ACCEPTED")


def live_key() -> F.Column:
    """draw:unit of a live offer, else null; equal keys are a violation."""
    return F.when(F.col("status").isin(*LIVE), F.concat_ws(":", "draw_id", "unit_id"))


def open_vacancies(allotments: DataFrame) -> DataFrame:
    """Forfeited allotments that no later allotment fills."""
    filled = allotments.where("fills_vacancy_of is not null").select(F.col("fills_vacancy_of").alias("allotment_id"))
    return allotments.where("status = 'FORFEITED'").join(filled, "allotment_id", "left_anti")


def promotion_sets(allotments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Holders (live), those who declined a promotion, and forfeited seats to fill."""
    holders = allotments.where(F.col("status").isin(*LIVE)).select("application_id").distinct()
    declined = allotments.where("status = 'FORFEITED' and fills_vacancy_of is not null").select("application_id").distinct()
    return holders, declined, open_vacancies(allotments).select("application_id", "allotment_id", "unit_id", "unit_type", "block", "draw_id", "pick_order")


def promote_open(ranking: DataFrame, selections: DataFrame, allotments: DataFrame) -> DataFrame:
    """New offers for open vacancies: the vacated unit goes to the promoted applicant; run again, it adds nothing new."""
    holders, declined, vacant = promotion_sets(allotments)
    own_pool = selections.select("application_id", "ticket_hex", "pool_code")
    # a vacancy left by someone who was promoted stays in the pool of the seat's first holder
    made = promote(ranking, own_pool, vacant, holders, declined).where("promoted is not null")
    seat = vacant.withColumnRenamed("application_id", "vacated_by")
    new = made.join(seat, "vacated_by")
    return new.select(
        F.concat_ws(":", "draw_id", "promoted", F.concat(F.lit("P"), F.col("pick_order").cast("string"))).alias("allotment_id"),
        "draw_id", F.col("promoted").alias("application_id"), "unit_id", "unit_type", "block", "pick_order", F.lit(0).alias("preference_rank_honoured"), "basis",
        F.lit("OFFERED").alias("status"), F.col("allotment_id").alias("fills_vacancy_of"),
    )
