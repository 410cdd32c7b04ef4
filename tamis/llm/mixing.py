"""Mixing sources to target weights with hash-threshold histograms; DataFrame operations only.

Each document has a fixed hash of `BITS * LEVELS` bits.  A source's target is a number of whole copies plus a remainder;
the remainder is the set of documents whose hash lies under a threshold.  The threshold comes from a histogram of words
by source and hash bucket: the bucket in which the running sum passes the budget is split on the next BITS bits, and
only its rows are summed again, until the last level.  Nothing is sorted; smaller budgets give subsets of larger ones.

Null texts have size 0; a null source is a source of its own, ordered last; null ids share one hash; equal rows get
equal decisions; an empty table gives an empty result; other columns are ignored by `mixture`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import free, keep, n_tokens

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
BITS, LEVELS = 8, 5
#: More sources than this are joined by shuffle, not broadcast.
MAX_BROADCAST_SOURCES = 50_000


def mix_hash(col: str) -> Column:
    """The first BITS * LEVELS bits of md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """source, source_size, target: budget times all words shared by weight, none above cap times its source.

    A share is min(cap * size, level * weight); with sources ordered by cap * size / weight, the level is the largest of
    (budget - caps before) / (weights from here on).  One row for each source, so the ordered windows are small.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # sources are few (their number does not follow the rows), so one ordered partition holds them
    ranked = per.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    order = Window.orderBy((F.col("source_size") * cap / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    leveled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return leveled.select("source", "source_size", F.least((F.col("source_size") * cap).cast("double"), F.col("level") * F.col("w")).alias("target"))


def _joined(rows: DataFrame, per: DataFrame, few: bool) -> DataFrame:
    per = per.withColumnRenamed("source", "of_source")
    return rows.join(F.broadcast(per) if few else per, rows["source"].eqNullSafe(per["of_source"])).drop("of_source")


def thresholds(sizes: DataFrame, per: DataFrame, few: bool) -> DataFrame:
    """per plus copies (whole takes) and below (hashes under it are taken once more)."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = per.withColumn("copies", copies.cast("long"))
    state = state.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("below", F.lit(0).cast("long"))
    for k in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - k)
        inside = sizes if k == 1 else _joined(sizes, state.select("source", "below"), few).where(F.shiftright("hash", shift + BITS) == F.col("below"))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("at")).agg(F.sum("size").alias("in_bucket"))
        upto = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("at"))
        sums = _joined(sums.withColumn("upto", upto), state.select("source", "left"), few)
        passed = sums.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min_by(F.struct("at", "in_bucket", (F.col("upto") - F.col("in_bucket")).alias("under")), "at").alias("edge"))
        passed = passed.withColumnRenamed("source", "of_source")
        state = state.join(F.broadcast(passed) if few else passed, state["source"].eqNullSafe(passed["of_source"]), "left").drop("of_source")
        at, under, of = F.col("edge.at"), F.col("left") - F.col("edge.under"), F.col("edge.in_bucket")
        # the last bucket counts as a whole if that comes closer to the budget
        at = at + F.when(under * 2 >= of, 1).otherwise(0) if k == LEVELS else at
        # a source without an edge fits whole: its threshold lies past every hash and nothing is left to split
        whole = F.lit(1 << BITS).cast("long") if k == 1 else F.shiftleft("below", BITS)
        found = F.col("edge").isNotNull()
        state = state.withColumns({"below": F.when(found, at).otherwise(whole), "left": F.when(found, under).otherwise(0.0)}).drop("edge")
        state = keep(state)
    return state


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> tuple[DataFrame, DataFrame, bool]:
    """The sizes (doc_id, size, source, hash), the decision of each source (target, copies, below), and whether sources are few."""
    sizes = keep(docs.select(F.col(doc_id).alias("doc_id"), n_tokens(F.col(text)).alias("size"), F.col(source).alias("source"), mix_hash(doc_id).alias("hash")))
    per = keep(source_targets(sizes, weights, budget, cap))
    few = per.count() <= MAX_BROADCAST_SOURCES
    return sizes, thresholds(sizes, per, few).select("source", "source_size", "target", "copies", "below"), few


def _times(hash_: Column, cap: int) -> Column:
    return F.least(F.col("copies") + F.when(hash_ < F.col("below"), 1).otherwise(0), F.lit(cap))


def mixture(docs: DataFrame, cap: int = CAP, **how: object) -> DataFrame:
    """doc_id, size, source, source_size, target, taken (words the mix takes, copies counted), times of each document."""
    sizes, state, few = mix_plan(docs, cap=cap, **how)
    times = _times(F.col("hash"), cap)
    return _joined(sizes, state, few).select("doc_id", "size", "source", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cap: int = CAP, **how: object) -> DataFrame:
    """docs, all columns, plus mix_times and mix_size, of the documents that the mix takes; texts are not shuffled.

    A table that has columns of these names keeps them; the new ones then end in as many underscores as it takes.
    """
    of, copies, below = free(("_mix_source", "_mix_copies", "_mix_below"), docs.columns)
    new_times, new_size = free(("mix_times", "mix_size"), docs.columns)
    _, state, few = mix_plan(docs, doc_id, text, source, cap=cap, **how)
    state = state.select(F.col("source").alias(of), F.col("copies").alias(copies), F.col("below").alias(below))
    rows = docs.join(F.broadcast(state) if few else state, docs[source].eqNullSafe(F.col(of)))
    times = F.least(F.col(copies) + F.when(mix_hash(doc_id) < F.col(below), 1).otherwise(0), F.lit(cap))
    return rows.withColumns({new_times: times, new_size: n_tokens(F.col(text))}).drop(of, copies, below).where(F.col(new_times) > 0)
