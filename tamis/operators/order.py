"""Places in a total order over many partitions: each partition is sorted and counted by itself, and only the counts are added up in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.storage import keep


def numbered(rows: DataFrame, group: str, by: str, name: str = "place", ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with their place, from 1, within their group in the order of `by`; ties are columns that order rows of one `by`."""
    dealt = keep(rows.repartitionByRange(group, by).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(by, *ties))
    same = dealt[group].eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of"))
    return dealt.withColumn("_within", within).join(counts, same).withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_part", "_within", "_group", "_of", "_before")


def kth(rows: DataFrame, wanted: dict[str, int], kind: str = "kind", at: str = "pick_order", width: int = 1 << 12) -> dict[str, int]:
    """For each kind the wanted[kind]-th smallest `at` (positive numbers, different within a kind); kinds with fewer rows are left out.

    Counts of ranges of width numbers show the range that holds it; only rows of those ranges are ordered.
    """
    spark = rows.sparkSession
    if not wanted:
        return {}
    need = F.broadcast(spark.createDataFrame(list(wanted.items()), "_kind string, _need long"))
    ranges = rows.groupBy(kind, F.floor(F.col(at) / width).alias("_range")).agg(F.count("*").alias("_n")).join(need, F.col(kind) == F.col("_kind"))
    upto = F.sum("_n").over(Window.partitionBy(kind).orderBy("_range"))
    edge = ranges.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
    edge = edge.select(F.col(kind).alias("_kind"), F.col("_range").alias("_edge"), (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_left"))
    inside = rows.join(F.broadcast(edge), (F.col(kind) == F.col("_kind")) & (F.floor(F.col(at) / width) == F.col("_edge")))
    found = inside.withColumn("_k", F.row_number().over(Window.partitionBy(kind).orderBy(at))).where(F.col("_k") == F.col("_left"))
    return {r[0]: r[1] for r in found.select(kind, at).collect()}


def ranks(rows: DataFrame, kind: str = "kind", at: str = "pick_order", width: int = 1 << 12) -> DataFrame:
    """rows with place: how many of the same kind have the same or a smaller `at`."""
    rows = rows.withColumn("_range", F.floor(F.col(at) / width))
    before = Window.partitionBy(kind).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(kind, "_range").agg(F.count("*").alias("_n")).select(kind, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(kind, "_range").orderBy(at))
    return rows.withColumn("_within", within).join(counts, [kind, "_range"]).withColumn("place", (F.col("_before") + F.col("_within")).cast("long")).drop("_range", "_within", "_before")


def order_violations(rows: DataFrame, at: str, by: str) -> DataFrame:
    """at, by, previous, fault ('repeat' or 'inversion') of rows whose value does not come after that of the row before.

    Partitions of a range of `at` are looked at by themselves; of each, only its last value meets the first of the next.
    """
    dealt = keep(rows.select(F.col(at).alias("at"), F.col(by).alias("by")).repartitionByRange("at").withColumn("_part", F.spark_partition_id()))
    last = dealt.groupBy("_part").agg(F.max_by("by", "at").alias("_last"))
    # one row for each partition
    border = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_border"))
    previous = F.lag("by").over(Window.partitionBy("_part").orderBy("at"))
    seen = dealt.withColumn("previous", previous).join(F.broadcast(border), "_part").withColumn("previous", F.coalesce("previous", "_border"))
    fault = F.when(F.col("by") == F.col("previous"), "repeat").when(F.col("by") < F.col("previous"), "inversion")
    return seen.select(F.col("at").alias(at), F.col("by").alias(by), "previous", fault.alias("fault")).where("fault is not null")
