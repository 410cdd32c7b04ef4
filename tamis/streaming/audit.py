"""Appending to hash-chained logs as a stream: each micro-batch goes on from the heads of the logs, so no append reads a log again.

A micro-batch's new events of one log are ordered (by time and id, unless other columns are named), numbered on from the head, and linked, in blocks of
bounded size (`operators/audit.py`).  A head is two values, the last number and hash of a log; they are a table beside the stream's checkpoint, one for each batch.
A restart goes on from the same heads; a batch that is run again gives the same links and replaces its own rows.  Logs are linked
beside one another, one log's events one after the other, as the chain demands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.operators import audit
from tamis.operators.storage import drop, scratch, stored

LINKED = "log string, sequence long, event_id string, previous_hash string, hash string"
HEADS = "log string, sequence long, hash string"


def numberless(events: DataFrame, key: str = "scheme_code", by: tuple[str, ...] = ("occurred_at", "event_id")) -> DataFrame:
    """log, event_id, the columns of the order (by_, nulls last) and the canonical text of events that get their numbers when they are linked.  Null logs are the log '-'."""
    log = F.coalesce(F.col(key).cast("string"), F.lit("-")) if key in events.columns else F.lit("-")
    order = [x for k, c in enumerate(by) for x in (F.col(c).isNull().alias(f"by_{k:02d}_null"), F.col(c).alias(f"by_{k:02d}"))]
    return events.select(log.alias("log"), "event_id", *order, audit.canonical(F.lit(audit.MARK)).alias("_text"))


def _put(new: DataFrame, batch: int, path: str, heads: str) -> None:
    """Links the new events of a micro-batch, as a part of the table at path, and writes the heads that they leave."""
    spark = new.sparkSession
    before = spark.read.schema(HEADS).parquet(f"{heads}/batch={batch - 1}") if batch else spark.createDataFrame([], HEADS)
    done = scratch(spark, "appended")
    # sources may not give a micro-batch twice
    made = audit.chained(stored(new), "log", tuple(c for c in new.columns if c.startswith("by_")), before, number=True, done=done)
    made.select(*[x.split()[0] for x in LINKED.split(", ")]).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    ends = before.unionByName(made.select("log", "sequence", "hash")).groupBy("log").agg(F.max("sequence").alias("sequence"), F.max_by("hash", "sequence").alias("hash"))
    ends.write.mode("overwrite").parquet(f"{heads}/batch={batch}")
    drop(spark, done)
    # only the last batch can be run again
    drop(spark, f"{heads}/batch={batch - 2}")


def append_to(events: DataFrame, path: str, checkpoint: str, **how: object) -> DataFrame:
    """Links all of a stream's events that are there, as a table at path, and returns the table; called again, it goes on from where it ended.

    Events (event_id, occurred_at and the fields of an event) need no sequence of their own: they get the next of their log.
    """
    rows, spark = numberless(events, **how), events.sparkSession
    query = rows.writeStream.foreachBatch(lambda new, batch: _put(new, batch, path, f"{checkpoint}/heads")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return spark.read.schema(f"{LINKED}, batch long").parquet(path).drop("batch")
