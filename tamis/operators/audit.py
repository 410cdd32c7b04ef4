"""Hash-chained audit logs.

Building a chain is a fold over one log, in order: blocks of bounded size go one after the other, and hand on the log's head; logs are
folded beside one another.  Verifying is local: each event is compared
with its own content and with the hash its predecessor carries, so it is one join and needs no order of processing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.hashing import GENESIS
from tamis.functions.text import iso_seconds
from tamis.operators.storage import drop, keep, scratch

FIELDS = ("actor", "actor_role", "action", "entity_type", "entity_id", "payload")
#: Events of one block of a fold, about.
BLOCK = 500_000
#: Stands for the number of an event that gets it when it is linked.
MARK = "\0"


def canonical(sequence: Column | None = None) -> Column:
    """event/1|sequence|time|actor|role|action|type|id|payload, nulls empty; the sequence is the column of that name unless another is given."""
    parts = [F.lit("event/1"), F.col("sequence").cast("string") if sequence is None else sequence, iso_seconds("occurred_at"), *[F.coalesce(F.col(c), F.lit("")) for c in FIELDS]]
    return F.concat_ws("|", *parts)


def _folded(batches: Iterator[pa.RecordBatch], key: str, number: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by log, its head before its events, with the hash of the event before and their own; number: events are numbered on from the head, too."""
    log, sequence, previous, at = object(), 0, GENESIS, 0
    for batch in batches:
        numbers, before, hashes, events = [], [], [], []
        for k, head, text in zip(*[batch.column(c).to_pylist() for c in (key, "_head", "_text")], strict=True):
            if k != log:
                log, sequence, previous = k, 0, GENESIS
            events.append(head is None)
            if head is not None:
                sequence, previous = head["sequence"], head["hash"]
                continue
            if number:
                sequence += 1
                text = text.replace(MARK, str(sequence), 1)
            before.append(previous)
            previous = hashlib.sha256(f"{previous}|{text}".encode()).hexdigest()
            numbers.append(sequence)
            hashes.append(previous)
        rows = batch.drop_columns(["_head", "_text"])
        rows = rows if all(events) else rows.filter(pa.array(events))
        made = ([("sequence", pa.array(numbers, pa.int64()))] if number else []) + [("previous_hash", pa.array(before, pa.string())), ("hash", pa.array(hashes, pa.string())), ("_at", pa.array(range(at, at + len(hashes)), pa.int64()))]
        at += len(hashes)
        yield pa.RecordBatch.from_arrays([*rows.columns, *[x for _, x in made]], names=[*rows.schema.names, *[n for n, _ in made]])


def chained(events: DataFrame, key: str, by: tuple[str, ...], heads: DataFrame | None = None, number: bool = False, block: int | None = None, done: str | None = None) -> DataFrame:
    """events, with the text to hash in _text, linked in the order of `by` as a table: previous_hash, hash, and with number the sequence, whose place in the text is MARK.

    Events are dealt by ranges of log and order over blocks of about as many events. A log's first blocks go on from its head in
    heads (key, sequence, hash) if it has one, all logs beside one another; then its second, from the heads that these leave, and so on:
    no task holds more than some blocks, and only a log that is longer than a block needs more than two rounds.  done: a new folder for the table.
    """
    spark, path = events.sparkSession, scratch(events.sparkSession, "blocks")
    done = done or scratch(spark, "chain")
    blocks = max(1, math.ceil(events.count() / (block or BLOCK)))
    events.repartitionByRange(blocks, key, *by).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(path)
    dealt = spark.read.schema(T.StructType([*events.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(path)
    places = keep(dealt.select(key, "_part").distinct().withColumn("_round", F.row_number().over(Window.partitionBy(key).orderBy("_part")) - 1))
    # a log's further blocks: at most one log for each edge between two blocks
    further = F.broadcast(places.where("_round > 0").select(F.col(key).alias("_log"), F.col("_part").alias("_of"), "_round"))
    parts: dict[int, list[int]] = {0: []}
    for r in places.select("_round", "_part").distinct().collect():
        parts.setdefault(r["_round"], []).append(r["_part"])
    fields = [f for f in events.schema.fields if f.name != "_text"]
    fields += ([T.StructField("sequence", T.LongType())] if number else []) + [T.StructField(c, T.StringType()) for c in ("previous_hash", "hash")] + [T.StructField("_at", T.LongType())]
    folded = T.StructType([f for f in fields if f.name != "_part"])
    head = F.struct(F.col("sequence").cast("long").alias("sequence"), "hash")
    for k in sorted(parts):
        some = dealt.where(F.col("_part").isin(parts[k]))
        if k == 0:
            rows = some.join(further, some[key].eqNullSafe(F.col("_log")) & (F.col("_part") == F.col("_of")), "left_anti")
            before = None if heads is None else heads.withColumnRenamed(key, "_log").join(places.where("_round = 0"), F.col("_log").eqNullSafe(F.col(key))).select(key, "_part", head.alias("_head"))
        else:
            now = further.where(F.col("_round") == k)
            rows = some.join(now, some[key].eqNullSafe(F.col("_log")) & (F.col("_part") == F.col("_of")), "left_semi")
            last = spark.read.schema(folded).parquet(f"{done}/_round={k - 1}")
            last = last.join(now, last[key].eqNullSafe(F.col("_log"))).groupBy(key, F.col("_of").alias("_part")).agg(F.max_by(head, "_at").alias("_head"))
            before = last.select(key, "_part", "_head")
        rows = rows.withColumn("_head", F.lit(None).cast("struct<sequence:bigint,hash:string>"))
        rows = rows if before is None else rows.unionByName(before, allowMissingColumns=True)
        rows = rows.repartition(max(1, len(parts[k])), "_part").sortWithinPartitions("_part", key, F.col("_head").isNull(), *by).drop("_part")
        rows.mapInArrow(lambda b: _folded(b, key, number), folded).write.parquet(f"{done}/_round={k}")
    drop(spark, path)
    return spark.read.schema(T.StructType([*folded.fields, T.StructField("_round", T.IntegerType())])).parquet(done).drop("_at", "_round")


def link(events: DataFrame, key: str = "scheme_code", block: int | None = None) -> DataFrame:
    """events (sequence, event_id, ...) of each log with previous_hash and hash, as a table."""
    events = events if key in events.columns else events.withColumn(key, F.lit("-"))
    return chained(events.withColumn("_text", canonical()), key, ("sequence",), block=block)


def append(head: tuple[int, str], events: list[dict]) -> list[dict]:
    """New events linked to a head (sequence, hash), for a single writer."""
    sequence, previous = head
    out = []
    for e in events:
        sequence += 1
        text = "|".join(["event/1", str(sequence), e["occurred_at"].strftime("%Y-%m-%dT%H:%M:%SZ"), *[e.get(c) or "" for c in FIELDS]])
        digest = hashlib.sha256(f"{previous}|{text}".encode()).hexdigest()
        out.append({**e, "sequence": sequence, "previous_hash": previous, "hash": digest})
        previous = digest
    return out


def checked(chain: DataFrame) -> DataFrame:
    """sequence and the first fault of each event: gap, predecessor or content; null if sound."""
    before = chain.select((F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("expected"), F.lit(True).alias("has_previous"))
    rows = chain.join(before, "sequence", "left")
    first = F.col("sequence") == 1
    expected = F.when(first, GENESIS).otherwise(F.col("expected"))
    content = F.sha2(F.concat_ws("|", "previous_hash", canonical()), 256)
    fault = F.when(~first & F.col("has_previous").isNull(), "gap").when(~expected.eqNullSafe(F.col("previous_hash")), "predecessor").when(content != F.col("hash"), "content")
    return rows.select("sequence", "event_id", fault.alias("fault"))


def verify(chain: DataFrame) -> DataFrame:
    """One row: intact, events_checked (before the first fault), fault_at, fault, and the head."""
    first = checked(chain).where("fault is not null").agg(F.min_by(F.struct("sequence", "event_id", "fault"), "sequence").alias("f"))
    total = chain.agg(F.count("*").alias("n"), F.max_by("hash", "sequence").alias("head"))
    ahead = F.coalesce(F.col("f.sequence") - 1, F.col("n"))
    return total.crossJoin(first).select(F.col("f").isNull().alias("intact"), ahead.cast("long").alias("events_checked"), F.col("f.sequence").alias("fault_at"), F.col("f.event_id").alias("event_id"), F.col("f.fault").alias("fault"), F.coalesce("head", F.lit(GENESIS)).alias("head"))


def head(chain: DataFrame) -> DataFrame:
    return chain.agg(F.count("*").alias("events"), F.coalesce(F.max_by("hash", "sequence"), F.lit(GENESIS)).alias("head"))
