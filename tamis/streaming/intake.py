"""Idempotent intake over a stream: the first request of each key within the watermark is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import is_blank


def first_requests(requests: DataFrame, delay: str = "1 day") -> DataFrame:
    """Requests (request_id, idempotency_key, arrival) without repeats; a blank key never repeats.

    State is dropped once the watermark has passed it.
    """
    key = F.when(is_blank("idempotency_key"), F.concat(F.lit("request:"), "request_id")).otherwise(F.concat(F.lit("key:"), "idempotency_key"))
    return requests.withColumn("_key", key).withWatermark("arrival", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
