"""Captured network events: finish <-> latest earlier receive (O70), an as-of join.

Spark has no as-of join; this one is a composition of aggregates and windows
that never puts one request id's whole history into a single task: events are
split into (request_id, time bucket) groups; each finish takes the latest earlier
receive inside its bucket, else the last receive of the nearest earlier bucket
(a window over one row per bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_trim

RECEIVED = "responseReceived"
FINISHED = "loadingFinished"


def correlate_responses(events: DataFrame, predicate=None, bucket_seconds: int = 3600) -> DataFrame:
    """One row per finish that has an earlier receive for the same request id and
    whose body fetch did not fail.  A second finish emits again.  Body is
    whitespace-collapsed (blank -> null).  ``predicate`` is a Column filter over
    the output record (the reference's response filter callback)."""
    ev = events.withColumn("request_id", safe_trim("request_id")).filter(F.col("request_id").isNotNull())
    ev = ev.withColumn("_b", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(bucket_seconds * 1_000_000)))
    recv_struct = F.struct(F.coalesce(safe_trim("url"), F.lit("")).alias("url"), "status",
                           safe_trim("mime_type").alias("mime_type"))
    is_recv = F.col("event_type") == RECEIVED
    is_fin = F.col("event_type") == FINISHED
    ev = ev.filter(is_recv | is_fin)
    # one partial aggregate per (request, bucket), without bodies and skew-safe: the last receive, and whether a finish asks
    buckets = ev.groupBy("request_id", "_b").agg(
        F.max_by(recv_struct, F.when(is_recv, F.struct("ts", "seq"))).alias("_last"), F.max(is_fin).alias("_asked"))
    wb = Window.partitionBy("request_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (buckets.select("request_id", "_b", "_asked", F.last("_last", ignorenulls=True).over(wb).alias("_carry"))
             .filter(F.col("_asked") & F.col("_carry").isNotNull()).drop("_asked"))
    # within (request, bucket): running last receive strictly before each row
    rows = ev.withColumn("_r", F.when(is_recv, recv_struct))
    w = Window.partitionBy("request_id", "_b").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    fin = (rows.withColumn("_prev", F.last("_r", ignorenulls=True).over(w))
           .filter(is_fin))
    out = fin.join(carry, ["request_id", "_b"], "left").withColumn("_m", F.coalesce("_prev", "_carry"))
    out = out.filter(F.col("_m").isNotNull() & ~F.coalesce(F.col("body_failed"), F.lit(False)))
    res = out.select(
        "request_id", F.col("_m.url").alias("url"), F.col("_m.status").alias("status"),
        F.col("_m.mime_type").alias("mime_type"), safe_trim("body").alias("body"),
        F.coalesce(F.col("base64"), F.lit(False)).alias("base64_encoded"),
        F.col("ts").alias("timestamp"), "seq",
    )
    return res.filter(predicate) if predicate is not None else res
