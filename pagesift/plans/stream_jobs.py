"""Streaming jobs (O65, O71) driven to completion with trigger availableNow.

Inputs are written as files first (the stream source), outputs go to file sinks
under the shared checkpoint folder and are read back as tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import render as R
from ..sources.render import net_log
from ..streaming.correlate_stream import latest_revisions, stream_correlate_responses
from ..streaming.pipeline_stream import stream_pipeline
from . import listing_sql as L
from .netlog_jobs import NET_SQL
from .pipeline import DEFAULT_MAX_PLACES as MP, DEFAULT_MAX_REVIEWS as MR
from .registry import query
from .sqlkit import sid


STREAM_SQL = f"""WITH {L.review_ctes(MR, MP)},
ph AS (
  SELECT pid, 'https://lh3.googleusercontent.com/p/' || CAST(k AS VARCHAR) || '-hero=w800-h600' AS image_url FROM pd
  UNION ALL SELECT pid, 'https://lh3.googleusercontent.com/p/' || CAST(k AS VARCHAR) || '-gallery=w1024-h768' FROM pd WHERE k % 4 = 0
  UNION ALL SELECT pid, 'https://lh3.googleusercontent.com/rp/' || CAST(o_orderkey AS VARCHAR) || '.jpg'
  FROM pd JOIN orders ON o_custkey = pd.k WHERE o_orderkey % 3 = 0 AND o_orderkey % 10 IN (0, 2)),
rvs AS (SELECT {L.REVIEW_COLS} FROM rv)
SELECT 'place' AS kind, pid AS id, region AS parent, keyword || '|' || name || '|' || address AS detail FROM pd
UNION ALL SELECT 'review', id, place_id, published_at || '|' || text || '|' || raw_label FROM rvs
UNION ALL SELECT 'review-photo', {sid('pid', 'image_url')}, pid, image_url FROM ph
UNION ALL SELECT 'search', keyword, region, CAST(max(rank) AS VARCHAR) || '|true' FROM sr GROUP BY keyword, region
UNION ALL SELECT 'done', pid, region, '' FROM pd"""


@query("stream_places", oracle=STREAM_SQL)
def q_stream_places(spark, sf):
    """All four tables after two calls: the first sees one page of every search of several, the second the others."""
    pages = R.stored(spark, sf, "search_pages")
    counts = pages.groupBy("keyword", "region").agg(F.count(F.lit(1)).cast("int").alias("page_count"), F.min("page_no").alias("_first"))
    marked = pages.join(counts, ["keyword", "region"]).withColumn("_call", F.when((F.col("page_count") > 1) & (F.col("page_no") == F.col("_first")), 0).otherwise(1))
    # the number of pages is known with the last of them
    marked = marked.withColumn("page_count", F.when(F.col("_call") == 1, F.col("page_count"))).select(*pages.columns, "page_count", "_call")
    src, out, ckpt = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-ckpt"))
    schema = marked.drop("_call").schema
    for call in (0, 1):
        marked.where(F.col("_call") == call).drop("_call").repartition(2, "page_id").write.mode("append").parquet(src)
        paths = stream_pipeline(spark, src, schema, R.stored(spark, sf, "place_pages"), R.segments(spark, sf), out, ckpt, MP, MR, files_per_trigger=1)
    places, reviews, photos, progress = (spark.read.parquet(paths[n]) for n in ("places", "reviews", "photos", "progress"))

    def rows(df, kind, key, parent, *detail):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(parent).alias("parent"), F.concat_ws("|", *detail).alias("detail"))

    searches = progress.where("place_id IS NULL")
    return (rows(places, "place", "id", "region", "search_keyword", "name", "address")
            .unionByName(rows(reviews, "review", "id", "place_id", "published_at", "text", "raw_label"))
            .unionByName(rows(photos, "review-photo", "id", "place_id", "image_url"))
            .unionByName(rows(searches, "search", "keyword", "region", F.col("next_place_index").cast("string"), F.col("completed").cast("string")))
            .unionByName(rows(progress.where("place_id IS NOT NULL"), "done", "place_id", "region")))


NET_OUT = ("request_id", "url", "status", "mime_type", "body", "base64_encoded", "timestamp", "seq")


def _drained(spark, log, file_no, bound=None):
    """The correlated rows of a log that arrives in four parts, a call and a batch each; as many tasks write and read a part as the log has splits."""
    src, out, ckpt = (scratch_path(spark, n) for n in ("net-in", "net-out", "net-ckpt"))
    parted = log.withColumn("_file", file_no)
    for i in range(4):
        parted.where(F.col("_file") == i).drop("_file").write.mode("append").parquet(src)
        stream = spark.readStream.schema(log.schema).parquet(src)
        (stream_correlate_responses(stream, bound).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)


@query("stream_correlate", oracle=NET_SQL)
def q_stream_correlate(spark, sf):
    """No bound: every request's events are spread over all four parts without any order."""
    return latest_revisions(_drained(spark, net_log(spark, sf), F.pmod(F.xxhash64("seq"), F.lit(4)))).select(*NET_OUT)


@query("stream_correlate_bounded", oracle=NET_SQL)
def q_stream_correlate_bounded(spark, sf):
    """With a bound: events arrive up to a quarter of the log's span late, so that requests go over borders of parts and out
    of order; a last heartbeat moves the watermark over the end."""
    log = net_log(spark, sf)
    us, kind = F.unix_micros(F.col("ts").cast("timestamp")), log.schema["ts"].dataType
    first, last = log.agg(F.min(us), F.max(us)).first()
    span = max(1, last - first + 1)
    late = F.pmod(F.xxhash64("seq", F.lit(1)), F.lit(span // 4 + 1))
    file_no = F.least(F.floor((us - F.lit(first) + late) * 4 / F.lit(span)), F.lit(3))
    beat = log.limit(1).select(*[(F.timestamp_micros(F.lit(last + 2 * span)).cast(kind) if c == "ts" else F.lit(None).cast(t.dataType)).alias(c) for c, t in zip(log.columns, log.schema)])
    both = log.unionByName(beat.withColumn("event_type", F.lit("heartbeat")).withColumn("request_id", F.lit("heartbeat")))
    return _drained(spark, both, F.when(F.col("event_type") == "heartbeat", 3).otherwise(file_no), f"{span // 2 // 1_000_000 + 1} seconds").select(*NET_OUT)
