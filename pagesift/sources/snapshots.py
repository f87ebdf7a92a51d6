"""Page snapshot input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import url_key

PAGE_SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("captured_at", T.TimestampType()),
])


def read_page_snapshots(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Explicit-schema parquet read; ``kind`` filter is pushed to the scan
    (and prunes directories when the table is partitioned by kind)."""
    df = spark.read.schema(PAGE_SNAPSHOT_SCHEMA).parquet(path)
    return df.filter(F.col("kind") == kind) if kind else df


def with_url_key(df: DataFrame, url_col: str = "url", out: str = "url_key") -> DataFrame:
    return df.withColumn(out, url_key(url_col))


def latest_per_url(df: DataFrame, key_col: str = "url_key") -> DataFrame:
    """Keep the newest capture per comparable URL (ties: larger page_id).

    Run this on *extracted* (narrow) rows, never on raw HTML: the winner per key
    comes from a partial (map-side) aggregate over (key, captured_at, page_id),
    so a URL captured millions of times costs one small row per partition, and
    the semi-join back is on the unique page_id.
    """
    winners = (
        df.groupBy(key_col)
        .agg(F.max(F.struct("captured_at", "page_id"))["page_id"].alias("page_id"))
        .select("page_id")
    )
    return df.join(winners, "page_id", "left_semi")
