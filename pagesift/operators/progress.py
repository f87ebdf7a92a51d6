"""Progress ledger: skip completed work, reconcile a ledger with a job, advance it
(O60-O62).  The ledger is a table, one row per (region, keyword) plus one row per
completed place id, so completion survives keyword reordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER_SCHEMA = T.StructType([
    T.StructField("region", T.StringType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("keyword_index", T.IntegerType()),
    T.StructField("next_place_index", T.IntegerType()),
    T.StructField("completed", T.BooleanType()),
    T.StructField("place_id", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def normalize_ledger(ledger: DataFrame) -> DataFrame:
    """Indexes truncated toward zero and clamped at >= 0; completed ids unique."""
    kw = ledger.filter(F.col("place_id").isNull()).withColumns({
        "next_place_index": F.greatest(F.lit(0), F.coalesce(F.col("next_place_index").cast("int"), F.lit(0))),
        "keyword_index": F.when(F.col("keyword_index").isNotNull(), F.greatest(F.lit(0), F.col("keyword_index").cast("int")))})
    ids = ledger.filter(F.col("place_id").isNotNull()).dropDuplicates(["region", "place_id"])
    return kw.unionByName(ids)


def keyword_rows(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("place_id").isNull())


def completed_ids(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("place_id").isNotNull()).select("region", "place_id").distinct()


def skip_completed_results(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """O60 (results): drop completed keywords; per keyword keep 0-based index >=
    next_place_index (default 0).  Ledger rows are keyword-sized; AQE broadcasts."""
    kw = keyword_rows(ledger).select("region", "keyword", "next_place_index", "completed")
    j = results.join(kw, ["region", "keyword"], "left")
    keep = ~F.coalesce(F.col("completed"), F.lit(False)) & (
        (F.col("rank") - 1) >= F.coalesce(F.col("next_place_index"), F.lit(0)))
    return j.filter(keep).drop("next_place_index", "completed")


def skip_completed_places(place_rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """O60 (places): places whose id is already completed contribute nothing."""
    done = completed_ids(ledger).withColumnRenamed("place_id", "id")
    return place_rows.join(done, ["region", "id"], "left_anti")


def reconcile_progress(job_keywords: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per region, the job's keyword set must equal the stored set (order
    ignored), else ValueError.  Output per (region, keyword): job keyword_index,
    completed, next_place_index (kept) and the region's next_keyword_index (first
    job keyword not completed, else the keyword count)."""
    kw = keyword_rows(ledger).select("region", "keyword", "completed", "next_place_index")
    job = job_keywords.select("region", "keyword", "keyword_index")
    both = job.join(kw, ["region", "keyword"], "full_outer")
    mismatch = both.filter(F.col("keyword_index").isNull() | F.col("completed").isNull()).limit(1).count()
    if mismatch:
        raise ValueError("Checkpoint does not match the current scrape job.")
    j = job.join(kw, ["region", "keyword"])
    nxt = (j.groupBy("region").agg(
        F.coalesce(F.min(F.when(~F.col("completed"), F.col("keyword_index"))), F.count(F.lit(1)).cast("int"))
        .alias("next_keyword_index")))
    return j.join(nxt, "region").select("region", "keyword", "keyword_index", "completed", "next_place_index",
                                        F.col("next_keyword_index").cast("int").alias("next_keyword_index"))


def skip_completed_searches(search_pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Search pages of keywords that the ledger has not completed, so that completed ones are neither parsed nor
    counted.  The other side is the ledger's completed (region, keyword) pairs."""
    done = keyword_rows(ledger).filter("completed").select("region", "keyword").distinct()
    return search_pages.join(done, ["region", "keyword"], "left_anti")


def advance_progress(ledger: DataFrame, processed: DataFrame, batch_results: DataFrame, batch_places: DataFrame,
                     now_col: F.Column | None = None) -> DataFrame:
    """Upsert after a batch.  ``processed`` (region, keyword, keyword_index) are the searches that the batch
    worked through to their end: exactly these become completed, also those without any result or with none left
    beyond next_place_index.  next_place_index = max(stored, max processed 0-based index + 1); ids of places processed
    (duplicates advance the index but add no id) are unioned."""
    now = now_col if now_col is not None else F.current_timestamp()
    kw = keyword_rows(ledger).select("region", "keyword", "keyword_index", "next_place_index", "completed")
    seen = processed.groupBy("region", "keyword").agg(F.min("keyword_index").cast("int").alias("_pi"), F.lit(True).alias("_seen"))
    batch = batch_results.groupBy("region", "keyword").agg(
        F.max("rank").cast("int").alias("_n"), F.min("keyword_index").cast("int").alias("_ki"))
    merged = kw.join(seen, ["region", "keyword"], "full_outer").join(batch, ["region", "keyword"], "full_outer").select(
        "region", "keyword",
        F.coalesce("keyword_index", "_pi", "_ki").alias("keyword_index"),
        F.greatest(F.coalesce("next_place_index", F.lit(0)), F.coalesce("_n", F.lit(0))).alias("next_place_index"),
        (F.coalesce("completed", F.lit(False)) | F.coalesce("_seen", F.lit(False))).alias("completed"),
        F.lit(None).cast("string").alias("place_id"), now.alias("updated_at"),
    )
    ids = completed_ids(ledger).unionByName(batch_places.select("region", F.col("id").alias("place_id"))).distinct()
    ids = ids.select("region", F.lit(None).cast("string").alias("keyword"), F.lit(None).cast("int").alias("keyword_index"),
                     F.lit(None).cast("int").alias("next_place_index"), F.lit(None).cast("boolean").alias("completed"),
                     "place_id", now.alias("updated_at"))
    return merged.unionByName(ids)


SUMMARY_NAMES = ("search_result_count", "place_count", "review_count", "photo_count")


def summary_of_counts(spark: SparkSession, *counts: int) -> DataFrame:
    """O63 from counts taken while the four tables were written; reads none of them."""
    return spark.range(1).select(*[F.lit(int(n)).cast("bigint").alias(name) for n, name in zip(counts, SUMMARY_NAMES)])


def run_summary(search_results: DataFrame, place_rows: DataFrame, reviews: DataFrame, photos: DataFrame) -> DataFrame:
    """The four counts in one row (union of one-row aggregates, then a
    conditional sum — no cross join)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("t"), "n")
             for i, df in enumerate((search_results, place_rows, reviews, photos))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return u.agg(*[F.sum(F.when(F.col("t") == i, F.col("n"))).cast("bigint").alias(n) for i, n in enumerate(SUMMARY_NAMES)])
