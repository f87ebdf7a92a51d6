"""The listing pipeline over arriving search-page snapshot files.

A search's pages may arrive in any batches and calls, and ranks, the limit and first-wins hold over the whole search,
so its places can only be decided when it has ended.  A search is

* open while fewer distinct pages are stored than the largest ``page_count`` that any of them states (none: open);
* ended when as many are there: the call that sees it works it through;
* done when the ledger has completed it, for the number of pages recorded with the run;
* open again when a further page of it arrives; it is then worked through anew, and known places are left out.

Each micro-batch extracts its links, once, and appends them as narrow rows under ``batch_id=<n>`` (a replayed batch
overwrites its own folder).  After the drain the place stage runs on the ended searches, and places, reviews, photos,
the searches' page numbers and the ledger are appended under ``run_id=<n>``.  The ledger is written last and commits
the run; a run that failed before it is repeated with the same id and overwrites its output.  Only place pages that
the ended searches may link to are parsed.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import progress as G
from ..operators import search as S
from ..plans.pipeline import extract_place_pages, place_tables, stage, wanted_pages

TABLES = ("places", "reviews", "photos", "progress")
PAGE_COLS = ("page_id", "url", "keyword", "region", "page_no", "captured_at", "page_count")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.option("mergeSchema", True).parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def current_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The ledger from its appended parts, and the next run id: of every keyword the newest row; every place id."""
    parts = _stored(spark, path)
    if parts is None:
        return G.empty_ledger(spark), 0
    last = parts.agg(F.max("run_id")).first()[0]
    cols = [c for c in G.LEDGER_SCHEMA.fieldNames() if c not in ("region", "keyword")]
    kw = (G.keyword_rows(parts).groupBy("region", "keyword").agg(F.max_by(F.struct(*cols), "run_id").alias("_r"))
          .select("region", "keyword", "_r.*"))
    ids = parts.filter(F.col("place_id").isNotNull()).drop("run_id").dropDuplicates(["region", "place_id"])
    return kw.unionByName(ids).select(*G.LEDGER_SCHEMA.fieldNames()), int(last) + 1


def stream_pipeline(spark: SparkSession, snapshot_dir: str, snapshot_schema, place_pages: DataFrame,
                    keywords: DataFrame, out_dir: str, checkpoint_location: str, max_places: int = 25,
                    max_reviews: int = 20, files_per_trigger: int = 1, settled: bool = False):
    """Drain the stream (trigger availableNow), then work through the searches that ended.  The snapshots may have a
    ``page_count`` column: the number of pages of their search, on one of its pages at least.  Without it no search ends, unless ``settled`` says that every search stored is complete."""
    out = out_dir.rstrip("/")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if "page_count" not in batch.columns:
            batch = batch.withColumn("page_count", F.lit(None).cast("int"))
        batch.select(*PAGE_COLS).write.mode("overwrite").parquet(f"{out}/search_pages/batch_id={batch_id}")
        S.listing_anchors(batch).write.mode("overwrite").parquet(f"{out}/links/batch_id={batch_id}")

    src = (spark.readStream.schema(snapshot_schema).option("maxFilesPerTrigger", files_per_trigger)
           .parquet(snapshot_dir))
    q = (src.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    finish_searches(spark, place_pages, keywords, out, max_places, max_reviews, settled)
    return {name: os.path.join(out, name) for name in TABLES}


def ended_searches(pages: DataFrame, done: DataFrame | None, settled: bool = False) -> DataFrame:
    """(region, keyword, pages) of the stored searches that have ended and were not worked through with as many pages.
    Captures of one page count once; a page without a number is told apart by its url, else by its id."""
    page = F.coalesce(F.col("page_no").cast("string"), F.concat(F.lit("u"), F.col("url")), F.concat(F.lit("i"), F.col("page_id")))
    have = pages.groupBy("region", "keyword").agg(F.count_distinct(page).cast("int").alias("pages"), F.max("page_count").alias("page_count"))
    ended = have if settled else have.where(F.col("pages") >= F.col("page_count"))
    ended = ended.select("region", "keyword", "pages")
    if done is None:
        return ended
    last = done.groupBy("region", "keyword").agg(F.max("pages").alias("_done"))
    return ended.join(last, ["region", "keyword"], "left").where(F.col("pages") > F.coalesce("_done", F.lit(0))).drop("_done")


def finish_searches(spark: SparkSession, place_pages: DataFrame, keywords: DataFrame, out: str, max_places: int, max_reviews: int, settled: bool = False) -> None:
    """The place stage for stored searches that have ended and are not done; appends one run, or nothing."""
    pages = _stored(spark, f"{out}/search_pages")
    if pages is None:
        return
    for name, kind in (("url", "string"), ("page_count", "int")):  # stored before pages kept them
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    ledger, run = current_ledger(spark, f"{out}/progress")
    done = _stored(spark, f"{out}/searches")
    if done is not None:
        done = done.where(F.col("run_id") < run)  # what a failed run left does not count
    ended = stage(spark, ended_searches(pages, done, settled), "stream_ended")
    if ended.isEmpty():
        return
    keys = ["region", "keyword"]
    open_pages = pages.join(ended.select(*keys), keys, "left_semi")
    links = spark.read.parquet(f"{out}/links").join(ended.select(*keys), keys, "left_semi")
    results = stage(spark, S.results_from_links(links, open_pages, max_places, keywords), "stream_results")
    # a search that is open again starts anew; its known places are left out by their ids
    pending = G.skip_completed_results(results, ledger.join(ended.select(*keys), keys, "left_anti"))
    extract = stage(spark, extract_place_pages(wanted_pages(place_pages, pending), max_reviews), "stream_extract")
    tables, _ = place_tables(spark, pending, extract, ledger, max_reviews)
    for name, df in zip(("places", "reviews", "photos"), tables):
        df.write.mode("overwrite").parquet(f"{out}/{name}/run_id={run}")
    ended.write.mode("overwrite").parquet(f"{out}/searches/run_id={run}")
    processed = ended.join(keywords.select("keyword", "keyword_index"), "keyword", "left").drop("pages")
    changed = G.advance_progress(ledger, processed, pending, tables[0])
    # of the ledger only rows of this run's searches and places that it did not know
    known = ledger.where(F.col("place_id").isNotNull()).select("region", "place_id")
    news = changed.where(F.col("place_id").isNull()).join(ended.select(*keys), keys, "left_semi").unionByName(
        changed.where(F.col("place_id").isNotNull()).join(known, ["region", "place_id"], "left_anti"))
    news.select(*G.LEDGER_SCHEMA.fieldNames()).write.mode("overwrite").parquet(f"{out}/progress/run_id={run}")
