"""The batch listing pipeline (O64) and run-level jobs."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import photos as P
from ..operators import places as PL
from ..functions.urls import url_key
from ..operators import progress as G
from ..operators.bloom import keep_possible
from ..operators import reviews as RV
from ..operators import search as S
from ..session import scratch_path
from ..sources.snapshots import latest_per_url

DEFAULT_MAX_PLACES = 25
DEFAULT_MAX_REVIEWS = 20


@dataclass
class PipelineResult:
    search_results: DataFrame
    places: DataFrame
    reviews: DataFrame
    photos: DataFrame
    progress: DataFrame
    summary: DataFrame


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and read it
    back: cuts lineage (lost executors recompute from here, not from the HTML)
    and lets several outputs reuse it without recomputation."""
    return stage_counted(spark, df, name)[0]


def stage_counted(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``stage`` and the number of rows, counted while they are written."""
    path, seen = scratch_path(spark, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def wanted_pages(place_pages: DataFrame, pending: DataFrame) -> DataFrame:
    """Place pages that a pending result may link to: a Bloom filter of the results' URL keys, tested before any page
    is parsed.  Later joins are exact."""
    return keep_possible(place_pages, url_key("url"), pending.select(url_key("place_url").alias("url_key")), "url_key")


def extract_place_pages(place_pages: DataFrame, max_reviews: int | None = DEFAULT_MAX_REVIEWS) -> DataFrame:
    """One page-local pass over place pages: the field struct, the review blocks up to the limit and the photo
    candidates as written in the page.  The HTML is read once; these rows are parsed before they meet an exchange."""
    pages = place_pages.withColumn("_cut", H.cut("html"))
    arrays = pages.withColumns({"_blocks": RV.review_block_array(H.Pieces(F.col("_cut")), max_reviews), "_photos": P.place_photo_array("html")})
    return PL.place_page_fields(arrays, keep=("_blocks", "_photos"), cut_col="_cut")


def place_tables(spark: SparkSession, pending: DataFrame, extract: DataFrame, ledger: DataFrame, max_reviews: int,
                 staged: bool = True) -> tuple[tuple[DataFrame, DataFrame, DataFrame], tuple | None]:
    """Pending results and extracted pages -> (places, reviews, photos) without completed places, and their row counts
    if staged.  Blocks and photos are parsed where they lie; only parsed rows are joined with the places."""
    fields = latest_per_url(extract.drop("_blocks", "_photos"))
    place_rows = G.skip_completed_places(PL.dedup_places(PL.places(pending, fields)), ledger)
    n_places = None
    if staged:
        place_rows, n_places = stage_counted(spark, place_rows, "places")
    by_page = place_rows.withColumn("page_id", F.col("place_page_id"))

    def rows(array):
        return extract.select("page_id", "captured_at", F.explode(array).alias("_e")).select("page_id", "captured_at", "_e.*")

    blocks = RV.parse_review_blocks(RV.review_blocks_from_raw(rows("_blocks")))
    reviews = RV.review_records(blocks.withColumnRenamed("captured_at", "scraped_at"), by_page, max_reviews, join_key="page_id")
    photos = P.place_photo_records(P.photo_entries_from_raw(rows("_photos")), by_page, join_key="page_id")
    if not staged:
        return (place_rows, reviews, photos), None
    # independent outputs of the same staged places: submit both jobs at once
    with ThreadPoolExecutor(max_workers=2) as pool:
        done = [pool.submit(stage_counted, spark, df, name) for df, name in ((reviews, "reviews"), (photos, "photos"))]
        (reviews, n_reviews), (photos, n_photos) = (d.result() for d in done)
    return (place_rows, reviews, photos), (n_places, n_reviews, n_photos)


def processed_searches(search_pages: DataFrame, keywords: DataFrame) -> DataFrame:
    """(region, keyword, keyword_index) of the searches whose pages are given."""
    return search_pages.select("region", "keyword").distinct().join(keywords.select("keyword", "keyword_index"), "keyword", "left")


def run_pipeline(spark: SparkSession, keywords: DataFrame, search_pages: DataFrame, place_pages: DataFrame,
                 ledger: DataFrame | None = None, max_places: int = DEFAULT_MAX_PLACES,
                 max_reviews: int = DEFAULT_MAX_REVIEWS, dry_run: bool = False,
                 staged: bool = True) -> PipelineResult:
    """search -> skip completed -> places -> dedup -> {reviews + limit, photos}
    -> advanced ledger and run summary.

    Searches that the ledger has completed are left out before their pages are
    parsed, so they are not counted.  ``dry_run`` gives the same tables without rows,
    and the ledger as it is."""
    ledger = ledger if ledger is not None else G.empty_ledger(spark)
    if dry_run:
        search_pages, place_pages, staged = search_pages.limit(0), place_pages.limit(0), False
    open_pages = G.skip_completed_searches(search_pages, ledger)
    results, n_results = S.search_results(open_pages, max_places, keywords), None
    if staged:
        results, n_results = stage_counted(spark, results, "search_results")
    pending = G.skip_completed_results(results, ledger)
    extract = extract_place_pages(place_pages if dry_run else wanted_pages(place_pages, pending), max_reviews)
    if staged:
        extract = stage(spark, extract, "place_extract")
    (place_rows, reviews, photos), counts = place_tables(spark, pending, extract, ledger, max_reviews, staged)
    progress = ledger if dry_run else G.advance_progress(ledger, processed_searches(open_pages, keywords), pending, place_rows)
    summary = G.summary_of_counts(spark, n_results, *counts) if counts else G.run_summary(results, place_rows, reviews, photos)
    return PipelineResult(results, place_rows, reviews, photos, progress, summary)
