"""Pipeline-level queries: O01, O03-O05, O60-O64 over the rendered snapshot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import progress as G
from ..sources import render as R
from ..sources.export import export_entity_tables, export_tagged_records, run_record
from ..sources.ledger import load_progress, save_progress
from ..sources.snapshots import latest_per_url, read_page_snapshots, with_url_key
from ..session import scratch_path
from . import listing_sql as L
from .listing import PHOTO_OUT, REVIEW_OUT, place_select
from .pipeline import DEFAULT_MAX_PLACES as MP, DEFAULT_MAX_REVIEWS as MR, run_pipeline
from .registry import query
from .sqlkit import sid


def pipeline(spark, sf, ledger=None, staged=True):
    return run_pipeline(spark, R.segments(spark, sf), R.stored(spark, sf, "search_pages"),
                        R.stored(spark, sf, "place_pages"), ledger, MP, MR, staged=staged)


@query("pipeline_places", oracle=f"WITH {L.place_ctes(MP, dedup=True)}\nSELECT {L.PLACE_COLS} FROM pd")
def q_pipeline_places(spark, sf):
    return place_select(pipeline(spark, sf).places)


@query("pipeline_reviews", oracle=f"WITH {L.review_ctes(MR, MP)}\nSELECT {L.REVIEW_COLS} FROM rv")
def q_pipeline_reviews(spark, sf):
    return pipeline(spark, sf).reviews.select(*REVIEW_OUT)


PIPE_PHOTOS_SQL = f"""WITH {L.place_ctes(MP, dedup=True)},
ph AS (
  SELECT pid, source_url, 'https://lh3.googleusercontent.com/p/' || CAST(k AS VARCHAR) || '-hero=w800-h600' AS image_url,
    800 AS width FROM pd
  UNION ALL
  SELECT pid, source_url, 'https://lh3.googleusercontent.com/p/' || CAST(k AS VARCHAR) || '-gallery=w1024-h768', NULL FROM pd WHERE k % 4 = 0
  UNION ALL
  SELECT pid, source_url, 'https://lh3.googleusercontent.com/rp/' || CAST(o_orderkey AS VARCHAR) || '.jpg', 640
  FROM pd JOIN orders ON o_custkey = pd.k WHERE o_orderkey % 3 = 0 AND o_orderkey % 10 IN (0, 2))
SELECT {sid('pid', 'image_url')} AS id, pid AS place_id, image_url, CAST(width AS BIGINT) AS width, source_url FROM ph"""


@query("pipeline_photos", oracle=PIPE_PHOTOS_SQL)
def q_pipeline_photos(spark, sf):
    return pipeline(spark, sf).photos.select("id", "place_id", "image_url", "width", "source_url")


SUMMARY_SQL = f"""WITH {L.review_ctes(MR, MP)}
SELECT (SELECT count(*) FROM sr) AS search_result_count, (SELECT count(*) FROM pd) AS place_count,
  (SELECT count(*) FROM rv) AS review_count,
  (SELECT count(*) FROM pd) + (SELECT count(*) FROM pd WHERE k % 4 = 0)
  + (SELECT count(*) FROM pd JOIN orders ON o_custkey = pd.k WHERE o_orderkey % 3 = 0 AND o_orderkey % 10 IN (0, 2))
  AS photo_count"""


@query("run_summary", oracle=SUMMARY_SQL)
def q_run_summary(spark, sf):
    return pipeline(spark, sf).summary


# ---- ledger rendered from nation x keywords ----
def ledger_df(spark, sf, with_ids=True):
    seg = R.segments(spark, sf)
    nat = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", F.col("n_name").alias("region"))
    pairs = R.stored(spark, sf, "search_pages").select("region", "keyword").distinct()
    kw = pairs.join(nat, "region").join(seg, "keyword")
    s = F.col("n_nationkey") + F.col("keyword_index")
    rows = kw.select("region", "keyword", F.col("keyword_index").cast("int"),
                     (s % 4).cast("int").alias("next_place_index"), (s % 5 == 0).alias("completed"),
                     F.lit(None).cast("string").alias("place_id"),
                     F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    if not with_ids:
        return rows
    done = pipeline(spark, sf).places.filter(F.col("place_page_id") % 9 == 0).select(
        "region", F.lit(None).cast("string").alias("keyword"), F.lit(None).cast("int").alias("keyword_index"),
        F.lit(None).cast("int").alias("next_place_index"), F.lit(None).cast("boolean").alias("completed"),
        F.col("id").alias("place_id"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    return rows.unionByName(done)


LEDGER_SQL = """lg AS (
  SELECT n_name AS lregion, p.keyword AS lkeyword, (n_nationkey + s.keyword_index) % 4 AS next_place_index,
         (n_nationkey + s.keyword_index) % 5 = 0 AS completed
  FROM (SELECT DISTINCT c_mktsegment AS keyword, c_nationkey AS nk FROM customer
        UNION SELECT s2.next_keyword, c_nationkey FROM customer JOIN seg s2 ON c_mktsegment = s2.keyword
        WHERE c_custkey % 10 = 0) p
  JOIN nation ON n_nationkey = p.nk JOIN seg s ON s.keyword = p.keyword)"""


@query("skip_completed", oracle=f"""WITH {L.search_ctes(MP)}, {LEDGER_SQL}
SELECT keyword, region, rank FROM sr JOIN lg ON lregion = region AND lkeyword = keyword
WHERE NOT completed AND rank - 1 >= next_place_index""")
def q_skip_completed(spark, sf):
    res = pipeline(spark, sf).search_results
    return G.skip_completed_results(res, ledger_df(spark, sf, with_ids=False)).select("keyword", "region", "rank")


@query("skip_completed_places", oracle=f"""WITH {L.place_ctes(MP, dedup=True)}
SELECT pid AS id, region FROM pd WHERE k % 9 <> 0""")
def q_skip_completed_places(spark, sf):
    pl = pipeline(spark, sf).places
    return G.skip_completed_places(pl, ledger_df(spark, sf)).select("id", "region")


@query("reconcile_progress", oracle=f"""WITH {L.SEG}, {LEDGER_SQL},
job AS (SELECT keyword AS jk, CAST(row_number() OVER (ORDER BY keyword DESC) - 1 AS INTEGER) AS job_index FROM seg),
j AS (SELECT lregion AS region, jk AS keyword, job_index AS keyword_index, completed, CAST(next_place_index AS INTEGER) AS next_place_index
      FROM lg JOIN job ON jk = lkeyword)
SELECT j.*, CAST(coalesce((SELECT min(keyword_index) FROM j j2 WHERE j2.region = j.region AND NOT j2.completed),
                           (SELECT count(*) FROM j j3 WHERE j3.region = j.region)) AS INTEGER) AS next_keyword_index
FROM j""")
def q_reconcile_progress(spark, sf):
    from pyspark.sql import Window

    seg = R.segments(spark, sf)
    led = ledger_df(spark, sf, with_ids=False)
    job_kw = seg.select("keyword", (F.row_number().over(Window.orderBy(F.col("keyword").desc())) - 1)
                        .cast("int").alias("keyword_index"))
    job = led.select("region", "keyword").join(job_kw, "keyword")
    return G.reconcile_progress(job, led)


@query("advance_progress", oracle=f"""WITH {L.search_ctes(MP)}, {LEDGER_SQL},
nk AS (SELECT n_name, n_nationkey FROM nation),
pend AS (SELECT keyword, region, max(rank) AS mx FROM sr JOIN lg ON lregion = region AND lkeyword = keyword
         WHERE NOT completed AND rank - 1 >= next_place_index GROUP BY keyword, region)
SELECT lregion AS region, lkeyword AS keyword, CAST(greatest(next_place_index, coalesce(mx, 0)) AS INTEGER) AS next_place_index,
  completed OR n_nationkey % 3 <> 1 AS completed
FROM lg JOIN nk ON n_name = lregion LEFT JOIN pend ON pend.region = lregion AND pend.keyword = lkeyword
UNION ALL SELECT n_name, 'no results', 0, n_nationkey % 3 <> 1 FROM nk WHERE n_nationkey % 3 <> 1""")
def q_advance_progress(spark, sf):
    """Two thirds of the regions are worked through, each with one more keyword that has no result; in some of them
    nothing is left beyond the stored index."""
    led = ledger_df(spark, sf, with_ids=False)
    res = pipeline(spark, sf).search_results
    pend = G.skip_completed_results(res, led)
    nat = spark.read.parquet(f"{sf}/nation.parquet").filter("n_nationkey % 3 <> 1").select(F.col("n_name").alias("region"))
    processed = led.join(nat, "region").select("region", "keyword", "keyword_index").unionByName(
        nat.select("region", F.lit("no results").alias("keyword"), F.lit(99).alias("keyword_index")))
    adv = G.advance_progress(led, processed, pend, spark.createDataFrame([], "region string, id string"))
    return G.keyword_rows(adv).select("region", "keyword", "next_place_index", "completed")


# ---- sinks read back: every record with its id, its parent's id and what tells it apart ----
ENTITY_SQL = f"""WITH {L.review_ctes(MR, MP)},
rr AS (SELECT {L.REVIEW_COLS} FROM rv),
ph AS (
  SELECT pid, 'https://lh3.googleusercontent.com/p/' || CAST(k AS VARCHAR) || '-hero=w800-h600' AS image_url FROM pd
  UNION ALL SELECT pid, 'https://lh3.googleusercontent.com/p/' || CAST(k AS VARCHAR) || '-gallery=w1024-h768' FROM pd WHERE k % 4 = 0
  UNION ALL SELECT pid, 'https://lh3.googleusercontent.com/rp/' || CAST(o_orderkey AS VARCHAR) || '.jpg'
  FROM pd JOIN orders ON o_custkey = pd.k WHERE o_orderkey % 3 = 0 AND o_orderkey % 10 IN (0, 2)),
entities AS (
  SELECT 'place' AS type, pid AS id, region AS parent, keyword || '|' || name || '|' || address AS detail FROM pd
  UNION ALL SELECT 'review', id, place_id, published_at || '|' || text || '|' || raw_label FROM rr
  UNION ALL SELECT 'review-photo', {sid('pid', 'image_url')}, pid, image_url FROM ph)"""

_EXPORTED = """type string, data struct<id string, region string, searchKeyword string, name string, address string, placeId string,
  publishedAt string, text string, rawLabel string, imageUrl string, searchResultCount long, placeCount long, reviewCount long,
  photoCount long, job struct<regions array<string>, keywords array<string>>>"""


@query("export_roundtrip", oracle=f"""{ENTITY_SQL},
n AS (SELECT (SELECT count(*) FROM sr) AS s, (SELECT count(*) FROM pd) AS p, (SELECT count(*) FROM rv) AS r, (SELECT count(*) FROM ph) AS h)
SELECT * FROM entities
UNION ALL SELECT 'run', NULL, NULL, concat_ws('|', s, p, r, h, (SELECT string_agg(keyword, ',' ORDER BY keyword) FROM seg),
  (SELECT string_agg(nat, ',' ORDER BY nat) FROM (SELECT DISTINCT nat FROM c))) FROM n""")
def q_export_roundtrip(spark, sf):
    res = pipeline(spark, sf)
    out = scratch_path(spark, "ndjson")
    run = run_record(res.summary, R.segments(spark, sf), res.progress, MP, MR)
    export_tagged_records(run, res.places, res.reviews, res.photos, out)
    back = spark.read.schema(_EXPORTED).json(out).select("type", "data.*")
    detail = {
        "run": F.concat_ws("|", "searchResultCount", "placeCount", "reviewCount", "photoCount", F.array_join("job.keywords", ","), F.array_join("job.regions", ",")),
        "place": F.concat_ws("|", "searchKeyword", "name", "address"),
        "review": F.concat_ws("|", "publishedAt", "text", "rawLabel"),
        "review-photo": F.col("imageUrl")}
    return back.select("type", "id", F.coalesce("placeId", "region").alias("parent"),
                       F.coalesce(*[F.when(F.col("type") == t, d) for t, d in detail.items()]).alias("detail"))


@query("entity_tables", oracle=f"""{ENTITY_SQL}
SELECT * FROM entities UNION ALL SELECT 'search-result', id, region, keyword || '|' || CAST(rank AS VARCHAR) || '|' || place_url FROM sr""")
def q_entity_tables(spark, sf):
    res, out = pipeline(spark, sf), scratch_path(spark, "entities")
    export_entity_tables({"search_results": res.search_results, "places": res.places, "reviews": res.reviews, "photos": res.photos}, out)

    def rows(name, kind, parent, *detail):
        return spark.read.parquet(f"{out}/{name}").select(F.lit(kind).alias("type"), "id", F.col(parent).alias("parent"), F.concat_ws("|", *detail).alias("detail"))

    return (rows("places", "place", "region", "search_keyword", "name", "address")
            .unionByName(rows("reviews", "review", "place_id", "published_at", "text", "raw_label"))
            .unionByName(rows("photos", "review-photo", "place_id", "image_url"))
            .unionByName(rows("search_results", "search-result", "region", "keyword", F.col("rank").cast("string"), "place_url")))


@query("ledger_roundtrip", oracle=f"""WITH {L.place_ctes(MP, dedup=True)}, {LEDGER_SQL},
r AS (
  SELECT lregion AS region, lkeyword AS keyword, keyword_index, CAST(next_place_index AS INTEGER) AS next_place_index, completed,
         CAST(NULL AS VARCHAR) AS place_id FROM lg JOIN seg ON seg.keyword = lkeyword
  UNION ALL SELECT region, NULL, NULL, NULL, NULL, pid FROM pd WHERE k % 9 = 0)
SELECT 1 AS version, * FROM r UNION ALL SELECT 2, * FROM r WHERE place_id IS NOT NULL OR completed""")
def q_ledger_roundtrip(spark, sf):
    """Two versions at one path, the second made from the first and saved over it."""
    path = scratch_path(spark, "ledger")
    first = save_progress(ledger_df(spark, sf), path)
    second = save_progress(load_progress(spark, path).where("place_id IS NOT NULL OR completed"), path, expected=first)
    cols = ("region", "keyword", "keyword_index", "next_place_index", "completed", "place_id")
    return load_progress(spark, path, first).select(F.lit(first).alias("version"), *cols).unionByName(
        load_progress(spark, path).select(F.lit(second).alias("version"), *cols))


def _resumed(ctes: str) -> str:
    """The CTEs of a run that starts from the rendered ledger."""
    pending = "FROM sr JOIN lg ON lregion = region AND lkeyword = keyword WHERE NOT completed AND rank - 1 >= next_place_index),\npl AS"
    return (ctes.replace(",\npl0 AS", f",\n{LEDGER_SQL},\npl0 AS").replace("FROM sr),\npl AS", pending)
            .replace("WHERE dn = 1)", "WHERE dn = 1 AND k % 9 <> 0)"))


@query("resume_summary", oracle=f"""WITH {_resumed(L.review_ctes(MR, MP))}
SELECT (SELECT count(*) FROM sr JOIN lg ON lregion = region AND lkeyword = keyword WHERE NOT completed) AS search_result_count,
  (SELECT count(*) FROM pd) AS place_count, (SELECT count(*) FROM rv) AS review_count,
  (SELECT count(*) FROM pd) + (SELECT count(*) FROM pd WHERE k % 4 = 0)
  + (SELECT count(*) FROM pd JOIN orders ON o_custkey = pd.k WHERE o_orderkey % 3 = 0 AND o_orderkey % 10 IN (0, 2)) AS photo_count""")
def q_resume_summary(spark, sf):
    """A run over the same pages from a ledger with completed searches, stored indexes and completed places."""
    return pipeline(spark, sf, ledger_df(spark, sf)).summary


@query("newest_snapshots", oracle=f"""WITH {L.SEG}, {L.CUST}
SELECT CASE WHEN k % 6 = 0 THEN k + 1000000000 ELSE k END AS page_id, canon || CASE WHEN k % 6 = 0 THEN '?hl=en#top' ELSE '' END AS url,
  canon AS url_key FROM cf""")
def q_newest_snapshots(spark, sf):
    """Every third place is captured twice, under another query and hash, a day later or earlier; search pages lie
    in the same table."""
    pages, path = R.stored(spark, sf, "place_pages"), scratch_path(spark, "snapshots")
    day = F.make_interval(days=F.when(F.col("page_id") % 2 == 0, 1).otherwise(-1))
    again = pages.where("page_id % 3 = 0").withColumns({
        "captured_at": F.col("captured_at") + day, "url": F.concat("url", F.lit("?hl=en#top")), "page_id": F.col("page_id") + 1_000_000_000})
    pages.unionByName(again).unionByName(R.stored(spark, sf, "search_pages")).write.parquet(path)
    found = with_url_key(read_page_snapshots(spark, path, "place").drop("html"))
    return latest_per_url(found).select("page_id", "url", "url_key")
