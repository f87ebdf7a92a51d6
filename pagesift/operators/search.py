"""Search seeds and search-result extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.ids import stable_id
from ..functions.labels import parse_result_label
from ..functions.text import collapse_ws, safe_trim
from ..functions.urls import is_listing_link, resolve_url, search_url

SEARCH_KEYS = ("keyword", "region")


def build_search_seeds(keywords: DataFrame, region, text_col: str = "text",
                       order_col: str = "line_no") -> DataFrame:
    """keyword_index, keyword, region, search_url for one region or a list of them (one job each, repeated regions
    count once).  No region or no keyword at all is a ValueError.

    Keyword texts are split on ``[,;\\n]+``, trimmed, blanks dropped, duplicates
    removed keeping the first (line, position); the dense index follows that order.
    The first-seen step is a partial aggregate; the dense index is a window over
    the distinct keywords only (a job-sized list).
    """
    regions = [" ".join(r.split()) for r in ([region] if isinstance(region, str) or region is None else region) if r and r.strip()]
    if not regions:
        raise ValueError("A region is required to build a scrape job.")
    exploded = keywords.select(F.col(order_col).alias("_line"),
                               F.posexplode(F.split(F.col(text_col), "[,;\n]+", -1)).alias("_pos", "_raw"))
    firsts = (exploded.select("_line", "_pos", safe_trim("_raw").alias("keyword"))
              .filter(F.col("keyword").isNotNull())
              .groupBy("keyword").agg(F.min(F.struct("_line", "_pos")).alias("_first")))
    if firsts.isEmpty():
        raise ValueError("At least one keyword is required to build a scrape job.")
    idx = F.row_number().over(Window.orderBy("_first")) - 1
    indexed = firsts.select(idx.cast("int").alias("keyword_index"), "keyword",
                            F.array(*[F.lit(r) for r in dict.fromkeys(regions)]).alias("_regions"))
    return indexed.select("keyword_index", "keyword", F.explode("_regions").alias("region")).withColumn(
        "search_url", search_url(F.col("keyword"), F.col("region")))


def filter_listing_links(anchors: DataFrame, kind: str = "place", href_col: str = "href") -> DataFrame:
    """Anchors whose trimmed href looks like a maps place (or review) link."""
    h = safe_trim(href_col)
    return anchors.filter(h.isNotNull() & is_listing_link(h, kind))


def dedup_links(links: DataFrame, keys=SEARCH_KEYS, url_col: str = "place_url",
                order=("page_no", "pos"), payload=()) -> DataFrame:
    """First link per (keys, url) in page order.  Partial aggregate: a URL repeated
    millions of times collapses map-side before the shuffle."""
    first = F.min(F.struct(*order, *payload)).alias("_f")
    out = links.groupBy(*keys, url_col).agg(first)
    return out.select(*keys, url_col, *[F.col("_f")[c].alias(c) for c in (*order, *payload)])


def rank_and_limit(links: DataFrame, limit: int | None, keys=SEARCH_KEYS, page_col: str = "page_no",
                   pos_col: str = "pos") -> DataFrame:
    """1-based rank by (page, pos) within each search; keep rank <= max(limit, 1).

    Ranks are built in two levels so no task holds a whole search: a page-local
    row_number, plus an offset = sum of result counts on earlier pages (a window
    over one row per page).  With a limit, rows beyond it on their own page are
    dropped first (they cannot make the global cut), and counts are capped the same
    way, which keeps the cut exact.
    """
    lim = None if limit is None else max(int(limit), 1)
    local = links.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, page_col).orderBy(pos_col)))
    if lim is not None:
        local = local.filter(F.col("_local") <= lim)
    counts = local.groupBy(*keys, page_col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(page_col).rowsBetween(Window.unboundedPreceding, -1)
    on = (*keys, page_col)
    offsets = counts.select(*[F.col(c).alias(f"_o_{c}") for c in on],
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # null-safe: a page without a number (sorted first) keeps its links
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in on])
    ranked = local.join(offsets, same).withColumn(
        "rank", (F.col("_off") + F.col("_local")).cast("int")).drop("_off", "_local", *[f"_o_{c}" for c in on])
    if lim is not None:
        ranked = ranked.filter(F.col("rank") <= lim)
    return ranked


def parse_result_labels(df: DataFrame, label_col: str = "raw_label") -> DataFrame:
    p = parse_result_label(label_col)
    return df.withColumn("_p", p).select(
        "*", F.col("_p.title").alias("parsed_title"), F.col("_p.category").alias("category"),
        F.col("_p.rating").alias("rating"), F.col("_p.review_count").alias("review_count"),
        F.col("_p.snippet").alias("snippet"),
    ).drop("_p")


def listing_anchors(pages: DataFrame) -> DataFrame:
    """Listing anchors of search page snapshots with resolved URL and raw label
    (aria-label -> title -> collapsed inner HTML).  Narrow; HTML is dropped here."""
    ids = ["page_id", "keyword", "region", "page_no", "captured_at"]
    a = pages.select(*ids, F.posexplode(H.element_array("html", "a")).alias("pos", "_e"))
    # attributes and the href behind a Generate each: filters on them would be moved below and compute them once more
    a = a.select(*ids, "pos", F.col("_e.inner").alias("inner_html"), F.explode(F.array(H.open_attrs("_e.open"))).alias("attrs"))
    a = a.select(*ids, "pos", "inner_html", "attrs", F.explode(F.array(safe_trim(H.attr("attrs", "href")))).alias("href"))
    a = filter_listing_links(a)
    label = F.coalesce(safe_trim(H.attr("attrs", "aria-label")), safe_trim(H.attr("attrs", "title")),
                       safe_trim(collapse_ws("inner_html")))
    return a.select(*ids, "pos", resolve_url("href").alias("place_url"), label.alias("raw_label"))


def newest_captures(pages: DataFrame, keys=(*SEARCH_KEYS, "page_no")) -> DataFrame:
    """page_id of the newest capture of each search page (the higher page_id of equal times).  Pages without a number
    are told apart by their resolved url (query kept, hash dropped).  Reads narrow columns only; a partial aggregate,
    so a page captured very often collapses before the shuffle."""
    unnumbered = F.when(F.col("page_no").isNull(), F.regexp_replace(resolve_url("url"), "(?s)#.*$", "")).alias("_url")
    newest = pages.groupBy(*keys, unnumbered).agg(F.max(F.struct("captured_at", "page_id")).alias("_n"))
    return newest.select(F.col("_n.page_id").alias("page_id"))


def search_results(pages: DataFrame, limit: int | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """Search page snapshots -> search_results rows; of several captures of one search page the newest counts.

    ``keywords`` (keyword, keyword_index) attaches the job's keyword order.
    """
    return results_from_links(listing_anchors(pages), pages, limit, keywords)


def results_from_links(links: DataFrame, pages: DataFrame, limit: int | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """O24 from extracted links and the (narrow) table of the search pages they come from."""
    links = links.join(newest_captures(pages), "page_id", "left_semi")
    # a page is its number and, as several may have none, its id
    first = dedup_links(links, order=("page_no", "page_id", "pos"), payload=("raw_label", "captured_at"))
    ranked = rank_and_limit(first.withColumn("_page", F.struct("page_no", "page_id")), limit, page_col="_page")
    parsed = parse_result_labels(ranked)
    title = F.coalesce(F.col("parsed_title"), F.col("raw_label"), F.col("place_url"))
    out = parsed.withColumn("title", title).select(
        stable_id("keyword", "region", "place_url", "title", F.col("rank") - 1).alias("id"),
        "keyword", "region", "title", "place_url", "category", "rating", "review_count", "snippet",
        "rank", "raw_label", F.col("captured_at").alias("scraped_at"), "page_id", "page_no", "pos",
    )
    if keywords is not None:
        out = out.join(keywords.select("keyword", "keyword_index"), "keyword", "left")
    return out
