"""Place enrichment: page-side fields, result<->page join, ordered fallbacks,
place records and cross-keyword de-duplication (O30-O38)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.ids import stable_id
from ..functions.labels import address_from_text, normalize_place_title, rating_count
from ..functions.text import collapse_ws, decode_entities, let, safe_trim, to_finite, to_int, unique_strings
from ..functions.urls import coords_from_url, url_key

TITLE_META = [("property", "og:title"), ("name", "twitter:title")]
DESC_META = [("name", "description"), ("property", "og:description")]
ADDRESS_META = [("itemprop", "streetAddress")]
ADDRESS_PARTS = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")
UNKNOWN_PLACE = "Unknown place"


def _is_place_obj(v):
    return H.v_is_object(v) & (
        H.v_is_string(H.vget(v, "name")) | H.vget(v, "address").isNotNull() | H.vget(v, "geo").isNotNull()
    )


def jsonld_place_fields(obj) -> F.Column:
    """Typed fields of the first JSON-LD place object (typeof rules kept)."""
    return F.struct(*[c.alias(name) for name, c in _jsonld_place_columns(obj).items()])


def _jsonld_place_columns(obj) -> dict[str, F.Column]:
    addr = H.vget(obj, "address")
    parts = F.filter(F.array(*[safe_trim(H.v_string(H.vget(addr, p))) for p in ADDRESS_PARTS]),
                     lambda x: x.isNotNull())
    address = F.when(H.v_is_object(addr) & (F.size(parts) > 0), F.array_join(parts, ", "))
    geo = H.vget(obj, "geo")
    lat, lng = to_finite(H.v_text(H.vget(geo, "latitude"))), to_finite(H.v_text(H.vget(geo, "longitude")))
    coords = F.when(H.v_is_object(geo) & lat.isNotNull() & lng.isNotNull(),
                    F.struct(lat.alias("lat"), lng.alias("lng")))
    agg = H.vget(obj, "aggregateRating")
    rating = F.when(H.v_is_object(agg), to_finite(H.v_text(H.vget(agg, "ratingValue"))))
    count = F.when(H.v_is_object(agg), to_int(H.v_text(H.vget(agg, "reviewCount"))))
    pr = H.vget(obj, "priceRange")
    price_v = F.when(pr.isNotNull() & ~F.is_variant_null(pr), pr).otherwise(H.vget(obj, "priceLevel"))
    desc = H.vget(obj, "description")
    return {
        "name": safe_trim(H.v_string(H.vget(obj, "name"))), "category": safe_trim(H.v_string(H.vget(obj, "@type"))),
        "address": address, "coords": coords, "rating": rating, "review_count": count,
        "price_level": safe_trim(H.v_string(price_v)),
        "description": F.when(H.v_is_string(desc), collapse_ws(H.v_string(desc))),
    }


def _first_text_of(elements_arr, pred) -> F.Column:
    hit = H.first(F.filter(elements_arr, pred))
    return F.nullif(collapse_ws(hit["inner"]), F.lit(""))


def _tagged(html, tags, attribute):
    """Elements of ``tags`` (tag-major order) that carry ``attribute``; open tags
    not mentioning the attribute are skipped before any attribute parsing."""
    found = F.transform(H.elements_of(html, tags, attribute), lambda e: F.struct(H.open_attrs(e["open"]).alias("attrs"), e["inner"].alias("inner")))
    return F.filter(found, lambda e: H.has_attr(e["attrs"], attribute))


def place_page_fields(pages: DataFrame, html_col: str = "html", keep: tuple = (), cut_col: str | None = None,
                      only: tuple | None = None) -> DataFrame:
    """Page-local extraction for place pages; the result has no HTML.

    Output: page_id, url_key, captured_at and struct ``p`` with every page-side
    candidate the fallbacks need.  Expensive text fallbacks (whole page text) are
    only evaluated for pages lacking the structured value.  ``keep`` names further
    columns of ``pages`` to carry along, ``cut_col`` a column with the page's cut
    (``H.cut``); all lookups share one cut.  ``only`` names the fields of ``p`` that
    the caller reads ("j.name", "phone"...): the others are null and not extracted.
    """
    html = F.col(html_col)
    if cut_col is None:
        pages, cut_col = pages.withColumn("_cut", H.cut(html)), "_cut"
    pieces = H.Pieces(F.col(cut_col))
    stage1 = pages.select(
        "page_id", url_key("url").alias("url_key"), "captured_at", html, F.col(cut_col), *keep,
        H.tag_attr_lists(pieces, "meta").alias("_metas"),
        H.first(F.filter(H.jsonld_objects(pieces), _is_place_obj)).alias("_obj"),
        F.transform(
            F.filter(H.element_array(pieces, "a"), lambda e: F.lower(e["open"]).contains("href")),
            lambda e: H.open_attrs(e["open"])).alias("_a_attrs"),
    )
    hrefs = F.transform(F.filter("_a_attrs", lambda a: H.has_attr(a, "href")), lambda a: safe_trim(H.attr(a, "href")))
    jsonld = _jsonld_place_columns("_obj")
    stage2 = stage1.select(
        "page_id", "url_key", "captured_at", html, F.col(cut_col), *keep,
        *[c.alias("_j_" + name) for name, c in jsonld.items()],
        H.meta_content("_metas", TITLE_META).alias("meta_title"),
        H.meta_content("_metas", DESC_META).alias("meta_desc"),
        H.meta_content("_metas", ADDRESS_META).alias("meta_address"),
        collapse_ws(H.first(H.element_array(pieces, "title"))["inner"]).alias("title_text"),
        H.link_href(H.tag_attr_lists(pieces, "link"), "canonical").alias("canonical"),
        hrefs.alias("_hrefs"),
    )
    phone1 = H.first(F.filter("_hrefs", lambda h: F.lower(h).startswith("tel:")))
    first_href = decode_entities(H.first(F.filter("_hrefs", lambda h: h.isNotNull())))
    phone2 = let(first_href, lambda d: F.when(F.lower(d).startswith("tel:"), F.substring(d, 5, 1 << 30)))
    web1 = H.first(F.filter("_hrefs", lambda h: h.isNotNull() & ~h.startswith("tel:")
                            & ~h.contains("google.com/maps") & ~h.contains("googleusercontent.com")))
    web2 = safe_trim(H.attr(H.first(_tagged(pieces, ("a", "div"), "data-website"))["attrs"], "data-website"))
    item_addr = _first_text_of(_tagged(pieces, ("button", "div", "span"), "data-item-id"),
                               lambda e: F.lower(safe_trim(H.attr(e["attrs"], "data-item-id"))) == "address")
    aria_addr = _first_text_of(_tagged(pieces, ("button", "div", "span"), "aria-label"),
                               lambda e: F.coalesce(F.lower(safe_trim(H.attr(e["attrs"], "aria-label"))).contains("address"), F.lit(False)))
    html_address = F.coalesce(F.col("meta_address"), item_addr, aria_addr)
    page_text = collapse_ws(html)
    no_struct_addr = F.col("_j_address").isNull() & F.col("_html_address").isNull()
    addr_text = F.when(no_struct_addr, F.coalesce(address_from_text("meta_desc"), address_from_text(page_text)))
    need_rc = F.col("_j_rating").isNull() | F.col("_j_review_count").isNull()
    rc_page = F.when(need_rc, F.coalesce(rating_count("meta_desc"), rating_count(page_text)))
    stage3 = stage2.withColumn("_html_address", F.when(F.col("_j_address").isNull(), html_address))
    def pick(name, value):
        # never true: a typed null, whose inputs the optimizer leaves out
        return (value if only is None or name in only else F.when(F.lit(False), value)).alias(name.split(".")[-1])

    return stage3.select(
        "page_id", "url_key", "captured_at", *keep,
        F.struct(
            F.struct(*[pick("j." + name, F.col("_j_" + name)) for name in jsonld]).alias("j"),
            *[pick(name, F.col(name)) for name in ("meta_title", "meta_desc", "title_text", "canonical")],
            pick("phone", F.coalesce(F.substring(phone1, 5, 1 << 30), phone2)),
            pick("website", F.coalesce(web1, web2)),
            pick("html_address", F.col("_html_address")), pick("address_text", addr_text), pick("rc_page", rc_page),
        ).alias("p"),
    )


def join_results_to_pages(results: DataFrame, page_fields: DataFrame, how: str = "inner") -> DataFrame:
    """Equi-join on the comparable URL (origin + path).  ``how='left'`` keeps
    results without a page and flags them with ``page_found``."""
    r = results.withColumn("url_key", url_key("place_url"))
    # found is known on the page's side, so that a caller who wants no field has none extracted
    found = page_fields.withColumn("page_found", F.col("p").isNotNull())
    j = r.join(found.withColumnRenamed("page_id", "place_page_id")
               .withColumnRenamed("captured_at", "page_captured_at"), "url_key", how)
    return j.withColumn("page_found", F.coalesce("page_found", F.lit(False)))


def place_records(joined: DataFrame) -> DataFrame:
    """Ordered fallbacks between page fields ``p`` and result columns."""
    p, j = F.col("p"), F.col("p.j")
    title = F.coalesce(p["meta_title"], p["title_text"], F.col("title"))
    name0 = normalize_place_title(F.coalesce(j["name"], title, F.col("title")))
    name = F.coalesce(safe_trim(F.coalesce(name0, F.col("title"))), F.lit(UNKNOWN_PLACE))
    canonical_or_result = F.coalesce(p["canonical"], F.col("place_url"))
    source_url = F.coalesce(safe_trim(canonical_or_result), F.lit(""))
    rc = F.coalesce(rating_count("raw_label"), rating_count("snippet"), p["rc_page"])
    address = F.coalesce(j["address"], p["html_address"], address_from_text("snippet"),
                         address_from_text("raw_label"), p["address_text"], F.col("snippet"))
    coords = F.coalesce(j["coords"], coords_from_url(canonical_or_result), coords_from_url("place_url"))
    region = F.coalesce(safe_trim("region"), F.lit("unknown"))
    staged = joined.select(
        "*", name.alias("_name"), source_url.alias("_source_url"), region.alias("_region"),
        title.alias("_title"), rc.alias("_rc"),
        address.alias("_address"), coords.alias("_coords"),
    )
    pid = stable_id("_source_url", "_name", "_region")
    return staged.select(
        pid.alias("id"),
        F.coalesce(safe_trim("id"), pid).alias("search_result_id"),
        F.coalesce(safe_trim("keyword"), F.lit("unknown")).alias("search_keyword"),
        F.col("_region").alias("region"),
        F.col("_name").alias("name"),
        safe_trim(F.coalesce(j["category"], F.col("category"))).alias("category"),
        safe_trim("_address").alias("address"),
        F.col("_coords").alias("coordinates"),
        F.coalesce(j["rating"], F.col("rating"), F.col("_rc.rating")).alias("rating"),
        F.coalesce(j["review_count"], F.col("review_count"), F.col("_rc.review_count")).alias("review_count"),
        safe_trim(j["price_level"]).alias("price_level"),
        safe_trim(p["phone"]).alias("phone"),
        safe_trim(p["website"]).alias("website"),
        safe_trim(F.coalesce(p["meta_desc"], j["description"])).alias("description"),
        F.col("_source_url").alias("source_url"),
        F.coalesce(safe_trim("place_url"), F.col("_source_url")).alias("search_url"),
        safe_trim("_title").alias("raw_title"),
        safe_trim("raw_label").alias("raw_label"),
        unique_strings(F.array("keyword", "region", "title")).alias("keywords"),
        F.coalesce(F.col("page_captured_at"), F.col("scraped_at")).alias("scraped_at"),
        *[c for c in ("keyword_index", "rank", "place_page_id", "url_key") if c in joined.columns],
    )


def places(results: DataFrame, page_fields: DataFrame) -> DataFrame:
    """Results joined with their place pages -> place records."""
    return place_records(join_results_to_pages(results, page_fields, "inner"))


def dedup_places(place_rows: DataFrame, order=("keyword_index", "rank")) -> DataFrame:
    """First place per (region, id) by (keyword_index, rank).

    min_by over a partial aggregate: a place listed under thousands of keywords
    collapses map-side, nothing is windowed over one hot id."""
    cols = [c for c in place_rows.columns if c not in ("region", "id")]
    agg = place_rows.groupBy("region", "id").agg(
        F.min_by(F.struct(*cols), F.struct(*order)).alias("_w"))
    return agg.select("id", "region", *[F.col("_w")[c].alias(c) for c in cols]).select(*place_rows.columns)


def places_from_results(results: DataFrame, job_keywords: list[str] | None = None,
                        job_region: str | None = None) -> DataFrame:
    """Degraded place records from search results alone (no page)."""
    name = F.coalesce(safe_trim("title"), F.lit(UNKNOWN_PLACE))
    src = F.coalesce(safe_trim("place_url"), F.lit(""))
    region = F.coalesce(safe_trim("region"), F.lit("unknown"))
    if job_keywords is not None:
        kw = unique_strings(F.array(F.col("keyword"), F.lit(job_region), *[F.lit(k) for k in job_keywords]))
    else:
        kw = unique_strings(F.array(F.col("keyword"), F.col("region"), name))
    staged = results.select("*", name.alias("_name"), src.alias("_src"), region.alias("_region"))
    pid = stable_id("_src", "_name", "_region")
    return staged.select(
        pid.alias("id"), F.coalesce(safe_trim("id"), pid).alias("search_result_id"),
        F.coalesce(safe_trim("keyword"), F.lit("unknown")).alias("search_keyword"),
        F.col("_region").alias("region"), F.col("_name").alias("name"), safe_trim("category").alias("category"),
        F.lit(None).cast("string").alias("address"),
        F.lit(None).cast("struct<lat:double,lng:double>").alias("coordinates"),
        F.col("rating"), F.col("review_count"),
        *[F.lit(None).cast("string").alias(c) for c in ("price_level", "phone", "website", "description")],
        F.col("_src").alias("source_url"), F.coalesce(safe_trim("place_url"), F.col("_src")).alias("search_url"),
        F.lit(None).cast("string").alias("raw_title"), safe_trim("raw_label").alias("raw_label"),
        kw.alias("keywords"), F.col("scraped_at"),
    )
