"""Review blocks, review records, per-place limits and normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.ids import stable_id
from ..functions.labels import LIKES_RE, RATING_RE
from ..functions.text import WS, collapse_ws, let, safe_trim, to_finite, to_int, unique_strings
from ..functions.urls import url_key
from .html import DEFAULT_BLOCK_TAGS, elements_with_attribute, with_attribute

# Attribute names and label patterns of review blocks.
REVIEW_ATTR = "data-review-id"
NESTED_TAGS = ("span", "div", "p", "a", "time")
AUTHOR_ATTRS = ("data-author-name", "data-author", "data-review-author")
PROFILE_ATTRS = ("data-author-url", "data-profile-url", "href")
TEXT_ATTRS = ("data-review-text", "data-text", "data-content")
TRANSLATED_ATTRS = ("data-translated-text", "data-google-translated-text")
AUTHOR_LABEL_RE = "(?i)^(?:reviewed by|by)" + WS + "+(.+?)(?:[·|]|$)"
PUBLISHED_LABEL_RE = "(?i)(?:posted|reviewed)" + WS + "+on" + WS + "+(.+?)(?:[·|]|$)"
TIME_RE = r"""(?i)<time(?![A-Za-z0-9_])[^>]*datetime=["']([^"']+)["'][^>]*>"""
DATA_RATING_RE = r"""(?i)data-rating=["']([^"']+)["']"""
DATA_LIKES_RE = r"""(?i)data-like-count=["']([^"']+)["']"""
STRIP_FOR_TEXT = ((r"(?is)<time(?![A-Za-z0-9_]).*?</time>", "</time>", "<time"), (r"(?i)<img(?![A-Za-z0-9_])[^>]*>", ">", "<img"),
                  (r"(?is)<button(?![A-Za-z0-9_]).*?</button>", "</button>", "<button"))


def review_blocks(pages: DataFrame, id_cols=("page_id",), html_col: str = "html", limit: int | None = None) -> DataFrame:
    """Elements with data-review-id on article, div, li — in that order; with ``limit`` the first of each page."""
    return elements_with_attribute(pages, REVIEW_ATTR, DEFAULT_BLOCK_TAGS, id_cols, html_col, with_text=False, limit=limit)


def review_block_array(html_col="html", limit: int | None = None):
    """The review blocks of a page as one array, in order; with a limit the first max(limit, 1) of them, so that
    the others are never parsed."""
    blocks = H.elements_of(html_col, DEFAULT_BLOCK_TAGS, REVIEW_ATTR)

    def carries(e):
        return H.has_attr(H.open_attrs(e["open"]), REVIEW_ATTR)

    return blocks if limit is None else F.slice(F.filter(blocks, carries), 1, max(int(limit), 1))


def review_blocks_from_raw(rows: DataFrame, id_cols=("page_id", "captured_at")) -> DataFrame:
    """Rows (ids, tag_ordinal, pos, open, inner, close) -> O40 rows."""
    return with_attribute(rows, REVIEW_ATTR, DEFAULT_BLOCK_TAGS, id_cols, with_text=False)


def _nested_elements(fragment):
    """The nested elements whose open tag names an attribute that is looked for; of the others none is parsed."""
    def named(e):
        lowered = F.lower(e["open"])
        return reduce(lambda a, b: a | b, [lowered.contains(n) for n in (*AUTHOR_ATTRS, *TEXT_ATTRS, *TRANSLATED_ATTRS)])

    return F.transform(F.filter(H.elements_of(fragment, NESTED_TAGS, "data-"), named), lambda e: F.struct(H.open_attrs(e["open"]).alias("attrs"), e["inner"].alias("inner")))


def _nested_text(els, names) -> F.Column:
    """First attribute value (else element text) that is non-empty, attribute-major."""
    def of(n):
        vals = F.transform(F.filter(els, lambda e: H.has_attr(e["attrs"], n)),
                           lambda e: F.coalesce(safe_trim(H.attr(e["attrs"], n)), collapse_ws(e["inner"])))
        return H.first(F.filter(vals, lambda v: v.isNotNull() & (v != "")))

    return H.first(F.filter(F.transform(F.array(*[F.lit(n) for n in names]), of), lambda v: v.isNotNull()))


def parse_review_blocks(blocks: DataFrame, ids_only: bool = False) -> DataFrame:
    """Block rows (attrs, inner_html) -> parsed review fields (no ids yet).  ``ids_only`` is for callers who read no field
    but the id made from them: author, date and text of a block with an id of its own are then null and not looked for."""
    frag, pieces = F.col("inner_html"), H.Pieces(F.col("_cut"))

    def asked(value):
        return F.when(safe_trim(H.attr("attrs", "data-review-id")).isNull(), value) if ids_only else value

    s1 = blocks.withColumn("_cut", H.cut(frag)).select(
        "*",
        safe_trim(H.attr("attrs", "data-review-id")).alias("review_id"),
        F.coalesce(safe_trim(H.attr("attrs", "aria-label")), collapse_ws(frag)).alias("label0"),
        asked(_nested_elements(pieces)).alias("_els"),
        F.transform(F.filter(F.transform(F.filter(H.element_array(pieces, "a"), lambda e: F.lower(e["open"]).contains("href")),
                                         lambda e: H.open_attrs(e["open"])),
                             lambda a: H.has_attr(a, "href")),
                    lambda a: H.first(F.filter(F.transform(F.array(*[F.lit(n) for n in PROFILE_ATTRS]), lambda n: safe_trim(H.attr(a, n))),
                                               lambda v: v.isNotNull()))).alias("_profiles"),
    )
    label = F.col("label0")
    author_label = F.when(label.rlike(AUTHOR_LABEL_RE), safe_trim(F.regexp_extract(label, AUTHOR_LABEL_RE, 1)))
    rating = F.coalesce(
        F.when(label.rlike(RATING_RE), to_finite(F.regexp_extract(label, RATING_RE, 1))),
        F.when(frag.rlike(DATA_RATING_RE), to_finite(F.regexp_extract(frag, DATA_RATING_RE, 1))),
    )
    published = F.when(frag.rlike(TIME_RE), safe_trim(F.regexp_extract(frag, TIME_RE, 1))).otherwise(
        F.when(label.rlike(PUBLISHED_LABEL_RE), safe_trim(F.regexp_extract(label, PUBLISHED_LABEL_RE, 1))))
    explicit = _nested_text("_els", TEXT_ATTRS)
    stripped = frag
    for pat, close, start in STRIP_FOR_TEXT:
        stripped = H.remove_spans(stripped, pat, close, start)
    text = F.coalesce(collapse_ws(explicit), let(collapse_ws(stripped), lambda t: F.nullif(t, F.lit(""))))
    translated = collapse_ws(_nested_text("_els", TRANSLATED_ATTRS))
    likes_raw = F.coalesce(F.when(frag.rlike(DATA_LIKES_RE), F.regexp_extract(frag, DATA_LIKES_RE, 1)),
                           F.when(label.rlike(LIKES_RE), F.regexp_extract(label, LIKES_RE, 1)))
    return s1.select(
        *[c for c in blocks.columns if c not in ("attrs", "inner_html", "raw", "text", "_cut")],
        "review_id",
        asked(F.coalesce(_nested_text("_els", AUTHOR_ATTRS), author_label)).alias("author_name"),
        H.first(F.filter("_profiles", lambda v: v.isNotNull())).alias("author_profile_url"),
        rating.alias("rating"), asked(published).alias("published_at"), asked(text).alias("text"),
        translated.alias("translated_text"), to_int(likes_raw).alias("likes"),
        safe_trim(label).alias("raw_label"),
    )


def review_records(parsed: DataFrame, place_rows: DataFrame, limit: int | None = None,
                   join_key: str = "url_key") -> DataFrame:
    """O41 + O42: attach each page's parsed blocks to its places, number them in
    (tag_ordinal, pos) order per place, cut at max(limit, 1), build ids/records.

    The window is per place (one page's blocks), so its size is bounded by a
    page; the limit becomes a WindowGroupLimit applied before the shuffle.
    """
    pl = place_rows.select(F.col("id").alias("place_id"), F.col("source_url").alias("place_source_url"), join_key)
    j = parsed.join(pl, join_key)
    w = Window.partitionBy("place_id").orderBy("tag_ordinal", "pos")
    j = j.withColumn("_n", F.row_number().over(w))
    if limit is not None:
        j = j.filter(F.col("_n") <= max(int(limit), 1))
    rid = F.coalesce(F.col("review_id"), stable_id("place_id", "author_name", "published_at", "text", F.col("_n") - 1))
    src = F.coalesce(safe_trim("place_source_url"), F.lit(""))
    return j.select(
        safe_trim(rid).alias("id"), safe_trim("place_id").alias("place_id"), src.alias("place_url"),
        safe_trim("author_name").alias("author_name"), safe_trim("author_profile_url").alias("author_profile_url"),
        "rating", safe_trim("published_at").alias("published_at"), safe_trim("text").alias("text"),
        safe_trim("translated_text").alias("translated_text"), "likes", src.alias("source_url"),
        F.array().cast("array<string>").alias("photo_ids"),
        *[c for c in ("scraped_at",) if c in parsed.columns],
        "raw_label", (F.col("_n") - 1).alias("block_index"),
        *[F.col(c).alias(a) for c, a in (("page_id", "page_id"), ("tag_ordinal", "tag_ordinal"), ("pos", "block_pos")) if c in parsed.columns],
    )


def limit_reviews(reviews: DataFrame, n: int, key: str = "place_id", order=("block_index",)) -> DataFrame:
    """O42 on its own: first max(n, 1) reviews per place."""
    w = Window.partitionBy(key).orderBy(*order)
    return reviews.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max(int(n), 1)).drop("_n")


def reviews_from_pages(place_rows: DataFrame, pages: DataFrame, limit: int | None = None, ids_only: bool = False) -> DataFrame:
    """Place pages -> review records for the given places.  A place's first blocks are among the first of each of its
    pages, so with a limit no other block is parsed.  ``ids_only``: see ``parse_review_blocks``."""
    blocks = review_blocks(pages.withColumn("url_key", url_key("url")), id_cols=("page_id", "url_key", "captured_at"),
                           limit=None if limit is None else max(int(limit), 1))
    parsed = parse_review_blocks(blocks, ids_only).withColumnRenamed("captured_at", "scraped_at")
    return review_records(parsed, place_rows, limit)


def normalize_reviews(place_rows: DataFrame, raw: DataFrame) -> DataFrame:
    """Review rows from another source -> records of the joined place."""
    pl = place_rows.select(F.col("id").alias("_pid"), F.col("source_url").alias("_purl"))
    j = raw.join(pl, raw.place_id == pl._pid)
    src = F.coalesce(safe_trim("source_url"), safe_trim("_purl"), F.lit(""))
    author, published, text = safe_trim("author_name"), safe_trim("published_at"), safe_trim("text")
    staged = j.select("*", src.alias("_src"), author.alias("_author"), published.alias("_pub"), text.alias("_text"))
    rid = F.coalesce(safe_trim("id"), stable_id("_pid", "_src", "_author", "_pub", "_text"))
    return staged.select(
        rid.alias("id"), F.col("_pid").alias("place_id"), F.coalesce(safe_trim("_purl"), F.lit("")).alias("place_url"),
        F.col("_author").alias("author_name"), safe_trim("author_profile_url").alias("author_profile_url"),
        to_finite("rating").alias("rating"), F.col("_pub").alias("published_at"), F.col("_text").alias("text"),
        safe_trim("translated_text").alias("translated_text"), to_int("likes").alias("likes"),
        F.col("_src").alias("source_url"), unique_strings("photo_ids").alias("photo_ids"),
        (safe_trim("raw_label") if "raw_label" in raw.columns else F.lit(None).cast("string")).alias("raw_label"),
        (F.col("scraped_at") if "scraped_at" in raw.columns else F.lit(None)).cast("timestamp").alias("scraped_at"),
    )
