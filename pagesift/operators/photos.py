"""Photo candidates, the ordered keep/drop rule, per-page de-duplication and
photo records (O50-O56)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.ids import stable_id
from ..functions.text import let, safe_trim, to_int, unique_strings
from ..functions.urls import url_key
from .html import strip_review_blocks, without_review_blocks

_W = "[A-Za-z0-9_]"
# Photo rule patterns.
EXPLICIT_ATTRS = ("data-photo-url", "data-thumbnail-url", "data-photo-index", "data-photo-id")
PROFILE_WORDS_RE = "(?i)(?<!" + _W + ")(profile|avatar|reviewer|author|user icon|user photo)(?!" + _W + ")"
PHOTO_WORDS = ("photo", "image", "gallery", "food", "drink", "dish", "meal", "interior", "menu", "place")
PHOTO_WORDS_RE = "(?i)(?<!" + _W + ")(photo|image|gallery|food|drink|dish|meal|interior|menu|place)(?!" + _W + ")"
PROFILE_WORDS = ("profile", "avatar", "reviewer", "author", "user icon", "user photo")
PROFILE_URL_WORDS = ("avatar", "profile", "userphoto", "reviewer")
PHOTO_HOST = "googleusercontent.com"


def _names_any(lowered, words) -> F.Column:
    """A text in lower case holds one of ``words``: a plain test, by far cheaper than an alternation tried at every character."""
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def on_photo_host(url) -> F.Column:
    return F.lower(url).contains(PHOTO_HOST)


def url_dimension(url, prefix: str) -> F.Column:
    pat = "(?i)(?:=|-)" + prefix + "(\\d+)(?!" + _W + ")"
    return let(safe_trim(url), lambda s: F.when(s.rlike(pat), to_int(F.regexp_extract(s, pat, 1))))


def photo_candidates(pages: DataFrame, id_cols=("page_id",), html_col: str = "html") -> DataFrame:
    """Images (ordinal 0) then photo-host anchors (ordinal 1), with the
    decision inputs and the record values (alt in the record = title for anchors).
    Both come from one scan of the page."""
    return candidates_from_raw(pages.select(*id_cols, F.explode(raw_candidates(html_col)).alias("_e")).select(*id_cols, "_e.*"), id_cols)


def raw_candidates(html_col):
    """array<struct<source_ordinal, pos, open, raw>>: image tags, then anchors with an href."""
    def entry(i, pos, open_tag, raw):
        return F.struct(F.lit(i).alias("source_ordinal"), pos.alias("pos"), open_tag.alias("open"), raw.alias("raw"))

    images = F.transform(H.open_tags(html_col, "img"), lambda r, p: entry(0, p, r, r))
    anchors = F.transform(H.element_array(html_col, "a"), lambda e, p: entry(1, p, e["open"], H.raw_element(e)))
    return F.concat(images, F.filter(anchors, lambda e: F.lower(e["open"]).contains("href")))


def candidates_from_raw(rows: DataFrame, id_cols=("page_id",)) -> DataFrame:
    """Rows (ids, source_ordinal, pos, open, raw) -> candidate rows."""
    image = F.col("source_ordinal") == 0

    def candidate(attrs):
        def at(name):
            return safe_trim(H.attr(attrs, name))

        def built(v):
            return F.struct(
                F.when(image, F.coalesce(at("data-photo-url"), v["link"])).otherwise(v["link"]).alias("image_url"),
                F.when(image, v["link"]).otherwise(at("data-thumbnail-url")).alias("thumbnail_url"),
                F.when(image, v["alt"]).otherwise(v["title"]).alias("alt_text"),
                F.when(image, v["alt"]).otherwise(F.coalesce(v["title"], at("aria-label"))).alias("context_alt"),
                v["title"].alias("title_text"),
                to_int(H.attr(attrs, "width")).alias("width"), to_int(H.attr(attrs, "height")).alias("height"),
            )

        return let(F.struct(F.when(image, at("src")).otherwise(at("href")).alias("link"), F.when(image, at("alt")).alias("alt"), at("title").alias("title")), built)

    def usable(c):
        return c["image_url"].isNotNull() & (image | on_photo_host(c["image_url"]))

    # behind a Generate, so that no filter is moved below the projection and the attributes are parsed once
    made = F.filter(F.transform(F.array(H.open_attrs("open")), candidate), usable)
    return rows.select(*id_cols, "source_ordinal", "pos", "raw", F.explode(made).alias("_c")).select(*id_cols, "source_ordinal", "pos", "raw", "_c.*")


def keep_photo(kind: str, author_col: str | None = None) -> F.Column:
    """The ordered keep/drop decision as one CASE expression."""
    ctx0 = F.lower(F.concat_ws(" ", "context_alt", "title_text", "raw", "image_url", "thumbnail_url"))
    w0 = F.coalesce(F.col("width"), url_dimension("image_url", "w"), url_dimension("thumbnail_url", "w"))
    h0 = F.coalesce(F.col("height"), url_dimension("image_url", "h"), url_dimension("thumbnail_url", "h"))
    a = F.lower(safe_trim(author_col)) if author_col is not None else F.lit(None).cast("string")

    def decide(v):
        ctx, w, h = v["ctx"], v["w"], v["h"]
        too_small = F.coalesce(w <= 150, F.lit(False)) | F.coalesce(h <= 150, F.lit(False))
        small_square = F.coalesce((w <= 128) & (h <= 128) & (F.abs(w - h) <= 24), F.lit(False))
        photo_word = _names_any(ctx, PHOTO_WORDS) & ctx.rlike(PHOTO_WORDS_RE)
        mentions_author = F.coalesce(v["a"].isNotNull() & ctx.contains(v["a"]), F.lit(False))
        tail = (~small_square) if kind == "place" else (
            w.isNull() | h.isNull() | (w >= 160) | (h >= 160) | photo_word)
        return (
            F.when(too_small, False)
            .when(_names_any(F.lower(F.col("raw")), EXPLICIT_ATTRS), True)
            .when((_names_any(ctx, PROFILE_WORDS) & ctx.rlike(PROFILE_WORDS_RE)) | _names_any(F.lower(F.col("image_url")), PROFILE_URL_WORDS)
                  | (mentions_author & small_square), False)
            .when(small_square & ~photo_word, False)
            .when(~on_photo_host(F.col("image_url")), False)
            .otherwise(tail)
        )

    return let(F.struct(ctx0.alias("ctx"), w0.alias("w"), h0.alias("h"), a.alias("a")), decide)


def filter_photos(candidates: DataFrame, kind: str = "place", author_col: str | None = None) -> DataFrame:
    return candidates.filter(keep_photo(kind, author_col))


def dedup_photos(photos: DataFrame, keys=("page_id",)) -> DataFrame:
    """Per page and image URL the last entry's values, at the first entry's
    position (Map.set semantics).  A partial aggregate keyed by (page, url)."""
    order = F.struct("source_ordinal", "pos")
    vals = F.struct("thumbnail_url", "alt_text", "width", "height")
    g = photos.groupBy(*keys, "image_url").agg(F.min(order).alias("_first"), F.max_by(vals, order).alias("_v"))
    return g.select(*keys, "image_url", F.col("_first.source_ordinal").alias("source_ordinal"),
                    F.col("_first.pos").alias("pos"), "_v.*")


def exclude_photos(photos: DataFrame, urls: DataFrame, url_col: str = "image_url") -> DataFrame:
    """Drop listed image URLs (anti-join; AQE broadcasts a small list)."""
    return photos.join(urls.select(F.col(url_col).alias("image_url")).distinct(), "image_url", "left_anti")


def place_photo_entries(pages: DataFrame, id_cols=("page_id", "url_key", "captured_at")) -> DataFrame:
    """O50 -> O51 -> O52('place') -> O53 on place pages (page-local, no place needed)."""
    stripped = strip_review_blocks(pages)
    cands = photo_candidates(stripped, id_cols)
    return dedup_photos(filter_photos(cands, "place"), keys=id_cols)


def place_photo_array(html_col: str = "html"):
    """The raw photo candidates of a place page without its review blocks, as one array."""
    return raw_candidates(without_review_blocks(html_col))


def photo_entries_from_raw(rows: DataFrame, id_cols=("page_id", "captured_at")) -> DataFrame:
    """Rows (ids, source_ordinal, pos, open, raw) of place pages -> kept, de-duplicated entries."""
    return dedup_photos(filter_photos(candidates_from_raw(rows, id_cols), "place"), keys=id_cols)


def place_photo_records(entries: DataFrame, place_rows: DataFrame, join_key: str = "url_key") -> DataFrame:
    """Photo entries of each place's page -> photo records."""
    pl = place_rows.select(F.col("id").alias("place_id"), F.col("source_url").alias("_src"), join_key)
    j = entries.join(pl, join_key)
    src = F.coalesce(safe_trim("_src"), F.lit(""))
    img = F.coalesce(safe_trim("image_url"), F.lit(""))
    return j.select(
        stable_id("place_id", "image_url").alias("id"), safe_trim("place_id").alias("place_id"),
        src.alias("place_url"), F.lit(None).cast("string").alias("review_id"),
        F.lit(None).cast("string").alias("review_url"), F.lit("place").alias("photo_kind"), img.alias("image_url"),
        safe_trim("thumbnail_url").alias("thumbnail_url"), safe_trim("alt_text").alias("alt_text"),
        "width", "height", src.alias("source_url"), F.col("captured_at").alias("scraped_at"),
    )


def place_photos(place_rows: DataFrame, pages: DataFrame) -> DataFrame:
    entries = place_photo_entries(pages.withColumn("url_key", url_key("url")))
    return place_photo_records(entries, place_rows)


def review_photos(reviews: DataFrame, image_urls: DataFrame) -> DataFrame:
    """Image URLs joined to known reviews; unique URLs per review; id = stable_id(place, review, url).

    The key is the review's block (page_id, tag_ordinal, block_pos) where both sides have it, so blocks without an id
    of their own keep their photos; else (place_id, review_id), else review_id."""
    block, pair = ("page_id", "tag_ordinal", "block_pos"), ("place_id", "review_id")
    known = reviews.withColumn("review_id", F.col("id"))
    on = next((list(k) for k in (block, pair, ("review_id",)) if set(k) <= set(known.columns) and set(k) <= set(image_urls.columns)))
    u = image_urls.select(*on, safe_trim("image_url").alias("image_url")).filter(F.col("image_url").isNotNull())
    u = u.distinct()
    keep = dict.fromkeys([*on, "review_id", "place_id", "place_url", "_rurl", *(c for c in ("scraped_at",) if c in reviews.columns)])
    r = known.withColumn("_rurl", F.col("source_url")).select(*keep).dropDuplicates(list(dict.fromkeys([*on, "place_id", "review_id"])))
    j = u.join(r, on)
    return j.select(
        stable_id("place_id", "review_id", "image_url").alias("id"), "place_id", "place_url", "review_id",
        safe_trim("_rurl").alias("review_url"), F.lit("review").alias("photo_kind"), "image_url",
        F.lit(None).cast("string").alias("thumbnail_url"), F.lit(None).cast("string").alias("alt_text"),
        F.lit(None).cast("bigint").alias("width"), F.lit(None).cast("bigint").alias("height"),
        F.coalesce(safe_trim("_rurl"), F.col("place_url")).alias("source_url"),
        *[c for c in ("scraped_at",) if c in reviews.columns],
    )


def review_image_urls(pages: DataFrame, author_col: str | None = None) -> DataFrame:
    """Review-photo URLs from review blocks: O40 fragments -> O51 -> O52('review')."""
    from .reviews import review_blocks

    blocks = review_blocks(pages).select("page_id", "tag_ordinal", F.col("pos").alias("block_pos"),
                                         safe_trim(H.attr("attrs", "data-review-id")).alias("review_id"),
                                         F.col("inner_html").alias("frag"))
    cands = photo_candidates(blocks, id_cols=("page_id", "tag_ordinal", "block_pos", "review_id"), html_col="frag")
    kept = filter_photos(cands, "review", author_col)
    return dedup_photos(kept, keys=("page_id", "tag_ordinal", "block_pos", "review_id"))


__all__ = ["dedup_photos", "exclude_photos", "filter_photos", "keep_photo", "photo_candidates",
           "place_photo_entries", "place_photo_records", "place_photos", "review_image_urls",
           "review_photos", "unique_strings", "url_dimension"]
