"""Table generators over page snapshots (one row per element) and per-page lookups.

Every function here is narrow (no shuffle): a Generate over a regex match array
followed by projections, or a per-row projection.  Callers drop ``html`` right
after these steps so that nothing wide is ever shuffled.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import collapse_ws, decode_entities, safe_trim

DEFAULT_BLOCK_TAGS = ("article", "div", "li")


def extract_elements(pages: DataFrame, tag: str, id_cols: Sequence[str] = ("page_id",),
                     html_col: str = "html", with_text: bool = True) -> DataFrame:
    """One row per ``<tag>…</tag>`` element: id cols, tag, pos, attrs, inner_html, text, raw.

    Matching is non-overlapping with the first closing tag winning, so a nested
    element of the same tag ends its parent (the reference's behaviour).
    """
    exploded = pages.select(*id_cols, F.posexplode(H.element_array(html_col, tag)).alias("pos", "_e"))
    inner = F.col("_e.inner")
    cols = [
        *id_cols,
        F.lit(tag).alias("tag"),
        F.col("pos"),
        H.open_attrs("_e.open").alias("attrs"),
        inner.alias("inner_html"),
    ]
    if with_text:
        cols.append(collapse_ws(inner).alias("text"))
    cols.append(H.raw_element(F.col("_e")).alias("raw"))
    return exploded.select(*cols)


def elements_with_attribute(pages: DataFrame, attribute: str, tags: Iterable[str] = DEFAULT_BLOCK_TAGS,
                            id_cols: Sequence[str] = ("page_id",), html_col: str = "html",
                            with_text: bool = True, limit: int | None = None) -> DataFrame:
    """Elements of any of ``tags`` carrying ``attribute`` (an empty value counts).

    Order is (tag_ordinal, pos): all matches of the first tag, then the second…
    An element nested in another match is reported again under its own tag.
    All tags come from one scan of the page.  With ``limit`` the first of each page.
    """
    tags = tuple(tags)
    found = _carrying(H.elements_of(html_col, tags, attribute), attribute)
    found = found if limit is None else F.slice(found, 1, limit)
    return _element_rows(pages.select(*id_cols, F.explode(found).alias("_e")).select(*id_cols, "_e.*"), tags, id_cols, with_text)


def with_attribute(rows: DataFrame, attribute: str, tags: Sequence[str], id_cols: Sequence[str] = ("page_id",),
                   with_text: bool = True) -> DataFrame:
    """Rows (ids, tag_ordinal, pos, open, inner, close) -> element rows, those that carry the attribute."""
    element = F.struct("tag_ordinal", "pos", "open", "inner", "close")
    return _element_rows(rows.select(*id_cols, F.explode(_carrying(F.array(element), attribute)).alias("_e")).select(*id_cols, "_e.*"), tags, id_cols, with_text)


def _carrying(elements, attribute: str):
    """Elements with ``attrs``, those that carry the attribute.  Parsed and tested within the array: a filter on rows
    would be moved below their projection and the attributes parsed once more for it."""
    parsed = F.transform(elements, lambda e: F.struct(*[e[c].alias(c) for c in ("tag_ordinal", "pos", "open", "inner", "close")], H.open_attrs(e["open"]).alias("attrs")))
    return F.filter(parsed, lambda e: H.has_attr(e["attrs"], attribute))


def _element_rows(rows: DataFrame, tags: Sequence[str], id_cols: Sequence[str], with_text: bool) -> DataFrame:
    cols = [*id_cols, F.element_at(F.array(*[F.lit(t) for t in tags]), F.col("tag_ordinal") + 1).alias("tag"), F.col("pos"),
            F.col("attrs"), F.col("inner").alias("inner_html")]
    if with_text:
        cols.append(collapse_ws("inner").alias("text"))
    raw = F.concat("open", "inner", "close").alias("raw")
    return rows.select(*cols, raw, "tag_ordinal")


def extract_anchors(pages: DataFrame, id_cols: Sequence[str] = ("page_id",), html_col: str = "html",
                    with_text: bool = True) -> DataFrame:
    """`<a>` elements that have an href attribute (empty allowed), plus ``href``."""
    a = extract_elements(pages, "a", id_cols, html_col, with_text)
    return a.filter(H.has_attr("attrs", "href")).withColumn("href", H.attr("attrs", "href"))


def extract_images(pages: DataFrame, id_cols: Sequence[str] = ("page_id",), html_col: str = "html") -> DataFrame:
    """One row per `<img …>` tag: id cols, pos, attrs, raw."""
    exploded = pages.select(*id_cols, F.posexplode(H.open_tags(html_col, "img")).alias("pos", "raw"))
    return exploded.select(*id_cols, F.col("pos"), H.open_attrs("raw").alias("attrs"), F.col("raw"))


def extract_meta(pages: DataFrame, criteria, id_cols: Sequence[str] = ("page_id",), html_col: str = "html",
                 out: str = "content") -> DataFrame:
    """Per page: content of the first meta (document order) matching any criterion.

    ``criteria``: list of (name|property|itemprop, value).  Page-local: no shuffle.
    """
    metas = H.tag_attr_lists(html_col, "meta")
    return pages.select(*id_cols, H.meta_content(metas, criteria).alias(out))


def extract_link_href(pages: DataFrame, rel: str, id_cols: Sequence[str] = ("page_id",),
                      html_col: str = "html", out: str = "href") -> DataFrame:
    links = H.tag_attr_lists(html_col, "link")
    return pages.select(*id_cols, H.link_href(links, rel).alias(out))


def extract_jsonld(pages: DataFrame, id_cols: Sequence[str] = ("page_id",), html_col: str = "html") -> DataFrame:
    """One row per JSON-LD object: id cols, pos (script order, array order), value (VARIANT).

    Top-level arrays are flattened one level; malformed blocks are skipped.
    """
    return pages.select(*id_cols, F.posexplode(H.jsonld_objects(html_col)).alias("pos", "value"))


def page_text(pages: DataFrame, id_cols: Sequence[str] = ("page_id",), html_col: str = "html",
              out: str = "text") -> DataFrame:
    """Tags stripped, entities decoded, whitespace collapsed (script/style bodies kept)."""
    return pages.select(*id_cols, collapse_ws(html_col).alias(out))


def pages_containing(pages: DataFrame, needle: str, html_col: str = "html") -> DataFrame:
    """Pages whose raw HTML contains ``needle`` (trimmed, case-insensitive)."""
    n = needle.strip().lower()
    return pages.filter(F.lower(F.col(html_col)).contains(n))


def first_element_text(pages: DataFrame, tag: str, id_cols: Sequence[str] = ("page_id",),
                       html_col: str = "html", out: str = "text") -> DataFrame:
    """Text of the very first ``tag`` element (even when empty); null when none."""
    hit = H.first(H.element_array(html_col, tag))
    return pages.select(*id_cols, collapse_ws(hit["inner"]).alias(out))


def first_element_attr(pages: DataFrame, tag: str, attribute: str, id_cols: Sequence[str] = ("page_id",),
                       html_col: str = "html", out: str = "value") -> DataFrame:
    """First non-blank ``attribute`` value among ``tag`` elements, decoded once more."""
    els = H.elements(html_col, tag, with_text=False)
    vals = F.transform(els, lambda e: safe_trim(H.attr(e["attrs"], attribute)))
    hit = H.first(F.filter(vals, lambda v: v.isNotNull()))
    return pages.select(*id_cols, decode_entities(hit).alias(out))


# Fixed value: a review block that photo extraction leaves out.
REVIEW_ARTICLE_RE = r"""(?is)<article(?![A-Za-z0-9_])[^>]*data-review-id=["'][^"']+["'].*?</article>"""


def without_review_blocks(html_col):
    return H.remove_spans(html_col, REVIEW_ARTICLE_RE, "</article>", "<article")


def strip_review_blocks(pages: DataFrame, html_col: str = "html", out: str = "html") -> DataFrame:
    """Replace `<article … data-review-id="non-empty" …>…</article>` blocks by one space."""
    return pages.withColumn(out, without_review_blocks(html_col))
