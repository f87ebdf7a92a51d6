"""Generic HTML jobs (O10-O12, O17-O19) over the given ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import html as ops
from ..sources.tables import table
from . import sqlkit as K
from .registry import query


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "html")


def _matches_sql(tag: str, cols: str = "page_id") -> str:
    re_ = K.elem_re(tag)
    return (f"SELECT {cols}, unnest(regexp_extract_all(html, '{re_}', 0)) AS raw, "
            f"generate_subscripts(regexp_extract_all(html, '{re_}', 0), 1) - 1 AS pos FROM pages")


def _g(tag: str, n: int) -> str:
    return f"regexp_extract(raw, '{K.elem_re(tag)}', {n})"


# ---- O10 extract_elements('p') ----
@query("elements_p", oracle=f"""
SELECT page_id, CAST(pos AS BIGINT) AS pos, {K.collapse(_g('p', 2))} AS text
FROM ({_matches_sql('p')})
""")
def q_elements_p(spark, sf_dir):
    e = ops.extract_elements(_pages(spark, sf_dir), "p")
    return e.select("page_id", F.col("pos").cast("bigint").alias("pos"), "text")


# ---- O12 extract_anchors ----
@query("anchors", oracle=f"""
SELECT page_id, CAST(pos AS BIGINT) AS pos,
       {K.decode_named(K.attr_val(_g('a', 1), 'href'))} AS href,
       {K.collapse(_g('a', 2))} AS text
FROM ({_matches_sql('a')})
WHERE {K.has_attr(_g('a', 1), 'href')}
""")
def q_anchors(spark, sf_dir):
    a = ops.extract_anchors(_pages(spark, sf_dir))
    return a.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "text")


# ---- O11 elements_with_attribute('class', [article, div, li]) ----
def _attr_oracle(attr_name: str, tags=("article", "div", "li")) -> str:
    parts = []
    for i, t in enumerate(tags):
        parts.append(
            f"SELECT page_id, {i} AS tag_ordinal, CAST(pos AS BIGINT) AS pos, "
            f"{K.decode_named(K.attr_val(_g(t, 1), attr_name))} AS value "
            f"FROM ({_matches_sql(t)}) WHERE {K.has_attr(_g(t, 1), attr_name)}"
        )
    return "\nUNION ALL\n".join(parts)


@query("elements_with_attr", oracle=_attr_oracle("class"))
def q_elements_with_attr(spark, sf_dir):
    e = ops.elements_with_attribute(_pages(spark, sf_dir), "class", with_text=False)
    return e.select("page_id", F.col("tag_ordinal").cast("int").alias("tag_ordinal"),
                    F.col("pos").cast("bigint").alias("pos"), H.attr("attrs", "class").alias("value"))


# ---- O19 first element text / first non-empty attribute ----
@query("title_text", oracle=f"""
SELECT page_id,
       CASE WHEN regexp_matches(html, '{K.elem_re('title')}')
            THEN {K.collapse(f"regexp_extract(html, '{K.elem_re('title')}', 2)")} END AS title
FROM pages
""")
def q_title_text(spark, sf_dir):
    return ops.first_element_text(_pages(spark, sf_dir), "title", out="title")


@query("first_href", oracle=f"""
SELECT page_id, {K.decode_named(K.decode_named(K.ws(f"regexp_extract(html, '(?i)<a\\b[^>]*href=\"([^\"]*[^\"{K.D_WS[1:-1]}][^\"]*)\"', 1)")))} AS value
FROM pages
""")
def q_first_href(spark, sf_dir):
    return ops.first_element_attr(_pages(spark, sf_dir), "a", "href")


# ---- O17 page_text ----
@query("page_text", oracle=f"SELECT page_id, {K.collapse('html')} AS text FROM pages")
def q_page_text(spark, sf_dir):
    return ops.page_text(_pages(spark, sf_dir))


# ---- O18 pages_containing ----
NEEDLE = "  Nicht "


@query("pages_containing", oracle=f"""
SELECT page_id, url FROM pages WHERE contains(lower(html), lower(trim('{NEEDLE}')))
""")
def q_pages_containing(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return ops.pages_containing(p, NEEDLE).select("page_id", "url")
