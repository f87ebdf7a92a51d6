"""Attributes are parsed once for an element, only for rows that need them, and faster patterns find what the plain ones do."""

import random
import re

from pyspark.sql import functions as F

from pagesift.functions import html as H
from pagesift.functions import text as T
from pagesift.operators import html as hops
from pagesift.operators import photos as P
from pagesift.operators import reviews as RV
from pagesift.operators import search as S

PIC = "https://lh3.googleusercontent.com/p"
HOST = "https://www.google.com/maps/place/t"
BLOCKS = "".join(f'<{tag} data-review-id="{rid}" aria-label="Reviewed by N{i} · 4.5 stars · Posted on 2024-01-0{i}"><p data-text="t{i}"></p><img data-photo-url="{PIC}/{i}" width=300 height=200 alt="{alt}"></{tag}>'
                 for i, (tag, rid, alt) in enumerate([("article", "a", "dish"), ("article", "", "x"), ("li", "", "avatar"), ("li", "b", "Ein Menü"), ("div", " ", "")], 1))
PAGE = f'<html><title>T</title>{BLOCKS}<a href="/maps/place/t" title=" T ">t</a><a name=x>n</a><img src="{PIC}/hero" alt="the place" width=800 height=600><a href="{PIC}/g=w500-h400" title="G">g</a></html>'


def pages(spark, *html):
    return spark.createDataFrame([(i, HOST, h, "k", "r", 0, None) for i, h in enumerate(html)],
                                 "page_id bigint, url string, html string, keyword string, region string, page_no int, captured_at timestamp")


def places(spark):
    return spark.createDataFrame([("pl", HOST, HOST)], "id string, source_url string, url_key string")


def in_filters(df, name):
    """How often ``name`` stands in the filters of the optimized plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return sum(line.split("Filter ", 1)[1].count(name) for line in plan if "Filter " in line)


def test_no_filter_parses_attributes(spark):
    p = pages(spark, PAGE)
    for df in (P.review_image_urls(p), P.place_photo_entries(p.withColumn("url_key", F.lit("u"))), RV.review_blocks(p), RV.parse_review_blocks(RV.review_blocks(p)), S.listing_anchors(p),
               P.filter_photos(P.photo_candidates(p), "review")):
        assert in_filters(df, """("[^"]*"|'[^']*'|""") == 0 and df.count() > 0


def test_photos_of_blocks_without_an_id(spark):
    """``ids_only`` looks for author, date and text where the id is made of them, and gives the same photos."""
    p = pages(spark, PAGE)
    every, some = (RV.reviews_from_pages(places(spark), p, ids_only=only) for only in (False, True))
    a, b = ([(r.block_index, r.id, r.place_id) for r in df.orderBy("block_index").collect()] for df in (every, some))
    assert a == b and len({i for _, i, _ in a}) == 5
    assert [r.author_name for r in some.orderBy("block_index").collect()] == [None, "N2", "N5", "N3", None]
    photos = [sorted(P.review_photos(r, P.review_image_urls(p)).drop("scraped_at").collect()) for r in (every, some)]
    assert photos[0] == photos[1] and [r.image_url[-1] for r in sorted(photos[0], key=lambda r: r.image_url)] == list("12345")


def test_whitespace_sets(spark):
    """The reordered classes hold the same characters."""
    plain = "[" + T.WS_CHARS + "]"
    chars = spark.createDataFrame([(chr(i),) for i in range(1, 0x10400) if not 0xD800 <= i < 0xE000], "c string")
    odd = chars.where((F.col("c").rlike(plain) != F.col("c").rlike(T.WS)) | (F.col("c").rlike(plain) == F.col("c").rlike(T.NOT_WS)))
    assert odd.count() == 0 and chars.where(F.col("c").rlike(T.WS)).count() == 25
    names = chars.where(F.col("c").rlike("^[^" + T.WS_CHARS + "=/>]$") != (F.regexp_extract("c", H.ATTR_RE, 1) != ""))
    values = chars.where(F.col("c").rlike("^[^" + T.WS_CHARS + "\"'=<>`]$") != (F.regexp_extract(F.concat(F.lit("a="), "c"), H.ATTR_RE, 2) != ""))
    assert names.count() == 0 and values.count() == 0


def test_text_that_needs_no_collapsing(spark):
    cases = {"": "", " ": "", "  ": "", " a b ": "a b", "a  b": "a b", "a b ": "a b", "\ta \n b": "a b", "a \u0085": "a\u0085", "ä·ö": "ä·ö", "a b": "a b", None: None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.normalize_ws("t").alias("x"), T.normalize_ws(F.concat("t", F.lit(""))).alias("y")).collect()
    assert {r.t: r.x for r in rows} == cases and {r.t: r.y for r in rows} == cases


BITS = ['<article data-review-id="x">', "<ARTICLE data-review-id='y' z>", "<article>", '<article data-review-id="">', '<article data-review-id="q', "</article>", "</Article>", "<articles>", "text", "\n", "é", '"', ">", "<img a>"]


def test_blocks_are_left_out_as_by_the_plain_pattern(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))) for i in range(3000)]
    plain = re.compile(r"""<article(?![A-Za-z0-9_])[^>]*data-review-id=["'][^"']+["'][\s\S]*?</article>""", re.I)
    got = hops.strip_review_blocks(spark.createDataFrame(rows, "i int, html string")).collect()
    want = {i: plain.sub(" ", html) for i, html in rows}
    assert {r.i: r.html for r in got} == want and sum(want[i] != html for i, html in rows) > 300


WORDS = ["avatar", "AVATAR", "user  photo", "user icon", "photos", "Photo", "drinK", "dish", "data-PHOTO-id", "profile", "reviewers", "https://LH3.Googleusercontent.com/x", "x", "=w90", "-h151", "_menu", "author"]


def test_photo_rule_equals_the_plain_patterns(spark):
    rng = random.Random(9)
    some = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 2))) or None
    rows = [(i, some(), some(), some() or "", some() or "x", some(), rng.choice([None, 100, 128, 155, 300]), rng.choice([None, 100, 151, 400])) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, context_alt string, title_text string, raw string, image_url string, thumbnail_url string, width bigint, height bigint")

    def plain(kind):
        ctx = F.lower(F.concat_ws(" ", "context_alt", "title_text", "raw", "image_url", "thumbnail_url"))
        w, h = (F.coalesce(F.col(c), P.url_dimension("image_url", c[0]), P.url_dimension("thumbnail_url", c[0])) for c in ("width", "height"))
        small = F.coalesce((w <= 128) & (h <= 128) & (F.abs(w - h) <= 24), F.lit(False))
        word = ctx.rlike(P.PHOTO_WORDS_RE)
        return (F.when(F.coalesce(w <= 150, F.lit(False)) | F.coalesce(h <= 150, F.lit(False)), False)
                .when(F.col("raw").rlike("(?i)data-photo-url|data-thumbnail-url|data-photo-index|data-photo-id"), True)
                .when(ctx.rlike(P.PROFILE_WORDS_RE) | F.col("image_url").rlike("(?i)avatar|profile|userphoto|reviewer"), False).when(small & ~word, False)
                .when(~F.col("image_url").rlike(r"(?i)googleusercontent\.com|lh3\.googleusercontent\.com"), False)
                .otherwise(~small if kind == "place" else word | w.isNull() | h.isNull() | (w >= 160) | (h >= 160)))

    for kind in ("place", "review"):
        got = df.select(P.keep_photo(kind).alias("a"), plain(kind).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got] and 0 < sum(r.a for r in got) < len(got)


def test_blocks_behind_the_limit_are_not_parsed(spark):
    """The limit of a place is taken on its pages first; the rows are those of a cut afterwards."""
    p = pages(spark, PAGE, PAGE.replace("N1", "M1"))
    cut = RV.reviews_from_pages(places(spark), pages(spark, PAGE), 2)
    whole = RV.limit_reviews(RV.reviews_from_pages(places(spark), pages(spark, PAGE)), 2)
    assert sorted(tuple(r) for r in cut.collect()) == sorted(tuple(r) for r in whole.collect()) and cut.count() == 2
    assert RV.reviews_from_pages(places(spark), p, 3).count() == 3 and RV.reviews_from_pages(places(spark), p, 0).count() == 1
    assert "slice(filter(transform(" in cut._jdf.queryExecution().optimizedPlan().toString()
    assert RV.review_blocks(p, limit=2).count() == 4
