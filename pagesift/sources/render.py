"""Listing pages rendered from the given relational tables (test and bench input).

Every page is built with plain ``concat`` from base columns, so an SQL oracle can
compute the expected extraction results from the same base columns without
parsing any HTML.  Rendering is a Spark job over the given tables: its size grows
with them.  Every page is bounded: a search page holds the listings of one
(keyword, region, chunk of ``CHUNK`` customer keys); a place page one customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.urls import search_url
from .tables import table

CHUNK = 1000  # customer keys per search page snapshot
BASE_TS = "2024-01-01 00:00:00"


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def r10(c) -> F.Column:
    """k -> 'k div 10 . k mod 10' (no float formatting involved)."""
    return F.concat(_s(F.floor(c / 10)), F.lit("."), _s(c % 10))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of the listing jobs: the distinct market segments, alphabetical,
    with keyword_index and the next segment (cyclic).  Five rows by definition."""
    d = table(spark, sf_dir, "customer", "c_mktsegment").distinct().withColumnRenamed("c_mktsegment", "keyword")
    w = Window.orderBy("keyword")
    return d.select(
        "keyword",
        (F.row_number().over(w) - 1).cast("int").alias("keyword_index"),
        F.coalesce(F.lead("keyword").over(w), F.first("keyword").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_keyword"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    k = F.col("c_custkey")
    lat = F.concat(_s(k % 90), F.lit(".5"))
    lng = F.concat(_s(k % 180), F.lit(".25"))
    slug = F.replace(F.col("c_name"), F.lit("#"), F.lit("+"))
    path = F.concat(F.lit("/maps/place/"), slug, F.lit("/@"), lat, F.lit(","), lng, F.lit(",17z"))
    return (
        c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        .select(
            k.alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"),
            F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nat"), F.col("r_name").alias("reg"),
            lat.alias("lat"), lng.alias("lng"),
            F.concat(F.lit("https://www.google.com"), path).alias("canon"),
            F.concat(
                F.when(k % 2 == 0, F.concat(F.lit("https://www.google.com"), path)).otherwise(path),
                F.when(k % 4 == 1, F.lit("?hl=en")).otherwise(F.lit("")),
            ).alias("href"),
        )
    )


def _label_anchor(k, name, seg) -> F.Column:
    r = r10(k % 51)
    cnt = F.format_number(k * 37, 0)
    full = F.concat(name, F.lit(" · "), seg, F.lit(" · "), r, F.lit(" stars · "), cnt, F.lit(" reviews"))
    aria = F.when(k % 17 == 0, F.concat(full, F.lit(" · Open 24 hours"))).otherwise(full)
    attrs = (
        F.when(k % 11 == 0, F.concat(F.lit(' title="'), name, F.lit(" · "), seg, F.lit('"')))
        .when(k % 13 == 0, F.lit(""))
        .otherwise(F.concat(F.lit(' aria-label="'), aria, F.lit('"')))
    )
    inner = F.when((k % 13 == 0) & (k % 11 != 0), F.concat(F.lit("<span>"), name, F.lit("</span>"))).otherwise(name)
    return attrs, inner


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per (keyword = segment, region = nation, chunk of customer keys).

    Listings in customer-key order; every 5th link repeated; every 7th preceded
    by a non-listing link; every 10th customer also listed under the next segment.
    """
    seg = segments(spark, sf_dir)
    cust = customers(spark, sf_dir)
    own = cust.withColumn("listed_seg", F.col("seg"))
    extra = (cust.filter(F.col("k") % 10 == 0).join(seg.select(F.col("keyword").alias("seg"), "next_keyword"), "seg")
             .withColumn("listed_seg", F.col("next_keyword")).drop("next_keyword"))
    rows = own.unionByName(extra)
    k = F.col("k")
    attrs, inner = _label_anchor(k, F.col("name"), F.col("seg"))
    anchor = F.concat(F.lit('<a href="'), F.col("href"), F.lit('"'), attrs, F.lit(">"), inner, F.lit("</a>"))
    entry = F.concat(
        F.when(k % 7 == 0, F.concat(F.lit('<a href="/maps/search/'), F.replace(F.col("name"), F.lit("#"), F.lit("+")),
                                    F.lit('">Search</a>'))).otherwise(F.lit("")),
        anchor,
        F.when(k % 5 == 0, anchor).otherwise(F.lit("")),
    )
    # dealt by page before anything is rendered: the customers may be a single split
    dealt = rows.select("*", F.col("listed_seg").alias("keyword"), F.col("nat").alias("region"),
                        F.floor(k / CHUNK).cast("int").alias("page_no")).repartition("keyword", "region", "nk", "page_no")
    pages = (
        dealt.select("keyword", "region", "nk", "page_no", k, entry.alias("entry"))
        .groupBy("keyword", "region", "nk", "page_no")
        .agg(F.array_sort(F.collect_list(F.struct("k", "entry"))).alias("entries"))
        .join(seg.select("keyword", "keyword_index"), "keyword")
    )
    body = F.array_join(F.transform("entries", lambda e: e["entry"]), "")
    html = F.concat(F.lit("<html><head><title>"), F.col("keyword"), F.lit(" in "), F.col("region"),
                    F.lit("</title></head><body><div role=\"feed\">"), body, F.lit("</div></body></html>"))
    return pages.select(
        (F.col("keyword_index").cast("bigint") * 1_000_000_000 + F.col("nk").cast("bigint") * 1_000_000
         + F.col("page_no")).alias("page_id"),
        F.concat(search_url(F.col("keyword"), F.col("region")), F.lit("?page="), _s("page_no")).alias("url"),
        html.alias("html"),
        F.lit("search").alias("kind"), "keyword", "region", "page_no",
        (F.lit(BASE_TS).cast("timestamp") + F.make_interval(secs=F.col("page_no"))).alias("captured_at"),
    )


def _review_block(o, name, d, pri) -> F.Column:
    tag = F.when(o % 10 == 0, F.lit("li")).otherwise(F.lit("article"))
    rid = F.when(o % 10 == 2, F.lit("")).otherwise(F.concat(F.lit("o"), _s(o)))
    r = r10(o % 51)
    return F.concat(
        F.lit("<"), tag, F.lit(' data-review-id="'), rid, F.lit('" aria-label="Reviewed by '), name, F.lit(" · "), r,
        F.lit(" stars · Posted on "), d, F.lit('"><span data-author-name="'), name,
        F.lit('"></span><img src="https://lh3.googleusercontent.com/a/u'), _s(o),
        F.lit('=w40-h40" alt="'), name, F.lit(' avatar" width="40" height="40"><span data-rating="'), r,
        F.lit('"></span>'),
        F.when(o % 10 != 1, F.concat(F.lit('<time datetime="'), d, F.lit('">'), d, F.lit("</time>"))).otherwise(F.lit("")),
        F.lit("<p data-review-text>"), pri, F.lit("</p>"),
        F.when(o % 3 == 0, F.concat(F.lit('<img data-photo-url="https://lh3.googleusercontent.com/rp/'), _s(o),
                                    F.lit('.jpg" alt="dish photo" width="640" height="480">'))).otherwise(F.lit("")),
        F.when(o % 4 == 0, F.concat(F.lit('<span data-like-count="'), _s(o % 97), F.lit('"></span>'))).otherwise(F.lit("")),
        F.lit("</"), tag, F.lit(">"),
    )


def place_pages(spark: SparkSession, sf_dir: str, with_reviews: bool = True) -> DataFrame:
    """One place snapshot per customer: head (three JSON-LD variants by key mod 3),
    contact links, the customer's orders as review blocks, two images."""
    cust = customers(spark, sf_dir)
    k = F.col("k")
    name = F.col("name")
    dollars = F.repeat(F.lit("$"), (k % 4 + 1).cast("int"))
    obj1 = F.concat(
        F.lit('{"@context":"https://schema.org","@type":"'), F.col("seg"), F.lit('","name":"'), name,
        F.lit('","address":{"streetAddress":"'), _s(k), F.lit(' Main St","addressLocality":"'), F.col("nat"),
        F.lit('","addressCountry":"'), F.col("reg"), F.lit('"},"geo":{"@type":"GeoCoordinates","latitude":'),
        F.col("lat"), F.lit(',"longitude":'), F.col("lng"), F.lit('},"aggregateRating":{"ratingValue":"'),
        r10(k % 41), F.lit('","reviewCount":"'), _s(k * 3), F.lit('"},"priceRange":"'), dollars,
        F.lit('","description":"'), name, F.lit(' and friends"}'),
    )
    obj2 = F.concat(
        F.lit('[{"@context":"https://schema.org"},{"@type":["'), F.col("seg"), F.lit('","Place"],"name":"'), name,
        F.lit('","address":null,"geo":{"latitude":"'), F.col("lat"), F.lit('","longitude":"'), F.col("lng"),
        F.lit('"},"aggregateRating":{"ratingValue":'), r10(k % 41), F.lit(',"reviewCount":'), _s(k * 3),
        F.lit('},"priceLevel":"'), F.repeat(F.lit("$"), (k % 3 + 1).cast("int")), F.lit('"}]'),
    )
    head = F.concat(
        F.lit("<html><head><title>"), name, F.lit(" - Google Maps</title>"),
        F.when(k % 3 != 0, F.concat(F.lit('<meta property="og:title" content="'), name, F.lit('">'))).otherwise(F.lit("")),
        F.lit('<meta name="description" content="'), F.col("seg"), F.lit(" in "), F.col("nat"), F.lit(' City">'),
        F.when(k % 3 != 0, F.concat(F.lit('<link rel="canonical" href="'), F.col("canon"), F.lit('">'))).otherwise(F.lit("")),
        F.when(k % 3 == 1, F.concat(F.lit('<script type="application/ld+json">'), obj1, F.lit("</script>")))
        .when(k % 3 == 2, F.concat(
            F.lit('<script type="application/ld+json">{"broken": </script><script type="application/ld+json">'), obj2,
            F.lit('</script><meta itemprop="streetAddress" content="'), _s(k), F.lit(" Side Rd, "), F.col("nat"),
            F.lit('">'))).otherwise(F.lit("")),
        F.lit("</head><body><h1>"), name, F.lit("</h1>"),
        F.when(k % 2 == 0, F.concat(F.lit('<a href="tel:+1-555-'), _s(k), F.lit('">Call</a>'))).otherwise(F.lit("")),
        F.when(k % 5 != 0, F.concat(F.lit('<a href="https://site'), _s(k), F.lit('.example.com/">Website</a>')))
        .when(k % 2 == 1, F.concat(F.lit('<div data-website="https://alt'), _s(k), F.lit('.example.com/">Site</div>')))
        .otherwise(F.lit("")),
        F.when(k % 4 == 0, F.concat(F.lit('<a href="https://lh3.googleusercontent.com/p/'), _s(k),
                                    F.lit('-gallery=w1024-h768" title="Gallery">Gallery</a>'))).otherwise(F.lit("")),
        F.lit("<section>"),
    )
    tail = F.concat(
        F.lit('</section><img src="https://lh3.googleusercontent.com/p/'), _s(k), F.lit('-hero=w800-h600" alt="'), name,
        F.lit(' photo" width="800" height="600"><img src="https://lh3.googleusercontent.com/a/'), _s(k),
        F.lit('-avatar=w48-h48" alt="avatar"></body></html>'),
    )
    # head and tail are rendered behind the exchange by key: the customers may be a single split
    base = cust if with_reviews else cust.repartition("k")
    if with_reviews:
        o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        blocks = (
            o.join(cust.select("k", "name"), o.o_custkey == F.col("k"))
            .select("k", F.struct(F.col("o_orderkey").alias("o"), _review_block(
                F.col("o_orderkey"), F.col("name"), F.date_format("o_orderdate", "yyyy-MM-dd"),
                F.col("o_orderpriority")).alias("b")).alias("blk"))
            .groupBy("k").agg(F.array_sort(F.collect_list("blk")).alias("blks"))
        )
        base = base.join(blocks, "k", "left")
        body = F.coalesce(F.array_join(F.transform("blks", lambda b: b["b"]), ""), F.lit(""))
    else:
        body = F.lit("")
    return base.select(
        F.col("k").cast("bigint").alias("page_id"), F.col("canon").alias("url"),
        F.concat(head, body, tail).alias("html"), F.lit("place").alias("kind"),
        F.lit(None).cast("string").alias("keyword"), F.lit(None).cast("string").alias("region"),
        F.lit(0).alias("page_no"), F.lit(BASE_TS).cast("timestamp").alias("captured_at"),
    )


def photo_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gallery page per part exercising every reachable photo rule."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    q = F.col("p_partkey")
    z = F.col("p_size")
    host = F.when(q % 2 == 0, F.lit("https://lh3.googleusercontent.com")).otherwise(F.lit("https://img.example.com"))
    first = F.concat(F.lit('<img src="'), host, F.lit("/p"), _s(q), F.lit('-a.jpg" alt="'), F.col("p_name"),
                     F.lit('" width="'), _s(z * 20), F.lit('" height="'), _s(z * 15), F.lit('">'))
    html = F.concat(
        F.lit('<html><body><div class="gallery">'), first,
        F.when(q % 4 == 0, F.concat(
            F.lit('<img data-photo-url="https://img.example.com/x'), _s(q),
            F.lit('.jpg" src="https://lh3.googleusercontent.com/t'), _s(q), F.lit("=w"), _s(z * 20), F.lit("-h"),
            _s(z * 15), F.lit('" width="'), _s(z * 20), F.lit('" height="'), _s(z * 15), F.lit('">'))).otherwise(F.lit("")),
        F.when(q % 6 == 0, F.concat(
            F.lit('<img src="'), host, F.lit("/p"), _s(q), F.lit('-a.jpg" alt="'), F.col("p_name"), F.lit(' large" width="'),
            _s(z * 20 + 7), F.lit('" height="'), _s(z * 15), F.lit('">'))).otherwise(F.lit("")),
        F.lit('<article data-review-id="r'), _s(q),
        F.lit('"><img src="https://lh3.googleusercontent.com/a/'), _s(q),
        F.lit('-avatar" width="200" height="200" alt="reviewer avatar"></article>'),
        F.when(q % 5 == 0, F.concat(
            F.lit('<a href="https://lh3.googleusercontent.com/g'), _s(q), F.lit("=w"), _s(z * 10), F.lit("-h"),
            _s(z * 10), F.lit('" aria-label="'), F.col("p_name"), F.lit('">g</a>'))).otherwise(F.lit("")),
        F.when(q % 7 == 0, F.concat(F.lit('<img src="https://lh3.googleusercontent.com/r'), _s(q),
                                    F.lit('=w155-h155">'))).otherwise(F.lit("")),
        F.lit("</div></body></html>"),
    )
    return p.select(q.cast("bigint").alias("page_id"),
                    F.concat(F.lit("https://www.google.com/maps/place/part"), _s(q)).alias("url"),
                    html.alias("html"))


_BUILDERS = {
    "search_pages": search_pages,
    "place_pages": place_pages,
    "place_heads": lambda spark, sf: place_pages(spark, sf, with_reviews=False),
    "photo_pages": photo_pages,
}
_WRITTEN: dict = {}


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rendered table ``name`` written once as parquet under the shared
    checkpoint folder and read back: later jobs start from a stored snapshot
    table (as production jobs do) instead of re-running the renderer."""
    import hashlib
    import os

    from ..session import checkpoint_dir

    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    path = _WRITTEN.get(key)
    if path is None:
        tag = hashlib.sha1(f"{key}".encode()).hexdigest()[:12]
        path = os.path.join(checkpoint_dir(spark), "rendered", f"{name}-{tag}")
        df = _BUILDERS[name](spark, sf_dir)
        # as many files as shuffle partitions that hold enough (adaptive execution keeps one a core at least): the HTML
        # scan parallelises and a task's share does not grow with the table
        df.repartition("page_id").write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(path)


def net_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured network events from ``events``: 'view' = response received,
    'click' = loading finished, others under their own names; request id = user id; seq = event id."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    recv, fin = F.col("event_type") == "view", F.col("event_type") == "click"
    eid = F.col("event_id")
    return e.select(
        F.col("user_id").cast("string").alias("request_id"),
        F.when(recv, F.lit("responseReceived")).when(fin, F.lit("loadingFinished")).otherwise(F.col("event_type")).alias("event_type"),
        "ts", eid.alias("seq"),
        F.when(recv, F.concat(F.lit("https://api.example.com/u/"), F.col("user_id").cast("string"), F.lit("/e/"),
                              eid.cast("string"))).alias("url"),
        F.when(recv, (F.lit(200) + eid % 3).cast("int")).alias("status"),
        F.when(recv, F.lit("application/json")).alias("mime_type"),
        F.when(fin, F.concat(F.lit("  "), F.col("props"), F.lit("\n "))).alias("body"),
        F.when(fin, eid % 2 == 0).alias("base64"),
        F.when(fin, eid % 13 == 0).alias("body_failed"),
    )
