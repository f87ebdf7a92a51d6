"""Listing jobs (O02, O20-O56) over pages rendered from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import safe_trim
from ..operators import html as hops
from ..operators import photos as P
from ..operators import places as PL
from ..operators import reviews as RV
from ..operators import search as S
from ..sources import render as R
from ..sources.tables import table
from . import listing_sql as L
from .registry import query
from .sqlkit import D_WS, sid

PIPELINE_PLACES = 25   # default places per keyword
PIPELINE_REVIEWS = 20  # default reviews per place


def search_results_df(spark, sf, limit=None):
    return S.search_results(R.stored(spark, sf, 'search_pages'), limit, R.segments(spark, sf))


def place_fields_df(spark, sf, only=None):
    return PL.place_page_fields(R.stored(spark, sf, 'place_pages'), only=only)


def places_df(spark, sf, limit=None, only=None):
    return PL.places(search_results_df(spark, sf, limit), place_fields_df(spark, sf, only))


# the page fields that make a place's id (source URL, name, region)
ID_FIELDS = ("j.name", "meta_title", "title_text", "canonical")


def place_select(df):
    return df.select(
        "id", "search_result_id", "search_keyword", "region", "name", "category", "address",
        F.col("coordinates.lat").alias("lat"), F.col("coordinates.lng").alias("lng"), "rating", "review_count",
        "price_level", "phone", "website", "description", "source_url", "search_url", "raw_title", "raw_label",
        F.array_join("keywords", "|").alias("keywords"))


# ---------------- O02 ----------------
SEED_REGION = "  Middle   East "


@query("search_seeds", oracle=f"""
WITH kw AS (
  SELECT p_partkey AS line, pos, {L.__name__ and ''}trim(regexp_replace(w, '{D_WS}+', ' ', 'g')) AS keyword
  FROM (SELECT p_partkey, unnest(string_split_regex(p_type || ',' || p_brand, '[,;\\n]+')) AS w,
               generate_subscripts(string_split_regex(p_type || ',' || p_brand, '[,;\\n]+'), 1) AS pos FROM part)),
f AS (SELECT keyword, min(line * 100 + pos) AS first FROM kw WHERE keyword <> '' GROUP BY keyword)
SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS keyword_index, keyword, 'Middle East' AS region,
       'https://www.google.com/maps/search/' || replace(replace(keyword || ' Middle East', '#', '%23'), ' ', '%20') AS search_url
FROM f""")
def q_search_seeds(spark, sf):
    kw = table(spark, sf, "part", "p_partkey", "p_type", "p_brand").select(
        F.col("p_partkey").alias("line_no"), F.concat_ws(",", "p_type", "p_brand").alias("text"))
    return S.build_search_seeds(kw, SEED_REGION)


# ---------------- O20-O24 ----------------
@query("listing_links", oracle=f"""
WITH {L.search_ctes()}
SELECT keyword, region, place_url, raw_label FROM ranked
UNION ALL SELECT keyword, region, place_url, raw_label FROM ranked WHERE k % 5 = 0""")
def q_listing_links(spark, sf):
    return S.listing_anchors(R.stored(spark, sf, 'search_pages')).select("keyword", "region", "place_url", "raw_label")


@query("dedup_links", oracle=f"""
WITH {L.search_ctes()}
SELECT keyword, region, place_url, raw_label FROM ranked""")
def q_dedup_links(spark, sf):
    links = S.listing_anchors(R.stored(spark, sf, 'search_pages'))
    return S.dedup_links(links, payload=("raw_label",)).select("keyword", "region", "place_url", "raw_label")


@query("rank_limit", oracle=f"""
WITH {L.search_ctes(PIPELINE_PLACES)}
SELECT keyword, region, place_url, rank FROM sr""")
def q_rank_limit(spark, sf):
    links = S.listing_anchors(R.stored(spark, sf, 'search_pages'))
    return S.rank_and_limit(S.dedup_links(links), PIPELINE_PLACES).select("keyword", "region", "place_url", "rank")


@query("parse_labels", oracle=f"""
WITH {L.search_ctes()}
SELECT keyword, region, place_url, name AS title, category, rating, review_count, snippet FROM ranked""")
def q_parse_labels(spark, sf):
    links = S.dedup_links(S.listing_anchors(R.stored(spark, sf, 'search_pages')), payload=("raw_label",))
    return S.parse_result_labels(links).select("keyword", "region", "place_url", F.col("parsed_title").alias("title"),
                                               "category", "rating", "review_count", "snippet")


SR_COLS = "id, keyword, region, title, place_url, category, rating, review_count, snippet, rank, raw_label, keyword_index"


@query("search_results", oracle=f"""
WITH {L.search_ctes()}
SELECT id, keyword, region, name AS title, place_url, category, rating, review_count, snippet, rank, raw_label, keyword_index
FROM sr""")
def q_search_results(spark, sf):
    return search_results_df(spark, sf).select(*[c.strip() for c in SR_COLS.split(",")])


# ---------------- O30-O38 ----------------
@query("results_pages_join", oracle=f"""
WITH {L.search_ctes()}
SELECT keyword, region, rank, place_url, k AS place_page_id, true AS page_found FROM sr""")
def q_results_pages_join(spark, sf):
    j = PL.join_results_to_pages(search_results_df(spark, sf), place_fields_df(spark, sf), "left")
    return j.select("keyword", "region", "rank", "place_url", "place_page_id", "page_found")


@query("jsonld_objects", oracle=f"""
WITH {L.CUST}
SELECT k AS page_id, 0 AS pos, name, 'https://schema.org' AS context, CAST(k AS VARCHAR) || ' Main St' AS street FROM cf WHERE k % 3 = 1
UNION ALL SELECT k, 0, NULL, 'https://schema.org', NULL FROM cf WHERE k % 3 = 2
UNION ALL SELECT k, 1, name, NULL, NULL FROM cf WHERE k % 3 = 2""")
def q_jsonld_objects(spark, sf):
    o = hops.extract_jsonld(R.stored(spark, sf, 'place_pages'))
    return o.select("page_id", "pos", H.v_string(H.vget("value", "name")).alias("name"), H.v_string(H.vget("value", "@context")).alias("context"),
                    F.try_variant_get("value", "$.address.streetAddress", "string").alias("street"))


@query("jsonld_place", oracle=f"""
WITH {L.CUST}
SELECT k AS page_id, CASE WHEN k % 3 <> 0 THEN name END AS name,
  CASE WHEN k % 3 = 1 THEN seg END AS category,
  CASE WHEN k % 3 = 1 THEN CAST(k AS VARCHAR) || ' Main St, ' || nat || ', ' || reg END AS address,
  CASE WHEN k % 3 <> 0 THEN CAST(lat AS DOUBLE) END AS lat, CASE WHEN k % 3 <> 0 THEN CAST(lng AS DOUBLE) END AS lng,
  CASE WHEN k % 3 <> 0 THEN CAST(k % 41 AS DOUBLE) / 10 END AS rating,
  CASE WHEN k % 3 <> 0 THEN CAST(k * 3 AS BIGINT) END AS review_count,
  CASE k % 3 WHEN 1 THEN repeat('$', CAST(k % 4 + 1 AS INTEGER)) WHEN 2 THEN '$$$' END AS price_level,
  CASE WHEN k % 3 = 1 THEN name || ' and friends' END AS description
FROM cf""")
def q_jsonld_place(spark, sf):
    f = place_fields_df(spark, sf)
    return f.select("page_id", F.col("p.j.name").alias("name"), F.col("p.j.category").alias("category"),
                    F.col("p.j.address").alias("address"), F.col("p.j.coords.lat").alias("lat"),
                    F.col("p.j.coords.lng").alias("lng"), F.col("p.j.rating").alias("rating"),
                    F.col("p.j.review_count").alias("review_count"), F.col("p.j.price_level").alias("price_level"),
                    F.col("p.j.description").alias("description"))


@query("meta_and_links", oracle=f"""
WITH {L.CUST}
SELECT k AS page_id, CASE WHEN k % 3 <> 0 THEN name END AS og_title, seg || ' in ' || nat || ' City' AS description,
  CASE WHEN k % 3 <> 0 THEN canon END AS canonical, CASE WHEN k % 3 = 2 THEN CAST(k AS VARCHAR) || ' Side Rd, ' || nat END AS street
FROM cf""")
def q_meta_and_links(spark, sf):
    pages = R.stored(spark, sf, 'place_pages')
    a = hops.extract_meta(pages, PL.TITLE_META, out="og_title")
    b = hops.extract_meta(pages, PL.DESC_META, out="description")
    c = hops.extract_link_href(pages, "canonical", out="canonical")
    d = hops.extract_meta(pages, PL.ADDRESS_META, out="street")
    return a.join(b, "page_id").join(c, "page_id").join(d, "page_id")


@query("place_contacts", oracle="""
SELECT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 0 THEN '+1-555-' || CAST(c_custkey AS VARCHAR) END AS phone,
  CASE WHEN c_custkey % 5 <> 0 THEN 'https://site' || CAST(c_custkey AS VARCHAR) || '.example.com/'
       WHEN c_custkey % 2 = 1 THEN 'https://alt' || CAST(c_custkey AS VARCHAR) || '.example.com/' END AS website
FROM customer""")
def q_place_contacts(spark, sf):
    return place_fields_df(spark, sf, ("phone", "website")).select("page_id", F.col("p.phone").alias("phone"), F.col("p.website").alias("website"))


def _place_query(cols, only):
    def fn(spark, sf):
        return place_select(places_df(spark, sf, only=(*ID_FIELDS, *only))).select(*cols)
    return fn


for _name, _cols, _only in (
    ("place_address", ["search_result_id", "address"], ("j.address", "html_address", "address_text")),
    ("place_rating", ["search_result_id", "rating", "review_count"], ("j.rating", "j.review_count", "rc_page")),
    ("place_coords", ["search_result_id", "lat", "lng"], ("j.coords",)),
):
    query(_name, oracle=f"WITH {L.place_ctes()}\nSELECT id AS search_result_id, "
          + ", ".join({"address": "address", "rating": "p_rating AS rating", "review_count": "p_review_count AS review_count",
                       "lat": "p_lat AS lat", "lng": "p_lng AS lng"}[c] for c in _cols[1:]) + " FROM pl")(_place_query(_cols, _only))


@query("places", oracle=f"WITH {L.place_ctes()}\nSELECT {L.PLACE_COLS} FROM pl")
def q_places(spark, sf):
    return place_select(places_df(spark, sf))


@query("dedup_places", oracle=f"WITH {L.place_ctes(dedup=True)}\nSELECT {L.PLACE_COLS} FROM pd")
def q_dedup_places(spark, sf):
    return place_select(PL.dedup_places(places_df(spark, sf)))


@query("places_from_results", oracle=f"""
WITH {L.search_ctes()}
SELECT {sid('place_url', 'name', 'region')} AS id, id AS search_result_id, keyword AS search_keyword, region, name,
  category, rating, review_count, place_url AS source_url, raw_label, keyword || '|' || region || '|' || name AS keywords
FROM sr""")
def q_places_from_results(spark, sf):
    p = PL.places_from_results(search_results_df(spark, sf))
    return p.select("id", "search_result_id", "search_keyword", "region", "name", "category", "rating",
                    "review_count", "source_url", "raw_label", F.array_join("keywords", "|").alias("keywords"))


# ---------------- O40-O43 ----------------
@query("review_blocks", oracle="""
SELECT o_custkey AS page_id, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 0 END AS INTEGER) AS tag_ordinal,
       CASE WHEN o_orderkey % 10 = 2 THEN '' ELSE 'o' || CAST(o_orderkey AS VARCHAR) END AS review_id
FROM orders""")
def q_review_blocks(spark, sf):
    b = RV.review_blocks(R.stored(spark, sf, 'place_pages'))
    return b.select("page_id", F.col("tag_ordinal").cast("int").alias("tag_ordinal"),
                    H.attr("attrs", "data-review-id").alias("review_id"))


REVIEW_OUT = ["id", "place_id", "place_url", "author_name", "author_profile_url", "rating", "published_at", "text",
              "translated_text", "likes", "source_url", "raw_label"]


def linked_places_df(spark, sf):
    """The de-duplicated places by what reviews and photos are attached to; other place fields are not extracted."""
    return PL.dedup_places(places_df(spark, sf, only=ID_FIELDS).select("id", "region", "source_url", "url_key", "place_page_id", "keyword_index", "rank"))


def reviews_df(spark, sf, limit=None, ids_only=False):
    pl = linked_places_df(spark, sf)
    return RV.reviews_from_pages(pl, R.stored(spark, sf, 'place_pages'), limit, ids_only)


@query("reviews", oracle=f"WITH {L.review_ctes()}\nSELECT {L.REVIEW_COLS} FROM rv")
def q_reviews(spark, sf):
    return reviews_df(spark, sf).select(*REVIEW_OUT)


@query("limit_reviews", oracle=f"WITH {L.review_ctes(PIPELINE_REVIEWS)}\nSELECT {L.REVIEW_COLS} FROM rv")
def q_limit_reviews(spark, sf):
    return reviews_df(spark, sf, PIPELINE_REVIEWS).select(*REVIEW_OUT)


@query("normalize_reviews", oracle=f"""
WITH {L.place_ctes(dedup=True)},
raw AS (
  SELECT pd.pid AS place_id, pd.source_url AS psrc, o_orderkey AS o,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'https://reviews.example.com/' || CAST(o_orderkey AS VARCHAR) END AS src,
    'Customer ' || CAST(o_custkey AS VARCHAR) AS author, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority AS pri
  FROM orders JOIN pd ON o_custkey = pd.k)
SELECT CASE WHEN o % 2 = 1 THEN 'o' || CAST(o AS VARCHAR)
            ELSE {sid('place_id', 'coalesce(src, psrc)', 'author', 'd', 'pri')} END AS id,
  place_id, psrc AS place_url, author AS author_name, CAST(o % 6 AS DOUBLE) AS rating, d AS published_at, pri AS text,
  CAST(o % 1000 AS BIGINT) * 1000 + 7 AS likes, coalesce(src, psrc) AS source_url, 'a|b' AS photo_ids
FROM raw""")
def q_normalize_reviews(spark, sf):
    pl = linked_places_df(spark, sf)
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    link = pl.select(F.col("id").alias("place_id"), F.col("place_page_id"))
    ok = F.col("o_orderkey")
    raw = o.join(link, o.o_custkey == link.place_page_id).select(
        "place_id",
        F.when(ok % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("https://reviews.example.com/"), ok.cast("string"))).alias("source_url"),
        F.concat(F.lit("  Customer \t"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("author_name"),
        F.lit(None).cast("string").alias("author_profile_url"),
        F.concat(F.lit(" "), (ok % 6).cast("string"), F.lit(".0 ")).alias("rating"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"),
        F.concat(F.lit("\n"), F.col("o_orderpriority"), F.lit("  ")).alias("text"),
        F.lit(None).cast("string").alias("translated_text"),
        F.concat(F.format_number(ok % 1000, 0), F.lit(",007")).alias("likes"),
        F.array(F.lit(" a"), F.lit("b"), F.lit("a "), F.lit(" ")).alias("photo_ids"),
        F.when(ok % 2 == 1, F.concat(F.lit("o"), ok.cast("string"))).alias("id"),
    )
    n = RV.normalize_reviews(pl, raw)
    return n.select("id", "place_id", "place_url", "author_name", "rating", "published_at", "text", "likes",
                    "source_url", F.array_join("photo_ids", "|").alias("photo_ids"))


# ---------------- O50-O56 ----------------
def _photo_pages(spark, sf):
    return R.stored(spark, sf, 'photo_pages')


@query("strip_reviews", oracle="""
SELECT p_partkey AS page_id, CAST(1 + (p_partkey % 4 = 0)::INT + (p_partkey % 6 = 0)::INT + (p_partkey % 7 = 0)::INT AS BIGINT) AS n_img
FROM part""")
def q_strip_reviews(spark, sf):
    s = hops.strip_review_blocks(_photo_pages(spark, sf))
    return s.select("page_id", F.size(F.regexp_extract_all("html", F.lit(H.void_pattern("img")), 0)).cast("bigint").alias("n_img"))


PHOTO_CANDS_SQL = """cand AS (
  SELECT p_partkey AS page_id, 0 AS source_ordinal, CAST(0 AS BIGINT) AS pos,
    CASE WHEN p_partkey % 2 = 0 THEN 'https://lh3.googleusercontent.com' ELSE 'https://img.example.com' END
      || '/p' || CAST(p_partkey AS VARCHAR) || '-a.jpg' AS image_url,
    CAST(p_size * 20 AS BIGINT) AS width, CAST(p_size * 15 AS BIGINT) AS height, p_name AS alt_text,
    p_partkey % 2 = 0 AS google, false AS explicit, p_size AS z FROM part
  UNION ALL
  SELECT p_partkey, 0, CAST(1 AS BIGINT), 'https://img.example.com/x' || CAST(p_partkey AS VARCHAR) || '.jpg',
    CAST(p_size * 20 AS BIGINT), CAST(p_size * 15 AS BIGINT), NULL, false, true, p_size FROM part WHERE p_partkey % 4 = 0
  UNION ALL
  SELECT p_partkey, 0, CAST(1 + (p_partkey % 4 = 0)::INT AS BIGINT),
    CASE WHEN p_partkey % 2 = 0 THEN 'https://lh3.googleusercontent.com' ELSE 'https://img.example.com' END
      || '/p' || CAST(p_partkey AS VARCHAR) || '-a.jpg',
    CAST(p_size * 20 + 7 AS BIGINT), CAST(p_size * 15 AS BIGINT), p_name || ' large', p_partkey % 2 = 0, false, p_size
  FROM part WHERE p_partkey % 6 = 0
  UNION ALL
  SELECT p_partkey, 0, CAST(1 + (p_partkey % 4 = 0)::INT + (p_partkey % 6 = 0)::INT AS BIGINT),
    'https://lh3.googleusercontent.com/r' || CAST(p_partkey AS VARCHAR) || '=w155-h155', NULL, NULL, NULL, true, false, 0
  FROM part WHERE p_partkey % 7 = 0
  UNION ALL
  SELECT p_partkey, 1, CAST(0 AS BIGINT),
    'https://lh3.googleusercontent.com/g' || CAST(p_partkey AS VARCHAR) || '=w' || CAST(p_size * 10 AS VARCHAR) || '-h' || CAST(p_size * 10 AS VARCHAR),
    NULL, NULL, NULL, true, false, p_size FROM part WHERE p_partkey % 5 = 0)"""

# dimension used by the rule: attributes, else the URL (=w/-h) of the r/g links
RULE_DIMS = """CASE WHEN image_url LIKE '%=w155-h155' THEN 155 WHEN source_ordinal = 1 THEN z * 10 ELSE width END AS rw,
  CASE WHEN image_url LIKE '%=w155-h155' THEN 155 WHEN source_ordinal = 1 THEN z * 10 ELSE height END AS rh"""


@query("photo_candidates", oracle=f"WITH {PHOTO_CANDS_SQL}\nSELECT page_id, source_ordinal, pos, image_url, width, height FROM cand")
def q_photo_candidates(spark, sf):
    s = hops.strip_review_blocks(_photo_pages(spark, sf))
    c = P.photo_candidates(s)
    return c.select("page_id", F.col("source_ordinal").cast("int").alias("source_ordinal"),
                    F.col("pos").cast("bigint").alias("pos"), "image_url", "width", "height")


def _kept_sql(kind):
    tail = "true" if kind == "place" else "(rw >= 160 OR rh >= 160)"
    return f"""WITH {PHOTO_CANDS_SQL}, d AS (SELECT cand.*, {RULE_DIMS} FROM cand)
SELECT page_id, source_ordinal, pos, image_url, width, height FROM d
WHERE NOT (rw <= 150 OR rh <= 150) AND (explicit OR (google AND {tail}))"""


@query("filter_photos", oracle=_kept_sql("review"))
def q_filter_photos(spark, sf):
    c = P.photo_candidates(hops.strip_review_blocks(_photo_pages(spark, sf)))
    return P.filter_photos(c, "review").select(
        "page_id", F.col("source_ordinal").cast("int").alias("source_ordinal"), F.col("pos").cast("bigint").alias("pos"),
        "image_url", "width", "height")


DEDUP_SQL = _kept_sql("place").replace("SELECT page_id, source_ordinal, pos, image_url, width, height FROM d", """, k AS (
SELECT page_id, source_ordinal, pos, image_url, width, height, alt_text FROM d""") + """)
SELECT page_id, image_url, min(source_ordinal * 1000 + pos) AS first_pos, arg_max(width, source_ordinal * 1000 + pos) AS width,
       arg_max(alt_text, source_ordinal * 1000 + pos) AS alt_text
FROM k GROUP BY page_id, image_url"""


@query("dedup_photos", oracle=DEDUP_SQL)
def q_dedup_photos(spark, sf):
    c = P.photo_candidates(hops.strip_review_blocks(_photo_pages(spark, sf)))
    d = P.dedup_photos(P.filter_photos(c, "place"))
    return d.select("page_id", "image_url", (F.col("source_ordinal") * 1000 + F.col("pos")).cast("bigint").alias("first_pos"),
                    "width", "alt_text")


@query("exclude_photos", oracle=f"""SELECT * FROM ({DEDUP_SQL})
WHERE NOT (page_id % 3 = 0 AND image_url = CASE WHEN page_id % 2 = 0 THEN 'https://lh3.googleusercontent.com'
  ELSE 'https://img.example.com' END || '/p' || CAST(page_id AS VARCHAR) || '-a.jpg')""")
def q_exclude_photos(spark, sf):
    c = P.photo_candidates(hops.strip_review_blocks(_photo_pages(spark, sf)))
    d = P.dedup_photos(P.filter_photos(c, "place"))
    part = table(spark, sf, "part", "p_partkey").filter(F.col("p_partkey") % 3 == 0)
    urls = part.select(F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("https://lh3.googleusercontent.com"))
                                .otherwise(F.lit("https://img.example.com")), F.lit("/p"),
                                F.col("p_partkey").cast("string"), F.lit("-a.jpg")).alias("image_url"))
    return P.exclude_photos(d, urls).select(
        "page_id", "image_url", (F.col("source_ordinal") * 1000 + F.col("pos")).cast("bigint").alias("first_pos"),
        "width", "alt_text")


PHOTO_OUT = ["id", "place_id", "place_url", "review_id", "review_url", "photo_kind", "image_url", "thumbnail_url",
             "alt_text", "width", "height", "source_url"]


@query("place_photos", oracle=f"""WITH {L.place_ctes(dedup=True)},
ph AS (
  SELECT pid, source_url, 'https://lh3.googleusercontent.com/p/' || CAST(k AS VARCHAR) || '-hero=w800-h600' AS image_url,
    'https://lh3.googleusercontent.com/p/' || CAST(k AS VARCHAR) || '-hero=w800-h600' AS thumbnail_url,
    name || ' photo' AS alt_text, CAST(800 AS BIGINT) AS width, CAST(600 AS BIGINT) AS height FROM pd
  UNION ALL
  SELECT pid, source_url, 'https://lh3.googleusercontent.com/p/' || CAST(k AS VARCHAR) || '-gallery=w1024-h768', NULL, 'Gallery',
    NULL, NULL FROM pd WHERE k % 4 = 0
  UNION ALL
  SELECT pid, source_url, 'https://lh3.googleusercontent.com/rp/' || CAST(o_orderkey AS VARCHAR) || '.jpg', NULL, 'dish photo',
    640, 480 FROM pd JOIN orders ON o_custkey = pd.k WHERE o_orderkey % 3 = 0 AND o_orderkey % 10 IN (0, 2))
SELECT {sid('pid', 'image_url')} AS id, pid AS place_id, source_url AS place_url, CAST(NULL AS VARCHAR) AS review_id,
  CAST(NULL AS VARCHAR) AS review_url, 'place' AS photo_kind, image_url, thumbnail_url, alt_text, width, height, source_url
FROM ph""")
def q_place_photos(spark, sf):
    pl = linked_places_df(spark, sf)
    return P.place_photos(pl, R.stored(spark, sf, 'place_pages')).select(*PHOTO_OUT)


@query("review_photos", oracle=f"""WITH {L.review_ctes()},
rp AS (SELECT *, CASE WHEN o % 10 = 2 THEN {sid('place_id', 'pname', 'd', 'pri', 'idx')} ELSE 'o' || CAST(o AS VARCHAR) END AS rid,
         'https://lh3.googleusercontent.com/rp/' || CAST(o AS VARCHAR) || '.jpg' AS image_url FROM rv WHERE o % 3 = 0)
SELECT {sid('place_id', 'rid', 'image_url')} AS id, place_id, src AS place_url, rid AS review_id, src AS review_url, 'review' AS photo_kind,
  image_url, CAST(NULL AS VARCHAR) AS thumbnail_url, CAST(NULL AS VARCHAR) AS alt_text, CAST(NULL AS BIGINT) AS width,
  CAST(NULL AS BIGINT) AS height, src AS source_url FROM rp""")
def q_review_photos(spark, sf):
    return P.review_photos(reviews_df(spark, sf, ids_only=True), P.review_image_urls(R.stored(spark, sf, 'place_pages'))).select(*PHOTO_OUT)
