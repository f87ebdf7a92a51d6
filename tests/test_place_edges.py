"""Place fallback edge cases (FIXTURES.md §2.3 additions)."""

import datetime as dt

from pagesift.operators import places as PL
from pagesift.sources.snapshots import PAGE_SNAPSHOT_SCHEMA

TS = dt.datetime(2024, 1, 1)
RES_SCHEMA = ("id string, keyword string, region string, title string, place_url string, category string, "
              "rating double, review_count bigint, snippet string, rank int, raw_label string, scraped_at timestamp, "
              "keyword_index int")


def run(spark, html, label=None, snippet=None, title="Result Title", rating=None, count=None):
    url = "https://www.google.com/maps/place/X/@1.5,2.25,17z"
    res = spark.createDataFrame([("sr", "kw", "Reg", title, url, "ResCat", rating, count, snippet, 1, label, TS, 0)],
                                RES_SCHEMA)
    pg = spark.createDataFrame([(1, url, html, "place", None, None, 0, TS)], PAGE_SNAPSHOT_SCHEMA)
    return PL.places(res, PL.place_page_fields(pg)).first()


def test_jsonld_array_after_malformed_block_and_null_address(spark):
    html = ('<script type="application/ld+json">{"broken": </script>'
            '<script type="application/ld+json">[{"@context":"x"},{"@type":["A","B"],"name":"N",'
            '"address":null,"geo":{"latitude":"3.5","longitude":4}}]</script>'
            '<meta itemprop="streetAddress" content="9 Side Rd">')
    p = run(spark, html)
    assert p.name == "N" and p.category == "ResCat"          # @type array -> result category
    assert p.address == "9 Side Rd"                          # null address -> meta itemprop
    assert (p.coordinates.lat, p.coordinates.lng) == (3.5, 4.0)


def test_numeric_name_is_not_a_place_name(spark):
    html = '<title>Page Title - Google Maps</title><script type="application/ld+json">{"name": 5, "geo": {}}</script>'
    assert run(spark, html).name == "Page Title"


def test_rating_and_count_come_from_the_first_text_having_either(spark):
    # label has only a rating; the count is only in the description -> count stays null
    html = '<meta name="description" content="88 reviews">'
    p = run(spark, html, label="X · 4.5 stars")
    assert (p.rating, p.review_count) == (4.5, None)


def test_og_description_vs_description_first_in_document(spark):
    html = '<meta property="og:description" content="first"><meta name="description" content="second">'
    assert run(spark, html).description == "first"


def test_suffix_only_title_gives_unknown_place(spark):
    assert run(spark, "<title> - Google Maps</title>").name == "Unknown place"


def test_empty_title_element_blocks_result_title_in_raw_title(spark):
    p = run(spark, "<title></title>")
    assert p.raw_title is None and p.name == "Result Title"


def test_results_without_a_page_stay_flagged_in_a_left_join(spark):
    seen, unseen = ("https://www.google.com/maps/place/%s/@1.5,2.25,17z" % n for n in ("Seen", "Unseen"))
    rows = [(n, "kw", "Reg", n, url, None, None, None, None, i, None, TS, 0)
            for i, (n, url) in enumerate([("a", seen + "?hl=en"), ("b", unseen), ("c", None)])]
    res = spark.createDataFrame(rows, RES_SCHEMA)
    pages = PL.place_page_fields(spark.createDataFrame([(7, seen, "<title>Seen</title>", "place", None, None, 0, TS)], PAGE_SNAPSHOT_SCHEMA))
    left = {r.id: (r.place_page_id, r.page_found) for r in PL.join_results_to_pages(res, pages, "left").collect()}
    assert left == {"a": (7, True), "b": (None, False), "c": (None, False)}
    assert [r.id for r in PL.join_results_to_pages(res, pages).collect()] == ["a"]
