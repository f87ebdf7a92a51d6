"""Page fields that a query does not read are not extracted, and lookups on a shared cut equal those on the text."""

from pyspark.sql import functions as F

from pagesift.functions import html as H
from pagesift.operators import places as PL

PAGE = ('<html><head><title>A - Google Maps</title><script type="application/ld+json">{"name":"A","address":"x"}</script></head><body>'
        '<A HREF="tel:+1">Call</a><a href="https://a.example.com/">W</a><div data-website="https://b.example.com/">S</div>'
        '<article data-review-id="r1"><p data-review-text>t</p></article><li data-review-id="r2">u</li><p>4.5 stars · 10 reviews</p></body></html>')


def _pages(spark):
    return spark.createDataFrame([(1, "https://www.google.com/maps/place/A", PAGE, None), (2, "https://www.google.com/maps/place/B", "<p>no tags < </p", None), (3, None, None, None)],
                                 "page_id bigint, url string, html string, captured_at timestamp")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_join_that_reads_no_field_parses_no_page(spark):
    results = spark.createDataFrame([("https://www.google.com/maps/place/A?x=1",), ("https://www.google.com/maps/place/C",)], "place_url string")
    joined = PL.join_results_to_pages(results, PL.place_page_fields(_pages(spark)), "left").select("place_url", "place_page_id", "page_found")
    assert "ld\\+json" not in _plan(joined) and "tag" not in _plan(joined)
    assert sorted(tuple(r) for r in joined.collect()) == [("https://www.google.com/maps/place/A?x=1", 1, True), ("https://www.google.com/maps/place/C", None, False)]


def test_chosen_fields_equal_those_of_all(spark):
    every = PL.place_page_fields(_pages(spark)).select("page_id", "p.*")
    some = PL.place_page_fields(_pages(spark), only=("phone", "website")).select("page_id", "p.*")
    assert some.schema.names == every.schema.names and "ld\\+json" not in _plan(some)
    a, b = ({r.page_id: r for r in df.collect()} for df in (every, some))
    assert [(b[i].phone, b[i].website) for i in a] == [(a[i].phone, a[i].website) for i in a]
    assert (a[1].phone, a[1].website, a[1].j.name, a[1].rc_page.rating, b[1].title_text, b[1].rc_page) == ("+1", "https://a.example.com/", "A", 4.5, None, None)


def test_a_shared_cut_equals_the_text(spark):
    def found(source):
        return F.struct(H.elements_of(source, ("article", "div", "li"), "data-review-id").alias("blocks"), H.element_array(source, "a").alias("a"), H.open_tags(source, "p").alias("p"))

    rows = _pages(spark).select(found("html").alias("plain"), found(H.Pieces(H.cut("html"))).alias("cut")).collect()
    assert all(r.plain == r.cut for r in rows)
    assert [(e.tag_ordinal, e.pos, e.open, e.inner, e.close) for e in rows[0].cut.blocks] == [
        (0, 0, '<article data-review-id="r1">', "<p data-review-text>t</p>", "</article>"), (2, 0, '<li data-review-id="r2">', "u", "</li>")]
