"""Element matching on tag soup equals the plain pattern, and takes linear time where tags are never closed."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pagesift.functions import html as H
from pagesift.operators import html as ops

BITS = ["<p>", "<p x='1'>", "<P a=b ", "<p ", "</p>", "</P >", "</p", "text", "<pre>", "</pre>", ">", "<", "<p/>", "<p-x>", " ", "\n", '<script type="application/ld+json">',
        "<script ", "</script>", '{"a":1}', "<script>", 'type="application/ld+json"', "<li data-x>", "</li>"]
ELEMENT = r"<{0}(?![A-Za-z0-9_])([^>]*)>([\s\S]*?)</{0}\s*>"
JSONLD = r"""<script(?![A-Za-z0-9_])([^>]*)type=["']application/ld\+json["'][^>]*>([\s\S]*?)</script>"""


def test_matches_equal_the_plain_pattern(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 14)))) for i in range(6000)]
    df = spark.createDataFrame(rows, "id int, html string")
    script = H.spans("html", F.lit("(?i)<script"), F.lit(H.tag_pattern("script")), F.lit("(?i)</script>"), lambda t: t.rlike(H.JSONLD_TYPE_RE))
    got = df.select("id", F.transform(H.element_array("html", "p"), lambda e: F.struct(e["inner"], H.raw_element(e))),
                    F.transform(script, lambda e: F.struct(e["inner"], H.raw_element(e))),
                    F.transform(H.elements_of("html", ("li", "p")), lambda e: F.struct(e["tag_ordinal"], e["pos"], H.raw_element(e)))).collect()
    found = 0
    for (_, html), (_, ps, scripts, both) in zip(rows, sorted(got)):
        want = [(m[2], m[0]) for m in re.finditer(ELEMENT.format("p"), html, re.I)]
        found += len(want)
        assert [tuple(x) for x in ps] == want
        assert [tuple(x) for x in scripts] == [(m[2], m[0]) for m in re.finditer(JSONLD, html, re.I)]
        assert [tuple(x) for x in both] == [(k, i, m[0]) for k, t in enumerate(("li", "p")) for i, m in enumerate(re.finditer(ELEMENT.format(t), html, re.I))]
    assert found > 1000


MEGABYTE = 1 << 20


@pytest.mark.parametrize("bit", ["<p>", "<li x>words ", "<p ", "</p>", "<", "<img ", "<article data-review-id='a'>", "<time "])
def test_a_megabyte_of_unclosed_tags(spark, bit):
    html = (bit * (MEGABYTE // len(bit) + 1))[:MEGABYTE]
    page = spark.createDataFrame([(1, html), (2, html + "<p>end</p>")], "page_id int, html string")
    began = time.time()
    rows = page.select(F.size(H.elements_of("html", ("p", "li", "article"))), F.length(H.page_text("html")), F.size(H.open_tags("html", "img")),
                       F.length(ops.without_review_blocks("html")), F.size(H.jsonld_objects("html"))).collect()
    assert len(rows) == 2 and time.time() - began < 30  # with planning on a busy machine; the quadratic pattern takes an hour


def test_attributes(spark):
    tags = ["<a HREF='x&amp;y' b=\"1\" c=3 d e = '' href=last/>", "<a-b c=d>", "<a/b=c>", "<a>", "<a x='un\" closed>", "<a  k=v\n>"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, t string").select("i", H.open_attrs("t").alias("a")).orderBy("i").collect()
    assert [[tuple(x) for x in r.a] for r in got] == [
        [("href", "x&y"), ("b", "1"), ("c", "3"), ("d", ""), ("e", ""), ("href", "last")], [("c", "d")], [], [], [("x", ""), ("'un\"", ""), ("closed", "")], [("k", "v")]]


def test_address_test_is_linear(spark):
    """Many numbers without a street word behind them: a pattern of both goes through the rest of the text for every one."""
    from pagesift.functions.labels import looks_like_address

    cases = {"12 Main St": True, "Main St 12": False, "a12 b 3 c\nrd": True, "12345 Road": False, "12345 7 road": True, "7street": False, "7 xstreet, 8": False,
             "1 a 2 b 3 c BLVD": True, "12_ st": False, "St 5 st": True, "5.st": True, "new ward": True, "": False, None: None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", looks_like_address("t").alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases
    start = time.time()
    assert spark.range(1).select(F.repeat(F.lit("7 x "), 150_000).alias("t")).where(looks_like_address("t")).count() == 0
    assert time.time() - start < 30


def test_customers_are_dealt_before_pages_are_rendered(spark, tmp_path):
    """The customers may be one split: heads and listing entries are rendered behind an exchange."""
    from pagesift.sources import render as R

    for name, rows, schema in (("customer", [(7, "C#7", 1, "S")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
                               ("nation", [(1, "N", 2)], "n_nationkey int, n_name string, n_regionkey int"), ("region", [(2, "R")], "r_regionkey int, r_name string"),
                               ("orders", [(3, 7, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderpriority string")):
        df = spark.createDataFrame(rows, schema)
        (df if name != "orders" else df.withColumn("o_orderdate", F.lit("2024-01-02").cast("timestamp"))).write.parquet(f"{tmp_path}/{name}.parquet")
    def plan(pages):
        return pages._jdf.queryExecution().executedPlan().toString().splitlines()

    def last(lines, mark):
        return max(i for i, line in enumerate(lines) if mark in line)

    place, search = R.place_pages(spark, str(tmp_path)), R.search_pages(spark, str(tmp_path))
    assert place.count() == 1 and search.count() == 1
    assert last(plan(place), "<html><head><title>") < last(plan(place), "LeftOuter")  # above the join with the review blocks
    below = plan(search)[last(plan(search), '<a href="'):]
    assert "REPARTITION_BY_COL" in "".join(below[:next(i for i, line in enumerate(below) if "FileScan" in line)])
