import hashlib

from pyspark.sql import functions as F

from pagesift.functions import html as H
from pagesift.functions import text as T
from pagesift.functions.ids import slugify, stable_id
from pagesift.functions.urls import coords_from_url, encode_uri_component, resolve_url, url_key


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_whitespace_is_ecmascript(spark):
    assert one(spark, T.normalize_ws(F.lit("  a \t　 b﻿"))) == "a b"
    assert one(spark, T.safe_trim(F.lit("   "))) is None


def test_numbers(spark):
    assert one(spark, T.to_finite(F.lit(" 1,234.5 "))) == 1234.5
    assert one(spark, T.to_finite(F.lit("1.0d"))) is None
    assert one(spark, T.to_finite(F.lit("Infinity"))) is None
    assert one(spark, T.to_finite(F.lit("0x1F"))) == 31.0
    assert one(spark, T.to_int(F.lit("-4.9"))) == -4
    assert one(spark, T.to_finite(F.lit("4 .6"))) is None


def test_entities_in_order(spark):
    assert one(spark, T.decode_entities(F.lit("&amp;lt;b&gt; &#x41;&#66; &copy; &apos;"))) == "<b> AB &copy; &apos;"
    assert one(spark, T.decode_entities(F.lit("&#x110000;"))) == "&#x110000;"
    assert one(spark, T.collapse_ws(F.lit("<p>a&nbsp;<b>b</b></p>"))) == "a b"


def test_stable_id(spark):
    sep = "␟"
    expect = hashlib.sha1(("a b" + sep + sep + "3" + sep).encode()).hexdigest()[:16]
    assert one(spark, stable_id(F.lit(" a  b "), F.lit(None).cast("string"), F.lit(3))) == expect


def test_slug(spark):
    assert one(spark, slugify(F.lit("Åre & 9.Weir_"))) == "åre-9-weir"
    assert one(spark, slugify(F.lit("?!"))) == "item"


def test_urls(spark):
    u = "https://www.google.com/maps/place/Stone+Ferry/@-12.25,44.5,15z/data=!9z?hl=xx#photos"
    assert one(spark, url_key(F.lit(u))) == "https://www.google.com/maps/place/Stone+Ferry/@-12.25,44.5,15z/data=!9z"
    assert one(spark, resolve_url(F.lit("/maps/place/Pond"))) == "https://www.google.com/maps/place/Pond"
    assert one(spark, url_key(F.lit("https://www.google.com/maps/place/Pond/"))) == one(
        spark, url_key(F.lit("https://www.google.com/maps/place/Pond#top")))
    c = one(spark, coords_from_url(F.lit("https://www.google.com/maps/place/Stone+Ferry/@-12.25,44.5,15z")))
    assert (c["lat"], c["lng"]) == (-12.25, 44.5)
    assert one(spark, coords_from_url(F.lit("https://www.google.com/maps/place/Stone+Ferry"))) is None
    assert one(spark, encode_uri_component(F.lit("tea & (y) ~ Ost!"))) == "tea%20%26%20(y)%20~%20Ost!"


def test_long_digits(spark):
    assert one(spark, T.decode_entities(F.lit("&#0000000065;&#x000000000042;&#99999999999;"))) == "AB&#99999999999;"
    assert one(spark, T.to_finite(F.lit("0x1FFFFFFFFFFFFFFFF"))) == float(0x1FFFFFFFFFFFFFFFF)
    assert one(spark, T.to_finite(F.lit("0b101"))) == 5.0 and one(spark, T.to_finite(F.lit("0o17"))) == 15.0
    assert one(spark, T.to_finite(F.lit("0x" + "F" * 400))) is None


def test_dot_segments_and_repeated_json_keys(spark):
    want = {"/a/../b": "https://www.google.com/b", "https://h.com/a/b/..": "https://h.com/a/", "https://h.com/a/./b/.": "https://h.com/a/b/",
            "../x": "https://www.google.com/x", "https://h.com/../../c?q=/../z#/./": "https://h.com/c?q=/../z#/./", "/a/%2E%2e/c": "https://www.google.com/c",
            "https://h.com/a..b/.c/...": "https://h.com/a..b/.c/...", "mailto:a/../b": "mailto:a/../b", "/a//../b": "https://www.google.com/a/b"}
    df = spark.createDataFrame([(u,) for u in want] + [(None,)], "u string")
    assert {r.u: r.r for r in df.select("u", resolve_url("u").alias("r")).collect()} == {**want, None: None}
    page = '<script type="application/ld+json">{"name": "old", "x": {"y": 1, "y": 2}, "name": "new"}</script>'
    v = spark.createDataFrame([(page,)], "html string").select(F.explode(H.jsonld_objects("html")).alias("v"))
    row = v.select(H.v_string(H.vget("v", "name")).alias("name"), F.try_variant_get("v", "$.x.y", "int").alias("y")).first()
    assert (row.name, row.y) == ("new", 2)
