"""The Bloom filter: never a false negative, few false positives, no exchange and no parsing of unwanted pages."""

from pyspark.sql import functions as F

from pagesift.operators import bloom
from pagesift.plans import pipeline as P


def test_no_key_is_lost_and_few_strangers_pass(spark):
    wanted = spark.range(20_000).select(F.concat(F.lit("https://x.example/"), F.col("id")).alias("k"))
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 1000 != 999, F.concat(F.lit("https://x.example/"), F.col("id"))).alias("url"))
    kept = bloom.keep_possible(rows, F.col("url"), wanted.unionByName(spark.createDataFrame([(None,)], "k string")), "k")
    n_wanted, n = kept.agg(F.count_if(F.col("id") < 20_000), F.count("*")).first()
    assert n_wanted == 19_980 and n - n_wanted < 0.05 * 40_000
    assert kept.columns == rows.columns
    assert bloom.keep_possible(rows, F.col("url"), wanted.limit(0), "k").count() == 0


def test_a_full_filter_lets_rows_through(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_WORDS", 64)
    wanted = spark.range(200_000).select(F.col("id").cast("string").alias("k"))
    assert bloom.keep_possible(spark.range(1000), F.col("id").cast("string"), wanted, "k").count() == 1000


def test_pages_are_pruned_before_they_are_parsed(spark):
    pages = spark.createDataFrame([(i, f"https://www.google.com/maps/place/p{i}?x=1", "<title>t</title>") for i in range(500)], "page_id long, url string, html string")
    pages = pages.withColumn("captured_at", F.lit("2024-01-01").cast("timestamp"))
    pending = spark.createDataFrame([("https://www.google.com/maps/place/p7/",), ("/maps/place/p8#y",)], "place_url string")
    kept = P.wanted_pages(pages, pending)
    assert {7, 8} <= {r.page_id for r in kept.select("page_id").collect()} and kept.count() < 25
    plan = P.extract_place_pages(kept, 20)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main
