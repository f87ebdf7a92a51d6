"""Search pages without a number: each url is a page of its own, with its own newest capture."""

import datetime as dt

from pagesift.operators import search as S
from pagesift.sources.snapshots import PAGE_SNAPSHOT_SCHEMA

TS = dt.datetime(2024, 1, 1)
URL = "https://www.google.com/maps/search/tea"


def page(page_id, url, names, days=0):
    html = "".join(f'<a href="/maps/place/{n}" aria-label="{n} · Cafe">x</a>' for n in names)
    return (page_id, url, html, "search", "tea", "Ostland", None, TS + dt.timedelta(days=days))


def test_every_url_keeps_its_newest_capture(spark):
    rows = [page(1, URL, "AB"), page(2, f"{URL}?start=20", "CD"), page(3, f"{URL}/more", "DE"), page(4, f"{URL}#top", "FB", days=1)]
    kw = spark.createDataFrame([("tea", 0)], "keyword string, keyword_index int")
    pages = spark.createDataFrame(rows, PAGE_SNAPSHOT_SCHEMA).repartition(3)
    got = S.search_results(pages, None, kw).orderBy("rank").collect()
    assert [(r.title, r.rank) for r in got] == [("C", 1), ("D", 2), ("E", 3), ("F", 4), ("B", 5)]
    assert [r.title for r in S.search_results(pages, 3, kw).orderBy("rank").collect()] == ["C", "D", "E"]
