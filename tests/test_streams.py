"""Both streams: events out of order, late receives, ends of searches, late pages and replays."""

import datetime as dt

import pytest


from pagesift.operators.netlog import correlate_responses
from pagesift.streaming import pipeline_stream as PS
from pagesift.streaming.correlate_stream import latest_revisions, stream_correlate_responses

NET = "request_id string, event_type string, ts timestamp, seq long, url string, status int, mime_type string, body string, base64 boolean, body_failed boolean"
T0 = dt.datetime(2024, 1, 1, 10)


def recv(minute, name, request="r", seq=None):
    return (request, "responseReceived", T0 + dt.timedelta(minutes=minute), minute if seq is None else seq, name, 200, "text/html", None, None, None)


def fin(minute, request="r", seq=None, failed=False):
    return (request, "loadingFinished", T0 + dt.timedelta(minutes=minute), minute if seq is None else seq, None, None, None, f" b{minute} ", True, failed)


def drain(spark, tmp_path, files, bound=None, idle=None):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in files:
        spark.createDataFrame(rows, NET).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(NET).parquet(src)
        (stream_correlate_responses(stream, bound, idle).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)


def pairs(df):
    return sorted((r.request_id, r.seq, r.url) for r in df.collect())


FILES = [[recv(0, "A"), recv(30, "B"), recv(2, "Q", " q "), fin(1, "q")], [fin(10), fin(3, "q"), recv(7, "x", "  "), fin(8, "  ")],
         [recv(5, "C"), fin(40), fin(41, failed=True), ("r", "other", T0, 9, None, None, None, None, None, None)], [fin(50), recv(45, "D"), fin(4), fin(45, seq=44)]]
BEAT = [("beat", "heartbeat", T0 + dt.timedelta(days=9), 0, None, None, None, None, None, None)]


def test_events_out_of_order(spark, tmp_path):
    want = pairs(correlate_responses(spark.createDataFrame(sum(FILES, []), NET)))
    assert ("r", 10, "C") in want and ("r", 40, "B") in want and ("r", 50, "D") in want and ("r", 44, "B") in want and ("q", 3, "Q") in want
    got = drain(spark, tmp_path, FILES)
    assert pairs(latest_revisions(got)) == want
    assert got.where("revision > 0").count() == 1  # the finish of 10:10 had A before C came


def test_events_out_of_order_with_a_bound(spark, tmp_path):
    want = pairs(correlate_responses(spark.createDataFrame(sum(FILES, []), NET)))
    got = drain(spark, tmp_path, [*FILES, BEAT], bound="1 hour")
    assert pairs(got) == want and got.where("revision <> 0").count() == 0


def test_idle_requests_are_forgotten(spark, tmp_path):
    day = [recv(0, "A")], [recv(600, "Z", "z"), recv(601, "Z2", "z")], [recv(900, "Y", "y")], [fin(1000), fin(1001, "y")], BEAT
    assert pairs(drain(spark, tmp_path, day, bound="1 minute", idle="2 hours")) == [("y", 1001, "Y")]
    with pytest.raises(ValueError):
        stream_correlate_responses(spark.createDataFrame([], NET), idle="1 hour")


PAGES = "page_id long, url string, html string, kind string, keyword string, region string, page_no int, captured_at timestamp, page_count int"


def search_page(pid, keyword, no, places, count=None, at=0):
    html = "".join(f'<a href="/maps/place/{p}" aria-label="{p} · Cafe">x</a>' for p in places)
    return (pid, f"https://s/{keyword}?{no}", html, "search", keyword, "R", no, T0 + dt.timedelta(minutes=at), count)


def place_pages(spark, names):
    rows = [(1000 + i, f"https://www.google.com/maps/place/{n}", f'<title>{n}</title><li data-review-id="rv{n}">good</li><img src="https://lh3.googleusercontent.com/{n}=w800-h600">', T0)
            for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, captured_at timestamp")


def test_search_ends_late_pages_and_replays(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    keywords = spark.createDataFrame([("k0", 0), ("k1", 1)], "keyword string, keyword_index int")
    places = place_pages(spark, "abcdefg")
    schema = spark.createDataFrame([], PAGES).schema

    def call(*pages):
        if pages:
            spark.createDataFrame(list(pages), PAGES).coalesce(1).write.mode("append").parquet(src)
        PS.stream_pipeline(spark, src, schema, places, keywords, out, ckpt, 25, 20)

    def names(table="places"):
        df = PS._stored(spark, f"{out}/{table}")
        return None if df is None else sorted(r[0] for r in df.select("name" if table == "places" else "id").collect())

    call(search_page(1, "k0", 0, "ab"), search_page(2, "k1", 0, "c", count=1))
    assert names() == ["c"]  # k0 has no end yet
    call(search_page(3, "k0", 1, "cd", count=3))
    assert names() == ["c"]
    call(search_page(4, "k0", 2, "e"), search_page(5, "k0", 1, "cd", at=5))  # the end, and a second capture
    assert names() == ["a", "b", "c", "d", "e"] and names("reviews") == [f"rv{n}" for n in "abcde"]
    call()
    assert names() == ["a", "b", "c", "d", "e"]
    call(search_page(6, "k1", 1, "fa"))  # a late page opens a done search again
    assert names() == ["a", "b", "c", "d", "e", "f"] and len(names("photos")) == 6
    ledger, _ = PS.current_ledger(spark, f"{out}/progress")
    rows = {r.keyword: (r.completed, r.next_place_index) for r in ledger.where("place_id IS NULL").collect()}
    assert rows == {"k0": (True, 5), "k1": (True, 3)} and ledger.where("place_id IS NOT NULL").count() == 6
    # a run that failed before its ledger part is repeated with the same id
    ended = PS.ended_searches(PS._stored(spark, f"{out}/search_pages"), PS._stored(spark, f"{out}/searches"))
    assert ended.count() == 0


def test_requests_share_state_keys(spark, tmp_path):
    """A call of the state function holds a bucket of requests, so calls do not grow with the number of requests."""
    names = [f"r{i}" for i in range(40)]
    parts = [[recv(0, "A", n) for n in names] + [fin(20, names[3])], [fin(10, n) for n in names] + [recv(5, "C", n) for n in names[::2]], BEAT]
    want = pairs(correlate_responses(spark.createDataFrame(sum(parts, []), NET)))
    assert len(want) == 41 and ("r0", 10, "C") in want and ("r1", 10, "A") in want
    for bound in (None, "1 hour"):
        src, out, ckpt = (str(tmp_path / f"{n}{bound}") for n in ("in", "out", "ckpt"))
        for rows in parts:
            spark.createDataFrame(rows, NET).coalesce(1).write.mode("append").parquet(src)
            q = (stream_correlate_responses(spark.readStream.schema(NET).parquet(src), bound, buckets=3).writeStream.format("parquet")
                 .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
            q.awaitTermination()
            assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
        assert pairs(latest_revisions(spark.read.parquet(out))) == want
