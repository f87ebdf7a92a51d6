import datetime as dt

import pytest

from pagesift.operators import netlog as N
from pagesift.operators import progress as G
from pagesift.operators.progress import LEDGER_SCHEMA
from pagesift.sources import ledger as LD

WHEN = dt.datetime(2025, 6, 2)


def ledger(spark, *rows):
    """Rows (region, keyword, index, next, completed) or (region, place id)."""
    full = [(r[0], None, None, None, None, r[1], WHEN) if len(r) == 2 else (*r, None, WHEN) for r in rows]
    return spark.createDataFrame(full, LEDGER_SCHEMA)


def reconciled(spark, names, *rows):
    job = spark.createDataFrame([("Fen", n, i) for i, n in enumerate(names)], "region string, keyword string, keyword_index int")
    return {r.keyword: r for r in G.reconcile_progress(job, ledger(spark, *rows)).collect()}


def test_a_job_in_another_order_keeps_each_keyword_state(spark):
    got = reconciled(spark, ["moor", "weir", "lock"], ("Fen", "lock", 0, 7, True), ("Fen", "moor", 1, 4, True), ("Fen", "weir", 2, 1, False), ("Fen", "p77"))
    assert {k: (r.keyword_index, r.completed, r.next_place_index) for k, r in got.items()} == {"moor": (0, True, 4), "weir": (1, False, 1), "lock": (2, True, 7)}
    assert {r.next_keyword_index for r in got.values()} == {1}


def test_nothing_left_gives_the_keyword_count(spark):
    got = reconciled(spark, ["x", "y", "z"], *[("Fen", k, i, 0, True) for i, k in enumerate("zyx")])
    assert {r.next_keyword_index for r in got.values()} == {3}


@pytest.mark.parametrize("names", [["moor"], ["moor", "weir", "lock"], ["moor", "sluice"]])
def test_another_keyword_set_is_an_error(spark, names):
    with pytest.raises(ValueError):
        reconciled(spark, names, ("Fen", "moor", 0, 0, False), ("Fen", "weir", 1, 0, False))


# ---- the stored ledger

def state(df):
    return sorted((r.region, r.keyword or "", r.keyword_index or 0, r.next_place_index or 0, r.place_id or "") for r in df.collect())


def test_versions_follow_each_other(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert LD.load_progress(spark, path).count() == 0 and LD.ledger_version(spark, path) == 0
    first = ledger(spark, ("Fen", "moor", -3, -9, False), ("Fen", "p1"), ("Fen", "p1"))
    assert LD.save_progress(first, path) == 1
    assert state(LD.load_progress(spark, path)) == [("Fen", "", 0, 0, "p1"), ("Fen", "moor", 0, 0, "")]
    more = LD.load_progress(spark, path).unionByName(ledger(spark, ("Fen", "p2")))
    assert LD.save_progress(more, path, expected=1) == 2  # saved to where it was loaded from
    assert [r[4] for r in state(LD.load_progress(spark, path))] == ["p1", "p2", ""]
    assert [r[4] for r in state(LD.load_progress(spark, path, 1))] == ["p1", ""]
    with pytest.raises(LD.LedgerConflict):
        LD.save_progress(first, path, expected=1)
    assert LD.ledger_version(spark, path) == 2


def test_a_failed_save_leaves_the_last_version(spark, tmp_path):
    path = tmp_path / "ledger"
    LD.save_progress(ledger(spark, ("Fen", "moor", 0, 5, False)), str(path))
    bad = ledger(spark, ("Fen", "moor", 0, 6, False)).selectExpr("region", "keyword", "keyword_index", "cast(raise_error('lost') as int) as next_place_index", "completed", "place_id", "updated_at")
    with pytest.raises(Exception, match="lost"):
        LD.save_progress(bad, str(path))
    assert state(LD.load_progress(spark, str(path))) == [("Fen", "moor", 0, 5, "")]
    (path / "manifest" / "000000000002").write_text('{"form')  # a writer that died while it committed
    assert state(LD.load_progress(spark, str(path))) == [("Fen", "moor", 0, 5, "")]
    assert LD.save_progress(ledger(spark, ("Fen", "moor", 0, 8, True)), str(path), expected=1) == 3
    assert state(LD.load_progress(spark, str(path))) == [("Fen", "moor", 0, 8, "")]


def test_other_formats_and_shapes_are_errors(spark, tmp_path):
    path = tmp_path / "ledger"
    LD.save_progress(ledger(spark, ("Fen", "moor", 0, 5, False)), str(path))
    manifest = path / "manifest" / "000000000001"
    manifest.write_text(manifest.read_text().replace('"format": 1', '"format": 2'))
    (path / "manifest" / ".000000000001.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        LD.load_progress(spark, str(path))
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError):
        LD.load_progress(spark, str(tmp_path / "plain"))


def test_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LD, "KEEP", 2)
    path = tmp_path / "ledger"
    for i in range(4):
        LD.save_progress(ledger(spark, ("Fen", "moor", 0, i, False)), str(path))
    assert sorted(p.name for p in (path / "manifest").iterdir() if p.name.isdigit()) == ["000000000003", "000000000004"]
    assert len(list((path / "data").iterdir())) == 2 and state(LD.load_progress(spark, str(path)))[0][3] == 3


# ---- the stored event log

def test_finishes_take_the_latest_earlier_receive(spark):
    at = [WHEN + dt.timedelta(seconds=7 * i) for i in range(12)]
    recv, fin = N.RECEIVED, N.FINISHED
    rows = [
        ("k", fin, at[0], 50, None, None, None, "early", None, None),  # nothing received yet
        ("k", recv, at[1], 51, " v/1 ", 404, " text/css ", None, None, None),
        ("k", fin, at[2], 52, None, None, None, "\tone\n two ", None, None),
        (" k ", recv, at[3], 53, None, None, " ", None, None, None),  # ids are trimmed; no url is an empty one
        ("k", fin, at[4], 55, None, None, None, "lost", True, True),  # its body could not be fetched
        ("k", fin, at[4], 54, None, None, None, "  ", True, False),
        ("m", recv, at[5], 56, "v/2", 200, "a/b", None, None, None),
        ("k", "dataReceived", at[6], 57, "v/3", 1, "c/d", None, None, None),
        (None, fin, at[7], 58, None, None, None, "no id", None, None),
        ("k", fin, at[11], 59, None, None, None, "last", False, None),
    ]
    log = spark.createDataFrame(rows, "request_id string, event_type string, ts timestamp, seq bigint, url string, status int, mime_type string, body string, base64 boolean, body_failed boolean")
    want = [(52, "v/1", 404, "text/css", "one two", False), (54, "", None, None, None, True), (59, "", None, None, "last", False)]
    for seconds in (5, 20, 100_000):  # the width of the time buckets does not matter
        got = N.correlate_responses(log, bucket_seconds=seconds).orderBy("seq").collect()
        assert [(r.seq, r.url, r.status, r.mime_type, r.body, r.base64_encoded) for r in got] == want


def test_the_log_is_read_twice_and_bodies_once(spark, tmp_path):
    where = str(tmp_path / "log")
    rows = [("q", N.RECEIVED, WHEN, 1, "v/1", 200, "a/b", None, None, None)]
    spark.createDataFrame(rows, "request_id string, event_type string, ts timestamp, seq bigint, url string, status int, mime_type string, body string, base64 boolean, body_failed boolean").write.parquet(where)
    plan = N.correlate_responses(spark.read.parquet(where))._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(schemas) == 2 and sum("body#" in line.split("Batched")[0] for line in schemas) == 1
