import datetime as dt
import json
import os
import tempfile

from pagesift.operators.progress import LEDGER_SCHEMA
from pagesift.sources.export import export_entity_tables, export_tagged_records
from pagesift.sources.ledger import load_progress, save_progress


def test_tagged_records_order_and_nulls(spark):
    run = spark.createDataFrame([(1, 2)], "place_count bigint, review_count bigint")
    places = spark.createDataFrame([("p1", None, dt.datetime(2024, 1, 1))], "id string, phone string, scraped_at timestamp")
    reviews = spark.createDataFrame([("r1", "p1")], "id string, place_id string")
    photos = spark.createDataFrame([("f1", "p1")], "id string, place_id string")
    out = tempfile.mkdtemp(prefix="pagesift-test-") + "/ndjson"
    export_tagged_records(run, places, reviews, photos, out)
    lines = []
    for f in sorted(os.listdir(out)):
        if f.startswith("part-"):
            with open(os.path.join(out, f)) as fh:
                lines += [json.loads(x) for x in fh if x.strip()]
    assert [x["type"] for x in lines] == ["run", "place", "review", "review-photo"]
    place = lines[1]["data"]
    assert "phone" in place and place["phone"] is None
    assert place["scrapedAt"] == "2024-01-01T00:00:00.000Z"


def test_entity_tables_and_ledger_roundtrip(spark):
    base = tempfile.mkdtemp(prefix="pagesift-test-")
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    export_entity_tables({"places": df, "reviews": df}, base, "json")
    assert spark.read.json(f"{base}/places").count() == 1
    assert load_progress(spark, f"{base}/missing").count() == 0
    ts = dt.datetime(2024, 1, 1)
    led = spark.createDataFrame([("R", "k", 0, -3, False, None, ts), ("R", None, None, None, None, "x", ts),
                                 ("R", None, None, None, None, "x", ts)], LEDGER_SCHEMA)
    save_progress(led, f"{base}/ledger")
    back = load_progress(spark, f"{base}/ledger").collect()
    assert len(back) == 2
    assert [r.next_place_index for r in back if r.place_id is None] == [0]
