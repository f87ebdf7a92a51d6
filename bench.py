"""Benchmark: the listing pipeline and its stages on pages rendered from
$BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].

Rendering the snapshot tables is input preparation (excluded from timing, as page
capture is excluded from the reference's floors).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pagesift.operators import html as hops  # noqa: E402
from pagesift.operators import places as PL  # noqa: E402
from pagesift.operators import reviews as RV  # noqa: E402
from pagesift.operators import search as S  # noqa: E402
from pagesift.plans.pipeline import run_pipeline  # noqa: E402
from pagesift.session import get_spark, scratch_path  # noqa: E402
from pagesift.sources import render as R  # noqa: E402
from pagesift.sources.tables import table  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", app="pagesift-bench", shuffle_partitions=cpus * 2)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")

    search_pages = R.stored(spark, sf_dir, "search_pages")
    place_pages = R.stored(spark, sf_dir, "place_pages")
    n_pages = place_pages.count() + search_pages.count()
    keywords = R.segments(spark, sf_dir)

    times: dict[str, float] = {}
    counts: dict[str, int] = {}

    def timed(name, fn):
        t = time.time()
        counts[name] = fn()
        times[name] = round(time.time() - t, 3)

    plan_s: dict[str, float] = {}

    def drained(name, build):
        """Every column of every row is computed (noop sink); building the plan is reported apart."""
        t = time.time()
        df = build()
        plan_s[name] = round(time.time() - t, 3)
        timed(name, lambda: df.write.format("noop").mode("overwrite").save())

    drained("anchors", lambda: hops.extract_anchors(table(spark, sf_dir, "pages", "page_id", "html")))
    drained("search_results", lambda: S.search_results(search_pages, 25, keywords))
    drained("place_fields", lambda: PL.place_page_fields(place_pages))
    drained("review_blocks", lambda: RV.parse_review_blocks(RV.review_blocks(place_pages)))

    def pipeline():
        res = run_pipeline(spark, keywords, search_pages, place_pages, None, 25, 20)
        # search results, places, reviews and photos are already written (staged)
        out = scratch_path(spark, "bench-out")
        res.progress.write.mode("overwrite").parquet(f"{out}/progress")
        s = res.summary.first()
        return int(s["place_count"]) + int(s["review_count"]) + int(s["photo_count"])

    timed("pipeline", pipeline)
    try:
        from pagesift.operators import netlog as N
        from pagesift.sources.render import net_log

        drained("correlate_responses", lambda: N.correlate_responses(net_log(spark, sf_dir)))
    except ImportError:
        pass

    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "pipeline_wall_seconds", "value": times["pipeline"], "unit": "sec",
        "queries": times, "total_sec": total, "sf": sf, "cpus": cpus,
        "pages": n_pages, "pages_per_sec": round(n_pages / times["pipeline"], 1) if times["pipeline"] else None,
        "rows": {k: v for k, v in counts.items() if v is not None}, "plan_sec": plan_s,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
