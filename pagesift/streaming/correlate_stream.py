"""Finish <-> latest earlier receive over an event stream, right also when events arrive out of order.

The state holds, for each request, the receives that may still be the latest earlier one of some finish and the
finishes that may still change.  It is keyed by one of ``buckets`` hash buckets of the request ids, and one call
matches all requests of a bucket by sorting arrays: a call costs some milliseconds whatever it holds, which a key for
each request would pay for every request in every batch.

* With ``bound`` (how late an event may be) a watermark of that size is declared.  A finish waits until the watermark
  has passed it, so that no earlier receive can follow, and is then emitted once.  Of a request's receives up to the
  watermark only the last one is kept.  Event-time timers emit what waits when a bucket has no further events; a
  later event of any request, or a heartbeat row, moves the watermark.  ``idle`` forgets a request so long after its last event.
* Without ``bound`` nothing is ever final: a finish is emitted when it arrives, and again, with the next ``revision``,
  when a late receive changes its answer.  ``latest_revisions`` keeps the last word on every finish.  All receives and finishes stay in the state.

All text is normalised by the batch job's expressions before grouping.  One bucket's rows of one micro-batch meet in one
task, and a batch rewrites the state of the buckets that it touches; the batch job (O70) has no such limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.text import safe_trim
from ..operators.netlog import FINISHED, RECEIVED

#: Hash buckets of the request ids; a stream keeps the number that its checkpoint began with.
BUCKETS = 1024

_OUT = "request_id string, url string, status int, mime_type string, body string, base64_encoded boolean, us bigint, seq bigint, revision int"
_RECEIVES = ("r_request", "r_us", "r_seq", "r_url", "r_status", "r_mime")
# f_revision -1: not emitted yet; else m_us and m_seq tell the receive that it was emitted with
_FINISHES = ("f_request", "f_us", "f_seq", "f_body", "f_base64", "m_us", "m_seq", "f_revision")
_LASTS = ("l_request", "l_us")
_STATE = ("r_request array<string>, r_us array<bigint>, r_seq array<bigint>, r_url array<string>, r_status array<int>, r_mime array<string>, "
          "f_request array<string>, f_us array<bigint>, f_seq array<bigint>, f_body array<string>, f_base64 array<boolean>, m_us array<bigint>, m_seq array<bigint>, "
          "f_revision array<int>, l_request array<string>, l_us array<bigint>")
_LONGS = {"r_us", "r_seq", "f_us", "f_seq", "m_us", "m_seq", "f_revision", "l_us"}


def _array(name: str, values):
    """A column of the state, or of new rows, as a numpy array: longs as they are, others as objects."""
    import numpy as np

    if name in _LONGS:
        return np.asarray(values, dtype=np.int64)
    out = np.empty(len(values), dtype=object)
    out[:] = [None if v is None or v != v else v for v in values]
    return out


def _extended(old: dict, name: str, values):
    import numpy as np

    return np.concatenate([_array(name, old.get(name) or []), _array(name, values)])


def _codes(*requests):
    """Numbers of the requests, the same in every one of the arrays, in order of first appearance."""
    import numpy as np

    numbers: dict = {}
    return [np.fromiter((numbers.setdefault(q, len(numbers)) for q in each), np.int64, len(each)) for each in requests]


def _latest_before(r: dict, f: dict):
    """For each finish the place of its request's last receive before it by (ts, seq), or -1.  Of equal receives the last to arrive counts."""
    import numpy as np

    n = len(r["r_us"])
    codes = np.concatenate(_codes(r["r_request"], f["f_request"]))
    us, seq = np.concatenate([r["r_us"], f["f_us"]]), np.concatenate([r["r_seq"], f["f_seq"]])
    received = np.arange(len(us)) < n
    order = np.lexsort((received, seq, us, codes))  # stable; a receive at a finish's own place is not earlier
    last = np.maximum.accumulate(np.where(received[order], np.arange(len(order)), -1))
    at = np.where(last >= 0, order[last], -1)
    at = np.where((at >= 0) & (codes[at] == codes[order]), at, -1)
    found = np.empty(len(us), dtype=np.int64)
    found[order] = at
    return found[n:]


def _superseded(r: dict, passed: int):
    """True for receives that a later one of the same request, up to the watermark too, stands in front of."""
    import numpy as np

    codes, = _codes(r["r_request"])
    order = np.lexsort((r["r_seq"], r["r_us"], codes))
    code, done = codes[order], r["r_us"][order] <= passed
    out = np.zeros(len(order), dtype=bool)
    out[order[:-1]] = done[:-1] & done[1:] & (code[:-1] == code[1:])
    return out


def _make_fn(bounded: bool, idle_ms: int | None):
    def fn(key, pdfs, state):
        import numpy as np
        import pandas as pd

        old = dict(zip((*_RECEIVES, *_FINISHES, *_LASTS), state.get)) if state.exists else {}
        frames = [] if state.hasTimedOut else [pdf for pdf in pdfs if len(pdf)]
        r_new, f_new, lasts = [[] for _ in _RECEIVES], [[] for _ in _FINISHES], dict(zip(old.get("l_request") or [], old.get("l_us") or []))
        for pdf in frames:
            got = pdf["received"].to_numpy(dtype=bool)
            wanted = ~got & ~pdf["body_failed"].to_numpy(dtype=bool)
            request, us, seq = (pdf[c].to_numpy() for c in ("request_id", "us", "seq"))
            for column, values in zip(r_new, (request, us, seq, *(pdf[c].to_numpy() for c in ("url", "status", "mime_type")))):
                column.extend(values[got].tolist())
            zeros = np.zeros(int(wanted.sum()), dtype=np.int64)
            for column, values in zip(f_new, (*(v[wanted] for v in (request, us, seq, pdf["body"].to_numpy(), pdf["base64"].to_numpy())), zeros, zeros, zeros - 1)):
                column.extend(values.tolist())
            if idle_ms is not None:
                for q, t in zip(request.tolist(), us.tolist()):
                    lasts[q] = max(lasts.get(q, t), t)
        r_new[4] = [None if v is None or v != v else int(v) for v in r_new[4]]
        r = {c: _extended(old, c, v) for c, v in zip(_RECEIVES, r_new)}
        f = {c: _extended(old, c, v) for c, v in zip(_FINISHES, f_new)}
        passed = state.getCurrentWatermarkMs() * 1000 if bounded else None

        at = _latest_before(r, f)
        final = f["f_us"] <= passed if bounded else np.ones(len(at), dtype=bool)
        m_us, m_seq = f["m_us"].copy(), f["m_seq"].copy()
        m_us[at >= 0], m_seq[at >= 0] = r["r_us"][at[at >= 0]], r["r_seq"][at[at >= 0]]
        news = final & (at >= 0) & ((f["f_revision"] < 0) | (m_us != f["m_us"]) | (m_seq != f["m_seq"]))
        f["m_us"], f["m_seq"], f["f_revision"] = np.where(news, m_us, f["m_us"]), np.where(news, m_seq, f["m_seq"]), f["f_revision"] + news
        out = None
        if news.any():
            i = at[news]
            out = pd.DataFrame({
                "request_id": f["f_request"][news], "url": r["r_url"][i], "status": pd.array(r["r_status"][i].tolist(), dtype="Int32"), "mime_type": r["r_mime"][i],
                "body": f["f_body"][news], "base64_encoded": f["f_base64"][news].astype(bool), "us": f["f_us"][news], "seq": f["f_seq"][news],
                "revision": f["f_revision"][news].astype(np.int32)})
        if bounded:
            f = {c: v[~final] for c, v in f.items()}
            keep = ~_superseded(r, passed)
            if idle_ms is not None:
                busy = set(f["f_request"].tolist()).union(*(pdf["request_id"].tolist() for pdf in frames))
                gone = {q for q, t in lasts.items() if q not in busy and t // 1000 + idle_ms <= passed // 1000}
                keep &= np.fromiter((q not in gone for q in r["r_request"].tolist()), bool, len(keep))
            r = {c: v[keep] for c, v in r.items()}
        if bounded and not len(f["f_us"]) and not len(r["r_us"]):
            state.remove()
        else:
            held = set(r["r_request"].tolist()) | set(f["f_request"].tolist())
            lasts = {q: t for q, t in lasts.items() if q in held}
            state.update((*(v.tolist() for v in (*r.values(), *f.values())), list(lasts), list(lasts.values())))
            timers = ([int(f["f_us"].min()) // 1000 + 1] if len(f["f_us"]) else []) + ([min(lasts.values()) // 1000 + idle_ms] if lasts else [])
            if bounded and timers:
                state.setTimeoutTimestamp(max(min(timers), passed // 1000 + 1))
        if out is not None:
            yield out

    return fn


def _ms(text: str) -> int:
    import pandas as pd

    return int(pd.Timedelta(text).total_seconds() * 1000)


def stream_correlate_responses(events: DataFrame, bound: str | None = None, idle: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``events``: a streaming DataFrame with the net_events columns.  Rows as O70's, and ``revision`` (always 0 with a bound).  ``bound`` and ``idle`` are times such as
    "1 hour"; ``idle`` needs a bound.  Events of other types only move the watermark.  ``buckets``: the number of state keys."""
    if idle is not None and bound is None:
        raise ValueError("idle needs a bound")
    kind = events.schema["ts"].dataType
    ev = events.withColumn("request_id", safe_trim("request_id")).withColumn("ts", F.col("ts").cast("timestamp"))
    if bound is not None:
        ev = ev.withWatermark("ts", bound)
    # the test names ts, so that it stays above the watermark, which every row moves
    wanted = F.col("request_id").isNotNull() & F.col("event_type").isin(RECEIVED, FINISHED)
    ev = ev.filter(F.when(F.col("ts").isNotNull(), wanted).otherwise(F.lit(False)))
    ev = ev.select(F.pmod(F.xxhash64("request_id"), F.lit(buckets)).alias("bucket"), "request_id", "ts", F.unix_micros("ts").alias("us"), "seq", (F.col("event_type") == RECEIVED).alias("received"),
                   F.coalesce(safe_trim("url"), F.lit("")).alias("url"), "status", safe_trim("mime_type").alias("mime_type"),
                   safe_trim("body").alias("body"), F.coalesce("base64", F.lit(False)).alias("base64"),
                   F.coalesce("body_failed", F.lit(False)).alias("body_failed"))
    timeout = GroupStateTimeout.NoTimeout if bound is None else GroupStateTimeout.EventTimeTimeout
    fn = _make_fn(bound is not None, None if idle is None else _ms(idle))
    out = ev.groupBy("bucket").applyInPandasWithState(fn, _OUT, _STATE, "append", timeout)
    return out.select("request_id", "url", "status", "mime_type", "body", "base64_encoded", F.timestamp_micros("us").cast(kind).alias("timestamp"), "seq", "revision")


def latest_revisions(emitted: DataFrame) -> DataFrame:
    """Of every finish the row emitted last."""
    key = ("request_id", "timestamp", "seq")
    rest = [c for c in emitted.columns if c not in key and c != "revision"]
    last = emitted.groupBy(*key).agg(F.max_by(F.struct(*rest), "revision").alias("_last"))
    return last.select("request_id", *[F.col("_last")[c].alias(c) for c in rest], "timestamp", "seq")
