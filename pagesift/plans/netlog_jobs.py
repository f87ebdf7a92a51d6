"""O70 over the captured-event log derived from ``events``."""

from __future__ import annotations

from ..operators.netlog import correlate_responses
from ..sources.render import net_log
from .registry import query
from .sqlkit import ws

NET_SQL = f"""WITH ev AS (
  SELECT CAST(user_id AS VARCHAR) AS request_id, event_type, ts, event_id AS seq,
    CASE WHEN event_type = 'view' THEN 'https://api.example.com/u/' || CAST(user_id AS VARCHAR) || '/e/' || CAST(event_id AS VARCHAR) END AS url,
    CASE WHEN event_type = 'view' THEN CAST(200 + event_id % 3 AS INTEGER) END AS status,
    props, event_id % 2 = 0 AS b64, event_id % 13 = 0 AS failed
  FROM events WHERE event_type IN ('view', 'click')),
w AS (
  SELECT *, last_value(CASE WHEN event_type = 'view' THEN url END IGNORE NULLS)
              OVER (PARTITION BY request_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r_url,
            last_value(CASE WHEN event_type = 'view' THEN status END IGNORE NULLS)
              OVER (PARTITION BY request_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r_status
  FROM ev)
SELECT request_id, r_url AS url, r_status AS status, 'application/json' AS mime_type,
  nullif({ws("'  ' || props || chr(10) || ' '")}, '') AS body, b64 AS base64_encoded, ts AS timestamp, seq
FROM w WHERE event_type = 'click' AND r_url IS NOT NULL AND NOT failed"""


@query("correlate_responses", oracle=NET_SQL)
def q_correlate_responses(spark, sf):
    return correlate_responses(net_log(spark, sf))
