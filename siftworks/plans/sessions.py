"""Queries of the session operator."""

from ..operators.sessions import sessionize
from ..runtime import table

VISITS = """
WITH e AS (SELECT DISTINCT session_id, id, created_at FROM search_events WHERE session_id IS NOT NULL AND created_at IS NOT NULL),
h AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS head
  FROM e WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)),
v AS (SELECT *, sum(head) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS visit FROM h)
SELECT session_id, arg_min(id, (created_at, id)) AS first_event_id, arg_max(id, (created_at, id)) AS last_event_id,
  min(created_at) AS start_at, max(created_at) AS end_at,
  CAST(floor(date_diff('microsecond', min(created_at), max(created_at)) / 1000) AS BIGINT) AS duration_ms, count(*) AS events
FROM v GROUP BY session_id, visit
"""


def p7_found(spark, folder):
    return sessionize(table(spark, folder, "search_events")).select("session_id", "first_event_id", "last_event_id")


def p7_sessions(spark, folder):
    return sessionize(table(spark, folder, "search_events"))


QUERIES = {"p7_found": p7_found, "p7_sessions": p7_sessions}
SQL = {
    "p7_found": f"SELECT session_id, first_event_id, last_event_id FROM ({VISITS})",
    "p7_sessions": VISITS,
}
