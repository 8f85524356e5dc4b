"""Queries of the click and session operators, in batch and as streams."""

from pyspark.sql import functions as F

from ..functions import behaviour as B
from ..functions.ranking import at
from ..operators import behaviour as O
from ..operators.search import top
from ..runtime import staged, table
from ..streaming import events as S
from .tables import AS_OF, CLICKS, NOW, SEARCHES, as_of, clicks, searches, sql_days

c = F.col
HALF = "2022-01-08 00:00:00"


def success_matrix(spark, folder):
    return O.success_matrix(searches(spark, folder), clicks(spark, folder))


def success_matrix_recent(spark, folder):
    """The matrix over the searches of the last 24 days, recomputed from its window."""
    since = as_of() - F.expr("INTERVAL 24 DAYS")
    return O.success_matrix(searches(spark, folder), clicks(spark, folder), since).select("query_cluster_id", "page_id", "impressions", "success_events", "click_count")


def matrix_merge(spark, folder):
    """Two halves of the searches merged give the whole matrix."""
    s, k = searches(spark, folder), clicks(spark, folder)
    early = O.success_matrix(s.where(c("created_at") < at(HALF)), k)
    late = O.success_matrix(s.where(c("created_at") >= at(HALF)), k)
    return O.merge_matrix(early, late)


def success_ranking(spark, folder):
    m = O.scored_matrix(success_matrix(spark, folder).where("impressions >= 2"), as_of())
    pages = table(spark, folder, "pages").select(c("id").alias("page_id"), "url").distinct()
    rows = m.join(pages, "page_id").withColumn("recency_weight", B.recency_weight(c("last_updated_at"), as_of()))
    rows = rows.select("query_cluster_id", "page_id", "url", "impressions", F.round("success_rate", 6).alias("success_rate"), F.round("score", 9).alias("score"), F.round("recency_weight", 6).alias("recency_weight"))
    return top(rows, F.desc("success_rate"), F.asc("query_cluster_id"), F.asc("page_id"), limit=100)


def time_decay(spark, folder):
    m = success_matrix(spark, folder)
    return m.select("query_cluster_id", "page_id", F.round(B.time_decay(c("last_updated_at"), at("2022-01-20 00:00:00"), 0.1), 9).alias("decay"))


def click_success(spark, folder):
    k = clicks(spark, folder)
    return k.select("id", B.click_success(c("time_on_page_ms"), F.coalesce("scroll_depth", F.lit(0.0)), c("interaction_signals")).alias("reason"))


def click_positions(spark, folder):
    k = clicks(spark, folder).where("rank_position is not null")
    return k.groupBy("rank_position").agg(F.count(F.lit(1)).alias("clicks"), F.round(F.avg(F.coalesce("is_success_signal", F.lit(False)).cast("double")), 6).alias("success"))


def _facts(spark, folder):
    s, k = searches(spark, folder), clicks(spark, folder)
    return O.session_facts(s, k, O.rapid_clicks(k, s, 1), as_of())


def session_trust(spark, folder):
    return _facts(spark, folder).select("session_id", "days_active", "searches", "clicks", "successes", "anomalies", F.round("trust", 6).alias("trust"))


def trust_with_fanout(spark, folder):
    """Trust from one join of all rows, where every click repeats its search: the counts are those of the join."""
    s, k = searches(spark, folder).where("session_id is not null"), clicks(spark, folder)
    j = s.join(k.select(c("search_event_id").alias("id"), "is_success_signal"), "id", "left")
    n = j.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.coalesce("is_success_signal", F.lit(False)).cast("double")), 6).alias("success"))
    return n.withColumn("trust", F.round(B.session_trust(F.lit(0), c("rows"), c("success"), F.lit(0)), 6))


def user_category(spark, folder):
    f = _facts(spark, folder)
    return f.groupBy(B.user_category(c("trust") - 0.3, c("days_active"), c("anomalies") > 0).alias("category")).agg(F.count(F.lit(1)).alias("sessions"))


def rapid_clicks(spark, folder):
    return O.rapid_clicks(clicks(spark, folder), searches(spark, folder), 1)


def search_sequence(spark, folder):
    return O.search_sequence(searches(spark, folder))


def click_score(spark, folder):
    pages = table(spark, folder, "pages").select("id", "click_score").dropDuplicates(["id"])
    return O.click_scores(pages, clicks(spark, folder)).select("id", F.round("click_score", 6).alias("click_score"))


def intent_content_preference(spark, folder):
    """Per intent of the searches and type of the clicked page: pages and success rate, by way of the success matrix."""
    from ..functions.content import url_type

    s = searches(spark, folder)
    m = O.success_matrix(s, clicks(spark, folder)).withColumn("rate", B.success_rate(c("impressions"), c("success_events")))
    kinds = table(spark, folder, "pages").select(c("id").alias("page_id"), url_type(c("url")).alias("content_type")).distinct()
    intents = s.where("query_cluster_id is not null and intent_type is not null").select("query_cluster_id", "intent_type").distinct()
    return m.join(intents, "query_cluster_id").join(kinds, "page_id").groupBy("intent_type", "content_type").agg(F.countDistinct("page_id").alias("pages"), F.round(F.avg("rate"), 6).alias("success"))


def stream_sessions(spark, folder):
    like = table(spark, folder, "search_events")
    s = S.source(spark, f"{folder}/search_events.parquet", like)
    return staged(S.run(S.session_counts(s), "complete"))


def stream_clicks(spark, folder):
    s = S.source(spark, f"{folder}/click_events.parquet", table(spark, folder, "click_events"))
    return staged(S.run(S.click_counts(s), "complete"))


def stream_rapid(spark, folder):
    s = S.source(spark, f"{folder}/click_events.parquet", table(spark, folder, "click_events"))
    return staged(S.run(S.rapid(s, 1), "complete"))


def stream_once(spark, folder):
    s = S.source(spark, f"{folder}/search_events.parquet", table(spark, folder, "search_events"))
    return staged(S.run(S.once(s.select("id", "created_at"), late="3650 days"), "append")).select("id")


MATRIX = f"""WITH {SEARCHES}, {CLICKS}, m AS (SELECT query_cluster_id, page_id, count(DISTINCT search_event_id) AS impressions, count(*) FILTER (coalesce(is_success_signal, false)) AS success_events, count(*) AS click_count,
  min(clicked_at) AS first_seen_at, max(clicked_at) AS last_updated_at FROM clicks c JOIN searches s ON c.search_event_id = s.id WHERE page_id IS NOT NULL AND query_cluster_id IS NOT NULL GROUP BY ALL)
"""
RAPID = f"""WITH {SEARCHES}, {CLICKS}, r AS (SELECT session_id, date_trunc('minute', clicked_at) AS minute, count(*) AS clicks FROM clicks c JOIN searches s ON c.search_event_id = s.id
  WHERE session_id IS NOT NULL AND clicked_at IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
"""
FACTS = RAPID + f""", p AS (SELECT search_event_id AS id, count(*) AS clicks, count(*) FILTER (coalesce(is_success_signal, false)) AS successes FROM clicks GROUP BY ALL),
f AS (SELECT session_id, coalesce({sql_days('min(created_at)', 'max(created_at)')}, 0) AS days_active, count(*) AS searches, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(successes), 0) AS BIGINT) AS successes
  FROM searches LEFT JOIN p USING (id) WHERE session_id IS NOT NULL GROUP BY session_id),
o AS (SELECT session_id, count(*) AS anomalies FROM r GROUP BY session_id),
t AS (SELECT f.*, coalesce(anomalies, 0) AS anomalies, greatest(0.1::DOUBLE, least(1.5::DOUBLE, 0.5::DOUBLE + least(0.3::DOUBLE, days_active / 30.0::DOUBLE) + least(0.2::DOUBLE, searches / 50.0::DOUBLE)
  + 0.2::DOUBLE * coalesce(successes / nullif(clicks, 0), 0) - least(0.5::DOUBLE, 0.1::DOUBLE * coalesce(anomalies, 0)))) AS trust FROM f LEFT JOIN o USING (session_id))
"""
_decay = lambda now, rate: f"CASE WHEN last_updated_at < {now} - INTERVAL 1 DAY THEN exp(-{rate}::DOUBLE * {sql_days('last_updated_at', now)}) ELSE 1.0::DOUBLE END"
_rate = "CASE WHEN impressions > 0 THEN least(1.0::DOUBLE, success_events / impressions) ELSE 0 END"

QUERIES = {
    "success_matrix": success_matrix, "success_matrix_recent": success_matrix_recent, "matrix_merge": matrix_merge, "success_ranking": success_ranking, "time_decay": time_decay, "click_success": click_success,
    "click_positions": click_positions, "session_trust": session_trust, "trust_with_fanout": trust_with_fanout, "user_category": user_category, "rapid_clicks": rapid_clicks, "search_sequence": search_sequence,
    "click_score": click_score, "intent_content_preference": intent_content_preference, "stream_sessions": stream_sessions, "stream_clicks": stream_clicks, "stream_rapid": stream_rapid, "stream_once": stream_once,
}
SQL = {
    "success_matrix": MATRIX + "SELECT * FROM m",
    "success_matrix_recent": MATRIX.replace("WHERE page_id", f"WHERE s.created_at > {NOW} - INTERVAL 24 DAYS AND page_id") + "SELECT query_cluster_id, page_id, impressions, success_events, click_count FROM m",
    "matrix_merge": MATRIX.replace("query_cluster_id IS NOT NULL", "query_cluster_id IS NOT NULL AND created_at IS NOT NULL") + "SELECT * FROM m",
    "success_ranking": MATRIX + f"""SELECT query_cluster_id, page_id, url, impressions, round({_rate}, 6) AS success_rate, round({_rate} * {_decay(NOW, 0.1)}, 9) AS score, round(greatest(0.1::DOUBLE, exp(-0.1::DOUBLE * {sql_days('last_updated_at', NOW)})), 6) AS recency_weight
  FROM m JOIN (SELECT DISTINCT id AS page_id, url FROM pages) USING (page_id) WHERE impressions >= 2 ORDER BY success_rate DESC, query_cluster_id, page_id LIMIT 100""",
    "time_decay": MATRIX + f"SELECT query_cluster_id, page_id, round({_decay(NOW.replace(AS_OF, '2022-01-20 00:00:00'), 0.1)}, 9) AS decay FROM m",
    "click_success": f"""WITH {CLICKS} SELECT id, CASE WHEN time_on_page_ms > 30000 THEN 'long_stay' WHEN NOT isnan(coalesce(scroll_depth, 0)) AND coalesce(scroll_depth, 0) > 0.5 THEN 'thorough_read'
  WHEN regexp_matches(coalesce(interaction_signals, ''), ':\\s*(true|[1-9]|"[^"]+")') THEN 'interaction' END AS reason FROM clicks""",
    "click_positions": f"WITH {CLICKS} SELECT rank_position, count(*) AS clicks, round(avg(CAST(coalesce(is_success_signal, false) AS INT)), 6) AS success FROM clicks WHERE rank_position IS NOT NULL GROUP BY 1",
    "session_trust": FACTS + "SELECT session_id, days_active, searches, clicks, successes, anomalies, round(trust, 6) AS trust FROM t",
    "trust_with_fanout": f"""WITH {SEARCHES}, {CLICKS}, n AS (SELECT session_id, count(*) AS rows, round(avg(CAST(coalesce(is_success_signal, false) AS INT)), 6) AS success FROM searches s LEFT JOIN clicks c ON c.search_event_id = s.id WHERE session_id IS NOT NULL GROUP BY session_id)
SELECT *, round(greatest(0.1::DOUBLE, least(1.5::DOUBLE, 0.5::DOUBLE + least(0.2::DOUBLE, rows / 50.0::DOUBLE) + 0.2::DOUBLE * success)), 6) AS trust FROM n""",
    "user_category": FACTS + """SELECT CASE WHEN trust - 0.3::DOUBLE >= 0.8 THEN 'trusted_long_term' WHEN trust - 0.3::DOUBLE >= 0.5 AND days_active >= 7 THEN 'established' WHEN trust - 0.3::DOUBLE >= 0.3 AND anomalies = 0 THEN 'normal'
  WHEN anomalies > 0 THEN 'suspicious' ELSE 'new' END AS category, count(*) AS sessions FROM t GROUP BY 1""",
    "rapid_clicks": RAPID + "SELECT * FROM r",
    "search_sequence": f"""WITH {SEARCHES} SELECT id, session_id, CAST(row_number() OVER w AS INT) AS number, CAST((epoch_us(created_at) - lag(epoch_us(created_at)) OVER w) / 1000000.0 AS DOUBLE) AS seconds_since,
  CAST(floor((lead(epoch_us(created_at)) OVER w - epoch_us(created_at)) / 1000) AS BIGINT) AS next_search_time_ms, lead(id) OVER w IS NULL AS is_last
  FROM searches WHERE session_id IS NOT NULL AND created_at IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)""",
    "click_score": f"WITH {CLICKS} SELECT p.id, round(coalesce(click_score, 0) + coalesce(n, 0), 6) AS click_score FROM (SELECT DISTINCT id, click_score FROM pages) p LEFT JOIN (SELECT page_id, count(*) AS n FROM clicks GROUP BY 1) k ON k.page_id = p.id",
    "stream_clicks": f"WITH {CLICKS} SELECT page_id, date_trunc('day', clicked_at) AS day, count(*) AS clicks, count(*) FILTER (coalesce(is_success_signal, false)) AS successes FROM click_events WHERE page_id IS NOT NULL AND clicked_at IS NOT NULL GROUP BY ALL",
    "stream_rapid": "SELECT page_id, date_trunc('minute', clicked_at) AS minute, count(*) AS clicks FROM click_events WHERE clicked_at IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "stream_once": "SELECT DISTINCT id FROM search_events WHERE created_at IS NOT NULL",
    "stream_sessions": """WITH e AS (SELECT session_id, created_at FROM search_events WHERE session_id IS NOT NULL AND created_at IS NOT NULL),
h AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at) < INTERVAL 24 HOURS THEN 0 ELSE 1 END AS head FROM e),
v AS (SELECT *, sum(head) OVER (PARTITION BY session_id ORDER BY created_at) AS visit FROM h)
SELECT session_id, min(created_at) AS start_at, max(created_at) + INTERVAL 24 HOURS AS end_at, count(*) AS events FROM v GROUP BY session_id, visit""",
}
from .tables import sql_url_type  # noqa: E402

SQL["intent_content_preference"] = MATRIX + f"""SELECT intent_type, content_type, count(DISTINCT page_id) AS pages, round(avg({_rate}), 6) AS success FROM m
  JOIN (SELECT DISTINCT query_cluster_id, intent_type FROM searches WHERE intent_type IS NOT NULL) USING (query_cluster_id) JOIN (SELECT DISTINCT id AS page_id, {sql_url_type('url')} AS content_type FROM pages) USING (page_id) GROUP BY ALL"""
