"""Learning from searches and clicks: success matrix, trust, anomalies, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.behaviour import session_trust, success_rate, time_decay


def success_matrix(searches: DataFrame, clicks: DataFrame, since: Column | None = None) -> DataFrame:
    """Per (query_cluster_id, page_id): impressions (distinct searches that clicked it), successes, clicks, first click.

    searches: id, query_cluster_id, created_at; clicks: search_event_id, page_id, clicked_at, is_success_signal. Clicks
    without a page and searches without a cluster are left out.
    """
    s = searches.where(F.col("query_cluster_id").isNotNull())
    if since is not None:
        s = s.where(F.col("created_at") > since)
    joined = s.select(F.col("id").alias("search_event_id"), "query_cluster_id").join(clicks.where(F.col("page_id").isNotNull()), "search_event_id")
    return joined.groupBy("query_cluster_id", "page_id").agg(
        F.countDistinct("search_event_id").alias("impressions"),
        F.count_if(F.coalesce("is_success_signal", F.lit(False))).alias("success_events"),
        F.count(F.lit(1)).alias("click_count"),
        F.min("clicked_at").alias("first_seen_at"),
        F.max("clicked_at").alias("last_updated_at"),
    )


def merge_matrix(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts added up, first and last times kept."""
    return (
        old.unionByName(new)
        .groupBy("query_cluster_id", "page_id")
        .agg(*[F.sum(c).alias(c) for c in ("impressions", "success_events", "click_count")], F.min("first_seen_at").alias("first_seen_at"), F.max("last_updated_at").alias("last_updated_at"))
    )


def scored_matrix(matrix: DataFrame, as_of: Column) -> DataFrame:
    rate, decay = success_rate(F.col("impressions"), F.col("success_events")), time_decay(F.col("last_updated_at"), as_of)
    return matrix.withColumns({"success_rate": rate, "time_decay_factor": decay, "score": rate * decay})


def session_facts(searches: DataFrame, clicks: DataFrame, anomalies: DataFrame, as_of: Column) -> DataFrame:
    """Per session_id: days_active, searches, clicks, success share, anomalies and trust; every count is of its own rows."""
    per_search = clicks.groupBy(F.col("search_event_id").alias("id")).agg(
        F.count(F.lit(1)).alias("clicks"), F.count_if(F.coalesce("is_success_signal", F.lit(False))).alias("successes")
    )
    s = searches.where(F.col("session_id").isNotNull())
    days = F.floor((F.unix_micros(F.max("created_at")) - F.unix_micros(F.min("created_at"))) / 86_400_000_000).cast("int")
    facts = s.join(per_search, "id", "left").groupBy("session_id").agg(
        F.coalesce(days, F.lit(0)).alias("days_active"),
        F.count(F.lit(1)).alias("searches"),
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"),
        F.coalesce(F.sum("successes"), F.lit(0)).alias("successes"),
    )
    odd = anomalies.groupBy("session_id").agg(F.count(F.lit(1)).alias("anomalies"))
    facts = facts.join(odd, "session_id", "left").fillna(0, ["anomalies"])
    share = F.coalesce(F.try_divide(F.col("successes"), F.col("clicks")), F.lit(0.0))
    return facts.withColumns({"success": share}).withColumn("trust", session_trust(F.col("days_active"), F.col("searches"), F.col("success"), F.col("anomalies")))


def rapid_clicks(clicks: DataFrame, searches: DataFrame, most: int = 10) -> DataFrame:
    """(session_id, minute, clicks) with more than `most` clicks in a calendar minute; counts combine before the shuffle."""
    joined = clicks.where(F.col("clicked_at").isNotNull()).join(searches.select(F.col("id").alias("search_event_id"), "session_id"), "search_event_id")
    per = joined.where(F.col("session_id").isNotNull()).groupBy("session_id", F.date_trunc("minute", "clicked_at").alias("minute")).agg(F.count(F.lit(1)).alias("clicks"))
    return per.where(F.col("clicks") > most)


def trailing_clicks(clicks: DataFrame, searches: DataFrame, seconds: int = 60) -> DataFrame:
    """(id, session_id, clicks): the clicks of its session within `seconds` up to every click, itself and equal times included.

    No task holds a session: a click stands in the bucket of its time and, as a past one, in the next; the frame of a
    click reaches no further. Rows without time or session are left out, repeated ones count once.
    """
    micros = seconds * 1_000_000
    joined = clicks.where(F.col("clicked_at").isNotNull()).dropDuplicates(["id"]).join(searches.select(F.col("id").alias("search_event_id"), "session_id").dropDuplicates(["search_event_id"]), "search_event_id")
    t = F.unix_micros("clicked_at")
    rows = joined.where(F.col("session_id").isNotNull()).select("id", "session_id", t.alias("t"), F.floor(t / micros).alias("own"))
    both = rows.withColumn("bucket", F.explode(F.array("own", F.col("own") + 1)))
    frame = Window.partitionBy("session_id", "bucket").orderBy("t").rangeBetween(-micros, Window.currentRow)
    return both.withColumn("clicks", F.count(F.lit(1)).over(frame)).where("bucket = own").select("id", "session_id", "clicks")


def search_sequence(searches: DataFrame, session: str = "session_id", bucket_seconds: int = 86_400) -> DataFrame:
    """(id, number in its session, seconds since the one before, ms to the next, whether it is the last of the session).

    A session that lasts for years is windowed by day, so that no task holds all of it; one row per day then carries the
    number of earlier events, the time of the last of them and of the first of a later day.
    """
    day = F.floor(F.unix_micros("created_at") / (bucket_seconds * 1_000_000)).alias("day")
    s = searches.where(F.col(session).isNotNull() & F.col("created_at").isNotNull()).select("id", session, "created_at", day)
    days = Window.partitionBy(session).orderBy("day")
    earlier = F.coalesce(F.sum("n").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_day = s.groupBy(session, "day").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("end"), F.min("created_at").alias("begin"))
    per_day = per_day.select(session, "day", earlier.alias("earlier"), F.lag("end").over(days).alias("end_before"), F.lead("begin").over(days).alias("begin_after"))
    w = Window.partitionBy(session, "day").orderBy("created_at", "id")
    inside = s.select("id", session, "day", "created_at", F.row_number().over(w).alias("place"), F.lag("created_at").over(w).alias("before"), F.lead("created_at").over(w).alias("after"))
    since = (F.unix_micros("created_at") - F.unix_micros(F.coalesce("before", "end_before"))) / 1_000_000
    following = F.unix_micros(F.coalesce("after", "begin_after"))
    until = F.floor((following - F.unix_micros("created_at")) / 1000).cast("long")
    number = (F.col("earlier") + F.col("place")).cast("int")
    return inside.join(per_day, [session, "day"]).select("id", session, number.alias("number"), since.alias("seconds_since"), until.alias("next_search_time_ms"), following.isNull().alias("is_last"))


def click_scores(pages: DataFrame, clicks: DataFrame, page_id: str = "id", score: str = "click_score") -> DataFrame:
    """Every click adds one to its page's score; an unknown score counts as 0."""
    n = clicks.where(F.col("page_id").isNotNull()).groupBy(F.col("page_id").alias(page_id)).agg(F.count(F.lit(1)).alias("_n"))
    return pages.join(n, page_id, "left").withColumn(score, F.coalesce(score, F.lit(0.0)) + F.coalesce("_n", F.lit(0))).drop("_n")
