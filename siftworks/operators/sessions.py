"""Sessions separated by inactivity, found by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import staged

HOUR = 3_600_000_000


def sessionize(
    events: DataFrame,
    session_col: str = "session_id",
    id_col: str = "id",
    time_col: str = "created_at",
    gap_seconds: int = 1800,
    bucket_micros: int = HOUR,
) -> DataFrame:
    """One row per visit: session_id, first_event_id, last_event_id, start_at, end_at, duration_ms, events.

    A visit ends where more than gap_seconds pass without an event of the session; exactly gap_seconds do not end it.
    Events are ordered by time, then id. Rows equal in session, id and time count once; events without session or time
    are left out; a null id sorts first and counts as an id of its own. An empty input gives no rows. Only the three
    named columns are read, so other columns may have any name.

    No task ever holds a whole session: events are windowed by (session, time bucket), where they link to a predecessor
    within the gap and contract to runs. Only a bucket's first run can continue another bucket's run, so pointers between
    runs are doubled by self-joins until no root moves, and runs are aggregated by their root.
    """
    gap = gap_seconds * 1_000_000
    width = max(bucket_micros, gap)
    t = F.unix_micros(F.col(time_col).cast("timestamp"))
    e = (
        events.select(F.col(session_col).alias("s"), F.col(id_col).alias("id"), t.alias("t"))
        .where(F.col("s").isNotNull() & F.col("t").isNotNull())
        .withColumn("b", F.col("t") - F.pmod(F.col("t"), F.lit(width)))
        .repartition("s", "b")
        .dropDuplicates(["s", "b", "t", "id"])  # served by the same partitioning
    )
    in_bucket = Window.partitionBy("s", "b").orderBy("t", "id")
    before = F.lag("t").over(in_bucket)
    runs = (
        e.withColumn("head", F.when(before.isNull() | (F.col("t") - before > gap), 1).otherwise(0))
        .withColumn("run", F.sum("head").over(in_bucket))
        .groupBy("s", "b", "run")
        .agg(
            F.min(F.struct("t", "id")).alias("first"),
            F.max(F.struct("t", "id")).alias("last"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("open", F.col("run") == F.max("run").over(Window.partitionBy("s", "b")))
    )
    runs = staged(runs)

    # a run is named by its start, which is unique within a session
    tails = runs.where("open").select("s", (F.col("b") + width).alias("b"), F.col("first.t").alias("to"), F.col("last.t").alias("end"))
    links = staged(
        runs.where("run = 1")
        .join(tails, ["s", "b"])
        .where(F.col("first.t") - F.col("end") <= gap)
        .select("s", F.col("first.t").alias("at"), "to")
    )
    roots = double_pointers(links)
    whole = (
        runs.withColumn("at", F.col("first.t"))
        .join(roots, ["s", "at"], "left")
        .groupBy("s", F.coalesce("to", "at").alias("root"))
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("events"))
    )
    return whole.select(
        F.col("s").alias("session_id"),
        F.col("first.id").alias("first_event_id"),
        F.col("last.id").alias("last_event_id"),
        F.timestamp_micros("first.t").alias("start_at"),
        F.timestamp_micros("last.t").alias("end_at"),
        F.floor((F.col("last.t") - F.col("first.t")) / 1000).cast("long").alias("duration_ms"),
        F.col("events"),
    )


def double_pointers(links: DataFrame) -> DataFrame:
    """Follow links (s, at -> to) to their roots by doubling.

    links has one row per node that has a predecessor; a node without a row is a root. Each round replaces every pointer
    by its target's pointer, so a chain of n links takes log2(n) rounds.
    """
    pointers = links
    while True:
        nxt = pointers.select("s", F.col("at").alias("to"), F.col("to").alias("far"))
        step = staged(
            pointers.join(nxt, ["s", "to"], "left").select(
                "s", "at", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")
            )
        )
        moved = not step.where("moved").isEmpty()
        pointers = step.select("s", "at", "to")
        if not moved:
            return pointers
