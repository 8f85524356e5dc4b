"""Streams of search and click events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_folder


def source(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A file stream with the schema of a frame."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", path.rpartition("/")[2]).parquet(path.rpartition("/")[0])


def session_counts(events: DataFrame, gap: str = "24 hours", late: str = "1 day") -> DataFrame:
    """Events per session window, closed by inactivity."""
    known = events.where("session_id is not null and created_at is not null").withWatermark("created_at", late)
    w = F.session_window("created_at", gap).alias("w")
    return known.groupBy("session_id", w).agg(F.count(F.lit(1)).alias("events")).select("session_id", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "events")


def click_counts(clicks: DataFrame, late: str = "1 day") -> DataFrame:
    """Clicks and successes per page and day: counters that grow as events arrive."""
    known = clicks.where("page_id is not null and clicked_at is not null").withWatermark("clicked_at", late)
    per = known.groupBy("page_id", F.window("clicked_at", "1 day").alias("w"))
    return per.agg(F.count(F.lit(1)).alias("clicks"), F.count_if(F.coalesce("is_success_signal", F.lit(False))).alias("successes")).select("page_id", F.col("w.start").alias("day"), "clicks", "successes")


def rapid(clicks: DataFrame, most: int = 2, late: str = "1 day") -> DataFrame:
    """Pages with more than `most` clicks within a minute."""
    known = clicks.where("clicked_at is not null").withWatermark("clicked_at", late)
    per = known.groupBy("page_id", F.window("clicked_at", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("clicks"))
    return per.where(F.col("clicks") > most).select("page_id", F.col("w.start").alias("minute"), "clicks")


def once(events: DataFrame, key: str = "id", time: str = "created_at", late: str = "1 day") -> DataFrame:
    """Every key once within the watermark."""
    return events.where(F.col(time).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now and give its result table."""
    spark = stream.sparkSession
    name = "siftworks_" + uuid.uuid4().hex
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
