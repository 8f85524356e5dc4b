"""Queries of problem 8."""

from pyspark.sql import functions as F

from ..runtime import table
from .packing import packed, token_counts


def _packed(spark, folder):
    return packed(token_counts(table(spark, folder, "documents")), table(spark, folder, "context_windows"))


def p8_containers(spark, folder):
    return _packed(spark, folder).withColumnRenamed("id", "doc_id")


def p8_fill(spark, folder):
    """Per capacity the containers, the tokens in them, the share of the room that is used, and overfull containers."""
    per = _packed(spark, folder).groupBy("window_id", "container_id").agg(F.sum("tokens").alias("tokens"))
    windows = table(spark, folder, "context_windows").select("window_id", "capacity_tokens")
    return (
        per
        .join(windows, "window_id")
        .groupBy("window_id")
        .agg(
            F.count(F.lit(1)).alias("containers"),
            F.sum("tokens").alias("tokens"),
            (F.sum("tokens") / F.sum("capacity_tokens")).alias("used"),
            F.count(F.when(F.col("tokens") > F.col("capacity_tokens"), 1)).alias("overfull"),
        )
    )


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
SQL = {}
