"""Queries of problem 1."""

from pyspark.sql import functions as F

from ..runtime import table
from .truncation import truncated


def p1_found(spark, folder):
    cases = truncated(table(spark, folder, "pages")).where("cut")
    return cases.select(F.col("page").alias("page_id"), F.col("field").alias("field_name"))


def p1_sources(spark, folder):
    """How often each site truncates each field."""
    values = truncated(table(spark, folder, "pages"))
    return values.groupBy(F.col("site").alias("site_id"), F.col("field").alias("field_name")).agg(
        F.count(F.lit(1)).alias("known"), F.count(F.when(F.col("cut"), 1)).alias("cut"), F.avg(F.col("cut").cast("double")).alias("share")
    )


QUERIES = {"p1_found": p1_found, "p1_sources": p1_sources}
SQL = {}
