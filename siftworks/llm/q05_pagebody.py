"""Queries of problem 5."""

from pyspark.sql import functions as F

from ..runtime import table
from .pagebody import STUFFED, bodies, job_documents, page_documents


def _bodies(spark, folder):
    pages, jobs = table(spark, folder, "pages"), table(spark, folder, "crawl_jobs")
    return bodies(page_documents(pages).unionByName(job_documents(jobs)))


def p5_found(spark, folder):
    found = _bodies(spark, folder).where(F.col("stuffing") <= STUFFED)
    return found.select(F.col("kind").alias("table_name"), F.col("doc").alias("row_key"), F.explode("body").alias("line_no"))


def p5_sizes(spark, folder):
    """Body lines of each table's documents."""
    return _bodies(spark, folder).groupBy(F.col("kind").alias("table_name")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.size("body")).alias("lines"), F.count(F.when(F.col("stuffing") > STUFFED, 1)).alias("stuffed")
    )


QUERIES = {"p5_found": p5_found, "p5_sizes": p5_sizes}
SQL = {}
