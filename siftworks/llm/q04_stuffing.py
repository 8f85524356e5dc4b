"""Queries of problem 4."""

from pyspark.sql import functions as F

from ..runtime import table
from .pagebody import STUFFED, bodies, host_of, page_documents


def p4_found(spark, folder):
    pages = bodies(page_documents(table(spark, folder, "pages")))
    return pages.where(F.col("stuffing") > STUFFED).select(F.col("doc").cast("long").alias("page_id"))


def _url_key(url):
    """A url without its scheme, www., case and closing slash: some jobs spell the page's url otherwise."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://(www\.)?", ""), "/+$", "")


def p4_links(spark, folder):
    """Stuffed pages of each host with the median link counts of their completed crawl jobs; null where there are none."""
    stuffed = p4_found(spark, folder)
    host = host_of(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]+)", 1)).alias("domain")
    pages = table(spark, folder, "pages").select(F.col("id").alias("page_id"), host, _url_key(F.col("url")).alias("key")).distinct()
    jobs = table(spark, folder, "crawl_jobs").where("lower(trim(status)) = 'completed'")
    jobs = jobs.select("job_id", _url_key(F.col("url")).alias("key"), "internal_links_count", "external_links_count").distinct()
    return (
        stuffed.join(pages, "page_id")
        .join(jobs, "key", "left")
        .groupBy("domain")
        .agg(
            F.countDistinct("page_id").alias("pages"),
            F.percentile("internal_links_count", 0.5).alias("internal_links"),
            F.percentile("external_links_count", 0.5).alias("external_links"),
        )
    )


QUERIES = {"p4_found": p4_found, "p4_links": p4_links}
SQL = {}
