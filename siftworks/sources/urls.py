"""Bulk lists of urls: CSV, JSON and plain text, brought to (url, domain)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import authority


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """First column url, second domain. A header row, whose first cell is url or link, may be there."""
    rows = spark.read.schema("url string, domain string").option("enforceSchema", "true").csv(path)
    return cleaned(rows.where(~F.lower(F.trim("url")).isin("url", "link")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of strings, or of objects with url or link and an optional domain."""
    items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("x"))
    key = lambda k: F.get_json_object("x", f"$.{k}")
    plain = F.when(~F.startswith(F.trim("x"), F.lit("{")), F.col("x"))
    return cleaned(items.select(F.coalesce(key("url"), key("link"), plain).alias("url"), key("domain").alias("domain")))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One url per line; blank lines and lines that begin with # are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return cleaned(lines.where("url <> '' and not startswith(url, '#')").withColumn("domain", F.lit(None).cast("string")))


def cleaned(rows: DataFrame, domain: str | None = None) -> DataFrame:
    """(url, domain): https:// where the scheme is missing, the host where the domain is; of one domain only, if given."""
    url = F.trim("url")
    url = F.when(F.rlike(url, F.lit("(?i)^https?://")), url).otherwise(F.concat(F.lit("https://"), url))
    out = rows.where(F.coalesce(F.trim("url"), F.lit("")) != "").select(url.alias("url"), F.lower(F.coalesce(F.nullif(F.trim("domain"), F.lit("")), authority(url))).alias("domain"))
    if domain:
        out = out.where((F.col("domain") == domain) | F.endswith("domain", F.lit("." + domain)))
    return out.distinct()


def merged(seeds: DataFrame, found: DataFrame) -> DataFrame:
    """(url, place): the seeds in their order, then the urls found in theirs, each url once. Both: url, place."""
    both = seeds.select("url", F.lit(0).alias("source"), "place").unionByName(found.select("url", F.lit(1).alias("source"), "place"))
    once = both.where(F.col("url").isNotNull()).groupBy("url").agg(F.min(F.struct("source", "place")).alias("first"))
    return once.select("url", "first.source", "first.place")
