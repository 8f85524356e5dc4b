"""Problem 6: lines repeated over the documents of one site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import spread, staged


def line_keys(content: Column) -> Column:
    """A hash per line, null for blank lines: trimmed, inner white space to one blank, lower case, digit runs equal.

    The whole text is brought into that form before it is split at LF, so that the regular expressions run once per text.
    """
    form = F.lower(content)
    form = F.regexp_replace(form, r"(?U)[\s&&[^\n]]+", " ")
    form = F.regexp_replace(form, " ?\n ?", "\n")
    form = F.trim(F.regexp_replace(form, r"\p{Nd}+", "0"))
    return F.transform(F.split(form, "\n", -1), lambda x: F.when(x != "", F.xxhash64(x)))


def repeated_lines(
    pages: DataFrame,
    site: str = "site_id",
    page: str = "id",
    content: str = "content",
    date: Column | None = None,
    at_least: int = 5,
    share: tuple[int, int] = (1, 10),
    at_least_clusters: int = 1,
    at_least_dates: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(site, page, keys) of every page with content, and (site, key, pages, clusters, dates) of the repeated lines.

    A line is repeated if it occurs in at_least different pages of its site and in `share` (a fraction) of all pages of
    the site, those without content included. Pages of a site with equal content are collapsed to one cluster first;
    a line is counted once per cluster, with the cluster's number of pages as its weight, so pages are counted exactly
    while each text is opened once. at_least_clusters and at_least_dates demand that many distinct clusters and
    publication dates besides, so that republished articles are no boilerplate; by default they only report. Dates are
    demanded of lines that have as many clusters with a date.

    Pages without site or id are left out. Null content has no lines, blank lines are none. Repeated rows count once.
    An empty table gives no rows. Other columns are ignored.
    """
    day = F.to_date(date) if date is not None else F.lit(None).cast("date")
    named = pages.where(F.col(site).isNotNull() & F.col(page).isNotNull())
    rows = named.select(F.col(site).alias("site"), F.col(page).alias("page"), F.col(content).alias("content"), day.alias("day"))
    rows = spread(rows).select(
        "site",
        "page",
        "day",
        F.when(F.col("content").isNotNull(), F.struct(F.xxhash64("content").alias("a"), F.length("content").alias("b"))).alias("same"),
        line_keys(F.col("content")).alias("keys"),
    )
    rows = staged(rows.dropDuplicates(["site", "page"]))
    totals = rows.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    clusters = (
        rows.where("same is not null")
        .groupBy("site", "same")
        .agg(F.count(F.lit(1)).alias("n"), F.collect_set("day").alias("days"), F.first("keys").alias("keys"))
    )
    counted = (
        clusters.select("site", "n", "days", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
        .groupBy("site", "key")
        .agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("clusters"), F.count(F.when(F.size("days") > 0, 1)).alias("dated"))
        .where(F.col("pages") >= at_least)
    )
    often = counted.join(totals, "site").where(F.col("pages") * share[1] >= F.col("total") * share[0])
    often = staged(often.drop("total"))
    dates = (
        clusters.select("site", F.explode("days").alias("day"), F.array_distinct(F.array_compact("keys")).alias("keys"))
        .select("site", "day", F.explode("keys").alias("key"))
        .join(often.select("site", "key"), ["site", "key"], "left_semi")
        .distinct()
        .groupBy("site", "key")
        .agg(F.count(F.lit(1)).alias("dates"))
        if date is not None
        else None
    )
    often = often.join(dates, ["site", "key"], "left").fillna(0, ["dates"]) if dates is not None else often.withColumn("dates", F.lit(0).cast("long"))
    several = (F.col("clusters") >= at_least_clusters) & ((F.col("dates") >= at_least_dates) | (F.col("dated") < at_least_dates))
    return rows, often.where(several).drop("dated")


def occurrences(rows: DataFrame, often: DataFrame) -> DataFrame:
    """(page, line_no) of every repeated line; a site has at most ten times as many of them as a page has lines."""
    per_site = often.groupBy("site").agg(F.collect_set("key").alias("often"))
    placed = F.transform("keys", lambda key, i: F.when(F.array_contains("often", key), i + 1))
    return rows.where("keys is not null").join(per_site, "site").select("page", F.explode(F.array_compact(placed)).alias("line_no"))


def without_repeated(pages: DataFrame, often: DataFrame, site: str = "site_id", page: str = "id", content: str = "content") -> DataFrame:
    """(page, content): every page with its repeated lines removed, once per id; pages without site stay as they are."""
    per_site = often.groupBy("site").agg(F.collect_set("key").alias("often"))
    rows = pages.where(F.col(page).isNotNull()).select(F.col(site).alias("site"), F.col(page).alias("page"), F.col(content).alias("content"))
    kept = F.filter(
        F.arrays_zip(F.split("content", "\n", -1).alias("line"), F.col("keys")),
        lambda x: ~F.coalesce(F.array_contains("often", x["keys"]), F.lit(False)),
    )
    return (
        rows.withColumn("keys", line_keys(F.col("content")))
        .join(per_site, "site", "left")
        .select("page", F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("content"))
        .dropDuplicates(["page"])
    )
