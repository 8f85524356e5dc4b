"""Crawl jobs as data: new jobs, states from an event log, the frontier search, and the way from jobs to indexed content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import quality
from ..runtime import staged


def new_jobs(urls: DataFrame, scores: DataFrame, as_of: Column) -> DataFrame:
    """Jobs for (session_id, domain, url, depth, max_depth): pending, with 100 minus the known score of the url as priority.

    scores: url, score, one row per url; 50 where none is known, or it is 0. The id is a hash of session and url.
    """
    score = F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(50.0))
    known = urls.join(scores.select("url", "score"), "url", "left").withColumn("page_value_score", score).drop("score")
    return known.select(
        F.sha2(F.concat_ws("/", "session_id", "url"), 256).alias("job_id"), "session_id", "domain", "url", F.lit("pending").alias("status"),
        (100 - F.col("page_value_score")).cast("int").alias("priority"), "depth", "max_depth", "page_value_score", as_of.alias("created_at"),
    )


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, started_at, completed_at) of an event log (job_id, status, at): the last event's status, the last
    time it was set to processing and to completed. Equal times are ordered by status; events without a time come first."""
    when = lambda s: F.max(F.when(F.col("status") == s, F.col("at")))
    last = F.max(F.struct("at", "status"))["status"]
    return events.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(last.alias("status"), when("processing").alias("started_at"), when("completed").alias("completed_at"))


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int, max_pages: int | None = None, per_page: int = 20, allowed: DataFrame | None = None, recent: DataFrame | None = None) -> DataFrame:
    """(url, depth): breadth-first search over links (src, dst, position) from seeds (url).

    Every page hands on its first per_page distinct links. allowed: (url) that robots rules permit, recent: (url) crawled
    within the recrawl window; neither disallowed nor recent pages are visited or followed. Of a level that would exceed
    max_pages the first urls in order are taken. One anti-join a level, each level is written.
    """
    first = links.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("position").alias("position"))
    first = first.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("position", "dst"))), 1, per_page).alias("l"))
    first = staged(first.select("src", F.explode("l.dst").alias("dst")))

    def open_urls(urls: DataFrame) -> DataFrame:
        urls = urls.where("url is not null").distinct()
        urls = urls.join(allowed.select("url").distinct(), "url", "left_semi") if allowed is not None else urls
        return urls.join(recent.select("url").distinct(), "url", "left_anti") if recent is not None else urls

    def level(urls: DataFrame, depth: int, left: int | None) -> DataFrame:
        urls = urls if left is None else urls.orderBy("url").limit(left)
        return staged(urls.select("url", F.lit(depth).alias("depth")))

    front = seen = level(open_urls(seeds.select("url")), 0, max_pages)
    left = None if max_pages is None else max_pages - front.count()
    for depth in range(1, max_depth + 1):
        if left == 0:
            break
        step = open_urls(first.join(front.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")))
        front = level(step.join(seen, "url", "left_anti"), depth, left)
        n = front.count()
        if not n:
            break
        left = None if left is None else left - n
        seen = seen.unionByName(front)
    return seen


def gated(rows: DataFrame) -> DataFrame:
    """Rows with outcome (indexed, filtered, or skipped without content) and reason, by the quality gate of their type.

    rows: content_type, content, url, title, og_title, description, og_image_url, h1, h2_count, analysis, value.
    """
    q = quality(*(F.col(x) for x in ("content_type", "content", "url", "title", "og_title", "description", "description", "og_image_url", "h1", "h2_count", "analysis", "value")))
    outcome = F.when(F.coalesce("content", F.lit("")) == "", F.lit("skipped")).when(F.col("_q.indexed"), F.lit("indexed")).otherwise(F.lit("filtered"))
    return rows.withColumn("_q", q).withColumns({"outcome": outcome, "quality_score": F.col("_q.score"), "reason": F.col("_q.reason")}).drop("_q")


def index(rows: DataFrame, content: DataFrame, images: DataFrame, icons: DataFrame, found_images: DataFrame, found_icons: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after indexing: content by url, images by url of their page, one icon per domain.

    rows: gated rows with the columns of content; only the indexed ones enter. found_images and found_icons: url, ...
    and domain, ... of the same pages. What is there for a key makes way.
    """
    passed = staged(rows.where("outcome = 'indexed'"))
    fresh = passed.select(*content.columns).dropDuplicates(["url"])
    new_images = found_images.join(fresh.select("url"), "url", "left_semi").select(*images.columns)
    new_icons = found_icons.join(passed.select("domain").distinct(), "domain", "left_semi").select(*icons.columns).dropDuplicates(["domain"])
    out = []
    for old, new, key, gone in ((content, fresh, "url", fresh), (images, new_images, "url", fresh), (icons, new_icons, "domain", new_icons)):
        out.append(old.join(gone.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new))
    return tuple(out)


def index_counters(gate: DataFrame) -> DataFrame:
    """Per content type the rows indexed, filtered and skipped."""
    return gate.groupBy("content_type").agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("indexed", "filtered", "skipped")])


def meaningful_alts(images: Column, least: int = 3) -> Column:
    """Images of an array whose alternative text has at least so many characters."""
    return F.size(F.filter(images, lambda i: F.length(F.coalesce(i["alt"], F.lit(""))) >= least))


def append(rows: DataFrame, path: str) -> None:
    """Append events to a table of files; every column keeps its type."""
    rows.write.mode("append").parquet(path)


def decoded(data: Column, charset: Column | None = None) -> Column:
    """Text of bytes by the charset named; without one as UTF-8 where that is valid, else as ISO-8859-1."""
    guess = F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8")).otherwise(F.decode(data, "ISO-8859-1"))
    if charset is None:
        return guess
    name = F.upper(F.trim(charset))
    out = guess
    for known in ("UTF-8", "ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16LE", "UTF-16BE"):
        out = F.when(name == known, F.decode(data, known)).otherwise(out)
    return out
