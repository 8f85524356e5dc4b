"""Logical tables over the test tables, as frames and as SQL, and helpers to write reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.content import GATE, PATTERNS, URL_TYPES, url_type
from ..functions.ranking import at
from ..functions.text import domain
from ..operators.search import latest
from ..runtime import table

AS_OF = "2022-01-31 00:00:00"
NOW = f"TIMESTAMPTZ '{AS_OF}+00'"
QUERY = "museum"


def as_of():
    return at(AS_OF)


def content(spark, folder, once: bool = True) -> DataFrame:
    """Pages as indexed content; quality is the length of the text over 3000 characters, 1 at most.

    once: repeated rows count once. What reads the text itself leaves that to the end, when only narrow rows are left:
    repeated rows are equal, so whatever is made of them is, too.
    """
    pages = table(spark, folder, "pages").select(
        "id", "url", domain(F.col("url")).alias("domain"), "title", "h1", "content", F.col("og_description").alias("description"), "og_title", "og_image_url", "jsonld",
        url_type(F.col("url")).alias("content_type"), F.when(F.col("content").isNotNull(), F.least(F.lit(1.0), F.length("content") / 3000)).alias("quality_score"), "pagerank_score", "click_score", "tracker_risk_score", "last_crawled_at", "site_id",
    )
    return pages.dropDuplicates(["id"]) if once else pages


def jobs(spark, folder) -> DataFrame:
    """Crawl jobs in their latest state."""
    rows = table(spark, folder, "crawl_jobs").withColumn("status", F.lower(F.trim("status")))
    order = [F.desc_nulls_last("completed_at"), F.desc_nulls_last("started_at"), F.asc_nulls_last("status"), F.asc_nulls_last("title"), F.asc_nulls_last("word_count")]
    return latest(rows, "job_id", *order).withColumn("domain", F.regexp_replace(F.lower("domain"), r"^www\.", ""))


def html_rows(spark, folder, features) -> DataFrame:
    """features(jobs with HTML) of the jobs whose latest state holds HTML: job_id and narrow columns.

    Which state is the latest is found on narrow rows with a hash of the HTML; the HTML itself is only read where it lies.
    """
    digest = F.xxhash64("content").alias("digest")
    order = [F.desc_nulls_last("completed_at"), F.desc_nulls_last("started_at"), F.asc_nulls_last("status"), F.asc_nulls_last("title"), F.asc_nulls_last("word_count")]
    rows = table(spark, folder, "crawl_jobs").withColumn("status", F.lower(F.trim("status"))).withColumn("domain", F.regexp_replace(F.lower("domain"), r"^www\.", ""))
    rows = rows.withColumn("digest", F.when(F.col("content").isNotNull(), digest))
    known = latest(rows.select("job_id", "completed_at", "started_at", "status", "title", "word_count", "digest"), "job_id", *order)
    found = features(rows.where("digest is not null"))
    return found.join(known.select("job_id", "digest"), ["job_id", "digest"], "left_semi").drop("digest").distinct()


def searches(spark, folder) -> DataFrame:
    return table(spark, folder, "search_events").dropDuplicates(["id"])


def clicks(spark, folder) -> DataFrame:
    return table(spark, folder, "click_events").dropDuplicates(["id"])


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_any(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(p)})" for p in parts) + ")"


def sql_case(cases: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {default} END"


def sql_domain(url: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':[0-9]+$', ''), '^www\.', '')"


def sql_path(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def sql_days(start: str, end: str) -> str:
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / 86400000000.0) AS INT)"


def sql_url_type(url: str) -> str:
    return sql_case([(sql_any(f"lower({url})", p), quoted(n)) for n, p in URL_TYPES.items()], "'blog'")


def sql_per_type(kind: str, pick) -> str:
    return sql_case([(f"{kind} = {quoted(n)}", str(pick(r))) for n, r in GATE.items()], str(pick(GATE["blog"])))


CONTENT = f"""content AS (SELECT id, url, {sql_domain("url")} AS domain, title, h1, content, og_description AS description, og_title, og_image_url, jsonld,
  {sql_url_type("url")} AS content_type, CASE WHEN content IS NOT NULL THEN least(1.0::DOUBLE, length(content) / 3000) END AS quality_score, pagerank_score, click_score, tracker_risk_score, last_crawled_at, site_id
  FROM (SELECT DISTINCT * FROM pages))"""
JOBS = r"""jobs AS (SELECT * EXCLUDE (place, domain, status), status, regexp_replace(lower(domain), '^www\.', '') AS domain FROM (SELECT * EXCLUDE (status), lower(trim(status)) AS status,
  row_number() OVER (PARTITION BY job_id ORDER BY completed_at DESC NULLS LAST, started_at DESC NULLS LAST, lower(trim(status)) ASC NULLS LAST, title ASC NULLS LAST, word_count ASC NULLS LAST) AS place FROM crawl_jobs) WHERE place = 1)"""
SEARCHES = "searches AS (SELECT DISTINCT * FROM search_events)"
CLICKS = "clicks AS (SELECT DISTINCT * FROM click_events)"
SCHEMA_TYPES = {s for _, _, schemas in PATTERNS.values() for s in schemas}
