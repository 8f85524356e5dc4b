"""Queries of problem 6."""

from pyspark.sql import functions as F

from ..runtime import table
from .sitelines import occurrences, repeated_lines, without_repeated

LINES = r"""
WITH p AS (SELECT DISTINCT id, site_id, content FROM pages WHERE site_id IS NOT NULL),
l AS (SELECT id, site_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM p),
k AS (SELECT id, site_id, line_no, regexp_replace(lower(trim(regexp_replace(line, '[\s\p{Z}\x{85}\x0b]+', ' ', 'g'))), '\p{Nd}+', '0', 'g') AS key FROM l),
n AS (SELECT site_id, key, count(DISTINCT id) AS pages FROM k WHERE key <> '' GROUP BY ALL),
o AS (SELECT n.* FROM n JOIN (SELECT site_id, count(*) AS total FROM p GROUP BY site_id) USING (site_id) WHERE pages >= 5 AND pages * 10 >= total)
"""


def _lines(spark, folder, **more):
    return repeated_lines(table(spark, folder, "pages"), **more)


def p6_found(spark, folder):
    return occurrences(*_lines(spark, folder)).withColumnRenamed("page", "page_id")


def p6_lines(spark, folder):
    """Repeated lines per site, with the distinct documents and crawl dates they were seen in."""
    often = _lines(spark, folder, date=F.col("last_crawled_at"))[1]
    return often.groupBy("site").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("pages").alias("pages"), F.sum("clusters").alias("clusters"), F.sum("dates").alias("dates")
    )


def p6_cleaned(spark, folder):
    """Every content without the lines that at least five different documents of its site hold, of two dates or more.

    An article that several pages give out is one document, so its lines stay, other than in p6_found, which counts pages.
    """
    pages = table(spark, folder, "pages")
    often = repeated_lines(pages, date=F.col("last_crawled_at"), at_least_clusters=5, at_least_dates=2)[1]
    return without_repeated(pages, often).withColumnRenamed("page", "page_id")


QUERIES = {"p6_found": p6_found, "p6_lines": p6_lines, "p6_cleaned": p6_cleaned}
SEEN = LINES + """, s AS (SELECT k.site_id, k.key, count(DISTINCT p.content) AS clusters, count(DISTINCT CAST(p.day AS DATE)) AS dates, count(DISTINCT CASE WHEN p.day IS NOT NULL THEN p.content END) AS dated
  FROM k JOIN (SELECT DISTINCT id, content, last_crawled_at AS day FROM pages) p ON p.id = k.id JOIN o ON o.site_id = k.site_id AND o.key = k.key GROUP BY ALL)
"""
SQL = {
    "p6_lines": SEEN + "SELECT site_id AS site, count(*) AS lines, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(clusters) AS BIGINT) AS clusters, CAST(sum(dates) AS BIGINT) AS dates FROM o JOIN s USING (site_id, key) GROUP BY site_id",
    "p6_cleaned": SEEN + """, b AS (SELECT site_id, key FROM s WHERE clusters >= 5 AND (dates >= 2 OR dated < 2)), a AS (SELECT DISTINCT id, site_id, content FROM pages),
u AS (SELECT id, site_id, line_no, line FROM (SELECT id, site_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM a WHERE content IS NOT NULL)),
v AS (SELECT u.id, string_agg(u.line, chr(10) ORDER BY u.line_no) FILTER (b.key IS NULL) AS content FROM u LEFT JOIN k ON k.id = u.id AND k.line_no = u.line_no LEFT JOIN b ON b.site_id = k.site_id AND b.key = k.key GROUP BY u.id)
SELECT a.id AS page_id, CASE WHEN a.content IS NOT NULL THEN coalesce(v.content, '') END AS content FROM a LEFT JOIN v USING (id)""",
    "p6_found": LINES + "SELECT k.id AS page_id, CAST(line_no AS INT) AS line_no FROM k JOIN o USING (site_id, key)",
}
