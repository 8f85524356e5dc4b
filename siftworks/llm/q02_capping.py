"""Queries of problem 2."""

from pyspark.sql import functions as F

from ..runtime import table
from .capping import capped, over_cap

RANKED = """
SELECT id, site_id, row_number() OVER (PARTITION BY site_id ORDER BY
    CASE WHEN pagerank_score IS NULL OR isnan(pagerank_score) THEN 1 ELSE 0 END,
    CASE WHEN isnan(pagerank_score) THEN NULL ELSE pagerank_score END DESC NULLS LAST, id) AS place,
  greatest(5, (SELECT count(DISTINCT id) FROM pages) // 100) AS cap
FROM (SELECT DISTINCT id, site_id, pagerank_score FROM pages)
"""


def p2_found(spark, folder):
    return over_cap(table(spark, folder, "pages")).select(F.col("id").alias("page_id"))


def p2_kept(spark, folder):
    """Kept pages of each site."""
    kept = capped(table(spark, folder, "pages").select("id", "site_id", "pagerank_score"))
    return kept.groupBy("site_id").agg(F.count(F.lit(1)).alias("kept"))


QUERIES = {"p2_found": p2_found, "p2_kept": p2_kept}
SQL = {
    "p2_found": f"SELECT id AS page_id FROM ({RANKED}) WHERE site_id IS NOT NULL AND place > cap",
    "p2_kept": f"SELECT site_id, count(*) AS kept FROM ({RANKED}) WHERE site_id IS NULL OR place <= cap GROUP BY site_id",
}
