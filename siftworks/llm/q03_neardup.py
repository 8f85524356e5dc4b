"""Queries of problem 3."""

from pyspark.sql import functions as F

from ..runtime import table
from .neardup import classes_and_links, grouped, similar_pairs


def _pages(spark, folder):
    return classes_and_links(table(spark, folder, "pages"), "id", "content", words=3, at_least=(3, 5))


def p3_found(spark, folder):
    pairs = similar_pairs(*_pages(spark, folder))
    return pairs.select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"))


def p3_groups(spark, folder):
    """One row per page with its group and its number of links."""
    return grouped(*_pages(spark, folder)).select(F.col("id").alias("page_id"), "links", "group_id")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
SQL = {
    "p3_found": r"""
WITH p AS (SELECT DISTINCT id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM pages WHERE content IS NOT NULL),
s AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM p WHERE len(w) >= 3),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT a AS page_id_a, b AS page_id_b FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b WHERE c * 5 >= (x.n + y.n - c) * 3
"""
}
