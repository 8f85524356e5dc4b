"""Queries of problem 10."""

from pyspark.sql import functions as F

from ..runtime import table
from .lookalike import canonical_form, equal_looking, equal_looking_pairs
from .textform import skeleton_sql


def p10_found(spark, folder):
    pairs = equal_looking_pairs(table(spark, folder, "documents"))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_canonical(spark, folder):
    return canonical_form(table(spark, folder, "documents"))


def p10_groups(spark, folder):
    """Documents that share a skeleton with another string, with the smallest id of their group."""
    members = equal_looking(table(spark, folder, "documents"))
    groups = members.groupBy("form").agg(F.min("id").alias("group_id"))
    return members.join(groups, "form").select(F.col("id").alias("doc_id"), "group_id")


QUERIES = {"p10_found": p10_found, "p10_canonical": p10_canonical, "p10_groups": p10_groups}
FORMS = f"WITH d AS (SELECT DISTINCT doc_id, text, {skeleton_sql('text')} AS f FROM documents WHERE text IS NOT NULL)"
SQL = {
    "p10_found": FORMS + " SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.f = b.f AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p10_groups": FORMS + ", g AS (SELECT f, min(doc_id) AS group_id FROM d GROUP BY f HAVING count(DISTINCT text) > 1) SELECT doc_id, group_id FROM d JOIN g USING (f)",
}
