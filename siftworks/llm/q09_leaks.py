"""Queries of problem 9."""

from pyspark.sql import functions as F

from ..runtime import table
from .leaks import PASSAGE, leaked
from .textform import skeleton_sql


def _leaked(spark, folder, edited=False):
    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"), edited=edited)


def p9_found(spark, folder):
    rows = _leaked(spark, folder).where(F.col("run") >= PASSAGE)
    return rows.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p9_alignments(spark, folder):
    """Every document that shares a seed with an item, with its alignment; copies with edits show in share."""
    return _leaked(spark, folder, edited=True).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p9_items(spark, folder):
    """Per leaked item the number of documents that hold a passage of it."""
    return p9_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_alignments": p9_alignments, "p9_items": p9_items}
_words = lambda text: f"regexp_extract_all(lower({skeleton_sql(text)}), '[\\p{{L}}\\p{{N}}]+')"
_passages = f"unnest(list_transform(range(1, len(w) - {PASSAGE - 2}), lambda i: array_to_string(w[i:i + {PASSAGE - 1}], ' ')))"
LEAKED = f"""WITH d AS (SELECT DISTINCT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL), q AS (SELECT DISTINCT item_id, {_words('text')} AS w FROM eval_items WHERE text IS NOT NULL),
x AS (SELECT DISTINCT doc_id, {_passages} AS passage FROM d WHERE len(w) >= {PASSAGE}), y AS (SELECT DISTINCT item_id, {_passages} AS passage FROM q WHERE len(w) >= {PASSAGE}),
leaked AS (SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (passage))
"""
SQL = {"p9_found": LEAKED + "SELECT * FROM leaked", "p9_items": LEAKED + "SELECT item_id, count(*) AS documents FROM leaked GROUP BY item_id"}
