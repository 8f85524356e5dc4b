"""Problem 10: one form for visually identical text, and the pairs only this form makes equal."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import spread, staged
from .textform import canonical, skeleton


@F.pandas_udf(T.StringType())
def canonical_text(text: pd.Series) -> pd.Series:
    return text.map(canonical, na_action="ignore")


@F.pandas_udf(T.StructType().add("form", "binary").add("text", "binary"))
def _digests(text: pd.Series) -> pd.DataFrame:
    both = [
        (xxhash.xxh3_128_digest(skeleton(x).encode("utf-8", "surrogatepass")), xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")))
        for x in text
    ]
    return pd.DataFrame(both, columns=["form", "text"])


def canonical_form(records: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, canonical): every text in its one form. Null stays null, empty stays empty, repeated rows stay."""
    return records.select(F.col(id_col), canonical_text(F.col(text_col)).alias("canonical"))


def equal_looking(records: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(form, text, id): records whose skeleton also stands for another string; form and text are digests.

    Originals are grouped by equal skeleton in two steps: a partial aggregate of the least and the greatest text digest
    finds the skeletons with more than one string, and only their records go on. Rows without text are left out, an
    empty text is a text; repeated rows of an id count once, and an empty table gives no rows.
    """
    known = records.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col)
    h = staged(spread(known).select(F.col(id_col).alias("id"), _digests(F.col(text_col)).alias("d")).select("id", "d.form", "d.text"))
    several = h.groupBy("form").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("form")
    return h.join(several, "form").dropDuplicates(["id", "text"])


def equal_looking_pairs(records: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b), a < b: pairs of ids whose texts differ and have the same skeleton.

    The strings of a skeleton are paired first, their copies are joined to those pairs after, so that the work is that
    of the result also where one skeleton has very many copies.
    """
    members = staged(equal_looking(records, id_col, text_col))
    texts = members.select("form", "text").distinct()
    variants = texts.join(texts.select("form", F.col("text").alias("other")), "form").where("text <> other")
    left = members.select("form", "text", F.col("id").alias("a"))
    right = members.select("form", F.col("text").alias("other"), F.col("id").alias("b"))
    return left.join(variants, ["form", "text"]).join(right, ["form", "other"]).where("a < b").select("a", "b").distinct()
