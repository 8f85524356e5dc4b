"""Sinks as frames: upsert, replace by key, delete. The caller writes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All new rows and the old rows whose key has no new row."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns))


def replace_group(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """As upsert for keys with several rows: the old rows of a key make way for the new ones."""
    return upsert(old, new, key)


def delete(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; unknown does not delete."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def clipped(rows: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """Text columns cut to the length their sink allows."""
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in lengths.items()})
