"""Scores of clicks and sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import days_between


def click_success(dwell_ms: Column, scroll: Column, signals: Column) -> Column:
    """Reason of a successful click, or null: a stay over 30 s, over half of the page read, or any true signal."""
    known = F.from_json(signals, "map<string,string>")
    truthy = F.exists(F.map_values(known), lambda v: ~F.coalesce(v, F.lit("")).isin("", "false", "0", "null", "[]", "{}"))
    return (
        F.when(dwell_ms > 30000, F.lit("long_stay"))
        .when(~F.isnan(scroll) & (scroll > 0.5), F.lit("thorough_read"))
        .when(F.coalesce(truthy, F.lit(False)), F.lit("interaction"))
    )


def session_trust(days: Column, searches: Column, success: Column, anomalies: Column) -> Column:
    grown = 0.5 + F.least(F.lit(0.3), days / 30.0) + F.least(F.lit(0.2), searches / 50.0) + 0.2 * success
    return F.greatest(F.lit(0.1), F.least(F.lit(1.5), grown - F.least(F.lit(0.5), 0.1 * anomalies)))


def time_decay(last: Column, as_of: Column, rate: float = 0.1) -> Column:
    """exp(-rate * whole days), 1 within the last day."""
    return F.when(last < as_of - F.expr("INTERVAL 1 DAY"), F.exp(-rate * days_between(last, as_of))).otherwise(F.lit(1.0))


def success_rate(impressions: Column, successes: Column) -> Column:
    return F.when(impressions > 0, F.least(F.lit(1.0), successes / impressions)).otherwise(F.lit(0.0))


def recency_weight(last: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.1), F.exp(-0.1 * days_between(last, as_of)))


def user_category(trust: Column, days: Column, anomalous: Column) -> Column:
    return (
        F.when(trust >= 0.8, F.lit("trusted_long_term"))
        .when((trust >= 0.5) & (days >= 7), F.lit("established"))
        .when((trust >= 0.3) & ~anomalous, F.lit("normal"))
        .when(anomalous, F.lit("suspicious"))
        .otherwise(F.lit("new"))
    )
