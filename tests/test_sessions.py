from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siftworks.operators.sessions import sessionize

SCHEMA = "id long, session_id long, created_at timestamp, events string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def brute(rows):
    by = {}
    for i, s, t, _ in set(rows):
        if s is not None and t is not None:
            by.setdefault(s, set()).add((t, i))
    out = set()
    for s, events in by.items():
        run = []
        for t, i in sorted(events, key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
            if run and (t - run[-1][0]).total_seconds() > 1800:
                out.add((s, run[0][1], run[-1][1], len(run)))
                run = []
            run.append((t, i))
        out.add((s, run[0][1], run[-1][1], len(run)))
    return out


def got(spark, rows):
    frame = sessionize(spark.createDataFrame(rows, SCHEMA))
    return {(r.session_id, r.first_event_id, r.last_event_id, r.events) for r in frame.collect()}


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_gap_of_exactly_half_an_hour_does_not_split(spark):
    rows = [(1, 7, at(0), "x"), (2, 7, at(1800), "x"), (3, 7, at(3600.000001), "x")]
    assert got(spark, rows) == {(7, 1, 2, 2), (7, 3, 3, 1)}


def test_nulls_repeats_and_ties(spark):
    rows = [(5, 1, at(0), None), (5, 1, at(0), None), (4, 1, at(0), "y"), (6, None, at(0), ""), (7, 1, None, ""), (None, 2, at(9), "")]
    assert got(spark, rows) == {(1, 4, 5, 2), (2, None, None, 1)}


def test_empty(spark):
    assert got(spark, []) == set()


def test_one_session_over_many_buckets(spark):
    rows = [(i, 1, at(1700 * i), "") for i in range(40)] + [(99, 1, at(1700 * 39 + 1801), "")]
    assert got(spark, rows) == {(1, 0, 39, 40), (1, 99, 99, 1)}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 500), st.integers(1, 3), st.integers(0, 60000)), max_size=60, unique_by=lambda x: x[0]))
def test_against_brute_force(spark, events):
    rows = [(i, s, at(t), "") for i, s, t in events]
    assert got(spark, rows) == brute(rows)
