import random
from datetime import datetime, timedelta, timezone

from siftworks.operators.behaviour import search_sequence

START = datetime(2022, 1, 1, tzinfo=timezone.utc)


def test_sequence_goes_on_over_midnight(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), START + timedelta(seconds=rng.randrange(9 * 86_400))) for i in range(60)]
    rows += [(100, 7, START + timedelta(hours=23)), (101, 7, START + timedelta(hours=23)), (102, 7, START + timedelta(days=5)), (103, None, START), (104, 7, None)]
    want = set()
    for s in {r[1] for r in rows} - {None}:
        events = sorted((t, i) for i, x, t in rows if x == s and t is not None)
        for k, (t, i) in enumerate(events):
            after = (events[k + 1][0] - t) // timedelta(milliseconds=1) if k + 1 < len(events) else None
            want.add((i, s, k + 1, (t - events[k - 1][0]).total_seconds() if k else None, after, k == len(events) - 1))
    got = search_sequence(spark.createDataFrame(rows, "id long, session_id long, created_at timestamp"))
    assert {tuple(r) for r in got.collect()} == want
    assert dict(got.dtypes)["number"] == "int" and got.count() == len(want)
