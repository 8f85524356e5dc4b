import pytest

import __spark_entry__

COLUMNS = "id long, search_event_id long, page_id long, clicked_at timestamp"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Searches 5 and 97 + 5: pages 100, 3, 197; 3, 3, 100; 7 alone. 3, 100 and 197 have one residue of 97."""
    from datetime import datetime, timedelta, timezone

    start = datetime(2022, 1, 1, tzinfo=timezone.utc)
    rows = [(1, 5, 100, 0), (2, 5, 3, 1), (3, 5, 197, 2), (4, 102, 3, 5), (5, 102, 3, 6), (6, 102, 100, 6), (7, 9, 7, 0), (8, 9, None, 1), (3, 5, 197, 2), (9, 11, 400, 0), (10, 11, 100, 1)]
    where = str(tmp_path_factory.mktemp("clicks"))
    spark.createDataFrame([(i, s, p, start + timedelta(seconds=t)) for i, s, p, t in rows], COLUMNS).write.parquet(f"{where}/click_events.parquet")
    return where


def test_ranks_of_whole_page_ids(spark, folder):
    ranks = {r.node: r["rank"] for r in __spark_entry__.queries()["pagerank"](spark, folder).collect()}
    out = {100: [3], 3: [197, 100], 400: [100]}
    want = dict.fromkeys([3, 100, 197, 400], 1.0)
    for _ in range(8):
        got = dict.fromkeys(want, want[197] / 4)
        for src, to in out.items():
            for dst in to:
                got[dst] += want[src] / len(to)
        want = {n: 0.15 + 0.85 * x for n, x in got.items()}
    assert ranks == pytest.approx(want, abs=1e-6)


def test_levels_of_whole_page_ids(spark, folder):
    got = {(r.node, r.depth) for r in __spark_entry__.queries()["bfs_levels"](spark, folder).collect()}
    assert got == {(400, 0), (100, 1), (3, 2), (197, 3)}
