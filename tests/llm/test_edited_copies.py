import random

import pytest

from siftworks.llm import leaks


@pytest.mark.parametrize("sent", [leaks.SENT, 0])
def test_copies_with_edits_are_aligned(spark, monkeypatch, sent):
    """Every tenth word of an item changed, at ten offsets, beside documents that hold one rarer seed of it."""
    monkeypatch.setattr(leaks, "SENT", sent)
    rng = random.Random(5)
    item = [f"w{k}" for k in range(60)]
    docs = []
    for k in range(10):
        copy = [f"x{k}y{i}" if i % 10 == k else w for i, w in enumerate(item)]
        docs.append((k, " ".join([f"a{rng.random()}" for _ in range(k)] + copy)))
    docs += [(20 + k, " ".join(item[k : k + 5])) for k in range(0, 55, 3)] + [(90, " ".join(item[:4])), (91, "other words stand here and there")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc: r for r in leaks.leaked(d, q, edited=True).collect()}
    assert set(got) == {k for k, _ in docs} - {90, 91}
    for k in range(10):
        assert (got[k].run, got[k].score) == (9, 54 * 2 - sum(0 < i < 59 for i in range(60) if i % 10 == k))
    assert leaks.leaked(d, q).where("run >= 12").count() == 0
