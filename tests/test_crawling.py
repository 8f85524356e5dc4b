"""Jobs, frontier, index and profiles: values by hand, and searches against brute force."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from siftworks.functions import pagevalue, relevance, trackers
from siftworks.operators import behaviour, crawling, graph, html, search, spam
from siftworks.sources import urls

START = datetime(2022, 1, 1, tzinfo=timezone.utc)


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_new_jobs(spark):
    asked = spark.createDataFrame([("s", "test.example.com", f"https://test.example.com/{x}", 1, 3) for x in "abc"], "session_id string, domain string, url string, depth int, max_depth int")
    scores = spark.createDataFrame([("https://test.example.com/b", 82.5), ("https://test.example.com/c", 0.0)], "url string, score double")
    got = crawling.new_jobs(asked, scores, F.lit(START))
    assert rows(got, "url", "status", "priority", "page_value_score") == [(f"https://test.example.com/{x}", "pending", p, s) for x, p, s in (("a", 50, 50.0), ("b", 17, 82.5), ("c", 50, 50.0))]
    assert got.select("job_id").distinct().count() == 3


def test_job_states(spark):
    at = lambda h: START + timedelta(hours=h)
    events = [("j", "pending", at(0)), ("j", "processing", at(1)), ("j", "completed", at(2)), ("k", "processing", at(5)), ("k", "pending", None), (None, "pending", at(1)), ("j", "completed", at(2))]
    got = crawling.job_states(spark.createDataFrame(events, "job_id string, status string, at timestamp"))
    assert [(r.job_id, r.status, r.started_at is not None, r.completed_at is not None) for r in got.orderBy("job_id").collect()] == [("j", "completed", True, True), ("k", "processing", True, False)]
    assert crawling.job_states(spark.createDataFrame([], "job_id string, status string, at timestamp")).count() == 0


@pytest.mark.parametrize("most", [None, 9])
def test_crawl_against_brute_force(spark, most):
    rng = random.Random(3)
    links = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", k) for k in range(150)]
    allowed, recent = {f"n{k}" for k in range(30) if k % 7}, {"n5", "n11"}
    seeds = ["n1", "n2", "n7", "n1", None]
    usable = lambda x: x in allowed and x not in recent
    out = {}
    for src in {s for s, _, _ in links}:
        place = {}
        for s, d, p in links:
            if s == src:
                place[d] = min(p, place.get(d, p))
        out[src] = [d for d, _ in sorted(place.items(), key=lambda x: (x[1], x[0]))][:3]
    level = sorted(x for x in set(seeds) - {None} if usable(x))[:most]
    want = {x: 0 for x in level}
    for depth in (1, 2):
        level = sorted({d for s in level for d in out.get(s, []) if usable(d) and d not in want})
        level = level if most is None else level[: most - len(want)]
        want |= {x: depth for x in level}
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "url string")
    got = crawling.crawl(one(seeds), spark.createDataFrame(links, "src string, dst string, position int"), 2, most, 3, one(allowed), one(recent))
    assert dict(rows(got, "url", "depth")) == want


def test_gate_and_index(spark):
    text = "A long article about kettles. " * 60
    data = [("https://a.org/1", "a.org", "blog", text, "A title of some length"), ("https://a.org/2", "a.org", "blog", "", "Empty"), ("https://b.org/spam", "b.org", "blog", "x", None)]
    frame = spark.createDataFrame(data, "url string, domain string, content_type string, content string, title string")
    none = F.lit(None).cast("string")
    gate = crawling.gated(frame.select("*", none.alias("og_title"), none.alias("description"), none.alias("og_image_url"), none.alias("h1"), F.lit(0).alias("h2_count"), F.lit(None).cast("double").alias("analysis"), F.lit(None).cast("double").alias("value")))
    assert [tuple(r) for r in crawling.index_counters(gate).collect()] == [("blog", 1, 1, 1)]
    old = spark.createDataFrame([("https://a.org/1", "old"), ("https://c.org/", "kept")], "url string, title string")
    images = spark.createDataFrame([("https://a.org/1", "old.png"), ("https://c.org/", "c.png")], "url string, src string")
    icons = spark.createDataFrame([("a.org", "old.ico"), ("b.org", "b.ico")], "domain string, icon string")
    found = spark.createDataFrame([("https://a.org/1", "new.png"), ("https://b.org/spam", "x.png")], "url string, src string")
    fresh = spark.createDataFrame([("a.org", "new.ico"), ("b.org", "n.ico")], "domain string, icon string")
    content, pictures, marks = crawling.index(gate, old, images, icons, found, fresh)
    assert rows(content, "url", "title") == [("https://a.org/1", "A title of some length"), ("https://c.org/", "kept")]
    assert rows(pictures, "url", "src") == [("https://a.org/1", "new.png"), ("https://c.org/", "c.png")]
    assert rows(marks, "domain", "icon") == [("a.org", "new.ico"), ("b.org", "b.ico")]


def test_append_and_decode(spark, tmp_path):
    frame = spark.createDataFrame([(1, START)], "id long, at timestamp")
    for _ in range(2):
        crawling.append(frame, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    data = spark.createDataFrame([(bytearray("é".encode()), None), (bytearray("é".encode("latin-1")), None), (bytearray("é".encode("utf-16-le")), "utf-16le"), (None, None)], "b binary, c string")
    assert [r[0] for r in data.select(crawling.decoded(F.col("b"), F.col("c"))).collect()] == ["é", "é", "é", None]


def test_trailing_clicks_against_brute_force(spark):
    rng = random.Random(8)
    asked = [(k, rng.choice([1, 1, 2, None])) for k in range(40)]
    data = [(k, rng.randrange(45), START + timedelta(seconds=rng.randrange(600))) for k in range(200)] + [(500, 1, None)]
    data += [(501, 1, START + timedelta(seconds=60)), (502, 1, START + timedelta(seconds=120)), (501, 1, START + timedelta(seconds=60))]
    session = dict(asked)
    mine = {k: (session.get(s), t) for k, s, t in data if t is not None and session.get(s) is not None}
    want = sorted((k, s, sum(1 for o, u in mine.values() if o == s and timedelta(0) <= t - u <= timedelta(seconds=60))) for k, (s, t) in mine.items())
    got = behaviour.trailing_clicks(spark.createDataFrame(data, "id long, search_event_id long, clicked_at timestamp"), spark.createDataFrame(asked, "id long, session_id long"))
    assert sorted(tuple(r) for r in got.select("id", "session_id", "clicks").collect()) == want


def test_sample_page_of_trackers(spark):
    page = """<script src="https://www.googletagmanager.com/gtag/js"></script><script src="https://static.hotjar.com/c.js"></script>
<script>gtag('config', 'x');</script><script>var cdn_ga = 1;</script><img src="https://www.facebook.com/tr?id=1&pixel=1"><img src="https://x.example/beacon.gif">"""
    got = spark.createDataFrame([(page,), (None,)], "html string").select(trackers.tracker_report(F.col("html")).alias("r")).collect()
    assert sorted((t.name, t.kind, t.risk) for t in got[0].r.trackers) == [("facebook_pixel", "pixel", 4), ("gtag", "inline_script", 2), ("gtag", "script", 2), ("hotjar", "script", 5)]
    assert (got[0].r["count"], got[0].r.average, got[0].r.profile) == (4, 3.25, "moderate_trackers") and got[0].r.safety == pytest.approx(0.15)
    assert (got[1].r["count"], got[1].r.profile, got[1].r.safety) == (0, "clean", 0.8)


def test_spam_with_all_signals(spark):
    facts = [("farm", 300.0, 0.5, 0.6, False, 0.0, 0.9), ("mixed", 1.0, 0.0, 0.0, True, 0.0, None), ("clean", 1.0, 0.0, 0.0, False, 0.1, 0.1)]
    frame = spark.createDataFrame(facts, "domain string, avg_links double, max_density double, share_external double, mixed boolean, ratio double, reciprocal_ratio double")
    got = {r.domain: r for r in spam.spam_report(frame).collect()}
    assert got["farm"].spam_score == pytest.approx((80 + 72) / 2) and got["farm"].risk_level == "spam" and list(got["farm"].flags) == ["link_farm", "reciprocal_linking"]
    assert got["mixed"].spam_score == pytest.approx(35.0) and got["mixed"].risk_level == "clean"
    assert got["clean"].recommendations == ["✅ Domain appears legitimate"] and len(got["farm"].recommendations) == 3


def test_reciprocal_links_to_other_hosts(spark):
    links = [("http://a.org/1", "http://b.org/x"), ("http://b.org/y", "http://a.org/1"), ("http://b.org/z", "http://a.org/1"), ("http://a.org/1", "http://a.org/2"), ("http://a.org/1", "http://c.org/")]
    got = spam.reciprocal_links(spark.createDataFrame(links, "src string, dst string"))
    assert rows(got, "domain", "links", "reciprocal") == [("a.org", 2, 2), ("b.org", 2, 0)]


def test_reasons_and_labels(spark):
    yes, no = F.lit(True), F.lit(False)
    deep = pagevalue.page_value(F.lit("https://e.com/a"), F.lit(7), F.lit(100), F.lit(1000), F.lit(10), F.lit(0), no, no, no, no, no, no)
    best = pagevalue.page_value(F.lit("https://e.com/a"), F.lit(3), F.lit(2), F.lit(10), F.lit(200), F.lit(3), no, yes, no, no, no, no)
    got = spark.range(1).select(deep.alias("d"), best.alias("b"), *[relevance.score_label(F.lit(x)).alias(f"l{k}") for k, x in enumerate((0.9, 0.7, 0.5, 0.3, 0.1))]).first()
    assert got.d.reasons == ["Heavily linked internally (100 incoming links)", "Significant external authority (1000 est. backlinks)", "Deep page (7 hops from root)", "Minimal content or metadata", "No structured data markup"]
    assert got.b.reasons == [f"Overall score: {got.b.total:.1f}"]
    assert list(got)[2:] == ["⚡ Excellent match", "✓ Good match", "~ Fair match", "◑ Weak match", "✗ Poor match"]


def test_crawl_record_and_images(spark):
    page = '<html><title>T</title><h1>a</h1><h1>b <b>c</b></h1><img src="/i.png" alt="a kettle"><img src="/j.png" alt="x"><a href="/p?b=2&a=1#f">one</a><a href="/p?b=2&a=1#g">one</a><a href="https://o.org/">out</a></html>'
    parsed = html.parsed(spark.createDataFrame([("k", "https://e.com/d/", page)], "job_id string, url string, content string"))
    record = html.crawl_record(parsed).first()
    assert record.h1 == "a b c" and [i.alt for i in record.images] == ["a kettle", "x"]
    assert {(x.url, x.same_domain) for x in record.links} == {("https://e.com/p?a=1&b=2", True), ("https://o.org/", False)} or {x.same_domain for x in record.links} == {True, False}
    assert rows(html.own_links(parsed), "url") == [("https://e.com/p?b=2&a=1",)]
    assert parsed.select(crawling.meaningful_alts(F.col("images"))).first()[0] == 1


def test_search_parts(spark):
    images = spark.createDataFrame([(1, "a red kettle"), (2, "how to use a museum"), (3, "the museum of museums"), (4, None)], "page_id long, alt_text string")
    assert rows(search.image_search(images, "museum -how OR kettle"), "page_id", "score") == [(1, 1), (3, 2)]
    pages = spark.createDataFrame([(1, "python", "learn python fast", "https://github.com/x"), (1, "python", "learn python fast", "https://github.com/x"), (2, "xyz", None, "http://bit.ly/spam")], "id long, title string, content string, url string")
    got = {r.id: r for r in search.explain_relevance(pages, "python").collect()}
    assert len(got) == 2 and got[1].title_match == 1.0 and got[1].content_match == pytest.approx(0.4235294117647059) and got[1].domain_relevance == 0.9 and got[2].domain_relevance == 0.3


def test_robots_extras_and_merged_urls(spark):
    text = "Crawl-delay: 1\nUser-agent: bot\nCrawl-delay: 9\nUser-agent: *\nCrawl-delay: 2.5 # s\nSitemap: /a.xml\nSitemap: /b.xml"
    got = graph.robots_extras(spark.createDataFrame([("d", text), ("e", "Disallow: /")], "domain string, robots string"))
    assert rows(got, "domain", "crawl_delay", "sitemaps") == [("d", 2.5, ["/a.xml", "/b.xml"]), ("e", None, [])]
    seeds, found = spark.createDataFrame([("b", 0), ("a", 1)], "url string, place int"), spark.createDataFrame([("c", 0), ("a", 1), (None, 2)], "url string, place int")
    assert [r.url for r in urls.merged(seeds, found).orderBy("source", "place").collect()] == ["b", "a", "c"]
