"""Values worked out by hand from the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from siftworks.functions import behaviour, content, intent, pagevalue, ranking, text, trackers
from siftworks.operators import graph, html, merge, spam
from siftworks.operators.search import fuzzy_match, fuzzy_search, image_search, with_fallback
from siftworks.sources import sitemap, urls


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first()[0]


def known(values):
    return [F.lit(v) for v in values]


@pytest.mark.parametrize(
    "query, name, confidence",
    [
        ("How to install Docker?", "question", 0.9),
        ("python list index out of range error", "question", 0.3),
        ("buy MacBook Pro", "transactional", 0.3),
        ("best VPN review", "product_research", 0.3),
        ("React tutorial", "research", 0.3),
        ("facebook login", "navigation", 0.6),
        ("Dockerの使い方は?", "question", 0.9),
        ("weather tokyo", "informational", 0.2),
    ],
)
def test_intent(spark, query, name, confidence):
    got = one(spark, intent.intent(F.lit(query)))
    assert got.intent == name and got.confidence == pytest.approx(confidence)


@pytest.mark.parametrize("q, t, score", [("python", "Python", 1.0), ("python", "learn python fast", 0.4235294117647059), ("pyton", "python", 0.9090909090909091), ("python async", "async io in python", 0.5), ("abc", "xyz", 0.0), ("pyton", "", 0.0)])
def test_fuzzy_match(q, t, score):
    assert fuzzy_match(q, t) == pytest.approx(score)


@pytest.mark.parametrize("url, kind", [("https://www.netflix.com/x", "video"), ("https://box.com/f", "social_media"), ("https://www.example.com/", "official_site"), ("https://example.com/post", "blog"), ("https://github.com/a/b", "code_repository")])
def test_url_type(spark, url, kind):
    assert one(spark, content.url_type(F.lit(url))) == kind


def test_quality_gate(spark):
    none = F.lit(None).cast("string")
    text_of = lambda n: F.lit("x" * n)
    good = one(spark, content.quality(F.lit("blog"), text_of(500), F.lit("https://e.com/a"), text_of(20), text_of(20), F.lit("d"), F.lit("d"), F.lit("i"), F.lit("h"), F.lit(0), F.lit(None).cast("double"), F.lit(50.0)))
    assert good.metadata_quality == pytest.approx(0.9) and good.indexed and good.reason is None
    bad = one(spark, content.quality(F.lit("blog"), text_of(20), F.lit("https://e.com/ads/?utm_x=1"), none, none, none, none, none, none, F.lit(0), F.lit(None).cast("double"), F.lit(50.0)))
    assert not bad.indexed and bad.reason.startswith("insufficient_content(20/100) + missing_title + spam_pattern(")


@pytest.mark.parametrize("flags, total", [(0, 42.5), (1, 46.5), (2, 50.5), (3, 54.5), (4, 58.5)])
def test_page_value(spark, flags, total):
    f = [F.lit(k < flags) for k in range(4)]
    no, zero = F.lit(False), F.lit(0)
    got = one(spark, pagevalue.page_value(F.lit("https://e.com/x"), zero, zero, zero, zero, zero, no, f[0], f[1], f[2], no, f[3]))
    assert got.total == pytest.approx(total)
    assert got.recommendation == ("CRAWL_SOON" if flags == 4 else "CRAWL_LATER")


def test_page_value_parts(spark):
    assert one(spark, pagevalue.depth_score(F.lit(7))) == pytest.approx(26.812801841425575)
    assert one(spark, pagevalue.link_score(F.lit(100))) == pytest.approx(86.0)
    assert one(spark, pagevalue.backlink_score(F.lit(1000))) == pytest.approx(86.0)


def test_trackers(spark):
    page = """<script src="https://www.googletagmanager.com/gtag/js?id=1"></script><script src="https://static.hotjar.com/c/hotjar.js"></script>
    <script>gtag('config')</script><img src="https://www.facebook.com/tr?id=1&pixel=1">"""
    got = one(spark, trackers.tracker_report(F.lit(page)))
    assert got["count"] == 4 and got.average == pytest.approx(3.25) and got.safety == pytest.approx(0.15) and got.profile == "moderate_trackers"
    clean = one(spark, trackers.tracker_report(F.lit("<p>x</p>")))
    assert (clean["count"], clean.safety, clean.profile) == (0, pytest.approx(0.8), "clean")
    assert one(spark, trackers.tracker_count(F.lit(None).cast("string"))).profile == "clean"


def test_ranking(spark):
    w = ranking.weights("question")
    assert w["relevance"] == pytest.approx(0.454545, abs=1e-6) and sum(w.values()) == pytest.approx(1)
    at = lambda x: F.lit(x).cast("timestamp")
    assert one(spark, ranking.recency(at("2024-01-01"), at("2024-03-31"))) == pytest.approx(math.exp(-0.5))
    got = one(spark, ranking.simple_score(["x"], F.lit("x"), F.lit("x"), F.lit("x"), F.lit("x x x"), F.lit(2000), F.lit(10)))
    assert got == 33.0


def test_behaviour(spark):
    lit = F.lit
    assert one(spark, behaviour.session_trust(lit(15), lit(10), lit(0.5), lit(2))) == pytest.approx(0.9)
    at = lambda x: F.lit(x).cast("timestamp")
    assert one(spark, behaviour.time_decay(at("2024-01-01"), at("2024-01-31"))) == pytest.approx(0.049787068367863944)
    reason = lambda d, s, j: one(spark, behaviour.click_success(lit(d), lit(s), lit(j)))
    assert [reason(30001, 0.0, None), reason(0, 0.51, "{}"), reason(0, 0.0, '{"copied":true}'), reason(30000, 0.5, '{"a":false}'), reason(0, 0.0, "broken")] == ["long_stay", "thorough_read", "interaction", None, None]


def test_text_functions(spark):
    assert one(spark, text.normalize_url(F.lit("HTTPS://Ex.COM/A/?b=2&a=1#t"))) == "https://ex.com/A?a=1&b=2"
    assert one(spark, text.normalize_url(F.lit("http://e.com/"))) == "http://e.com/"
    assert one(spark, text.short_hash("ip_", F.lit("1.2.3.4"))) == "214c89e5658e9de4"
    assert one(spark, text.title_from_path(F.lit("https://e.com/a/some-page_x/"))) == "some page x"
    assert one(spark, text.tokens(F.lit("Hé the x これ"))) == ["Hé", "the", "これ"]


def test_html():
    page = html.parse(
        '<html lang="en"><head><title>T</title><meta property="og:title" content="O"><meta name="robots" content="noindex, nofollow"><meta name="keywords" content="b, a">'
        '<script type="application/ld+json">{"@type": "Article", "author": {"name": "N"}, "datePublished": "2024"}</script><script type="application/ld+json">{bad</script>'
        '<link rel="icon" href="/i.ico"><link rel="apple-touch-icon" href="/i.png"></head><body><nav>menu</nav><h1>a <b>b</b> c</h1><p>text'
        '<a href="/x" title="t">in</a><a href="http://o.com/">out</a><a href="#x">no</a><img src="a.png" alt=" A " width="3" height="x"><img src="data:1"></body></html>',
        "http://h.com/d/",
    )
    assert (page["title"], page["author"], page["published"], page["keywords"], page["h1"]) == ("O", "N", "2024", ["a", "b"], ["a b c"])
    assert page["robots"] == {"index": False, "follow": False, "archive": True, "snippet": True}
    assert [(x["url"], x["internal"]) for x in page["links"]] == [("http://h.com/x", True), ("http://o.com/", False)]
    assert [(x["src"], x["alt"], x["width"]) for x in page["images"]] == [("http://h.com/d/a.png", "A", None)]
    assert page["icons"][0]["format"] == "png" and "menu" not in page["text"] and "T" not in page["text"].split()
    assert html.parse(None, None)["links"] == [] and html.parse("<a href='http://[x'>", "http://h/")["title"] is None


def test_robots(spark):
    text_ = "Disallow: /a\nAllow: /a\nUser-agent: x\nDisallow: /\nUser-agent: *\nDisallow: /p\nAllow: /p/q # c"
    rules = graph.robots_rules(spark.createDataFrame([("d", text_)], "domain string, robots string"))
    paths = spark.createDataFrame([("d", p) for p in ("/a", "/p/x", "/p/q/r", "/z")] + [("e", "/")], "domain string, path string")
    assert {(r.domain, r.path): r.allowed for r in graph.robots_allowed(paths, rules).collect()} == {("d", "/a"): True, ("d", "/p/x"): False, ("d", "/p/q/r"): True, ("d", "/z"): True, ("e", "/"): True}


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.depth) for r in graph.reach(seeds, edges, 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    ranks = {r.node: r["rank"] for r in graph.pagerank(edges, rounds=20).collect()}
    assert sum(ranks.values()) == pytest.approx(4)
    assert ranks[1] == pytest.approx(ranks[4]) and ranks[1] < ranks[2] < ranks[3]  # 1 and 4 each get half of what 3 gives
    assert graph.pagerank(edges.limit(0)).count() == 0


def test_merge_and_search(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (4, "d")], "k int, v string")
    assert {tuple(r) for r in merge.upsert(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, None), (4, "d")}
    assert {r.k for r in merge.delete(old, F.col("v") == "a").collect()} == {2, 3}
    assert with_fallback(old, new).count() == 3 and with_fallback(old.limit(0), new).count() == 2
    images = spark.createDataFrame([(1, "Red red cat"), (2, "red dog"), (3, None)], "id int, alt_text string")
    assert [(r.id, r.score) for r in image_search(images, "red -dog").collect()] == [(1, 2)]


def test_fuzzy_search(spark):
    rows = [(1, "Python guide", None, "", "learn python", "u1/python", 1.0), (2, "Python typo", None, "", "x", "u2", 0.8), (3, "Other", None, "", "python here", "u3", 0.9)]
    frame = spark.createDataFrame(rows, "id long, title string, h1 string, description string, content string, url string, quality_score double")
    got = fuzzy_search(frame, "python", limit=2).collect()
    assert [r.id for r in got][0] == 1 and len(got) == 2
    assert [r.id for r in fuzzy_search(frame, "python", limit=2, offset=2).collect()] == [r.id for r in fuzzy_search(frame, "python", limit=3).collect()][2:]


def test_spam(spark):
    facts = spark.createDataFrame([("a", 10.0, 0.1, 0.0, True, 0.0), ("b", 300.0, 0.5, 0.9, False, 0.6), ("c", None, None, None, False, 0.0)], "domain string, avg_links double, max_density double, share_external double, mixed boolean, ratio double")
    got = {r.domain: (r.spam_score, r.risk_level) for r in spam.spam_report(facts).collect()}
    assert got["a"] == (pytest.approx(35.0), "clean") and got["c"] == (0.0, "clean")
    assert got["b"] == (pytest.approx((1.0 * 80 + 0.6 * 80) / 2), "suspicious")


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("url,domain\nhttps://a.com/x,A.com\nb.org/y,\n")
    (tmp_path / "a.json").write_text('["https://a.com/x", {"link": "c.net", "domain": "c.net"}, {"url": "d.io/1"}]')
    (tmp_path / "a.txt").write_text("# no\n\nhttps://sub.a.com/\n")
    got = lambda f: {tuple(r) for r in f.collect()}
    assert got(urls.read_csv(spark, str(tmp_path / "a.csv"))) == {("https://a.com/x", "a.com"), ("https://b.org/y", "b.org")}
    assert got(urls.read_json(spark, str(tmp_path / "a.json"))) == {("https://a.com/x", "a.com"), ("https://c.net", "c.net"), ("https://d.io/1", "d.io")}
    text_ = urls.read_text(spark, str(tmp_path / "a.txt"))
    assert got(text_) == {("https://sub.a.com/", "sub.a.com")} and urls.cleaned(text_, "a.com").count() == 1


def test_sitemaps(spark):
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = f"<sitemapindex {space}><sitemap><loc>http://s/1</loc></sitemap></sitemapindex>"
    child = f"<urlset {space}><url><loc>http://s/p</loc><priority>0.5</priority></url><url><loc>http://s/q</loc><priority>x</priority></url></urlset>"
    roots = spark.createDataFrame([("http://s/0", index), ("http://s/bad", "<no")], "url string, xml string")
    fetched = spark.createDataFrame([("http://s/1", child)], "url string, xml string")
    assert {(r.loc, r.priority) for r in sitemap.expanded(roots, fetched).collect()} == {("http://s/p", 0.5), ("http://s/q", None)}
    assert sitemap.locations(fetched).count() == 2
    found = sitemap.discovered(spark.createDataFrame([("d.com", "Sitemap: https://d.com/own.xml")], "domain string, robots string"))
    assert found.where("sitemap = 'https://d.com/own.xml'").count() == 1 and found.count() == 9
