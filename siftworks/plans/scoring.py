"""Queries of the scoring functions."""

from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import intent as I
from ..functions import ranking as R
from ..functions.pagevalue import page_value
from ..functions.text import domain
from ..operators.search import latest
from ..runtime import spread, table
from .tables import CONTENT, JOBS, NOW, SEARCHES, as_of, content, html_rows, jobs, quoted, searches, sql_any, sql_case, sql_days, sql_domain, sql_path, sql_per_type, sql_url_type

c = F.col


def classify_url(spark, folder):
    pages = table(spark, folder, "pages").dropDuplicates(["id"])
    return pages.select("id", C.url_type(c("url")).alias("content_type"))


def page_types(spark, folder):
    schema = F.get_json_object("jsonld", "$['@type']")
    root = F.regexp_replace("url", "/$", "") == F.concat(F.lit("https://"), c("domain"))
    return content(spark, folder, False).select("id", C.page_type(c("url"), schema, c("content"), root).alias("page_type")).dropDuplicates(["id"])


def content_classify(spark, folder):
    schema = F.get_json_object("jsonld", "$['@type']")
    kind = C.classify(F.coalesce("url", F.lit("")), F.coalesce("content", F.lit("")), F.coalesce(schema, F.lit("")))
    return spread(content(spark, folder, False)).select("id", kind.alias("k")).dropDuplicates(["id"]).select("id", c("k.type").alias("content_type"), F.round("k.confidence", 6).alias("confidence"))


def content_type_distribution(spark, folder):
    return content_classify(spark, folder).groupBy("content_type").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("confidence"), 6).alias("confidence"))


def intent_detect(spark, folder):
    q = searches(spark, folder).where("query is not null")
    return q.select("id", I.intent(c("query")).alias("i")).select("id", c("i.intent").alias("intent"), F.round("i.confidence", 6).alias("confidence"))


def expertise_level(spark, folder):
    return searches(spark, folder).where("query is not null").select("id", I.expertise(c("query")).alias("level"))


def query_intent(spark, folder):
    q = searches(spark, folder).where("query is not null").select("id", I.search_intent(c("query")).alias("i"))
    return q.select("id", c("i.intent").alias("intent"), c("i.confidence").alias("confidence"), F.array_join("i.secondary", ",").alias("secondary"), F.array_join("i.keywords", ",").alias("keywords"), F.array_join("i.modifiers", ",").alias("modifiers"))


def intent_match(spark, folder):
    """How well each type of content fits each intent that was asked for, weighted by how often."""
    asked = searches(spark, folder).where("intent_type is not null").groupBy("intent_type").agg(F.count(F.lit(1)).alias("times"))
    kinds = F.explode(F.array(*[F.lit(x) for x in ("text_article", "forum", "video", "image", "tool")]))
    pairs = asked.withColumn("content_type", kinds)
    return pairs.select("intent_type", "content_type", "times", I.intent_fit(c("intent_type"), c("content_type")).alias("fit"), I.best_content(c("intent_type")).alias("best"))


def page_values(spark, folder):
    """Value of the crawled pages by the counts of the latest completed job of their url; og and schema flags come from the page.

    Internal and external links are the job's counts, headings those of its HTML. A page without such a job, and a count
    that the job leaves out, has 0, which is what the columns default to.
    """
    counted = F.regexp_count("content", F.lit(r"(?i)<h[1-6][\s>]")).alias("headings")
    headings = html_rows(spark, folder, lambda j: j.select("job_id", "digest", counted))
    done = jobs(spark, folder).where("status = 'completed' and url is not null").select("job_id", "url", "completed_at", c("internal_links_count").alias("internal"), c("external_links_count").alias("external"))
    n = latest(done, "url", F.desc_nulls_last("completed_at"), F.desc("job_id")).join(headings, "job_id", "left").select("url", "internal", "external", "headings")
    known = content(spark, folder, False).withColumn("words", F.size(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).drop("content").dropDuplicates(["id"])
    pages = known.join(n, "url", "left").fillna(0, ["internal", "external", "headings"])
    has = lambda x: F.coalesce(x, F.lit("")) != ""
    depth = F.size(F.array_remove(F.split(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/"), ""))
    v = page_value(
        c("url"), depth, c("internal"), c("external"), c("words"), c("headings"), c("content_type") == "blog", has(c("jsonld")), has(F.get_json_object("jsonld", "$.datePublished")), has(F.get_json_object("jsonld", "$.author")), has(c("og_title")), has(c("description"))
    )
    return pages.select("id", v.alias("v")).select("id", F.round("v.total", 6).alias("total"), F.round("v.link", 6).alias("link"), c("v.content").alias("content"), "v.priority", "v.recommendation")


def quality_gate(spark, folder):
    pages = content(spark, folder, False)
    none = F.lit(None).cast("double")
    q = C.quality(c("content_type"), c("content"), c("url"), c("title"), c("og_title"), c("description"), c("description"), c("og_image_url"), c("h1"), F.lit(0), none, none)
    return pages.select("id", q.alias("q")).dropDuplicates(["id"]).select("id", "q.score", "q.indexed", "q.reason", F.round("q.metadata_quality", 6).alias("metadata_quality"))


def quality_counts(spark, folder):
    return quality_gate(spark, folder).groupBy("indexed", C.quality_label(c("score")).alias("label")).agg(F.count(F.lit(1)).alias("pages"))


def harmony_rank(spark, folder):
    pages, sites = content(spark, folder, False), table(spark, folder, "sites").select(c("id").alias("site_id"), "trust_score")
    h = R.harmony("research", c("quality_score"), c("last_crawled_at"), c("domain"), c("trust_score"), c("content"), c("h1"), c("click_score"), c("pagerank_score"), c("tracker_risk_score"), as_of())
    joined = pages.where("quality_score is not null").join(sites, "site_id", "left")
    return joined.select("id", h.alias("h")).dropDuplicates(["id"]).select("id", F.round("h.score", 6).alias("score"), F.round("h.recency", 6).alias("recency"), F.round("h.domain_trust", 6).alias("domain_trust"), F.round("h.engagement", 6).alias("engagement"))


def final_scores(spark, folder):
    sites = table(spark, folder, "sites").select(c("id").alias("site_id"), "trust_score")
    pages = content(spark, folder).where("quality_score is not null").join(sites, "site_id")
    fit = I.intent_fit(F.lit("research"), F.when(c("content_type") == "video", F.lit("video")).otherwise(F.lit("text_article")))
    score = R.final_score(c("quality_score") * 30, fit, F.coalesce("trust_score", F.lit(0.5)), 1 - F.coalesce(F.nanvl("tracker_risk_score", F.lit(0.5)), F.lit(0.5)))
    return pages.select("id", F.round(score, 6).alias("score"))


def domain_quality(spark, folder):
    pages = table(spark, folder, "pages").dropDuplicates(["id"])
    return pages.groupBy(domain(c("url")).alias("domain")).agg(F.max(R.domain_quality(c("url"))).alias("quality"), F.count(F.lit(1)).alias("pages"))


def _re(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted('(?i)' + pattern)})"


def _intent_score(patterns, q: str) -> str:
    return "least(4, " + " + ".join(f"CAST({_re(q, p)} AS INT)" for p in patterns) + ")"


def _first_best(names: list[str]) -> str:
    most = f"greatest({', '.join('s_' + n for n in names)})"
    return sql_case([(f"s_{n} = {most}", quoted(n)) for n in names], "NULL")


_q = "lower(trim(query))"
_ascii = {n: [p for p in ps if p.isascii()] for n, ps in I.INTENTS.items()}
_classes = {
    n: " + ".join(
        [f"CAST({_re('u', p)} AS INT) * {30 / len(urls)!r}::DOUBLE" for p in urls]
        + [f"CAST({_re('t', p)} AS INT) * {40 / len(texts)!r}::DOUBLE" for p in texts]
        + [f"CAST(contains(s, {quoted(p)}) AS INT) * {30 / len(schemas)!r}::DOUBLE" for p in schemas]
    )
    for n, (urls, texts, schemas) in C.PATTERNS.items()
}
CLASSIFIED = f"""WITH {CONTENT}, b AS (SELECT id, coalesce(url, '') AS u, coalesce(content, '') AS t, coalesce(jsonld->>'@type', '') AS s FROM content),
k AS (SELECT id, {', '.join(f'round({e}, 6) AS s_{n}' for n, e in _classes.items())} FROM b),
m AS (SELECT id, {_first_best(list(_classes))} AS best, least(greatest({', '.join('s_' + n for n in _classes)}) / 100, 1.0) AS confidence FROM k),
o AS (SELECT id, CASE WHEN confidence < 0.1 THEN 'unknown' ELSE best END AS content_type, CASE WHEN confidence < 0.1 THEN 0.0 ELSE round(confidence, 6) END AS confidence FROM m)
"""
_keys = sorted({k for ks in I.KEYWORDS.values() for k in ks})
_len, _asked = "length(trim(coalesce(content, ''), ' '))", sql_per_type("content_type", lambda r: r[1])
_has = lambda x: f"(coalesce({x}, '') <> '')"
_title = f"trim(CASE WHEN {_has('og_title')} THEN og_title ELSE coalesce(title, '') END, ' ')"
_low = "lower(coalesce(content, ''))"
_add = lambda x, n: f"CASE WHEN {x} THEN {n} ELSE 0 END"
_meta = f"30 + {_add(_has('description'), 15)} + {_add(_has('og_title'), 15)} + {_add(_has('description'), 10)} + {_add(_has('og_image_url'), 10)}"
_bonus = sql_case(
    [
        ("content_type = 'blog'", _add(_has("h1"), 10)),
        ("content_type = 'video'", _add("length(coalesce(description, '')) > 50", 15) + " + " + _add(f"contains({_low}, 'video') OR contains({_low}, 'transcript')", 5)),
        ("content_type = 'manga'", _add(_has("h1"), 10)),
        ("content_type = 'image'", _add("regexp_matches(coalesce(content, ''), 'alt=[\"''][^\"'']*[\"]')", 15)),
        ("content_type = 'official_site'", _add(f"{_has('og_title')} AND {_has('description')}", 15) + " + " + _add(f"contains({_low}, 'json-ld') OR contains({_low}, 'schema')", 10)),
        ("content_type = 'code_repository'", _add(f"contains({_low}, 'readme') OR contains({_low}, 'documentation')", 20) + " + " + _add("contains(lower(url), 'github') OR contains(lower(url), 'gitlab')", 10)),
    ],
    "0",
)
_spam = " - ".join(["100", *[f"CAST(contains(lower(url), {quoted(p)}) AS INT) * 15" for p in C.SPAM_PARTS]])
_url_points = f"(CASE WHEN {sql_any('lower(url)', C.GOOD_HOSTS)} THEN least(100, {_spam} + 15) ELSE {_spam} END)"
_reasons = "list_filter([" + ", ".join([f"CASE WHEN n < asked THEN 'insufficient_content(' || n || '/' || asked || ')' END", f"CASE WHEN length({_title}) < 5 THEN 'missing_title' END", *[f"CASE WHEN contains(lower(url), {quoted(p)}) THEN {quoted(f'spam_pattern({p})')} END" for p in C.SPAM_PARTS]]) + "], lambda x: x IS NOT NULL)"
GATE_SQL = f"""WITH {CONTENT}, a AS (SELECT *, {_len} AS n, {_asked} AS asked, {sql_per_type('content_type', lambda r: r[0])} AS floor_ FROM content),
f AS (SELECT *, CASE WHEN n < asked THEN greatest(0.1, n / asked * 0.5::DOUBLE) WHEN n > asked * 10 THEN 1.0 ELSE least(1.0, n / (asked * 10)) END AS f0,
  CASE WHEN length({_title}) < 5 THEN 0.1 WHEN length({_title}) > 200 THEN 0.6 ELSE 0.95 END AS f1, least(1.0, ({_meta} + {_bonus}) / 100) AS f2, greatest(0.2, {_url_points} / 100) AS f3, {_reasons} AS reasons FROM a),
g AS (SELECT *, floor(round((f0 * {sql_per_type('content_type', lambda r: f'{r[2][0]}::DOUBLE')} + f1 * {sql_per_type('content_type', lambda r: f'{r[2][1]}::DOUBLE')} + f2 * {sql_per_type('content_type', lambda r: f'{r[2][2]}::DOUBLE')}
  + f3 * {sql_per_type('content_type', lambda r: f'{r[2][3]}::DOUBLE')} + 0.5 * {sql_per_type('content_type', lambda r: f'{r[2][4]}::DOUBLE')} + 0.5 * {sql_per_type('content_type', lambda r: f'{r[2][5]}::DOUBLE')}) * 100, 6) + 0.5) / 100 AS score FROM f),
gate AS (SELECT id, CAST(score AS DOUBLE) AS score, score >= floor_ AS indexed, CASE WHEN score < floor_ THEN CASE WHEN len(reasons) > 0 THEN array_to_string(reasons[1:3], ' + ') ELSE 'below_threshold(' || format('{{:.2f}}', CAST(score AS DOUBLE)) || ' < ' || format('{{:.2f}}', CAST(floor_ AS DOUBLE)) || ')' END END AS reason,
  round(CAST(f2 AS DOUBLE), 6) AS metadata_quality FROM g)
"""
_w = R.weights("research")
_crawl_days = sql_days("last_crawled_at", NOW)
_trust = "CASE WHEN coalesce(domain, '') = '' THEN 0.5 " + " ".join(f"WHEN ends_with(domain, {quoted(e)}) THEN {v}" for e, v in R.ENDINGS.items()) + " " + " ".join(f"WHEN contains(domain, {quoted(h)}) THEN {v}" for h, v in R.KNOWN_HOSTS.items()) + f" WHEN {sql_any('lower(domain)', R.SUSPICIOUS)} THEN 0.2 WHEN coalesce(trust_score, 0) <> 0 THEN trust_score ELSE 0.5 END"
_share = lambda x, n: f"coalesce(CASE WHEN NOT isnan({x}) THEN least({x} / {n}, 1.0) END, 0.0)"
_depth = "len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''))"
_article = "(content_type = 'blog')"
_flags = {"schema": _has("jsonld"), "dated": _has("jsonld->>'datePublished'"), "author": _has("jsonld->>'author'"), "og": _has("og_title"), "description": _has("description")}

QUERIES = {
    "classify_url": classify_url,
    "page_type": page_types,
    "content_classify": content_classify,
    "content_type_distribution": content_type_distribution,
    "intent_detect": intent_detect,
    "expertise_level": expertise_level,
    "query_intent": query_intent,
    "intent_match": intent_match,
    "page_value": page_values,
    "quality_gate": quality_gate,
    "quality_counts": quality_counts,
    "harmony_rank": harmony_rank,
    "final_score": final_scores,
    "domain_quality": domain_quality,
}
SQL = {
    "classify_url": f"SELECT id, {sql_url_type('url')} AS content_type FROM (SELECT DISTINCT * FROM pages)",
    "page_type": f"""WITH {CONTENT} SELECT id, {sql_case(
        [(sql_any('lower(url)', p), quoted(n)) for n, p in C.PAGE_URLS.items()]
        + [(sql_any("lower(coalesce(jsonld->>'@type', ''))", p), quoted(n)) for n, p in C.PAGE_SCHEMAS.items()]
        + [(sql_any("lower(coalesce(content, ''))", p), quoted(n)) for n, p in C.PAGE_TEXTS.items()]
        + [("regexp_replace(url, '/$', '') = 'https://' || domain", "'landing_page'")], "'unknown'")} AS page_type FROM content""",
    "content_classify": CLASSIFIED + "SELECT * FROM o",
    "content_type_distribution": CLASSIFIED + "SELECT content_type, count(*) AS pages, round(avg(confidence), 6) AS confidence FROM o GROUP BY content_type",
    "intent_detect": f"""WITH {SEARCHES}, k AS (SELECT id, {', '.join(f'{_intent_score(p, _q)} AS s_{n}' for n, p in _ascii.items())} FROM searches WHERE query IS NOT NULL),
m AS (SELECT *, greatest({', '.join('s_' + n for n in _ascii)}) AS most FROM k)
SELECT id, CASE WHEN most > 0 THEN {_first_best(list(_ascii))} ELSE 'informational' END AS intent, round(CASE WHEN most > 0 THEN least(1.0::DOUBLE, most * 0.3::DOUBLE) ELSE 0.2::DOUBLE END, 6) AS confidence FROM m""",
    "expertise_level": f"""WITH {SEARCHES} SELECT id, {sql_case([(' OR '.join(_re('lower(query)', p) for p in ps if p.isascii()), quoted(n)) for n, ps in I.EXPERTISE.items()], "'intermediate'")} AS level FROM searches WHERE query IS NOT NULL""",
    "query_intent": f"""WITH {SEARCHES}, k AS (SELECT id, lower(query) AS q, {', '.join('(' + ' + '.join(f'CAST(contains(lower(query), {quoted(x)}) AS INT)' for x in ks) + f') AS s_{n}' for n, ks in I.KEYWORDS.items())} FROM searches WHERE query IS NOT NULL),
m AS (SELECT *, greatest({', '.join('s_' + n for n in I.KEYWORDS)}) AS most, {_first_best(list(I.KEYWORDS))} AS intent FROM k)
SELECT id, intent, least(1.0::DOUBLE, most * 0.25::DOUBLE) AS confidence, array_to_string(list_filter([{', '.join(f"CASE WHEN intent <> '{n}' AND s_{n} > 0 AND s_{n} >= most * 0.2 THEN '{n}' END" for n in I.KEYWORDS)}], lambda x: x IS NOT NULL), ',') AS secondary,
array_to_string(list_filter([{', '.join(quoted(x) for x in _keys)}], lambda x: contains(q, x)), ',') AS keywords,
array_to_string(list_filter([CASE WHEN contains(q, 'cheapest') THEN 'budget' END, CASE WHEN s_commercial > 0 THEN 'comparison' END, CASE WHEN contains(q, 'free') THEN 'free' END, CASE WHEN s_local > 0 THEN 'location-based' END, CASE WHEN contains(q, '2024') OR contains(q, '2025') THEN 'recent' END], lambda x: x IS NOT NULL), ',') AS modifiers FROM m""",
    "intent_match": f"""WITH {SEARCHES}, a AS (SELECT intent_type, count(*) AS times FROM searches WHERE intent_type IS NOT NULL GROUP BY intent_type), p AS (SELECT *, unnest(['text_article', 'forum', 'video', 'image', 'tool']) AS content_type FROM a)
SELECT *, CAST({sql_case([(f"intent_type = '{i}' AND content_type = '{t}'", str(v)) for (i, t), v in I.FIT.items()], '0.5')} AS DOUBLE) AS fit, {sql_case([(f"intent_type = '{i}'", quoted(t)) for i, t in I.BEST_CONTENT.items()], "'text_article'")} AS best FROM p""",
    "page_value": f"""WITH {CONTENT}, {JOBS}, j AS (SELECT url, internal_links_count AS links, external_links_count AS back, len(regexp_extract_all(content, '(?i)<h[1-6][\\s>]')) AS heads FROM jobs WHERE status = 'completed' AND url IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY completed_at DESC NULLS LAST, job_id DESC) = 1),
a AS (SELECT content.*, {_depth.replace('url', 'content.url')} AS depth, coalesce(links, 0) AS links, coalesce(back, 0) AS back, coalesce(heads, 0) AS heads, len(regexp_extract_all(coalesce(content.content, ''), '[\\p{{L}}\\p{{N}}_]+')) AS words, {' + '.join(f'CAST({f} AS INT)' for f in _flags.values())} AS flags FROM content LEFT JOIN j ON content.url = j.url),
s AS (SELECT *, CASE WHEN depth <= 1 THEN 100.0 WHEN depth = 2 THEN 85.0 WHEN depth = 3 THEN 70.0 WHEN depth = 4 THEN 55.0 WHEN depth = 5 THEN 40.0 ELSE greatest(10.0, 40.0 * exp(-0.2 * (depth - 5))) END AS d,
  CASE WHEN links = 0 THEN 20.0 WHEN links = 1 THEN 40.0 WHEN links <= 3 THEN 60.0 WHEN links <= 10 THEN 75.0 WHEN links <= 50 THEN 85.0 ELSE least(100.0, 85.0 + ln(links) / ln(100.0)) END AS p,
  CASE WHEN back = 0 THEN 30.0 WHEN back <= 5 THEN 50.0 WHEN back <= 20 THEN 70.0 WHEN back <= 100 THEN 85.0 ELSE least(100.0, 85.0 + ln(back) / ln(1000.0)) END AS b,
  least(100.0, 50.0 + CASE WHEN {_article} THEN 15 ELSE 0 END + flags * 5 + CASE WHEN words >= 500 THEN 10 WHEN words >= 300 THEN 7 WHEN words >= 100 THEN 3 ELSE 0 END + CASE WHEN heads >= 5 THEN 5 WHEN heads >= 3 THEN 3 ELSE 0 END) AS q, flags / 5 * 100 AS m,
  greatest(10.0, CASE WHEN {_article} THEN 80 ELSE 50 END - CASE WHEN {sql_any(f"lower({sql_path('url')})", ['archive', 'category', 'tag', 'author'])} THEN 15 ELSE 0 END - CASE WHEN length(url) - length(replace(url, '?', '')) > 1 THEN 10 ELSE 0 END) AS u FROM a),
t AS (SELECT *, d * 0.15 + p * 0.15 + b * 0.15 + q * 0.20 + m * 0.15 + 50 * 0.10 + u * 0.10 AS total FROM s)
SELECT id, round(CAST(total AS DOUBLE), 6) AS total, round(CAST((d + p + b) / 3 AS DOUBLE), 6) AS link, CAST(q AS DOUBLE) AS content, CASE WHEN total >= 75 THEN 1 WHEN total >= 55 THEN 3 WHEN total >= 35 THEN 6 ELSE 10 END AS priority,
  CASE WHEN total >= 75 THEN 'CRAWL_NOW' WHEN total >= 55 THEN 'CRAWL_SOON' WHEN total >= 35 THEN 'CRAWL_LATER' ELSE 'LOW_VALUE' END AS recommendation FROM t""",
    "quality_gate": GATE_SQL + "SELECT * FROM gate",
    "quality_counts": GATE_SQL + "SELECT indexed, CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'acceptable' ELSE 'poor' END AS label, count(*) AS pages FROM gate GROUP BY ALL",
    "harmony_rank": f"""WITH {CONTENT}, j AS (SELECT c.*, s.trust_score FROM content c LEFT JOIN sites s ON c.site_id = s.id WHERE quality_score IS NOT NULL),
k AS (SELECT id, quality_score * {_w['relevance']!r}::DOUBLE AS rel, CAST(CASE WHEN last_crawled_at IS NULL THEN 0.5 WHEN {_crawl_days} <= 0 THEN 1.0 WHEN {_crawl_days} >= 365 THEN 0.1 ELSE greatest(0.1, exp(-{_crawl_days} / 180.0::DOUBLE)) END AS DOUBLE) * {_w['recency']!r}::DOUBLE AS recency,
  CAST({_trust} AS DOUBLE) * {_w['domain_trust']!r}::DOUBLE AS domain_trust, CAST(CASE WHEN length(coalesce(content, '')) = 0 THEN 0.3 ELSE CASE WHEN length(content) < 100 THEN 0.3 WHEN length(content) < 500 THEN 0.6 WHEN length(content) < 2000 THEN 0.8 ELSE 0.95 END * 0.6 + CASE WHEN length(coalesce(h1, '')) > 10 THEN 0.8 ELSE 0.5 END * 0.4 END AS DOUBLE) * {_w['quality']!r}::DOUBLE AS qual,
  ({_share('click_score', '100.0::DOUBLE')} * 0.3::DOUBLE + {_share('pagerank_score', '10.0::DOUBLE')} * 0.7::DOUBLE) * {_w['engagement']!r}::DOUBLE AS engagement, CAST(CASE WHEN coalesce(tracker_risk_score, 0) <> 0 THEN 1.0 - tracker_risk_score ELSE 0.5 END AS DOUBLE) * {_w['tracker_safety']!r}::DOUBLE AS safety FROM j)
SELECT id, round(rel + recency + domain_trust + qual + engagement + safety, 6) AS score, round(recency, 6) AS recency, round(domain_trust, 6) AS domain_trust, round(engagement, 6) AS engagement FROM k""",
    "final_score": f"""WITH {CONTENT} SELECT c.id, round((quality_score * 30 + 2.0::DOUBLE * CASE WHEN content_type = 'video' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END) * coalesce(trust_score, 0.5) * (1 - 0.3::DOUBLE * (1 - (1 - coalesce(CASE WHEN isnan(tracker_risk_score) THEN 0.5 ELSE tracker_risk_score END, 0.5)))), 6) AS score
  FROM content c JOIN sites s ON c.site_id = s.id WHERE quality_score IS NOT NULL""",
    "domain_quality": f"SELECT {sql_domain('url')} AS domain, max(CAST(CASE WHEN regexp_matches(url, {quoted(R.BAD_HOSTS)}) THEN 0.3 WHEN regexp_matches(url, {quoted(R.GOOD_HOSTS)}) THEN 0.9 ELSE 0.7 END AS DOUBLE)) AS quality, count(*) AS pages FROM (SELECT DISTINCT * FROM pages) GROUP BY ALL",
}
