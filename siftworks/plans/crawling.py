"""Queries on the way from crawl jobs to indexed content, counts of the index, images, intents and trackers as tables."""

from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import trackers as K
from ..functions.content import url_type
from ..functions.relevance import score_label
from ..operators import behaviour as O
from ..operators import crawling as C
from ..operators import graph as G
from ..operators import html as H
from ..operators.search import explain_relevance, image_search, latest, top
from ..runtime import table
from .operations import GRAPH, _page_clicks
from .pages import SQL as PAGE_SQL
from .scoring import GATE_SQL
from .scoring import SQL as SCORING_SQL
from .tables import CLICKS, CONTENT, JOBS, QUERY, SEARCHES, as_of, clicks, content, html_rows, jobs, searches, sql_domain, sql_url_type

c = F.col
EITHER = f"{QUERY} -how OR kettle"


def new_jobs(spark, folder):
    """A job for every page, scored by the latest job of its url."""
    scored = latest(jobs(spark, folder).where("url is not null"), "url", F.desc_nulls_last("completed_at"), F.desc("job_id")).select("url", c("page_value_score").alias("score"))
    pages = content(spark, folder).select(c("domain").alias("session_id"), "domain", "url", F.lit(0).alias("depth"), F.lit(3).alias("max_depth"))
    return C.new_jobs(pages, scored, as_of()).select("url", "session_id", "status", "priority", F.round("page_value_score", 6).alias("page_value_score"))


def job_states(spark, folder):
    """States of the jobs, every delivered row being an event at the last of its times."""
    at = F.greatest("created_at", "started_at", "completed_at").alias("at")
    return C.job_states(table(spark, folder, "crawl_jobs").select("job_id", F.lower(F.trim("status")).alias("status"), at))


def index_totals(spark, folder):
    """Indexed pages, their quality, and how many completed jobs are pending or not indexed."""
    pages = content(spark, folder).select(F.lit("page").alias("state"), "quality_score")
    states = jobs(spark, folder).select(c("status").alias("state"), F.lit(None).cast("double").alias("quality_score"))
    count = lambda s: F.count_if(c("state") == s)
    n = pages.unionByName(states).agg(count("page").alias("total"), F.round(F.avg("quality_score"), 3).alias("avg_quality"), count("pending").alias("pending"), count("completed").alias("completed"))
    return n.withColumn("not_indexed", c("completed") - c("total"))


def page_totals(spark, folder):
    """How many pages each content type has in all, and how many pages of 20 a list of them fills."""
    n = content(spark, folder).groupBy("content_type").agg(F.count(F.lit(1)).alias("total"))
    return n.withColumn("lists", F.ceil(c("total") / 20).cast("long"))


def distinct_domains(spark, folder):
    return jobs(spark, folder).where("domain is not null").select("domain").distinct().orderBy("domain")


def remaining_limits(spark, folder):
    """Per domain how many of 100 pages may still be crawled, one at least."""
    n = content(spark, folder).groupBy("domain").agg(F.count(F.lit(1)).alias("existing"))
    return n.withColumn("remaining", F.greatest(F.lit(1).cast("long"), 100 - c("existing")))


def debug_counts(spark, folder):
    """Rows of the main tables, with the five smallest keys of each."""
    out = None
    for name, rows, key in (("pages", content(spark, folder), "id"), ("crawl_jobs", jobs(spark, folder), "job_id"), ("search_events", searches(spark, folder), "id")):
        keys = rows.select(c(key).cast("string").alias("key"), c(key).alias("by"))
        sample = top(keys, F.asc("by"), limit=5).agg(F.array_join(F.array_sort(F.collect_list("by")), ",").alias("sample"))
        counted = keys.agg(F.count(F.lit(1)).alias("rows"))
        for one in (counted.withColumn("sample", F.lit(None).cast("string")), sample.withColumn("rows", F.lit(None).cast("long"))):
            one = one.select(F.lit(name).alias("name"), "rows", "sample")
            out = one if out is None else out.unionByName(one)
    return out.groupBy("name").agg(F.max("rows").alias("rows"), F.max("sample").alias("sample"))


def sampled_sites(spark, folder):
    """Twenty sites in the order of a seeded hash: a sample that every run repeats."""
    sites = table(spark, folder, "sites").select("id", "domain")
    return top(sites.withColumn("by", F.md5(F.concat(F.lit("7/"), c("domain")))), F.asc("by"), F.asc("id"), limit=20).select("id", "domain")


def image_alts(spark, folder):
    """Per page with HTML its images, and those whose alternative text says something."""
    p = H.parsed(jobs(spark, folder).where("content is not null"))
    return p.select(c("key").alias("job_id"), F.size("images").alias("images"), C.meaningful_alts(c("images")).alias("described"))


def _images(spark, folder):
    return content(spark, folder).where("og_image_url is not null").select(c("id").alias("page_id"), c("og_image_url").alias("url"), c("og_title").alias("alt_text"))


def images_of_pages(spark, folder):
    """Images with an alternative text, joined to their pages."""
    pages = content(spark, folder).select(c("id").alias("page_id"), "title", "domain")
    return _images(spark, folder).where("length(alt_text) >= 3").join(pages, "page_id").select("page_id", "url", "title", "domain")


def image_either(spark, folder):
    pages = content(spark, folder).where("og_image_url is not null").select(c("id").alias("page_id"), c("title").alias("alt_text"))
    return image_search(pages, EITHER).select("page_id", "score")


def cluster_intents(spark, folder):
    """The intent kept per cluster of queries: that of its last search."""
    s = searches(spark, folder).where("query_cluster_id is not null and query is not null")
    last = s.groupBy("query_cluster_id").agg(F.max_by("query", F.struct("created_at", "id")).alias("query"), F.count(F.lit(1)).alias("searches"))
    return last.withColumn("i", I.intent(c("query"))).select("query_cluster_id", "searches", c("i.intent").alias("intent"), F.round("i.confidence", 6).alias("confidence"))


def tracker_tables(spark, folder):
    """Trackers as a table of their own: name, category, risk and the pages they are on."""
    t = html_rows(spark, folder, lambda j: j.select("job_id", "digest", F.explode(K.trackers(c("content"))).alias("t")))
    n = t.groupBy(c("t.name").alias("name"), c("t.risk").alias("risk_level")).agg(F.countDistinct("job_id").alias("pages"))
    return n.withColumn("category", K.category(c("name")))


def tracker_pages(spark, folder):
    """Pages with their trackers by way of the two tables: pages without one stay."""
    found = html_rows(spark, folder, lambda j: j.select("job_id", "digest", K.trackers(c("content")).alias("t")))
    held = found.select("job_id", F.explode("t").alias("x")).select("job_id", c("x.name").alias("name"))
    risks = tracker_tables(spark, folder).select("name", "risk_level", "category")
    joined = found.select("job_id").join(held, "job_id", "left").join(risks, "name", "left")
    return joined.groupBy("job_id").agg(F.count("name").alias("trackers"), F.count_if(c("risk_level") >= 4).alias("high_risk"), F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"))


def trailing_minute(spark, folder):
    return O.trailing_clicks(clicks(spark, folder), searches(spark, folder))


def term_frequency(spark, folder):
    """How often each term occurs in each title."""
    from ..functions.text import tokens

    words = content(spark, folder).select("id", F.explode(tokens(F.lower("title"))).alias("term"))
    return words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("times"))


def index_outcomes(spark, folder):
    """What the quality gate makes of the completed jobs that no page shows yet, per content type."""
    return C.index_counters(_gated(spark, folder))


def _gated(spark, folder):
    none = F.lit(None).cast("string")
    j = jobs(spark, folder).where("status = 'completed' and url is not null").join(table(spark, folder, "pages").select("url").distinct(), "url", "left_anti")
    return C.gated(
        j.select("job_id", "url", "domain", url_type(c("url")).alias("content_type"), "content", "title", "description", none.alias("og_title"), none.alias("og_image_url"), none.alias("h1"), F.lit(0).alias("h2_count"), F.lit(None).cast("double").alias("analysis"), F.lit(None).cast("double").alias("value"))
    )


def analysis_explained(spark, folder):
    """The five scores of a job's analysis as one struct per job, null where the analysis has none of them."""
    names = ["page_value_score", "spam_score", "relevance_score", "word_count", "priority"]
    j = jobs(spark, folder)
    any_known = F.greatest(*[c(x).isNotNull() for x in names[:3]])
    return j.select("job_id", F.when(any_known, F.struct(*names)).alias("s")).where("s is not null").select("job_id", *[c(f"s.{x}").alias(x) for x in names])


def crawl_reach(spark, folder):
    """Pages within three clicks of the first hundred that follow no other, ten followers each, without the recent ones."""
    e = _page_clicks(spark, folder)
    links = e.select(c("src").cast("string").alias("src"), c("dst").cast("string").alias("dst"), c("dst").alias("position"))
    seeds = links.select(c("src").alias("url")).join(links.select(c("dst").alias("url")), "url", "left_anti")
    recent = content(spark, folder).where("last_crawled_at > timestamp '2022-01-30 00:00:00'").select(c("id").cast("string").alias("url"))
    return C.crawl(seeds, links, 3, max_pages=100_000, per_page=10, recent=recent)


def fuzzy_explain(spark, folder):
    """How each page answers a query, by title, content, url and host, with labels."""
    x = explain_relevance(content(spark, folder, False), QUERY)
    names = ["title_match", "content_match", "url_match", "domain_relevance"]
    return x.select("id", *[F.round(n, 6).alias(n) for n in names], *[score_label(c(n)).alias(f"{n}_label") for n in names])


def robots_extras(spark, folder):
    sites = table(spark, folder, "sites")
    text = F.concat(F.lit("Crawl-delay: 1\nUser-agent: other\nCrawl-delay: 9\nUser-agent: *\nCrawl-delay: "), (c("id") % 10).cast("string"), F.lit(" # s\nSitemap: /a.xml\nSitemap: /b.xml"))
    return G.robots_extras(sites.select("domain", text.alias("robots"))).select("domain", "crawl_delay", F.array_join("sitemaps", ",").alias("sitemaps"))


QUERIES = {
    "new_jobs": new_jobs, "job_states": job_states, "index_totals": index_totals, "page_totals": page_totals, "distinct_domains": distinct_domains, "remaining_limits": remaining_limits, "debug_counts": debug_counts,
    "sampled_sites": sampled_sites, "image_alts": image_alts, "images_of_pages": images_of_pages, "image_either": image_either, "cluster_intents": cluster_intents, "tracker_tables": tracker_tables, "tracker_pages": tracker_pages,
    "trailing_minute": trailing_minute, "term_frequency": term_frequency, "index_outcomes": index_outcomes, "analysis_explained": analysis_explained, "crawl_reach": crawl_reach, "fuzzy_explain": fuzzy_explain, "robots_extras": robots_extras,
}

_tracked = PAGE_SQL["tracker_detect"].split(", n AS (SELECT h.job_id", 1)[0]
_category = "CASE " + " ".join(f"WHEN name IN ({', '.join(map(repr, names))}) THEN '{kind}'" for kind, names in K.CATEGORIES.items()) + " ELSE 'other' END"
_trackers = _tracked + ", y AS (SELECT job_id, split_part(t, '/', 2) AS name, CAST(split_part(t, '/', 3) AS INT) AS risk_level FROM t)"
_times = lambda w: f"CAST((length(a) - length(replace(a, '{w}', ''))) / {len(w)} AS INT)"
_gate_jobs = f"{JOBS}, content AS (SELECT job_id AS id, url, {sql_url_type('url')} AS content_type, content, title, NULL::VARCHAR AS og_title, description, NULL::VARCHAR AS og_image_url, NULL::VARCHAR AS h1 FROM jobs WHERE status = 'completed' AND url IS NOT NULL AND url NOT IN (SELECT url FROM pages))"
_intent = SCORING_SQL["intent_detect"].split(", k AS (SELECT id, ", 1)[1].split(" FROM searches WHERE query IS NOT NULL)", 1)
SQL = {
    "new_jobs": f"""WITH {CONTENT}, {JOBS}, l AS (SELECT url, page_value_score FROM jobs WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY completed_at DESC NULLS LAST, job_id DESC) = 1),
s AS (SELECT c.url, domain AS session_id, 'pending' AS status, coalesce(nullif(l.page_value_score, 0), 50.0::DOUBLE) AS score FROM content c LEFT JOIN l ON l.url = c.url) SELECT url, session_id, status, CAST(trunc(100 - score) AS INT) AS priority, round(score, 6) AS page_value_score FROM s""",
    "job_states": """WITH e AS (SELECT job_id, lower(trim(status)) AS status, greatest(created_at, started_at, completed_at) AS moment FROM crawl_jobs WHERE job_id IS NOT NULL)
SELECT job_id, arg_max(status, (coalesce(moment, TIMESTAMPTZ '0001-01-01 00:00:00+00'), status)) AS status, max(moment) FILTER (status = 'processing') AS started_at, max(moment) FILTER (status = 'completed') AS completed_at FROM e GROUP BY job_id""",
    "index_totals": f"""WITH {CONTENT}, {JOBS}, p AS (SELECT count(*) AS total, round(avg(quality_score), 3) AS avg_quality FROM content), j AS (SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'completed') AS completed FROM jobs)
SELECT *, completed - total AS not_indexed FROM p, j""",
    "page_totals": f"WITH {CONTENT} SELECT content_type, count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS lists FROM content GROUP BY 1",
    "distinct_domains": f"WITH {JOBS} SELECT DISTINCT domain FROM jobs WHERE domain IS NOT NULL ORDER BY domain",
    "remaining_limits": f"WITH {CONTENT} SELECT domain, count(*) AS existing, greatest(1, 100 - count(*)) AS remaining FROM content GROUP BY 1",
    "debug_counts": f"""WITH {JOBS}, {SEARCHES}, p AS (SELECT DISTINCT id FROM pages),
a AS (SELECT 'pages' AS name, count(*) AS rows, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM p ORDER BY id LIMIT 5)) AS sample FROM p),
b AS (SELECT 'crawl_jobs', count(*), (SELECT string_agg(job_id, ',' ORDER BY job_id) FROM (SELECT job_id FROM jobs ORDER BY job_id LIMIT 5)) FROM jobs),
d AS (SELECT 'search_events', count(*), (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM searches ORDER BY id LIMIT 5)) FROM searches) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d""",
    "sampled_sites": "SELECT id, domain FROM sites ORDER BY md5('7/' || domain), id LIMIT 20",
    "image_alts": f"""WITH {JOBS} SELECT job_id, CAST(len(regexp_extract_all(content, '(?i)<img[^>]*\\ssrc=')) AS INT) AS images, CAST(len(regexp_extract_all(content, '(?i)<img[^>]*\\salt="[^"]{{3,}}"')) AS INT) AS described FROM jobs WHERE content IS NOT NULL""",
    "images_of_pages": f"WITH {CONTENT} SELECT id AS page_id, og_image_url AS url, title, domain FROM content WHERE og_image_url IS NOT NULL AND length(og_title) >= 3",
    "image_either": f"""WITH {CONTENT}, i AS (SELECT id AS page_id, lower(coalesce(title, '')) AS a FROM content WHERE og_image_url IS NOT NULL), m AS (SELECT *, contains(a, '{QUERY}') AND NOT contains(a, 'how') AS x, contains(a, 'kettle') AS y FROM i)
SELECT page_id, CAST(CASE WHEN x THEN {_times(QUERY)} ELSE 0 END + CASE WHEN y THEN {_times('kettle')} ELSE 0 END AS INT) AS score FROM m WHERE x OR y""",
    "cluster_intents": f"""WITH {SEARCHES}, q AS (SELECT query_cluster_id, arg_max(query, (coalesce(created_at, TIMESTAMPTZ '0001-01-01 00:00:00+00'), id)) AS query, count(*) AS searches FROM searches WHERE query_cluster_id IS NOT NULL AND query IS NOT NULL GROUP BY 1),
k AS (SELECT query_cluster_id AS id, searches, {_intent[0]} FROM q){_intent[1].replace('SELECT id, CASE', 'SELECT id AS query_cluster_id, searches, CASE')}""",
    "tracker_tables": _trackers + f" SELECT name, risk_level, count(DISTINCT job_id) AS pages, {_category} AS category FROM y GROUP BY name, risk_level",
    "tracker_pages": _trackers + f" SELECT h.job_id, count(y.name) AS trackers, count(*) FILTER (y.risk_level >= 4) AS high_risk, coalesce(string_agg(DISTINCT CASE WHEN y.name IS NOT NULL THEN {_category.replace('name IN', 'y.name IN')} END, ', ' ORDER BY CASE WHEN y.name IS NOT NULL THEN {_category.replace('name IN', 'y.name IN')} END), '') AS categories FROM h LEFT JOIN y USING (job_id) GROUP BY h.job_id",
    "trailing_minute": f"""WITH {SEARCHES}, {CLICKS} SELECT c.id, s.session_id, count(*) OVER (PARTITION BY s.session_id ORDER BY c.clicked_at RANGE BETWEEN INTERVAL 1 MINUTE PRECEDING AND CURRENT ROW) AS clicks
FROM clicks c JOIN searches s ON c.search_event_id = s.id WHERE s.session_id IS NOT NULL AND c.clicked_at IS NOT NULL""",
    "term_frequency": PAGE_SQL["tokenize_tf"].split("WITH ", 1)[0] + f"WITH {CONTENT}, w AS (SELECT id, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM content) SELECT id, term, count(*) AS times FROM w WHERE length(term) >= 2 AND " + PAGE_SQL["tokenize_tf"].split(">= 2 AND ", 1)[1].split(" GROUP BY", 1)[0] + " GROUP BY id, term",
    "index_outcomes": GATE_SQL.replace(CONTENT, _gate_jobs) + """SELECT c.content_type, count(*) FILTER (coalesce(c.content, '') <> '' AND g.indexed) AS indexed, count(*) FILTER (coalesce(c.content, '') <> '' AND NOT g.indexed) AS filtered, count(*) FILTER (coalesce(c.content, '') = '') AS skipped
FROM content c JOIN gate g USING (id) GROUP BY 1""",
    "analysis_explained": f"WITH {JOBS} SELECT job_id, page_value_score, spam_score, relevance_score, word_count, priority FROM jobs WHERE page_value_score IS NOT NULL OR spam_score IS NOT NULL OR relevance_score IS NOT NULL",
    "robots_extras": "SELECT domain, CAST(id % 10 AS DOUBLE) AS crawl_delay, '/a.xml,/b.xml' AS sitemaps FROM sites",
}
