"""Queries on crawl jobs, index content and link graphs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import merge as M
from ..operators.search import top
from ..runtime import staged, table
from .tables import CONTENT, JOBS, clicks, content, jobs, sql_domain

c = F.col
HREF = r'<a href="([^"]*)"'


def job_status_counts(spark, folder):
    return jobs(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


def session_stats(spark, folder):
    n = jobs(spark, folder).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("jobs"), *[F.count_if(c("status") == s).alias(s) for s in ("completed", "failed", "pending")], F.round(F.avg("depth"), 6).alias("avg_depth")
    )
    return n.withColumn("progress", F.round(c("completed") / c("jobs") * 100, 4))


def worker_metrics(spark, folder):
    done = jobs(spark, folder).where("status in ('completed', 'failed')")
    took = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1_000_000
    return done.agg(F.count(F.lit(1)).alias("jobs"), F.round(F.avg((c("status") == "completed").cast("double")), 6).alias("success"), F.round(F.avg(took), 3).alias("seconds"))


def index_stats(spark, folder):
    k = content(spark, folder)
    return k.groupBy("content_type").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("domain").alias("domains"), F.round(F.avg("quality_score"), 6).alias("quality"))


def top_domains(spark, folder):
    return top(content(spark, folder).groupBy("domain").agg(F.count(F.lit(1)).alias("pages")), F.desc("pages"), F.asc("domain"), limit=10)


def domain_jobs(spark, folder):
    return jobs(spark, folder).groupBy("domain").agg(F.count(F.lit(1)).alias("jobs"), F.countDistinct("url").alias("urls"), F.countDistinct("session_id").alias("sessions"))


def frontier_next(spark, folder):
    waiting = jobs(spark, folder).where("status = 'pending' and url is not null and url <> ''")
    return top(waiting, F.asc_nulls_last("depth"), F.asc_nulls_last("priority"), F.asc_nulls_last("created_at"), F.asc("job_id"), limit=12).select("job_id", "depth", "priority")


def _done(spark, folder):
    return jobs(spark, folder).where("status = 'completed'").select("job_id", "url", "domain")


def unindexed(spark, folder):
    return _done(spark, folder).join(table(spark, folder, "pages").select("url"), "url", "left_anti").select("job_id")


def indexed(spark, folder):
    return _done(spark, folder).join(table(spark, folder, "pages").select("url"), "url", "left_semi").groupBy("domain").agg(F.count(F.lit(1)).alias("jobs"))


def sites_without_recent_jobs(spark, folder):
    recent = jobs(spark, folder).where("created_at >= timestamp '2022-01-13 00:00:00'").select("domain")
    return table(spark, folder, "sites").join(recent, "domain", "left_anti").select("id", "domain")


def cleanup_titles(spark, folder):
    kept = M.delete(content(spark, folder), c("title").isNull() | c("title").isin("", "Untitled"))
    return kept.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"))


def upsert_pages(spark, folder):
    """The latest crawl of every url takes the place of its page; texts are cut to their columns."""
    old = content(spark, folder).select("url", "title", F.lit("page").alias("origin"))
    fresh = jobs(spark, folder).where("status = 'completed' and title is not null and url is not null").groupBy("url").agg(F.max("title").alias("title")).withColumn("origin", F.lit("job"))
    return M.clipped(M.upsert(old, fresh, "url"), {"title": 40})


def replace_images(spark, folder):
    images = content(spark, folder).where("og_image_url is not null").select(c("id").alias("page_id"), c("og_image_url").alias("url"))
    fresh = images.where("page_id % 10 = 0").withColumn("url", F.concat("url", F.lit("?v=2")))
    return M.replace_group(images, fresh, "page_id")


def _edges(spark, folder):
    """Links between hosts and paths of the crawled pages."""
    j = jobs(spark, folder).where("content is not null").select("url", F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1).alias("root"), F.explode(F.regexp_extract_all("content", F.lit(HREF), F.lit(1))).alias("href"))
    return j.select(c("url").alias("src"), F.when(F.startswith("href", F.lit("/")), F.concat("root", "href")).otherwise(c("href")).alias("dst")).distinct()


def _page_clicks(spark, folder):
    """Pages that follow each other in the clicks of one search, by time: a graph with cycles, over whole page ids."""
    k = clicks(spark, folder).where("page_id is not null and search_event_id is not null")
    w = Window.partitionBy("search_event_id").orderBy("clicked_at", "id")
    # a page clicked again does not follow itself
    return k.select(c("page_id").alias("src"), F.lead("page_id").over(w).alias("dst")).where("src <> dst").distinct()


def bfs_reach(spark, folder):
    seeds = _edges(spark, folder).select(c("src").alias("node")).where("node like '%.example/%'")
    return G.reach(seeds, _edges(spark, folder), 2).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


def bfs_levels(spark, folder):
    """Pages within three clicks of the pages that follow no other."""
    e = staged(_page_clicks(spark, folder))
    seeds = e.select(c("src").alias("node")).join(e.select(c("dst").alias("node")), "node", "left_anti")
    return G.reach(seeds, e, 3)


def pagerank(spark, folder):
    r = G.pagerank(_page_clicks(spark, folder), rounds=8)
    return r.select("node", F.round("rank", 6).alias("rank"))


def robots_paths(spark, folder):
    """Rules made of each site's number against the paths of its pages."""
    sites = table(spark, folder, "sites")
    text = F.concat(F.lit("User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /news\nAllow: /news/"), (c("id") % 10).cast("string"), F.lit("\nDisallow: /blog/ # all\nAllow: /blog/\nSitemap: /s.xml"))
    rules = G.robots_rules(sites.select("domain", text.alias("robots")))
    pages = content(spark, folder).select("domain", F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    return G.robots_allowed(pages, rules)


DONE = f"WITH {JOBS}, d AS (SELECT job_id, url, domain FROM jobs WHERE status = 'completed')"
EDGES = f"""WITH RECURSIVE {JOBS}, x AS (SELECT url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root, unnest(regexp_extract_all(content, '{HREF}', 1)) AS href FROM jobs WHERE content IS NOT NULL),
e AS (SELECT DISTINCT url AS src, CASE WHEN starts_with(href, '/') THEN root || href ELSE href END AS dst FROM x), """
GRAPH = """o AS (SELECT page_id AS src, lead(page_id) OVER (PARTITION BY search_event_id ORDER BY clicked_at NULLS FIRST, id) AS dst FROM (SELECT DISTINCT * FROM click_events) WHERE page_id IS NOT NULL AND search_event_id IS NOT NULL),
e AS (SELECT DISTINCT src, dst FROM o WHERE src <> dst)"""

QUERIES = {
    "job_status_counts": job_status_counts, "session_stats": session_stats, "worker_metrics": worker_metrics, "index_stats": index_stats, "top_domains": top_domains, "domain_jobs": domain_jobs, "frontier_next": frontier_next,
    "unindexed_anti": unindexed, "indexed_semi": indexed, "recent_sites_anti": sites_without_recent_jobs, "cleanup_titles": cleanup_titles, "upsert_pages": upsert_pages, "replace_images": replace_images,
    "bfs_reach": bfs_reach, "bfs_levels": bfs_levels, "pagerank": pagerank, "robots_allowed": robots_paths,
}
_round = lambda k: f"""r{k} AS (SELECT n.node, 0.15::DOUBLE + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM n)) AS rank
  FROM n LEFT JOIN (SELECT dst AS node, sum(rank / o) AS got FROM e JOIN r{k - 1} ON e.src = r{k - 1}.node JOIN (SELECT src, count(*) AS o FROM e GROUP BY src) USING (src) GROUP BY dst) g USING (node))"""  # noqa: E731
SQL = {
    "job_status_counts": f"WITH {JOBS} SELECT status, count(*) AS jobs FROM jobs GROUP BY 1",
    "session_stats": f"""WITH {JOBS} SELECT session_id, count(*) AS jobs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending,
  round(avg(depth), 6) AS avg_depth, round(count(*) FILTER (status = 'completed') / count(*) * 100, 4) AS progress FROM jobs GROUP BY 1""",
    "worker_metrics": f"WITH {JOBS} SELECT count(*) AS jobs, round(avg(CAST(status = 'completed' AS INT)), 6) AS success, round(avg((epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0::DOUBLE), 3) AS seconds FROM jobs WHERE status IN ('completed', 'failed')",
    "index_stats": f"WITH {CONTENT} SELECT content_type, count(*) AS pages, count(DISTINCT domain) AS domains, round(avg(quality_score), 6) AS quality FROM content GROUP BY 1",
    "top_domains": f"SELECT {sql_domain('url')} AS domain, count(*) AS pages FROM (SELECT DISTINCT * FROM pages) GROUP BY 1 ORDER BY pages DESC, domain LIMIT 10",
    "domain_jobs": f"WITH {JOBS} SELECT domain, count(*) AS jobs, count(DISTINCT url) AS urls, count(DISTINCT session_id) AS sessions FROM jobs GROUP BY 1",
    "frontier_next": f"WITH {JOBS} SELECT job_id, depth, priority FROM jobs WHERE status = 'pending' AND url <> '' ORDER BY depth NULLS LAST, priority NULLS LAST, created_at NULLS LAST, job_id LIMIT 12",
    "unindexed_anti": DONE + " SELECT job_id FROM d WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = d.url)",
    "indexed_semi": DONE + " SELECT domain, count(*) AS jobs FROM d WHERE url IN (SELECT url FROM pages) GROUP BY 1",
    "recent_sites_anti": f"WITH {JOBS} SELECT id, domain FROM sites s WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.domain = s.domain AND j.created_at >= TIMESTAMPTZ '2022-01-13 00:00:00+00')",
    "cleanup_titles": f"WITH {CONTENT} SELECT domain, count(*) AS pages FROM content WHERE title IS NOT NULL AND title NOT IN ('', 'Untitled') GROUP BY 1",
    "upsert_pages": f"""WITH {CONTENT}, {JOBS}, n AS (SELECT url, max(title) AS title, 'job' AS origin FROM jobs WHERE status = 'completed' AND title IS NOT NULL AND url IS NOT NULL GROUP BY url)
SELECT url, substring(title, 1, 40) AS title, origin FROM (SELECT * FROM n UNION ALL SELECT url, title, 'page' FROM content WHERE url NOT IN (SELECT url FROM n))""",
    "replace_images": f"WITH {CONTENT} SELECT id AS page_id, og_image_url || CASE WHEN id % 10 = 0 THEN '?v=2' ELSE '' END AS url FROM content WHERE og_image_url IS NOT NULL",
    "bfs_reach": EDGES + """s AS (SELECT DISTINCT src AS node FROM e WHERE src LIKE '%.example/%'), l1 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM s) AND dst NOT IN (SELECT node FROM s)),
l2 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM l1) AND dst NOT IN (SELECT node FROM s UNION SELECT node FROM l1)), a AS (SELECT 0 AS depth, node FROM s UNION ALL SELECT 1, node FROM l1 UNION ALL SELECT 2, node FROM l2)
SELECT depth, count(*) AS nodes FROM a GROUP BY 1""",
    "bfs_levels": f"""WITH RECURSIVE {GRAPH}, w AS (SELECT DISTINCT src AS node, 0 AS depth FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < 3) SELECT node, min(depth) AS depth FROM w GROUP BY node""",
    "pagerank": f"WITH {GRAPH}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r0 AS (SELECT node, 1.0::DOUBLE AS rank FROM n), " + ", ".join(_round(k) for k in range(1, 9)) + " SELECT node, round(rank, 6) AS rank FROM r8",
    "robots_allowed": f"""WITH {CONTENT}, p AS (SELECT DISTINCT domain, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM content),
r AS (SELECT domain, '/news' AS rule, 0 AS allow FROM sites UNION ALL SELECT domain, '/news/' || (id % 10), 1 FROM sites UNION ALL SELECT domain, '/blog/', 0 FROM sites UNION ALL SELECT domain, '/blog/', 1 FROM sites),
b AS (SELECT p.domain, p.path, arg_max(allow, (length(rule), allow)) AS allow FROM p JOIN r ON p.domain = r.domain AND starts_with(p.path, r.rule) GROUP BY ALL)
SELECT p.domain, p.path, coalesce(b.allow = 1, true) AS allowed FROM p LEFT JOIN b USING (domain, path)""",
}
