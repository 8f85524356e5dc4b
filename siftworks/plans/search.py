"""Search queries."""

from pyspark.sql import functions as F

from ..functions.ranking import simple_score
from ..functions.text import days_between
from ..operators.search import fuzzy_search, image_search, latest, response, search, suggest, top, with_fallback
from ..runtime import table
from .tables import CONTENT, JOBS, NOW, QUERY, SEARCHES, as_of, content, jobs, sql_days

HIT = f"(coalesce(title ILIKE '%{QUERY}%', false) OR coalesce(h1 ILIKE '%{QUERY}%', false) OR coalesce(description ILIKE '%{QUERY}%', false) OR coalesce(content ILIKE '%{QUERY}%', false))"
FRESH = f"greatest(0.0::DOUBLE, 3 - 0.01::DOUBLE * {sql_days('last_crawled_at', NOW)})"
RANK = " + ".join(f"CASE WHEN coalesce({c} ILIKE '%{QUERY}%', false) THEN {n}.0::DOUBLE ELSE 0.0::DOUBLE END" for c, n in (("title", 10), ("h1", 8), ("url", 6), ("description", 4))) + f" + quality_score * 5 + coalesce({FRESH}, 0.0::DOUBLE)"


def _ranked(hits):
    return hits.select("place", "id", F.round("rank", 6).alias("rank"))


def search_ranked(spark, folder):
    return _ranked(search(content(spark, folder, False), QUERY, as_of()))


def search_paged(spark, folder):
    return _ranked(search(content(spark, folder, False), QUERY, as_of(), limit=15, offset=10))


def search_filtered(spark, folder):
    return _ranked(search(content(spark, folder, False), QUERY, as_of(), limit=20, domain="hub", content_type="blog", least_quality=0.6))


def search_quality_fallback(spark, folder):
    return _ranked(search(content(spark, folder, False), QUERY, as_of(), rank="quality"))


def search_with_analysis(spark, folder):
    """The best hits, and only for these the latest finished analysis of their url."""
    hits = search(content(spark, folder, False), QUERY, as_of(), limit=50).select("place", "id", "url")
    done = jobs(spark, folder).where("status = 'completed'").select("url", "job_id", "completed_at", "page_value_score", "spam_score")
    found = done.join(F.broadcast(hits.select("url").distinct()), "url")  # at most 50 urls
    last = latest(found, "url", F.desc_nulls_last("completed_at"), F.asc("job_id"))
    return hits.join(last, "url", "left").select("place", "id", "job_id", "page_value_score", "spam_score")


def search_response(spark, folder):
    return response(search(content(spark, folder, False), QUERY, as_of(), limit=20))


def job_fallback(spark, folder):
    """No page holds the word, so crawl jobs are searched by their title and description."""
    word = "zzznothing"
    hits = search(content(spark, folder, False), word, as_of()).select(F.col("id").cast("string").alias("key"), "title", F.lit("search_content").alias("source"))
    known = jobs(spark, folder).where((F.col("status") == "completed") & F.ilike(F.coalesce("title", F.lit("")), F.lit(f"%{QUERY}%")))
    other = top(known, F.desc_nulls_last("page_value_score"), F.asc("job_id"), limit=10).select(F.col("job_id").alias("key"), "title", F.lit("crawl_jobs").alias("source"))
    return with_fallback(hits, other)


def simple_scores(spark, folder):
    c = content(spark, folder, False)
    score = simple_score(["the", QUERY], F.col("title"), F.col("url"), F.col("h1"), F.col("content"), F.length(F.coalesce("content", F.lit(""))), F.coalesce(days_between(F.col("last_crawled_at"), as_of()), F.lit(0)))
    return c.select("id", F.round(score, 6).alias("score")).dropDuplicates(["id"])


def suggestions(spark, folder):
    return suggest(table(spark, folder, "search_events").dropDuplicates(["id"]), content(spark, folder), "how", 12)


def suggest_history(spark, folder):
    asked = table(spark, folder, "search_events").dropDuplicates(["id"]).where("query is not null").groupBy("query").agg(F.count(F.lit(1)).alias("times"))
    return top(asked, F.desc("times"), F.asc("query"), limit=20)


def images_found(spark, folder):
    pages = content(spark, folder).where("og_image_url is not null").select(F.col("id").alias("page_id"), F.col("og_image_url").alias("url"), F.col("title").alias("alt_text"))
    return top(image_search(pages, f"{QUERY} -how"), F.desc("score"), F.asc("page_id"), limit=30).select("page_id", "score")


def list_contents(spark, folder):
    excerpt = F.when(F.length("content") > 500, F.concat(F.substring("content", 1, 500), F.lit("..."))).otherwise(F.col("content")).alias("excerpt")
    c = content(spark, folder, False).select("id", "url", "last_crawled_at", excerpt).dropDuplicates(["id"])
    return top(c, F.desc_nulls_last("last_crawled_at"), F.asc("id"), limit=20, offset=5).drop("last_crawled_at")


def fuzzy(spark, folder):
    return fuzzy_search(content(spark, folder, False), QUERY, limit=10)


def _sql(where: str, order: str, limit: int, offset: int = 0) -> str:
    return f"""WITH {CONTENT}, hits AS (SELECT *, {order} AS rank FROM content WHERE {where}),
p AS (SELECT *, row_number() OVER (ORDER BY rank DESC NULLS FIRST, id) AS place FROM hits)
SELECT CAST(place AS INT) AS place, id, round(rank, 6) AS rank FROM p WHERE place > {offset} AND place <= {offset + limit}"""


OCCURS = "CAST((length(coalesce(lower(content), '')) - length(replace(coalesce(lower(content), ''), '{w}', ''))) / {n} AS INT)"
TERMS = " + ".join(
    f"CASE WHEN contains(lower(coalesce(title, '')), '{w}') THEN 10.0::DOUBLE ELSE 0 END + CASE WHEN contains(lower(coalesce(url, '')), '{w}') THEN 6.0::DOUBLE ELSE 0 END"
    f" + CASE WHEN contains(lower(coalesce(h1, '')), '{w}') THEN 8.0::DOUBLE ELSE 0 END + {OCCURS.format(w=w, n=len(w))}"
    for w in ("the", QUERY)
)
DAYS = f"coalesce({sql_days('last_crawled_at', NOW)}, 0)"

QUERIES = {
    "search_ranked": search_ranked,
    "search_paged": search_paged,
    "search_filtered": search_filtered,
    "search_quality_fallback": search_quality_fallback,
    "search_with_analysis": search_with_analysis,
    "search_response": search_response,
    "job_fallback": job_fallback,
    "simple_score": simple_scores,
    "suggest": suggestions,
    "suggest_history": suggest_history,
    "image_search": images_found,
    "list_contents": list_contents,
    "fuzzy_search": fuzzy,
}
SQL = {
    "search_ranked": _sql(HIT, RANK, 10),
    "search_paged": _sql(HIT, RANK, 15, 10),
    "search_filtered": _sql(HIT + " AND domain ILIKE '%hub%' AND content_type = 'blog' AND quality_score >= 0.6", RANK, 20),
    "search_quality_fallback": _sql(HIT, "quality_score", 10),
    "search_with_analysis": f"""WITH {CONTENT}, {JOBS}, hits AS (SELECT *, row_number() OVER (ORDER BY {RANK} DESC NULLS FIRST, id) AS place FROM content WHERE {HIT}),
last AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY completed_at DESC NULLS LAST, job_id) AS n FROM jobs WHERE status = 'completed')
SELECT CAST(h.place AS INT) AS place, h.id, l.job_id, l.page_value_score, l.spam_score FROM hits h LEFT JOIN (SELECT * FROM last WHERE n = 1) l USING (url) WHERE h.place <= 50""",
    "search_response": f"""WITH {CONTENT}, hits AS (SELECT *, row_number() OVER (ORDER BY {RANK} DESC NULLS FIRST, id) AS place FROM content WHERE {HIT})
SELECT id, url, domain, coalesce(nullif(title, ''), 'No title') AS title, coalesce(nullif(quality_score, 0.0), 0.5) AS score, substring(coalesce(description, ''), 1, 200) AS snippet,
  coalesce(content_type, 'unknown') AS content_type, 'search_content' AS source FROM hits WHERE place <= 20""",
    "job_fallback": f"""WITH {CONTENT}, {JOBS} SELECT job_id AS key, title, 'crawl_jobs' AS source FROM jobs WHERE status = 'completed' AND title ILIKE '%{QUERY}%' AND NOT EXISTS (SELECT 1 FROM content WHERE
  title ILIKE '%zzznothing%' OR h1 ILIKE '%zzznothing%' OR description ILIKE '%zzznothing%' OR content ILIKE '%zzznothing%') ORDER BY page_value_score DESC NULLS LAST, job_id LIMIT 10""",
    "simple_score": f"""WITH {CONTENT} SELECT id, round(greatest(CASE WHEN contains(lower(coalesce(title, '')), 'the {QUERY}') THEN 5.0::DOUBLE ELSE 0 END + {TERMS}
  - CASE WHEN {DAYS} > 0 THEN least({DAYS} * 0.1::DOUBLE, 10.0::DOUBLE) ELSE 0 END + CASE WHEN length(coalesce(content, '')) < 100 THEN -5.0::DOUBLE WHEN length(coalesce(content, '')) > 1000 THEN 2.0::DOUBLE ELSE 0 END, 0.0::DOUBLE), 6) AS score FROM content""",
    "suggest": f"""WITH {SEARCHES}, {CONTENT}, a AS (SELECT query AS text, 0 AS source, -count(*) AS ord FROM searches WHERE query ILIKE 'how%' GROUP BY query ORDER BY ord, query LIMIT 12),
b AS (SELECT DISTINCT title AS text, 1 AS source, 0 AS ord FROM content WHERE starts_with(lower(title), 'how') ORDER BY title LIMIT 12),
u AS (SELECT trim(text) AS suggestion, *, row_number() OVER (PARTITION BY trim(text) ORDER BY source, ord, text) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT suggestion, CAST(row_number() OVER (ORDER BY source, ord, text) AS INT) AS place FROM u WHERE n = 1 AND suggestion <> '' ORDER BY source, ord, text LIMIT 12""",
    "suggest_history": f"WITH {SEARCHES} SELECT query, count(*) AS times FROM searches WHERE query IS NOT NULL GROUP BY query ORDER BY times DESC, query LIMIT 20",
    "image_search": f"""WITH {CONTENT} SELECT id AS page_id, CAST((length(lower(title)) - length(replace(lower(title), '{QUERY}', ''))) / {len(QUERY)} AS INT) AS score FROM content
  WHERE og_image_url IS NOT NULL AND contains(lower(title), '{QUERY}') AND NOT contains(lower(title), 'how') ORDER BY score DESC, id LIMIT 30""",
    "list_contents": f"""WITH {CONTENT} SELECT id, url, CASE WHEN length(content) > 500 THEN substring(content, 1, 500) || '...' ELSE content END AS excerpt FROM content ORDER BY last_crawled_at DESC NULLS LAST, id LIMIT 20 OFFSET 5""",
}
