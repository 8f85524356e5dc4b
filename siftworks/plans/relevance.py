"""Queries on relevance, explanations and tracker profiles."""

from pyspark.sql import functions as F

from ..functions import trackers as K
from ..functions.content import page_type
from ..functions.ranking import domain_quality
from ..functions.relevance import TYPE_SCORES, page_relevance, score_label
from ..functions.text import jaccard, normalize_query
from .pages import SQL as PAGE_SQL
from .scoring import SQL as SCORING_SQL
from .tables import CONTENT, QUERY, content, html_rows

c = F.col
ASKED = "best free guide to a compact museum 2024"
# what the key words give for the query asked, for the reference SQL
WORDS = ["best", "free", "guide"]


def page_relevances(spark, folder):
    pages = content(spark, folder, False)
    root = F.regexp_replace("url", "/$", "") == F.concat(F.lit("https://"), c("domain"))
    kind = page_type(c("url"), F.get_json_object("jsonld", "$['@type']"), c("content"), root)
    dated = F.get_json_object("jsonld", "$.datePublished").isNotNull()
    r = page_relevance(F.lit(ASKED), kind, c("content"), c("title"), c("description"), dated)
    return pages.select("id", r.alias("r")).dropDuplicates(["id"]).select("id", F.round("r.relevance", 6).alias("relevance"), "r.intent_match", F.round("r.content_match", 6).alias("content_match"), "r.relevant")


def explained(spark, folder):
    """Per page the overlap of its title with the query, the quality of its host, and labels for both."""
    words = lambda x: F.array_distinct(F.split(normalize_query(x), " "))
    pages = content(spark, folder).where("title is not null")
    pages = pages.withColumn("overlap", F.round(jaccard(words(c("title")), words(F.lit(f"how to find a {QUERY}"))), 6)).withColumn("host", domain_quality(c("url")))
    return pages.select("id", "overlap", score_label(c("overlap")).alias("overlap_label"), "host", score_label(c("host")).alias("host_label"))


def tracker_profile(spark, folder):
    """Per page the number of trackers, those of high risk, their categories, and the profile."""
    t = html_rows(spark, folder, lambda j: j.select("job_id", "digest", K.trackers(c("content")).alias("t")))
    n, high = F.size("t"), F.size(F.filter("t", lambda x: x["risk"] >= 4))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("t", lambda x: K.category(x["name"])))), ", ")
    profile = F.when(n == 0, F.lit("clean")).when(high > 0, F.lit("risky")).when(n >= 5, F.lit("tracker_heavy")).otherwise(F.lit("normal"))
    return t.select("job_id", n.alias("trackers"), high.alias("high_risk"), names.alias("categories"), profile.alias("profile"))


_type = SCORING_SQL["page_type"].rsplit("SELECT id, ", 1)[1].rsplit(" AS page_type", 1)[0]
_hits = " + ".join(f"CAST(contains(lower(coalesce(content, '')), '{w}') AS INT)" for w in WORDS)
_in = lambda x: "(" + " OR ".join(f"contains(lower(coalesce({x}, '')), '{w}')" for w in WORDS) + ")"
_fit = TYPE_SCORES["commercial"]
_words = r"list_distinct(string_split(trim(regexp_replace(lower(title), '\s+', ' ', 'g'), ' '), ' '))"
_label = lambda x: f"CASE WHEN {x} >= 0.9 THEN '⚡ Excellent match' WHEN {x} >= 0.7 THEN '✓ Good match' WHEN {x} >= 0.5 THEN '~ Fair match' WHEN {x} >= 0.3 THEN '◑ Weak match' ELSE '✗ Poor match' END"
_quality = SCORING_SQL["domain_quality"].split("max(CAST(", 1)[1].split(" AS DOUBLE))", 1)[0]
_category = "CASE " + " ".join(f"WHEN split_part(t.t, '/', 2) IN ({', '.join(map(repr, names))}) THEN '{kind}'" for kind, names in K.CATEGORIES.items()) + " WHEN t.t IS NOT NULL THEN 'other' END"

QUERIES = {"page_relevance": page_relevances, "explain_relevance": explained, "tracker_profile": tracker_profile}
SQL = {
    "page_relevance": f"""WITH {CONTENT}, t AS (SELECT *, {_type} AS kind, {_hits} AS hits FROM content),
m AS (SELECT id, CAST(CASE kind WHEN 'product' THEN {_fit['product']} WHEN 'article' THEN {_fit['article']} WHEN 'listing' THEN {_fit['listing']} ELSE {_fit['*']} END AS DOUBLE) AS intent_match,
  least(100.0::DOUBLE, 50.0::DOUBLE + hits / {len(WORDS)} * 30 + CASE WHEN hits > 0 AND {_in('title')} THEN 10 ELSE 0 END + CASE WHEN hits > 0 AND {_in('description')} THEN 5 ELSE 0 END
  + CASE WHEN contains(lower(coalesce(content, '')), 'free') THEN 5 ELSE 0 END + CASE WHEN jsonld->>'datePublished' IS NOT NULL THEN 5 ELSE 0 END) AS content_match FROM t)
SELECT id, round((intent_match + content_match) / 2, 6) AS relevance, intent_match, round(content_match, 6) AS content_match, (intent_match + content_match) / 2 >= 60 AS relevant FROM m""",
    "explain_relevance": f"""WITH {CONTENT}, o AS (SELECT id, round(CAST(len(list_intersect({_words}, q)) / len(list_distinct(list_concat({_words}, q))) AS DOUBLE), 6) AS overlap, CAST({_quality} AS DOUBLE) AS host
  FROM (SELECT *, ['how', 'to', 'find', 'a', '{QUERY}'] AS q FROM content WHERE title IS NOT NULL)) SELECT id, overlap, {_label('overlap')} AS overlap_label, host, {_label('host')} AS host_label FROM o""",
    "tracker_profile": PAGE_SQL["tracker_detect"].split(", n AS (SELECT h.job_id", 1)[0] + f""", n AS (SELECT h.job_id, count(t.t) AS n, count(*) FILTER (CAST(split_part(t.t, '/', 3) AS INT) >= 4) AS high, coalesce(string_agg(DISTINCT {_category}, ', ' ORDER BY {_category}), '') AS categories
  FROM h LEFT JOIN t USING (job_id) GROUP BY h.job_id) SELECT job_id, CAST(n AS INT) AS trackers, CAST(high AS INT) AS high_risk, categories, CASE WHEN n = 0 THEN 'clean' WHEN high > 0 THEN 'risky' WHEN n >= 5 THEN 'tracker_heavy' ELSE 'normal' END AS profile FROM n""",
}
