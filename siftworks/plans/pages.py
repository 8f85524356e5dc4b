"""Queries over page text, urls and HTML."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import trackers as K
from ..operators import html as H
from ..operators import spam as S
from ..operators.search import top
from ..runtime import staged, table
from .tables import CONTENT, JOBS, SEARCHES, content, html_rows, jobs, quoted, searches, sql_domain, sql_path

c = F.col
TITLE = r"(?s)<title[^>]*>(.*?)</title>"
HEAD1 = r"(?s)<h1[^>]*>(.*?)</h1>"
HREF = r'<a href="([^"]*)"'


def tokenize_tf(spark, folder):
    """The most frequent terms of the search log."""
    words = searches(spark, folder).select(F.explode(T.tokens(F.lower("query"))).alias("term"))
    return top(words.groupBy("term").agg(F.count(F.lit(1)).alias("times")), F.desc("times"), F.asc("term"), limit=100)


def normalize_query(spark, folder):
    return searches(spark, folder).where("query is not null").groupBy(T.normalize_query(c("query")).alias("query")).agg(F.count(F.lit(1)).alias("times"))


def normalize_url(spark, folder):
    pages = table(spark, folder, "pages").dropDuplicates(["id"])
    return pages.select("id", T.normalize_url(c("url")).alias("url"), T.domain(c("url")).alias("domain"), T.path(c("url")).alias("path"))


def url_valid(spark, folder):
    pages = table(spark, folder, "pages").dropDuplicates(["id"])
    return pages.select("id", T.is_valid_url(c("url")).alias("page"), T.is_valid_url(c("og_image_url")).alias("image"))


def url_titles(spark, folder):
    p = content(spark, folder)
    named = F.coalesce(F.nullif("og_title", F.lit("")), F.nullif("title", F.lit("")), F.nullif("h1", F.lit("")), T.title_from_path(c("url")))
    return p.select("id", F.substring(named, 1, 200).alias("title"), T.title_from_path(c("url")).alias("from_path"))


def jaccard_match(spark, folder):
    """Overlap of the words of each query with those of a fixed one."""
    other = F.array(*[F.lit(w) for w in ("how", "to", "a", "compact", "museum")])
    words = F.array_distinct(F.split(T.normalize_query(c("query")), " "))
    return searches(spark, folder).where("query is not null").select("id", F.round(T.jaccard(words, other), 6).alias("overlap"))


def hashed_ids(spark, folder):
    s = searches(spark, folder).where("session_id is not null").select("session_id").distinct()
    name = c("session_id").cast("string")
    both = F.sha2(F.concat_ws("_", T.short_hash("ip_", name), T.short_hash("ua_", name)), 256)
    return s.select("session_id", T.short_hash("ip_", name).alias("ip_hash"), T.short_hash("ua_", name).alias("ua_hash"), both.alias("session_hash"), T.short_hash("search:", c("session_id").cast("string")).alias("cache_key"))


def _html(spark, folder):
    return jobs(spark, folder).where("content is not null")


def html_titles(spark, folder):
    take = lambda p: F.nullif(F.regexp_extract("content", p, 1), F.lit(""))
    return html_rows(spark, folder, lambda j: j.select("job_id", "digest", take(TITLE).alias("title"), take(HEAD1).alias("h1"), F.size(F.regexp_extract_all("content", F.lit(HREF), F.lit(1))).alias("links")))


def html_metadata(spark, folder):
    p = H.parsed(_html(spark, folder))
    return p.select(c("key").alias("job_id"), "title", "language", "description", F.size("h2").alias("h2"), F.size("links").alias("links"), F.size("images").alias("images"), F.length("text").alias("text_length"))


def html_links(spark, folder):
    l = H.links(H.parsed(_html(spark, folder)))
    return l.groupBy(c("key").alias("job_id")).agg(F.countDistinct("url").alias("urls"), F.count_if("internal").alias("internal"), F.count_if(~c("internal")).alias("external"))


def html_favicons(spark, folder):
    return H.favicon(H.parsed(_html(spark, folder))).select(c("key").alias("job_id"), "icon", "format")


def domain_links(spark, folder):
    """Distinct links of a page in order, the first 20, then those of its own host."""
    hrefs = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(HREF), F.lit(1)))), 1, 20).alias("hrefs")
    j = html_rows(spark, folder, lambda j: j.select("job_id", "digest", "domain", hrefs))
    kept = F.filter("hrefs", lambda h: F.startswith(h, F.lit("/")) | F.contains(h, c("domain")))
    return j.select("job_id", F.explode(kept).alias("href"))


def dup_ratio(spark, folder):
    text = F.when(F.coalesce("content", F.lit("")) != "", F.sha2(T.clean_text(F.lower("content")), 256)).alias("content")
    p = content(spark, folder, False).select("id", "domain", text).dropDuplicates(["id"])
    return S.duplicate_ratio(p, "domain", "content").select("domain", "pages", F.round("ratio", 6).alias("ratio"))


def cms_fingerprint(spark, folder):
    return S.system_counts(_html(spark, folder), "domain", "content")


def _farm(spark, folder):
    return S.link_farm(jobs(spark, folder).where("status = 'completed'"), "domain")


def link_farm(spark, folder):
    return _farm(spark, folder).select("domain", F.round("avg_links", 6).alias("avg_links"), F.round("max_density", 6).alias("max_density"), F.round("share_external", 6).alias("share_external"))


def spam_reports(spark, folder):
    done = staged(jobs(spark, folder).where("status = 'completed'").select("domain", "content", "internal_links_count", "external_links_count", "word_count"))
    facts = S.link_farm(done, "domain").join(S.system_counts(done, "domain", "content").select("domain", "mixed"), "domain").join(S.duplicate_ratio(done, "domain", "content").select("domain", "ratio"), "domain")
    back = reciprocal(spark, folder).select(F.regexp_replace("domain", r"^www\\.", "").alias("domain"), "links", "reciprocal").groupBy("domain").agg((F.sum("reciprocal") / F.sum("links")).alias("reciprocal_ratio"))
    facts = facts.join(back, "domain", "left")
    return S.spam_report(facts).select("domain", F.size("signals").alias("signals"), F.array_join("flags", ",").alias("flags"), F.round("spam_score", 6).alias("spam_score"), "risk_level", F.size("recommendations").alias("recommendations"))


def reciprocal(spark, folder):
    j = _html(spark, folder).select("url", F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1).alias("root"), F.explode(F.regexp_extract_all("content", F.lit(HREF), F.lit(1))).alias("href"))
    edges = j.select(c("url").alias("src"), F.when(F.startswith("href", F.lit("/")), F.concat("root", "href")).otherwise(c("href")).alias("dst"))
    return S.reciprocal_links(edges)


def tracker_detect(spark, folder):
    return html_rows(spark, folder, lambda j: j.select("job_id", "digest", K.tracker_report(c("content")).alias("r"))).select("job_id", c("r.count").alias("trackers"), F.round("r.safety", 6).alias("safety"), c("r.profile").alias("profile"))


def tracker_counts(spark, folder):
    return html_rows(spark, folder, lambda j: j.select("job_id", "digest", K.tracker_count(c("content")).alias("r"))).select("job_id", "r.count", "r.risk", "r.profile")


def tracker_distribution(spark, folder):
    p = content(spark, folder).where("tracker_risk_score is not null and not isnan(tracker_risk_score)")
    return p.groupBy(K.safety_label(1 - c("tracker_risk_score")).alias("label")).agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("tracker_risk_score"), 6).alias("risk"))


def _found(low: str, patterns: str) -> str:
    return f"regexp_matches({low}, {quoted('(?i)' + patterns)})"


_links = "(coalesce(internal_links_count, 0) + coalesce(external_links_count, 0))"
_clean = r"trim(regexp_replace(lower(content), '\s+', ' ', 'g'), ' ')"
_html_sql = f"WITH {JOBS}, h AS (SELECT * FROM jobs WHERE content IS NOT NULL)"
_systems = {n: " + ".join(f"CAST(contains(lower(content), {quoted(s.lower())}) AS INT)" for s in parts) for n, parts in S.SYSTEMS.items()}
FACTS = f"""WITH {JOBS}, d AS (SELECT * FROM jobs WHERE status = 'completed'),
f AS (SELECT domain, avg({_links}) AS avg_links, max(CASE WHEN word_count > 0 THEN {_links} / word_count END) AS max_density, avg(CAST(coalesce(external_links_count, 0) > coalesce(internal_links_count, 1) * 2 AS INT)) AS share_external FROM d GROUP BY domain)"""
EDGES = f"""x AS (SELECT url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root, unnest(regexp_extract_all(content, {quoted(HREF)}, 1)) AS href FROM jobs WHERE content IS NOT NULL),
e AS (SELECT DISTINCT url AS src, CASE WHEN starts_with(href, '/') THEN root || href ELSE href END AS dst FROM x), g AS (SELECT *, regexp_extract(lower(src), '^[a-z]+://([^/?#]+)', 1) AS s_host, regexp_extract(lower(dst), '^[a-z]+://([^/?#]+)', 1) AS d_host FROM e),
reciprocals AS (SELECT a.s_host AS domain, count(DISTINCT (a.src, a.dst)) AS links, count(b.src) AS reciprocal FROM g a LEFT JOIN g b ON b.s_host = a.d_host AND b.dst = a.src WHERE a.d_host <> a.s_host GROUP BY a.s_host)"""
_name_cases = " ".join(f"WHEN {_found('x', '|'.join(ps))} THEN {quoted(n + '/' + str(r))}" for n, (r, ps) in K.TRACKERS.items())
_elements = {
    "script": (r"""<script[^>]*src=["']?([^"'>\s]+)""", ""),
    "inline_script": (r"<script[^>]*>([^<]+)</script>", ""),
    "pixel": (r"""<img[^>]*src=["']?([^"'>\s]+)""", " WHERE regexp_matches(x, '(?i)pixel|beacon')"),
    "iframe": (r"""<iframe[^>]*src=["']?([^"'>\s]+)""", ""),
}
_inline_cases = " ".join(f"WHEN {_found('x', '|'.join(ps))} THEN {quoted(n + '/' + str(r))}" for n, (r, ps) in K.INLINE.items())
_cases = lambda k: _inline_cases if k == "inline_script" else _name_cases + (f" WHEN {_found('x', 'pixel')} THEN '{K.UNKNOWN_PIXEL[0]}/{K.UNKNOWN_PIXEL[1]}'" if k == "pixel" else "")
_sources = " UNION ALL ".join(
    f"SELECT DISTINCT job_id, '{k}/' || n AS t FROM (SELECT job_id, CASE {_cases(k)} END AS n FROM (SELECT job_id, x FROM (SELECT job_id, unnest(regexp_extract_all(content, {quoted('(?is)' + p)}, 1)) AS x FROM h){w})) WHERE n IS NOT NULL"
    for k, (p, w) in _elements.items()
)
_count = " + ".join(f"CAST({_found('content', p)} AS INT)" for p in K.COUNTED.values())
_norm_query = r"trim(regexp_replace(lower(query), '\s+', ' ', 'g'), ' ')"
_last = f"regexp_extract(regexp_replace({sql_path('url')}, '/+$', ''), '([^/]+)$', 1)"
_auth = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_from_path = f"coalesce(nullif(translate({_last}, '-_', '  '), ''), nullif({_auth}, ''), url)"
_media = "|".join(T.MEDIA)
_valid = lambda u: f"coalesce(regexp_matches({u}, '(?i)^https?://[^/?#]+') AND NOT regexp_matches(lower({sql_path(u)}), '\\.({_media})$'), false)"
_query = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"

QUERIES = {
    "tokenize_tf": tokenize_tf, "normalize_query": normalize_query, "normalize_url": normalize_url, "url_valid": url_valid, "url_titles": url_titles, "jaccard_match": jaccard_match, "hashed_ids": hashed_ids,
    "html_titles": html_titles, "html_metadata": html_metadata, "html_links": html_links, "html_favicons": html_favicons, "domain_links": domain_links, "dup_ratio": dup_ratio, "cms_fingerprint": cms_fingerprint,
    "link_farm": link_farm, "spam_report": spam_reports, "reciprocal_links": reciprocal, "tracker_detect": tracker_detect, "tracker_count": tracker_counts, "tracker_distribution": tracker_distribution,
}
SQL = {
    "tokenize_tf": f"""WITH {SEARCHES}, w AS (SELECT unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM searches)
SELECT term, count(*) AS times FROM w WHERE length(term) >= 2 AND term NOT IN ({', '.join(quoted(x) for x in T.STOPWORDS)}) GROUP BY term ORDER BY times DESC, term LIMIT 100""",
    "normalize_query": f"WITH {SEARCHES} SELECT {_norm_query} AS query, count(*) AS times FROM searches WHERE query IS NOT NULL GROUP BY 1",
    "normalize_url": f"""WITH p AS (SELECT DISTINCT id, url FROM pages), q AS (SELECT id, url, {sql_path('url')} AS path, list_filter(string_split({_query}, '&'), lambda x: x <> '') AS parts FROM p),
r AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(parts, lambda x, i: {{'k': split_part(x, '=', 1), 'i': i, 'p': x}})), lambda x: CASE WHEN contains(x.p, '=') THEN x.p ELSE x.p || '=' END), '&') AS joined FROM q)
SELECT id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower({_auth}) || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END || CASE WHEN joined <> '' THEN '?' || joined ELSE '' END AS url, {sql_domain('url')} AS domain, path FROM r""",
    "url_valid": f"SELECT id, {_valid('url')} AS page, {_valid('og_image_url')} AS image FROM (SELECT DISTINCT * FROM pages)",
    "url_titles": f"WITH {CONTENT} SELECT id, substring(coalesce(nullif(og_title, ''), nullif(title, ''), nullif(h1, ''), {_from_path}), 1, 200) AS title, {_from_path} AS from_path FROM content",
    "jaccard_match": f"""WITH {SEARCHES}, w AS (SELECT id, list_distinct(string_split({_norm_query}, ' ')) AS a, ['how', 'to', 'a', 'compact', 'museum'] AS b FROM searches WHERE query IS NOT NULL)
SELECT id, round(CAST(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS overlap FROM w""",
    "hashed_ids": f"WITH {SEARCHES} SELECT DISTINCT session_id, substring(sha256('ip_' || session_id), 1, 16) AS ip_hash, substring(sha256('ua_' || session_id), 1, 16) AS ua_hash, sha256(substring(sha256('ip_' || session_id), 1, 16) || '_' || substring(sha256('ua_' || session_id), 1, 16)) AS session_hash, substring(sha256('search:' || session_id), 1, 16) AS cache_key FROM searches WHERE session_id IS NOT NULL",
    "html_titles": f"{_html_sql} SELECT job_id, nullif(regexp_extract(content, {quoted(TITLE)}, 1), '') AS title, nullif(regexp_extract(content, {quoted(HEAD1)}, 1), '') AS h1, CAST(len(regexp_extract_all(content, {quoted(HREF)}, 1)) AS INT) AS links FROM h",
    "domain_links": f"""{_html_sql}, l AS (SELECT job_id, domain, unnest(list_sort(list_distinct(regexp_extract_all(content, {quoted(HREF)}, 1)))[1:20]) AS href FROM h) SELECT job_id, href FROM l WHERE starts_with(href, '/') OR contains(href, domain)""",
    "dup_ratio": f"""WITH {CONTENT}, k AS (SELECT domain, CASE WHEN coalesce(content, '') <> '' THEN {_clean} END AS k, count(*) AS n FROM content GROUP BY ALL)
SELECT domain, CAST(sum(n) AS BIGINT) AS pages, round(CAST(sum(CASE WHEN k IS NOT NULL THEN n - 1 ELSE 0 END) / sum(n) AS DOUBLE), 6) AS ratio FROM k GROUP BY domain""",
    "cms_fingerprint": f"""{_html_sql}, n AS (SELECT domain, {', '.join(f'CAST(sum({e}) AS BIGINT) AS {n}' for n, e in _systems.items())} FROM h GROUP BY domain)
SELECT *, CASE WHEN greatest(wordpress, drupal, joomla, wix) = 0 THEN NULL {' '.join(f"WHEN {n} = greatest(wordpress, drupal, joomla, wix) THEN '{n}'" for n in S.SYSTEMS)} END AS system,
  {' + '.join(f'CAST({n} > 0 AS INT)' for n in S.SYSTEMS)} >= 2 AS mixed FROM n""",
    "link_farm": FACTS + " SELECT domain, round(avg_links, 6) AS avg_links, round(CAST(max_density AS DOUBLE), 6) AS max_density, round(share_external, 6) AS share_external FROM f",
    "spam_report": FACTS + f""", {EDGES}, s AS (SELECT domain, {' + '.join(f'CAST(coalesce(sum({e}), 0) > 0 AS INT)' for e in _systems.values())} >= 2 AS mixed FROM d GROUP BY domain),
u AS (SELECT domain, sum(CASE WHEN k IS NOT NULL THEN n - 1 ELSE 0 END) / sum(n) AS ratio FROM (SELECT domain, CASE WHEN coalesce(content, '') <> '' THEN {_clean} END AS k, count(*) AS n FROM d GROUP BY ALL) GROUP BY domain),
y AS (SELECT regexp_replace(domain, '^www\\.', '') AS domain, sum(reciprocal) / sum(links) AS back FROM reciprocals GROUP BY 1),
p AS (SELECT domain, mixed, ratio, back, CAST(coalesce(avg_links > 200, false) AS INT) * 4 + CAST(coalesce(max_density > 0.4, false) AS INT) * 3 + CAST(coalesce(share_external > 0.5, false) AS INT) * 3 AS tenths FROM f JOIN s USING (domain) JOIN u USING (domain) LEFT JOIN y USING (domain)),
v AS (SELECT domain, list_filter([CASE WHEN tenths >= 5 THEN 'link_farm' END, CASE WHEN mixed THEN 'cms_anomaly' END, CASE WHEN ratio >= 0.2 THEN 'content_duplication' END, CASE WHEN back >= 0.6 THEN 'reciprocal_linking' END], lambda x: x IS NOT NULL) AS names,
  CASE WHEN tenths >= 5 THEN least(1.0, tenths / 10.0::DOUBLE) * CASE WHEN tenths >= 7 THEN 80 ELSE 50 END ELSE 0 END + CASE WHEN mixed THEN 35 ELSE 0 END
  + CASE WHEN ratio >= 0.2 THEN ratio * CASE WHEN ratio >= 0.5 THEN 80 ELSE 50 END ELSE 0 END + CASE WHEN back >= 0.6 THEN least(1.0, back) * CASE WHEN back >= 0.8 THEN 80 ELSE 50 END ELSE 0 END AS total FROM p),
w AS (SELECT domain, names, CASE WHEN len(names) > 0 THEN least(100.0, total / len(names)) ELSE 0 END AS score FROM v)
SELECT domain, CAST(len(names) AS INT) AS signals, array_to_string(names, ',') AS flags, round(CAST(score AS DOUBLE), 6) AS spam_score, CASE WHEN score >= 75 THEN 'spam' WHEN score >= 45 THEN 'suspicious' ELSE 'clean' END AS risk_level, CAST(len(names) + 1 AS INT) AS recommendations FROM w""",
    "reciprocal_links": f"""{_html_sql}, {EDGES} SELECT * FROM reciprocals""",
    "tracker_detect": f"""{_html_sql}, t AS ({_sources}), n AS (SELECT h.job_id, count(t.t) AS n, avg(CAST(split_part(t.t, '/', 3) AS INT)) AS a FROM h LEFT JOIN t USING (job_id) GROUP BY h.job_id)
SELECT job_id, CAST(n AS INT) AS trackers, round(greatest(0.1, least(1.0, 1.0 - coalesce(a, 1.0) / 5 - n * 0.05)), 6) AS safety, CASE WHEN n = 0 THEN 'clean' WHEN a >= 4.5 THEN 'severe_tracking_risk' WHEN a >= 3.5 THEN 'heavy_trackers' WHEN a >= 2.5 THEN 'moderate_trackers' WHEN a >= 1.5 THEN 'minimal_trackers' ELSE 'clean' END AS profile FROM n""",
    "tracker_count": f"""{_html_sql}, n AS (SELECT job_id, {_count} AS n FROM h) SELECT job_id, n AS count, CAST(CASE WHEN n = 0 THEN 0 WHEN n <= 2 THEN 0.3 WHEN n <= 4 THEN 0.6 WHEN n <= 6 THEN 0.8 ELSE 1 END AS DOUBLE) AS risk,
  CASE WHEN n = 0 THEN 'clean' WHEN n <= 2 THEN 'minimal' WHEN n <= 4 THEN 'moderate' WHEN n <= 6 THEN 'heavy' ELSE 'severe' END AS profile FROM n""",
    "tracker_distribution": f"""WITH {CONTENT}, s AS (SELECT 1 - tracker_risk_score AS s, tracker_risk_score AS r FROM content WHERE tracker_risk_score IS NOT NULL AND NOT isnan(tracker_risk_score))
SELECT CASE WHEN s >= 0.9 THEN 'clean' WHEN s >= 0.7 THEN 'minimal' WHEN s >= 0.5 THEN 'moderate' WHEN s >= 0.3 THEN 'heavy' ELSE 'severe' END AS label, count(*) AS pages, round(avg(r), 6) AS risk FROM s GROUP BY 1""",
}
