"""Ranking scores of search results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, days_between, occurrences, text_or_empty

# Weights of the combined ranking, and what an intent changes before they are scaled to a sum of 1.
WEIGHTS = {"relevance": 0.40, "recency": 0.15, "domain_trust": 0.15, "quality": 0.15, "engagement": 0.05, "tracker_safety": 0.10}
INTENT_WEIGHTS = {
    "question": {"relevance": 0.50, "domain_trust": 0.20, "recency": 0.10},
    "navigation": {"domain_trust": 0.35, "engagement": 0.15, "relevance": 0.30},
    "product_research": {"relevance": 0.40, "domain_trust": 0.25, "engagement": 0.10, "tracker_safety": 0.15},
    "research": {"quality": 0.25, "recency": 0.20, "domain_trust": 0.25, "relevance": 0.25},
}
# Trust by ending and by known host; parts of a host that speak against it.
ENDINGS = {".edu": 0.95, ".gov": 0.95, ".ac": 0.90}
KNOWN_HOSTS = {"github.com": 0.90, "stackoverflow.com": 0.90, "wikipedia.org": 0.95, "arxiv.org": 0.92, "scholar.google.com": 0.90}
BAD_HOSTS = r"(?i)spam|scam|adult|malware|bit.ly|tinyurl|short.link"
GOOD_HOSTS = r"(?i)(github|stackoverflow|wikipedia|arxiv|scholar)\.com|(edu|gov)"
SUSPICIOUS = ["bit.ly", "tinyurl", "short.link", "spam", "scam", "malware"]


def at(moment: str | datetime) -> Column:
    return F.lit(str(moment)).cast("timestamp")


def matches(query: str, *fields: Column) -> Column:
    """Whether any field holds the query, ignoring case; % and _ in the query are wildcards."""
    pattern = f"%{query}%"
    found = [F.coalesce(F.ilike(f, F.lit(pattern)), F.lit(False)) for f in fields]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def search_rank(query: str, title: Column, h1: Column, url: Column, description: Column, quality: Column, crawled: Column, as_of: Column) -> Column:
    """10, 8, 6 and 4 for a hit in title, h1, url and description, five times the quality, and up to 3 for freshness.

    An unknown quality gives no rank; an unknown crawl time no freshness.
    """
    q = query.lower().strip()
    hit = lambda c, n: F.when(matches(q, c), F.lit(float(n))).otherwise(F.lit(0.0))
    fresh = F.greatest(F.lit(0.0), 3 - 0.01 * days_between(crawled, as_of))
    return hit(title, 10) + hit(h1, 8) + hit(url, 6) + hit(description, 4) + quality * 5 + fresh


def simple_score(terms: list[str], title: Column, url: Column, h1: Column, body: Column, length: Column, days: Column) -> Column:
    """Additive score: phrase in the title 5; per term title 10, url 6, h1 8, each occurrence in the body 1; age and length."""
    t, u, h, b = (F.lower(text_or_empty(c)) for c in (title, url, h1, body))
    score = F.when(F.contains(t, F.lit(" ".join(terms))), 5.0).otherwise(0.0)
    for term in (x.lower() for x in terms):
        for c, n in ((t, 10.0), (u, 6.0), (h, 8.0)):
            score = score + F.when(F.contains(c, F.lit(term)), n).otherwise(0.0)
        score = score + occurrences(b, term)
    score = score - F.when(days > 0, F.least(days * 0.1, F.lit(10.0))).otherwise(0.0)
    score = score + F.when(length < 100, -5.0).when(length > 1000, 2.0).otherwise(0.0)
    return F.greatest(score, F.lit(0.0))


def weights(intent: str) -> dict[str, float]:
    chosen = WEIGHTS | INTENT_WEIGHTS.get(intent, {})
    total = sum(chosen.values())
    return {k: v / total for k, v in chosen.items()}


def recency(crawled: Column, as_of: Column) -> Column:
    days = days_between(crawled, as_of)
    return F.when(crawled.isNull(), 0.5).when(days <= 0, 1.0).when(days >= 365, 0.1).otherwise(F.greatest(F.lit(0.1), F.exp(-days / 180.0)))


def domain_trust(domain: Column, trust: Column) -> Column:
    out = F.when(F.coalesce(trust, F.lit(0.0)) != 0, trust).otherwise(F.lit(0.5))
    out = F.when(contains_any(F.lower(domain), SUSPICIOUS), 0.2).otherwise(out)
    for host, value in reversed(KNOWN_HOSTS.items()):
        out = F.when(F.contains(domain, F.lit(host)), value).otherwise(out)
    for ending, value in reversed(ENDINGS.items()):
        out = F.when(F.endswith(domain, F.lit(ending)), value).otherwise(out)
    return F.when(text_or_empty(domain) == "", 0.5).otherwise(out)


def content_depth(content: Column, h1: Column) -> Column:
    n = F.length(text_or_empty(content))
    size = F.when(n < 100, 0.3).when(n < 500, 0.6).when(n < 2000, 0.8).otherwise(0.95)
    return F.when(n == 0, 0.3).otherwise(size * 0.6 + F.when(F.length(text_or_empty(h1)) > 10, 0.8).otherwise(0.5) * 0.4)


def engagement(clicks: Column, pagerank: Column) -> Column:
    share = lambda c, most: F.coalesce(F.when(c.isNotNull() & ~F.isnan(c), F.least(c / most, F.lit(1.0))), F.lit(0.0))
    return share(clicks, 100.0) * 0.3 + share(pagerank, 10.0) * 0.7


def tracker_safety(risk: Column) -> Column:
    return F.when(F.coalesce(risk, F.lit(0.0)) != 0, 1.0 - risk).otherwise(0.5)


def harmony(intent: str, relevance: Column, crawled: Column, domain: Column, trust: Column, content: Column, h1: Column, clicks: Column, pagerank: Column, risk: Column, as_of: Column) -> Column:
    """struct(score, and the six weighted contributions)."""
    w = weights(intent)
    signals = {
        "relevance": relevance,
        "recency": recency(crawled, as_of),
        "domain_trust": domain_trust(domain, trust),
        "quality": content_depth(content, h1),
        "engagement": engagement(clicks, pagerank),
        "tracker_safety": tracker_safety(risk),
    }
    parts = {k: s * w[k] for k, s in signals.items()}
    total = sum(parts.values(), F.lit(0.0))
    return F.struct(total.alias("score"), *[p.alias(k) for k, p in parts.items()])


def final_score(base: Column, intent_match: Column, trust: Column, safety: Column) -> Column:
    """(base + 2 * intent match) * trust, less up to 30 % for trackers."""
    return (base + 2.0 * intent_match) * trust * (1 - 0.3 * (1 - safety))


def domain_quality(url: Column) -> Column:
    """0.3 for shorteners and spam, 0.9 for education, government and known hosts, else 0.7."""
    return F.when(F.rlike(url, F.lit(BAD_HOSTS)), 0.3).when(F.rlike(url, F.lit(GOOD_HOSTS)), 0.9).otherwise(0.7)
