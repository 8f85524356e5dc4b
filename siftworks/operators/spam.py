"""Signals of spam per domain: copies, mixed systems, link farms, reciprocal links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, contains_any

# Signatures of content systems; weights of a signal by its severity.
SYSTEMS = {
    "wordpress": ["/wp-content/", "/wp-admin/", "wp-json", '<meta name="generator" content="WordPress"'],
    "drupal": ["/sites/default/", "drupal.settings", '<meta name="Generator" content="Drupal"'],
    "joomla": ["/components/", "/modules/", '<meta name="generator" content="Joomla"'],
    "wix": ["wixClient.js", "wixApi.js"],
}
# What a signal and a score recommend.
ADVICE = {
    "link_farm": "⚠️  Domain appears to be link farm - deprioritize in crawl queue",
    "content_duplication": "📋 Significant content duplication - consider deduplication in indexing",
    "reciprocal_linking": "🔗 Excessive reciprocal linking - likely part of link exchange scheme",
    "cms_anomaly": "⚠️  Mixed CMS signatures - domain may be compromised",
}
VERDICTS = [(75, "🚫 RECOMMENDATION: Add to spam/PBN watchlist"), (45, "⚠️  RECOMMENDATION: Monitor this domain closely"), (None, "✅ Domain appears legitimate")]
SEVERITY = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2}


def duplicate_ratio(pages: DataFrame, domain: str, content: str) -> DataFrame:
    """(domain, pages, ratio): pages beyond the first of equal normalised content, as a share of all pages."""
    key = F.sha2(clean_text(F.lower(F.col(content))), 256)
    n = pages.groupBy(domain, F.when(F.coalesce(content, F.lit("")) != "", key).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    copies = F.sum(F.when(F.col("_k").isNotNull(), F.col("n") - 1).otherwise(0))
    return n.groupBy(domain).agg(F.sum("n").alias("pages"), (copies / F.sum("n")).alias("ratio"))


def system_counts(pages: DataFrame, domain: str, content: str) -> DataFrame:
    """(domain, one count per system, system): hits of signatures, the system with most, whether several were found."""
    hits = {name: sum((F.contains(F.lower(F.col(content)), F.lit(s.lower())).cast("int") for s in parts), F.lit(0)) for name, parts in SYSTEMS.items()}
    n = pages.groupBy(domain).agg(*[F.sum(h).alias(name) for name, h in hits.items()])
    values = F.array(*[F.coalesce(F.col(x), F.lit(0)) for x in SYSTEMS])
    best = F.element_at(F.array(*[F.lit(x) for x in SYSTEMS]), F.array_position(values, F.array_max(values)).cast("int"))
    several = F.size(F.filter(values, lambda v: v > 0))
    return n.withColumns({"system": F.when(F.array_max(values) > 0, best), "mixed": several >= 2})


def link_farm(pages: DataFrame, domain: str) -> DataFrame:
    """(domain, avg_links, max_density, share_external): from internal_links_count, external_links_count, word_count."""
    inner, outer = F.coalesce("internal_links_count", F.lit(0)), F.coalesce("external_links_count", F.lit(0))
    against = F.coalesce("internal_links_count", F.lit(1))  # one where it is not known
    density = F.when(F.col("word_count") > 0, (inner + outer) / F.col("word_count"))
    return pages.groupBy(domain).agg(
        F.avg(inner + outer).alias("avg_links"), F.max(density).alias("max_density"), F.avg((outer > against * 2).cast("double")).alias("share_external")
    )


def reciprocal_links(links: DataFrame) -> DataFrame:
    """(domain, links, reciprocal): edges src -> dst to other hosts, and those whose target host links back to the very source.

    An equi-join on the target's host and the source, counted once per answering page.
    """
    host = lambda c: F.regexp_extract(F.lower(F.col(c)), r"^[a-z]+://([^/?#]+)", 1)
    e = links.select("src", "dst", host("src").alias("s_host"), host("dst").alias("d_host")).distinct()
    back = e.groupBy(F.col("s_host").alias("d_host"), F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("back"))
    return e.where("d_host <> s_host").join(back, ["d_host", "src"], "left").groupBy(F.col("s_host").alias("domain")).agg(F.count(F.lit(1)).alias("links"), F.coalesce(F.sum("back"), F.lit(0)).alias("reciprocal"))


def spam_report(facts: DataFrame) -> DataFrame:
    """Signals, score and risk per domain.

    facts: domain, avg_links, max_density, share_external, mixed, ratio, and reciprocal_ratio where known. Score: mean over the signals
    of confidence times weight, in percent. flags are the names of the signals, recommendations what they and the score
    advise.
    """
    if "reciprocal_ratio" not in facts.columns:
        facts = facts.withColumn("reciprocal_ratio", F.lit(None).cast("double"))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    tenths = yes(F.col("avg_links") > 200) * 4 + yes(F.col("max_density") > 0.4) * 3 + yes(F.col("share_external") > 0.5) * 3

    def signal(condition: Column, name: str, confidence: Column, severity: Column) -> Column:
        weight = F.lit(0.5)
        for level, w in SEVERITY.items():
            weight = F.when(severity == level, F.lit(w)).otherwise(weight)
        return F.when(condition, F.struct(F.lit(name).alias("name"), confidence.alias("confidence"), weight.alias("weight")))

    signals = F.array_compact(
        F.array(
            signal(tenths >= 5, "link_farm", F.least(F.lit(1.0), tenths / 10), F.when(tenths >= 7, F.lit("high")).otherwise(F.lit("medium"))),
            signal(F.col("mixed"), "cms_anomaly", F.lit(0.7), F.lit("medium")),
            signal(F.col("ratio") >= 0.2, "content_duplication", F.col("ratio"), F.when(F.col("ratio") >= 0.5, F.lit("high")).otherwise(F.lit("medium"))),
            signal(F.col("reciprocal_ratio") >= 0.6, "reciprocal_linking", F.least(F.lit(1.0), F.col("reciprocal_ratio")), F.when(F.col("reciprocal_ratio") >= 0.8, F.lit("high")).otherwise(F.lit("medium"))),
        )
    )
    n = F.size("signals")
    score = F.when(n > 0, F.least(F.lit(100.0), F.aggregate("signals", F.lit(0.0), lambda a, s: a + s["confidence"] * s["weight"] * 100) / n)).otherwise(F.lit(0.0))
    risk = F.when(F.col("spam_score") >= 75, F.lit("spam")).when(F.col("spam_score") >= 45, F.lit("suspicious")).otherwise(F.lit("clean"))
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    flags = F.transform("signals", lambda s: s["name"])
    verdict = F.when(F.col("spam_score") >= VERDICTS[0][0], F.lit(VERDICTS[0][1])).when(F.col("spam_score") >= VERDICTS[1][0], F.lit(VERDICTS[1][1])).otherwise(F.lit(VERDICTS[2][1]))
    scored = facts.withColumn("signals", signals).withColumn("spam_score", score).withColumn("risk_level", risk)
    return scored.withColumn("flags", flags).withColumn("recommendations", F.concat(F.transform("flags", lambda f: advice[f]), F.array(verdict)))


def has_system(content: Column, name: str) -> Column:
    return contains_any(content, SYSTEMS[name])
