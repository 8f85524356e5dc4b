"""Search over a content table: ranked, filtered, fuzzy, suggestions, images."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import domain_quality, matches, search_rank
from ..runtime import ship


def latest(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row per key in the given order."""
    keys = [key] if isinstance(key, str) else key
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def top(rows: DataFrame, *order: Column, limit: int = 10, offset: int = 0) -> DataFrame:
    ordered = rows.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def search(content: DataFrame, query: str, as_of: Column, limit: int = 10, offset: int = 0, domain: str | None = None, content_type: str | None = None, least_quality: float | None = None, rank: str = "text") -> DataFrame:
    """Hits of the query in title, h1, description or content, by rank ("text") or quality, with their place.

    content: id, url, domain, title, h1, description, content, content_type, quality_score, last_crawled_at. Unknown
    ranks come first, equal ones by id. Repeated rows of an id count once; the hits have no content column, so that no
    text is shuffled.
    """
    hits = content.where(matches(query, F.col("title"), F.col("h1"), F.col("description"), F.col("content")))
    if domain:
        hits = hits.where(F.ilike("domain", F.lit(f"%{domain}%")))
    if content_type:
        hits = hits.where(F.col("content_type") == content_type)
    if least_quality is not None:
        hits = hits.where(F.col("quality_score") >= least_quality)
    score = F.col("quality_score") if rank == "quality" else search_rank(query, *(F.col(c) for c in ("title", "h1", "url", "description", "quality_score", "last_crawled_at")), as_of)
    ranked = hits.withColumn("rank", score).drop("content").dropDuplicates(["id"])
    best = top(ranked, F.desc_nulls_first("rank"), F.asc("id"), limit=limit, offset=offset)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_first("rank"), F.asc("id")))  # over at most limit rows
    return best.withColumn("place", place + offset)


def response(hits: DataFrame) -> DataFrame:
    """What a result list shows: defaults for title, score and type, and a snippet."""
    return hits.select(
        "id",
        "url",
        "domain",
        F.coalesce(F.nullif("title", F.lit("")), F.lit("No title")).alias("title"),
        F.coalesce(F.nullif(F.col("quality_score"), F.lit(0.0)), F.lit(0.5)).alias("score"),
        F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("snippet"),
        F.coalesce("content_type", F.lit("unknown")).alias("content_type"),
        F.lit("search_content").alias("source"),
    )


def with_fallback(hits: DataFrame, other: DataFrame) -> DataFrame:
    """The hits, or all rows of the other frame where there are none."""
    some = hits.select(F.lit(1).alias("_some")).limit(1)
    return hits.unionByName(other.join(some, F.lit(True), "left_anti"))


def suggest(queries: DataFrame, titles: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """(suggestion, place): popular queries with the prefix first, then titles, each text once."""
    asked = queries.where(F.ilike("query", F.lit(f"{prefix}%"))).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    asked = top(asked, F.desc("n"), F.asc("query"), limit=limit).select(F.trim("query").alias("suggestion"), F.lit(0).alias("source"), (-F.col("n")).alias("order"), F.col("query").alias("text"))
    named = titles.where(F.startswith(F.lower("title"), F.lit(prefix.lower()))).select("title").distinct()
    named = top(named, F.asc("title"), limit=limit).select(F.trim("title").alias("suggestion"), F.lit(1).alias("source"), F.lit(0).cast("long").alias("order"), F.col("title").alias("text"))
    both = latest(asked.unionByName(named).where("suggestion <> ''"), "suggestion", F.col("source"), F.col("order"), F.col("text"))
    best = top(both, F.col("source"), F.col("order"), F.col("text"), limit=limit)
    place = F.row_number().over(Window.orderBy("source", "order", "text"))
    return best.select("suggestion", place.alias("place"))


def image_search(images: DataFrame, query: str) -> DataFrame:
    """Images whose alternative text holds all words of the query, one with - holds it off, OR parts alternatives.

    score is the number of occurrences of the wanted words of all alternatives that hold.
    """
    text = F.lower(F.coalesce("alt_text", F.lit("")))
    score, keep = F.lit(0), F.lit(False)
    for part in " ".join(query.split()).split(" OR "):
        holds, found = F.lit(True), F.lit(0)
        for word in part.lower().split():
            if word.startswith("-") and len(word) > 1:
                holds = holds & ~F.contains(text, F.lit(word[1:]))
            else:
                holds = holds & F.contains(text, F.lit(word))
                found = found + ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")
        keep, score = keep | holds, score + F.when(holds, found).otherwise(0)
    return images.where(keep).withColumn("score", score)


def fuzzy_match(query: str, text: str | None, threshold: float = 0.6) -> float:
    """1 for equal texts; share of the length for a part; overlap of the words; else the sequence ratio from threshold."""
    q, t = query.lower().strip(), (text or "").lower().strip()
    if q == t:
        return 1.0
    if q in t:
        return min(len(q) / len(t) * 1.2, 1.0)
    a, b = set(q.split()), set(t.split())
    if a & b:
        return len(a & b) / len(a | b)
    ratio = SequenceMatcher(None, q, t).ratio()
    return ratio if ratio >= threshold else 0.0


def _fuzzy_columns(query: str):
    def run(batches):
        for batch in batches:
            head = batch["content"].fillna("").str[:500]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "m_title": [fuzzy_match(query, x) for x in batch["title"]],
                    "m_content": [fuzzy_match(query, x, 0.4) for x in head],
                    "m_content_low": [fuzzy_match(query, x, 0.3) for x in head],
                    "m_url": [fuzzy_match(query, x) for x in batch["url"]],
                }
            )

    return run


def fuzzy_search(content: DataFrame, query: str, limit: int = 10, offset: int = 0, ambiguity_control: float = 0.5) -> DataFrame:
    """The best 3 * limit hits by quality, reranked by fuzzy matches: id, base, fuzzy, ambiguity, final.

    The matches are computed once per candidate in one Arrow pass; offset applies to the reranked list.
    """
    ship(content.sparkSession)
    hits = content.where(matches(query, F.col("title"), F.col("h1"), F.col("description"), F.col("content")))
    best = top(hits.select("id", "quality_score").dropDuplicates(["id"]), F.desc_nulls_last("quality_score"), F.asc("id"), limit=3 * (limit + offset))
    best = F.broadcast(best.select("id"))  # at most 3 * (limit + offset) ids
    candidates = hits.join(best, "id", "left_semi").select("id", "title", "content", "url", "quality_score").dropDuplicates(["id"])
    matched = candidates.mapInPandas(_fuzzy_columns(query), "id long, m_title double, m_content double, m_content_low double, m_url double")
    matched = matched.join(candidates.select("id", "quality_score"), "id")
    base = F.when(F.coalesce("quality_score", F.lit(0.0)) != 0, F.col("quality_score") * 10).otherwise(F.lit(5.0))
    mean = F.col("m_title") * 0.5 + F.col("m_content") * 0.3 + F.col("m_url") * 0.2
    spread = sum(((F.col(c) - mean) * (F.col(c) - mean) for c in ("m_title", "m_content", "m_url")), F.lit(0.0)) / 3
    scored = matched.select("id", base.alias("base"), F.greatest("m_title", "m_content_low").alias("fuzzy"), F.least(spread, F.lit(1.0)).alias("ambiguity"))
    whole = Window.partitionBy()  # over at most 3 * limit rows
    share = lambda c: F.when(F.max(c).over(whole) > 0, F.col(c) / F.max(c).over(whole)).otherwise(F.lit(0.0))
    final = share("base") * 0.4 + share("fuzzy") * 0.5 - F.col("ambiguity") * ambiguity_control * 0.1
    return top(scored.withColumn("final", final), F.desc("final"), F.asc("id"), limit=limit, offset=offset)


def explain_relevance(pages: DataFrame, query: str) -> DataFrame:
    """(id, title_match, content_match, url_match, domain_relevance) of pages (id, title, content, url) for the query.

    Of the content the first 500 characters are compared, as a snippet. Repeated rows count once.
    """
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "url": batch["url"],
                    "title_match": [fuzzy_match(query, x) for x in batch["title"]],
                    "content_match": [fuzzy_match(query, x, 0.3) for x in batch["content"].fillna("").str[:500]],
                    "url_match": [fuzzy_match(query, x) for x in batch["url"]],
                }
            )

    found = pages.select("id", "url", "title", "content").mapInPandas(run, "id long, url string, title_match double, content_match double, url_match double")
    return found.withColumn("domain_relevance", domain_quality(F.col("url"))).drop("url").dropDuplicates(["id"])
