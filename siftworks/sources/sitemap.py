"""Sitemaps: entries, child sitemaps, discovery."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread, staged

ENTRY = "source string, kind string, loc string, lastmod string, changefreq string, priority double"
# Places where sites keep their sitemaps.
COMMON = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemaps.xml", "/sitemap1.xml", "/sitemap/sitemap.xml", "/wp-sitemap.xml", "/sitemap.txt"]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def entries(sitemaps: DataFrame, source: str = "url", xml: str = "xml") -> DataFrame:
    """(source, kind, loc, lastmod, changefreq, priority): kind is url, or sitemap for a child; text that is no XML gives none."""

    def run(batches):
        for batch in batches:
            rows = []
            for where, text in zip(batch["source"], batch["xml"]):
                try:
                    root = ElementTree.fromstring(text.strip().encode("utf-8")) if text else None
                except ElementTree.ParseError:
                    root = None
                for node in root if root is not None else ():
                    kind = _local(node.tag)
                    if kind in ("url", "sitemap"):
                        value = {_local(x.tag): (x.text or "").strip() for x in node}
                        if value.get("loc"):
                            try:
                                priority = float(value["priority"]) if value.get("priority") else None
                            except ValueError:
                                priority = None
                            rows.append((where, kind, value["loc"], value.get("lastmod"), value.get("changefreq"), priority))
            yield pd.DataFrame(rows, columns=["source", "kind", "loc", "lastmod", "changefreq", "priority"])

    rows = sitemaps.where(F.col(xml).isNotNull()).select(F.col(source).alias("source"), F.col(xml).alias("xml"))
    return spread(rows).mapInPandas(run, ENTRY)


def locations(sitemaps: DataFrame, source: str = "url", xml: str = "xml") -> DataFrame:
    """(source, loc) by pattern, for sitemaps that are no well-formed XML."""
    found = F.explode(F.regexp_extract_all(xml, F.lit(r"<loc[^>]*>([^<]+)</loc>"), F.lit(1))).alias("loc")
    return sitemaps.select(F.col(source).alias("source"), found).withColumn("loc", F.trim("loc")).where(F.rlike("loc", F.lit("^https?://")))


def expanded(roots: DataFrame, fetched: DataFrame, rounds: int | None = None) -> DataFrame:
    """All url entries below the root sitemaps: child sitemaps are looked up in `fetched` (url, xml) until none is new.

    Every sitemap is looked up once; `rounds` limits the depth if given.
    """
    known = staged(entries(roots))
    out = known.where("kind = 'url'")
    seen = None
    while rounds is None or rounds > 0:
        children = known.where("kind = 'sitemap'").select(F.col("loc").alias("url")).distinct()
        children = staged(children if seen is None else children.join(seen, "url", "left_anti"))
        if children.isEmpty():
            break
        seen = children if seen is None else seen.union(children)
        known = staged(entries(fetched.join(children, "url")))
        out = out.unionByName(known.where("kind = 'url'"))
        rounds = None if rounds is None else rounds - 1
    return out.dropDuplicates(["loc"])


def discovered(sites: DataFrame) -> DataFrame:
    """(domain, sitemap): lines Sitemap: of robots.txt, and the common places. sites: domain, robots."""
    lines = F.regexp_extract_all(F.coalesce("robots", F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    common = F.transform(F.array(*[F.lit(p) for p in COMMON]), lambda p: F.concat(F.lit("https://"), F.col("domain"), p))
    return sites.select("domain", F.explode(F.array_distinct(F.concat(lines, common))).alias("sitemap"))
