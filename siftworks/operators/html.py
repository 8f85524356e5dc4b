"""Metadata, headings, links and images of HTML pages, parsed once per page in Arrow batches."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import domain, normalize_url
from ..runtime import spread

LINK = "struct<url: string, text: string, title: string, rel: string, internal: boolean>"
IMAGE = "struct<src: string, alt: string, title: string, width: int, height: int, responsive: boolean, position: int>"
ICON = "struct<url: string, format: string, sizes: string>"
PARSED = (
    "title string, description string, canonical string, language string, published string, modified string, author string, robots struct<index: boolean, follow: boolean, archive: boolean, snippet: boolean>, "
    "og map<string, string>, twitter map<string, string>, jsonld array<string>, keywords array<string>, h1 array<string>, h2 array<string>, h3 array<string>, "
    f"text string, links array<{LINK}>, images array<{IMAGE}>, icons array<{ICON}>"
)
FIELDS = ["title", "description", "canonical", "language", "published", "modified", "author", "robots", "og", "twitter", "jsonld", "keywords", "h1", "h2", "h3", "text", "links", "images", "icons"]
# Elements whose text is no body text, and the order in which formats of icons are preferred.
NO_TEXT = {"script", "style", "nav", "footer", "header", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ICON_ORDER = {"png": 1, "svg": 2, "ico": 3, "jpg": 4}


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.base, self.host = url, urlsplit(url).netloc
        self.meta: list[tuple[str, str, str]] = []
        self.title = self.canonical = self.language = None
        self.jsonld, self.links, self.images, self.icons = [], [], [], []
        self.headings = {"h1": [], "h2": [], "h3": []}
        self.words: list[str] = []
        self.open: list[tuple[str, list[str], dict]] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.language = a.get("lang") or None
        elif tag == "meta":
            self.meta.append((a.get("property", "").lower(), (a.get("name") or a.get("http-equiv", "")).lower(), a.get("content", "")))
        elif tag == "link":
            rel = a.get("rel", "").lower()
            if "canonical" in rel.split():
                self.canonical = self.canonical or a.get("href")
            if any(x in rel for x in ("icon", "apple-touch")) and a.get("href"):
                end = a["href"].lower().split("?")[0].rpartition(".")[2]
                self.icons.append({"url": self._absolute(a["href"]), "format": end if end in ICON_ORDER else "other", "sizes": a.get("sizes") or None})
        elif tag == "img":
            src = (a.get("src") or a.get("data-src", "")).strip()
            if src and not src.startswith("data:"):
                try:
                    width, height = (int(a[x]) if a.get(x) else None for x in ("width", "height"))
                except ValueError:
                    width = height = None
                wide = "srcset" in a or "sizes" in a or "responsive" in a.get("class", "")
                self.images.append({"src": self._absolute(src), "alt": a.get("alt", "").strip(), "title": a.get("title", "").strip(), "width": width, "height": height, "responsive": wide, "position": len(self.images)})
        if tag in VOID:
            return
        if tag in NO_TEXT:
            self.silent += 1
        if tag in ("title", "a", "script", "h1", "h2", "h3") or tag in NO_TEXT:
            self.open.append((tag, [], a))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        text = data.strip()
        for _, parts, _ in self.open:
            if text:
                parts.append(text)
        if text and not self.silent and not any(t == "title" for t, _, _ in self.open):
            self.words.append(text)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        _, parts, a = self.open.pop(at)
        if tag in NO_TEXT:
            self.silent = max(0, self.silent - 1)
        text = " ".join(parts)
        if tag == "title":
            self.title = self.title if self.title is not None else text
        elif tag in self.headings:
            if text:
                self.headings[tag].append(text)
        elif tag == "script" and a.get("type", "").lower() == "application/ld+json":
            try:
                found = json.loads("".join(parts))
                self.jsonld += [json.dumps(x, ensure_ascii=False) for x in (found if isinstance(found, list) else [found])]
            except ValueError:
                pass
        elif tag == "a" and "href" in a:
            href = a["href"].strip()
            if href and not href.startswith("#") and not href.lower().startswith(("javascript:", "mailto:")):
                url = self._absolute(href)
                self.links.append({"url": url, "text": text[:100], "title": a.get("title") or None, "rel": a.get("rel") or None, "internal": urlsplit(url).netloc == self.host})

    def _absolute(self, href: str) -> str:
        try:
            return urljoin(self.base, href)
        except ValueError:
            return href


def parse(html: str | None, url: str | None) -> dict:
    """All fields of a page; unfinished markup is read as far as it goes."""
    page = _Page(url or "")
    try:
        page.feed(html or "")
        page.close()
    except (ValueError, AssertionError):  # markup the parser gives up on: what it found so far stays
        pass
    og, twitter, named = {}, {}, {}
    tags = []
    for prop, name, content in page.meta:
        if prop.startswith("og:"):
            og[prop] = content
        if name.startswith("twitter:"):
            twitter[name] = content
        if prop == "article:tag":
            tags.append(content.strip())
        for key in (prop, name):
            if key and key not in named:
                named[key] = content
    items = [json.loads(x) for x in page.jsonld]
    from_items = lambda key: next((x[key] for x in items if isinstance(x, dict) and x.get(key)), None)
    author = from_items("author")
    author = author.get("name") if isinstance(author, dict) else author
    flags = (named.get("robots") or "").lower()
    keywords = [x.strip() for x in (named.get("keywords") or "").split(",")] + tags
    as_text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    return {
        "title": og.get("og:title") or page.title,
        "description": og.get("og:description") or named.get("description"),
        "canonical": page.canonical,
        "language": page.language or named.get("content-language"),
        "published": as_text(named.get("og:published_time") or named.get("article:published_time") or from_items("datePublished")),
        "modified": as_text(named.get("og:modified_time") or from_items("dateModified")),
        "author": as_text(named.get("article:author") or named.get("author") or author),
        "robots": {k: f"no{k}" not in flags for k in ("index", "follow", "archive", "snippet")},
        "og": og,
        "twitter": twitter,
        "jsonld": page.jsonld,
        "keywords": sorted({x for x in keywords if x}),
        **page.headings,
        "text": " ".join(page.words),
        "links": page.links,
        "images": page.images,
        "icons": sorted(page.icons, key=lambda x: ICON_ORDER.get(x["format"], 9)),
    }


def parsed(pages: DataFrame, key: str = "job_id", url: str = "url", html: str = "content") -> DataFrame:
    """(key, url, fields...) of every page with HTML. One parse per page serves all metadata, link and image queries."""

    def run(batches):
        for batch in batches:
            rows = [parse(h, u) for h, u in zip(batch["html"], batch["url"])]
            out = pd.DataFrame(rows, columns=FIELDS)
            out.insert(0, "url", batch["url"].to_numpy())
            out.insert(0, "key", batch["key"].to_numpy())
            yield out

    rows = pages.where(F.col(html).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    return spread(rows).mapInPandas(run, f"key string, url string, {PARSED}")


def links(pages: DataFrame) -> DataFrame:
    return pages.select("key", F.explode("links").alias("l")).select("key", "l.*")


def images(pages: DataFrame) -> DataFrame:
    return pages.select("key", F.explode("images").alias("i")).select("key", "i.*")


def favicon(pages: DataFrame) -> DataFrame:
    """(key, url, format): the preferred icon, or /favicon.ico of the host."""
    root = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    first = F.try_element_at("icons", F.lit(1))
    return pages.select("key", F.coalesce(first["url"], F.concat(root, F.lit("/favicon.ico"))).alias("icon"), F.coalesce(first["format"], F.lit("ico")).alias("format"))


def crawl_record(pages: DataFrame) -> DataFrame:
    """(key, h1, text, images, links) as the crawler keeps them: all h1 joined or else the title, alternative texts of 255
    characters, links in normal form with whether they stay on the page's host."""
    host = domain(F.col("url"))
    return pages.select(
        "key",
        F.coalesce(F.nullif(F.array_join("h1", " "), F.lit("")), F.col("title")).alias("h1"),
        "text",
        F.transform("images", lambda i: F.struct(i["src"].alias("src"), F.substring(i["alt"], 1, 255).alias("alt"))).alias("images"),
        F.transform("links", lambda x: F.struct(normalize_url(x["url"]).alias("url"), (domain(x["url"]) == host).alias("same_domain"))).alias("links"),
    )


def own_links(pages: DataFrame) -> DataFrame:
    """(key, url): the links of a page to its own host, without fragment, each once."""
    own = links(pages).where("internal").select("key", F.regexp_replace("url", "#.*$", "").alias("url"))
    return own.distinct()
