"""Content types by url, by page text and schema, and the quality gate of the index."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, contains_any, text_or_empty

# Parts of a url per content type, the first that matches wins; then the default.
URL_TYPES = {
    "video": ["youtube.com", "youtu.be", "vimeo.com", "dailymotion.com", "netflix.com", "hulu.com", "twitch.tv", "niconico.jp", "/video", "/videos", "/stream", ".mp4", ".webm", ".mov"],
    "manga": ["manga", "manganelo", "mangakakalot", "webtoon", "comic", "doujin", "pixiv", "booth", "dlsite", "/ch/", "/episode"],
    "image": [".jpg", ".png", ".gif", ".webp", "/image", "/images", "/photo", "/gallery", "imgur", "flickr", "500px"],
    "pdf": [".pdf", "/pdf"],
    "code_repository": ["/github", "/gitlab", "/bitbucket"],
    "social_media": ["/twitter", "/facebook", "/instagram", "/tiktok", "twitter.com", "facebook.com", "instagram.com", "tiktok.com", "x.com"],
    "official_site": ["www.", "/official", "/about", "/company", "/products", "/service", "/contact"],
}
# Per type the least score, the length asked for, and the weights of length, title, metadata, url, analysis
# and page value.
GATE = {
    "blog": (0.50, 100, (0.25, 0.20, 0.20, 0.15, 0.12, 0.08)),
    "video": (0.45, 30, (0.15, 0.25, 0.25, 0.15, 0.12, 0.08)),
    "manga": (0.48, 50, (0.10, 0.25, 0.30, 0.15, 0.12, 0.08)),
    "image": (0.40, 20, (0.08, 0.20, 0.35, 0.15, 0.12, 0.10)),
    "pdf": (0.52, 100, (0.25, 0.20, 0.20, 0.15, 0.12, 0.08)),
    "official_site": (0.55, 80, (0.20, 0.15, 0.25, 0.20, 0.12, 0.08)),
    "code_repository": (0.60, 120, (0.30, 0.15, 0.20, 0.15, 0.12, 0.08)),
    "social_media": (0.35, 10, (0.20, 0.15, 0.15, 0.20, 0.20, 0.10)),
}
# Parts of a url that speak for spam, and hosts that speak for quality.
SPAM_PARTS = ["/download", "/redirect", "/click", "/ads", "/ad/", "/banner", "utm_", "tracking", "referrer=", "onclick", "onclick="]
GOOD_HOSTS = ["github.com", "medium.com", "dev.to", "stackoverflow.com", "wikipedia.org", "arxiv.org", "nature.com", "science.org"]
# Patterns in url and text, and schema types, per content type.
PATTERNS = {
    "text_article": ([r"/blog/", r"/article/", r"/post/", r"/news/", r"/story/", r"/press/", r"/publication/"], [r"<article", r"<main", r"<h1>.*?</h1>.*?<p>", r"byline|author|published|article"], ["Article", "NewsArticle", "BlogPosting"]),
    "video": ([r"/video/", r"/watch", r"youtube.com/watch", r"vimeo.com", r"/video-", r"/v/"], [r"<iframe.*?src=.*?(youtube|vimeo)", r"<video", r"videojs", r"player"], ["VideoObject"]),
    "image": ([r"/gallery/", r"/images/", r"/photos/", r"/picture", r"imgur.com", r"flick.com"], [r"<img[^>]+src=.*?\.(jpg|png|gif|webp)", r"lightbox|photoswipe|gallery"], ["ImageObject"]),
    "forum": ([r"/forum/", r"/thread/", r"/discussion/", r"/topic/", r"reddit.com", r"stackoverflow.com", r"github.com/issues"], [r"comment|reply|post.*?user", r"upvote|downvote|vote", r"<ul.*?class.*?comment"], ["DiscussionForumPosting"]),
    "tool": ([r"/app/", r"/tool", r"/calculator", r"/generator", r"/converter", r"/api", r"/service"], [r"<input[^>]+type.*?(text|number|file)", r"<button[^>]+id=.*?submit|execute|generate", r"api.example"], ["SoftwareApplication"]),
    "product": ([r"/product/", r"/shop/", r"/store/", r"/item/", r"/listing/", r"amazon.com/", r"ebay.com"], [r"price|\$[0-9]+|¥", r"add.*?cart|buy.*?now", r"rating|star|review"], ["Product", "Offer"]),
    "documentation": ([r"/docs/", r"/documentation/", r"/manual/", r"/guide/", r"/tutorial/", r"/readme"], [r"<code", r"```", r"<pre>", r"example", r"installation|setup|configuration"], ["TechArticle"]),
    "manga": ([r"/manga/", r"/comic/", r"/chapter/", r"mangadex|mangaplus|manganelo"], [r"<img[^>]+class=.*?manga|chapter", r"page.*?\d+", r"next.*?chapter"], ["Manga", "Comic"]),
    "academic": ([r"/paper/", r"/research/", r"/study/", r"arxiv.org", r"scholar.google", r"researchgate"], [r"abstract|introduction|conclusion", r"doi:|citation|reference"], ["ScholarlyArticle"]),
}
# Page types by url parts, schema parts and text parts, tried in this order.
PAGE_URLS = {"product": ["product", "/p/", "shop", "store"], "category": ["category", "tag", "archive"], "documentation": ["docs", "documentation", "api", "guide", "reference"], "forum": ["forum", "discussion", "thread", "comment"], "article": ["news", "article", "blog", "post"]}
PAGE_SCHEMAS = {"product": ["product"], "article": ["article", "news"], "video": ["video"]}
PAGE_TEXTS = {"product": ["add to cart", "buy", "price:", "$", "purchase"], "article": ["published", "author:", "updated"], "video": ["watch", "video", "youtube"]}
QUALITY_LABELS = [(0.8, "excellent"), (0.6, "good"), (0.4, "acceptable")]


def _first(cases: list[tuple[Column, str]], default: Column) -> Column:
    out = default
    for condition, name in reversed(cases):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def url_type(url: Column) -> Column:
    u = F.lower(url)
    return _first([(contains_any(u, parts), name) for name, parts in URL_TYPES.items()], F.lit("blog"))


def page_type(url: Column, schema: Column, text: Column, is_root: Column) -> Column:
    """Type of a page by its url, else its schema types (a string), else its text, else landing_page or unknown."""
    u, s, t = F.lower(url), F.lower(text_or_empty(schema)), F.lower(text_or_empty(text))
    cases = [(contains_any(u, p), n) for n, p in PAGE_URLS.items()]
    cases += [(contains_any(s, p), n) for n, p in PAGE_SCHEMAS.items()]
    cases += [(contains_any(t, p), n) for n, p in PAGE_TEXTS.items()]
    return _first([*cases, (is_root, "landing_page")], F.lit("unknown"))


def _found(low: Column, pattern: str) -> Column:
    """Whether a pattern is found in a text in lower case. Plain alternatives are searched as such; the others only
    where the plain text they begin with occurs."""
    out = F.lit(False)
    for part in re.split(r"\|(?![^(]*\))", pattern):
        plain = re.match(r"[\w<>/` :-]*", part)[0]
        if plain == part:
            one = F.contains(low, F.lit(part))
        else:
            # a quantifier after the plain text would make its last character optional
            start = plain[:-1] if part[len(plain)] in "*?{" else plain
            one = F.rlike(low, F.lit(part))
            one = F.contains(low, F.lit(start)) & one if start else one
        out = out | one
    return out


def classify(url: Column, text: Column, schema_types: Column) -> Column:
    """struct(type, confidence): 30 points for url patterns, 40 for text patterns, 30 for schema types."""
    scores = {}
    low, low_url = F.lower(text), F.lower(url)
    for name, (urls, texts, schemas) in PATTERNS.items():
        points = [_found(low_url, p).cast("int") * (30 / len(urls)) for p in urls]
        points += [_found(low, p).cast("int") * (40 / len(texts)) for p in texts]
        points += [F.contains(schema_types, F.lit(p)).cast("int") * (30 / len(schemas)) for p in schemas]
        scores[name] = F.round(sum(points, F.lit(0.0)), 6)
    names = F.array(*[F.lit(x) for x in scores])

    def pick(values: Column) -> Column:
        best = F.array_max(values)
        confidence = F.least(best / 100, F.lit(1.0))
        name = F.element_at(names, F.array_position(values, best).cast("int"))
        return F.struct(F.when(confidence < 0.1, F.lit("unknown")).otherwise(name).alias("type"), F.when(confidence < 0.1, F.lit(0.0)).otherwise(confidence).alias("confidence"))

    return bound(F.array(*scores.values()), pick)


def _per_type(kind: Column, pick) -> Column:
    out = F.lit(pick(GATE["blog"]))
    for name, row in GATE.items():
        out = F.when(kind == name, F.lit(pick(row))).otherwise(out)
    return out


def quality(kind: Column, content: Column, url: Column, title: Column, og_title: Column, description: Column, og_description: Column, og_image: Column, h1: Column, h2_count: Column, analysis: Column, value: Column) -> Column:
    """struct(score, floor, indexed, reason, and the six factors) of a page under the gate of its type.

    The score is rounded half up at two decimals before it is compared with the floor of the type.
    """
    text = text_or_empty(content)
    length = F.length(F.trim(text))
    asked = _per_type(kind, lambda r: r[1])
    long_enough = F.when(length > asked * 10, F.lit(1.0)).otherwise(F.least(F.lit(1.0), length / (asked * 10)))
    f_length = F.when(length < asked, F.greatest(F.lit(0.1), length / asked * 0.5)).otherwise(long_enough)

    has = lambda c: text_or_empty(c) != ""
    shown = F.trim(F.when(has(og_title), og_title).otherwise(text_or_empty(title)))
    f_title = F.when(F.length(shown) < 5, F.lit(0.1)).when(F.length(shown) > 200, F.lit(0.6)).otherwise(F.lit(0.95))

    low = F.lower(text)
    add = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0))
    # in hundredths, so that the sum is exact
    meta = F.lit(30) + add(has(description), 15) + add(has(og_title), 15) + add(has(og_description), 10) + add(has(og_image), 10)
    bonus = (
        F.when(kind == "blog", add(has(h1), 10) + add(h2_count > 2, 5))
        .when(kind == "video", add(F.length(text_or_empty(description)) > 50, 15) + add(F.contains(low, F.lit("video")) | F.contains(low, F.lit("transcript")), 5))
        .when(kind == "manga", add(has(h1), 10) + add(h2_count > 0, 10))
        .when(kind == "image", add(F.rlike(text, F.lit("alt=[\"'][^\"']*[\"]")), 15))
        .when(kind == "official_site", add(has(og_title) & has(og_description), 15) + add(F.contains(low, F.lit("json-ld")) | F.contains(low, F.lit("schema")), 10))
        .when(kind == "code_repository", add(F.contains(low, F.lit("readme")) | F.contains(low, F.lit("documentation")), 20) + add(F.contains(F.lower(url), F.lit("github")) | F.contains(F.lower(url), F.lit("gitlab")), 10))
        .otherwise(F.lit(0))
    )
    f_meta = F.least(F.lit(1.0), (meta + bonus) / 100)

    u = F.lower(url)
    spam = [F.contains(u, F.lit(p)) for p in SPAM_PARTS]
    points = F.lit(100) - sum((s.cast("int") * 15 for s in spam), F.lit(0))
    points = F.when(contains_any(u, GOOD_HOSTS), F.least(F.lit(100), points + 15)).otherwise(points)
    f_url = F.greatest(F.lit(0.2), points / 100)
    share = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / 100))).otherwise(F.lit(0.5))
    factors = [f_length, f_title, f_meta, f_url, share(analysis), share(value)]
    total = sum((f * _per_type(kind, lambda r, i=i: r[2][i]) for i, f in enumerate(factors)), F.lit(0.0))
    score = F.floor(F.round(total * 100, 6) + 0.5) / 100
    floor = _per_type(kind, lambda r: r[0])
    reasons = F.array_compact(
        F.array(
            F.when(length < asked, F.concat(F.lit("insufficient_content("), length.cast("string"), F.lit("/"), asked.cast("string"), F.lit(")"))),
            F.when(F.length(shown) < 5, F.lit("missing_title")),
            *[F.when(s, F.lit(f"spam_pattern({p})")) for s, p in zip(spam, SPAM_PARTS)],
        )
    )
    below = F.concat(F.lit("below_threshold("), F.format_string("%.2f", score), F.lit(" < "), F.format_string("%.2f", floor), F.lit(")"))
    reason = F.when(score < floor, F.when(F.size(reasons) > 0, F.array_join(F.slice(reasons, 1, 3), " + ")).otherwise(below))
    names = ["content_length", "title_quality", "metadata_quality", "url_quality", "analysis_score", "page_value_score"]
    return F.struct(score.alias("score"), floor.alias("floor"), (score >= floor).alias("indexed"), reason.alias("reason"), *[f.alias(n) for f, n in zip(factors, names)])


def quality_label(score: Column) -> Column:
    return _first([(score >= at, name) for at, name in QUALITY_LABELS], F.lit("poor"))
