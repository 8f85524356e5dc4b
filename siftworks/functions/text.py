"""Text, URL and hash functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Japanese words left out of the term counts, and file endings that are no pages.
STOPWORDS = ["の", "に", "は", "を", "た", "が", "で", "て", "と", "し", "れ", "さ", "ある", "いる", "も", "する", "から", "な", "こと", "として", "い", "や", "など", "なっ", "ない", "この", "ため"]
MEDIA = ["pdf", "jpg", "jpeg", "png", "gif", "zip", "mp4", "avi", "mp3"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def contains_any(text: Column, parts: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(p)) for p in parts])


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def clean_text(text: Column) -> Column:
    """White space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_query(query: Column) -> Column:
    return clean_text(F.lower(query))


def tokens(text: Column) -> Column:
    """Words of two characters or more, stop words left out, in order and with repeats."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, F.lower(t)))


def occurrences(text: Column, part: str) -> Column:
    """How often a part occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def domain(url: Column) -> Column:
    """Host in lower case without port and www."""
    return F.regexp_replace(F.regexp_replace(F.lower(authority(url)), r":\d+$", ""), r"^www\.", "")


def is_valid_url(url: Column) -> Column:
    """http(s), with a host, and no media file."""
    return F.coalesce(
        F.rlike(url, F.lit(r"(?i)^https?://[^/?#]+")) & ~F.rlike(F.lower(path(url)), F.lit(r"\.(" + "|".join(MEDIA) + r")$")), F.lit(False)
    )


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no slash at the end of a path, parameters sorted, no fragment.

    Parameters keep their encoding; the values of one name keep their order.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    where = path(url)
    where = F.when(where == "/", where).otherwise(F.regexp_replace(where, r"/+$", ""))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), i.alias("i"), p.alias("p")))
    ordered = F.transform(F.array_sort(named), lambda x: F.when(F.contains(x["p"], F.lit("=")), x["p"]).otherwise(F.concat(x["p"], F.lit("="))))
    joined = F.array_join(ordered, "&")
    return F.concat(scheme, F.lit("://"), F.lower(authority(url)), where, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")))


def title_from_path(url: Column) -> Column:
    """The last part of the path with blanks for - and _, or the host, or the url."""
    last = F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), r"([^/]+)$", 1)
    return F.coalesce(F.nullif(F.translate(last, "-_", "  "), F.lit("")), F.nullif(authority(url), F.lit("")), url)


def short_hash(prefix: str, value: Column) -> Column:
    """First 16 hex digits of sha256 over prefix and value."""
    return F.substring(F.sha2(F.concat(F.lit(prefix), value), 256), 1, 16)


def days_between(start: Column, end: Column) -> Column:
    """Whole periods of 24 hours."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 86_400_000_000).cast("int")
