"""Trackers in HTML: by kind of element with a risk profile, and by a plain count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# Risk and patterns per tracker, in order of the search.
TRACKERS = {
    "google_analytics": (2, [r"google-analytics", r"ga\(", r"gtag\(", r"_gid", r"_ga"]),
    "gtag": (2, [r"googletagmanager", r"gtag\("]),
    "amplitude": (2, [r"amplitude\.com", r"amplitude\("]),
    "mixpanel": (2, [r"mixpanel", r"mixpanel\.track"]),
    "facebook_pixel": (4, [r"facebook\.com/tr", r"fbq\(", r"pixel", r"_fbp"]),
    "google_ads": (3, [r"google\.com/ads", r"pagead", r"gstatic\.com/ads"]),
    "criteo": (3, [r"criteo\.com", r"criteo\.net"]),
    "twitter_pixel": (3, [r"twitter\.com.*pixel", r"twq\("]),
    "tiktok_pixel": (3, [r"tiktok\.com.*pixel"]),
    "hotjar": (5, [r"hotjar", r"hj\."]),
    "fullstory": (5, [r"fullstory", r"_fs_", r"FS\.replaySession"]),
    "sessioncam": (5, [r"sessioncam", r"_scc"]),
    "smartlook": (5, [r"smartlook", r"smartlook\.com"]),
    "microsoft_clarity": (4, [r"clarity\.ms", r"clarity\("]),
    "contentsquare": (4, [r"contentsquare", r"contentsquarecdn"]),
    "optimizely": (2, [r"optimizely", r"optimizely\.com"]),
    "convert": (2, [r"convertkit", r"convertexperiments"]),
    "cloudflare": (1, [r"cloudflare\.com"]),
    "cdn": (1, [r"cdn", r"jsdelivr", r"unpkg"]),
}
# Calls in inline scripts that name a tracker, in order of the search; a pixel of no known tracker.
INLINE = {"google_analytics": (2, [r"ga\("]), "gtag": (2, [r"gtag\("]), "facebook_pixel": (4, [r"fbq\("]), "twitter_pixel": (3, [r"twq\("]), "hotjar": (5, [r"hj\("]), "fullstory": (5, [r"_fs_\("]), "amplitude": (2, [r"amplitude\.track"]), "mixpanel": (2, [r"mixpanel\.track"])}
UNKNOWN_PIXEL = ("unknown_pixel", 3)
# Categories of the profile.
CATEGORIES = {
    "analytics": ["google_analytics", "gtag", "amplitude", "mixpanel"],
    "advertising": ["facebook_pixel", "google_ads", "criteo", "twitter_pixel", "tiktok_pixel"],
    "heatmap": ["hotjar", "fullstory", "sessioncam", "smartlook", "microsoft_clarity", "contentsquare"],
}
COUNTED = {"google_analytics": r"google-analytics|UA-\d+", "facebook_pixel": r"facebook\.com/tr|fbq\(", "google_ads": r"google.*?ads|googleadservices", "mixpanel": r"mixpanel\.com", "amplitude": r"amplitude\.com", "hotjar": r"hotjar\.com", "intercom": r"intercom\.com", "rollbar": r"rollbar\.com", "sentry": r"sentry\.io"}
ELEMENTS = {"script": r"""(?i)<script[^>]*src=["']?([^"'>\s]+)""", "inline_script": r"(?is)<script[^>]*>([^<]+)</script>", "pixel": r"""(?i)<img[^>]*src=["']?([^"'>\s]+)""", "iframe": r"""(?i)<iframe[^>]*src=["']?([^"'>\s]+)"""}
PROFILES = [(4.5, "severe_tracking_risk"), (3.5, "heavy_trackers"), (2.5, "moderate_trackers"), (1.5, "minimal_trackers")]
COUNT_PROFILES = [(0, 0.0, "clean"), (2, 0.3, "minimal"), (4, 0.6, "moderate"), (6, 0.8, "heavy")]
SAFETY = [(0.9, "clean"), (0.7, "minimal"), (0.5, "moderate"), (0.3, "heavy")]


def _named(text: Column, kind: str) -> Column:
    """struct(name, kind, risk) of the first tracker that a source or a snippet shows, or null."""
    out = F.lit(None)
    if kind == "pixel":
        name, risk = UNKNOWN_PIXEL
        out = F.when(F.rlike(text, F.lit("(?i)pixel")), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(risk).alias("risk")))
    for name, (risk, patterns) in reversed((INLINE if kind == "inline_script" else TRACKERS).items()):
        found = F.rlike(text, F.lit("(?i)" + "|".join(patterns)))
        out = F.when(found, F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(risk).alias("risk"))).otherwise(out)
    return out


def _finder(kind: str):
    return lambda source: _named(source, kind)


def trackers(html: Column) -> Column:
    """array<struct(name, kind, risk)> of the distinct trackers in scripts, inline scripts, pixels and frames."""
    text = F.coalesce(html, F.lit(""))
    found = []
    for kind, pattern in ELEMENTS.items():
        sources = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        if kind == "pixel":
            sources = F.filter(sources, lambda s: F.rlike(s, F.lit("(?i)pixel|beacon")))
        found.append(F.array_compact(F.transform(sources, _finder(kind))))
    return F.array_distinct(F.concat(*found))


def tracker_report(html: Column) -> Column:
    """struct(trackers, count, average, safety, profile); safety is 1 for clean."""
    return bound(trackers(html), _report)


def _report(found: Column) -> Column:
    n = F.size(found)
    average = F.when(n > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x["risk"]) / n).otherwise(F.lit(1.0))
    profile = F.lit("clean")
    for at, name in reversed(PROFILES):
        profile = F.when((n > 0) & (average >= at), F.lit(name)).otherwise(profile)
    safety = F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1.0 - average / 5 - n * 0.05))
    return F.struct(found.alias("trackers"), n.alias("count"), average.alias("average"), safety.alias("safety"), profile.alias("profile"))


def category(name: Column) -> Column:
    """The category of a tracker, other for those without one."""
    out = F.lit("other")
    for kind, names in CATEGORIES.items():
        out = F.when(name.isin(names), F.lit(kind)).otherwise(out)
    return out


def tracker_count(html: Column) -> Column:
    """struct(count, risk, profile) by nine patterns over the whole page; risk is 0 for clean."""
    text = F.coalesce(html, F.lit(""))
    n = sum((F.rlike(text, F.lit("(?i)" + p)).cast("int") for p in COUNTED.values()), F.lit(0))
    risk, profile = F.lit(1.0), F.lit("severe")
    for upto, value, name in reversed(COUNT_PROFILES):
        risk, profile = F.when(n <= upto, F.lit(value)).otherwise(risk), F.when(n <= upto, F.lit(name)).otherwise(profile)
    return F.struct(n.alias("count"), risk.alias("risk"), profile.alias("profile"))


def safety_label(score: Column) -> Column:
    out = F.lit("severe")
    for at, name in reversed(SAFETY):
        out = F.when(score >= at, F.lit(name)).otherwise(out)
    return out
