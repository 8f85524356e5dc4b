"""Problem 1: text cut off by field limits or in transfer."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import spread, staged

# Pairs of brackets and quotes, what may end a sentence, and what may follow that.
CLOSERS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
TERMINATORS = ".!?。！？;:…"
AFTER = "\"'”’»)]}*_ \t\r"
# Marks of a cut. At most three words may follow the mark, as in "... Read more".
MARKED = re.compile(r"(…|\.\.\.|\[…\]|\(…\)|\(\.\.\.\)|\[\.\.\.\])(\s+\w+){0,3}\s*$")
SENTENCE_END = re.compile(r"[^\W\d_][.!?]['\"”»)]*\s+\S|[。！？]['\"”»)]*\s*\S")
WORD = re.compile(r"[^\W_]+")
# How a line on rights begins, which ends in a name.
RIGHTS = re.compile(r"(©|\(c\)|copyright\b)", re.IGNORECASE)
SEPARATOR = re.compile(r"\s*([:|–—·»/]|-\s)")
# Elements that must be closed.
PAIRED = {"a", "abbr", "article", "aside", "b", "blockquote", "body", "button", "cite", "code", "del", "div", "em", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "html", "i", "label", "main", "mark", "nav", "ol", "pre", "q", "s", "script", "section", "select", "small", "span", "strong", "style", "sub", "sup", "table", "textarea", "title", "u", "ul", "video"}
#: The automaton's input symbols: a tag, one without its end; an entity, an escape or a character without its end, which
#: matter at the end of the value only; an opening, a closing mark, a straight quote.
_symbols = re.compile(
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)[^<>]*>"
    r"|(?P<broken></?[a-zA-Z][^<>]*\Z|&#?\w{0,8}\Z|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?\Z|(?<=[^\s\d])%[0-9a-fA-F]?\Z|[\ufffd\ud800-\udfff]+\Z)"
    r"|\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[\\\"'nrt])"
    r"|(?P<open>[(\[{“«])|(?P<close>[)\]}”»])|(?P<quote>\")"
)

#: A last word that ends at most this share of its occurrences as the end of an unterminated line does not end lines.
RARELY = 0.004
#: Ends of lines that are added to those seen of a headline's last word: one that is rare in text tells nothing.
DOUBT = 0.2
#: A length is a source's limit if its count is so many times that of the lengths nearby, and by so many standard
#: deviations (of a Poisson distribution) more than it.
OUTSTANDING, DEVIATIONS = 5, 3


def unfinished(text: str) -> tuple[str | None, int]:
    """A stack automaton over the whole value: (what is unfinished at its end, where that began).

    'broken' is a tag, entity, escape or multibyte sequence without its end, 'unclosed' a quote, bracket or element on
    the stack. A list number "1)" closes nothing and an inch mark opens nothing. A quote that opens while another is open
    starts anew, so that a stray mark doesn't reach over the next quotation.
    """
    stack: list[tuple[str, int]] = []
    for found in _symbols.finditer(text):
        kind, at = found.lastgroup, found.start()
        if kind == "broken":
            return "broken", at
        if kind == "open":
            stack.append((found[0], at))
        elif kind == "close":
            if stack and stack[-1][0] == CLOSERS[found[0]]:
                stack.pop()
        elif kind == "quote":
            before = text[at - 1] if at else " "
            inside = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if inside is not None:
                opens = before.isspace() and at + 1 < len(text) and not text[at + 1].isspace()
                del stack[inside:]
                if opens:
                    stack.append(('"', at))
            elif not before.isdigit():
                stack.append(('"', at))
        elif kind == "tag" and found["tag"].lower() in PAIRED and not found[0].endswith("/>"):
            name = "<" + found["tag"].lower()
            if not found["end"]:
                stack.append((name, at))
            elif any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
    return ("unclosed", stack[-1][1]) if stack else (None, len(text))


def judge(text: str) -> tuple[str, str, str, bool]:
    """(state, reason, last line, several): state is cut, whole or open; open needs the source's baseline."""
    stripped = text.rstrip()
    line = stripped.rpartition("\n")[2].strip()
    if not line:
        return "whole", "empty", "", False
    if MARKED.search(line):
        return "cut", "marked", line, False
    what, began = unfinished(stripped)
    if what == "broken":
        return "cut", "broken", line, False
    several = bool(SENTENCE_END.search(line))
    bare = line.rstrip(AFTER)
    ended = not bare or bare[-1] in TERMINATORS
    here = began >= len(stripped) - len(line)
    if what == "unclosed" and len(line) > 1 and (here or not RIGHTS.match(line)):
        return ("cut" if here and (several or not ended) else "open"), "unclosed", line, several
    if ended:
        return "whole", "terminated", line, several
    if line[-1] in ")]}”»\"" or RIGHTS.match(line):
        return "whole", "closed", line, several
    return "open", "unterminated", line, several


def against(value: str, others: list[str]) -> tuple[str | None, str | None]:
    """Compare a headline with longer forms of it: 'cut' if one goes on inside the headline, 'whole' if one ends there.

    A longer form that goes on after a separator (a site's name, a second headline) confirms the end. A shorter form that
    the value itself continues after a separator shows that only such an addition can be cut: 'added', with the addition.
    """
    stem = value.rstrip()
    verdict = addition = None
    for other in others:
        other = MARKED.sub("", other).rstrip()
        if other == stem:
            verdict = verdict or "same"
        elif stem.startswith(other) and SEPARATOR.match(stem[len(other) :]):
            verdict, addition = verdict or "added", stem[len(other) :]
        elif len(other) > len(stem) and other.startswith(stem):
            if SEPARATOR.match(other[len(stem) :]):
                return "whole", None
            verdict = "cut"
    return verdict, addition


def _facts(batches):
    columns = ["page", "site", "field", "state", "reason", "line", "last", "small", "several", "head", "addition", "chars", "bytes"]
    for batch in batches:
        rows = []
        for page, site, content, title, h1, og in zip(*(batch[x] for x in ("page", "site", "content", "title", "h1", "og"))):
            heads = [x.strip() for x in (title, h1, og) if x and x.strip()]
            head = xxhash.xxh3_64_intdigest(heads[-1]) - (1 << 63) if heads else page
            stems = tuple({MARKED.sub("", x).rstrip() for x in heads})
            lines = [x for x in map(str.strip, content.split("\n")) if x and (x.startswith(stems) or any(s.startswith(x) for s in stems))] if content and stems else []
            for field, value in (("content", content), ("title", title), ("h1", h1)):
                if not value or not value.strip():
                    continue
                addition = None
                state, reason, line, several = judge(value)
                if field != "content":
                    text = value.strip()
                    stem = MARKED.sub("", text).rstrip()
                    others = [h1, og if og != title else None] if field == "title" else [title, og]
                    seen, addition = against(stem, [x.strip() for x in others if x] + lines)
                    if seen in ("cut", "whole") or (seen == "same" and reason == "marked"):
                        state, reason = "cut" if seen == "cut" else "whole", "headline"
                    elif seen and state == "open":
                        reason = seen
                    if state == "open" and text[-1] in "-|–—:,;/&":
                        state, reason = "cut", "separator"
                words = WORD.findall(line)
                dangling = bool(line) and not (line[-1].isalnum() or line[-1] in AFTER)
                rows.append((page, site, field, state, reason, line if state == "open" else None, words[-1].lower() if words and not dangling else None, bool(words) and words[-1][0].islower(), several and field == "content", head, addition, len(value), len(value.encode("utf-8", "surrogatepass"))))
        yield pd.DataFrame(rows, columns=columns)


def _vocabulary(batches):
    """Per batch (word, total, ends): occurrences, and those at the end of an unterminated line that is not the last."""
    for batch in batches:
        total: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        for text in batch["content"]:
            inner = text.rstrip().rpartition("\n")[0]
            total.update(WORD.findall(inner.lower()))
            for line in inner.split("\n"):
                line = line.rstrip()
                at = len(line)
                while at and line[at - 1].isalnum():
                    at -= 1
                if at < len(line):
                    ends[line[at:].lower()] += 1
        yield pd.DataFrame([(w, n, ends.get(w, 0)) for w, n in total.items()], columns=["word", "total", "ends"])


def truncated(
    pages: DataFrame,
    page: str = "id",
    site: str = "site_id",
    content: str = "content",
    title: str = "title",
    h1: str = "h1",
    og_title: str = "og_title",
) -> DataFrame:
    """(page, site, field, cut, reason): every non-blank value of content, title and h1, with whether its end is missing.

    A stack automaton over the whole value finds open quotes, brackets and elements, and tags, entities, escapes and
    multibyte sequences without their end; marks of a cut count too. Headlines are compared with their longer forms in the other fields and in the text.
    An unterminated last line with a sentence before it is cut. Any other unterminated end is judged by baselines over
    all pages: it is whole if the source ends other pages with the same line, or other headlines with the same addition; it is cut if it has the length at which
    the source cuts values, if its last word occurs nowhere else, or if that word hardly ever ends an unterminated line.

    Null and blank values are left out; repeated rows count once; a null site is a source of its own; an empty table
    gives no rows; other columns are ignored.
    """
    rows = pages.where(F.col(page).isNotNull()).select(
        F.col(page).alias("page"), F.col(site).alias("site"), F.col(content).alias("content"), F.col(title).alias("title"), F.col(h1).alias("h1"), F.col(og_title).alias("og")
    )
    kinds = dict(rows.dtypes)
    wide = spread(rows)
    schema = f"page {kinds['page']}, site {kinds['site']}, field string, state string, reason string, line string, last string, small boolean, several boolean, head long, addition string, chars int, bytes int"
    facts = wide.mapInPandas(_facts, schema)
    facts = staged(facts.withColumn("key", F.xxhash64(F.regexp_replace(F.lower("line"), r"\p{Nd}+", "0"))).drop("line").dropDuplicates(["page", "field"]))

    words = staged(
        wide.where(F.col("content").isNotNull())
        .select("content")
        .mapInPandas(_vocabulary, "word string, total long, ends long")
        .groupBy("word")
        .agg(F.sum("total").alias("total"), F.sum("ends").alias("ends"))
    )

    # a source's limit: a length, in characters or bytes, that far more unfinished values have than the lengths nearby
    spikes = None
    for unit in ("chars", "bytes"):
        unfinished = facts.where("state <> 'whole'").groupBy("site", "field", F.col(unit).alias("size")).agg(F.count(F.lit(1)).alias("n"))
        near = unfinished.select(F.explode(F.sequence(F.col("size") - 12, F.col("size") + 12)).alias("at"), F.col("site").alias("where"), F.col("field").alias("what"), F.col("n").alias("m"))
        around = near.groupBy("where", "what", "at").agg(F.sum("m").alias("around"))
        usual = (F.col("around") - F.col("n")) / 24
        outstanding = (F.col("n") >= OUTSTANDING * usual) & (F.col("n") >= usual + DEVIATIONS * F.sqrt(usual + 1))
        one = unfinished.join(around, F.expr("site <=> where and field = what and size = at")).where(outstanding).select("site", "field", "size")
        # hardly any value of the source is longer than its limit, and no headline is; the window runs over the lengths of
        # a source, which are far fewer than its values
        sizes = facts.groupBy("site", "field", F.col(unit).alias("long")).agg(F.count(F.lit(1)).alias("m"))
        upto = Window.partitionBy("site", "field").orderBy("long")
        share = sizes.select(F.col("site").alias("where"), F.col("field").alias("what"), "long", (1 - F.sum("m").over(upto) / F.sum("m").over(Window.partitionBy("site", "field"))).alias("longer"))
        one = (
            one.join(share, F.expr("site <=> where and field = what and size = long"))
            .where("longer = 0 or (field = 'content' and longer <= 0.3)")
            .select("site", "field", F.lit(unit).alias("unit"), "size")
        )
        spikes = one if spikes is None else spikes.unionByName(one)
    spikes = staged(spikes.withColumn("at", F.explode(F.sequence(F.col("size") - 2, F.col("size")))).select("site", "field", "unit", "at").distinct())

    open_values = facts.where("state = 'open'")
    shared = facts.where("state = 'open' and field = 'content'").groupBy("site", "key").agg(F.countDistinct("head").alias("same"))
    judged = open_values.alias("v").join(shared.alias("s"), F.expr("v.field = 'content' and v.key = s.key and v.site <=> s.site"), "left").select("v.*", "s.same")
    for unit in ("chars", "bytes"):
        limit = spikes.where(F.col("unit") == unit).select(F.col("site").alias("l_site"), F.col("field").alias("l_field"), F.col("at").alias("l_at"), F.lit(True).alias(f"at_{unit}"))
        judged = judged.join(limit, F.col("site").eqNullSafe(F.col("l_site")) & (F.col("field") == F.col("l_field")) & (F.col(unit) == F.col("l_at")), "left").drop("l_site", "l_field", "l_at")
    judged = judged.join(words.withColumnRenamed("word", "last"), "last", "left")
    # what a source mostly adds to its headlines, such as its name, is whole; a longer form shows if that one is cut, too
    additions = facts.where("addition is not null").groupBy("site", "addition").agg(F.count(F.lit(1)).alias("n"))
    usual = additions.groupBy(F.col("site").alias("u_site")).agg(F.max_by("addition", F.struct("n", F.length("addition"), "addition")).alias("mostly"))
    usual = additions.join(usual, F.expr("site <=> u_site and startswith(addition, mostly)"))
    usual = usual.groupBy("u_site").agg(F.max_by("addition", F.struct(F.length("addition"), "addition")).alias("usual"))
    judged = judged.join(usual, F.col("site").eqNullSafe(F.col("u_site")), "left")
    complete = F.coalesce(F.col("addition") == F.col("usual"), F.lit(False))
    at_limit = F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))
    total, ends = F.coalesce("total", F.lit(0)), F.coalesce("ends", F.lit(0))
    in_text = F.col("field") == "content"
    reason = (
        F.when((F.coalesce("same", F.lit(0)) > 1) | complete, F.lit(None))
        .when(F.col("several"), F.lit("unterminated"))
        .when((F.col("reason") != "same") & at_limit, F.lit("limit"))
        .when(F.col("last").isNull() | (F.col("reason") == "added"), F.lit(None))
        .when((total == 0) & (in_text | F.col("small")), F.lit("unknown word"))
        .when(ends + F.when(in_text, 0.0).otherwise(DOUBT) <= total * RARELY, F.lit("no last word"))
    )
    judged = judged.select("page", "site", "field", reason.isNotNull().alias("cut"), F.coalesce(reason, F.lit("whole")).alias("reason"))
    sure = facts.where("state <> 'open'").select("page", "site", "field", (F.col("state") == "cut").alias("cut"), "reason")
    return sure.unionByName(judged)
