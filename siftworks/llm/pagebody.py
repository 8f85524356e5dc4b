"""Problems 4 and 5: the body of a page by template deduction over same-host pages, and pages stuffed with keywords.

Lines are the tokens of a page. Tokens of a host with one occurrence vector form an equivalence class. A class with
several paragraphs of prose is an article that several pages give out: those pages count as one from then on. The other
classes make up the template of the host if they are valid: frequent, and in one order on every page. They are
nested by their place, and the slot they leave between the headline and the first class behind the text is the body.

Stuffed pages are told by the shapes of their lines: shapes are grouped over the crawl, and a shape that does not end
sentences is one of lists if the pages that hold it are otherwise prose, else one of stuffing.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import spread, staged

#: A class belongs to the template if it occurs in at least this many articles of the host, and this share of them ...
HEADLINES, SHARE = 3, 0.004
#: ... or the second share where its tokens change their order from page to page. The second share on so many hosts
#: makes a token template wherever it stands.
FIRM_SHARE, HOSTS = 0.03, 3
#: Paragraphs with one occurrence vector that make an article given out by several pages.
PARAGRAPHS = 2
#: Prose is a line with several sentences of more than so many characters, as short notices have several, too; on a page
#: without such lines the second length will do.
PROSE, SHORT_PROSE = 120, 40
#: A token lies behind the text if on average at most this share of the prose follows it.
BEHIND, FAR_BEHIND = 0.2, 0.05
#: A page is stuffed if more than this share of its own words stands in shapes of stuffing.
STUFFED = 0.5
#: A shape is taken to stand among prose until so many words of it have been seen elsewhere.
PRIOR_WORDS = 30
#: Lines of more characters are no headlines; of more than the second, no lines about the site; of more than the third,
#: no bylines, trails or labels. The leading words of a line of markup that may be the title of a block.
HEADLINE_SIZE, NOTICE_SIZE, LABEL_SIZE, LEADS = 400, 300, 120, 9

TAG = re.compile(r"<[^<>]*>")
ANCHOR = re.compile(r"<a\b[^<>]*>.*?</a>", re.IGNORECASE)
HEADLINE = re.compile(r"<h1\b[^<>]*>(.*?)</h1>", re.IGNORECASE)
DIGITS, WORD = re.compile(r"\d+"), re.compile(r"[^\W_]+")
MANY_SENTENCES = re.compile(r"[^\W\d_][.!][\"”»)]*\s+\S")
SENTENCE_END = re.compile(r"(?<=[^\W\d_][.!?])[\"”»)]*\s+|(?<=[。！？])")
CLOSED = re.compile(r"[.!?。！？…][\"'”’»)]*$")
LINK = re.compile(r"https?://|www\.|\]\(", re.IGNORECASE)
SEPARATORS = re.compile(r"[|;,•»·#/<>]")
TRAIL = re.compile(r"^[^.!?]{0,40}?\s[»>/›|·]\s[^.!?]*$")
DATE = re.compile(r"\b(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{4})\b")
SUFFIX = re.compile(r"\s+[-|–—]\s+[^-|–—]*$")


def line_form(line: str) -> str:
    return DIGITS.sub("0", " ".join(line.split()).lower())


def key_of(form: str) -> int:
    return xxhash.xxh3_64_intdigest(form.encode("utf-8", "surrogatepass")) - (1 << 63)


def text_lines(content: str, markup: bool) -> tuple[list[tuple[int, str, str, bool]], list[str]]:
    """[(line number, text, first part, only links)] of the lines with text, and the headlines the markup names."""
    out, heads, skip = [], [], ""
    for number, line in enumerate(content.split("\n"), 1):
        if not markup:
            text = line.strip()
            if text:
                out.append((number, text, text, False))
            continue
        if skip:
            end = line.lower().find(skip)
            if end < 0:
                continue
            line, skip = line[end + len(skip) :], ""
        low = line.lower()
        for name in ("head", "script", "style"):
            at = re.search(rf"<{name}\b", low)
            if at:
                end = low.find(f"</{name}>", at.start())
                if end < 0:
                    line, skip = line[: at.start()], f"</{name}>"
                else:
                    line = line[: at.start()] + line[end + len(name) + 3 :]
                low = line.lower()
        parts = [p for p in (html.unescape(p).strip() for p in TAG.split(line)) if p]
        if parts:
            heads += [html.unescape(TAG.sub("", x)).strip() for x in HEADLINE.findall(line)]
            bare = html.unescape(TAG.sub("", ANCHOR.sub("", line))).strip() if "<a" in low else "x"
            out.append((number, html.unescape(TAG.sub("", line)).strip(), parts[0], not bare))
    return out, heads


def shape(sentence: str, words: list[str], closed: bool) -> int:
    """Words on a scale, numbers, share of capitals, separators, links and a closing mark, packed into 12 bits."""
    n = len(words)
    size = 4 * min(15, n.bit_length()) + min(3, sum(any(map(str.isdigit, w)) for w in words))
    capitals = sum(w[0].isupper() for w in words) * 3 // max(1, n)
    separators = min(3, 4 * len(SEPARATORS.findall(sentence)) // max(1, n))
    return (((size * 4 + capitals) * 4 + separators) * 2 + bool(LINK.search(sentence))) * 2 + closed


@lru_cache(maxsize=10_000)
def _name_in(name: str) -> re.Pattern:
    """A site's name with whatever stands between its letters but other letters and digits."""
    return re.compile(r"[\W_]*".join(map(re.escape, name)))


def _label(text: str) -> int:
    """Key of a short line without its last name, the last word with a capital behind the first; 0 without one."""
    words = text.split()
    at = next((i for i in range(len(words) - 1, 0, -1) if words[i][0].isupper()), 0)
    return key_of("\0" + " ".join(words[:at] + words[at + 1 :]).lower()) if at and len(words) > 2 and not DIGITS.search(text) else 0


def _leads(form: str) -> list[int]:
    """Keys of the first words of a line: markup often has a whole block, with its title, in one line."""
    words = form.split(" ", LEADS)[:LEADS]
    return [key_of(" ".join(words[:k])) for k in range(1, len(words) + 1)] if form.count(" ") >= 3 else []


def _sentences(lines: list[str]) -> tuple[list[list[int]], list[list[int]], list[int]]:
    """Per line the shapes and the words of its parts that are no sentences, and the words of its sentences.

    A closed string made up of the page's repeated pairs of words is no sentence; a pair is repeated if it occurs six
    times and makes up a fortieth of the page. Without such pairs only the open end of a line is looked at.
    """
    own = [WORD.findall(line.lower()) for line in lines]
    low = [w for words in own for w in words]
    least = max(6, 0.025 * len(low))
    often = {p for p, n in Counter(zip(low, low[1:])).items() if n >= least}
    shapes, counts, said = [], [], []
    for line, in_line in zip(lines, own):
        s, c, good = [], [], 0
        closed = bool(CLOSED.search(line[-8:]))
        if closed and not often:
            good = len(in_line)
        else:
            parts = [p for p in SENTENCE_END.split(line) if p]
            for k, part in enumerate(parts):
                ended = closed or k + 1 < len(parts)
                words = WORD.findall(part)
                stuffed = False
                if often and ended and len(words) > 2:
                    pairs = [w.lower() for w in words]
                    stuffed = sum(p in often for p in zip(pairs, pairs[1:])) >= 0.3 * (len(words) - 1)
                if ended and not stuffed:
                    good += len(words)
                elif words:
                    s.append(shape(part, words, ended))
                    c.append(len(words))
        shapes.append(s)
        counts.append(c)
        said.append(good)
    return shapes, counts, said


def _token_rows(batches):
    """One row per document: its lines as tokens, with what the later steps need of each line."""
    columns = ["kind", "doc", "host", "head", "line", "token", "stem", "after", "use", "leads", "shapes", "words", "said"]
    for batch in batches:
        rows = []
        for kind, doc, host, content, *named in zip(*(batch[c] for c in ("kind", "doc", "host", "content", "h1", "og", "title"))):
            markup = kind == "crawl_jobs"
            lines, heads = text_lines(content, markup)
            if not lines:
                continue
            heads += [x for x in named if x and len(x.strip()) > 5]
            forms = [line_form(x) for x in heads]
            forms += [SUFFIX.sub("", x) for x in forms]
            forms = [x for x in (x.rstrip("…. ") for x in forms) if len(x) > 5]
            name = "".join(WORD.findall((host or "").split(".")[0].lower()))
            known, long = set(forms), tuple(x for x in forms if len(x) > 15)
            named_here = _name_in(name) if len(name) > 5 else None
            tokens, stems, use, lengths, leads = [], [], [], [], []
            for _, text, first, linked in lines:
                form = line_form(first)
                size = len(text)
                head = size < HEADLINE_SIZE and (form in known or form.startswith(long))
                own = dated = trail = False
                if named_here and size < NOTICE_SIZE:
                    own = bool(named_here.search(text.lower()))
                prose = size > SHORT_PROSE and bool(MANY_SENTENCES.search(text))
                stem = 0
                if size < LABEL_SIZE and not prose:
                    dated = bool(DATE.search(text)) and not CLOSED.search(text)
                    trail = bool(TRAIL.match(text))
                    stem = _label(text)
                lengths.append(size if prose else 0)
                tokens.append(key_of(form))
                stems.append(stem)
                use.append(head + 2 * linked + 4 * own + 8 * prose + 16 * trail + 32 * dated)
                leads.append(_leads(form) if markup and not head else [])
            if max(lengths) > PROSE:
                lengths = [n if n > PROSE else 0 for n in lengths]
            whole = sum(lengths)
            after = (100 * (1 - np.cumsum(lengths) / whole)).round().astype(np.int32) if whole else np.full(len(lines), -1, np.int32)
            shapes, counts, said = _sentences([x[1] for x in lines])
            rows.append(
                (
                    kind,
                    doc,
                    host,
                    key_of(forms[0]) if forms else 0,
                    [x[0] for x in lines],
                    tokens,
                    stems,
                    after.tolist(),
                    use,
                    leads,
                    shapes,
                    counts,
                    said,
                )
            )
        yield pd.DataFrame(rows, columns=columns)


TOKENS = "kind string, doc string, host string, head long, line array<int>, token array<long>, stem array<long>, after array<int>, use array<int>, leads array<array<long>>, shapes array<array<int>>, words array<array<int>>, said array<int>"


def page_documents(pages: DataFrame) -> DataFrame:
    """(kind, doc, host, content, h1, og, title) of the pages with content; the host comes from the url."""
    return pages.where(F.col("id").isNotNull() & F.col("content").isNotNull()).select(
        F.lit("pages").alias("kind"),
        F.col("id").cast("string").alias("doc"),
        host_of(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://([^/?#:]+)", 1)).alias("host"),
        "content",
        "h1",
        F.col("og_title").alias("og"),
        "title",
    )


def job_documents(jobs: DataFrame) -> DataFrame:
    """The same of the crawl jobs that kept their HTML."""
    return jobs.where(F.col("job_id").isNotNull() & F.col("content").isNotNull()).select(
        F.lit("crawl_jobs").alias("kind"),
        F.col("job_id").alias("doc"),
        host_of(F.coalesce("domain", F.lit(""))).alias("host"),
        "content",
        F.lit(None).cast("string").alias("h1"),
        F.lit(None).cast("string").alias("og"),
        "title",
    )


def host_of(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"^www\.", "")


def articles(tokens: DataFrame) -> DataFrame:
    """(host, art, article): the article each headline of a host belongs to.

    Paragraphs of prose with one occurrence vector over the headlines of a host are a class. A class of several of them
    is an article which several pages give out, be it under other headlines and with edits elsewhere; its headlines get
    the name of the least of them, and take over the name that one has got by other classes.
    """
    prose = tokens.select("host", "art", F.explode(F.filter(F.arrays_zip("token", "use"), lambda x: x["use"].bitwiseAND(F.lit(8)) > 0)).alias("x"))
    prose = staged(prose.select("host", F.col("x.token").alias("token"), "art").distinct())
    vectors = prose.groupBy("host", "token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("art")).alias("vector"), F.min("art").alias("least")).where("n >= 2")
    vectors = staged(vectors)
    classes = vectors.groupBy("host", "n", "vector").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= PARAGRAPHS)
    given_out = vectors.join(classes, ["host", "n", "vector"]).select("host", "token", "least")
    named = staged(prose.join(given_out, ["host", "token"]).groupBy("host", "art").agg(F.min("least").alias("to")))
    further = named.select("host", F.col("art").alias("to"), F.col("to").alias("far"))
    return named.join(further, ["host", "to"], "left").select("host", "art", F.coalesce("far", "to").alias("article"))


def templates(tokens: DataFrame) -> DataFrame:
    """(host, names, places): the tokens of each host's template with their places.

    Documents with one headline (copies, a page and its job), and headlines of one article, count once for a token. Tokens
    of a host with one occurrence vector over its articles (compared by its count and a hash) form a class, valid as said
    above; its tokens are nested by their place, the share of the prose that follows them: 1 before the text, 0 behind
    it. A label with a changing name is a token without that name, and needs FIRM_SHARE. A host's template has at
    most 250 times as many tokens as its documents have lines.
    """
    tokens = tokens.dropDuplicates(["kind", "doc"]).withColumn("art", F.when(F.col("head") != 0, F.col("head")).otherwise(F.xxhash64("kind", "doc")))
    first = tokens.groupBy("kind", "host", "art").agg(F.min("doc").alias("doc"))
    one = tokens.join(first, ["kind", "host", "art", "doc"], "left_semi")
    one = staged(one.join(articles(one), ["host", "art"], "left").withColumn("art", F.coalesce("article", "art")).drop("article"))
    hosts = staged(one.groupBy("host").agg(F.count_distinct("art").alias("documents")))
    places = F.transform(F.arrays_zip("token", "stem", "after", "use"), lambda x, i: F.struct(x["token"].alias("token"), x["stem"].alias("stem"), x["after"].alias("after"), i.alias("at")))
    line = one.select("host", "art", F.explode(places).alias("x"))
    each = line.select("host", "art", F.col("x.token").alias("token"), F.col("x.after").alias("after"), F.col("x.at").alias("at"), F.lit(False).alias("label"))
    stem = line.where("x.stem <> 0").select("host", "art", F.col("x.stem").alias("token"), F.col("x.after").alias("after"), F.col("x.at").alias("at"), F.lit(True).alias("label"))
    known = F.when(F.col("after") >= 0, F.col("after"))
    per_article = staged(each.unionByName(stem).groupBy("host", "label", "token", "art").agg(F.sum(known).alias("sum"), F.count(known).alias("known"), F.min("at").alias("at")))
    counted = (
        per_article.groupBy("host", "label", "token")
        .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("art")).alias("vector"), F.try_divide(F.sum("sum"), F.sum("known")).alias("after"))
        .where("n >= 2")
        .join(hosts, "host")
    )
    counted = staged(counted.withColumn("firm", F.col("n") >= FIRM_SHARE * F.col("documents")))
    firm = counted.where("firm").groupBy("token").agg(F.count(F.lit(1)).alias("on_hosts"), F.avg("after").alias("usual"))
    firm = staged(firm.where(F.col("on_hosts") >= HOSTS).select("token", "usual"))
    shared = per_article.select("host", "token").join(firm, "token").distinct()

    frequent = (F.col("n") >= HEADLINES) & (F.col("n") >= SHARE * F.col("documents"))
    mine = counted.where(~F.col("label"))
    classes = staged(mine.groupBy("host", "n", "vector").agg(F.count(F.lit(1)).alias("size")).where("size >= 2"))
    members = mine.join(classes, ["host", "n", "vector"])
    sequence = F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]))
    orders = per_article.where(~F.col("label")).join(members.select("host", "token", "n", "vector"), ["host", "token"]).groupBy("host", "n", "vector", "art").agg(sequence.alias("order"))
    orders = orders.groupBy("host", "n", "vector").agg((F.min("order") == F.max("order")).alias("ordered"))
    judged = mine.join(classes.join(orders, ["host", "n", "vector"]), ["host", "n", "vector"], "left").withColumn("ordered", F.coalesce("ordered", F.lit(True)))
    valid = frequent & (F.col("ordered") | F.col("firm"))
    own = judged.where(valid).select("host", "token", "after").unionByName(counted.where(F.col("label") & frequent & F.col("firm")).select("host", "token", "after"))
    kept = own.join(shared, ["host", "token"], "full").withColumn("after", F.coalesce("after", "usual", F.lit(100.0)))
    nested = F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("before"), "token")))
    return kept.groupBy("host").agg(nested.alias("m")).select("host", F.col("m.token").alias("names"), F.transform("m", lambda x: -x["before"] / 100).alias("places"))


def body_of(token, stem, after, use, leads, names: dict[int, float]) -> list[int]:
    """Indices of the body lines of one document, the headline first."""
    n = len(token)
    start = next((i for i in range(n) if use[i] & 1 and not use[i] & 2), None)
    fixed = [i != start and (token[i] in names or stem[i] in names) for i in range(n)]
    if start is None:
        start = next((i for i in range(n) if not fixed[i] and not use[i] & (2 | 4 | 16)), n)
    end = n
    for i in range(start + 1, n):
        if fixed[i]:
            place = names[token[i]] if token[i] in names else names[stem[i]]
        else:
            place = min((names[x] for x in leads[i] if x in names), default=1.0)
        # an advertisement before a short last paragraph looks as if behind the text, too
        prose_next = fixed[i] and i + 1 < n and use[i + 1] & 8 and not use[i + 1] & (2 | 4) and token[i + 1] not in names
        if not prose_next and (place <= FAR_BEHIND or (place <= BEHIND and after[i] <= 0)):
            end = i
            break
    return [i for i in range(start, end) if i == start or not (fixed[i] or use[i] & (2 | 4 | 32))]


def _bodies(batches):
    for batch in batches:
        rows = []
        last_host, names = None, {}
        for kind, doc, host, line, token, stem, after, use, leads, shapes, words, said, known, places in zip(*(batch[c] for c in BODY_INPUT)):
            if host != last_host or known is None:
                names, last_host = dict(zip(known.tolist(), places.tolist())) if known is not None else {}, host
            body = body_of(token.tolist(), stem.tolist(), after, use, leads, names)
            other: Counter[int] = Counter()
            times: Counter[int] = Counter()
            for i in body[1:]:
                for s, n in zip(shapes[i], words[i]):
                    other[s] += n
                    times[s] += 1
            scaled = [8 * int(s) + min(7, times[s].bit_length()) for s in other]
            rows.append((kind, doc, [int(line[i]) for i in body], sum(int(said[i]) for i in body[1:]), scaled, list(other.values())))
        yield pd.DataFrame(rows, columns=["kind", "doc", "body", "said", "shape", "words"])


BODY_INPUT = ["kind", "doc", "host", "line", "token", "stem", "after", "use", "leads", "shapes", "words", "said", "names", "places"]


def shapes_of_stuffing(found: DataFrame) -> list[int]:
    """The shapes that mostly stand on pages without prose, each with how often it stands there; at most 2^15 of them.

    found: (said, shape, words), a page's words in sentences, and its words in each shape that is none; a shape carries
    the times it occurs on the page, on a scale. The words of all pages of the crawl are grouped by that, each weighted
    with the share of sentences on its page, and PRIOR_WORDS among prose are added.
    """
    whole = F.col("said") + F.aggregate("words", F.lit(0).cast("long"), lambda a, n: a + n)
    one = found.select((F.col("said") / whole).alias("prose"), F.explode(F.arrays_zip("shape", "words")).alias("x"))
    n, among = F.sum("x.words"), F.sum(F.col("x.words") * F.col("prose"))
    rows = one.groupBy("x.shape").agg(n.alias("n"), among.alias("among")).where((F.col("among") + PRIOR_WORDS) * 2 < F.col("n") + PRIOR_WORDS)
    return [r[0] for r in rows.select("shape").collect()]


def bodies(documents: DataFrame) -> DataFrame:
    """(kind, doc, body, stuffing): the line numbers of each document's body, and its share of words in keyword shapes.

    documents: (kind, doc, host, content, h1, og, title); content of the kind crawl_jobs is HTML. The body starts at the
    headline, found by its markup or by the other fields, or else at the first line the template leaves. It ends at the
    first template class behind the text. Template lines between (advertisements, bylines, notices), lines that name the
    site and lines of links only are no body. stuffing is a share of the body without its headline, 0 where nothing else
    is there. Documents without a line of text give no row, repeated rows one; unknown hosts share a template; an empty
    table gives no rows.
    """
    narrow = documents.select("kind", "doc", "host", "content", "h1", "og", "title")
    tokens = staged(spread(narrow).mapInPandas(_token_rows, TOKENS))
    # written, so that the join reads two shuffles and can split a host of many pages
    template = staged(templates(tokens.select("kind", "doc", "host", "head", "token", "stem", "after", "use")))
    found = tokens.join(template, "host", "left")
    found = found.select(*BODY_INPUT).mapInPandas(_bodies, "kind string, doc string, body array<int>, said long, shape array<int>, words array<long>")
    found = staged(found.dropDuplicates(["kind", "doc"]))
    stuffed = F.lit(shapes_of_stuffing(found) or [-1])
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, n: a + n)
    some = total(F.transform(F.arrays_zip("shape", "words"), lambda x: F.when(F.array_contains(stuffed, x["shape"]), x["words"]).otherwise(F.lit(0).cast("long"))))
    share = F.coalesce(F.try_divide(some, F.col("said") + total("words")), F.lit(0.0))
    return found.select("kind", "doc", "body", share.alias("stuffing"))
