import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftworks.llm import capping, leaks, lookalike, neardup, packing, pagebody, sitelines, textform, truncation, wordhash

LONG = "word and other words, " * 40_000


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


# ---------------------------------------------------------------- capping

PAGES = "id long, site_id int, pagerank_score double, c string, key string, cut string, n string"


def capped_by_hand(data, limit):
    by = {}
    for i, s, p in {(r[0], r[1], r[2]) if r[2] is None or not math.isnan(r[2]) else (r[0], r[1], None) for r in data}:
        if i is not None and s is not None:
            by.setdefault(s, []).append((p is None, -(p or 0.0), i))
    return sorted((s, i) for s, x in by.items() for _, _, i in sorted(x)[limit:])


def cap(spark, data, least=2):
    frame = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in data], PAGES)
    return rows(capping.over_cap(frame, least=least), "site_id", "id")


def test_cap_ties_nulls_nan_and_repeats(spark):
    data = [(i, 1, 0.5) for i in range(9)] + [(20, 1, None), (21, 1, float("nan")), (22, 1, -1.0), (23, 1, 1e300), (23, 1, 1e300), (24, None, 9.0), (None, 1, 9.0), (30, 2, 0.0), (31, 2, -0.0), (32, 2, 0.0)]
    assert cap(spark, data) == capped_by_hand(data, 2)


def test_cap_scores_of_every_size(spark):
    rng = random.Random(3)
    data = [(i, i % 3, rng.choice([rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300), 0.25, None])) for i in range(300)]
    assert cap(spark, data, least=17) == capped_by_hand(data, 17)


def test_cap_empty(spark):
    assert cap(spark, []) == []


def test_kept_and_surplus_are_all(spark):
    frame = spark.createDataFrame([(i, 1, float(i), "", "", "", "") for i in range(10)], PAGES)
    assert capping.capped(frame, least=4).count() == 4


# ---------------------------------------------------------------- look-alikes


@pytest.mark.parametrize(
    "a, b",
    [("ｆｕｌｌ　ｗｉｄｔｈ１", "full width1"), ("café", "café"), ("ﬁt", "fit"), ("zero​width﻿", "zerowidth"), ("a b", "a b"), ("раураl", "paypal"), ("Ηello", "Hello"), ("ｶﾞｲﾄﾞ", "ガイド"), ("a‐b", "a-b"), ("е́", "é")],
)
def test_equal_skeletons(a, b):
    assert textform.skeleton(a) == textform.skeleton(b)


@pytest.mark.parametrize("a, b", [("cafe", "café"), ("A", "a"), ("2", "²"), ("①", "1"), ("ß", "ss"), ("l", "1"), ("½", "1/2")])
def test_visible_differences_stay(a, b):
    assert textform.skeleton(a) != textform.skeleton(b)


def test_lookalike_pairs(spark):
    data = [(1, "paypal"), (2, "pаypal"), (3, "paypal"), (4, None), (5, ""), (6, "​"), (7, LONG), (7, LONG), (8, LONG.replace("o", "ο", 1)), (None, "paypаl")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in data], "doc_id long, text string, form string, id string")
    assert rows(lookalike.equal_looking_pairs(frame), "a", "b") == [(1, 2), (2, 3), (5, 6), (7, 8)]
    assert lookalike.canonical_form(frame).count() == len(data)
    assert rows(lookalike.equal_looking_pairs(frame.limit(0)), "a", "b") == []


# ---------------------------------------------------------------- near-duplicates


def test_word_hashes_are_the_words():
    texts = ["", "One, two; ONE", "Ünï 12x", "a" * 100_000, "日本語 テスト", "x_y"]
    for text in texts:
        words = textform.words(text)
        hashes = wordhash.word_hashes(text)
        assert len(hashes) == len(words)
        assert len(set(hashes.tolist())) == len(set(words))
    assert wordhash.word_hashes("b a b").tolist()[0] == wordhash.word_hashes("zz b").tolist()[1]


def jaccard(a, b, n=3):
    a, b = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (textform.words(a or ""), textform.words(b or "")))
    return len(a & b) / len(a | b) if a and b else 0


def test_neardup_against_brute_force(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(80)] for _ in range(12)]
    texts = []
    for words in base:
        for edits in (0, 0, 2, 5, 9, 14):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 999)}"
            texts.append(" ".join(copy))
    texts += [None, "", "two words", "three little words", "Three, little WORDS"]
    frame = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "s", 1)], "id long, content string, same string, a int")
    members, links = neardup.classes_and_links(frame, "id", "content", words=3, at_least=(3, 5))
    want = sorted((i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i], texts[j]) >= 0.6)
    assert rows(neardup.similar_pairs(members, links), "a", "b") == want
    groups = neardup.grouped(members, links).collect()
    degree = Counter(x for pair in want for x in pair)
    assert {r.id: r.links for r in groups} == {r.id: degree.get(r.id, 0) for r in groups}
    root = {r.id: r.group_id for r in groups}
    assert all(root[i] == root[j] for i, j in want)
    assert all(root[r.id] <= r.id for r in groups)


def test_neardup_empty_and_long(spark):
    schema = "id long, content string"
    members, links = neardup.classes_and_links(spark.createDataFrame([], schema), "id", "content")
    assert neardup.similar_pairs(members, links).count() == 0
    members, links = neardup.classes_and_links(spark.createDataFrame([(1, LONG), (2, LONG + "end"), (None, LONG)], schema), "id", "content", words=3, at_least=(3, 5))
    assert rows(neardup.similar_pairs(members, links), "a", "b") == [(1, 2)]


# ---------------------------------------------------------------- site lines


def test_site_lines(spark):
    pages = [(i, 1, f"Legal  NOTICE {i}\r\nown line {'x' * i}\n\nShare" if i < 6 else None, "k") for i in range(8)]
    pages += [pages[0], (100, None, "Share", "k"), (None, 1, "Share", "k"), (101, 2, "", "k"), (102, 2, LONG, "k")]
    frame = spark.createDataFrame(pages, "id long, site_id int, content string, keys string")
    found = sitelines.occurrences(*sitelines.repeated_lines(frame))
    assert rows(found, "page", "line_no") == sorted((i, n) for i in range(6) for n in (1, 4))
    _, often = sitelines.repeated_lines(frame)
    cleaned = {r.page: r.content for r in sitelines.without_repeated(frame, often).collect()}
    assert cleaned[1] == "own line x\n" and cleaned[7] is None and cleaned[100] == "Share" and cleaned[102] == LONG
    assert sitelines.occurrences(*sitelines.repeated_lines(frame.limit(0))).count() == 0


def test_republished_articles_are_one_cluster(spark):
    frame = spark.createDataFrame([(i, 1, "the same article\nagain") for i in range(6)], "id long, site_id int, content string")
    _, often = sitelines.repeated_lines(frame)
    assert {(r.pages, r.clusters) for r in often.collect()} == {(6, 1)}
    assert sitelines.repeated_lines(frame, at_least_clusters=2)[1].count() == 0


# ---------------------------------------------------------------- packing


def test_best_filling_is_the_best():
    rng = random.Random(5)
    for _ in range(200):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(0, 9)))
        target = rng.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        used = packing.best_filling(target, dict(counts))
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= target)
        assert all(n <= counts[x] for x, n in used.items())


def test_packed(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 1, 3, 7, 8, 12, 25])) for i in range(400)] + [(500, 1000), (500, 1000)]
    counts = spark.createDataFrame(sizes, "id long, tokens long")
    windows = spark.createDataFrame([(1, "s", 10), (2, "l", 64), (3, "none", None), (4, "bad", 0)], "window_id int, window_name string, capacity_tokens int")
    got = packing.packed(counts, windows).collect()
    for window, capacity in ((1, 10), (2, 64)):
        mine = [r for r in got if r.window_id == window]
        fill, total = Counter(), Counter()
        for r in mine:
            fill[r.container_id] += r.tokens
            total[r.id] += r.tokens
        assert dict(total) == {i: n for i, n in sizes}
        assert max(fill.values()) <= capacity and set(range(1, max(fill) + 1)) == {k for k, v in fill.items() if v}
        assert max(Counter(r.id for r in mine if r.id != 500 and total[r.id] <= capacity).values()) == 1
        assert sum(fill.values()) / (len([1 for v in fill.values() if v]) * capacity) > 0.8
    assert packing.packed(counts.limit(0), windows).count() == 0
    assert packing.packed(counts, windows.limit(0)).count() == 0


def test_many_of_one_length_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 20)
    counts = spark.range(300).select("id", F.lit(4).cast("long").alias("tokens"))
    got = packing.packed(counts, spark.createDataFrame([(1, 10)], "window_id int, capacity_tokens int"))
    assert {r["count"] for r in got.groupBy("container_id").count().collect()} == {2}


def test_token_counts(spark):
    frame = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (None, "x")], "doc_id long, text string")
    assert rows(packing.token_counts(frame), "id", "tokens") == [(1, 2), (2, 0), (3, 0)]


# ---------------------------------------------------------------- leaks


def leaked_by_hand(docs, items, n=12):
    out = set()
    for i, text in items:
        w = textform.words(textform.canonical(text or ""))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, other in docs:
            v = textform.words(textform.canonical(other or ""))
            if d is not None and any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return sorted(out)


@pytest.mark.parametrize("sent", [leaks.SENT, 0])
def test_leaks_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(leaks, "SENT", sent)
    rng = random.Random(2)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([8, 11, 12, 30, 60])))) for i in range(20)]
    docs = []
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(60)]
        passage = rng.choice(items)[1].split()
        n = rng.choice([5, 11, 12, 14, 40])
        start = rng.randrange(max(1, len(passage) - n + 1))
        at = rng.randrange(50)
        docs.append((d, " ".join(w[:at] + [x.upper() + "," for x in passage[start : start + n]] + w[at:])))
    docs += [(100, None), (101, ""), (102, items[3][1].replace("v", "ｖ")), (None, items[3][1]), (0, docs[0][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item int")
    q = spark.createDataFrame([*[(*x, 1) for x in items], (99, None, 1)], "item_id long, text string, doc int")
    got = leaks.leaked(d, q)
    assert rows(got.where("run >= 12"), "doc", "item") == leaked_by_hand(docs, items)
    assert leaks.leaked(d.limit(0), q).count() == 0 and leaks.leaked(d, q.limit(0)).count() == 0


def test_alignment():
    a, b = wordhash.word_hashes("a b c x d e f g"), wordhash.word_hashes("a b c d e f g")
    assert leaks.align(a, b) == (4, 7 * 2 - 1)


# ---------------------------------------------------------------- truncation


@pytest.mark.parametrize(
    "text, state",
    [
        ("A whole sentence. And another one.", "whole"),
        ("A whole sentence. And another on", "open"),
        ('"We painted it early', "cut"),
        ("Something … Read more", "cut"),
        ("An entity &am", "cut"),
        ("A tag <a href=", "cut"),
        ("A list item (open", "cut"),
        ("533 requests, greenhouse (muddy)", "whole"),
        ("© 2023 Somebody", "whole"),
        ("   ", "whole"),
    ],
)
def test_judge(text, state):
    assert truncation.judge(text)[0] == state


def test_truncated(spark):
    full = "How to trim a private crawler in Dundsior"
    body = "The crawler stays local for 197 visitors. It works.\nWhy the fox jumps over the lazy dog\n"
    data = [(i, 1, f"{full}\n{body}More text stands here, and ends.", full, full, None) for i in range(20)]
    data += [
        (50, 1, f"{full}\n{body}First sentence. Then it sto", full[:15], full, full),
        (51, 1, f"{full}\n{body}zzqqy", full + " - Site", full, None),
        (52, None, None, None, "", " "),
        (53, 1, LONG, full + "…", full, None),
        (53, 1, LONG, full + "…", full, None),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in data], "id long, site_id int, content string, title string, h1 string, og_title string, page string, site string")
    cut = rows(truncation.truncated(frame).where("cut"), "page", "field")
    assert (50, "content") in cut and (50, "title") in cut and (51, "content") in cut
    assert not [x for x in cut if x[0] < 50 or x == (51, "title") or x == (53, "title") or x[0] == 52]
    assert truncation.truncated(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- bodies and stuffing


def site(n=12):
    out = []
    for i in range(n):
        head = f"Why article number {'abcdefghijklmnop'[i]} matters to readers"
        content = [
            "Home | Search | About",
            head,
            f"Posted by staff on 2024-01-{i + 10}",
            f"The first paragraph of {head} is long. It has several sentences, as prose has. They end here.",
            "Advertisement",
            f"A second paragraph follows on topic {'qwertzuiopasdfgh'[i]}. It is prose as well. It also ends.",
            f"{i} comments so far. Log in to reply.",
            f"Somebody{'qwertzuiopasdfgh'[i]}: thanks for this!",
            "© 2024 Somewhere",
        ]
        out.append((i, "https://some.example/" + str(i), head, head, "\n".join(content)))
    return out


SITE = "id long, url string, title string, h1 string, content string, og_title string, kind string, token string"


def test_body(spark):
    pages = [(*r, None, "x", "y") for r in site()]
    pages += [pages[0], (90, None, None, None, None, None, "x", "y"), (91, None, None, None, "", None, "x", "y"), (92, None, None, None, LONG, None, "x", "y"), (None, None, None, None, "x", None, "x", "y")]
    frame = spark.createDataFrame(pages, SITE)
    found = {r.doc: list(r.body) for r in pagebody.bodies(pagebody.page_documents(frame)).collect()}
    assert all(found[str(i)] == [2, 4, 6] for i in range(12))
    assert "90" not in found and "91" not in found and found["92"] == [1]
    assert pagebody.bodies(pagebody.page_documents(frame.limit(0))).count() == 0


def test_body_of_markup(spark):
    jobs = []
    for i, url, _, head, content in site():
        lines = content.split("\n")
        html = ["<html><head><title>x</title>", "<script>var a=1;</script>", "</head><body>", f"<nav>{lines[0]}</nav>", f"<h1>{lines[1]}</h1>", f"<p>{lines[3]}</p>", '<p><a href="/x">Another page</a></p>', f"<div>{lines[6]} {lines[7]}</div>", "</body></html>"]
        jobs.append((f"j{i}", "WWW.some.example", "\n".join(html), None))
    frame = spark.createDataFrame(jobs, "job_id string, domain string, content string, title string")
    pages = spark.createDataFrame([(*r, None, "x", "y") for r in site()], SITE)
    both = pagebody.page_documents(pages).unionByName(pagebody.job_documents(frame))
    found = {r.doc: list(r.body) for r in pagebody.bodies(both).where("kind = 'crawl_jobs'").collect()}
    assert all(found[f"j{i}"] == [5, 6] for i in range(12))


def test_stuffed_pages(spark):
    rng = random.Random(4)
    noun = ["saddle", "shelf", "kettle", "museum"]
    key = lambda: " ".join(rng.choice(["cheap", "best", "buy", "sale"]) + " vohund " + rng.choice(noun) for _ in range(20))
    stuffed = [(100, key() + "\n" + key()), (101, " | ".join(f"{rng.choice(noun)} sale" for _ in range(60))), (102, " ".join("Our vohund saddle best: vohund saddle sale vohund saddle." for _ in range(12)))]
    glossary = [
        "Kettle: a vessel in which water is brought to the boil.",
        "Saddle: a seat that lets a rider stay on a horse for hours.",
        "Shelf: a flat board on which books and cups find their place.",
        "Museum: a house that keeps old things and shows them to visitors.",
        "Anvil: the block of iron upon which a smith shapes hot metal.",
        "Ledger: a book where every sum that was paid is written down.",
        "Trail: a narrow way through woods, made by many feet.",
    ]
    fine = [(103, "\n".join(glossary))]
    pages = [(*r, None, "x", "y") for r in site()] + [(i, f"https://some.example/{i}", f"A headline of page {i}", None, f"A headline of page {i}\n{t}", None, "x", "y") for i, t in stuffed + fine]
    found = {int(r.doc): r.stuffing for r in pagebody.bodies(pagebody.page_documents(spark.createDataFrame(pages, SITE))).collect()}
    assert {i for i, s in found.items() if s > pagebody.STUFFED} == {100, 101, 102}
