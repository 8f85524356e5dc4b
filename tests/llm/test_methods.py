"""Each method decides: without its vectors, shapes, stack or dates the results here would differ."""

import random

import pytest
from pyspark.sql import functions as F

from siftworks.llm import leaks, packing, pagebody, sitelines, textform, truncation

PAGES = "id long, url string, title string, h1 string, content string, og_title string"


def prose(rng, n=1):
    noun = lambda: rng.choice("saddle shelf kettle museum ledger anvil harbour trail engine orchard".split()) + "".join(rng.choice("abcdefgh") for _ in range(4))
    return " ".join(f"The {noun()} near the {noun()} was painted by {noun()} before the {noun()} came to {noun()}." for _ in range(2 * n))


def page(i, head, lines, rng, before=("Home", "Search", "About us"), behind=("Follow us every day", "© Somewhere")):
    return (i, f"https://some.example/{i}", head, head, "\n".join([*before, head, *lines, *behind]), None)


def bodies(spark, pages):
    found = pagebody.bodies(pagebody.page_documents(spark.createDataFrame(pages, PAGES)))
    return {int(r.doc): r for r in found.collect()}


def test_an_article_given_out_by_several_pages_is_no_template(spark):
    rng = random.Random(1)
    pages = [page(i, f"Headline of page {'abcdefghijklmnop'[i]} here", [prose(rng), prose(rng)], rng) for i in range(12)]
    shared = ["A list item of the article", prose(rng), "- another item", prose(rng), prose(rng)]
    pages += [page(20 + k, f"Same article, headline {'xyzv'[k]}", [*shared, prose(rng)], rng) for k in range(4)]
    found = bodies(spark, pages)
    assert all(list(found[20 + k].body) == [4, 5, 6, 7, 8, 9, 10] for k in range(4))
    assert all(list(found[i].body) == [4, 5, 6] for i in range(12))


def test_one_vector_makes_the_article_not_single_paragraphs(spark):
    """A notice of several sentences is on some pages each; no two of its lines share a vector, so pages stay apart."""
    rng = random.Random(2)
    notice = "This site stores small files on your device so that we can count visits and remember your basket. You may refuse them at any time."
    pages = [page(i, f"Headline of page {'abcdefghijklmnop'[i]} here", [prose(rng)] + [notice] * (i % 3 > 0) + [prose(rng)], rng) for i in range(12)]
    found = bodies(spark, pages)
    assert all(list(found[i].body) == ([4, 5, 7] if i % 3 else [4, 5, 6]) for i in range(12))


def test_order_decides_on_weak_classes(spark):
    """Three of 120 pages share two lines: template where they keep their order, body where they change it."""
    rng = random.Random(3)
    head = lambda i: "Headline " + "".join(chr(97 + int(c)) for c in str(1000 + i))
    pages = [page(i, head(i), [prose(rng), prose(rng)], rng) for i in range(120)]
    same = ["One small label", "Other small label"]
    for i in (3, 50, 90):
        pages[i] = page(i, head(i), [prose(rng), *same, prose(rng)], rng)
    for i, turned in ((5, False), (60, True), (99, False)):
        lines = ["First turning label", "Second turning label"]
        pages[i] = page(i, head(i), [prose(rng), *(lines[::-1] if turned else lines), prose(rng)], rng)
    found = bodies(spark, pages)
    assert all(list(found[i].body) == [4, 5, 8] for i in (3, 50, 90))
    assert all(list(found[i].body) == [4, 5, 6, 7, 8] for i in (5, 60, 99))


def test_labels_with_changing_names(spark):
    rng = random.Random(4)
    pages = [page(i, f"Headline of page {'abcdefghijklmnop'[i]} here", [prose(rng), f"Share this on {'QWERTZUIOPAS'[i]}xample", prose(rng)], rng) for i in range(10)]
    found = bodies(spark, pages)
    assert all(list(found[i].body) == [4, 5, 7] for i in range(10))


def test_shapes_tell_lists_from_stuffing(spark):
    """Equal parts of words outside sentences: many shapes of one kind on a page without prose, few each in articles."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    pages = []
    for i in range(40):
        items = [f"{word()} {word()} {word()} {word()}" for _ in range(6)]
        pages.append(page(i, f"Article {word()}", [prose(rng), *items, prose(rng)], rng))
    for i in range(100, 106):
        pages.append(page(i, f"Page {word()}", [f"{word()} {word()} {word()} {word()}" for _ in range(40)], rng))
    short = [f"{word()} {word()} {word()} {word()}" for _ in range(5)]
    pages.append(page(200, "A page of few lines", short, rng))  # as short lists of articles are
    found = bodies(spark, pages)
    assert {i for i, r in found.items() if r.stuffing > pagebody.STUFFED} == set(range(100, 106))


@pytest.mark.parametrize(
    "text, what",
    [
        ("He said (this was\nnot closed at all.", "unclosed"),
        ("“An opening quote\nand the rest of it", "unclosed"),
        ('He said "this"\nand "that" too', None),
        ("A <b>bold end", "unclosed"),
        ("A <b>bold</b> end<br>", None),
        ("<kettle> and <saddle> are products", None),
        ("see <a href='x", "broken"),
        ("ends &am", "broken"),
        ("ends \\u00e", "broken"),
        ("half �", "broken"),
        ("up 50%", None),
        ("1) one\n2) two", None),
        ('a 6" pipe', None),
        ("", None),
    ],
)
def test_automaton_over_the_whole_value(text, what):
    assert truncation.unfinished(text)[0] == what


def test_a_source_name_added_to_headlines_is_whole(spark):
    names = "kettle saddle ledger museum harbour anvil trail shelf".split()
    data = [(i, 1, None, f"How to paint a {n} | Somewhere", f"How to paint a {n}", None) for i, n in enumerate(names)]
    data += [(50, 1, None, "How to rent an orchard | Somewhe", "How to rent an orchard", None), (51, 1, None, "Why we sell tents | Some", "Why we sell tents", None)]
    data += [(60 + i, 1, None, f"How to rent the {n} {'x' * (11 - len(n))}| Some", f"How to rent the {n} {'x' * (11 - len(n))}", None) for i, n in enumerate(names)]
    frame = spark.createDataFrame(data, "id long, site_id int, content string, title string, h1 string, og_title string")
    cut = {r.page for r in truncation.truncated(frame).where("cut").collect()}
    assert not cut & set(range(8))


@pytest.mark.parametrize(
    "text, form",
    [
        ("データ ガイド トロリー", "データ ガイド トロリー"),
        ("デ一夕", "データ"),
        ("カナダへ行く工場", "カナダへ行く工場"),
        ("Привет, мир", "Привет, мир"),
        ("Пpивeт, миp", "Привет, мир"),
        ("Νέα Υόρκη, ο κόσμος", "Νέα Υόρκη, ο κόσμος"),
        ("pаypal сор", "paypal cop"),
        ("ｆｕｌｌ　ﬁne​ café", "full fine café"),
        ("ışık ağaç", "ışık ağaç"),
        ("", ""),
    ],
)
def test_canonical_text_keeps_scripts(text, form):
    assert textform.canonical(text) == form
    assert textform.canonical(form) == form and textform.skeleton(form) == textform.skeleton(text)
    assert "゙" not in textform.canonical(text)


def test_republished_articles_survive_cleaning(spark):
    article = "The same article is here.\nIt has two lines."
    rows = [(i, 1, article + "\nLegal notice", f"2024-01-0{i + 1}") for i in range(6)]
    rows += [(10 + i, 1, f"Own text {'abcdef'[i]}\nLegal notice", f"2024-02-0{i + 1}") for i in range(6)]
    pages = spark.createDataFrame(rows, "id long, site_id int, content string, day string").withColumn("day", F.to_timestamp("day"))
    often = sitelines.repeated_lines(pages, date=F.col("day"), at_least_clusters=5, at_least_dates=2)[1]
    cleaned = {r.page: r.content for r in sitelines.without_repeated(pages, often).collect()}
    assert all(cleaned[i] == article for i in range(6)) and cleaned[10] == "Own text a"
    undated = sitelines.repeated_lines(pages.withColumn("day", F.lit(None).cast("timestamp")), date=F.col("day"), at_least_clusters=5, at_least_dates=2)[1]
    assert undated.count() == 1


@pytest.mark.parametrize("sent_bytes", [leaks.SENT_BYTES, 0])
def test_recall_of_edited_copies(spark, monkeypatch, sent_bytes):
    """Copies with a sixth of their words replaced, dropped or inserted at random: at least nine in ten come out."""
    monkeypatch.setattr(leaks, "SENT_BYTES", sent_bytes)
    rng = random.Random(6)
    items = [(i, [f"i{i}w{rng.randrange(40)}" for _ in range(rng.randrange(20, 60))]) for i in range(30)]
    docs, true = [], set()
    for d in range(300):
        i, words = items[d % 30]
        copy = []
        for w in words:
            edit = rng.random()
            copy += [w] if edit > 1 / 6 else [f"n{rng.random()}"] if edit > 1 / 9 else [w, f"n{rng.random()}"] if edit > 1 / 18 else []
        docs.append((d, " ".join([f"b{rng.random()}" for _ in range(30)] + copy)))
        true.add((d, i))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(r.doc, r.item): r.share for r in leaks.leaked(d, q, edited=True).collect()}
    assert set(found) <= true and len(found) >= 0.9 * len(true)
    assert sum(s >= 0.5 for s in found.values()) >= 0.9 * len(found)


def test_a_long_plan_is_joined(spark, monkeypatch):
    rng = random.Random(7)
    counts = spark.createDataFrame([(i, rng.randrange(0, 90)) for i in range(300)], "id long, tokens long")
    windows = spark.createDataFrame([(1, 100), (2, 37)], "window_id int, capacity_tokens int")
    key = lambda frame: sorted(tuple(r) for r in frame.collect())
    sent = key(packing.packed(counts, windows))
    monkeypatch.setattr(packing, "SENT_ROWS", 0)
    assert key(packing.packed(counts, windows)) == sent
