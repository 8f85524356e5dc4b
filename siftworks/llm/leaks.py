"""Problem 9: evaluation texts in a corpus, by rare n-gram seeds and Smith-Waterman alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import spread, staged
from .textform import folded
from .wordhash import U, grams, word_hashes

#: Words of a seed, and of the shortest passage that must be found for certain.
SEED, PASSAGE = 5, 12
#: Distinct seeds of the test items that are sent to every task (16 MB); more are joined instead.
SENT = 2_000_000
#: Bytes of the items' words that are sent to every task for the alignment; more are joined to the documents instead.
SENT_BYTES = 64 << 20
MATCH, MISMATCH, GAP = 2, 1, 1
#: Cells of the sequences that are aligned at once: a row of them stays in the cache.
CELLS = 1 << 15


def form_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, whatever look-alikes it is written with."""
    return word_hashes(folded(text))


@F.pandas_udf(T.BinaryType())
def _item_words(text: pd.Series) -> pd.Series:
    return text.map(lambda x: form_hashes(x).tobytes())


@F.pandas_udf(T.ArrayType(T.LongType()))
def _grams(words: pd.Series) -> pd.Series:
    return words.map(lambda x: grams(np.frombuffer(x, U), SEED).view(np.int64))


def _hits(wanted: np.ndarray | None):
    """Rows (doc, gram) for every distinct n-gram of a document, of those wanted if given."""

    def run(batches):
        for batch in batches:
            docs, found = [], []
            for doc, text in zip(batch["doc"], batch["text"]):
                g = np.unique(grams(form_hashes(text), SEED).view(np.int64))
                if wanted is not None and len(g):
                    g = g[wanted[np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)] == g]
                if len(g):
                    docs.append(np.full(len(g), doc))
                    found.append(g)
            if docs:
                yield pd.DataFrame({"doc": np.concatenate(docs), "gram": np.concatenate(found)})

    return run


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(longest common run of words, best Smith-Waterman score) of two word sequences."""
    longest, best = align_many([doc], item)
    return int(longest[0]), int(best[0])


def align_many(docs: list[np.ndarray], item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest common runs and best Smith-Waterman scores of word sequences with one item.

    Row by row over the item, all sequences at once; the gap along a sequence is a running maximum. Sequences are filled
    up with words that the item does not have.
    """
    words, codes = np.unique(item, return_inverse=True)
    grid = np.full((len(docs), max(map(len, docs))), -1, np.int32)
    for row, doc in zip(grid, docs):
        at = np.minimum(np.searchsorted(words, doc), len(words) - 1)
        row[: len(doc)] = np.where(words[at] == doc, at, -1)
    count, width = grid.shape
    along = (np.arange(width) * GAP).astype(np.int32)
    score, run = np.zeros((count, width + 1), np.int32), np.zeros((count, width + 1), np.int32)
    best, longest = np.zeros(count, np.int32), np.zeros(count, np.int32)
    for word in codes.astype(np.int32):
        same = (grid == word).astype(np.int32)
        run[:, 1:] = (run[:, :-1] + 1) * same
        cell = np.maximum(score[:, :-1] + same * np.int32(MATCH + MISMATCH) - np.int32(MISMATCH), score[:, 1:] - np.int32(GAP))
        cell = np.maximum(cell, 0)
        cell = np.maximum(cell, np.maximum.accumulate(cell + along, axis=1) - along)
        score[:, 1:] = cell
        best, longest = np.maximum(best, cell.max(axis=1)), np.maximum(longest, run.max(axis=1))
    return longest, best


def _near(doc: np.ndarray, seeds: np.ndarray, wanted: np.ndarray, reach: int) -> list[np.ndarray]:
    """The stretches of a document around its n-grams that are wanted (sorted); no alignment with a seed leaves them."""
    at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, seeds), len(wanted) - 1)] == seeds)
    out, begin, end = [], None, None
    for p in at:
        if end is not None and p - reach <= end:
            end = p + reach
        else:
            if end is not None:
                out.append(doc[begin:end])
            begin, end = max(0, p - reach), p + reach
    if end is not None:
        out.append(doc[begin:end])
    return out


def _aligned(sent):
    def run(batches):
        yield from _alignments(batches, sent.value if sent else None)

    return run


def _alignments(batches, known: dict[int, bytes] | None):
    """Align every document with its items: ids of known ones, or structs of id and words."""
    for batch in batches:
        rows, parts, seeds = [], {}, {}
        for doc, text, items in zip(batch["doc"], batch["text"], batch["items"]):
            words = form_hashes(text)
            own = grams(words, SEED)
            for one in items:
                number, key = (one, known[one]) if known is not None else (one["item"], one["words"])
                item = np.frombuffer(key, U)
                if key not in seeds:
                    seeds[key] = np.unique(grams(item, SEED))
                parts.setdefault(key, []).extend((len(rows), part) for part in _near(words, own, seeds[key], 2 * len(item)))
                rows.append((doc, number, len(item)))
        best, longest = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for key, some in parts.items():
            some.sort(key=lambda x: len(x[1]))  # equal lengths need little filling
            while some:
                n = max(1, min(len(some), CELLS // len(some[-1][1])))
                at, docs = zip(*some[-n:])
                del some[-n:]
                run, score = align_many(list(docs), np.frombuffer(key, U))
                np.maximum.at(longest, list(at), run)
                np.maximum.at(best, list(at), score)
        doc, item, length = zip(*rows) if rows else ((), (), ())
        yield pd.DataFrame({"doc": doc, "item": item, "run": longest, "score": best, "share": best / (MATCH * np.array(length, float))})


def _passage_seeds(hits: DataFrame, at: DataFrame) -> DataFrame:
    """(item, gram): the rarest seed of each window of PASSAGE words, if all its seeds occur in the corpus."""
    known = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
    ends = at.groupBy("item").agg((F.max("pos") + SEED - PASSAGE).alias("last"))
    window = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - (PASSAGE - SEED)), F.least("pos", "last")))
    return (
        at.join(known, "gram", "left")
        .join(ends.where("last >= 0"), "item")
        .where(F.col("pos") - (PASSAGE - SEED) <= F.col("last"))
        .select("item", window.alias("window"), rank.alias("seed"))
        .groupBy("item", "window")
        .agg(F.min("seed").alias("seed"))
        .where("seed.n > 0")
        .select("item", F.col("seed.gram").alias("gram"))
        .distinct()
    )


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", edited: bool = False) -> DataFrame:
    """(doc, item, run, score, share): documents that share a seed with an item, aligned with it.

    run is the longest unbroken run of common words, score that of the local alignment (2 a match, -1 a mismatch or a
    gap) and share its part of the item's own score. Texts are compared word by word in canonical form. Every run of
    PASSAGE words is found: of the seeds in each window of that many words of an item, the one that is rarest in the
    corpus is looked up. Items of fewer words have no window and are never found. A copy with edits may lack just that
    seed, or any window that is whole: with `edited` every document that shares any seed is aligned. Rows with a null id or text are left
    out, repeated rows count once, and an empty table on either side gives no rows.
    """
    d = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    q = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text"))
    q = staged(q.select("item", _item_words("text").alias("words")).distinct())
    at = staged(q.select("item", F.posexplode(_grams("words")).alias("pos", "gram")))
    wanted = at.select("gram").distinct()
    if wanted.count() <= SENT:
        keep = np.sort(wanted.toPandas()["gram"].to_numpy(dtype=np.int64))
        found = spread(d).mapInPandas(_hits(keep), "doc long, gram long") if len(keep) else d.select("doc", F.lit(0).cast("long").alias("gram")).limit(0)
    else:
        found = spread(d).mapInPandas(_hits(None), "doc long, gram long").join(wanted, "gram", "left_semi")
    hits = staged(found)

    seeds = at.select("item", "gram").distinct() if edited else _passage_seeds(hits, at)
    pairs = hits.join(seeds, "gram").select("doc", "item").distinct()
    size = q.agg(F.sum(F.length("words")).alias("bytes"), F.count_distinct("item").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    small = (size["bytes"] or 0) <= SENT_BYTES and size["n"] == size["rows"]
    sent = docs.sparkSession.sparkContext.broadcast({r["item"]: bytes(r["words"]) for r in q.collect()}) if small else None
    items_of = pairs.select("doc", F.col("item").alias("one")) if small else pairs.join(q, "item").select("doc", F.struct("item", "words").alias("one"))
    per_doc = staged(items_of.groupBy("doc").agg(F.collect_list("one").alias("items")))
    return (
        d.join(per_doc, "doc")
        .mapInPandas(_aligned(sent), "doc long, item long, run int, score int, share double")
        .dropDuplicates(["doc", "item"])
    )
