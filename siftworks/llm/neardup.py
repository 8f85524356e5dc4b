"""Problem 3: near-duplicates by pigeonhole blocks of a fingerprint, Hamming distance, and an exact check."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread, staged
from .wordhash import U, grams, mixed, word_hashes

#: The fingerprint has BLOCKS blocks of WIDTH symbols; a symbol is the minimum of one permutation of the shingles.
BLOCKS, WIDTH = 82, 5
SYMBOLS = BLOCKS * WIDTH
_multipliers = mixed(np.arange(1, SYMBOLS // 2 + 1, dtype=U)) | U(1)
#: Symbols compared for the Hamming distance, and the share of them that must agree to go on to the exact check. With
#: 256 symbols and a similarity of 0.6 the share falls below 0.46 in about one of 500,000 pairs.
COMPARED, AGREE = 256, 0.46


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return np.unique(grams(word_hashes(text), n))


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS minima of 32 bits: every product with a multiplier serves two permutations, its halves."""
    least = None
    for at in range(0, len(shingles), 1024):  # the products of a part stay in the cache
        part = (shingles[at : at + 1024][:, None] * _multipliers).view(np.uint32).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def block_keys(prints: np.ndarray) -> np.ndarray:
    """One 64-bit value per block of symbols, for fingerprints one below the other."""
    keys = np.tile(mixed(np.arange(BLOCKS, dtype=U)), (len(prints), 1))
    for column in range(WIDTH):
        keys = mixed(keys + prints[:, column::WIDTH])
    return keys


def _featured(n: int):
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows, prints = [], []
                for key, text in zip(batch["id"][at : at + 500], batch["text"][at : at + 500]):
                    s = shingle_set(text, n)
                    if len(s):
                        rows.append((key, xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)))
                        prints.append(fingerprint(s))
                if rows:
                    f = np.stack(prints)
                    out = pd.DataFrame(rows, columns=["id", "same"])
                    out["print"] = [x.tobytes() for x in f[:, :COMPARED].astype(np.uint8)]
                    out["blocks"] = list(block_keys(f).view(np.int64))
                    yield out

    return run


def _agreeing(pairs):
    for batch in pairs:
        if len(batch):
            a = np.frombuffer(b"".join(batch["print_a"]), np.uint8).reshape(-1, COMPARED)
            b = np.frombuffer(b"".join(batch["print_b"]), np.uint8).reshape(-1, COMPARED)
            distance = (a != b).sum(axis=1)
            yield batch.loc[distance <= (1 - AGREE) * COMPARED, ["a", "b"]]


def _shingled(n: int):
    @F.pandas_udf("binary")
    def shingles(text: pd.Series) -> pd.Series:
        return text.map(lambda x: shingle_set(x, n).tobytes())

    return shingles


def _similar(numerator: int, denominator: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * denominator >= numerator * (len(x) + len(y) - common))
            yield batch.loc[keep, ["a", "b"]]

    return run


def classes_and_links(records: DataFrame, id_col: str, text_col: str, words: int = 5, at_least: tuple[int, int] = (4, 5)) -> tuple[DataFrame, DataFrame]:
    """(id, same) and (a, b): the class of every record with enough words, and the links between different classes.

    A class holds the records with equal sets of shingles of `words` words, and is named by a hash of the set. Two
    classes are linked if their sets have a Jaccard similarity of at_least (a fraction). Records without id or with fewer
    words than a shingle are in no class; repeated rows count once; an empty table gives no rows.

    Per class, found on one of its records: a fingerprint of 410 symbols in 82 blocks of five. Fingerprints that differ in fewer than 82 symbols
    share a block for certain, pairs of similarity 0.6 do in 99.9 % of cases. Classes are joined on their blocks, pairs
    go on by the Hamming distance of their fingerprints, and those are checked on the shingles themselves.
    """
    known = records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    texts = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(texts.dtypes)["id"]
    features = staged(spread(texts).mapInPandas(_featured(words), f"id {kind}, same long, print binary, blocks array<long>"))
    members = staged(features.select("id", "same").distinct())
    first = members.groupBy("same").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = staged(members.join(first, "same").where("id <> first").select("id"))
    features = features.join(copies, "id", "left_anti")

    keyed = features.select(F.explode("blocks").alias("block"), "same")
    other = keyed.select("block", F.col("same").alias("b"))
    met = keyed.withColumnRenamed("same", "a").join(other, "block").where("a < b").select("a", "b").distinct()
    prints = features.select("same", "print").dropDuplicates(["same"])
    near = (
        met.join(prints.select(F.col("same").alias("a"), F.col("print").alias("print_a")), "a")
        .join(prints.select(F.col("same").alias("b"), F.col("print").alias("print_b")), "b")
        .mapInPandas(_agreeing, "a long, b long")
    )
    near = staged(near)

    # one record stands for each class that needs the exact check; only its text is read again
    wanted = near.select(F.col("a").alias("same")).union(near.select(F.col("b").alias("same"))).distinct()
    stand_in = staged(members.join(wanted, "same").groupBy("same").agg(F.min("id").alias("id")))
    sets = texts.join(stand_in, "id").dropDuplicates(["same"]).select("same", _shingled(words)("text").alias("set"))
    sets = staged(sets)
    links = (
        near.join(sets.select(F.col("same").alias("a"), F.col("set").alias("x")), "a")
        .join(sets.select(F.col("same").alias("b"), F.col("set").alias("y")), "b")
        .mapInPandas(_similar(*at_least), "a long, b long")
    )
    return members, staged(links)


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of record ids, within a class and between linked classes.

    The members of a class are spread by the ids they are joined to, so that the work is that of the result.
    """
    left = members.withColumnRenamed("id", "a")
    right = members.withColumnRenamed("id", "b")
    within = left.join(right, "same").where("a < b").select("a", "b")
    across = (
        links.select(F.col("a").alias("same"), F.col("b").alias("far"))
        .join(left, "same")
        .join(right.withColumnRenamed("same", "far"), "far")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    return within.unionByName(across)


def grouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, same, links, group_id): one row per record; group_id is the smallest id of its connected component.

    links is the number of other records it is similar to. Components spread their least class name along the links,
    with pointers halved after every step; each step is written to the shared folder.
    """
    sizes = staged(members.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")))
    edges = staged(links.union(links.select("b", "a")).toDF("a", "b"))
    label = staged(edges.select("a").distinct().withColumn("root", F.col("a")))
    while True:
        heard = edges.join(label.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(heard, "a").select("a", "root", F.least("root", "near").alias("to"))
        jump = label.select(F.col("a").alias("to"), F.col("root").alias("far"))
        step = staged(step.join(jump, "to", "left").select("a", "root", F.least("to", F.coalesce("far", "to")).alias("next")))
        moved = not step.where("root <> next").isEmpty()
        label = step.select("a", F.col("next").alias("root"))
        if not moved:
            break
    degree = edges.join(sizes.select(F.col("same").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("across"))
    named = (
        sizes.join(label.withColumnRenamed("a", "same"), "same", "left")
        .join(degree.withColumnRenamed("a", "same"), "same", "left")
        .withColumn("root", F.coalesce("root", "same"))
    )
    heads = named.groupBy("root").agg(F.min("least").alias("group_id"))
    per_class = named.join(heads, "root").select("same", (F.col("n") - 1 + F.coalesce("across", F.lit(0))).alias("links"), "group_id")
    return members.join(per_class, "same").select("id", "same", "links", "group_id")
