"""Problem 2: cap the records of dominant contributors by parallel bisection of their score ranges."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import staged

LOWEST = -(1 << 63)


def score_key(score: Column) -> Column:
    """A long that orders as the double does; null and NaN take the lowest value, -0.0 equals 0.0."""
    known = score.isNotNull() & ~F.isnan(score)
    bits = F.java_method(
        F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.when(known, score + F.lit(0.0)).otherwise(F.lit(0.0))
    ).cast("long")
    ordered = F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    return F.when(known, ordered).otherwise(F.lit(LOWEST))


def cutoffs(rows: DataFrame, need: DataFrame) -> DataFrame:
    """For each contributor c the key of its need-th largest row: (c, cut, left, at).

    rows: (c, key), need: (c, need) with 1 <= need < number of rows of c. All rows above cut are kept, and left of the at
    rows that equal it. Each round halves every open contributor's bounds 16 times at once: rows are counted between all
    2^16 - 1 midpoints together, the interval holding the need-th row becomes the new bounds, and only its rows are read
    on. A contributor is done when its interval holds one value, or is kept whole.
    """
    open_rows = rows.join(need, "c").withColumn("u", F.col("key").bitwiseXOR(F.lit(LOWEST)))
    done = None
    for shift in range(48, -16, -16):
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(0xFFFF))
        above = Window.partitionBy("c").orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, -1)
        counts = (
            open_rows.groupBy("c", "need", digit.alias("digit"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
            .withColumn("left", F.col("need") - F.coalesce(F.sum("n").over(above), F.lit(0)))
            .where("left > 0 and left <= n")
        )
        counts = staged(counts)
        final = counts.where("low = high or left = n").select("c", F.col("low").alias("cut"), "left", F.col("n").alias("at"))
        done = final if done is None else done.unionByName(final)
        narrowed = counts.where("low <> high and left < n").select("c", "digit", F.col("left").alias("next"))
        if narrowed.isEmpty():
            return done
        open_rows = staged(
            open_rows.withColumn("digit", digit)
            .join(narrowed, ["c", "digit"])
            .select("c", "key", "u", F.col("next").alias("need"))
        )
    return done


def over_cap(
    records: DataFrame,
    contributor: str = "site_id",
    record_id: str = "id",
    score: str = "pagerank_score",
    share: str = "0.01",
    least: int = 5,
) -> DataFrame:
    """The records beyond their contributor's limit: (contributor, record_id).

    The limit is share of the number of distinct ids in the whole table, rounded down, but at least `least`. A
    contributor keeps its records with the highest score; null and NaN rank below every number, equal scores rank by
    the smaller id. Repeated rows of an id count once; rows without id are left out; records without contributor count
    in the total and are never returned. An empty table gives no rows. Columns besides the three named are ignored.
    """
    r = staged(
        records.where(F.col(record_id).isNotNull())
        .select(F.col(contributor).alias("c"), F.col(record_id).alias("id"), score_key(F.col(score).cast("double")).alias("key"))
        .dropDuplicates(["id"])
    )
    sizes = staged(r.groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limit = max(least, int(Fraction(share) * total))
    need = sizes.where(F.col("c").isNotNull() & (F.col("n") > limit)).select("c", F.lit(limit).cast("long").alias("need"))
    big = staged(r.join(need, "c"))
    cuts = staged(cutoffs(big.select("c", "key"), need))

    ties = cuts.where("left < at").select("c", "cut", F.col("left").alias("need"))
    tied = staged(big.drop("need").join(ties, "c").where("key = cut").select("c", F.bitwise_not("id").alias("key")))
    last = cutoffs(tied, ties.select("c", "need")).select("c", F.bitwise_not("cut").alias("last_id"))
    beyond = (F.col("key") < F.col("cut")) | ((F.col("key") == F.col("cut")) & (F.col("id") > F.col("last_id")))
    return (
        big.join(cuts.select("c", "cut").join(last, "c", "left"), "c")
        .where(beyond)
        .select(F.col("c").alias(contributor), F.col("id").alias(record_id))
    )


def capped(records: DataFrame, contributor: str = "site_id", record_id: str = "id", score: str = "pagerank_score", **limits) -> DataFrame:
    """The records that stay: all rows whose id is not over its contributor's cap, once per id."""
    gone = over_cap(records, contributor, record_id, score, **limits).select(F.col(record_id).alias("__gone"))
    kept = records.where(F.col(record_id).isNotNull()).dropDuplicates([record_id])
    return kept.join(gone, kept[record_id] == gone["__gone"], "left_anti")
