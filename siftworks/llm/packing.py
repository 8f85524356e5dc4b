"""Problem 8: texts into containers of fixed capacity by minimum bin slack."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import spread, staged

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Rows that one task numbers at most, on average, where many texts have one length.
NUMBERED = 500_000
#: Capacities packed in one call; they are listed in the plan. More are an error.
WINDOWS = 100
#: Rows of the plan that are sent to every task (24 bytes each); a longer plan is joined to the pieces instead.
SENT_ROWS = 1_000_000


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens): tokens of each whole text under a public byte-pair vocabulary; 0 for a null or empty text."""

    def run(batches):
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "tokens": [len(encode(x)) if x else 0 for x in batch["text"]]})

    rows = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return spread(rows).mapInPandas(run, f"id {kind}, tokens long")


def best_filling(target: int, counts: dict[int, int]) -> dict[int, int]:
    """Lengths, with how many of each, whose sum comes closest to target from below.

    Bit s of `reached` says that sum s can be made. The state before each length is kept, and from the best sum we go
    back through these states, taking as few of each length as lead to a sum that was reached before it.
    """
    reached, mask, before = 1, (1 << (target + 1)) - 1, []
    for length in sorted((x for x in counts if x <= target), reverse=True):
        before.append((length, reached))
        left, part = min(counts[length], target // length), 1
        while left:
            take = min(part, left)
            reached |= (reached << (take * length)) & mask
            left, part = left - take, part * 2
        if reached >> target & 1:
            break
    at, used = reached.bit_length() - 1, {}
    for length, state in reversed(before):
        n = 0
        while not state >> at & 1:
            at, n = at - length, n + 1
        if n:
            used[length] = n
    return used


def minimum_slack(capacity: int, counts: dict[int, int]) -> list[tuple[int, dict[int, int]]]:
    """[(containers, lengths with how many of each in one container)] that use up all counts.

    Each window is opened by the longest remaining length and filled as closely as possible; the filling is repeated as
    often as the counts allow. The work depends on the capacity, not on how many texts there are.
    """
    left = {length: n for length, n in counts.items() if n}
    plan = []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = best_filling(capacity - longest, {x: n for x, n in left.items() if n})
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[length] // n for length, n in used.items())
        plan.append((times, used))
        for length, n in used.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
    return plan


PLAN = "window_id int, len int, first long, per long, container long, times long"


def _planned(group: pd.DataFrame) -> pd.DataFrame:
    window, capacity = int(group["window_id"].iloc[0]), int(group["capacity"].iloc[0])
    seen: dict[int, int] = {}
    rows, container = [], 1
    for times, used in minimum_slack(capacity, dict(zip(group["len"].tolist(), group["n"].tolist()))):
        for length, n in used.items():
            rows.append((window, length, seen.get(length, 0), n, container, times))
            seen[length] = seen.get(length, 0) + n * times
        container += times
    return pd.DataFrame(rows, columns=["window_id", "len", "first", "per", "container", "times"])


def packed(counts: DataFrame, windows: DataFrame, window_id: str = "window_id", capacity: str = "capacity_tokens") -> DataFrame:
    """(window_id, id, piece_no, tokens, container_id): the container of every piece, for every capacity.

    counts: (id, tokens). A text is split only if it exceeds the capacity: into pieces of the full capacity, each with a
    container of its own, and a rest. Only the histogram of piece lengths is planned in one task per capacity and sent to all:
    it has at most `capacity` rows however many texts there are; the pieces of one length are then numbered in parallel, in parts of bounded size, and a
    number decides the container. Containers count from 1 in each window. A text without tokens needs no room: it is put
    into one of the containers by a hash of its id, or container 1 where there is none. Repeated rows are packed once;
    capacities that are null or below 1 are left out; no capacities or no texts give no rows.
    """
    sizes = windows.select(F.col(window_id).cast("int"), F.col(capacity).cast("int")).distinct().limit(WINDOWS + 1).collect()
    if len(sizes) > WINDOWS:
        raise ValueError(f"more than {WINDOWS} capacities")
    sizes = sorted((w, c) for w, c in sizes if w is not None and c is not None and c > 0)
    listed = F.array(*[F.struct(F.lit(w).alias("window_id"), F.lit(c).alias("capacity")) for w, c in sizes])
    if not sizes:
        listed = listed.cast("array<struct<window_id: int, capacity: int>>")
    texts = counts.dropDuplicates(["id"]).select("id", "tokens", F.explode(listed).alias("w")).select("id", "tokens", "w.*")
    last = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)).cast("long")
    pieces = texts.withColumn("piece_no", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    length = F.least(F.col("tokens") - (F.col("piece_no") - 1) * F.col("capacity"), F.col("capacity")).cast("int")
    pieces = staged(pieces.select("window_id", "id", "piece_no", length.alias("len"), "capacity"))

    histogram = staged(pieces.groupBy("window_id", "capacity", "len").agg(F.count(F.lit(1)).alias("n")))
    steps = staged(histogram.where("len > 0").groupBy("window_id").applyInPandas(_planned, PLAN))
    ends = steps.groupBy("window_id").agg(F.max(F.col("container") + F.col("times") - 1).alias("last"), F.count(F.lit(1)).alias("rows")).collect()
    total = {r["window_id"]: r["last"] for r in ends}
    listed_plan = steps.groupBy("window_id", "len").agg(F.array_sort(F.collect_list(F.struct("first", "per", "container"))).alias("steps"))
    joined = sum(r["rows"] for r in ends) > SENT_ROWS
    plan = None
    if not joined:
        rows = steps.toPandas().sort_values(["window_id", "len", "first"])
        plan = {key: tuple(g[x].to_numpy() for x in ("first", "per", "container")) for key, g in rows.groupby(["window_id", "len"])}
    sent = pieces.sparkSession.sparkContext.broadcast((plan, total))

    # numbers within one length: a part's rows are numbered on their own, after all rows of the parts before it
    most = histogram.agg(F.max("n")).first()[0] or 0
    parts = 1 + most // NUMBERED
    split = pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece_no"), F.lit(parts)))
    group = ["window_id", "len", "part"]
    before = Window.partitionBy("window_id", "len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy(group).orderBy("id", "piece_no"))
    numbered = split.withColumn("place", place).join(offsets, group)
    number = F.when(F.col("len") > 0, F.col("offset") + F.col("place") - 1).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    kind = dict(pieces.dtypes)["id"]
    numbered = numbered.select("window_id", "id", "piece_no", "len", number.alias("number"))
    numbered = numbered.join(listed_plan, ["window_id", "len"], "left") if joined else numbered
    return numbered.mapInPandas(
        _placed(sent), f"window_id int, id {kind}, piece_no long, tokens int, container_id long"
    )


def _placed(sent):
    def run(batches):
        plan, total = sent.value
        for batch in batches:
            out = np.empty(len(batch), np.int64)
            numbers = batch["number"].to_numpy()
            for key, at in batch.groupby(["window_id", "len"]).indices.items():
                if key[1] == 0:
                    out[at] = 1 + numbers[at] % max(1, total.get(key[0], 0))
                    continue
                first, per, container = plan[key] if plan is not None else (np.array([s[x] for s in batch["steps"].iloc[at[0]]]) for x in ("first", "per", "container"))
                k = np.searchsorted(first, numbers[at], side="right") - 1
                out[at] = container[k] + (numbers[at] - first[k]) // per[k]
            yield pd.DataFrame({"window_id": batch["window_id"], "id": batch["id"], "piece_no": batch["piece_no"], "tokens": batch["len"], "container_id": out})

    return run
