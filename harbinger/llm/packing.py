"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost. Pieces are placed longest
first into the open sequence that they leave least room in, whatever its length; when
none has room, the length is opened whose cost for each token it is likely to hold is
least, judged by filling it greedily with the pieces still to come. At the end every
sequence is cut down to the shortest permitted length that holds its contents.

Rows are dealt by hash into shards of about SHARD_ROWS, each packed by one task, so the
work is the same for each row at any size; the price is the last few sequences of a
shard. The hash holds a row number, so rows without an id, or with one id, spread as well. A text longer than the longest sequence is cut into full pieces and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import bound_batches, settle

CAPACITIES = (512, 1024, 2048, 4096)
ATTENTION = 16_384
SHARD_ROWS = 2000

PLACED = "doc_id long, piece int, start long, length long, shard long, bin_no long, capacity long, offset long"


def sequence_cost(capacity: int) -> float:
    """Cost of a sequence: linear work, and attention that grows with the square."""
    return capacity * (1 + capacity / ATTENTION)


def pack_lengths(lengths: list[int], capacities: tuple[int, ...], costs: tuple[float, ...]) -> tuple[list[int], list[int]]:
    """(bin of each length, capacity of each bin) for lengths sorted longest first."""
    room: list[tuple[int, int]] = []  # open sequences by the room they have left
    bins: list[int] = []
    filled: list[int] = []
    where: list[int] = []
    values = sorted(set(lengths))
    waiting = [0] * len(values)
    place = {v: i for i, v in enumerate(values)}
    for length in lengths:
        waiting[place[length]] += 1
    for length in lengths:
        waiting[place[length]] -= 1
        spot = bisect_left(room, (length, -1))
        if spot < len(room):
            left, b = room.pop(spot)
        else:
            b = len(bins)
            capacity = _open(length, values, waiting, capacities, costs)
            bins.append(capacity)
            filled.append(0)
            left = capacity
        where.append(b)
        filled[b] += length
        if left > length:
            insort(room, (left - length, b))
    return where, [min(c for c in capacities if c >= f) for f in filled]


def _open(length: int, values: list[int], waiting: list[int], capacities, costs) -> int:
    """The capacity with the least cost for each token it would hold; the shorter of equals.

    ``waiting`` counts the pieces still to come by their length in ``values``. Each length
    is taken as often as it fits before the next shorter one, so a step for every
    different length in the sequence fills it, however short the pieces are.
    """
    best = None
    for capacity, cost in sorted(zip(capacities, costs, strict=True)):
        if capacity < length:
            continue
        left = capacity - length
        k = bisect_right(values, left) - 1
        while k >= 0 and left:
            left -= min(waiting[k], left // values[k]) * values[k]
            k = min(k - 1, bisect_right(values, left) - 1)
        rate = cost / (capacity - left)
        if best is None or rate < best[0] - 1e-12:
            best = (rate, capacity)
    return best[1]


def pack(docs: DataFrame, length: Column, capacities: tuple[int, ...] = CAPACITIES, cost=sequence_cost) -> DataFrame:
    """One row for each piece: its document, its part of it, and its place in a sequence.

    A sequence is (shard, bin_no); ``offset`` is where the piece begins in it and
    ``capacity`` the final length of the sequence. Rows of length zero or NULL are
    returned as one piece without a sequence. Repeated rows are packed as often as they
    occur; an empty table gives no rows. ``docs`` needs doc_id; other columns are ignored.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    bound_batches(docs.sparkSession, 10_000)
    sizes = tuple(sorted(capacities))
    costs = tuple(float(cost(c)) for c in sizes)
    longest = sizes[-1]
    rows = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("length"), F.monotonically_increasing_id().alias("_row")))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "length", "_row"), F.lit(shards)))
    empty = dealt.where("length <= 0").select(
        "doc_id",
        F.lit(0).alias("piece"),
        F.lit(0).cast("long").alias("start"),
        F.lit(0).cast("long").alias("length"),
        "shard",
        *[F.lit(None).cast("long").alias(c) for c in ("bin_no", "capacity", "offset")],
    )
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(longest).cast("long"))
    pieces = dealt.where("length > 0").select("doc_id", "shard", "length", F.posexplode(starts).alias("piece", "start"))
    pieces = pieces.withColumn("length", F.least(F.col("length") - F.col("start"), F.lit(longest)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        where, bins = pack_lengths(part["length"].tolist(), sizes, costs)
        part["bin_no"] = where
        part["capacity"] = np.array(bins, np.int64)[where]
        part["offset"] = part.groupby("bin_no")["length"].cumsum() - part["length"]
        return part[["doc_id", "piece", "start", "length", "shard", "bin_no", "capacity", "offset"]]

    placed = pieces.select("doc_id", "piece", "start", "length", "shard").groupBy("shard").applyInPandas(run, PLACED)
    return placed.union(empty)


def word_length(text: str = "text") -> Column:
    """Words of a text (runs without a space or a control from 09 to 0D), plus one for its end; empty texts have none."""
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.when(words > 0, words + 1).otherwise(0)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Every document packed by its number of words."""
    return pack(docs, word_length())
