"""What several text operators need: batches, words, bounded id filters, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger.sources.shared import settle

BATCH_ROWS = 1000
CACHE_WORDS = 400_000
FILTER_BITS = 1 << 26


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small, so that a Python worker holds few long texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class WordHashes(dict):
    """64-bit hash of a word (bytes), the same in every process; bounded between batches."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def byte_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text: runs without a space or one of the controls 09 to 0D.

    Splitting bytes cuts at exactly these characters, and lowering bytes touches
    only A-Z. A null text has no words.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each window of n consecutive values."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    h = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k])
    return h


def shingle_set(text: str | None, words: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct k-word shingle hashes; a shorter text is one shingle, an empty one none."""
    ids = words.of(byte_words(text, lower=True))
    if not len(ids):
        return np.empty(0, np.uint64)
    if len(ids) < k:
        return np.unique(rolling(np.append(ids, np.uint64(len(ids))), len(ids) + 1))
    return np.unique(rolling(ids, k))


def long_lists(rows: list[np.ndarray]) -> pa.Array:
    """An Arrow list<int64> column from numpy rows."""
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    for value in batch.column(column):
        yield value.as_py()


def hit_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap of the hashed ids: at most bits / 8 bytes, however many ids there are."""
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    return ids.groupBy(F.expr(f"bitmap_bucket_number(pmod(xxhash64({column}), {bits}L))").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits")
    )


def with_hits(df: DataFrame, column: str, bitmap: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Add ``_hit``: false where the id is surely none of the filter's; true where it may be.

    The filter has a fixed greatest size, so sending it to every task is safe. Rows with
    ``_hit`` still need an exact join; the others never have to be shuffled.
    """
    place = f"pmod(xxhash64({column}), {bits}L)"
    bit = f"bitmap_bit_position({place})"
    byte = f"conv(hex(substring(_bits, cast({bit} div 8 as int) + 1, 1)), 16, 10)"
    return (
        df.withColumn("_bucket", F.expr(f"bitmap_bucket_number({place})"))
        .join(F.broadcast(bitmap), "_bucket", "left")
        .withColumn("_hit", F.expr(f"coalesce((cast({byte} as int) & shiftleft(1, cast({bit} % 8 as int))) <> 0, false)"))
        .drop("_bucket", "_bits")
    )


ROWS_PER_FILE = 500_000


def parts_for(rows: int, each: int = ROWS_PER_FILE) -> int:
    return max(1, -(-rows // each))


def settle_small(df: DataFrame, each: int = ROWS_PER_FILE) -> DataFrame:
    """Settle a frame of narrow rows; it is read by as many tasks as its rows need, after a count."""
    kept = settle(df)
    return kept.coalesce(parts_for(kept.count(), each))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge.

    Alternating large and small stars: edges are only re-hung, never multiplied, each
    round is two aggregations with map-side combine, and a node with very many edges is
    met by joins that adaptive execution can split. It ends when every tree is a star.
    The edges are counted once: a round has no more tasks than they need, however many
    shuffle partitions there are, since the driver keeps a record of every task.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    now = settle(edges.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct())
    parts = parts_for(now.count())
    now = now.coalesce(parts)
    while True:
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(now.select("v", F.lit(0), F.lit(1))).coalesce(parts)
        ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).coalesce(parts)
        if ends.where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = small.union(low.select("u", F.col("m").alias("v"))).coalesce(parts)
        now = settle(hung.distinct().coalesce(parts)).coalesce(parts)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def clean_columns(df: DataFrame, *names: str) -> list[Column]:
    """The named columns, NULL where the table lacks one."""
    have = set(df.columns)
    return [F.col(f"`{n}`") if n in have else F.lit(None).alias(n) for n in names]
