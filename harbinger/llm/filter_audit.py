"""How five filters act on a corpus in every order, from one word per document.

Each document becomes a 32-bit word: bit s is set when the document survives the subset s
of the filters (bit k of s stands for filter k). Words are counted by position inside
tasks with carry-save adders, for each part and label, so that 32 sums per part and label
are all that is shuffled. Any order of the filters is then a chain of subsets, and every
count of it is a difference of two of those sums.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import bound_batches, clean_columns
from harbinger.sources.shared import settle

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ALL = SUBSETS - 1
SEPARATORS = " \t\n\x0b\x0c\r"

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

# survivors of each failure pattern: bit s is set when s holds none of the failed filters
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set.

    Words of equal weight are added three at a time: the exclusive or keeps the weight, the
    majority carries to the next. What is left of a weight, two words at most, is counted.
    """
    total = np.zeros(32, np.int64)
    weight, now = 0, words
    while len(now):
        carried = []
        while len(now) > 2:
            third = len(now) // 3
            a, b, c = now[:third], now[third : 2 * third], now[2 * third : 3 * third]
            half = a ^ b
            carried.append((a & b) | (c & half))
            now = np.concatenate([half ^ c, now[3 * third :]])
        for word in now:
            total += (int(word) >> np.arange(32) & 1) << weight
        now = np.concatenate(carried) if carried else now[:0]
        weight += 1
    return total


def text_failures(text: Column) -> list[Column]:
    """The failure conditions of filters A to D for a text that is not NULL."""
    words = F.split(F.btrim(text, F.lit(SEPARATORS)), r"[\x20\x09-\x0D]+")
    some = F.length(F.btrim(text, F.lit(SEPARATORS))) > 0
    n_words = F.when(some, F.size(words)).otherwise(0)
    n_distinct = F.when(some, F.size(F.array_distinct(words))).otherwise(0)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [
        n_words < 200,
        100 * n_distinct < 50 * n_words,
        100 * capitals > 3 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def document_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_key, failed): filters A to D as bits 0 to 3 of ``failed``."""
    doc_id, text, lang = clean_columns(docs, "doc_id", "text", "lang")
    rows = docs.select(
        doc_id.cast("long").alias("doc_id"),
        F.coalesce(lang.cast("string"), F.lit("")).alias("part"),
        F.coalesce(text.cast("string"), F.lit("")).alias("text"),
    )
    failed = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(text_failures(F.col("text")))), F.lit(0))
    key = F.unhex(F.sha2("text", 256)).alias("text_key")
    return rows.select("doc_id", "part", key, failed.cast("int").alias("failed"))


def with_copies(rows: DataFrame) -> DataFrame:
    """Bit 4 of ``failed``: some smaller doc_id has the same text.

    The first document of a text is met on text and id together, so that a text which holds
    a third of all rows still spreads over all tasks. Rows without an id are nobody's copy.
    """
    named = rows.where("doc_id IS NOT NULL")
    first = named.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(0))
    met = named.join(first, ["text_key", "doc_id"], "left")
    copy = F.coalesce("first", F.lit(1 << 4))
    marked = met.select("doc_id", "part", (F.col("failed") + copy).cast("int").alias("failed"))
    return marked.union(rows.where("doc_id IS NULL").select("doc_id", "part", "failed"))


def survivors(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents of the part that survive the subset."""
    doc_id, quality, toxic = clean_columns(labels, "doc_id", "quality", "toxic")
    marks = (
        labels.select(doc_id.cast("long").alias("doc_id"), quality.alias("q"), toxic.alias("t"))
        .where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("q") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("t") == 1, 1).otherwise(0)).alias("bad"))
    )
    named = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    label = (F.coalesce("good", F.lit(0)) + 2 * F.coalesce("bad", F.lit(0))).cast("int")
    labelled = named.select("part", label.alias("label"), "failed").union(
        rows.where("doc_id IS NULL").select("part", F.lit(0).alias("label"), "failed")
    )

    def run(batches):
        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            names = parts.dictionary.to_pylist()
            group = parts.indices.to_numpy().astype(np.int64) * 4 + batch.column("label").to_numpy()
            words = WORDS[batch.column("failed").to_numpy()]
            found, back = np.unique(group, return_inverse=True)
            counts = [positional_popcount(words[back == g]) for g in range(len(found))]
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[g // 4] for g in found.tolist()], pa.string()),
                        pa.array((found % 4).astype(np.int32)),
                        pa.array([c.tolist() for c in counts], pa.list_(pa.int64())),
                    ],
                    ["part", "label", "counts"],
                )

    counted = labelled.mapInArrow(run, "part string, label int, counts array<long>")
    flat = counted.select("part", "label", F.posexplode("counts").alias("subset", "n"))
    return flat.groupBy("part", "subset").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("label") % 2 == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("label") >= 2, F.col("n")).otherwise(0)).alias("toxic"),
    )


def shapley_counts(n: np.ndarray) -> list[int]:
    """What each filter removes, summed over every order: subsets before it, by their orders."""
    k = len(FILTERS)
    out = []
    for f in range(k):
        before = [s for s in range(SUBSETS) if not s >> f & 1]
        orders = [factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) for s in before]
        out.append(sum(w * int(n[s] - n[s | 1 << f]) for s, w in zip(before, orders, strict=True)))
    return out


def order_rows(part: str, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> pd.DataFrame:
    """One row for each order and step of a part, from its survivors by subset."""
    share, rows = shapley_counts(n), []
    for order in permutations(range(len(FILTERS))):
        name, past = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            now = past | 1 << f
            removed = int(n[past] - n[now])
            fails = int(n[0] - n[1 << f])
            alone = int(n[ALL ^ 1 << f] - n[ALL])
            lost = (int(x[past] - x[now]) for x in (good, toxic))
            rows.append((part, name, step, int(n[now]), removed, fails - removed, alone, *lost, share[f]))
            past = now
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in AUDIT.split(", ")]).astype({"step": "int32"})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters, and step: the columns of AUDIT.

    A NULL text counts as empty, a NULL lang as the part ''. Rows without an id are audited,
    but are no copies, make no copies and have no labels. Repeated rows count as often as
    they occur; equal ids are not smaller than each other, so an exact repetition is no copy.
    Of several labels of one id the highest counts. A table without rows has no parts and
    gives no rows. Very long texts are read whole, and columns beside doc_id, text, lang,
    quality and toxic are ignored.
    """
    bound_batches(docs.sparkSession, 10_000)
    rows = settle(document_failures(docs))
    sums = survivors(with_copies(rows), labels)

    def expand(part: pd.DataFrame) -> pd.DataFrame:
        by = part.sort_values("subset")
        return order_rows(by["part"].iloc[0], *(by[c].to_numpy() for c in ("n", "good", "toxic")))

    return sums.groupBy("part").applyInPandas(expand, AUDIT)


def audit_sql() -> str:
    """The same counts as SQL over ``documents`` and ``labels``, each order walked through."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    letters = " UNION ALL ".join(f"SELECT '{f}' AS f, {b} AS b" for f, b in bit.items())
    chain = ", ".join(f"l{i}.f AS f{i}, l{i}.b AS b{i}" for i in range(1, 6))
    joins = "letters l1" + "".join(
        f" JOIN letters l{i} ON " + " AND ".join(f"l{i}.f <> l{j}.f" for j in range(1, i)) for i in range(2, 6)
    )
    steps = " UNION ALL ".join(
        f"SELECT f1 || f2 || f3 || f4 || f5 AS filter_order, {i} AS step, f{i} AS f, b{i} AS b,"
        f" ({' | '.join(['0', *[f'b{j}' for j in range(1, i)]])}) AS past FROM orders"
        for i in range(1, 6)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    doc_id IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY text) AS copy FROM d),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
t AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN copy THEN 16 ELSE 0 END) AS failed
    FROM w LEFT JOIN marks USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM t GROUP BY part, failed),
letters AS ({letters}),
orders AS (SELECT {chain} FROM {joins}),
steps AS ({steps}),
walked AS (SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (failed & (past | b) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (failed & past = 0 AND failed & b <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failed & past <> 0 AND failed & b <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed = b), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (failed & past = 0 AND failed & b <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(bad) FILTER (failed & past = 0 AND failed & b <> 0), 0)::BIGINT AS toxic_lost
    FROM c, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM walked
"""
