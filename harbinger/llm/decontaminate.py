"""Benchmark decontamination: a BM25 index of test items searched by every passage.

Passages are word windows of twice the longest item, one item length apart, so that an
item copied whole lies inside one of them. A passage is a query; an item's score is
compared with what the item scores against itself, and every item at or above
SHARE of that is retrieved by block-max WAND. Retrieval is exact: bounds only skip items
that cannot reach the threshold. What is retrieved is kept if the passage holds enough of
the item's question (five-word shingles) and of its answer (words of its last sentence).

The items are test data of bounded size. Postings are dealt into shards of at most
SHARD_POSTINGS; each shard is sent to the tasks and all documents pass it without a
shuffle. Item counts and lengths are taken over all shards, so shards do not change scores.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from harbinger.llm.common import CACHE_WORDS, WordHashes, bound_batches, byte_words, rolling, settle, settle_small, texts

SHARE = 0.5
QUESTION_SHARE, ANSWER_SHARE = 0.5, 0.6
SHINGLE = 5
K1, B = 1.2, 0.75
LEAST_SPAN = 32
BLOCK = 4
COMMON_SHARE = 0.1
SHARD_POSTINGS = 2_000_000
ITEMS_PER_TASK = 10_000
EDGES = b".,;:!?\"'()[]{}<>|*$%&#_-/\\"

MATCH = "array<struct<item_id:long,share:double,bm25:double,question:double,answer:double,start:long>>"


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without outer punctuation; bare punctuation is no word."""
    return [w for w in (x.strip(EDGES) for x in byte_words(text, lower=True)) if w]


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """(question words, answer words): the answer is the last sentence, or the last quarter of a single one."""
    parts = [p for p in (plain_words(s) for s in re.split(r"(?<=[.!?])\s+|\n", text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut] or words, words[cut:]


@dataclass
class Index:
    """One shard: postings and block maxima by term, and what verification needs."""

    terms: np.ndarray  # sorted term hashes
    at: np.ndarray  # posting range of each term
    item: np.ndarray  # item number, ascending inside a term
    part: np.ndarray  # share of the item's own score
    top: np.ndarray  # greatest share of each term
    block_at: np.ndarray
    block: np.ndarray
    block_top: np.ndarray
    essential: np.ndarray  # terms that drive the search: no item reaches SHARE without one
    rest: np.ndarray  # by block: most that other terms can add
    own: np.ndarray  # own score of each item
    ids: list[int | None]  # item_id by number
    question: list[tuple[int, np.ndarray]]  # shingle width and hashes
    answer: list[np.ndarray]
    span: int

    @cached_property
    def lists(self) -> tuple[list, list, list, list]:
        """Postings and blocks as lists, which a loop over single entries reads faster."""
        return self.item.tolist(), self.part.tolist(), self.block.tolist(), self.block_top.tolist()


def _postings(items: DataFrame) -> DataFrame:
    def run(batches):
        words = WordHashes()
        for batch in batches:
            ids, terms, counts, sizes = [], [], [], []
            for i, text in zip(batch.column("number").to_pylist(), texts(batch), strict=True):
                h = words.of(plain_words(text))
                value, count = np.unique(h, return_counts=True)
                ids.extend([i] * len(value))
                terms.append(value.view(np.int64))
                counts.extend(count.tolist())
                sizes.extend([len(h)] * len(value))
            flat = np.concatenate(terms) if terms else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(flat), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
                ["number", "term", "tf", "words"],
            )

    return items.mapInArrow(run, "number long, term long, tf long, words long")


def build_index(items: DataFrame) -> list[Index]:
    """The shards of the index over (item_id, text); items without words are left out.

    Each distinct pair of id and text is an item of its own; ids may repeat or be null.
    """
    bound_batches(items.sparkSession)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    # numbers are given once, in a settled frame
    rows = settle_small(
        rows.distinct().orderBy("item_id", "text").withColumn("number", F.monotonically_increasing_id()), ITEMS_PER_TASK
    )
    postings = settle_small(_postings(rows))
    size = postings.select("number", "words").distinct().agg(
        F.count("*").alias("n"), F.avg("words").alias("avg"), F.max("words").alias("longest")
    ).first()
    if not size.n:
        return []
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (size.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("words") / size.avg)
    scored = postings.join(df, "term").withColumn("w", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))
    shards = -(-postings.count() // SHARD_POSTINGS)
    scored = settle(scored.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards))))
    out = []
    for shard in range(shards):
        mine = scored.where(F.col("shard") == shard).select("number", "term", "w", "df").toPandas()
        if not len(mine):
            continue
        body = rows.where(F.pmod(F.xxhash64("number"), F.lit(shards)) == shard).collect()
        out.append(_shard(mine, body, size.n, max(LEAST_SPAN, int(size.longest))))
    return out


def _shard(postings: pd.DataFrame, body: list[Row], n_items: int, span: int) -> Index:
    ids = np.sort(postings["number"].unique())
    number = np.searchsorted(ids, postings["number"].to_numpy())
    terms, term = np.unique(postings["term"].to_numpy().view(np.uint64), return_inverse=True)
    w = postings["w"].to_numpy()
    own = np.bincount(number, w, len(ids))
    part = w / own[number]
    order = np.lexsort((number, term))
    term, number, part = term[order], number[order], part[order]
    at = np.searchsorted(term, np.arange(len(terms) + 1))
    df = np.zeros(len(terms))
    df[term] = postings["df"].to_numpy()[order]
    block = number // BLOCK
    first = np.flatnonzero(np.diff(term * (block.max() + 1) + block, prepend=-1))
    essential, common = _essential(df, at, number, part, len(ids), n_items)
    rest = np.zeros(block.max() + 1)
    np.maximum.at(rest, np.arange(len(ids)) // BLOCK, common)
    row = {r["number"]: r for r in body}
    words = WordHashes()
    split = [split_item(row[i]["text"]) for i in ids.tolist()]
    asked = [words.of(q) for q, _ in split]
    question = [(w, np.unique(rolling(h, w))) for w, h in ((max(1, min(SHINGLE, len(h))), h) for h in asked)]
    return Index(
        terms,
        at,
        number,
        part,
        np.maximum.reduceat(part, at[:-1]),
        np.searchsorted(term[first], np.arange(len(terms) + 1)),
        block[first],
        np.maximum.reduceat(part, first),
        essential,
        rest,
        own,
        [row[i]["item_id"] for i in ids.tolist()],
        question,
        [np.unique(words.of(a)) for _, a in split],
        span,
    )


def _essential(
    df: np.ndarray, at: np.ndarray, number: np.ndarray, part: np.ndarray, items: int, n_items: int
) -> tuple[np.ndarray, np.ndarray]:
    """(terms that drive the search, by item what its other terms add).

    From the most common down, terms of more than COMMON_SHARE of the items are left
    out of the search as long as no item reaches SHARE by such terms alone.
    """
    essential = np.ones(len(df), bool)
    common = np.zeros(items)
    many = np.flatnonzero(df > max(1.0, COMMON_SHARE * n_items))
    for t in many[np.argsort(-df[many], kind="stable")].tolist():
        mine = slice(at[t], at[t + 1])
        if (common[number[mine]] + part[mine]).max() < SHARE - 1e-6:
            common[number[mine]] += part[mine]
            essential[t] = False
    return essential, common


class TermIds(dict):
    """Number of a raw word in the index, -1 if the index lacks it, -2 if it is no word."""

    def __init__(self, terms: np.ndarray):
        super().__init__()
        self.terms = terms

    def of(self, raw: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        new = [w for w in set(raw) if w not in self]
        if new:
            # all new words of a text are looked up at once
            bare = [w.strip(EDGES) for w in new]
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, bare), np.uint64, len(bare))
            k = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            value = np.where(self.terms[k] == h, k, -1)
            value[[not w for w in bare]] = -2
            self.update(zip(new, value.tolist(), strict=True))
        return np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))


def block_max_wand(
    query: np.ndarray, index: Index, theta: float, blocks: list[int] | None = None
) -> list[tuple[int, float]]:
    """(item number, share) of every item whose share reaches theta, items ascending.

    ``query`` holds distinct term numbers. The pivot is the first list, by current item,
    at which the term maxima reach theta; its block maxima decide whether the pivot is
    scored or the whole block skipped. ``blocks`` names the only blocks whose maxima can
    reach theta, where the caller has summed them already; all lists then jump there.
    """
    item, part, block_of, tops = index.lists
    ends = index.at[query + 1].tolist()
    place = index.at[query].tolist()
    block_end = index.block_at[query + 1].tolist()
    block_place = index.block_at[query].tolist()
    top = index.top[query].tolist()
    slack = theta - 1e-9
    live = range(len(query))
    if blocks is not None:
        first = blocks[0] * BLOCK
        for k in live:
            place[k] = bisect_left(item, first, place[k], ends[k])
    live = [k for k in live if place[k] < ends[k]]
    out = []
    while live:
        live.sort(key=lambda k: item[place[k]])
        bound, pivot = 0.0, -1
        for n, k in enumerate(live):
            bound += top[k]
            if bound >= slack:
                pivot = n
                break
        if pivot < 0:
            break
        target = item[place[live[pivot]]]
        block = target // BLOCK
        if blocks is not None:
            at = bisect_left(blocks, block)
            if at == len(blocks):
                break
            if blocks[at] > block:
                target = blocks[at] * BLOCK
                for k in live:
                    place[k] = bisect_left(item, target, place[k], ends[k])
                live = [k for k in live if place[k] < ends[k]]
                continue
        while pivot + 1 < len(live) and item[place[live[pivot + 1]]] == target:
            pivot += 1
        bound = 0.0
        for k in live[: pivot + 1]:
            b = block_place[k] = bisect_left(block_of, block, block_place[k], block_end[k])
            if b < block_end[k] and block_of[b] == block:
                bound += tops[b]
        if bound < slack:
            # nothing before the next block, or before the next list begins, can qualify
            target = (block + 1) * BLOCK
            if pivot + 1 < len(live):
                target = min(target, item[place[live[pivot + 1]]])
            moved = live[: pivot + 1]
        elif item[place[live[0]]] == target:
            share = sum(part[place[k]] for k in live[: pivot + 1])
            if share >= slack:
                out.append((target, share))
            moved = live[: pivot + 1]
            target += 1
        else:
            moved = [k for k in live[: pivot + 1] if item[place[k]] < target]
        for k in moved:
            place[k] = bisect_left(item, target, place[k], ends[k])
        live = [k for k in live if place[k] < ends[k]]
    return out


def promising(ids: np.ndarray, index: Index, theta: float) -> dict[int, list[int]]:
    """Windows of a text (by their start, in spans) with the blocks that can reach theta there.

    For all windows at once: block maxima of the essential terms present, plus the most
    that the block's other terms can add. Blocks that the others alone bring to theta (none
    for a theta of SHARE or more) can reach it in every window that holds a term.
    """
    spot = np.flatnonzero(ids >= 0)
    last = max(0, (len(ids) - 1) // index.span - 1)
    alone = np.flatnonzero(index.rest >= theta - 1e-9)
    open_cells = np.empty(0, np.int64)
    if len(alone):
        segment = np.unique(spot // index.span)
        held = np.unique(np.concatenate([np.minimum(segment, last), segment[(segment >= 1) & (segment <= last + 1)] - 1]))
        open_cells = (held[:, None] * len(index.rest) + alone).ravel()
    spot = spot[index.essential[ids[spot]]]
    if not len(spot) and not len(open_cells):
        return {}
    segment, term = spot // index.span, ids[spot]
    window = np.concatenate([np.minimum(segment, last), segment - 1])
    term = np.concatenate([term, term])
    ok = (window >= 0) & (window <= last)
    key = np.unique(window[ok] * len(index.terms) + term[ok])
    window, term = key // len(index.terms), key % len(index.terms)
    many = index.block_at[term + 1] - index.block_at[term]
    line = np.repeat(index.block_at[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
    cell = np.repeat(window, many) * len(index.rest) + index.block[line]
    cells, back = np.unique(cell, return_inverse=True)
    bound = np.bincount(back, index.block_top[line]) + index.rest[cells % len(index.rest)]
    out: dict[int, list[int]] = {}
    for c in np.union1d(cells[bound >= theta - 1e-9], open_cells).tolist():
        out.setdefault(c // len(index.rest), []).append(c % len(index.rest))
    return out


def search_text(text: str | None, index: Index, numbers: TermIds, words: WordHashes, theta: float) -> list[dict]:
    """Verified items of one text, each at its best passage (the first of equals)."""
    raw = byte_words(text, lower=True)
    ids = numbers.of(raw)
    if len(ids) and (ids == -2).any():
        keep = ids > -2
        raw = [w for w, k in zip(raw, keep.tolist(), strict=True) if k]
        ids = ids[keep]
    best: dict[int, dict] = {}
    for window, blocks in promising(ids, index, theta).items():
        start = window * index.span
        part = ids[start : start + 2 * index.span]
        found = block_max_wand(np.unique(part[part >= 0]), index, theta, blocks)
        if not found:
            continue
        h = words.of([w.strip(EDGES) for w in raw[start : start + 2 * index.span]])
        for number, share in found:
            width, question = index.question[number]
            q = np.isin(question, rolling(h, width)).mean() if len(question) else 1.0
            a = np.isin(index.answer[number], h).mean() if len(index.answer[number]) else 1.0
            if q < QUESTION_SHARE or a < ANSWER_SHARE:
                continue
            if number not in best or share > best[number]["share"]:
                best[number] = {
                    "item_id": index.ids[number],
                    "share": float(share),
                    "bm25": float(share * index.own[number]),
                    "question": float(q),
                    "answer": float(a),
                    "start": start,
                }
    return [best[n] for n in sorted(best)]


def _search(held: Broadcast, theta: float):
    @F.pandas_udf(MATCH)
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        numbers, words = TermIds(held.value.terms), WordHashes()
        for part in parts:
            yield pd.Series([search_text(t, held.value, numbers, words, theta) for t in part], dtype=object)

    # what follows may name the result twice; the search must still run once
    return search.asNondeterministic()


def with_matches(docs: DataFrame, shards: list[Index], name: str = "matches", theta: float = SHARE) -> DataFrame:
    """Add an array of verified items to every row: empty where the text is null or clean."""
    spark = docs.sparkSession
    bound_batches(spark)
    columns = [_search(spark.sparkContext.broadcast(x), theta)(F.col("text").cast("string")) for x in shards]
    found = reduce(F.concat, columns) if columns else F.array().cast(MATCH)
    return docs.withColumn(name, found)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and test item it holds: ids, scores, overlaps, passage start.

    Items that share an id, or have none, are found each for itself; rows of ``items``
    equal in id and text are one item. Repeated documents are searched alike and give
    repeated rows; an empty table of either kind gives none.
    """
    rows = with_matches(docs.select("doc_id", "text"), build_index(items))
    return rows.select("doc_id", F.explode("matches").alias("m")).select(
        "doc_id",
        "m.item_id",
        "m.share",
        "m.bm25",
        F.col("m.question").alias("question_overlap"),
        F.col("m.answer").alias("answer_overlap"),
        F.col("m.start").alias("passage_start"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item; columns stay as they are."""
    body = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("text").alias("text"))
    return with_matches(body, build_index(items)).where(F.size("matches") == 0).select("_row.*")
