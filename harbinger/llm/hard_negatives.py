"""Hard negatives by exact search in a multiway hyperplane tree with range tables.

Scores are integer inner products. One more coordinate, sqrt(M^2 - |x|^2) with M the largest
norm, puts all rows on a sphere, so that a score falls as the distance to the query grows
and a window of scores is an annulus around it.

1. Of the rows with equal vector and label only the first few ids can be among the best, so
   the index holds those; equal queries are asked once.
2. Split points of the tree are chosen greedily far apart on a bounded sample. A row goes to
   the nearest split point, level by level. Every split point keeps the least and greatest
   distance to the rows of each sibling subtree, taken over all rows.
3. Leaves are cut into blocks of bounded size. A query skips a subtree when, for some split
   point, the range and the annuli of its windows cannot meet; it first asks its own leaf,
   which narrows the annuli, then all leaves that are left. Inside a leaf every row is scored.

The tree has at most the size of the sample, however many rows there are; leaves only grow
in blocks. Nothing is approximate: a subtree is skipped only if none of its rows can count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbinger.llm.common import bound_batches
from harbinger.sources.shared import settle

FANOUT = 8
LEAF_ROWS = 1024
BLOCK_ROWS = 1024
SAMPLE_ROWS = 16_384
QUERY_BATCH = 256
BATCH = 256  # blocks held at once by a task
SPREAD = 8
ENDLESS = 1 << 62

MINED = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score".split(", ")


class Space:
    """How vectors are stored and multiplied, so that every inner product is exact."""

    def __init__(self, width: int, largest: int, norm2: float):
        self.width = width
        self.stored = np.dtype(next(k for k in ("<i2", "<i4", "<i8") if largest <= np.iinfo(k).max))
        # a sum of products stays below the product of the norms, so floats are exact up to their mantissa
        self.exact = np.dtype("f4" if norm2 < 1 << 23 else "f8" if norm2 < 1 << 52 else "i8")
        self.radius2 = float(norm2)
        self.slack = 1e-6 * np.sqrt(self.radius2) + 1e-9

    def unpack(self, blobs: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(blobs), self.stored).reshape(len(blobs), self.width).astype(self.exact)

    def norms2(self, rows: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", rows, rows, dtype="f8")

    def height(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.radius2 - self.norms2(rows), 0))

    def between(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances of rows from points, both lifted to the sphere."""
        product = (rows @ points.T).astype("f8") + self.height(rows)[:, None] * self.height(points)[None, :]
        return np.sqrt(np.maximum(2 * self.radius2 - 2 * product, 0))

    def from_queries(self, queries: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances of queries, which are not lifted, from lifted points."""
        far = self.norms2(queries)[:, None] + self.radius2 - 2 * (queries @ points.T).astype("f8")
        return np.sqrt(np.maximum(far, 0))

    def annuli(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distances (inner, outer) between which scores from ``low`` to ``high`` lie."""
        far = (self.norms2(queries) + self.radius2)[:, None]
        inner = np.sqrt(np.maximum(far - 2 * high.astype("f8"), 0))
        return inner, np.sqrt(np.maximum(far - 2 * low.astype("f8"), 0))


class Tree:
    """Split points, children, and the range of distances from every point to every child."""

    def __init__(self, space: Space):
        self.space = space
        self.points: list[np.ndarray] = []
        self.child: list[list[int]] = []  # a node, or -1 - leaf
        self.near: list[np.ndarray] = []
        self.far: list[np.ndarray] = []
        self.leaves = 0

    @classmethod
    def fit(cls, space: Space, sample: np.ndarray, rows: int, fanout: int, leaf_rows: int) -> Tree:
        tree, draw = cls(space), np.random.default_rng(11)

        def grow(own: np.ndarray) -> int:
            share = len(own) * rows / max(1, len(sample))
            if share <= leaf_rows or len(own) < 4 * fanout:
                return tree._leaf()
            some = own[draw.choice(len(own), min(len(own), 3 * fanout), replace=False)]
            picked, apart = [0], space.between(some, some[:1])[:, 0]
            while len(picked) < fanout and apart.max() > space.slack:
                picked.append(int(apart.argmax()))
                apart = np.minimum(apart, space.between(some, some[picked[-1:]])[:, 0])
            if len(picked) < 2:
                return tree._leaf()
            points = some[picked]
            home = space.between(own, points).argmin(1)
            node = len(tree.points)
            tree.points.append(points)
            tree.child.append([])
            tree.near.append(np.full((len(points), len(points)), np.inf))
            tree.far.append(np.full((len(points), len(points)), -np.inf))
            tree.child[node] = [grow(own[home == j]) for j in range(len(points))]
            return node

        tree.root = grow(sample)
        return tree

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def descend(self, rows: np.ndarray, lifted: bool = True):
        """The leaf of every row, and (node, child, nearest, farthest) of the rows that went there."""
        leaf, ranges = np.zeros(len(rows), np.int64), []

        def go(node: int, own: np.ndarray) -> None:
            if not len(own):
                return
            if node < 0:
                leaf[own] = -1 - node
                return
            measure = self.space.between if lifted else self.space.from_queries
            apart = measure(rows[own], self.points[node])
            home = apart.argmin(1)
            for j, below in enumerate(self.child[node]):
                inside = home == j
                if inside.any():
                    ranges.append((node, j, apart[inside].min(0).tolist(), apart[inside].max(0).tolist()))
                    go(below, own[inside])

        go(self.root, np.arange(len(rows)))
        return leaf, ranges

    def reach(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray):
        """(leaf, numbers of the queries that may find something in it)."""
        inner, outer = self.space.annuli(queries, low, high)
        open_ = low <= high
        slack, found = self.space.slack, []

        def go(node: int, own: np.ndarray) -> None:
            if not len(own):
                return
            if node < 0:
                found.append((-1 - node, own))
                return
            apart = self.space.from_queries(queries[own], self.points[node])
            for j, below in enumerate(self.child[node]):
                near, far = self.near[node][:, j], self.far[node][:, j]
                if not np.isfinite(near[0]):
                    continue  # no row went there
                least = np.maximum(apart - far, near - apart).max(1)
                least = np.maximum(least, (apart[:, j, None] - apart).max(1) / 2)  # beyond the hyperplanes
                most = (apart + far).min(1)
                meets = (least[:, None] <= outer[own] + slack) & (most[:, None] >= inner[own] - slack) & open_[own]
                go(below, own[meets.any(1)])

        go(self.root, np.arange(len(queries)))
        return found


def valid_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; components as whole numbers."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("vector").cast("array<bigint>").alias("vector"),
    )
    return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)")


def scaled(column: str | Column, by: int = 256) -> Column:
    """Components as floor(by * x); NULL for a vector with a null or non-finite component."""
    values = F.col(column).cast("array<double>") if isinstance(column, str) else column.cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(values, lambda x: F.floor(x * by)))


def _measure(rows: DataFrame) -> Space:
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = F.greatest(F.array_max("vector"), -F.array_min("vector"))
    found = rows.agg(F.max(F.size("vector")).alias("w"), F.max(largest).alias("l"), F.max(norm2).alias("n")).first()
    return Space(found.w or 0, found.l or 0, found.n or 0.0)


def _packed(rows: DataFrame, space: Space) -> DataFrame:
    """Vectors as bytes of one length; a shorter vector ends in zeros."""

    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()
            out = np.zeros((len(sizes), space.width), space.stored)
            out[np.arange(space.width)[None, :] < sizes[:, None]] = flat
            blobs = [r.tobytes() for r in out]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vector"])

    return rows.mapInArrow(run, "vec_id long, label long, vector binary")


def _with_leaf(rows: DataFrame, tree: Tree, lifted: bool = True) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                leaf, _ = tree.descend(tree.space.unpack(batch.column("vector").to_pylist()), lifted)
                yield batch.append_column("leaf", pa.array(leaf))

    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in rows.dtypes) + ", leaf long")


def _blocks(rows: DataFrame, tree: Tree) -> DataFrame:
    """One row for each block: ids, labels and vectors, and the ranges of its rows."""
    sizes = rows.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    # one row a leaf: never more than the sample has
    dealt = rows.join(F.broadcast(sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    ranges = "array<struct<node:int,child:int,near:array<double>,far:array<double>>>"

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        _, found = tree.descend(tree.space.unpack(part["vector"].tolist()))
        return pd.DataFrame(
            {
                "leaf": [int(part["leaf"].iloc[0])],
                "block": [int(part["block"].iloc[0])],
                "blocks": [int(part["blocks"].iloc[0])],
                "ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
                "labels": [part["label"].to_numpy(np.int64).tobytes()],
                "vectors": [b"".join(part["vector"])],
                "ranges": [[dict(zip(("node", "child", "near", "far"), r, strict=True)) for r in found]],
            }
        )

    schema = f"leaf long, block long, blocks long, ids binary, labels binary, vectors binary, ranges {ranges}"
    return dealt.groupBy("leaf", "block").applyInPandas(pack, schema)


def _learn_ranges(tree: Tree, blocks: DataFrame) -> None:
    """Widen the ranges of the tree to what all blocks have seen."""
    seen = blocks.select(F.explode("ranges").alias("r")).select("r.node", "r.child", F.posexplode(F.arrays_zip("r.near", "r.far")))
    seen = seen.groupBy("node", "child", "pos").agg(F.min("col.near").alias("near"), F.max("col.far").alias("far"))
    for r in seen.collect():  # nodes x fanout x fanout rows, bounded by the sample
        tree.near[r.node][r.pos, r.child] = r.near
        tree.far[r.node][r.pos, r.child] = r.far


def build_index(rows: DataFrame, space: Space, copies: int, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS):
    """(tree, blocks) over rows (vec_id, label, vector as bytes).

    Of equal vectors with one label, the first ``copies`` ids are held: no search for fewer
    can miss one of the others.
    """
    by_copy = Window.partitionBy("vector", "label").orderBy("vec_id")
    held = settle(rows.withColumn("_n", F.row_number().over(by_copy)).where(F.col("_n") <= copies).drop("_n"))
    n = held.count()
    chance = F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(1 << 40))
    some = held.where(chance <= int((1 << 40) * min(1.0, SAMPLE_ROWS / max(1, n)))).select("vec_id", "vector")
    sample = [r.vector for r in some.orderBy("vec_id").collect()]
    tree = Tree.fit(space, space.unpack(sample), n, fanout, leaf_rows)
    blocks = settle(_blocks(_with_leaf(held, tree), tree))
    _learn_ranges(tree, blocks)
    return tree, blocks.drop("ranges")


ASKED = "leaf long, queries binary, labels binary, vectors binary, low binary, high binary"


def _windows(lists: pa.Array, closed: int) -> np.ndarray:
    """Window ends as a matrix; queries with fewer windows end in closed ones."""
    sizes = lists.value_lengths().to_numpy()
    out = np.full((len(sizes), int(sizes.max(initial=0))), closed, np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _asked(queries: DataFrame, tree: Tree, home_only: bool) -> DataFrame:
    """For every batch of queries and leaf in reach, the queries that ask there.

    Queries are sorted by their own leaf, so that a batch asks much the same leaves.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BATCH):
                part = batch.slice(at, QUERY_BATCH)
                vectors = tree.space.unpack(part.column("vector").to_pylist())
                low, high = _windows(part.column("low"), ENDLESS), _windows(part.column("high"), -ENDLESS)
                query, label, home = (part.column(c).to_numpy() for c in ("query", "label", "leaf"))
                if home_only:
                    found = [(leaf, np.flatnonzero(home == leaf)) for leaf in np.unique(home).tolist()]
                else:
                    found = tree.reach(vectors, low, high)
                if found:
                    blobs = [[x[own].tobytes() for _, own in found] for x in (query, label, vectors, low, high)]
                    columns = [pa.array([leaf for leaf, _ in found], pa.int64()), *[pa.array(b, pa.binary()) for b in blobs]]
                    yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in ASKED.split(", ")])

    ordered = queries.repartitionByRange(F.col("leaf"), F.col("query")).sortWithinPartitions("leaf", "query")
    return ordered.mapInArrow(run, ASKED)


def _best(scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """(window, id, score) of the first k rows inside each window of one query."""
    some = np.flatnonzero(fits & (scores >= low.min()) & (scores <= high.max()))
    if not len(some):
        return
    some = some[np.lexsort((ids[some], -scores[some]))]
    falling = -scores[some]
    for w, (lo, hi) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        first = int(np.searchsorted(falling, -hi, "left"))
        last = min(first + k, int(np.searchsorted(falling, -lo, "right")))
        for r in some[first:last].tolist():
            yield w, int(ids[r]), int(scores[r])


def _answers(asked: DataFrame, blocks: DataFrame, space: Space, k: int, same_label: bool) -> DataFrame:
    """(query, window, id, score): the best of each block for the queries that ask it."""
    sizes = blocks.groupBy("leaf").agg(F.max("blocks").alias("blocks"))
    pairs = asked.join(F.broadcast(sizes), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.drop("blocks").withColumnsRenamed({"labels": "own", "vectors": "asked"})
    rows = pairs.join(blocks.drop("blocks"), ["leaf", "block"])

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for r in range(batch.num_rows):
                value = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                query, own, ids, labels = (np.frombuffer(value[c], np.int64) for c in ("queries", "own", "ids", "labels"))
                low, high = (np.frombuffer(value[c], np.int64).reshape(len(query), -1) for c in ("low", "high"))
                left = np.frombuffer(value["asked"], space.exact).reshape(len(query), -1)
                right = np.frombuffer(value["vectors"], space.stored).reshape(len(ids), -1).astype(space.exact)
                scores = (left @ right.T).astype(np.int64)
                for q, number in enumerate(query.tolist()):
                    fits = (labels == own[q]) == same_label
                    out += [(number, *hit) for hit in _best(scores[q], ids, fits, low[q], high[q], k)]
            if out:
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["query", "window", "id", "score"])

    kept = rows.select("queries", "own", "asked", "low", "high", "ids", "labels", "vectors")
    return kept.mapInArrow(run, "query long, window long, id long, score long")


def _first(answers: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, tree: Tree, blocks: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(query, window, id, score, rank): the first k rows by score, then id, in every window.

    ``queries`` holds query, label, vector, leaf, and the windows as arrays ``low`` and
    ``high`` of equal length. The own leaf of a query is asked first; a window that has k
    rows there needs no lower scores from elsewhere.
    """
    space = tree.space
    home = _first(_answers(_asked(queries, tree, True), blocks, space, k, same_label), k)
    full = home.where(F.col("rank") == k).groupBy("query").agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("_least")
    )
    narrowed = F.transform("low", lambda lo, w: F.greatest(lo, F.coalesce(F.try_element_at("_least", w.cast("long")), lo)))
    again = queries.join(full, "query", "left").withColumn("low", F.when(F.col("_least").isNull(), F.col("low")).otherwise(narrowed))
    return _first(_answers(_asked(again.drop("_least"), tree, False), blocks, space, k, same_label), k)


def _hundredths(value: Column, up: bool) -> Column:
    """A whole number divided by 100, rounded up or down without leaving whole numbers."""
    even = value + F.pmod(-value, F.lit(100)) if up else value - F.pmod(value, F.lit(100))
    return F.call_function("div", even, F.lit(100))


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100,
    fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The first negatives of every anchor and positive: the columns of MINED.

    ``vectors`` holds vec_id, label and vector (whole numbers whose products fit 64 bits);
    ``is_anchor`` is a condition on vec_id. The positives of an anchor are the first other
    rows of its label by score, then id; a negative has another label and a score from
    ``least`` to ``most`` hundredths of the positive's.

    Rows with a NULL id, label, vector or component take no part. Of rows that share an id
    the least by label, then by the bytes of the vector, takes part, so repeated rows count
    once. Vectors of different lengths are compared as if the shorter ended in zeros; an
    empty vector scores 0 with all. Anchors without a positive, or without a negative in
    the window (always so below a score of 0), give no rows; an empty table gives none.
    """
    bound_batches(vectors.sparkSession, BATCH)
    valid = valid_rows(vectors)
    space = _measure(valid)
    once = _packed(valid, space).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r"))
    rows = settle(once.select("vec_id", "r.label", "r.vector"))
    tree, blocks = build_index(rows, space, max(positives + 1, negatives), fanout, leaf_rows)

    anchors = rows.where(is_anchor)
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD))
    classes = anchors.groupBy("vector", "label").agg(F.min(F.struct("vec_id", spread.alias("s"))).alias("f"), F.count("*").alias("n"))
    # ids are distinct, so the first anchor of a class names it
    queries = classes.select(F.col("f.vec_id").alias("query"), "label", "vector", F.col("f.s").alias("spread"), "n")
    queries = settle(_with_leaf(queries, tree, lifted=False))
    asked = queries.select(
        "query", "label", "vector", "leaf", F.array(F.lit(-ENDLESS)).alias("low"), F.array(F.lit(ENDLESS)).alias("high")
    )
    close = settle(search(asked, tree, blocks, positives + 1, True))

    found = close.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))
    windows = queries.join(found, "query").select(
        "query", "label", "vector", "leaf",
        F.transform("near", lambda p: _hundredths(p["score"] * least, up=True)).alias("low"),
        F.transform("near", lambda p: _hundredths(p["score"] * most, up=False)).alias("high"),
    )
    hard = search(windows, tree, blocks, negatives, False)
    hits = hard.groupBy("query").agg(F.collect_list(F.struct("window", "rank", "id", "score")).alias("hits"))
    told = queries.select("query", "label", "vector", "spread", "n").join(found, "query").join(hits, "query")
    # a class of several anchors meets them in SPREAD places
    places = F.when(F.col("n") > 1, F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).otherwise(F.array("spread"))
    told = told.withColumn("spread", F.explode(places)).drop("n", "query")
    mine_ = anchors.withColumn("spread", spread).join(told, ["vector", "label", "spread"])
    own = F.array_position(F.transform("near", lambda p: p["id"]), F.col("vec_id"))
    each = mine_.select("vec_id", "near", own.alias("own"), F.explode("hits").alias("h"))
    each = each.withColumn("at", F.col("h.window") + 1)
    each = each.where((F.col("at") != F.col("own")) & ((F.col("own") > 0) | (F.col("at") <= positives)))
    positive = F.element_at("near", F.col("at").cast("int"))
    return each.select(
        F.col("vec_id").alias("anchor_id"), positive["id"].alias("positive_id"), F.col("h.rank").alias("rank"),
        F.col("h.id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("h.score").alias("negative_score"),
    )
