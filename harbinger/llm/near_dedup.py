"""Near-duplicate documents: MinHash with tensored banding, every link verified.

A table key is made of one half-key from each of two small collections: LEFT half-keys
of three hashes and RIGHT half-keys of two. LEFT * RIGHT tables so need only
3 * LEFT + 2 * RIGHT hashes, about the square root of what separate bands would take.
At similarity J a pair meets in some table with probability
(1 - (1 - J^3)^LEFT) * (1 - (1 - J^2)^RIGHT): 0.9985 at 0.8 and 0.9998 at 0.85.

1. Texts with the same shingle set become one class, which has a number of its own: ids
   come back only at the end, so that rows which share an id cannot be taken for each other.
2. Keys of the classes are counted (map-side combine); keys of one class only go.
3. Each class is checked on full sets against the class it meets most often.
4. Keys that still join different components are walked run by run. Sketches (one byte
   of each hash) discard pairs more than five standard errors below the threshold and
   the rest gather into clusters.
5. Inside a cluster, blocks of bounded size are paired and compared exactly, all against
   all, by one matrix product; only what connects two components is returned.

Nothing is capped: a class in a busy key is compared like any other. Rows without an id
take part through their text only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import (
    WordHashes,
    bound_batches,
    components,
    hit_filter,
    long_lists,
    mix,
    settle,
    settle_small,
    shingle_set,
    texts,
    with_hits,
)

LEFT, LEFT_ROWS, RIGHT, RIGHT_ROWS = 10, 3, 7, 2
HASHES = LEFT * LEFT_ROWS + RIGHT * RIGHT_ROWS
BLOCK = 192
SEED = 20240229

SIGNED = "doc_id long, text_key binary, n_shingles long, set_key binary, halves array<long>, sketch binary"


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    top = np.iinfo(np.uint64).max
    return draw.integers(1, top, HASHES, np.uint64) | np.uint64(1), draw.integers(0, top, HASHES, np.uint64)


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):
        part = mix(shingles[start : start + 4096])
        h = part[None, :] * a[:, None] + b[:, None]
        h ^= h >> np.uint64(29)
        np.minimum(low, h.min(1), out=low)
    return low


def _halves(low: np.ndarray) -> np.ndarray:
    split = LEFT * LEFT_ROWS
    left = low[:split].reshape(LEFT, LEFT_ROWS)
    right = low[split:].reshape(RIGHT, RIGHT_ROWS)
    out = np.empty(LEFT + RIGHT, np.uint64)
    for part, at, width in ((left, 0, LEFT_ROWS), (right, LEFT, RIGHT_ROWS)):
        h = mix(part[:, 0])
        for k in range(1, width):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + part[:, k])
        out[at : at + len(part)] = h
    return out


def _text_key(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))


def _set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sign(docs: DataFrame, k: int) -> DataFrame:
    """Set size, set identity, half-keys and sketch of every row, in one pass."""

    def run(batches):
        words = WordHashes()
        a, b = _coefficients()
        for batch in batches:
            sizes, keys, halves, sketches, own = [], [], [], [], []
            for text in texts(batch):
                own.append(_text_key(text))
                s = shingle_set(text, words, k)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None)
                    halves.append(np.empty(0, np.int64))
                    sketches.append(None)
                    continue
                low = _minima(s, a, b)
                keys.append(_set_key(s))
                halves.append(_halves(low).view(np.int64))
                sketches.append((mix(low) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(own, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    long_lists(halves),
                    pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "text_key", "n_shingles", "set_key", "halves", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNED)


def _keys(classes: DataFrame) -> DataFrame:
    """(key, node): every pair of a left and a right half-key, salted by its table."""
    tables = F.array(
        *[
            F.xxhash64(F.lit(i * RIGHT + j), F.col("halves")[i], F.col("halves")[LEFT + j])
            for i in range(LEFT)
            for j in range(RIGHT)
        ]
    )
    return classes.select("node", F.explode(tables).alias("key"))


def _shared_keys(classes: DataFrame) -> DataFrame:
    """(key, node, lead) for keys that at least two classes have."""
    keys = _keys(classes)
    shared = keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"))
    return keys.join(shared.where("lead < last").drop("last"), "key")


def _sets(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of classes (node, doc_id, set_key), from rows of their documents.

    Only rows whose id may be wanted are moved; a row of that id with another set is passed
    over.
    """

    def run(batches):
        words = WordHashes()
        for batch in batches:
            wanted, nodes, out = batch.column("set_key").to_pylist(), [], []
            for text, node, key in zip(texts(batch), batch.column("node").to_pylist(), wanted, strict=True):
                own = shingle_set(text, words, k)
                if _set_key(own) == key:
                    nodes.append(node)
                    out.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], ["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = with_hits(rows, "doc_id", hit_filter(classes, "doc_id")).where("_hit").drop("_hit")
    met = rows.join(classes.select("node", "doc_id", "set_key"), "doc_id").select("node", "text", "set_key")
    return met.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def similar(inter, union, percent: int):
    return 100 * inter >= percent * union


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            small, big = sorted((len(s), len(t)))
            if not similar(small, big, percent):
                out.append(False)
                continue
            inter = len(np.intersect1d(s, t, assume_unique=True))
            out.append(similar(inter, len(s) + len(t) - inter, percent))
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(linked("x", "y")).select("a", "b")


def _cluster_edges(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of components that some key joins and whose sketches may be similar enough.

    ``rows`` holds (key, comp, sketch), all rows of a key together and in order. A run is
    compared with vectors, and only a spanning forest of its components leaves.
    """
    j = percent / 100
    least = HASHES * j - 5 * np.sqrt(HASHES * j * (1 - j))

    def forest(comp: np.ndarray, sketch: np.ndarray):
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for i in range(1, len(comp)):
            other = np.flatnonzero(comp[:i] != comp[i])
            if not len(other):
                continue
            near = other[(sketch[other] == sketch[i]).sum(1) >= least]
            for c in np.unique(comp[near]).tolist():
                p, q = find(c), find(int(comp[i]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    yield min(p, q), max(p, q)

    def run(batches):
        kept: tuple | None = None

        def edges(key, comp, sketch):
            cuts = np.flatnonzero(np.diff(key)) + 1
            pairs: set[tuple[int, int]] = set()
            for c, s in zip(np.split(comp, cuts), np.split(sketch, cuts), strict=True):
                if len(c) > 1 and c.min() != c.max():
                    pairs.update(forest(c, s))
            both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy(zero_copy_only=False)
            comp = batch.column("comp").to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
            if kept is not None:
                key, comp, sketch = (np.concatenate([x, y]) for x, y in zip(kept, (key, comp, sketch), strict=True))
            last = len(key) - int((key[::-1] != key[-1]).argmax()) if key[0] != key[-1] else 0
            kept = (key[last:], comp[last:], sketch[last:])
            if last:
                yield edges(key[:last], comp[:last], sketch[:last])
        if kept is not None:
            yield edges(*kept)

    ordered = rows.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _block_pairs(members: DataFrame) -> DataFrame:
    """Members with every pair of blocks of their cluster that spans two components.

    A component of a block or more is cut into blocks of its own, so pairs inside it are
    never formed; the small ones share mixed blocks. Blocks are dealt by hash and hold
    about BLOCK members.
    """
    size = members.groupBy("cluster", "comp").agg(F.count("*").alias("_n"))
    small = F.col("_n") < BLOCK
    group = size.withColumn("_own", F.when(small, F.lit(-1)).otherwise(F.col("comp")))
    total = group.groupBy("cluster", "_own").agg(F.sum("_n").alias("_m"))
    total = total.withColumn("_parts", F.ceil(F.col("_m") / BLOCK).cast("long"))
    placed = members.join(group.select("cluster", "comp", "_own"), ["cluster", "comp"]).join(total, ["cluster", "_own"])
    placed = placed.select(
        "cluster", "comp", "node", "_own", F.pmod(F.xxhash64("node"), F.col("_parts")).alias("_part")
    )
    blocks = total.select("cluster", "_own", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    p = blocks.select("cluster", F.struct("_own", "_part").alias("p"))
    q = blocks.select("cluster", F.struct("_own", "_part").alias("q"))
    pure = (F.col("p._own") == F.col("q._own")) & (F.col("p._own") >= 0)
    pairs = p.join(q, "cluster").where((F.col("p") <= F.col("q")) & ~pure)
    pairs = pairs.withColumn("pair", F.xxhash64("cluster", "p", "q"))
    sides = pairs.select("cluster", "pair", F.explode(F.array_distinct(F.array("p", "q"))).alias("s"))
    sides = sides.select("cluster", "pair", F.col("s._own").alias("_own"), F.col("s._part").alias("_part"))
    return placed.join(sides, ["cluster", "_own", "_part"]).select("pair", "comp", "node")


def _compare_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect components, from all against all inside each block pair."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        node, comp = group["node"].to_numpy(), group["comp"].to_numpy()
        sizes = np.array([len(s) for s in sets])
        inter = np.zeros((len(sets), len(sets)), np.float32)
        if sets:
            values, ids = np.unique(np.concatenate(sets), return_inverse=True)
            who = np.repeat(np.arange(len(sets)), sizes)
            often = np.bincount(ids, minlength=len(values)) > 1
            column = np.cumsum(often) - 1
            hit = often[ids]
            who, ids = who[hit], column[ids[hit]]
            for start in range(0, int(often.sum()), 4096):
                m = np.zeros((len(sets), 4096), np.float32)
                part = (ids >= start) & (ids < start + 4096)
                m[who[part], ids[part] - start] = 1
                inter += m @ m.T
        union = sizes[:, None] + sizes[None, :] - inter
        ok = (100 * inter.astype(np.int64) >= percent * union.astype(np.int64)) & (comp[:, None] < comp[None, :])
        x, y = np.nonzero(ok)
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for i, k in zip(x.tolist(), y.tolist(), strict=True):
            p, q = find(int(comp[i])), find(int(comp[k]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(node[i]), int(node[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("pair").applyInPandas(run, "a long, b long")


def _linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per input row: doc_id, text_key, n_shingles, and its component as a node."""
    bound_batches(docs.sparkSession)
    signed = settle(sign(docs, k))
    named = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    same = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "halves", "sketch")).alias("s"))
    classes = settle(
        same.select("set_key", F.col("s.doc_id").alias("doc_id"), "s.halves", "s.sketch").withColumn(
            "node", F.monotonically_increasing_id()
        )
    )
    shared = settle_small(_shared_keys(classes))

    met_ones = classes.join(shared.select("node").distinct(), "node").select("node", "doc_id", "set_key")
    sets = settle(_sets(docs, settle(met_ones), k))
    met = shared.where("node <> lead").groupBy("node", "lead").agg(F.count("*").alias("n"))
    best = met.groupBy("node").agg(F.max(F.struct("n", (-F.col("lead")).alias("l"))).alias("m"))
    stars = best.select(F.col("node").alias("a"), (-F.col("m.l")).alias("b"))
    first = components(_verify(stars, sets, percent), "a", "b")

    comp = F.coalesce("root", "node")
    mine = shared.join(first, "node", "left").select("key", "node", comp.alias("comp"))
    mixed = mine.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    rows = mine.join(mixed.select("key"), "key").join(classes.select("node", "sketch"), "node")
    hints = components(_cluster_edges(rows.select("key", "comp", "sketch"), percent), "a", "b")
    clusters = hints.select(F.col("node").alias("comp"), F.col("root").alias("cluster"))
    inside = sets.select("node").join(first, "node", "left").select("node", comp.alias("comp")).join(clusters, "comp")
    pairs = _block_pairs(settle_small(inside))
    more = _compare_blocks(pairs.join(sets, "node"), percent)

    last = components(first.select("node", "root").union(more), "node", "root")
    placed = classes.select("set_key", "node", "doc_id").join(last, "node", "left").select("set_key", "doc_id", comp.alias("comp"))
    smallest = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    ids = placed.drop("doc_id").join(smallest, "comp")
    return signed.select("doc_id", "text_key", "n_shingles", "set_key").join(ids, "set_key", "left")


def link_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Rows whose word-shingle sets (k words, A-Z lowered) have at least ``percent``
    hundredths in common are linked; ``component_id`` is the smallest doc_id reachable.
    Null and wordless texts have no shingles and are linked with nothing. Repeated rows
    are exact copies. Rows that share an id but not a text are linked by their own texts
    only, each with its own component, whatever the order of the rows. A row without an id
    takes the component of its copies (NULL when it has none with an id) and is not kept
    as a representative. Very long texts are read whole; only their sets and hashes are
    kept. An empty table gives no rows. ``docs`` needs doc_id and text; other columns are
    ignored.
    """
    out = _linked(docs, k, percent)
    alone = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        alone.alias("component_id"),
        F.coalesce(F.col("doc_id") == alone, F.lit(False)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first of their group: by id, then by hash of the text.

    Repeated rows stay once. Rows that share an id but not a text are told apart by the
    text. Only rows whose id may be that of a dropped or repeated document are moved. Rows
    without an id cannot be named by a link and stay.
    """
    linked = settle_small(_linked(docs, k, percent).where(F.col("doc_id").isNotNull()))
    one = F.struct("doc_id", "text_key")
    # texts without shingles are groups of their own
    firsts = linked.where("comp IS NOT NULL").groupBy("comp").agg(F.min(one).alias("_first"))
    texts_ = linked.groupBy("doc_id", "text_key", "comp").agg(F.count("*").alias("_n")).join(firsts, "comp", "left")
    kept = F.coalesce(F.col("_first") == one, F.lit(True))
    each = settle(texts_.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), kept.alias("_kept"), "_n"))
    per = each.groupBy("_id").agg(F.bool_and("_kept").alias("k"), F.sum("_n").alias("n"))
    odd = hit_filter(settle(per.where("not k or n > 1").select("_id")), "_id")
    body = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    marked = with_hits(body, "_id", odd)
    free = marked.where("not _hit or _id is null").select("_row.*")

    @F.pandas_udf("binary")
    def text_key(part: pd.Series) -> pd.Series:
        return pd.Series([_text_key(t) for t in part], dtype=object)

    # a join asks for keys that are not null; the text must not be hashed again for that, by a second worker
    once = text_key.asNondeterministic()
    met = marked.where("_hit and _id is not null").withColumn("_text", once(F.col("_row.text").cast("string")))
    named = with_hits(each.where("_kept").select("_id", "_text"), "_id", odd).where("_hit").drop("_hit")
    stays = met.join(named, ["_id", "_text"])
    return free.union(stays.dropDuplicates(["_id", "_text"]).select("_row.*"))
