import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harbinger.llm.hard_negatives import MINED, Space, Tree, mine, scaled

SCHEMA = "vec_id long, label long, vector array<long>"


def brute(rows, anchors, positives=5, negatives=5, least=80, most=100):
    """Every anchor against every row, in plain Python."""
    width = max((len(v) for _, _, v in rows if v is not None), default=0)
    valid = [r for r in rows if None not in r and None not in r[2]]
    by_id = {}
    for i, label, v in valid:
        v = tuple(v) + (0,) * (width - len(v))
        by_id.setdefault(i, []).append((label, v))
    once = {i: min(own, key=lambda r: (r[0], np.array(r[1], "<i2").tobytes())) for i, own in by_id.items()}
    out = []
    for a, (label, v) in once.items():
        if not anchors(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in once.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            hard = [x for x in scores if x[2] != label and least * -s <= 100 * -x[0] <= most * -s][:negatives]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(hard, 1)]
    return sorted(out)


def got(frame, **more):
    return sorted(tuple(r) for r in mine(frame, F.col("vec_id") % 10 == 0, **more).select(*MINED).collect())


@pytest.mark.parametrize("seed, n, width, spread", [(1, 500, 6, 3), (2, 700, 16, 40), (3, 300, 2, 2)])
def test_equals_every_pair(spark, seed, n, width, spread):
    draw = np.random.default_rng(seed)
    centres = draw.integers(-100, 100, (6, width))
    rows = []
    for i in range(n):
        k = int(draw.integers(0, 6))
        rows.append((i, k if draw.random() < 0.7 else int(draw.integers(0, 6)), (centres[k] + draw.integers(-spread, spread, width)).tolist()))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    expected = brute(rows, lambda i: i % 10 == 0)
    assert expected and got(frame, fanout=4, leaf_rows=25) == expected


def test_copies_ties_and_odd_rows(spark):
    draw = random.Random(5)
    rows = [(i, i % 3, [5, 5, 5]) for i in range(0, 300)]  # equal vectors, three labels
    rows += [(i, i % 4, [draw.randint(-9, 9) for _ in range(draw.choice([0, 2, 3]))]) for i in range(300, 500)]
    rows += [(500, None, [1, 2, 3]), (None, 1, [1, 2, 3]), (510, 1, None), (520, 1, [1, None, 3]), (530, 9, [1, 1, 1])]
    rows += [rows[10], rows[10], (20, 1, [9, 9, 9]), (310, 0, [])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("x")).withColumn("query", F.lit(1))
    assert got(frame, fanout=4, leaf_rows=20) == brute(rows, lambda i: i % 10 == 0)


def test_large_components_stay_exact(spark):
    rows = [(i, i % 2, [2_000_000_000 + i * 7, -1_500_000_000 + i]) for i in range(60)]
    valid = {i: (label, v) for i, label, v in rows}
    for r in got(spark.createDataFrame(rows, SCHEMA)):
        assert r[4] == sum(x * y for x, y in zip(valid[r[0]][1], valid[r[1]][1], strict=True))
        assert r[5] == sum(x * y for x, y in zip(valid[r[0]][1], valid[r[3]][1], strict=True)) <= r[4]


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(10, 1, []), (20, 2, [])], SCHEMA)) == []


def test_scaled_components(spark):
    rows = [(1, [0.5, -0.001]), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf")]), (5, None), (6, [])]
    frame = spark.createDataFrame(rows, "i int, v array<float>")
    assert {r.i: r.s for r in frame.select("i", scaled("v").alias("s")).collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_subtrees_are_skipped_only_when_empty_handed():
    draw = np.random.default_rng(4)
    centres = draw.integers(-100, 100, (12, 4))
    rows = (centres[draw.integers(0, 12, 3000)] + draw.integers(-4, 4, (3000, 4))).astype(float)
    space = Space(4, 200, float((rows**2).sum(1).max()))
    tree = Tree.fit(space, rows[:1500], 3000, 6, 100)
    leaf, ranges = tree.descend(rows)
    for node, j, near, far in ranges:
        tree.near[node][:, j], tree.far[node][:, j] = near, far
    queries = rows[:80]
    scores = queries @ rows.T
    top = np.sort(scores, 1)[:, ::-1][:, [20]]
    reached = tree.reach(queries, top, scores.max(1, keepdims=True))
    asked = {(q, at) for at, own in reached for q in own.tolist()}
    needed = {(q, int(leaf[r])) for q in range(80) for r in np.flatnonzero(scores[q] >= top[q])}
    assert needed <= asked
    assert len(asked) < 80 * tree.leaves / 2
