"""Co-training takes in every unlabelled document; its ends equal a plain count."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harbinger.llm import cotraining as C


def plain_ends(logits, positive, share):
    """Walk the buckets of all logits from either end."""
    at = np.floor(np.clip(logits, -C.LOGIT_END, C.LOGIT_END) / C.LOGIT_STEP).astype(int)
    up = down = 0
    low, high = float("inf"), float("-inf")
    for b in sorted(set(at.tolist()), reverse=True):
        if up >= share * positive * len(at) or b < 0:
            break
        up, low = up + int((at == b).sum()), b * C.LOGIT_STEP
    for b in sorted(set(at.tolist())):
        if down >= share * (1 - positive) * len(at) or b >= 0:
            break
        down, high = down + int((at == b).sum()), (b + 1) * C.LOGIT_STEP
    return low, high, up, down


@pytest.mark.parametrize("shift, positive, share", [(0.0, 0.5, 0.1), (3.0, 0.7, 0.3), (-40.0, 0.2, 0.2)])
def test_ends_equal_a_plain_count(spark, shift, positive, share):
    draw = np.random.default_rng(1)
    a, b = draw.normal(shift, 2, 5000), draw.normal(0, 9, 5000)
    frame = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "a double, b double").repartition(6)
    got = C.confident_ends(frame, positive, share)
    assert got == {"a": plain_ends(a, positive, share), "b": plain_ends(b, positive, share)}


@pytest.fixture(scope="module")
def table(spark):
    """6,000 documents of which 200 are labelled; good ones are long and varied, bad ones repeat."""
    draw = random.Random(3)
    good, bad = [f"word{i}" for i in range(400)], ["buy", "now", "$$$", "click"]
    rows, labels = [], []
    for i in range(6000):
        y = int(draw.random() < 0.6)
        words = draw.choices(good if y else bad, k=draw.randint(20, 60) if y else draw.randint(10, 30))
        rows.append((i, " ".join(words) + ("\n" * draw.randint(0, 2 + 3 * (1 - y))), "en", "site" if y else "shop", None))
        if i < 200:
            labels.append((i, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int"), {r[0]: int(r[3] == "site") for r in rows}


def test_every_unlabelled_document_takes_part(spark, table, monkeypatch):
    docs, labels, truth = table
    seen = []

    def counted(scored, *more, real=C.confident_ends):
        seen.append((scored.count(), real(scored, *more)))
        return seen[-1][1]

    monkeypatch.setattr(C, "confident_ends", counted)
    views = C.stored_views(docs)
    model = C.fit_views(views, labels)
    held = docs.where(C.held_out()).where("doc_id >= 200").count()
    assert [n for n, _ in seen] == [5800 - held] * C.ROUNDS
    # the exchange grows with the corpus and the rounds
    sure = [ends["a"][2] + ends["a"][3] for _, ends in seen]
    assert sure[0] >= 0.1 * (5800 - held) * 0.9 and sure[2] > sure[0]
    scored = C.score_views(views, model).join(docs.where(C.held_out()).select("doc_id"), "doc_id").collect()
    right = np.mean([(r.score >= 0.5) == bool(truth[r.doc_id]) for r in scored])
    assert right > 0.97
    # stored views and a model scored again, row by row in plain numpy
    some = views.where("doc_id < 20").collect()
    again = {r.doc_id: r.score for r in C.score_views(views.where("doc_id < 20"), model).collect()}
    for r in some:
        za = np.frombuffer(r.a, "<f2").astype(float) @ model.content * model.curves[0, 0] + model.curves[0, 1]
        zb = np.frombuffer(r.b, "<f2").astype(float) @ model.metadata * model.curves[1, 0] + model.curves[1, 1]
        p = 1 / (1 + np.exp(-(model.blend @ [za, zb, 1.0])))
        assert again[r.doc_id] == pytest.approx(p, abs=1e-9)


def test_a_row_beyond_any_sample_changes_the_ends(spark):
    """One more sure row in a large table moves the counts it is part of."""
    rows = spark.range(20000).select((F.col("id") % 7 - 3).cast("double").alias("a"), F.lit(0.5).alias("b"))
    more = rows.union(spark.createDataFrame([(9.0, 9.0)], "a double, b double"))
    assert C.confident_ends(rows, 0.5, 0.0001)["a"] != C.confident_ends(more, 0.5, 0.0001)["a"]
