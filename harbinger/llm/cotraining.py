"""Quality scores by co-training two views of a document.

The content view sees words (hashed) and what they are made of; the metadata view sees
the language, source and length columns and the layout of lines. Each is a logistic
regression. Both views of every document are made once, in tasks, and stored.

In each of ROUNDS a view scores every document that has no label and is not held out. Its
surest ones, a share of all of them that grows by CONFIDENT each round, in the proportion of
the known labels, are found by a histogram of the scores over all such documents and become
training rows of the other view: at most about DRAW_ROWS of each side by hash of the id, and
weighed so that they count as much as the labelled rows, however many were drawn. Each view
is then calibrated, and the two are combined, by logistic curves fitted on labelled rows
kept out of both fits.

The only bounded parts are those fits: at most about TRAIN_ROWS labelled documents of each
label, and DRAW_ROWS confident ones of each side.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import BATCH_ROWS, bound_batches, byte_words, clean_columns, hit_filter, settle, with_hits
from harbinger.sources.shared import shared_folder

TRAIN_ROWS, DRAW_ROWS = 3000, 1500
ROUNDS, CONFIDENT = 3, 0.1
# buckets of the logit histogram
LOGIT_STEP, LOGIT_END = 0.05, 30.0
# the samples are bounded, so are the tasks of each step of a fit
FIT_PARTS = 12
WORD_SLOTS, NAME_SLOTS = 256, 64
PUNCTUATION = b".,;:!?"
MARKS = b"#*$%&|<>=+_~^@"


class _Slots(dict):
    """Slot of a word, and whether it holds an upper-case letter, a digit or a mark."""

    def __missing__(self, word: bytes) -> tuple[int, int, int, int, int]:
        value = self[word] = (
            xxhash.xxh3_64_intdigest(word.lower().strip(PUNCTUATION + MARKS)) % WORD_SLOTS,
            int(word.isupper()),
            int(any(48 <= c <= 57 for c in word)),
            int(any(c in MARKS for c in word)),
            int(word[-1] in PUNCTUATION),
        )
        return value


def content_features(text: str | None, slots: _Slots) -> np.ndarray:
    """Log counts of hashed words as shares of the text, and rates of its make-up."""
    out = np.zeros(WORD_SLOTS + 9)
    words = byte_words(text)
    n = len(words)
    if not n:
        return out
    if len(slots) > 300_000:
        slots.clear()
    seen = np.array([slots[w] for w in words])
    out[:WORD_SLOTS] = np.sqrt(np.bincount(seen[:, 0], minlength=WORD_SLOTS) / n)
    count = Counter(words)
    out[WORD_SLOTS:] = [
        1.0,
        *seen[:, 1:].mean(0),
        len(count) / n,
        max(count.values()) / n,
        min(1.0, sum(map(len, words)) / n / 20),
        sum(map(eq, words[1:], words)) / (n - 1) if n > 1 else 0.0,
    ]
    return out


def metadata_features(text: str | None, lang, source, n_chars) -> np.ndarray:
    """Hashed language and source, log length, and the layout of lines."""
    out = np.zeros(NAME_SLOTS + 7)
    for name in (f"lang={lang}", f"source={source}"):
        out[xxhash.xxh3_64_intdigest(name) % NAME_SLOTS] = 1.0
    lines = (text or "").split("\n")
    size = np.array([len(x) for x in lines])
    length = 0.0 if n_chars is None or n_chars != n_chars else max(0.0, float(n_chars))
    out[NAME_SLOTS:] = [
        1.0,
        np.log1p(length) / 10,
        np.log1p(len(lines)) / 5,
        np.log1p(size.mean()) / 8,
        np.log1p(size.max()) / 10,
        float((size == 0).mean()),
        1 - len(set(lines)) / len(lines),
    ]
    return out


@dataclass
class QualityModel:
    """Weights of both views, their curves, and the weights that combine them."""

    content: np.ndarray
    metadata: np.ndarray
    curves: np.ndarray  # slope and shift of each view
    blend: np.ndarray  # weight of each calibrated logit, and a shift


def _draw(most: int, total: int, salt: str) -> Column:
    """About ``most`` of ``total`` rows, by hash of the id."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return part < min(1.0, most / max(1, total))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *clean_columns(docs, "text", "lang", "source", "n_chars")).select(
        "doc_id",
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("double").alias("n_chars"),
    )


CONTENT, METADATA = WORD_SLOTS + 9, NAME_SLOTS + 7
STORED = np.dtype("<f2")


def _view_bytes(text, lang, source, n_chars, slots: _Slots) -> tuple[bytes, bytes]:
    """Both views as stored: half floats, in which they are fitted and scored alike."""
    return (
        content_features(text, slots).astype(STORED).tobytes(),
        metadata_features(text, lang, source, n_chars).astype(STORED).tobytes(),
    )


def _matrix(blobs, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), STORED).reshape(len(blobs), width).astype(np.float64)


def stored_views(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b) of every row, written once to the shared folder."""
    bound_batches(docs.sparkSession, BATCH_ROWS)

    @F.pandas_udf("a binary, b binary")
    def views(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        slots = _Slots()
        for text, lang, source, n in parts:
            made = [_view_bytes(*x, slots) for x in zip(text, lang, source, n, strict=True)]
            yield pd.DataFrame({"a": [x[0] for x in made], "b": [x[1] for x in made]})

    made = views.asNondeterministic()("text", "lang", "source", "n_chars")
    rows = _columns(docs).withColumn("_v", made).select("doc_id", "_v.a", "_v.b")
    folder = f"{shared_folder(docs.sparkSession)}/quality-views-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _logits(a: str, b: str, weights: dict[str, np.ndarray]) -> Column:
    @F.pandas_udf("a double, b double")
    def scored(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"a": _matrix(x, CONTENT) @ weights["a"], "b": _matrix(y, METADATA) @ weights["b"]})

    return scored(a, b)


def _as_vector(x: str, width: int) -> Column:
    @F.pandas_udf("array<double>")
    def values(blobs: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(blobs, width)))

    return array_to_vector(values(x))


def _regression(rows: DataFrame, x: str) -> np.ndarray:
    """Weights of one view from (y, w, view)."""
    points = rows.select("y", "w", _as_vector(x, CONTENT if x == "a" else METADATA).alias("features"))
    fit = LogisticRegression(
        labelCol="y", weightCol="w", fitIntercept=False, standardization=False, regParam=1e-3, maxIter=50, tol=1e-5
    ).fit(settle(points).coalesce(FIT_PARTS))
    return fit.coefficients.toArray()


def _curve(rows: DataFrame, columns: list[Column]) -> np.ndarray:
    points = rows.select("y", array_to_vector(F.array(*columns)).alias("features"))
    fit = LogisticRegression(labelCol="y", regParam=1e-3, maxIter=50, tol=1e-5).fit(points)
    return np.append(fit.coefficients.toArray(), fit.intercept)


def confident_ends(scored: DataFrame, positive: float, share: float) -> dict[str, tuple[float, float, int, int]]:
    """(lowest sure logit, highest sure one, rows above, rows below) of each view.

    ``scored`` holds the logits a and b of all unlabelled rows. The sure ones are the bucket
    tails that hold the share, split in the proportion of the labels, and lie on their side
    of zero; a bucket counts whole.
    """
    bucket = {x: F.floor(F.greatest(F.least(F.col(x), F.lit(LOGIT_END)), F.lit(-LOGIT_END)) / LOGIT_STEP).cast("int") for x in "ab"}
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("view"), c.alias("at")) for x, c in bucket.items()]))
    # at most 2 * LOGIT_END / LOGIT_STEP buckets a view
    counted = scored.select(each.alias("s")).groupBy("s.view", "s.at").agg(F.count("*").alias("n")).collect()
    out = {}
    for x in "ab":
        mine = sorted((r["at"], r["n"]) for r in counted if r["view"] == x)
        total = sum(n for _, n in mine)
        ends = {}
        for side, wanted, order in (("up", share * positive, mine[::-1]), ("down", share * (1 - positive), mine)):
            seen, end = 0, None
            for at, n in order:
                if seen >= wanted * total or (at < 0 if side == "up" else at >= 0):
                    break
                seen, end = seen + n, at
            ends[side] = (end, seen)
        low = float("inf") if ends["up"][0] is None else ends["up"][0] * LOGIT_STEP
        high = float("-inf") if ends["down"][0] is None else (ends["down"][0] + 1) * LOGIT_STEP
        out[x] = (low, high, ends["up"][1], ends["down"][1])
    return out


def _confident(scored: DataFrame, teacher: str, ends: tuple, weigh: float, positive: float, step: int) -> DataFrame:
    """(y, w, views) of a draw of the teacher's sure rows, weighing ``weigh`` in all."""
    low, high, above, below = ends
    z, salt = F.col(f"z.{teacher}"), f"{teacher}{step}"
    up = scored.where((z >= low) & _draw(DRAW_ROWS, above, salt)).withColumn("y", F.lit(1.0))
    down = scored.where((z < high) & _draw(DRAW_ROWS, below, salt)).withColumn("y", F.lit(0.0))
    rows = settle(up.union(down).select("doc_id", "y", "a", "b").dropDuplicates(["doc_id"]))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    w = F.when(F.col("y") == 1, weigh * positive / sizes.get(1.0, 1)).otherwise(weigh * (1 - positive) / sizes.get(0.0, 1))
    return rows.select("y", w.alias("w"), "a", "b")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel | None:
    """Learn from labelled documents outside the held-out fifth; None without both labels."""
    return fit_views(stored_views(docs), labels, label)


def fit_views(views: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel | None:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    known = known.where(F.col("y").isin(0.0, 1.0) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = settle(known)
    size = {r[0]: r[1] for r in known.where(~held_out()).groupBy("y").agg(F.count("*")).collect()}
    if len(size) < 2:
        return None
    share = F.when(F.col("y") == 1, _draw(TRAIN_ROWS, size[1.0], "quality")).otherwise(_draw(TRAIN_ROWS, size[0.0], "quality"))
    # at most about TRAIN_ROWS ids of each label
    chosen = F.broadcast(known.where(~held_out() & share))
    rows = views.where("doc_id is not null")
    labelled = settle(rows.join(chosen, "doc_id").dropDuplicates(["doc_id"])).coalesce(FIT_PARTS)
    # a row whose id is surely not labelled never moves
    marked = with_hits(rows.where(~held_out()), "doc_id", hit_filter(known, "doc_id"))
    maybe = marked.where("_hit").drop("_hit").join(known.select("doc_id"), "doc_id", "left_anti")
    pool = marked.where("not _hit").drop("_hit").unionByName(maybe)

    # one labelled row in four is for calibration alone
    kept = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0
    train, check = labelled.where(~kept), labelled.where(kept)
    if check.select("y").distinct().count() < 2 or train.select("y").distinct().count() < 2:
        train = check = labelled
    train = train.withColumn("w", F.lit(1.0)).select("y", "w", "a", "b")
    weigh = float(train.count())
    positive = size[1.0] / (size[1.0] + size[0.0])
    extra: dict[str, DataFrame | None] = {"a": None, "b": None}
    weights: dict[str, np.ndarray] = {}
    for step in range(ROUNDS + 1):
        for x in ("a", "b"):
            weights[x] = _regression(train if extra[x] is None else train.union(extra[x]), x)
        if step == ROUNDS:
            break
        scored = pool.withColumn("z", _logits("a", "b", dict(weights)))
        ends = confident_ends(scored.select("z.a", "z.b"), positive, CONFIDENT * (step + 1))
        for teacher, pupil in (("a", "b"), ("b", "a")):
            extra[pupil] = _confident(scored, teacher, ends[teacher], weigh, positive, step)
    checked = settle(check.withColumn("z", _logits("a", "b", dict(weights))).select("y", "z.a", "z.b"))
    ca, cb = _curve(checked, [F.col("a")]), _curve(checked, [F.col("b")])
    blend = _curve(checked, [F.col("a") * float(ca[0]) + float(ca[1]), F.col("b") * float(cb[0]) + float(cb[1])])
    return QualityModel(weights["a"], weights["b"], np.array([ca, cb]), blend)


def _scores(a: pd.Series, b: pd.Series, model: QualityModel) -> pd.DataFrame:
    z = np.vstack([_matrix(a, CONTENT) @ model.content, _matrix(b, METADATA) @ model.metadata])
    z = z * model.curves[:, :1] + model.curves[:, 1:]
    both = model.blend[0] * z[0] + model.blend[1] * z[1] + model.blend[2]
    p = 1 / (1 + np.exp(-np.clip(np.vstack([z, both]), -500, 500)))
    return pd.DataFrame({"content_score": p[0], "metadata_score": p[1], "score": p[2]})


def score_views(views: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id, content_score, metadata_score and score of stored views; NULL without a model."""
    if model is None:
        return views.select("doc_id", *[F.lit(None).cast("double").alias(c) for c in ("content_score", "metadata_score", "score")])

    @F.pandas_udf("content_score double, metadata_score double, score double")
    def scored(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return _scores(a, b, model)

    return views.select("doc_id", scored("a", "b").alias("_s")).select("doc_id", "_s.*")


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id, content_score, metadata_score and score (0 to 1; higher: label 1 likelier).

    Without a model every score is NULL. Null texts have the features of empty ones;
    missing metadata columns count as NULL.
    """
    if model is None:
        return score_views(_columns(docs), None)
    return score_views(stored_views(docs), model)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, view scores, score and kept (score of one half or more) for every row.

    Repeated rows are scored each and learned from once; rows without an id are scored only.
    Very long texts are read whole; their views have a fixed size. An empty table gives no
    rows, and labels of one kind alone NULL scores.
    """
    views = stored_views(docs)
    rows = score_views(views, fit_views(views, labels))
    return rows.select(
        "doc_id", held_out().alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= 0.5).alias("kept")
    )
