"""Toxicity: a subsequence string kernel with Nystroem landmarks under a linear SVM.

The kernel of two units (words) counts the three-character subsequences they share,
each occurrence weighted DECAY ** span, as gap-weighted subsequence kernels do; spans go
up to SPAN characters, so up to three characters may be inserted between the three.
The normalised kernel is raised to POWER (a product of kernels is a kernel) and taken as
0 below FAINT, so that most words are remembered without a vector. Units are
the words of a text without outer punctuation, with marks for their start and end, which
are matched like characters; single characters in a row
("x y z") are joined first, and words over WIDTH characters are read through
overlapping windows, so no part of a text goes unread.

A sentence is described by its best normalised kernel value against each landmark,
mapped by the inverse root of the landmark matrix. A linear SVM is fitted on sentences:
those that look worst in each training document, first by kernel value, then in ROUNDS
by the margin of the last fit, carry the label of their document. Each also appears with
a character inserted into its words. A document's score is a logistic regression, fitted
on training documents, on its three highest sentence margins and the log of how far its
WORST highest ones exceed -1 (long clean texts hold a chance likeness, not several).

Landmarks are the units that mark label 1 most clearly in the training rows, each unlike
those before it, and common units of label 0. Training reads at most TRAIN_ROWS labelled
documents per label, those of lowest hash; every document is scored whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbinger.llm.common import bound_batches, settle, texts

TRAIN_ROWS = 4000
# the sample is bounded, so are the tasks of each step of a fit
FIT_PARTS = 12
# a step over so few vectors costs less than its tasks, of which the driver keeps a record
STEP_PARTS = 4
MARKED, COMMON, CONSIDERED, ALIKE = 120, 8, 600, 0.8
LEAST_DOCS, LEAST_Z = 4, 5.0
TOP, WORST = 3, 8
ROUNDS = 2
DECAY, SPAN, WIDTH, POWER, FAINT = 0.7, 6, 20, 3, 0.03
CACHE_UNITS = 300_000
# units whose triples are held at once
TOGETHER = 1024
# characters of texts whose words are looked up together
GROUP_CHARS = 1_000_000
SYMBOLS = 64
START, END = "\x02", "\x03"
OUTER = " \t.,;:!?\"'()[]{}<>|*$%&#_-/\\~`^+="

# gaps (j, k) of the second and third character behind the first
GAPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


@dataclass
class ToxicModel:
    """Landmarks, SVM and curve; a few kilobytes whatever the corpus."""

    landmarks: list[str]
    weights: list[float]
    intercept: float
    curve: list[float]
    shift: float

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> ToxicModel:
        return ToxicModel(**json.loads(text))


def units_of(word: str) -> list[str]:
    """A word as units: outer punctuation off, long words in overlapping windows."""
    bare = word.strip(OUTER)
    if not bare:
        return []
    bare = f"{START}{bare}{END}"
    if len(bare) <= WIDTH:
        return [bare]
    return [bare[i : i + WIDTH] for i in range(0, len(bare) - WIDTH // 2, WIDTH // 2)]


def sentences_of(text: str | None) -> list[list[str]]:
    """Lower-cased words by sentence; a sentence ends with a line or at . ! ?"""
    out: list[list[str]] = []
    for line in (text or "").lower().split("\n"):
        now: list[str] = []
        spelled = ""
        for word in line.split():
            if len(word.strip(OUTER)) == 1:
                spelled += word.strip(OUTER)
            elif spelled:
                now.append(spelled)
                spelled = ""
            now.append(word)
            if word[-1] in ".!?":
                if spelled:
                    now.append(spelled)
                    spelled = ""
                out.append(now)
                now = []
        if spelled:
            now.append(spelled)
        if now:
            out.append(now)
    return out


def _codes(units: list[str], length: int) -> np.ndarray:
    """Characters as numbers below SYMBOLS: a-z, 0-9, then other characters by code."""
    points = np.array(units, f"<U{length}").view(np.uint32).reshape(len(units), length).astype(np.int64)
    out = 37 + points % (SYMBOLS - 37)
    out = np.where((points >= 97) & (points <= 122), points - 96, out)
    return np.where((points >= 48) & (points <= 57), points - 48 + 27, out)


@cache
def _places(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the three characters and weight, for every gap and start in a unit."""
    gaps = [(j, k, i) for j, k in GAPS for i in range(length - k)]
    j, k, i = np.array(gaps).reshape(-1, 3).T
    return i, i + j, i + k, DECAY ** (k + 1.0)


def _triples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the triples, a row for each gap and start and a column for each unit; weights of the rows)."""
    one, two, three, weight = _places(codes.shape[1])
    turned = np.ascontiguousarray(codes.T, np.int32)
    return (turned[one] * SYMBOLS + turned[two]) * SYMBOLS + turned[three], weight


class Kernel:
    """Normalised kernel values of units against landmarks."""

    def __init__(self, landmarks: list[str]):
        self.m = len(landmarks)
        found: dict[int, list[tuple[int, float]]] = {}
        for at, mark in enumerate(landmarks):
            mine: dict[int, float] = {}
            if len(mark) >= 3:
                codes, weights = _triples(_codes([mark], len(mark)))
                for c, weight in zip(codes[:, 0].tolist(), weights.tolist(), strict=True):
                    mine[c] = mine.get(c, 0.0) + weight
            norm = np.sqrt(sum(v * v for v in mine.values())) or 1.0
            for c, v in mine.items():
                found.setdefault(c, []).append((at, v / norm))
        # postings of each triple: landmark and weight, by a row number; the last row is empty
        self.place = np.full(SYMBOLS**3, len(found), np.int32)
        self.place[list(found)] = np.arange(len(found))
        self.ends = np.cumsum([0, *map(len, found.values()), 0])
        pairs = [p for posting in found.values() for p in posting]
        self.mark = np.array([p[0] for p in pairs], np.int64)
        self.weight = np.array([p[1] for p in pairs], np.float64)

    def values(self, units: list[str]) -> np.ndarray:
        parts = [self._values(units[i : i + TOGETHER]) for i in range(0, len(units), TOGETHER)]
        return np.concatenate(parts) if parts else np.zeros((0, self.m), np.float32)

    def _values(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), self.m), np.float32)
        lengths = np.array([len(u) for u in units])
        for length in np.unique(lengths):
            if length < 3:
                continue
            at = np.flatnonzero(lengths == length)
            codes = _codes([units[i] for i in at], int(length))
            triple, weight = _triples(codes)
            row = self.place[triple.ravel()]
            found = np.flatnonzero(row < len(self.ends) - 2)
            if not len(found):
                continue
            row, col, who = row[found], found // len(at), found % len(at)
            many = self.ends[row + 1] - self.ends[row]
            line = np.repeat(self.ends[row] - np.cumsum(many) + many, many) + np.arange(many.sum())
            cell = np.repeat(who, many) * self.m + self.mark[line]
            value = np.repeat(weight[col], many) * self.weight[line]
            kernel = np.bincount(cell, value, len(at) * self.m).reshape(len(at), self.m)
            # a unit's norm is least if no two of its triples are equal: what is faint by that norm stays faint
            least = np.sqrt((weight**2).sum())
            near = np.flatnonzero(kernel.max(1) >= (1 - 1e-6) * FAINT ** (1 / POWER) * least)
            # own norm: equal triples of a unit are summed before squaring
            own = triple.T[near]
            order = np.argsort(own, 1, kind="stable")
            own = np.take_along_axis(own, order, 1)
            w = weight[order]
            total = np.cumsum(w, 1)
            ends = np.concatenate([own[:, 1:] != own[:, :-1], np.ones((len(own), 1), bool)], 1)
            held = np.where(ends, total, 0.0)
            before = np.maximum.accumulate(np.concatenate([np.zeros((len(own), 1)), held[:, :-1]], 1), 1)
            square = (np.where(ends, total - before, 0.0) ** 2).sum(1)
            value = np.minimum(kernel[near] / np.sqrt(square)[:, None], 1) ** POWER
            out[at[near]] = np.where(value < FAINT, 0, value)
        return out


def root_inverse(landmarks: list[str]) -> np.ndarray:
    """K^(-1/2) of the landmarks, small eigenvalues raised."""
    k = Kernel(landmarks).values(landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    return (vector / np.sqrt(np.maximum(value, 0.05))) @ vector.T


class Reader:
    """Turns texts into per-sentence kernel values, remembering words between texts."""

    def __init__(self, landmarks: list[str], change=None):
        self.kernel = Kernel(landmarks)
        self.change = change
        self.reset()

    def reset(self) -> None:
        self.rows = np.zeros((1024, self.kernel.m), np.float32)
        self.used = 1  # row 0 is that of every word unlike all landmarks
        # by word: four times its row, plus 2 for a single character, plus 1 at a sentence's end
        self.ids: dict[str, int] = {}

    def _learn(self, words: list[str]) -> None:
        units, owner = [], []
        for at, word in enumerate(words):
            for u in units_of(self.change(word) if self.change else word):
                units.append(u)
                owner.append(at)
        values = np.zeros((len(words), self.kernel.m), np.float32)
        if units:
            own = np.array(owner)
            first = np.flatnonzero(np.diff(own, prepend=-1))
            values[own[first]] = np.maximum.reduceat(self.kernel.values(units), first, 0)
        alike = values.any(1)
        place = np.where(alike, self.used - 1 + np.cumsum(alike), 0)
        marks = [2 * (len(w.strip(OUTER)) == 1) + (w[-1] in ".!?") for w in words]
        self.ids.update(zip(words, (4 * place + np.array(marks, np.int64)).tolist(), strict=True))
        need = self.used + int(alike.sum())
        if need > len(self.rows):
            more = np.zeros((max(need, 2 * len(self.rows)), self.kernel.m), np.float32)
            more[: self.used] = self.rows[: self.used]
            self.rows = more
        self.rows[self.used : need] = values[alike]
        self.used = need

    def _learn_new(self, words: set[str]) -> None:
        new = list(words.difference(self.ids))
        for i in range(0, len(new), 8192):
            self._learn(new[i : i + 8192])

    def read_all(self, parts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """For each text one row of best kernel values for each sentence.

        Sentences are those of ``sentences_of``. New words of GROUP_CHARS characters of
        texts, or of one longer text, are learned together.
        """
        group, size = [], 0
        for text in parts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                yield from self._read(group)
                group, size = [], 0
        yield from self._read(group)

    def _read(self, group: list[str]) -> Iterator[np.ndarray]:
        if len(self.ids) > CACHE_UNITS:
            self.reset()
        lines = [[line.split() for line in text.lower().split("\n")] for text in group]
        words = [list(chain.from_iterable(x)) for x in lines]
        self._learn_new(set().union(*words))
        spots, sentence, spelled = [], [], []
        for x, mine in zip(lines, words, strict=True):
            spot = np.fromiter(map(self.ids.__getitem__, mine), np.int64, len(mine))
            first = np.zeros(len(mine) + 1, np.int64)
            first[np.cumsum([0, *map(len, x)])] = 1
            first[1:] |= spot & 1
            spots.append(spot)
            sentence.append(np.cumsum(first[:-1]) - 1)
            spelled.append(self._spelled(mine, spot, sentence[-1]))
        self._learn_new({w for x, _ in spelled for w in x})
        for spot, own, (joined, joined_own) in zip(spots, sentence, spelled, strict=True):
            out = np.zeros((int(own[-1]) + 1 if len(own) else 0, self.kernel.m), np.float32)
            self._raise(out, spot >> 2, own)
            if joined:
                self._raise(out, np.fromiter(map(self.ids.__getitem__, joined), np.int64, len(joined)) >> 2, joined_own)
            yield out

    def _spelled(self, words: list[str], spot: np.ndarray, sentence: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Words joined of single characters in a row, and their sentences."""
        single = np.flatnonzero(spot & 2)
        if not len(single):
            return [], single
        own = sentence[single]
        first = np.flatnonzero((np.diff(single, prepend=-2) != 1) | (np.diff(own, prepend=-1) != 0))
        letters = [words[i].strip(OUTER) for i in single.tolist()]
        ends = [*first[1:].tolist(), len(letters)]
        return ["".join(letters[a:b]) for a, b in zip(first.tolist(), ends, strict=True)], own[first]

    def _raise(self, out: np.ndarray, spots: np.ndarray, sentence: np.ndarray) -> None:
        """Raise each sentence's row to the best of its words."""
        at = np.flatnonzero(spots)
        spots, sentence = spots[at], sentence[at]
        for i in range(0, len(at), 20_000):  # so many words at a time, however long the text
            part, own = spots[i : i + 20_000], sentence[i : i + 20_000]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            best = np.maximum.reduceat(self.rows[part], first, 0)
            out[own[first]] = np.maximum(out[own[first]], best)


def _sample(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most about ``most`` rows of each label, by hash of the text and id."""
    total = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect()}
    share = F.lit(0.0)
    for value, n in total.items():
        share = F.when(F.col(label) == value, F.lit(min(1.0, most / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(draw < share)


def choose_landmarks(train: DataFrame, label: str) -> tuple[list[str], list[str]]:
    """Units in clearly more documents of label 1 (two-proportion z), and common ones."""

    def run(batches):
        for batch in batches:
            units, marks = [], []
            for text, y in zip(texts(batch), batch.column("y").to_pylist(), strict=True):
                mine = {u for s in sentences_of(text) for w in s for u in units_of(w) if len(u) >= 5}
                units.extend(mine)
                marks.extend([y] * len(mine))
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(marks, pa.int32())], ["unit", "y"])

    size = {r[0]: r[1] for r in train.groupBy(label).agg(F.count("*")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return [], []
    seen = train.select("text", F.col(label).cast("int").alias("y")).mapInArrow(run, "unit string, y int")
    count = seen.groupBy("unit").agg(F.sum("y").alias("d1"), F.sum(1 - F.col("y")).alias("d0"))
    count = settle(count)
    share = (F.col("d1") + F.col("d0")) / (n1 + n0)
    error = F.sqrt(share * (1 - share + 1e-9) * (1 / n1 + 1 / n0))
    clear = count.where(F.col("d1") >= LEAST_DOCS).withColumn("z", (F.col("d1") / n1 - F.col("d0") / n0) / error)
    clear = clear.where(F.col("z") > LEAST_Z)
    ranked = [r[0] for r in clear.orderBy(F.desc("z"), "unit").limit(CONSIDERED).select("unit").collect()]
    marked: list[str] = []
    if ranked:
        like = Kernel(ranked).values(ranked)
        taken: list[int] = []
        for i in range(len(ranked)):
            if len(taken) < MARKED and not (like[i, taken] > ALIKE).any():
                taken.append(i)
        marked = [ranked[i] for i in taken]
    common = [r[0] for r in count.orderBy(F.desc("d0"), "unit").limit(COMMON + len(marked)).select("unit").collect()]
    return marked, [u for u in common if u not in set(marked)][:COMMON]


def stretch(word: str) -> str:
    """The word with one character put into its middle, as evasive spellings do."""
    middle = len(word) // 2
    return word if len(word) < 5 else word[:middle] + ".-*x1"[len(word) % 5] + word[middle:]


def sentence_vectors(rows: DataFrame, landmarks: list[str], marked: int, label: str) -> DataFrame:
    """(doc_id, y, at, worst, x, z): vectors of sentences, as written and stretched.

    ``worst`` is the best kernel value against a marking landmark; the WORST sentences of
    a training document are its candidates, so what is stored is bounded by the sample.
    """
    root = root_inverse(landmarks).astype(np.float32)
    m = len(landmarks)

    def lists(parts):
        flat = np.concatenate(parts) if parts else np.zeros((0, m), np.float32)
        ends = np.arange(0, flat.size + 1, m, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))

    def run(batches):
        plain, bent = Reader(landmarks), Reader(landmarks, stretch)
        for batch in batches:
            ids, ys, at, worst, xs, zs = [], [], [], [], [], []
            read = zip(plain.read_all(texts(batch)), bent.read_all(texts(batch)), strict=True)
            for i, y, (x, z) in zip(batch.column("doc_id"), batch.column("y"), read, strict=True):
                if not len(x):
                    continue
                value = x[:, :marked].max(1)
                first = np.argsort(-value, kind="stable")[:WORST]
                ids.extend([i.as_py()] * len(first))
                ys.extend([float(y.as_py())] * len(first))
                at.extend(first.tolist())
                worst.extend(value[first].astype(float).tolist())
                xs.append((x @ root)[first])
                zs.append((z @ root)[first])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(ys, pa.float64()),
                    pa.array(at, pa.int32()),
                    pa.array(worst, pa.float64()),
                    lists(xs),
                    lists(zs),
                ],
                ["doc_id", "y", "at", "worst", "x", "z"],
            )

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"), "text")
    return rows.mapInArrow(run, "doc_id long, y double, at int, worst double, x array<float>, z array<float>")


def _margin(x: str, weights: list[float], intercept: float) -> Column:
    each = F.zip_with(x, F.array(*map(F.lit, weights)), lambda a, b: a.cast("double") * b)
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v) + F.lit(intercept)


def fit(train: DataFrame, label: str = "toxic") -> ToxicModel:
    """Fit on rows (doc_id, text, label 0/1) of a bounded number, see ``train_rows``.

    With no row of either label, or no unit that marks label 1, every text scores 0.
    """
    bound_batches(train.sparkSession)
    train = settle(train).coalesce(FIT_PARTS)
    marked, common = choose_landmarks(train, label)
    if not marked:
        return ToxicModel([], [], 0.0, [0.0] * (TOP + 1), -50.0)
    marks = marked + common
    vectors = settle(sentence_vectors(train, marks, len(marked), label)).coalesce(FIT_PARTS)
    rank = F.col("worst")
    for _ in range(ROUNDS):
        order = Window.partitionBy("doc_id").orderBy(F.desc("_rank"), "at")
        ranked = vectors.withColumn("_rank", rank).withColumn("_n", F.row_number().over(order))
        top = ranked.where(F.col("_n") <= TOP)
        points = top.select("y", F.explode(F.array("x", "z")).alias("x"))
        points = points.select("y", array_to_vector(F.col("x").cast("array<double>")).alias("features"))
        points = settle(points.coalesce(STEP_PARTS))
        svm = LinearSVC(labelCol="y", maxIter=60, tol=1e-4, regParam=1e-4, standardization=False).fit(points)
        w = [float(v) for v in svm.coefficients.toArray()]
        rank = _margin("x", w, float(svm.intercept))
    margins = vectors.select("doc_id", "y", rank.alias("m"))
    order = Window.partitionBy("doc_id", "y").orderBy(F.desc("m"))
    tops = margins.withColumn("n", F.row_number().over(order))
    floor = float(svm.intercept)
    each = [F.coalesce(F.max(F.when(F.col("n") == i, F.col("m"))), F.lit(floor)) for i in range(1, TOP + 1)]
    excess = F.log1p(F.sum(F.greatest(F.col("m") + 1, F.lit(0.0))))
    best = tops.groupBy("doc_id", "y").agg(F.array(*each, excess).alias("f"))
    curve = LogisticRegression(labelCol="y", maxIter=60, tol=1e-5, regParam=1e-4).fit(
        settle(best.select("y", array_to_vector("f").alias("features")).coalesce(STEP_PARTS))
    )
    return ToxicModel(marks, w, floor, [float(v) for v in curve.coefficients.toArray()], float(curve.intercept))


def document_features(margins: np.ndarray, floor: float) -> np.ndarray:
    """The highest margins, ``floor`` where a text has fewer, and the log of their excess."""
    top = np.full(TOP + 1, floor)
    best = np.sort(margins)[::-1][:WORST]
    top[: min(TOP, len(best))] = best[:TOP]
    top[TOP] = np.log1p(np.maximum(best + 1, 0).sum())
    return top


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Add ``toxic_score`` (0 to 1) to rows with a text column; nothing is shuffled.

    Null and wordless texts have no sentence and get the value for margins at the SVM's
    intercept, the margin of a sentence that resembles nothing.
    """
    bound_batches(docs.sparkSession)
    marks = model.landmarks
    direction = (root_inverse(marks) @ np.array(model.weights)).astype(np.float32) if marks else None
    curve = np.array(model.curve)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(marks) if marks else None
        for part in parts:
            out = []
            for rows in reader.read_all(part) if reader else [()] * len(part):
                margins = rows @ direction + model.intercept if len(rows) else np.empty(0)
                z = float(document_features(margins, model.intercept) @ curve) + model.shift
                out.append(1.0 / (1.0 + float(np.exp(-np.clip(z, -500, 500)))))
            yield pd.Series(out, dtype=float)

    # score and decision both name the result; the kernel must still run once
    return docs.withColumn("toxic_score", scored.asNondeterministic()(F.col("text").cast("string")))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_ROWS) -> DataFrame:
    """Labelled documents outside the held-out fifth, about ``most`` of each label.

    The sample is drawn from the labels, so its ids are few enough to send to every
    task and no text is moved for it. An id labelled twice takes the higher label.
    Rows without an id or text are never learned from.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label))
    known = known.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).alias(label)).where(~held_out())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    return rows.join(F.broadcast(_sample(known, label, most)), "doc_id").dropDuplicates(["doc_id"])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, learned from ``labels.toxic``."""
    bound_batches(docs.sparkSession)
    model = fit(train_rows(docs, labels))
    rows = score(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model does not reject; columns stay as they are.

    The score is named apart from any column the table may have.
    """
    bound_batches(docs.sparkSession)
    model = fit(train_rows(docs, labels))
    body = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("text").alias("text"))
    kept = score(body, model).where(F.col("toxic_score") < threshold)
    return kept.select("_row.*")
