"""Language identification by word-first backoff.

A word seen in training is scored by its log frequency in each language. An unseen word
is scored by its character n-grams (marks for start and end included): the longest
length of which any n-gram is known, then shorter ones, down to single characters. The
language with the highest sum wins (the first in order of name among equals) and its
score is the posterior under equal priors.

Training counts words over about TRAIN_ROWS documents of each language, those of lowest
hash, each read whole, which is the only bounded part: every word and n-gram counted there
is in the tables. These are made in tasks, written to the shared folder as hash and log
frequencies, and read from there by the workers that score; the driver sees their sums
alone. Every document is scored whole. ``und`` is returned for a text that is null or has
no letter.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import regex
import xxhash
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import bound_batches, settle, texts
from harbinger.sources.shared import shared_folder

TRAIN_ROWS = 5000
LONGEST = 4
SMOOTH = 0.5
CACHE = 300_000
UNDEFINED = "und"
ASCII_LETTERS = re.compile(r"[a-z]+")
# a letter takes the marks that follow it along, such as vowel signs
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
HASH_SEED = 42  # of the engine's xxhash64


_LOADED: dict[str, tuple[np.ndarray, np.ndarray]] = {}


@dataclass(frozen=True)
class StoredTable:
    """Log frequencies by hash of the entry, read once by each worker from a shared folder."""

    path: str
    columns: int

    def _rows(self) -> tuple[np.ndarray, np.ndarray]:
        if self.path not in _LOADED:
            system, name = arrow_fs.FileSystem.from_uri(self.path)
            table = ds.dataset(name, filesystem=system, format="parquet").to_table()
            keys = table.column("h").to_numpy().view(np.uint64)
            logs = table.column("logs").combine_chunks().flatten().to_numpy().reshape(len(keys), self.columns)
            order = np.argsort(keys)
            _LOADED[self.path] = keys[order], logs[order]
        return _LOADED[self.path]

    def lookup(self, entries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(whether the table holds each entry, the rows of those it holds)."""
        keys, logs = self._rows()
        if not len(keys):
            return np.zeros(len(entries), bool), logs
        wanted = np.array([xxhash.xxh64_intdigest(e, HASH_SEED) for e in entries], np.uint64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        held = keys[at] == wanted
        return held, logs[at[held]]


@dataclass(frozen=True)
class PlainTable:
    """The same over a dictionary."""

    rows: dict[str, np.ndarray]

    def lookup(self, entries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        held = np.array([e in self.rows for e in entries], bool)
        return held, np.array([self.rows[e] for e in entries if e in self.rows])


Table = StoredTable | PlainTable


@dataclass
class LanguageModel:
    """Log frequencies by word and by n-gram, one column for each language."""

    langs: list[str]
    words: Table = field(default_factory=lambda: PlainTable({}))
    grams: list[Table] = field(default_factory=list)  # of length 1, 2, ...


def letter_words(text: str | None) -> list[str]:
    """Runs of letters with their marks, lower-cased."""
    lowered = (text or "").lower()
    return (ASCII_LETTERS if lowered.isascii() else LETTERS).findall(lowered)


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def gram_scores(word: str, model: LanguageModel) -> np.ndarray:
    """Log frequency of an unseen word: the longest n-grams of which any is known."""
    for n in range(len(model.grams), 0, -1):
        held, seen = model.grams[n - 1].lookup(grams_of(word, n))
        if held.any():
            return np.mean(seen, axis=0)
    return np.zeros(len(model.langs))


def word_scores(words: list[str], model: LanguageModel) -> list[np.ndarray]:
    """Log frequency of every word in each language, backing off where it is unseen."""
    held, rows = model.words.lookup(words)
    known = iter(rows)
    return [next(known) if h else gram_scores(w, model) for w, h in zip(words, held.tolist(), strict=True)]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, most: int) -> DataFrame:
    total = docs.groupBy("lang").agg(F.count("*").alias("_n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one row for each language, as many as the model has columns; texts are not shuffled for it
    return docs.join(F.broadcast(total), "lang").where(draw < F.lit(float(most)) / F.col("_n")).drop("_n")


def fit(docs: DataFrame, most: int = TRAIN_ROWS) -> LanguageModel:
    """Learn from (doc_id, text, lang); rows without a text or language are left out."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null and doc_id is not null")

    def run(batches):
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                seen.setdefault(lang, Counter()).update(letter_words(text))
            for lang, words in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(words), pa.string()),
                        pa.array(list(words), pa.string()),
                        pa.array(list(words.values()), pa.int64()),
                    ],
                    ["lang", "word", "n"],
                )

    counted = _sample(rows, most).select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    words = settle(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    model = LanguageModel(langs)
    if langs:
        model.words = _table(words, langs)
        for n in range(1, LONGEST + 1):
            padded = F.concat(F.lit("^"), "word", F.lit("$")) if n > 1 else F.col("word")
            start = F.explode(F.sequence(F.lit(1), F.char_length("_p") - n + 1)).alias("_i")
            cut = words.withColumn("_p", padded).where(F.char_length("_p") >= n).select("lang", "n", "_p", start)
            model.grams.append(_table(cut.select("lang", F.expr(f"substring(_p, _i, {n})").alias("word"), "n"), langs))
    return model


def _table(counts: DataFrame, langs: list[str]) -> StoredTable:
    """Smoothed log frequencies of all entries, written to the shared folder."""
    each = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"c{i}") for i, lang in enumerate(langs)]
    wide = settle(counts.groupBy("word").agg(*each))
    total = wide.agg(*[F.sum(f"c{i}") for i in range(len(langs))]).first()
    size = [max(1.0, float(v or 0)) for v in total]
    # one floor for all languages, so that a language with more text does not lose by it
    floor = SMOOTH / max(size)
    logs = F.array(*[F.log(F.col(f"c{i}") / size[i] + floor).cast("float") for i in range(len(langs))])
    folder = f"{shared_folder(counts.sparkSession)}/language-{uuid.uuid4().hex}"
    wide.select(F.xxhash64("word").alias("h"), logs.alias("logs")).write.parquet(folder)
    return StoredTable(_arrow_uri(folder), len(langs))


def _arrow_uri(path: str) -> str:
    """``file:/x`` and ``/x`` as ``file:///x``, which is how Arrow spells them."""
    path = path.removeprefix("file:") if path.startswith("file:") else path
    return "file:///" + path.lstrip("/") if path.startswith("/") else path


class Scorer:
    """Sums word scores, remembering the words met."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.known: dict[str, np.ndarray] = {}

    def of(self, text: str | None) -> tuple[str, float]:
        words = letter_words(text)
        if not words or not self.model.langs:
            return UNDEFINED, 0.0
        if len(self.known) > CACHE:
            self.known.clear()
        counts = Counter(words)
        new = [w for w in counts if w not in self.known]
        if new:
            self.known.update(zip(new, word_scores(new, self.model), strict=True))
        rows = np.array([self.known[w] for w in counts], np.float64)
        total = np.array(list(counts.values()), np.float64) @ rows
        best = int(total.argmax())
        return self.model.langs[best], 1.0 / float(np.exp(np.maximum(total - total[best], -700)).sum())


def _predictor(model: LanguageModel):
    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for part in parts:
            yield pd.DataFrame([scorer.of(t) for t in part], columns=["lang_pred", "score"])

    # both fields are read from one result
    return predict.asNondeterministic()


def identify(docs: DataFrame, model: LanguageModel, out: str = "language") -> DataFrame:
    """Add struct ``out`` (lang_pred, score) to rows with a text; nothing is shuffled.

    A column that has that name already stays, and the new one gets a leading underscore.
    """
    bound_batches(docs.sparkSession)
    while out in docs.columns:
        out = f"_{out}"
    return docs.withColumn(out, _predictor(model)(F.col("text").cast("string")))


def language_ids(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, learned from rows not held out.

    Repeated rows give repeated rows. A row without an id is scored, never learned from.
    Without any training row every prediction is ``und`` with score 0.
    """
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    rows = identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")

