import math
import random
from collections import Counter

import numpy as np

from harbinger.llm.langid import (
    LONGEST,
    SMOOTH,
    UNDEFINED,
    LanguageModel,
    PlainTable,
    fit,
    grams_of,
    identify,
    language_ids,
    letter_words,
    word_scores,
)

TEXT = {
    "en": "the house and the garden with this water",
    "de": "das haus und der garten mit dem wasser",
    "fr": "la maison et le jardin avec cette eau",
}


def rows(spark):
    out = [(i, f"{TEXT[x]} {i}", x) for i, x in enumerate(sorted(TEXT) * 20)]
    out += [(900, None, "en"), (901, "", "en"), (902, "123 ²½ --", "de"), (903, "das wasser", None), (None, "le jardin", "fr")]
    out += [(904, "gartenhaus wasserhaus " * 3000, "de"), (0, f"{TEXT['de']} 0", "de")]
    return spark.createDataFrame(out, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x"))


from pyspark.sql import functions as F  # noqa: E402


def test_words_first_then_shorter_grams():
    a, b, c = (np.array([x, -x], np.float32) for x in (1.0, 2.0, 3.0))
    model = LanguageModel(["p", "q"], PlainTable({"cat": a}), [PlainTable({"c": b}), PlainTable({"^d": c, "dx": c})])
    got = [w.tolist() for w in word_scores(["cat", "dx", "cz", "zz"], model)]
    assert got == [[1, -1], [3, -3], [2, -2], [0, 0]]


def test_predictions(spark):
    data = rows(spark)
    got = {r.doc_id: r for r in language_ids(data).collect()}
    truth = {r.doc_id: r.lang for r in data.collect()}
    assert language_ids(data).count() == data.count()
    for d, r in got.items():
        if d in (900, 901, 902):
            assert (r.lang_pred, r.score) == (UNDEFINED, 0.0)
        else:
            assert r.lang_pred == (truth[d] or "de") and 1 / 3 <= r.score <= 1
    assert not got[None].held_out and any(r.held_out for r in got.values())


def test_held_out_rows_teach_nothing(spark):
    data = rows(spark)
    wrong = data.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "xx").otherwise(F.col("lang")))
    assert sorted(map(str, language_ids(data).collect())) == sorted(map(str, language_ids(wrong).collect()))


def test_without_training_rows(spark, empty, documents):
    assert language_ids(empty).collect() == []
    none = fit(empty)
    assert {tuple(r.language) for r in identify(documents, none).collect()} == {(UNDEFINED, 0.0)}


def test_words_keep_their_marks():
    assert letter_words("नमस्ते दुनिया") == ["नमस्ते", "दुनिया"]
    assert letter_words("Don't x2y über_alles ²½") == ["don", "t", "x", "y", "über", "alles"]


def plain_model(pairs):
    """Counted and smoothed with dictionaries alone."""
    langs = sorted({lang for _, lang in pairs})
    words = {lang: Counter() for lang in langs}
    for text, lang in pairs:
        words[lang].update(letter_words(text))

    def table(counts):
        size = [max(1, sum(counts[x].values())) for x in langs]
        floor = SMOOTH / max(size)
        every = set().union(*counts.values())
        return {e: [math.log(counts[x][e] / size[i] + floor) for i, x in enumerate(langs)] for e in every}

    grams = []
    for n in range(1, LONGEST + 1):
        counts = {x: Counter() for x in langs}
        for x in langs:
            for word, times in words[x].items():
                for g in grams_of(word, n):
                    counts[x][g] += times
        grams.append(table(counts))
    return langs, table(words), grams


def plain_scores(text, langs, words, grams):
    total = [0.0] * len(langs)
    for word in letter_words(text):
        rows = [words[word]] if word in words else []
        for n in range(LONGEST, 0, -1):
            if not rows:
                rows = [grams[n - 1][g] for g in grams_of(word, n) if g in grams[n - 1]]
        for i in range(len(langs)):
            total[i] += sum(r[i] for r in rows) / len(rows) if rows else 0.0
    return total


def test_equals_plain_scoring(spark):
    """Every row scored again from plain counts; the vocabulary is larger than any table before."""
    draw = random.Random(7)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ßéñöüå"}

    def text(lang, n):
        return " ".join("".join(draw.choices(letters[lang], k=draw.randint(1, 9))) for _ in range(n))

    data = [(i, text(x, 900), x) for i, x in enumerate(sorted(letters) * 90)]
    data += [(1000 + i, text(x, draw.randint(1, 6)), x) for i, x in enumerate(sorted(letters) * 30)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(6)
    kept = frame.where("doc_id < 270")
    langs, words, grams = plain_model([(t, x) for d, t, x in data if d < 270])
    assert len(words) > 120_000
    model = fit(kept)
    got = {r.doc_id: r.language for r in identify(frame, model).collect()}
    for doc_id, t, _ in data:
        total = plain_scores(t, langs, words, grams)
        best = max(total)
        odds = 1 / sum(math.exp(max(x - best, -700)) for x in total)
        assert got[doc_id].score == np.float64(got[doc_id].score) and abs(got[doc_id].score - odds) < 1e-3
        if odds > 0.51:
            assert got[doc_id].lang_pred == langs[total.index(best)]


def test_a_column_named_language_stays(spark):
    frame = spark.createDataFrame([("das haus", "mine")], "text string, language string")
    out = identify(frame, LanguageModel([])).first()
    assert out.language == "mine" and out["_language"].lang_pred == UNDEFINED
