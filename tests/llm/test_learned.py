import random
import tracemalloc

import numpy as np
import pytest

from harbinger.llm import cotraining, toxicity


def kernel(a, b):
    """Gap-weighted three-character subsequences within SPAN, counted one by one, normalised."""

    def parts(s):
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    key = s[i] + s[j] + s[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    p, q = parts(a), parts(b)
    dot = sum(v * q.get(u, 0) for u, v in p.items())
    norm = (sum(v * v for v in p.values()) * sum(v * v for v in q.values())) ** 0.5
    value = (dot / norm if norm else 0) ** toxicity.POWER
    return value if value >= toxicity.FAINT else 0


def test_kernel_equals_enumeration():
    draw = random.Random(1)
    units = ["".join(draw.choices("abcdx1.", k=draw.randint(1, 12))) for _ in range(80)]
    marks = [u for u in units if len(u) > 3][:9]
    got = toxicity.Kernel(marks).values(units)
    want = np.array([[kernel(u, m) for m in marks] for u in units])
    assert np.allclose(got, want, atol=1e-5)


def test_kernel_holds_few_units_at_once():
    draw = random.Random(2)
    units = ["".join(draw.choices("abcdefgh", k=20)) for _ in range(8192)]
    read = toxicity.Kernel(units[:128])
    tracemalloc.start()
    values = read.values(units)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6
    some = random.Random(3).sample(range(len(units)), 50)
    assert np.array_equal(values[some], np.concatenate([read.values([units[i]]) for i in some]))


def test_units_cover_long_words():
    word = "".join(random.Random(2).choices("abcdef", k=95))
    units = toxicity.units_of(word)
    assert all(word[i : i + 8] in "".join(units) or any(word[i : i + 8] in u for u in units) for i in range(87))
    assert toxicity.sentences_of("a b c. de\n\nf") == [["a", "b", "c.", "abc"], ["de"], ["f", "f"]]


def test_texts_are_read_together_as_each_alone(monkeypatch):
    """Few kernel calls for many texts, and for each sentence the best values of its words."""
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdx", k=draw.randint(1, 9))) + draw.choice(["", "", ".", "!", ",", "-"]) for _ in range(300)]
    words += ["a", "b.", "(c)", "--", "x,", "\u00e9", "Z"] * 20
    parts = ["".join(w + draw.choice([" ", " ", "\n", " \t"]) for w in draw.choices(words, k=draw.randint(1, 60))) for _ in range(40)]
    parts += [None, "", " \n ", "a", "a b\nc d", "a. b c", "x y z. alpha", "a -- b"]
    marks = [toxicity.units_of(w)[0] for w in ("abcd", "ccab", "xabc", "bca")]
    kernel, calls = toxicity.Kernel(marks), []
    want = []
    for text in parts:
        units = [[u for w in s for u in toxicity.units_of(w)] for s in toxicity.sentences_of(text) if s]
        want.append([kernel.values(s).max(0) if s else np.zeros(len(marks)) for s in units])
    values = toxicity.Kernel.values
    monkeypatch.setattr(toxicity.Kernel, "values", lambda self, units: calls.append(len(units)) or values(self, units))
    for size in (toxicity.GROUP_CHARS, 200):
        calls.clear()
        monkeypatch.setattr(toxicity, "GROUP_CHARS", size)
        got = list(toxicity.Reader(marks).read_all(parts))
        assert len(got) == len(want) and all(len(g) == len(w) and np.array_equal(g, np.array(w).reshape(g.shape)) for g, w in zip(got, want, strict=True))
        assert size == 200 or len(calls) <= 2


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(6)
    plain = ["".join(draw.choices("aeioulmnrst", k=draw.randint(2, 8))) for _ in range(400)]
    bad = ["blockhead", "numbskull", "dunderpate"]
    rows, labels = [], []
    for d in range(300):
        words = draw.choices(plain, k=draw.randint(8, 60))
        toxic = d % 5 == 1
        good = d % 3 != 0
        if toxic:
            for w in draw.sample(bad, 2) * 2:
                words.insert(draw.randrange(len(words)), w)
        if not good:
            words = [w + "%%" for w in words]
        rows.append((d, " ".join(words) + ".", "en", f"s{d % 3}", len(words)))
        labels.append((d, int(good), int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (None, "some words", "en", "s1", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, corpus):
    docs, labels = corpus
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [d for d, r in out.items() if r.held_out and d in truth]
    assert np.mean([out[d].predicted == truth[d] for d in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in out.values()) and out[900].predicted == out[901].predicted == 0


def test_toxicity_tolerates_inserted_characters(spark, corpus):
    model = toxicity.fit(toxicity.train_rows(*corpus))
    texts = [(1, "mona block.head lars numb-skull. dunder.pate"), (2, "mona lars rise"), (3, "mona b l o c k h e a d numb.skull.")]
    got = {r.doc_id: r.toxic_score for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert got[1] > 0.5 and got[3] > 0.5 and got[2] < 0.2
    assert toxicity.ToxicModel.from_json(model.to_json()) == model


def test_toxicity_without_labels(spark, documents, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(documents, none).collect()} == {0}
    assert toxicity.drop_toxic(documents, none).columns == documents.columns
    assert toxicity.toxicity(empty, none).collect() == []


def test_quality_on_held_out_rows(spark, corpus):
    docs, labels = corpus
    out = {r.doc_id: r for r in cotraining.quality(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d, r in out.items() if r.held_out and d in truth]
    assert len(out) == docs.count()
    assert np.mean([out[d].kept == bool(truth[d]) for d in held]) >= 0.95


def test_quality_without_labels(spark, documents, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = cotraining.quality(documents, none).collect()
    assert len(out) == documents.count() and all(r.score is None for r in out)
    assert cotraining.quality(empty, none).collect() == []
