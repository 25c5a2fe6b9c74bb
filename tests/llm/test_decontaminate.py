import random

import numpy as np

from harbinger.llm.common import WordHashes, byte_words
from harbinger.llm.decontaminate import (
    EDGES,
    SHARE,
    TermIds,
    block_max_wand,
    build_index,
    contaminated,
    drop_contaminated,
    promising,
)


def make(spark, seed=3):
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 30
    sentence = lambda n: " ".join(draw.choices(vocab, k=n)) + "."
    items = [(i, f"{sentence(draw.randint(8, 20))} {sentence(draw.randint(4, 9))}") for i in range(37)]
    docs = []
    for d in range(60):
        text = " ".join(sentence(12) for _ in range(draw.randint(1, 30)))
        if d % 4 == 0:
            text += " " + items[d % 37][1] + " " + sentence(40)
        docs.append((d, text))
    return items, docs, spark.createDataFrame(items, "item_id long, text string")


def test_search_equals_exhaustive_scores(spark):
    items, docs, table = make(spark)
    (index,) = build_index(table)
    numbers = TermIds(index.terms)
    for _, text in docs:
        ids = numbers.of(byte_words(text, lower=True))
        ids = ids[ids > -2]
        hot = promising(ids, index, SHARE)
        for window in range(max(1, (len(ids) - 1) // index.span)):
            part = ids[window * index.span : (window + 2) * index.span]
            query = np.unique(part[part >= 0])
            score = np.zeros(len(index.ids))
            for t in query:
                score[index.item[index.at[t] : index.at[t + 1]]] += index.part[index.at[t] : index.at[t + 1]]
            want = [n for n in range(len(score)) if score[n] >= SHARE - 1e-9]
            got = block_max_wand(query, index, SHARE)
            assert [n for n, _ in got] == want
            assert np.allclose([s for _, s in got], score[want])
            assert window in hot or not want
            if window in hot:
                assert block_max_wand(query, index, SHARE, hot[window]) == got


def test_finds_planted_items_only(spark):
    items, docs, table = make(spark)
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), table)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found == {(d, d % 37) for d, _ in docs if d % 4 == 0}


def test_new_words_of_a_text_are_looked_up_at_once(spark, monkeypatch):
    items, docs, table = make(spark)
    (index,) = build_index(table)
    raw = [b"w1", b"(w2)", b"--", b"", b"w1", b"no-such-word", b"the.", *byte_words(docs[0][1], lower=True)]
    calls, search, hashes = [], np.searchsorted, WordHashes()
    terms = [int(t) for t in index.terms]
    want = [terms.index(hashes[b]) if hashes[b] in terms else -1 if b else -2 for b in (w.strip(EDGES) for w in raw)]
    monkeypatch.setattr(np, "searchsorted", lambda *a: calls.append(1) or search(*a))
    numbers = TermIds(index.terms)
    assert numbers.of(raw).tolist() == want and numbers.of(raw).tolist() == want and numbers.of([]).tolist() == []
    assert len(calls) == 1


def searched(spark, items, docs, theta):
    """(found by way of promising windows, found by scoring every window against every item)."""
    (index,) = build_index(spark.createDataFrame(items, "item_id long, text string"))
    numbers = TermIds(index.terms)
    got, want = set(), set()
    for d, text in enumerate(docs):
        ids = numbers.of(byte_words(text, lower=True))
        ids = ids[ids > -2]
        hot = promising(ids, index, theta)
        for window in range(max(1, (len(ids) - 1) // index.span)):
            part = ids[window * index.span : (window + 2) * index.span]
            query = np.unique(part[part >= 0])
            score = np.zeros(len(index.ids))
            for t in query:
                score[index.item[index.at[t] : index.at[t + 1]]] += index.part[index.at[t] : index.at[t + 1]]
            want |= {(d, window, n) for n in range(len(score)) if score[n] >= theta - 1e-9}
            if window in hot:
                got |= {(d, window, n) for n, _ in block_max_wand(query, index, theta, hot[window])}
    return got, want


def test_items_of_common_words_only(spark):
    draw = random.Random(8)
    words = [f"v{i}" for i in range(9)]
    fill = lambda n: " ".join(f"z{draw.randrange(10**6)}" for _ in range(n))
    twins = [(i, f"alpha beta gamma delta epsilon {i // 2}x. answer {i // 2}y here.") for i in range(8)]
    templated = [(i, f"what is {' plus '.join(draw.choices(words, k=4))}. {draw.choice(words)}.") for i in range(150)]
    for items in (twins, templated):
        docs = [f"{fill(draw.randint(0, 90))} {items[draw.randrange(len(items))][1]} {fill(draw.randint(0, 90))}" for _ in range(25)]
        for theta in (SHARE, 0.3):
            got, want = searched(spark, items, docs, theta)
            assert want and got == want
    docs = spark.createDataFrame([(1, "so " + twins[4][1]), (2, "nothing of it")], "doc_id long, text string")
    table = spark.createDataFrame(twins, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, table).collect()} == {(1, 4), (1, 5)}


def test_items_that_share_an_id_or_have_none(spark):
    one, two, three = (f"{' '.join(f'{c}{i}' for i in range(12))}. {' '.join(f'{c}{i}' for i in range(20, 25))}." for c in "pqr")
    items = spark.createDataFrame([(0, one), (0, "longer " + two), (0, one), (None, three)], "item_id long, text string")
    docs = spark.createDataFrame([(1, one), (2, two), (3, three), (4, "clean words")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, items).collect()) == [(1, 0), (2, 0), (3, None)]
    assert [r.doc_id for r in drop_contaminated(docs, items).collect()] == [4]


def test_odd_rows(spark, documents, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one"), (None, "x y")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(documents, items).collect()}
    assert got == {(7, 3), (8, 3)}
    left = drop_contaminated(documents, items)
    assert left.columns == documents.columns and left.count() == documents.count() - 2
    none = items.where("item_id > 9")
    assert contaminated(documents, none).count() == 0 and drop_contaminated(documents, none).count() == documents.count()
    assert contaminated(empty, items).count() == 0
