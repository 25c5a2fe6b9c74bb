import random
import re
from itertools import permutations

import duckdb
import numpy as np

from harbinger.llm.filter_audit import COUNTS, audit, audit_sql, positional_popcount

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string"


def fails(docs):
    for doc_id, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        copy = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs)
        yield doc_id, lang or "", {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": copy,
        }


def brute(docs, labels):
    rows, out, totals = list(fails(docs)), {}, {}
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, t in labels if t == 1 and d is not None}
    for part in {p for _, p, _ in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[1] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[2][f]]
                past = [r for r in rows if r[1] == part and r not in left]
                left = [r for r in left if not r[2][f]]
                only = [r for r in rows if r[1] == part and [k for k in "ABCDE" if r[2][k]] == [f]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(r[2][f] for r in past), len(only),
                    sum(r[0] in good for r in gone), sum(r[0] in bad for r in gone),
                ]
                totals[part, f] = totals.get((part, f), 0) + len(gone)
    return {k: v + [totals[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def sample(seed):
    draw = random.Random(seed)
    texts = []
    for _ in range(25):
        vocab = [f"w{k}" for k in range(draw.choice([20, 500]))] + ["Name", "UPPER", "é"] + draw.choice([[], ["a|b", "$"]])
        words = draw.choices(vocab, k=draw.choice([0, 3, 199, 200, 260]))
        texts.append("".join(w + draw.choice([" ", "\n", "\x0b\t"]) for w in words))
    docs = [(i, draw.choice(texts), draw.choice(["en", "de", "", None])) for i in range(60)]
    docs += [(60, None, "en"), (61, "", "en"), (3, docs[3][1], "en"), docs[4], (None, docs[5][1], "en"), (None, None, None)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 40)] + [(None, 1, 1)]
    return docs, labels


def test_equals_walking_every_order(spark):
    for seed in range(2):
        docs, labels = sample(seed)
        frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in audit(frame, marks).collect()}
        assert got == brute([tuple(d) for d in docs], labels)


def test_equals_sql(spark):
    docs, labels = sample(9)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    expected = con.execute(audit_sql())
    names = [d[0] for d in expected.description]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit(spark.createDataFrame(docs, SCHEMA), marks).select(*names)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected.fetchall())


def test_positional_popcount():
    draw = np.random.default_rng(3)
    for n in [0, 1, 2, 3, 4, 5, 17, 1000, 4099]:
        words = draw.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)
        assert positional_popcount(words).tolist() == [int((words >> np.uint32(b) & 1).sum()) for b in range(32)]


def test_odd_rows(spark, documents, empty):
    marks = spark.createDataFrame([(1, 1, 0), (1, None, 1)], "doc_id long, quality int, toxic int")
    out = audit(documents, marks).collect()
    assert len(out) == 4 * 600  # en, de, fr and no lang
    rows = documents.count()
    assert sum(r.kept + r.removed for r in out if r.step == 1 and r.filter_order == "ABCDE") == rows
    assert audit(empty, marks).collect() == []
    assert len(audit(documents.drop("lang"), marks.limit(0)).collect()) == 600
