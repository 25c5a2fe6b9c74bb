import re

from pyspark.sql import functions as F

from harbinger.llm import pii
from harbinger.llm.common import settle


def test_forms_are_kept(spark):
    text = "Mrs. Anna Schmidt, Mr Bob Ross, MRS. ANNA SCHMIDT; 4111 1111 1111 1111 4111111111111111 é a9@b.com +1 (017) 555-7713 10.1.2.3"
    out = pii.pseudonymise(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), b"k")
    by = {r.doc_id: r for r in out.collect()}
    new = by[1].text
    names = re.match(r"Mrs\. ([A-Z]\w+) ([A-Z]\w+), Mr ([A-Z]\w+) ([A-Z]\w+), MRS\. ([A-Z]+) ([A-Z]+);", new)
    assert names and names[5] == names[1].upper() and names[6] == names[2].upper()
    assert names[1] in pii.GIVEN["latin", "f"] and names[3] in pii.GIVEN["latin", "m"]
    cards = re.search(r"(\d{4} \d{4} \d{4} \d{4}) (\d{16}) é", new)
    assert cards[1].replace(" ", "") == cards[2] != "4111111111111111" and pii.luhn(cards[2])
    assert re.search(r"[a-z]\d@[a-z]\.com \+\d \(\d{3}\) \d{3}-\d{4} ", new)
    assert (by[2].text, by[2].entities, by[3].text) == (None, "", "")


def test_distinct_and_never_an_entity_of_the_corpus(spark):
    # a form of one hundred values that is nearly full
    text = " ".join(f"{i:02d}@x.com" for i in range(90))
    found = settle(pii.entities(spark.createDataFrame([(1, text)], "doc_id long, text string")).withColumn("entity", F.col("value")))
    rows = pii.surrogates(found, b"k").collect()
    made = {r.surrogate for r in rows}
    assert len(rows) == len(made) == 90
    assert not made & {r.entity for r in rows}


def test_written_names_are_distinct_and_nobody_of_the_corpus(spark):
    # single names of three genders, one of every given list of endings in use as a real name
    syllables = pii.SYLLABLES["latin"]
    real = [f"{a}{b}{c}".capitalize() for a in syllables[:8] for b in syllables for c in syllables[:8]]
    rows = [(i, f"{title} {name} spoke") for i, name in enumerate(real) for title in ("Mrs", "Mr", "Dr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.pseudonymise(docs, b"k").collect()
    made = [r.text.split()[1].casefold() for r in out]
    assert len(made) == len(set(made)) == 3 * len(real)
    assert not set(made) & {x.casefold() for x in real}


def test_bare_mentions_follow_the_titled_one(spark):
    text = "Mrs Anna Schmidt came. Anna Schmidt left; ANNA SCHMIDT, Anna Schmidtz and anna schmidt. Dr Anna Schmidt: Anna Schmidt. Bob Ross"
    (row,) = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), b"k").collect()
    two = r"([A-Z][a-z]+ [A-Z][a-z]+)"
    got = re.fullmatch(rf"Mrs {two} came\. {two} left; ([A-Z ]+), Anna Schmidtz and anna schmidt\. Dr {two}: {two}\. Bob Ross", row.text)
    assert got and got[1] == got[2] == got[3].title() != "Anna Schmidt" and got[4] == got[5] != got[1]
    assert row.entities.count("name:") == 5


def test_same_entity_same_surrogate(spark):
    rows = [(i, f"mail me@here.org or {i}@there.org") for i in range(30)] + [(0, "mail me@here.org or 0@there.org")]
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()
    assert len(out) == 31 and len({re.search(r"mail (\S+)", r.text)[1] for r in out}) == 1
    assert len({re.search(r"or (\S+)", r.text)[1] for r in out}) == 30


def test_odd_rows(documents, empty):
    out = pii.pseudonymise(documents, b"k")
    assert out.columns == [*documents.columns, "entities"]
    plain = sorted(map(str, out.drop("entities").where("doc_id <> 10 or doc_id is null").collect()))
    assert plain == sorted(map(str, documents.where("doc_id <> 10 or doc_id is null").collect()))
    assert pii.pseudonymise(empty, b"k").collect() == []
