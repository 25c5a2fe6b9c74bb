import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with every odd case: null, empty, long, repeated, tied, clashing column names."""
    long_text = " ".join(f"word{i % 977} plain{i % 13}" for i in range(30_000))
    base = " ".join(f"alpha{i}" for i in range(60))
    near = base.replace("alpha30 ", "changed ")
    rows = [
        (1, base, "en", "s1", 5, "x"),
        (2, near, "en", "s1", 5, "x"),
        (3, base, "en", "s1", 5, "x"),
        (3, base, "en", "s1", 5, "x"),
        (4, None, None, None, None, None),
        (5, "", "en", "s2", 0, ""),
        (6, "  \n\t ", "en", "s2", 5, ""),
        (7, "one two", "de", "s2", 7, ""),
        (8, "One  two", "de", "s2", 8, ""),
        (9, long_text, "en", "s3", len(long_text), "y"),
        (None, base, "en", "s3", 5, "y"),
        (10, "12345 +++ 678", "fr", "s3", 13, "y"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _hit string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
