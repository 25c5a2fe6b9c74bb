import textwrap

import duckdb

from harbinger.llm.licenses import RULES, SENTENCES, scan, scan_sql


def found(spark, *texts):
    rows = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.licenses for r in sorted(rows, key=lambda r: r.doc_id)]


def wrapped(*names):
    return "\n\n".join(textwrap.fill(" ".join(SENTENCES[n].split()), 70) for n in names)


def test_texts_notices_and_order(spark):
    mit = wrapped("mit-grant", "mit-notice", "mit-warranty", "mit-liability")
    bsd = wrapped("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")
    bsd3 = wrapped("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")
    got = found(
        spark,
        f"MIT License\n\nCopyright 2020 Someone\n\n{mit}",
        wrapped("mit-notice", "mit-grant", "mit-warranty", "mit-liability"),
        bsd,
        bsd3,
        "prose.\nReleased under the MIT License.\nmore. This work is licensed under CC BY-NC 4.0.",
        "no stop here\nLicensed under the Apache License, Version 2.0.",
        "about the MIT License and others.",
        None,
        "",
    )
    assert got == ["MIT", "", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-NC-4.0,MIT", "Apache-2.0", "", "", ""]


def comment_cases():
    """(texts, the rule that each must reach): full texts under titles, copyright lines and comment marks."""
    full = [(rule, ids) for rule, _, ids in RULES if rule.endswith("-text")]
    texts, want = [], []
    for rule, ids in full:
        body = wrapped(*ids).split("\n")
        lines = ["The MIT License (MIT)", "", "Copyright (c) 2020 Foo", "", *body]
        close = ["MIT License", "Copyright 2019 Bar", "Copyright (c) 2020 Foo", *body]
        for form in (lines, close):
            for mark in ("# ", " * ", "// ", ""):
                inner = "\n".join((mark + x).rstrip(" ") for x in form)
                texts.append(f"/*\n{inner}\n */\nint x;" if mark == " * " else f"{inner}\n\ncode")
                texts.append(texts[-1].replace("\n", "\r\n"))
                want += [rule, rule]
    # a known sentence is found at any width, also where a line of it begins with Copyright
    for width in range(20, 90, 7):
        for rule, ids in full:
            texts.append("\n#\n".join(textwrap.fill(" ".join(SENTENCES[n].split()), width, initial_indent="# ", subsequent_indent="# ") for n in ids))
            want.append(rule)
    return texts, want


def test_texts_in_comments_under_title_and_copyright(spark):
    texts, want = comment_cases()
    rows = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: r.rules.split(",") for r in rows}
    assert [(rule, texts[i]) for i, rule in enumerate(want) if rule not in got[i]] == []


def test_every_rule_is_reached(spark):
    texts = [("Licensed " if ids[0].startswith("notice") else "") + wrapped(*ids) for _, _, ids in RULES]
    rows = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by = {r.doc_id: r.rules.split(",") for r in rows}
    assert all(rule in by[i] for i, (rule, _, _) in enumerate(RULES))


def test_odd_rows(documents, empty):
    out = scan(documents).collect()
    assert len(out) == documents.count() and {r.licenses for r in out} == {""}
    assert scan(empty).collect() == []


def test_equals_sql(spark):
    """Query and SQL side by side, over comments, titles, copyright lines in a row, and odd texts."""
    texts, _ = comment_cases()
    mit = wrapped("mit-grant", "mit-notice", "mit-warranty", "mit-liability")
    heads = ["MIT License\n\nMIT License\n\nBSD License", "Copyright 2020 A\nCopyright 2021 B\nCopyright 2022 C", "(c) X\nAll rights reserved"]
    heads += ["copyright notice\nCopyright holder", "copyright  notice", "\u00a9 Foo\r\nThe MIT License (MIT)\r"]
    texts += [f"{mark}{h}\n{mit}".replace("\n", f"\n{mark}") for h in heads for mark in ("", "# ", " * ", ";; ")]
    texts += [None, "", "\n\n\n", "# \n#\n", mit.replace("\n", "\r\n")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    expected = con.execute(scan_sql())
    names = [d[0] for d in expected.description]
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(*names)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected.fetchall())
