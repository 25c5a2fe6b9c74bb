"""License scans by sentence rules, in DataFrame operations only.

Texts are cut into sentences twice: once with lines joined (license texts are wrapped,
often inside comments, under a title and a copyright line), once line by line. A sentence is normalised to lower-case words, a notice ("licensed
under the ...") to one form, and looked up among known sentences; unknown sentences
drop out. The identifiers that remain, in order, are matched against rules, each an
ordered run of sentence identifiers. Nothing is shuffled; texts are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public license texts and notices, by identifier.
SENTENCES = {
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions:""",
    "mit-notice": """The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "mit-warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "mit-liability": """IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies.""",
    "isc-warranty": """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "bsd-grant": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met:""",
    "bsd-source": """Redistributions of source code must retain the above copyright notice, this list of conditions and
        the following disclaimer.""",
    "bsd-binary": """Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "bsd-endorse": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission.""",
    "bsd-warranty": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "apache-header": """Licensed under the Apache License, Version 2.0 (the "License");""",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "gpl-2": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
        your option) any later version.""",
    "gpl-3-free": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version.""",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "notice-mit": "under the MIT License.",
    "notice-apache": "under the Apache License, Version 2.0.",
    "notice-apache-short": "under the Apache License 2.0.",
    "notice-gpl-2": "under the GNU General Public License, version 2.",
    "notice-gpl-3": "under the GNU General Public License, version 3.",
    "notice-lgpl-21": "under the GNU Lesser General Public License, version 2.1.",
    "notice-lgpl-3": "under the GNU Lesser General Public License, version 3.",
    "notice-agpl-3": "under the GNU Affero General Public License, version 3.",
    "notice-mpl-2": "under the Mozilla Public License, version 2.0.",
    "notice-bsd-2": "under the BSD 2-Clause License.",
    "notice-bsd-3": "under the BSD 3-Clause License.",
    "notice-isc": "under the ISC License.",
    "notice-cc0": "under CC0 1.0.",
    "notice-cc-by": "under CC BY 4.0.",
    "notice-cc-by-sa": "under CC BY-SA 4.0.",
    "notice-cc-by-nc": "under CC BY-NC 4.0.",
    "notice-cc-by-nd": "under CC BY-ND 4.0.",
    "notice-cc-by-nc-sa": "under CC BY-NC-SA 4.0.",
    "notice-cc-by-nc-nd": "under CC BY-NC-ND 4.0.",
}

# Rule, license, ordered sentence identifiers.
RULES = [
    ("mit-text", "MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("isc-text", "ISC", ["isc-grant", "isc-warranty"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]),
    ("apache-text", "Apache-2.0", ["apache-header", "apache-comply"]),
    ("gpl-2-text", "GPL-2.0", ["gpl-2"]),
    ("gpl-3-text", "GPL-3.0", ["gpl-3-free"]),
    ("mpl-2-text", "MPL-2.0", ["mpl-2"]),
    ("unlicense-text", "Unlicense", ["unlicense"]),
    ("mit-notice-line", "MIT", ["notice-mit"]),
    ("apache-notice-line", "Apache-2.0", ["notice-apache"]),
    ("apache-notice-short", "Apache-2.0", ["notice-apache-short"]),
    ("gpl-2-notice-line", "GPL-2.0", ["notice-gpl-2"]),
    ("gpl-3-notice-line", "GPL-3.0", ["notice-gpl-3"]),
    ("lgpl-21-notice-line", "LGPL-2.1", ["notice-lgpl-21"]),
    ("lgpl-3-notice-line", "LGPL-3.0", ["notice-lgpl-3"]),
    ("agpl-3-notice-line", "AGPL-3.0", ["notice-agpl-3"]),
    ("mpl-2-notice-line", "MPL-2.0", ["notice-mpl-2"]),
    ("bsd-2-notice-line", "BSD-2-Clause", ["notice-bsd-2"]),
    ("bsd-3-notice-line", "BSD-3-Clause", ["notice-bsd-3"]),
    ("isc-notice-line", "ISC", ["notice-isc"]),
    ("cc0-notice-line", "CC0-1.0", ["notice-cc0"]),
    ("cc-by-notice-line", "CC-BY-4.0", ["notice-cc-by"]),
    ("cc-by-sa-notice-line", "CC-BY-SA-4.0", ["notice-cc-by-sa"]),
    ("cc-by-nc-notice-line", "CC-BY-NC-4.0", ["notice-cc-by-nc"]),
    ("cc-by-nd-notice-line", "CC-BY-ND-4.0", ["notice-cc-by-nd"]),
    ("cc-by-nc-sa-notice-line", "CC-BY-NC-SA-4.0", ["notice-cc-by-nc-sa"]),
    ("cc-by-nc-nd-notice-line", "CC-BY-NC-ND-4.0", ["notice-cc-by-nc-nd"]),
]

GAP = r"[ \t\r\n\f]"
NOTICE = (
    r"^(this |the )?(work |program |software |project |file |code |document |library )?(is )?"
    r"(licensed|released|distributed|available|published) under (the )?"
)
# kept as it is by the notice rule: its header goes on with "the License"
HEADER = "licensed under the apache license version 2 0 the license"


# before lines are joined: comment marks go, so that a bare mark is an empty line, and an
# empty line follows a title (a short first line of a paragraph that ends in "License")
# and a copyright line; no known sentence is wrapped so that a line of it is one of these
LINES = [
    (r"(^|\n)[ \t#*/;%!-]+", "$1"),
    (
        r"(?i)(^|\n[ \t\r\f]*\n)([^\n.:;!?]{0,60}\blicen[sc]e(?:[ \t]*\([^()\n]*\))?[ \t\r\f]*)(?=\n)",
        "$1$2\n",
    ),
    (r"(?i)(^|\n)((?:copyright[ \t]+(?!notice|holder)|\(c\)|\u00a9)[^\n]*|all rights reserved[ \t\r\f]*)(?=\n)", "$1$2\n"),
]


def normal(sentence: str) -> str:
    """The form under which a known sentence is looked up."""
    words = re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()
    return words if words == HEADER else re.sub(NOTICE, "under ", re.sub("^under (the )?", "under ", words))


def _known() -> tuple[dict[str, str], list[tuple[str, str, list[str]]]]:
    """(identifier by normalised sentence, rules over those identifiers).

    A listed sentence that is cut in its middle becomes parts; a part that several
    sentences share has one identifier.
    """
    known: dict[str, str] = {}
    parts: dict[str, list[str]] = {}
    for name, text in SENTENCES.items():
        cut = re.split(r"(?<=[.;:!?])\s+", " ".join(text.split()))
        parts[name] = [known.setdefault(normal(p), name if len(cut) == 1 else f"{name}/{i}") for i, p in enumerate(cut, 1)]
    return known, [(rule, license, [p for x in ids for p in parts[x]]) for rule, license, ids in RULES]


KNOWN, SEQUENCES = _known()


def _normal(sentence: Column) -> Column:
    words = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    return F.when(words == HEADER, words).otherwise(F.regexp_replace(words, NOTICE, "under "))


def _identifiers(text: Column, joined: bool) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    if joined:
        for pattern, put in LINES:
            text = F.regexp_replace(text, pattern, put)
        cut = F.regexp_replace(text, rf"([.;:!?]){GAP}+|\n{GAP}*\n", "$1\u0001")
        cut = F.split(F.translate(cut, "\n", " "), "\u0001", -1)
    else:
        cut = F.split(F.regexp_replace(text, rf"([.;:!?]){GAP}+", "$1\n"), "\n", -1)
    return F.array_compact(F.transform(cut, lambda s: known[_normal(s)]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, ``sentences`` (identifiers known, in order), ``rules`` and ``licenses``, as comma-joined text.

    A rule holds if its identifiers follow each other in either reading; rules stand in
    the order of RULES, licenses in alphabetical order. Null and empty texts have none.
    Repeated rows give repeated rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", _identifiers(text, True).alias("a"), _identifiers(text, False).alias("b"))
    line = lambda c: F.concat(F.lit(","), F.array_join(c, ","), F.lit(","))
    rows = rows.withColumn("_a", line("a")).withColumn("_b", line("b"))
    held = [
        F.when(F.col("_a").contains(p) | F.col("_b").contains(p), F.struct(F.lit(r).alias("rule"), F.lit(x).alias("license")))
        for r, x, p in ((r, x, f",{','.join(ids)},") for r, x, ids in SEQUENCES)
    ]
    rows = rows.withColumn("m", F.array_compact(F.array(*held)))
    both = F.when(F.size("a") >= F.size("b"), F.col("a")).otherwise(F.col("b"))
    return rows.select(
        "doc_id",
        F.array_join(both, ",").alias("sentences"),
        F.array_join("m.rule", ",").alias("rules"),
        F.array_join(F.array_sort(F.array_distinct("m.license")), ",").alias("licenses"),
    )


def _lines_sql(text: str) -> str:
    """LINES for an engine without look-around.

    A pattern takes the line end along and puts it back doubled. It may thereby miss the
    next line, which a second turn finds; more empty lines than one change nothing. The
    words that may not follow "copyright" are marked beforehand.
    """
    def turn(value: str, pattern: str) -> str:
        return f"regexp_replace({value}, '{pattern.replace('(?=' + chr(92) + 'n)', chr(92) + 'n')}', '\\1\\2' || chr(10) || chr(10), 'g')"

    (marks, _), (title, _), (rights, _) = LINES
    bare = f"regexp_replace({text}, '{marks}', '\\1', 'g')"
    titled = turn(turn(bare, title), title)
    spared = f"regexp_replace({titled}, '(?i)(^|\\n)(copyright[ \\t](?:notice|holder))', '\\1' || chr(2) || '\\2', 'g')"
    plain = rights.replace("(?!notice|holder)", "").replace(chr(92) + "u00a9", "\u00a9")
    return f"replace({turn(turn(spared, plain), plain)}, chr(2), '')"


def scan_sql() -> str:
    """The same scan as SQL over the table ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(words)}, {quote(name)})" for words, name in KNOWN.items())
    rules = ", ".join(f"({i}, {quote(r)}, {quote(x)}, ',{','.join(ids)},')" for i, (r, x, ids) in enumerate(SEQUENCES))
    return f"""
WITH known(words, name) AS (VALUES {known}),
rules(place, rule, license, ids) AS (VALUES {rules}),
cut AS (
    SELECT doc_id, row_number() OVER () AS r,
        string_split(replace(regexp_replace({_lines_sql("coalesce(text, '')")},
            '([.;:!?]){GAP}+|\\n{GAP}*\\n', '\\1' || chr(1), 'g'), chr(10), ' '), chr(1)) AS a,
        string_split(regexp_replace(coalesce(text, ''), '([.;:!?]){GAP}+', '\\1' || chr(10), 'g'), chr(10)) AS b
    FROM documents),
each AS (
    SELECT r, 'a' AS way, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM cut
    UNION ALL SELECT r, 'b', unnest(b), generate_subscripts(b, 1) FROM cut),
words AS (SELECT r, way, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS w FROM each),
named AS (
    SELECT r, way, i, name FROM words JOIN known
    ON known.words = CASE WHEN w = '{HEADER}' THEN w ELSE regexp_replace(w, '{NOTICE}', 'under ') END),
seq AS (
    SELECT r, coalesce(string_agg(name, ',' ORDER BY i) FILTER (way = 'a'), '') AS a,
        coalesce(string_agg(name, ',' ORDER BY i) FILTER (way = 'b'), '') AS b,
        count(*) FILTER (way = 'a') AS na, count(*) FILTER (way = 'b') AS nb
    FROM named GROUP BY r),
held AS (
    SELECT r, string_agg(rule, ',' ORDER BY place) AS rules,
        array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses
    FROM seq JOIN rules ON contains(',' || a || ',', ids) OR contains(',' || b || ',', ids) GROUP BY r)
SELECT doc_id, coalesce(CASE WHEN na >= nb THEN seq.a ELSE seq.b END, '') AS sentences,
    coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
FROM cut LEFT JOIN seq USING (r) LEFT JOIN held USING (r)
"""
