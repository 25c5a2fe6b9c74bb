"""Repetition rules: characters inside repeated word n-grams and lines, by rolling hashes.

For each n of NGRAMS the words inside windows that occur twice or more in the text are
marked, the first occurrence included, and their characters are summed: a character in
several repeated windows counts once. For each n of TOP_NGRAMS the characters under the
most covering repeated window are taken. Lines count as repeated when an equal line came
before. A text fails when a share of its word characters passes the limit of its rule.

Words are runs without a space or a control from 09 to 0D; lines end at a newline and
count if they hold a word. Null and wordless texts have zero everywhere and fail the
base rule on the number of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import WordHashes, bound_batches, byte_words, rolling

# limits in hundredths of the word characters
NGRAMS = {5: 15, 7: 13, 10: 10}
TOP_NGRAMS = {2: 20, 3: 18, 4: 16}
LINE_CHARS = 20
SYMBOLS = re.compile(r"[#*$%&|<>]")

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["dup_line_chars", *[f"dup_chars_{n}" for n in NGRAMS], *[f"top_chars_{n}" for n in TOP_NGRAMS]]


def repeated_windows(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window, whether its n-gram occurs twice or more)."""
    h = rolling(ids, n)
    if not len(h):
        return h, np.zeros(0, bool)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return h, twice


def covered(twice: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside any marked window."""
    step = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(text: str | None, words: WordHashes) -> list[int]:
    """The numbers of BASE and MORE for one text."""
    text = text or ""
    raw = byte_words(text)
    ids = words.of(raw)
    if text.isascii():
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    else:
        sizes = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in raw), np.int64, len(raw))
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        own = byte_words(line)
        if not own:
            continue
        if line in seen:
            dup_lines += 1
            dup_chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in own)
        seen.add(line)
    marks = {n: repeated_windows(ids, n) for n in {*NGRAMS, *TOP_NGRAMS}}
    dups = []
    for n in NGRAMS:
        inside = covered(marks[n][1], n, len(ids))
        dups.append(int(sizes[inside].sum()))
        if n == 5:
            repeat_words = int(inside.sum())
    tops = []
    total = np.concatenate([[0], np.cumsum(sizes)])
    for n in TOP_NGRAMS:
        h, twice = marks[n]
        if not twice.any():
            tops.append(0)
            continue
        at = np.flatnonzero(twice)
        value, back, count = np.unique(h[at], return_inverse=True, return_counts=True)
        length = np.zeros(len(value), np.int64)
        length[back] = total[at + n] - total[at]
        tops.append(int((length * count).max()))
    base = [len(raw), int(sizes.sum()), len(SYMBOLS.findall(text)), dup_lines, repeat_words]
    return [*base, dup_chars, *dups, *tops]


def repetition(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, ``base_failed`` and ``kept`` for every row; nothing is shuffled.

    ``top_chars_n`` is the length of the n-gram times its occurrences, overlaps
    included. Repeated rows give repeated rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    names = BASE + MORE

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def measured(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for part in parts:
            yield pd.DataFrame([measure(t, words) for t in part], columns=names)

    once = measured.asNondeterministic()
    rows = docs.select("doc_id", once(F.col("text").cast("string")).alias("m")).select("doc_id", "m.*")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    over = 100 * F.col("dup_line_chars") > LINE_CHARS * F.col("word_chars")
    for prefix, limits in (("dup_chars", NGRAMS), ("top_chars", TOP_NGRAMS)):
        for n, limit in limits.items():
            over = over | (100 * F.col(f"{prefix}_{n}") > limit * F.col("word_chars"))
    return rows.select("doc_id", *names, base_failed.alias("base_failed"), (~base_failed & ~over).alias("kept"))


def repetition_sql() -> str:
    """The same rules as SQL over the table ``documents``, with n-grams as word lists."""
    every = sorted({*NGRAMS, *TOP_NGRAMS})
    grams = " UNION ALL ".join(
        f"SELECT r, {n} AS n, i, list_aggregate(list_slice(w, i, i + {n - 1}), 'string_agg', ' ') AS g,"
        f" list_sum(list_transform(list_slice(w, i, i + {n - 1}), lambda x: length(x))) AS c"
        f" FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) AS i FROM t WHERE len(w) >= {n})"
        for n in every
    )
    dup = ", ".join(f"coalesce(sum(length(w[k])) FILTER (n = {n}), 0)::BIGINT AS dup_chars_{n}" for n in NGRAMS)
    top = ", ".join(f"coalesce(max(m) FILTER (n = {n}), 0)::BIGINT AS top_chars_{n}" for n in TOP_NGRAMS)
    over = " OR ".join(
        [f"100 * dup_line_chars > {LINE_CHARS} * word_chars"]
        + [f"100 * dup_chars_{n} > {v} * word_chars" for n, v in NGRAMS.items()]
        + [f"100 * top_chars_{n} > {v} * word_chars" for n, v in TOP_NGRAMS.items()]
    )
    more = [f"dup_chars_{n}" for n in NGRAMS] + [f"top_chars_{n}" for n in TOP_NGRAMS]
    filled = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ["n_repeat_words", "n_dup_lines", "dup_line_chars", *more])
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
own AS (SELECT r, line, i, list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: length(x))) AS c
    FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
copies AS (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM own),
repeats AS (SELECT r, count(*) AS n_dup_lines, sum(c) AS dup_line_chars FROM copies WHERE k > 1 GROUP BY r),
grams AS ({grams}),
counted AS (SELECT *, count(*) OVER (PARTITION BY r, n, g) AS m FROM grams),
twice AS (SELECT r, n, i, g, m * c AS m FROM counted WHERE m > 1),
inside AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS k FROM twice WHERE n IN ({", ".join(map(str, NGRAMS))})),
dups AS (SELECT r, count(*) FILTER (n = 5) AS n_repeat_words, {dup} FROM inside JOIN t USING (r) GROUP BY r),
tops AS (SELECT r, {top} FROM twice GROUP BY r),
base AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, {filled}
    FROM d JOIN t USING (r) LEFT JOIN repeats USING (r) LEFT JOIN dups USING (r) LEFT JOIN tops USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND NOT ({over}) AS kept FROM judged
"""
