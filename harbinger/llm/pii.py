"""Personal data replaced by surrogates.

Entities (e-mail addresses, phone, card and account numbers, network addresses, titled
names) are detected in whole texts. Each distinct entity gets one surrogate, drawn by a
keyed hash: letters become letters of the same case and script, digits digits, marks
stay; names come from lists by gender and script and keep their case. Card numbers keep
a valid check digit and address bytes stay below 256. The same entity has the same
surrogate in every document. A name that has a title in a text is also replaced where the
text repeats the whole name without one.

Surrogates are then checked over the whole corpus: those that two entities of a kind
share, and those that are some entity of the corpus, are drawn again for all but the
first entity, until none is left; from WIDEN draws on the form gets one character more,
so a full form cannot stop it. Only entities, never texts, meet in these checks.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import bound_batches, settle
from harbinger.llm.rewrite import KEY, apply_cuts, text_key

WIDEN = 6

# fixed values: patterns by kind, in the order in which overlaps are settled
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}\b",
    "card": r"(?<![0-9.])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "name": r"\b(?i:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame|Г-н|Г-жа)\.? "
    r"([^\W\d_a-zа-я]\w+(?:[ -][^\W\d_a-zа-я]\w+){0,2})",
}

# fixed values: titles that tell a gender, and given and family names by script
FEMALE = {"mrs", "ms", "miss", "frau", "señora", "madame", "г-жа"}
MALE = {"mr", "herr", "señor", "monsieur", "г-н"}
GIVEN = {
    ("latin", "f"): ["Anna", "Clara", "Elena", "Ida", "Julia", "Laura", "Maria", "Nora", "Rosa", "Vera"],
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Leo", "Oscar", "Paul"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Денис", "Игорь", "Максим", "Олег", "Павел"],
}
SYLLABLES = {
    "latin": ["bar", "cor", "den", "fal", "gor", "hal", "lin", "mar", "nor", "pel", "ros", "sol", "tor", "ven", "wes", "zan"],
    "cyrillic": ["бар", "вол", "гор", "дан", "кор", "лом", "мар", "нов", "пет", "рос", "сом", "тим", "фед", "шар"],
}
FOUND = "array<struct<start:int,stop:int,kind:string,value:string>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str | None) -> list[dict]:
    """Entities in order of place; where two overlap the earlier, then the earlier kind, stays."""
    text, found = text or "", []
    digits = DIGIT.search(text) is not None
    for rank, (kind, pattern) in enumerate(_COMPILED.items()):
        # no match is possible without the character that the pattern must hold
        if not ("@" in text if kind == "email" else digits or kind == "name"):
            continue
        for m in pattern.finditer(text):
            group = 1 if kind == "name" else 0
            title = m.group(0)[: m.start(1) - m.start()].strip(" .").lower() + ":" if group else ""
            found.append((m.start(group), rank, m.end(group), kind, title + m.group(group)))
    found += _bare(text, sorted(x for x in found if x[3] == "name"))
    found.sort()
    out, end = [], 0
    for start, _, stop, kind, value in found:
        if start >= end:
            out.append({"start": start, "stop": stop, "kind": kind, "value": value})
            end = stop
    return out


def _bare(text: str, titled: list[tuple]) -> list[tuple]:
    """Mentions without a title of the names that have one in the text.

    A mention is the whole name as written, in upper case or capitalised; it is the person
    of the last mention with a title before it, or else of the first.
    """
    owners: dict[str, list[tuple[int, str]]] = {}
    forms = set()
    for start, _, _, _, value in titled:
        title, _, name = value.partition(":")
        owners.setdefault(name.casefold(), []).append((start, title))
        forms |= {name, name.upper(), name.title()}
    if not forms:
        return []
    either = "|".join(map(re.escape, sorted(forms, key=lambda x: (-len(x), x))))
    out = []
    for m in re.finditer(rf"(?<!\w)(?:{either})(?!\w)", text):
        known = owners[m.group().casefold()]
        title = known[max(0, bisect_right(known, m.start(), key=lambda x: x[0]) - 1)][1]
        out.append((m.start(), len(PATTERNS), m.end(), "name", f"{title}:{m.group()}"))
    return out


DIGIT = re.compile("[0-9]")
_COMPILED = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}


def normal(kind: str, value: str) -> str:
    """What makes two mentions one entity: case of addresses, spacing of numbers, titles of names."""
    if kind == "email":
        return value.lower()
    if kind == "name":
        title, _, name = value.partition(":")
        gender = "f" if title in FEMALE else "m" if title in MALE else "x"
        return f"{gender}:{name.casefold()}"
    if kind in ("card", "phone", "iban", "ssn"):
        return re.sub(r"[^0-9A-Za-z+]", "", value)
    return value


class _Draws:
    """A keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.key, self.seed, self.n = key, f"{kind}\x00{value}\x00{attempt}".encode(), 0

    def below(self, most: int) -> int:
        self.n += 1
        digest = hmac.new(self.key, self.seed + b"\x00%d" % self.n, hashlib.sha256).digest()
        return int.from_bytes(digest[:8], "big") % most


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """A replacement for a normalised entity, in normalised form."""
    draw = _Draws(key, kind, value, attempt)
    more = max(0, attempt - WIDEN + 1)
    if kind == "name":
        gender, _, name = value.partition(":")
        script = "cyrillic" if re.search("[Ѐ-ӿ]", name) else "latin"
        sex = gender if gender in "fm" else "fm"[draw.below(2)]
        given = GIVEN[script, sex]
        parts = len(re.split("[ -]", name))
        family = lambda: "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(3 + more))
        words = [given[draw.below(len(given))] for _ in range(parts - 1)] + [family().capitalize()]
        return f"{gender}:{' '.join(words)}"
    if kind == "ip":
        return ".".join(str(draw.below(256)) for _ in range(4))
    head, tail = (value.rsplit("@", 1)[0], "@" + value.rsplit("@", 1)[1]) if kind == "email" else (value, "")
    change = lambda c: _like(c, draw)
    domain = tail
    if tail:
        first, _, rest = tail.partition(".")
        domain = "".join(map(change, first)) + "." + rest
    keep = 2 if kind == "iban" else 0
    out = head[:keep] + "".join(map(change, head[keep:]))
    out += "".join(change("0" if kind != "email" else "a") for _ in range(more))
    if kind == "card" and luhn(head) and not more:
        out = next(out[:-1] + d for d in "0123456789" if luhn(out[:-1] + d))
    return out + domain


def _like(c: str, draw: _Draws) -> str:
    if c.isdigit() and c.isascii():
        return "0123456789"[draw.below(10)]
    if c.isascii() and c.isalpha():
        low = "abcdefghijklmnopqrstuvwxyz"[draw.below(26)]
        return low.upper() if c.isupper() else low
    return c


def dress(kind: str, mention: str, made: str) -> str:
    """A surrogate in the form of the mention: its case, and its marks between digits."""
    if kind == "email":
        return made.upper() if mention.isupper() else made
    if kind == "name":
        words = made.partition(":")[2]
        return words.upper() if mention.isupper() else words
    if kind in ("card", "phone", "iban", "ssn"):
        rest = iter(made)
        out = "".join(next(rest, "") if re.match(r"[0-9A-Za-z+]", c) else c for c in mention)
        return out + "".join(rest)
    return made


def entities(docs: DataFrame) -> DataFrame:
    """(text key, start, stop, kind, mention, value) of every entity of every distinct text."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf(FOUND)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([detect(t) for t in part], dtype=object)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*text_key(text), found.asNondeterministic()(text).alias("e")).where(F.size("e") > 0)
    return rows.select(*KEY, F.explode("e").alias("e")).select(*KEY, "e.*").dropDuplicates([*KEY, "start"])


def _written(value: str) -> Column:
    """What is compared: a name without its gender, in lower case and without hyphens."""
    name = F.translate(F.lower(F.expr(f"substring({value}, instr({value}, ':') + 1)")), "-", " ")
    return F.when(F.col("kind") == "name", name).otherwise(F.col(value))


def surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate): distinct for distinct entities, and no entity of the corpus.

    Names are compared as they are written, whatever the gender.
    """

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, *x) for x in zip(kind, value, attempt, strict=True)], dtype=object)

    real = settle(found.select("kind", "entity").distinct())
    now = real.withColumn("attempt", F.lit(0))
    while True:
        now = now.withColumn("surrogate", drawn("kind", "entity", "attempt")).withColumn("written", _written("surrogate"))
        now = settle(now)
        first = now.groupBy("kind", "written").agg(F.min(F.struct("attempt", "entity")).alias("first"))
        taken = real.select("kind", _written("entity").alias("written"), F.lit(True).alias("taken")).distinct()
        marked = now.join(first, ["kind", "written"]).join(taken, ["kind", "written"], "left")
        again = F.coalesce("taken", F.lit(False)) | (F.col("first.entity") != F.col("entity"))
        marked = marked.select("kind", "entity", "surrogate", "attempt", again.alias("again"))
        if marked.where("again").isEmpty():
            return now.select("kind", "entity", "surrogate")
        now = marked.select("kind", "entity", F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))


def replacements(docs: DataFrame, key: bytes) -> DataFrame:
    """(text key, start, stop, kind, mark) of every mention, ``mark`` being what replaces it."""

    @F.pandas_udf("string")
    def normalised(kind: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([normal(k, v) for k, v in zip(kind, value, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def dressed(kind: pd.Series, value: pd.Series, made: pd.Series) -> pd.Series:
        rows = zip(kind, value, made, strict=True)
        return pd.Series([dress(k, v.partition(":")[2] if k == "name" else v, m) for k, v, m in rows], dtype=object)

    found = settle(entities(docs).withColumn("entity", normalised("kind", "value")))
    made = found.join(surrogates(found, key), ["kind", "entity"])
    return made.select(*KEY, "start", "stop", "kind", dressed("kind", "value", "surrogate").alias("mark"))


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with every entity replaced by its surrogate, and ``entities`` added.

    ``entities`` lists kind:start:end of what was replaced (code points of the old text,
    in order, comma-joined; empty where there was none). Null texts stay null; repeated
    rows are changed alike. A column named ``entities`` is replaced.
    """
    marks = settle(replacements(docs, key))
    cut = F.struct("start", "stop", "mark", "kind")
    cuts = settle(marks.groupBy(*KEY).agg(F.sort_array(F.collect_list(cut)).alias("_cuts")))
    listed = F.array_join(F.transform("_cuts", lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["stop"].cast("string"))), ",")
    names = [c for c in docs.columns if c != "entities"]
    named = docs.select(*[f"`{c}`" for c in names], F.lit("").alias("entities"))
    return apply_cuts(named, cuts, {"entities": listed})
