"""Text clean-up and display formatting as native column expressions."""

from __future__ import annotations

import unicodedata
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


HANGUL, HANGUL_END = 0xAC00, 0xD7A4


def _plain(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


def _char_class(codes: list[int]) -> str:
    """A regular-expression class of code points, as ranges."""
    runs: list[list[int]] = []
    for code in codes:
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in runs) + "]"


def _accent_tables() -> tuple[str, str, dict[str, str], str, str]:
    """Compatibility-decomposition tables over every code point of the Unicode database.

    Characters whose decomposition (combining marks removed) is one character go
    into a ``translate`` pair, longer ones into a map; Korean syllables follow a rule.
    """
    source, target, expand, marks = [], [], {}, []
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(code)
            continue
        if HANGUL <= code < HANGUL_END:
            continue
        plain = _plain(char)
        if plain == char:
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            expand[char] = plain
    several = sorted([*map(ord, expand), *range(HANGUL, HANGUL_END)])
    return "".join(source), "".join(target), expand, _char_class(several), _char_class(marks)


_FROM, _TO, _SEVERAL, _SEVERAL_CLASS, _MARKS = _accent_tables()


def _expand(ch: Column) -> Column:
    """The characters that a character of several parts stands for, else itself."""
    lead, vowel, tail = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))
    at = F.ascii(ch) - HANGUL

    def part(letters: str, place: Column) -> Column:
        return F.substring(F.lit(letters), (place + 1).cast("int"), F.lit(1))

    syllable = F.concat(
        part(lead, F.floor(at / 588)),
        part(vowel, F.floor(at % 588 / 28)),
        F.when(at % 28 > 0, part(tail, at % 28 - 1)).otherwise(""),
    )
    table = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    return F.when((at >= 0) & (at < HANGUL_END - HANGUL), syllable).otherwise(F.coalesce(table[ch], ch))


def strip_accents(c: Column) -> Column:
    """Compatibility-fold every letter and drop combining marks."""
    out = F.translate(c, _FROM, _TO)
    wide = F.array_join(F.transform(F.split(out, ""), _expand), "")
    return F.regexp_replace(F.when(out.rlike(_SEVERAL_CLASS), wide).otherwise(out), _MARKS + "+", "")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_key(c: Column) -> Column:
    """Accent-free, lower-case, single-spaced form used as a match key."""
    return collapse_spaces(F.lower(strip_accents(c)))


def strip_punctuation(c: Column) -> Column:
    """Hyphen, underscore, slash and apostrophe become spaces."""
    return collapse_spaces(F.regexp_replace(c, r"[-_/']", " "))


def zero_pad(c: Column, width: int = 3) -> Column:
    """Left-pad with zeros; longer strings pass unchanged (``lpad`` would cut them)."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def map_synonyms(c: Column, synonyms: dict[str, str]) -> Column:
    """Replace a category by its synonym target, else keep it."""
    pairs = [F.lit(x) for kv in synonyms.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.lower(F.trim(c))], c)


def _known(c: Column) -> Column:
    """The value as a double, NULL when missing."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def nearest_units(x: Column, decimals: int) -> Column:
    """``|x| * 10**decimals`` rounded to a whole number, ties to even; up to 2 decimals.

    Rounds the exact binary value, as C and Python do; the JVM formatter rounds the
    shortest decimal text instead, which moves values such as 37.65. The fraction
    is scaled by 2**56, which is exact, and the rest is whole-number arithmetic.
    Small values, whose last bits lie below 2**-56, are scaled by 2**60 and keep a
    sticky bit for what the shift drops.
    """
    scale = 10**decimals

    def big(n: int) -> Column:
        return F.lit(n).cast("bigint")

    size = F.abs(x)
    fine = (size * float(2**60)).cast("bigint") * scale
    sticky = F.when(fine.bitwiseAND(big(15)) != 0, big(1)).otherwise(big(0))
    product = F.when(size < 0.0625, F.shiftright(fine, 4).bitwiseOR(sticky)).otherwise(
        ((size % 1.0) * float(2**56)).cast("bigint") * scale
    )
    odd = F.shiftright(product, 56).bitwiseAND(big(1))
    return size.cast("bigint") * scale + F.shiftright(product + (2**55 - 1) + odd, 56)


def _thousands(n: Column) -> Column:
    """A whole number of 0 or more with a comma before every three digits."""
    rest = F.lpad((n % 1000).cast("string"), 3, "0")
    return (
        F.when(n < 1000, n.cast("string"))
        .when(n < 1_000_000, F.concat(F.call_function("div", n, F.lit(1000)).cast("string"), F.lit(","), rest))
        .otherwise(F.format_number(n, 0))
    )


def _wide_text(size: Column, decimals: int, grouped: bool) -> Column:
    """A double from 2**53 on, which is a whole number: exact up to 2**102, put together from
    two halves, and beyond that from its shortest digits."""
    part = float(2**50)
    mid = F.when(size < 2.0**102, size).otherwise(0.0)
    high = F.floor(mid / part).cast("bigint")
    whole = high.cast("decimal(19,0)") * F.lit(Decimal(2**50)) + (mid % part).cast("bigint").cast("decimal(19,0)")
    digits = F.format_number(whole, 0) if grouped else whole.cast("decimal(38,0)").cast("string")
    point = "." + "0" * decimals if decimals else ""
    huge = F.format_number(size, decimals)
    return F.when(size < 2.0**102, F.concat(digits, F.lit(point))).otherwise(huge if grouped else F.replace(huge, F.lit(","), F.lit("")))


def fixed_text(c: Column, decimals: int, plus: bool = False, grouped: bool = False) -> Column:
    """Fixed-point text, NULL when missing; ``plus`` signs every number.

    ``grouped`` adds thousands commas.
    """
    x = _known(c)
    size = F.abs(x)
    # below 2**53: whole numbers alone
    units = nearest_units(F.when(size < 2.0**53, size).otherwise(0.0), decimals)
    scale = F.lit(10**decimals).cast("bigint")
    whole = F.call_function("div", units, scale)
    text = _thousands(whole) if grouped else whole.cast("string")
    if decimals:
        text = F.concat(text, F.lit("."), F.lpad((units % scale).cast("string"), decimals, "0"))
    # the rare large value is written inside a lambda, which stays out of the generated code
    wide = F.get(F.transform(F.array(size), lambda v: _wide_text(v, decimals, grouped)), F.lit(0))
    text = F.when(size < 2.0**53, text).when(size == float("inf"), "inf").when(size.isNotNull(), wide)
    return F.concat(F.when(x < 0, "-").otherwise("+" if plus else ""), text)


def _plus_above_zero(c: Column) -> Column:
    return F.when(c > 0, "+").otherwise("")


def anomaly_text(c: Column, unit: str = "%") -> Column:
    """``+15.2%``; a plus sign only above zero; ``N/A`` when missing."""
    text = F.concat(_plus_above_zero(c), fixed_text(c, 1), F.lit(unit))
    return F.coalesce(text, F.lit("N/A"))


def currency_text(c: Column, prefix: str = "KES ") -> Column:
    return F.coalesce(F.concat(F.lit(prefix), fixed_text(c, 2, grouped=True)), F.lit("N/A"))


def zscore_text(c: Column) -> Column:
    text = F.concat(_plus_above_zero(c), fixed_text(c, 2), F.lit(" σ"))
    return F.coalesce(text, F.lit("N/A"))


def percent_text(p: Column, missing: str = "N/A") -> Column:
    """Probability as ``37.8%``."""
    return F.coalesce(F.concat(fixed_text(p.cast("double") * 100, 1), F.lit("%")), F.lit(missing))


def signed_text(c: Column, decimals: int, suffix: str) -> Column:
    """Always-signed number (``+0.0%``), ``N/A`` when missing."""
    return F.coalesce(F.concat(fixed_text(c, decimals, plus=True), F.lit(suffix)), F.lit("N/A"))


def integer_text(c: Column) -> Column:
    return F.coalesce(_known(c).cast("int").cast("string"), F.lit("N/A"))
