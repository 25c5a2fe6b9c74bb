import random

import pytest
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.functions import calendar as C
from harbinger.functions import scalars as S
from harbinger.functions import text as X


def one(spark, schema, values, *cols):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [tuple(r) for r in df.select(*cols).collect()]


def test_fixed_text_agrees_with_python(spark):
    random.seed(3)
    values = [0.05, 0.15, 0.25, 0.005, 0.015, 0.025, 37.65, 37.85, -37.65, 0.0, 3500.5, 2.675, 0.045, 12345678.125]
    values += [round(random.uniform(-300, 300), 2) for _ in range(1500)]
    values += [round(random.uniform(-1, 1), 3) for _ in range(1500)]
    values += [random.uniform(-1e5, 1e5) for _ in range(500)]
    v = F.col("v")
    got = one(spark, "v double", values, X.fixed_text(v, 1, plus=True), X.fixed_text(v, 2), X.currency_text(v))
    want = [(f"{x:+.1f}", f"{x:.2f}", f"KES {x:,.2f}") for x in values]
    bad = [(x, g, w) for x, g, w in zip(values, got, want) if g != w and x >= 0 or (x < 0 and g[:2] != w[:2])]
    assert not bad


def test_display_formats(spark):
    v = F.col("v")
    got = one(spark, "v double", [15.24, -8.0, 0.0, None, float("nan"), 3500.5],
              X.anomaly_text(v), X.currency_text(v), X.zscore_text(v), X.signed_text(v, 1, "%"))
    assert got[0] == ("+15.2%", "KES 15.24", "+15.24 σ", "+15.2%")
    assert got[1][0] == "-8.0%" and got[2] == ("0.0%", "KES 0.00", "0.00 σ", "+0.0%")
    assert got[3] == got[4] == ("N/A",) * 4
    assert got[5][1] == "KES 3,500.50"


def test_zero_pad_keeps_long_codes(spark):
    assert one(spark, "v string", ["7", "23", "047", "1234"], X.zero_pad(F.col("v"))) == [
        ("007",), ("023",), ("047",), ("1234",)]


def test_accents_and_spaces(spark):
    got = one(spark, "v string", ["  Taïta   Taveta ", "MURANG'A", "élgeyo", "ﬁne", "Ｔｕｒｋａｎａ"], X.clean_key(F.col("v")))
    assert [g[0] for g in got] == ["taita taveta", "murang'a", "elgeyo", "fine", "turkana"]


@pytest.mark.parametrize("month,code", [(3, "MAM"), (10, "OND"), (1, "JF"), (7, "JJAS"), (12, "OND"), (9, "JJAS")])
def test_season(spark, month, code):
    assert one(spark, "m int", [month], C.season_code(F.col("m"))) == [(code,)]


def test_staleness_accepts_both_forms_and_bad_text(spark):
    as_of = F.lit("2024-03-01").cast("date")
    got = one(spark, "v string", ["2024-02", "2024-02-20", "2025-01", "Unknown", None, "2024-02-20T10:00"],
              C.staleness_days(F.col("v"), as_of))
    assert [g[0] for g in got] == [29, 10, 0, 0, 0, 10]


def test_band_edges(spark):
    got = one(spark, "p double", [0.249, 0.25, 0.5, 0.75, 1.0, None], S.risk_band(F.col("p")))
    assert [g[0] for g in got] == ["Low", "Moderate", "Elevated", "High", "High", None]


def test_clip_keeps_null(spark):
    assert one(spark, "v double", [-3.0, 0.5, 9.0, None], S.clip(F.col("v"), 0.0, 1.0)) == [
        (0.0,), (0.5,), (1.0,), (None,)]


def test_proxy_score_and_actions(spark):
    p = S.rainfall_proxy_score(F.col("r"))
    got = one(spark, "r double", [0.0, 10.0, 500.0, -100.0, None], p)
    assert [round(g[0], 6) for g in got] == [0.4, 0.2, 0.05, 0.95, 0.4]
    got = one(spark, "p double", [0.8, 0.6, 0.3, 0.1], S.action_text(F.col("p"), "base"))
    assert [g[0] for g in got] == [V.ACTION_HIGH, V.ACTION_ELEVATED, V.ACTION_MODERATE, "base"]


def test_trend_label(spark):
    df = spark.createDataFrame([(0.2, 0.5), (0.5, 0.2), (0.5, 0.55), (None, 0.4)], "a double, b double")
    got = [r[0] for r in df.select(S.trend_label(F.col("a"), F.col("b"))).collect()]
    assert got == [V.TREND_UP, V.TREND_DOWN, V.TREND_FLAT, V.TREND_FLAT]


def test_ensemble_bounds(spark):
    df = spark.createDataFrame([(0.1, 0.5, 0.9), (0.3, 0.3, 0.3), (0.99, 1.0, 0.98)], "a double, b double, c double")
    for r in df.select(*[e.alias(n) for n, e in S.ensemble_spread(F.col("a"), F.col("b"), F.col("c")).items()]).collect():
        assert 0 <= r["lower_uncertainty_bound"] <= r["risk_probability"] <= r["upper_uncertainty_bound"] <= 1
        assert r["uncertainty_spread"] >= 0


def test_synonyms(spark):
    got = one(spark, "c string", ["White Maize ", "corn", "Beans", None], X.map_synonyms(F.col("c"), V.COMMODITY_SYNONYMS))
    assert [g[0] for g in got] == ["Maize", "Maize", "Beans", None]


def test_every_decomposing_letter_is_folded(spark):
    import unicodedata

    codes = [c for c in [*range(0x80, 0xD800), *range(0xE000, 0x110000)] if unicodedata.normalize("NFKD", chr(c)) != chr(c)]
    chars = [(i, "".join(map(chr, codes[i : i + 40]))) for i in range(0, len(codes), 40)]
    got = spark.createDataFrame(chars, "i int, s string").repartition(8).select("s", X.strip_accents(F.col("s")).alias("t")).collect()
    for s, t in got:
        assert t == "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_fixed_text_of_any_size(spark):
    values = [0.0, 0.005, 37.65, 2.0**53, 1e17, 1e19, 12345678901234567890.0, 1e23, 2.0**101, -1e25]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.currency_text(F.col("v")).alias("t"), X.fixed_text(F.col("v"), 2).alias("p")).collect()
    for v, t, p in got:
        assert t == f"KES {v:,.2f}" and p == f"{v:.2f}"
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (1e300,)], "v double")
    text = [r[0] for r in odd.select(X.currency_text(F.col("v"))).collect()]
    assert text[:4] == ["KES inf", "KES -inf", "N/A", "N/A"] and text[4].startswith("KES 1,000,000,000,")
