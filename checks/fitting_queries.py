"""Medians, logistic fits and calibration, with every Newton step stated in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import oracle_tables as O
from checks import standins as S
from checks.catalog import query, r6, rounded
from harbinger.operators import logistic as G

FILLED = ["rainfall_anomaly_3m", "ndvi_anomaly_3m", "maize_price_change_3m", "previous_ipc_phase"]
FIT = ["rainfall_anomaly_3m", "maize_price_change_3m"]


def _median_sql(columns: list[str]) -> str:
    medians = ", ".join(f"median(CAST({c} AS DOUBLE)) AS m_{c}" for c in columns)
    filled = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}, 0) AS {c}" for c in columns)
    return f"""filled AS (SELECT county_name, year, month, target_phase3plus, {filled}
      FROM panel, (SELECT {medians} FROM panel))"""


def _determinant(m: list[list[str]]) -> str:
    if len(m) == 1:
        return f"({m[0][0]})"
    minors = [[row[:j] + row[j + 1 :] for row in m[1:]] for j in range(len(m))]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} ({m[0][j]}) * {_determinant(minors[j])}" for j in range(len(m))) + ")"


def newton_sql(source: str, d: int, steps: int = G.STEPS, penalty: float = 1.0) -> str:
    """Common tables fit0, fit1, ... over ``source`` (x1 .. xd, y, s): one for each step."""
    width, x = d + 1, ["1", *[f"x{i}" for i in range(1, d + 1)]]
    linear = " + ".join(f"b{i} * {x[i]}" for i in range(width))
    sums = [f"sum(s * p * (1 - p) * {x[i]} * {x[j]}) AS h{i}{j}" for i in range(width) for j in range(i, width)]
    sums += [f"sum(s * (y - p) * {x[i]}) AS g{i}" for i in range(width)]
    betas = [f"b{i}" for i in range(width)]
    matrix = [
        [f"h{min(i, j)}{max(i, j)}" + (f" + {penalty}::DOUBLE" if i == j and i else "") for j in range(width)] for i in range(width)
    ]
    right = [f"g{i}" + (f" - {penalty}::DOUBLE * b{i}" if i else "") for i in range(width)]
    whole = _determinant(matrix)
    solved = []
    for k in range(width):  # Cramer's rule
        swapped = [[right[i] if j == k else matrix[i][j] for j in range(width)] for i in range(width)]
        solved.append(f"b{k} + {_determinant(swapped)} / {whole} AS b{k}")
    out = ["fit0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS {b}" for b in betas) + ")"]
    for step in range(1, steps + 1):
        out.append(
            f"""fit{step} AS (SELECT {", ".join(solved)} FROM (SELECT {", ".join(betas)}, {", ".join(sums)} FROM (
              SELECT {source}.*, {", ".join(betas)}, 1 / (1 + exp(-({linear}))) AS p FROM {source}, fit{step - 1})
              GROUP BY {", ".join(betas)}))"""
        )
    return ",\n".join(out)


@query(
    "median_impute",
    f"""WITH {O.PANEL}, {_median_sql(FILLED)}
    SELECT county_name, year, month, {rounded(*FILLED)} FROM filled""",
)
def median_query(spark, sf):
    out = G.median_impute(S.panel(spark, sf), FILLED)
    return r6(out.select("county_name", "year", "month", *FILLED))


SCALED = f"""scaled AS (SELECT filled.*, CAST(target_phase3plus AS DOUBLE) AS y,
  {", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x{i}" for i, c in enumerate(FIT, 1))},
  CASE WHEN target_phase3plus = 1 THEN count(*) OVER () / (2.0::DOUBLE * sum((target_phase3plus = 1)::INT) OVER ())
       ELSE count(*) OVER () / (2.0::DOUBLE * sum((target_phase3plus = 0)::INT) OVER ()) END AS s
  FROM filled WHERE target_phase3plus IS NOT NULL)"""


@query(
    "logistic_irls",
    f"""WITH {O.PANEL}, {_median_sql(FIT)}, {SCALED}, {newton_sql("scaled", len(FIT))}
    SELECT county_name, year, month, target_phase3plus,
      round(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 6) AS p FROM scaled, fit{G.STEPS}""",
)
def logistic_query(spark, sf):
    """Balanced, standardised, unit penalty: the probability of every panel row."""
    rows = G.median_impute(S.panel(spark, sf), FIT).where(F.col(G.LABEL).isNotNull())
    curve = G.fit_logistic(rows, FIT)
    return r6(rows.select("county_name", "year", "month", G.LABEL, curve.probability().alias("p")))


@query(
    "platt_curve",
    f"""WITH {O.SCORED}, raw AS (SELECT p AS x1, CAST(y AS DOUBLE) AS y, 1.0::DOUBLE AS s, p AS raw FROM
      (SELECT p AS p, y FROM scored WHERE p IS NOT NULL AND y IS NOT NULL)), {newton_sql("raw", 1)}
    SELECT raw, round(1 / (1 + exp(-(b0 + b1 * raw))), 6) AS p, count(*) AS n FROM raw, fit{G.STEPS} GROUP BY ALL""",
)
def platt_query(spark, sf):
    """Raw score, calibrated probability and rows of every distinct score."""
    scored = S.scored_orders(spark, sf)
    curve = G.platt_curve(scored, "p", "y")
    rows = scored.where("p IS NOT NULL AND y IS NOT NULL").groupBy(F.col("p").alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    calibrated = rows.withColumn("p", F.col("raw")).withColumn("p", curve.probability())
    return calibrated.select("raw", F.round("p", 6).alias("p"), "n")
