"""Run queries and their SQL side by side: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("harbinger")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    """One value as both engines should state it."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def as_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if name not in catalog.ORACLES:
        return True, f"rows={len(rows)} {spent:.2f}s (rows only)"
    cur = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cur.description]
    kinds = dict(zip(columns, (str(d[1]) for d in cur.description), strict=True))
    expected = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    mine, theirs = as_rows(df.columns, rows), as_rows(columns, expected)
    ok = mine == theirs
    note = f"rows={len(rows)} {spent:.2f}s"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    same = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
            "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}
    odd = {c: (types[c], kinds[c]) for c in types if same.get(kinds[c], kinds[c]) != types[c]}
    if odd:
        note += f" TYPES {odd}"
    if not ok:
        only_mine = [r for r in mine if r not in set(theirs)][:2]
        only_theirs = [r for r in theirs if r not in set(mine)][:2]
        diff = len(set(mine) ^ set(theirs))
        note += f" vs {len(theirs)} diff={diff}\n   {sorted(columns)}\n   spark {only_mine}\n   sql   {only_theirs}"
    return ok, note


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    catalog.load_all()
    names = args[1:] or list(catalog.QUERIES)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as err:  # noqa: BLE001
            ok, note = False, f"{type(err).__name__}: {str(err)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
