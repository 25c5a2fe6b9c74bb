import datetime as dt

import pytest
from frame_rows import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.operators import names as N
from harbinger.operators.quality import SchemaDrift
from harbinger.plans.build import run_build, stored_forecasts, stored_scores
from harbinger.sources import dimension as D
from harbinger.sources import feeds as R
from harbinger.sources import manifest as M
from harbinger.sources import storage as S

RAIN = """county_name,year,month,rainfall_mm,rainfall_anomaly,extra
Turkana,2019,1,9.0,16.9,x
turkana county,2019,2,1.0,-5.0,x
23,2019.0,3,4.0,,x
Turkana,2019,1,7.5,2.0,x
"""


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_rainfall_feed(spark, tmp_path, dim):
    path = put(tmp_path / "r.csv", RAIN.replace("turkana county", "TURKANA "))
    got = rows(R.load_feed(spark, path, "rainfall", dim))
    assert got == [("Turkana", 2019, 1, 7.5, 2.0), ("Turkana", 2019, 2, 1.0, -5.0), ("Turkana", 2019, 3, 4.0, None)]


def test_last_file_wins_across_files(spark, tmp_path, dim):
    put(tmp_path / "in" / "a.csv", "county_name,year,month,rainfall_mm,rainfall_anomaly\nLamu,2019,1,1.0,1.0\nLamu,2019,2,5.0,1.0\n")
    put(tmp_path / "in" / "b.csv", "county_name,year,month,rainfall_mm,rainfall_anomaly\nLamu,2019,1,2.0,1.0\n")
    got = rows(R.load_feed(spark, str(tmp_path / "in"), "rainfall", dim).select("month", "rainfall_mm"))
    assert got == [(1, 2.0), (2, 5.0)]


@pytest.mark.parametrize("bad", ["Turkana,2019,13,1.0,1.0", "Turkana,2019,1,-2.0,1.0", "Oz,2019,1,1.0,1.0"])
def test_strict_feed_aborts(spark, tmp_path, dim, bad):
    path = put(tmp_path / "r.csv", "county_name,year,month,rainfall_mm,rainfall_anomaly\n" + bad + "\n")
    with pytest.raises(PySparkException):
        R.load_feed(spark, path, "rainfall", dim).collect()


def test_quarantine_keeps_the_rest(spark, tmp_path, dim):
    text = "county_name,year,month,rainfall_mm,rainfall_anomaly\nTurkana,2019,1,1.0,1.0\nOz,2019,x,-1.0,1.0\nLamu,2019,3,1.0,\n"
    raw = R.read_csv(spark, put(tmp_path / "r.csv", text), R.FEED_COLUMNS["rainfall"])
    good, bad = R.split_feed(raw, "rainfall", dim, N.strict_aliases(spark))
    assert sorted(r["county_name"] for r in good.collect()) == ["Lamu", "Turkana"]
    assert [set(r["problems"]) for r in bad.collect()] == [{"name", "type:month", "month", "rainfall"}]
    lenient = R.load_feed(spark, str(tmp_path / "r.csv"), "rainfall", dim, strict=False)
    assert lenient.count() == 2


def test_missing_column(spark, tmp_path, dim):
    path = put(tmp_path / "r.csv", "county_name,year,month\nTurkana,2019,1\n")
    with pytest.raises(SchemaDrift, match="rainfall_mm"):
        R.load_feed(spark, path, "rainfall", dim)


def test_vegetation_and_market(spark, tmp_path, dim):
    veg = put(tmp_path / "v.csv", "county_name,year,month,ndvi_mean,ndvi_anomaly\nLamu,2019,1,0.3,1\nLamu,2019,2,1.4,1\n")
    with pytest.raises(PySparkException, match="ndvi"):
        R.load_feed(spark, veg, "vegetation", dim).collect()
    text = "county_name,year,month,commodity,price\nLamu,2019,1, MAIZE ,10\nLamu,2019,1,Beans,20\nLamu,2019,2,maize,30\n"
    market = put(tmp_path / "m.csv", text)
    assert R.load_feed(spark, market, "market", dim).count() == 2
    assert R.load_feed(spark, market, "market", dim, commodity=None).count() == 3
    with pytest.raises(ValueError, match="no rows"):
        R.require_rows(R.load_feed(spark, market, "market", dim, commodity="Rice"), "Rice")


def test_assessments_to_months(spark, tmp_path, dim):
    text = ("county_name,period_start,period_end,ipc_phase,phase3plus_population,phase3plus_percent\n"
            "Turkana,2019-01-01,2019-06-30,2,100,19.7\nTurkana,2019-06-01,2019-07-31,3,200,30.0\n")
    got = R.monthly_assessments(R.load_feed(spark, put(tmp_path / "a.csv", text), "assessments", dim))
    assert rows(got.select("month", "ipc_phase", "target_phase3plus")) == [
        (1, 2, 0), (2, 2, 0), (3, 2, 0), (4, 2, 0), (5, 2, 0), (6, 3, 1), (7, 3, 1)]


def test_normalise_clips_and_harmonises(spark, dim):
    veg = spark.createDataFrame([("turkana", "2019", "1", "1.7", "2")], "county_name string, year string, month string, ndvi string, ndvi_anomaly string")
    r = R.normalise(veg, "vegetation", dim).first()
    assert (r["county_name"], r["year"], r["ndvi_mean"], r["ndvi"]) == ("Turkana", 2019, 1.0, 1.0)
    price = spark.createDataFrame([("Oz", "2019", "1", "white maize", "-5")],
                                  "county_name string, year string, month string, commodity string, price_kes_per_90kg string")
    r = R.normalise(price, "market", dim).first()
    assert (r["county_name"], r["commodity"], r["price"], r["unit"], r["currency"]) == ("Oz", "Maize", 0.0, V.PRICE_UNIT, "KES")
    a = spark.createDataFrame([("Lamu", "2019-01-01", "2019-06-30", "7", "-4", "130.5")],
                              "county_name string, period_start string, period_end string, ipc_phase string, phase3plus_population string, phase3plus_percent string")
    r = R.normalise(a, "assessments", dim).first()
    assert (r["ipc_phase"], r["phase3plus_population"], r["phase3plus_percent"], r["target_phase3plus"]) == (5, 0, 100.0, 1)
    assert r["period_start"] == dt.date(2019, 1, 1)
    with pytest.raises(SchemaDrift):
        R.normalise(veg.drop("ndvi"), "vegetation", dim)


def test_snapshot_choice(spark, tmp_path):
    folder = tmp_path / "raw"
    with pytest.raises(FileNotFoundError):
        S.pick_snapshot(spark, str(folder), "d.csv")
    put(folder / "20240101_d.csv", "a\n1\n")
    put(folder / "20240301_d.csv", "a\n1\n")
    path, status = S.pick_snapshot(spark, str(folder), "d.csv")
    assert path.endswith("20240301_d.csv") and status == "stale_fallback"
    put(folder / "d.csv", "a\n1\n")
    assert S.pick_snapshot(spark, str(folder), "d.csv") == (f"{folder}/d.csv", "success")


def test_landing_is_written_once(spark, tmp_path):
    first = S.land_raw(spark.range(3), str(tmp_path / "land"), "20240101")
    S.land_raw(spark.range(9), str(tmp_path / "land"), "20240101")
    assert spark.read.parquet(first).count() == 3
    S.land_raw(spark.range(9), str(tmp_path / "land"), "20240102")
    assert spark.read.parquet(str(tmp_path / "land")).count() == 12
    (tmp_path / "land" / "ingest_date=20240101" / "_SUCCESS").unlink()
    S.land_raw(spark.range(5), str(tmp_path / "land"), "20240101")
    assert spark.read.parquet(first).count() == 5


def test_fingerprint(spark, tmp_path):
    put(tmp_path / "f" / "x.csv", "hello\n")
    r = S.fingerprint(spark, str(tmp_path / "f")).first()
    assert r["file_size_bytes"] == 6
    assert r["sha256_checksum"] == "5891b5b522d5df086d0ff0b110fbd9d21bb4fc7163af34d08286a2e846f6be03"


def test_tables_and_reports(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(4)

    path = str(tmp_path / "t")
    assert S.reload_or_build(spark, path, build).count() == 4
    assert S.reload_or_build(spark, path, build).count() == 4 and len(calls) == 1
    S.write_report(spark.createDataFrame([("e1", 0.5)], "id string, f1 double"), str(tmp_path / "j"), partition_by="id")
    S.write_report(spark.createDataFrame([("e2", 0.7)], "id string, f1 double"), str(tmp_path / "j"), partition_by="id")
    assert S.read_report(spark, str(tmp_path / "j")).count() == 2 and S.read_report(spark, str(tmp_path / "no")) is None
    assert S.read_table(spark, str(tmp_path / "no"), path).count() == 4
    with pytest.raises(FileNotFoundError):
        S.read_table(spark, str(tmp_path / "no"))
    put(tmp_path / "m.json", '{"a": {"b": 1},\n "c": [1, 2]}')
    assert S.read_json_document(spark, str(tmp_path / "m.json")).first()["a"]["b"] == 1


def test_registry_and_staleness(spark):
    reg = M.source_registry(spark)
    assert {r["source_key"]: r["staleness_warning_days"] for r in reg.collect()} == {
        "rainfall_chirps": 45, "vegetation_modis": 40, "market_prices": 60, "ipc_food_security": 180, "county_boundaries": 365}
    df = spark.createDataFrame([("market_prices", "2024-01"), ("market_prices", "2024-02-15")], "source_key string, date_coverage_end string")
    got = rows(M.with_staleness(df, reg, F.lit("2024-03-02").cast("date")).select("staleness_days", "is_stale"))
    assert got == [(16, False), (61, True)]


def test_dimension_seed_and_lookup(spark, tmp_path, dim):
    path = str(tmp_path / "dim")
    new = dim.drop("alternate_names")
    assert D.seed_dimension(spark, path, new.where("county_id < '040'")) == 39
    assert D.seed_dimension(spark, path, new) == 8
    assert D.seed_dimension(spark, path, new) == 0
    stored = spark.read.parquet(path)
    assert stored.count() == 47
    assert D.entity_by_code(stored, "23").first()["canonical_name"] == "Turkana"
    assert D.entity_by_code(stored, "99").count() == 0
    assert {r["asal_category"] for r in D.list_entities(stored, "Arid").collect()} == {"Arid"}


def feed_files(base):
    months = [(2019 + i // 12, i % 12 + 1) for i in range(24)]
    names = ["Turkana", "marsabit", "Lamu County"]
    head = {"climate": "rainfall_mm,rainfall_anomaly", "vegetation": "ndvi_mean,ndvi_anomaly", "market": "commodity,price"}
    file = {"climate": V.SOURCES[0][7], "vegetation": V.SOURCES[1][7], "market": V.SOURCES[2][7]}
    cell = {"climate": "{m}.5,-{m}.0", "vegetation": "0.{m},{m}.0", "market": "Dry Maize,{m}00"}
    for kind in head:
        lines = [f"{n},{y},{m},{cell[kind].format(m=m)}" for n in names for y, m in months]
        put(base / kind / file[kind], f"county_name,year,month,{head[kind]}\n" + "\n".join(lines) + "\n")
    lines = [f"{n},{y}-{a},{y}-{b},{p},10,5.0" for n in names for y in (2019, 2020)
             for a, b, p in (("01-01", "06-30", 2), ("07-01", "12-31", 3))]
    put(base / "ipc" / V.SOURCES[3][7], "county_name,period_start,period_end,ipc_phase,phase3plus_population,phase3plus_percent\n" + "\n".join(lines) + "\n")
    return {s[0]: str(base / s[6].rsplit("/", 1)[-1]) for s in V.SOURCES[:4]}


def test_whole_build(spark, tmp_path, dim):
    folders = feed_files(tmp_path / "raw")
    out = str(tmp_path / "out")
    dry = run_build(spark, folders, out, dim, "2021-03-01", "2021-03-01 10:00:00", dry_run=True).first()
    assert dry["status"] == "success" and dry["panel_rows"] is None
    log = run_build(spark, folders, out, dim, "2021-03-01", "2021-03-02 10:00:00").first()
    assert (log["panel_rows"], log["long_rows"], log["broken_rules"], log["status"]) == (72, 216, 0, "success")
    latest = {r["dataset_name"]: r for r in M.latest_assets(M.read_manifest(spark, f"{out}/manifest")).collect()}
    rain = latest["rainfall_chirps"]
    assert (rain["date_coverage_start"], rain["date_coverage_end"], rain["row_count"], rain["is_stale"]) == ("2019-01", "2020-12", 72, True)
    assert rain["geographic_coverage"] == ["Lamu", "Marsabit", "Turkana"] and len(rain["sha256_checksum"]) == 64
    # the dry run recorded the file; the second run found the record and added none
    assert rain["asset_id"] == f"rainfall_chirps-20210301100000-{rain['sha256_checksum'][:8]}"
    quality = {r["source_key"]: r for r in S.read_report(spark, f"{out}/quality").collect()}
    assert quality["rainfall_chirps"]["status"] == V.STATUS_STALE and quality["ipc_food_security"]["status"] == V.STATUS_CURRENT
    again = M.already_ingested(M.read_manifest(spark, f"{out}/manifest"), M.read_manifest(spark, f"{out}/manifest"))
    assert again.count() == 4 and log["models_trained"] is False
    assert S.read_report(spark, f"{out}/runs").count() == 2
    cut = run_build(spark, folders, out, dim, "2021-03-01", "2021-03-03 10:00:00", step="features", from_date="2020-06").first()
    assert cut["panel_rows"] == 36


def test_one_broken_source_does_not_stop_the_rest(spark, tmp_path, dim):
    folders = feed_files(tmp_path / "raw")
    put(tmp_path / "raw" / "market" / V.SOURCES[2][7], "county_name,year\nTurkana,2019\n")
    log = run_build(spark, folders, str(tmp_path / "out"), dim, "2021-03-01", "2021-03-01 10:00:00").first()
    assert log["status"] == "partial_failure" and log["failed"][0].startswith("market_prices")
    assert log["panel_rows"] is None and len(log["succeeded"]) == 3 and log["unmatched"] == []
    run_build(spark, folders, str(tmp_path / "out"), dim, "2021-03-01", "2021-03-02 10:00:00", step="ingest")
    records = M.read_manifest(spark, str(tmp_path / "out" / "manifest"))
    failed = records.where("ingestion_status = 'failed'").collect()
    assert records.count() == 4 and [r["dataset_name"] for r in failed] == ["market_prices"]
    assert failed[0]["error_message"] and failed[0]["sha256_checksum"] is None


def test_unmatched_names_are_reported(spark, tmp_path, dim):
    folders = feed_files(tmp_path / "raw")
    put(tmp_path / "raw" / "climate" / V.SOURCES[0][7], "county_name,year,month,rainfall_mm,rainfall_anomaly\nOz,2019,1,1,1\n")
    log = run_build(spark, folders, str(tmp_path / "out"), dim, "2021-03-01", "2021-03-01 10:00:00", step="ingest").first()
    assert log["unmatched"] == ["rainfall_chirps: 1"] and log["status"] == "success"


def test_training_from_the_stored_table(spark, tmp_path, dim):
    folders, out = feed_files(tmp_path / "raw"), str(tmp_path / "out")
    folds = [
        ("v", "2019-01-01", "2019-12-31", "2020-01-01", "2020-08-31", "validation"),
        ("t", "2019-01-01", "2020-08-31", "2020-09-01", "2020-12-31", "test"),
    ]
    options = {"folds": folds, "candidates": ("logistic_regression", "random_forest"), "max_iter": 3}
    run_build(spark, folders, out, dim, "2021-03-01", "2021-03-01 10:00:00", step="features")
    log = run_build(spark, folders, out, dim, "2021-03-01", "2021-03-01 10:00:00", step="train", **options).first()
    assert log["models_trained"] is True and log["attempted"] == []
    metrics = spark.read.parquet(f"{out}/metrics")
    assert metrics.count() == 9 and {r[0] for r in metrics.select("experiment_id").collect()} == {"backtest"}
    forecasts = stored_forecasts(spark, out)
    assert rows(forecasts.select("county_name", "horizon_months")) == [(c, h) for c in ("Lamu", "Marsabit", "Turkana") for h in (1, 2, 3)]
    assert forecasts.where("risk_probability between 0 and 1").count() == 9
    run_build(spark, folders, out, dim, "2021-03-01", "2021-03-02 10:00:00", step="train", **options)
    assert spark.read.parquet(f"{out}/metrics").count() == 9  # replaced, not added
    scored = stored_scores(spark, out)
    assert scored.count() == 72 and scored.where("model_risk_prob between 0 and 1").count() == 72


def test_a_commit_that_died_before_its_rename_leaves_no_trace(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "manifest")
    record = M.failed_record(spark, "market_prices", "no header", "2021-03-01 10:00:00")

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(M, "move_folder", dies)
        with pytest.raises(RuntimeError, match="lost"):
            M.commit_records(record, path)
    assert M.read_manifest(spark, path).isEmpty()
    assert M.commit_records(record, path) == 1 and M.commit_records(record, path) == 0
    assert M.commit_records(record.union(record), path) == 0
    assert M.read_manifest(spark, path).count() == 1
