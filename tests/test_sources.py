"""Feeds, the store, formats and streams on small files."""

import json
import time
from datetime import UTC, date, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger import errors
from skyledger.schemas import OBSERVATION
from skyledger.sources import formats, readers
from skyledger.sources.store import Store, live_overlaps
from skyledger.streaming import live


def test_archive_csv(spark, tmp_path):
    head = ",".join(readers.IEM_COLUMNS)
    good = {"station": "JFK", "valid": "2025-01-06 13:51", "tmpf": "30.02", "dwpf": "M", "sknt": "10.00", "drct": "990", "p01i": "T", "metar": "KJFK 061351Z RMK AO2 T10111022", "skyc1": "SKC", "skyl1": "70000", "vsby": "200", "mslp": "1090"}
    lines = [good, good | {"tmpf": "M", "sknt": "M", "mslp": "M"}, good | {"valid": "2025-13-06 13:51"}, good | {"tmpf": "200"}]
    (tmp_path / "a.csv").write_text("#DEBUG: x\n" + head + "\n" + "".join(",".join(r.get(c, "M") for c in readers.IEM_COLUMNS) + "\n" for r in lines))
    rows = readers.read_iem_csv(spark, str(tmp_path / "a.csv")).collect()
    assert len(rows) == 2 and rows[0].asDict().keys() == {f.name for f in OBSERVATION.fields}
    r = rows[0]
    assert (r.station_code, r.observed_at, r.temp_c, r.temp_f, r.dewpoint_c, r.wind_dir_degrees, r.precip_1hr_inches, r.sky_cover_1, r.sky_base_1_ft, r.visibility_miles, r.sea_level_pressure_mb) == ("JFK", "2025-01-06T13:51:00Z", -1.1, 30.02, None, None, 0.0, "SKC", None, 99.99, None)
    assert rows[1].temp_c is None and rows[1].temp_f is None
    canonical = readers.canonical(readers.read_iem_csv(spark, str(tmp_path / "a.csv")), "iem").first()
    assert canonical.sky_cover_1 == "CLR" and (canonical.knowledge_time - canonical.event_time).total_seconds() == 900
    assert "feels_like_f" in readers.in_units(readers.read_iem_csv(spark, str(tmp_path / "a.csv"))).columns
    with pytest.raises(ValueError):
        readers.in_units(spark.range(1), "furlongs")


def test_live_json(spark, tmp_path):
    rows = [{"icaoId": "KJFK", "obsTime": 1736171460, "metarType": "SPECI", "temp": -1.0, "wdir": "VRB", "wspd": 5, "altim": 1013.25, "visib": "10+", "clouds": [{"cover": "CAVOK", "base": None}], "rawOb": "SPECI KJFK RMK T10111022 PK WND 28045/1330", "precip": "T"}, {"icaoId": None, "obsTime": 1}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (r,) = readers.read_awc_json(spark, str(tmp_path / "a.json")).collect()
    assert (r.observation_type, r.temp_c, r.temp_f, r.wind_dir_degrees, r.sky_cover_1, r.peak_wind_gust_kt, r.precip_1hr_inches) == ("SPECI", -1.1, 30.0, None, "CLR", 45, 0.0) and r.altimeter_inhg == pytest.approx(29.92, abs=0.01)


def test_climatology_psv(spark, tmp_path):
    names = ["STATION", "DATE", "temperature", "temperature_Quality_Code", "temperature_Report_Type", "wind_speed", "wind_speed_Quality_Code", "REM"]
    lines = [["US1", "2025-01-06T13:51:00", "1.5", "1", "FM16", "10", "3", "MET123METAR KJFK 061351Z"], ["US1", "2025-01-06T14:51:00", "1.5", "2", "FM15", "10", "7", ""]]
    (tmp_path / "a.psv").write_text("\n".join("|".join(x) for x in [names, *lines]) + "\n")
    (r,) = readers.read_ghcnh_psv(spark, str(tmp_path / "a.psv"), "JFK").collect()
    assert (r.temp_c, r.temp_f, r.observation_type, r.wind_speed_kt, r.raw_metar) == (1.5, 34.7, "SPECI", None, "METAR KJFK 061351Z")


def test_daily_reports(spark, tmp_path):
    rows = [{"station": "KATL", "valid": "2024-01-01", "high": "60", "low": "M", "product": "202401020559-KFFC"}, {"valid": "2024-02-30", "high": "1"}, {"valid": "2024-01-02", "high": "M", "low": None}, {"valid": "2024-01-03", "high": "200", "low": "10.5", "product": None}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    climate = readers.read_cli_json(spark, str(tmp_path / "a.json"), "ATL")
    got = {r.observation_date: (r.high_temp_f, r.low_temp_f, r.report_type, r.issued_at) for r in climate.collect()}
    assert got == {"2024-01-01": (60, None, "final", "2024-01-02T05:59:00Z"), "2024-01-03": (None, 10, "preliminary", None)}
    settled = {r.settlement_date: r for r in readers.settlement_rows(climate, "America/New_York").collect()}
    assert settled[date(2024, 1, 1)].finality == "final" and settled[date(2024, 1, 3)].finality == "provisional"


def test_forecast_feeds(spark):
    df = spark.createDataFrame([("KNYC", "gfs", "2024-01-01 00:00", "2024-01-01T05:40", "50", "M", "10", "180", "40"), ("KNYC", "gfs", "x", "2024-01-01 06:00", "1", "1", "1", "1", "1")], "station string, model string, runtime string, ftime string, tmp string, dpt string, wsp string, wdr string, pop12 string")
    (r,) = readers.mos_rows(df).collect()
    assert (r.model, r.forecast_hour, r.temp_c, r.dew_point_c, r.wind_speed_ms, r.pop) == ("GFS", 6, 10.0, None, 5.144444, 0.4)
    text = json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.0]}})
    payload = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", "hourly struct<time:array<string>,temperature_2m:array<double>>").alias("p")).select("p.*")
    assert [r.temperature_2m for r in readers.hourly_rows(payload, variables=("temperature_2m", "absent")).orderBy("valid_at").collect()] == [1.0, None]


def test_point_forecasts(spark, tmp_path):
    df = spark.createDataFrame([("NYC", datetime(2024, 1, 2, 7, tzinfo=UTC), 5.0, 40.0)], "station string, valid_at timestamp, temperature_2m double, precipitation_probability double")
    get = lambda endpoint, **o: readers.point_forecast_rows(df, "gfs_global", endpoint, **o).withColumn("issued_at", F.date_format("issued_at", "MM-dd HH")).first()
    assert (get("previous_runs").issued_at, get("previous_runs").forecast_hour, get("previous_runs").pop) == ("01-01 06", 25, 0.4)
    assert (get("seamless").issued_at, get("seamless").forecast_hour) == (None, 0)
    assert get("live", now=F.lit(datetime(2024, 1, 2, 5, tzinfo=UTC))).issued_at == "01-01 18"
    with pytest.raises(ValueError):
        get("other")
    (tmp_path / "m.json").write_text(json.dumps({"data": [{"station": "KNYC", "model": "nbe", "runtime": "2024-01-01 01:00", "ftime": "2024-01-01 03:00", "tmp": 50}]}))
    assert readers.read_mos_json(spark, str(tmp_path / "m.json")).first().temp_c == 10.0
    renamed = readers.with_unit_names(spark.createDataFrame([(1.0,)], "temp_c double"), "schema.observation.v1", "imperial")
    assert renamed.columns == ["temp_f"]


def test_grid_indexes(spark, tmp_path):
    (tmp_path / "a.idx").write_text("1:0:d=2024010100:TMP:2 m above ground:anl:\n2:100:d=2024010100:UGRD:10 m above ground:anl:\n3:100:d=2024010100:VGRD:10 m above ground:anl:\n4:250:d=2024010100:TMP:surface:anl:\n")
    index = readers.read_index_text(spark, str(tmp_path / "a.idx"))
    assert [(r.offset, r.next_offset) for r in index.orderBy("record_no").collect()] == [(0, 100), (100, 250), (100, 250), (250, None)]
    assert readers.wanted_records(index, [("TMP", "2 m above ground"), ("VGRD", "10 m above ground")]).count() == 2 and readers.wanted_records(index, []).count() == 0
    (tmp_path / "bad.idx").write_text("1:0:d\n")
    with pytest.raises(Exception, match="index_format"):
        readers.read_index_text(spark, str(tmp_path / "bad.idx")).collect()
    (tmp_path / "a.jsonl").write_text('{"_offset": 0, "_length": 5, "param": "2t", "levtype": "sfc"}\n')
    assert readers.read_index_json(spark, str(tmp_path / "a.jsonl")).first()[:] == (0, 5, "2t", "sfc")
    assert readers.ADAPTERS.get("iem.archive") is readers.iem_to_observation
    with pytest.raises(errors.UnknownSourceError):
        readers.ADAPTERS.get("x")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [("NYC", f"2024-{m:02d}-10T00:00:00Z", s, float(m)) for m in (1, 2, 3) for s in ("iem", "awc.live")]
    df = spark.createDataFrame(rows, "station_code string, observed_at string, source string, temp_f double")
    store.write("observations", df, now=datetime(2024, 3, 15, tzinfo=UTC))
    assert sorted(r.temp_f for r in store.read("observations", station_code="NYC").collect()) == [1.0, 2.0]  # the month that runs and live rows aren't stored
    plan = store.read("observations", start=datetime(2024, 2, 1, tzinfo=UTC), station_code=["NYC"])
    assert [r.temp_f for r in plan.collect()] == [2.0]
    store.write("observations", df.filter("observed_at LIKE '2024-02%'").withColumn("temp_f", F.lit(9.0)), now=datetime(2024, 3, 15, tzinfo=UTC))
    assert sorted(r.temp_f for r in store.read("observations").collect()) == [1.0, 9.0]
    assert store.invalidate("observations", station_code="NYC", year=2024, month=1) and store.read("observations").count() == 1
    with pytest.raises(errors.CacheError):
        store.invalidate("observations", year=2024)
    now = datetime(2024, 3, 5, tzinfo=UTC)
    assert live_overlaps(2024, 2, now) and live_overlaps(2024, 3, now) and not live_overlaps(2024, 1, now) and not live_overlaps(2024, 4, now)


_CELLS = st.one_of(st.none(), st.booleans(), st.integers(-(10**9), 10**9), st.text(max_size=12), st.floats(allow_nan=False, allow_infinity=False, width=32))


@given(_CELLS)
def test_cells_read_back(x):
    got = formats._value(formats._cell(x))
    assert got == pytest.approx(x) if isinstance(x, float) else got == x


def test_tables_as_text(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1, None, 2.5), ("2024-01-01", 2, 'q"\n', 1e-7)], "`odd name` string, n int, t string, x double").coalesce(1)
    text = formats.toon_dumps(df)
    assert text.startswith('rows[2]{"odd name",n,t,x}:') and formats.toon_loads(text) == [r.asDict() for r in df.collect()]
    for bad in ("x", "rows[2]{a}:\n  1", "rows[1]{a}:\n  1,2", 'rows[1]{a}:\n  "x'):
        with pytest.raises(errors.FormatError):
            formats.toon_loads(bad)
    assert json.loads(formats.to_json(df.limit(0))) == {"columns": df.columns, "data": []} and len(json.loads(formats.to_json(df))) == 2
    loop: dict = {"a": float("nan")}
    loop["b"] = loop
    assert formats.json_safe(loop) == {"a": None, "b": "<cycle>"}
    with pytest.raises(errors.FormatError):
        formats.json_safe({1: 2})
    for kind in ("parquet", "csv", "json"):
        formats.write(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2


def test_rows_in_memory_are_checked(spark):
    assert readers.from_rows(spark, [], "awc.live").columns == readers.from_rows(spark, [{"station_code": "NYC", "observed_at": "2024-01-01T00:00:00Z"}], "iem.archive").columns
    with pytest.raises(errors.UnknownSourceError):
        readers.from_rows(spark, [], "elsewhere")
    for make in (lambda at: readers.from_rows(spark, [], "awc.live", at), lambda at: readers.from_records(spark, [], "UTC", at)):
        with pytest.raises(ValueError, match="time zone"):
            make(datetime(2024, 1, 1))
    assert readers.from_records(spark, [], "UTC").count() == 0


def test_partitions_have_safe_names(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    spark.createDataFrame([("kalshi", "KXHIGHNY-25MAY26-T79", "2024-01-10T00:00:00Z", 1)], "issuer string, ticker string, ts string, n int").transform(lambda df: store.write("trades", df, now=datetime(2024, 3, 1, tzinfo=UTC)) or df)
    assert store.read("trades", issuer="kalshi", ticker="KXHIGHNY-25MAY26-T79").count() == 1
    for bad in ({"issuer": "../x"}, {"issuer": "Kalshi"}, {"ticker": "..."}, {"ticker": "a/b"}, {"issuer": ["kalshi", ""]}):
        with pytest.raises(errors.CacheError):
            store.read("trades", **bad)
    with pytest.raises(errors.CacheError):
        store.invalidate("trades", issuer="kalshi", ticker="..", year=2024, month=1)


def test_live_requests_are_checked_first():
    assert live.check_request("awc", 30, "KNYC") == {"processingTime": "30 seconds"}
    for source, cadence, station, kind in (("x", 30, "NYC", errors.UnknownSourceError), ("iem", 30, "NYC", ValueError), ("awc", "30", "NYC", TypeError), ("awc", 30, "nyc", ValueError)):
        with pytest.raises(kind):
            live.check_request(source, cadence, station)


def test_latest(spark):
    at = datetime(2024, 1, 1, tzinfo=UTC)
    df = spark.createDataFrame([("NYC", at, "METAR", 1), ("NYC", at, "SPECI", 2), ("LAX", at, "METAR", 3)], "station_code string, observed_at timestamp, observation_type string, n int")
    assert live.latest_one(df, "NYC")["n"] == 2
    with pytest.raises(errors.NoLiveDataError):
        live.latest_one(df, "XXX")


def test_latest_of_each_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("".join(json.dumps({"station_code": "NYC", "observed_at": t, "observation_type": "METAR"}) + "\n" for t in ("t2", "t1")))
    stream = live.read_files(spark, str(source), "station_code string, observed_at string, observation_type string")
    seen = []
    live.write_latest(stream, lambda df, k: seen.append((k, [r.observed_at for r in df.collect()])), availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert seen == [(0, ["t2"])]


def test_streamed_changes_are_the_batch_ones(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    times = ["t1", "t1", "t2", "t1", "t1", "t3"]
    schema = "station_code string, observed_at string, seq int"
    for k in range(0, 6, 2):
        (source / f"{k}.json").write_text("".join(json.dumps({"station_code": s, "observed_at": times[k + j], "seq": k + j}) + "\n" for j in range(2) for s in ("NYC", "LAX")))
        time.sleep(0.05)
    stream = live.changes_stream(live.read_files(spark, str(source), schema, maxFilesPerTrigger=1))
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(out))
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.schema(schema).parquet(str(out)).collect()))
    want = sorted(map(tuple, live.changes(spark.read.schema(schema).json(str(source))).collect()))
    assert got == want and len(got) == 8
