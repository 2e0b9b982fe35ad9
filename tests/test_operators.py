"""Operators on hand-made rows: ties, nulls, edges of windows, and empty input."""

import random
from datetime import UTC, date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger import errors, schemas, stations
from skyledger.functions import models, parsing, temporal, units, weather
from skyledger.operators import aggregates, asof, extremes, grid, markets, merge, qc, transforms, validate
from skyledger.plans import discovery, pairs
from skyledger.stations import REGISTRY, Registry

UTC_DAY = datetime(2024, 7, 4, tzinfo=UTC)


def obs(spark, rows, more=""):
    names = "station_code string, observed_at timestamp, observation_type string, source string, temp_f double, temp_c double, precip_1hr_inches double" + more
    return spark.createDataFrame(rows, names)


def row(hour=0, *, day=UTC_DAY, station="NYC", kind="METAR", source="iem", f=None, c=None, p=None):
    return (station, day + timedelta(hours=hour), kind, source, f, c, p)


# -- merges


def test_merge_prefers_the_live_feed_and_keeps_specials_apart(spark):
    rows = [row(source="ghcnh", f=1.0), row(source="awc", f=3.0), row(source="iem", f=2.0), row(source="odd", f=9.0), row(kind="SPECI", source="odd", f=4.0)]
    got = {(r.observation_type, r.source, r.temp_f) for r in merge.merge_observations(obs(spark, rows)).collect()}
    assert got == {("METAR", "awc", 3.0), ("SPECI", "odd", 4.0)}


def test_dotted_tags_have_no_priority(spark):
    assert merge.merge_observations(obs(spark, [row(source="iem.archive", f=1.0), row(source="ghcnh", f=2.0)])).first().source == "ghcnh"


def test_gold_orders_by_receipt_then_ingestion(spark):
    rows = [("NYC", 1, "iem", "b", None), ("NYC", 1, "iem", "a", "2"), ("NYC", 1, "iem", "a", "1"), ("NYC", 1, "ncei", "a", "0")]
    df = spark.createDataFrame(rows, "station_code string, observed_at int, source string, source_received_at string, ingestion_id string")
    assert merge.query_time_merge(df).first().ingestion_id == "1"
    assert merge.query_time_merge(df.drop("source_received_at", "ingestion_id")).count() == 1


def test_merge_doesnt_depend_on_partitions(spark):
    draw = random.Random(1)
    rows = [row(draw.randrange(5), source=draw.choice(["awc", "iem", "ghcnh"]), f=float(draw.randrange(9))) for _ in range(300)]
    one = sorted(map(tuple, merge.merge_observations(obs(spark, rows)).collect()), key=repr)
    draw.shuffle(rows)
    other = merge.merge_observations(obs(spark, rows).repartition(7))
    assert sorted(map(tuple, other.collect()), key=repr) == one
    assert sorted(map(tuple, merge.merge_observations(other).collect()), key=repr) == one  # and twice is once


def test_climate_and_first_seen(spark):
    rows = [("NYC", date(2024, 1, 1), "preliminary", 1.0, 1), ("NYC", date(2024, 1, 1), "final", 3.0, 2), ("NYC", date(2024, 1, 1), "final", 3.0, 0), (None, date(2024, 1, 1), "final", 3.0, 5)]
    df = spark.createDataFrame(rows, "station_code string, observation_date date, report_type string, report_type_priority double, seq int")
    assert {r.seq for r in merge.merge_climate(df, "seq").collect()} == {0, 5}
    assert merge.dedup_climate_reports(df).count() == 1
    slugs = spark.createDataFrame([("a", 2), ("a", 1), (" ", 0), (None, 0)], "slug string, seq int")
    assert [tuple(r) for r in merge.dedup_first_seen(slugs, "slug", "seq").collect()] == [("a", 1)]


# -- days


def test_settlement_day_ignores_daylight_saving(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 4, 3, tzinfo=UTC),), (datetime(2024, 7, 4, 5, tzinfo=UTC),)], "ts timestamp")
    assert [r[0] for r in df.select(temporal.settlement_date("ts", F.lit(-18000))).collect()] == [date(2024, 7, 3), date(2024, 7, 4)]
    assert df.select(temporal.local_date("ts", "America/New_York")).first()[0] == date(2024, 7, 3)
    assert stations.lst_offset_seconds("Australia/Sydney") == 36000 and stations.lst_offset_seconds("America/New_York") == -18000
    close = df.select(F.date_format(temporal.market_close(F.lit(date(2024, 7, 4)), F.lit(-18000)), "yyyy-MM-dd HH:mm")).first()[0]
    assert close == "2024-07-04 21:30"


def test_pairs_have_every_day(spark):
    dim = Registry({"NYC": REGISTRY.get("KNYC")}).table(spark)
    rows = [row(6, f=70.0, p=0.1), row(7, f=80.0), row(8)]
    out = {r.date.day: r for r in pairs.pairs(obs(spark, rows), None, dim, date(2024, 7, 3), date(2024, 7, 5)).collect()}
    assert sorted(out) == [3, 4, 5]
    assert (out[4].obs_high_f, out[4].obs_low_f, out[4].obs_mean_f, out[4].obs_count, out[4].obs_total_precip_in) == (80.0, 70.0, 75.0, 3, 0.1)
    assert (out[3].obs_count, out[3].obs_high_f, out[3].fcst_high_f) == (0, None, None)
    result = pairs.research("KNYC", date(2024, 7, 4), date(2024, 7, 4), obs=obs(spark, rows + [row(9, c=99.0)]), qc=True, source="iem")
    assert (result.qc.first().flagged, result.qc.first().total, result.source, result.frame.count()) == (1, 4, "iem", 1)
    empty = pairs.pairs(obs(spark, []), None, dim, date(2024, 7, 3), date(2024, 7, 4))
    assert [r.obs_count for r in empty.collect()] == [0, 0] and set(schemas.PAIRS.names) == set(empty.columns)
    assert temporal.spine(spark, date(2024, 1, 2), date(2024, 1, 1)).count() == 0


def test_quality_control_is_kept_beside_the_pairs(spark, tmp_path):
    from skyledger.sources.store import Store

    rows = obs(spark, [row(6, f=70.0), row(9, c=99.0)])
    store = Store(spark, str(tmp_path))
    ask = lambda df, **o: pairs.research("KNYC", date(2024, 7, 4), date(2024, 7, 4), obs=df, **o)
    result = ask(rows, qc=True, store=store, ordered=True)
    (hit,) = store.read("qc", station_code="NYC").drop("year", "month").collect()
    assert set(schemas.QC_SIDECAR.names) == set(hit.asDict()) and len(schemas.QC_SIDECAR.names) == 13
    assert (hit.rule_id, hit.field, hit.flag, hit.detector_metadata) == ("temp_c.out_of_range", "temp_c", "flagged", '{"value":99.0}')
    assert result.sidecar.columns == schemas.QC_SIDECAR.names and result.qc.first().crosscheck_disagreements == 0
    assert ask(rows).sidecar is None and ask(rows).qc is None
    version = result.data_version
    assert len(version) == 16 and version == ask(rows.repartition(3)).data_version
    assert version not in {ask(obs(spark, [row(6, f=71.0), row(9, c=99.0)])).data_version, pairs.research("KNYC", date(2024, 7, 4), date(2024, 7, 5), obs=rows).data_version}
    raw = pairs.obs_rows("NYC", date(2024, 7, 4), date(2024, 7, 4), obs=rows)
    assert raw.columns == [*rows.columns, "date"] and raw.count() == 2
    assert pairs.obs_rows("NYC", date(2024, 7, 3), date(2024, 7, 3), obs=rows).count() == 0


def test_windows_cut_by_time_are_the_same(spark):
    draw = random.Random(2)
    rows = [(s, None if draw.random() < 0.02 else datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=draw.choice((0, 1, 30)) + 9 * k), k, draw.random()) for s in ("a", "b", None) for k in range(draw.choice((1, 40, 90)))]
    df = spark.createDataFrame(rows, "s string, ts timestamp, seq int, x double").repartition(3)
    by = {"partition_by": ["s"], "order_by": ["ts", "seq"]}
    makes = [
        lambda **o: transforms.lag(df, "x", 3, **by, **o),
        lambda **o: transforms.lag(df, "x", -5, **by, **o),
        lambda **o: transforms.diff(df, "x", 2, **by, **o),
        lambda **o: transforms.diff2(df, "x", **by, **o),
        lambda **o: transforms.rolling(df, "x", 12, "max", **by, **o),
        lambda **o: transforms.rolling(df, "x", 1, "sum", **by, **o),
    ]
    for make in makes:
        assert make(chunk="day").columns == make().columns
        assert sorted(map(repr, make(chunk="day").collect())) == sorted(map(repr, make().collect()))


def test_settlement_pages_name_stations(spark):
    texts = {
        "https://www.wunderground.com/history/daily/us/ny/new-york-city/KLGA/date/2024-1-1": "KLGA",
        "see http://wunderground.com/dashboard/pws/KNYC.": "KNYC",
        "https://wunderground.com/cat/forecasts/KJFK?x=1 and https://wunderground.com/weather-station/KJFK": "KJFK",
        "https://wunderground.com/history/daily/KJFKX": None,
        "https://wunderground.com/history/weekly/KJFK": None,
        "https://wunderground.com/history/daily/US/KJFK": None,
        "https://wunderground.com.evil.example/history/daily/KJFK": None,
        "https://wunderground.com/history/airport/KJFK https://wunderground.com/history/daily/KLGA": None,
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.i for r in df.select("t", markets.url_icao("t").alias("i")).collect()} == texts
    words = {"The highest": "high", "minimum of": "low", "maximal": "default", "high or low": "default", "HOTTEST": "high"}
    df = spark.createDataFrame([(t,) for t in words], "t string")
    assert {r.t: r.m for r in df.select("t", markets.measure("t").alias("m")).collect()} == words


def test_registries_are_bounded(spark, monkeypatch):
    rows = spark.range(4).selectExpr("CAST(id AS STRING) AS code", "'X' AS icao", "'UTC' AS tz", "0.0D AS latitude", "0.0D AS longitude")
    assert len(Registry.from_table(rows).stations) == 4
    monkeypatch.setattr(stations, "MOST_STATIONS", 3)
    with pytest.raises(errors.StationError):
        Registry.from_table(rows)
    with pytest.raises(ValueError, match="names"):
        markets.derive_city(rows, [f"city {k}" for k in range(markets.MOST_CITIES + 1)], "code")


def test_points_off_the_grid_have_their_nearest(spark):
    import math

    points = [(k, -20.0 + k % 7, 100.0 + k // 7) for k in range(70)]
    where = [("a", 45.0, -100.0), ("b", -17.3, 103.2), ("c", -90.0, 0.0), ("d", 10.0, 300.0)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    g = spark.createDataFrame(points, "id int, lat double, lon double")
    got = {r.k: (r.id, r.grid_dist_km) for r in grid.nearest_grid(spark.createDataFrame(where, "k string, latitude double, longitude double"), g, station="k", point=["id"]).collect()}
    for k, a, b in where:
        want = min((km(a, b, c, d), i) for i, c, d in points)
        assert got[k][1] == pytest.approx(want[0]) and (got[k][0] == want[1] or k == "c")


def _forecast(spark, rows):
    return spark.createDataFrame(rows, "station_code string, issued_at timestamp, valid_at timestamp, model string, temperature_f double, pop_6hr_pct double, qpf_6hr_in double, temperature_c double, precipitation_probability_pct double")


def test_the_run_of_a_day_was_issued_by_the_close(spark):
    dim = Registry({"NYC": REGISTRY.get("NYC")}).table(spark)
    close, noon = datetime(2024, 7, 4, 21, 30, tzinfo=UTC), datetime(2024, 7, 4, 17, tzinfo=UTC)
    at = [("NYC", close, noon, "gfs", 90.0, 10.0, 0.1, None, None), ("NYC", close + timedelta(seconds=1), noon, "gfs", 99.0, 10.0, 0.1, None, None), ("NYC", close - timedelta(hours=6), noon, "nbe", 80.0, 10.0, 0.1, None, None)]
    get = lambda rows, **o: pairs.pairs(obs(spark, []), None, dim, date(2024, 7, 4), date(2024, 7, 4), forecasts=_forecast(spark, rows), **o).first()
    assert (get(at).fcst_high_f, get(at).fcst_model) == (90.0, "gfs")
    assert get(at, model="NBE").fcst_high_f == 80.0
    assert get(at[1:2]).fcst_high_f is None
    series = [("NYC", None, noon, None, None, None, None, 30.0, 40.0)]
    mixed = get([("NYC", close, noon, "gfs", None, 10.0, 0.2, None, None), *series])
    assert (mixed.fcst_high_f, mixed.fcst_model, mixed.fcst_qpf_6hr_in, mixed.fcst_pop_6hr_pct) == (86.0, "open-meteo", 0.2, 40.0) and mixed.fcst_issued_at is not None


def test_extremes_need_twelve_temperatures(spark):
    def days(n):
        rows = [row(10 + k, c=20.0 + k, source="awc") for k in range(n)] + [row(10 + n, c=None, p=0.25), row(9, c=20.0, source="ghcnh") if n > 3 else row(9)]
        df = obs(spark, rows).withColumns({"tz": F.lit("America/New_York"), "is_us": F.lit(True)})
        return extremes.daily_extremes(df).first()

    low, enough = days(3), days(12)
    assert (low.n_obs, low.tmax_c, low.source_tmin, low.precip_inches) == (3, None, None, 0.25)
    assert (enough.n_obs, enough.tmax_c, enough.tmin_c, enough.source_tmin, enough.source_tmax) == (13, 31.0, 20.0, "ghcnh", "awc")
    with pytest.raises(ValueError):
        extremes.daily_extremes(obs(spark, []), merge="other")
    assert spark.range(1).select(units.half_up(F.lit(-2.5), 0), units.half_up(F.lit(-0.05), 1)).first()[:] == (-3.0, -0.1)


# -- points in time


def test_views_and_guards(spark):
    at = temporal.TimePoint(datetime(2024, 1, 1, tzinfo=UTC))
    df = spark.createDataFrame([(at.at,), (at.at + timedelta(seconds=1),), (None,)], "knowledge_time timestamp")
    assert asof.knowledge_view(df, at).count() == 1 and asof.leakage(df, at).count() == 1
    with pytest.raises(errors.LeakageError) as leak:
        asof.assert_no_leakage(df, at)
    assert leak.value.details["count"] == 1 and "leakage" in leak.value.to_json()
    with pytest.raises(errors.LeakageError):
        asof.assert_issued(df, at, "knowledge_time")
    assert asof.assert_issued(df.limit(0), at, "knowledge_time").count() == 0
    tagged = df.withColumn("source", F.lit("iem"))
    assert asof.pin_source(tagged, "iem.archive").count() == 3 and asof.assert_source(tagged, "iem").count() == 3
    for call in (lambda: asof.pin_source(tagged, "x"), lambda: asof.assert_source(tagged, "awc"), lambda: asof.assert_source(df.withColumn("source", F.lit(None).cast("string")), "awc")):
        with pytest.raises(errors.SourceMismatchError):
            call()


def test_snapshot_reasons(spark):
    dim = Registry({"NYC": REGISTRY.get("NYC")}).table(spark)
    climate = spark.createDataFrame([("NYC", date(2024, 7, 4), "final", 90)], "station_code string, observation_date date, report_type string, high_temp_f int")
    table = obs(spark, [row(10, f=1.0), row(30, f=2.0), row(12, f=3.0)])
    get = lambda hour, c: asof.snapshot(table, c, dim, date(2024, 7, 4), temporal.TimePoint(UTC_DAY + timedelta(hours=hour))).first()
    assert (get(11, climate).obs_count, get(11, climate).climate_reason, get(11, climate).climate) == (1, "not yet published", None)
    assert (get(40, climate).obs_count, get(40, climate).climate_reason, get(40, climate).climate.high_temp_f) == (2, "available", 90)
    assert get(40, climate.limit(0)).climate_reason == "no record"


@given(st.datetimes(timezones=st.just(UTC)))
def test_time_points_order_as_instants(at):
    p = temporal.TimePoint(at)
    assert p == temporal.TimePoint(at.astimezone()) and not p < p and p.iso().endswith("Z")


@pytest.mark.parametrize("bad", [datetime(2024, 1, 1), date(2024, 1, 1), None, "2024-01-01"])
def test_time_points_refuse_what_is_no_instant(bad):
    with pytest.raises(errors.TimePointError):
        temporal.TimePoint.parse(bad) if isinstance(bad, str) else temporal.TimePoint(bad)


def test_cycles(spark):
    f = lambda h, hours: spark.range(1).select(F.date_format(temporal.floor_to_cycle(F.lit(datetime(2024, 3, 1, h, 59, tzinfo=UTC)).cast("timestamp"), hours), "MM-dd HH")).first()[0]
    assert (f(5, (6, 18)), f(6, (6, 18)), f(23, (6, 18))) == ("02-29 18", "03-01 06", "03-01 18")
    assert temporal.default_cycle(datetime(2024, 1, 2, 1, 29, tzinfo=UTC), 0, (0, 6, 12, 18)) == datetime(2024, 1, 1, 18, tzinfo=UTC)
    assert temporal.mos_hours("NBE", date(2026, 5, 1), date(2026, 5, 9)) == (0, 1, 6, 7, 12, 13, 18, 19)
    assert temporal.months(date(2023, 11, 5), date(2024, 2, 1)) == [(2023, 11), (2023, 12), (2024, 1), (2024, 2)]
    assert temporal.years(date(2023, 11, 5), date(2024, 2, 1))[1] == (date(2024, 1, 1), date(2024, 2, 1))
    with pytest.raises(errors.ModelError):
        temporal.issued_at_previous_day(F.lit(None), 8, (0,))
    models.check_depth("hrrr", datetime(2015, 1, 1, tzinfo=UTC), datetime(2024, 1, 1, tzinfo=UTC))
    with pytest.raises(errors.HistoricalDepthError):
        models.check_depth("hafs", datetime(2015, 1, 1, tzinfo=UTC), datetime(2024, 1, 1, tzinfo=UTC))
    assert len(models.GRIDDED) == 24 and len(models.POINT) == 36 and models.point("jma_msm").hours[1] == 3


# -- quality


def test_qc_bits(spark):
    df = spark.createDataFrame([(60.0, 10.0, -1.0, 361, 1100.0), (None, 5.0, None, None, None), (10.0, 11.0, 1.0, 0, 870.0)], "temp_c double, dew_point_c double, wind_speed_ms double, wind_dir_deg int, slp_hpa double")
    assert [r.obs_qc_status for r in qc.apply_qc(df).collect()] == [1 + 4 + 8 + 16, 0, 2]
    assert qc.apply_qc(df.drop("slp_hpa")).first().obs_qc_status == 1 + 4 + 8
    marked = qc.apply_qc(df.withColumns({"station_code": F.lit("NYC"), "observed_at": F.lit("t"), "source": F.lit("iem")}))
    assert qc.sidecar(marked).count() == 5 and qc.qc_summary(marked).first().flagged == 2
    assert qc.family_of("gefs") == "ensemble" and qc.family_of("hrrr") == "base"
    nwp = spark.createDataFrame([(300.0, 0.4), (float("nan"), 0.1), (350.0, 0.1), (-1.0, 0.1)], "temp_k_2m double, precip_m_total double")
    assert [r.qc_status for r in qc.nwp_verdict(nwp, "ecmwf_ifs_ens").collect()] == ["flagged", "clean", "flagged", "suspect"]


def test_crosscheck_is_strict(spark):
    rows = [row(source="iem", c=1.0), row(source="ghcnh.x", c=3.0), row(1, source="iem", c=1.0), row(1, source="ghcnh", c=3.5), row(1, source="ghcnh", c=9.0)]
    assert sorted(r.delta for r in qc.crosscheck_by_source(obs(spark, rows)).collect()) == [2.5, 8.0]


def test_validation(spark):
    good = spark.createDataFrame([("NYC", datetime(2024, 1, 1, tzinfo=UTC), "METAR", "iem.archive")], "station string, event_time timestamp, observation_type string, source string")
    assert validate.validate(good, "schema.observation.v1", source="iem.archive").ok
    bad = good.withColumn("station", F.lit(None).cast("string")).withColumn("observation_type", F.lit("X")).withColumn("temp_c", F.lit("1"))
    report = validate.validate(bad, "schema.observation.v1", source="iem.archive", strict=False)
    assert {(p["column"], p["problem"]) for p in report.problems} == {("station", "nulls"), ("observation_type", "values"), ("temp_c", "type")}
    with pytest.raises(errors.SchemaError):
        validate.validate(bad, "schema.observation.v1")
    with pytest.raises(errors.SourceMismatchError):
        validate.validate(good, "schema.observation.v1", source="other")
    with pytest.raises(errors.UnknownSchemaError):
        schemas.lookup("x")
    with pytest.raises(errors.SchemaConflictError):
        schemas.register(schemas.Schema("schema.observation.v1", ()))
    with pytest.raises(errors.SchemaError):
        schemas.ColumnSpec("a", "enum")
    assert len(validate.audit_log()) >= 3 and len(schemas.OBSERVATION.fields) == 30 and len(schemas.LEDGER.fields) == 39 and len(schemas.PAIRS.fields) == 20


# -- transforms and scalars


def test_clamping_keeps_nulls_and_lone_values(spark):
    df = spark.createDataFrame([(1, None), (2, 99.0)], "k int, temp_c double")
    assert [r.temp_c_clipped for r in transforms.clip_outliers(df, "temp_c").orderBy("k").collect()] == [None, 57.0]
    assert [r.temp_c_clipped for r in transforms.clip_sigma(df, "temp_c").orderBy("k").collect()] == [None, 99.0]
    for call, kind in ((lambda: transforms.clip_outliers(df, "x"), KeyError), (lambda: transforms.clip_outliers(df, "k", std=0), ValueError), (lambda: transforms.rolling(df, "k", 2, "skew", partition_by=[], order_by=["k"]), ValueError)):
        with pytest.raises(kind):
            call()
    own = transforms.rolling(df, "k", 2, lambda xs: F.array_max(xs) - F.array_min(xs), partition_by=[], order_by=["k"])
    assert [r.k_rolling_2_lambda for r in own.orderBy("k").collect()] == [0, 1]


@settings(max_examples=25, deadline=None)
@given(st.floats(-60, 120), st.floats(0, 100), st.floats(0, 100))
def test_feels_like_lies_between_its_branches(spark, t, wind, rh):
    got = spark.range(1).select(weather.feels_like(F.lit(t), F.lit(wind), F.lit(rh))).first()[0]
    assert got is not None and (got == t or t <= 50 or t >= 80)


def test_missing_and_infinite_weather(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    n, nan = F.lit(None).cast("double"), F.lit(float("nan"))
    assert f(weather.wind_chill(n, F.lit(5.0))) is None and f(weather.wind_chill(F.lit(60.0), F.lit(5.0))) == 60.0
    assert f(weather.feels_like(F.lit(90.0), n, nan)) == 90.0 and f(weather.feels_like(F.lit(40.0), nan, n)) is None
    assert f(weather.relative_humidity(F.lit(10.0), F.lit(20.0))) == 100.0 and f(weather.relative_humidity(nan, F.lit(1.0))) is None


def test_every_tenths_group_reads_back(spark):
    values = [(v,) for v in range(-999, 1000, 7)]
    df = spark.createDataFrame(values, "v int").withColumn("raw", F.concat(F.lit("KNYC T01110111 RMK T"), F.when(F.col("v") < 0, "1").otherwise("0"), F.lpad(F.abs("v").cast("string"), 3, "0"), F.lit("0005")))
    t, d = parsing.tenths_group("raw")
    assert all(r.t == r.v / 10 and r.d == 0.5 for r in df.select("v", t.alias("t"), d.alias("d")).collect())
    assert spark.range(1).select(parsing.tenths_group(F.lit("KNYC T01110111"))[0]).first()[0] is None


@pytest.mark.parametrize(("text", "miles"), [("10+", 10.0), ("1 1/2", 1.5), ("M1/4", 0.25), ("1/0", None), ("150", 99.99), ("", None), ("x", None), (None, None)])
def test_visibility(spark, text, miles):
    assert spark.range(1).select(parsing.visibility(F.lit(text).cast("string"))).first()[0] == miles


@pytest.mark.parametrize(("hour", "days", "kind"), [(3, 1, "correction"), (4, 1, "final"), (10, 1, "final"), (11, 1, "correction"), (9, 0, "preliminary"), (9, 2, "correction")])
def test_report_kinds(spark, hour, days, kind):
    product = f"{(date(2024, 1, 1) + timedelta(days)):%Y%m%d}{hour:02d}59-KOKX"
    assert spark.range(1).select(parsing.report_type(F.lit(product), F.lit(date(2024, 1, 1)))).first()[0] == kind
    assert spark.range(1).select(parsing.report_type(F.lit("x"), F.lit(date(2024, 1, 1)))).first()[0] == "preliminary"


# -- markets, grids, stations


def test_settlement_statuses(spark):
    events = [("1", "highest-on-2024-07-03", "Highest in Paris", "", "paris"), ("2", "lowest-2024-07-03", "Lowest", "https://evil.example/x", "paris"), ("3", "x-2024-07-03", "Low", "", "taipei"), ("4", "x-2024-07-04", "high", "https://www.wunderground.com/history/daily/KNYC", "nowhere"), ("5", "x", "high", "", "paris"), ("é", "x", "", "", "paris")]
    df = spark.createDataFrame(events, "id string, slug string, title string, description string, city string")
    cities = spark.createDataFrame(stations.event_cities(), "city string, measure string, icao string")
    resolved = markets.resolve_events(df, cities)
    assert {r.id: (r.status, r.icao) for r in resolved.collect()} == {"1": ("ok", "LFPG"), "2": ("bad_description", "LFPB"), "3": ("deferred", "RCTP"), "4": ("ok", "KNYC"), "5": ("no_date", "LFPG"), "é": ("bad_id", "LFPG")}
    listed = {r.id: (r.icao, r.measure) for r in markets.discover_events(df, cities).collect()}
    assert listed["3"] == (None, None) and listed["1"] == ("LFPG", "high") and len(listed) == 6
    days = spark.createDataFrame([("LFPG", date(2024, 7, 3), 10.0, 25.0, 20, "iem", "awc"), ("KNYC", date(2024, 7, 4), 1.0, 2.0, 20, "iem", "iem")], "station string, local_date date, tmin_c double, tmax_c double, n_obs bigint, source_tmin string, source_tmax string")
    done = {r.id: (r.status, r.observed_value_c) for r in markets.settle(resolved, days, REGISTRY.table(spark), datetime(2024, 7, 5, 3, tzinfo=UTC)).collect()}
    assert done["1"] == ("settled", 25.0) and done["4"] == ("too_early", None) and done["3"] == ("deferred", None)


def test_contracts_and_selectors():
    assert markets.resolve_contract("KXHIGHNY-25MAY26-T79") == ("high", "NYC") and markets.resolve_contract("KLOWCHI") == ("low", "MDW")
    for call, kind in ((lambda: markets.resolve_contract("X"), errors.ContractError), (lambda: markets.resolve_contract("KHIGHNY", datetime(2024, 1, 1)), errors.ContractError), (lambda: markets.check_selector(station="a", city="b"), errors.SelectorError), (lambda: REGISTRY.get("nope"), errors.StationError)):
        with pytest.raises(kind):
            call()
    assert markets.check_selector(station="a", city=None) == "station"
    assert stations.city_stations("chicago") == ["KMDW", "KORD"] and stations.zone_of("ORD") == "America/Chicago" and len(REGISTRY.stations) == 66


def test_fills_and_prices(spark):
    history = spark.createDataFrame([("m", '{"history": [{"t": 10, "p": 0.5}, {"p": 1}]}')], "market string, payload string")
    assert [(r.market, r.price) for r in markets.price_history(history).collect()] == [("m", 0.5)]
    df = spark.createDataFrame([('{"trade_id":"t","yes_price_dollars":"0.5600","count_fp":"3.00","taker_side":"yes","created_time":"2024-01-01T00:00:00Z"}',), ('{"yes_price":40,"count":2}',)], "payload string")
    assert [(round(r.price, 6), r["count"]) for r in markets.fills(df).collect()] == [(56.0, 3), (40.0, 2)]


def test_nearest_grid_wraps_and_falls_back(spark):
    where = spark.createDataFrame([("a", 10.2, 179.9), ("b", 0.0, 0.0), ("c", 89.5, 10.0)], "station_code string, latitude double, longitude double")
    points = spark.createDataFrame([(0, 0, 10.0, 180.2), (0, 1, 11.0, 170.0), (0, 2, -40.0, 30.0), (0, 3, 89.0, 200.0)], "iy int, ix int, lat double, lon double")
    got = {r.station_code: r.ix for r in grid.nearest_grid(where, points).collect()}
    assert got == {"a": 0, "b": 2, "c": 3}


def test_versions_and_discovery(spark):
    df = spark.createDataFrame([("NYC", "2024-01-01T01:00:00Z"), ("NYC", "2024-01-01T00:00:00Z")], "station_code string, observed_at string")
    a, b = aggregates.data_version(df).first(), aggregates.data_version(df.repartition(3)).first()
    assert a == b and len(a.version) == 16 and aggregates.data_fingerprint(df, ["station_code"]).first().rows == 2
    assert len(aggregates.version_of("a", "b")) == 16
    assert discovery.describe(spark, "schema.observation.v1").count() == 20
    gaps = discovery.climate_gaps(spark.createDataFrame([("NYC", date(2024, 1, 1))], "station_code string, observation_date date"), Registry({"NYC": REGISTRY.get("NYC")}).table(spark), date(2023, 12, 31), date(2024, 1, 2), by_year=True)
    assert [r.date for r in gaps.collect()] == [date(2023, 12, 31)]
