"""Feeds, row parsers, sinks and registries as queries. There are no feeds among the driver's tables, so their texts are made
from ``events`` and ``orders`` by expressions that are the same in both languages; what comes out of them isn't.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import models, parsing
from .operators import aggregates, extremes, markets, merge, qc
from .plans import discovery
from .plans import pairs as plan
from .queries import _CLI_BEST, _DAYS_SQL, _EV_SQL, _EVENT_STATUS, _ICAO, _MEASURE, CLI_SQL, CODES, DAILY_SQL, MERGED_SQL, OBS_SQL, OFFSETS_SQL, _cities, _cli_plain, _events, _local, _obs, _read, query
from .sources import formats, readers
from .sources.store import Store
from .stations import _US, REGISTRY, city_stations, zones
from .streaming import live

_STAMP = "strftime(ts, '%Y-%m-%d %H:%M')"


def _base_sql(fields: dict[str, str], name: str = "f") -> str:
    return f"e AS (SELECT event_id AS i, user_id AS u, value AS v, ts, {_STAMP} AS stamp FROM events), {name} AS (SELECT i, ts, stamp, " + ", ".join(f"{e} AS {n}" for n, e in fields.items()) + " FROM e)"


def _base(spark: SparkSession, d: str, fields: dict[str, str]) -> DataFrame:
    e = _read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.selectExpr("event_id AS i", "user_id AS u", "value AS v", "ts", "date_format(ts, 'yyyy-MM-dd HH:mm') AS stamp")
    return e.selectExpr("i", "ts", "stamp", *[f"{x} AS {n}" for n, x in fields.items()])


def _shared(spark: SparkSession, label: str) -> str:
    """A new path below the folder that the session names for what driver and executors share; a session of one process may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "skyledger-shared")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _num(x: str, missing: str = "M") -> str:
    return f"try_cast(nullif(nullif({x}, '{missing}'), '') AS DOUBLE)"


def _in(x: str, low, high) -> str:
    return f"CASE WHEN {x} BETWEEN {low} AND {high} THEN {x} END"


def _rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def _whole(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


# -- archive of surface reports

_IEM = {
    "station": "CASE i % 7 WHEN 0 THEN 'ab' WHEN 1 THEN 'KNYC' WHEN 2 THEN 'NYC' ELSE 'EGLC' END",
    "valid": "CASE WHEN i % 11 = 0 THEN '2024-13-01 00:00' ELSE stamp END",
    "tmpf": "CASE WHEN i % 5 = 0 THEN 'M' WHEN i % 5 = 1 THEN '' ELSE CAST(i % 260 - 80 AS STRING) || '.0' END",
    "dwpf": "CASE WHEN i % 6 = 0 THEN 'M' ELSE CAST(i % 120 + 2 AS STRING) || '.5' END",
    "sknt": "CASE WHEN i % 4 = 0 THEN 'M' ELSE CAST(i % 250 AS STRING) END",
    "drct": "CAST(i % 400 AS STRING)",
    "mslp": "CASE WHEN i % 3 = 0 THEN 'M' ELSE CAST(850 + i % 260 AS STRING) || '.3' END",
    "vsby": "CASE WHEN i % 8 = 0 THEN 'M' ELSE CAST(i % 120 AS STRING) END",
    "gust": "CASE WHEN i % 9 = 0 THEN CAST(i % 300 AS STRING) ELSE 'M' END",
    "p01i": "CASE i % 10 WHEN 0 THEN 'T' WHEN 1 THEN 'M' ELSE '0.' || lpad(CAST(i % 100 AS STRING), 2, '0') END",
    "alti": "'29.' || lpad(CAST(i % 100 AS STRING), 2, '0')",
    "skyc1": "CASE i % 4 WHEN 0 THEN 'cavok' WHEN 1 THEN 'SKC' WHEN 2 THEN 'BKN' ELSE 'M' END",
    "skyl1": "CASE WHEN i % 4 = 3 THEN 'M' ELSE CAST(i * 7 % 70000 AS STRING) END",
    "metar": "CASE WHEN i % 3 = 0 THEN 'SPECI KNYC ' ELSE 'METAR KNYC ' END || CAST(i AS STRING) || CASE WHEN i % 2 = 0 THEN ' RMK AO2 T' || CAST(i % 2 AS STRING) || lpad(CAST(i % 400 AS STRING), 3, '0') || '1' || lpad(CAST(i % 90 AS STRING), 3, '0') ELSE '' END",
}
_IEM_SQL = (
    _base_sql(_IEM)
    + f""", p AS (SELECT *, {_num("tmpf")} AS t, {_num("dwpf")} AS td, {_num("sknt")} AS kt, {_num("mslp")} AS slp, {_num("vsby")} AS vis, CASE WHEN i % 2 = 0 THEN CAST(i % 400 AS DOUBLE) / 10 END AS tg, CASE WHEN i % 2 = 0 THEN -CAST(i % 90 AS DOUBLE) / 10 END AS dg FROM f
  WHERE station <> 'ab' AND i % 11 <> 0),
s AS (SELECT i, ts, CASE station WHEN 'KNYC' THEN 'NYC' ELSE station END AS station_code, replace(stamp, ' ', 'T') || ':00Z' AS observed_at, CASE WHEN i % 3 = 0 THEN 'SPECI' ELSE 'METAR' END AS observation_type, 'iem' AS source,
  CASE WHEN (t - 32) * 5 / 9 BETWEEN -90 AND 60 THEN coalesce(tg, (t - 32) * 5 / 9) END AS temp_c, CASE WHEN (td - 32) * 5 / 9 BETWEEN -90 AND 60 THEN coalesce(dg, (td - 32) * 5 / 9) END AS dewpoint_c,
  CASE WHEN (t - 32) * 5 / 9 BETWEEN -90 AND 60 THEN t END AS temp_f, CASE WHEN (td - 32) * 5 / 9 BETWEEN -90 AND 60 THEN td END AS dewpoint_f,
  {_in("CAST(drct AS INTEGER)", 0, 360)} AS wind_dir_degrees, CASE WHEN kt BETWEEN 0 AND 200 THEN CAST(kt AS INTEGER) END AS wind_speed_kt, CASE WHEN i % 9 = 0 AND i % 300 <= 250 THEN CAST(i % 300 AS INTEGER) END AS wind_gust_kt, CAST(alti AS DOUBLE) AS altimeter_inhg,
  {_in("slp", 870, 1084)} AS sea_level_pressure_mb, CASE WHEN vis IS NOT NULL THEN least(vis, 99.99::DOUBLE) END AS visibility_miles, CASE i % 10 WHEN 0 THEN 0::DOUBLE WHEN 1 THEN NULL ELSE CAST(p01i AS DOUBLE) END AS precip_1hr_inches,
  CASE i % 4 WHEN 0 THEN 'CLR' WHEN 1 THEN 'SKC' WHEN 2 THEN 'BKN' END AS sky_cover_1, CASE WHEN i % 4 < 3 AND i * 7 % 70000 <= 60000 THEN CAST(i * 7 % 70000 AS INTEGER) END AS sky_base_1_ft, metar AS raw_metar
  FROM p WHERE coalesce(t, td, kt, slp) IS NOT NULL)"""
)
_STORAGE = "station_code observed_at observation_type source temp_c dewpoint_c temp_f dewpoint_f wind_dir_degrees wind_speed_kt wind_gust_kt altimeter_inhg sea_level_pressure_mb visibility_miles precip_1hr_inches sky_cover_1 sky_base_1_ft raw_metar".split()
_STORAGE_SQL = f"station_code, observed_at, observation_type, source, {_rounded('temp_c', 'dewpoint_c', 'temp_f', 'dewpoint_f')}, {_whole('wind_dir_degrees', 'wind_speed_kt', 'wind_gust_kt')}, {_rounded('altimeter_inhg', 'sea_level_pressure_mb', 'visibility_miles', 'precip_1hr_inches')}, sky_cover_1, CAST(sky_base_1_ft AS BIGINT) AS sky_base_1_ft, raw_metar"


def _iem(spark, d):
    rows = _base(spark, d, _IEM)
    return readers.iem_to_observation(rows.select(*[F.col(c) if c in _IEM else F.lit("M").alias(c) for c in readers.IEM_COLUMNS]))


@query(f"WITH {_IEM_SQL} SELECT {_STORAGE_SQL} FROM s")
def iem_observations(spark, d):
    return _iem(spark, d).select(*_STORAGE)


@query(
    f"""WITH {_IEM_SQL} SELECT station_code AS station, CAST(strptime(observed_at, '%Y-%m-%dT%H:%M:%SZ') AS TIMESTAMP) AS event_time, observation_type, round(temp_c, 6) + 0.0 AS temp_c, round(dewpoint_c, 6) + 0.0 AS dew_point_c, round(wind_speed_kt * (1852.0::DOUBLE / 3600), 6) + 0.0 AS wind_speed_ms, CAST(wind_dir_degrees AS BIGINT) AS wind_dir_deg,
  round(wind_gust_kt * (1852.0::DOUBLE / 3600), 6) + 0.0 AS wind_gust_ms, round(sea_level_pressure_mb, 6) + 0.0 AS slp_hpa, round(visibility_miles * 1609.344::DOUBLE, 6) + 0.0 AS visibility_m, CASE sky_cover_1 WHEN 'SKC' THEN 'CLR' ELSE sky_cover_1 END AS sky_cover_1, round(sky_base_1_ft * 0.3048::DOUBLE, 6) + 0.0 AS sky_base_1_m,
  round(precip_1hr_inches * 25.4::DOUBLE, 6) + 0.0 AS precip_mm_1h, raw_metar, source, CAST(strptime(observed_at, '%Y-%m-%dT%H:%M:%SZ') AS TIMESTAMP) + INTERVAL 15 MINUTES AS knowledge_time FROM s"""
)
def canonical_observations(spark, d):
    names = "station event_time observation_type temp_c dew_point_c wind_speed_ms wind_dir_deg wind_gust_ms slp_hpa visibility_m sky_cover_1 sky_base_1_m precip_mm_1h raw_metar source knowledge_time".split()
    return readers.canonical(_iem(spark, d), "iem").select(*names)


@query(f"WITH {_IEM_SQL} SELECT raw_metar, round(wind_speed_kt * (1852.0::DOUBLE / 3600), 6) + 0.0 AS wind_speed_ms, round(visibility_miles * 1.609344::DOUBLE, 6) + 0.0 AS visibility_km, round(precip_1hr_inches * 25.4::DOUBLE, 6) + 0.0 AS precip_mm FROM s")
def metric_units(spark, d):
    return readers.in_units(_iem(spark, d), "metric").select("raw_metar", "wind_speed_ms", "visibility_km", "precip_mm")


@query(f"WITH {_IEM_SQL} SELECT raw_metar, round(wind_speed_kt * 1.15078::DOUBLE, 6) + 0.0 AS wind_speed_mph, round(visibility_miles, 6) + 0.0 AS visibility_miles FROM s")
def imperial_units(spark, d):
    return readers.in_units(_iem(spark, d), "imperial").select("raw_metar", "wind_speed_mph", "visibility_miles")


@query(f"WITH {_IEM_SQL} SELECT raw_metar, round(temp_c, 6) + 0.0 AS temp_f, round(dewpoint_c, 6) + 0.0 AS dew_point_f FROM s")
def unit_names(spark, d):
    rows = readers.canonical(_iem(spark, d), "iem").select("raw_metar", "temp_c", "dew_point_c")
    return readers.with_unit_names(rows, "schema.observation.v1", "imperial")


# -- live reports

_AWC = {
    "icaoId": "CASE i % 6 WHEN 0 THEN NULL WHEN 1 THEN 'EGLC' ELSE 'KLAX' END",
    "metarType": "CASE WHEN i % 4 = 0 THEN 'speci' ELSE 'METAR' END",
    "temp": "CASE WHEN i % 5 = 0 THEN NULL ELSE CAST(i % 200 - 100 AS DOUBLE) / 2 END",
    "dewp": "CASE WHEN i % 7 = 0 THEN NULL ELSE CAST(i % 90 - 50 AS DOUBLE) END",
    "wdir": "CASE WHEN i % 8 = 0 THEN 'VRB' ELSE CAST(i % 400 AS STRING) END",
    "wspd": "CAST(i % 230 AS DOUBLE)",
    "wgst": "CASE WHEN i % 3 = 0 THEN CAST(i % 300 AS DOUBLE) END",
    "altim": "CAST(980 + i % 60 AS DOUBLE)",
    "slp": "CAST(860 + i % 230 AS DOUBLE)",
    "visib": "CASE i % 5 WHEN 0 THEN '10+' WHEN 1 THEN '1 1/2' WHEN 2 THEN 'M1/4' WHEN 3 THEN CAST(i % 150 AS STRING) ELSE 'x' END",
    "cover": "CASE i % 3 WHEN 0 THEN 'CAVOK' WHEN 1 THEN 'OVC' ELSE 'zz' END",
    "base": "CAST(i * 11 % 80000 AS INT)",
    "precip": "CASE i % 4 WHEN 0 THEN 'T' WHEN 1 THEN NULL ELSE '0.' || lpad(CAST(i % 100 AS STRING), 2, '0') END",
    "rawOb": "'KLAX ' || CAST(i AS STRING) || CASE WHEN i % 2 = 0 THEN ' RMK PK WND ' || lpad(CAST(i % 400 AS STRING), 3, '0') || lpad(CAST(i % 90 AS STRING), 2, '0') || '/1215 T' || CAST(i % 2 AS STRING) || lpad(CAST(i % 400 AS STRING), 3, '0') || '1' || lpad(CAST(i % 90 AS STRING), 3, '0') ELSE '' END",
}


@query(
    "WITH "
    + _base_sql(_AWC)
    + f""", p AS (SELECT *, date_trunc('second', ts) AS second, {_in("CASE WHEN i % 2 = 0 THEN CAST(i % 400 AS DOUBLE) / 10 ELSE temp END", -90, 60)} AS tc, {_in("CASE WHEN i % 2 = 0 THEN -CAST(i % 90 AS DOUBLE) / 10 ELSE dewp END", -90, 60)} AS dc FROM f WHERE icaoId IS NOT NULL)
SELECT CASE icaoId WHEN 'KLAX' THEN 'LAX' ELSE icaoId END AS station_code, strftime(second, '%Y-%m-%dT%H:%M:%SZ') AS observed_at, CASE WHEN i % 4 = 0 THEN 'SPECI' ELSE 'METAR' END AS observation_type, 'awc' AS source, round(tc, 6) + 0.0 AS temp_c, round(dc, 6) + 0.0 AS dewpoint_c,
  round(CASE WHEN i % 2 = 0 THEN round_even(tc * 9 / 5 + 32, 0) ELSE tc * 9 / 5 + 32 END, 6) + 0.0 AS temp_f, round(CASE WHEN i % 2 = 0 THEN round_even(dc * 9 / 5 + 32, 0) ELSE dc * 9 / 5 + 32 END, 6) + 0.0 AS dewpoint_f,
  CASE WHEN i % 8 <> 0 AND i % 400 <= 360 THEN i % 400 END AS wind_dir_degrees, CASE WHEN i % 230 <= 200 THEN i % 230 END AS wind_speed_kt, CASE WHEN i % 3 = 0 AND i % 300 <= 250 THEN i % 300 END AS wind_gust_kt, round(altim * 0.0295299875::DOUBLE, 6) + 0.0 AS altimeter_inhg,
  round({_in("slp", 870, 1084)}, 6) + 0.0 AS sea_level_pressure_mb, CASE i % 5 WHEN 0 THEN 10::DOUBLE WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 0.25::DOUBLE WHEN 3 THEN least(99.99::DOUBLE, CAST(i % 150 AS DOUBLE)) END AS visibility_miles,
  CASE i % 4 WHEN 0 THEN 0::DOUBLE WHEN 1 THEN NULL ELSE round(CAST(precip AS DOUBLE), 6) + 0.0 END AS precip_1hr_inches, CASE i % 3 WHEN 0 THEN 'CLR' WHEN 1 THEN 'OVC' END AS sky_cover_1, CASE WHEN base <= 60000 THEN CAST(base AS BIGINT) END AS sky_base_1_ft, rawOb AS raw_metar,
  CASE WHEN i % 2 = 0 AND i % 400 <= 360 THEN i % 90 END AS peak_wind_gust_kt, CASE WHEN i % 2 = 0 AND i % 400 <= 360 THEN i % 400 END AS peak_wind_dir FROM p"""
)
def awc_observations(spark, d):
    rows = _base(spark, d, _AWC).selectExpr("*", "CAST(floor(unix_micros(ts) / 1000000) AS BIGINT) AS obsTime", "array(named_struct('cover', cover, 'base', base)) AS clouds", "CAST(NULL AS STRING) AS wxString", "CAST(NULL AS INT) AS qcField", "CAST(NULL AS DOUBLE) AS snow")
    return readers.awc_to_observation(rows).select(*_STORAGE, "peak_wind_gust_kt", "peak_wind_dir")


# -- climatology

_GHCNH = {
    "station": "'USW00094728'",
    "date": "CASE WHEN i % 13 = 0 THEN 'bad' ELSE replace(stamp, ' ', 'T') || ':00' END",
    "temperature": "CASE WHEN i % 5 = 0 THEN '' ELSE CAST(i % 150 - 80 AS STRING) || '.5' END",
    "temperature_quality_code": "CASE i % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '' ELSE '5' END",
    "temperature_report_type": "CASE WHEN i % 3 = 0 THEN 'FM-16' ELSE 'FM-15' END",
    "wind_speed": "CASE WHEN i % 6 = 0 THEN '' ELSE CAST(i % 50 AS STRING) || '.2' END",
    "wind_speed_quality_code": "CASE WHEN i % 5 = 1 THEN '7' ELSE '0' END",
    "wind_direction": "CAST(i % 380 AS STRING)",
    "sea_level_pressure": "CASE WHEN i % 7 = 0 THEN '' ELSE CAST(900 + i % 200 AS STRING) END",
    "visibility": "CAST(i % 300 AS STRING)",
    "precipitation": "CASE WHEN i % 2 = 0 THEN CAST(i % 40 AS STRING) || '.5' ELSE '' END",
    "rem": "'MET099METAR KNYC ' || CAST(i AS STRING)",
    "pres_wx_mw1": "CASE i % 3 WHEN 0 THEN 'RA' WHEN 1 THEN '61' ELSE 'SN' END",
    "pres_wx_mw1_quality_code": "CASE WHEN i % 4 = 1 THEN '3' ELSE '1' END",
    "pres_wx_mw2": "CASE WHEN i % 5 = 0 THEN 'FG' ELSE '' END",
    "sky_cover_1": "CASE i % 3 WHEN 0 THEN 'OVC:08' WHEN 1 THEN 'xx' ELSE 'FEW:02' END",
    "sky_cover_baseht_1": "CAST(i * 3 % 20000 AS STRING)",
}


@query(
    "WITH "
    + _base_sql(_GHCNH)
    + f""", p AS (SELECT *, CASE WHEN i % 4 <> 1 THEN {_in(_num("temperature"), -90, 60)} END AS t, CASE WHEN i % 5 <> 1 THEN {_num("wind_speed")} / 0.514444::DOUBLE END AS kt, {_in(_num("sea_level_pressure"), 870, 1084)} AS slp, {_num("precipitation")} AS mm,
  concat_ws(' ', CASE WHEN i % 4 <> 1 AND i % 3 <> 1 THEN pres_wx_mw1 END, CASE WHEN i % 5 = 0 THEN 'FG' END) AS wx FROM f WHERE i % 13 <> 0)
SELECT 'NYC' AS station_code, replace(stamp, ' ', 'T') || ':00Z' AS observed_at, CASE WHEN i % 3 = 0 THEN 'SPECI' ELSE 'METAR' END AS observation_type, round(t, 6) + 0.0 AS temp_c, round(t * 9 / 5 + 32, 6) + 0.0 AS temp_f, CASE WHEN i % 380 <= 360 THEN i % 380 END AS wind_dir_degrees,
  CASE WHEN round_even(kt, 0) BETWEEN 0 AND 200 THEN CAST(round_even(kt, 0) AS BIGINT) END AS wind_speed_kt, round(slp, 6) + 0.0 AS sea_level_pressure_mb, round(least((i % 300) / 1.609344::DOUBLE, 99.99::DOUBLE), 6) + 0.0 AS visibility_miles, round(mm / 25.4::DOUBLE, 6) + 0.0 AS precip_1hr_inches,
  nullif(wx, '') AS weather_codes, CASE i % 3 WHEN 0 THEN 'OVC' WHEN 2 THEN 'FEW' END AS sky_cover_1, CASE WHEN round_even((i * 3 % 20000) / 0.3048::DOUBLE, 0) <= 60000 THEN CAST(round_even((i * 3 % 20000) / 0.3048::DOUBLE, 0) AS BIGINT) END AS sky_base_1_ft, 'METAR KNYC ' || CAST(i AS VARCHAR) AS raw_metar
  FROM p WHERE coalesce(t, kt, slp) IS NOT NULL"""
)
def ghcnh_observations(spark, d):
    rows = _base(spark, d, _GHCNH).drop("i", "ts", "stamp")
    names = "station_code observed_at observation_type temp_c temp_f wind_dir_degrees wind_speed_kt sea_level_pressure_mb visibility_miles precip_1hr_inches weather_codes sky_cover_1 sky_base_1_ft raw_metar".split()
    return readers.ghcnh_to_observation(rows, "NYC").select(*names)


# -- daily reports and settlements

_DAILY = {
    "valid": "CASE WHEN i % 17 = 0 THEN '2024-02-30' ELSE '2024-01-' || lpad(CAST(i % 28 + 1 AS STRING), 2, '0') END",
    "high": "CASE i % 5 WHEN 0 THEN 'M' ELSE CAST(i % 230 - 70 AS STRING) || '.5' END",
    "low": "CASE i % 4 WHEN 0 THEN 'M' ELSE CAST(i % 200 - 90 AS STRING) END",
    "product": "CASE WHEN i % 6 = 0 THEN 'none' ELSE '202401' || lpad(CAST((i + i % 3) % 28 + 1 AS STRING), 2, '0') || lpad(CAST(i % 24 AS STRING), 2, '0') || '30-KOKX-' || CAST(i AS STRING) END",
}
_DAILY_SQL = f"""o AS (SELECT o_orderkey AS i FROM orders), f AS (SELECT i, {", ".join(f"{e} AS {n}" for n, e in _DAILY.items())} FROM o),
g AS (SELECT *, CASE WHEN i % 5 <> 0 THEN {_in(f"round_even({_num('high')}, 0)", -60, 150)} END AS hi, {_in(_num("low"), -80, 130)} AS lo, CAST(i % 28 + 1 AS BIGINT) AS day, CASE WHEN i % 6 <> 0 THEN CAST((i + i % 3) % 28 + 1 AS BIGINT) END AS pday FROM f WHERE i % 17 <> 0),
k AS (SELECT *, CASE WHEN pday IS NULL OR pday <= day THEN 'preliminary' WHEN pday = day + 1 AND i % 24 BETWEEN 4 AND 10 THEN 'final' ELSE 'correction' END AS report_type, CASE WHEN pday IS NOT NULL THEN make_timestamp(2024, 1, pday, i % 24, 30, 0) END AS issued FROM g WHERE hi IS NOT NULL OR lo IS NOT NULL)"""


def _daily(spark, d):
    rows = _read(spark, d, "orders").selectExpr("o_orderkey AS i").selectExpr(*[f"{x} AS {n}" for n, x in _DAILY.items()])
    return readers.cli_to_climate(rows, "NYC")


@query(f"WITH {_DAILY_SQL} SELECT 'NYC' AS station_code, valid AS observation_date, CAST(hi AS BIGINT) AS high_temp_f, CAST(lo AS BIGINT) AS low_temp_f, report_type, CASE report_type WHEN 'final' THEN 3.0::DOUBLE WHEN 'correction' THEN 2.0 ELSE 1.0 END AS report_type_priority, product AS product_id, strftime(issued, '%Y-%m-%dT%H:%M:%SZ') AS issued_at FROM k")
def cli_reports(spark, d):
    return _daily(spark, d).drop("source")


@query(
    f"""WITH {_DAILY_SQL} SELECT 'NYC' AS station, CAST(valid AS DATE) AS settlement_date, CAST(valid AS TIMESTAMP) + INTERVAL 5 HOURS AS event_time, CAST(hi AS BIGINT) AS high_temp_f, CAST(lo AS BIGINT) AS low_temp_f, report_type, CASE report_type WHEN 'preliminary' THEN 'provisional' ELSE 'final' END AS finality, product AS product_id, issued AS knowledge_time FROM k
QUALIFY row_number() OVER (PARTITION BY valid ORDER BY CASE report_type WHEN 'final' THEN 3 WHEN 'correction' THEN 2 ELSE 1 END DESC, hi NULLS LAST, lo NULLS LAST, report_type, product) = 1"""
)
def settlement_reports(spark, d):
    return readers.settlement_rows(_daily(spark, d), "America/New_York").select("station", "settlement_date", "event_time", "high_temp_f", "low_temp_f", "report_type", "finality", "product_id", "knowledge_time")


# -- forecasts

_MOS = {
    "station": "'KNYC'",
    "model": "CASE WHEN i % 2 = 0 THEN 'nbe' ELSE 'Gfs' END",
    "runtime": "CASE WHEN i % 9 = 0 THEN 'x' ELSE stamp END",
    "ftime": "CASE WHEN i % 10 = 0 THEN '' ELSE '2024-02-0' || CAST(i % 9 + 1 AS STRING) || 'T12:30' END",
    "tmp": "CASE WHEN i % 4 = 0 THEN 'M' ELSE CAST(i % 110 AS STRING) END",
    "dpt": "CAST(i % 70 AS STRING)",
    "wsp": "CAST(i % 40 AS STRING)",
    "wdr": "CAST(i % 360 AS STRING)",
    "pop12": "CASE WHEN i % 3 = 0 THEN 'M' ELSE CAST(i % 101 AS STRING) END",
}


@query(
    "WITH "
    + _base_sql(_MOS)
    + """, p AS (SELECT *, date_trunc('minute', ts) AS issued, strptime(replace(ftime, 'T', ' '), '%Y-%m-%d %H:%M') AS v FROM f WHERE i % 9 <> 0 AND i % 10 <> 0)
SELECT station, upper(model) AS model, issued AS issued_at, v AS valid_at, CAST(round_even((epoch(v) - epoch(issued)) / 3600, 0) AS BIGINT) AS forecast_hour, CASE WHEN i % 4 <> 0 THEN round((i % 110 - 32) * 5 / 9::DOUBLE, 6) + 0.0 END AS temp_c, round((i % 70 - 32) * 5 / 9::DOUBLE, 6) + 0.0 AS dew_point_c,
  round((i % 40) * 0.5144444::DOUBLE, 6) + 0.0 AS wind_speed_ms, i % 360 AS wind_dir_deg, CASE WHEN i % 3 <> 0 THEN round((i % 101) / 100::DOUBLE, 6) + 0.0 END AS pop, 'iem.archive' AS source FROM p"""
)
def mos_forecasts(spark, d):
    return readers.mos_rows(_base(spark, d, _MOS))


_SIX = "date_trunc('day', {0}) + to_hours(CAST(hour({0}) // 6 * 6 AS BIGINT))"


@query(
    f"""WITH e AS (SELECT event_id AS i, ts AS valid_at, value AS v FROM events),
r AS (SELECT *, 'open_meteo.single_runs' AS source, TIMESTAMP '2024-01-01 06:00:00' AS issued_at FROM e UNION ALL SELECT *, 'open_meteo.previous_runs', {_SIX.format("(valid_at - INTERVAL 48 HOURS)")} FROM e
  UNION ALL SELECT *, 'open_meteo.live', TIMESTAMP '2024-01-20 00:00:00' FROM e UNION ALL SELECT *, 'open_meteo.seamless', NULL FROM e)
SELECT CAST(i AS VARCHAR) AS station, 'gfs_global' AS model, issued_at, valid_at, coalesce(CAST(round_even((floor(epoch(valid_at)) - epoch(issued_at)) / 3600, 0) AS BIGINT), 0) AS forecast_hour, round(v, 6) + 0.0 AS temp_c, round(v / 5 / 100, 6) + 0.0 AS pop, source FROM r"""
)
def point_forecasts(spark, d):
    e = _read(spark, d, "events").select(F.col("event_id").cast("string").alias("station"), F.col("ts").cast("timestamp").alias("valid_at"), F.col("value").alias("temperature_2m"), (F.col("value") / 5).alias("precipitation_probability"))
    at = lambda *x: F.lit(datetime(*x, tzinfo=UTC))
    found = merge.union_sources(
        readers.point_forecast_rows(e, "gfs_global", "single_runs", run=at(2024, 1, 1, 6)),
        readers.point_forecast_rows(e, "gfs_global", "previous_runs", days=2),
        readers.point_forecast_rows(e, "gfs_global", "live", now=at(2024, 1, 20, 9)),
        readers.point_forecast_rows(e, "gfs_global", "seamless"),
    )
    return found.drop("dew_point_c", "wind_speed_ms")


@query("SELECT CAST(event_id AS DOUBLE) AS record_no, CASE event_id % 3 WHEN 0 THEN 'TMP' ELSE 'UGRD' END AS variable FROM events WHERE event_id % 3 < 2")
def wanted_records(spark, d):
    i = F.col("event_id")
    name = F.when(i % 3 == 0, "TMP").when(i % 3 == 1, "UGRD").otherwise("HGT")
    lines = _read(spark, d, "events").select((F.col("user_id") % 4).cast("string").alias("file"), F.concat_ws(":", i.cast("string"), (i * 100).cast("string"), F.lit("d=2024010100"), name, F.when(i % 3 == 0, "2 m above ground").otherwise("10 m above ground"), F.lit("anl")).alias("value"))
    wanted = [models.variables("hrrr")[c] for c in ("temp_k_2m", "wind_u_ms_10m")]
    return readers.wanted_records(readers.index_records(lines), wanted).select("record_no", "variable")


_NWP_FAMILY = {
    "gefs": "CASE WHEN t <= 0 OR t >= 400 THEN 2 WHEN t < 180 OR t > 340 THEN 1 ELSE 0 END",
    "ecmwf_ifs_hres": "greatest(CASE WHEN t <= 0 OR t >= 400 THEN 2 WHEN t < 180 OR t > 340 THEN 1 ELSE 0 END, CASE WHEN p < 0 THEN 2 WHEN p > 0.305 THEN 1 ELSE 0 END)",
    "hafs": "greatest(CASE WHEN t <= 0 OR t >= 400 THEN 2 WHEN t < 180 OR t > 340 THEN 1 ELSE 0 END, CASE WHEN lat < 0 OR lat > 60 THEN 2 ELSE 0 END)",
}


@query("WITH g AS (SELECT event_id AS seq, value AS t, (event_id % 50)::DOUBLE / 100 - 0.02::DOUBLE AS p, (event_id % 80)::DOUBLE - 5 AS lat FROM events) " + " UNION ALL ".join(f"SELECT seq, '{m}' AS model, CASE {x} WHEN 2 THEN 'suspect' WHEN 1 THEN 'flagged' ELSE 'clean' END AS qc_status FROM g" for m, x in _NWP_FAMILY.items()))
def nwp_families(spark, d):
    i = F.col("event_id")
    g = _read(spark, d, "events").select(i.alias("seq"), F.col("value").alias("temp_k_2m"), ((i % 50).cast("double") / 100 - 0.02).alias("precip_m_total"), ((i % 80).cast("double") - 5).alias("storm_lat_deg"))
    return merge.union_sources(*[qc.nwp_verdict(g, m).select("seq", F.lit(m).alias("model"), "qc_status") for m in _NWP_FAMILY])


# -- days

_EXTREMES_SQL = f"""{MERGED_SQL}, loc AS (SELECT *, CAST(observed_at + to_seconds(lst) AS DATE) AS local_date FROM merged JOIN {OFFSETS_SQL} USING (station_code) WHERE source = 'iem'),
e AS (SELECT station_code AS station, local_date, min(temp_c) AS lo, max(temp_c) AS hi, avg(temp_c) AS mean, sum(precip_1hr_inches) AS p, count(temp_c) AS n_obs FROM loc GROUP BY ALL)"""


@query(
    f"""WITH {_EXTREMES_SQL} SELECT station, local_date, CASE WHEN n_obs >= 12 THEN round(lo, 0) + 0.0 END AS tmin_c, CASE WHEN n_obs >= 12 THEN round(hi, 0) + 0.0 END AS tmax_c, CASE WHEN n_obs >= 12 THEN round(mean, 0) + 0.0 END AS tmean_c, round(coalesce(p, 0), 4) + 0.0 AS precip_inches, n_obs,
  CASE WHEN n_obs >= 12 THEN 'iem' END AS source_tmin, CASE WHEN n_obs >= 12 THEN 'iem' END AS source_tmax, 'iem_only' AS merge_policy FROM e"""
)
def extremes_abroad(spark, d):
    return extremes.daily_extremes(_local(spark, d).withColumn("is_us", F.lit(False)), merge="iem_only")


_UP = "CASE WHEN n_obs >= 12 THEN floor(({0} * 9 / 5 + 32) * {1} + 0.5) / {1}::DOUBLE END"


@query(f"WITH {_EXTREMES_SQL} SELECT local_date AS date, station, {_UP.format('lo', 1)} AS tmin_f, {_UP.format('hi', 1)} AS tmax_f, {_UP.format('mean', 1)} AS tmean_f, floor(p * 100 + 0.5) / 100::DOUBLE AS precip_in, n_obs < 12 AS low_coverage, n_obs FROM e")
def extremes_fahrenheit(spark, d):
    return extremes.daily_extremes_f(_local(spark, d), merge="iem_only")


@query(f"WITH {MERGED_SQL} SELECT seq, station_code, observed_at, source, CAST(observed_at + to_seconds(lst) AS DATE) AS date FROM merged JOIN {OFFSETS_SQL} USING (station_code) WHERE station_code IN ('NYC', 'LAX')")
def obs_raw(spark, d):
    return plan.obs_rows(["NYC", "KLAX"], date(2023, 12, 30), date(2024, 1, 31), obs=_obs(spark, d)).select("seq", "station_code", "observed_at", "source", "date")


@query(
    f"""WITH {DAILY_SQL}, {CLI_SQL}, {_DAYS_SQL}, {_CLI_BEST}, frame AS (SELECT * FROM spine LEFT JOIN daily USING (station_code, date) LEFT JOIN best USING (station_code, date)),
m AS (SELECT o_orderkey AS k, CASE o_custkey % 5 WHEN 0 THEN 'NYC' WHEN 1 THEN 'MDW' WHEN 2 THEN 'DEN' WHEN 3 THEN 'LAX' ELSE 'PHX' END AS station_code, CAST(DATE '2024-01-01' + CAST(o_orderkey % 40 AS INTEGER) AS DATE) AS date, o_orderkey % 2 = 0 AS high, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 90 AS DOUBLE) END AS lo, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 90 + 30 AS DOUBLE) END AS hi, CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END AS res FROM orders),
j AS (SELECT m.*, frame.* EXCLUDE (station_code, date), CASE WHEN high THEN high_temp_f ELSE low_temp_f END AS cli, CASE WHEN high THEN obs_high_f ELSE obs_low_f END AS seen FROM m LEFT JOIN frame USING (station_code, date))
SELECT station_code, date AS observation_date, CAST(high_temp_f AS BIGINT) AS cli_high_temp_f, CAST(low_temp_f AS BIGINT) AS cli_low_temp_f, {", ".join(f"round({a}, 6) + 0.0 AS {b}" for a, b in (("obs_high_f", "metar_high_temp_f"), ("obs_low_f", "metar_low_temp_f")))}, coalesce(obs_count, 0) AS metar_count, 'KX-' || CAST(k AS VARCHAR) AS market_ticker, 'KX' AS series_ticker, CASE WHEN high THEN 'HIGH_TEMP' ELSE 'LOW_TEMP' END AS measure_type,
  lo AS floor_strike, hi AS cap_strike, res AS market_result, CASE WHEN cli IS NOT NULL AND res <> '' THEN (coalesce(cli >= lo, true) AND coalesce(cli < hi, true)) = (res = 'yes') END AS settlement_consistent, round(cli - seen, 6) + 0.0 AS cli_metar_delta_f, coalesce(report_type, '') <> 'final' AS unconfirmed FROM j"""
)
def market_join(spark, d):
    frame = plan.research(list(CODES), date(2023, 12, 30), date(2024, 1, 31), obs=_obs(spark, d), climate=_cli_plain(spark, d)).frame
    k = F.col("o_orderkey")
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("o_custkey") % 5 + 1).cast("int"))
    listed = _read(spark, d, "orders").select(
        F.concat(F.lit("KX-"), k.cast("string")).alias("ticker"),
        F.lit("KX").alias("series_ticker"),
        code.alias("station"),
        F.date_add(F.lit(date(2024, 1, 1)), (k % 40).cast("int")).alias("date"),
        F.when(k % 2 == 0, "HIGH_TEMP").otherwise("LOW_TEMP").alias("measure_type"),
        F.when(k % 5 > 0, (k % 90).cast("double")).alias("floor_strike"),
        F.when(k % 7 > 0, (k % 90 + 30).cast("double")).alias("cap_strike"),
        F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").otherwise("").alias("market_result"),
    )
    return markets.market_join(frame, listed)


@query(
    """SELECT event_id, CASE WHEN icao = 'KMDW' THEN 'fahrenheit' ELSE 'celsius' END AS unit, CASE WHEN icao = 'KMDW' THEN floor(c * 9 / 5 + 32 + 0.5)::DOUBLE ELSE round(c, 6) + 0.0 END AS resolved_value,
  abs(CASE WHEN icao = 'KMDW' THEN floor(c * 9 / 5 + 32 + 0.5) ELSE c END - pub) > CASE WHEN icao = 'KMDW' THEN 1.0 ELSE 0.6 END AS alert
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'KMDW' ELSE 'LFPG' END AS icao, CASE WHEN event_id % 4 > 0 THEN (event_id % 70)::DOUBLE / 2 END AS c, (event_id % 90)::DOUBLE AS pub FROM events)"""
)
def settlement_units(spark, d):
    i = F.col("event_id")
    rows = _read(spark, d, "events").select("event_id", F.when(i % 3 == 0, "KMDW").otherwise("LFPG").alias("icao"), F.when(i % 4 > 0, (i % 70).cast("double") / 2).alias("observed_value_c"), (i % 90).cast("double").alias("published_value"))
    out = markets.with_unit(rows, REGISTRY.table(spark))
    off = F.when(F.col("resolved_value").isNotNull(), F.col("data_quality_alert").isNotNull())
    return out.select("event_id", "unit", "resolved_value", off.alias("alert"))


@query(f"WITH {_EV_SQL} SELECT event_id, CASE WHEN {_EVENT_STATUS} <> 'deferred' THEN {_MEASURE} END AS measure, CASE WHEN {_EVENT_STATUS} <> 'deferred' THEN {_ICAO} END AS icao, {_EVENT_STATUS} AS status FROM ev WHERE {_EVENT_STATUS} <> 'unknown_city'")
def event_listing(spark, d):
    return markets.discover_events(_events(spark, d), _cities(spark)).select("event_id", "measure", "icao", "status")


# -- markets' payloads


@query("SELECT event_id AS seq, 't' || CAST(event_id AS VARCHAR) AS trade_id, TIMESTAMP '2024-01-05 10:00:00' + to_seconds(event_id % 3600) AS ts, CASE WHEN event_id % 2 = 0 THEN round((event_id % 100) / 100::DOUBLE * 100, 6) + 0.0 ELSE (event_id % 90)::DOUBLE END AS price, CASE WHEN event_id % 2 = 0 THEN event_id % 500 ELSE 3 END AS count, 'yes' AS taker_side, 'kalshi' AS source FROM events")
def fills(spark, d):
    i = F.col("event_id")
    made = F.date_format(F.lit(datetime(2024, 1, 5, 10, tzinfo=UTC)).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (i % 3600).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    new = F.format_string('{"trade_id": "t%d", "created_time": "%s", "yes_price_dollars": "0.%02d", "yes_price": 1, "count_fp": "%d.00", "taker_side": "yes"}', i, made, i % 100, i % 500)
    old = F.format_string('{"trade_id": "t%d", "created_time": "%s", "yes_price": %d, "count": 3, "taker_side": "yes"}', i, made, i % 90)
    return markets.fills(_read(spark, d, "events").select(i.alias("seq"), F.when(i % 2 == 0, new).otherwise(old).alias("payload")))


@query("SELECT event_id AS seq, to_timestamp(event_id + k)::TIMESTAMP AS ts, k / 4::DOUBLE AS price, 'polymarket' AS source FROM events, (VALUES (1), (3)) t(k)")
def price_history(spark, d):
    i = F.col("event_id")
    payload = F.format_string('{"history": [{"t": %d, "p": 0.25}, {"p": 0.5}, {"t": %d, "p": 0.75}]}', i + 1, i + 3)
    return markets.price_history(_read(spark, d, "events").select(i.alias("seq"), payload.alias("payload")))


# -- store, formats, rows in memory


@query(f"WITH {OBS_SQL} SELECT station_code, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS observed_at, seq, round(temp_f, 6) + 0.0 AS temp_f FROM obs WHERE station_code IN ('NYC', 'DEN') AND date_trunc('second', ts) >= TIMESTAMP '2024-01-10' AND date_trunc('second', ts) < TIMESTAMP '2024-01-20'")
def store_scan(spark, d):
    store = Store(spark, _shared(spark, "store"))
    rows = _obs(spark, d).select("station_code", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at"), "seq", "temp_f")
    store.write("observations", rows, now=datetime(2024, 3, 15, tzinfo=UTC))
    found = store.read("observations", start=datetime(2024, 1, 10, tzinfo=UTC), stop=datetime(2024, 1, 20, tzinfo=UTC), station_code=["NYC", "DEN"])
    return found.select("station_code", "observed_at", "seq", "temp_f")


@query("SELECT kind, o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority || ',\"' END AS t FROM orders, (VALUES ('parquet'), ('csv'), ('json')) v(kind)")
def format_round_trip(spark, d):
    rows = _read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.when(F.col("o_orderkey") % 3 > 0, F.concat("o_orderpriority", F.lit(',"'))).alias("t"))
    found = []
    for kind in ("parquet", "csv", "json"):
        path = _shared(spark, f"format-{kind}")
        formats.write(rows, path, kind)
        found.append(spark.read.schema(rows.schema).options(**({"header": "true", "escape": '"'} if kind == "csv" else {})).format(kind).load(path).withColumn("kind", F.lit(kind)))
    return merge.union_sources(*found)


@query("SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 4::DOUBLE END AS x FROM nation")
def text_table(spark, d):
    rows = _read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") / F.lit(4.0)).alias("x"))
    read = formats.toon_loads(formats.toon_dumps(rows))
    return spark.createDataFrame([(r["k"], r["name"], None if r["x"] is None else float(r["x"])) for r in read], "k bigint, name string, x double")


@query("SELECT * FROM (VALUES ('NYC', TIMESTAMP '2024-01-05 12:51:00', 1.5::DOUBLE, 5.144444::DOUBLE, 1609.344::DOUBLE, 'CLR', TIMESTAMP '2024-01-05 13:06:00', 'iem.archive'), ('LAX', TIMESTAMP '2024-01-06 00:00:00', NULL, NULL, NULL, NULL, TIMESTAMP '2024-01-06 00:15:00', 'iem.archive')) t(station, event_time, temp_c, wind_speed_ms, visibility_m, sky_cover_1, knowledge_time, source)")
def rows_in_memory(spark, d):
    rows = [{"station_code": "NYC", "observed_at": "2024-01-05T12:51:00Z", "temp_c": 1.5, "wind_speed_kt": 10, "visibility_miles": 1, "sky_cover_1": "SKC", "other": 1}, {"station_code": "LAX", "observed_at": "2024-01-06T00:00:00Z"}]
    return readers.from_rows(spark, rows, "iem.archive", datetime(2024, 1, 7, tzinfo=UTC)).select("station", "event_time", "temp_c", "wind_speed_ms", "visibility_m", "sky_cover_1", "knowledge_time", "source")


@query("SELECT * FROM (VALUES ('NYC', DATE '2024-07-04', TIMESTAMP '2024-07-04 04:00:00', 91::BIGINT, 'final', 'final', TIMESTAMP '2024-07-05 06:30:00'), ('NYC', DATE '2024-07-05', TIMESTAMP '2024-07-05 04:00:00', NULL, 'estimated', 'provisional', NULL)) t(station, settlement_date, event_time, high_temp_f, report_type, finality, knowledge_time)")
def records_in_memory(spark, d):
    records = [
        {"station_code": "NYC", "observation_date": "2024-07-04", "high_temp_f": 90, "report_type": "preliminary", "product_id": "202407042130-KOKX"},
        {"station_code": "NYC", "observation_date": "2024-07-04", "high_temp_f": 91, "report_type": "final", "product_id": "202407050630-KOKX"},
        {"station_code": "NYC", "observation_date": "2024-07-05", "report_type": "estimated"},
        {"station_code": None, "observation_date": "2024-07-06", "report_type": "final"},
    ]
    return readers.from_records(spark, records, "America/New_York", datetime(2024, 7, 8, tzinfo=UTC)).select("station", "settlement_date", "event_time", "high_temp_f", "report_type", "finality", "knowledge_time")


# -- versions, registries, identifiers, live rows


@query(f"""WITH {OBS_SQL}, h AS (SELECT ('0x' || substr(sha256('{{"station_code":"' || station_code || '","seq":' || CAST(seq AS VARCHAR) || ',"wind_gust_kt":' || coalesce(CAST(wind_gust_kt AS VARCHAR), 'null') || '}}'), 1, 12))::BIGINT AS n FROM obs)
SELECT substr(sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(n) AS VARCHAR)), 1, 16) AS version FROM h""")
def content_version(spark, d):
    return spark.createDataFrame([(aggregates.content_hash(_obs(spark, d), ["station_code", "seq", "wind_gust_kt"]),)], "version string")


#: Standard time of the zones in seconds from UTC.
_STANDARD = {"America/New_York": -18000, "America/Chicago": -21600, "America/Denver": -25200, "America/Phoenix": -25200, "America/Los_Angeles": -28800}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', 'K{c}', '{z}', {_STANDARD[z]}::BIGINT)" for c, (z, _, _) in _US.items()) + ") t(code, icao, tz, lst_offset_seconds)")
def us_stations(spark, d):
    return REGISTRY.table(spark).filter("country = 'US'").select("code", "icao", "tz", "lst_offset_seconds")


@query("SELECT * FROM (VALUES ('paris', 'LFPG,LFPB'), ('NYC', 'KNYC,KLGA,KEWR,KJFK'), ('nyc', 'KNYC,KLGA,KEWR,KJFK'), ('chicago', 'KMDW,KORD'), ('tokyo_narita', 'RJAA')) t(city, stations)")
def city_station_lists(spark, d):
    return spark.createDataFrame([(c, ",".join(city_stations(c))) for c in ("paris", "NYC", "nyc", "chicago", "tokyo_narita")], "city string, stations string")


@query("SELECT * FROM (VALUES ('KLGA', 'America/New_York'), ('KBOI', 'America/Boise'), ('PHNL', NULL), ('KHNL', 'Pacific/Honolulu'), ('EGLL', 'Europe/London')) t(icao, tz)")
def station_zones(spark, d):
    asked = spark.createDataFrame([(i,) for i in ("KLGA", "KBOI", "PHNL", "KHNL", "EGLL")], "icao string")
    return asked.join(F.broadcast(zones(spark)), "icao", "left")


@query("SELECT * FROM (VALUES ('hrrr', 'aws_bdp,nomads', 'TMP', 'MSLMA', 9::BIGINT), ('cfs', 'aws_bdp,nomads', 'TMP', 'PRMSL', 4), ('ecmwf_aifs_ens', 'ecmwf_gcp,ecmwf_aws,ecmwf_data_portal,ecmwf_azure', '2t', 'msl', 6), ('hrdps', 'msc', 'TMP', 'PRMSL', 9)) t(model, mirrors, temperature, pressure, variables)")
def model_places(spark, d):
    rows = [(m, ",".join(models.mirrors(m)), v["temp_k_2m"][0], v["pressure_pa_mslp"][0], len(v)) for m in ("hrrr", "cfs", "ecmwf_aifs_ens", "hrdps") for v in [models.variables(m)]]
    return spark.createDataFrame(rows, "model string, mirrors string, temperature string, pressure string, variables bigint")


_NAMES = {0: "KXHIGHNY-25MAY26-T79", 1: "..", 2: "kalshi", 3: "a/b", 4: "NYC", 5: "x" * 40, 6: "Poly", 7: ""}


@query("SELECT event_id AS seq, event_id % 8 = 2 AS issuer, event_id % 8 IN (0, 2, 4, 5, 6) AS ticker, event_id % 8 = 4 AS station, event_id % 8 IN (0, 4) AS feed_id FROM events")
def identifiers(spark, d):
    i = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(x) for x in _NAMES.values()]), (i % 8 + 1).cast("int"))
    rows = _read(spark, d, "events").select(i.alias("seq"), name.alias("name"))
    return rows.select("seq", parsing.valid_issuer("name").alias("issuer"), parsing.valid_ticker("name").alias("ticker"), parsing.valid_station_code("name").alias("station"), parsing.valid_feed_station_id("name").alias("feed_id"))


@query(f"WITH {OBS_SQL} SELECT seq, 'awc.live' AS source FROM obs")
def live_tags(spark, d):
    return live.tagged(_obs(spark, d), "awc").select("seq", "source")


@query("SELECT * FROM (VALUES (0::BIGINT, 'station', 'string', false), (1, 'settlement_date', 'date', false), (2, 'event_time', 'timestamp_utc', false), (3, 'high_temp_f', 'int64', true), (4, 'low_temp_f', 'int64', true), (5, 'report_type', 'enum', true), (6, 'finality', 'enum', true), (7, 'quality', 'string', true), (8, 'product_id', 'string', true), (9, 'product_release_time', 'timestamp_utc', true), (10, 'knowledge_time', 'timestamp_utc', true), (11, 'source', 'string', true)) t(position, name, kind, nullable)")
def schema_columns(spark, d):
    return discovery.describe(spark, "schema.settlement.cli.v1").select("position", "name", "kind", "nullable")
