"""Every operator as a query over the driver's tables, and the SQL that says the same.

There are no weather tables here, so operators run on projections of ``events`` and ``orders`` that are the same
expressions in both languages: OBS, CLI and FCST below.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import parsing as P
from .functions import temporal as T
from .functions import units as U
from .functions import weather as W
from .operators import aggregates, asof, extremes, grid, markets, merge, qc, transforms, validate
from .plans import discovery
from .plans import pairs as plan
from .schemas import ColumnSpec, Schema
from .sources import readers
from .stations import REGISTRY, Registry, zones
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CODES = ("NYC", "MDW", "DEN", "LAX", "PHX")
#: All settlement days of the tables, and one more on either side.
FIRST, LAST = date(2023, 12, 30), date(2024, 1, 31)
AS_OF = T.TimePoint(datetime(2024, 1, 15, 12, tzinfo=UTC))

OFFSETS_SQL = "(VALUES ('NYC', -18000), ('MDW', -21600), ('DEN', -25200), ('LAX', -28800), ('PHX', -25200)) AS dim(station_code, lst)"
OBS_SQL = """obs AS (
  SELECT event_id AS seq, CASE user_id % 5 WHEN 0 THEN 'NYC' WHEN 1 THEN 'MDW' WHEN 2 THEN 'DEN' WHEN 3 THEN 'LAX' ELSE 'PHX' END AS station_code,
         date_trunc('hour', ts) AS observed_at, ts, CASE WHEN event_type = 'error' THEN 'SPECI' ELSE 'METAR' END AS observation_type,
         CASE event_id % 3 WHEN 0 THEN 'awc' WHEN 1 THEN 'iem' ELSE 'ghcnh' END AS source,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 1.3::DOUBLE END AS temp_f, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 10 END AS temp_c,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 3 END AS dewpoint_f, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 8 END AS dewpoint_c,
         CAST(event_id % 60 AS INTEGER) AS wind_speed_kt, CASE WHEN event_id % 11 = 0 THEN CAST(event_id % 90 AS INTEGER) END AS wind_gust_kt,
         CASE WHEN event_id % 4 = 0 THEN value / 700 END AS precip_1hr_inches, CAST(event_id % 400 AS INTEGER) AS wind_dir_degrees, 860 + value / 2 AS sea_level_pressure_mb
  FROM events)"""
MERGED_SQL = OBS_SQL + """, merged AS (
  SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY station_code, observed_at, observation_type ORDER BY CASE source WHEN 'awc' THEN 3 WHEN 'iem' THEN 2 WHEN 'ghcnh' THEN 1 ELSE 0 END DESC, source, seq) = 1)"""
#: As MERGED_SQL, of the columns that daily aggregates need: ties are broken by these.
DAILY_SQL = OBS_SQL + """, merged AS (
  SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY station_code, observed_at, observation_type ORDER BY CASE source WHEN 'awc' THEN 3 WHEN 'iem' THEN 2 WHEN 'ghcnh' THEN 1 ELSE 0 END DESC, source,
    temp_f NULLS LAST, dewpoint_f NULLS LAST, wind_speed_kt NULLS LAST, wind_gust_kt NULLS LAST, precip_1hr_inches NULLS LAST) = 1)"""
CLI_SQL = """cli AS (
  SELECT o_orderkey AS seq, CASE o_custkey % 5 WHEN 0 THEN 'NYC' WHEN 1 THEN 'MDW' WHEN 2 THEN 'DEN' WHEN 3 THEN 'LAX' ELSE 'PHX' END AS station_code,
         CAST(DATE '2024-01-01' + CAST(o_orderkey % 28 AS INTEGER) AS DATE) AS observation_date,
         CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN 'final' WHEN 1 THEN 'correction' WHEN 2 THEN 'preliminary' ELSE 'estimated' END AS report_type,
         CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 2.0 WHEN 2 THEN 1.0 ELSE 0.0 END AS report_type_priority,
         CAST(40 + o_orderkey % 60 AS INTEGER) AS high_temp_f, CAST(o_orderkey % 40 AS INTEGER) AS low_temp_f
  FROM orders)"""
FCST_SQL = """fcst AS (
  SELECT event_id AS seq, CASE user_id % 5 WHEN 0 THEN 'NYC' WHEN 1 THEN 'MDW' WHEN 2 THEN 'DEN' WHEN 3 THEN 'LAX' ELSE 'PHX' END AS station_code,
         CASE WHEN event_id % 6 = 0 THEN NULL ELSE date_trunc('day', ts) - to_hours(CAST(6 * (event_id % 9) AS BIGINT)) END AS issued_at, ts AS valid_at,
         CASE WHEN event_id % 10 = 3 THEN NULL WHEN event_id % 6 = 0 THEN 'ser' WHEN event_id % 2 = 0 THEN 'GFS' ELSE 'NBE' END AS model,
         CASE WHEN event_id % 8 = 0 THEN NULL ELSE value / 4 END AS temperature_f, value / 9 AS temperature_c, value / 5 AS pop_6hr_pct, value / 100 AS qpf_6hr_in, value / 6 AS precipitation_probability_pct
  FROM events)"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _station(c: str):
    out = F.lit(CODES[4])
    for k in range(3, -1, -1):
        out = F.when(F.col(c) % 5 == k, F.lit(CODES[k])).otherwise(out)
    return out


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    i, v = F.col("event_id"), F.col("value")
    return e.select(
        i.alias("seq"),
        _station("user_id").alias("station_code"),
        F.date_trunc("hour", "ts").alias("observed_at"),
        "ts",
        F.when(F.col("event_type") == "error", "SPECI").otherwise("METAR").alias("observation_type"),
        F.when(i % 3 == 0, "awc").when(i % 3 == 1, "iem").otherwise("ghcnh").alias("source"),
        F.when(i % 7 != 0, v / 1.3).alias("temp_f"),
        F.when(i % 7 != 0, v / 10).alias("temp_c"),
        F.when(i % 5 != 0, v / 3).alias("dewpoint_f"),
        F.when(i % 5 != 0, v / 8).alias("dewpoint_c"),
        (i % 60).cast("int").alias("wind_speed_kt"),
        F.when(i % 11 == 0, (i % 90).cast("int")).alias("wind_gust_kt"),
        F.when(i % 4 == 0, v / 700).alias("precip_1hr_inches"),
        (i % 400).cast("int").alias("wind_dir_degrees"),
        (860 + v / 2).alias("sea_level_pressure_mb"),
    )


def _cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "final").when(k % 4 == 1, "correction").when(k % 4 == 2, "preliminary").otherwise("estimated")
    return o.select(
        k.alias("seq"),
        _station("o_custkey").alias("station_code"),
        F.date_add(F.lit(date(2024, 1, 1)), (k % 28).cast("int")).alias("observation_date"),
        kind.alias("report_type"),
        merge.priority(kind, merge.REPORT_PRIORITY, 0.0).alias("report_type_priority"),
        (40 + k % 60).cast("int").alias("high_temp_f"),
        (k % 40).cast("int").alias("low_temp_f"),
    )


def _fcst(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    i, v = F.col("event_id"), F.col("value")
    return e.select(
        i.alias("seq"),
        _station("user_id").alias("station_code"),
        F.when(i % 6 != 0, F.date_trunc("day", "ts") - T.seconds(i % 9 * 21600)).alias("issued_at"),
        F.col("ts").alias("valid_at"),
        F.when(i % 10 == 3, None).when(i % 6 == 0, "ser").when(i % 2 == 0, "GFS").otherwise("NBE").alias("model"),
        F.when(i % 8 != 0, v / 4).alias("temperature_f"),
        (v / 9).alias("temperature_c"),
        (v / 5).alias("pop_6hr_pct"),
        (v / 100).alias("qpf_6hr_in"),
        (v / 6).alias("precipitation_probability_pct"),
    )


def _dim(spark: SparkSession) -> DataFrame:
    return Registry({c: REGISTRY.get(c) for c in CODES}).table(spark)


def _out(df: DataFrame) -> DataFrame:
    """Edge types: doubles rounded to 6 places, instants without a zone, integers as long."""
    made = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        c = F.round(c, 6) + 0.0 if kind == "double" else c.cast("timestamp_ntz") if kind == "timestamp" else c.cast("bigint") if kind in ("int", "tinyint", "smallint") else c
        made.append(c.alias(f.name))
    return df.select(*made)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: _out(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


# -- merges

_OBS_COLUMNS = "seq, station_code, observed_at, observation_type, source, round(temp_f, 6) + 0.0 AS temp_f"


@query(f"WITH {MERGED_SQL} SELECT {_OBS_COLUMNS} FROM merged")
def merge_observations(spark, d):
    return merge.merge_observations(_obs(spark, d)).select("seq", "station_code", "observed_at", "observation_type", "source", "temp_f")


@query(f"""WITH {OBS_SQL} SELECT {_OBS_COLUMNS} FROM obs
QUALIFY row_number() OVER (PARTITION BY station_code, observed_at ORDER BY CASE source WHEN 'awc' THEN 3 WHEN 'iem' THEN 2 WHEN 'ghcnh' THEN 1 ELSE -1 END DESC, ts, lpad(CAST(seq AS VARCHAR), 12, '0')) = 1""")
def merge_gold(spark, d):
    rows = _obs(spark, d).withColumn("source_received_at", F.col("ts")).withColumn("ingestion_id", F.lpad(F.col("seq").cast("string"), 12, "0"))
    return merge.query_time_merge(rows).select("seq", "station_code", "observed_at", "observation_type", "source", "temp_f")


@query(f"WITH {CLI_SQL} SELECT station_code, observation_date, report_type, CAST(high_temp_f AS BIGINT) AS high_temp_f, CAST(low_temp_f AS BIGINT) AS low_temp_f FROM cli QUALIFY row_number() OVER (PARTITION BY station_code, observation_date ORDER BY report_type_priority DESC, seq) = 1")
def merge_climate(spark, d):
    return merge.merge_climate(_cli(spark, d), "seq").select("station_code", "observation_date", "report_type", "high_temp_f", "low_temp_f")


@query(f"WITH {CLI_SQL} SELECT station_code, observation_date, max(report_type_priority) AS report_type_priority FROM cli GROUP BY ALL")
def dedup_climate_reports(spark, d):
    return merge.dedup_climate_reports(_cli(spark, d)).select("station_code", "observation_date", "report_type_priority")


@query("SELECT o_custkey AS slug, min(o_orderkey) AS seq FROM orders GROUP BY ALL")
def dedup_first_seen(spark, d):
    return merge.dedup_first_seen(_read(spark, d, "orders").select(F.col("o_custkey").alias("slug"), F.col("o_orderkey").alias("seq")), "slug", "seq")


# -- daily plans

_DAYS_SQL = f"""days AS (SELECT m.*, CAST(m.observed_at + to_seconds(lst) AS DATE) AS date FROM merged m JOIN {OFFSETS_SQL} USING (station_code)),
daily AS (SELECT station_code, date, max(temp_f) AS obs_high_f, min(temp_f) AS obs_low_f, avg(temp_f) AS obs_mean_f, avg(dewpoint_f) AS obs_mean_dewpoint_f,
  CAST(max(wind_speed_kt) AS BIGINT) AS obs_max_wind_kt, CAST(max(wind_gust_kt) AS BIGINT) AS obs_max_gust_kt, sum(precip_1hr_inches) AS obs_total_precip_in, count(*) AS obs_count FROM days GROUP BY ALL),
spine AS (SELECT station_code, lst, CAST(d AS DATE) AS date FROM {OFFSETS_SQL}, range(DATE '2023-12-30', DATE '2024-02-01', INTERVAL 1 DAY) t(d))"""
_OBS_OUT = "round(obs_high_f, 6) + 0.0 AS obs_high_f, round(obs_low_f, 6) + 0.0 AS obs_low_f, round(obs_mean_f, 6) + 0.0 AS obs_mean_f, round(obs_mean_dewpoint_f, 6) + 0.0 AS obs_mean_dewpoint_f, obs_max_wind_kt, obs_max_gust_kt, round(obs_total_precip_in, 6) + 0.0 AS obs_total_precip_in, coalesce(obs_count, 0) AS obs_count"
_CLOSE = "CAST(date AS TIMESTAMP) - to_seconds(lst) + INTERVAL '16 hours 30 minutes'"


@query(f"WITH {DAILY_SQL}, {_DAYS_SQL} SELECT date, station_code AS station, {_OBS_OUT} FROM spine LEFT JOIN daily USING (station_code, date)")
def obs_daily(spark, d):
    return plan.obs_daily(list(CODES), FIRST, LAST, obs=_obs(spark, d))


_CLI_BEST = "best AS (SELECT station_code, observation_date AS date, high_temp_f, low_temp_f, report_type FROM cli QUALIFY row_number() OVER (PARTITION BY station_code, observation_date ORDER BY report_type_priority DESC, high_temp_f, low_temp_f, report_type) = 1)"
_NO_FCST = "CAST(NULL AS DOUBLE) AS fcst_high_f, CAST(NULL AS DOUBLE) AS fcst_low_f, CAST(NULL AS VARCHAR) AS fcst_model, CAST(NULL AS TIMESTAMP) AS fcst_issued_at, CAST(NULL AS DOUBLE) AS fcst_pop_6hr_pct, CAST(NULL AS DOUBLE) AS fcst_qpf_6hr_in"
_CLI_OUT = "CAST(high_temp_f AS BIGINT) AS cli_high_f, CAST(low_temp_f AS BIGINT) AS cli_low_f, report_type AS cli_report_type"


def _cli_plain(spark, d):
    return _cli(spark, d).select("station_code", "observation_date", "high_temp_f", "low_temp_f", "report_type", "report_type_priority")


@query(f"WITH {DAILY_SQL}, {CLI_SQL}, {_DAYS_SQL}, {_CLI_BEST} SELECT date, station_code AS station, {_CLI_OUT}, {_OBS_OUT}, {_NO_FCST}, {_CLOSE} AS market_close_utc FROM spine LEFT JOIN daily USING (station_code, date) LEFT JOIN best USING (station_code, date)")
def pairs_flagship(spark, d):
    return plan.research(list(CODES), FIRST, LAST, obs=_obs(spark, d), climate=_cli_plain(spark, d)).frame


_FDAYS = f"""fd AS (SELECT f.*, lst, CAST(valid_at + to_seconds(lst) AS DATE) AS date FROM fcst f JOIN {OFFSETS_SQL} USING (station_code)),
fw AS (SELECT *, {_CLOSE} AS market_close_utc, CAST(date AS TIMESTAMP) - to_seconds(lst) AS win_start, CAST(date AS TIMESTAMP) - to_seconds(lst) + INTERVAL 24 HOURS AS win_end FROM fd),
run AS (SELECT * FROM fw WHERE issued_at <= market_close_utc QUALIFY issued_at = max(issued_at) OVER (PARTITION BY station_code, date)),
ragg AS (SELECT station_code, date, max(temperature_f) FILTER (valid_at BETWEEN win_start AND win_end) AS run_high_f, min(temperature_f) FILTER (valid_at BETWEEN win_start AND win_end) AS run_low_f,
  max(pop_6hr_pct) AS run_pop, sum(qpf_6hr_in) AS run_qpf, arg_min(model, (valid_at, model)) FILTER (model IS NOT NULL) AS run_model, max(issued_at) AS run_issued_at FROM run GROUP BY ALL),
sagg AS (SELECT station_code, date, max(temperature_c * 9 / 5 + 32) AS s_high, min(temperature_c * 9 / 5 + 32) AS s_low, max(precipitation_probability_pct) AS s_pop,
  coalesce(arg_min(model, (valid_at, model)) FILTER (model IS NOT NULL), 'open-meteo') AS s_model FROM fw WHERE issued_at IS NULL GROUP BY ALL)"""


@query(f"WITH {FCST_SQL}, {_FDAYS} SELECT seq, station_code, date, issued_at, valid_at FROM run")
def forecast_asof_run(spark, d):
    return aggregates.best_run(_windows(spark, d), ["station_code", "date"]).select("seq", "station_code", "date", "issued_at", "valid_at")


def _windows(spark, d):
    rows = _fcst(spark, d).join(F.broadcast(_dim(spark).select(F.col("code").alias("station_code"), "lst_offset_seconds")), "station_code")
    lst = F.col("lst_offset_seconds")
    rows = rows.withColumn("date", T.settlement_date("valid_at", lst))
    return rows.withColumns({"market_close_utc": T.market_close("date", lst), "win_start": T.settlement_start("date", lst), "win_end": T.settlement_end("date", lst)})


@query(f"WITH {FCST_SQL}, {_FDAYS} SELECT station_code, date, {_r('run_high_f', 'run_low_f', 'run_pop', 'run_qpf')}, run_model, run_issued_at FROM ragg")
def forecast_run_aggregates(spark, d):
    keys = ["station_code", "date"]
    return aggregates.run_aggregates(aggregates.best_run(_windows(spark, d), keys), keys)


@query(f"WITH {FCST_SQL}, {_FDAYS} SELECT station_code, date, round(s_high, 6) + 0.0 AS series_high_f, round(s_low, 6) + 0.0 AS series_low_f, round(s_pop, 6) + 0.0 AS series_pop, s_model AS series_model FROM sagg")
def forecast_series_aggregates(spark, d):
    return aggregates.series_aggregates(_windows(spark, d).filter("issued_at IS NULL"), ["station_code", "date"])


@query(f"""WITH {DAILY_SQL}, {CLI_SQL}, {FCST_SQL}, {_DAYS_SQL}, {_CLI_BEST}, {_FDAYS}
SELECT date, station_code AS station, {_CLI_OUT}, {_OBS_OUT},
  round(CASE WHEN run_high_f IS NULL AND s_model IS NOT NULL THEN s_high ELSE run_high_f END, 6) + 0.0 AS fcst_high_f, round(CASE WHEN run_high_f IS NULL AND s_model IS NOT NULL THEN s_low ELSE run_low_f END, 6) + 0.0 AS fcst_low_f,
  CASE WHEN run_high_f IS NULL AND s_model IS NOT NULL THEN s_model ELSE run_model END AS fcst_model, run_issued_at AS fcst_issued_at,
  round(CASE WHEN run_high_f IS NULL AND s_model IS NOT NULL THEN s_pop ELSE run_pop END, 6) + 0.0 AS fcst_pop_6hr_pct, round(run_qpf, 6) + 0.0 AS fcst_qpf_6hr_in, {_CLOSE} AS market_close_utc
FROM spine LEFT JOIN daily USING (station_code, date) LEFT JOIN best USING (station_code, date) LEFT JOIN ragg USING (station_code, date) LEFT JOIN sagg USING (station_code, date)""")
def pairs_forecast(spark, d):
    return plan.research(list(CODES), FIRST, LAST, obs=_obs(spark, d), climate=_cli_plain(spark, d), forecasts=_fcst(spark, d)).frame


def _nwp(spark, d):
    f = _windows(spark, d)
    return f.select("station_code", "date", "market_close_utc", F.coalesce("issued_at", "valid_at").alias("cycle"), "valid_at", F.when(F.col("seq") % 2 == 0, "hrrr").otherwise("gfs").alias("model"), (250 + F.col("pop_6hr_pct") / 2).alias("temp_k_2m"))


_NWP_SQL = "nwp AS (SELECT station_code, date, market_close_utc, coalesce(issued_at, valid_at) AS cycle, CASE WHEN seq % 2 = 0 THEN 'hrrr' ELSE 'gfs' END AS model, 250 + pop_6hr_pct / 2 AS k FROM fw)"
_NWP_OUT = ", ".join(f"round({f}((k - 273.15) * 9 / 5 + 32) FILTER (model = '{m}'), 6) + 0.0 AS fcst_{n}_f_nwp_{m}" for m in ("hrrr", "gfs") for f, n in (("max", "high"), ("min", "low")))


@query(f"WITH {FCST_SQL}, {_FDAYS}, {_NWP_SQL} SELECT station_code, date, {_NWP_OUT} FROM nwp GROUP BY ALL")
def nwp_pivot(spark, d):
    return aggregates.nwp_aggregates(_nwp(spark, d), ["station_code", "date"], ["hrrr", "gfs"])


@query(f"WITH {FCST_SQL}, {_FDAYS}, {_NWP_SQL} SELECT station_code, date, {_NWP_OUT} FROM nwp WHERE cycle <= market_close_utc GROUP BY ALL")
def nwp_pivot_asof(spark, d):
    return aggregates.nwp_aggregates(_nwp(spark, d), ["station_code", "date"], ["hrrr", "gfs"], "market_close_utc")


@query(f"""WITH {DAILY_SQL}, {CLI_SQL}, {_DAYS_SQL}, {_CLI_BEST} SELECT date, station_code AS station, round(high_temp_f - obs_high_f, 6) + 0.0 AS cli_metar_delta_f, abs(high_temp_f - obs_high_f) <= 60 AS settlement_consistent
FROM spine LEFT JOIN daily USING (station_code, date) LEFT JOIN best USING (station_code, date)""")
def settlement_consistency(spark, d):
    frame = plan.research(list(CODES), FIRST, LAST, obs=_obs(spark, d), climate=_cli_plain(spark, d)).frame
    return plan.settlement_consistency(frame, 60.0).select("date", "station", "cli_metar_delta_f", "settlement_consistent")


_TZ = "CASE station_code WHEN 'NYC' THEN 'America/New_York' WHEN 'MDW' THEN 'America/Chicago' WHEN 'DEN' THEN 'America/Denver' WHEN 'LAX' THEN 'America/Los_Angeles' ELSE 'America/Phoenix' END"


@query(f"""WITH {MERGED_SQL}, loc AS (SELECT *, CAST(observed_at + to_seconds(lst) AS DATE) AS local_date FROM merged JOIN {OFFSETS_SQL} USING (station_code)),
e AS (SELECT station_code AS station, local_date, min(temp_c) AS lo, max(temp_c) AS hi, avg(temp_c) AS mean, coalesce(sum(precip_1hr_inches), 0) AS p, count(temp_c) AS n_obs,
  arg_min(source, (temp_c, observed_at, source)) FILTER (temp_c IS NOT NULL) AS smin, arg_min(source, (-temp_c, observed_at, source)) FILTER (temp_c IS NOT NULL) AS smax FROM loc GROUP BY ALL)
SELECT station, local_date, CASE WHEN n_obs >= 12 THEN round(lo, 1) + 0.0 END AS tmin_c, CASE WHEN n_obs >= 12 THEN round(hi, 1) + 0.0 END AS tmax_c, CASE WHEN n_obs >= 12 THEN round(mean, 1) + 0.0 END AS tmean_c,
  round(p, 4) + 0.0 AS precip_inches, n_obs, CASE WHEN n_obs >= 12 THEN smin END AS source_tmin, CASE WHEN n_obs >= 12 THEN smax END AS source_tmax, 'live_v1' AS merge_policy FROM e""")
def daily_extremes(spark, d):
    return extremes.daily_extremes(_local(spark, d))


def _local(spark, d):
    dim = _dim(spark).select(F.col("code").alias("station_code"), "tz", F.lit(True).alias("is_us"))
    return merge.merge_observations(_obs(spark, d)).join(F.broadcast(dim), "station_code")


@query(f"""WITH {OBS_SQL}, {CLI_SQL}, seen AS (SELECT station_code, count(*) AS obs_count, max(observed_at) AS latest, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY observed_at, seq) AS seqs FROM obs JOIN {OFFSETS_SQL} USING (station_code)
  WHERE observed_at >= TIMESTAMP '2024-01-14' - to_seconds(lst) AND observed_at < TIMESTAMP '2024-01-15' - to_seconds(lst) AND observed_at <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY ALL),
rep AS (SELECT station_code, max(report_type_priority) AS p FROM cli WHERE observation_date = DATE '2024-01-14' GROUP BY ALL)
SELECT station_code, DATE '2024-01-14' AS settlement_date, coalesce(obs_count, 0) AS obs_count, latest, seqs, CASE WHEN TIMESTAMP '2024-01-15 12:00:00' >= TIMESTAMP '2024-01-15' - to_seconds(lst) + INTERVAL 6 HOURS THEN p END AS priority,
  CASE WHEN TIMESTAMP '2024-01-15 12:00:00' < TIMESTAMP '2024-01-15' - to_seconds(lst) + INTERVAL 6 HOURS THEN 'not yet published' WHEN p IS NULL THEN 'no record' ELSE 'available' END AS climate_reason
FROM {OFFSETS_SQL} LEFT JOIN seen USING (station_code) LEFT JOIN rep USING (station_code)""")
def snapshot_asof(spark, d):
    s = asof.snapshot(_obs(spark, d), _cli(spark, d), _dim(spark), date(2024, 1, 14), AS_OF, cli_hours=6)
    return s.select("station_code", "settlement_date", "obs_count", "latest", F.array_join(F.transform("obs", lambda o: o["seq"].cast("string")), ",").alias("seqs"), F.col("climate.report_type_priority").alias("priority"), "climate_reason")


# -- points in time

_KT_SQL = OBS_SQL + ", kt AS (SELECT *, CASE WHEN seq % 13 = 0 THEN NULL ELSE ts + INTERVAL 15 MINUTES END AS knowledge_time FROM obs)"


def _known(spark, d):
    return _obs(spark, d).withColumn("knowledge_time", F.when(F.col("seq") % 13 != 0, F.col("ts") + F.expr("INTERVAL 15 MINUTES")))


@query(f"WITH {_KT_SQL} SELECT seq, knowledge_time FROM kt WHERE knowledge_time <= TIMESTAMP '2024-01-15 12:00:00'")
def knowledge_view(spark, d):
    return asof.knowledge_view(_known(spark, d), AS_OF).select("seq", "knowledge_time")


@query(f"WITH {_KT_SQL} SELECT station_code, count(*) AS violations FROM kt WHERE knowledge_time > TIMESTAMP '2024-01-15 12:00:00' GROUP BY ALL")
def leakage_count(spark, d):
    return asof.leakage(_known(spark, d), AS_OF).groupBy("station_code").agg(F.count(F.lit(1)).alias("violations"))


@query(f"WITH {OBS_SQL} SELECT seq, source FROM obs WHERE source IN ('iem', 'iem.archive')")
def source_pin(spark, d):
    return asof.pin_source(_obs(spark, d), "iem").select("seq", "source")


@query(f"""WITH {OBS_SQL} SELECT seq, CAST(ts + to_seconds(lst) AS DATE) AS day, date_trunc('day', ts + to_seconds(lst)) - to_seconds(lst) AS win_start, date_trunc('day', ts + to_seconds(lst)) - to_seconds(lst) + INTERVAL 24 HOURS AS win_end,
date_trunc('day', ts + to_seconds(lst)) - to_seconds(lst) + INTERVAL '16 hours 30 minutes' AS close, date_trunc('day', ts + to_seconds(lst)) - to_seconds(lst) + INTERVAL 34 HOURS AS cli_at FROM obs JOIN {OFFSETS_SQL} USING (station_code)""")
def settlement_window(spark, d):
    rows = _obs(spark, d).join(F.broadcast(_dim(spark).select(F.col("code").alias("station_code"), "lst_offset_seconds")), "station_code")
    lst = F.col("lst_offset_seconds")
    rows = rows.withColumn("day", T.settlement_date("ts", lst))
    return rows.select("seq", "day", T.settlement_start("day", lst).alias("win_start"), T.settlement_end("day", lst).alias("win_end"), T.market_close("day", lst).alias("close"), T.cli_available_at("day", lst).alias("cli_at"))


_CYCLE = "CASE WHEN hour({0}) >= 18 THEN date_trunc('day', {0}) + INTERVAL 18 HOURS WHEN hour({0}) >= 12 THEN date_trunc('day', {0}) + INTERVAL 12 HOURS WHEN hour({0}) >= 3 THEN date_trunc('day', {0}) + INTERVAL 3 HOURS ELSE date_trunc('day', {0}) - INTERVAL 6 HOURS END"


@query(f"SELECT event_id AS seq, {_CYCLE.format('ts')} AS cycle, {_CYCLE.format('(ts - INTERVAL 48 HOURS)')} AS issued_prev, {_CYCLE.format('(ts - INTERVAL 90 MINUTES)')} AS issued_live FROM events")
def cycle_floor(spark, d):
    hours = (3, 12, 18)
    return _obs(spark, d).select("seq", T.floor_to_cycle("ts", hours).alias("cycle"), T.issued_at_previous_day("ts", 2, hours).alias("issued_prev"), T.issued_at_live("ts", 90, hours).alias("issued_live"))


@query("SELECT c AS cycle FROM range(TIMESTAMP '2024-01-01 04:00:00', TIMESTAMP '2024-01-09 00:00:01', INTERVAL 1 HOUR) t(c) WHERE hour(c) IN (0, 6, 12, 18)")
def cycle_range(spark, d):
    return T.cycle_range(spark, datetime(2024, 1, 1, 3, 30, tzinfo=UTC), datetime(2024, 1, 9, tzinfo=UTC), (0, 6, 12, 18))


# -- quality control

_QC_SQL = OBS_SQL + ", q AS (SELECT *, dewpoint_c AS dew, wind_speed_kt * 0.514444 - 1 AS ms, CASE WHEN seq % 3 = 0 THEN NULL ELSE wind_dir_degrees END AS dir, sea_level_pressure_mb AS slp FROM obs)"
_FIRED = {"temp_c.out_of_range": "temp_c < -89 OR temp_c > 57", "dew_point_c.exceeds_temp": "dew > temp_c", "wind_speed_ms.negative": "ms < 0", "wind_dir_deg.out_of_range": "dir < 0 OR dir > 360", "slp_hpa.out_of_range": "slp < 870 OR slp > 1085"}
_STATUS = " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, c in enumerate(_FIRED.values()))


def _qc(spark, d):
    rows = qc.to_qc_columns(_obs(spark, d)).withColumn("wind_speed_ms", F.col("wind_speed_ms") - 1)
    return qc.apply_qc(rows.withColumn("wind_dir_deg", F.when(F.col("seq") % 3 != 0, F.col("wind_dir_deg"))))


@query(f"WITH {_QC_SQL} SELECT seq, CAST({_STATUS} AS BIGINT) AS obs_qc_status FROM q")
def qc_bitfield(spark, d):
    return _qc(spark, d).select("seq", "obs_qc_status")


_SIDECAR_SQL = "SELECT station_code, ts AS observed_at, observation_type AS observation_kind, source, CAST(NULL AS VARCHAR) AS parser_name, CAST(NULL AS TIMESTAMP) AS as_of_time, CAST(seq AS VARCHAR) AS ingestion_id, 'skyledger.qc' AS qc_system, '1' AS qc_version, '{0}' AS rule_id, '{1}' AS field, 'flagged' AS flag FROM q WHERE {2}"


@query(f"WITH {_QC_SQL} " + " UNION ALL ".join(_SIDECAR_SQL.format(r, r.partition(".")[0], c) for r, c in _FIRED.items()))
def qc_sidecar(spark, d):
    rows = _qc(spark, d).withColumns({"observed_at": F.col("ts"), "ingestion_id": F.col("seq").cast("string")})
    return qc.sidecar(rows).drop("detector_metadata")


@query(f"WITH {_QC_SQL} SELECT count(*) AS total, count(*) FILTER (({_STATUS}) <> 0) AS flagged, " + ", ".join(f"count(*) FILTER ({c}) AS {r.replace('.', '_')}" for r, c in _FIRED.items()) + " FROM q")
def qc_summary(spark, d):
    return qc.qc_summary(_qc(spark, d))


@query(f"WITH {OBS_SQL} SELECT a.station_code AS station, a.observed_at AS event_time, round(a.temp_c, 6) + 0.0 AS value_a, round(b.temp_c, 6) + 0.0 AS value_b, round(abs(a.temp_c - b.temp_c), 6) + 0.0 AS delta FROM obs a JOIN obs b USING (station_code, observed_at) WHERE a.source = 'iem' AND b.source = 'ghcnh' AND abs(a.temp_c - b.temp_c) > 2")
def crosscheck(spark, d):
    return qc.crosscheck_by_source(_obs(spark, d))


@query("""WITH g AS (SELECT event_id AS seq, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS t, value - 5 + event_id % 17 AS dp, value / 4 - 6 AS rh, value / 5 - 3 AS gust, value - 2 AS p, value * 300 AS sfc, 80000 + value * 60 AS msl, value / 8 AS dist FROM events)
SELECT seq, CASE greatest(coalesce(CASE WHEN t <= 0 OR t >= 400 THEN 2 WHEN t < 180 OR t > 340 THEN 1 END, 0), coalesce(CASE WHEN dp <= 0 OR dp >= 400 THEN 2 WHEN dp > t + 1 THEN 1 END, 0), coalesce(CASE WHEN rh < -5 OR rh > 110 THEN 2 WHEN rh < 0 OR rh > 105 THEN 1 END, 0),
  coalesce(CASE WHEN gust < 0 THEN 2 WHEN gust > 90 THEN 1 END, 0), coalesce(CASE WHEN p < 0 THEN 2 WHEN p > 305 THEN 1 END, 0), coalesce(CASE WHEN sfc <= 0 THEN 2 WHEN sfc < 50000 OR sfc > 110000 THEN 1 END, 0), coalesce(CASE WHEN msl <= 0 THEN 2 WHEN msl < 87000 OR msl > 108500 THEN 1 END, 0), coalesce(CASE WHEN dist > 50 THEN 2 END, 0))
  WHEN 2 THEN 'suspect' WHEN 1 THEN 'flagged' ELSE 'clean' END AS qc_status FROM g""")
def nwp_severity(spark, d):
    v, i = F.col("value"), F.col("event_id")
    g = _read(spark, d, "events").select(i.alias("seq"), F.when(i % 9 != 0, v).alias("temp_k_2m"), (v - 5 + i % 17).alias("dewpoint_k_2m"), (v / 4 - 6).alias("relative_humidity_pct_2m"), (v / 5 - 3).alias("wind_gust_ms"), (v - 2).alias("precip_mm_1h"), (v * 300).alias("pressure_pa_surface"), (80000 + v * 60).alias("pressure_pa_mslp"), (v / 8).alias("grid_dist_km"))
    return qc.nwp_verdict(g, "hrdps").select("seq", "qc_status")


# -- transforms

_BY = {"partition_by": ["station_code"], "order_by": ["ts", "seq"]}
_W = "(PARTITION BY station_code ORDER BY ts, seq)"


def _transform(name: str, make: Callable[[DataFrame], DataFrame], column: str, sql: str) -> None:
    def run(spark, d):
        return make(_obs(spark, d)).select("seq", column)

    run.__name__ = name
    query(f"WITH {OBS_SQL} SELECT seq, {sql} AS {column} FROM obs")(run)


_transform("lag", lambda df: transforms.lag(df, "temp_f", 2, **_BY), "temp_f_lag_2", f"round(lag(temp_f, 2) OVER {_W}, 6) + 0.0")
_transform("lead", lambda df: transforms.lag(df.withColumnRenamed("temp_f", "t"), "t", -1, **_BY).withColumnRenamed("t_lag_-1", "t_lead"), "t_lead", f"round(lead(temp_f, 1) OVER {_W}, 6) + 0.0")
_transform("diff", lambda df: transforms.diff(df, "temp_f", 1, **_BY), "temp_f_diff_1", f"round(temp_f - lag(temp_f, 1) OVER {_W}, 6) + 0.0")
_transform("diff2", lambda df: transforms.diff2(df, "temp_f", **_BY), "temp_f_diff2", f"round((temp_f - lag(temp_f, 1) OVER {_W}) - (lag(temp_f, 1) OVER {_W} - lag(temp_f, 2) OVER {_W}), 6) + 0.0")
for _fn, _sql in {"mean": "avg", "median": "median", "min": "min", "max": "max", "std": "stddev_samp", "var": "var_samp", "sum": "sum"}.items():
    _transform(f"rolling_{_fn}", lambda df, fn=_fn: transforms.rolling(df, "temp_f", 3, fn, **_BY), f"temp_f_rolling_3_{_fn}", f"round({_sql}(temp_f) OVER (PARTITION BY station_code ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) + 0.0")
_transform("rolling_by_week", lambda df: transforms.rolling(df, "temp_f", 30, "mean", chunk="week", **_BY), "temp_f_rolling_30_mean", "round(avg(temp_f) OVER (PARTITION BY station_code ORDER BY ts, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) + 0.0")
_transform("lead_by_day", lambda df: transforms.lag(df.withColumnRenamed("temp_f", "t"), "t", -1, chunk="day", **_BY).withColumnRenamed("t_lag_-1", "t_lead"), "t_lead", f"round(lead(temp_f, 1) OVER {_W}, 6) + 0.0")
_transform("rolling_count", lambda df: transforms.rolling(df, "temp_f", 3, "count", **_BY), "temp_f_rolling_3_count", "count(temp_f) OVER (PARTITION BY station_code ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
_transform("spread", lambda df: transforms.spread(df, "temp_f", "dewpoint_f"), "temp_f_minus_dewpoint_f", "round(temp_f - dewpoint_f, 6) + 0.0")
_transform("clip_physics", lambda df: transforms.clip_outliers(df, "dewpoint_c"), "dewpoint_c_clipped", "round(CASE WHEN dewpoint_c IS NOT NULL THEN greatest(-89.0::DOUBLE, least(35.0::DOUBLE, dewpoint_c)) END, 6) + 0.0")
_transform("clip_sigma", lambda df: transforms.clip_outliers(df, "temp_f", std=1.0), "temp_f_clipped", "round(CASE WHEN temp_f IS NOT NULL THEN greatest((SELECT avg(temp_f) - stddev_samp(temp_f) FROM obs), least((SELECT avg(temp_f) + stddev_samp(temp_f) FROM obs), temp_f)) END, 6) + 0.0")


@query("SELECT event_id AS seq, " + ", ".join(f"round({f}(2 * pi() * {x}), 6) + 0.0 AS {n}_{f}" for n, x in {"month": "month(ts) / 12.0::DOUBLE", "dow": "(isodow(ts) - 1) / 7.0::DOUBLE", "hour": "hour(ts) / 24.0::DOUBLE", "day_of_year": "dayofyear(ts) / 365.0::DOUBLE"}.items() for f in ("sin", "cos")) + " FROM events")
def calendar_features(spark, d):
    out = transforms.calendar_features(_obs(spark, d).select("seq", "ts"), "ts")
    return out.drop("ts")


_CHILL = "35.74 + 0.6215 * t - 35.75 * pow(v, 0.16) + 0.4275 * t * pow(v, 0.16)"
_SIMPLE = "0.5 * (t + 61.0 + (t - 68.0) * 1.2 + h * 0.094)"
_FULL = "(-42.379 + 2.04901523 * t + 10.14333127 * h - 0.22475541 * t * h - 0.00683783 * t * t - 0.05481717 * h * h + 0.00122874 * t * t * h + 0.00085282 * t * h * h - 0.00000199 * t * t * h * h)"
_HEAT = f"CASE WHEN ({_SIMPLE} + t) / 2 < 80 THEN {_SIMPLE} WHEN h < 13 AND t BETWEEN 80 AND 112 THEN {_FULL} - (13 - h) / 4 * sqrt((17 - abs(t - 95)) / 17) WHEN h > 85 AND t BETWEEN 80 AND 87 THEN {_FULL} + (h - 85) / 10 * ((87 - t) / 5) ELSE {_FULL} END"
_WX_SQL = "wx AS (SELECT event_id AS seq, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (value / 4)::DOUBLE END AS t, (event_id % 40)::DOUBLE AS v, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 101)::DOUBLE END AS h FROM events)"


def _wx(spark, d):
    i = F.col("event_id")
    return _read(spark, d, "events").select(i.alias("seq"), F.when(i % 7 != 0, F.col("value") / 4).alias("t"), (i % 40).cast("double").alias("v"), F.when(i % 13 != 0, (i % 101).cast("double")).alias("h"))


@query(f"WITH {_WX_SQL} SELECT seq, round(CASE WHEN t IS NULL THEN NULL WHEN t > 50 OR v <= 3 THEN t ELSE {_CHILL} END, 6) + 0.0 AS wind_chill_f FROM wx")
def wind_chill(spark, d):
    return transforms.wind_chill(_wx(spark, d), "t", "v").select("seq", "wind_chill_f")


@query(f"WITH {_WX_SQL} SELECT seq, round(CASE WHEN t IS NULL OR h IS NULL THEN NULL WHEN t < 80 THEN t ELSE {_HEAT} END, 6) + 0.0 AS heat_index_f FROM wx")
def heat_index(spark, d):
    return transforms.heat_index(_wx(spark, d), "t", "h").select("seq", "heat_index_f")


@query(f"WITH {_WX_SQL.replace('(event_id % 40)::DOUBLE', '(event_id % 40)::DOUBLE * 1.15078')} SELECT seq, round(CASE WHEN t IS NULL THEN NULL WHEN t <= 50 AND v > 3 THEN {_CHILL} WHEN t >= 80 AND h IS NOT NULL THEN {_HEAT} ELSE t END, 6) + 0.0 AS feels_like_f FROM wx")
def feels_like(spark, d):
    return _wx(spark, d).select("seq", W.feels_like("t", "v", "h").alias("feels_like_f"))


@query(f"WITH {OBS_SQL} SELECT seq, round(CASE WHEN temp_c IS NOT NULL AND dewpoint_c IS NOT NULL THEN greatest(0, least(100, 100 * exp(17.625 * dewpoint_c / (243.04 + dewpoint_c)) / exp(17.625 * temp_c / (243.04 + temp_c)))) END, 6) + 0.0 AS rh FROM obs")
def relative_humidity(spark, d):
    return _obs(spark, d).select("seq", W.relative_humidity("temp_c", "dewpoint_c").alias("rh"))


@query(f"WITH {OBS_SQL} SELECT seq, round(temp_c * 9 / 5 + 32, 6) + 0.0 AS f, round((temp_f - 32) * 5 / 9, 6) + 0.0 AS c, round(wind_speed_kt * (1852.0::DOUBLE / 3600), 6) + 0.0 AS ms, round(wind_speed_kt * 1.15078::DOUBLE, 6) + 0.0 AS mph, round(temp_c * 1609.344, 6) + 0.0 AS m, round(temp_c * 25.4, 6) + 0.0 AS mm, round(sea_level_pressure_mb * 0.0295299875, 6) + 0.0 AS inhg, round(temp_c, 1) + 0.0 AS half_up FROM obs")
def units(spark, d):
    return _obs(spark, d).select("seq", U.c_to_f("temp_c").alias("f"), U.f_to_c("temp_f").alias("c"), U.kt_to_ms("wind_speed_kt").alias("ms"), U.kt_to_mph("wind_speed_kt").alias("mph"), U.mi_to_m("temp_c").alias("m"), U.in_to_mm("temp_c").alias("mm"), U.hpa_to_inhg("sea_level_pressure_mb").alias("inhg"), U.half_up("temp_c", 1).alias("half_up"))


# -- parsing

_TEXT_SQL = """txt AS (SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'KNYC 011251Z AO2' ELSE 'METAR KNYC RMK AO2 PK WND ' || lpad(CAST(event_id % 400 AS VARCHAR), 3, '0') || lpad(CAST(event_id % 90 AS VARCHAR), 2, '0') || '/1215 T' || CAST(event_id % 2 AS VARCHAR) || lpad(CAST(event_id % 400 AS VARCHAR), 3, '0') || '1' || lpad(CAST(event_id % 90 AS VARCHAR), 3, '0') END AS raw,
  CASE event_id % 5 WHEN 0 THEN '10+' WHEN 1 THEN '1 1/2' WHEN 2 THEN 'M1/4' WHEN 3 THEN CAST(event_id % 150 AS VARCHAR) ELSE 'x' END AS vis,
  CASE event_id % 4 WHEN 0 THEN 'cavok' WHEN 1 THEN 'BKN' WHEN 2 THEN 'XXX' END AS cover, CASE event_id % 3 WHEN 0 THEN 'KNYC' WHEN 1 THEN 'EGLC' ELSE 'NYC' END AS icao,
  strftime(ts, '%Y%m%d%H%M') || '-KOKX' AS product, CAST(ts AS DATE) - CAST(event_id % 4 AS INTEGER) + 1 AS day FROM events)"""


def _text(spark, d):
    i = F.col("event_id")
    e = _read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    pad = lambda n, w: F.lpad((i % n).cast("string"), w, "0")
    raw = F.when(i % 4 == 0, "KNYC 011251Z AO2").otherwise(F.concat(F.lit("METAR KNYC RMK AO2 PK WND "), pad(400, 3), pad(90, 2), F.lit("/1215 T"), (i % 2).cast("string"), pad(400, 3), F.lit("1"), pad(90, 3)))
    vis = F.when(i % 5 == 0, "10+").when(i % 5 == 1, "1 1/2").when(i % 5 == 2, "M1/4").when(i % 5 == 3, (i % 150).cast("string")).otherwise("x")
    return e.select(i.alias("seq"), raw.alias("raw"), vis.alias("vis"), F.when(i % 4 == 0, "cavok").when(i % 4 == 1, "BKN").when(i % 4 == 2, "XXX").alias("cover"), F.when(i % 3 == 0, "KNYC").when(i % 3 == 1, "EGLC").otherwise("NYC").alias("icao"), F.concat(F.date_format("ts", "yyyyMMddHHmm"), F.lit("-KOKX")).alias("product"), F.date_add(F.to_date("ts"), (1 - i % 4).cast("int")).alias("day"))


@query(f"""WITH {_TEXT_SQL} SELECT seq, CASE WHEN regexp_matches(raw, 'RMK.* T[01]') THEN round(CAST(substr(raw, length(raw) - 6, 3) AS DOUBLE) / 10 * CASE WHEN substr(raw, length(raw) - 7, 1) = '1' THEN -1 ELSE 1 END, 6) + 0.0 END AS t,
CASE WHEN regexp_matches(raw, 'RMK.* T[01]') THEN round(-CAST(right(raw, 3) AS DOUBLE) / 10, 6) + 0.0 END AS td FROM txt""")
def tenths_group(spark, d):
    t, td = P.tenths_group("raw")
    return _text(spark, d).select("seq", t.alias("t"), td.alias("td"))


@query(f"""WITH {_TEXT_SQL}, pk AS (SELECT seq, try_cast(nullif(regexp_extract(raw, 'PK WND (\\d{{3}})(\\d{{2,3}})/(\\d{{4}})', 1), '') AS BIGINT) AS dir, try_cast(nullif(regexp_extract(raw, 'PK WND (\\d{{3}})(\\d{{2,3}})/(\\d{{4}})', 2), '') AS BIGINT) AS kt FROM txt)
SELECT seq, CASE WHEN dir <= 360 THEN dir END AS dir, CASE WHEN dir <= 360 THEN kt END AS kt, CASE WHEN dir <= 360 THEN '1215' END AS at FROM pk""")
def peak_wind(spark, d):
    a, b, c = P.peak_wind("raw")
    return _text(spark, d).select("seq", a.alias("dir"), b.alias("kt"), c.alias("at"))


@query(f"""WITH {_TEXT_SQL} SELECT seq, CASE vis WHEN '10+' THEN 10.0::DOUBLE WHEN '1 1/2' THEN 1.5::DOUBLE WHEN 'M1/4' THEN 0.25::DOUBLE WHEN 'x' THEN NULL ELSE least(99.99::DOUBLE, CAST(CASE WHEN vis = 'x' OR vis LIKE '%/%' OR vis LIKE '%+' THEN '0' ELSE vis END AS DOUBLE)) END AS visibility,
CASE upper(cover) WHEN 'CAVOK' THEN 'CLR' WHEN 'BKN' THEN 'BKN' END AS cover, CASE WHEN icao = 'KNYC' THEN 'NYC' ELSE icao END AS code FROM txt""")
def report_fields(spark, d):
    return _text(spark, d).select("seq", P.visibility("vis").alias("visibility"), P.cloud_cover("cover").alias("cover"), P.icao_to_code("icao").alias("code"))


@query(f"""WITH {_TEXT_SQL}, k AS (SELECT seq, strptime(substr(product, 1, 12), '%Y%m%d%H%M') AS pt, day FROM txt)
SELECT seq, CASE WHEN date_diff('day', day, CAST(pt AS DATE)) <= 0 THEN 'preliminary' WHEN date_diff('day', day, CAST(pt AS DATE)) = 1 AND hour(pt) BETWEEN 4 AND 10 THEN 'final' ELSE 'correction' END AS report_type FROM k""")
def report_type(spark, d):
    return _text(spark, d).select("seq", P.report_type("product", "day").alias("report_type"))


@query(f"WITH {OBS_SQL} SELECT seq, CASE WHEN temp_c BETWEEN -90 AND 60 THEN round(temp_c, 6) + 0.0 END AS temp_c, CASE WHEN wind_dir_degrees BETWEEN 0 AND 360 THEN CAST(wind_dir_degrees AS BIGINT) END AS dir, CASE WHEN sea_level_pressure_mb BETWEEN 870 AND 1084 THEN round(sea_level_pressure_mb, 6) + 0.0 END AS slp FROM obs")
def bounds(spark, d):
    return _obs(spark, d).select("seq", P.within("temp_c", "temp_c").alias("temp_c"), P.within("wind_dir_degrees", "wind_dir_degrees").alias("dir"), P.within("sea_level_pressure_mb", "sea_level_pressure_mb").alias("slp"))


@query("SELECT event_id AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts + to_hours(CAST(h AS BIGINT)) AS valid_at, CASE WHEN h < 2 THEN round(value + h, 6) + 0.0 END AS temperature_2m FROM events, range(3) t(h)")
def hourly_rows(spark, d):
    e = _read(spark, d, "events").select(F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.struct(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda h: F.date_format(F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(0), h), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("time"), F.array(F.col("value"), F.col("value") + 1).alias("temperature_2m")).alias("hourly"))
    return readers.hourly_rows(e)


@query("SELECT CAST(record_no AS DOUBLE) AS record_no, \"offset\", variable, level, lead(\"offset\") OVER (PARTITION BY f ORDER BY \"offset\") AS next_offset FROM (SELECT event_id AS record_no, event_id * 100 AS \"offset\", 'TMP' AS variable, '2 m above ground' AS level, user_id % 4 AS f FROM events)")
def index_records(spark, d):
    lines = _read(spark, d, "events").select((F.col("user_id") % 4).cast("string").alias("file"), F.concat_ws(":", F.col("event_id").cast("string"), (F.col("event_id") * 100).cast("string"), F.lit("d=2024010100"), F.lit("TMP"), F.lit("2 m above ground"), F.lit("anl")).alias("value"))
    return readers.index_records(lines).select("record_no", "offset", "variable", "level", "next_offset")


# -- grids, validation, discovery


@query("""WITH s AS (SELECT n_nationkey AS k, (n_nationkey * 13 % 120 - 60)::DOUBLE + 0.3 AS lat, (n_nationkey * 37 % 360)::DOUBLE + 0.2 AS lon FROM nation),
g AS (SELECT p_partkey AS id, (p_partkey * 7 % 130 - 65)::DOUBLE AS lat, (p_partkey * 11 % 360)::DOUBLE AS lon FROM part),
x AS (SELECT k, id, g.lat, g.lon, 2 * 6371.0 * asin(sqrt(least(1, pow(sin((radians(g.lat) - radians(s.lat)) / 2), 2) + cos(radians(s.lat)) * cos(radians(g.lat)) * pow(sin((radians(g.lon) - radians(s.lon)) / 2), 2)))) AS km FROM s, g)
SELECT CAST(k AS BIGINT) AS k, id, lat AS grid_lat, CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END AS grid_lon, round(km, 6) + 0.0 AS grid_dist_km FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY km, id) = 1""")
def nearest_grid(spark, d):
    k, p = F.col("n_nationkey"), F.col("p_partkey")
    s = _read(spark, d, "nation").select(k.alias("k"), ((k * 13 % 120 - 60).cast("double") + 0.3).alias("latitude"), ((k * 37 % 360).cast("double") + 0.2).alias("longitude"))
    g = _read(spark, d, "part").select(p.alias("id"), (p * 7 % 130 - 65).cast("double").alias("lat"), (p * 11 % 360).cast("double").alias("lon"))
    return grid.nearest_grid(s, g, station="k", point=["id"], cell=5.0).select("k", "id", "grid_lat", "grid_lon", "grid_dist_km")


_SEEN = Schema("schema.events.check", (ColumnSpec("source", "enum", values=("awc", "iem")), ColumnSpec("temp_f", "float64"), ColumnSpec("observation_type", "enum", values=("METAR", "SPECI"))))


@query(f"WITH {OBS_SQL} SELECT count(*) AS rows, count(*) FILTER (source IS NULL) AS source_nulls, count(*) FILTER (source NOT IN ('awc', 'iem')) AS source_bad, count(*) FILTER (temp_f IS NULL) AS temp_f_nulls, count(*) FILTER (observation_type IS NULL) AS observation_type_nulls, count(*) FILTER (observation_type NOT IN ('METAR', 'SPECI')) AS observation_type_bad FROM obs")
def validate_counts(spark, d):
    return validate.counts(_obs(spark, d), _SEEN)


@query(f"""WITH {OBS_SQL} SELECT station_code, substr(sha256(station_code || '|' || string_agg(strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ'), ',' ORDER BY observed_at)), 1, 16) AS version, count(*) AS rows, max(strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ')) AS latest FROM obs GROUP BY station_code""")
def data_version(spark, d):
    return aggregates.data_version(_obs(spark, d).withColumn("observed_at", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")))


@query(f"WITH {OBS_SQL} SELECT station_code AS station, count(*) AS rows, min(observed_at) AS first, max(observed_at) AS last, count(DISTINCT strftime(observed_at, '%Y-%m')) AS months, count(DISTINCT year(observed_at)) AS years FROM obs GROUP BY ALL")
def availability(spark, d):
    return discovery.availability(_obs(spark, d))


@query(f"WITH {CLI_SQL}, spine AS (SELECT station_code, CAST(d AS DATE) AS date FROM {OFFSETS_SQL}, range(DATE '2023-12-20', DATE '2024-02-11', INTERVAL 1 DAY) t(d)) SELECT station_code AS station, date FROM spine WHERE NOT EXISTS (SELECT 1 FROM cli WHERE cli.station_code = spine.station_code AND observation_date = date)")
def climate_gaps(spark, d):
    return discovery.climate_gaps(_cli(spark, d), _dim(spark), date(2023, 12, 20), date(2024, 2, 10))


@query("SELECT c_mktsegment AS city, CASE c_nationkey % 3 WHEN 0 THEN 'NYC' WHEN 1 THEN 'LAX' ELSE 'XXXX' END AS station, CASE c_nationkey % 3 WHEN 0 THEN 'KNYC' WHEN 1 THEN 'KLAX' ELSE 'XXXX' END AS icao, list_aggregate(list_sort(list(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'kalshi' ELSE 'polymarket' END)), 'string_agg', ',') AS settles_for FROM customer GROUP BY ALL")
def discover(spark, d):
    c = _read(spark, d, "customer")
    cities = c.select(F.col("c_mktsegment").alias("city"), F.when(F.col("c_nationkey") % 3 == 0, "KNYC").when(F.col("c_nationkey") % 3 == 1, "KLAX").otherwise("XXXX").alias("icao"), F.when(F.col("c_custkey") % 2 == 0, "kalshi").otherwise("polymarket").alias("issuer"))
    return discovery.discover(spark, cities).withColumn("settles_for", F.concat_ws(",", "settles_for"))


# -- markets


@query("""SELECT event_id AS seq, to_timestamp(event_id)::TIMESTAMP AS ts, CASE WHEN event_id % 2 = 0 THEN round(CAST(printf('%.4f', value / 500) AS DOUBLE) * 100, 6) + 0.0 ELSE CAST(user_id AS DOUBLE) END AS open, CASE WHEN event_id % 2 = 0 THEN event_id % 1000 ELSE user_id END AS volume, 'kalshi' AS source FROM events""")
def candles(spark, d):
    i = F.col("event_id")
    payload = F.when(i % 2 == 0, F.format_string('{"end_period_ts": %d, "price": {"open_dollars": "%.4f", "open": 1}, "volume_fp": "%d.00", "volume": 9}', i, F.col("value") / 500, i % 1000)).otherwise(F.format_string('{"end_period_ts": %d, "price": {"open": %d}, "volume": %d}', i, F.col("user_id"), F.col("user_id")))
    return markets.candles(_read(spark, d, "events").select(i.alias("seq"), payload.alias("payload"))).select("seq", "ts", "open", "volume", "source")


@query("""SELECT event_id AS seq, side, CASE WHEN event_id % 2 = 0 THEN p::DOUBLE ELSE 40.0::DOUBLE END AS price, CASE WHEN event_id % 2 = 0 THEN event_id % 50 ELSE 7 END AS size FROM events, (VALUES ('yes', 25.0), ('no', 50.0)) v(side, p) WHERE event_id % 2 = 0 OR side = 'yes'""")
def order_book(spark, d):
    i = F.col("event_id")
    payload = F.when(i % 2 == 0, F.format_string('{"orderbook_fp": {"yes_dollars": [["0.2500", "%d.00"]], "no_dollars": [["0.5000", "%d"]]}}', i % 50, i % 50)).otherwise(F.lit('{"orderbook": {"yes": [[40, 7]], "no": null}}'))
    return markets.order_book(_read(spark, d, "events").select(i.alias("seq"), payload.alias("payload"))).select("seq", "side", "price", "size")


@query("SELECT event_id AS seq, o AS outcome, CASE WHEN o = 'Yes' THEN round(user_id / 150.0::DOUBLE, 6) + 0.0 END AS price FROM events, (VALUES ('Yes'), ('No')) v(o)")
def outcomes(spark, d):
    e = _read(spark, d, "events").select(F.col("event_id").alias("seq"), F.lit('["Yes", "No"]').alias("outcomes"), F.concat(F.lit('["'), (F.col("user_id") / 150).cast("string"), F.lit('"]')).alias("outcomePrices"))
    return markets.outcomes(e)


_EV_SQL = """ev AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Highest temperature' WHEN 1 THEN 'Coldest day' WHEN 2 THEN 'high and low' ELSE 'Weather' END AS title, event_type || '-on-2020-02-30x-' || strftime(ts, '%Y-%m-%d') AS slug,
  CASE event_id % 5 WHEN 0 THEN 'see https://www.wunderground.com/history/daily/us/ny/KLGA for it' WHEN 1 THEN 'https://wunderground.com/history/daily/KJFK and https://wunderground.com/history/daily/KLGA' WHEN 2 THEN 'https://evil.example/KLGA' WHEN 3 THEN 'https://www.weather.gov/wrh' ELSE '' END AS description FROM events)"""


def _events(spark, d):
    i = F.col("event_id")
    e = _read(spark, d, "events")
    title = F.when(i % 4 == 0, "Highest temperature").when(i % 4 == 1, "Coldest day").when(i % 4 == 2, "high and low").otherwise("Weather")
    text = F.when(i % 5 == 0, "see https://www.wunderground.com/history/daily/us/ny/KLGA for it").when(i % 5 == 1, "https://wunderground.com/history/daily/KJFK and https://wunderground.com/history/daily/KLGA").when(i % 5 == 2, "https://evil.example/KLGA").when(i % 5 == 3, "https://www.weather.gov/wrh").otherwise("")
    return e.select("event_id", i.cast("string").alias("id"), title.alias("title"), F.concat(F.col("event_type"), F.lit("-on-2020-02-30x-"), F.date_format("ts", "yyyy-MM-dd")).alias("slug"), text.alias("description"), F.when(i % 3 == 0, "Chicago").when(i % 3 == 1, "Paris").when(i % 6 == 5, "Taipei").otherwise("Nowhere").alias("city"))


_MEASURE = "CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'default' END"
_ICAO = f"CASE WHEN event_id % 5 = 0 THEN 'KLGA' WHEN event_id % 3 = 0 THEN 'KMDW' WHEN event_id % 3 = 1 THEN CASE WHEN {_MEASURE} = 'low' THEN 'LFPB' ELSE 'LFPG' END WHEN event_id % 6 = 5 THEN 'RCTP' END"
_EVENT_STATUS = f"CASE WHEN event_id % 5 = 2 THEN 'bad_description' WHEN {_ICAO} IS NULL THEN 'unknown_city' WHEN {_ICAO} = 'RCTP' THEN 'deferred' WHEN {_MEASURE} = 'default' THEN 'ambiguous_measure' ELSE 'ok' END"


@query(f"WITH {_EV_SQL} SELECT event_id, {_MEASURE} AS measure, {_ICAO} AS icao, CASE WHEN event_id % 5 IN (0, 1) THEN 'wunderground' WHEN event_id % 5 = 3 THEN 'noaa_wrh' ELSE 'other' END AS source_type, CAST(right(slug, 10) AS DATE) AS settlement_date, {_EVENT_STATUS} AS status FROM ev")
def resolve_events(spark, d):
    return markets.resolve_events(_events(spark, d), _cities(spark)).select("event_id", "measure", "icao", "source_type", "settlement_date", "status")


def _cities(spark):
    return spark.createDataFrame([("chicago", "default", "KMDW"), ("paris", "high", "LFPG"), ("paris", "low", "LFPB"), ("paris", "default", "LFPG"), ("taipei", "default", "RCTP")], "city string, measure string, icao string")


@query(f"""WITH {_EV_SQL}, {MERGED_SQL}, loc AS (SELECT *, CAST(observed_at + to_seconds(-21600) AS DATE) AS local_date FROM merged WHERE station_code = 'MDW'),
x AS (SELECT local_date, round(min(temp_c), 1) + 0.0 AS lo, round(max(temp_c), 1) + 0.0 AS hi, count(temp_c) AS n FROM loc GROUP BY ALL),
s AS (SELECT event_id, {_MEASURE} AS measure, {_ICAO} AS icao, CAST(right(slug, 10) AS DATE) AS day, {_EVENT_STATUS} AS st, CASE WHEN event_id % 5 = 3 THEN 4 WHEN event_id % 5 < 2 THEN 6 ELSE 24 END AS wait FROM ev),
t AS (SELECT s.*, x.lo, x.hi, x.n, x.local_date, CAST(day AS TIMESTAMP) + INTERVAL '23 hours 59 minutes 59 seconds' + to_hours(CAST(CASE icao WHEN 'KMDW' THEN 6 WHEN 'KLGA' THEN 5 ELSE -1 END AS BIGINT)) + to_hours(CAST(wait AS BIGINT)) AS final_at FROM s LEFT JOIN x ON icao = 'KMDW' AND day = local_date)
SELECT event_id, CASE WHEN st <> 'ok' THEN st WHEN TIMESTAMP '2024-01-20 12:00:00' < final_at THEN 'too_early' WHEN local_date IS NULL THEN 'no_extremes' WHEN n < 12 THEN 'low_coverage' ELSE 'settled' END AS status,
  CASE WHEN st = 'ok' AND TIMESTAMP '2024-01-20 12:00:00' >= final_at AND n >= 12 THEN CASE WHEN measure = 'high' THEN hi ELSE lo END END AS observed_value_c FROM t""")
def settle(spark, d):
    days = extremes.daily_extremes(_local(spark, d)).withColumn("station", F.concat(F.lit("K"), "station"))
    events = markets.resolve_events(_events(spark, d), _cities(spark))
    return markets.settle(events, days, zones(spark), datetime(2024, 1, 20, 12, tzinfo=UTC)).select("event_id", "status", "observed_value_c")


@query("SELECT event_id AS seq, CASE WHEN event_id % 3 < 2 THEN 'high' END AS measure, CASE event_id % 3 WHEN 0 THEN 'NY' WHEN 1 THEN 'ZZ' END AS city, CASE WHEN event_id % 3 < 2 THEN DATE '2024-01-05' END AS contract_date, CASE event_id % 3 WHEN 0 THEN 'NYC' END AS station, CASE event_id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'unknown_city' ELSE 'malformed' END AS status FROM events")
def contract_resolve(spark, d):
    i = F.col("event_id")
    e = _read(spark, d, "events").select(i.alias("seq"), F.when(i % 3 == 0, "KXHIGHNY-24JAN05-T79").when(i % 3 == 1, "KHIGHZZ-24JAN05").otherwise("SOMETHING").alias("ticker"))
    return markets.resolve_contracts(e).drop("ticker")


@query("WITH c AS (SELECT c_custkey % 40 AS city, 'default' AS measure, CASE WHEN c_custkey % 7 = 0 THEN 'KLGA' ELSE 'KNYC' END AS icao FROM customer) SELECT city, measure, list_aggregate(list_sort(list(DISTINCT icao)), 'string_agg', ',') AS icaos FROM c GROUP BY ALL HAVING count(DISTINCT icao) > 1")
def disagreeing_cities(spark, d):
    k = F.col("c_custkey")
    c = _read(spark, d, "customer").select((k % 40).alias("city"), F.lit("default").alias("measure"), F.when(k % 7 == 0, "KLGA").otherwise("KNYC").alias("icao"))
    return markets.disagreeing_cities(c).withColumn("icaos", F.concat_ws(",", "icaos"))


@query("WITH t AS (SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'rain in New-York today' WHEN event_id % 4 = 1 THEN 'YORK weather' WHEN event_id % 4 = 2 THEN 'newyorkhigh' ELSE 'none' END AS text FROM events) SELECT seq, CASE seq % 4 WHEN 0 THEN 'new york' WHEN 1 THEN 'york' WHEN 2 THEN 'new york' END AS city FROM t")
def derive_city(spark, d):
    i = F.col("event_id")
    e = _read(spark, d, "events").select(i.alias("seq"), F.when(i % 4 == 0, "rain in New-York today").when(i % 4 == 1, "YORK weather").when(i % 4 == 2, "newyorkhigh").otherwise("none").alias("text"))
    return markets.derive_city(e, ["York", "New York", "Rome"], "text").select("seq", "city")


# -- live


@query(f"WITH {OBS_SQL} SELECT seq, station_code, observed_at FROM obs QUALIFY observed_at IS DISTINCT FROM lag(observed_at) OVER (PARTITION BY station_code ORDER BY seq)")
def live_changes(spark, d):
    return live.changes(_obs(spark, d)).select("seq", "station_code", "observed_at")


@query(f"WITH {OBS_SQL} SELECT station_code, max(observed_at) AS observed_at, bool_or(observation_type = 'SPECI') AS speci FROM (SELECT *, max(observed_at) OVER (PARTITION BY station_code) AS m FROM obs) WHERE observed_at = m GROUP BY ALL")
def live_latest(spark, d):
    return live.latest(_obs(spark, d)).select("station_code", "observed_at", (F.col("observation_type") == "SPECI").alias("speci"))


@query(f"""WITH {OBS_SQL} SELECT station_code, CAST(observed_at - INTERVAL 5 HOURS AS DATE) AS date, round(max(temp_f), 6) + 0.0 AS high_f, round(min(temp_f), 6) + 0.0 AS low_f, count(*) AS rows FROM obs GROUP BY ALL""")
def settlement_stream_days(spark, d):
    """The running day of a stream, on a batch: the same plan without a watermark's effect."""
    return live.settlement_days(_obs(spark, d), -18000)


@query("SELECT unnest(['lag', 'diff', 'diff2', 'rolling', 'calendar_features', 'spread', 'wind_chill', 'heat_index', 'clip_outliers', 'clip_sigma']) AS feature")
def feature_catalog(spark, d):
    return discovery.feature_catalog(spark)
