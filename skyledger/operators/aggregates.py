"""Daily aggregates, forecast runs and versions of data."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import c_to_f, finite, k_to_f

OBS_AGGREGATES = {"obs_high_f": ("max", "temp_f"), "obs_low_f": ("min", "temp_f"), "obs_mean_f": ("avg", "temp_f"), "obs_mean_dewpoint_f": ("avg", "dewpoint_f"), "obs_max_wind_kt": ("max", "wind_speed_kt"), "obs_max_gust_kt": ("max", "wind_gust_kt"), "obs_total_precip_in": ("sum", "precip_1hr_inches")}


def obs_aggregates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: extremes and means of temperature, mean dew point, greatest wind and gust, total precipitation (null without any value), and obs_count of all rows. NaN counts as null; columns that df lacks give null."""
    doubles = {"temp_f", "dewpoint_f", "precip_1hr_inches"}
    aggs: list[Column] = []
    for name, (how, source) in OBS_AGGREGATES.items():
        if source not in df.columns:
            aggs.append(F.max(F.lit(None).cast("double" if source in doubles else "int")).alias(name))
            continue
        x = finite(source) if source in doubles else F.col(source)
        aggs.append({"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}[how](x).alias(name))
    return df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("obs_count"))


def best_run(forecasts: DataFrame, keys: list[str], close: str = "market_close_utc", model: str | None = None) -> DataFrame:
    """Rows of the latest run of each key that was issued by ``close`` (included). An as-of join without a join: the latest time is a window maximum over the key.

    forecasts: keys, issued_at, valid_at, close, model. model filters without regard to case.
    """
    rows = forecasts.filter(F.col("issued_at").isNotNull() & (F.col("issued_at") <= F.col(close)))
    if model is not None:
        rows = rows.filter(F.lower("model") == model.lower())
    return rows.withColumn("_best", F.max("issued_at").over(Window.partitionBy(*keys))).filter("issued_at = _best").drop("_best")


def run_aggregates(run: DataFrame, keys: list[str], start: str = "win_start", stop: str = "win_end") -> DataFrame:
    """Per key of best_run()'s rows: extremes inside the window (both ends included), the greatest chance and the sum of precipitation there, the model first by valid_at, and issued_at, which is kept even if nothing lies in the window."""
    inside = F.col("valid_at").between(F.col(start), F.col(stop))
    t = F.when(inside, finite("temperature_f"))
    return run.groupBy(*keys).agg(
        F.max(t).alias("run_high_f"),
        F.min(t).alias("run_low_f"),
        F.max(F.when(inside, finite("pop_6hr_pct"))).alias("run_pop"),
        F.sum(F.when(inside, finite("qpf_6hr_in"))).alias("run_qpf"),
        F.min_by("model", F.when(F.col("model").isNotNull(), F.struct("valid_at", "model"))).alias("run_model"),
        F.max("issued_at").alias("run_issued_at"),
    )


def series_aggregates(series: DataFrame, keys: list[str], default_model: str = "open-meteo") -> DataFrame:
    """Per key of rows without a run: extremes in F of temperature_c, the greatest chance, and the model."""
    t = c_to_f(finite("temperature_c"))
    return series.groupBy(*keys).agg(
        F.max(t).alias("series_high_f"),
        F.min(t).alias("series_low_f"),
        F.max(finite("precipitation_probability_pct")).alias("series_pop"),
        F.coalesce(F.min_by("model", F.when(F.col("model").isNotNull(), F.struct("valid_at", "model"))), F.lit(default_model)).alias("series_model"),
    )


def nwp_aggregates(nwp: DataFrame, keys: list[str], models: list[str], as_of: str | None = None) -> DataFrame:
    """fcst_high_f_nwp_<model> and fcst_low_f_nwp_<model> per key over all rows of the day. as_of names a column: then only cycles up to it count, which closes a leak that the default leaves for parity."""
    rows = nwp if as_of is None else nwp.filter(F.col("cycle") <= F.col(as_of))
    t = k_to_f(finite("temp_k_2m"))
    aggs = []
    for m in models:
        of = F.when(F.lower("model") == m.lower(), t)
        aggs += [F.max(of).alias(f"fcst_high_f_nwp_{m}"), F.min(of).alias(f"fcst_low_f_nwp_{m}")]
    return rows.groupBy(*keys).agg(*aggs)


def data_version(df: DataFrame, station: str = "station_code", at: str = "observed_at") -> DataFrame:
    """Per station: version (16 hex digits of SHA-256 over the code, a pipe and the sorted times joined by commas), rows, latest.

    The times of one station are gathered: at one a minute, a century takes about 1 GB; use data_fingerprint() beyond that.
    """
    times = F.concat_ws(",", F.sort_array(F.collect_list(F.col(at).cast("string"))))
    return df.groupBy(station).agg(F.substring(F.sha2(F.concat(F.first(station), F.lit("|"), times), 256), 1, 16).alias("version"), F.count(F.lit(1)).alias("rows"), F.max(at).alias("latest"))


def data_fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: an order-free fingerprint that needs no gathering: the count and the sum and exclusive-or of row hashes."""
    row = F.xxhash64(*df.columns)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(row).alias("hash_xor"))


def content_hash(df: DataFrame, columns: list[str]) -> str:
    """16 hex digits that depend on the rows alone, not on their order or files: over the count and the sum of 48-bit digests of each row's values as JSON."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0))).first()
    return hashlib.sha256(f"{n}:{int(total)}".encode()).hexdigest()[:16]


def version_of(*parts: str) -> str:
    """16 hex digits over parts (release, schemas, sources, code, data) joined by pipes."""
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]
