"""Extremes by the station's own calendar day, with daylight saving."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import local_date
from ..functions.units import c_to_f, finite, half_up

#: Fixed value: with fewer temperatures a day has no extremes.
LEAST_OBS = 12
#: Sources whose rows count, by merge policy; None: all.
MERGE_POLICIES = {"live_v1": None, "iem_only": ("iem", "iem.archive"), "awc_only": ("awc", "awc.live")}


def daily_extremes(df: DataFrame, start: date | None = None, stop: date | None = None, *, merge: str = "live_v1", station: str = "station_code", tz: str = "tz", us: str = "is_us") -> DataFrame:
    """One row per station and local day that has rows: tmin_c, tmax_c, tmean_c (one decimal in the US, none abroad), precip_inches (0 without any), n_obs (temperatures), and the sources of the extremes, first in time.

    df: station, observed_at, source, temp_c, precip_1hr_inches, and the station's tz and is_us. Days with fewer than 12
    temperatures keep their row without extremes. merge: live_v1 (all rows as given), iem_only or awc_only.
    """
    if merge not in MERGE_POLICIES:
        raise ValueError(f"no merge policy {merge!r}")
    if MERGE_POLICIES[merge]:
        df = df.filter(F.col("source").isin(*MERGE_POLICIES[merge]))
    rows = df.withColumn("_t", finite("temp_c")).withColumn("local_date", local_date("observed_at", F.col(tz)))
    if start is not None:
        rows = rows.filter(F.col("local_date") >= F.lit(start))
    if stop is not None:
        rows = rows.filter(F.col("local_date") <= F.lit(stop))
    known = F.col("_t").isNotNull()
    at = lambda t: F.when(known, F.struct(t.alias("t"), "observed_at", "source"))
    days = rows.groupBy(F.col(station).alias("station"), "local_date").agg(
        F.first(us).alias("_us"),
        F.min("_t").alias("_min"),
        F.max("_t").alias("_max"),
        F.avg("_t").alias("_mean"),
        F.coalesce(F.sum(finite("precip_1hr_inches")), F.lit(0.0)).alias("_precip"),
        F.count("_t").alias("n_obs"),
        F.min_by("source", at(F.col("_t"))).alias("_smin"),
        F.min_by("source", at(-F.col("_t"))).alias("_smax"),
    )
    enough = F.col("n_obs") >= LEAST_OBS
    shown = lambda x: F.when(enough, F.when(F.col("_us"), half_up(x, 1)).otherwise(half_up(x, 0)))
    return days.select(
        "station",
        "local_date",
        shown("_min").alias("tmin_c"),
        shown("_max").alias("tmax_c"),
        shown("_mean").alias("tmean_c"),
        F.round("_precip", 4).alias("precip_inches"),
        "n_obs",
        F.when(enough, F.col("_smin")).alias("source_tmin"),
        F.when(enough, F.col("_smax")).alias("source_tmax"),
        F.lit(merge).alias("merge_policy"),
    )


def daily_extremes_f(df: DataFrame, start: date | None = None, stop: date | None = None, *, merge: str = "live_v1", station: str = "station_code", tz: str = "tz", us: str = "is_us") -> DataFrame:
    """As daily_extremes() in Fahrenheit and inches: date, station, tmin_f, tmax_f, tmean_f (whole in the US, one decimal abroad), precip_in (two decimals, null without any), low_coverage, n_obs. Halves go up."""
    if merge not in MERGE_POLICIES:
        raise ValueError(f"no merge policy {merge!r}")
    if MERGE_POLICIES[merge]:
        df = df.filter(F.col("source").isin(*MERGE_POLICIES[merge]))
    rows = df.withColumn("_t", finite("temp_c")).withColumn("local_date", local_date("observed_at", F.col(tz)))
    if start is not None:
        rows = rows.filter(F.col("local_date") >= F.lit(start))
    if stop is not None:
        rows = rows.filter(F.col("local_date") <= F.lit(stop))
    days = rows.groupBy(F.col(station).alias("station"), "local_date").agg(
        F.first(us).alias("_us"), F.min("_t").alias("_min"), F.max("_t").alias("_max"), F.avg("_t").alias("_mean"), F.sum(finite("precip_1hr_inches")).alias("_precip"), F.count("_t").alias("n_obs")
    )
    low = F.col("n_obs") < LEAST_OBS
    scale = F.when(F.col("_us"), 1.0).otherwise(10.0)
    shown = lambda c: F.when(~low, F.floor(c_to_f(c) * scale + 0.5) / scale)
    return days.select(F.col("local_date").alias("date"), "station", shown("_min").alias("tmin_f"), shown("_max").alias("tmax_f"), shown("_mean").alias("tmean_f"), (F.floor(F.col("_precip") * 100 + 0.5) / 100).alias("precip_in"), low.alias("low_coverage"), "n_obs")
