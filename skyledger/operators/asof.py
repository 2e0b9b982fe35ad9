"""Points in time: what was known at an instant, and guards against what wasn't."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LeakageError, SourceMismatchError
from ..functions.temporal import TimePoint, cli_available_at, settlement_end, settlement_start
from .merge import REPORT_PRIORITY, priority, priority_dedup

SAMPLES, ISSUED_SAMPLES = 10, 5
#: Request names and the tags they stand for.
SOURCE_ALIASES = {
    "iem": ("iem", "iem.archive"),
    "iem.archive": ("iem", "iem.archive"),
    "iem.live": ("iem.live",),
    "awc": ("awc", "awc.live"),
    "awc.live": ("awc", "awc.live"),
    "ghcnh": ("ghcnh", "ghcnh.archive"),
    "ghcnh.archive": ("ghcnh", "ghcnh.archive"),
}


def _instant(as_of: TimePoint | Column) -> Column:
    return as_of.column() if isinstance(as_of, TimePoint) else as_of


def knowledge_view(df: DataFrame, as_of: TimePoint | Column, column: str = "knowledge_time") -> DataFrame:
    """Rows known at as_of; rows without a knowledge time aren't."""
    return df.filter(F.col(column) <= _instant(as_of))


def leakage(df: DataFrame, as_of: TimePoint | Column, column: str = "knowledge_time") -> DataFrame:
    """Rows known only after as_of. A missing knowledge time is no violation."""
    return df.filter(F.col(column) > _instant(as_of))


def assert_no_leakage(df: DataFrame, as_of: TimePoint | Column, column: str = "knowledge_time") -> DataFrame:
    """df itself; raises with the count and up to ten samples."""
    bad = leakage(df, as_of, column)
    n = bad.count()
    if n:
        samples = [str(r[0]) for r in bad.select(column).orderBy(F.col(column)).limit(SAMPLES).collect()]
        raise LeakageError(f"{n} rows are known only after the as-of time", count=n, samples=samples)
    return df


def assert_issued(df: DataFrame, as_of: TimePoint | Column, column: str = "issued_at") -> DataFrame:
    """df itself; raises if a row has no issue time or one after as_of. An empty table passes."""
    bad = df.filter(F.col(column).isNull() | (F.col(column) > _instant(as_of)))
    if n := bad.count():
        samples = [str(r[0]) for r in bad.select(column).limit(ISSUED_SAMPLES).collect()]
        raise LeakageError(f"{n} rows weren't issued by the as-of time", count=n, samples=samples)
    return df


def pin_source(df: DataFrame, name: str, column: str = "source") -> DataFrame:
    """Rows of one source, by its request name; tags stay as they are. Apply it before a merge to see all rows of the source, after it for those that won."""
    if name not in SOURCE_ALIASES:
        raise SourceMismatchError(f"no source {name!r}", known=sorted(SOURCE_ALIASES))
    return df.filter(F.col(column).isin(*SOURCE_ALIASES[name]))


def assert_source(df: DataFrame, name: str, column: str = "source") -> DataFrame:
    """df itself; raises if any row's source isn't the one expected. Null isn't."""
    bad = df.filter(~F.coalesce(F.col(column).isin(*SOURCE_ALIASES.get(name, (name,))), F.lit(False)))
    if n := bad.count():
        found = [r[0] for r in bad.select(column).distinct().limit(SAMPLES).collect()]
        raise SourceMismatchError(f"{n} rows aren't from {name}", count=n, found=[str(x) for x in found])
    return df


def snapshot(obs: DataFrame, climate: DataFrame, stations: DataFrame, day: date, as_of: TimePoint, *, cli_hours: int = 10) -> DataFrame:
    """One row per station: what was known of a settlement day at an instant.

    station_code, settlement_date, as_of, obs (array of structs in time order), obs_count, latest, climate (struct or null)
    and climate_reason: 'available', 'not yet published' or 'no record'. A day's rows of one station are few, so they may
    be gathered. stations: code, lst_offset_seconds.
    """
    d = F.lit(day)
    dim = F.broadcast(stations.select(F.col("code").alias("station_code"), "lst_offset_seconds"))
    start, stop = settlement_start(d, F.col("lst_offset_seconds")), settlement_end(d, F.col("lst_offset_seconds"))
    seen = obs.join(dim, "station_code").filter((F.col("observed_at") >= start) & (F.col("observed_at") <= as_of.column()) & (F.col("observed_at") < stop))
    fields = [c for c in obs.columns if c != "station_code"]
    rows = seen.groupBy("station_code").agg(F.sort_array(F.collect_list(F.struct("observed_at", *[c for c in fields if c != "observed_at"]))).alias("obs"), F.count(F.lit(1)).alias("obs_count"), F.max("observed_at").alias("latest"))
    rank = priority("report_type", REPORT_PRIORITY, -1.0)
    best = priority_dedup(climate.filter(F.col("observation_date") == d), ["station_code"], [-rank]).select("station_code", F.struct(*[c for c in climate.columns if c != "station_code"]).alias("climate"))
    out = dim.join(rows, "station_code", "left").join(best, "station_code", "left")
    published = as_of.column() >= cli_available_at(d, F.col("lst_offset_seconds"), cli_hours)
    return out.select(
        "station_code",
        d.alias("settlement_date"),
        as_of.column().alias("as_of"),
        "obs",
        F.coalesce("obs_count", F.lit(0)).alias("obs_count"),
        "latest",
        F.when(published, F.col("climate")).alias("climate"),
        F.when(~published, "not yet published").when(F.col("climate").isNull(), "no record").otherwise("available").alias("climate_reason"),
    )
