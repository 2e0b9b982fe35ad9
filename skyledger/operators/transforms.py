"""Feature transforms over a partition (a station) in a total order. Each returns df with one more column, or several."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import weather

#: Physical bounds by column.
PHYSICS_BOUNDS = {
    "temp_c": (-89.0, 57.0),
    "dew_point_c": (-89.0, 35.0),
    "dewpoint_c": (-89.0, 35.0),
    "wind_speed_ms": (0.0, 100.0),
    "wind_speed_kt": (0.0, 200.0),
    "wind_dir_deg": (0.0, 360.0),
    "wind_dir_degrees": (0.0, 360.0),
    "slp_hpa": (870.0, 1085.0),
    "sea_level_pressure_mb": (870.0, 1085.0),
    "relative_humidity_pct_2m": (0.0, 100.0),
    "precip_mm_1h": (0.0, 305.0),
}
FEATURES = ("lag", "diff", "diff2", "rolling", "calendar_features", "spread", "wind_chill", "heat_index", "clip_outliers", "clip_sigma")


def _over(partition_by: list[str], order_by: list[str]):
    return Window.partitionBy(*partition_by).orderBy(*order_by)


def _by_chunk(df: DataFrame, reach: int, make: Callable[[DataFrame, list[str]], DataFrame], partition_by: list[str], order_by: list[str], chunk: str | None) -> DataFrame:
    """make(df, partition_by), whose windows reach ``reach`` rows back (or ahead, if negative).

    With a chunk (month, week, ...; of the first column of order_by) the partitions are cut by time, so that a task gets one
    chunk of a station and not its whole history: rows that a chunk's windows reach beyond its edge are copied into it and
    left out of the result. What is ordered by station then are lists of so many rows for each chunk.
    """
    if chunk is None or reach == 0:
        return make(df, partition_by)
    n, names = abs(reach), df.columns
    rows = df.withColumn("_chunk", F.date_trunc(chunk, F.col(order_by[0]).cast("timestamp"))).withColumn("_copied", F.lit(False))
    edge = [F.col(o).desc_nulls_last() if reach > 0 else F.col(o).asc_nulls_first() for o in order_by]
    ends = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*partition_by, "_chunk").orderBy(*edge))).filter(F.col("_place") <= n)
    row = F.struct(*[F.col(o).alias(f"o{k}") for k, o in enumerate(order_by)], F.struct(*[F.col(c) for c in names]).alias("row"))
    lists = ends.groupBy(*partition_by, "_chunk").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    # each chunk has a row at least, so the n chunks beside it hold enough
    beside = Window.partitionBy(*partition_by).orderBy("_chunk").rowsBetween(*((-n, -1) if reach > 0 else (1, n)))
    near = F.flatten(F.collect_list("_rows").over(beside))
    near = F.when(F.size(near) <= n, near).otherwise(F.slice(near, -n if reach > 0 else 1, n))
    copies = lists.withColumn("_near", near).select("_chunk", F.explode("_near").alias("_r")).select("_r.row.*", "_chunk", F.lit(True).alias("_copied"))
    return make(rows.unionByName(copies), [*partition_by, "_chunk"]).filter("NOT _copied").drop("_chunk", "_copied")


def lag(df: DataFrame, column: str, n: int = 1, *, partition_by: list[str], order_by: list[str], chunk: str | None = None) -> DataFrame:
    """{column}_lag_{n}; a negative n looks ahead. chunk cuts long partitions by time and changes no result."""
    return _by_chunk(df, n, lambda rows, by: rows.withColumn(f"{column}_lag_{n}", F.lag(column, n).over(_over(by, order_by))), partition_by, order_by, chunk)


def diff(df: DataFrame, column: str, n: int = 1, *, partition_by: list[str], order_by: list[str], chunk: str | None = None) -> DataFrame:
    return _by_chunk(df, n, lambda rows, by: rows.withColumn(f"{column}_diff_{n}", F.col(column) - F.lag(column, n).over(_over(by, order_by))), partition_by, order_by, chunk)


def diff2(df: DataFrame, column: str, *, partition_by: list[str], order_by: list[str], chunk: str | None = None) -> DataFrame:
    """The difference of differences; null in the first two rows."""

    def make(rows: DataFrame, by: list[str]) -> DataFrame:
        w = _over(by, order_by)
        one, two = F.lag(column, 1).over(w), F.lag(column, 2).over(w)
        return rows.withColumn(f"{column}_diff2", (F.col(column) - one) - (one - two))

    return _by_chunk(df, 2, make, partition_by, order_by, chunk)


_ROLLING: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": lambda x: F.percentile(x, F.lit(0.5)),
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "sum": F.sum,
    "count": F.count,
}


def rolling(df: DataFrame, column: str, window: int, fn: str | Callable[[Column], Column] = "mean", *, partition_by: list[str], order_by: list[str], chunk: str | None = None) -> DataFrame:
    """{column}_rolling_{window}_{fn} over the row and the window - 1 before it, from the first value on. fn: mean, median, min, max, std, var, sum, count, or a function from the array of the window's values (nulls left out) to a column. chunk cuts long partitions by time and changes no result."""
    if window < 1:
        raise ValueError("window must be 1 or more")
    if isinstance(fn, str) and fn not in _ROLLING:
        raise ValueError(f"no rolling function {fn!r}; known: {sorted(_ROLLING)}")

    def make(rows: DataFrame, by: list[str]) -> DataFrame:
        over = _over(by, order_by).rowsBetween(1 - window, 0)
        if isinstance(fn, str):
            return rows.withColumn(f"{column}_rolling_{window}_{fn}", _ROLLING[fn](F.col(column)).over(over))
        return rows.withColumn(f"{column}_rolling_{window}_{getattr(fn, '__name__', 'fn').strip('<>')}", fn(F.collect_list(column).over(over)))

    return _by_chunk(df, window - 1, make, partition_by, order_by, chunk)


def calendar_features(df: DataFrame, column: str, tz: str | None = None) -> DataFrame:
    """Sine and cosine of month, day of week (Monday 0), hour and day of year; tz moves the clock first."""
    at = F.col(column).cast("timestamp")
    at = F.from_utc_timestamp(at, F.lit(tz)) if tz else at
    parts = {"month": F.month(at) / F.lit(12.0), "dow": F.weekday(at) / F.lit(7.0), "hour": F.hour(at) / F.lit(24.0), "day_of_year": F.dayofyear(at) / F.lit(365.0)}
    out = {}
    for name, turn in parts.items():
        out[f"{name}_sin"], out[f"{name}_cos"] = F.sin(F.lit(2 * math.pi) * turn), F.cos(F.lit(2 * math.pi) * turn)
    return df.withColumns(out)


def spread(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn(f"{a}_minus_{b}", F.col(a) - F.col(b))


def wind_chill(df: DataFrame, temp_f: str, wind_mph: str) -> DataFrame:
    return df.withColumn("wind_chill_f", weather.wind_chill(temp_f, wind_mph))


def heat_index(df: DataFrame, temp_f: str, rh: str) -> DataFrame:
    return df.withColumn("heat_index_f", weather.heat_index(temp_f, rh))


def _clamp(x: Column, low: Column, high: Column) -> Column:
    # greatest and least skip nulls, so a null value and null bounds are kept apart here
    return F.when(x.isNull() | low.isNull() | high.isNull(), x).otherwise(F.greatest(low, F.least(high, x)))


def clip_sigma(df: DataFrame, column: str, std: float = 3.0, *, partition_by: list[str] | None = None) -> DataFrame:
    """{column}_clipped to mean ± std sample deviations, of all rows or of each partition. With one value nothing is clipped. The bounds are an aggregate joined back, one row per partition."""
    keys = partition_by or []
    stats = df.groupBy(*keys).agg(F.avg(column).alias("_mu"), F.stddev_samp(column).alias("_sigma"))
    joined = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))  # one row
    low, high = F.col("_mu") - std * F.col("_sigma"), F.col("_mu") + std * F.col("_sigma")
    return joined.withColumn(f"{column}_clipped", _clamp(F.col(column), low, high)).drop("_mu", "_sigma")


def clip_outliers(df: DataFrame, column: str, *, bounds: tuple[float, float] | None = None, std: float = 3.0, partition_by: list[str] | None = None) -> DataFrame:
    """{column}_clipped to the bounds given, else to the column's physical bounds, else as clip_sigma()."""
    if column not in df.columns:
        raise KeyError(column)
    bounds = bounds or PHYSICS_BOUNDS.get(column)
    if bounds is None:
        if std <= 0:
            raise ValueError("std must be above 0")
        return clip_sigma(df, column, std, partition_by=partition_by)
    return df.withColumn(f"{column}_clipped", _clamp(F.col(column), F.lit(bounds[0]), F.lit(bounds[1])))
