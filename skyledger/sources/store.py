"""The partitioned Parquet store of observations, climate, forecasts and trades."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CacheError
from ..functions.parsing import ISSUER, STATION_CODE, TICKER

VERSION = "v1"
LAYOUTS = {
    "observations": ["station_code", "year", "month"],
    "climate": ["station_code", "year"],
    "forecasts": ["station_code", "source", "model", "year", "month"],
    "trades": ["issuer", "ticker", "year", "month"],
    "qc": ["station_code", "year", "month"],
}
_NAMES = {"station_code": STATION_CODE, "issuer": ISSUER, "ticker": TICKER}
_TIME = {"observations": "observed_at", "climate": "observation_date", "forecasts": "valid_at", "trades": "ts", "qc": "observed_at"}


LIVE_HOURS = 168


def live_overlaps(year: int, month: int, now: datetime) -> bool:
    """Whether a month reaches into the last 168 hours, which the live feed still has."""
    first = datetime(year, month, 1, tzinfo=UTC)
    after = datetime(year + month // 12, month % 12 + 1, 1, tzinfo=UTC)
    return first <= now and after > now - timedelta(hours=LIVE_HOURS)


def check_name(column: str, value) -> None:
    """Raises for a value that may not name a folder of a partition."""
    pattern = _NAMES.get(column)
    if pattern and not re.match(pattern.replace(r"\z", r"\Z"), str(value)):
        raise CacheError(f"{value!r} can't be a {column}", column=column)


class Store:
    """Tables below root/<kind>/<version>. The version is part of the path, so rows of another layout are never read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, kind: str) -> str:
        if kind not in LAYOUTS:
            raise CacheError(f"no table {kind!r}", known=sorted(LAYOUTS))
        return f"{self.root}/{kind}/{VERSION}"

    def read(self, kind: str, *, start: datetime | None = None, stop: datetime | None = None, **equal) -> DataFrame:
        """Rows by partition columns and a half-open window. The window also bounds year and month, so other partitions aren't listed into the scan."""
        df = self.spark.read.option("recursiveFileLookup", "false").parquet(self.path(kind))
        for k, v in equal.items():
            for one in v if isinstance(v, (list, tuple, set)) else [v]:
                check_name(k, one)
            df = df.filter(F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
        parts = LAYOUTS[kind]
        at = F.to_timestamp(_TIME[kind])
        number = F.col("year") * 12 + F.col("month") if "month" in parts else F.col("year") * 12
        if start is not None:
            df = df.filter(number >= (start.year * 12 + (start.month if "month" in parts else 0))).filter(at >= F.lit(start))
        if stop is not None:
            df = df.filter(number <= (stop.year * 12 + (stop.month if "month" in parts else 0))).filter(at < F.lit(stop))
        return df

    def write(self, kind: str, df: DataFrame, now: datetime | None = None, lst_offset_seconds: int = 0) -> None:
        """Replaces the partitions that df has rows for. Rows of the current month (year) of standard time are still changing and aren't stored, nor are rows of live and seamless sources."""
        now = (now or datetime.now(UTC)) + timedelta(seconds=lst_offset_seconds)
        parts, at = LAYOUTS[kind], F.to_timestamp(_TIME[kind])
        rows = df.withColumn("year", F.year(at))
        closed = F.col("year") < now.year
        if "month" in parts:
            rows = rows.withColumn("month", F.month(at))
            closed = closed | ((F.col("year") == now.year) & (F.col("month") < now.month))
        rows = rows.filter(closed)
        if "source" in rows.columns:
            rows = rows.filter(~F.coalesce(F.col("source").rlike(r"(\.live|seamless)$"), F.lit(False)))
        rows.repartition(*[F.col(p) for p in parts]).sortWithinPartitions(*parts, _TIME[kind]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(self.path(kind))

    def invalidate(self, kind: str, **equal) -> bool:
        """Deletes one partition, named by all its columns; whether there was one."""
        parts = LAYOUTS[kind]
        if set(equal) != set(parts):
            raise CacheError("a partition is named by all its columns", columns=parts)
        for k, v in equal.items():
            check_name(k, v)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(kind) + "".join(f"/{p}={equal[p]}" for p in parts))
        return bool(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
