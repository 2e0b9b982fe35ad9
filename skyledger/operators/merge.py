"""Deduplication by priority.

The winner of a key is an aggregate, the smallest struct of what orders the rows, so partial aggregation runs before the
shuffle: at most one row of a key leaves a partition, and no key's rows are gathered. As a struct isn't updated in place,
the aggregation sorts its partition by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Priorities of sources and of report types.
SOURCE_PRIORITY = {"awc": 3.0, "iem": 2.0, "ghcnh": 1.0}
POLICY_PRIORITY = SOURCE_PRIORITY | {"ncei": 0.0}
REPORT_PRIORITY = {"final": 3.0, "ncei_final": 2.5, "correction": 2.0, "preliminary": 1.0, "estimated": 0.0}


def priority(x: Column | str, table: dict[str, float], missing: float) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    out = F.lit(missing)
    for name, value in table.items():
        out = F.when(x == name, F.lit(value)).otherwise(out)
    return out


def nulls_last(x: str) -> list[Column]:
    """In a struct that is ordered: rows with a null come after the others."""
    return [F.col(x).isNull(), F.col(x)]


def priority_dedup(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, all columns: the first by ``order`` (ascending; negate for descending), then by all columns, so any partitioning gives the same rows. Null keys are keys."""
    rest = [c for c in df.columns if c not in keys]
    whole = F.struct(*[F.col(c) for c in rest])
    rank = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], *[x.alias(f"t{k}_{j}") for k, c in enumerate(rest) for j, x in enumerate(nulls_last(c))])
    best = df.groupBy(*keys).agg(F.min_by(whole, rank).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of several sources or cycles, columns by name; what a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_observations(df: DataFrame) -> DataFrame:
    """One row per (station_code, observed_at, observation_type): the live feed before the archive before the climatology; unknown sources last; ties by source, then by all columns."""
    return priority_dedup(df, ["station_code", "observed_at", "observation_type"], [-priority("source", SOURCE_PRIORITY, 0.0), *nulls_last("source")])


def query_time_merge(df: DataFrame, priorities: dict[str, float] = POLICY_PRIORITY) -> DataFrame:
    """Silver to gold: one row per (station_code, observed_at) by policy priority (unknown -1), then the earliest receipt, then the ingestion id; nulls last; missing columns are skipped."""
    order = [-priority("source", priorities, -1.0)]
    for c in ("source_received_at", "ingestion_id"):
        if c in df.columns:
            order += nulls_last(c)
    return priority_dedup(df, ["station_code", "observed_at"], order)


def merge_climate(df: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per (station_code, observation_date): the highest report_type_priority (missing counts 0), then the first by ``seq`` where given."""
    order = [-F.coalesce(F.col("report_type_priority"), F.lit(0.0))] + (nulls_last(seq) if seq else [])
    return priority_dedup(df, ["station_code", "observation_date"], order)


def dedup_climate_reports(df: DataFrame, station: str = "station_code", day: str = "observation_date") -> DataFrame:
    """As merge_climate with priorities recomputed from report_type (missing: preliminary); rows without a key are dropped."""
    rows = df.filter(F.col(station).isNotNull() & F.col(day).isNotNull())
    rank = priority(F.coalesce(F.col("report_type"), F.lit("preliminary")), REPORT_PRIORITY, 0.0)
    return priority_dedup(rows, [station, day], [-rank])


def dedup_first_seen(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row by ``seq`` of each key; null and blank keys are dropped."""
    rows = df.filter(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "")
    return priority_dedup(rows, [key], nulls_last(seq))
