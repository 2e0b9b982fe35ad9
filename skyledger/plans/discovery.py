"""What is in the store and what the library offers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import spine
from ..operators.transforms import FEATURES
from ..schemas import lookup
from ..stations import REGISTRY, Registry


def availability(obs: DataFrame, station: str = "station_code", at: str = "observed_at") -> DataFrame:
    """Per station: rows, first, last, months that have rows, and years."""
    month = F.date_format(F.col(at), "yyyy-MM")
    by_month = obs.groupBy(F.col(station).alias("station"), month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
    return by_month.groupBy("station").agg(F.sum("n").alias("rows"), F.min("a").alias("first"), F.max("b").alias("last"), F.count("month").alias("months"), F.countDistinct(F.substring("month", 1, 4)).alias("years"))


def climate_gaps(climate: DataFrame, stations: DataFrame, start: date, stop: date, *, by_year: bool = False) -> DataFrame:
    """station, date of the days without a report; by_year: only days of years without any."""
    every = F.broadcast(stations.select(F.col("code").alias("station"))).crossJoin(spine(climate.sparkSession, start, stop))
    have = climate.select(F.col("station_code").alias("station"), F.col("observation_date").alias("date")).distinct()
    if by_year:
        have = have.select("station", F.year("date").alias("y")).distinct()
        return every.withColumn("y", F.year("date")).join(have, ["station", "y"], "left_anti").drop("y")
    return every.join(have, ["station", "date"], "left_anti")


def describe(spark: SparkSession, schema_id: str) -> DataFrame:
    """One row per column of a registered schema."""
    rows = [(k, c.name, c.kind, c.units, c.nullable, list(c.values)) for k, c in enumerate(lookup(schema_id).columns)]
    return spark.createDataFrame(rows, "position int, name string, kind string, units string, nullable boolean, allowed array<string>")


def feature_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f,) for f in FEATURES], "feature string")


def discover(spark: SparkSession, cities: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """One row per city and station that settles it: city, station, icao, settles_for (issuers, sorted). cities: city, issuer, icao."""
    dim = F.broadcast(registry.table(spark).select("code", "icao"))
    found = cities.groupBy("city", "icao").agg(F.sort_array(F.collect_set("issuer")).alias("settles_for"))
    return found.join(dim, "icao", "left").select("city", F.coalesce("code", "icao").alias("station"), "icao", "settles_for")


def settles_for(cities: DataFrame) -> DataFrame:
    """The issuers that settle by each station: icao, settles_for."""
    return cities.groupBy("icao").agg(F.sort_array(F.collect_set("issuer")).alias("settles_for"))
