"""Nearest point of a forecast grid for each station.

Stations look only into cells around their own: the grid is keyed by cells of ``cell`` degrees, and a station is copied to
the cells of its neighbourhood, so the join is an equi-join however large the grid. Stations without a grid point in the
neighbourhood (outside the domain) are compared with one point of each cell first, of which there are a fixed number at
most, and then by an equi-join with the cells that could hold a nearer one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def wrap_longitude(x) -> Column:
    """Longitudes of 0 to 360 as -180 to 180."""
    x = F.col(x) if isinstance(x, str) else x
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def nearest_grid(stations: DataFrame, grid: DataFrame, *, station: str = "station_code", point: list[str] | None = None, cell: float = 1.0) -> DataFrame:
    """stations with their nearest grid point: the point's key columns, grid_lat, grid_lon and grid_dist_km; ties go to the smallest key.

    stations: station, latitude, longitude. grid: point's columns (default iy, ix), lat, lon.
    """
    point = point or ["iy", "ix"]
    s = stations.select(station, "latitude", wrap_longitude("longitude").alias("longitude"))
    g = grid.select(*point, F.col("lat").alias("grid_lat"), wrap_longitude("lon").alias("grid_lon"))
    n = math.ceil(360 / cell)
    reach = F.least(F.lit(n // 2), F.ceil(1.0 / F.greatest(F.cos(F.radians("latitude")), F.lit(0.01))).cast("int"))  # cells shrink towards the poles
    near = s.withColumn("_y", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.floor(F.col("latitude") / cell) + k)))
    near = near.withColumn("_x", F.explode(F.transform(F.sequence(-reach, reach), lambda k: F.pmod(F.floor((F.col("longitude") + 180) / cell) + k, F.lit(n))))).distinct()
    cells = g.withColumn("_y", F.floor(F.col("grid_lat") / cell)).withColumn("_x", F.pmod(F.floor((F.col("grid_lon") + 180) / cell), F.lit(n)))
    distance = haversine_km(F.col("latitude"), F.col("longitude"), F.col("grid_lat"), F.col("grid_lon"))
    best = F.min(F.struct(distance.alias("grid_dist_km"), *point, "grid_lat", "grid_lon")).alias("_best")
    inside = near.join(cells, ["_y", "_x"]).groupBy(station).agg(best)
    # what is found within a cell's height is nearest for certain: the neighbourhood reaches at least as far
    sure = inside.filter(F.col("_best.grid_dist_km") <= cell * math.pi * EARTH_KM / 180 * 0.99)
    left = s.join(sure, station, "left_anti")
    # one point stands for its cell: no other one of the cell is nearer by more than the cell's two sides
    some = cells.groupBy("_y", "_x").agg(F.min(F.struct("grid_lat", "grid_lon")).alias("_p")).select("_y", "_x", "_p.*")
    reached = left.crossJoin(F.broadcast(some)).withColumn("_km", distance)  # (180 / cell + 1) * 360 / cell rows at most
    bound = reached.groupBy(F.col(station).alias("_s")).agg((F.min("_km") + 2 * cell * math.pi * EARTH_KM / 180 * 1.01).alias("_most"))
    could = reached.join(bound, F.col(station) == F.col("_s")).filter("_km <= _most").select(station, "latitude", "longitude", "_y", "_x")
    outside = could.join(cells, ["_y", "_x"]).groupBy(station).agg(best)
    found = sure.unionByName(outside)
    return stations.join(found, station, "left").select(*stations.columns, *[F.col(f"_best.{p}").alias(p) for p in point], F.col("_best.grid_lat").alias("grid_lat"), F.col("_best.grid_lon").alias("grid_lon"), F.col("_best.grid_dist_km").alias("grid_dist_km"))
