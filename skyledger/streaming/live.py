"""Live observations as streams: the newest row of each station, changes only, and running settlement days."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import NoLiveDataError, UnknownSourceError
from ..functions.parsing import STATION_CODE

#: The shortest time between polls of a feed in seconds, and how its rows are tagged.
CADENCE = {"awc": 30, "iem": 60}
TAGS = {"awc": "awc.live", "iem": "iem.live"}


def check_request(source: str, cadence: float, station: str) -> dict:
    """Checks a request before the first poll; the trigger to use."""
    import re

    if source not in CADENCE:
        raise UnknownSourceError(f"no live source {source!r}", known=sorted(CADENCE))
    if isinstance(cadence, bool) or not isinstance(cadence, (int, float)):
        raise TypeError("the cadence is a number of seconds")
    if cadence < CADENCE[source]:
        raise ValueError(f"{source} may be polled every {CADENCE[source]} s at most")
    if not re.match(STATION_CODE.replace(r"\z", r"\Z"), station):
        raise ValueError(f"{station!r} is no station code")
    return {"processingTime": f"{cadence:g} seconds"}


def tagged(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(TAGS[source]))


def read_files(spark: SparkSession, path: str, schema, fmt: str = "json", **options) -> DataFrame:
    """A stream of files that pollers drop into a folder."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def latest(df: DataFrame, station: str = "station_code", at: str = "observed_at") -> DataFrame:
    """The newest row of each station; of a METAR and a SPECI at one time the SPECI. An aggregate, so nothing is sorted."""
    rest = [c for c in df.columns if c != station]
    rank = F.struct(F.col(at), (F.col("observation_type") == "SPECI").cast("int"), F.xxhash64(*rest))
    best = df.filter(F.col(at).isNotNull()).groupBy(station).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return best.select(station, "_row.*").select(*df.columns)


def latest_one(df: DataFrame, station: str) -> dict:
    row = latest(df.filter(F.col("station_code") == station)).first()
    if row is None:
        raise NoLiveDataError(f"nothing from {station}", station=station)
    return row.asDict()


def write_latest(stream: DataFrame, sink: Callable[[DataFrame, int], None], **trigger):
    """Starts a query that gives ``sink`` the newest row of each station of every micro-batch, with the batch's number; a sink that keeps the number is safe against a batch that comes twice."""
    return stream.writeStream.foreachBatch(lambda batch, k: sink(latest(batch), k)).trigger(**trigger)


def changes(df: DataFrame, station: str = "station_code", at: str = "observed_at", seq: str = "seq") -> DataFrame:
    """Rows whose time differs from the row before in order of arrival (seq): an older time is a change, too; a second row of the same time isn't. The batch form of changes_stream()."""
    before = F.lag(at).over(Window.partitionBy(station).orderBy(seq))
    return df.withColumn("_before", before).filter(~F.col(at).eqNullSafe(F.col("_before"))).drop("_before")


def changes_stream(df: DataFrame, station: str = "station_code", at: str = "observed_at", seq: str = "seq") -> DataFrame:
    """changes() over a stream: the state of a station is the last time it yielded."""
    names, schema = df.columns, df.schema

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for part in sorted((p.sort_values(seq, kind="stable") for p in parts), key=lambda p: p[seq].iloc[0]):
            stamp = part[at].astype("int64") if str(part[at].dtype).startswith("datetime") else part[at]
            new = stamp.ne(stamp.shift(1))
            new.iloc[0] = last is None or str(stamp.iloc[0]) != last
            last = str(stamp.iloc[-1])
            out.append(part[new])
        state.update((last,))
        yield pd.concat(out)[names]

    return df.groupBy(station).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def settlement_days(df: DataFrame, offset_seconds: int, late: str = "2 hours", at: str = "observed_at") -> DataFrame:
    """Running daily extremes of a stream by settlement day of one standard time: a tumbling day that starts at the offset, closed when the watermark passes it."""
    shift = f"{(-offset_seconds) % 86400} seconds"
    days = df.withWatermark(at, late).groupBy("station_code", F.window(at, "1 day", "1 day", shift))
    out = days.agg(F.max("temp_f").alias("high_f"), F.min("temp_f").alias("low_f"), F.count(F.lit(1)).alias("rows"))
    return out.select("station_code", F.to_date(F.col("window.start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(offset_seconds).cast("decimal(18,6)"))).alias("date"), "high_f", "low_f", "rows")
