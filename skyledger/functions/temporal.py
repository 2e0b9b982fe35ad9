"""Settlement days, market times, forecast cycles and points in time.

A settlement day runs from midnight to midnight of local standard time; a local day follows the station's clock with
daylight saving. The two have functions of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from functools import total_ordering

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelError, TimePointError
from .parsing import col

CLOSE_HOUR, CLOSE_MINUTE, CLI_DELAY_HOURS = 16, 30, 10


def seconds(n) -> Column:
    """A day-time interval of n seconds."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), col(n).cast("decimal(18,6)") if not isinstance(n, int) else F.lit(n).cast("decimal(18,6)"))


def settlement_date(ts, offset) -> Column:
    """The day of local standard time that holds ts; offset in seconds."""
    return F.to_date(col(ts) + seconds(offset))


def settlement_start(day, offset) -> Column:
    return col(day).cast("timestamp") - seconds(offset)


def settlement_end(day, offset) -> Column:
    return settlement_start(day, offset) + F.expr("INTERVAL 24 HOURS")


def market_close(day, offset) -> Column:
    """16:30 local standard time as UTC."""
    return settlement_start(day, offset) + F.expr(f"INTERVAL '{CLOSE_HOUR}:{CLOSE_MINUTE:02d}' HOUR TO MINUTE")


def cli_available_at(day, offset, hours: int = CLI_DELAY_HOURS) -> Column:
    return settlement_end(day, offset) + F.expr(f"INTERVAL {int(hours)} HOURS")


def local_date(ts, tz) -> Column:
    """The date on the station's own clock; tz is an IANA name (column or string)."""
    return F.to_date(F.from_utc_timestamp(col(ts), tz if isinstance(tz, Column) else F.lit(tz)))


def local_end_of_day(day, tz) -> Column:
    """23:59:59 of the station's clock as UTC."""
    return F.to_utc_timestamp(col(day).cast("timestamp") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"), tz if isinstance(tz, Column) else F.lit(tz))


def local_midnight(day, tz) -> Column:
    return F.to_utc_timestamp(col(day).cast("timestamp"), tz if isinstance(tz, Column) else F.lit(tz))


def slug_date(slug) -> Column:
    """The last YYYY-MM-DD in a slug; null if there is none or it is no date."""
    found = F.regexp_extract_all(F.coalesce(col(slug), F.lit("")), F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0))
    return F.try_to_date(F.try_element_at(found, F.lit(-1)), "yyyy-MM-dd")


def spine(spark: SparkSession, start: date, stop: date, name: str = "date") -> DataFrame:
    """Every day from start to stop, both included; no row if stop is before start."""
    days = (stop - start).days + 1
    base = spark.range(max(0, days)).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias(name))
    return base


def months(start: date, stop: date) -> list[tuple[int, int]]:
    """(year, month) from start to stop, both included."""
    out, at = [], (start.year, start.month)
    while at <= (stop.year, stop.month):
        out.append(at)
        at = (at[0] + at[1] // 12, at[1] % 12 + 1)
    return out


def years(start: date, stop: date) -> list[tuple[date, date]]:
    """Chunks of a calendar year that cover start to stop."""
    return [(max(start, date(y, 1, 1)), min(stop, date(y, 12, 31))) for y in range(start.year, stop.year + 1)]


def utc_envelope(start: date, stop: date, offset_seconds: int) -> tuple[datetime, datetime]:
    """[first, last) UTC instants of the settlement days from start to stop, for pruning partitions before a scan."""
    shift = timedelta(seconds=offset_seconds)
    return datetime(start.year, start.month, start.day, tzinfo=UTC) - shift, datetime(stop.year, stop.month, stop.day, tzinfo=UTC) + timedelta(days=1) - shift


# -- forecast cycles


def floor_to_cycle(ts, hours: tuple[int, ...]) -> Column:
    """The last cycle hour of the day at or before ts; before the day's first one, the last of the day before."""
    if not hours or not all(0 <= h < 24 for h in hours):
        raise ModelError("cycle hours must lie in 0..23", hours=list(hours))
    day = F.date_trunc("day", col(ts))
    ordered = sorted(hours)
    past = F.array_max(F.filter(F.array(*map(F.lit, ordered)), lambda h: h <= F.hour(col(ts))))
    return F.when(past.isNotNull(), day + seconds(past * 3600)).otherwise(day - F.expr("INTERVAL 1 DAY") + seconds(ordered[-1] * 3600))


def issued_at_previous_day(valid_at, n: int, hours: tuple[int, ...]) -> Column:
    """A bound from below of when a forecast n days ahead (1 to 7) was issued."""
    if not 1 <= n <= 7:
        raise ModelError("days ahead must lie in 1..7", n=n)
    return floor_to_cycle(col(valid_at) - F.expr(f"INTERVAL {24 * n} HOURS"), hours)


def issued_at_live(now, publish_lag_minutes: int, hours: tuple[int, ...]) -> Column:
    return floor_to_cycle(col(now) - F.expr(f"INTERVAL {int(publish_lag_minutes)} MINUTES"), hours)


def cycle_range(spark: SparkSession, start: datetime, stop: datetime, hours: tuple[int, ...]) -> DataFrame:
    """cycle: every full hour from start (rounded up) to stop whose hour is allowed."""
    first = start if not (start.minute or start.second or start.microsecond) else start.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1)
    n = max(0, int((stop - first).total_seconds() // 3600) + 1) if stop >= first else 0
    every = spark.range(n).select((F.lit(first).cast("timestamp") + seconds(F.col("id") * 3600)).alias("cycle"))
    return every.filter(F.hour("cycle").isin(*hours))


def default_cycle(now: datetime, fxx: int, hours: tuple[int, ...], latency_minutes: int = 90) -> datetime:
    """The latest cycle for which the hour that is fxx hours ahead lay latency_minutes back or more at now."""
    at = (now - timedelta(minutes=latency_minutes, hours=fxx)).replace(minute=0, second=0, microsecond=0)
    for k in range(24):
        if (c := at - timedelta(hours=k)).hour in hours:
            return c
    raise ModelError("a model needs a cycle hour", hours=list(hours))


#: Fixed value: the day from which the blend's runs start at 0, 6, 12 and 18 instead of 1, 7, 13 and 19.
BLEND_CHANGE = date(2026, 5, 5)


def mos_hours(model: str, start: date, stop: date) -> tuple[int, ...]:
    """Run hours of a station-guidance model in a window; both sets where the window spans the change."""
    if model.lower() not in MOS_MODELS:
        raise ModelError(f"no model {model!r}", models=sorted(MOS_MODELS))
    if model.lower() != "nbe":
        return (0, 6, 12, 18)
    early, late = (1, 7, 13, 19), (0, 6, 12, 18)
    return tuple(sorted((early if start < BLEND_CHANGE else ()) + (late if stop >= BLEND_CHANGE else ())))


MOS_MODELS = frozenset({"nbe", "gfs", "lav", "met", "ecm"})


@total_ordering
@dataclass(frozen=True)
class TimePoint:
    """A UTC instant. Naive datetimes, bare dates and null times are refused."""

    at: datetime

    def __post_init__(self) -> None:
        if not isinstance(self.at, datetime):
            raise TimePointError(f"{self.at!r} is no instant")
        if self.at != self.at or self.at.tzinfo is None or self.at.utcoffset() is None:
            raise TimePointError(f"{self.at!r} has no time zone")
        object.__setattr__(self, "at", self.at.astimezone(UTC))

    @classmethod
    def parse(cls, text: str) -> TimePoint:
        if not isinstance(text, str) or "T" not in text.upper().replace(" ", "T"):
            raise TimePointError(f"{text!r} is no instant")
        try:
            return cls(datetime.fromisoformat(text.replace("Z", "+00:00")))
        except ValueError as bad:
            raise TimePointError(f"{text!r} is no instant") from bad

    def __lt__(self, other: TimePoint) -> bool:
        return self.at < other.at

    def column(self) -> Column:
        return F.lit(self.at).cast("timestamp")

    def iso(self) -> str:
        return self.at.strftime("%Y-%m-%dT%H:%M:%SZ")
