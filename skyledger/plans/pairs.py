"""The flagship plan: one row per station and settlement day, observations beside the settlement report and the forecast that was known."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import market_close, settlement_date, settlement_end, settlement_start, spine, utc_envelope
from ..functions.units import finite
from .. import __version__
from ..operators.aggregates import OBS_AGGREGATES, best_run, content_hash, nwp_aggregates, obs_aggregates, run_aggregates, series_aggregates, version_of
from ..operators.asof import pin_source
from ..operators.merge import merge_climate, merge_observations
from ..operators.qc import apply_qc, crosscheck_by_source, qc_summary, sidecar, to_qc_columns
from ..sources.store import Store
from ..stations import REGISTRY, Registry

#: A request of more days than this reads the merged store; fewer may read what was fetched for them. The plan is the same.
EXACT_WINDOW_DAYS = 90
_FORECAST = {"fcst_high_f": "double", "fcst_low_f": "double", "fcst_model": "string", "fcst_issued_at": "timestamp", "fcst_pop_6hr_pct": "double", "fcst_qpf_6hr_in": "double"}


@dataclass(frozen=True)
class Result:
    """A frame with where it came from."""

    frame: DataFrame
    source: str
    schema_id: str
    retrieved_at: datetime = field(default_factory=lambda: datetime.now(UTC))
    qc: DataFrame | None = None
    sidecar: DataFrame | None = None
    notes: dict[str, Any] = field(default_factory=dict)
    make_version: Callable[[], str] | None = None

    @cached_property
    def data_version(self) -> str | None:
        """16 hex digits that stand for release, schemas, sources, request and data; found by one pass over the data when first asked for."""
        return self.make_version() if self.make_version else None


def day_rows(obs: DataFrame, dim: DataFrame, start: date, stop: date) -> DataFrame:
    """Observations of the settlement days from start to stop with their day. A plain bound on observed_at comes first, so that a scan can skip files and row groups."""
    first = min(utc_envelope(start, stop, s)[0] for s in (-43200, 50400))
    last = max(utc_envelope(start, stop, s)[1] for s in (-43200, 50400))
    rows = obs.filter((F.col("observed_at") >= F.lit(first)) & (F.col("observed_at") < F.lit(last)))
    rows = rows.join(dim, "station_code").withColumn("date", settlement_date("observed_at", F.col("lst_offset_seconds")))
    return rows.filter(F.col("date").between(F.lit(start), F.lit(stop)))


def pairs(obs: DataFrame, climate: DataFrame | None, stations: DataFrame, start: date, stop: date, *, forecasts: DataFrame | None = None, nwp: DataFrame | None = None, nwp_models: list[str] | None = None, model: str | None = None, nwp_as_of_close: bool = False, merged: bool = False) -> DataFrame:
    """One row for each station of ``stations`` and each day, even without any input.

    obs: storage rows with observed_at as a timestamp. climate: CLIMATE rows with observation_date as a date. stations: code,
    lst_offset_seconds. forecasts: station_code, issued_at (null for a series), valid_at, model, temperature_f, pop_6hr_pct,
    qpf_6hr_in, temperature_c, precipitation_probability_pct; a run belongs to the day of each valid_at. nwp: station_code,
    cycle, valid_at, model, temp_k_2m. All sides are aggregated to the day before they meet, so the joins are small.

    A series supplies high, low, model and chance where the run has no high; the run's issue time and precipitation stay,
    as consumers of the original table expect. nwp columns know no as-of time unless nwp_as_of_close.
    """
    spark = obs.sparkSession
    dim = F.broadcast(stations.select(F.col("code").alias("station_code"), "lst_offset_seconds"))  # a registry is small
    every = dim.crossJoin(spine(spark, start, stop))  # stations x days, the shape of the result
    offset = F.col("lst_offset_seconds")
    keys = ["station_code", "date"]
    # what isn't aggregated is left out before the merge, whose winners are whole rows: so scans read these columns alone
    needed = ["station_code", "observed_at", "observation_type", "source", *(c for c in dict.fromkeys(x for _, x in OBS_AGGREGATES.values()) if c in obs.columns)]
    rows = obs if merged else merge_observations(obs.select(*needed))
    daily = obs_aggregates(day_rows(rows, dim, start, stop), keys)
    out = every.join(daily, keys, "left")
    if climate is not None:
        cli = merge_climate(climate.filter(F.col("observation_date").between(F.lit(start), F.lit(stop))))
        cli = cli.select("station_code", F.col("observation_date").alias("date"), F.col("high_temp_f").alias("cli_high_f"), F.col("low_temp_f").alias("cli_low_f"), F.col("report_type").alias("cli_report_type"))
        out = out.join(cli, keys, "left")
    else:
        out = out.withColumns({"cli_high_f": F.lit(None).cast("int"), "cli_low_f": F.lit(None).cast("int"), "cli_report_type": F.lit(None).cast("string")})
    if forecasts is not None:
        rows = forecasts.join(dim, "station_code").withColumn("date", settlement_date("valid_at", offset)).filter(F.col("date").between(F.lit(start), F.lit(stop)))
        rows = rows.withColumn("market_close_utc", market_close("date", offset)).withColumn("win_start", settlement_start("date", offset)).withColumn("win_end", settlement_end("date", offset))
        run = run_aggregates(best_run(rows, keys, model=model), keys)
        series = series_aggregates(rows.filter(F.col("issued_at").isNull()), keys)
        out = out.join(run, keys, "left").join(series, keys, "left")
        use = F.col("run_high_f").isNull() & F.col("series_model").isNotNull()
        out = out.withColumns(
            {
                "fcst_high_f": F.when(use, F.col("series_high_f")).otherwise(F.col("run_high_f")),
                "fcst_low_f": F.when(use, F.col("series_low_f")).otherwise(F.col("run_low_f")),
                "fcst_model": F.when(use, F.col("series_model")).otherwise(F.col("run_model")),
                "fcst_issued_at": F.col("run_issued_at"),
                "fcst_pop_6hr_pct": F.when(use, F.col("series_pop")).otherwise(F.col("run_pop")),
                "fcst_qpf_6hr_in": F.col("run_qpf"),
            }
        )
    else:
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in _FORECAST.items()})
    more: list[str] = []
    if nwp is not None and nwp_models:
        grid = nwp.join(dim, "station_code").withColumn("date", settlement_date("valid_at", offset))
        grid = grid.withColumn("market_close_utc", market_close("date", offset)).filter(F.col("date").between(F.lit(start), F.lit(stop)))
        wide = nwp_aggregates(grid, keys, nwp_models, "market_close_utc" if nwp_as_of_close else None)
        more = [c for c in wide.columns if c not in keys]
        out = out.join(wide, keys, "left")
    out = out.withColumn("market_close_utc", market_close("date", offset)).withColumn("obs_count", F.coalesce("obs_count", F.lit(0)))
    obs_columns = ["obs_high_f", "obs_low_f", "obs_mean_f", "obs_mean_dewpoint_f", "obs_max_wind_kt", "obs_max_gust_kt", "obs_total_precip_in", "obs_count"]
    return out.select("date", F.col("station_code").alias("station"), "cli_high_f", "cli_low_f", "cli_report_type", *obs_columns, *_FORECAST, *more, "market_close_utc")


#: What a version of research() stands for besides the request and the data.
SCHEMAS = ("schema.forecast.iem_mos.v1", "schema.observation.v1", "schema.settlement.cli.v1")
SOURCES = ("awc.live", "ghcnh", "iem.archive", "iem.live", "nws.cli")


def research_version(stations: list[str], start: date, stop: date, obs: DataFrame, climate: DataFrame | None = None) -> str:
    """The version of a research() request: release, schemas, sources, the request, and the content of the rows that it may read, not the files that hold them."""
    rows = obs.filter(F.col("station_code").isin(*stations))
    data = content_hash(rows, [c for c in ("station_code", "observed_at", "observation_type", "source", *dict.fromkeys(x for _, x in OBS_AGGREGATES.values())) if c in rows.columns])
    if climate is not None:
        data += content_hash(climate.filter(F.col("station_code").isin(*stations)), ["station_code", "observation_date", "report_type", "high_temp_f", "low_temp_f"])
    return version_of(__version__, ",".join(SCHEMAS), ",".join(SOURCES), f"research:{','.join(sorted(stations))}:{start.isoformat()}:{stop.isoformat()}", data)


def research(station: str | list[str], start: date, stop: date, *, obs: DataFrame, climate: DataFrame | None = None, registry: Registry = REGISTRY, source: str | None = None, qc: bool = False, store: Store | None = None, ordered: bool = False, **options) -> Result:
    """pairs() for stations by name, wrapped with its provenance. source pins the observations before they are merged.

    qc adds a summary of the rules over the rows before the merge, which stay as they are, the number of disagreements
    between archive and climatology, and the sidecar's rows; with a store the sidecar is written there, too (months that
    still run aren't). ordered sorts the result by date and station, which a table that is written doesn't need.
    """
    spark = obs.sparkSession
    names = [station] if isinstance(station, str) else station
    chosen = Registry({s.code: s for s in map(registry.get, names)})
    rows = pin_source(obs, source) if source else obs
    rows = rows.filter(F.col("station_code").isin(*chosen.stations))
    summary = hits = None
    if qc:
        marked = apply_qc(to_qc_columns(rows))
        hits = sidecar(marked)
        disagree = crosscheck_by_source(rows).agg(F.count(F.lit(1)).alias("crosscheck_disagreements"))
        summary = qc_summary(marked).crossJoin(F.broadcast(disagree))  # one row each
        if store is not None:
            store.write("qc", hits)
    frame = pairs(rows, climate, chosen.table(spark), start, stop, **options)
    return Result(
        frame.orderBy("date", "station") if ordered else frame,
        source or "merged",
        "pairs.v1",
        qc=summary,
        sidecar=hits,
        notes={"nwp_as_of_close": options.get("nwp_as_of_close", False)},
        make_version=lambda: research_version(sorted(chosen.stations), start, stop, rows, climate),
    )


def obs_rows(station: str | list[str], start: date, stop: date, *, obs: DataFrame, registry: Registry = REGISTRY, source: str | None = None) -> DataFrame:
    """The merged observations themselves of the settlement days from start to stop, all columns of obs and their day as ``date``. source pins them before the merge."""
    names = [station] if isinstance(station, str) else station
    chosen = Registry({s.code: s for s in map(registry.get, names)})
    rows = pin_source(obs, source) if source else obs
    dim = F.broadcast(chosen.table(obs.sparkSession).select(F.col("code").alias("station_code"), "lst_offset_seconds"))  # a registry is small
    return day_rows(merge_observations(rows.filter(F.col("station_code").isin(*chosen.stations))), dim, start, stop).select(*obs.columns, "date")


def obs_daily(station: str | list[str], start: date, stop: date, *, obs: DataFrame, registry: Registry = REGISTRY, source: str | None = None, strategy: str = "auto") -> DataFrame:
    """Daily aggregates of observations alone. strategy (auto, exact_window, warm_cache) is checked and makes no difference to the plan; a source goes with auto or exact_window."""
    if strategy not in ("auto", "exact_window", "warm_cache"):
        raise ValueError(f"no strategy {strategy!r}")
    if source and strategy == "warm_cache":
        raise ValueError("the merged store can't be pinned to a source before the merge; use exact_window")
    frame = research(station, start, stop, obs=obs, registry=registry, source=source).frame
    return frame.select("date", "station", *[c for c in frame.columns if c.startswith("obs_")])


def settlement_consistency(frame: DataFrame, tolerance_f: float = 1.0) -> DataFrame:
    """pairs() with cli_metar_delta_f (report minus observed high) and settlement_consistent (within the tolerance)."""
    delta = F.col("cli_high_f") - finite("obs_high_f")
    return frame.withColumn("cli_metar_delta_f", delta).withColumn("settlement_consistent", F.abs(delta) <= tolerance_f)


def in_bracket(value: str, low: str, high: str):
    """Whether a value lies in [low, high); a null bound is open."""
    v = F.col(value)
    return v.isNotNull() & (F.col(low).isNull() | (v >= F.col(low))) & (F.col(high).isNull() | (v < F.col(high)))
