"""Canonical schemas: storage rows as StructTypes, versioned column specifications, and their registry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import SchemaConflictError, SchemaError, UnknownSchemaError

#: The closed set of column kinds and the Spark types that pass for each.
KINDS: dict[str, tuple[type, ...]] = {
    "string": (T.StringType,),
    "float64": (T.DoubleType,),
    "int64": (T.LongType, T.IntegerType),
    "timestamp_utc": (T.TimestampType,),
    "date": (T.DateType,),
    "bool": (T.BooleanType,),
    "enum": (T.StringType,),
}
_SPARK = {"string": T.StringType(), "float64": T.DoubleType(), "int64": T.LongType(), "timestamp_utc": T.TimestampType(), "date": T.DateType(), "bool": T.BooleanType(), "enum": T.StringType()}


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    units: str | None = None
    nullable: bool = True
    values: tuple[str, ...] = ()
    notes: str = ""

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise SchemaError(f"{self.name}: {self.kind!r} is no kind of column", kinds=sorted(KINDS))
        if (self.kind == "enum") != bool(self.values):
            raise SchemaError(f"{self.name}: values go with the kind enum, and only with it")

    def field(self) -> T.StructField:
        return T.StructField(self.name, _SPARK[self.kind], self.nullable, {"units": self.units or "", "values": list(self.values), "notes": self.notes})


@dataclass(frozen=True)
class Schema:
    schema_id: str
    columns: tuple[ColumnSpec, ...]
    sources: frozenset[str] = field(default_factory=frozenset)
    metric_names: dict[str, str] = field(default_factory=dict)
    imperial_names: dict[str, str] = field(default_factory=dict)

    def struct(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def __getitem__(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name == name)


_REGISTRY: dict[str, Schema] = {}


def register(schema: Schema) -> Schema:
    """Registers a schema under its id; the same id with another definition is an error."""
    if _REGISTRY.setdefault(schema.schema_id, schema) != schema:
        raise SchemaConflictError(f"{schema.schema_id} is registered with another definition", schema_id=schema.schema_id)
    return schema


def lookup(schema_id: str) -> Schema:
    if schema_id not in _REGISTRY:
        raise UnknownSchemaError(f"no schema {schema_id!r}", known=sorted(_REGISTRY))
    return _REGISTRY[schema_id]


def registered() -> list[str]:
    return sorted(_REGISTRY)


_SIMPLE = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def struct(text: str) -> T.StructType:
    """A row type from 'name type, ...' of simple types; it needs no session."""
    return T.StructType([T.StructField(n, _SIMPLE[t]) for n, t in (x.split() for x in text.split(","))])


#: A row of the observation store, in storage order.
OBSERVATION = struct(
    "station_code string, observed_at string, observation_type string, source string, temp_c double, dewpoint_c double, temp_f double, dewpoint_f double, "
    "wind_dir_degrees int, wind_speed_kt int, wind_gust_kt int, altimeter_inhg double, sea_level_pressure_mb double, "
    + ", ".join(f"sky_cover_{k} string, sky_base_{k}_ft int" for k in range(1, 5))
    + ", visibility_miles double, weather_codes string, precip_1hr_inches double, peak_wind_gust_kt int, peak_wind_dir int, peak_wind_time string, snow_depth_inches double, qc_field int, raw_metar string"
)
LINEAGE = ("parser_name", "parser_version", "ingestion_id", "as_of_time", "source_received_at", "qc_status", "observation_kind", "provenance", "observation_quality")
LEDGER = T.StructType([*OBSERVATION.fields, *(T.StructField(n, T.StringType()) for n in LINEAGE)])
CLIMATE = struct("station_code string, observation_date string, high_temp_f int, low_temp_f int, report_type string, report_type_priority double, source string, product_id string, issued_at string")
QC_SIDECAR = struct(
    "station_code string, observed_at timestamp, observation_kind string, source string, parser_name string, as_of_time timestamp, ingestion_id string, qc_system string, qc_version string, rule_id string, field string, flag string, detector_metadata string"
)
PAIRS = struct(
    "date date, station string, cli_high_f int, cli_low_f int, cli_report_type string, obs_high_f double, obs_low_f double, obs_mean_f double, obs_mean_dewpoint_f double, obs_max_wind_kt int, obs_max_gust_kt int, obs_total_precip_in double, obs_count bigint, "
    "fcst_high_f double, fcst_low_f double, fcst_model string, fcst_issued_at timestamp, fcst_pop_6hr_pct double, fcst_qpf_6hr_in double, market_close_utc timestamp"
)
DAILY_EXTREME = struct("station string, local_date date, tmin_c double, tmax_c double, tmean_c double, precip_inches double, n_obs bigint, source_tmin string, source_tmax string, merge_policy string")
CANDLE = struct("ts timestamp, open double, high double, low double, close double, volume bigint, open_interest bigint, source string")
BOOK = struct("side string, price double, size bigint, source string")

COVER = ("CLR", "FEW", "SCT", "BKN", "OVC", "VV")
_c = ColumnSpec
OBSERVATION_V1 = register(
    Schema(
        "schema.observation.v1",
        (
            _c("station", "string", nullable=False),
            _c("event_time", "timestamp_utc", nullable=False),
            _c("observation_type", "enum", values=("METAR", "SPECI")),
            _c("temp_c", "float64", "celsius"),
            _c("dew_point_c", "float64", "celsius"),
            _c("wind_speed_ms", "float64", "m/s"),
            _c("wind_dir_deg", "int64", "degrees"),
            _c("wind_gust_ms", "float64", "m/s"),
            _c("slp_hpa", "float64", "hPa"),
            _c("altimeter_inhg", "float64", "inHg"),
            _c("visibility_m", "float64", "m"),
            _c("sky_cover_1", "enum", values=COVER),
            _c("sky_base_1_m", "float64", "m"),
            _c("sky_cover_2", "enum", values=COVER),
            _c("sky_base_2_m", "float64", "m"),
            _c("precip_mm_1h", "float64", "mm"),
            _c("peak_wind_gust_ms", "float64", "m/s"),
            _c("snow_depth_mm", "float64", "mm"),
            _c("weather_codes", "string"),
            _c("raw_metar", "string"),
        ),
        frozenset({"iem.archive"}),
        imperial_names={"temp_c": "temp_f", "dew_point_c": "dew_point_f", "wind_speed_ms": "wind_speed_kt", "visibility_m": "visibility_mi"},
    )
)
SETTLEMENT_V1 = register(
    Schema(
        "schema.settlement.cli.v1",
        (
            _c("station", "string", nullable=False),
            _c("settlement_date", "date", nullable=False),
            _c("event_time", "timestamp_utc", nullable=False),
            _c("high_temp_f", "int64", "fahrenheit"),
            _c("low_temp_f", "int64", "fahrenheit"),
            _c("report_type", "enum", values=("final", "ncei_final", "correction", "preliminary", "estimated")),
            _c("finality", "enum", values=("provisional", "final")),
            _c("quality", "string"),
            _c("product_id", "string"),
            _c("product_release_time", "timestamp_utc"),
            _c("knowledge_time", "timestamp_utc"),
            _c("source", "string"),
        ),
        frozenset({"cli.archive"}),
    )
)
FORECAST_SOURCES = frozenset({"iem.archive", "open_meteo.single_runs", "open_meteo.previous_runs", "open_meteo.live", "open_meteo.seamless"})
_FORECAST = (
    _c("station", "string", nullable=False),
    _c("model", "string", nullable=False),
    _c("issued_at", "timestamp_utc"),
    _c("valid_at", "timestamp_utc", nullable=False),
    _c("forecast_hour", "int64"),
    _c("temp_c", "float64", "celsius"),
    _c("dew_point_c", "float64", "celsius"),
    _c("wind_speed_ms", "float64", "m/s"),
    _c("wind_dir_deg", "int64", "degrees"),
    _c("pop", "float64", "fraction"),
    _c("source", "string"),
)
FORECAST_V1 = register(Schema("schema.forecast.station.v1", _FORECAST, FORECAST_SOURCES))
MOS_V1 = register(Schema("schema.forecast.iem_mos.v1", _FORECAST, FORECAST_SOURCES))
NWP_V1 = register(
    Schema(
        "schema.forecast_nwp.v1",
        (
            _c("station", "string", nullable=False),
            _c("model", "string", nullable=False),
            _c("cycle", "timestamp_utc", nullable=False),
            _c("forecast_hour", "int64", nullable=False),
            _c("valid_at", "timestamp_utc", nullable=False),
            _c("temp_k_2m", "float64", "kelvin"),
            _c("dewpoint_k_2m", "float64", "kelvin"),
            _c("relative_humidity_pct_2m", "float64", "percent"),
            _c("wind_u_ms_10m", "float64", "m/s"),
            _c("wind_v_ms_10m", "float64", "m/s"),
            _c("wind_gust_ms", "float64", "m/s"),
            _c("precip_mm_1h", "float64", "mm"),
            _c("pressure_pa_surface", "float64", "Pa"),
            _c("pressure_pa_mslp", "float64", "Pa"),
            _c("grid_lat", "float64"),
            _c("grid_lon", "float64"),
            _c("grid_dist_km", "float64", "km"),
            _c("qc_status", "enum", values=("clean", "flagged", "suspect")),
            _c("source", "string"),
        ),
        frozenset({"noaa_bdp"}),
    )
)
LEDGER_V1 = register(Schema("schema.observation_ledger.v1", tuple(_c(n, "string") for n in ("station_code", "observed_at", "source", *LINEAGE)) + (_c("temp_c", "float64", "celsius"), _c("dewpoint_c", "float64", "celsius")), frozenset({"iem.archive"})))
QC_V1 = register(
    Schema(
        "schema.observation_qc.v1",
        (
            _c("station_code", "string", nullable=False),
            _c("observed_at", "timestamp_utc", nullable=False),
            _c("observation_kind", "enum", values=("METAR", "SPECI")),
            _c("source", "enum", values=("awc", "iem", "ghcnh", "ncei")),
            _c("parser_name", "string"),
            _c("as_of_time", "timestamp_utc"),
            _c("ingestion_id", "string"),
            _c("qc_system", "string", nullable=False),
            _c("qc_version", "string", nullable=False),
            _c("rule_id", "string", nullable=False),
            _c("field", "string", nullable=False, notes="the observation's column that the rule looked at"),
            _c("flag", "enum", nullable=False, values=("clean", "flagged", "suspect")),
            _c("detector_metadata", "string", notes="JSON, by qc_system"),
        ),
        frozenset({"iem.archive"}),
    )
)
