"""Feeds to canonical rows: text, JSON and wide files are read by Spark's own readers and projected by column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IndexFormatError, UnknownSourceError
from ..functions import parsing as P
from ..functions import units as U
from ..functions.temporal import local_midnight, seconds
from ..operators.merge import REPORT_PRIORITY, dedup_climate_reports, priority
from ..schemas import CLIMATE, OBSERVATION

#: How long after the event a feed's row is known, in minutes.
KNOWLEDGE_LAG = {"iem": 15, "awc": 5, "ghcnh": 360}
IEM_COLUMNS = (
    "station valid tmpf dwpf relh drct sknt p01i alti mslp vsby gust skyc1 skyc2 skyc3 skyc4 skyl1 skyl2 skyl3 skyl4 wxcodes "
    "ice_accretion_1hr ice_accretion_3hr ice_accretion_6hr peak_wind_gust peak_wind_drct peak_wind_time feel metar snowdepth"
).split()
AWC_SCHEMA = "icaoId string, obsTime bigint, metarType string, temp double, dewp double, wdir string, wspd double, wgst double, altim double, slp double, visib string, clouds array<struct<cover:string,base:int>>, wxString string, precip string, rawOb string, qcField int, snow double"


def _storage(df: DataFrame, columns: dict[str, Column], extra: tuple[str, ...] = ()) -> DataFrame:
    """The storage columns in order and type; what isn't given is null."""
    have = {f.name: columns.get(f.name, F.lit(None)).cast(f.dataType) for f in OBSERVATION.fields}
    return df.select(*[c.alias(n) for n, c in have.items()], *extra)


def _staged(df: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """df with parsed values as columns of their own, and these by name: what is used several times is then parsed once."""
    return df.withColumns({f"_n_{k}": c for k, c in columns.items()}), {k: F.col(f"_n_{k}") for k in columns}


def _integer(x: Column) -> Column:
    return F.rint(x).cast("int")


def read_iem_csv(spark: SparkSession, path: str, observation_type: str | None = None) -> DataFrame:
    """Observations of comma-separated archive files; lines that start with # are comments."""
    schema = ", ".join(f"{c} string" for c in IEM_COLUMNS)
    return iem_to_observation(spark.read.csv(path, schema=schema, header=True, comment="#", enforceSchema=False), observation_type)


def iem_to_observation(df: DataFrame, observation_type: str | None = None) -> DataFrame:
    """Archive rows as storage rows: M and empty are null; a T-group replaces a temperature that was in range; F is null where C is out of range. Rows without station, time, or any of temperature, dew point, wind and pressure go."""
    numbers = ("tmpf", "dwpf", "drct", "sknt", "alti", "mslp", "vsby", "gust", "peak_wind_gust", "peak_wind_drct", "snowdepth", *(f"skyl{k}" for k in range(1, 5)))
    df, n = _staged(df, {c: P.number(c) for c in numbers} | {"at": P.observed_at("valid"), "raw": F.when(F.col("metar") != "M", F.substring("metar", 1, P.MAX_METAR))})
    at, raw = n["at"], n["raw"]
    t_group, d_group = P.tenths_group(raw)
    df, g = _staged(df, {"t_group": t_group, "d_group": d_group, "in_t": P.within(U.f_to_c(n["tmpf"]), "temp_c"), "in_d": P.within(U.f_to_c(n["dwpf"]), "dewpoint_c")})
    temp, dew = F.when(g["in_t"].isNotNull(), F.coalesce(g["t_group"], g["in_t"])), F.when(g["in_d"].isNotNull(), F.coalesce(g["d_group"], g["in_d"]))
    kind = F.lit(observation_type) if observation_type else F.when(F.startswith(F.coalesce(raw, F.lit("")), F.lit("SPECI")), "SPECI").otherwise("METAR")
    kept = df.filter(F.col("station").rlike(r"^[A-Z0-9]{3,4}$") & at.isNotNull() & F.coalesce(n["tmpf"], n["dwpf"], n["sknt"], n["mslp"]).isNotNull())
    columns = {
        "station_code": P.icao_to_code("station"),
        "observed_at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "observation_type": kind,
        "source": F.lit("iem"),
        "temp_c": temp,
        "dewpoint_c": dew,
        "temp_f": F.when(temp.isNotNull(), n["tmpf"]),
        "dewpoint_f": F.when(dew.isNotNull(), n["dwpf"]),
        "wind_dir_degrees": P.within(_integer(n["drct"]), "wind_dir_degrees"),
        "wind_speed_kt": P.within(_integer(n["sknt"]), "wind_speed_kt"),
        "wind_gust_kt": P.within(_integer(n["gust"]), "wind_gust_kt"),
        "altimeter_inhg": n["alti"],
        "sea_level_pressure_mb": P.within(n["mslp"], "sea_level_pressure_mb"),
        "visibility_miles": F.when(n["vsby"].isNotNull(), F.least(n["vsby"], F.lit(P.MAX_VISIBILITY))),
        "weather_codes": F.when(~F.col("wxcodes").isin("M", ""), F.substring("wxcodes", 1, P.MAX_CODES)),
        "precip_1hr_inches": P.precipitation("p01i"),
        "peak_wind_gust_kt": _integer(n["peak_wind_gust"]),
        "peak_wind_dir": P.within(_integer(n["peak_wind_drct"]), "wind_dir_degrees"),
        "peak_wind_time": F.when(F.col("peak_wind_time") != "M", F.col("peak_wind_time")),
        "snow_depth_inches": n["snowdepth"],
        "raw_metar": raw,
    }
    for k in range(1, 5):
        columns[f"sky_cover_{k}"] = P.cloud_cover(f"skyc{k}")
        columns[f"sky_base_{k}_ft"] = P.within(_integer(n[f"skyl{k}"]), "sky_base_ft")
    return _storage(kept, columns)


def read_awc_json(spark: SparkSession, path: str) -> DataFrame:
    return awc_to_observation(spark.read.schema(AWC_SCHEMA).json(path, multiLine=True))


def awc_to_observation(df: DataFrame) -> DataFrame:
    """Live METAR rows as storage rows. With a T-group the temperature in F is rounded to an integer, ties to even; a variable wind has no direction; a trace is 0."""
    t_group, d_group = P.tenths_group("rawOb")
    temp, dew = P.within(F.coalesce(t_group, U.finite("temp")), "temp_c"), P.within(F.coalesce(d_group, U.finite("dewp")), "dewpoint_c")
    speed, gust, at = P.peak_wind("rawOb")[1], P.within(_integer(F.col("wgst")), "wind_gust_kt"), F.timestamp_seconds("obsTime")
    kept = df.filter(F.col("icaoId").isNotNull() & F.col("obsTime").isNotNull() & F.year(at).between(*P.YEARS))
    columns = {
        "station_code": P.icao_to_code("icaoId"),
        "observed_at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "observation_type": F.when(F.upper("metarType") == "SPECI", "SPECI").otherwise("METAR"),
        "source": F.lit("awc"),
        "temp_c": temp,
        "dewpoint_c": dew,
        "temp_f": F.when(t_group.isNotNull(), F.rint(U.c_to_f(temp))).otherwise(U.c_to_f(temp)),
        "dewpoint_f": F.when(d_group.isNotNull(), F.rint(U.c_to_f(dew))).otherwise(U.c_to_f(dew)),
        "wind_dir_degrees": P.within(_integer(P.number("wdir", "VRB")), "wind_dir_degrees"),
        "wind_speed_kt": P.within(_integer(F.col("wspd")), "wind_speed_kt"),
        "wind_gust_kt": gust,
        "altimeter_inhg": U.hpa_to_inhg("altim"),
        "sea_level_pressure_mb": P.within(U.finite("slp"), "sea_level_pressure_mb"),
        "visibility_miles": P.visibility("visib"),
        "weather_codes": F.substring("wxString", 1, P.MAX_CODES),
        "precip_1hr_inches": P.precipitation("precip"),
        "peak_wind_gust_kt": speed,
        "peak_wind_dir": P.peak_wind("rawOb")[0],
        "peak_wind_time": P.peak_wind("rawOb")[2],
        "snow_depth_inches": U.finite("snow"),
        "qc_field": F.col("qcField"),
        "raw_metar": F.substring("rawOb", 1, P.MAX_METAR),
    }
    for k in range(1, 5):
        cloud = F.try_element_at("clouds", F.lit(k))
        columns[f"sky_cover_{k}"] = P.cloud_cover(cloud["cover"])
        columns[f"sky_base_{k}_ft"] = P.within(cloud["base"], "sky_base_ft")
    return _storage(kept, columns)


def read_ghcnh_psv(spark: SparkSession, path: str, code: str | None = None) -> DataFrame:
    return ghcnh_to_observation(spark.read.csv(path, sep="|", header=True), code)


def ghcnh_to_observation(df: DataFrame, code: str | None = None) -> DataFrame:
    """Wide climatology rows as storage rows. A value counts if its quality code is 0, 1, 4, 5 or missing; rows without temperature, dew point, wind and pressure go. Lower-case variable names are looked up without regard to case."""
    names = {c.lower(): c for c in df.columns}

    def raw(v: str) -> Column:
        return F.col(f"`{names[v]}`") if v in names else F.lit(None).cast("string")

    measured = ("temperature", "dew_point_temperature", "wind_speed", "sea_level_pressure", "wind_direction", "wind_gust", "altimeter", "visibility", "precipitation", "snow_depth", *(f"sky_cover_baseht_{k}" for k in range(1, 4)))
    parsed = {v: P.number(P.accepted(raw(v), raw(f"{v}_quality_code"))) for v in measured}
    df, n = _staged(df, parsed | {"at": P.observed_at(F.substring(F.replace(raw("date"), F.lit("T"), F.lit(" ")), 1, 16))})
    value, at = n.__getitem__, n["at"]
    df, g = _staged(df, {"temp": P.within(value("temperature"), "temp_c"), "dew": P.within(value("dew_point_temperature"), "dewpoint_c"), "wind": U.ms_to_kt(value("wind_speed")), "slp": P.within(value("sea_level_pressure"), "sea_level_pressure_mb")})
    temp, dew, wind, slp = g.values()
    remark = F.coalesce(raw("rem"), F.lit(""))
    metar = F.regexp_extract(remark, r"((?:METAR|SPECI).*)$", 1)
    codes = [k for k in (f"pres_wx_mw{j}" for j in range(1, 4)) if k in names]
    kept = df.filter(at.isNotNull() & F.coalesce(temp, dew, wind, slp).isNotNull())
    columns = {
        "station_code": F.lit(code) if code else raw("station"),
        "observed_at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "observation_type": F.when(F.coalesce(raw("temperature_report_type"), F.lit("")).contains("FM16") | F.coalesce(raw("temperature_report_type"), F.lit("")).contains("FM-16"), "SPECI").otherwise("METAR"),
        "source": F.lit("ghcnh"),
        "temp_c": temp,
        "dewpoint_c": dew,
        "temp_f": U.c_to_f(temp),
        "dewpoint_f": U.c_to_f(dew),
        "wind_dir_degrees": P.within(_integer(value("wind_direction")), "wind_dir_degrees"),
        "wind_speed_kt": P.within(_integer(wind), "wind_speed_kt"),
        "wind_gust_kt": P.within(_integer(U.ms_to_kt(value("wind_gust"))), "wind_gust_kt"),
        "altimeter_inhg": U.hpa_to_inhg(value("altimeter")),
        "sea_level_pressure_mb": slp,
        "visibility_miles": F.least(U.km_to_mi(value("visibility")), F.lit(P.MAX_VISIBILITY)),
        "weather_codes": P.weather_codes([raw(k) for k in codes], [raw(f"{k}_quality_code") for k in codes]) if codes else F.lit(None),
        "precip_1hr_inches": U.mm_to_in(value("precipitation")),
        "snow_depth_inches": value("snow_depth") / 2.54,
        "raw_metar": F.when(metar != "", F.substring(metar, 1, P.MAX_METAR)),
    }
    for k in range(1, 4):
        cover = F.regexp_extract(F.coalesce(raw(f"sky_cover_{k}"), F.lit("")), r"([A-Z]{2,5})", 1)
        columns[f"sky_cover_{k}"] = P.cloud_cover(cover)
        columns[f"sky_base_{k}_ft"] = P.within(_integer(U.m_to_ft(value(f"sky_cover_baseht_{k}"))), "sky_base_ft")
    return _storage(kept, columns)


def read_cli_json(spark: SparkSession, path: str, code: str) -> DataFrame:
    schema = "station string, valid string, high string, low string, product string, name string"
    return cli_to_climate(spark.read.schema(schema).json(path, multiLine=True), code)


def cli_to_climate(df: DataFrame, code: str) -> DataFrame:
    """Daily reports as climate rows: the date must be real, M is null, values are rounded and out of range null; rows without both go. The report's kind follows from when its product was issued."""
    df, n = _staged(df, {"day": F.try_to_date("valid", "yyyy-MM-dd"), "high": _integer(P.number("high")), "low": _integer(P.number("low"))})
    df, g = _staged(df, {"kind": P.report_type("product", n["day"])})
    day, kind = n["day"], g["kind"]
    high, low = P.within(n["high"], "high_temp_f"), P.within(n["low"], "low_temp_f")
    rows = df.filter(day.isNotNull() & F.coalesce(high, low).isNotNull())
    return rows.select(
        F.lit(code).alias("station_code"),
        F.date_format(day, "yyyy-MM-dd").alias("observation_date"),
        high.alias("high_temp_f"),
        low.alias("low_temp_f"),
        kind.alias("report_type"),
        priority(kind, REPORT_PRIORITY, 0.0).alias("report_type_priority"),
        F.lit("iem").alias("source"),
        F.col("product").alias("product_id"),
        F.date_format(F.try_to_timestamp(F.substring("product", 1, 12), F.lit("yyyyMMddHHmm")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("issued_at"),
    )


def mos_rows(df: DataFrame, station: str = "station") -> DataFrame:
    """Station guidance as forecast rows: runtime and ftime must be readable; F to C, kt to m/s, chance as a fraction, forecast_hour rounded from the two times, model in capitals."""
    issued, valid = (F.try_to_timestamp(F.replace(F.col(c), F.lit("T"), F.lit(" "))) for c in ("runtime", "ftime"))
    rows = df.filter(issued.isNotNull() & valid.isNotNull())
    hours = F.rint((F.unix_timestamp(valid) - F.unix_timestamp(issued)) / 3600).cast("bigint")
    return rows.select(
        F.col(station).alias("station"),
        F.upper("model").alias("model"),
        issued.alias("issued_at"),
        valid.alias("valid_at"),
        hours.alias("forecast_hour"),
        U.f_to_c(P.number("tmp")).alias("temp_c"),
        U.f_to_c(P.number("dpt")).alias("dew_point_c"),
        U.kt_to_ms(P.number("wsp"), U.KT_TO_MS_MOS).alias("wind_speed_ms"),
        P.number("wdr").cast("bigint").alias("wind_dir_deg"),
        (P.number("pop12") / 100).alias("pop"),
        F.lit("iem.archive").alias("source"),
    )


def read_mos_json(spark: SparkSession, path: str) -> DataFrame:
    """mos_rows() of payloads with a data array."""
    item = "station:string,model:string,runtime:string,ftime:string,tmp:string,dpt:string,wsp:string,wdr:string,pop12:string"
    payloads = spark.read.schema(f"data array<struct<{item}>>").json(path, multiLine=True)
    return mos_rows(payloads.select(F.inline("data")))


#: Endpoints of the point-forecast feed and the source tag of their rows.
ENDPOINTS = {"single_runs": "open_meteo.single_runs", "previous_runs": "open_meteo.previous_runs", "live": "open_meteo.live", "seamless": "open_meteo.seamless"}


def point_forecast_rows(df: DataFrame, model: str, endpoint: str, *, days: int = 1, run: Column | None = None, now: Column | None = None) -> DataFrame:
    """Rows of hourly_rows() as forecast rows. issued_at by endpoint: the run itself; a bound from ``days`` ahead; the newest published cycle at ``now``; unknown (null, forecast_hour 0) for the seamless one. A chance in percent becomes a fraction."""
    from ..functions import models
    from ..functions import temporal as T

    if endpoint not in ENDPOINTS:
        raise ValueError(f"no endpoint {endpoint!r}")
    m = models.point(model)
    issued = {
        "single_runs": lambda: run,
        "previous_runs": lambda: T.issued_at_previous_day("valid_at", days, m.hours),
        "live": lambda: T.issued_at_live(now if now is not None else F.current_timestamp(), 60 * (m.lag_hours or 0), m.hours),
        "seamless": lambda: F.lit(None),
    }[endpoint]().cast("timestamp")
    hour = F.coalesce(F.rint((F.unix_timestamp("valid_at") - F.unix_timestamp(issued)) / 3600).cast("bigint"), F.lit(0).cast("bigint"))
    get = lambda c: U.finite(c) if c in df.columns else F.lit(None).cast("double")
    return df.select(
        *(["station"] if "station" in df.columns else []),
        F.lit(model).alias("model"),
        issued.alias("issued_at"),
        "valid_at",
        hour.alias("forecast_hour"),
        get("temperature_2m").alias("temp_c"),
        get("dew_point_2m").alias("dew_point_c"),
        get("wind_speed_10m").alias("wind_speed_ms"),
        (get("precipitation_probability") / 100).alias("pop"),
        F.lit(ENDPOINTS[endpoint]).alias("source"),
    )


def with_unit_names(df: DataFrame, schema_id: str, system: str) -> DataFrame:
    """Columns under the schema's names for a unit system: names only, no value changes."""
    from ..schemas import lookup

    if system not in ("metric", "imperial"):
        raise ValueError(f"no unit system {system!r}")
    schema = lookup(schema_id)
    return df.withColumnsRenamed(schema.metric_names if system == "metric" else schema.imperial_names)


def hourly_rows(df: DataFrame, hourly: str = "hourly", variables: tuple[str, ...] = ("temperature_2m",)) -> DataFrame:
    """Parallel arrays of a columnar payload (a struct with time and variables) as one row per time; short arrays are padded with null."""
    keep = [c for c in df.columns if c != hourly]
    have = set(df.schema[hourly].dataType.names)
    zipped = F.arrays_zip(F.col(f"{hourly}.time").alias("time"), *[F.col(f"{hourly}.{v}").alias(v) for v in variables if v in have])
    rows = df.select(*keep, F.posexplode(zipped).alias("_k", "_h"))
    out = {"valid_at": F.try_to_timestamp(F.replace(F.col("_h.time"), F.lit("T"), F.lit(" "))), **{v: F.col(f"_h.{v}") if v in have else F.lit(None).cast("double") for v in variables}}
    return rows.select(*keep, *[c.alias(n) for n, c in out.items()]).filter(F.col("valid_at").isNotNull())


def read_index_text(spark: SparkSession, path: str) -> DataFrame:
    """A colon-separated index of gridded messages: record_no, offset, reference, variable, level, forecast, and next_offset (the byte before which the record ends; null for the last of a file). A line with fewer than five fields stops the read."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    return index_records(lines)


def index_records(lines: DataFrame) -> DataFrame:
    """As read_index_text() of rows (file, value)."""
    from pyspark.sql import Window

    parts = F.split("value", ":")
    checked = F.when(F.size(parts) >= 5, parts).otherwise(F.raise_error(F.concat(F.lit(f"{IndexFormatError.code}: "), F.col("value"))).cast("array<string>"))
    rows = lines.select("file", checked.alias("p"))
    rows = rows.select("file", F.col("p")[0].cast("double").alias("record_no"), F.col("p")[1].cast("bigint").alias("offset"), F.col("p")[2].alias("reference"), F.col("p")[3].alias("variable"), F.col("p")[4].alias("level"), F.get("p", F.lit(5)).alias("forecast"))
    # several records may share an offset: the next one is what follows the last of them
    rows = rows.withColumn("_next", F.lead("offset").over(Window.partitionBy("file").orderBy("offset")))
    later = F.when(F.col("_next") > F.col("offset"), F.col("_next"))
    return rows.withColumn("next_offset", F.max(later).over(Window.partitionBy("file", "offset"))).drop("_next")


def read_index_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines index: offset, length, variable, level; rows without a place stop the read."""
    rows = spark.read.schema("_offset bigint, _length bigint, param string, levtype string").json(path, mode="FAILFAST")
    checked = F.when(F.col("_offset").isNotNull() & F.col("_length").isNotNull(), F.col("_offset")).otherwise(F.raise_error(F.lit(f"{IndexFormatError.code}: a record has no place")).cast("bigint"))
    return rows.select(checked.alias("offset"), F.col("_length").alias("length"), F.col("param").alias("variable"), F.col("levtype").alias("level"))


def wanted_records(index: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Records whose (variable, level) is wanted, each record_no once."""
    match = F.struct("variable", "level").isin(*[F.struct(F.lit(v), F.lit(x)) for v, x in wanted]) if wanted else F.lit(False)
    return index.filter(match).dropDuplicates(["file", "record_no"] if "file" in index.columns else ["record_no"])


def decode_grids(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """Files of gridded messages through a decoder that is given (bytes -> iterator of record batches in ``schema``). No decoder comes with the library."""

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                yield from decode(content.as_py())

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


# -- canonical projections


def canonical(obs: DataFrame, feed: str, retrieved_at: Column | None = None) -> DataFrame:
    """Storage rows in canonical names and SI units, with source, retrieved_at and knowledge_time (the event plus the feed's lag)."""
    at = F.to_timestamp("observed_at")
    base = {
        "station": F.col("station_code"),
        "event_time": at,
        "observation_type": F.col("observation_type"),
        "temp_c": F.col("temp_c"),
        "dew_point_c": F.col("dewpoint_c"),
        "wind_speed_ms": U.kt_to_ms("wind_speed_kt"),
        "wind_dir_deg": F.col("wind_dir_degrees").cast("bigint"),
        "wind_gust_ms": U.kt_to_ms("wind_gust_kt"),
        "slp_hpa": F.col("sea_level_pressure_mb"),
        "altimeter_inhg": F.col("altimeter_inhg"),
        "visibility_m": U.mi_to_m("visibility_miles"),
        "sky_cover_1": P.cloud_cover("sky_cover_1", canonical=True),
        "sky_base_1_m": U.ft_to_m("sky_base_1_ft"),
        "sky_cover_2": P.cloud_cover("sky_cover_2", canonical=True),
        "sky_base_2_m": U.ft_to_m("sky_base_2_ft"),
        "precip_mm_1h": U.in_to_mm("precip_1hr_inches"),
        "peak_wind_gust_ms": U.kt_to_ms("peak_wind_gust_kt"),
        "snow_depth_mm": U.in_to_mm("snow_depth_inches"),
        "weather_codes": F.col("weather_codes"),
        "raw_metar": F.col("raw_metar"),
        "source": F.col("source"),
        "retrieved_at": retrieved_at if retrieved_at is not None else F.current_timestamp(),
        "knowledge_time": at + seconds(KNOWLEDGE_LAG[feed] * 60),
    }
    return obs.select(*[c.alias(n) for n, c in base.items()])


#: Sources that rows in memory may be tagged with, and the feed whose lag they have.
ROW_SOURCES = {"iem.archive": "iem", "iem.live": "iem", "awc.live": "awc", "ghcnh.archive": "ghcnh", "ghcnh": "ghcnh"}


def _retrieved(at: datetime | None) -> Column:
    if at is None:
        return F.current_timestamp()
    if at.tzinfo is None:
        raise ValueError(f"{at!r} has no time zone")
    return F.lit(at).cast("timestamp")


def from_rows(spark: SparkSession, rows: list[dict], source: str, retrieved_at: datetime | None = None) -> DataFrame:
    """Storage rows in memory as canonical ones; no rows give an empty frame of the same schema. Keys that aren't storage columns are left out."""
    if source not in ROW_SOURCES:
        raise UnknownSourceError(f"no source {source!r}", known=sorted(ROW_SOURCES))
    at = _retrieved(retrieved_at)
    table = spark.createDataFrame([tuple(_typed(r.get(f.name), f) for f in OBSERVATION.fields) for r in rows], OBSERVATION)
    return canonical(table, ROW_SOURCES[source], at).withColumn("source", F.lit(source))


def _typed(x, f):
    """A value as its column has it: whole numbers for integers, floats for doubles."""
    kind = f.dataType.simpleString()
    return None if x is None else {"int": round, "double": float, "string": str}[kind](x)


def from_records(spark: SparkSession, records: list[dict], tz: str, retrieved_at: datetime | None = None) -> DataFrame:
    """Climate records in memory as settlements, with retrieved_at."""
    at = _retrieved(retrieved_at)
    table = spark.createDataFrame([tuple(_typed(r.get(f.name), f) for f in CLIMATE.fields) for r in records], CLIMATE)
    return settlement_rows(table, tz).withColumn("retrieved_at", at)


def settlement_rows(climate: DataFrame, tz: str) -> DataFrame:
    """Climate rows as settlements: one per day, event_time at the station's midnight, knowledge_time at the product's release, finality from the report's kind."""
    rows = dedup_climate_reports(climate)
    day, release = F.to_date("observation_date"), F.try_to_timestamp(F.substring("product_id", 1, 12), F.lit("yyyyMMddHHmm"))
    return rows.select(
        F.col("station_code").alias("station"),
        day.alias("settlement_date"),
        local_midnight(day, tz).alias("event_time"),
        F.col("high_temp_f").cast("bigint").alias("high_temp_f"),
        F.col("low_temp_f").cast("bigint").alias("low_temp_f"),
        "report_type",
        F.when(F.col("report_type").isin("final", "correction", "ncei_final"), "final").otherwise("provisional").alias("finality"),
        F.lit("clean").alias("quality"),
        "product_id",
        release.alias("product_release_time"),
        release.alias("knowledge_time"),
        F.lit("cli.archive").alias("source"),
    )


def in_units(obs: DataFrame, system: str = "raw") -> DataFrame:
    """Storage rows in raw, metric or imperial units. feels_like_f is found before the wind is converted."""
    from ..functions.weather import feels_like, relative_humidity

    if system not in ("raw", "metric", "imperial"):
        raise ValueError(f"no unit system {system!r}")
    out = obs.withColumn("relative_humidity_pct", relative_humidity("temp_c", "dewpoint_c"))
    out = out.withColumn("feels_like_f", feels_like("temp_f", "wind_speed_kt", "relative_humidity_pct"))
    if system == "metric":
        return out.withColumns({"wind_speed_ms": U.kt_to_ms("wind_speed_kt"), "visibility_km": U.mi_to_km("visibility_miles"), "precip_mm": U.in_to_mm("precip_1hr_inches"), "feels_like_c": U.f_to_c("feels_like_f")}).drop("wind_speed_kt", "visibility_miles", "precip_1hr_inches", "feels_like_f")
    return out.withColumn("wind_speed_mph", U.kt_to_mph("wind_speed_kt")).drop("wind_speed_kt") if system == "imperial" else out


class Adapters:
    """Feeds by id: a function from a raw frame to storage rows. The same id with another function is an error."""

    def __init__(self) -> None:
        self._by_id: dict = {}

    def register(self, source_id: str, make) -> None:
        if self._by_id.setdefault(source_id, make) is not make:
            raise ValueError(f"{source_id!r} is registered with another adapter")

    def get(self, source_id: str):
        if source_id not in self._by_id:
            raise UnknownSourceError(f"no source {source_id!r}", known=sorted(self._by_id))
        return self._by_id[source_id]


ADAPTERS = Adapters()
for _id, _make in (("iem.archive", iem_to_observation), ("awc.live", awc_to_observation), ("ghcnh.archive", ghcnh_to_observation)):
    ADAPTERS.register(_id, _make)
