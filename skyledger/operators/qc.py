"""Quality control: a bit field of rules, one row per rule that fires, cross-checks of sources, and verdicts on gridded forecasts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import KT_TO_MS_QC, finite
from ..schemas import QC_SIDECAR


@dataclass(frozen=True)
class Rule:
    rule_id: str
    bit: int
    columns: tuple[str, ...]
    fires: Callable[[], Column]
    message: str = ""


def _outside(name: str, low: float, high: float) -> Callable[[], Column]:
    return lambda: (F.col(name) < low) | (F.col(name) > high)


#: The rules and their bounds.
RULES = (
    Rule("temp_c.out_of_range", 0, ("temp_c",), _outside("temp_c", -89.0, 57.0), "temperature beyond the records"),
    Rule("dew_point_c.exceeds_temp", 1, ("dew_point_c", "temp_c"), lambda: F.col("dew_point_c") > F.col("temp_c"), "dew point above the temperature"),
    Rule("wind_speed_ms.negative", 2, ("wind_speed_ms",), lambda: F.col("wind_speed_ms") < 0, "negative wind"),
    Rule("wind_dir_deg.out_of_range", 3, ("wind_dir_deg",), _outside("wind_dir_deg", 0, 360), "direction outside 0 to 360"),
    Rule("slp_hpa.out_of_range", 4, ("slp_hpa",), _outside("slp_hpa", 870.0, 1085.0), "pressure outside 870 to 1085"),
)


def _fired(df: DataFrame, rule: Rule) -> Column:
    return F.coalesce(rule.fires(), F.lit(False)) if set(rule.columns) <= set(df.columns) else F.lit(False)


def apply_qc(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with obs_qc_status: the bits of the rules that fire. A null fires nothing; a rule whose column is missing is off."""
    return df.withColumn("obs_qc_status", reduce(lambda a, b: a.bitwiseOR(b), [F.when(_fired(df, r), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules], F.lit(0)))


QC_SYSTEM, QC_VERSION = "skyledger.qc", "1"


def sidecar(df: DataFrame, rules: tuple[Rule, ...] = RULES, *, station: str = "station_code", at: str = "observed_at") -> DataFrame:
    """One row per row and rule that fires, as QC_SIDECAR has them. Columns of the schema that df lacks are null; detector_metadata holds the value that fired as JSON."""
    given = lambda name: F.col(name) if name in df.columns else F.lit(None)
    found = [F.when(_fired(df, r), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.columns[0]).alias("field"), given(r.columns[0]).cast("double").alias("value"))) for r in rules]
    kind = "observation_kind" if "observation_kind" in df.columns else "observation_type"
    rows = df.select(
        given(station).alias("station_code"),
        given(at).alias("observed_at"),
        given(kind).alias("observation_kind"),
        *[given(c).alias(c) for c in ("source", "parser_name", "as_of_time", "ingestion_id")],
        F.lit(QC_SYSTEM).alias("qc_system"),
        F.lit(QC_VERSION).alias("qc_version"),
        F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("_hit"),
    )
    rows = rows.withColumns({"rule_id": F.col("_hit.rule_id"), "field": F.col("_hit.field"), "flag": F.lit("flagged"), "detector_metadata": F.to_json(F.struct("_hit.value"))})
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in QC_SIDECAR.fields])


def qc_summary(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row: total, flagged and, by rule (its id with _ for the dot), the number of rows in which it fired."""
    status = F.col("obs_qc_status")
    counts = [F.count_if(status.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(r.rule_id.replace(".", "_")) for r in rules]
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(status != 0).alias("flagged"), *counts)


def to_qc_columns(df: DataFrame) -> DataFrame:
    """Storage names and units (kt, mb) as the rules have them; what df lacks stays off."""
    out = {}
    for name, source, factor in (("dew_point_c", "dewpoint_c", None), ("wind_speed_ms", "wind_speed_kt", KT_TO_MS_QC), ("wind_dir_deg", "wind_dir_degrees", None), ("slp_hpa", "sea_level_pressure_mb", None)):
        if name not in df.columns and source in df.columns:
            out[name] = F.col(source).cast("double") * factor if factor else F.col(source)
    return df.withColumns(out) if out else df


def crosscheck(a: DataFrame, b: DataFrame, tolerance: float = 2.0, *, station: str = "station_code", at: str = "observed_at", value: str = "temp_c") -> DataFrame:
    """Rows of two sources at one station and time that differ by more than the tolerance: station, time, value_a, value_b, delta. Repeats give every combination."""
    left = a.select(F.col(station).alias("station"), F.col(at).alias("event_time"), finite(value).alias("value_a"))
    right = b.select(F.col(station).alias("station"), F.col(at).alias("event_time"), finite(value).alias("value_b"))
    joined = left.join(right, ["station", "event_time"]).withColumn("delta", F.abs(F.col("value_a") - F.col("value_b")))
    return joined.filter(F.col("delta") > tolerance)


def crosscheck_by_source(df: DataFrame, a: str = "iem", b: str = "ghcnh", tolerance: float = 2.0, *, source: str = "source", **names: str) -> DataFrame:
    """crosscheck() of the rows whose source starts with a against those whose source starts with b."""
    return crosscheck(df.filter(F.startswith(source, F.lit(a))), df.filter(F.startswith(source, F.lit(b))), tolerance, **names)


# -- gridded forecasts: 0 clean, 1 flagged, 2 suspect


def _severity(name: str, suspect: Callable[[Column], Column], flagged: Callable[[Column], Column] | None = None) -> Callable[[DataFrame], Column]:
    def make(df: DataFrame) -> Column:
        if name not in df.columns:
            return F.lit(0)
        x = finite(name)
        out = F.when(suspect(x), 2)
        return F.coalesce((out.when(flagged(x), 1) if flagged else out), F.lit(0))

    return make


def _dew(df: DataFrame) -> Column:
    if "dewpoint_k_2m" not in df.columns:
        return F.lit(0)
    d, t = finite("dewpoint_k_2m"), finite("temp_k_2m") if "temp_k_2m" in df.columns else F.lit(None).cast("double")
    return F.coalesce(F.when((d <= 0) | (d >= 400), 2).when(d > t + 1, 1), F.lit(0))


#: Bounds of the gridded variables.
NWP_BASE = (
    _severity("temp_k_2m", lambda x: (x <= 0) | (x >= 400), lambda x: (x < 180) | (x > 340)),
    _dew,
    _severity("relative_humidity_pct_2m", lambda x: (x < -5) | (x > 110), lambda x: (x < 0) | (x > 105)),
    _severity("wind_gust_ms", lambda x: x < 0, lambda x: x > 90),
    _severity("precip_mm_1h", lambda x: x < 0, lambda x: x > 305),
    _severity("pressure_pa_surface", lambda x: x <= 0, lambda x: (x < 50_000) | (x > 110_000)),
    _severity("pressure_pa_mslp", lambda x: x <= 0, lambda x: (x < 87_000) | (x > 108_500)),
)
NWP_FAMILIES = {
    "base": (),
    "ecmwf": (_severity("precip_m_total", lambda x: x < 0, lambda x: x > 0.305),),
    "ensemble": (),
    "hurricane": (_severity("storm_lat_deg", lambda x: (x < 0) | (x > 60)),),
    "regional": (_severity("grid_dist_km", lambda x: x > 50),),
}
#: Families by how a model's name starts; all others are base.
NWP_FAMILY_OF = {"ecmwf": "ecmwf", "ifs": "ecmwf", "aifs": "ecmwf", "gefs": "ensemble", "href": "ensemble", "reps": "ensemble", "hafs": "hurricane", "hrdps": "regional"}


def family_of(model: str) -> str:
    return next((f for start, f in NWP_FAMILY_OF.items() if model.lower().startswith(start)), "base")


def nwp_verdict(df: DataFrame, model: str = "hrrr") -> DataFrame:
    """df with qc_status: the worst of the model's rules (suspect over flagged over clean)."""
    rules = [make(df) for make in NWP_BASE + NWP_FAMILIES[family_of(model)]]
    worst = F.greatest(*rules)
    return df.withColumn("qc_status", F.when(worst == 2, "suspect").when(worst == 1, "flagged").otherwise("clean"))
