"""Forecast models: cycle hours, how far back they reach, and how long after a cycle they are published."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..errors import HistoricalDepthError, ModelError


@dataclass(frozen=True)
class Model:
    name: str
    step: int  # hours between cycles
    floor: datetime | None  # the first cycle that is kept; None: only recent cycles are
    lag_hours: int | None = None  # from the cycle to its publication

    @property
    def hours(self) -> tuple[int, ...]:
        return tuple(range(0, 24, self.step))


#: Gridded models: hours between cycles, and the first cycle in the archive (None: live only).
GRIDDED_MODELS = {
    "hrrr": (1, "2014-07-30"),
    "hrrrak": (3, "2018-01-01"),
    "gfs": (6, "2021-01-01"),
    "gdas": (6, "2021-01-01"),
    "gefs": (6, "2017-01-01"),
    "nbm": (1, "2020-01-01"),
    "rap": (1, "2020-01-01"),
    "rrfs": (1, "2024-01-01"),
    "rtma": (1, "2024-01-01"),
    "urma": (1, "2024-01-01"),
    "cfs": (6, "2011-01-01"),
    "ecmwf_ifs_hres": (6, "2022-01-01"),
    "ecmwf_ifs_ens": (6, "2022-01-01"),
    "ecmwf_aifs_single": (6, "2024-02-25T06"),
    "ecmwf_aifs_ens": (6, "2024-02-25T06"),
    "nam": (6, "2024-01-01"),
    "hrdps": (6, None),
    "rdps": (6, None),
    "gdps": (12, None),
    "geps": (12, None),
    "reps": (6, None),
    "hafs": (6, None),
    "href": (6, None),
    "hiresw": (12, None),
}
#: Models of the point-forecast feed: hours between cycles, first day, hours to publication.
POINT_MODELS = {
    "gfs_seamless": (6, "2024-01-01", 6),
    "gfs_global": (6, "2024-01-01", 6),
    "gfs_graphcast025": (6, "2024-01-01", 6),
    "aigfs025": (6, "2026-01-07", 6),
    "hgefs025": (6, "2026-01-07", 6),
    "ncep_hrrr_conus": (1, "2024-01-01", 2),
    "ncep_nbm_conus": (1, "2024-10-08", 2),
    "ncep_nam_conus": (6, "2024-01-01", 2),
    "ecmwf_aifs025_single": (6, "2024-03-14", 6),
    "ecmwf_ifs025": (6, "2024-01-01", 6),
    "ecmwf_ifs_hres": (6, "2024-01-01", 6),
    "dwd_icon_d2": (3, "2024-01-01", 2),
    "dwd_icon_d2_15min": (3, "2024-01-01", 2),
    "dwd_icon_eu": (6, "2024-01-01", 4),
    "dwd_icon_global": (6, "2024-01-01", 4),
    "dwd_icon_seamless": (6, "2024-01-01", 4),
    "meteofrance_arome_france0025": (3, "2024-01-01", 2),
    "meteofrance_arome_france_hd": (3, "2024-01-01", 2),
    "meteofrance_arome_france_hd_15min": (3, "2024-01-01", 2),
    "meteofrance_arpege_europe": (6, "2024-01-01", 4),
    "meteofrance_arpege_world025": (6, "2024-01-01", 6),
    "meteofrance_seamless": (6, "2024-01-01", 4),
    "metno_nordic_pp": (1, "2024-01-01", 2),
    "ukmo_global_deterministic_10km": (6, "2024-01-01", 6),
    "ukmo_uk_deterministic_2km": (3, "2024-01-01", 2),
    "cmc_gem_gdps": (12, "2024-01-01", 6),
    "cmc_gem_hrdps": (6, "2024-01-01", 2),
    "cmc_gem_rdps": (6, "2024-01-01", 4),
    "bom_access_global": (6, "2024-01-01", 6),
    "cma_grapes_global": (6, "2024-01-01", 6),
    "jma_gsm": (6, "2018-01-01", 6),
    "jma_msm": (3, "2018-01-01", 2),
    "jma_seamless": (6, "2018-01-01", 6),
    "kma_gdps": (6, "2024-01-01", 6),
    "kma_ldps": (3, "2024-01-01", 2),
    "kma_seamless": (6, "2024-01-01", 6),
}
#: Public archives that hold a model's files, the preferred one first.
_NCEP, _ECMWF, _MSC = ("aws_bdp", "nomads"), ("ecmwf_gcp", "ecmwf_aws", "ecmwf_data_portal", "ecmwf_azure"), ("msc",)
MIRRORS = {
    "hrrr": _NCEP,
    "hrrrak": _NCEP,
    "gfs": _NCEP,
    "gdas": _NCEP,
    "gefs": _NCEP,
    "nbm": _NCEP,
    "rap": _NCEP,
    "rrfs": ("aws_bdp",),
    "rtma": _NCEP,
    "urma": _NCEP,
    "cfs": _NCEP,
    "ecmwf_ifs_hres": _ECMWF,
    "ecmwf_ifs_ens": _ECMWF,
    "ecmwf_aifs_single": _ECMWF,
    "ecmwf_aifs_ens": _ECMWF,
    "nam": _NCEP,
    "hrdps": _MSC,
    "rdps": _MSC,
    "gdps": _MSC,
    "geps": _MSC,
    "reps": _MSC,
    "hafs": ("nomads",),
    "href": ("nomads",),
    "hiresw": ("nomads",),
}
#: An index's variable and level for each column, and in which models they are others or missing.
_GRIB = {
    "temp_k_2m": ("TMP", "2 m above ground"),
    "dewpoint_k_2m": ("DPT", "2 m above ground"),
    "relative_humidity_pct_2m": ("RH", "2 m above ground"),
    "wind_u_ms_10m": ("UGRD", "10 m above ground"),
    "wind_v_ms_10m": ("VGRD", "10 m above ground"),
    "wind_gust_ms": ("GUST", "surface"),
    "precip_mm_1h": ("APCP", "surface"),
    "pressure_pa_surface": ("PRES", "surface"),
    "pressure_pa_mslp": ("MSLMA", "mean sea level"),
}
_IFS = {
    "temp_k_2m": ("2t", "sfc"),
    "dewpoint_k_2m": ("2d", "sfc"),
    "wind_u_ms_10m": ("10u", "sfc"),
    "wind_v_ms_10m": ("10v", "sfc"),
    "wind_gust_ms": ("10fg", "sfc"),
    "pressure_pa_surface": ("sp", "sfc"),
    "pressure_pa_mslp": ("msl", "sfc"),
}
_CANADA = {
    "temp_k_2m": ("TMP", "TGL_2"),
    "dewpoint_k_2m": ("DPT", "TGL_2"),
    "relative_humidity_pct_2m": ("RH", "TGL_2"),
    "wind_u_ms_10m": ("UGRD", "TGL_10"),
    "wind_v_ms_10m": ("VGRD", "TGL_10"),
    "wind_gust_ms": ("GUST", "TGL_10"),
    "precip_mm_1h": ("APCP", "Sfc"),
    "pressure_pa_surface": ("PRES", "Sfc"),
    "pressure_pa_mslp": ("PRMSL", "MSL"),
}
_SEA_LEVEL = {"pressure_pa_mslp": ("PRMSL", "mean sea level")}
_OTHER_VARIABLES = {
    "gfs": _SEA_LEVEL,
    "gdas": _SEA_LEVEL | {"relative_humidity_pct_2m": None, "wind_gust_ms": None},
    "gefs": _SEA_LEVEL | {"relative_humidity_pct_2m": None, "wind_gust_ms": None},
    "cfs": _SEA_LEVEL | {"dewpoint_k_2m": None, "relative_humidity_pct_2m": None, "wind_gust_ms": None, "precip_mm_1h": None, "pressure_pa_surface": None},
    "nbm": {"wind_gust_ms": ("GUST", "10 m above ground"), "pressure_pa_surface": None},
    "rtma": {"relative_humidity_pct_2m": None, "precip_mm_1h": None},
    "urma": {"relative_humidity_pct_2m": None, "precip_mm_1h": None},
    "hafs": {"relative_humidity_pct_2m": None},
    "hiresw": {"relative_humidity_pct_2m": None},
    "href": {"relative_humidity_pct_2m": None, "wind_gust_ms": None, "pressure_pa_surface": None},
    "rdps": {"relative_humidity_pct_2m": None, "wind_gust_ms": None},
    "gdps": {"relative_humidity_pct_2m": None, "wind_gust_ms": None},
    "geps": {"relative_humidity_pct_2m": None, "wind_gust_ms": None},
    "reps": {"relative_humidity_pct_2m": None, "wind_gust_ms": None},
    "ecmwf_aifs_single": {"wind_gust_ms": None},
    "ecmwf_aifs_ens": {"wind_gust_ms": None},
}
LIVE_WINDOW = timedelta(days=7)


def _model(name: str, step: int, floor: str | None, lag: int | None = None) -> Model:
    return Model(name, step, None if floor is None else datetime.fromisoformat(floor).replace(tzinfo=UTC), lag)


GRIDDED = {name: _model(name, *given) for name, given in GRIDDED_MODELS.items()}
POINT = {name: _model(name, *given) for name, given in POINT_MODELS.items()}


def gridded(name: str) -> Model:
    if name.lower() not in GRIDDED:
        raise ModelError(f"no gridded model {name!r}", models=sorted(GRIDDED))
    return GRIDDED[name.lower()]


def point(name: str) -> Model:
    if name.lower() not in POINT:
        raise ModelError(f"no point model {name!r}", models=sorted(POINT))
    return POINT[name.lower()]


def mirrors(name: str) -> tuple[str, ...]:
    """The archives of a gridded model, the preferred one first."""
    return MIRRORS[gridded(name).name]


def variables(name: str) -> dict[str, tuple[str, str]]:
    """(variable, level) in a gridded model's index, by column; what the model doesn't have is left out."""
    model = gridded(name).name
    base = _IFS if model.startswith("ecmwf") else _CANADA if MIRRORS[model] == _MSC else _GRIB
    found = base | _OTHER_VARIABLES.get(model, {})
    return {column: place for column, place in found.items() if place is not None}


def check_depth(name: str, cycle: datetime, now: datetime) -> None:
    """Raises for a cycle before the model's archive; models without an archive have the last seven days."""
    m = gridded(name)
    first = m.floor if m.floor is not None else now - LIVE_WINDOW
    if cycle < first:
        raise HistoricalDepthError(f"{name} goes back to {first.isoformat()}", model=name, cycle=cycle.isoformat())


def table(spark: SparkSession) -> DataFrame:
    rows = [(kind, m.name, list(m.hours), m.floor, m.lag_hours) for kind, ms in (("gridded", GRIDDED), ("point", POINT)) for m in ms.values()]
    return spark.createDataFrame(rows, "kind string, model string, hours array<int>, first timestamp, lag_hours int")
