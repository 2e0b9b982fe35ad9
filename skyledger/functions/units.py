"""Unit conversions as column expressions. Null stays null; evaluation order is kept so results agree to the bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Feeds use different factors for knots; each path keeps its own.
KT_TO_MS, KT_TO_MS_QC, KT_TO_MS_MOS = 1852 / 3600, 0.514444, 0.5144444
KT_TO_MPH, MI_TO_KM, MI_TO_M, FT_TO_M, IN_TO_MM, HPA_TO_INHG = 1.15078, 1.609344, 1609.344, 0.3048, 25.4, 0.0295299875


def _d(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def c_to_f(c):
    return _d(c) * 9 / 5 + 32


def f_to_c(f):
    return (_d(f) - 32) * 5 / 9


def k_to_f(k):
    return (_d(k) - 273.15) * 9 / 5 + 32


def kt_to_ms(kt, factor: float = KT_TO_MS):
    return _d(kt) * factor


def ms_to_kt(ms, factor: float = KT_TO_MS_QC):
    return _d(ms) / factor


def kt_to_mph(kt):
    return _d(kt) * KT_TO_MPH


def mi_to_km(mi):
    return _d(mi) * MI_TO_KM


def km_to_mi(km):
    return _d(km) / MI_TO_KM


def mi_to_m(mi):
    return _d(mi) * MI_TO_M


def ft_to_m(ft):
    return _d(ft) * FT_TO_M


def m_to_ft(m):
    return _d(m) / FT_TO_M


def in_to_mm(inch):
    return _d(inch) * IN_TO_MM


def mm_to_in(mm):
    return _d(mm) / IN_TO_MM


def hpa_to_inhg(hpa):
    return _d(hpa) * HPA_TO_INHG


def finite(x):
    """x, or null where it is NaN or infinite."""
    x = _d(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def half_up(x, places: int):
    """Rounding half away from zero."""
    return F.round(_d(x), places)


def half_even_int(x):
    """Rounding to the nearest integer, ties to even."""
    return F.rint(_d(x)).cast("int")
