"""Derived weather quantities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import finite, kt_to_mph

#: The Magnus coefficients.
MAGNUS_A, MAGNUS_B = 17.625, 243.04


def relative_humidity(temp_c, dewpoint_c) -> Column:
    """Percent by the Magnus formula, within 0 to 100; null unless both are finite."""
    t, d = finite(temp_c), finite(dewpoint_c)
    rh = 100.0 * F.exp(MAGNUS_A * d / (MAGNUS_B + d)) / F.exp(MAGNUS_A * t / (MAGNUS_B + t))
    return F.when(rh.isNotNull(), F.greatest(F.lit(0.0), F.least(rh, F.lit(100.0))))


def _chill(t: Column, v: Column) -> Column:
    power = F.pow(v, F.lit(0.16))
    return 35.74 + 0.6215 * t - 35.75 * power + 0.4275 * t * power


def wind_chill(temp_f, wind_mph) -> Column:
    """The 2001 wind chill; the temperature itself above 50 F or up to 3 mph."""
    t, v = finite(temp_f), finite(wind_mph)
    return F.when(t.isNull() | v.isNull(), None).when((t > 50.0) | (v <= 3.0), t).otherwise(_chill(t, v))


#: The Rothfusz regression, (coefficient, power of T, power of RH).
ROTHFUSZ = ((-42.379, 0, 0), (2.04901523, 1, 0), (10.14333127, 0, 1), (-0.22475541, 1, 1), (-0.00683783, 2, 0), (-0.05481717, 0, 2), (0.00122874, 2, 1), (0.00085282, 1, 2), (-0.00000199, 2, 2))


def _heat(t: Column, h: Column) -> Column:
    simple = 0.5 * (t + 61.0 + (t - 68.0) * 1.2 + h * 0.094)
    full = F.lit(0.0)
    for k, a, b in ROTHFUSZ:
        term = F.lit(k)
        for factor in [t] * a + [h] * b:
            term = term * factor
        full = full + term
    dry = (13.0 - h) / 4.0 * F.sqrt((17.0 - F.abs(t - 95.0)) / 17.0)
    humid = (h - 85.0) / 10.0 * ((87.0 - t) / 5.0)
    adjusted = F.when((h < 13.0) & t.between(80.0, 112.0), full - dry).when((h > 85.0) & t.between(80.0, 87.0), full + humid).otherwise(full)
    return F.when((simple + t) / 2.0 < 80.0, simple).otherwise(adjusted)


def heat_index(temp_f, rh_pct) -> Column:
    """The heat index from 80 F on; the temperature itself below."""
    t, h = finite(temp_f), finite(rh_pct)
    return F.when(t.isNull() | h.isNull(), None).when(t < 80.0, t).otherwise(_heat(t, h))


def feels_like(temp_f, wind_kt, rh_pct) -> Column:
    """Wind chill up to 50 F with over 3 mph; heat index from 80 F with a known humidity; else the temperature. A missing wind counts as calm, a non-finite one gives null."""
    t, h = finite(temp_f), finite(rh_pct)
    wind = wind_kt if isinstance(wind_kt, Column) else F.col(wind_kt)
    v = finite(F.when(wind.isNull(), F.lit(0.0)).otherwise(kt_to_mph(wind)))
    return F.when(t.isNull() | v.isNull(), None).when((t <= 50.0) & (v > 3.0), _chill(t, v)).when((t >= 80.0) & h.isNotNull(), _heat(t, h)).otherwise(t)
