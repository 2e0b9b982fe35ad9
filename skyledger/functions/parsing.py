"""Parsers of report fields as column expressions: no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of parsed fields; what is outside becomes null and is never clamped.
BOUNDS = {
    "temp_c": (-90.0, 60.0),
    "dewpoint_c": (-90.0, 60.0),
    "wind_dir_degrees": (0, 360),
    "wind_speed_kt": (0, 200),
    "wind_gust_kt": (0, 250),
    "sea_level_pressure_mb": (870.0, 1084.0),
    "sky_base_ft": (0, 60000),
    "high_temp_f": (-60, 150),
    "low_temp_f": (-80, 130),
}
MAX_VISIBILITY, MAX_METAR, MAX_CODES, YEARS = 99.99, 2048, 256, (1940, 2100)
ACCEPTED_QC = ("0", "1", "4", "5", "")
COVERS = ("CLR", "SKC", "FEW", "SCT", "BKN", "OVC", "VV")
ISSUER, TICKER = r"\A[a-z][a-z0-9._-]{0,31}\z", r"\A(?=.*[^.])[A-Za-z0-9._-]{1,128}\z"
STATION_CODE, FEED_STATION_ID = r"\A[A-Z]{3,4}\z", r"\A[A-Z0-9][A-Z0-9-]{0,31}\z"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x, missing: str = "M") -> Column:
    """A double, or null where the text is empty, the missing mark, no number, or not finite."""
    text = F.trim(col(x).cast("string"))
    value = F.when((text == "") | (text == missing), None).otherwise(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def precipitation(x) -> Column:
    """As number(), a trace (T) being 0."""
    return F.when(F.upper(F.trim(col(x).cast("string"))) == "T", F.lit(0.0)).otherwise(number(x))


def within(x, name: str) -> Column:
    low, high = BOUNDS[name]
    return F.when(col(x).between(low, high), col(x))


def observed_at(x) -> Column:
    """'YYYY-MM-DD HH:MM' in UTC as a timestamp; null for other shapes, impossible times and years out of range."""
    text = F.regexp_extract(F.coalesce(col(x).cast("string"), F.lit("")), r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2})(?::\d{2}Z?)?$", 1)
    at = F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm"))
    return F.when(F.year(at).between(*YEARS), at)


def _remarks(raw) -> Column:
    raw = F.coalesce(col(raw), F.lit(""))
    return F.when(F.locate("RMK", raw) > 0, F.substring(raw, F.locate("RMK", raw), F.length(raw))).otherwise(F.lit(""))


def tenths_group(raw) -> tuple[Column, Column]:
    """Temperature and dew point in C from a T-group in the remarks (T, sign, three digits, sign, three digits)."""
    pattern, rest = r"\bT([01])(\d{3})([01])(\d{3})\b", _remarks(raw)

    def part(k: int) -> Column:
        digits = F.regexp_extract(rest, pattern, k + 1).try_cast("double") / 10
        return F.when(F.regexp_extract(rest, pattern, k) == "1", -digits).otherwise(digits)

    return part(1), part(3)


def visibility(x) -> Column:
    """Miles from '10+', '1 1/2', '3/4', 'M1/4' or a number, at most 99.99."""
    text = F.trim(col(x).cast("string"))
    num = r"[+-]?(?:\d+\.?\d*|\.\d+)"
    at = lambda p, k: F.regexp_extract(text, p, k).try_cast("double")
    plus, mixed, ratio, plain = rf"^({num})\+$", rf"^({num}) ({num})/({num})$", rf"^[Mm]?({num})/({num})$", rf"^({num})$"
    value = (
        F.when(text.rlike(plus), at(plus, 1))
        .when(text.rlike(mixed), at(mixed, 1) + F.try_divide(at(mixed, 2), at(mixed, 3)))
        .when(text.rlike(ratio), F.try_divide(at(ratio, 1), at(ratio, 2)))
        .when(text.rlike(plain), at(plain, 1))
    )
    return F.when(value.isNotNull(), F.least(value, F.lit(MAX_VISIBILITY)))


def cloud_cover(x, canonical: bool = False) -> Column:
    """The standard abbreviation or null; CAVOK is CLR. canonical: SKC is CLR too, as the canonical schema has it."""
    code = F.upper(col(x))
    out = F.when(code.isin(*COVERS), code).when(code == "CAVOK", F.lit("CLR"))
    return F.when(out == "SKC", F.lit("CLR")).otherwise(out) if canonical else out


def peak_wind(raw) -> tuple[Column, Column, Column]:
    """Direction, speed in kt and time (hhmm) of the remark PK WND dddss(s)/hhmm."""
    pattern = r"PK WND (\d{3})(\d{2,3})/(\d{4})"
    raw = F.coalesce(col(raw), F.lit(""))
    part = [F.regexp_extract(raw, pattern, k) for k in (1, 2, 3)]
    ok = part[0].try_cast("int").between(0, 360)
    return F.when(ok, part[0].try_cast("int")), F.when(ok, part[1].try_cast("int")), F.when(ok, part[2])


def weather_codes(values: list, qc: list) -> Column:
    """Codes joined by a space: without those whose quality is 3 or P and without purely numeric ones."""
    kept = [F.when(~F.coalesce(col(q), F.lit("")).isin("3", "P") & ~F.coalesce(col(v), F.lit("")).rlike(r"^\s*[\d.]*\s*$"), F.trim(col(v))) for v, q in zip(values, qc, strict=True)]
    joined = F.substring(F.concat_ws(" ", *kept), 1, MAX_CODES)
    return F.when(joined != "", joined)


def icao_to_code(x) -> Column:
    """Without the K of a four-letter US identifier."""
    return F.when((F.length(col(x)) == 4) & F.startswith(col(x), F.lit("K")), F.substring(col(x), 2, 3)).otherwise(col(x))


def report_type(product_id, observation_date) -> Column:
    """preliminary, final or correction by when the product was issued: up to the day itself; the next day from 4 to 10:59; later or else. An unreadable product is preliminary."""
    at = F.try_to_timestamp(F.substring(F.regexp_extract(F.coalesce(col(product_id), F.lit("")), r"^(\d{12})", 1), 1, 12), F.lit("yyyyMMddHHmm"))
    days = F.datediff(at, col(observation_date))
    return F.when(at.isNull() | (days <= 0), F.lit("preliminary")).when((days == 1) & F.hour(at).between(4, 10), F.lit("final")).otherwise(F.lit("correction"))


def accepted(value, qc) -> Column:
    """The value where its quality code is acceptable or missing."""
    return F.when(F.coalesce(F.trim(col(qc)), F.lit("")).isin(*ACCEPTED_QC), col(value))


def valid_station_code(x) -> Column:
    return col(x).rlike(STATION_CODE)


def valid_feed_station_id(x) -> Column:
    return col(x).rlike(FEED_STATION_ID)


def valid_issuer(x) -> Column:
    """Whether a text may name an issuer's folder."""
    return col(x).rlike(ISSUER)


def valid_ticker(x) -> Column:
    """Whether a text may name a ticker's folder; dots alone may not."""
    return col(x).rlike(TICKER)
