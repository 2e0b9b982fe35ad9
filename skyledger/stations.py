"""The station dimension: a small built-in set, more from a table, and offsets of standard time.

Settlement days use local *standard* time all year. The offset is a property of the station, found once on the driver and
stored in the dimension, so plans hold plain interval arithmetic and no time-zone lookups.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import StationError


MOST_STATIONS = 100_000


@dataclass(frozen=True)
class Station:
    code: str
    icao: str
    tz: str
    latitude: float
    longitude: float
    country: str = "US"
    venues: tuple[str, ...] = ()

    @property
    def lst_offset_seconds(self) -> int:
        return lst_offset_seconds(self.tz)

    @property
    def is_us(self) -> bool:
        return self.country == "US" and self.icao.startswith("K")


#: Airports by code, time zone and place.
_US = {
    "ATL": ("America/New_York", 33.6407, -84.4277),
    "AUS": ("America/Chicago", 30.1975, -97.6664),
    "BNA": ("America/Chicago", 36.1245, -86.6782),
    "BOS": ("America/New_York", 42.3656, -71.0096),
    "CVG": ("America/New_York", 39.0488, -84.6678),
    "DCA": ("America/New_York", 38.8512, -77.0402),
    "DEN": ("America/Denver", 39.8561, -104.6737),
    "DFW": ("America/Chicago", 32.8998, -97.0403),
    "DTW": ("America/New_York", 42.2124, -83.3534),
    "HOU": ("America/Chicago", 29.6454, -95.2789),
    "IAH": ("America/Chicago", 29.9844, -95.3414),
    "LAS": ("America/Los_Angeles", 36.0840, -115.1537),
    "LAX": ("America/Los_Angeles", 33.9425, -118.4081),
    "MDW": ("America/Chicago", 41.7868, -87.7522),
    "MIA": ("America/New_York", 25.7959, -80.2870),
    "MSP": ("America/Chicago", 44.8848, -93.2223),
    "MSY": ("America/Chicago", 29.9934, -90.2580),
    "NYC": ("America/New_York", 40.7789, -73.9692),
    "OKC": ("America/Chicago", 35.3931, -97.6007),
    "PHL": ("America/New_York", 39.8721, -75.2411),
    "PHX": ("America/Phoenix", 33.4373, -112.0078),
    "SAT": ("America/Chicago", 29.5337, -98.4698),
    "SEA": ("America/Los_Angeles", 47.4502, -122.3088),
    "SFO": ("America/Los_Angeles", 37.6213, -122.3790),
    "SLC": ("America/Denver", 40.7884, -111.9778),
}
_ABROAD = {
    "EDDB": ("Europe/Berlin", 52.3667, 13.5033, "DE"),
    "EDDF": ("Europe/Berlin", 50.0379, 8.5622, "DE"),
    "EDDM": ("Europe/Berlin", 48.3538, 11.7861, "DE"),
    "EFHK": ("Europe/Helsinki", 60.3172, 24.9633, "FI"),
    "EGKK": ("Europe/London", 51.1481, -0.1903, "GB"),
    "EGLL": ("Europe/London", 51.4706, -0.4619, "GB"),
    "EHAM": ("Europe/Amsterdam", 52.3086, 4.7639, "NL"),
    "EKCH": ("Europe/Copenhagen", 55.6181, 12.6561, "DK"),
    "EPWA": ("Europe/Warsaw", 52.1657, 20.9671, "PL"),
    "ESSA": ("Europe/Stockholm", 59.6519, 17.9186, "SE"),
    "LEBL": ("Europe/Madrid", 41.2974, 2.0833, "ES"),
    "LEMD": ("Europe/Madrid", 40.4719, -3.5626, "ES"),
    "LFPB": ("Europe/Paris", 48.9694, 2.4414, "FR"),
    "LFPG": ("Europe/Paris", 49.0097, 2.5479, "FR"),
    "LFPO": ("Europe/Paris", 48.7233, 2.3794, "FR"),
    "LIMC": ("Europe/Rome", 45.6306, 8.7281, "IT"),
    "LIRF": ("Europe/Rome", 41.8003, 12.2389, "IT"),
    "LOWW": ("Europe/Vienna", 48.1103, 16.5697, "AT"),
    "LSZH": ("Europe/Zurich", 47.4647, 8.5492, "CH"),
    "NZAA": ("Pacific/Auckland", -37.0081, 174.7917, "NZ"),
    "NZWN": ("Pacific/Auckland", -41.3272, 174.8053, "NZ"),
    "OERK": ("Asia/Riyadh", 24.9576, 46.6988, "SA"),
    "OMDB": ("Asia/Dubai", 25.2532, 55.3657, "AE"),
    "OTHH": ("Asia/Qatar", 25.2731, 51.6080, "QA"),
    "RCTP": ("Asia/Taipei", 25.0777, 121.2328, "TW"),
    "RJAA": ("Asia/Tokyo", 35.7647, 140.3864, "JP"),
    "RJTT": ("Asia/Tokyo", 35.5522, 139.7800, "JP"),
    "RKSI": ("Asia/Seoul", 37.4691, 126.4505, "KR"),
    "SAEZ": ("America/Argentina/Buenos_Aires", -34.8222, -58.5358, "AR"),
    "SBGR": ("America/Sao_Paulo", -23.4356, -46.4731, "BR"),
    "UUEE": ("Europe/Moscow", 55.9728, 37.4147, "RU"),
    "VABB": ("Asia/Kolkata", 19.0887, 72.8679, "IN"),
    "VHHH": ("Asia/Hong_Kong", 22.3080, 113.9185, "HK"),
    "VIDP": ("Asia/Kolkata", 28.5562, 77.1000, "IN"),
    "VTBS": ("Asia/Bangkok", 13.6900, 100.7501, "TH"),
    "WSSS": ("Asia/Singapore", 1.3644, 103.9915, "SG"),
    "YBBN": ("Australia/Brisbane", -27.3842, 153.1175, "AU"),
    "YMML": ("Australia/Melbourne", -37.6733, 144.8433, "AU"),
    "YSSY": ("Australia/Sydney", -33.9461, 151.1772, "AU"),
    "ZBAA": ("Asia/Shanghai", 40.0801, 116.5846, "CN"),
    "ZSPD": ("Asia/Shanghai", 31.1443, 121.8083, "CN"),
}
#: Zones of US codes beyond the registry.
_ZONES = {
    "ABQ": "America/Denver",
    "ALB": "America/New_York",
    "ANC": "America/Anchorage",
    "BHM": "America/Chicago",
    "BIR": "America/Chicago",
    "BOI": "America/Boise",
    "BTR": "America/Chicago",
    "BTV": "America/New_York",
    "BUF": "America/New_York",
    "BUR": "America/Los_Angeles",
    "BWI": "America/New_York",
    "BZN": "America/Denver",
    "CHS": "America/New_York",
    "CLE": "America/New_York",
    "CLT": "America/New_York",
    "CMH": "America/New_York",
    "DAL": "America/Chicago",
    "DSM": "America/Chicago",
    "EWR": "America/New_York",
    "FAI": "America/Anchorage",
    "FAT": "America/Los_Angeles",
    "FLL": "America/New_York",
    "GJT": "America/Denver",
    "GSO": "America/New_York",
    "HNL": "Pacific/Honolulu",
    "HSV": "America/Chicago",
    "IAD": "America/New_York",
    "IND": "America/Indiana/Indianapolis",
    "JAX": "America/New_York",
    "JFK": "America/New_York",
    "JNU": "America/Juneau",
    "KOA": "Pacific/Honolulu",
    "LGA": "America/New_York",
    "LIT": "America/Chicago",
    "MCI": "America/Chicago",
    "MCO": "America/New_York",
    "MEM": "America/Chicago",
    "MKE": "America/Chicago",
    "MOB": "America/Chicago",
    "OAK": "America/Los_Angeles",
    "OGG": "Pacific/Honolulu",
    "OMA": "America/Chicago",
    "ONT": "America/Los_Angeles",
    "ORD": "America/Chicago",
    "ORF": "America/New_York",
    "PBI": "America/New_York",
    "PDX": "America/Los_Angeles",
    "PIT": "America/New_York",
    "RDU": "America/New_York",
    "RIC": "America/New_York",
    "RNO": "America/Los_Angeles",
    "RSW": "America/New_York",
    "SAN": "America/Los_Angeles",
    "SAV": "America/New_York",
    "SDF": "America/Chicago",
    "SHV": "America/Chicago",
    "SJC": "America/Los_Angeles",
    "SMF": "America/Los_Angeles",
    "SNA": "America/Los_Angeles",
    "STL": "America/Chicago",
    "SYR": "America/New_York",
    "TPA": "America/New_York",
    "TUL": "America/Chicago",
    "TUS": "America/Phoenix",
}
#: Exchange cities and the stations that settle them, and stations that are often taken for them.
EXCHANGE_CITIES = {
    "ATL": "ATL",
    "AUS": "AUS",
    "BNA": "BNA",
    "BOS": "BOS",
    "CHI": "MDW",
    "CVG": "CVG",
    "DAL": "DFW",
    "DCA": "DCA",
    "DEN": "DEN",
    "DTW": "DTW",
    "HOU": "IAH",
    "LAX": "LAX",
    "MIA": "MIA",
    "MSP": "MSP",
    "NYC": "NYC",
    "PHL": "PHL",
    "PHX": "PHX",
    "SEA": "SEA",
    "SFO": "SFO",
    "SLC": "SLC",
    "TLV": "LAS",
}
EXCHANGE_DENIED = frozenset({"KLGA", "KJFK", "KEWR", "KORD", "KIAD", "KBWI", "KOAK", "KHOU", "KDAL"})
#: Cities of the event market and their stations; a city may have another one for the low.
_EVENT_CITIES = {
    "amsterdam": "EHAM",
    "atlanta": "KATL",
    "auckland": "NZAA",
    "austin": "KAUS",
    "bangkok": "VTBS",
    "barcelona": "LEBL",
    "beijing": "ZBAA",
    "berlin": "EDDB",
    "boston": "KBOS",
    "brisbane": "YBBN",
    "buenos_aires": "SAEZ",
    "chicago": "KORD",
    "copenhagen": "EKCH",
    "dallas": "KDFW",
    "delhi": "VIDP",
    "denver": "KDEN",
    "detroit": "KDTW",
    "doha": "OTHH",
    "dubai": "OMDB",
    "frankfurt": "EDDF",
    "helsinki": "EFHK",
    "hong_kong": "VHHH",
    "houston": "KIAH",
    "london": "EGLL",
    "london_gatwick": "EGKK",
    "los_angeles": "KLAX",
    "madrid": "LEMD",
    "melbourne": "YMML",
    "miami": "KMIA",
    "milan": "LIMC",
    "minneapolis": "KMSP",
    "moscow": "UUEE",
    "mumbai": "VABB",
    "munich": "EDDM",
    "nyc": "KLGA",
    "paris": "LFPG",
    "paris_orly": "LFPO",
    "philadelphia": "KPHL",
    "phoenix": "KPHX",
    "riyadh": "OERK",
    "rome": "LIRF",
    "san_francisco": "KSFO",
    "sao_paulo": "SBGR",
    "seattle": "KSEA",
    "seoul": "RKSI",
    "shanghai": "ZSPD",
    "singapore": "WSSS",
    "stockholm": "ESSA",
    "sydney": "YSSY",
    "taipei": "RCTP",
    "tokyo": "RJTT",
    "tokyo_narita": "RJAA",
    "vienna": "LOWW",
    "warsaw": "EPWA",
    "washington_dc": "KDCA",
    "wellington": "NZWN",
    "zurich": "LSZH",
}
_EVENT_LOWS = {"paris": "LFPB"}
EVENT_DENIED = {"nyc": ("KEWR", "KJFK", "KNYC"), "chicago": ("KMDW",), "houston": ("KHOU",), "dallas": ("KDAL",), "san_francisco": ("KOAK",), "washington_dc": ("KBWI", "KIAD")}
#: The exchange's short names and the event market's long ones.
CITY_ALIASES = {
    "NYC": "nyc",
    "CHI": "chicago",
    "LAX": "los_angeles",
    "MIA": "miami",
    "DEN": "denver",
    "BOS": "boston",
    "AUS": "austin",
    "DCA": "washington_dc",
    "PHL": "philadelphia",
    "SFO": "san_francisco",
    "SEA": "seattle",
    "ATL": "atlanta",
    "HOU": "houston",
    "DAL": "dallas",
    "PHX": "phoenix",
    "MSP": "minneapolis",
    "DTW": "detroit",
}


def event_cities() -> list[tuple[str, str, str]]:
    """(city, measure, icao) with the default of every city and the high and low of those that part them."""
    rows = []
    for city, icao in _EVENT_CITIES.items():
        rows.append((city, "default", icao))
        if city in _EVENT_LOWS:
            rows += [(city, "high", icao), (city, "low", _EVENT_LOWS[city])]
    return rows


def zone_of(code: str) -> str:
    """The time zone of a registered station or of one of the other US codes."""
    return _ZONES.get(code.upper()) or REGISTRY.get(code).tz


def zones(spark: SparkSession) -> DataFrame:
    """icao, tz of the registered stations and of the other US codes."""
    known = {s.icao: s.tz for s in REGISTRY.stations.values()} | {"K" + code: tz for code, tz in _ZONES.items()}
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{i}', '{tz}')" for i, tz in known.items()) + " AS t(icao, tz)")


def city_stations(name: str, registry: Registry | None = None) -> list[str]:
    """Stations of a city under its short or long name, in order and once each: the exchange's, the event market's, and those that are often taken for them."""
    key = name.strip()
    short = key.upper() if key.upper() in EXCHANGE_CITIES else next((s for s, long in CITY_ALIASES.items() if long == key.lower()), None)
    long = CITY_ALIASES.get(short or "", key.lower())
    found = ["K" + EXCHANGE_CITIES[short]] if short else []
    found += [i for c, m, i in sorted(event_cities(), key=lambda r: ("default", "high", "low").index(r[1])) if c == long]
    found += sorted(EVENT_DENIED.get(long, ()))
    if not found:
        raise StationError(f"no city {name!r}", city=name)
    return list(dict.fromkeys(found))


def _built_in() -> dict[str, Station]:
    found = {}
    for code, (tz, lat, lon) in _US.items():
        found[code] = Station(code, "K" + code, tz, lat, lon, venues=("kalshi",) if code in EXCHANGE_CITIES.values() else ())
    for code, (tz, lat, lon, country) in _ABROAD.items():
        found[code] = Station(code, code, tz, lat, lon, country, ("polymarket",))
    return found


def lst_offset_seconds(tz: str) -> int:
    """The zone's offset without daylight saving: January's if January has none, else July's (southern hemisphere)."""
    try:
        zone = ZoneInfo(tz)
    except (ZoneInfoNotFoundError, ValueError) as unknown:
        raise StationError(f"no time zone {tz!r}", tz=tz) from unknown
    for month in (1, 7):
        at = datetime(2024, month, 15, 12, tzinfo=zone)
        if not at.dst():
            return int(at.utcoffset().total_seconds())
    raise StationError(f"{tz!r} has no standard time", tz=tz)


class Registry:
    def __init__(self, stations: dict[str, Station] | None = None):
        self.stations = dict(_built_in() if stations is None else stations)

    @classmethod
    def from_table(cls, df: DataFrame) -> Registry:
        """From a table with code, icao, tz, latitude, longitude and, optionally, country and venues (array). A registry is kept on the driver, so one of over MOST_STATIONS rows is an error."""
        names = set(df.columns)
        rows = df.limit(MOST_STATIONS + 1).collect()
        if len(rows) > MOST_STATIONS:
            raise StationError(f"a registry has {MOST_STATIONS} stations at most")
        return cls({r["code"]: Station(r["code"], r["icao"], r["tz"], r["latitude"], r["longitude"], r["country"] if "country" in names else "US", tuple(r["venues"] or ()) if "venues" in names else ()) for r in rows})

    def get(self, name: str) -> Station:
        """By code or ICAO."""
        key = name.strip().upper()
        if key in self.stations:
            return self.stations[key]
        for s in self.stations.values():
            if s.icao == key:
                return s
        raise StationError(f"no station {name!r}", station=name)

    def filter(self, venue: str | None = None, country: str | None = None) -> list[Station]:
        found = [s for s in self.stations.values() if (venue is None or venue in s.venues) and (country is None or s.country == country)]
        return sorted(found, key=lambda s: s.icao)

    def venues(self) -> list[str]:
        return sorted({v for s in self.stations.values() for v in s.venues})

    def table(self, spark: SparkSession) -> DataFrame:
        """The dimension: code, icao, tz, latitude, longitude, country, venues, lst_offset_seconds."""
        columns = "code, icao, tz, latitude, longitude, country, venues, lst_offset_seconds"
        if not self.stations:
            return spark.sql(f"SELECT * FROM VALUES ('', '', '', 0D, 0D, '', array(''), 0) AS t({columns}) WHERE false")
        text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        rows = [f"({text(s.code)}, {text(s.icao)}, {text(s.tz)}, {s.latitude!r}D, {s.longitude!r}D, {text(s.country)}, cast(array({', '.join(map(text, s.venues))}) AS array<string>), {s.lst_offset_seconds})" for s in self.stations.values()]
        return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({columns})")  # a local relation: no job and no Python is needed to read it


REGISTRY = Registry()


def with_station(df: DataFrame, registry: Registry = REGISTRY, code: str = "station_code") -> DataFrame:
    """df with the station's tz and lst_offset_seconds; the dimension has as many rows as the registry, so it is broadcast."""
    dim = registry.table(df.sparkSession).select(F.col("code").alias("_code"), "tz", "lst_offset_seconds")
    return df.join(F.broadcast(dim), F.col(code) == F.col("_code"), "left").drop("_code")
