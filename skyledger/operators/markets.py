"""Prediction-market payloads, contracts, events and settlement. Row by row everything is a column expression; failures are statuses, not exceptions."""

from __future__ import annotations

import re
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ContractError, SelectorError
from ..functions.parsing import col
from ..functions.temporal import local_end_of_day, slug_date
from ..functions.units import c_to_f
from ..stations import EXCHANGE_CITIES

INTERVALS = {"1m": 60, "1h": 3600, "1d": 86400}
#: Words of daily highs and lows, hosts of settlement sources, and how many hours after the local day they are final.
HIGH = ("highest", "high", "hottest", "warmest", "max", "maximum")
LOW = ("lowest", "low", "coldest", "coolest", "min", "minimum")
HOSTS = {"www.wunderground.com": "wunderground", "wunderground.com": "wunderground", "www.weather.gov": "noaa_wrh", "weather.gov": "noaa_wrh"}
DELAY_HOURS = {"wunderground": 6, "noaa_wrh": 4, "other": 24}
DESCRIPTION_BYTES = 16 * 1024
EVENT_ID = r"\A[A-Za-z0-9_-]{1,128}\z"
DEFERRED = (("VHHH", "low"), ("RCTP", "high"), ("RCTP", "low"), ("RCTP", "default"))
CITY_OF_TICKER = EXCHANGE_CITIES | {"NY": "NYC"}
#: How the paths of settlement pages begin.
PAGES = (("pws",), ("history", "daily"), ("history", "airport"), ("weather-station",), ("cat", "forecasts"))
#: Names of cities that are looked for in texts, at most.
MOST_CITIES = 2_000
_URL = r"https?://(?:www\.)?wunderground\.com/(?:dashboard/)?(?:pws|history/daily|history/airport|weather-station|cat/forecasts)/(?:[a-z0-9-]+/)*(K[A-Z]{3})(?![A-Za-z0-9_-])"
_URL = r"https?://[^\s<>\"')]+"


# -- payloads


def cents(x) -> Column:
    """Dollars as a text to cents; fractions of a cent stay."""
    return col(x).cast("string").try_cast("double") * 100.0


def whole(x) -> Column:
    """A fixed-point text such as '100.00' to an integer, cut off."""
    value = col(x).cast("string").try_cast("double")
    return F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("bigint")


def _key(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, f"$.{path}")


def _has(payload: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(payload), name), F.lit(False))


def candles(df: DataFrame, payload: str = "payload", source: str = "kalshi") -> DataFrame:
    """One row per candle (a JSON text): ts, open, high, low, close in cents, volume, open_interest, source. Which form a field has is told by the presence of its key: <name>_dollars and <name>_fp first, plain cents and counts else."""
    p = F.col(payload)
    price = F.coalesce(_key(p, "price"), F.lit("{}"))
    ohlc = [F.when(_has(price, f"{n}_dollars"), cents(_key(price, f"{n}_dollars"))).otherwise(_key(price, n).try_cast("double")).alias(n) for n in ("open", "high", "low", "close")]
    fp = [F.when(_has(p, f"{n}_fp"), whole(_key(p, f"{n}_fp"))).otherwise(_key(p, n).try_cast("bigint")).alias(n) for n in ("volume", "open_interest")]
    keep = [c for c in df.columns if c != payload]
    return df.select(*keep, F.timestamp_seconds(_key(p, "end_period_ts").try_cast("bigint")).alias("ts"), *ohlc, *fp, F.lit(source).alias("source"))


def order_book(df: DataFrame, payload: str = "payload", source: str = "kalshi") -> DataFrame:
    """One row per side and level of a book (a JSON text): side, price in cents, size, source."""
    p = F.col(payload)
    new = _has(p, "orderbook_fp")

    def levels(side: str) -> Column:
        found = F.when(new, F.from_json(_key(p, f"orderbook_fp.{side}_dollars"), "array<array<string>>")).otherwise(F.from_json(_key(p, f"orderbook.{side}"), "array<array<string>>"))
        return F.transform(F.coalesce(found, F.array().cast("array<array<string>>")), lambda x: F.struct(F.lit(side).alias("side"), F.try_element_at(x, F.lit(1)).alias("p"), F.try_element_at(x, F.lit(2)).alias("n")))

    sides = [levels("yes"), levels("no")]
    keep = [c for c in df.columns if c != payload]
    rows = df.select(*keep, new.alias("_new"), F.explode(F.concat(*sides)).alias("_l")).filter(F.col("_l.n").isNotNull())
    price = F.when(F.col("_new"), cents("_l.p")).otherwise(F.col("_l.p").try_cast("double"))
    size = F.when(F.col("_new"), whole("_l.n")).otherwise(F.col("_l.n").try_cast("bigint"))
    return rows.select(*keep, F.col("_l.side").alias("side"), price.alias("price"), size.alias("size"), F.lit(source).alias("source"))


def fills(df: DataFrame, payload: str = "payload", source: str = "kalshi") -> DataFrame:
    """One row per trade (a JSON text): trade_id, ts, price in cents of yes, count, taker_side, source."""
    p = F.col(payload)
    price = F.when(_has(p, "yes_price_dollars"), cents(_key(p, "yes_price_dollars"))).otherwise(_key(p, "yes_price").try_cast("double"))
    count = F.when(_has(p, "count_fp"), whole(_key(p, "count_fp"))).otherwise(_key(p, "count").try_cast("bigint"))
    keep = [c for c in df.columns if c != payload]
    return df.select(*keep, _key(p, "trade_id").alias("trade_id"), F.to_timestamp(_key(p, "created_time")).alias("ts"), price.alias("price"), count.alias("count"), _key(p, "taker_side").alias("taker_side"), F.lit(source).alias("source"))


def texts(x) -> Column:
    """array<string> from a JSON list or a text that holds one."""
    return F.from_json(col(x).cast("string"), "array<string>")


def outcomes(df: DataFrame, names: str = "outcomes", prices: str = "outcomePrices") -> DataFrame:
    """One row per outcome of a market: outcome, price; short lists are padded with null."""
    keep = [c for c in df.columns if c not in (names, prices)]
    pairs = F.arrays_zip(texts(names).alias("outcome"), texts(prices).alias("price"))
    return df.select(*keep, F.explode(pairs).alias("_o")).select(*keep, F.col("_o.outcome").alias("outcome"), F.col("_o.price").try_cast("double").alias("price"))


def price_history(df: DataFrame, payload: str = "payload", source: str = "polymarket") -> DataFrame:
    """One row per point of a price history (a JSON text with history: [{t, p}]): ts, price, source; points without a time are left out."""
    keep = [c for c in df.columns if c != payload]
    points = F.from_json(_key(F.col(payload), "history"), "array<struct<t:bigint,p:double>>")
    rows = df.select(*keep, F.explode(points).alias("_p")).filter(F.col("_p.t").isNotNull())
    return rows.select(*keep, F.timestamp_seconds("_p.t").alias("ts"), F.col("_p.p").alias("price"), F.lit(source).alias("source"))


# -- contracts and events


def _holds_word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(r"(?i)\b(" + "|".join(words) + r")\b")


def measure(text) -> Column:
    """high, low, or default if the words of neither or of both are there."""
    given = F.coalesce(col(text), F.lit(""))
    high, low = _holds_word(given, HIGH), _holds_word(given, LOW)
    return F.when(low & ~high, "low").when(high & ~low, "high").otherwise("default")


def url_icao(text) -> Column:
    """The station that the text's settlement pages agree on; null if there is none or they disagree.

    A page's path names its kind, then places in lower case, then the station in capitals. Step by step over the list of
    URLs, so that each step finds what the one before made of a URL and doesn't make it again.
    """
    hosts = [h for h, kind in HOSTS.items() if kind == "wunderground"]
    none = F.lit(None).cast("array<string>")
    parts = F.filter(F.transform(urls(text), lambda u: F.split(F.regexp_replace(u, r"^https?://", ""), "/")), lambda p: p[0].isin(*hosts))
    paths = F.transform(parts, lambda p: F.slice(p, F.when(F.try_element_at(p, F.lit(2)) == "dashboard", 3).otherwise(2), F.size(p)))
    rests = F.transform(paths, lambda p: reduce(lambda out, kind: F.when(F.slice(p, 1, len(kind)) == F.array(*map(F.lit, kind)), F.slice(p, len(kind) + 1, F.size(p))).otherwise(out), PAGES, none))
    names = F.transform(rests, lambda r: F.try_element_at(F.filter(r, lambda x: ~x.rlike("^[a-z0-9-]+$")), F.lit(1)))
    codes = F.transform(names, lambda x: F.regexp_extract(x, r"^(K[A-Z]{3})(?![A-Za-z0-9_-])", 1))
    found = F.array(F.array_distinct(F.filter(codes, lambda c: c != "")))
    return F.try_element_at(F.try_element_at(F.filter(found, lambda f: F.size(f) == 1), F.lit(1)), F.lit(1))


def urls(text) -> Column:
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(_URL), F.lit(0))


def _hosts(text) -> Column:
    return F.transform(urls(text), lambda u: F.lower(F.regexp_extract(u, r"^https?://([^/?#]*)", 1)))


def description_ok(text) -> Column:
    """At most 16 KB, and every URL of an allowed host."""
    foreign = F.exists(_hosts(text), lambda h: (h != "") & ~h.isin(*HOSTS))
    return (F.octet_length(F.coalesce(col(text), F.lit(""))) <= DESCRIPTION_BYTES) & ~foreign


def source_type(text) -> Column:
    """The settlement source by the first allowed host; other if there is none."""
    first = F.try_element_at(F.filter(_hosts(text), lambda h: h.isin(*HOSTS)), F.lit(1))
    return F.coalesce(reduce(lambda out, kv: F.when(first == kv[0], F.lit(kv[1])).otherwise(out), HOSTS.items(), F.lit(None).cast("string")), F.lit("other"))


def contract_parts(ticker) -> tuple[Column, Column, Column]:
    """(measure, city, date) of a contract such as KXHIGHNY-25MAY26-T79; nulls for other shapes."""
    pattern = r"^KX?(HIGH|LOW)(?:T)?([A-Z]{2,5})-(\d{2}[A-Z]{3}\d{2})"
    t = F.upper(F.coalesce(col(ticker), F.lit("")))
    part = [F.regexp_extract(t, pattern, k) for k in (1, 2, 3)]
    none = F.lit(None).cast("string")
    day = F.concat(F.lit("20"), F.substring(part[2], 1, 2), F.lit("-"), F.initcap(F.substring(part[2], 3, 3)), F.lit("-"), F.substring(part[2], 6, 2))
    return F.when(part[0] != "", F.lower(part[0])).otherwise(none), F.when(part[1] != "", part[1]).otherwise(none), F.when(part[2] != "", F.try_to_date(day, "yyyy-MMM-dd"))


def resolve_contracts(df: DataFrame, ticker: str = "ticker", cities: dict[str, str] | None = None) -> DataFrame:
    """df with measure, city, contract_date, station and status (resolved, unknown_city, malformed)."""
    m, city, day = contract_parts(ticker)
    station = reduce(lambda out, kv: F.when(city == kv[0], F.lit(kv[1])).otherwise(out), (cities or CITY_OF_TICKER).items(), F.lit(None).cast("string"))
    status = F.when(m.isNull() | day.isNull(), "malformed").when(station.isNull(), "unknown_city").otherwise("resolved")
    return df.withColumns({"measure": m, "city": city, "contract_date": day, "station": station, "status": status})


def resolve_contract(ticker: str, day: date | None = None, cities: dict[str, str] | None = None) -> tuple[str, str]:
    """(measure, station) of one contract; raises for what resolve_contracts() marks."""
    if isinstance(day, datetime):
        raise ContractError("the day is a date, not an instant")
    found = re.match(r"KX?(HIGH|LOW)T?([A-Z]{2,5})(?:-|$)", ticker.upper())
    if not found:
        raise ContractError(f"{ticker!r} is no contract")
    table = cities or CITY_OF_TICKER
    if found[2] not in table:
        raise ContractError(f"no station for {found[2]!r}", city=found[2])
    return found[1].lower(), table[found[2]]


def check_selector(**given) -> str:
    """The one selector that is given (station, city, contract, contracts); none or several are an error."""
    chosen = [k for k, v in given.items() if v is not None]
    if len(chosen) != 1:
        raise SelectorError("exactly one selector is needed", given=chosen)
    return chosen[0]


def derive_city(df: DataFrame, cities: DataFrame | list[str], text: str) -> DataFrame:
    """df with city: the longest name (of equal ones the first) that the text holds, spelled with spaces, hyphens or neither. The names (a list, or a table's column city) become part of the plan, so more than MOST_CITIES are an error."""
    names = cities if isinstance(cities, list) else [r[0] for r in cities.select("city").distinct().limit(MOST_CITIES + 1).collect()]
    if len(names) > MOST_CITIES:
        raise ValueError(f"at most {MOST_CITIES} names can be looked for")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.lit(None).cast("string")
    for name in sorted({n.lower() for n in names if n}, key=lambda n: (len(n), [-ord(c) for c in n])):  # the last one wins
        found = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(spelled)) for spelled in dict.fromkeys((name, name.replace(" ", "-"), name.replace(" ", "")))]), F.lit(name)).otherwise(found)
    return df.withColumn("city", found)


def resolve_events(events: DataFrame, cities: DataFrame) -> DataFrame:
    """events (id, slug, title, description, city) with measure, icao, station_measure, source_type, settlement_date and status.

    The station comes from the settlement page's URL, else from the city: its entry for the measure, else its default.
    cities: city, measure, icao. status: ok, bad_id, bad_description, unknown_city, deferred, ambiguous_measure or no_date.
    """
    words = F.concat_ws(" ", F.col("title"), F.col("slug"))
    rows = events.withColumn("measure", measure(words)).withColumn("_url", url_icao("description")).withColumn("source_type", source_type("description")).withColumn("settlement_date", slug_date("slug"))
    by_city = cities.groupBy(F.lower("city").alias("_city")).agg(*[F.max(F.when(F.col("measure") == m, F.col("icao"))).alias(f"_{m}") for m in ("high", "low", "default")])
    rows = rows.join(F.broadcast(by_city), F.lower("city") == F.col("_city"), "left")
    special = F.when(F.col("measure") == "high", F.col("_high")).when(F.col("measure") == "low", F.col("_low"))
    rows = rows.withColumn("icao", F.coalesce("_url", special, "_default"))
    rows = rows.withColumn("station_measure", F.when(F.col("_url").isNotNull() | special.isNotNull(), F.col("measure")).otherwise("default"))
    deferred = reduce(lambda a, b: a | b, [(F.col("icao") == i) & (F.col("measure") == m) for i, m in DEFERRED]) | (F.col("icao") == "RCTP")
    status = (
        F.when(~F.coalesce(F.col("id").cast("string").rlike(EVENT_ID), F.lit(False)), "bad_id")
        .when(~description_ok("description"), "bad_description")
        .when(F.col("icao").isNull(), "unknown_city")
        .when(F.coalesce(deferred, F.lit(False)), "deferred")
        .when(F.col("measure") == "default", "ambiguous_measure")
        .when(F.col("settlement_date").isNull(), "no_date")
        .otherwise("ok")
    )
    return rows.withColumn("status", status).drop("_url", "_city", "_high", "_low", "_default")


def discover_events(events: DataFrame, cities: DataFrame) -> DataFrame:
    """resolve_events() for a listing: events of unknown cities are left out, deferred ones stay without icao and measure."""
    rows = resolve_events(events, cities).filter(F.col("status") != "unknown_city")
    held = F.col("status") == "deferred"
    return rows.withColumns({"icao": F.when(~held, F.col("icao")), "measure": F.when(~held, F.col("measure"))})


def settle(events: DataFrame, extremes: DataFrame, stations: DataFrame, now: datetime | Column) -> DataFrame:
    """resolve_events()'s rows settled by daily_extremes(): observed_value_c, observed_source, n_obs and status, which adds too_early, no_extremes and low_coverage; settled is what went well.

    stations: icao, tz. extremes: station (an ICAO) and local_date as keys. now is the instant that decides what is final.
    """
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    zones = F.broadcast(stations.select(F.col("icao").alias("_icao"), F.col("tz").alias("_tz")))
    rows = events.join(zones, F.col("icao") == F.col("_icao"), "left")
    wait = reduce(lambda out, kv: F.when(F.col("source_type") == kv[0], F.lit(kv[1])).otherwise(out), DELAY_HOURS.items(), F.lit(24))
    final_at = local_end_of_day("settlement_date", F.coalesce("_tz", F.lit("UTC"))) + F.make_dt_interval(F.lit(0), wait)
    days = extremes.select(F.col("station").alias("_s"), F.col("local_date").alias("_d"), "tmin_c", "tmax_c", "n_obs", "source_tmin", "source_tmax")
    rows = rows.join(days, (F.col("icao") == F.col("_s")) & (F.col("settlement_date") == F.col("_d")), "left")
    high = F.col("measure") == "high"
    value = F.when(high, F.col("tmax_c")).otherwise(F.col("tmin_c"))
    status = F.when(F.col("status") != "ok", F.col("status")).when(at < final_at, "too_early").when(F.col("_s").isNull(), "no_extremes").when(value.isNull(), "low_coverage").otherwise("settled")
    done = status == "settled"
    out = rows.withColumns({"observed_value_c": F.when(done, value), "observed_source": F.when(done, F.when(high, F.col("source_tmax")).otherwise(F.col("source_tmin"))), "_status": status})
    return out.drop("status", "_icao", "_tz", "_s", "_d", "tmin_c", "tmax_c", "source_tmin", "source_tmax").withColumnRenamed("_status", "status")


def with_unit(settled: DataFrame, stations: DataFrame, unit: str | None = None, published: str = "published_value") -> DataFrame:
    """settle()'s rows with unit, resolved_value and data_quality_alert.

    unit: fahrenheit or celsius, else by the station's country (F in the US, where values are whole; abroad one decimal).
    The alert is a text where the value that the market published, if df has that column, is off by over 1 F or 0.6 C.
    stations: icao, country; a station that isn't there counts as abroad.
    """
    if unit not in (None, "fahrenheit", "celsius"):
        raise ValueError(f"no unit {unit!r}")
    places = F.broadcast(stations.select(F.col("icao").alias("_icao"), (F.col("country") == "US").alias("_us")))  # a registry
    rows = settled.join(places, F.col("icao") == F.col("_icao"), "left")
    us = F.coalesce(F.col("_us"), F.lit(False))
    chosen = F.lit(unit) if unit else F.when(us, "fahrenheit").otherwise("celsius")
    scale = F.when(us, 1.0).otherwise(10.0)
    value = F.when(chosen == "celsius", F.col("observed_value_c")).otherwise(F.floor(c_to_f("observed_value_c") * scale + 0.5) / scale)
    off = F.abs(value - col(published).cast("double")) if published in settled.columns else F.lit(None).cast("double")
    most, sign = F.when(chosen == "celsius", 0.6).otherwise(1.0), F.when(chosen == "celsius", "°C").otherwise("°F")
    alert = F.when(off > most, F.format_string("settled at %.1f%s, published %.1f%s: off by %.2f, more than %.1f", value, sign, col(published).cast("double") if published in settled.columns else F.lit(None).cast("double"), sign, off, most))
    return rows.withColumns({"unit": chosen, "resolved_value": value, "data_quality_alert": alert}).drop("_icao", "_us")


def market_join(frame: DataFrame, markets: DataFrame) -> DataFrame:
    """Observations, reports and markets of a day: each market with its station's report and observations.

    frame: pairs(). markets: ticker, series_ticker, station, date, measure_type (HIGH_TEMP, LOW_TEMP), floor_strike,
    cap_strike, market_result (yes, no, ''). settlement_consistent says whether the report's value lies in the bracket
    [floor, cap) just if the result is yes; null while either is missing. cli_metar_delta_f is the report minus the
    observed extreme. unconfirmed marks reports that aren't final.
    """
    days = frame.select(F.col("station").alias("_s"), F.col("date").alias("_d"), "cli_high_f", "cli_low_f", "cli_report_type", "obs_high_f", "obs_low_f", "obs_count")
    rows = markets.join(days, (F.col("station") == F.col("_s")) & (F.col("date") == F.col("_d")), "left")
    high = F.col("measure_type") == "HIGH_TEMP"
    cli, seen = F.when(high, F.col("cli_high_f")).otherwise(F.col("cli_low_f")), F.when(high, F.col("obs_high_f")).otherwise(F.col("obs_low_f"))
    inside = (F.col("floor_strike").isNull() | (cli >= F.col("floor_strike"))) & (F.col("cap_strike").isNull() | (cli < F.col("cap_strike")))
    consistent = F.when(cli.isNotNull() & F.col("market_result").isin("yes", "no"), inside == (F.col("market_result") == "yes"))
    return rows.select(
        F.col("station").alias("station_code"),
        F.col("date").alias("observation_date"),
        F.col("cli_high_f").alias("cli_high_temp_f"),
        F.col("cli_low_f").alias("cli_low_temp_f"),
        F.col("obs_high_f").alias("metar_high_temp_f"),
        F.col("obs_low_f").alias("metar_low_temp_f"),
        F.coalesce("obs_count", F.lit(0)).alias("metar_count"),
        F.col("ticker").alias("market_ticker"),
        "series_ticker",
        "measure_type",
        "floor_strike",
        "cap_strike",
        "market_result",
        consistent.alias("settlement_consistent"),
        (cli - seen).alias("cli_metar_delta_f"),
        (F.coalesce(F.col("cli_report_type"), F.lit("")) != "final").alias("unconfirmed"),
    )


def disagreeing_cities(cities: DataFrame) -> DataFrame:
    """Cities that two issuers settle by different stations for the same measure: city, measure, icaos."""
    return cities.groupBy("city", "measure").agg(F.sort_array(F.collect_set("icao")).alias("icaos")).filter(F.size("icaos") > 1)
