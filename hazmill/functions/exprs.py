"""Native column expressions: text, numbers, dates, units, geography and statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label words to type codes.
TYPE_CODES = {"earthquake": "EQ", "eq": "EQ", "cyclone": "TC", "tc": "TC", "typhoon": "TC", "hurricane": "TC", "wildfire": "WF", "wf": "WF", "bushfire": "WF", "drought": "DR", "dr": "DR", "flood": "FL", "fl": "FL", "flooding": "FL"}

# Words that don't tell places apart.
PLACE_STOP_WORDS = ["the", "and", "for", "area", "region", "province", "district", "county", "city", "state", "states", "united", "kingdom", "republic", "democratic", "north", "south", "east", "west", "central", "upper", "lower", "new", "greater", "metropolitan"]

# Words for levels of severity, in the order in which they are looked for.
SEVERITY_LEVELS = {"minor": 1, "medium": 2, "severe": 3, "extreme": 4}

# The fields of which one at least must be known for confidence: in a report's text, and for a model.
TEXT_KEYS = {"EQ": ["magnitude", "depth"], "TC": ["maximum_wind_speed_kmh"], "WF": ["burned_area_ha", "people_affected"], "DR": ["duration_days"], "FL": ["dead", "displaced"]}
MODEL_KEYS = {"EQ": ["magnitude", "depth", "rapidpopdescription"], "TC": ["maximum_wind_speed_kmh", "maximum_storm_surge_m", "exposed_population"], "WF": ["duration_days", "burned_area_ha", "people_affected"], "DR": ["duration_days", "affected_area_km2", "affected_country_count"], "FL": ["dead", "displaced"]}

# Factors of units, by the field they measure.
UNIT_FACTORS = {
    "depth": {"mi": 1.60934, "mile": 1.60934},
    "maximum_wind_speed_kmh": {"mph": 1.60934, "kt": 1.852, "knot": 1.852, "m/s": 3.6},
    "rainfall_mm": {"cm": 10.0, "in": 25.4, "inch": 25.4, "inche": 25.4},
    "burned_area_ha": {"acre": 0.404686, "km2": 100.0, "km²": 100.0, "square kilometer": 100.0, "sq km": 100.0, "sq. km": 100.0, "sq.km": 100.0},
    "affected_area_km2": {"sq mi": 2.58999, "sq. mi": 2.58999, "square mile": 2.58999},
    "maximum_storm_surge_m": {"ft": 0.3048, "feet": 0.3048},
    "duration_days": {"week": 7.0, "month": 30.0},
}


def nullify(c: Column) -> Column:
    """Null for the textual nulls: empty, none, nan in any case."""
    return F.when(F.lower(F.trim(c)).isin("", "none", "nan"), None).otherwise(c)


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def sentences(c: Column) -> Column:
    return F.filter(F.split(normalize_text(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def title_of(text: Column) -> Column:
    parts = F.split(text, r" \[SEP\] ", 2)
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("")


def body_of(text: Column) -> Column:
    parts = F.split(text, r" \[SEP\] ", 2)
    return F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))


def build_text(title: Column, body: Column) -> Column:
    return F.when(F.trim(F.coalesce(title, F.lit(""))) != "", F.concat_ws(" [SEP] ", title, body)).otherwise(body)


def parse_timestamp(c: Column) -> Column:
    # The forms of a timestamp, in the order in which they are tried.
    forms = ("yyyyMMddHHmmss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in forms])


def parse_date(c: Column) -> Column:
    """YYYY-MM-DD..., or YYYY-MM as the month's first day."""
    s = F.trim(nullify(c))
    return F.to_date(F.try_to_timestamp(F.when(F.length(s) == 7, F.concat(s, F.lit("-01"))).otherwise(F.substring(s, 1, 10)), F.lit("yyyy-MM-dd")))


def to_number(c: Column) -> Column:
    """A number with commas, null if it isn't one (or is NaN)."""
    d = F.regexp_replace(F.trim(c), ",", "").try_cast("double")
    return F.when(~F.isnan(d), d)


def scaled_number(c: Column) -> Column:
    """The first number with an optional k, m, b, thousand, million or billion."""
    scale = F.lower(F.regexp_extract(c, r"(?i)\d[\d,]*(?:\.\d+)?\s*(thousand|million|billion|k|m|b)\b", 1))
    factor = F.when(scale.isin("k", "thousand"), 1e3).when(scale.isin("m", "million"), 1e6).when(scale.isin("b", "billion"), 1e9).otherwise(1.0)
    return to_number(F.regexp_extract(c, r"\d[\d,]*(?:\.\d+)?", 0)) * factor


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def convert_unit(field: str, value: Column, unit: Column) -> Column:
    out, name = value, F.regexp_replace(F.regexp_replace(F.lower(F.trim(unit)), r"\s+", " "), "(?<!/)s$", "")
    for word, factor in UNIT_FACTORS.get(field, {}).items():
        out = F.when(name == word, value * F.lit(factor)).otherwise(out)
    return out


def type_code(label: Column) -> Column:
    word = F.lower(F.trim(label))
    out = F.when(word == "", "")
    for k, v in TYPE_CODES.items():
        out = out.when(word == k, v)
    return out.otherwise(F.upper(F.substring(word, 1, 2)))


def location_tokens(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(nullify(c), F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, PLACE_STOP_WORDS)))


def tokens_overlap(a: Column, b: Column) -> Column:
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(p) * F.sin(p) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(q) * F.sin(q)
    return 2 * 6371.0 * F.asin(F.sqrt(h))


def duration_days(begin: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(F.to_date(end), F.to_date(begin)))


def coordinates(text: Column) -> Column:
    """struct<lat,lon> from the first of three notations that gives a valid place, rounded to 4 places."""

    def place(lat, lon):
        ok = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
        return F.when(ok, F.struct(F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon")))

    def number(pattern, k):
        return F.regexp_extract(text, pattern, k).try_cast("double")

    # Three notations of coordinates, in the order in which they are tried.
    a = r"(?i)(\d{1,3}(?:\.\d+)?)\s*°?\s*([NS])[,\s]+?(\d{1,3}(?:\.\d+)?)\s*°?\s*([EW])"
    b = r"(?is)lat(?:itude)?\s*[:\s]\s*(-?\d{1,3}(?:\.\d+)?).*?lon(?:gitude)?\s*[:\s]\s*(-?\d{1,3}(?:\.\d+)?)"
    c = r"\(\s*(-?\d{1,2}(?:\.\d+)?)\s*,\s*(-?\d{2,3}(?:\.\d+)?)\s*\)"
    south = F.when(F.upper(F.regexp_extract(text, a, 2)) == "S", -1).otherwise(1)
    west = F.when(F.upper(F.regexp_extract(text, a, 4)) == "W", -1).otherwise(1)
    return F.coalesce(place(number(a, 1) * south, number(a, 3) * west), place(number(b, 1), number(b, 2)), place(number(c, 1), number(c, 2)))


def rapid_population(text: Column) -> Column:
    """struct<people, log, missing, few, unparsed> of a population description."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    few = low.contains("few people")
    word = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*(thousand|million|billion)?", 2)
    number = F.regexp_extract(low, r"\d+(?:\.\d+)?", 0).try_cast("double")
    people = F.coalesce(number * F.when(word == "thousand", 1e3).when(word == "million", 1e6).when(word == "billion", 1e9).otherwise(1.0), F.when(few, 100.0))
    bit = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.struct(people.alias("people"), F.log1p(people).alias("log"), bit(low == "").alias("missing"), bit(few).alias("few"), bit((low != "") & ~few & number.isNull()).alias("unparsed"))


def impact_score(dead, displaced, affected, loss, wind, magnitude, burned) -> Column:
    """0 to 100."""
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    # The weights of the score.
    raw = 18 * F.log1p(z(dead)) + 8 * F.log1p(z(displaced)) + 4 * F.log1p(z(affected)) + 12 * F.log1p(z(loss) / 1e6) + 0.08 * z(wind) + 2.5 * z(magnitude) + 3 * F.log1p(z(burned) / 1e3)
    return clamp(raw, 0.0, 100.0)


def impact_tier(score: Column) -> Column:
    return F.when(score >= 65, "high").when(score >= 35, "medium").otherwise("low")


def flood_severity(dead: Column, displaced: Column) -> Column:
    return F.when(F.coalesce(dead > 100, F.lit(False)) | F.coalesce(displaced > 80000, F.lit(False)), "orange_or_red").otherwise("green")


def severity_level(text: Column) -> Column:
    """1 to 4 by the first word of SEVERITY_LEVELS that the text holds; null without any."""
    low = F.lower(F.trim(text))
    return F.coalesce(*[F.when(low.contains(word), level) for word, level in SEVERITY_LEVELS.items()])


def low_confidence(code: Column, get, keys: dict[str, list[str]] = TEXT_KEYS) -> Column:
    """Whether all key fields of the type are missing; false for a type without any. get: field name to column; textual nulls are missing."""
    out = F.lit(False)
    for k, names in keys.items():
        out = F.when(code == k, F.coalesce(*[nullify(get(n).cast("string")) for n in names]).isNull()).otherwise(out)
    return out


#: Terms of the continued fraction, steps that a gamma ratio is shifted by, terms of the normal tail, and degrees from which the tail is expanded.
FRACTION, SHIFT, TAIL, MANY = 80, 12, 60, 1000


def _half_gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): shifted upwards, then an asymptotic series in 1/a."""
    shifted = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(1.0), lambda acc, k: acc * (a + k) / (a + k + 0.5))
    r = 1 / (a + SHIFT)
    series = 1 - r / 8 + r**2 / 128 + 5 * r**3 / 1024 - 21 * r**4 / 32768 - 399 * r**5 / 262144
    return shifted * F.sqrt(a + SHIFT) * series


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its last term backwards."""

    def term(acc, i):
        m = F.floor(i / 2).cast("double")
        even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(i % 2 == 0, even).otherwise(odd) / acc

    return 1 / F.aggregate(F.sequence(F.lit(FRACTION), F.lit(1), F.lit(-1)), F.lit(1.0), term)


def normal_tails(z: Column) -> Column:
    """The probability that a normal deviate is at least z from 0, for z >= 0: a series near 0, a continued fraction beyond."""
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    start = F.struct(z.alias("term"), z.alias("sum"))

    def step(acc, k):
        term = acc["term"] * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    near = 1 - 2 * density * F.aggregate(F.sequence(F.lit(1), F.lit(TAIL)), start, step, lambda acc: acc["sum"])
    far = 2 * density / F.aggregate(F.sequence(F.lit(TAIL), F.lit(1), F.lit(-1)), z, lambda acc, k: z + k / acc)
    return F.when(z < 2.5, near).otherwise(far)


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided Student-t p-value, native, in the same few steps for any degrees of freedom.

    The tails are a regularised incomplete beta function: its continued fraction up to MANY degrees; beyond, the deviate is expanded to a normal one
    (Hill's series in 1 / df, whose error is below 1e-12 there). Null for df <= 0.
    """
    df, size = F.when(df > 0, df.cast("double")), F.abs(t.cast("double"))
    a, b, t2 = df / 2, F.lit(0.5), size * size
    x = df / (df + t2)
    front = F.exp(a * F.ln(x)) * F.sqrt(1 - x) * _half_gamma_ratio(a) / math.sqrt(math.pi)
    few = F.when(x < (a + 1) / (a + 2.5), front / a * _beta_fraction(a, b, x)).otherwise(1 - front / 0.5 * _beta_fraction(b, a, 1 - x))
    c = df - 0.5
    y, d = c * F.log1p(t2 / df), 48 * c * c
    z = (((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100 + d) + y + 3) / d + 1) * F.sqrt(y)
    p = F.when(df <= MANY, few).otherwise(normal_tails(z))
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def relative_error(truth: Column, got: Column) -> Column:
    return F.when(truth > 0, F.abs(got - truth) / truth)


# Industry keyword patterns by sector.
INDUSTRY_PATTERNS = {
    "insurance": r"\b(insur(?:ance|er|ed|ers)|reinsur\w+|catastrophe\s+bond|cat\s+bond|claims?\s+payout|underwriter)\b",
    "agriculture": r"\b(crop(?:s|land)?|harvest|farmland|agricult\w+|livestock|grain|wheat|rice|corn|soybean|food\s+supply|drought.{0,30}farm|flood.{0,30}farm|farm.{0,20}flood|farm.{0,20}drought)\b",
    "energy": r"\b(oil\s+(?:field|platform|refiner|spill|price|export)|natural\s+gas|pipeline|petroleum|fuel\s+supply|energy\s+(?:sector|infrastructure|supply)|blackout|power\s+(?:plant|grid|outage|cut|station))\b",
    "utilities": r"\b(utilit(?:y|ies)|electricity\s+(?:supply|grid|outage)|water\s+(?:supply|utility|treatment|shortage)|grid\s+(?:failure|collapse|damage)|power\s+line)\b",
    "construction": r"\b(construction|rebuild(?:ing)?|reconstruct\w+|infrastructure\s+damage|bridge\s+(?:collapse|damage)|road\s+(?:damage|destroyed)|building\s+(?:collapse|damage|destroyed)|real\s+estate|property\s+damage|housing\s+damage)\b",
    "tourism": r"\b(tourism|tourist|hotel|resort|airline|flight\s+cancel|airport\s+(?:close|shut|damage)|travel\s+(?:warning|ban|disruption)|evacuat\w+.{0,30}tourist)\b",
    "timber": r"\b(timber|forest(?:ry)?|lumber|logging|wood\s+(?:supply|industry)|wildfire.{0,30}forest|forest.{0,30}burned)\b",
    "mining": r"\b(mining|mine\s+(?:flood|collapse|shut)|mineral\s+(?:export|production)|coal\s+(?:mine|production)|copper\s+(?:mine|output))\b",
    "manufacturing": r"\b(garment|textile|manufactur\w+\s+(?:disruption|halt|shutdown)|factory\s+(?:flood|damage|shutdown)|supply\s+chain\s+(?:disruption|breakdown|interrupt))\b",
    "shipping": r"\b(port\s+(?:damage|closed|operations)|shipping\s+(?:route|disruption)|trade\s+(?:disruption|halted)|export\s+(?:disruption|halted|ban)|import\s+(?:disruption|shortage))\b",
    "financial": r"\b(bank\w*\s+(?:loss|exposure|write.?off)|stock\s+(?:market|exchange)\s+(?:fell|drop|plunge|crash)|financial\s+(?:loss|impact|market))\b",
}


def industries(text: Column) -> Column:
    """The sectors that a text names, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(s)) for s, p in INDUSTRY_PATTERNS.items()])))


# Companies in the news and their sectors, in the order in which a name is tried.
COMPANY_SECTORS = {
    "aig": "insurance", "allianz": "insurance", "axa": "insurance", "munich re": "insurance", "swiss re": "insurance", "lloyd's": "insurance", "zurich": "insurance", "berkshire": "insurance", "allstate": "insurance", "state farm": "insurance", "tokio marine": "insurance",
    "chevron": "energy", "exxon": "energy", "shell": "energy", "bp": "energy", "total": "energy", "conocophillips": "energy", "halliburton": "energy", "schlumberger": "energy", "petronas": "energy", "sinopec": "energy",
    "pg&e": "utilities", "duke energy": "utilities", "nextera": "utilities",
    "cargill": "agriculture", "adm": "agriculture", "bunge": "agriculture", "tyson": "agriculture", "nestle": "agriculture", "unilever": "agriculture",
    "caterpillar": "construction", "lafarge": "construction", "bechtel": "construction", "fluor": "construction",
    "bhp": "mining", "rio tinto": "mining", "vale": "mining", "barrick": "mining", "freeport": "mining", "glencore": "mining",
    "united airlines": "tourism", "delta": "tourism", "american airlines": "tourism", "southwest": "tourism", "lufthansa": "tourism", "air france": "tourism", "marriott": "tourism", "hilton": "tourism",
}


def company_sectors(names: Column) -> Column:
    """The sectors of organisations (an array of names from a recogniser), sorted: each by the first known company that its name holds."""
    first = lambda n: F.coalesce(*[F.when(F.lower(F.trim(n)).contains(k), s) for k, s in COMPANY_SECTORS.items()])
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce(names, F.array().cast("array<string>")), first))))
