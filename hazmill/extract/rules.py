"""Numeric fields from news text: a rule catalogue and the engine that binds numbers to their anchors.

The engine needs spans and token distances, so it runs on Arrow batches, a batch's texts at once (columns.py); the rules are data. A match scores by
its anchors among the tokens from eight before its first to eight after its last one.

Defined results: empty texts give no metrics; an unknown type gets the rules for all types and no statement on confidence; among equal
candidates the first counts. A scale letter needs a word boundary ("12 men" is 12, not 12 million).
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazmill.durable import spread
from hazmill.extract.columns import BREAK, Batch, Matcher, bindings, negated, with_anchors
from hazmill.functions.exprs import TEXT_KEYS, TYPE_CODES, UNIT_FACTORS

# The number grammar, without and with a scale.
N = r"\d[\d,]*(?:\.\d+)?"
NS = N + r"(?:\s*(?:k|m|b|thousand|million|billion)\b)?"

# Cues that weaken a find.
NEGATIONS = ("no", "not", "without", "zero", "none", "unlikely", "unconfirmed", "could", "may", "might")

# Sector keywords of the impact summary.
SECTOR_WORDS = {
    "energy": ("power grid", "electricity", "oil", "gas", "refinery", "pipeline"),
    "transportation": ("airport", "flight", "rail", "port", "shipping", "highway"),
    "agriculture": ("crop", "harvest", "farmland", "livestock", "agriculture"),
    "insurance": ("insured losses", "claims", "insurer", "reinsurance"),
    "tourism": ("tourism", "hotel", "resort", "tourist"),
    "technology": ("semiconductor", "chip plant", "data center", "factory"),
    "mining": ("mine", "copper", "lithium", "iron ore"),
}

# The units in which fields are given; people where none is named.
UNITS = {"depth": "km", "maximum_wind_speed_kmh": "km/h", "rainfall_mm": "mm", "burned_area_ha": "ha", "affected_area_km2": "km2", "maximum_storm_surge_m": "m", "duration_days": "days", "economic_loss_usd": "usd", "affected_country_count": "countries", "magnitude": "", "rapidpopdescription": ""}
RAPID_UNITS = {"rapid_pop_people": "people", "rapid_pop_log": "log_people", "rapid_missing": "flag", "rapid_few_people": "flag", "rapid_unparsed": "flag"}


@dataclass(frozen=True)
class Rule:
    field: str
    types: tuple[str, ...]
    base: float
    least: float
    anchors: tuple[str, ...]
    patterns: tuple[str, ...]
    text: bool = False


# The rule catalogue.
RULES = (
    Rule("magnitude", ("EQ",), 0.60, 0.18, ("magnitude", "richter", "earthquake", "quake", "aftershock"), (
        rf"(?:magnitude|richter|mw|mb|ml|ms)\s*[:\-]?\s*(?P<num>{N})",
        rf"\bM\s*(?P<num>{N})\b",
        rf"(?P<num>{N})[- ]?(?:magnitude|richter|mw|mb|ml|ms)\b",
    )),
    Rule("depth", ("EQ",), 0.58, 0.18, ("depth", "deep", "earthquake", "hypocenter", "epicenter"), (
        rf"(?:depth|deep)\s*(?:of\s*|:\s*)?(?P<num>{N})\s*(?P<unit>km|kilometers?|mi|miles?)",
        rf"(?P<num>{N})\s*(?P<unit>km|kilometers?|mi|miles?)\s*(?:depth|deep)\b",
    )),
    Rule("rapidpopdescription", ("EQ",), 0.56, 0.22, ("mmi", "intensity", "earthquake", "quake", "aftershock", "shaking"), (
        rf"(?P<raw>(?:few|{N})\s*(?:thousand|million|billion)?\s*people(?:\s+in\s+MMI\s+[IVX]+)?)",
        rf"(?P<raw>MMI\s+[IVX]+\s*(?:felt by|affecting)\s*(?:few|{N})\s*(?:thousand|million|billion)?\s*people)",
    ), True),
    Rule("maximum_wind_speed_kmh", ("TC",), 0.54, 0.18, ("wind", "gust", "cyclone", "typhoon", "hurricane", "storm", "landfall"), (
        rf"(?P<num>{N})\s*(?P<unit>km/h|kph|mph|knots?|kt|m/s)\s*(?:sustained\s*)?(?:winds?|gusts?)?",
    )),
    Rule("maximum_storm_surge_m", ("TC",), 0.62, 0.18, ("storm surge", "surge", "coastal flooding", "inundation", "cyclone", "typhoon", "hurricane"), (
        rf"storm surge(?:\s*of)?\s*(?P<num>{N})\s*(?P<unit>m|meters?|ft|feet)",
    )),
    Rule("exposed_population", ("TC",), 0.58, 0.18, ("exposed", "at risk", "in the path", "track", "cyclone", "typhoon", "hurricane"), (
        rf"(?P<num>{NS})\s*(?:people|residents|persons?)\s*(?:were\s*)?(?:exposed|at risk|in the path|under threat|vulnerable)",
        rf"(?:exposed|at risk|in the path)\s*(?:population\s*)?(?:of\s*)?(?P<num>{NS})",
    )),
    Rule("rainfall_mm", (), 0.50, 0.18, ("rain", "rainfall", "precipitation", "downpour", "flood", "storm"), (
        rf"(?P<num>{N})\s*(?P<unit>mm|millimeters?|cm|inches?|in)\s*(?:of\s*)?(?:rain|rainfall|precipitation)",
    )),
    Rule("burned_area_ha", ("WF",), 0.58, 0.18, ("burned", "scorched", "charred", "wildfire", "bushfire", "blaze", "fire", "hectare", "acre"), (
        rf"(?P<num>{N})\s*(?P<unit>ha|hectares?|acres?|km2|km²|square kilometers?|sq\.?\s*km)\s*(?:of\s*(?:land|forest|bush|vegetation|terrain))?\s*(?:burned|scorched|charred|destroyed|ablaze|on fire)?",
        rf"(?:burned|scorched|charred|destroyed|consumed|razed)\s*(?:(?:over|about|more than|nearly|around|some)\s*)?(?P<num>{N})\s*(?P<unit>ha|hectares?|acres?|km2|km²|square kilometers?|sq\.?\s*km)",
        rf"(?P<num>{N})\s*(?P<unit>ha|hectares?|acres?|km2|km²|square kilometers?|sq\.?\s*km)\s*(?:of\s*(?:land|forest|bush|vegetation|terrain))\s*(?:burned|scorched|charred|destroyed|consumed|were burned|have burned)?",
        rf"(?:fire|blaze|wildfire|bushfire)\s*(?:has\s*)?(?:burned|covered|spread over|scorched)\s*(?:(?:over|about|more than|nearly|around)\s*)?(?P<num>{N})\s*(?P<unit>ha|hectares?|acres?|km2|km²|square kilometers?|sq\.?\s*km)",
    )),
    Rule("affected_area_km2", ("DR", "FL"), 0.54, 0.18, ("affected area", "under water", "impacted area", "drought", "flooded area", "parched", "farmland", "land"), (
        rf"(?P<num>{N})\s*(?P<unit>km2|km²|square kilometers?|sq\.?\s*km|sq\.?\s*mi|square miles?)\s*(?:affected|under water|impacted|parched|burned)?",
        rf"(?P<num>{N})\s*(?P<unit>km2|km²|square kilometers?|sq\.?\s*km|sq\.?\s*mi|square miles?)\s*(?:of\s*)?(?:farmland|land|terrain|area)",
    )),
    Rule("duration_days", ("WF", "DR"), 0.52, 0.18, ("lasting", "lasted", "duration", "days", "weeks", "months", "drought", "wildfire", "blaze", "burning", "persisted"), (
        rf"(?:for|lasting|lasted|persisting for|persisted for|burning for|raging for|continuing for|going on for)\s*(?P<num>{N})\s*(?P<unit>days?|weeks?|months?)",
        rf"(?P<num>{N})\s*(?P<unit>days?|weeks?|months?)\s*(?:of\s*)?(?:drought|dry spell|wildfire|bushfire|fires?)",
        rf"(?P<num>{N})-(?P<unit>day|week|month)\s*(?:wildfire|bushfire|blaze|drought|dry spell|fire)",
        rf"(?:drought|fire|blaze|wildfire)\s*(?:that\s*)?(?:has\s*)?(?:lasted|burned|continued|persisted|gone on)\s*(?:for\s*)?(?P<num>{N})\s*(?P<unit>days?|weeks?|months?)",
        rf"(?P<num>{N})\s*(?P<unit>days?|weeks?|months?)\s*ago\b",
    )),
    Rule("economic_loss_usd", (), 0.55, 0.18, ("loss", "losses", "damage", "insured", "economic"), (
        rf"(?:\$|usd)\s*(?P<num>{N})\s*(?P<scale>k|m|b|thousand|million|billion)?\s*(?:in\s*)?(?:losses?|damage)",
        rf"(?:losses?|damage)\s*(?:estimated at|of|around|near)?\s*(?:\$|usd)\s*(?P<num>{N})\s*(?P<scale>k|m|b|thousand|million|billion)?",
    )),
    Rule("affected_country_count", ("DR",), 0.62, 0.18, ("countries", "nations", "across", "drought", "affecting"), (
        r"(?:across|affecting|spanning)\s*(?P<num>\d+)\s*(?:countries|nations)",
        r"(?P<num>\d+)\s*(?:countries|nations)\s*(?:affected|impacted|hit|experiencing)",
    )),
    Rule("dead", (), 0.60, 0.18, ("dead", "killed", "fatality", "fatalities", "death toll", "deaths", "died", "lives", "perished"), (
        rf"(?P<num>{NS})\s*(?:people\s*|persons?\s*|civilians?\s*)?(?:were\s*|have\s*been\s*)?(?:killed|dead|died|fatalities?)",
        rf"(?:killed|claimed|left|took)\s*(?:at least\s*)?(?:more than\s*)?(?:over\s*)?(?:about\s*)?(?P<num>{NS})\s*(?:people|lives|persons?|dead|fatalities?)?",
        rf"(?:death toll|deaths?)\s*(?:rose to|climbed to|reached|surpassed|exceeded|at|of|:|stands at|now at)\s*(?:at least\s*)?(?:over\s*)?(?P<num>{NS})",
        rf"(?P<num>{NS})\s*(?:people\s*)?(?:killed|dead)\s*(?:in|after|following|from|by)",
        rf"(?:claiming|costing|cost)\s*(?:at least\s*)?(?:over\s*)?(?:more than\s*)?(?P<num>{NS})\s*(?:lives?|deaths?|fatalities?)",
        rf"(?:at least\s*|over\s*|more than\s*)?(?P<num>{NS})\s*(?:people|persons?)\s*(?:lost their lives|perished|were killed|have died)",
    )),
    Rule("injured", (), 0.58, 0.18, ("injured", "wounded", "hurt"), (
        rf"(?P<num>{NS})\s*(?:people\s*)?(?:were\s*)?injured",
        rf"injur(?:ed|ing)\s*(?:at least\s*)?(?:more than\s*)?(?P<num>{NS})\s*(?:people|persons?)?",
    )),
    Rule("missing", (), 0.58, 0.18, ("missing", "unaccounted"), (
        rf"(?P<num>{NS})\s*(?:people\s*)?(?:are|were|remain)?\s*missing",
        rf"missing\s*(?:persons?\s*)?(?:toll\s*)?(?:rose to|reached|:)?\s*(?P<num>{NS})",
    )),
    Rule("displaced", (), 0.60, 0.18, ("displaced", "evacuated", "homeless", "relocated", "fled", "shelter", "evacuation"), (
        rf"(?P<num>{NS})\s*(?:people\s*|residents\s*|persons?\s*|families\s*)?(?:were\s*|have\s*been\s*)?(?:displaced|evacuated|homeless|relocated|forced to flee|fled their homes?)",
        rf"(?:displaced|evacuated|forced to flee|forced from their homes?)\s*(?:at least\s*)?(?:more than\s*)?(?:over\s*)?(?:about\s*)?(?:some\s*)?(?P<num>{NS})\s*(?:people|residents|families|persons?)?",
        rf"(?P<num>{NS})\s*(?:people|residents|persons?|families)\s*(?:fled|were forced to leave|were uprooted)",
        rf"(?P<num>{NS})\s*(?:people|residents|persons?|families)\s*(?:are\s*)?(?:seeking shelter|in evacuation cent(?:er|re)|in emergency shelter|in relief camp)",
    )),
    Rule("people_affected", (), 0.55, 0.18, ("affected", "affecting", "impacted", "stranded", "people", "residents", "evacuation", "evacuated", "at risk", "under threat"), (
        rf"(?P<num>{NS})\s*(?:people|residents|persons?|families|households?)\s*(?:were\s*|are\s*|have been\s*)?(?:affected|impacted|stranded|displaced by|hit by)",
        rf"affect(?:ing|ed)\s*(?:at least\s*)?(?:more than\s*)?(?:about\s*)?(?:over\s*)?(?:around\s*)?(?:some\s*)?(?P<num>{NS})\s*(?:people|residents|persons?|families|households?)",
        rf"evacuation\s*(?:orders?|advisories?|warnings?|notices?)\s*(?:for|issued\s*(?:for|to)|affecting|covering)\s*(?:(?:more than|over|about|nearly|around|some)\s*)?(?P<num>{NS})\s*(?:people|residents|persons?|homes?|households?)?",
        rf"(?P<num>{NS})\s*(?:people|residents|persons?|homes?|households?)\s*(?:were\s*)?(?:under\s*)?(?:evacuation|evacuat(?:ed|ion))\s*(?:orders?|advisories?|warnings?)?",
        rf"(?P<num>{NS})\s*(?:people|residents|persons?)\s*(?:were\s*)?(?:ordered|told|forced|asked)\s*(?:to\s*)?evacuate",
        rf"(?P<num>{NS})\s*(?:people|residents|persons?)\s*(?:are\s*|were\s*)?(?:at risk|under threat|in harm|in the path|threatened)\b",
    )),
)

FIELDS = [r.field for r in RULES if not r.text]
RAPID = ["rapid_missing", "rapid_few_people", "rapid_unparsed"]
_SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "b": 1e9, "billion": 1e9}
_NUMBER = re.compile(r"(\d+(?:\.\d+)?)\s*(k|m|b|thousand|million|billion)?")


def number(text: str) -> float | None:
    """A number with commas and at most a scale after it."""
    m = _NUMBER.fullmatch(" ".join(text.split()).lower().replace(",", ""))
    return float(m[1]) * _SCALES.get(m[2] or "", 1.0) if m else None


def converted(field: str, value: float, unit: str) -> float:
    name = re.sub(r"(?<!/)s$", "", " ".join(unit.lower().split()))
    return value * UNIT_FACTORS.get(field, {}).get(name, 1.0)


_matchers: list = []
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
#: Characters of a batch that is matched as one string.
CHUNK = 1 << 20


def _sentence(text: str, begin: int, end: int) -> str:
    """The sentence that holds a span, or nothing if it reaches over a sentence's end."""
    cuts = [0, *(m.end() for m in _SENTENCE_END.finditer(text)), len(text) + 1]
    k = bisect_right(cuts, begin)
    found = text[cuts[k - 1] : cuts[k] if k < len(cuts) else None].rstrip()
    return found if end <= cuts[k - 1] + len(found) else ""


def _value(rule: Rule, m: re.Match) -> float | str | None:
    if rule.text:
        return " ".join(m["raw"].split()) or None
    parts = m.groupdict()
    value = number(parts["num"])
    return None if value is None else converted(rule.field, value * _SCALES.get((parts.get("scale") or "").lower(), 1.0), parts.get("unit") or "")


def _found(batch: Batch, rule: Rule, matchers: list[Matcher], allowed: np.ndarray, starts: dict, with_evidence: bool) -> Iterator[tuple[int, float | str, float, str, str]]:
    """(text, value, confidence, evidence, match) of each text's best match: the surest, then the largest, then the first."""
    pairs = [p for matcher in matchers for p in matcher.matches(batch, allowed, starts)]
    if not pairs:
        return
    texts = np.fromiter((t for t, _ in pairs), dtype=np.int64, count=len(pairs))
    spans = np.array([m.span() for _, m in pairs], dtype=np.int64)
    first, last = batch.token_at(spans[:, 0], texts), batch.token_at(np.maximum(spans[:, 0], spans[:, 1] - 1), texts)
    score = bindings(batch, texts, first, last, rule.anchors)
    confidence = rule.base + 0.24 * score - 0.20 * negated(batch, texts, first, last, NEGATIONS)
    best: dict[int, tuple] = {}
    for k in np.flatnonzero(score >= rule.least).tolist():
        text, m = pairs[k]
        value = _value(rule, m)
        if value is None:
            continue
        sure = confidence[k]
        if not rule.text and batch.official[text]:
            at = batch.begin[text]
            evidence = _sentence(batch.texts[text], m.start() - at, m.end() - at) or m[0]
            sure = sure + 0.04 * ("official" in evidence.lower())
        rank = (min(0.98, max(0.05, float(sure))), 0.0 if rule.text else value)
        if text not in best or rank > best[text][0]:
            best[text] = rank, value, m
    for text, (rank, value, m) in best.items():
        at = batch.begin[text]
        evidence = (_sentence(batch.texts[text], m.start() - at, m.end() - at) or m[0]) if with_evidence else ""
        yield text, value if rule.text else round(value, 6), round(rank[0], 3), evidence, m[0]


def extract_all(texts: list[str | None], codes: list[str], fields: frozenset[str] | None = None, evidence: bool = True) -> list[dict[str, tuple[float | str, float, str, str]]]:
    """For each text the best (value, confidence, evidence, match) of each field, or of the fields asked for; the evidence is left out if it isn't wanted."""
    if not _matchers:
        _matchers.extend((r, [Matcher(p) for p in r.patterns]) for r in RULES)
    clean = [" ".join(t.split()) if t else "" for t in texts]
    out: list[dict] = [{} for _ in clean]
    at = 0
    while at < len(clean):
        to, size = at, 0
        while to < len(clean) and (to == at or size + len(clean[to]) <= CHUNK):
            size += len(clean[to])
            to += 1
        batch = Batch(clean[at:to])
        batch.official = ["official" in t for t in batch.low.split(BREAK)] if "official" in batch.low else [False] * (to - at)
        kinds, starts = np.array(codes[at:to], dtype=object), {}
        numbered = np.zeros(to - at, dtype=bool)
        numbered[batch.text_of(batch.number_starts)] = True
        for rule, matchers in _matchers:
            if fields is not None and rule.field not in fields:
                continue
            allowed = with_anchors(batch, rule.anchors)
            if rule.types:
                allowed &= np.isin(kinds, rule.types)
            if not rule.text:  # all other patterns have a number
                allowed &= numbered
            if allowed.any():
                for text, *found in _found(batch, rule, matchers, allowed, starts, evidence):
                    out[at + text][rule.field] = tuple(found)
        at = to
    return out


def extract(text: str | None, code: str, fields: frozenset[str] | None = None) -> dict[str, tuple[float | str, float, str, str]]:
    """extract_all of one text."""
    return extract_all([text], [code], fields)[0]


def rapid_features(text: str) -> dict[str, float | None]:
    """The five features of a population description."""
    low = " ".join(text.split()).lower()
    few = "few people" in low
    m = re.search(r"(\d+(?:\.\d+)?)\s*(thousand|million|billion)?", low)
    people = float(m[1]) * _SCALES.get(m[2] or "", 1.0) if m else 100.0 if few else None
    log = None if people is None else round(math.log1p(people), 6)
    return {"rapid_pop_people": people, "rapid_pop_log": log, "rapid_missing": float(not low), "rapid_few_people": float(few), "rapid_unparsed": float(bool(low) and not few and m is None)}


def code_of(label: str | None) -> str:
    """The type's code; empty for an unknown one."""
    return TYPE_CODES.get((label or "").strip().lower(), "")


def record(text: str | None, label: str | None, timestamp: str | None = None, place: str | None = None, found: dict | None = None) -> dict:
    """The whole record of a report: metrics with units and evidence, derived features, sectors, impact summary and meta. found: what extract gives, if it is there."""
    code = code_of(label)
    found = extract(text, code) if found is None else found
    metrics = {f: {"value": v, "unit": UNITS.get(f, "people"), "confidence": c, "evidence": e, "raw": r} for f, (v, c, e, r) in found.items()}
    clean = " ".join((text or "").split())
    if source := metrics.get("rapidpopdescription"):
        for f, v in rapid_features(str(source["value"])).items():
            metrics[f] = {"value": v, "unit": RAPID_UNITS[f], "confidence": round(max(0.0, source["confidence"] - 0.05), 3), "evidence": source["evidence"], "raw": source["raw"]}
    elif code == "EQ" and clean:
        for f in RAPID:
            metrics[f] = {"value": float(f == "rapid_missing"), "unit": "flag", "confidence": 1.0, "evidence": "", "raw": ""}
    low = clean.lower()
    hints = {s: n for s, words in SECTOR_WORDS.items() if (n := sum(w in low for w in words))}
    sectors = sorted(hints, key=lambda s: -hints[s])
    z = lambda f: float(metrics[f]["value"]) if f in metrics else 0.0
    score = 18 * math.log1p(z("dead")) + 8 * math.log1p(z("displaced")) + 4 * math.log1p(z("people_affected")) + 12 * math.log1p(z("economic_loss_usd") / 1e6) + 0.08 * z("maximum_wind_speed_kmh") + 2.5 * z("magnitude") + 3 * math.log1p(z("burned_area_ha") / 1e3)
    score = min(100.0, max(0.0, score))
    return {
        "event_type": code or None,
        "metrics": metrics,
        "sector_hints": hints,
        "affected_sectors": sectors,
        "low_confidence": all(f not in metrics for f in TEXT_KEYS[code]) if code else None,
        "stock_impact_summary": {"impact_score_0_100": round(score, 3), "impact_tier": "high" if score >= 65 else "medium" if score >= 35 else "low", "likely_affected_sectors": sectors},
        "meta": {"timestamp": " ".join((timestamp or "").split()), "location_text": " ".join((place or "").split())},
    }


def extract_fields(df: DataFrame, keep: list[str], text: str = "text", label: str = "label", fields: list[str] | None = None) -> DataFrame:
    """The columns to keep and one column for each field asked for (all fields and rapidpopdescription by default)."""
    wanted = [*FIELDS, "rapidpopdescription"] if fields is None else fields
    schema = df.select(*keep).schema
    for f in wanted:
        schema = schema.add(f, "string" if f == "rapidpopdescription" else "double")
    asked = frozenset(wanted)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column("__text").to_pylist(), batch.column("__label").to_pylist()
            got = extract_all(texts, [code_of(x) for x in labels], asked, evidence=False)
            cols = [pa.array([g[f][0] if f in g else None for g in got], pa.string() if f == "rapidpopdescription" else pa.float64()) for f in wanted]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *cols], schema.fieldNames())

    return spread(df).select(*keep, F.col(text).alias("__text"), F.col(label).alias("__label")).mapInArrow(extracted, schema)


def extract_features(df: DataFrame, text: str = "text", label: str = "label", timestamp: str = "timestamp", place: str = "location_text", out: str = "event_features") -> DataFrame:
    """The table with a column of JSON records. The text column must be there; other inputs that are missing count as empty."""
    if text not in df.columns:
        raise ValueError(f"no column {text}")
    have = [F.col(c).cast("string") if c in df.columns else F.lit("") for c in (label, timestamp, place)]
    inputs = [F.col(text).cast("string").alias("__a"), *(c.alias(n) for c, n in zip(have, ("__b", "__c", "__d")))]
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = [batch.column(c).to_pylist() for c in ("__a", "__b", "__c", "__d")]
            rows = zip(*inputs, extract_all(inputs[0], [code_of(x) for x in inputs[1]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array([json.dumps(record(*r), ensure_ascii=False) for r in rows], pa.string())], schema.fieldNames())

    return spread(df).select(*df.columns, *inputs).mapInArrow(recorded, schema)


def sector_hints(text: Column) -> Column:
    """Sectors by how many of their keywords a text has, most first."""
    hits = [F.struct((-sum(F.when(F.lower(text).contains(w), 1).otherwise(0) for w in words)).alias("n"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, (s, words) in enumerate(SECTOR_WORDS.items())]
    return F.transform(F.filter(F.array_sort(F.array(*hits)), lambda h: h["n"] < 0), lambda h: h["s"])
