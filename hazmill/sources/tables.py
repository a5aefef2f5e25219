"""Reading and writing tables; the hazard catalogue from CSV or nested JSON documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema

from hazmill.extract.where import catalogue_countries
from hazmill.functions.exprs import duration_days, severity_level, to_number
from hazmill.operators.tables import pending
from hazmill.sources.answers import read_answers, write_answers
from hazmill.sources.sheets import read_xlsx

# The catalogue's columns.
CATALOGUE_TEXT = ["eventid", "eventtype", "alertlevel", "country", "fromdate", "todate", "rapidpopdescription", "severity_text"]
CATALOGUE_NUMBERS = ["magnitude", "depth", "maximum_wind_speed_kmh", "maximum_storm_surge_m", "exposed_population", "duration_days", "burned_area_ha", "people_affected", "affected_area_km2", "affected_country_count", "dead", "displaced", "severity_level"]

CATALOGUE_COLUMNS = ["eventid", "eventtype", "alertlevel", "country", "fromdate", "todate", "magnitude", "depth", "rapidpopdescription", "maximum_wind_speed_kmh", "maximum_storm_surge_m", "exposed_population", "duration_days", "burned_area_ha", "people_affected", "affected_area_km2", "affected_country_count", "dead", "displaced", "severity_level", "severity_text"]

ARTICLES = T.StructType().add("idx", "long").add("timestamp", "string").add("label", "string").add("text", "string")
CATALOGUE = T.StructType()
for _name in CATALOGUE_TEXT + CATALOGUE_NUMBERS:
    CATALOGUE = CATALOGUE.add(_name, "string")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, line_breaks: bool = False) -> DataFrame:
    """A table by its suffix: csv, tsv, json, parquet, orc, xlsx. Bad bytes are replaced, and there is no NA vocabulary (a country NA stays).
    Columns of a schema are found by name, wherever they stand; those that a file lacks, and values of another type, are null.

    line_breaks: whether quoted values may hold line breaks; such a file can't be split, so each is one task.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if suffix in ("csv", "tsv"):
        raw = spark.read.csv(path, header=True, multiLine=line_breaks, escape='"', sep="\t" if suffix == "tsv" else ",", mode="PERMISSIVE")
        return raw if schema is None else raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    if suffix == "json":
        return reader.json(path)
    if suffix in ("parquet", "orc"):
        return getattr(reader, suffix)(path)
    if suffix == "xlsx":
        return read_xlsx(spark, path, schema)
    raise ValueError(f"no reader for .{suffix}")


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """key, value (JSON) of a JSON object of entries, without _comment; of entries with the same key the last one."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    last = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    try:
        found = text.select(F.map_entries("m").alias("e")).first()
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", last)
    entries = {k: v for k, v in (found.e if found and found.e else []) if k != "_comment"}
    return spark.createDataFrame(list(entries.items()), "key string, value string")


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite as CSV with a header; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')


def write_fixed(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Overwrite as CSV with exactly these columns (the catalogue's by default), absent ones empty."""
    columns = CATALOGUE_COLUMNS if columns is None else columns
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def labelled(df: DataFrame, folder: str, ask: Callable[[list[dict]], list[dict]], result: str, key: str = "idx", label: str = "label", batch: int = 50) -> DataFrame:
    """Ask a service for each row that the folder holds no answer for yet (an error isn't one), and give all answers, the last of each key.

    ask: rows to answers (dicts of the result's columns), on the executors. Rows are asked in batches of so many for each core, and each batch is committed
    as a whole when it is done (see answers.py), so that a broken run goes on where it stopped.
    """
    spark = df.sparkSession
    schema = T.StructType.fromDDL(result)
    whole = T.StructType([*schema.fields, T.StructField("__at", T.LongType())])

    def answered() -> DataFrame:
        return read_answers(spark, folder, whole)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for part in batches:
            rows = [r | {"__at": time.time_ns()} for r in ask(part.to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(whole))

    todo = pending(df, answered(), key, label)
    n, cores = todo.count(), spark.sparkContext.defaultParallelism
    turns = -(-n // max(1, batch * cores))
    for turn in range(turns):
        now = pending(df, answered(), key, label).filter(F.pmod(F.xxhash64(key), F.lit(turns)) == turn)
        write_answers(now.repartition(cores).mapInArrow(asked, whole), folder)
    got = answered()
    rest = [c for c in schema.fieldNames() if c != key]
    return got.groupBy(key).agg(F.max_by(F.struct(*rest), "__at").alias("r")).select(key, "r.*")


def windowed(rows: DataFrame, begin: str, end: str, column: str = "event_date") -> DataFrame:
    """Rows with a date between two, both counted."""
    return rows.filter(F.col(column).between(F.to_date(F.lit(begin)), F.to_date(F.lit(end))))


def catalogue(spark: SparkSession, path: str | None, begin: str | None = None, end: str | None = None, countries: bool = False) -> DataFrame:
    """The hazard catalogue with typed dates and numbers; an absent file is an empty one. With a window only its dates, with countries also iso2."""
    try:
        raw = read_table(spark, path, CATALOGUE) if path else None
        if raw is not None:
            raw.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = None
    raw = spark.createDataFrame([], CATALOGUE) if raw is None else raw
    numbers = [to_number(F.col(c)).alias(c) for c in CATALOGUE_NUMBERS]
    out = raw.select(*CATALOGUE_TEXT, *numbers, F.to_date(F.try_to_timestamp(F.substring("fromdate", 1, 10), F.lit("yyyy-MM-dd"))).alias("event_date"), F.upper(F.trim("eventtype")).alias("etype"))
    out = windowed(out, begin or "0001-01-01", end or "9999-12-31") if begin or end else out
    return catalogue_countries(out) if countries else out


def union_files(spark: SparkSession, paths: list[str], key: str = "idx") -> DataFrame:
    """All files' rows, the first of each key in order of the files and, within a file, of its rows."""
    at = lambda i: F.struct(F.lit(i).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    parts = [read_table(spark, p).select("*", at(i).alias("__at")) for i, p in enumerate(paths)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("__at", key)]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), "__at").alias("r")).select(key, "r.*")


def features(documents: DataFrame, column: str = "feature") -> DataFrame:
    """Rows of the catalogue from features (JSON), with details_url. Fields that only the details hold are null."""
    impact = "dead:string,killed:string,displaced:string,homeless:string"
    properties = f"eventid:string,eventtype:string,alertlevel:string,country:string,fromdate:string,todate:string,url:struct<details:string>,severitydata:struct<severity:string,severitytext:string,dead:string,displaced:string>,affectedcountries:array<string>,humanimpact:struct<{impact}>"
    keep = [c for c in documents.columns if c != column]
    p = documents.select(*[F.col(c).alias(f"__{c}") for c in keep], F.from_json(column, f"struct<properties:struct<{properties}>>")["properties"].alias("p")).select(*[f"__{c}" for c in keep], "p.*")
    kind = F.upper(F.trim("eventtype"))
    text = F.when(kind.isin("DR", "FL"), F.trim("severitydata.severitytext"))
    whole = lambda *names: F.floor(F.coalesce(*[to_number(F.col(n)) for n in names])).cast("double")
    none = lambda name, type_="double": F.lit(None).cast(type_).alias(name)
    return p.select(
        *[F.col(f"__{c}").alias(c) for c in keep if c in ("n", "level")],
        F.trim("eventid").alias("eventid"), kind.alias("eventtype"), F.lower(F.trim("alertlevel")).alias("alertlevel"), F.trim("country").alias("country"), F.trim("fromdate").alias("fromdate"), F.trim("todate").alias("todate"),
        none("magnitude"), none("depth"), none("rapidpopdescription", "string"), none("maximum_wind_speed_kmh"), none("maximum_storm_surge_m"), none("exposed_population"),
        F.when(kind.isin("DR", "WF"), duration_days(F.substring("fromdate", 1, 10), F.substring("todate", 1, 10))).cast("double").alias("duration_days"),
        none("burned_area_ha"), none("people_affected"),
        F.when(kind == "DR", to_number(F.col("severitydata.severity"))).alias("affected_area_km2"),
        F.when(kind == "DR", F.coalesce(F.size("affectedcountries"), F.lit(0))).cast("double").alias("affected_country_count"),
        F.when(kind == "FL", whole("humanimpact.dead", "humanimpact.killed", "severitydata.dead")).alias("dead"),
        F.when(kind == "FL", whole("humanimpact.displaced", "humanimpact.homeless", "severitydata.displaced")).alias("displaced"),
        severity_level(text).cast("double").alias("severity_level"), text.alias("severity_text"), F.trim("url.details").alias("details_url"),
    )


_RESOURCE = "resource:struct<buffer74:string,buffer39:string,impact:string>"
_DETAILS = f"struct<properties:struct<earthquakedetails:struct<magnitude:string,depth:string,rapidpopdescription:string>,severitydata:struct<severity:string>,impacts:array<struct<{_RESOURCE}>>,cyclonesurge:array<struct<data:array<struct<last:boolean,url:string>>>>>>"


def details(kind: Column, doc: Column) -> Column:
    """struct<magnitude,depth,rapidpopdescription,wind,burned> of a details document, by hazard type."""
    p = F.from_json(doc, _DETAILS)["properties"]
    quake, severity = p["earthquakedetails"], to_number(p["severitydata"]["severity"])
    number = lambda name: F.when(kind == "EQ", to_number(quake[name])).alias(name)
    return F.struct(number("magnitude"), number("depth"), F.when(kind == "EQ", F.trim(quake["rapidpopdescription"])).alias("rapidpopdescription"), F.when(kind == "TC", severity).alias("wind"), F.when(kind == "WF", severity).alias("burned"))


def impact_urls(kind: Column, doc: Column) -> Column:
    """array<struct<what,url>>: the further documents that a details document names. Cyclones: exposed people (the wider buffer of each impact
    first) and surges (the last ones of each source, if any is marked so); fires: the first impact."""
    p = F.from_json(doc, _DETAILS)["properties"]
    given = lambda c, what: F.filter(F.transform(c, lambda u: F.struct(F.lit(what).alias("what"), F.trim(u).alias("url"))), lambda x: x["url"] != "")
    impacts = F.coalesce(p["impacts"], F.array().cast(f"array<struct<{_RESOURCE}>>"))
    exposed = given(F.flatten(F.transform(impacts, lambda i: F.array(i["resource"]["buffer74"], i["resource"]["buffer39"]))), "exposed")
    sources = F.transform(F.coalesce(p["cyclonesurge"], F.array().cast("array<struct<data:array<struct<last:boolean,url:string>>>>")), lambda s: F.coalesce(s["data"], F.array().cast("array<struct<last:boolean,url:string>>")))
    last = lambda d: F.filter(d, lambda e: F.coalesce(e["last"], F.lit(False)))
    surges = given(F.flatten(F.transform(sources, lambda d: F.transform(F.when(F.size(last(d)) > 0, last(d)).otherwise(d), lambda e: e["url"]))), "surge")
    affected = F.slice(given(F.transform(impacts, lambda i: i["resource"]["impact"]), "affected"), 1, 1)
    return F.when(kind == "TC", F.concat(exposed, surges)).when(kind == "WF", affected).otherwise(F.array().cast("array<struct<what:string,url:string>>"))


def scalars_of(doc: Column) -> Column:
    """array<struct<name,value>> of an impact document."""
    parsed = F.from_json(doc, "struct<datums:array<struct<datum:array<struct<scalars:struct<scalar:array<struct<name:string,value:string>>>>>>>>")
    return F.flatten(F.flatten(F.transform(F.filter(parsed["datums"], lambda d: d["datum"].isNotNull()), lambda d: F.transform(F.filter(d["datum"], lambda x: x["scalars"]["scalar"].isNotNull()), lambda x: x["scalars"]["scalar"]))))


def largest_population(scalars: Column, what: Column) -> Column:
    """The largest whole number of array<struct<name,value>>: of names that begin with SUMPOP for exposed people, of POPAFFECTED for affected ones."""
    name = lambda s: F.upper(F.trim(s["name"]))
    wanted = lambda s: F.when(what == "exposed", name(s).startswith("SUMPOP")).otherwise(name(s) == "POPAFFECTED")
    return F.array_max(F.transform(F.filter(scalars, wanted), lambda s: F.floor(to_number(s["value"])).cast("double")))


def surge_height(doc: Column) -> Column:
    return to_number(F.from_json(doc, "struct<properties:struct<maxheight:string>>")["properties"]["maxheight"])


def python_list(c: Column) -> Column:
    """An array from a list that was written as text with single quotes."""
    return F.from_json(F.regexp_replace(c, "'", '"'), "array<string>")


def parse_label(response: Column, labels: list[str]) -> Column:
    """The label of a model's answer: after LABEL:, else the valid one that occurs last, else error."""
    clean = F.lower(F.regexp_replace(response, r"(?s)<think>.*?</think>", ""))
    said = F.regexp_extract(clean, r"label\s*:\s*(\w+)", 1)
    places = F.array(*[F.struct((F.length(clean) - F.locate(x[::-1], F.reverse(clean)) - len(x)).alias("at"), F.lit(-i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(labels)])
    found = F.filter(places, lambda p: clean.contains(p["x"]))
    return F.when(said.isin(*labels), said).otherwise(F.coalesce(F.array_max(found)["x"], F.lit("error")))


def answer_line(response: Column, name: str) -> Column:
    """What follows NAME: on its line; N/A, NA, none and empty are null. A name at a line's beginning goes before one elsewhere."""
    at_start, anywhere = (F.regexp_extract(response, rf"(?im){p}{name}:[ \t]*(\S.*)$", 1) for p in ("^", ""))
    value = F.trim(F.when(at_start != "", at_start).otherwise(anywhere))
    return F.when(~F.upper(value).isin("", "N/A", "NA", "NONE"), value)


def answer_number(value: Column) -> Column:
    """The number that an answer begins with; commas don't count, what follows it doesn't either."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), ",", ""), r"[^\d.\-].*$", "").try_cast("double")


def parse_place(response: Column) -> list[Column]:
    """location_text, country_iso2 (both error if not given), lat, lon, source_note of an answer."""
    number = lambda name: F.round(F.regexp_replace(answer_line(response, name), r"[^\d.\-]", "").try_cast("double"), 4).alias(name.lower())
    place, country = answer_line(response, "LOCATION"), F.substring(F.upper(answer_line(response, "COUNTRY")), 1, 2)
    return [F.coalesce(place, F.lit("error")).alias("location_text"), F.coalesce(country, F.lit("error")).alias("country_iso2"), number("LAT"), number("LON"), F.substring(F.coalesce(answer_line(response, "NOTE"), F.lit("")), 1, 200).alias("source_note")]


# What an answer about time may say, and the numbers asked for by hazard.
GRANULARITIES, TIME_TYPES = ["day", "month", "year", "unknown"], ["event_date", "date_range", "duration_only", "unknown"]
ANSWER_FIELDS = {
    "earthquake": ["magnitude", "depth_km", "rapid_pop_description"], "cyclone": ["wind_speed_kmh", "storm_surge_m", "exposed_population"], "wildfire": ["burned_area_ha", "people_affected", "duration_days"],
    "drought": ["affected_area_km2", "duration_days", "affected_country_count"], "flood": ["dead", "displaced"],
}


def parse_time(response: Column) -> list[Column]:
    """event_date_raw, event_date_iso (a day or a month), granularity, time_type, source_note of an answer."""
    raw, iso = answer_line(response, "EVENT_DATE_RAW"), answer_line(response, "EVENT_DATE_ISO")
    known = lambda name, values: F.when(F.lower(answer_line(response, name)).isin(*values), F.lower(answer_line(response, name))).otherwise("unknown").alias(name.lower())
    return [F.regexp_replace(raw, r"\s+", " ").alias("event_date_raw"), F.when(iso.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), iso).alias("event_date_iso"), known("GRANULARITY", GRANULARITIES), known("TIME_TYPE", TIME_TYPES), F.substring(F.coalesce(answer_line(response, "NOTE"), F.lit("")), 1, 220).alias("source_note")]


def parse_numbers(response: Column, label: Column) -> list[Column]:
    """One column for each field that is asked of any hazard, null for those that aren't asked of the row's."""
    out = []
    for field in sorted({f for fields in ANSWER_FIELDS.values() for f in fields}):
        kinds = [k for k, fields in ANSWER_FIELDS.items() if field in fields]
        line = answer_line(response, field.upper())
        value = F.substring(F.regexp_replace(line, r"\s+", " "), 1, 300) if field == "rapid_pop_description" else answer_number(line)
        out.append(F.when(label.isin(*kinds), value).alias(field))
    return out
