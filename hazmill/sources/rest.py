"""A hazard catalogue behind a paged REST service, as a Python data source, and the details of its rows.

The data source reads pages of feature collections, one partition for each hazard type and alert filter, one row for each feature (its JSON). A
partition ends at a short page, at its limit of rows, or when too many pages in a row have failed. Requests are tried again with exponentially growing
waits and some chance; what isn't there (404) isn't asked for again, and a task that fails altogether is Spark's to repeat.

Details are fetched where the rows are; an error leaves the row as it was. Any URL that urllib opens will do, files too.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The service's hazard types, its levels and the rows of a full page.
TYPES, LEVELS, PAGE = ["EQ", "TC", "WF", "DR", "FL"], ["green", "orange", "red"], 100
ATTEMPTS, WAIT, LONGEST_WAIT, CHANCE, PAGE_FAILURES, TIMEOUT = 4, 1.0, 20.0, 0.5, 3, 30


def backoff(attempt: int, wait: float = WAIT, longest: float = LONGEST_WAIT) -> float:
    return min(wait * 2**attempt, longest) + random.uniform(0, CHANCE)


def fetch_json(url: str | Request, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, opener=urlopen):
    """The JSON behind a URL."""
    for attempt in range(attempts):
        try:
            with opener(url, timeout=TIMEOUT) as answer:
                return json.load(answer)
        except (OSError, ValueError) as e:
            if attempt == attempts - 1 or isinstance(e, HTTPError) and e.code == 404:
                raise
            sleep(backoff(attempt))
    raise ValueError("no attempts")


def parsed_types(text: str) -> list[str]:
    """Types from a comma-separated text: the known ones, or all."""
    return [t for x in text.split(",") if (t := x.strip().upper()) in TYPES] or TYPES


def parsed_levels(text: str) -> list[str]:
    """Levels from a text separated by semicolons, or all."""
    return [t for x in text.split(";") if (t := x.strip().lower())] or LEVELS


def pages(url: str, kind: str, level: str, begin: str, end: str, limit: int, fetch=fetch_json) -> Iterator[dict]:
    """The features of one type and alert filter, at most so many. url: with {type}, {level}, {begin}, {end} and {page}."""
    page = failures = given = 0
    while given < limit:
        try:
            found = fetch(url.format(type=kind, level=quote(level, safe=";"), begin=begin, end=end, page=page)).get("features") or []
        except (OSError, ValueError):
            failures, page = failures + 1, page + 1
            if failures >= PAGE_FAILURES:
                return
            continue
        failures, page = 0, page + 1
        for feature in found[: limit - given]:
            yield feature
        given += len(found)
        if len(found) < PAGE:
            return


@dataclass
class Part(InputPartition):
    kind: str
    level: str

    def __init__(self, kind: str, level: str):
        super().__init__((kind, level))
        self.kind, self.level = kind, level


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[Part]:
        levels = parsed_levels(self.o.get("levels", ""))
        filters = levels if self.o.get("bylevel", "false").lower() == "true" else [";".join(levels)]
        return [Part(t, f) for t in parsed_types(self.o.get("types", "")) for f in filters]

    def read(self, partition: Part) -> Iterator[tuple]:
        limit = int(self.o.get("limit", "10000"))
        for n, feature in enumerate(pages(self.o["url"], partition.kind, partition.level, self.o.get("begin", ""), self.o.get("end", ""), limit)):
            yield partition.kind, partition.level, n, json.dumps(feature)


class CatalogueSource(DataSource):
    """Format "hazard_pages": type, level, n (the place among the partition's rows), feature (JSON). Options: url, types, levels, begin, end, limit, bylevel."""

    @classmethod
    def name(cls) -> str:
        return "hazard_pages"

    def schema(self) -> str:
        return "type string, level string, n int, feature string"

    def reader(self, schema) -> CatalogueReader:
        return CatalogueReader(dict(self.options))


def read_pages(spark: SparkSession, url: str, **options: str) -> DataFrame:
    spark.dataSource.register(CatalogueSource)
    return spark.read.format(CatalogueSource.name()).options(url=url, **options).load()


def fetched(df: DataFrame, url: str, out: str, attempts: int = ATTEMPTS, parallel: int | None = None) -> DataFrame:
    """The table with a column of the documents behind a column of URLs (text; null without a URL or if it can't be had)."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def got(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = []
            for address in batch.column(url).to_pylist():
                try:
                    docs.append(json.dumps(fetch_json(address, attempts)) if address else None)
                except (OSError, ValueError):
                    docs.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(docs, pa.string())], schema.fieldNames())

    rows = df.repartition(parallel) if parallel else df
    return rows.mapInArrow(got, schema)


def asker(url: str, attempts: int = ATTEMPTS) -> Callable[[list[dict]], list[dict]]:
    """A function from rows (idx, label, text) to answers (idx, label: done or error, response) of a service; with {idx} in the URL it is only read."""

    def ask(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            address = url.format(idx=r["idx"]) if "{idx}" in url else Request(url, json.dumps(r, default=str).encode(), {"Content-Type": "application/json"})
            try:
                said = fetch_json(address, attempts).get("answer")
            except (OSError, ValueError, AttributeError):
                said = None
            out.append({"idx": int(r["idx"]), "label": "error" if said is None else "done", "response": said})
        return out

    return ask


def balanced(rows: DataFrame, per_level: int, limit: int) -> DataFrame:
    """The first rows of each type and level, or, without a number for these, of each type. rows: eventid, eventtype, alertlevel, n; ids are there once."""
    from hazmill.operators.tables import capped

    return capped(rows, ["eventtype", "alertlevel"], ["n"], per_level).drop("rn") if per_level > 0 else capped(rows, ["eventtype"], ["n"], limit).drop("rn")


def with_details(rows: DataFrame, attempts: int = ATTEMPTS, parallel: int | None = None) -> DataFrame:
    """Catalogue rows (see sources.tables.features) completed from their details, and from the documents that these name."""
    from hazmill.sources.tables import details, impact_urls, largest_population, scalars_of, surge_height

    docs = fetched(rows, "details_url", "__doc", attempts, parallel)
    parts = docs.select(*docs.columns, details(F.col("eventtype"), F.col("__doc")).alias("__d"), impact_urls(F.col("eventtype"), F.col("__doc")).alias("__u"))
    named = parts.select("eventtype", "eventid", F.posexplode("__u").alias("at", "u")).select("eventtype", "eventid", "at", "u.*")
    more = fetched(named, "url", "__more", attempts, parallel)
    numbers = more.select("eventtype", "eventid", "at", "what", largest_population(scalars_of(F.col("__more")), F.col("what")).alias("people"), surge_height(F.col("__more")).alias("surge"))
    of = numbers.groupBy("eventtype", "eventid").agg(
        F.min(F.when((F.col("what") == "exposed") & F.col("people").isNotNull(), F.struct("at", "people")))["people"].alias("__exposed"),
        F.max(F.when(F.col("what") == "affected", F.col("people"))).alias("__affected"),
        F.max(F.when(F.col("what") == "surge", F.col("surge"))).alias("__surge"),
    )
    out = parts.join(of, ["eventtype", "eventid"], "left")
    fill = {"magnitude": F.col("__d.magnitude"), "depth": F.col("__d.depth"), "rapidpopdescription": F.col("__d.rapidpopdescription"), "maximum_wind_speed_kmh": F.col("__d.wind"), "burned_area_ha": F.col("__d.burned"), "maximum_storm_surge_m": F.col("__surge"), "exposed_population": F.col("__exposed"), "people_affected": F.when(F.col("__affected") > 0, F.col("__affected"))}
    return out.select(*[F.coalesce(fill[c], F.col(c)).alias(c) if c in fill else F.col(c) for c in rows.columns if c != "details_url"])
