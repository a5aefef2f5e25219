"""Command line: python -m hazmill.cli COMMAND ...

analyse   articles and a catalogue to events, abnormal returns and group statistics
extract   a table with a text column to the same table with a JSON column of extracted features
train     a catalogue to a folder of severity models
recall    events and a catalogue to the catalogue's entries with the events near them, and the rates
fetch     a paged service to a catalogue table
evaluate  labels and articles to rates of what is extracted: places, times, numbers, or earlier labels
label     articles that have no answer yet to answers of a service, kept in a folder, and a table of what they say
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmill.durable import settled
from hazmill.extract.rules import FIELDS, extract_features, extract_fields
from hazmill.extract.when import event_time
from hazmill.extract.where import city_index, extract_location
from hazmill.functions.exprs import body_of, nullify, parse_date, parse_timestamp, title_of, to_number, type_code
from hazmill.ml.severity import FEATURES, SeverityModels, train_type
from hazmill.operators.evaluate import compare_places, compare_times, join_labels, rule_baseline, valid_labels
from hazmill.operators.events import catalogue_recall, recall_rates
from hazmill.operators.tables import keep_first, threshold_accuracy
from hazmill.plans.pipeline import build_events, event_study, locate
from hazmill.sources import rest, sheets, tables
from hazmill.sources.prices import read_prices

#: What articles are labelled as.
LABELS = ("earthquake", "flood", "cyclone", "wildfire", "drought", "not_related")


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hazmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyse")
    a.add_argument("--input", required=True, help="articles: idx, timestamp, label, text")
    a.add_argument("--catalogue", help="hazard catalogue; none is an empty one")
    a.add_argument("--prices", help="ticker, date, close; without it no returns are computed")
    a.add_argument("--price-url", help="a service of prices instead, with {ticker}, {begin} and {end}; only the events' funds and days are asked for")
    a.add_argument("--market", default="ACWI", help="the ticker that stands for the market")
    a.add_argument("--models", help="folder of severity models")
    a.add_argument("--cities", help="gazetteer: name, alternatenames, population, iso2, lat, lon")
    a.add_argument("--max-rows", type=int, default=0)
    a.add_argument("--skip-stock", action="store_true")
    a.add_argument("--lists", action="store_true", help="the articles' ids in one row for each event")
    a.add_argument("--output-dir", required=True)
    x = sub.add_parser("extract")
    x.add_argument("--input", required=True)
    x.add_argument("--output", required=True, help="xlsx or a folder of CSV files")
    for name, default in (("text", "text"), ("timestamp", "timestamp"), ("location", "location_text"), ("event-type", "label")):
        x.add_argument(f"--{name}-column", default=default)
    t = sub.add_parser("train")
    t.add_argument("--input", required=True)
    t.add_argument("--model-dir", required=True)
    t.add_argument("--types", default="EQ,TC,WF,DR")
    r = sub.add_parser("recall")
    r.add_argument("--events", required=True)
    r.add_argument("--catalogue", required=True)
    r.add_argument("--start", default="2025-08-01")
    r.add_argument("--end", default="2025-12-31")
    r.add_argument("--tolerance", type=int, default=7)
    r.add_argument("--lists", action="store_true", help="the clusters' ids in one text for each entry")
    r.add_argument("--output", required=True)
    f = sub.add_parser("fetch")
    f.add_argument("--url", required=True, help="with {type}, {level}, {begin}, {end} and {page}")
    f.add_argument("--fromdate", default="")
    f.add_argument("--todate", default="")
    f.add_argument("--types", default="")
    f.add_argument("--levels", default="")
    f.add_argument("--limit-per-type", type=int, default=10_000)
    f.add_argument("--balanced-per-level", type=int, default=0)
    f.add_argument("--no-details", action="store_true")
    f.add_argument("--output", required=True)
    e = sub.add_parser("evaluate")
    e.add_argument("kind", choices=sorted(EVALUATIONS))
    e.add_argument("--labels", required=True)
    e.add_argument("--articles", help="idx, timestamp, label, text; earlier labels need none")
    e.add_argument("--cities", help="gazetteer, for places")
    e.add_argument("--output", required=True)
    n = sub.add_parser("label")
    n.add_argument("--kind", choices=["type", "place", "time", "numbers"], default="type")
    n.add_argument("--input", required=True, help="idx, label, text")
    n.add_argument("--service", required=True, help="URL that is sent {idx, label, text} as JSON and answers {answer}; {idx} in it is filled in and makes it a plain request")
    n.add_argument("--answers", required=True, help="folder of answers; rows that have one there aren't asked again")
    n.add_argument("--batch", type=int, default=50)
    n.add_argument("--output", required=True)
    return top


def analyse(spark: SparkSession, o: argparse.Namespace) -> None:
    raw = tables.read_table(spark, o.input, tables.ARTICLES, line_breaks=True).withColumn("pos", F.monotonically_increasing_id())
    cities = tables.read_table(spark, o.cities) if o.cities else None
    if cities is not None:
        cities = city_index(cities)
    articles = locate(raw.filter(~F.col("label").eqNullSafe("not_related")), cities)
    entries = tables.catalogue(spark, o.catalogue, countries=True)
    entries = entries.select(F.monotonically_increasing_id().alias("g_pos"), F.col("etype").alias("g_type"), F.col("iso2").alias("g_iso2"), F.col("event_date").alias("g_day"), F.col("alertlevel").alias("alert"), *[c for c in entries.columns if c in tables.CATALOGUE_NUMBERS or c == "rapidpopdescription"])
    build_events(articles, entries, SeverityModels(o.models), o.max_rows, lists=o.lists).write.mode("overwrite").parquet(f"{o.output_dir}/events")
    events = spark.read.parquet(f"{o.output_dir}/events")
    if o.skip_stock or not (o.prices or o.price_url):
        return
    if o.price_url:
        prices = settled(prices_of(events, o.price_url, o.market))
    else:
        prices = tables.read_table(spark, o.prices).select("ticker", F.to_date("date").alias("date"), F.col("close").cast("double").alias("close"))
    cars, groups = event_study(events, prices, prices.filter(F.col("ticker") == o.market))
    cars.write.mode("overwrite").parquet(f"{o.output_dir}/car_results")
    tables.write_csv(groups, f"{o.output_dir}/group_analysis")


def prices_of(events: DataFrame, url: str, market: str, before: int = 120, after: int = 30) -> DataFrame:
    """Prices of the events' funds and the market, from so many days before the first event to so many after the last."""
    funds = events.select(F.explode("sector_etfs").alias("t")).distinct().collect()  # at most the funds that are known
    day = F.to_date("event_date")
    first, last = events.agg(F.date_sub(F.min(day), before), F.date_add(F.max(day), after)).first()
    prices = read_prices(events.sparkSession, url=url, tickers=",".join(sorted({r.t for r in funds} | {market})))
    return prices.filter(F.col("date").between(F.lit(first), F.lit(last)))


def extract(spark: SparkSession, o: argparse.Namespace) -> None:
    got = extract_features(tables.read_table(spark, o.input, line_breaks=True), o.text_column, o.event_type_column, o.timestamp_column, o.location_column)
    (sheets.write_xlsx if o.output.endswith(".xlsx") else tables.write_csv)(got, o.output)


def train(spark: SparkSession, o: argparse.Namespace) -> None:
    entries = tables.catalogue(spark, o.input)
    for kind in [k for k in rest.parsed_types(o.types) if k in FEATURES]:
        print(json.dumps(train_type(entries, kind, o.model_dir) or {"type": kind, "skipped": "too few rows of a class"}))


def recall(spark: SparkSession, o: argparse.Namespace) -> None:
    events = tables.read_table(spark, o.events).select(F.col("event_id").alias("cid"), "type", "iso2", parse_date(F.col("event_date").cast("string")).alias("day"))
    entries = tables.catalogue(spark, o.catalogue, o.start, o.end, countries=True).select(F.col("eventid").alias("g_pos"), F.col("etype").alias("g_type"), F.col("iso2").alias("g_iso2"), F.col("event_date").alias("g_day"), F.col("alertlevel").alias("alert"))
    found = catalogue_recall(events, entries, o.tolerance, o.lists)
    tables.write_csv(found, o.output)
    recall_rates(found).show(100, False)


def fetch(spark: SparkSession, o: argparse.Namespace) -> None:
    options = {"begin": o.fromdate, "end": o.todate, "types": o.types, "levels": o.levels, "limit": str(o.limit_per_type), "bylevel": str(o.balanced_per_level > 0).lower()}
    rows = tables.features(rest.read_pages(spark, o.url, **options))
    once = keep_first(rows.withColumn("key", F.concat_ws("|", "eventtype", "eventid")).filter("eventid <> ''"), "key", "n").drop("key")
    chosen = rest.balanced(once, o.balanced_per_level, o.limit_per_type)
    tables.write_fixed(chosen if o.no_details else rest.with_details(chosen), o.output)


def _evaluated(spark: SparkSession, o: argparse.Namespace, truth: str) -> DataFrame:
    """The articles (pos, label, timestamp, text) that have a valid label, with the label's columns, which are called ..._gt where both have one."""
    labels = valid_labels(tables.read_table(spark, o.labels), truth)
    articles = tables.read_table(spark, o.articles, tables.ARTICLES, line_breaks=True)
    both = join_labels(labels, articles).withColumn("pos", F.col("idx").cast("long"))
    return both.withColumnRenamed("label_article", "label") if "label" in labels.columns else both


def evaluate_places(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    both = _evaluated(spark, o, "location_text").withColumns({"gt_country": F.col("country_iso2"), "gt_lat": to_number(F.col("lat")), "gt_lon": to_number(F.col("lon"))}).drop("location_text", "country_iso2", "lat", "lon")
    cities = city_index(tables.read_table(spark, o.cities)) if o.cities else None
    cut = both.withColumns({"title": title_of(F.col("text")), "body": body_of(F.col("text"))})
    got = extract_location(cut, cities, None, "body", "title").select("pos", F.col("location_text").alias("pred_location"), F.col("country_iso2").alias("pred_country"), F.col("lat").alias("pred_lat"), F.col("lon").alias("pred_lon"), F.col("loc_confidence").alias("confidence"))
    return compare_places(both.join(got, "pos"), "label")


def evaluate_times(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    both = _evaluated(spark, o, "granularity").withColumns({"base": F.to_date(parse_timestamp(F.col("timestamp"))), "type": type_code(F.col("label"))}).withColumnRenamed("granularity", "granularity_gt")
    got = event_time(both.drop("time_type", "event_date_raw"), "text", "base", "type")
    return compare_times(got.withColumns({"gt_date": nullify(F.col("event_date_iso")), "pred_date": F.col("event_date")}), "label")


def evaluate_numbers(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """field, n, coverage, within_5, within_20, within_50, median_error."""
    both = _evaluated(spark, o, "idx")
    names = {name: LABEL_FIELDS.get(name, name) for name in both.columns if LABEL_FIELDS.get(name, name) in FIELDS}
    truths = both.select("pos", *[to_number(F.col(c)).alias(f"t_{f}") for c, f in names.items()])
    got = extract_fields(both, ["pos"], "text", "label", list(names.values())).join(truths, "pos")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"t_{f}").alias("truth"), F.col(f).alias("got")) for f in names.values()]))
    return threshold_accuracy(got.select(each.alias("e")).select("e.*"), "field", "truth", "got")


def evaluate_labels(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """What was said before (old_event_type) against the labels (llm_event_type or label)."""
    labels = tables.read_table(spark, o.labels)
    truth = "llm_event_type" if "llm_event_type" in labels.columns else "label"
    return rule_baseline(labels, list(LABELS), truth).orderBy("nr")


EVALUATIONS = {"places": evaluate_places, "times": evaluate_times, "numbers": evaluate_numbers, "labels": evaluate_labels}
#: Names of label columns that fields have other names for.
LABEL_FIELDS = {"depth_km": "depth", "wind_speed_kmh": "maximum_wind_speed_kmh", "storm_surge_m": "maximum_storm_surge_m"}


def evaluate(spark: SparkSession, o: argparse.Namespace) -> None:
    got = EVALUATIONS[o.kind](spark, o)
    tables.write_csv(got, o.output)
    spark.read.csv(o.output, header=True).show(100, False)


def label(spark: SparkSession, o: argparse.Namespace) -> None:
    rows = tables.read_table(spark, o.input, tables.ARTICLES, line_breaks=True).select("idx", "label", "text")
    answers = tables.labelled(rows, o.answers, rest.asker(o.service), "idx long, label string, response string", batch=o.batch)
    known = answers.select("idx", "response").join(rows.select("idx", F.col("label").alias("kind")), "idx")
    said = {"type": lambda: [tables.parse_label(F.col("response"), list(LABELS)).alias("label")], "place": lambda: tables.parse_place(F.col("response")), "time": lambda: tables.parse_time(F.col("response")), "numbers": lambda: tables.parse_numbers(F.col("response"), F.col("kind"))}[o.kind]()
    tables.write_csv(known.select("idx", *([] if o.kind == "type" else [F.col("kind").alias("label")]), *said), o.output)


def main(args: list[str] | None = None) -> None:
    from hazmill.shipping import ship

    o = arguments().parse_args(args)
    spark = SparkSession.builder.appName("hazmill").getOrCreate()
    ship(spark)
    {"analyse": analyse, "extract": extract, "train": train, "recall": recall, "fetch": fetch, "evaluate": evaluate, "label": label}[o.command](spark, o)


if __name__ == "__main__":
    main()
