"""The whole analysis: articles to events, severity, sectors, abnormal returns and group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazmill.durable import settled
from hazmill.extract.rules import RAPID, extract_fields
from hazmill.extract.when import event_time
from hazmill.extract.where import extract_location, resolve_iso2
from hazmill.functions.exprs import MODEL_KEYS, TEXT_KEYS, body_of, industries, low_confidence, parse_timestamp, rapid_population, title_of, type_code
from hazmill.ml.severity import SeverityModels
from hazmill.operators.event_study import abnormal_returns, explode_tickers, group_statistics
from hazmill.operators.events import TEXT_NUMERICS, greedy_clusters, link_sectors, merge_clusters, nearest_catalogue, number_events

CUT, TEXTS = 512, 5


def locate(articles: DataFrame, cities: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Articles (pos, timestamp, label, text) with event_date, country_iso2, location_text, lat and lon from the title and the body's first CUT characters."""
    cut = articles.withColumn("__title", title_of(F.col("text"))).withColumn("__body", F.substring(body_of(F.col("text")), 1, CUT))
    cut = cut.withColumn("__base", F.to_date(parse_timestamp(F.col("timestamp")))).withColumn("__type", type_code(F.col("label")))
    dated = event_time(cut, "__body", "__base", "__type", "__title").select("pos", F.col("event_date").cast("string").alias("event_date"))
    placed = extract_location(cut, cities, aliases, "__body", "__title").drop("loc_confidence")
    return articles.join(dated, "pos").join(placed, "pos")


def text_fields(texts: DataFrame) -> DataFrame:
    """event_id with the fields of its articles' whole texts: largest numbers, the first population description, the last of its flags, and
    whether all articles lack the key fields. texts: event_id, type, seq, label, text."""
    got = extract_fields(texts, ["event_id", "type", "seq"], "text", "label", [*TEXT_NUMERICS, "rapidpopdescription"])
    flags = rapid_population(F.col("rapidpopdescription"))
    quake = F.col("type") == "EQ"
    got = got.withColumn("__flags", F.when(F.col("rapidpopdescription").isNotNull() | quake, flags)).withColumn("__low", low_confidence(F.col("type"), F.col, TEXT_KEYS))
    first = F.min(F.when(F.col("rapidpopdescription").isNotNull(), F.struct("seq", "rapidpopdescription")))
    last = F.max(F.when(F.col("__flags").isNotNull(), F.struct("seq", F.col("__flags.missing").alias("rapid_missing"), F.col("__flags.few").alias("rapid_few_people"), F.col("__flags.unparsed").alias("rapid_unparsed"))))
    largest = [F.max(c).alias(c) for c in TEXT_NUMERICS]
    return got.groupBy("event_id").agg(*largest, first["rapidpopdescription"].alias("rapidpopdescription"), *[last[f].alias(f) for f in RAPID], F.bool_and("__low").alias("low_confidence"))


def text_sectors(texts: DataFrame) -> DataFrame:
    """event_id, sectors_from_text: the sectors that its first TEXTS articles name, in order. texts: event_id, seq, text. Other rows are dropped before the shuffle."""
    few = texts.withColumn("n", F.row_number().over(W.partitionBy("event_id").orderBy("seq"))).filter(F.col("n") <= TEXTS)
    lists = few.select("event_id", "n", industries(F.coalesce("text", F.lit(""))).alias("s")).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("l"))
    return lists.select("event_id", F.array_distinct(F.flatten(F.transform("l", lambda x: x["s"]))).alias("sectors_from_text"))


def build_events(articles: DataFrame, catalogue: DataFrame, models: SeverityModels | None = None, max_rows: int = 0, aliases: DataFrame | None = None, lists: bool = False) -> DataFrame:
    """Events of articles (pos, idx, label, event_date, country_iso2, location_text, text; see locate): clustered, numbered, matched by the
    resolved country, given a severity, linked.

    A matched event takes the catalogue's fields, nulls too. An unmatched one takes those of its articles' texts; its severity comes from
    its type's model, or a rule for floods (a type without a model has none). With lists each event has its articles' ids in one row. catalogue: g_pos, g_type, g_iso2, g_day, alert and any of the fields.
    """
    relevant = articles.filter(~F.col("label").eqNullSafe("not_related"))
    if max_rows:
        relevant = relevant.orderBy("pos").limit(max_rows)
    placed = settled(greedy_clusters(relevant)).join(relevant, "pos")  # several steps below start from the clusters
    events = settled(number_events(settled(merge_clusters(placed, ["type", "country", "cluster"], lists=lists))))
    asked = events.select(F.col("event_id").alias("cid"), "type", F.col("primary_country").alias("iso2"), F.col("event_date").cast("date").alias("day"))
    matched = nearest_catalogue(asked, catalogue).select(F.col("cid").alias("event_id"), "g_pos", F.col("predicted_alert").alias("catalogue_alert"), F.col("prob").alias("catalogue_prob"))
    fields = [*TEXT_NUMERICS, "rapidpopdescription", *RAPID]
    events = settled(events.select(*[c for c in events.columns if c not in (*fields, "low_confidence")]).join(matched, "event_id"))
    known = [F.col(c) if c in catalogue.columns else F.lit(None).cast("string" if c == "rapidpopdescription" else "double").alias(c) for c in fields]
    hits = events.filter("g_pos is not null").join(catalogue.select("g_pos", F.lower(F.trim("alert")).alias("catalogue_alertlevel"), *known), "g_pos", "left")
    hits = hits.withColumn("low_confidence", F.col("catalogue_alertlevel").isNull())
    member = placed.select("type", "country", "cluster", "seq", "label", "text").join(events.select("type", "country", "cluster", "event_id", "g_pos"), ["type", "country", "cluster"])
    read = text_fields(member.filter("g_pos is null").select("event_id", "type", "seq", "label", "text"))
    missed = events.filter("g_pos is null").join(read, "event_id", "left").withColumn("catalogue_alertlevel", F.lit(None).cast("string"))
    missed = missed.withColumn("low_confidence", low_confidence(F.col("type"), F.col, MODEL_KEYS))
    out = hits.withColumns({"prob": F.col("catalogue_prob"), "predicted_alert": F.col("catalogue_alert"), "severity_source": F.lit("catalogue")})
    out = out.unionByName((models or SeverityModels()).predict(missed).withColumn("severity_source", F.lit("model"))).drop("catalogue_alert", "catalogue_prob")
    out = settled(out)
    codes = resolve_iso2(out, "event_id", "primary_country", "location_text", aliases)
    out = out.join(codes, "event_id").join(text_sectors(member.select("event_id", "seq", "text")), "event_id", "left")
    return link_sectors(out.withColumn("sectors_from_text", F.coalesce("sectors_from_text", F.array().cast("array<string>"))), text=None)


def event_study(events: DataFrame, prices: DataFrame, market: DataFrame, align: str = "fixed") -> tuple[DataFrame, DataFrame]:
    """(abnormal returns by event and fund, group statistics) of events with a date and a fund."""
    tradeable = events.filter((F.size("sector_etfs") > 0) & F.col("event_date").isNotNull())
    pairs = explode_tickers(tradeable, align).select("event_id", F.col("event_date").cast("date").alias("event_date"), F.col("type").alias("event_type"), F.col("predicted_alert").alias("severity"), "ticker", "sector")
    cars = abnormal_returns(pairs, prices, market)
    return cars, group_statistics(cars)


def single_ticker_study(events: DataFrame, prices: DataFrame, market: DataFrame) -> DataFrame:
    """Abnormal returns of one ticker an event: its country's index, or else its first fund."""
    one = events.select("event_id", F.col("event_date").cast("date").alias("event_date"), F.coalesce("index_ticker", F.get("sector_etfs", F.lit(0))).alias("ticker"))
    return abnormal_returns(one, prices, market)
