"""Evaluations of extraction, labelling and linking against a table of truths: rates, medians and breakdowns, overall (null class) and by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazmill.functions.exprs import haversine, parse_date
from hazmill.operators.medians import exact_medians
from hazmill.operators.tables import classification_report, confusion

# Errors that labels note instead of a value, and distances and day counts that are reported.
ERRORS = ["error", "Error", "api_error"]


def join_labels(labels: DataFrame, articles: DataFrame, key: str = "idx") -> DataFrame:
    """Labels with their articles' columns; columns of both sides but the key get _gt and _article."""
    both = {c for c in labels.columns if c in articles.columns and c != key}
    left = labels.select(*[F.col(c).alias(f"{c}_gt") if c in both else F.col(c) for c in labels.columns])
    right = articles.select(*[F.col(c).alias(f"{c}_article") if c in both else F.col(c) for c in articles.columns])
    return left.join(right, key)


def valid_labels(labels: DataFrame, column: str) -> DataFrame:
    """Without rows whose value is missing or an error."""
    return labels.filter(F.col(column).isNotNull() & ~F.col(column).isin(*ERRORS))


def rate(hits: Column, of: Column) -> Column:
    """The share of hits among the rows that count, null if none does."""
    return F.round(F.try_divide(F.count_if(of & hits), F.count_if(of)), 6)


def _by(df: DataFrame, by: str | None, *aggregates: Column, median: str, name: str, columns: list[str]) -> DataFrame:
    """The aggregates and the exact median of a column, overall and by class."""
    if by is None:
        rates, middle = df.agg(*aggregates), exact_medians(df, [], median, name)
        return rates.crossJoin(middle.select(F.round(name, 4).alias(name))).select(*columns)  # one row each
    rates = df.groupingSets([[], [by]], by).agg(*aggregates, F.grouping_id().cast("int").alias("__all"))
    sides = df.select(F.explode(F.array(F.struct(F.lit(0).alias("__all"), F.col(by).alias("__by")), F.struct(F.lit(1).alias("__all"), F.lit(None).cast(df.schema[by].dataType).alias("__by")))).alias("__k"), median).select("__k.*", median)
    middle = exact_medians(sides, ["__all", "__by"], median, name).select(F.col("__all").alias("__a"), "__by", F.round(name, 4).alias(name))
    return rates.join(middle, (F.col("__all") == F.col("__a")) & F.col(by).eqNullSafe(F.col("__by")), "left").select(by, *columns)


def compare_places(df: DataFrame, by: str | None = None) -> DataFrame:
    """n, country_accuracy (of rows with both), coverage, coord_pairs, median_km, within_100, within_500 and the counts of each confidence.

    df: gt_country, gt_lat, gt_lon, pred_location, pred_country, pred_lat, pred_lon, confidence. Only coordinates from the text count.
    """
    both = F.col("gt_country").isNotNull() & F.col("pred_country").isNotNull()
    placed = (F.col("confidence") == "coords_text") & F.col("gt_lat").isNotNull() & F.col("gt_lon").isNotNull() & F.col("pred_lat").isNotNull() & F.col("pred_lon").isNotNull()
    df = df.withColumn("__km", F.when(placed, haversine(F.col("gt_lat"), F.col("gt_lon"), F.col("pred_lat"), F.col("pred_lon"))))
    km = F.col("__km")
    counts = [F.count_if(F.col("confidence") == c).alias(f"n_{c}") for c in ("coords_text", "location", "none")]
    return _by(
        df, by, F.count("*").alias("n"), rate(F.upper(F.trim("gt_country")) == F.upper(F.trim("pred_country")), both).alias("country_accuracy"), rate(F.col("pred_location").isNotNull(), F.lit(True)).alias("coverage"), F.count(km).alias("coord_pairs"), rate(km < 100, km.isNotNull()).alias("within_100"), rate(km < 500, km.isNotNull()).alias("within_500"), *counts,
        median="__km", name="median_km", columns=["n", "country_accuracy", "coverage", "coord_pairs", "median_km", "within_100", "within_500", "n_coords_text", "n_location", "n_none"],
    )


def day_errors(df: DataFrame, truth: str = "gt_date", got: str = "pred_date") -> DataFrame:
    """With diff_days, exact (two nulls agree), within_1d and within_7d; a month stands for its first day."""
    a, b = parse_date(F.col(truth).cast("string")), F.col(got).cast("date")
    diff = F.abs(F.datediff(a, b))
    return df.withColumns({"diff_days": diff, "exact": a.eqNullSafe(b), "within_1d": F.coalesce(diff <= 1, F.lit(False)), "within_7d": F.coalesce(diff <= 7, F.lit(False))})


def compare_times(df: DataFrame, by: str | None = None) -> DataFrame:
    """n, n_dated (truths), coverage, comparable, exact, within_1d, within_7d, median_days, both_null. df: gt_date, pred_date."""
    df = day_errors(df)
    truth, got = parse_date(F.col("gt_date").cast("string")).isNotNull(), F.col("pred_date").isNotNull()
    return _by(
        df, by, F.count("*").alias("n"), F.count_if(truth).alias("n_dated"), rate(got, truth).alias("coverage"), F.count_if(truth & got).alias("comparable"), *[rate(F.col(c), truth & got).alias(c) for c in ("exact", "within_1d", "within_7d")], F.count_if(~truth & ~got).alias("both_null"),
        median="diff_days", name="median_days", columns=["n", "n_dated", "coverage", "comparable", "exact", "within_1d", "within_7d", "median_days", "both_null"],
    )


def breakdown(df: DataFrame, column: str) -> DataFrame:
    """Each value's count and share."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.join(total).select(column, "n", F.round(F.col("n") / F.col("__total"), 6).alias("share"))


def full_report(df: DataFrame, labels: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """label, precision, recall, f1, support of the given labels in their order (nr), zeros where there is nothing; then macro avg and accuracy."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(labels)), "nr int, label string")
    own = wanted.join(classification_report(df, label, pred), "label", "left").select("nr", "label", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")], F.coalesce("support", F.lit(0)).cast("long").alias("support"))
    macro = own.agg(F.lit(len(labels)).alias("nr"), F.lit("macro avg").alias("label"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    pairs = confusion(df, label, pred)
    hits = F.round(F.try_divide(F.sum(F.when(F.col("label") == F.col("pred"), F.col("n"))), F.sum("n")), 6)
    accuracy = pairs.agg(F.lit(len(labels) + 1).alias("nr"), F.lit("accuracy").alias("label"), *[F.coalesce(hits, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")], F.sum("n").alias("support"))
    return own.unionByName(macro).unionByName(accuracy)


def rule_baseline(labels: DataFrame, classes: list[str], truth: str = "label", guess: str = "old_event_type", articles: DataFrame | None = None, key: str = "idx") -> DataFrame:
    """full_report of what earlier rules or themes said of each article against its label; rows whose label is missing or an error don't count.

    Without articles, labels has both columns; else the guesses are the articles'.
    """
    both = valid_labels(labels, truth)
    if articles is not None:
        both = both.select(key, truth).join(articles.select(key, guess), key)
    return full_report(both.select(F.col(truth).alias("label"), F.lower(F.trim(guess)).alias("pred")), classes)


def positive_f1(df: DataFrame, positive: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """f1 of one class (0 if it doesn't occur)."""
    own = classification_report(df, label, pred).filter(F.col("label") == positive)
    return own.agg(F.coalesce(F.max("f1"), F.lit(0.0)).alias("f1"))


def coverage_counts(events: DataFrame) -> DataFrame:
    """n, with_country, with_funds, tradeable, matched: how far events got."""
    funds = F.size("sector_etfs") > 0
    return events.agg(F.count("*").alias("n"), F.count("iso2").alias("with_country"), F.count_if(funds).alias("with_funds"), F.count_if(funds & F.col("event_date").isNotNull()).alias("tradeable"), F.count("g_pos").alias("matched"))


def label_distribution(df: DataFrame, alert: str = "alertlevel") -> DataFrame:
    """green and orange_or_red of rows whose level is known."""
    level = F.lower(F.trim(alert))
    return df.agg(F.count_if(level == "green").alias("green"), F.count_if(level.isin("orange", "red")).alias("orange_or_red"))


def row_slice(df: DataFrame, begin: int, end: int, pos: str = "pos", kind: str = "event_type", without: str = "volcano") -> DataFrame:
    """Rows from one place up to before another, without a kind that isn't supported."""
    return df.filter(F.col(pos).between(begin, end - 1) & ~F.col(kind).eqNullSafe(without))


def iso_week(date: Column) -> Column:
    """2025-W07; UNKNOWN_DATE for null."""
    return F.coalesce(F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0")), F.lit("UNKNOWN_DATE"))
