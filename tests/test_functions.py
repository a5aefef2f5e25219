import math
import time

import pytest
from pyspark.sql import functions as F

from hazmill.functions import exprs as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("t", "df", "p"), [(0.0, 3, 1.0), (1.0, 1, 0.5), (4.302653, 2, 0.05), (2.570582, 5, 0.05), (2.228139, 10, 0.05), (1.983972, 100 - 0 + 4, 0.04991)])
def test_student_t(spark, t, df, p):
    assert one(spark, X.t_pvalue(F.lit(t), F.lit(df))) == pytest.approx(p, abs=2e-4)


@pytest.mark.parametrize(("text", "want"), [("", None), ("None", None), (" NaN ", None), ("NA", "NA"), (None, None)])
def test_textual_nulls(spark, text, want):
    assert one(spark, X.nullify(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("text", "want"), [("2025-08", "2025-08-01"), ("2025-08-14T06:00", "2025-08-14"), ("bad", None), (None, None)])
def test_dates(spark, text, want):
    got = one(spark, X.parse_date(F.lit(text).cast("string")))
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(("text", "want"), [("1,200", 1200), ("1.2 million", 1.2e6), ("5k", 5000), ("few", None), ("12 men", 12)])
def test_scaled_numbers(spark, text, want):
    assert one(spark, X.scaled_number(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("23.97°N, 121.6°E", (23.97, 121.6)), ("latitude 38.1, longitude 142.4", (38.1, 142.4)), ("(38.1, 142.4)", (38.1, 142.4)), ("95°N 10°E", None)])
def test_coordinates(spark, text, want):
    got = one(spark, X.coordinates(F.lit(text)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("dead", "displaced", "want"), [(100, 80000, "green"), (101, None, "orange_or_red"), (None, 80001, "orange_or_red"), (None, None, "green")])
def test_flood_rule(spark, dead, displaced, want):
    assert one(spark, X.flood_severity(F.lit(dead).cast("double"), F.lit(displaced).cast("double"))) == want


def test_title_and_body(spark):
    rows = spark.createDataFrame([("only body",), ("a [SEP] b [SEP] c",), (" [SEP] b",)], "t string").select(X.title_of(F.col("t")), X.body_of(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("", "only body"), ("a", "b [SEP] c"), ("", "b")]


def test_units_and_distance(spark):
    assert one(spark, X.convert_unit("maximum_wind_speed_kmh", F.lit(10.0), F.lit("m/s"))) == 36.0
    assert one(spark, X.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(6371 * math.pi)


def series_pvalue(t, n):
    """Two-sided p-value by the finite trigonometric series."""
    theta = math.atan(abs(t) / math.sqrt(n))
    cos, sin = math.cos(theta), math.sin(theta)
    if n == 1:
        return 1 - 2 * theta / math.pi
    term = total = 1.0 if n % 2 == 0 else cos
    for k in range(1, (n - n % 2) // 2 if n % 2 == 0 else (n - 1) // 2):
        term *= cos * cos * ((2 * k - 1) / (2 * k) if n % 2 == 0 else 2 * k / (2 * k + 1))
        total += term
    return 1 - (sin * total if n % 2 == 0 else 2 / math.pi * (theta + sin * total))


def test_t_tails_equal_the_series(spark):
    rows = [(float(t), n) for n in (1, 2, 3, 4, 7, 10, 33, 100, 501, 999, 1000, 1001, 2500, 20_000) for t in (-2.5, 0.0, 1e-4, 0.3, 1.0, 1.72, 1.75, 4.0, 30.0)]
    got = spark.createDataFrame(rows, "t double, n long").select("t", "n", X.t_pvalue(F.col("t"), F.col("n")).alias("p")).collect()
    assert max(abs(r.p - max(0.0, series_pvalue(r.t, r.n))) for r in got) < 1e-9


def test_t_tails_of_very_many_degrees_are_normal_and_quick(spark):
    rows = [(z / 10, 10**9) for z in range(0, 80)]
    got = spark.createDataFrame(rows, "t double, n long").select("t", X.t_pvalue(F.col("t"), F.col("n")).alias("p")).collect()
    assert all(r.p == pytest.approx(math.erfc(r.t / math.sqrt(2)), rel=1e-6, abs=1e-15) for r in got)
    begun = time.time()
    spark.range(20_000).select(F.sum(X.t_pvalue(F.col("id") / 4_000.0, F.lit(10**9)))).collect()
    assert time.time() - begun < 30
    assert one(spark, X.t_pvalue(F.lit(1.0), F.lit(0))) is None and one(spark, X.t_pvalue(F.lit(None).cast("double"), F.lit(5))) is None
