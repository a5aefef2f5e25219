import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from hazmill import cli
from hazmill.ml import models, severity
from hazmill.plans import pipeline as P
from hazmill.sources import tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A catalogue in which large quakes and strong winds are red, as CSV, and models trained on it."""
    rng, rows = random.Random(2), []
    for i in range(240):
        kind, x = ("EQ", "TC")[i % 2], rng.random()
        day = date(2024, 10, 1) + timedelta(i * 2)
        rows.append((str(i), kind, "red" if x > 0.5 else "green", "Japan", str(day), 4 + 4 * x if kind == "EQ" else None, 100 + 100 * x if kind == "TC" else None, "few people" if kind == "EQ" else None))
    df = spark.createDataFrame(rows + [("999", "DR", "red", "Japan", "2025-01-01", None, None, None)], "eventid string, eventtype string, alertlevel string, country string, fromdate string, magnitude double, maximum_wind_speed_kmh double, rapidpopdescription string")
    path = tmp_path_factory.mktemp("models")
    tables.write_fixed(df, f"{path}/catalogue.csv")
    got = {k: severity.train_type(tables.catalogue(spark, f"{path}/catalogue.csv"), k, f"{path}/models", trees=10) for k in ("EQ", "TC", "DR")}
    assert got["DR"] is None and got["EQ"]["split"] == "time" and got["EQ"]["test"]["macro_f1"] > 0.8 and got["TC"]["cv_f1"] > 0.8
    return path


def test_models_are_stored_and_loaded_by_type(spark, folder):
    events = spark.createDataFrame([(1, "EQ", 7.9, None, None, None), (2, "EQ", 4.1, None, None, None), (3, "TC", None, 199.0, None, None), (4, "FL", None, None, 200.0, None), (5, "DR", None, None, None, None), (6, None, None, None, None, None)], "event_id long, type string, magnitude double, maximum_wind_speed_kmh double, dead double, displaced double")
    got = {r.event_id: r for r in severity.SeverityModels(f"{folder}/models").predict(events).collect()}
    assert {i: r.predicted_alert for i, r in got.items()} == {1: "orange_or_red", 2: "green", 3: "orange_or_red", 4: "orange_or_red", 5: None, 6: None}
    assert got[1].prob > 0.5 and got[4].prob is None


def test_whole_analysis(spark, folder):
    rows = [(i, f"2025010{1 + i}120000", label, text) for i, (label, text) in enumerate([
        ("earthquake", "Quake strikes Peru [SEP] A magnitude 7.9 earthquake struck yesterday. It killed 12 people."), ("earthquake", "Peru again [SEP] A magnitude 7.1 quake hit Peru on January 1, 2025."),
        ("flood", "Floods in Kenya [SEP] A flood killed 150 people. Crops were lost. The insurer pays."), ("not_related", "Sports [SEP] Nothing."), ("cyclone", "Storm [SEP] A storm hit Japan on January 4, 2025 with 100 mph winds."),
    ])]
    a = spark.createDataFrame(rows, "pos long, timestamp string, label string, text string").withColumn("idx", F.col("pos"))
    located = P.locate(a)
    entries = spark.createDataFrame([(0, "TC", "JP", date(2025, 1, 6), "Orange", 180.0)], "g_pos long, g_type string, g_iso2 string, g_day date, alert string, maximum_wind_speed_kmh double")
    got = {r.type: r for r in P.build_events(located, entries, severity.SeverityModels(f"{folder}/models")).collect()}
    assert set(got) == {"EQ", "FL", "TC"} and got["EQ"].article_count == 2 and got["EQ"].iso2 == "PE" and got["EQ"].magnitude == 7.9 and got["EQ"].predicted_alert == "orange_or_red" and got["EQ"].rapid_missing == 1
    assert got["TC"].severity_source == "catalogue" and got["TC"].maximum_wind_speed_kmh == 180 and got["TC"].predicted_alert == "orange_or_red" and not got["TC"].low_confidence
    assert got["FL"].sectors_from_text == ["agriculture", "insurance"] and got["FL"].predicted_alert == "orange_or_red" and got["FL"].linked


def test_text_classifier(spark):
    rows = [(i, ("flood", "fire")[i % 2], ("water rose in town " if i % 2 == 0 else "flames burned the hills ") + f"report {i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "idx long, label string, text string")
    got = models.label_predictions(models.train_text(df, iterations=50), df).collect()
    assert all(r.label == r.pred and 0.5 < r.confidence <= 1 for r in got)


def test_batched_labels(spark):
    from hazmill.ml.batched import batched_labels

    def make():
        import numpy as np

        return lambda x: np.stack([x, -x, np.zeros_like(x)], axis=1).astype(np.float32)

    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([3, -2, 0])], "idx long, x double")
    got = batched_labels(df, make, ["x"], ["a", "b", "c"]).orderBy("idx").collect()
    assert [r.pred_label for r in got] == ["a", "b", "a"] and got[2].confidence == pytest.approx(1 / 3) and all(r.prob_a + r.prob_b + r.prob_c == pytest.approx(1) for r in got)


def test_command_line(spark, folder, tmp_path):
    (tmp_path / "a.csv").write_text('idx,timestamp,label,text\n1,20250105120000,flood,"Flood in Kenya [SEP] A flood killed 150 people."\n2,20250105120000,not_related,x\n')
    cli.main(["extract", "--input", f"{tmp_path}/a.csv", "--output", f"{tmp_path}/features"])
    assert spark.read.csv(f"{tmp_path}/features", header=True, escape='"').filter("idx = 1").first().event_features.startswith('{"event_type": "FL"')
    prices = "\n".join(f"{t},{date(2024, 10, 1) + timedelta(d)},{100 + (d * 7 + k * 3) % 11}" for k, t in enumerate(["ACWI", "IAK", "MOO", "XHB"]) for d in range(130))
    (tmp_path / "p.csv").write_text("ticker,date,close\n" + prices + "\n")
    cli.main(["analyse", "--input", f"{tmp_path}/a.csv", "--catalogue", f"{folder}/catalogue.csv", "--prices", f"{tmp_path}/p.csv", "--models", f"{folder}/models", "--output-dir", f"{tmp_path}/out"])
    assert spark.read.parquet(f"{tmp_path}/out/events").count() == 1 and spark.read.parquet(f"{tmp_path}/out/car_results").filter("error is null").count() > 0
    cli.main(["recall", "--events", _as_parquet(spark, tmp_path), "--catalogue", f"{folder}/catalogue.csv", "--start", "2024-10-01", "--output", f"{tmp_path}/recall"])
    assert spark.read.csv(f"{tmp_path}/recall", header=True).count() > 0


def _as_parquet(spark, tmp_path):
    path = f"{tmp_path}/again.parquet"
    spark.read.parquet(f"{tmp_path}/out/events").write.parquet(path)
    return path


def test_evaluations_and_labelling_from_the_command_line(spark, tmp_path):
    articles = [(1, "2025-01-10", "flood", "Flood hits Japan [SEP] Flood killed 12 people on 5 January 2025. It struck Japan at 35.0N, 139.0E."), (2, "2025-02-01", "earthquake", "Quake [SEP] A magnitude 6.1 earthquake struck Chile yesterday."), (3, "2025-03-01", "flood", "x [SEP] y")]
    spark.createDataFrame(articles, "idx long, timestamp string, label string, text string").coalesce(1).write.csv(f"{tmp_path}/a.csv", header=True)
    labels = [(1, "flood", "Japan", "JP", "35.1", "139.0", "2025-01-05", "day", "12"), (2, "earthquake", "Chile", "CL", None, None, "2025-01-30", "day", None), (3, "flood", "error", "error", None, None, None, "unknown", None)]
    spark.createDataFrame(labels, "idx long, label string, location_text string, country_iso2 string, lat string, lon string, event_date_iso string, granularity string, dead string").coalesce(1).write.csv(f"{tmp_path}/l.csv", header=True)

    def result(kind, labels="l.csv"):
        cli.main(["evaluate", kind, "--labels", f"{tmp_path}/{labels}", "--articles", f"{tmp_path}/a.csv", "--output", f"{tmp_path}/{kind}"])
        return [r.asDict() for r in spark.read.csv(f"{tmp_path}/{kind}", header=True).collect()]

    places = {r["label"]: r for r in result("places")}
    assert places[None]["n"] == "2" and places[None]["country_accuracy"] == "1.0" and float(places["flood"]["median_km"]) == pytest.approx(11.12, abs=0.1)
    times = {r["label"]: r for r in result("times")}
    assert times[None]["n"] == "3" and times["flood"]["exact"] == "1.0" and times["earthquake"]["median_days"] == "1.0"
    numbers = {r["field"]: r for r in result("numbers")}
    assert numbers["dead"]["n"] == "1" and numbers["dead"]["within_5"] == "1.0"
    spark.createDataFrame([(1, "flood", " Flood"), (2, "earthquake", "flood"), (3, "error", "flood")], "idx long, llm_event_type string, old_event_type string").coalesce(1).write.csv(f"{tmp_path}/t.csv", header=True)
    said = {r["label"]: r for r in result("labels", "t.csv")}
    assert said["accuracy"]["f1"] == "0.5" and said["flood"]["precision"] == "0.5" and said["earthquake"]["recall"] == "0.0"

    (tmp_path / "service").mkdir()
    for k, text in ((1, "LABEL: flood"), (2, "this is an earthquake")):
        (tmp_path / "service" / f"{k}.json").write_text(json.dumps({"answer": text}))
    for round_ in (1, 2):  # the third article's answer is there the second time only
        cli.main(["label", "--input", f"{tmp_path}/a.csv", "--service", f"file://{tmp_path}/service/{{idx}}.json", "--answers", f"{tmp_path}/answers", "--output", f"{tmp_path}/labels"])
        got = {r.idx: r.label for r in spark.read.csv(f"{tmp_path}/labels", header=True).collect()}
        assert got["1"] == "flood" and got["2"] == "earthquake" and got.get("3") in ((None, "error") if round_ == 1 else ("not_related",))
        (tmp_path / "service" / "3.json").write_text(json.dumps({"answer": "LABEL: not_related"}))
        (tmp_path / "service" / "1.json").write_text(json.dumps({"answer": "LABEL: drought"}))  # isn't asked for again


def test_text_classifier_learns_from_each_different_row_once(spark):
    """Rows whose terms of the vocabulary are equal weigh as much as all of them: the model is that of all rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, IDF

    kinds = [("flood", "water rose in town"), ("flood", "water rose in the hills"), ("fire", "flames burned the hills"), ("fire", "smoke in town")]
    rows = [(i, *kinds[i % 7 % 4], i) for i in range(200)]
    df = spark.createDataFrame([(i, label, f"Report {1000 + k} {text}") for i, label, text, k in rows], "idx long, label string, text string")
    model = models.train_text(df, iterations=100)
    assert model.stages[-1].summary.predictions.count() == len(kinds)
    weighted = df.join(models.class_weights(df, "label").select("label", "weight"), "label")
    plain = [*model.stages[:3], CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=100_000, minDF=2.0), models.LogCounts("counts", "damped"), IDF(inputCol="damped", outputCol="weighted"),
             *model.stages[6:8], LogisticRegression(labelCol="target", weightCol="weight", regParam=1 / (5.0 * 200), maxIter=100)]
    whole = Pipeline(stages=plain).fit(weighted)
    assert sorted(model.stages[3].vocabulary) == sorted(whole.stages[3].vocabulary) and model.stages[5].numDocs == whole.stages[5].numDocs == 200
    got, want = ({r.idx: (r.pred, r.confidence) for r in models.label_predictions(m, df).collect()} for m in (model, whole))
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-3) for i in want)
