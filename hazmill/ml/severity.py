"""Severity classifiers: features, splits, training, evaluation, storage and prediction by hazard type.

One forest for each of EQ, TC, WF and DR; floods go by rule. A model folder holds, for each type, the fitted pipeline and a row of metadata
(the medians that stand for nulls, the features, how many rows it was fitted on). Forests are Spark's: trees aren't those of another library.

Defined results: rows with another alert level than green, orange or red are no training rows; a type with too few rows of a class has no
model; rows of a type without a model get neither probability nor alert; nulls become the training rows' exact medians (0 if
a feature has no value at all).
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmill.durable import settled
from hazmill.functions.exprs import flood_severity, rapid_population
from hazmill.operators.tables import class_weights, classification_report, folds, random_split, ranking_metrics, top_up

# Each type's features, its forest, the boundaries of the time split and how many rows of a class are enough.
FEATURES = {
    "EQ": ["magnitude", "depth", "rapid_pop_people", "rapid_pop_log", "rapid_missing", "rapid_few_people", "rapid_unparsed"],
    "TC": ["maximum_wind_speed_kmh", "maximum_storm_surge_m", "exposed_population"],
    "WF": ["duration_days", "burned_area_ha", "people_affected"],
    "DR": ["duration_days", "affected_area_km2", "affected_country_count"],
}
DEPTH = {"EQ": 10, "TC": 10, "WF": 8, "DR": 8}
TREES, LEAF = 300, 2
VAL_FROM, TEST_FROM = "2025-04-30", "2025-07-31"
TRAIN_LEAST, TEST_LEAST = 20, 30
GREEN, POSITIVE = "green", "orange_or_red"


def with_target(df: DataFrame, alert: str = "alertlevel") -> DataFrame:
    """Rows whose alert level is known, with positive (0 or 1)."""
    level = F.lower(F.trim(alert))
    return df.filter(level.isin("green", "orange", "red")).withColumn("positive", F.when(level == "green", 0).otherwise(1))


def with_features(df: DataFrame, kind: str) -> DataFrame:
    """With the type's features as numbers: what isn't one, or lacks, is null; a quake's population description is spread out."""
    parts = {"rapid_pop_people": "people", "rapid_pop_log": "log", "rapid_missing": "missing", "rapid_few_people": "few", "rapid_unparsed": "unparsed"}
    if kind == "EQ":
        text = F.col("rapidpopdescription").cast("string") if "rapidpopdescription" in df.columns else F.lit(None).cast("string")
        spread = rapid_population(text)
        df = df.withColumns({name: spread[part] for name, part in parts.items()})
    number = {c: F.when(~F.isnan(n), n) for c in FEATURES[kind] for n in [F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")]}
    return df.withColumns(number)


def time_split(df: DataFrame, column: str = "fromdate", val_from: str = VAL_FROM, test_from: str = TEST_FROM) -> DataFrame:
    """With split: train before the first boundary, val before the second, then test; rows without a time are in none."""
    at = F.try_to_timestamp(F.substring(F.col(column).cast("string"), 1, 10), F.lit("yyyy-MM-dd"))
    return df.withColumn("split", F.when(at < val_from, "train").when(at < test_from, "val").when(at >= test_from, "test"))


def fit_forest(df: DataFrame, features: list[str], depth: int, trees: int = TREES, seed: int = 42) -> tuple[PipelineModel, dict[str, float]]:
    """A balanced forest over rows with positive, and the medians that stand for nulls. Features that don't vary are left out: a tree that draws one can't split."""
    got = df.agg(*[F.median(c).alias(c) for c in features], *[F.count_distinct(F.coalesce(c, F.lit(0.0))).alias(f"n_{c}") for c in features]).first().asDict()
    medians = {c: 0.0 if got[c] is None else float(got[c]) for c in features}
    features = [c for c in features if got[f"n_{c}"] > 1] or features
    weighted = df.fillna(medians).join(class_weights(df, "positive").select("positive", "weight"), "positive")
    forest = RandomForestClassifier(labelCol="positive", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=LEAF, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__vector"), forest.setFeaturesCol("__vector")]).fit(weighted), medians


def scored(df: DataFrame, model: PipelineModel, medians: dict[str, float]) -> DataFrame:
    """With prob, that of the positive class, and predicted_alert."""
    kept = df.select(F.struct(*df.columns).alias("__row"), *medians)
    prob = vector_to_array("probability")[1]
    got = model.transform(kept.fillna(medians)).select("__row.*", prob.alias("prob"))
    return got.withColumn("predicted_alert", F.when(F.col("prob") > 0.5, POSITIVE).otherwise(GREEN))


def evaluate(df: DataFrame) -> dict[str, float | None]:
    """n, accuracy, macro F1, ROC and PR AUC and the positive class's F1 of scored rows."""
    named = df.select(F.when(F.col("positive") == 1, POSITIVE).otherwise(GREEN).alias("label"), F.col("predicted_alert").alias("pred"), "prob", "positive")
    report = {r.label: r for r in classification_report(named).collect()}
    total, right = named.agg(F.count("*"), F.count_if(F.col("label") == F.col("pred"))).first()
    ranks = ranking_metrics(named, "prob", "positive").first()
    f1 = [r.f1 for r in report.values()]
    return {"n": total, "accuracy": right / total if total else None, "macro_f1": sum(f1) / len(f1) if f1 else None, "roc_auc": ranks.roc_auc, "pr_auc": ranks.pr_auc, "positive_f1": report[POSITIVE].f1 if POSITIVE in report else 0.0}


def _enough(df: DataFrame, least: int) -> bool:
    n = df.agg(F.count_if(F.col("positive") == 0), F.count_if(F.col("positive") == 1)).first()
    return min(n) >= least


def train_type(catalogue: DataFrame, kind: str, folder: str, key: str = "eventid", trees: int = TREES, seed: int = 42) -> dict | None:
    """Split, check, top up, fit, evaluate, cross-validate, fit again on train and val, store. The metrics, or null without enough rows."""
    rows = settled(with_features(with_target(catalogue.filter(F.upper(F.trim("eventtype")) == kind)), kind))  # all steps below start from it
    if not _enough(rows, max(2, TRAIN_LEAST // 2)):
        return None
    features, method = FEATURES[kind], "time"
    split = time_split(rows)
    if not _enough(split.filter("split = 'train'"), TRAIN_LEAST):
        split, method = random_split(rows, "positive", key, seed), "random"
    leaked = split.filter("split is not null").groupBy(key).agg(F.count_distinct("split").alias("n")).filter("n > 1").count()
    if method == "time" and leaked:
        raise ValueError(f"{leaked} ids are in more than one split")
    train, val, test = (split.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test"))
    model, medians = fit_forest(train, features, DEPTH[kind], trees, seed)
    out: dict = {"type": kind, "split": method}
    if _enough(val, 1):
        out["val"] = evaluate(scored(val, model, medians))
    topped = top_up(test, train, "positive", key, TEST_LEAST, seed)
    out["test"] = evaluate(scored(topped, model, medians))
    if _enough(test, 1):
        out["test_native"] = evaluate(scored(test, model, medians))
    k = max(2, min(5, *train.agg(F.count_if(F.col("positive") == 0), F.count_if(F.col("positive") == 1)).first()))
    dealt, f1 = folds(train, "positive", key, k, seed), []
    for fold in range(k):
        own, own_medians = fit_forest(dealt.filter(F.col("fold") != fold), features, DEPTH[kind], trees, seed)
        f1.append(evaluate(scored(dealt.filter(F.col("fold") == fold), own, own_medians))["macro_f1"])
    out["cv_f1"] = sum(f1) / k
    out["cv_f1_std"] = (sum((x - out["cv_f1"]) ** 2 for x in f1) / k) ** 0.5
    both = train.unionByName(val)
    final, medians = fit_forest(both, features, DEPTH[kind], trees, seed)
    save(catalogue.sparkSession, folder, kind, final, medians, both.count())
    return out


def save(spark: SparkSession, folder: str, kind: str, model: PipelineModel, medians: dict[str, float], rows: int) -> None:
    model.write().overwrite().save(f"{folder}/{kind}/model")
    meta = {"type": kind, "features": FEATURES[kind], "labels": [GREEN, POSITIVE], "medians": medians, "rows": rows}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{kind}/meta")


class SeverityModels:
    """The models of a folder, each loaded when its type is first asked for; or models given as type to (pipeline, medians)."""

    def __init__(self, folder: str | None = None, given: dict[str, tuple[PipelineModel, dict[str, float]]] | None = None):
        self.folder, self.loaded = folder, dict(given or {})

    def get(self, spark: SparkSession, kind: str) -> tuple[PipelineModel, dict[str, float]] | None:
        if kind not in self.loaded and self.folder:
            path = f"{self.folder}/{kind}"
            try:
                meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                return None
            self.loaded[kind] = (PipelineModel.load(f"{path}/model"), meta["medians"])
        return self.loaded.get(kind)

    def predict(self, events: DataFrame, kind: str = "type") -> DataFrame:
        """With prob and predicted_alert, by type; floods by rule and without a probability, other types without a model with neither."""
        nothing = {"prob": F.lit(None).cast("double"), "predicted_alert": F.when(F.col(kind) == "FL", flood_severity(F.col("dead"), F.col("displaced")))}
        names = [k for k in FEATURES if self.get(events.sparkSession, k)]
        out = events.filter(F.col(kind).isNull() | ~F.col(kind).isin(*names) if names else F.lit(True)).withColumns(nothing)
        for k in names:
            model, medians = self.get(events.sparkSession, k)
            own = events.filter(F.col(kind) == k).withColumn("__own", F.struct(*events.columns))  # the events' own columns stay as they were
            out = out.unionByName(scored(with_features(own, k), model, medians).select("__own.*", "prob", "predicted_alert"))
        return out
