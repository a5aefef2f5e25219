"""Forests by hazard type and the text classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazmill.durable import settled
from hazmill.ml.severity import DEPTH, FEATURES, TREES, SeverityModels, fit_forest, with_features
from hazmill.operators.tables import class_weights


class LogCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Sparse counts c as 1 + ln c: a batch's values are one array."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        if inputCol:
            self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        source, schema = self.getInputCol(), T.StructType([*df.schema.fields, T.StructField(self.getOutputCol(), VectorUDT())])

        def damped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column(source)
                kind, size, indices, values = (v.field(c) for c in ("type", "size", "indices", "values"))
                logs = pa.ListArray.from_arrays(values.offsets, pa.array(1 + np.log(values.values.to_numpy(zero_copy_only=False))))
                out = pa.StructArray.from_arrays([kind, size, indices, logs], fields=[v.type.field(c).with_type(a.type) for c, a in zip(("type", "size", "indices", "values"), (kind, size, indices, logs))])
                yield pa.RecordBatch.from_arrays([*batch.columns, out], schema.fieldNames())

        return df.mapInArrow(damped, schema)


def severity_by_type(df: DataFrame, kind: str = "eventtype", trees: int = TREES, seed: int = 42) -> DataFrame:
    """With prob and predicted_alert: a forest for each type over its own rows and features; floods by rule, without a prob.

    df: positive (0 or 1; null for rows not to learn from) and a column for each feature, dead and displaced; those that it lacks are
    null. A type without rows of both classes has no forest: its rows have neither prob nor alert, as have rows of unknown type.
    """
    full = df.select("*", *[F.lit(None).cast("double").alias(c) for c in ("dead", "displaced") if c not in df.columns])
    models = {}
    for name in FEATURES:
        rows = with_features(full.filter((F.col(kind) == name) & F.col("positive").isNotNull()), name)
        if rows.select("positive").distinct().count() > 1:
            models[name] = fit_forest(rows, FEATURES[name], DEPTH[name], trees, seed)
    return SeverityModels(given=models).predict(full, kind).select(*df.columns, "prob", "predicted_alert")


#: So many rows of a text are numbered at once.
TIMES = 1 << 16


def train_text(df: DataFrame, text: str = "text", label: str = "label", c: float = 5.0, vocabulary: int = 100_000, least: float = 2.0, iterations: int = 1000) -> PipelineModel:
    """TF-IDF of one- and two-word terms (logarithmic frequency, unit length) and a balanced multinomial logistic regression.

    Rows of one label whose counts of the vocabulary's terms are equal have equal features: they are settled as one row with their number.
    The document frequencies count it that often, and in the regression it weighs as much as all of them, so that the loss is that of all rows,
    while texts are cut into terms twice and the iterations go through different rows only.
    """
    weights = settled(class_weights(df, label))
    n = weights.agg(F.sum("n")).first()[0] or 0
    cut = [
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"(?U)\b\w\w+\b", gaps=False),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
    ]
    terms = PipelineModel(cut).transform(df.select(text, label))
    counter = CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=vocabulary, minDF=least).fit(terms)
    counted = counter.transform(terms).groupBy(label, "counts").agg(F.count("*").alias("times"))
    distinct = settled(counted.join(F.broadcast(weights.select(label, "weight")), label).withColumn("weight", F.col("weight") * F.col("times")))
    # Counts and their damped values are positive in the same places, which is all that document frequencies depend on.
    repeated = distinct.select(F.col("counts").alias("damped"), "times", F.explode(F.expr(f"sequence(0, (times - 1) div {TIMES})")).alias("block"))
    repeated = repeated.select("damped", F.explode(F.expr(f"sequence(block * {TIMES}, least(times, (block + 1) * {TIMES}) - 1)")))
    damp, idf = LogCounts(inputCol="counts", outputCol="damped"), IDF(inputCol="damped", outputCol="weighted").fit(repeated.select("damped"))
    unit = Normalizer(inputCol="weighted", outputCol="features")
    index = StringIndexer(inputCol=label, outputCol="target", handleInvalid="keep").fit(df.select(label))
    learn = PipelineModel([damp, idf, unit, index]).transform(distinct)
    fit = LogisticRegression(labelCol="target", weightCol="weight", regParam=1 / (c * max(1, n)), maxIter=iterations).fit(learn)
    return PipelineModel([*cut, counter, damp, idf, unit, index, fit])


def label_predictions(model: PipelineModel, df: DataFrame, out: str = "pred", confidence: str = "confidence") -> DataFrame:
    """The table with the most probable label and its probability."""
    labels = next(s for s in model.stages if isinstance(s, StringIndexerModel)).labels
    names = F.array(*map(F.lit, labels))
    got = model.transform(df).withColumn("__p", vector_to_array("probability"))
    best = F.array_position(F.slice("__p", 1, len(labels)), F.array_max(F.slice("__p", 1, len(labels)))).cast("int")
    return got.select(*df.columns, F.element_at(names, best).alias(out), F.array_max("__p").alias(confidence))
