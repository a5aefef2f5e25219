"""Labels from any model that scores batches: one load a worker, batches over Arrow, softmax and choice as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def batched_labels(df: DataFrame, make_predict: Callable, inputs: list[str], labels: list[str], batch: int = 128) -> DataFrame:
    """With pred_label (the first of the highest), confidence and prob_LABEL for each label.

    make_predict: called once a worker, gives a function from arrays of the inputs to an array of scores, rows x labels.
    """
    score = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    out = df.withColumn("__scores", score(*inputs))
    top = F.array_max("__scores")
    powers = F.transform("__scores", lambda s: F.exp(s.cast("double") - top.cast("double")))
    out = out.withColumn("__powers", powers)
    total = F.aggregate("__powers", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("__p", F.transform("__powers", lambda x: x / total))
    best = F.array_position("__scores", top).cast("int")
    names = F.array(*map(F.lit, labels))
    return out.select(*df.columns, F.element_at(names, best).alias("pred_label"), F.array_max("__p").alias("confidence"), *[F.get("__p", F.lit(k)).alias(f"prob_{n}") for k, n in enumerate(labels)])
