"""Splits, sampling, de-duplication and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazmill.durable import settled
from hazmill.operators.medians import exact_medians


def time_split(df: DataFrame, at: Column, first: str, second: str) -> DataFrame:
    """With split: train up to the first boundary (midnight), val up to the second, test after it; null times are in none."""
    a, b = F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(second))
    return df.withColumn("split", F.when(at <= a, "train").when(at <= b, "val").when(at > b, "test"))


def leaked_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one split holds."""
    return df.filter("split is not null").groupBy(*keys).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def viable(df: DataFrame, label: str, classes: list[str], least: int = 20) -> DataFrame:
    """Whether each split has enough of every class."""
    counts = [F.count_if(F.col(label) == c) for c in classes]
    return df.groupBy("split").agg((F.least(*counts) >= least if len(counts) > 1 else counts[0] >= least).alias("viable"))


def hash_of(key: Column, seed: int) -> Column:
    """32 hexadecimal digits, the same in any engine that has MD5: an order to draw rows by."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def with_hashed_rank(df: DataFrame, by: Column, key: str, seed: int, rank: str = "rn", size: str | None = None) -> DataFrame:
    """With each row's rank (from 1) among the rows of its class by the key's hash, and the class's size if a name for it is given.

    A class is cut into 256 parts by the hash's first digits: parts are ranked in tasks of their own, and only the parts' counts are
    added up, so that no task sorts a whole class.
    """
    part, order = F.substring("__hash", 1, 2), W.partitionBy("__by", "__part").orderBy("__hash", F.col(key))
    cut = df.withColumn("__by", by).withColumn("__hash", hash_of(F.col(key), seed)).withColumn("__part", part)
    counts = cut.groupBy("__by", "__part").agg(F.count("*").alias("__c"))
    w = W.partitionBy("__by").orderBy("__part")
    counts = counts.select(F.col("__by").alias("__b"), F.col("__part").alias("__p"), F.coalesce(F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__c").over(W.partitionBy("__by")).alias("__n"))
    both = cut.withColumn("__own", F.row_number().over(order)).join(counts, F.col("__by").eqNullSafe(F.col("__b")) & (F.col("__part") == F.col("__p")))
    out = [*df.columns, F.expr("__own + __before").alias(rank)]
    return both.select(*out, *([F.col("__n").alias(size)] if size else []))


def random_split(df: DataFrame, label: str, key: str, seed: int = 42, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """With split: of each class the given shares of its rows, rounded up, are test and val, in order of a hash of the key; the rest is train."""
    ranked = with_hashed_rank(df, F.col(label), key, seed, "__rank", "__size")
    first = F.ceil(F.col("__size") * F.lit(test).cast("decimal(9,6)"))
    second = first + F.ceil(F.col("__size") * F.lit(val).cast("decimal(9,6)"))
    return ranked.withColumn("split", F.when(F.col("__rank") <= first, "test").when(F.col("__rank") <= second, "val").otherwise("train")).drop("__rank", "__size")


def capped(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each group; groups are cut as they are sorted (WindowGroupLimit before the shuffle)."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rn") <= most)


def top_up(test: DataFrame, train: DataFrame, label: str, key: str, least: int = 30, seed: int = 42) -> DataFrame:
    """The test rows and, for each class short of so many, rows of train (flagged _augmented), drawn by hash."""
    have = test.groupBy(label).agg(F.count("*").alias("__have"))
    ranked = with_hashed_rank(train, F.col(label), key, seed, "__rank").join(have, label, "left")
    more = ranked.filter(F.col("__rank") <= least - F.coalesce("__have", F.lit(0))).select(*train.columns)
    return test.withColumn("_augmented", F.lit(False)).unionByName(more.withColumn("_augmented", F.lit(True)), allowMissingColumns=True)


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """With fold, 0 to k-1: each class is dealt out evenly, in order of a hash."""
    return with_hashed_rank(df, F.col(label), key, seed, "__rank").withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank")


def sampled(df: DataFrame, by: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most so many rows of each class, drawn by hash, with shuffled (the place in a random order over all classes)."""
    drawn = with_hashed_rank(df, F.col(by), key, seed, "__rank").filter(F.col("__rank") <= most).drop("__rank")
    return with_hashed_rank(drawn, F.lit(0), key, seed + 1, "shuffled")


def keep_first(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The first row of each key (no empty keys): one partial aggregate."""
    rest = [c for c in df.columns if c not in (key, pos)]
    got = df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.min(F.struct(pos, *rest)).alias("r"))
    return got.select(key, "r.*")


def pending(df: DataFrame, done: DataFrame, key: str = "idx", label: str = "label") -> DataFrame:
    """Rows without a label yet; an error isn't one."""
    ok = done.filter(F.col(label).isNotNull() & ~F.lower(F.col(label)).isin("error", "api_error")).select(key)
    return df.join(ok, key, "left_anti")


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """label, precision, recall, f1, support: 0 where there is nothing to divide by. Made of the counts of pairs, once shuffled."""
    pairs = confusion(df, label, pred)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), "n", (F.col("label") == F.col("pred")).alias("hit"))
    g = sides.groupBy(F.col("s.c").alias("label")).agg(F.sum(F.col("n") * F.col("s.t")).alias("support"), F.sum(F.col("n") * F.col("s.p")).alias("predicted"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("s.t")).otherwise(0)).alias("tp"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = div(F.col("tp"), F.col("predicted")), div(F.col("tp"), F.col("support"))
    return g.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(div(2 * p * r, p + r), 6).alias("f1"), "support")


def ranking_metrics(df: DataFrame, score: str, truth: str, few: int = 100_000) -> DataFrame:
    """n_pos, n_neg, roc_auc (ties count half), pr_auc (average precision), over distinct scores: null unless both classes occur.

    Distinct scores are counted up in their order: by one window if there are few, else in ranges of scores that are summed up in tasks of their own, so that
    one task adds up the ranges only.
    """
    steps = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("tp"), F.sum(1 - F.col(truth).cast("long")).alias("fp"))
    if df.select(F.approx_count_distinct(score, 0.02)).first()[0] > few:
        ranged = settled(steps.repartitionByRange(F.desc("s")).withColumn("part", F.spark_partition_id()))
        before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        sums = ranged.groupBy("part").agg(F.sum("tp").alias("tps"), F.sum("fp").alias("fps"))
        sums = sums.select("part", F.coalesce(F.sum("tps").over(before), F.lit(0)).alias("tp0"), F.coalesce(F.sum("fps").over(before), F.lit(0)).alias("fp0"))
        w = W.partitionBy("part").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
        cum = ranged.withColumns({"ctp": F.sum("tp").over(w), "cfp": F.sum("fp").over(w)}).join(sums, "part").select("tp", "fp", F.expr("ctp + tp0").alias("ctp"), F.expr("cfp + fp0").alias("cfp"))
    else:
        w = W.orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
        cum = steps.withColumns({"ctp": F.sum("tp").over(w), "cfp": F.sum("fp").over(w)})
    g = cum.agg(F.sum("tp").alias("n_pos"), F.sum("fp").alias("n_neg"), F.sum(F.col("fp") * (F.col("ctp") - F.col("tp") / 2)).alias("area"), F.sum(F.col("tp") * F.col("ctp") / (F.col("ctp") + F.col("cfp"))).alias("ap"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return g.select("n_pos", "n_neg", F.round(F.when(both, F.col("area") / (F.col("n_pos") * F.col("n_neg"))), 6).alias("roc_auc"), F.round(F.when(both, F.col("ap") / F.col("n_pos")), 6).alias("pr_auc"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.join(F.broadcast(total)).select(label, "n", F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("weight"))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    rates = [F.struct(F.lit(c).alias("column"), F.round(F.avg(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1.0).otherwise(0.0)), 6).alias("null_rate")) for c in columns]
    return df.agg(F.array(*rates).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def threshold_accuracy(df: DataFrame, field: str, truth: str, got: str) -> DataFrame:
    """Per field coverage and the shares of rows with both values whose relative error is at most 5, 20 and 50 %, and the exact median error."""
    e = F.when(F.col(truth) > 0, F.abs(F.col(got) - F.col(truth)) / F.col(truth))
    both = F.col(truth).isNotNull() & F.col(got).isNotNull()
    hits = [F.round(F.try_divide(F.count_if(both & (e <= x / 100)), F.count_if(both)), 6).alias(f"within_{x}") for x in (5, 20, 50)]
    rates = df.groupBy(field).agg(F.count_if(F.col(truth).isNotNull()).alias("n"), F.round(F.try_divide(F.count_if(both), F.count_if(F.col(truth).isNotNull())), 6).alias("coverage"), *hits)
    middle = exact_medians(df.select(F.col(field).alias("__f"), F.when(both, e).alias("__e")), ["__f"], "__e", "median_error")
    return rates.join(middle, F.col(field).eqNullSafe(F.col("__f"))).select(*rates.columns, F.round("median_error", 6).alias("median_error"))
