"""Exact medians of groups of any size: selection by repeated histograms, so that no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazmill.durable import settled

#: Values of a group that one task may hold, and bins of a round.
FEW, BINS = 100_000, 1024


def _same(keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return on


def exact_medians(df: DataFrame, keys: list[str], value: str, name: str, few: int = FEW, bins: int = BINS) -> DataFrame:
    """keys and the exact median of each group's values (null without any); null keys are groups, and no keys are one.

    Groups of few values are sorted by their tasks. For larger ones, each round counts the values between a group's bounds in bins (partial
    aggregates of at most so many bins), finds the bins that hold the two middle ranks and takes the least and greatest value there as new
    bounds, until few values are left or all are equal. The ends of a range fall into different bins, so that each round removes a value at least,
    and all but the last bits of an even spread go in two or three rounds.
    """
    values = df.select(*keys, F.col(value).cast("double").alias("v"))
    sizes = values.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = settled(sizes.select(*keys, "n", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("left")))  # a row for each group
    held = values.filter("v is not null")
    while state.filter((F.col("left") > few) & (F.col("lo") < F.col("hi"))).limit(1).count():
        state = settled(_narrowed(held, state, keys, few, bins))
    low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")
    within = held.alias("l").join(state.alias("r"), _same(keys) & F.col("v").between(F.col("lo"), F.col("hi")) & (F.col("lo") < F.col("hi"))).select(*[F.col(f"l.{k}") for k in keys], "v")
    lists = within.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("vs"))  # few values
    at = lambda rank: F.get("vs", (rank - F.col("before")).cast("int"))
    both = state.alias("l").join(lists.alias("r"), _same(keys), "left").select(*[F.col(f"l.{k}") for k in keys], "n", "lo", "hi", "before", "vs")
    middle = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((at(low) + at(high)) / 2)
    return both.select(*keys, F.when(F.col("n") > 0, middle).alias(name))


def _narrowed(held: DataFrame, state: DataFrame, keys: list[str], few: int, bins: int) -> DataFrame:
    """The state after one round: bounds of the values among which the middle ranks are, with the number of values before them and between them."""
    wide = (F.col("left") > few) & (F.col("lo") < F.col("hi"))
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    # a range too wide or too narrow for the quotient still has its ends apart
    bin_of = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), bins - 1).otherwise(F.least(F.lit(bins - 2), F.greatest(F.lit(1), F.floor(F.coalesce(F.nanvl(share, F.lit(0.5)), F.lit(0.5)) * bins))))
    binned = held.alias("l").join(state.filter(wide).alias("r"), _same(keys) & F.col("v").between(F.col("lo"), F.col("hi"))).select(*[F.col(f"l.{k}") for k in keys], "v", bin_of.cast("int").alias("bin"))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
    upto = F.sum("c").over(W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))  # bins of a group
    counts = counts.withColumn("upto", upto)
    near = counts.alias("l").join(state.alias("r"), _same(keys)).filter(F.expr("before + upto > (n - 1) div 2 and before + upto - c <= n div 2"))
    new = near.groupBy(*[F.col(f"l.{k}").alias(k) for k in keys]).agg(F.min("a").alias("lo2"), F.max("b").alias("hi2"), F.min(F.expr("before + upto - c")).alias("before2"), F.sum("c").alias("left2"))
    out = state.alias("l").join(new.alias("r"), _same(keys), "left")
    return out.select(*[F.col(f"l.{k}") for k in keys], "n", *[F.coalesce(f"{c}2", F.col(f"l.{c}")).alias(c) for c in ("lo", "hi", "before", "left")])
