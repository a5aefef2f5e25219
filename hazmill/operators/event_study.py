"""Event study: returns, market model, cumulative abnormal returns and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazmill.durable import settled
from hazmill.functions.exprs import t_pvalue

ESTIMATION, EVENT, LEAST_ESTIMATION, HORIZONS = (-45, -6), (0, 5), 10, (1, 3, 5)
DRAWS = 1 << 16


def log_returns(prices: DataFrame) -> DataFrame:
    """ticker, date, ret, without each ticker's first row."""
    w = W.partitionBy("ticker").orderBy("date")
    return prices.select("ticker", "date", F.log(F.col("close") / F.lag("close").over(w)).alias("ret")).filter("ret is not null")


def aligned_returns(prices: DataFrame, market: DataFrame) -> DataFrame:
    """ticker, date, y, x (market), pos: days that both have, numbered by ticker."""
    x = log_returns(market).select("date", F.col("ret").alias("x"))
    both = log_returns(prices).join(x, "date").select("ticker", "date", F.col("ret").alias("y"), "x")
    return both.withColumn("pos", F.row_number().over(W.partitionBy("ticker").orderBy("date")) - 1)


def market_model(returns: DataFrame) -> DataFrame:
    """For each ticker and trading day as an event's day: date, pos, n_est, alpha, beta, car_t1, car_t3, car_t5.

    The estimation days' moments are differences of two prefix sums over a ticker's days (of returns less the ticker's mean, so that
    no digits cancel); one window goes through a ticker's days once, whatever the number of events. beta is null where the market didn't
    move in the estimation days, told by the number of changes.
    """
    days = W.partitionBy("ticker").orderBy("date")
    whole, upto = W.partitionBy("ticker"), days.rowsBetween(W.unboundedPreceding, 0)
    centred = returns.withColumns({"my": F.avg("y").over(whole), "mx": F.avg("x").over(whole), "moved": (F.col("x") != F.lag("x").over(days)).cast("int")})
    y, x = F.col("y") - F.col("my"), F.col("x") - F.col("mx")
    sums = {"s_y": y, "s_x": x, "s_xy": x * y, "s_xx": x * x, "s_moved": F.coalesce("moved", F.lit(0))}
    prefixed = centred.withColumns({name: F.sum(c).over(upto) for name, c in sums.items()})
    first, last = -ESTIMATION[0], -ESTIMATION[1]
    between = {name.replace("s_", "e_"): F.lag(name, last).over(days) - F.coalesce(F.lag(name, first + 1).over(days), F.lit(0)) for name in ("s_y", "s_x", "s_xy", "s_xx")}
    between["e_moved"] = F.lag("s_moved", last).over(days) - F.coalesce(F.lag("s_moved", first).over(days), F.lit(0))
    after = {f"{c}{k}": F.lead(c, k).over(days) for k in range(1, EVENT[1] + 1) for c in ("y", "x")}
    got = prefixed.withColumns(between | after)
    n = F.greatest(F.lit(0), F.col("pos") - last - F.greatest(F.col("pos") - first, F.lit(0)) + 1)
    spread = F.col("e_xx") - F.try_divide(F.col("e_x") * F.col("e_x"), n)
    beta = F.when((F.col("e_moved") > 0) & (spread > 0), (F.col("e_xy") - F.try_divide(F.col("e_x") * F.col("e_y"), n)) / spread)
    got = got.withColumns({"n_est": n.cast("long"), "beta": beta})
    mean = lambda c, m: F.try_divide(F.col(c), F.col("n_est")) + F.col(m)
    got = got.withColumn("alpha", mean("e_y", "my") - F.col("beta") * mean("e_x", "mx"))
    cars = [sum(F.col(f"y{j}") - (F.col("alpha") + F.col("beta") * F.col(f"x{j}")) for j in range(1, k + 1)).alias(f"car_t{k}") for k in HORIZONS]
    return got.select("ticker", "date", "pos", "n_est", "alpha", "beta", *cars)


def event_days(events: DataFrame, days: DataFrame) -> DataFrame:
    """The events with known (whether the ticker has any day) and, of the first trading day on or after the event date, t0, t0_pos and days' other columns.

    One window over both sides, latest first, so that a running last value is enough: no range join, and a ticker's days are gone through once.
    """
    more = [c for c in days.columns if c not in ("ticker", "date", "pos")]
    day = F.struct(F.col("date").alias("t0"), F.col("pos").alias("t0_pos"), *more)
    asked = events.select("ticker", F.col("event_date").alias("d")).distinct()
    both = days.select("ticker", F.col("date").alias("d"), day.alias("day")).unionByName(asked, allowMissingColumns=True)
    w = W.partitionBy("ticker").orderBy(F.desc("d"), F.col("day").isNull()).rowsBetween(W.unboundedPreceding, 0)
    found = both.select("ticker", "d", "day", F.last("day", ignorenulls=True).over(w).alias("t"), (F.count("day").over(W.partitionBy("ticker")) > 0).alias("known"))
    found = found.filter("day is null").select("ticker", F.col("d").alias("event_date"), "known", "t.*")
    return events.join(found, ["ticker", "event_date"], "left")


def abnormal_returns(events: DataFrame, prices: DataFrame, market: DataFrame) -> DataFrame:
    """One row for each event and ticker: t0, n_est, alpha, beta, car_t1, car_t3, car_t5 and error."""
    return study(events, market_model(aligned_returns(prices, market)))


def study(events: DataFrame, model: DataFrame) -> DataFrame:
    """abnormal_returns by a market model; settle it if several studies use it."""
    out = event_days(events, model)
    error = (
        F.when(F.col("ticker").isNull() | F.col("event_date").isNull(), "missing_ticker_or_date")
        .when(~F.coalesce("known", F.lit(False)), "no_price_data")
        .when(F.col("t0_pos").isNull(), "event_date_after_data")
        .when(F.coalesce("n_est", F.lit(0)) < LEAST_ESTIMATION, "insufficient_estimation_data")
        .when(F.col("beta").isNull(), "ols_failed")
    )
    out = out.withColumn("error", error)
    good = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("alpha", "beta", *(f"car_t{k}" for k in HORIZONS))]
    return out.select(*events.columns, "t0", F.coalesce("n_est", F.lit(0)).alias("n_est"), *good, "error")


def explode_tickers(events: DataFrame, align: str = "fixed") -> DataFrame:
    """A row for each of an event's ETFs with its sector; an event without ETFs keeps one row.

    align "fixed" pairs etfs with etf_sectors; "compat" pairs them by place with key_industries.
    """
    names = F.col("etf_sectors" if align == "fixed" else "key_industries")
    out = events.select("*", F.posexplode_outer("sector_etfs").alias("at", "ticker"))
    return out.withColumn("sector", F.coalesce(F.get(names, F.col("at")), F.col("ticker"))).drop("at")


def _ttest(mean, sd, n):
    t = mean / (sd / F.sqrt(n))
    return F.when((n >= 3) & (sd > 0), t_pvalue(t, n - 1))


def group_statistics(cars: DataFrame, keys: tuple[str, ...] = ("event_type", "severity", "sector")) -> DataFrame:
    """keys, window, n, mean_car, p_value, significant_5pct: one-sample t tests of each group and horizon; null keys are groups."""
    long = cars.select(*keys, F.explode(F.array(*[F.struct(F.lit(f"car_t{k}").alias("window"), F.col(f"car_t{k}").alias("car")) for k in HORIZONS])).alias("w")).select(*keys, "w.*")
    g = long.groupBy(*keys, "window").agg(F.count("car").alias("n"), F.avg("car").alias("m"), F.stddev_samp("car").alias("s"))
    p = F.round(_ttest(F.col("m"), F.col("s"), F.col("n")), 4)
    return g.select(*keys, "window", "n", F.round("m", 5).alias("mean_car"), p.alias("p_value"), F.coalesce(p < 0.05, F.lit(False)).alias("significant_5pct"))


def compare_baseline(events: DataFrame, random: DataFrame) -> DataFrame:
    """Per horizon mean, population deviation, n and the t tests of events against zero, random dates against zero and both against each other."""

    def long(df, kind):
        return df.select(F.lit(kind).alias("kind"), F.explode(F.array(*[F.struct(F.lit(f"car_t{k}").alias("window"), F.col(f"car_t{k}").alias("car")) for k in HORIZONS])).alias("w")).select("kind", "w.*")

    both = long(events, "event").unionByName(long(random, "random")).filter("car is not null")
    aggs = []
    for kind in ("event", "random"):
        c = F.when(F.col("kind") == kind, F.col("car"))
        aggs += [F.avg(c).alias(f"{kind}_m"), F.stddev_pop(c).alias(f"{kind}_p"), F.count(c).alias(f"{kind}_n"), F.stddev_samp(c).alias(f"{kind}_s")]
    # no result has the name of an input: inside lambdas Spark would take the result of that name
    g = both.groupBy("window").agg(*aggs).filter("event_n >= 3 and random_n >= 3")
    n, m = F.col("event_n"), F.col("random_n")
    pooled = ((n - 1) * F.col("event_s") ** 2 + (m - 1) * F.col("random_s") ** 2) / (n + m - 2)
    t = (F.col("event_m") - F.col("random_m")) / F.sqrt(pooled * (1 / n + 1 / m))
    return g.select(
        "window", *[F.round(f"{k}_{v}", 6).alias(f"{k}_{name}") for k in ("event", "random") for v, name in (("m", "mean"), ("p", "std"))], "event_n", "random_n",
        F.round(_ttest(F.col("event_m"), F.col("event_s"), n), 4).alias("p_event_vs_zero"),
        F.round(_ttest(F.col("random_m"), F.col("random_s"), m), 4).alias("p_random_vs_zero"),
        F.round(F.when(pooled > 0, t_pvalue(t, n + m - 2)), 4).alias("p_event_vs_random"),
    )


def free_dates(events: DataFrame, days: int = 10) -> DataFrame:
    """All dates from the first to the last event that are more than so many days from any event."""
    span = events.agg(F.min("event_date").alias("a"), F.max("event_date").alias("b")).filter("a is not null")
    pool = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    taken = events.filter("event_date is not null").select(F.explode(F.sequence(F.date_sub("event_date", days), F.date_add("event_date", days))).alias("date")).distinct()
    return pool.join(taken, "date", "left_anti")


def drawn_number(key: Column, seed: int) -> Column:
    """A reproducible number of 60 bits, from MD5, so that any engine can draw it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def random_events(events: DataFrame, cars: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """n events (as many as there are rows without error) at free dates, with tickers drawn with replacement from the rows without error: reproducible hash draws.

    cars: ticker and error of every event; the dates of events with an error aren't free either. A ticker owns as many
    successive numbers as it has rows; a drawn number finds its owner among the few of its span. There are as many spans as tickers, all
    equally likely, so that a draw meets two owners on average, and the owners are two rows a ticker whatever the number of rows. Draws
    are numbered in blocks, so that no task makes all of them; Spark takes them for as few as the blocks, so the calendar's days and the
    owners are named as the sides to be sent around, and the draws stay where they are made.
    """
    w = W.orderBy("date")
    # Two small tables from which several steps start: a row for each day, a row for each ticker.
    pool = settled(free_dates(events).select("date", (F.row_number().over(w) - 1).alias("k")))
    counts = settled(cars.filter("error is null and ticker is not null").groupBy("ticker").agg(F.count("*").alias("c")))
    upto = F.sum("c").over(W.orderBy("ticker").rowsBetween(W.unboundedPreceding, 0))
    tickers = counts.select("ticker", (upto - F.col("c")).alias("a"), (upto - 1).alias("b"))
    total = counts.agg(F.sum("c").alias("nv"), F.ceil(F.sum("c") / F.count("*")).alias("width"))
    owners = tickers.crossJoin(F.broadcast(total.select("width"))).select("ticker", "a", "b", F.explode(F.expr("sequence(a div width, b div width)")).alias("span"))
    wanted = F.col("nv") if n is None else F.lit(n).cast("long")
    sizes = pool.agg(F.count("*").alias("np")).crossJoin(total.select("nv", "width", wanted.alias("n"))).filter("np > 0 and nv > 0 and n > 0")  # one row each
    blocks = sizes.select("*", F.explode(F.expr(f"sequence(0, (n - 1) div {DRAWS})")).alias("block"))
    blocks = blocks.repartition(cars.sparkSession.sparkContext.defaultParallelism, "block")
    draws = blocks.select("np", "nv", "width", F.explode(F.expr(f"sequence(block * {DRAWS}, least(n, (block + 1) * {DRAWS}) - 1)")).alias("id"))
    draws = draws.select((drawn_number(F.col("id"), seed) % F.col("np")).cast("int").alias("k"), (drawn_number(F.col("id"), seed + 1) % F.col("nv")).alias("j"), "width")
    out = draws.join(F.broadcast(pool), "k").withColumn("span", F.expr("j div width")).join(F.broadcast(owners), "span").filter("j between a and b")
    return out.select(F.concat(F.lit("RAND_"), F.col("date").cast("string"), F.lit("_"), "ticker").alias("event_id"), F.col("date").alias("event_date"), "ticker")
