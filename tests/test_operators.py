import itertools
import random
import re
import statistics
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazmill.extract import columns
from hazmill.extract.rules import NEGATIONS, RULES, extract, extract_all, record
from hazmill.operators import events as E
from hazmill.operators import tables as T
from hazmill.operators.event_study import market_model
from hazmill.operators.medians import exact_medians


def slow_first_fit(days, tokens):
    clusters, out = [], []
    for i, (d, t) in enumerate(zip(days, tokens)):
        for k, members in enumerate(clusters):
            near = all(d is None or days[m] is None or abs(d - days[m]) <= E.TOLERANCE for m in members)
            if near and all(not t or not tokens[m] or t & tokens[m] for m in members):
                members.append(i)
                out.append(k)
                break
        else:
            clusters.append([i])
            out.append(len(clusters) - 1)
    return out


def test_first_fit_against_the_plain_rule():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(0, 25)
        days = sorted(rng.randint(0, 40) for _ in range(n))
        days = days[: n - n // 5] + [None] * (n // 5)
        tokens = [frozenset(rng.sample("abcd", rng.randint(0, 2))) for _ in range(n)]
        assert E.first_fit(days, tokens) == slow_first_fit(days, tokens)


def test_mode_takes_the_first_seen_among_equals(spark):
    rows = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3), (1, None, 4), (1, "nan", 5)], "k int, v string, s int")
    assert [tuple(r) for r in E.first_mode(rows, ["k"], "v", "s", "m").collect()] == [(1, "b")]


def test_nearest_entry(spark):
    asked = spark.createDataFrame([(i, "EQ", "JP", date(2025, 1, d) if d else None) for i, d in enumerate([10, 18, 25, None])] + [(9, "EQ", None, date(2025, 1, 10))], "cid long, type string, iso2 string, day date")
    entries = spark.createDataFrame([(0, "EQ", "JP", date(2025, 1, 3), "red"), (1, "EQ", "JP", date(2025, 1, 17), "odd"), (2, "EQ", "JP", None, "red")], "g_pos long, g_type string, g_iso2 string, g_day date, alert string")
    got = {r.cid: (r.g_pos, r.predicted_alert) for r in E.nearest_catalogue(asked, entries).collect()}
    assert got == {0: (0, "orange_or_red"), 1: (1, "green"), 2: (None, None), 3: (None, None), 9: (None, None)}


def test_ranking_metrics_against_pairs(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.3, 1), (0.1, 0)]
    got = T.ranking_metrics(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pairs = [(a, b) for (a, x), (b, y) in itertools.product(rows, rows) if x == 1 and y == 0]
    assert got.roc_auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs), abs=1e-6)


def bound(text, token, anchors):
    at = np.array([token])
    return columns.bindings(columns.Batch([text]), np.array([0]), at, at, anchors)[0]


def test_texts_of_a_batch_dont_touch():
    """A batch gives what its texts give alone, whatever stands beside them, and matches and windows end with their text."""
    rng = random.Random(2)
    parts = ["killed", "12", "1,200", "1.2.3", "million people", "were", "magnitude", "M", "6.1-magnitude quake", "depth of", "km deep", "few people in MMI IV", "storm surge of", "feet", "at risk", "burned over", "acres", "km²", "death toll rose to", "no/yes", "not", "official.", "5-month drought", "$", "losses of usd", "é", "x\x00y", "\u0130", "١٢"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["killed", "12 people", None, ""]
    codes = [rng.choice(["EQ", "TC", "WF", "DR", "FL", ""]) for _ in texts]
    whole = extract_all(texts, codes)
    assert whole == [extract(t, c) for t, c in zip(texts, codes)] and sum(map(len, whole)) > 100


def test_windows_against_a_plain_walk():
    rng = random.Random(3)
    words = ["at", "risk", "toll", "death", "no", "and/or", "not/x", "a", "b", "c"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    batch, anchors = columns.Batch(texts), ("at risk", "death", "death toll", "a")
    for k, text in enumerate(texts):
        tokens = text.split()
        i = rng.randrange(len(tokens))
        j = min(len(tokens) - 1, i + rng.randint(0, 2))
        near = tokens[max(0, i - 8) : j + 9]
        gaps = [min(abs(n - i), abs(n - j)) for n in range(max(0, i - 8), min(len(tokens), j + 9)) if tokens[n] in anchors] + [1 for a in anchors if " " in a and a in " ".join(near)]
        want = min(1.0, 0.42 + 0.12 * min(len(gaps), 3) + max(0.0, 0.26 - 0.03 * min(gaps))) if gaps else 0.08
        one, base = np.array([k]), batch.from_token[k]
        assert columns.bindings(batch, one, np.array([base + i]), np.array([base + j]), anchors)[0] == pytest.approx(want)
        assert bool(columns.negated(batch, one, np.array([base + i]), np.array([base + j]), NEGATIONS)[0]) == any(p in NEGATIONS for t in tokens[max(0, i - 5) : j + 6] for p in t.split("/"))


def test_every_pattern_knows_its_beginnings():
    from hazmill.plans.queries import FINDS

    assert all(columns.heads(p) for r in RULES for p in r.patterns) and sum(len(r.patterns) for r in RULES) == 47
    asked = [(f, t.replace("{n}", "40")) for _, t, f, *_ in FINDS]
    assert all(any(f == r.field and re.search(p, t, re.I) for f, t in asked) for r in RULES for p in r.patterns)


def test_extraction():
    got = extract("A magnitude 6.2 earthquake struck at a depth of 10 miles. Official reports: it killed 12 men.", "EQ")
    assert got["magnitude"][0] == 6.2 and got["depth"][0] == pytest.approx(16.0934) and got["dead"][0] == 12
    assert extract("", "EQ") == {} == extract(None, "") and "magnitude" not in extract("magnitude 6.2 earthquake", "TC")
    assert bound("x y", 0, ("dead",)) == 0.08
    assert "dead" in extract("The fire left 3 dead.", "") and "dead" not in extract("It left 3 here.", "FL")


def test_anchors_must_be_whole_tokens_and_each_counts():
    text = "killed killed killed killers 12"
    assert bound(text, 4, ("killed",)) == pytest.approx(0.42 + 0.36 + 0.26 - 0.06)
    assert bound(text, 4, ("kill",)) == 0.08


def test_whole_record():
    r = record("Quake hits the port [SEP] Shaking felt: few people in MMI VI. Crops and crop harvest lost.", "earthquake", " now ", None)
    assert r["metrics"]["rapid_pop_people"]["value"] == 100.0 and r["metrics"]["rapid_few_people"]["value"] == 1.0 and r["low_confidence"] is True
    assert r["sector_hints"] == {"transportation": 1, "agriculture": 2} and r["affected_sectors"] == ["agriculture", "transportation"] and r["meta"] == {"timestamp": "now", "location_text": ""}
    assert record("", "EQ")["metrics"] == {} and record("x", "volcano")["low_confidence"] is None and record("x", "EQ")["metrics"]["rapid_missing"]["value"] == 1.0


def test_queries_import():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_clusters_across_gaps_and_without_dates(spark):
    rng, rows = random.Random(9), []
    for pos in range(400):
        day = None if rng.random() < 0.15 else date(2025, 1, 1) + timedelta(rng.choice([0, 3, 6, 9, 30, 33, 36, 60, 61]))
        rows.append((pos, rng.choice(["flood", "eq"]), str(day) if day else None, rng.choice(["JP", None]), " ".join(rng.sample(["alpha", "beta", "gamma", "north"], rng.randint(0, 2)))))
    df = spark.createDataFrame(rows, "pos long, label string, event_date string, country_iso2 string, location_text string")
    got = {r.pos: (r.cluster, r.seq) for r in E.greedy_clusters(df).collect()}
    groups = {}
    for pos, label, day, iso, place in rows:
        groups.setdefault((label, iso), []).append((day or "9999", pos, frozenset(place.split()) - {"north"}))
    for members in groups.values():
        members.sort(key=lambda m: m[:2])
        days = [None if d == "9999" else date.fromisoformat(d).toordinal() for d, _, _ in members]
        want = slow_first_fit(days, [t for _, _, t in members])
        assert [got[p] for _, p, _ in members] == [(c, i) for i, c in enumerate(want)]


def test_as_of_takes_the_first_day_on_or_after(spark):
    from hazmill.operators.event_study import event_days

    days = spark.createDataFrame([("A", date(2025, 1, d), p) for p, d in enumerate([2, 3, 7])] + [("B", date(2025, 1, 9), 0)], "ticker string, date date, pos int")
    asked = spark.createDataFrame([(i, "A", date(2025, 1, d)) for i, d in enumerate([1, 2, 4, 7, 8])], "event_id long, ticker string, event_date date")
    assert [r.t0_pos for r in event_days(asked, days).orderBy("event_id").collect()] == [0, 0, 2, 2, None]


def test_splits_are_stratified_and_cover_all(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 10 = 0, 'rare', 'common') as c")
    n = {(r.c, r.split): r["count"] for r in T.random_split(df, "c", "id").groupBy("c", "split").count().collect()}
    assert n == {("rare", "test"): 20, ("rare", "val"): 10, ("rare", "train"): 70, ("common", "test"): 180, ("common", "val"): 90, ("common", "train"): 630}


def test_exact_medians_of_a_million_errors(spark):
    df = spark.range(1_000_001).select(F.lit("big").alias("g"), F.exp(F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e8).alias("v"))
    small = spark.createDataFrame([("small", float(x)) for x in (5, 1, 4, 2)] + [("none", None), (None, 2.0), (None, 9.0), (None, 3.0)], "g string, v double")
    got = {r.g: r.m for r in exact_medians(df.unionByName(small), ["g"], "v", "m").collect()}
    values = sorted(r.v for r in df.select("v").collect())
    assert got == {"big": values[500_000], "small": 3.0, "none": None, None: 3.0}


def test_exact_medians_of_odd_spreads(spark):
    for seed in range(5):
        rng = random.Random(seed)
        values = [rng.choice([0.0, 1e-300, 1e300, -1e300, 5.0, rng.random(), float(rng.randint(0, 9))]) for _ in range(rng.randint(1, 300))]
        got = exact_medians(spark.createDataFrame([(v,) for v in values], "v double"), [], "v", "m", few=4, bins=8).first()[0]
        assert got == statistics.median(values)
    assert exact_medians(spark.createDataFrame([], "v double"), [], "v", "m").first()[0] is None


def test_market_model_against_regression_of_each_window(spark):
    rng = random.Random(9)
    rows = [(t, date(2025, 1, 1) + timedelta(days=k), rng.gauss(5, 1), 0.5 if t == "flat" or 10 <= k < 70 and t == "part" else rng.gauss(-3, 1)) for t, n in (("a", 90), ("flat", 60), ("part", 90), ("short", 12)) for k in range(n)]
    returns = spark.createDataFrame(rows, "ticker string, date date, y double, x double").withColumn("pos", F.row_number().over(W.partitionBy("ticker").orderBy("date")) - 1)
    of = {}
    for t, _, y, x in rows:
        of.setdefault(t, []).append((y, x))
    for r in market_model(returns).collect():
        days = of[r.ticker]
        est = days[max(0, r.pos - 45) : max(0, r.pos - 5)]
        assert r.n_est == len(est)
        mx, my = (sum(d[k] for d in est) / len(est) if est else 0 for k in (1, 0))
        sxx = sum((x - mx) ** 2 for _, x in est)
        if not est or len({x for _, x in est}) == 1:
            assert r.beta is None and r.car_t1 is None
            continue
        beta = sum((x - mx) * (y - my) for y, x in est) / sxx
        assert r.beta == pytest.approx(beta, abs=1e-8) and r.alpha == pytest.approx(my - beta * mx, abs=1e-7)
        for k in (1, 3, 5):
            got = r[f"car_t{k}"]
            after = days[r.pos + 1 : r.pos + k + 1]
            assert got == pytest.approx(sum(y - (my - beta * mx) - beta * x for y, x in after), abs=1e-6) if len(after) == k else got is None


def test_ranking_of_many_scores_in_ranges(spark):
    rows = [(k % 97 / 97, int(k * 7 % 3 == 0)) for k in range(500)]
    df = spark.createDataFrame(rows, "s double, y int")
    assert T.ranking_metrics(df, "s", "y", few=10).first() == T.ranking_metrics(df, "s", "y").first()
