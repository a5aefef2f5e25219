"""Queries and operators cover all rows of their input."""

from datetime import date, timedelta

import duckdb
import pytest

from hazmill.operators import event_study as S
from hazmill.plans import queries as Q
from hazmill.plans import views as V

SMALL = "/root/testdata/sf0.001"


def duck(sql):
    con = duckdb.connect()
    for t in V.TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return sorted(con.execute(sql).fetchall())


def drawn(spark, rows, *args, **named):
    cars = spark.createDataFrame(rows, "event_date date, ticker string, error string")
    return S.random_events(cars.drop("error"), cars, *args, **named)


def test_date_pool_excludes_days_near_every_event(spark):
    assert "event_id %" not in Q.SQL["q_date_pool"]
    got = sorted(tuple(r) for r in Q.q_date_pool(spark, SMALL).collect())
    assert got and got == duck(Q.SQL["q_date_pool"])


def test_random_baseline_draws_as_many_as_valid_rows(spark):
    start = date(2020, 1, 1)
    rows = [(start, "A", None)] * 150 + [(start + timedelta(100), "B", None)] * 150 + [(start + timedelta(50), "C", "no_price_data")]
    got = drawn(spark, rows, seed=1).collect()
    assert len(got) == 300
    assert all(min(abs((r.event_date - start).days - k) for k in (0, 50, 100)) > 10 for r in got)
    assert drawn(spark, rows, 7).count() == 7
    assert drawn(spark, rows[:150], seed=1).count() == 0  # no free date
    assert drawn(spark, rows[-1:], seed=1).count() == 0


def test_random_baseline_query(spark):
    events = V.view(spark, SMALL, V.EVM)
    valid = S.abnormal_returns(events, *Q._px(spark, SMALL)).filter("error is null").count()
    assert Q.q_random_baseline(spark, SMALL).count() == valid > 0


def test_tickers_are_drawn_by_their_valid_rows(spark):
    start = date(2020, 1, 1)
    rows = [(start, "A", None)] * 900 + [(start + timedelta(100), t, None) for t in "BCDEFGHIJ" for _ in range(10)] + [(start, "Z", "no_price_data")] * 50
    got = [r.ticker for r in drawn(spark, rows).collect()]
    assert len(got) == 990 and "Z" not in got
    assert got.count("A") / len(got) == pytest.approx(900 / 990, abs=0.05)
    assert set(got) == set("ABCDEFGHIJ")


def test_union_of_splits_covers_the_table(spark):
    assert "%" not in Q.SQL["q_union_splits"]
    assert sorted(tuple(r) for r in Q.q_union_splits(spark, SMALL).collect()) == duck(Q.SQL["q_union_splits"])


def test_each_type_has_its_own_forest(spark):
    from hazmill.ml import models

    rows = [(i, t, float(i % 10), float(i % 10 > 4) if t == "EQ" else float(i % 10 <= 4)) for t in ("EQ", "TC") for i in range(40)]
    p = spark.createDataFrame([(i, t, m, m, int(y)) for i, t, m, y in rows] + [(99, "FL", 5.0, 5.0, 1), (98, "DR", 5.0, 5.0, 1)], "eventid long, eventtype string, magnitude double, maximum_wind_speed_kmh double, positive int")
    got = {(r.eventtype, r.eventid): r for r in models.severity_by_type(p, trees=10).collect()}
    assert len(got) == 82 and got["FL", 99].prob is None and got["FL", 99].predicted_alert == "green"
    assert got["DR", 98].prob is None and got["DR", 98].predicted_alert is None
    for i, t, _, y in rows:
        assert got[t, i].predicted_alert == ("orange_or_red" if y else "green")


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_plans_read_their_inputs_a_few_times(spark):
    """The market model is made in one pass, and settled where several steps start from it."""
    assert leaves(Q.q_ols_beta(spark, SMALL)) <= 6 and leaves(Q.q_car_windows(spark, SMALL)) <= 6
    assert leaves(Q.q_random_baseline(spark, SMALL)) <= 20
    plan = Q.q_greedy_clusters(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # that of articles without a date; the others were placed before


def test_the_rest_works_without_the_training_data_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['hazmill.llm.queries'] = None; import __spark_entry__ as e; n = e.queries(); assert len(n) > 80 and not any(k.startswith('op') or k == 'pipeline' for k in n) and set(e.oracle_sql()) <= set(n)"
    root = Path(__file__).resolve().parent.parent
    got = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr


def rows_made(df, operator="Join"):
    """The most rows that any join of the plan gave, by Spark's own counts."""
    df.collect()
    plan, most, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan)
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if operator in name and node.metrics().contains("numOutputRows"):
            most = max(most, int(node.metrics().apply("numOutputRows").value()))
        kids = node.children().iterator()
        while kids.hasNext():
            todo.append(kids.next())
    return most


def crowded(spark, n=600):
    """Clusters and entries of two days and one type and country, with a null country and an entry without clusters."""
    day = date(2020, 3, 1)
    clusters = spark.createDataFrame([(i, "EQ", None if i % 100 == 99 else "JP", day + timedelta(4 * (i % 2))) for i in range(n)], "cid long, type string, iso2 string, day date")
    entries = [(i, "EQ", "JP", day + timedelta(2), "Red" if i == n // 2 else "green") for i in range(n // 2, n)] + [(n, "FL", "JP", day, "green"), (n + 1, "EQ", None, day, "red")]
    return clusters, spark.createDataFrame(entries, "g_pos long, g_type string, g_iso2 string, g_day date, alert string")


def test_nearest_catalogue_forms_no_square_of_a_day(spark):
    from hazmill.operators import events as E

    clusters, entries = crowded(spark)
    df = E.nearest_catalogue(clusters, entries)
    assert rows_made(df) <= 2 * clusters.count()
    got = df.collect()
    assert len(got) == 600
    for r in got:
        assert (r.g_pos, r.gap, r.predicted_alert) == ((None, None, None) if r.iso2 is None else (300, 2, "orange_or_red"))


def test_catalogue_matches_form_no_square_of_a_day(spark):
    from hazmill.operators import events as E

    clusters, entries = crowded(spark)
    ids = ";".join(str(i) for i in range(600) if i % 100 != 99)
    for lists in (True, False):
        df = E.catalogue_recall(clusters, entries, lists=lists)
        assert rows_made(df) <= 2 * clusters.count()
        for r in df.collect():
            want = 594 if (r.g_type, r.g_iso2) == ("EQ", "JP") else 0
            assert (r.n_matching, r.found, r.over_split) == (want, want > 0, want > 1)
            assert not lists or r.matching_ids == (ids if want else "")
        assert df.count() == 302


def test_random_draws_are_never_sent_around_whole(spark):
    """Spark takes the draws for as few rows as their blocks; the sides that are broadcast are the days and the tickers."""
    start = date(2020, 1, 1)
    df = drawn(spark, [(start, "A", None)] * 4000 + [(start + timedelta(100), "B", None)] * 4000)
    assert df.count() == 8000
    joins = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in x]
    assert joins and all("BuildRight" in x for x in joins)
    assert rows_made(df) <= 3 * 8000
    owners = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "explode(sequence(" in x and "width" in x and "span" in x]
    assert len(owners) == 1  # as many spans as tickers
