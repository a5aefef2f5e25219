"""The clusterer of a stream against that of a batch."""

import random
from collections import defaultdict

import pytest

from hazmill.operators.events import TOLERANCE, greedy_clusters
from hazmill.streaming.clusters import PROVIDER, stream_clusters

ARTICLES = "pos long, label string, country_iso2 string, event_date string, location_text string"


def day(n):
    return f"2025-{1 + n // 28:02d}-{1 + n % 28:02d}"


def run(spark, tmp_path, batches, **more):
    """The rows that come out of batches of articles, fed one after the other."""
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ARTICLES).coalesce(1).write.parquet(str(source / f"b{k:03d}"))
        for f in (source / f"b{k:03d}").glob("part-*"):
            f.rename(source / f"{k:03d}.parquet")
    stream = spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(source))
    query = stream_clusters(stream, **more).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None and not query.isActive
    return spark.read.parquet(str(out)).collect(), query


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def articles(seed, n, undated=0.0):
    rng = random.Random(seed)
    return [(k, rng.choice(["flood", "earthquake"]), rng.choice(["JP", None]), None if rng.random() < undated else day(rng.randint(0, 60)), rng.choice([None, "Kobe", "Osaka", "Kobe Osaka", "Nara"])) for k in range(n)]


END = [(10_000 + k, label, iso, "2026-01-01", "end") for k, (label, iso) in enumerate((a, b) for a in ("flood", "earthquake") for b in ("JP", None))]


def test_equal_to_the_batch_in_order_and_shuffled(rocks, tmp_path):
    rows = sorted(articles(1, 90), key=lambda r: (r[3], r[0]))
    want = {r.pos: (r.type, r.country, r.cluster) for r in greedy_clusters(rocks.createDataFrame(rows, ARTICLES)).collect()}
    for kind in ("ordered", "shuffled"):
        if kind == "shuffled":  # within the lateness
            random.Random(2).shuffle(rows)
        folder = tmp_path / kind
        folder.mkdir()
        got, _ = run(rocks, folder, [rows[:40], rows[40:], END], lateness="100 days")
        assert {r.pos: (r.type, r.country, r.cluster) for r in got if r.pos < 10_000} == want and not any(r.late for r in got)


def test_late_articles_are_set_apart_and_no_cluster_is_wide(rocks, tmp_path):
    rows = articles(3, 120)
    got, query = run(rocks, tmp_path, [rows[:40], rows[40:80], rows[80:], END], lateness="3 days")
    of, dates = {r.pos: r for r in got}, {r[0]: r[3] for r in rows}
    assert set(dates) <= set(of) and any(of[p].late for p in dates) and all((of[p].cluster is None) == of[p].late for p in dates)
    spans = defaultdict(list)
    for p, d in dates.items():
        if not of[p].late:
            spans[of[p].type, of[p].country, of[p].cluster].append((int(d[5:7]) - 1) * 31 + int(d[8:]))
    assert all(max(s) - min(s) <= TOLERANCE + 3 for s in spans.values())  # months counted as 31 days


def test_state_is_bounded_with_undated_articles(rocks, tmp_path):
    rows = [(k, "flood", "JP", None if k % 2 else day(k // 2), f"place{chr(97 + k % 26)}{chr(97 + k // 26)}x") for k in range(240)]
    got, query = run(rocks, tmp_path, [rows[k : k + 60] for k in range(0, 240, 60)] + [END], lateness="1 day", retention=5)
    assert {r.pos for r in got} >= {r[0] for r in rows} and all(r.cluster is not None for r in got if r.pos < 240)
    kept = sum(p["numRowsTotal"] for p in query.lastProgress["stateOperators"])
    assert kept < 60  # of 240 clusters


def test_needs_its_state_store(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value as pos", "'flood' as label", "'JP' as country_iso2", "'2025-01-01' as event_date", "'x' as location_text")
    with pytest.raises(ValueError):
        stream_clusters(stream)
