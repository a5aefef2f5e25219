import json
from datetime import date

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazmill.extract import where
from hazmill.sources import rest, sheets, tables


def test_readers_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'idx,text\n1,"two\nlines, NA"\n2,bad \xff byte\n')
    got = tables.read_table(spark, f"{tmp_path}/a.csv", line_breaks=True).collect()
    assert [r.idx for r in got] == ["1", "2"] and got[0].text == "two\nlines, NA" and got[1].text.startswith("bad ")
    (tmp_path / "b.tsv").write_text("country\tn\nNA\t3\n")
    assert tables.read_table(spark, f"{tmp_path}/b.tsv").first().country == "NA"
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.doc")


def test_spreadsheets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a < b & c", [1, 2]), (2, None, None)], "idx long, text string, l array<int>")
    sheets.write_xlsx(df, f"{tmp_path}/t.xlsx")
    got = tables.read_table(spark, f"{tmp_path}/t.xlsx").orderBy("idx").collect()
    assert [tuple(r) for r in got] == [("1", "a < b & c", "[1,2]"), ("2", None, None)]
    assert tables.read_table(spark, f"{tmp_path}/t.xlsx", tables.ARTICLES).filter("idx = 1").first().text == "a < b & c"


def test_catalogue_is_empty_if_absent_and_cut_to_its_window(spark, tmp_path):
    assert tables.catalogue(spark, f"{tmp_path}/none.csv").count() == 0 == tables.catalogue(spark, None).count()
    rows = spark.createDataFrame([("1", "eq ", "Red", "Japan", "2025-01-05T00:00:00", "6,000"), ("2", "TC", "green", "Viet Nam", "2025-03-01", "x")], "eventid string, eventtype string, alertlevel string, country string, fromdate string, dead string")
    tables.write_fixed(rows, f"{tmp_path}/c.csv")
    got = tables.catalogue(spark, f"{tmp_path}/c.csv", "2025-01-01", "2025-01-31", countries=True).collect()
    assert len(got) == 1 and got[0].etype == "EQ" and got[0].event_date == date(2025, 1, 5) and got[0].dead == 6000 and got[0].iso2 == "JP"
    assert [r.iso2 for r in tables.catalogue(spark, f"{tmp_path}/c.csv", countries=True).orderBy("eventid").collect()] == ["JP", "VN"]
    assert spark.read.csv(f"{tmp_path}/c.csv", header=True).columns == tables.CATALOGUE_COLUMNS


def test_first_of_each_key_over_files(spark, tmp_path):
    for i, lines in enumerate((["1,a", "2,b", "1,c"], ["2,d", "3,e"])):
        (tmp_path / f"{i}.csv").write_text("idx,v\n" + "\n".join(lines) + "\n")
    assert sorted(tuple(r) for r in tables.union_files(spark, [f"{tmp_path}/0.csv", f"{tmp_path}/1.csv"]).collect()) == [("1", "a"), ("2", "b"), ("3", "e")]


def test_lookups_take_the_last_of_equal_keys(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"_comment": "x", "MX": {"a": 1}, "US": {"a": 2}, "MX": {"a": 3}}')
    assert {r.key: json.loads(r.value)["a"] for r in tables.read_lookup(spark, f"{tmp_path}/k.json").collect()} == {"MX": 3, "US": 2}


def test_labelling_goes_on_where_it_stopped(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("idx"))

    def odd_fail(rows):
        return [{"idx": r["idx"], "label": "error" if r["idx"] % 2 else "flood"} for r in rows]

    def all_well(rows):
        return [{"idx": r["idx"], "label": "drought"} for r in rows]

    first = {r.idx: r.label for r in tables.labelled(df, f"{tmp_path}/l", odd_fail, "idx long, label string", batch=2).collect()}
    assert len(first) == 20 and first[1] == "error"
    again = {r.idx: r.label for r in tables.labelled(df, f"{tmp_path}/l", all_well, "idx long, label string", batch=2).collect()}
    assert again[0] == "flood" and again[1] == "drought"


def _page(folder, kind, level, page, n, start):
    feats = [{"properties": {"eventid": start + i, "eventtype": kind, "alertlevel": level, "url": {"details": f"file://{folder}/detail{start + i}.json"}}} for i in range(n)]
    (folder / f"{kind}_{level}_{page}.json").write_text(json.dumps({"features": feats}))


def test_paged_source_and_details(spark, tmp_path):
    _page(tmp_path, "EQ", "red", 0, 100, 0)
    _page(tmp_path, "EQ", "red", 1, 100, 100)
    _page(tmp_path, "EQ", "red", 2, 7, 200)
    _page(tmp_path, "WF", "red", 0, 3, 500)
    (tmp_path / "detail5.json").write_text(json.dumps({"properties": {"earthquakedetails": {"magnitude": "6.5", "depth": 10, "rapidpopdescription": "few people"}}}))
    (tmp_path / "detail501.json").write_text(json.dumps({"properties": {"severitydata": {"severity": 77.5}, "impacts": [{"resource": {"impact": f"file://{tmp_path}/impact.json"}}]}}))
    (tmp_path / "impact.json").write_text(json.dumps({"datums": [{"datum": [{"scalars": {"scalar": [{"name": "POPAFFECTED", "value": "1,200"}]}}]}]}))
    url = f"file://{tmp_path}/{{type}}_{{level}}_{{page}}.json"
    raw = rest.read_pages(spark, url, types="EQ,WF", levels="red", limit="150", bylevel="true")
    assert {(r.type, r["count"]) for r in raw.groupBy("type").count().collect()} == {("EQ", 150), ("WF", 3)}
    rows = rest.balanced(tables.features(raw), 10, 0)
    got = {r.eventid: r for r in rest.with_details(rows, attempts=1).collect()}
    assert len(got) == 13 and got["5"].magnitude == 6.5 and got["5"].depth == 10 and got["4"].magnitude is None
    assert got["501"].burned_area_ha == 77.5 and got["501"].people_affected == 1200 and got["500"].burned_area_ha is None


def test_retries_and_page_failures():
    from urllib.error import HTTPError

    waits, calls = [], []

    def opener(url, timeout):
        calls.append(url)
        raise HTTPError(url, 404 if "gone" in url else 500, "no", {}, None)

    for url, n in (("x", 3), ("gone", 1)):
        calls.clear()
        with pytest.raises(HTTPError):
            rest.fetch_json(url, 3, waits.append, opener)
        assert len(calls) == n
    assert len(waits) == 2 and 1 <= waits[0] <= 1.5 and 2 <= waits[1] <= 2.5 and rest.backoff(30) <= 20.5

    def flaky(url):
        if url.endswith(("0", "1")):
            raise OSError
        return {"features": [1]}

    assert list(rest.pages("{page}", "EQ", "red", "", "", 5, flaky)) == [1]
    assert list(rest.pages("a0{page}0", "EQ", "red", "", "", 5, flaky)) == []
    assert rest.parsed_types("eq, xx") == ["EQ"] and rest.parsed_types("") == rest.TYPES and rest.parsed_levels(" Red;") == ["red"]


def test_locations(spark):
    cities = where.city_index(spark.createDataFrame([("Springfield", "", 10, "US", 1.0, 2.0), ("Springfield", None, 99, "AU", 3.0, 4.0), ("Kob", "Kobe,7,xy", 5, "JP", 5.0, 6.0)], "name string, alternatenames string, population long, iso2 string, lat double, lon double"))
    assert {r.name: r.iso2 for r in cities.collect()} == {"springfield": "AU", "kob": "JP", "kobe": "JP"}
    rows = [(0, "Storm hits Springfield", "It rained. Japan watched."), (1, "", "TOKYO, (Agency) Rain. Fires struck Kobe. Peru was calm."), (2, "", "Nothing."), (3, None, None), (4, "South Korea and North Korea", "x"), (5, "", "The US and us; It is cold in New Zealand at 10.5S, 20W.")]
    a = spark.createDataFrame(rows, "pos long, title string, text string")
    got = {r.pos: (r.location_text, r.country_iso2, r.loc_confidence) for r in where.extract_location(a, cities).collect()}
    assert got[0] == ("Springfield", "AU", "location") and got[1] == ("Kobe", "JP", "location") and got[2] == (None, None, "none") == got[3]
    assert got[4] == ("South Korea", "KR", "location") and got[5] == ("US", "US", "coords_text")
    named = spark.createDataFrame([(0, ["Atlantis", "Lima, Peru"]), (1, []), (2, ["Nowhere", "Kobe", "Peru"])], "pos long, names array<string>").withColumns({"title": F.lit(""), "text": F.lit("")})
    given = {r.pos: (r.location_text, r.country_iso2) for r in where.extract_location(named, cities, entities="names").collect()}
    assert given == {0: ("Atlantis", "PE"), 1: (None, None), 2: ("Kobe", "JP")}


def test_trie_and_join_find_the_same_names(spark, monkeypatch):
    import random

    from hazmill.extract import gazetteer, where

    rng = random.Random(5)
    words = ["Japan", "South", "Korea", "korea", "United", "States", "of", "the", "U.S.", "US", "us", "Congo", "Democratic Republic of the Congo", "struck", "Papua New Guinea's", "Türkiye", "Springfield,", "New", "Kobe", "[SEP]", "It rained.", "Timor-Leste", "'India'", "(Fiji)", "TOKYO,", "Cote d'Ivoire", "İzmir"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14))), " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), rng.choice([None, "JP", "xx", ""])) for k in range(300)] + [(300, None, None, None)]
    a = spark.createDataFrame(rows, "pos long, text string, title string, country_iso2 string")
    cities = where.city_index(spark.createDataFrame([("Springfield", "", 10, "US", 1.0, 2.0), ("Kobe", "New Kobe,South Kobe", 5, "JP", 1.0, 1.0), ("Korea", "x", 1, "ZZ", 0.0, 0.0)], "name string, alternatenames string, population long, iso2 string, lat double, lon double"))

    def both():
        named = sorted(map(tuple, where.extract_location(a, cities).collect()), key=str)
        codes = sorted(map(tuple, where.resolve_iso2(a.withColumnRenamed("text", "location_text"), "pos").collect()), key=str)
        return named, codes

    small = both()
    monkeypatch.setattr(gazetteer, "MOST_NAMES", 3)
    assert both() == small and sum(r[2] is not None for r in small[0]) > 100 and sum(r[1] is not None for r in small[1]) > 100


def test_answers_of_failed_tasks_dont_count(spark, tmp_path):
    from hazmill.sources import tables
    from hazmill.sources.answers import AnswerWriter, read_answers, write_answers

    folder = f"{tmp_path}/answers"
    df = spark.range(40).withColumnRenamed("id", "idx").withColumn("text", F.col("idx").cast("string"))

    def fails_late(rows):
        out = []
        for r in rows:
            if r["idx"] == 33:
                raise RuntimeError("the service is gone")
            out.append({"idx": r["idx"], "label": "x"})
        return out

    with pytest.raises(Exception, match="service is gone"):
        tables.labelled(df, folder, fails_late, "idx long, label string", batch=100)
    schema = T.StructType.fromDDL("idx long, label string, __at long")
    assert read_answers(spark, folder, schema).count() == 0  # other tasks of the job had written their files
    asked = spark.sparkContext.accumulator(0)

    def well(rows):
        asked.add(len(rows))
        return [{"idx": r["idx"], "label": "y"} for r in rows]

    for _ in range(2):  # the second run asks for nothing
        got = tables.labelled(df, folder, well, "idx long, label string", batch=3).collect()
        assert sorted((r.idx, r.label) for r in got) == [(i, "y") for i in range(40)]
    assert asked.value == 40 and read_answers(spark, folder, schema).count() == 40

    # a task that ran twice: only the attempt that the driver knows of counts
    writer = AnswerWriter(f"{tmp_path}/twice")
    batch = pa.RecordBatch.from_pydict({"idx": [1, 2]})
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.name != second.name
    writer.commit([second, None])
    assert sorted(r.idx for r in read_answers(spark, f"{tmp_path}/twice", T.StructType.fromDDL("idx long")).collect()) == [1, 2]
    other = AnswerWriter(f"{tmp_path}/twice")
    other.abort([other.write(iter([batch])), None])
    assert read_answers(spark, f"{tmp_path}/twice", T.StructType.fromDDL("idx long")).count() == 2
    assert len(list((tmp_path / "twice" / "files").iterdir())) == 2


def test_price_source_asks_for_what_is_wanted(spark, tmp_path):
    import datetime
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from hazmill.sources.prices import read_prices, write_prices

    log = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            _, ticker, begin, end = self.path.split("/")
            log.append((ticker, begin, end))
            days = [datetime.date(2025, 1, 1) + datetime.timedelta(days=k) for k in range(10)]
            body = json.dumps({"prices": [{"date": d.isoformat(), "close": float(d.day)} for d in days if begin <= d.isoformat() <= end]}).encode()
            self.send_response(404 if ticker == "T9" else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    tickers = ",".join(f"T{k}" for k in range(30))
    prices = read_prices(spark, url=f"http://127.0.0.1:{server.server_port}/{{ticker}}/{{begin}}/{{end}}", tickers=tickers, perpartition="7")
    assert prices.count() == 29 * 10 and len(log) == 30 and prices.rdd.getNumPartitions() == 5  # T9 isn't known
    log.clear()
    some = prices.filter("ticker in ('T3', 'T4', 'nothing') and date >= '2025-01-05' and date < '2025-01-08'")
    assert sorted((r.ticker, r.close) for r in some.collect()) == [(t, c) for t in ("T3", "T4") for c in (5.0, 6.0, 7.0)]
    assert sorted(log) == [("T3", "2025-01-05", "2025-01-07"), ("T4", "2025-01-05", "2025-01-07")]
    log.clear()
    assert prices.filter("ticker = 'T1' and date > '2025-01-09'").count() == 1 and log == [("T1", "2025-01-10", "9999-12-31")]
    assert prices.filter("ticker = 'T1' and date = '2025-01-02' and close > 5").count() == 0 and prices.filter("ticker = 'T1' and ticker = 'T2'").count() == 0
    log.clear()
    from hazmill.cli import prices_of

    events = spark.createDataFrame([("2025-01-04", ["T1", "T2"]), ("2025-01-05", ["T2"]), (None, [])], "event_date string, sector_etfs array<string>")
    got = prices_of(events, f"http://127.0.0.1:{server.server_port}/{{ticker}}/{{begin}}/{{end}}", "T3", before=2, after=1)
    assert sorted((r.ticker, r.close) for r in got.collect()) == [(t, float(d)) for t in ("T1", "T2", "T3") for d in range(2, 7)]
    assert sorted(log) == [(t, "2025-01-02", "2025-01-06") for t in ("T1", "T2", "T3")]
    server.shutdown()

    folder = f"{tmp_path}/prices"
    rows = [(t, datetime.date(2025, 1, k), float(k)) for t in ("A B", "C/D", "^X") for k in range(1, 6)]
    write_prices(spark.createDataFrame(rows, "ticker string, date date, close double"), folder)
    files = read_prices(spark, path=folder)
    assert sorted(map(tuple, files.collect())) == sorted(rows)
    assert sorted(map(tuple, files.filter("ticker = 'C/D' and date between '2025-01-02' and '2025-01-03'").collect())) == [r for r in rows if r[0] == "C/D" and 2 <= r[2] <= 3]
    assert read_prices(spark, path=f"{tmp_path}/none").count() == 0
