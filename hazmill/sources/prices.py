"""Prices by ticker and date as a Python data source, from a service or from files, with filters pushed down to it.

Filters on ticker (=, in) leave only those tickers' partitions and requests, filters on date narrow the range that is asked for. One partition
holds a few tickers. A ticker that can't be had (unknown, or an error after all attempts) has no rows, as in an analysis it is an event without prices.

Service: option url with {ticker}, {begin} and {end}; the answer is JSON, a list of {"date", "close"} or an object with such a list under "prices".
Files: option path, a folder of Parquet files by ticker (ticker=X/...) with date and close; a range of dates is pushed into Parquet. Needs spark.sql.python.filterPushdown.enabled
for the filters; without it all tickers are read and Spark filters.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from hazmill.sources.answers import _store
from hazmill.sources.rest import ATTEMPTS, fetch_json

SCHEMA = "ticker string, date date, close double"
EARLIEST, LATEST = datetime.date(1, 1, 1), datetime.date(9999, 12, 31)
PER_PARTITION = 20


@dataclass
class Tickers(InputPartition):
    names: tuple[str, ...]
    begin: datetime.date
    end: datetime.date

    def __init__(self, names: tuple[str, ...], begin: datetime.date, end: datetime.date):
        super().__init__((names, begin, end))
        self.names, self.begin, self.end = names, begin, end


class PriceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options
        self.wanted: set[str] | None = None
        self.begin = datetime.date.fromisoformat(options.get("begin") or EARLIEST.isoformat())
        self.end = datetime.date.fromisoformat(options.get("end") or LATEST.isoformat())

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take filters on ticker and date; give back those that Spark has to check itself."""
        day = datetime.timedelta(days=1)
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("ticker",) and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = names if self.wanted is None else self.wanted & names
                continue
            if column == ("date",) and isinstance(getattr(f, "value", None), datetime.date):
                if isinstance(f, EqualTo | GreaterThanOrEqual):
                    self.begin = max(self.begin, f.value)
                if isinstance(f, GreaterThan):
                    self.begin = max(self.begin, min(f.value, LATEST - day) + day)
                if isinstance(f, EqualTo | LessThanOrEqual):
                    self.end = min(self.end, f.value)
                if isinstance(f, LessThan):
                    self.end = min(self.end, max(f.value, EARLIEST + day) - day)
            yield f  # a service may give more days than it was asked for

    def _known(self) -> list[str]:
        if names := [t for t in self.o.get("tickers", "").split(",") if t]:
            return names
        from pyarrow import fs

        if "path" not in self.o:
            raise ValueError("tickers are needed for a service")
        store, base = _store(self.o["path"])
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return [unquote(i.base_name[len("ticker=") :]) for i in found if i.base_name.startswith("ticker=")]

    def partitions(self) -> list[Tickers]:
        names = sorted({t for t in self._known() if self.wanted is None or t in self.wanted})
        size = int(self.o.get("perpartition", PER_PARTITION))
        some = self.begin <= self.end
        return [Tickers(tuple(names[k : k + size]), self.begin, self.end) for k in range(0, len(names) if some else 0, size)] or [Tickers((), self.begin, self.end)]

    def read(self, partition: Tickers) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ticker", pa.string()), ("date", pa.date32()), ("close", pa.float64())])
        for ticker in partition.names:
            rows = self._from_files(ticker, partition) if "path" in self.o else self._from_service(ticker, partition)
            yield from rows.cast(schema).to_batches()

    def _from_files(self, ticker: str, part: Tickers) -> pa.Table:
        import pyarrow.dataset as ds

        store, base = _store(self.o["path"])
        found = ds.dataset(f"{base}/ticker={quote(ticker, safe=' ')}", format="parquet", filesystem=store, exclude_invalid_files=False)
        rows = found.to_table(["date", "close"], filter=(ds.field("date") >= part.begin) & (ds.field("date") <= part.end))
        return pa.table({"ticker": pa.array([ticker] * rows.num_rows, pa.string()), "date": rows["date"], "close": rows["close"]})

    def _from_service(self, ticker: str, part: Tickers) -> pa.Table:
        url = self.o["url"].format(ticker=quote(ticker, safe=""), begin=part.begin.isoformat(), end=part.end.isoformat())
        try:
            found = fetch_json(url, int(self.o.get("attempts", ATTEMPTS)))
        except (OSError, ValueError):
            found = []
        rows = found.get("prices") or [] if isinstance(found, dict) else found
        days = [(datetime.date.fromisoformat(str(r["date"])[:10]), r["close"]) for r in rows if r.get("date") and r.get("close") is not None]
        days = [d for d in days if part.begin <= d[0] <= part.end]
        return pa.table({"ticker": pa.array([ticker] * len(days), pa.string()), "date": pa.array([d for d, _ in days], pa.date32()), "close": pa.array([float(c) for _, c in days], pa.float64())})


class PriceSource(DataSource):
    """Format "prices": ticker, date, close. Options: url or path, tickers (commas between), begin, end, perpartition, attempts."""

    @classmethod
    def name(cls) -> str:
        return "prices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PriceReader:
        return PriceReader(dict(self.options))


def read_prices(spark: SparkSession, **options: str) -> DataFrame:
    """ticker, date, close; filter the result, and only what is wanted is asked for."""
    spark.dataSource.register(PriceSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(PriceSource.name()).options(**options).load()


def write_prices(prices: DataFrame, path: str) -> None:
    """The files that the source reads: Parquet by ticker."""
    prices.select("ticker", "date", "close").repartition("ticker").sortWithinPartitions("ticker", "date").write.mode("overwrite").partitionBy("ticker").parquet(path)
