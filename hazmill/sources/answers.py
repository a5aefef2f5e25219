"""A transactional sink for answers of a labelling service: files count only once their job's commit is there.

Each task writes a Parquet file of its own; the driver's commit writes one small list of the files of the tasks that succeeded. Readers go by the
lists, so that a failed task or job leaves no answers behind and a repeated or speculative one no second copies. What an aborted job wrote is deleted as far as
the driver knows of it; the rest is never read. The folder must be one that all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FILES, COMMITS = "files", "commits"


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class AnswerWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        store, base = _store(self.folder)
        context = TaskContext.get()
        own = f"{context.partitionId():05d}-{context.taskAttemptId()}" if context else "00000-0"
        name, out, rows = f"{self.job}-{own}-{uuid.uuid4().hex[:8]}.parquet", None, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    store.create_dir(f"{base}/{FILES}", recursive=True)
                    out = pq.ParquetWriter(f"{base}/{FILES}/{name}", batch.schema, filesystem=store)
                out.write_batch(batch)
                rows += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(f"{base}/{FILES}/{name}")
            raise
        if out is not None:
            out.close()
        return Written(name if out is not None else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """List the files of the tasks that succeeded: one small file, moved into its place when it is whole."""
        store, base = _store(self.folder)
        names = [m.name for m in messages if m is not None and m.name]
        store.create_dir(f"{base}/{COMMITS}", recursive=True)
        half = f"{base}/{COMMITS}/.{self.job}"
        with store.open_output_stream(half) as f:
            f.write(json.dumps({"files": names, "rows": sum(m.rows for m in messages if m is not None)}).encode())
        store.move(half, f"{base}/{COMMITS}/{self.job}.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _store(self.folder)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{base}/{FILES}/{m.name}")


class AnswerSink(DataSource):
    """Format "answers", mode append. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        raise ValueError("read answers with read_answers")

    def writer(self, schema: StructType, overwrite: bool) -> AnswerWriter:
        if overwrite:
            raise ValueError("answers are appended only")
        return AnswerWriter(self.options["path"])


def write_answers(df: DataFrame, folder: str) -> None:
    df.sparkSession.dataSource.register(AnswerSink)
    df.write.format(AnswerSink.name()).mode("append").option("path", folder).save()


def read_answers(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All answers that were committed."""
    commits = spark.read.option("pathGlobFilter", "*.json").schema("files array<string>, rows long")
    try:
        names = [name for row in commits.json(f"{folder}/{COMMITS}").collect() for name in row.files]  # a short name for each task that wrote
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        names = []
    return spark.read.schema(schema).parquet(*[f"{folder}/{FILES}/{n}" for n in names]) if names else spark.createDataFrame([], schema)
