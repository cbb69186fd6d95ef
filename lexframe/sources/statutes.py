"""Statute documents: one JSON file per law."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STEM = r"([^/]+?)(?:\.json)?$"


def _name_and_text(files: DataFrame) -> DataFrame:
    name = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), _STEM, 1))
    return files.select(name.alias("law_name"), F.col("value").alias("doc"))


def read_statute_json(spark: SparkSession, path: str) -> DataFrame:
    """``law_name`` (file name) and ``doc`` (whole file) of every document."""
    return _name_and_text(spark.read.text(path, wholetext=True))


def write_statute_json(documents: DataFrame, path: str) -> None:
    """One file per row of ``documents`` (``doc``), in a folder per task under ``path``, which must be new.

    Spark's writer commits every file by itself, which costs more than the text. A file gets its name when it is whole,
    so a repeated task replaces equal files only.
    """
    def write(batches):
        store, base = pyarrow.fs.FileSystem.from_uri(path)
        task, written = TaskContext.get().partitionId(), 0
        folder = f"{base}/task={task:06d}"
        for batch in batches:
            for text in batch.column(0):
                if not written:
                    store.create_dir(folder, recursive=True)
                name = f"{folder}/{written:09d}.json"
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as file:
                    file.write((text.as_py() or "").encode())
                store.move(draft, name)
                written += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    documents.select("doc").mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


def stream_statute_json(spark: SparkSession, path: str) -> DataFrame:
    """The same for files that keep arriving."""
    return _name_and_text(spark.readStream.text(path, wholetext=True))


def usable(doc: Column) -> Column:
    """The text is JSON and holds a law."""
    return F.try_parse_json(doc).isNotNull() & F.get_json_object(doc, "$.법령").isNotNull()


def split_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable documents, and the rest to be looked at."""
    good = F.coalesce(usable(F.col("doc")), F.lit(False))
    return documents.where(good), documents.where(~good)
