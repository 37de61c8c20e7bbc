"""Sources."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import DETAIL, TIMELINE
from . import tables


def read_raw(spark: SparkSession, path: str, kind: str = "timeline") -> DataFrame:
    """Raw JSON documents (gzip by extension) under
    ``<path>/<segment>/<period>/<id>.<kind>.json[.gz]``, typed by an explicit schema,
    with segment and period taken from the path."""
    schema = TIMELINE if kind == "timeline" else DETAIL
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}.json*").option("multiLine", True).json(path)
    file = F.col("_metadata.file_path")
    part = r"/([^/]+)/([^/]+)/[^/]+$"
    return rows.select("*", F.regexp_extract(file, part, 1).alias("segment"), F.regexp_extract(file, part, 2).alias("period"))


def write_raw(df: DataFrame, path: str, kind: str = "timeline", batch: int = 1000) -> None:
    """Write JSON documents (segment, period, document) as the tree that ``read_raw``
    reads. A file holds up to ``batch`` documents of a segment and period as one array."""
    spark = df.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        task, n = TaskContext.get(), 0
        for rows in batches:
            held: dict[tuple[str, str], list[str]] = {}
            for x in rows.to_pylist():
                held.setdefault((x["segment"], x["period"]), []).append(x["document"])
            for (segment, period), documents in held.items():
                folder = f"{root}/{segment}/{period}"
                files.create_dir(folder, recursive=True)
                for at in range(0, len(documents), batch):
                    # a retried task writes the same files again: hidden until they are whole
                    name = f"{task.partitionId()}-{n}.{kind}.json.gz"
                    with files.open_output_stream(f"{folder}/.{name}.{task.taskAttemptId()}") as out:
                        out.write(gzip.compress(("[" + ",".join(documents[at : at + batch]) + "]").encode()))
                    files.move(f"{folder}/.{name}.{task.taskAttemptId()}", f"{folder}/{name}")
                    n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    df.select("segment", "period", "document").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def load_reference(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header and ``#`` comment lines; a byte order mark is dropped."""
    reader = spark.read.option("header", True).option("comment", "#")
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))


def scan_facts(spark: SparkSession, path: str, periods: list[str]) -> DataFrame:
    """Rows of some periods of a stored table: only their folders are read. Periods are
    what they were written as: '16.1' isn't '16.10'."""
    rows = tables.read(spark, path, periods)
    if rows is None:
        raise ValueError(f"no table at {path}")
    return rows
