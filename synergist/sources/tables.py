"""Stored tables whose changes are transactions.

``<path>/data/write=<id>`` holds what one write brought, in folders by partition, and
is never changed. ``<path>/manifest/version=<n>`` names the live (partition, write)
pairs of a version, in one file; ``<path>/schema`` keeps the columns' types and the
partition columns. A change writes its data first and its version last, so readers
see the old rows until that file is in place, and a change that fails leaves them.

Partition values keep their types: the period '16.10' is a string and isn't '16.1'.
An empty string in a partition column is stored as null, as Spark's writers do.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

#: Column of the data folders that names the write.
WRITE = "_of_write"


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e)


def layout(spark: SparkSession, path: str) -> tuple[StructType, list[str]] | None:
    """(schema, partition columns) of the table at ``path``, None if there is none."""
    try:
        got = json.loads(spark.read.text(f"{path}/schema", wholetext=True).first()[0])
    except AnalysisException as e:
        if _missing(e):
            return None
        raise
    return StructType.fromJson(got["schema"]), got["partition"]


def _entry_schema(schema: StructType, partition: list[str]) -> StructType:
    out = StructType([StructField(c, schema[c].dataType) for c in partition])
    return out.add(WRITE, StringType()).add("_rows", LongType())


def _versions(spark: SparkSession, path: str, schema: StructType, partition: list[str]) -> DataFrame:
    return spark.read.schema(_entry_schema(schema, partition).add("version", LongType())).parquet(f"{path}/manifest")


def version(spark: SparkSession, path: str) -> int:
    """Number of the newest version, -1 before the first."""
    found = layout(spark, path)
    if found is None:
        return -1
    try:
        top = _versions(spark, path, *found).agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if _missing(e):
            return -1
        raise
    return -1 if top is None else top


def entries(spark: SparkSession, path: str) -> DataFrame | None:
    """Live (partition columns, write, _rows) of the newest version: a row for each
    partition and each write that it has rows of. None if there is no table."""
    found, at = layout(spark, path), version(spark, path)
    if found is None or at < 0:
        return None
    rows = _versions(spark, path, *found).where(F.col("version") == at)
    return rows.where(F.col(WRITE).isNotNull()).drop("version")


def _among(columns: list[str], values: list[tuple]) -> Column:
    """Whether the columns have one of the value tuples; null is a value."""
    one = lambda v: reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNull() if x is None else F.col(f"`{c}`") == F.lit(x) for c, x in zip(columns, v, strict=True)))
    if len(columns) == 1:
        known = [v[0] for v in values if v[0] is not None]
        parts = ([F.col(f"`{columns[0]}`").isin(*known)] if known else []) + ([F.col(f"`{columns[0]}`").isNull()] if len(known) < len(values) else [])
    else:
        parts = [one(v) for v in values]
    return reduce(lambda a, b: a | b, parts, F.lit(False)) if parts else F.lit(False)


def read(spark: SparkSession, path: str, values: list | None = None) -> DataFrame | None:
    """Live rows, with ``values`` those of some values of the first partition column
    only. Other partitions, and rows of replaced ones, aren't read: the filters are on
    partition columns alone. None if there is no table."""
    found, live = layout(spark, path), entries(spark, path)
    if found is None or live is None:
        return None
    schema, partition = found
    if values is not None:
        live = live.where(_among(partition[:1], [(v,) for v in values]))
    wanted = _live_rows(live, partition)
    if wanted is None:
        return spark.createDataFrame([], schema)
    return _all_rows(spark, path, schema).where(wanted).select(*(f"`{c}`" for c in schema.names))


def _live_rows(live: DataFrame, partition: list[str]) -> Column | None:
    """The filter on partition columns that finds the rows of some entries."""
    by_write: dict[str, list[tuple]] = {}
    for row in live.select(WRITE, *(f"`{c}`" for c in partition)).collect():  # a row for each live partition and write
        by_write.setdefault(row[0], []).append(tuple(row[1:]))
    wanted = [(F.col(WRITE) == w) & (_among(partition, v) if partition else F.lit(True)) for w, v in by_write.items()]
    return reduce(lambda a, b: a | b, wanted) if wanted else None


def _all_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType(list(schema)).add(WRITE, StringType())).parquet(f"{path}/data")


def _commit(spark: SparkSession, path: str, before: int, rows: DataFrame) -> None:
    """Put the next version in place; another writer's version in between is an error."""
    schema, partition = layout(spark, path)
    marker = spark.createDataFrame([(None,) * (len(partition) + 2)], _entry_schema(schema, partition))
    rows = marker.unionByName(rows.select(*(f"`{c}`" for c in partition), WRITE, "_rows"))
    for n in range(before + 1, before + 100):
        try:
            rows.coalesce(1).write.parquet(f"{path}/manifest/version={n}")
            return
        except AnalysisException as e:
            # the folder may be all that is left of a writer that died
            if "PATH_ALREADY_EXISTS" not in str(e) or version(spark, path) != before:
                raise
    raise RuntimeError(f"no version of {path} could be written")


def _store(df: DataFrame, path: str, partition: list[str]) -> DataFrame:
    """Write the rows of ``df`` to a folder of their own; returns their entries."""
    spark = df.sparkSession
    found = layout(spark, path)
    if found is None:
        text = json.dumps({"schema": json.loads(df.schema.json()), "partition": partition})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
        found = layout(spark, path)
    schema, partition = found
    missing = set(schema.names) ^ set(df.columns)
    if missing:
        raise ValueError(f"columns differ from the table's: {sorted(missing)}")
    df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in schema))
    name = uuid.uuid4().hex
    at = f"{path}/data/{WRITE}={name}"
    writer = df.write
    (writer.partitionBy(*partition) if partition else writer).parquet(at)
    keys = [F.col(f"`{c}`") for c in partition]
    rows = spark.read.schema(schema).parquet(at).groupBy(*keys).agg(F.count("*").alias("_rows")).where("_rows > 0")
    return rows.withColumn(WRITE, F.lit(name))


def _without(live: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """Entries whose partition isn't among the gone ones (null is a value)."""
    named = gone.select(*(F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(columns))).distinct()
    on = [F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(columns)]
    return live.join(named, on, "left_anti") if columns else live.where(F.lit(False))


def append(df: DataFrame, path: str, partition: list[str]) -> None:
    """Add the rows of ``df``."""
    before = version(df.sparkSession, path)
    fresh = _store(df, path, partition)
    live = entries(df.sparkSession, path)
    _commit(df.sparkSession, path, before, fresh if live is None else live.unionByName(fresh))


def replace(df: DataFrame, path: str, partition: list[str], values: list | None = None) -> None:
    """Replace partitions by the rows of ``df``: those that it has rows of, and all of
    ``values`` of the first partition column, which are left without rows if ``df`` has
    none for them. Without partition columns the whole table is replaced."""
    spark = df.sparkSession
    before = version(spark, path)
    fresh = _store(df, path, partition)
    live = entries(spark, path)
    if live is not None:
        if partition and values:
            live = live.where(~_among(partition[:1], [(v,) for v in values]))
        fresh = _without(live, fresh, partition).unionByName(fresh)
    _commit(spark, path, before, fresh)


def drop(spark: SparkSession, path: str, values: list) -> int:
    """Drop the partitions of some values of the first partition column, by the manifest
    alone; returns the number of rows that they had."""
    found, live, before = layout(spark, path), entries(spark, path), version(spark, path)
    if live is None:
        return 0
    gone = _among(found[1][:1], [(v,) for v in values])
    n = live.where(gone).agg(F.sum("_rows")).first()[0] or 0
    if n:
        _commit(spark, path, before, live.where(~gone))
    return n


def replace_everything(df: DataFrame, path: str, partition: list[str]) -> None:
    """Replace all rows of the table, whatever its partitions."""
    spark = df.sparkSession
    before = version(spark, path)
    _commit(spark, path, before, _store(df, path, partition))


def row_count(spark: SparkSession, path: str) -> int:
    """Live rows, from the manifest."""
    live = entries(spark, path)
    return 0 if live is None else live.agg(F.sum("_rows")).first()[0] or 0


def row_count_of(spark: SparkSession, path: str, values: list) -> int:
    """Live rows of some values of the first partition column, from the manifest."""
    live = entries(spark, path)
    return 0 if live is None else live.where(_among(layout(spark, path)[1][:1], [(v,) for v in values])).agg(F.sum("_rows")).first()[0] or 0


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders of partitions that the newest version doesn't name, and the
    versions before it, through Hadoop's file system (readers of older versions lose
    them). Returns the number of folders."""
    found, live, top = layout(spark, path), entries(spark, path), version(spark, path)
    if live is None:
        return 0
    schema, partition = found
    rows = _all_rows(spark, path, schema)
    wanted = _live_rows(live, partition)
    dead = rows if wanted is None else rows.where(~F.coalesce(wanted, F.lit(False)))
    folder = F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1)
    names = [r[0] for r in dead.select(folder).distinct().collect()]  # a row for each dead partition
    old = _versions(spark, path, *found).where(F.col("version") < top)
    names += [r[0] for r in old.select(folder).distinct().collect()]
    for name in names:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(names)
