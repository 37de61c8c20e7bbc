"""Exact deduplication as a stateful stream.

Documents arrive as a stream of files. Keyed state on disk (RocksDB), without
expiry, retains for every digest a stable identifier and the locator (file and
row) of the copy to keep. Hits are then checked on their full bytes. Everything is
DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, join_unique, materialise, maybe_in

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def digest_of(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def _located(df: DataFrame, normalise) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    body: Column = normalise(text) if normalise else text
    return df.select(
        F.col("doc_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        body.alias("body"),
        digest_of(body).alias("digest"),
    )


def state_of(spark: SparkSession, path: str, checkpoint: str, files_per_batch: int = 1000, normalise=None) -> DataFrame:
    """Run the stream over all files that ``checkpoint`` hasn't seen, and return
    the retained state: digest, copies, keep (doc_id, file, row), n_bytes.

    Each micro-batch emits the digests it touched; the last word on a digest is
    the one of the highest batch. A restart with the same checkpoint continues.
    """
    keys = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # many small stores: files take the space of their content only
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
        # as a pattern, so that a single file is a source too
        docs = source.parquet(path if set(path) & set("*?[{\\") else f"{path[:-1]}[{path[-1]}]")
        state = (
            _located(docs, normalise)
            .withColumn("n_bytes", F.octet_length("body"))
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"))
        )
        touched = f"{checkpoint}/touched"

        def store(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{touched}/batch={batch_id}")

        query = state.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = state.schema.add("batch", "long")
    seen = spark.read.schema(schema).parquet(touched) if query.lastProgress or query.recentProgress else spark.createDataFrame([], schema)
    last = F.max_by(F.struct("keep", "copies", "n_bytes"), "batch").alias("s")
    return seen.groupBy("digest").agg(last).select("digest", "s.*")


def deduplicate(spark: SparkSession, path: str, checkpoint: str | None = None, files_per_batch: int = 1000, normalise=None) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after ``normalise`` (a Column function; none:
    unchanged); null counts as empty. The row with the largest doc_id stays (null
    is smallest; of rows that repeat it, the last file and row), so exactly one
    row of a group is kept. Where texts of one digest differ in their bytes,
    each text is a group of its own. ``path`` is a table or a file pattern.
    """
    checkpoint = checkpoint or fresh_path(spark, "dedup")
    state = materialise(state_of(spark, path, checkpoint, files_per_batch, normalise), "state")
    docs = _located(spark.read.parquet(path), normalise)
    groups = state.select("digest", "keep", "copies")
    sizes = state.select("digest", F.col("copies").alias("_rows"))
    clash = materialise(clashes(docs, state.where("copies > 1").select("digest")), "clashes")
    slim = docs.drop("body")
    if clash.take(1):
        plain = join_unique(slim.join(clash, "digest", "left_anti"), groups, "digest", sizes)
        return _rows(plain).unionByName(_rows(_by_text(docs, clash)))
    return _rows(join_unique(slim, groups, "digest", sizes))


def clashes(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Digests of ``repeated`` whose documents aren't all the same bytes.

    The full bytes of every hit, the located copy's among them, are compared: the
    least and the largest text of a digest are equal or it's a clash. Both are found
    before the shuffle, so a hot digest sends two texts for each task.
    """
    ends = maybe_in(docs.select("digest", "body"), repeated, "digest").groupBy("digest").agg(F.min("body").alias("lo"), F.max("body").alias("hi"))
    return ends.where("lo <> hi").select("digest").join(repeated, "digest", "left_semi")


def _by_text(docs: DataFrame, clash: DataFrame) -> DataFrame:
    """The documents of clashing digests with the kept copy of their own text."""
    rows = docs.join(clash, "digest", "left_semi")
    per_text = rows.groupBy("digest", "body").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("copies"))
    return rows.join(per_text, ["digest", "body"])


def _rows(joined: DataFrame) -> DataFrame:
    kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return joined.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("copies").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))
