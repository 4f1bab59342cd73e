"""Exact deduplication by a stateful stream: disk-backed keyed state, full bytes checked on hits.

State. A streaming aggregation in RocksDB keeps, without expiry, one entry a digest: how many rows had
it, the stable identifier (largest doc_id) and the content locator (file and row within it) of the row
that stays. Spark pre-aggregates each micro-batch before its shuffle, so a text that a third of
all rows share reaches the state as one row a task. State, offsets and updates lie in the folder `at`, on the shared file
system: a run that is stopped or loses executors goes on from its last micro-batch, and a later run reads new files only.

Check. Each micro-batch writes the entries that it changed. After a run, the rows of every changed entry with two rows or
more are read again, the retained row at its locator among them, and the least and greatest of their whole texts are
compared, as bytes. An entry where they differ holds several texts under one digest; its rows are
grouped anew by whole text, so a weak digest costs time, never a wrong answer.

Scale. Rows meet their entry in a join of two written tables, which Spark splits for a hot digest; texts
are shuffled once, for the check. Nothing is collected but whether an entry is mixed.

Null texts are empty texts, and equal ones. Of equal texts the row with the largest doc_id stays; a null
doc_id is smaller than any; of rows that repeat that doc_id exactly one stays, the last by file and row. Other columns are
no matter. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import shared_dir, written

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State on disk; no disk is set aside beforehand, which many small stores would fill.
STORE = {PROVIDER: ROCKS, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
MOST_BYTES = 256 << 30
ENTRY = "digest binary, n long, keep struct<doc_id: bigint, file: string, place: bigint>"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text (null: empty), digest, file, place of a table that is read from Parquet files, as a batch or a stream."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digest(text).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def ingest(spark: SparkSession, path: str, at: str, digest: Callable[[Column], Column] = sha256, most_bytes: int = MOST_BYTES, most_files: int | None = None) -> None:
    """Take every file below path that the state in `at` has not seen, in micro-batches of about most_bytes or most_files.

    The number of state partitions is spark.sql.shuffle.partitions of the first run and stays as it is.
    """
    spark.createDataFrame([], ENTRY).write.mode("overwrite").parquet(f"{at}/updates/batch=-1")
    source = spark.readStream.schema(spark.read.parquet(path).select("doc_id", "text").schema)
    source = source.option("maxFilesPerTrigger", most_files) if most_files else source.option("maxBytesPerTrigger", most_bytes)
    path = path.rstrip("/")
    rows = located(source.parquet(f"{path[:-1]}[{path[-1]}]"), digest)  # as a pattern, a path may be one file as well as a folder
    entries = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "place")).alias("keep"))

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/updates/batch={number}")  # a repeated micro-batch writes the same again

    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        entries.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def entries(spark: SparkSession, at: str) -> DataFrame:
    """digest, n, keep as the state in `at` has them now: n only grows, so the largest is the latest."""
    log = spark.read.schema(ENTRY).parquet(f"{at}/updates")
    return log.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("e")).select("digest", "e.n", "e.keep")


def verdicts(spark: SparkSession, path: str, at: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row below path, all of whose files have been taken in."""
    now = written(entries(spark, at), "op13-entries")
    rows = located(spark.read.parquet(path), digest)
    hits = written(rows.select("digest", "text").join(now.where("n > 1").select("digest"), "digest"), "op13-hits")
    mixed = written(hits.groupBy("digest").agg(F.min("text").alias("x"), F.max("text").alias("y")).where("x <> y").select("digest"), "op13-mixed")
    own = F.col("keep.file").eqNullSafe(F.col("file")) & F.col("keep.place").eqNullSafe(F.col("place"))
    out = (F.col("doc_id"), F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), own.alias("kept"), F.col("text_sha256"))
    named = rows.withColumn("text_sha256", F.sha2("text", 256))
    if mixed.isEmpty():
        return named.drop("text").join(now, "digest").select(*out)
    odd = written(named.join(mixed, "digest"), "op13-odd")
    groups = written(odd.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "place")).alias("keep")), "op13-groups")
    plain = named.drop("text").join(now.join(mixed, "digest", "left_anti"), "digest").select(*out)
    return plain.unionByName(odd.join(groups, ["digest", "text"]).select(*out))


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The verdicts on a table that is not yet on disk: it is written first, so that its rows have a locator."""
    spark, at = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/op13-{uuid.uuid4().hex}"
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").write.parquet(f"{at}/rows")
    ingest(spark, f"{at}/rows", at, digest)
    return verdicts(spark, f"{at}/rows", at, digest)


def op13_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, at = f"{sf_dir}/documents.parquet", f"{shared_dir(spark)}/op13-{uuid.uuid4().hex}"
    ingest(spark, path, at)
    return verdicts(spark, path, at)


OP13_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM t
"""
