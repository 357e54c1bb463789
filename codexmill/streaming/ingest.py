"""Streams: incremental ingest of files and rows, idle sessions and liveness over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codexmill.operators.chunking import ChunkOptions, chunk
from codexmill.operators.incremental import Ledger
from codexmill.operators.search import postings
from codexmill.sources.extract import extract

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def available(source: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Process what is there now in batches, once each, and end; a later call goes on from the checkpoint."""
    query = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_files(spark: SparkSession, folder: str, out: str, options: ChunkOptions = ChunkOptions(), per_batch: int = 100) -> None:
    """Files of a folder to tables units, chunks and postings under `out`, one partition per batch.

    A batch that is run again after a failure overwrites its own partition, so nothing is lost or doubled. Ids of
    documents are hashes of their paths, the same in every run.
    """
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        units = extract(batch).withColumn("doc_id", F.xxhash64("path"))
        units.write.mode("overwrite").parquet(f"{out}/units/batch={number}")
        good = spark.read.parquet(f"{out}/units/batch={number}").where("error is null").select("doc_id", "unit_no", "text")
        chunks = chunk(good, options).withColumn("chunk_id", F.xxhash64("doc_id", "ord"))
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        postings(spark.read.parquet(f"{out}/chunks/batch={number}")).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")

    available(stream, f"{out}/checkpoint", write)


def ingest_rows(spark: SparkSession, folder: str, schema: StructType, ledger: Ledger, transform: Callable[[DataFrame], DataFrame], per_batch: int = 1000) -> None:
    """Parquet rows that arrive in a folder, transformed and committed with their sequence numbers.

    The ledger decides what is new, so rows that a repeated batch or a second file brings again are not processed twice.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        ledger.process(batch, lambda rows: transform(rows.dropDuplicates([ledger.seq])))

    available(stream, f"{ledger.root}/checkpoint", write)


def sessions(events: DataFrame, by: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(by, begin, end, events) of sessions that a gap of silence ends; works on streams (with watermark) and tables."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(at, late)
    s = e.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("events"))
    return s.select(by, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "events")


def windowed(events: DataFrame, at: str, size: str, by: str, late: str = "1 hour") -> DataFrame:
    """(window_start, by, events, value_sum) of tumbling windows; works on streams and tables."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(at, late)
    g = e.groupBy(F.window(at, size).alias("w"), by).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value_sum"))
    return g.select(F.col("w.start").alias("window_start"), by, "events", "value_sum")
