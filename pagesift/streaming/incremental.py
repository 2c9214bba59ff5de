"""Incremental runs over growing folders: the file source and its checkpoint replace hand-kept cursors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.functions.dom import chunk_pages
from pagesift.plans.stages import shared_folder
from pagesift.sources.sinks import open_collection, upsert


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1_000) -> DataFrame:
    """A parquet table, a folder or a single file, as a stream of its files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process all that is there, in batches, and stop; run again, only new files are processed."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", out).start()
    query.awaitTermination()


def incremental_best(spark: SparkSession, hits: DataFrame, folder: str | None = None) -> DataFrame:
    """Best similarity of every (page, class) over a stream of hits (page, label, similarity), kept as running state.

    The state is one row per page and class. A batch merges only the rows that changed
    into a collection, of which it rewrites the buckets they fall into; a repeated batch
    merges the same rows again and changes nothing.
    """
    folder = folder or f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    best = hits.groupBy("page", "label").agg(F.max("similarity").alias("best"), F.count(F.lit(1)).alias("hits"))
    schema = "page string, label int, best double, hits long"

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("pair", F.to_json(F.struct("page", "label"))).withColumn("batch", F.lit(number))
        upsert(spark, f"{folder}/best", rows, "pair", "batch", "label")

    run_available(best, "", f"{folder}/checkpoint", "update", keep)
    try:
        return open_collection(spark, f"{folder}/best").select("page", "label", "best", "hits")
    except FileNotFoundError:  # the stream had nothing
        return spark.createDataFrame([], schema)


def incremental_chunks(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Chunks of a stream of pages (source_file, html), appended batch by batch."""
    folder = folder or f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    run_available(chunk_pages(pages), f"{folder}/chunks", f"{folder}/checkpoint")
    return spark.read.schema("source_file string, chunk_index int, token_count int, document string").parquet(f"{folder}/chunks")
