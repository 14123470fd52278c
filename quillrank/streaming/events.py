"""Streams of interactions: windowed counts, late duplicates dropped, an append log with the last state kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.runtime import shared_folder


def stream(spark: SparkSession, path: str, files_at_once: int = 64) -> DataFrame:
    """New Parquet files of a folder as they come, with the schema of those that are there; or one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent().toString()))
    return reader.parquet(path)


def counted(events: DataFrame, time: str, key: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """``start, key, n``: events per window and key; rows later than ``late`` are left out."""
    rows = events.select(F.col(time).cast("timestamp").alias("ts"), F.col(key).alias("key")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window).alias("w"), "key").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "key", "n")


def once(events: DataFrame, time: str, key: str, late: str = "2 hours") -> DataFrame:
    """Each key's first delivery; a copy within ``late`` of it is dropped."""
    return events.withColumn("ts", F.col(time).cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_end(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Handles all that is there and stops. In mode complete the result is the whole state after the last batch, else
    all that was emitted; it is a table in the shared folder, as is the stream's own checkpoint."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/batches/n={number}")

    query = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(df.schema).option("basePath", f"{place}/batches").parquet(f"{place}/batches") if mode != "complete" else None
    if rows is None:
        last = max((p["batchId"] for p in query.recentProgress), default=0)
        rows = spark.read.schema(df.schema).parquet(f"{place}/batches/n={last}")
    return rows


def keep_latest(df: DataFrame, key: str, order: str, table_path: str, checkpoint: str):
    """An append log: every micro-batch is added with its number, and :func:`latest` reads the last state of each key."""

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(table_path)

    return df.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, key: str, order: str, table_path: str) -> DataFrame:
    from quillrank.operators.snapshot import one_per_key

    return one_per_key(spark.read.parquet(table_path), [key], [F.col(order).desc(), F.col("_batch").desc()]).drop("_batch")
