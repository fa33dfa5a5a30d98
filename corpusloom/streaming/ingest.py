"""Incremental ingestion as a file stream: every file once, redelivered rows once, latest state per key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def working_folder(spark: SparkSession, name: str) -> str:
    """A folder for checkpoints and sinks below the shared one that the cluster names, or a temporary one on a local master."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"corpusloom-{name}-")


def file_stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``, one file or a folder of files, as a stream."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def deduplicated_stream(spark: SparkSession, source: str, name: str, schema: str, key: str, at: str, lateness: str) -> DataFrame:
    """All rows of the Parquet table ``name`` in ``source``, each ``key`` once, read as a stream until nothing is left.

    A row that comes again within ``lateness`` of event time is dropped by the state store, which the watermark keeps
    bounded. The sink commits whole batches; a restart repeats none.
    """
    folder = working_folder(spark, "ingest")
    stream = file_stream(spark, source, name, schema).where(F.col(key).isNotNull())
    unique = stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])
    writer = unique.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def windowed_counts(spark: SparkSession, source: str, name: str, schema: str, at: str, kind: str, width: str, lateness: str) -> DataFrame:
    """``window_start, kind, n``: rows per tumbling window and kind, by a watermarked streaming aggregation."""
    folder = working_folder(spark, "windows")
    stream = file_stream(spark, source, name, schema).withWatermark(at, lateness)
    counts = stream.groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(store).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("window_start", kind).agg(F.max(F.struct("batch", "n")).alias("r"))
    return last.select("window_start", kind, F.col("r.n").alias("n"))
