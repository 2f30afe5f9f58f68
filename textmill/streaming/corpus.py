"""The corpus as a stream of arriving shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import PATTERN, words


def arriving(spark: SparkSession, folder: str, schema: str = "text string", files_per_trigger: int = 16) -> DataFrame:
    """Rows of the .parquet files of a folder (or of a single file) as they arrive. The query's checkpoint is the cursor: a restarted query goes on behind the last committed file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(where) and files.getFileStatus(where).isFile():
        folder = f"{folder[:-1]}[{folder[-1]}]"  # as a pattern: a plain path must be a folder
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def word_histogram(stream: DataFrame, text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    return stream.select(F.explode(words(F.col(text_col), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def keep_histogram(stream: DataFrame, path: str, checkpoint: str, text_col: str = "text") -> StreamingQuery:
    """Adds each batch's own counts to a Parquet table as batch=<id>, overwritten if the batch is run again; summed_histogram() adds them up. State grows with the output only."""

    def write(batch: DataFrame, number: int) -> None:
        word_histogram(batch, text_col).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summed_histogram(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("word").agg(F.sum("n").alias("n"))


def event_counts(stream: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Counts per window and kind, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
