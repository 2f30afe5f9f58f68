"""Vocabularies, checkpoint metadata and metric logs: writing and reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.select("token_id", "bytes").coalesce(1).write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token_id int, bytes binary").parquet(path)


def checkpoint_name(step, rank=None):
    """The name of a step's metadata, or of a rank's part of it: columns or numbers."""
    step = F.lit(step) if isinstance(step, int) else step
    if rank is None:
        return F.format_string("meta_%06d.json", step)
    return F.format_string("part_%06d_rank%02d", step, F.lit(rank) if isinstance(rank, int) else rank)


def save_meta(meta: DataFrame, path: str) -> None:
    """Nested metadata, one JSON object a row, under step=<step>."""
    meta.withColumn("_step", F.col("step")).withColumnRenamed("_step", "at_step").write.mode("append").partitionBy("at_step").json(path)


def load_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).drop("at_step")


def latest_step(names: DataFrame, col: str = "name", pattern: str = r"model_(\d+)\.pt") -> DataFrame:
    """One row: the highest step among file names; null if there is none."""
    return names.agg(F.max(F.nullif(F.regexp_extract(col, pattern, 1), F.lit("")).cast("int")).alias("step"))


def log_metrics(rows: DataFrame, path: str) -> None:
    """Appends tag, key, value, step; partitioned by tag."""
    rows.select("tag", "key", F.col("value").cast("double").alias("value"), F.col("step").cast("long").alias("step")).write.mode("append").partitionBy("tag").parquet(path)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, value double, step long, tag string").parquet(path)


def by_step(rows: DataFrame, tags: list[str]) -> DataFrame:
    """A row per step, a column per tag; of repeated entries the last value by size counts."""
    return rows.groupBy("step").pivot("tag", tags).agg(F.max("value"))


def missing(wanted: DataFrame, landed: DataFrame, key: str = "name") -> DataFrame:
    """What is still to be fetched: a landing that is run again does nothing twice."""
    return wanted.join(landed.select(key), key, "left_anti")


def save_parts(parts: DataFrame, path: str) -> None:
    """Each rank's rows of a checkpoint under step=<step>/rank=<rank>; rank 0's metadata is save_meta()'s. parts: step, rank and anything else."""
    parts.repartition("step", "rank").write.mode("append").partitionBy("step", "rank").parquet(path)


def load_parts(spark: SparkSession, path: str, step: int, rank: int | None = None) -> DataFrame:
    """One step's rows, of all ranks or one; other partitions are not read."""
    rows = spark.read.parquet(path).where(F.col("step") == step)
    return rows if rank is None else rows.where(F.col("rank") == rank)


def land(wanted: DataFrame, folder: str, fetch, tries: int = 5, key: str = "name") -> DataFrame:
    """name, ok, tries, error: one row per wanted file. Files that have landed are skipped; the others are fetched on the executors.

    fetch(name) gives a file's bytes and may raise; it is called `tries` times at most. A file is written under another name and renamed, so that none is ever half there; running it again does nothing twice. folder: a
    path or address that pyarrow's file systems know, shared by all executors.
    """

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(base, recursive=True)
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                where, error, n = f"{base}/{name}", None, 0
                if files.get_file_info(where).type == fs.FileType.File:
                    rows.append((name, True, 0, None))
                    continue
                while n < tries:
                    n += 1
                    try:
                        content, partly = fetch(name), f"{where}.{uuid.uuid4().hex}.tmp"
                        with files.open_output_stream(partly) as out:
                            out.write(content)
                        files.move(partly, where)
                        error = None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                rows.append((name, error is None, n, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.int32(), pa.string()))], names=["name", "ok", "tries", "error"])

    return wanted.select(F.col(key).cast("string").alias("name")).where("name is not null").distinct().mapInArrow(run, "name string, ok boolean, tries int, error string")


def advance(spark: SparkSession, path: str, rows: DataFrame, pf_idx: int, rg_idx: int, epoch: int) -> None:
    """Writes rows together with the place behind them as one step: a folder that a reader sees only when it is whole."""
    last = cursor(spark, path)
    at = 0 if last is None else last["at"] + 1
    rows.withColumn("pf_idx", F.lit(pf_idx)).withColumn("rg_idx", F.lit(rg_idx)).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/at={at}")


def cursor(spark: SparkSession, path: str):
    """at, pf_idx, rg_idx, epoch of the last step written with advance(), or None."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # Only folders whose write was committed have the mark.
    done = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/at=*/_SUCCESS")) if files.exists(where) else []
    at = max((int(f.getPath().getParent().getName()[3:]) for f in done), default=None)
    if at is None:
        return None
    return spark.read.parquet(f"{path}/at={at}").select(F.lit(at).alias("at"), "pf_idx", "rg_idx", "epoch").first()
