"""Session building, and cutting of lineage into the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by cut() in this process, by the session's application id.
_written: dict[str, list[str]] = {}


def session(master: str | None = None, app: str = "textmill", **conf: str) -> SparkSession:
    """A session with the settings this library counts on; those given win, and a running session is kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = builder.config(map=settings).getOrCreate()
    reachable(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this machine only where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + os.path.join(tempfile.gettempdir(), "textmill-checkpoints")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again, so that it is computed once and a lost executor costs no recomputation.

    The files are removed when the process ends, or by release().
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(df: DataFrame) -> None:
    """Removes what cut() wrote for df, before the process ends: for rounds of which only the last is read again."""
    path, app = getattr(df, "_written_to", None), df.sparkSession.sparkContext.applicationId
    if path in _written.get(app, []):
        _written[app].remove(path)
        _delete(df.sparkSession, path)


def scratch_folder(spark: SparkSession) -> str:
    """A name for a new folder in the shared folder, removed when the process ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark).rstrip('/')}/textmill-{app}/{uuid.uuid4().hex}"
    if app not in _written:
        _written[app] = []
        atexit.register(_remove, spark, app)
    _written[app].append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove(spark: SparkSession, app: str) -> None:
    try:
        for path in _written.pop(app, []):
            _delete(spark, path)
    except Exception:  # the session has ended already
        pass


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where it has fewer: work in Python on a table of a few row groups then uses them all. Larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table of which at most `limit` may reach the driver; more raise ValueError."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, too many for the driver")
    return rows


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this library from where it lies, whatever their working directory; on a cluster it must lie there too, or be installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
