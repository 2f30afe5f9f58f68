"""Corpus shards in Parquet, and the small files beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHAT = "array<struct<role: string, content: string>>"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, pf_idx: the folder's .parquet files in order of their names; .tmp files are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path")
    return found.withColumn("pf_idx", F.row_number().over(Window.orderBy("path")) - 1)  # a row per file


def read(spark: SparkSession, folder: str, split: str | None = None, text_col: str = "text") -> DataFrame:
    """text, path, pf_idx, row_index of all shards, or of one split: the last file is 'val', all others 'train'. A lone file leaves 'train' empty."""
    if split not in (None, "train", "val"):
        raise ValueError("split must be train or val")
    names = files(spark, folder).withColumn("last", F.max("pf_idx").over(Window.partitionBy(F.lit(0))))
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder).select(F.col(text_col).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    rows = rows.withColumn("name", F.element_at(F.split("file", "/"), -1))
    names = names.select(F.element_at(F.split("path", "/"), -1).alias("name"), "pf_idx", "last")
    out = rows.join(F.broadcast(names), "name")  # a row per file
    if split:
        out = out.where(F.col("pf_idx") == F.col("last") if split == "val" else F.col("pf_idx") < F.col("last"))
    return out.select("text", F.col("file").alias("path"), F.col("pf_idx").cast("int").alias("pf_idx"), "row_index")


class RowGroups(DataSource):
    """spark.read.format('textmill_row_groups'): one partition per row group of one column of the Parquet files of a folder, or of one file.

    Options: path; column ('text'); split ('train', 'val' or '' for all); rank and world: of each file the row groups rank, rank + world, ...; pf_idx and rg_idx: a cursor,
    in whose file reading begins at row group rg_idx + rank, while the files before are skipped.
    """

    @classmethod
    def name(cls) -> str:
        return "textmill_row_groups"

    def schema(self) -> str:
        return "text string, pf_idx int, rg_idx int, row int"

    def reader(self, schema) -> DataSourceReader:
        return _RowGroupReader(self.options)


class _RowGroupReader(DataSourceReader):
    def __init__(self, options):
        self.column = options.get("column", "text")
        self.folder, self.split = options["path"], options.get("split", "")
        self.rank, self.world = int(options.get("rank", 0)), int(options.get("world", 1))
        self.cursor = int(options.get("pf_idx", 0)), int(options.get("rg_idx", 0))

    def partitions(self):
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow.parquet as pq
        from pyarrow import fs

        # Any file system that pyarrow knows; `path` is a folder or one file.
        files, folder = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        if files.get_file_info(folder).type == fs.FileType.File:
            names = [folder]
        else:
            names = sorted(i.path for i in files.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and i.path.endswith(".parquet"))
        kept = range(len(names)) if not self.split else range(len(names) - 1) if self.split == "train" else range(max(0, len(names) - 1), len(names))
        kept = [f for f in kept if f >= self.cursor[0]]
        with ThreadPoolExecutor(32) as pool:  # footers are small and far away
            sizes = list(pool.map(lambda f: pq.ParquetFile(names[f], filesystem=files).num_row_groups, kept))
        out = []
        for f, n in zip(kept, sizes):
            first = self.rank + (self.cursor[1] if f == self.cursor[0] else 0)
            out += [InputPartition((names[f], f, g)) for g in range(first, n, self.world)]
        return out or [InputPartition(None)]

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        if partition.value is None:
            return
        path, f, g = partition.value
        files = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
        texts = pq.ParquetFile(path, filesystem=files).read_row_group(g, columns=[self.column]).column(0).combine_chunks().cast(pa.string())
        n = len(texts)
        if n:
            yield pa.RecordBatch.from_arrays([texts if isinstance(texts, pa.Array) else texts.chunk(0), pa.array([f] * n, pa.int32()), pa.array([g] * n, pa.int32()), pa.array(range(n), pa.int32())], names=["text", "pf_idx", "rg_idx", "row"])


def row_groups(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(RowGroups)
    return spark.read.format("textmill_row_groups").options(path=folder, **{k: str(v) for k, v in options.items()}).load()


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """messages from a file with one JSON array of messages a line; lines that can't be read give null."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", CHAT).alias("messages"))


def items(spark: SparkSession, path: str, schema: str = "query string, choices array<string>, gold int") -> DataFrame:
    return spark.read.schema(schema).json(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("word"))


def baselines(spark: SparkSession, path: str) -> DataFrame:
    """label, percent from a CSV file with the columns 'Eval Task' and 'Random baseline'."""
    return spark.read.option("header", True).csv(path).select(F.col("Eval Task").alias("label"), F.col("Random baseline").cast("double").alias("percent"))


def task_config(spark: SparkSession, path: str) -> DataFrame:
    """label, icl_task_type, dataset_uri, num_fewshot, continuation_delimiter (' ' where none is given) from a YAML file read on the driver."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("task_config() needs PyYAML") from e
    with open(path, encoding="utf-8") as file:
        tasks = yaml.safe_load(file)["icl_tasks"]
    rows = [(t["label"], t["icl_task_type"], t["dataset_uri"], int(t["num_fewshot"][0]), t.get("continuation_delimiter", " ")) for t in tasks]
    return spark.createDataFrame(rows, "label string, icl_task_type string, dataset_uri string, num_fewshot int, continuation_delimiter string")


def nested_rows(df: DataFrame, field: str = "train") -> DataFrame:
    """The fields of a struct column as columns."""
    return df.select(f"{field}.*")
