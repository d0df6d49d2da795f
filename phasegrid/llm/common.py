"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: What separates words: the ASCII white space of the contract's word pattern.
SPACES = " \t\n\x0b\x0c\r"
#: Java and RE2 spelling of one word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="phasegrid-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: it is computed once, and a lost executor loses nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows(batches: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[tuple[list, ...]]:
    """The columns of the batches as Python lists, few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield tuple(c.to_pylist() for c in part.columns)


def small_batches(spark: SparkSession, n: int = 1000) -> None:
    """Rows that hold whole texts go to Python n at a time, and 16 MB at a time, where the session still has Spark's defaults of ten and four times as many."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16777216b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """name, or a longer one that isn't taken (Spark doesn't tell names apart by case)."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def row_hash(docs: DataFrame) -> Column:
    """A hash of a row's columns; maps, which Spark doesn't hash, are left out."""
    return F.xxhash64(*[docs[c] for c, t in docs.dtypes if "map<" not in t and t != "variant"])


def first_by_id(docs: DataFrame) -> DataFrame:
    """One row of docs for each doc_id: the first by its hash."""
    n = fresh("n", docs.columns)
    return docs.withColumn(n, F.row_number().over(Window.partitionBy("doc_id").orderBy(row_hash(docs)))).where(F.col(n) == 1).drop(n)


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `place`, from 0, among the rows that equal them in `by`, ascending in `order` (nulls first), and `total`, how many those are.

    Rows are dealt out by ranges of both, so a key with a third of all rows is many tasks' work. A task numbers its own rows, and
    a key's rows in it are moved by those in the tasks before: a row for each task and key. rows are read twice, so
    they should be stored; the result is.
    """
    at, part = fresh("n", rows.columns), fresh("part", rows.columns)
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *by, *order).sortWithinPartitions(*by, *order)
    numbered = stored(dealt.withColumn(at, F.monotonically_increasing_id()), name).withColumn(part, F.shiftright(at, 33))
    runs = numbered.groupBy(*[F.col(c).alias(f"{c}_") for c in by], F.col(part).alias("part_")).agg(F.min(at).alias("first"), F.count("*").alias("size"))
    key = Window.partitionBy(*[f"{c}_" for c in by])
    runs = runs.withColumn("before", F.sum("size").over(key.orderBy("part_")) - F.col("size")).withColumn("total", F.sum("size").over(key))
    same = (F.col(part) == F.col("part_")) & reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by], F.lit(True))
    place = (F.col("before") + F.col(at) - F.col("first")).alias("place")
    return numbered.join(runs, same).select(*[F.col(c) for c in rows.columns], place, "total")


def with_mark(docs: DataFrame, name: str, mark: Callable[[str | None], int]) -> DataFrame:
    """docs with a long column made from each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([mark(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))
