"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see.

    Only a session on one machine (a test, a notebook) that has none set gets a folder under its own warehouse.
    """
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with an eager checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CREATED: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    _CREATED.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _CREATED[-1]


def stored(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back; remove_stored deletes it."""
    path = new_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession) -> int:
    """Deletes the tables that this process has written so far, once no result that reads them is needed; their number."""
    n = len(_CREATED)
    while _CREATED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_CREATED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def batches_of(values: list, sizes: list[int], most: int) -> Iterator[list]:
    """Splits values in order into runs of about `most` summed size, one value at least."""
    run, total = [], 0
    for value, size in zip(values, sizes):
        if run and total + size > most:
            yield run
            run, total = [], 0
        run.append(value)
        total += size
    if run:
        yield run


def id_remainder(divisor: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text modulo divisor; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor, F.lit(-1))
