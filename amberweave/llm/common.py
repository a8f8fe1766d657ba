"""Shared helpers of the training-data operators: scratch tables, sizes, ASCII case."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two or three longs; a broadcast of more is never asked for (about 8 MB).
BROADCAST_ROWS = 200_000
#: The same for rows of one long.
LONGS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; where none is set and all runs on this machine, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="amberweave-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Intermediate tables as Parquet in the shared folder; they cut the lineage.

    Tables the result still reads stay until the JVM ends; others go with free().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._path(self.base)[1].deleteOnExit(self._path(self.base)[0])

    def _path(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def free(self, name: str) -> None:
        """Delete a table; shuffle files and broadcasts of its jobs go too."""
        p, fs = self._path(f"{self.base}/{name}")
        fs.delete(p, True)
        self.sweep()

    def sweep(self) -> None:
        """Shuffle files and broadcasts of jobs that have ended go: Spark drops them once the driver has collected its garbage."""
        self.spark._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has at most so many rows (read from Parquet footers)."""
    return df.count() <= rows


def lookup(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a written table of checked size; otherwise leave the join to shuffle."""
    return F.broadcast(df) if small(df, rows) else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is used where the text is ASCII, since it is faster."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def cut(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many: text rows can be long, and what is worked out for a batch is held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
