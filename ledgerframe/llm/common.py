"""Shared helpers: work folders, table access and deterministic splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may have none: there a temporary folder is set.  On a cluster
    a folder of one machine would lose data, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")  # the session's own subfolder


def work_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/ledgerframe/{tag}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Within it, the shuffles behind a query that has ended are deleted (a setting of Spark's)."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def _written(df: DataFrame, tag: str, compression: str, by: str | None = None) -> str:
    path = work_path(df.sparkSession, tag)
    with shuffles_cleaned(df.sparkSession):
        out = df.write.option("compression", compression)
        (out.partitionBy(by) if by else out).parquet(path)
    return path


def cut(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts lineage so that a lost executor costs a re-read, not a re-run.  The shuffles
    behind the table go with the write (a setting of Spark's, on for the write alone).
    """
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, tag, compression))


class Scratch:
    """The written tables of one job; those not handed out are deleted when they are not needed any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.names = spark, {}, {}

    def cut(self, df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
        """As ``cut``, in folders by the values of ``by``; the table lives until ``drop`` or the end of the job."""
        path = _written(df, tag, "zstd", by)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def cut_placed(self, df: DataFrame, tag: str, column: str, buckets: int) -> DataFrame:
        """As ``cut``, bucketed by ``column``: a later grouping by it in as many partitions moves no row."""
        path = work_path(self.spark, tag)
        name = "ledgerframe_" + path.rpartition("-")[2]
        with shuffles_cleaned(self.spark):
            df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
        out = self.spark.table(name)
        self.paths[id(out)] = (path, out)
        self.names[path] = name
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if id(table) in self.paths:
                self._delete(self.paths.pop(id(table))[0])

    def drop_parts(self, table: DataFrame, *folders: str) -> None:
        """Deletes some folders of a table that was cut ``by`` a column."""
        for folder in folders:
            self._delete(f"{self.paths[id(table)][0]}/{folder}")

    def keep(self, *tables: DataFrame) -> None:
        """These outlive the job."""
        for table in tables:
            self.paths.pop(id(table), None)

    def _delete(self, path: str) -> None:
        if path in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(path)}")
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path, _table in self.paths.values():
            self._delete(path)
        self.paths.clear()


def sliced(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes (a row at least), in order.

    What a Python worker makes of a batch (texts, results) is then small at any time, and
    the memory that Arrow keeps is given back at the end, for workers outlive their tasks.
    """
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(most, batch.nbytes))
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def crc_mod(column: str, modulus: int) -> Column:
    """crc32(column as text) mod ``modulus``; a null column counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus



def unused(names: list[str], name: str = "_own") -> str:
    """A column name that is not among ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    while name in taken:
        name += "_"
    return name
