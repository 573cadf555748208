"""Session helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Internal columns carry this prefix, so columns of the caller never clash with them.
P = "__pl_"

#: Words are runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows of a file, about, where a table is known to have few.
ROWS_A_FILE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="panelloom-")
            spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/panelloom/{label}-{uuid.uuid4().hex}"


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, path) as the JVM's objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


@functools.cache
def _malloc_trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # not glibc
        return None


def give_back() -> None:
    """Hands memory that Arrow and the C library hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _malloc_trim():
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after whose last batch the process gives memory back: it stays beside the tasks of later stages, idle but as large as it was."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def written(df: DataFrame, path: str, most_rows: int | None = None, **options) -> DataFrame:
    """The rows of df, kept as Parquet in the shared folder: lineage ends here and a lost executor costs nothing.

    Where df has at most most_rows rows, they make no more files than these need: on a local file system Hadoop starts two
    processes for each file, and every file is a task of its own for whoever reads the table.
    """
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // ROWS_A_FILE)))
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
