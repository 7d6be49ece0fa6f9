"""What several operators share: the shared folder, written tables and small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of characters that are not ASCII white space (fixed value).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch. Long texts then don't add up to large batches of many rows.
ARROW_BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one of a local master (tests), removed at exit."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gyrolens-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: name, with underscores before it until it is free."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_SCOPES: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES[-1:]:
        scope.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what new_path() named within it: for work whose result is written elsewhere by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back, so a lost executor loses nothing of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Deletes a table that materialise() wrote and that no later plan reads."""
    paths = [df_or_path] if isinstance(df_or_path, str) else {f.rpartition("/")[0] for f in df_or_path.inputFiles()}
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def release() -> None:
    """Hands memory that Arrow and the C library keep for later back to the system: workers outlive their tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)
