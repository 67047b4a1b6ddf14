"""Shared helpers: the folder that all executors see, written intermediate tables, text defaults."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and the session is local, as
    in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="sievemill-")
        shared_dir.own = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a row group of intermediate tables: what a task's writer holds.
ROW_GROUP = 32 << 20
#: Where the tables are that materialise wrote.
WRITTEN: dict[int, str] = {}


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends there, so a lost
    executor costs a re-read and rows made by non-deterministic task attempts stay fixed."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    WRITTEN[id(out)] = path
    weakref.finalize(out, WRITTEN.pop, id(out), None)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that materialise wrote and that no later step reads."""
    for df in tables:
        if df is not None and (path := WRITTEN.pop(id(df), None)):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_of(column: str | Column = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def input_partitions(df: DataFrame) -> int:
    """Number of tasks that will scan df: a size measure that costs no job."""
    return max(1, df.rdd.getNumPartitions())


#: Rows and bytes of text that a Python worker is handed at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def give_back() -> None:
    """Freed memory goes back to the system: workers are reused, and what one stage held should not weigh on the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def size_in_bytes(text: str) -> int:
    """A Spark size setting: bytes, or a number with k, m, g or t and an optional b."""
    t = text.strip().lower().removesuffix("b")
    unit = "kmgt".find(t[-1:]) + 1 if t[-1:] else 0
    return int(float(t[:-1] if unit else t) * 1024**unit)


def small_batches(spark: SparkSession) -> None:
    """Batches for Python small enough for long texts; a smaller setting of the session stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < size_in_bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _returning(f):
    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def pandas_map(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """mapInPandas in small batches. Nullable integers would pass through floats: hand ids over as strings."""
    small_batches(df.sparkSession)
    return df.mapInPandas(_returning(f), schema)


def column_map(spark: SparkSession, f: Callable[[Iterator[pd.Series]], Iterator[pd.Series]], returns: str):
    """f over the batches of one column, as a column function: all other columns stay in the JVM as they are."""
    small_batches(spark)
    own = _returning(f)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from own(batches)

    return F.pandas_udf(run, returns)


def struct_map(spark: SparkSession, f: Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]], returns: str):
    """As column_map, for several values a row."""
    small_batches(spark)
    own = _returning(f)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from own(batches)

    return F.pandas_udf(run, returns)
