"""Where loops cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and the session is local, as in tests."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sievemill-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for files that all executors see; the checkpoint folder should be emptied between jobs."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df from files that every executor can read again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes that a Python worker is handed at once where rows are large.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows that hold blocks reach Python a few at a time: Spark's own bound is 64 MB; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    value = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < value <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: Most rows of a table that is sent to all tasks.
SENT = 1 << 20


def written(df: DataFrame) -> DataFrame:
    """As cut, by a Parquet table: smaller, and its size is known to later joins."""
    path = new_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame) -> DataFrame:
    """A written table that joins send to all tasks, unless it is too large for that."""
    df = written(df)
    return F.broadcast(df) if df.count() <= SENT else df


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with its place, from 0, in the given order: sorted by ranges and counted range by range, so no task sees all
    rows. The order should be total."""
    place = F.monotonically_increasing_id()  # range number times 2^33 and the place in the range
    done = cut(df.orderBy(*order).withColumn("_place", place))
    rank = F.shiftright("_place", 33)
    sizes = done.groupBy(rank.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_start"))
    return done.withColumn("_range", rank).join(starts, "_range").withColumn(name, F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, name)


def numbered_in(df: DataFrame, key: str, name: str, *order: str) -> DataFrame:
    """df with its place, from 0, within its key: sorted by ranges of key and order, so a key with many rows is cut over
    tasks, and counted range by range. The order should be total within a key. Rows are shuffled once, unless there are
    more keys than may be sent to all tasks."""
    done = written(df.orderBy(key, *order).withColumn("_place", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_place", 33))
    parts = done.groupBy(key, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sent(parts.withColumn("_start", before).select(F.col(key).alias("_key"), "_range", "_first", "_start"))
    j = done.join(starts, (F.col(key).eqNullSafe(F.col("_key"))) & (done["_range"] == starts["_range"]))
    return j.withColumn(name, F.col("_start") + F.col("_place") - F.col("_first")).select(*df.columns, name)


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df to be sent to all tasks; raises for more rows than that is meant for."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a dimension of at most {most} rows is needed here")
    return F.broadcast(df)
