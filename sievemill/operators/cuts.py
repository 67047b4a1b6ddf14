"""Long runs cut into pieces that tasks share: pieces with a margin of their neighbours, and filling across pieces.

Rows are numbered from 0 within their run (idx). A piece is `size` rows; windows partitioned by run and piece then see
the margin they need, and a run that holds a third of all rows is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.session import cut

SIZE = 4096
#: Runs of at most so many rows may be one array in a task; longer ones are cut.
WHOLE = 1 << 14


def by_length(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys with at most so many rows, and those of the others, None without any. The keys of these are at
    most one to each `most` rows, so they are sent to all tasks. Rows without a key are left out."""
    rows = rows.filter(F.col(key).isNotNull())
    long = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(key))
    if long.isEmpty():
        return rows, None
    return rows.join(F.broadcast(long), key, "left_anti"), rows.join(F.broadcast(long), key, "left_semi")


def run_by_run(rows: DataFrame, key: str, order: str, kernel: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """kernel(rows of some runs, in order; where each begins and the last ends) over runs of bounded length: many short
    runs reach Python in one batch, and of one that goes on in the next batch the rows are kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            keys = pdf[key].to_numpy()
            ends = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
            if ends[-1]:
                yield kernel(pdf.iloc[: ends[-1]], ends)
            rest = pdf.iloc[ends[-1] :].reset_index(drop=True)
        if rest is not None:
            yield kernel(rest, np.array([0, len(rest)]))

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def with_halo(rows: DataFrame, before: int, after: int = 0, size: int = SIZE) -> DataFrame:
    """rows with piece and own: each row in its own piece, and (own false) in the next or last one where it lies within
    `before` rows ahead of it or `after` rows behind it."""
    size = max(size, before, after)
    piece, place = F.floor(F.col("idx") / size), F.col("idx") % size
    near = F.array(piece, F.when(place >= size - before, piece + 1), F.when((place < after) & (piece > 0), piece - 1))
    return rows.withColumn("piece", F.explode(F.array_compact(near))).withColumn("own", F.col("piece") == F.floor(F.col("idx") / size))


def filled(rows: DataFrame, key: str, column: str = "value", size: int = SIZE) -> DataFrame:
    """Missing values (null or NaN) filled linearly by idx; those at the ends take the nearest; a run without any value
    stays null. Only the last and first values of pieces cross from piece to piece."""
    have = F.when(F.col(column).isNotNull() & ~F.isnan(column), F.struct(F.col("idx").alias("at"), F.col(column).cast("double").alias("x")))
    pieces = rows.withColumn("_piece", F.floor(F.col("idx") / size)).withColumn("_have", have)
    by = Window.partitionBy(key, "_piece").orderBy("idx")
    up, down = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    pieces = pieces.withColumn("_left", F.last("_have", ignorenulls=True).over(up)).withColumn("_right", F.first("_have", ignorenulls=True).over(down))
    ends = pieces.groupBy(key, "_piece").agg(F.max("_have").alias("_last"), F.min("_have").alias("_first"))
    over = Window.partitionBy(key).orderBy("_piece")
    ends = ends.withColumn("_before", F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("_after", F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)))
    j = pieces.join(ends.select(key, "_piece", "_before", "_after"), [key, "_piece"])
    left, right = F.coalesce("_left", "_before"), F.coalesce("_right", "_after")
    between = left["x"] + (right["x"] - left["x"]) * (F.col("idx") - left["at"]) / (right["at"] - left["at"])
    value = F.when(F.col("_have").isNotNull(), F.col("_have.x")).when(left.isNull(), right["x"]).when(right.isNull(), left["x"]).otherwise(between)
    return j.withColumn(column, value).select(rows.columns)
