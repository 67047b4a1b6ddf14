"""The test tables as runs of samples, checks, corners and graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.operators.sequence import number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one run a user: state is the event type, t seconds since the start of 2024."""
    e = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01', ts) / 1e6")
    rows = number_rows(e.select("user_id", "event_id", "ts", t.alias("t"), "value", F.col("event_type").alias("state")), "user_id", "ts", "event_id")
    return rows.select("run_key", "idx", "t", "value", "state")


#: The same for DuckDB, as a common table expression named s.
SAMPLES_SQL = """WITH s AS (SELECT user_id AS run_key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
  epoch_us(ts - TIMESTAMP '2024-01-01' + TIMESTAMP '1970-01-01') / 1e6 AS t, value, event_type AS state FROM events)"""


class Catalog:
    """Collects queries by name, each with its oracle."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums depend on their order in the last digits."""
    return df.select([F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
