"""The test tables written as files of other formats and read back in byte ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions.session import new_folder
from sievemill.sources import lines, runs

from .inputs import SAMPLES_SQL as S
from .inputs import Catalog, rounded, samples

C = Catalog()


@C.add(S + " SELECT CAST(run_key AS VARCHAR) AS run_id, 'value' AS signal, idx, t, value FROM s")
def csv_round_trip(spark, sf):
    """events as CSV files of many runs, read back in byte ranges."""
    path = new_folder(spark, "csv")
    lines.write_csv_runs(samples(spark, sf), path)
    return runs.read_wave_csv(spark, f"{path}/*/*", key="run")


@C.add(S + " SELECT CAST(run_key AS VARCHAR) AS run_id, count(*) AS n, round(max(1e-4 * idx / n), 12) AS t_max, round(sum(1e-4 * idx / n * value), 6) AS weighted FROM (SELECT *, greatest(count(*) OVER (PARTITION BY run_key) - 1, 1) AS n FROM s) GROUP BY run_key")
def csv_without_time(spark, sf):
    """The same files read as tables without a time column of the asked name: samples spread evenly over the span."""
    path = new_folder(spark, "csv")
    lines.write_csv_runs(samples(spark, sf), path)
    read = runs.read_table_csv(spark, f"{path}/*/*", time="seconds", key="run").filter("signal = 'value'")
    out = read.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("t"), 12).alias("t_max"), F.round(F.sum(F.col("t") * F.col("value")), 6).alias("weighted"))
    return out


@C.add(S + " SELECT CAST(run_key AS VARCHAR) AS run_id, state AS signal, round(t, 6) AS t, round(value, 6) AS value FROM s")
def vcd_round_trip(spark, sf):
    """events as value change dumps, a scope a run and a variable an event type, read back in byte ranges."""
    path = new_folder(spark, "vcd")
    now = F.round(F.col("t") * 1e6).cast("long")
    lines.write_changes(samples(spark, sf).select("run_key", now.alias("now"), F.col("state").alias("signal"), "value"), path, "us")
    read = lines.read_changes(spark, f"{path}/*/*", scopes=True)
    return rounded(read.select(F.col("scope").alias("run_id"), "signal", "t", "value"))


@C.add(S + " SELECT CAST(run_key AS VARCHAR) AS run_id, idx, v.name, v.kind, CASE v.name WHEN 'time' THEN t ELSE value END AS value FROM s, (VALUES ('time', 'time'), ('v(out)', 'voltage')) AS v(name, kind)")
def raw_round_trip(spark, sf):
    """events as ASCII raw files, a plot a run, read back in byte ranges."""
    path = new_folder(spark, "raw")
    lines.write_points(samples(spark, sf), path)
    read = lines.read_points(spark, f"{path}/*/*", titles=True)
    return read.select(F.col("title").alias("run_id"), "idx", "name", "kind", "value")


QUERIES, ORACLES = C.queries, C.oracles
