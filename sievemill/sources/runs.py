"""Waveform runs: CSV in, partitioned Parquet tables as the container, profiles and exports.

The container is a directory of Parquet files partitioned by run_id and corner_id, rows sorted by signal and idx, so a
point read of one signal of one run prunes to its files and row groups. Columnar encodings take the place of hand-made
delta and quantization.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.functions.scalar import signal_kind, strip_kind
from sievemill.functions.session import numbered
from sievemill.sources.lines import number, read_wide_csv, stem


def read_wave_csv(spark: SparkSession, *patterns: str, run: Callable[[Column], Column] = stem, key: str | None = None) -> DataFrame:
    """Tall samples of CSV files, one run a file, by default named by its stem, or many, told by the column named key. The first column is time whatever its name; headers
    may differ from file to file; cells that are no number are missing; no file at all is an error. Long files are read
    in byte ranges."""
    wide = read_wide_csv(spark, *patterns, run=run, key=key)
    few = F.raise_error(F.concat(F.col("run_id"), F.lit(": a time column and one signal at least are needed")))
    names = F.when(F.size("names") < 2, few.cast("array<string>")).otherwise(F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(1))))
    each = wide.select("run_id", "idx", number(F.col("cells")[0]).alias("t"), "cells", F.posexplode(names).alias("_k", "signal"))
    return each.select("run_id", "signal", "idx", "t", number(F.get("cells", F.col("_k") + 1)).alias("value"))


def read_table_csv(spark: SparkSession, pattern: str, time: str = "time", span: float = 1e-4, run: Callable[[Column], Column] = stem, key: str | None = None) -> DataFrame:
    """Tall samples of CSV files with a header, one run a file or many, told by the column named key. Without the named time column the samples of a run are spread evenly
    over the span; cells that are no number are missing. Long files are read in byte ranges."""
    wide = read_wide_csv(spark, pattern, run=run, key=key).withColumn("_at", F.array_position("names", time))
    even = F.lit(span) * F.col("idx") / F.greatest(F.col("total") - 1, F.lit(1))
    t = F.when(F.col("_at") > 0, number(F.get("cells", (F.col("_at") - 1).cast("int")))).otherwise(even)
    each = wide.select("run_id", "idx", t.alias("t"), "cells", "_at", F.posexplode("names").alias("_k", "signal")).filter("_k <> _at - 1")
    return each.select("run_id", "signal", "idx", "t", number(F.get("cells", F.col("_k"))).alias("value"))


def read_frequency_csv(spark: SparkSession, path: str, freq: str = "freq", real: str = "real", imag: str | None = "imag") -> DataFrame:
    """w, re and im of a response; without an imaginary column it is 0. A missing column is an error that lists those
    that are there."""
    raw = spark.read.option("header", True).csv(path)
    for c in (freq, real, *([imag] if imag else [])):
        if c not in raw.columns:
            raise ValueError(f"{c} not found in {path}; columns: {', '.join(raw.columns)}")
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    return raw.select(number(freq).alias("w"), number(real).alias("re"), (number(imag) if imag else F.lit(0.0)).alias("im"))


def write_predictions(df: DataFrame, path: str, pairs: dict[str, str]) -> None:
    """Features with each target, its prediction and the error in per cent of the target (null for 0)."""
    errors = [(100.0 * (F.col(p) - F.col(y)) / F.abs(F.nullif(F.col(y), F.lit(0.0)))).alias(f"{y}_err_pct") for y, p in pairs.items()]
    write_csv(df.select("*", *errors), path)


def check_runs(keys: DataFrame) -> DataFrame:
    """keys (run_id, corner_id, ...) unchanged; raises where a pair stands more than once."""
    twice = keys.groupBy("run_id", "corner_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(3).collect()
    if twice:
        raise ValueError("runs given more than once: " + ", ".join(f"{r['run_id']}@{r['corner_id']}" for r in twice))
    return keys


def number_runs(samples: DataFrame, corner: str = "") -> DataFrame:
    """run_number by run_id order, corner_id as given: the runs dimension."""
    runs = samples.groupBy("run_id").agg(F.countDistinct("signal").alias("n_signals"), F.countDistinct("idx").alias("ntime"))
    return numbered(runs, "run_number", "run_id").withColumn("run_number", (F.col("run_number") + 1).cast("int")).withColumn("corner_id", F.lit(corner))


def write_runs(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """samples (run_id, corner_id, signal, idx, t, value); raises on an existing path unless mode is overwrite."""
    (samples.repartition("run_id", "corner_id", "signal").sortWithinPartitions("run_id", "corner_id", "signal", "idx").write.mode(mode).partitionBy("run_id", "corner_id").parquet(path))


RUN_SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("signal", T.StringType()), ("idx", T.IntegerType()), ("t", T.DoubleType()), ("value", T.DoubleType()), ("run_id", T.StringType()), ("corner_id", T.StringType()))])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path).na.fill("", ["corner_id"])


def append_runs(samples: DataFrame, path: str) -> None:
    """Adds runs; raises if a (run_id, corner_id) pair is there already."""
    spark = samples.sparkSession
    keys = lambda df: df.select("run_id", "corner_id").distinct()
    clash = keys(samples).join(keys(read_runs(spark, path)), ["run_id", "corner_id"], "left_semi").limit(3).collect()
    if clash:
        raise ValueError("runs exist already: " + ", ".join(f"{r['run_id']}@{r['corner_id']}" for r in clash))
    write_runs(samples, path, "append")


def select_runs(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All runs, or those named `run` or `run@corner`; raises for names that match nothing or, without a corner, more
    than one corner."""
    if keys is None:
        return samples
    have = samples.select("run_id", "corner_id").distinct()
    asked = samples.sparkSession.createDataFrame([(k, k.split("@")[0], k.split("@")[1] if "@" in k else None) for k in keys], "k string, run_id string, c string")
    j = asked.join(have, "run_id", "left").filter("c IS NULL OR c = corner_id OR corner_id IS NULL")
    counts = {r["k"]: r["n"] for r in j.groupBy("k").agg(F.count("corner_id").alias("n")).collect()}  # one row a name
    wrong = [k for k in keys if counts.get(k, 0) != 1]
    if wrong:
        raise ValueError("unknown or ambiguous runs: " + ", ".join(wrong))
    return samples.join(F.broadcast(j.select("run_id", "corner_id").distinct()), ["run_id", "corner_id"], "left_semi")


def profile(samples: DataFrame) -> DataFrame:
    """Per run: time span, samples, signals and the share of samples that changed."""
    from pyspark.sql import Window

    changed = (~F.col("value").eqNullSafe(F.lag("value").over(Window.partitionBy("run_id", "corner_id", "signal").orderBy("idx")))).cast("int")
    return samples.withColumn("_c", changed).groupBy("run_id", "corner_id").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.count(F.lit(1)).alias("samples"), F.countDistinct("signal").alias("signals"), (100.0 * F.sum("_c") / F.count(F.lit(1))).alias("changed_pct"))


def run_matrix(samples: DataFrame, signals: list[str]) -> DataFrame:
    """One column a requested signal; one that a run lacks is null there."""
    return samples.groupBy("run_id", "corner_id", "idx").pivot("signal", signals).agg(F.first("value"))


def signal_names(samples: DataFrame) -> DataFrame:
    """Base names by kind, with the runs that have them."""
    return samples.groupBy(strip_kind(F.col("signal")).alias("base"), signal_kind(F.col("signal")).alias("kind")).agg(F.sort_array(F.collect_set("run_id")).alias("runs"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def state_parameters(rows: DataFrame) -> DataFrame:
    """Long parameter table (corner, state, param, value; null state: the baseline) -> value and change against the
    baseline, changes of nothing left out; raises for a state without a baseline."""
    base = rows.filter("state IS NULL").select("corner", "param", F.col("value").alias("base"))
    j = rows.filter("state IS NOT NULL").join(base, ["corner", "param"], "left").withColumn("delta", F.col("value") - F.col("base"))
    if j.filter("base IS NULL").limit(1).count():
        raise ValueError("a state has no baseline")
    return j.filter("delta <> 0").select("corner", "state", "param", "value", "delta")
