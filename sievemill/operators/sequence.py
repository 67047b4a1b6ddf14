"""Window and sequence operators over runs of samples.

Samples are a tall table: run_key, idx (rising within a run), t (seconds), value and, where needed, state. Every window
is partitioned by run_key, so no operator sees across the seam of two runs, and operators over one run share a single
exchange. NaN counts as missing: `clean` turns it into null at the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_run() -> WindowSpec:
    return Window.partitionBy("run_key").orderBy("idx")


def up_to() -> WindowSpec:
    return by_run().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def clean(samples: DataFrame, column: str = "value") -> DataFrame:
    return samples.withColumn(column, F.when(~F.isnan(column), F.col(column)))


def number_rows(df: DataFrame, run: str, *order: str) -> DataFrame:
    """run_key and idx from 0 in the given order. The name is given after the window, so that Spark knows the result as
    partitioned by run_key and later windows need no exchange."""
    w = Window.partitionBy(run).orderBy(*order)
    numbered = df.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))
    return numbered.withColumnRenamed(run, "run_key")


def forward_fill(samples: DataFrame, column: str = "value") -> DataFrame:
    """Zero-order hold: a missing value takes the last one before it; none before stays null."""
    return samples.withColumn(column, F.last(column, ignorenulls=True).over(up_to()))


def decode_changes(grid: DataFrame, changes: DataFrame) -> DataFrame:
    """Dense samples from stored change points (run_key, idx, value) on a grid (run_key, idx)."""
    return forward_fill(grid.select("run_key", "idx").join(changes.select("run_key", "idx", "value"), ["run_key", "idx"], "left"))


def time_slice(samples: DataFrame, low: float, high: float) -> DataFrame:
    """Inclusive range of times; filling comes first, or the value held at the start is lost."""
    return forward_fill(samples).filter(F.col("t").between(low, high))


def resolve_tolerance(samples: DataFrame, absolute: float, relative: float) -> DataFrame:
    """Per run the larger of the absolute tolerance and the relative share of the range; 1e-9 where that is none."""
    span = F.max("value") - F.min("value")
    tol = F.greatest(F.lit(absolute), F.lit(relative) * span)
    return samples.groupBy("run_key").agg(F.when(tol > 0, tol).otherwise(1e-9).alias("tol"))


def change_points(samples: DataFrame, tolerance: float) -> DataFrame:
    """Samples that differ by more than the tolerance from the last one kept; the first and last of a run are always
    kept, and all of them if the tolerance is not positive. Each decision rests on the one before, so a run is walked
    in order, batch by batch, with the last kept value carried over: a task holds one batch, however long the run."""
    if tolerance <= 0:
        return samples.select("run_key", "idx", "value")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, begun, tail = 0.0, False, None
        for pdf in batches:
            value, kept = pdf["value"].tolist(), []
            for i, x in enumerate(value):
                if not begun or abs(x - last) > tolerance:
                    kept.append(i)
                    last, begun = x, True
            tail = None if kept and kept[-1] == len(value) - 1 else pdf.iloc[-1:]
            yield pdf.iloc[kept]
        if tail is not None:
            yield tail

    kind = dict(samples.dtypes)
    rows = samples.select("run_key", "idx", "value").repartition("run_key").sortWithinPartitions("run_key", "idx")
    return rows.groupBy("run_key").applyInPandas(walk, f"run_key {kind['run_key']}, idx {kind['idx']}, value double")


def with_islands(samples: DataFrame, state: str = "state") -> DataFrame:
    """island: number, from 0, of the maximal stretch of one state that a sample lies in."""
    new = F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(by_run()))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(by_run()) == 1, 0).otherwise(new)
    return samples.withColumn("_new", first).withColumn("island", F.sum("_new").over(up_to()).cast("int")).drop("_new")


def islands(samples: DataFrame, state: str = "state") -> DataFrame:
    """One row a stretch: first and last idx, samples, start and end time."""
    return (
        with_islands(samples, state)
        .groupBy("run_key", "island", F.col(state).alias("state"))
        .agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("n"), F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    )


def dwell(samples: DataFrame, settling: float, times: float = 3.0) -> DataFrame:
    """Stretches with their dwell, samples times the run's median step, and whether it is `times` the settling time."""
    step = samples.withColumn("dt", F.col("t") - F.lag("t").over(by_run())).groupBy("run_key").agg(F.median("dt").alias("dt"))
    held = islands(samples).join(step, "run_key").withColumn("dwell", F.col("n") * F.coalesce("dt", F.lit(0.0)))
    return held.select("run_key", "island", "state", "n", "dwell", (F.col("dwell") >= times * settling).alias("sufficient"))


def longest_island(samples: DataFrame) -> DataFrame:
    """The longest stretch of each run and state, the first of equals."""
    w = Window.partitionBy("run_key", "state").orderBy(F.desc("n"), "first_idx")
    return islands(samples).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("run_key", "state", "first_idx", "n")


def state_slices(samples: DataFrame, least: int = 20) -> DataFrame:
    """Samples of stretches that have at least so many."""
    n = F.count(F.lit(1)).over(Window.partitionBy("run_key", "island"))
    return with_islands(samples).withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def transition_time(samples: DataFrame, share: float = 0.05, default: float = 1e-6, floor: float = 1e-12) -> DataFrame:
    """Per run a share of the median dwell of its stretches."""
    d = dwell(samples, 0.0).groupBy("run_key").agg(F.median("dwell").alias("d"))
    return d.select("run_key", F.greatest(F.when(F.col("d") > 0, F.col("d") * share).otherwise(default), F.lit(floor)).alias("transition_time"))


def binarize(samples: DataFrame) -> DataFrame:
    """bit: above the middle of the run's range (missing counts as the minimum); a flat run is above 0.5 or not."""
    whole = Window.partitionBy("run_key")
    lo, hi = F.min("value").over(whole), F.max("value").over(whole)
    firm = F.first("value", ignorenulls=True).over(by_run().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bit = F.when(hi - lo < 1e-9, firm > 0.5).otherwise(F.coalesce("value", lo) > (lo + hi) / 2)
    return samples.withColumn("bit", F.coalesce(bit, F.lit(False)).cast("int"))


def edges(samples: DataFrame) -> DataFrame:
    """Samples at which the binarized value changed: idx of the new sample and direction."""
    before = F.lag("bit").over(by_run())
    return binarize(samples).withColumn("rise", F.col("bit") - before).filter("rise <> 0").select("run_key", "idx", "t", "rise")


def edge_windows(samples: DataFrame, width: int, guard: int) -> DataFrame:
    """For each edge the means of `width` samples before and after it, `guard` samples away: frames, not a range join."""
    before, after = by_run().rowsBetween(-width - guard + 1, -guard), by_run().rowsBetween(guard, guard + width - 1)
    marked = binarize(samples).withColumn("rise", F.col("bit") - F.lag("bit").over(by_run()))
    marked = marked.withColumn("before", F.avg("value").over(before)).withColumn("after", F.avg("value").over(after))
    return marked.filter("rise <> 0").select("run_key", "idx", "rise", "before", "after", (F.col("after") - F.col("before")).alias("shift"))


def windowed_features(samples: DataFrame, k: int) -> DataFrame:
    """Mean, population deviation and slope of k equal windows of a run; the tail of n mod k samples is left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy("run_key"))
    cut = samples.withColumn("size", F.floor(n / k)).filter("size > 0")
    cut = cut.withColumn("win", F.floor(F.col("idx") / F.col("size")).cast("int")).filter(F.col("win") < k)
    cut = cut.withColumn("x", F.when(F.col("value").isNotNull(), F.col("idx") % F.col("size")).cast("double"))
    slope = F.regr_slope("value", "x")
    return cut.groupBy("run_key", "win").agg(*[F.coalesce(c, F.lit(0.0)).alias(a) for c, a in ((F.avg("value"), "mean"), (F.stddev_pop("value"), "std"), (slope, "slope"))])


def mid_rail_dwell(samples: DataFrame, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """Share of a run's time that its value, scaled to the overall range, spends strictly between the two levels."""
    span = samples.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    weight = F.greatest(F.coalesce(F.lead("t").over(by_run()) - F.col("t"), F.lit(0.0)), F.lit(0.0))
    scaled = samples.withColumn("w", weight).join(F.broadcast(span)).withColumn("z", (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    inside = F.sum(F.when((F.col("z") > low) & (F.col("z") < high), F.col("w")).otherwise(0.0))
    return scaled.groupBy("run_key").agg((inside / F.sum("w")).alias("mid_share"))


def classify_digital(samples: DataFrame, mean_below: float = 0.05, max_below: float = 0.5) -> DataFrame:
    """One row: mean and largest mid-rail share over the runs, and whether both say digital."""
    m = mid_rail_dwell(samples).agg(F.avg("mid_share").alias("mean_share"), F.max("mid_share").alias("max_share"))
    return m.withColumn("digital", (F.col("mean_share") < mean_below) & (F.col("max_share") < max_below))


def gradient(samples: DataFrame) -> DataFrame:
    """Second-order derivative estimate on uneven steps, one-sided at the ends of a run."""
    v, t = F.col("value"), F.col("t")
    a, b = t - F.lag("t").over(by_run()), F.lead("t").over(by_run()) - t
    left, right = (v - F.lag("value").over(by_run())) / a, (F.lead("value").over(by_run()) - v) / b
    return samples.withColumn("slope", F.when(a.isNull(), right).when(b.isNull(), left).otherwise((left * b + right * a) / (a + b)))


def cumulative_trapezoid(samples: DataFrame) -> DataFrame:
    """Running integral of value over t, 0 at the first sample of a run."""
    area = (F.col("value") + F.lag("value").over(by_run())) / 2 * (F.col("t") - F.lag("t").over(by_run()))
    return samples.withColumn("_a", F.coalesce(area, F.lit(0.0))).withColumn("integral", F.sum("_a").over(up_to())).drop("_a")


def median3(samples: DataFrame) -> DataFrame:
    """Median of a sample and its neighbours, zeros beyond the ends of a run."""
    near = F.array(F.coalesce(F.lag("value").over(by_run()), F.lit(0.0)), F.col("value"), F.coalesce(F.lead("value").over(by_run()), F.lit(0.0)))
    return samples.withColumn("smooth", F.element_at(F.sort_array(near), 2))


def noise_floor(samples: DataFrame, parts: int = 12, least: int = 4, lowest: float = 1e-15) -> DataFrame:
    """Per run the smallest 1.4826 * MAD of full windows of max(least, n / parts) samples; where that is nothing, that
    of the steps over sqrt 2; runs of fewer than `least` samples have their population deviation."""
    whole = Window.partitionBy("run_key")
    cut = samples.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("dv", F.col("value") - F.lag("value").over(by_run()))
    size = F.greatest(F.lit(least), F.floor(F.col("n") / parts))
    cut = cut.withColumn("size", size).withColumn("win", F.floor(F.col("idx") / F.col("size")))
    cut = cut.withColumn("mid", F.median("value").over(Window.partitionBy("run_key", "win"))).withColumn("dmid", F.median("dv").over(whole))
    mads = cut.groupBy("run_key", "win").agg(F.count(F.lit(1)).alias("m"), F.first("size").alias("size"), (F.median(F.abs(F.col("value") - F.col("mid"))) * 1.4826).alias("mad"))
    best = mads.filter("m = size").groupBy("run_key").agg(F.min("mad").alias("mad"))
    rest = cut.groupBy("run_key").agg(F.first("n").alias("n"), F.stddev_pop("value").alias("sd"), (F.median(F.abs(F.col("dv") - F.col("dmid"))) * 1.4826 / F.sqrt(F.lit(2.0))).alias("step"))
    floor = F.when(F.col("n") < least, F.col("sd")).when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("step"))
    return rest.join(best, "run_key", "left").select("run_key", F.greatest(F.coalesce(floor, F.lit(0.0)), F.lit(lowest)).alias("floor"))


def above_floor(samples: DataFrame, floors: DataFrame, k: float) -> DataFrame:
    """Samples whose magnitude is over k times their run's noise floor."""
    return samples.join(floors, "run_key").filter(F.abs("value") > k * F.col("floor")).drop("floor")


def lock_time(samples: DataFrame, locked: Column, hold: int = 10) -> DataFrame:
    """First time from which `hold` samples in a row are locked and a further one follows, else the first locked time,
    else infinity."""
    ahead = by_run().rowsBetween(0, hold - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy("run_key"))
    marked = samples.withColumn("ok", locked.cast("int")).withColumn("all", F.min("ok").over(ahead)).withColumn("n", n)
    firm = F.min(F.when((F.col("all") == 1) & (F.col("idx") + hold < F.col("n")), F.col("t")))
    some = F.min(F.when(F.col("ok") == 1, F.col("t")))
    return marked.groupBy("run_key").agg(F.coalesce(firm, some, F.lit(float("inf"))).alias("lock_time"))


def first_crossing(samples: DataFrame, level: float) -> DataFrame:
    """Per run the first time that the value falls below the level, linearly interpolated; the last time if never."""
    v, t = F.lag("value").over(by_run()), F.lag("t").over(by_run())
    at = t + (F.col("t") - t) * (v - level) / (v - F.col("value"))
    crossed = samples.withColumn("at", F.when((v >= level) & (F.col("value") < level), at))
    return crossed.groupBy("run_key").agg(F.coalesce(F.min("at"), F.max("t")).alias("crossing"))


def bimodality(samples: DataFrame, least: int = 2, islands_needed: int = 4, times: float = 3.0) -> DataFrame:
    """States whose stretch means fall into two groups: split at the widest gap, apart by `times` the wider spread."""
    means = with_islands(samples).groupBy("run_key", "state", "island").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m")).filter(F.col("n") >= least)
    means = means.groupBy("run_key", "state", "island").agg(F.first("m").alias("m"))
    by = Window.partitionBy("state").orderBy("m", "run_key", "island")
    gaps = means.withColumn("gap", F.lead("m").over(by) - F.col("m")).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("state"))).filter(F.col("k") >= islands_needed)
    cut = gaps.groupBy("state").agg(F.max_by("m", F.struct("gap", -F.col("m"))).alias("cut"))
    sides = gaps.join(cut, "state").groupBy("state").agg(
        *[f(F.when(c, F.col("m"))).alias(a) for c, s in ((F.col("m") <= F.col("cut"), "low"), (F.col("m") > F.col("cut"), "high")) for f, a in ((F.avg, s), (F.stddev_pop, f"{s}_sd"))]
    )
    spread = F.greatest("low_sd", "high_sd")
    return sides.select("state", "low", "high", ((F.col("high") - F.col("low")) > times * spread).alias("bimodal"))


def corner_frequencies(curves: DataFrame) -> DataFrame:
    """Per run of a response in dB (value) over frequency (t): the gain at the start, the first frequency 3 dB below it,
    the first crossing of 0 dB (both interpolated, the last frequency if never), and the slope per decade from the
    sample before the corner to ten times its frequency, -20 where there is no room for it."""
    w = Window.partitionBy("run_key").orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v, t = F.lag("value").over(w), F.lag("t").over(w)
    between = lambda level: F.when(F.abs(F.col("value") - v) > 1e-10, t + (level - v) / (F.col("value") - v) * (F.col("t") - t)).otherwise(t)
    c = curves.withColumn("_gain", F.first("value").over(whole)).withColumn("_last", F.max("t").over(Window.partitionBy("run_key")))
    level = F.col("_gain") - 3.0
    c = c.withColumn("_c", F.when(v.isNotNull() & (F.col("value") <= level), F.struct(F.col("idx"), between(level).alias("f"))))
    c = c.withColumn("_u", F.when((v > 0) & (F.col("value") <= 0), F.struct(F.col("idx"), between(F.lit(0.0)).alias("f"))))
    found = c.groupBy("run_key").agg(F.first("_gain").alias("gain"), F.coalesce(F.min("_c")["f"], F.max("_last")).alias("corner"), F.coalesce(F.min("_u")["f"], F.max("_last")).alias("unity"))
    j = curves.join(found, "run_key")
    low = F.max(F.when(F.col("t") < F.col("corner"), F.struct("idx", "t", "value")))
    start, end = F.min(F.struct("idx", "t", "value")), F.max(F.struct("idx", "t", "value"))
    high = F.min(F.when(F.col("t") >= 10 * F.col("corner"), F.struct("idx", "t", "value")))
    ends = j.groupBy("run_key", "gain", "corner", "unity").agg(F.coalesce(low, start).alias("a"), F.coalesce(high, end).alias("b"))
    room = (F.col("b.idx") > F.col("a.idx")) & (F.col("b.t") > F.col("a.t"))
    slope = F.when(room, (F.col("b.value") - F.col("a.value")) / F.greatest(F.log10(F.col("b.t") / (F.col("a.t") + 1e-30)), F.lit(1e-10))).otherwise(-20.0)
    return ends.select("run_key", "gain", "corner", "unity", slope.alias("slope"))
