"""Savitzky-Golay smoothing of runs of any length, as sums that merge.

The least-squares parabola over a window is a sum of samples times 1, k and k^2, k being the distance from the middle.
Runs of at most WHOLE samples are an array each, and their windows are sums of its products. Longer runs are cut: within blocks of a run running sums of these are kept; a window is the running sum at its end less that before its
start, and the whole of the first block where it spans two. Both ends are sent to the row in the middle and added up
there, so the work grows with the samples, however wide the window, and no task holds a run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import WHOLE, by_length, filled, run_by_run

#: Rows of a block, at least: short ones keep running sums small, so little is lost in differences.
BLOCK = 64


def auto_window(n: Column) -> Column:
    """An odd twentieth of a run's samples, five at least, and no more than the run has."""
    return F.least(F.greatest(F.lit(5), F.floor(F.floor(n / 20) / 2) * 2 + 1), n - 1 + n % 2)


def moments(p: str, at: Column) -> list[Column]:
    """Sums about another place: those of 1, p and p^2 become those of k = p - at."""
    s0, s1, s2 = F.col(f"{p}0"), F.col(f"{p}1"), F.col(f"{p}2")
    return [s0, s1 - at * s0, s2 - 2 * at * s1 + at * at * s0]


def parabola(h: Column) -> list[Column]:
    """Coefficients of the fit over -h to h, from the columns m0, m1 and m2."""
    n, s2 = 2 * h + 1, h * (h + 1) * (2 * h + 1) / 3
    s4 = s2 * (3 * h * h + 3 * h - 1) / 5
    d = n * s4 - s2 * s2
    m0, m1, m2 = F.col("m0"), F.col("m1"), F.col("m2")
    return [(s4 * m0 - s2 * m2) / d, m1 / s2, (n * m2 - s2 * m0) / d]


def parabolas(y: np.ndarray, window: int | None) -> tuple[np.ndarray, np.ndarray]:
    """smooth and slope of one run; see smooth."""
    n, ok = len(y), ~np.isnan(y)
    if not ok.all():
        if not ok.any():
            return y, y
        y = np.interp(np.arange(n), np.flatnonzero(ok), y[ok])
    h = min(max(5, n // 20 // 2 * 2 + 1) if window is None else window, n - 1 + n % 2) // 2
    if h < 1:
        return y, np.full(n, y[-1] - y[0])
    k = np.arange(-h, h + 1.0)
    count, s2, s4 = 2 * h + 1, float((k**2).sum()), float((k**4).sum())
    d = count * s4 - s2 * s2
    a, b, c = (np.correlate(y, w, "valid") for w in ((s4 - s2 * k * k) / d, k / s2, (count * k * k - s2) / d))
    mid = np.clip(np.arange(n), h, n - 1 - h)
    off, at = np.arange(n) - mid, mid - h
    return a[at] + b[at] * off + c[at] * off * off, b[at] + 2 * c[at] * off


def smooth_whole(samples: DataFrame, window: int | None) -> DataFrame:
    """smooth for runs that fit an array each."""

    def fitted(pdf: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
        value = pdf["value"].to_numpy(dtype=float)
        made = [parabolas(value[a:b], window) for a, b in zip(ends, ends[1:])]
        return pd.DataFrame({"run_key": pdf["run_key"], "idx": pdf["idx"], "smooth": np.concatenate([s for s, _ in made]), "slope": np.concatenate([s for _, s in made])})

    found = run_by_run(samples, "run_key", "idx", fitted, f"run_key {dict(samples.dtypes)['run_key']}, idx long, smooth double, slope double")
    return found.select("run_key", "idx", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("smooth", "slope")])


def smooth(samples: DataFrame, window: int | None = None, most: int = WHOLE) -> DataFrame:
    """run_key, idx, smooth and slope (a sample): the parabola over `window` samples (odd; without one auto_window of
    the run), those of the first and last full window reaching to the ends. Missing values are filled linearly first;
    runs of one or two samples stay as they are, with the slope between them. Runs of more than `most` samples are cut."""
    rows = samples.select("run_key", F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))
    whole, long = by_length(rows, "run_key", most)
    out = smooth_whole(whole, window)
    out = out if long is None else out.union(smooth_cut(long, window))
    return out.withColumn("idx", F.col("idx").cast(samples.schema["idx"].dataType))


def smooth_cut(rows: DataFrame, window: int | None) -> DataFrame:
    """smooth for runs of any length, by running sums within blocks."""
    y = filled(rows, "run_key")
    size = y.groupBy("run_key").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "idx").alias("y0"), F.max_by("value", "idx").alias("y1"))
    width = auto_window(F.col("n")) if window is None else F.least(F.lit(window), F.col("n") - 1 + F.col("n") % 2)
    size = size.withColumn("h", F.floor(width / 2).cast("double"))
    size = size.withColumn("len", F.greatest(F.lit(float(BLOCK)), 2 * F.col("h") + 1))
    few = y.join(size.filter("h < 1"), "run_key").select("run_key", "idx", F.col("value").alias("smooth"), F.when(F.col("n") > 1, F.col("y1") - F.col("y0")).otherwise(0.0).alias("slope"))
    j = y.join(size.filter("h >= 1").select("run_key", "n", "h", "len"), "run_key").withColumn("block", F.floor(F.col("idx") / F.col("len")))
    p = F.col("idx") - F.col("block") * F.col("len")
    whole = Window.partitionBy("run_key", "block")
    upto = whole.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    terms = [F.col("value"), p * F.col("value"), p * p * F.col("value")]
    j = j.withColumns({f"c{k}": F.sum(t).over(upto) for k, t in enumerate(terms)} | {f"t{k}": F.sum(t).over(whole) for k, t in enumerate(terms)})
    start = F.col("block") * F.col("len")
    last, first = F.col("idx") - F.col("h"), F.col("idx") + F.col("h") + 1  # the middles of windows that end here, that start after this
    ends = [F.struct(last.alias("mid"), *[c.alias(f"m{k}") for k, c in enumerate(moments("c", last - start))])]
    over = (F.floor((first + F.col("h")) / F.col("len")) > F.col("block")).cast("double")  # the window begins in the block before
    ends.append(F.struct(first.alias("mid"), *[(over * t - c).alias(f"m{k}") for k, (c, t) in enumerate(zip(moments("c", first - start), moments("t", first - start)))]))
    sums = j.select("run_key", "n", "h", F.explode(F.array(*ends)).alias("e")).select("run_key", "n", "h", "e.*").filter("mid >= h and mid <= n - 1 - h")
    sums = sums.groupBy("run_key", F.col("mid").cast("long").alias("mid")).agg(F.first("n").alias("n"), F.first("h").alias("h"), *[F.sum(f"m{k}").alias(f"m{k}") for k in range(3)])
    a, b, c = parabola(F.col("h"))
    h = F.col("h").cast("long")
    low = F.when(F.col("mid") == h, F.sequence(F.lit(0).cast("long"), h - 1))
    high = F.when(F.col("mid") == F.col("n") - 1 - h, F.sequence(F.col("mid") + 1, F.col("n") - 1))
    none = F.array().cast("array<bigint>")
    told = sums.select("run_key", "mid", a.alias("a"), b.alias("b"), c.alias("c"), F.explode(F.concat(F.array("mid"), F.coalesce(low, none), F.coalesce(high, none))).alias("idx"))
    d = F.col("idx") - F.col("mid")
    out = told.select("run_key", "idx", (F.col("a") + F.col("b") * d + F.col("c") * d * d).alias("smooth"), (F.col("b") + 2 * F.col("c") * d).alias("slope"))
    return out.union(few)
