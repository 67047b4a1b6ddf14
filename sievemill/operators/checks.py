"""Specification checks, corner and Monte-Carlo statistics, report roll-ups and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26, the error function to 1.5e-7, in built-in functions.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return (1 + erf(x / F.sqrt(F.lit(2.0)))) / 2


def measures(samples: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """mean, max, min and rms; `measure_of` picks one by name."""
    v = F.col(value)
    return samples.groupBy(*by).agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.sqrt(F.avg(v * v)).alias("rms"))


def measure_of(name: Column) -> Column:
    """The measure of that name; an unknown name means the mean."""
    return F.coalesce(*[F.when(name == m, F.col(m)) for m in ("max", "min", "rms")], F.col("mean"))


def check(measured: Column, low: Column, high: Column, target: Column) -> tuple[Column, Column]:
    """Status and margin: bounds are inclusive, the margin is given for two bounds only, a target alone always passes."""
    status = F.when(measured.isNull(), "FAIL").when(low.isNotNull() & (measured < low), "FAIL").when(high.isNotNull() & (measured > high), "FAIL").otherwise("PASS")
    return status, F.when(low.isNotNull() & high.isNotNull(), F.least(measured - low, high - measured))


def in_window(value: Column, low: Column, high: Column) -> Column:
    """Inclusive range; one without width is widened by 0.1 on both sides."""
    flat = low == high
    return (value >= F.when(flat, low - 0.1).otherwise(low)) & (value <= F.when(flat, high + 0.1).otherwise(high))


def current_stats(samples: DataFrame) -> DataFrame:
    """Per run: average, rms, peak magnitude with its first time, and the inrush (peak of the first n / 100 samples)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("run_key"))
    early = F.col("idx") < F.greatest(F.lit(1), F.floor(F.col("n") / 100))
    m = F.abs("value")
    return (
        samples.withColumn("n", n)
        .groupBy("run_key")
        .agg(F.avg("value").alias("avg"), F.max(m).alias("peak"), F.sqrt(F.avg(F.col("value") ** 2)).alias("rms"), F.max_by("t", F.struct(m, -F.col("idx"))).alias("peak_time"), F.max(F.when(early, m)).alias("inrush"))
    )


def supply_stats(samples: DataFrame, by: list[str]) -> DataFrame:
    """Mean, droop (mean - min), ripple (max - min) and the first time of the minimum."""
    v = F.col("value")
    return samples.groupBy(*by).agg(F.avg(v).alias("mean"), (F.avg(v) - F.min(v)).alias("droop"), (F.max(v) - F.min(v)).alias("ripple"), F.min_by("t", F.struct(v, "t")).alias("droop_time"))


def corner_worst(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """rows (corner, param, measured) against spec (param, min, max): smallest margin, its corner (first of equals),
    whether all pass, and the failing corners in order. A missing bound is never violated."""
    inf = F.lit(float("inf"))
    margin = F.least(F.coalesce(F.col("measured") - F.col("min"), inf), F.coalesce(F.col("max") - F.col("measured"), inf))
    judged = rows.join(spec, "param").withColumn("margin", margin)
    fails = F.sort_array(F.collect_list(F.when(F.col("margin") < 0, F.col("corner"))))  # one entry a corner
    return judged.groupBy("param").agg(F.min("margin").alias("worst_margin"), F.min_by("corner", F.struct("margin", "corner")).alias("worst_corner"), F.bool_and(F.col("margin") >= 0).alias("passed"), fails.alias("failing"))


def monte_carlo(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """Per parameter: mean, population sigma, Cpk and normal yield. With one bound or no spread there is no Cpk, and
    without one the check does not pass."""
    agg = rows.groupBy("param").agg(F.avg("measured").alias("mean"), F.stddev_pop("measured").alias("sigma"), F.count("measured").alias("n"))
    j = agg.join(spec, "param")
    both = F.col("min").isNotNull() & F.col("max").isNotNull() & (F.col("sigma") > 0)
    up, down = (F.col("max") - F.col("mean")) / F.col("sigma"), (F.col("mean") - F.col("min")) / F.col("sigma")
    cpk = F.when(both, F.least(up, down) / 3)
    out = j.withColumn("cpk", cpk).withColumn("yield", F.when(both, normal_cdf(up) - normal_cdf(-down)))
    return out.select("param", "n", "mean", "sigma", "cpk", "yield")


def with_verdict(mc: DataFrame, least_cpk: float = 1.33) -> DataFrame:
    return mc.withColumn("status", F.when(F.coalesce(F.col("cpk") >= least_cpk, F.lit(False)), "PASS").otherwise("FAIL"))


def sensitivity_ranking(rows: DataFrame) -> DataFrame:
    """Parameters by population sigma over max(mean, 1e-30)."""
    return rows.groupBy("param").agg((F.stddev_pop("measured") / F.greatest(F.avg("measured"), F.lit(1e-30))).alias("cv")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cv"), "param")))


def yield_sweep(mc: DataFrame, nominal: Column, steps: int) -> DataFrame:
    """Normal yield within a tolerance around the mean, for tolerances from nominal down in equal steps."""
    swept = mc.filter("sigma > 0").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    tol = nominal * (1 - F.col("step") / steps)
    return swept.select("param", "step", tol.alias("tolerance"), (2 * normal_cdf(tol / F.col("sigma")) - 1).alias("yield"))


def roll_up(results: DataFrame, by: list[str]) -> DataFrame:
    """Totals by status and the pass rate in per cent; nothing gives 0 %."""
    s = lambda x: F.count_if(F.col("status") == x)
    total = F.count("status")
    return results.groupBy(*by).agg(total.alias("total"), s("PASS").alias("passed"), s("FAIL").alias("failed"), s("WARNING").alias("warned"), (100.0 * s("PASS") / F.greatest(total, F.lit(1))).alias("pass_rate"))


def quality_gate(results: DataFrame, required: list[str], blocked: list[str], least_rate: float, most_fails: int, worst: int = 3) -> DataFrame:
    """One row: the violated rules, with required checkers that are missing, blocked ones that fail, and the worst
    few errors only."""
    r = results
    agg = r.agg(
        F.count("status").alias("total"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.collect_set("checker").alias("seen"),  # names of checkers: a dimension
        F.collect_set(F.when((F.col("status") == "FAIL") & F.col("checker").isin(blocked), F.col("checker"))).alias("blocked"),
    )
    errors = r.filter("status = 'FAIL'").orderBy("margin", "checker", "item").limit(worst)
    listed = errors.agg(F.sort_array(F.collect_list(F.struct("margin", "checker", "item"))).alias("e")).select(F.transform("e", lambda x: F.concat_ws("/", x["checker"], x["item"].cast("string"))).alias("worst"))
    rate = 100.0 * F.col("passed") / F.greatest("total", F.lit(1))
    missing = F.array_except(F.array(*[F.lit(x) for x in required]), F.col("seen"))
    rules = F.array_compact(
        F.array(
            F.when(rate < least_rate, F.lit("pass rate")),
            F.when(F.col("failed") > most_fails, F.lit("too many failures")),
            F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(missing), ","))),
            F.when(F.size("blocked") > 0, F.concat(F.lit("blocked: "), F.array_join(F.array_sort("blocked"), ","))),
        )
    )
    return agg.crossJoin(listed).select("total", "passed", "failed", F.array_join(rules, "; ").alias("violations"), F.array_join("worst", ", ").alias("worst"))  # one row each


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings by severity, critical first."""
    order = F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low", "info")])
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.array_position(order, F.col("severity")).cast("int"))


def corner_outliers(rows: DataFrame, least_group: int = 3, majority: float = 0.5, drop: float = 0.2) -> DataFrame:
    """rows (run, corner, states, coverage) -> the corners out of line in their run: their state list differs from that
    of a strict majority, or their coverage is under Q1 - 1.5 IQR (of four corners at least), or under the median by
    more than `drop`. Groups are runs of three corners or more; if no run has so many, all corners are one group."""
    n = F.count(F.lit(1)).over(Window.partitionBy("run"))
    sized = rows.withColumn("_n", n)
    largest = sized.agg(F.max("_n").alias("_big"))  # one row
    g = sized.join(F.broadcast(largest)).withColumn("grp", F.when(F.col("_big") < least_group, F.lit("*")).when(F.col("_n") >= least_group, F.col("run").cast("string"))).filter("grp IS NOT NULL")
    stats = g.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.percentile("coverage", F.lit(0.25)).alias("q1"), F.percentile("coverage", F.lit(0.75)).alias("q3"), F.median("coverage").alias("mid"))
    modes = g.groupBy("grp", "states").agg(F.count(F.lit(1)).alias("c"))
    mode = modes.groupBy("grp").agg(F.max_by("states", "c").alias("mode"), F.max("c").alias("c"))  # a strict majority has no ties
    j = g.join(stats, "grp").join(mode, "grp")
    odd_states = (F.col("c") > majority * F.col("m")) & (F.col("states") != F.col("mode"))
    low = (F.col("m") >= 4) & (F.col("coverage") < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
    under = F.col("coverage") < F.col("mid") - drop
    reasons = F.concat_ws(",", F.when(odd_states, "states"), F.when(low, "iqr"), F.when(under, "median"))
    return j.withColumn("reasons", reasons).filter("reasons <> ''").select("run", "corner", "reasons")


def code_density(samples: DataFrame, bits: int) -> DataFrame:
    """Histogram of converter codes -> DNL of the inner codes, INL as its running sum, and whether the code is missing."""
    codes = samples.filter(F.col("code").between(0, 2**bits)).withColumn("code", F.least(F.col("code").cast("long"), F.lit(2**bits - 1)))
    h = codes.groupBy("code").agg(F.count(F.lit(1)).alias("hits"))
    inner = samples.sparkSession.range(1, 2**bits - 1).select(F.col("id").alias("code")).join(h, "code", "left").na.fill(0, ["hits"])
    whole = Window.partitionBy()
    dnl = F.col("hits") / F.avg("hits").over(whole) - 1  # 2^bits rows
    out = inner.withColumn("dnl", F.coalesce(dnl, F.lit(-1.0)))
    return out.select("code", "hits", "dnl", F.sum("dnl").over(Window.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)).alias("inl"), (F.col("hits") == 0).alias("missing"))


def jitter(edges: DataFrame) -> DataFrame:
    """Periods between rising edges of a run: mean frequency and population and sample deviation."""
    period = F.col("t") - F.lag("t").over(Window.partitionBy("run_key").orderBy("idx"))
    p = edges.filter("rise = 1").withColumn("p", period).groupBy("run_key")
    return p.agg(F.count("p").alias("periods"), (1 / F.avg("p")).alias("frequency"), F.stddev_pop("p").alias("jitter"), F.stddev_samp("p").alias("jitter_samp")).filter("periods >= 2")


def regression_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (y, p): R2 (denominator + 1e-12), MAE, RMSE and MAPE (denominator + 1e-9)."""
    e = F.col("y") - F.col("p")
    a = rows.groupBy(*by).agg(F.sum(e * e).alias("sse"), F.var_pop("y").alias("v"), F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), (F.avg(F.abs(e) / (F.abs("y") + 1e-9)) * 100).alias("mape"))
    return a.select(*by, (1 - F.col("sse") / (F.col("v") * F.col("n") + 1e-12)).alias("r2"), "mae", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mape")


def fit_error(rows: DataFrame, by: list[str]) -> DataFrame:
    """rmse, mae and the rmse over the range (a range of 0 counts as 1)."""
    e = F.col("y") - F.col("p")
    span = F.max("y") - F.min("y")
    return rows.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.sqrt(F.avg(e * e)) / F.when(span == 0, 1.0).otherwise(span)).alias("nrmse"))


def holdout_errors(rows: DataFrame) -> DataFrame:
    """Per cent error of each prediction, null for a target of nothing."""
    return rows.withColumn("err_pct", F.when(F.abs("y") >= 1e-30, 100 * F.abs(F.col("p") - F.col("y")) / F.abs("y")))


def best_model(rows: DataFrame, by: list[str]) -> DataFrame:
    """The model with the smallest error, the first by name of equals."""
    return rows.groupBy(*by).agg(F.min_by("model", F.struct("mse", "model")).alias("model"), F.min("mse").alias("mse"))


def silicon_gaps(rows: DataFrame) -> DataFrame:
    """Per cent gap of measured to simulated (denominator 1 for nothing) and its severity."""
    den = F.when(F.abs("sim") <= 1e-10, 1.0).otherwise(F.abs("sim"))
    g = rows.withColumn("gap_pct", 100 * (F.col("measured") - F.col("sim")) / den)
    return g.withColumn("severity", F.when(F.abs("gap_pct") > 10, "HIGH").when(F.abs("gap_pct") > 5, "MEDIUM").otherwise("LOW"))


def filter_response(rows: DataFrame, by: list[str], pass_edge: float, stop_edge: float) -> DataFrame:
    """Ripple (max - min) in the pass band and attenuation (minus the max) in the stop band."""
    p, s = F.when(F.col("freq") <= pass_edge, F.col("gain")), F.when(F.col("freq") >= stop_edge, F.col("gain"))
    return rows.groupBy(*by).agg((F.max(p) - F.min(p)).alias("ripple"), (-F.max(s)).alias("attenuation"))


def meta_trust(rows: DataFrame) -> DataFrame:
    """Keys of run metadata whose values tell runs apart too little: one value, or fewer than half as many as runs."""
    runs = rows.select("run").distinct().count()
    c = rows.groupBy("key").agg(F.countDistinct("value").alias("values"))
    return c.withColumn("trusted", ~((F.lit(runs) > 1) & ((F.col("values") == 1) | (F.col("values") < 0.5 * runs))))


def vi_consistency(rows: DataFrame, least: int = 3, spread: float = 0.2) -> DataFrame:
    """Buckets of (state, v, i) in which the means of two paths or more differ by over a share of the largest."""
    key = rows.withColumn("bv", F.bround("v", 2)).withColumn("bi", F.bround(F.col("i") * 10000, 0) / 10000)
    per = key.groupBy("state", "bv", "bi", "path").agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    b = per.groupBy("state", "bv", "bi").agg(F.count(F.lit(1)).alias("paths"), F.max("m").alias("hi"), F.min("m").alias("lo")).filter("paths >= 2")
    rel = (F.col("hi") - F.col("lo")) / F.greatest(F.abs("hi"), F.abs("lo"))
    return b.withColumn("rel", rel).filter(F.col("rel") > spread).select("state", "bv", "bi", "paths", "rel")


def large_signal_slope(samples: DataFrame, least_span: float) -> DataFrame:
    """Median over runs of the magnitude of the slope of value over x, for runs whose x spans enough."""
    s = samples.groupBy("run_key").agg(F.regr_slope("value", "x").alias("slope"), (F.max("x") - F.min("x")).alias("span")).filter(F.col("span") > least_span)
    return s.agg(F.median(F.abs("slope")).alias("slope"), F.count(F.lit(1)).alias("runs"))


def drive_capacity(samples: DataFrame, by: list[str], v_min: float, spec: float) -> DataFrame:
    """Largest magnitude of the current while the voltage holds, and whether it is short of the specification."""
    ok = F.when(F.col("v") >= v_min, F.abs("i"))
    return samples.groupBy(*by).agg(F.max(ok).alias("capacity")).withColumn("short", F.coalesce(F.col("capacity"), F.lit(0.0)) < 0.98 * spec)


def efficiency(samples: DataFrame, by: list[str]) -> DataFrame:
    """Mean |i| v of the outputs over that of the inputs; none without input, flagged outside 0 to 1.05."""
    p = F.abs("i") * F.col("v")
    a = samples.groupBy(*by).agg(F.avg(F.when(F.col("side") == "out", p)).alias("o"), F.avg(F.when(F.col("side") == "in", p)).alias("n"))
    e = F.when(F.col("n") > 1e-18, F.col("o") / F.col("n"))
    return a.select(*by, e.alias("efficiency"), ((e < 0) | (e > 1.05)).alias("odd"))


def sequencing_violations(samples: DataFrame, by: list[str], active: Column, valid: Column, share: float = 0.02) -> DataFrame:
    """Share of samples that are active while not valid, where it is over the limit."""
    return samples.groupBy(*by).agg(F.avg((active & ~valid).cast("double")).alias("share")).filter(F.col("share") > share)


def power_sequence(samples: DataFrame, rail: str, threshold: float) -> DataFrame:
    """First time of each rail at its threshold, in that order, with the margin to the rail before; never: no time."""
    at = samples.groupBy(rail).agg(F.min(F.when(F.col("value") >= threshold, F.col("t"))).alias("up"))
    w = Window.orderBy(F.asc_nulls_last("up"), rail)  # one row a rail
    return at.select(rail, "up", F.row_number().over(w).alias("position"), (F.col("up") - F.lag("up").over(w)).alias("margin"))
