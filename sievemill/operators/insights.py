"""Findings from samples around events: thresholds, loads, shoot-through, inrush, dividers, fingerprints.

Windows around an event are frames over the run's own order, filtered to the events afterwards: no range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.session import bounded, cut

from .sequence import by_run, edges


def effective_threshold(samples: DataFrame, pin: str, reach: int = 5, least: int = 2) -> DataFrame:
    """Per run: the median, over crossings of the binarized value, of the pin voltage at the largest current within
    `reach` samples, its spread, and a confidence 1 / (1 + spread / range of the pin)."""
    near = by_run().rowsBetween(-reach, reach)
    at_peak = F.max_by(pin, F.struct(F.abs("current"), -F.col("idx"))).over(near)
    marked = samples.withColumn("_v", at_peak).join(edges(samples).select("run_key", "idx"), ["run_key", "idx"], "left_semi")
    span = samples.groupBy("run_key").agg((F.max(pin) - F.min(pin)).alias("span"))
    found = marked.groupBy("run_key").agg(F.median("_v").alias("threshold"), F.stddev_pop("_v").alias("spread"), F.count("_v").alias("n")).filter(F.col("n") >= least)
    conf = 1 / (1 + F.col("spread") / F.col("span"))
    return found.join(span.filter("span > 0"), "run_key").select("run_key", "threshold", "spread", "n", conf.alias("confidence"))


def dummy_loads(windows: DataFrame, floors: DataFrame, k: float = 3.0, least: int = 2, agree: float = 0.6, gate: float = 0.05) -> DataFrame:
    """Runs whose current steps at the edges of another signal: windows (run_key, rise, before, after, v_before,
    v_after); edges that move the output by more than the gate are left out; steps must agree in sign with the edge (or
    against it) often enough, and their median must be over k times the noise floor."""
    held = windows.filter(F.abs(F.col("v_after") - F.col("v_before")) <= gate * F.abs("v_before"))
    step = F.col("after") - F.col("before")
    s = held.groupBy("run_key").agg(F.count(F.lit(1)).alias("edges"), F.avg((F.signum(step) == F.signum("rise")).cast("double")).alias("_a"), F.median(F.abs(step)).alias("step"))
    s = s.withColumn("consistency", F.greatest("_a", 1 - F.col("_a"))).join(floors, "run_key")
    return s.filter((F.col("edges") >= least) & (F.col("consistency") >= agree) & (F.col("step") > k * F.col("floor"))).select("run_key", "edges", "consistency", "step")


def shoot_through(samples: DataFrame, width: int) -> DataFrame:
    """For each edge of a run: peak of the total current in the window after it, against the median of the windows that
    flank it."""
    w = by_run()
    peak = F.max(F.abs("value")).over(w.rowsBetween(0, width - 1))

    def flank(low: int, high: int) -> Column:
        """Median over a frame, which the median function does not take: of the sorted few values of the frame."""
        a = F.sort_array(F.collect_list(F.abs("value")).over(w.rowsBetween(low, high)))
        n = F.size(a)
        return F.when(n > 0, (a[F.floor((n - 1) / 2).cast("int")] + a[F.floor(n / 2).cast("int")]) / 2)

    before, after = flank(-width, -1), flank(width, 2 * width - 1)
    marked = samples.withColumn("peak", peak).withColumn("_b", before).withColumn("_a", after)
    base = F.greatest(F.coalesce("_b", F.lit(0.0)), F.coalesce("_a", F.lit(0.0)))
    return marked.join(edges(samples).select("run_key", "idx"), ["run_key", "idx"], "left_semi").select("run_key", "idx", "peak", base.alias("flank"), (F.col("peak") / F.nullif(base, F.lit(0.0))).alias("ratio"))


def inrush_capacitance(samples: DataFrame, least_dv: float = 1e-3, least: int = 3) -> DataFrame:
    """Per run: integral of |current| over time, divided by the rise of the voltage."""
    area = (F.abs("current") + F.abs(F.lag("current").over(by_run()))) / 2 * (F.col("t") - F.lag("t").over(by_run()))
    s = samples.withColumn("_q", area).groupBy("run_key").agg(F.sum("_q").alias("q"), (F.max_by("value", "idx") - F.min_by("value", "idx")).alias("dv"), F.count(F.lit(1)).alias("n"))
    return s.filter((F.col("n") >= least) & (F.abs("dv") > least_dv)).select("run_key", "q", "dv", (F.col("q") / F.abs("dv")).alias("capacitance"))


def divider_ratio(samples: DataFrame, by: list[str]) -> DataFrame:
    """Median of the positive ratios of feedback to output."""
    r = F.col("fb") / F.nullif(F.col("out"), F.lit(0.0))
    return samples.groupBy(*by).agg(F.median(F.when(r > 0, r)).alias("ratio"), F.count(F.when(r > 0, r)).alias("n"))


def probe_coverage(pins: DataFrame) -> DataFrame:
    """By role: pins in all and those that have a current probe."""
    return pins.groupBy("role").agg(F.count(F.lit(1)).alias("total"), F.count_if("with_current").alias("with_current"))


def size_statistics(components: DataFrame, types: list[str]) -> DataFrame:
    """Per component type, also those that do not occur: count, mean, deviation, extremes and total of the size."""
    s = components.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), F.stddev_pop("size").alias("std"), F.min("size").alias("min"), F.max("size").alias("max"), F.sum("size").alias("sum"))
    wanted = components.sparkSession.createDataFrame([(t,) for t in types], "type string")
    return wanted.join(s, "type", "left").na.fill(0)


def clustering(edges_: DataFrame) -> DataFrame:
    """Clustering coefficient of each node of an undirected graph (a, b): closed over possible pairs of neighbours."""
    e = edges_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    both = e.union(e.select("b", "a"))
    deg = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    x, y = e.select(F.col("a").alias("u"), F.col("b").alias("v")), both.select(F.col("a").alias("v"), F.col("b").alias("w"))
    closed = x.join(y, "v").join(both.select(F.col("a").alias("w"), F.col("b").alias("u")), ["w", "u"])
    tri = closed.filter("u < v AND v < w").select("u", "v", "w")
    per = tri.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    c = F.when(F.col("d") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return deg.join(per, "node", "left").select("node", "d", c.alias("clustering"))


def grade(loss: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The first grade whose limit the loss does not exceed."""
    out = F.lit(last)
    for limit, name in reversed(steps):
        out = F.when(loss <= limit, name).otherwise(out)
    return out


def weighted_loss(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Composite of the named losses and its grade."""
    total = sum(F.col(c) * w for c, w in weights.items()) / sum(weights.values())
    return rows.withColumn("loss", total).withColumn("grade", grade(F.col("loss"), [(0.15, "A"), (0.3, "B"), (0.5, "C")], "D"))


def compliance(specs: DataFrame, values: DataFrame) -> DataFrame:
    """Every specification with its value, if any, and whether it lies within the inclusive bounds."""
    j = specs.join(values, "spec", "left")
    ok = F.coalesce(F.col("value") >= F.col("min"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("max"), F.lit(True))
    return j.withColumn("evaluated", F.col("value").isNotNull()).withColumn("passed", F.when(F.col("evaluated"), ok))


def explain_shift(shifts: DataFrame, sensitivity: DataFrame, top: int = 3) -> DataFrame:
    """For each pole shift (pole, shift) the parameters whose implied change is smallest: sensitivity (pole, param,
    slope, nominal)."""
    j = shifts.join(sensitivity.filter("slope <> 0"), "pole").withColumn("delta", F.col("shift") / F.col("slope")).withColumn("rel", F.abs(F.col("delta") / F.col("nominal")))
    w = Window.partitionBy("pole").orderBy("rel", "param")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("pole", "rank", "param", "delta", "rel")


def run_groups(runs: DataFrame, key: str = "corner", default: str = "ALL") -> DataFrame:
    """Run ids by a metadata key; runs without it belong to the default group. The list is one entry a run."""
    return runs.groupBy(F.coalesce(F.try_element_at("meta", F.lit(key)), F.lit(default)).alias("process")).agg(F.sort_array(F.collect_list("run_id")).alias("runs"))


def reference_compare(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """mse, mae and largest error of two series on their common rows, missing pairs left out."""
    e = F.col("a") - F.col("b")
    j = left.withColumnRenamed("value", "a").join(right.withColumnRenamed("value", "b"), [*by, "idx"])
    return j.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("worst"), F.count(e).alias("n"))


def silicon_match(chips: DataFrame, sims: DataFrame) -> DataFrame:
    """Simulated value of each measured spec: by name, else the first simulated name that holds it or lies in it. The
    simulated names are a dimension."""
    exact = chips.join(sims.select("spec", F.col("sim").alias("_e")), "spec", "left")
    s, o = F.lower("spec"), F.lower("other")
    names = chips.select("spec").distinct().join(bounded(sims.select(F.col("spec").alias("other"), "sim")), s.contains(o) | o.contains(s))
    loose = names.groupBy("spec").agg(F.min_by("sim", "other").alias("_l"))
    return exact.join(loose, "spec", "left").withColumn("sim", F.coalesce("_e", "_l")).drop("_e", "_l")




def medians(values: DataFrame, by: list[str], accuracy: int = 1000) -> DataFrame:
    """by..., median (exact) and n of the column value by group, missing ones left out. Approximate quantiles bracket the
    middle; a second pass counts what lies below and the values within, so groups of any size take little memory. A
    group whose bracket misses its middle is counted whole."""
    v = values.filter("value IS NOT NULL").select(*by, "value")
    around = F.percentile_approx("value", F.array(F.lit(0.5 - 2 / accuracy), F.lit(0.5 + 2 / accuracy)), F.lit(accuracy))
    ends = cut(v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), around.alias("_e")).select(*by, "n", F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi")))
    found = cut(_middles(v, ends, by))
    missed = found.filter("median IS NULL")
    if missed.isEmpty():
        return found
    whole = ends.join(missed.select(*by), by).withColumns({"_lo": F.lit(float("-inf")), "_hi": F.lit(float("inf"))})
    return found.filter("median IS NOT NULL").unionByName(_middles(v, whole, by))


def _sent(groups: DataFrame) -> DataFrame:
    """A row a group, sent to all tasks where there are few groups, so that large ones need no shuffle."""
    return F.broadcast(groups) if groups.limit(100_001).count() <= 100_000 else groups


def _middles(values: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """Medians where they lie between _lo and _hi, else null."""
    j = values.join(_sent(ends), by)
    side = F.when(F.col("value") < F.col("_lo"), 0).when(F.col("value") <= F.col("_hi"), 1).otherwise(2)
    counts = j.withColumn("_side", side).groupBy(*by, "n", "_side", F.when(side == 1, F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_side", "value").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_to", upto)
    at = lambda k: F.max(F.when((k < F.col("_to")) & (k >= F.col("_to") - F.col("_c")), F.col("value")))
    middle = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    return counts.groupBy(*by).agg(middle.alias("median"), F.max("n").alias("n"))


def divider_resistors(samples: DataFrame, by: list[str], reference: float, regulating: str, least: float = 1e-9) -> DataFrame:
    """Both resistors of a feedback divider by group, as medians of positive ratios. Tier 1 takes each sample's output
    (out), feedback voltage (fb) and current (i); where it finds nothing, tier 2 takes samples of the regulating state and
    the reference (the median of the column ref there, if any) in place of the feedback voltage; tier 3 finds none."""
    ok = F.abs("i") > least
    split = lambda low, whole: F.when(ok & (low > 0) & (whole - low > 0), F.struct((whole - low).alias("r1"), low.alias("r2")))
    whole = F.col("out") / F.nullif(F.col("i"), F.lit(0.0))
    state = F.col("state") == regulating
    refs = medians(samples.filter(state).select(*by, F.col("ref").alias("value")), by).select(*by, F.col("median").alias("_ref"))
    groups = samples.select(*by).distinct()
    j = samples.join(_sent(refs), by, "left").withColumn("_ref", F.coalesce("_ref", F.lit(reference)))
    tiers = F.array(*[F.struct(F.lit(k).alias("_tier"), x.alias("_r")) for k, x in ((1, split(F.col("fb") / F.nullif(F.col("i"), F.lit(0.0)), whole)), (2, F.when(state, split(F.col("_ref") / F.nullif(F.col("i"), F.lit(0.0)), whole))))])
    each = j.select(*by, F.explode(tiers).alias("_t")).select(*by, "_t._tier", "_t._r").filter("_r IS NOT NULL")
    tall = each.select(*by, "_tier", F.explode(F.array(*[F.struct(F.lit(r).alias("name"), F.col(f"_r.{r}").alias("value")) for r in ("r1", "r2")])).alias("_v")).select(*by, "_tier", "_v.*")
    found = medians(tall, [*by, "_tier", "name"])
    value = lambda r: F.max(F.when(F.col("name") == r, F.col("median"))).alias(r)
    told = found.groupBy(*by, "_tier").agg(value("r1"), value("r2"), F.max("n").alias("n"))
    best = told.groupBy(*by).agg(F.min_by(F.struct(F.col("_tier").alias("tier"), "r1", "r2", "n"), "_tier").alias("_b"))
    return groups.join(best, by, "left").select(*by, F.coalesce("_b.tier", F.lit(3)).alias("tier"), "_b.r1", "_b.r2", F.coalesce("_b.n", F.lit(0)).alias("n"))


def mux_findings(shifts: DataFrame, floors: DataFrame, times: float = 4.0) -> DataFrame:
    """shifts (run_key, sel, idx, pin, shift): the change of each candidate supply's current at an edge of a select pin;
    floors (run_key, pin, floor). One row an edge that moves current, from the pin with the least to that with the
    largest change, and one for each run and select pin without any: there the path is not verified."""
    real = shifts.join(floors, ["run_key", "pin"], "left").filter(F.abs("shift") > times * F.coalesce("floor", F.lit(0.0)))
    moved = real.groupBy("run_key", "sel", "idx").agg(F.max_by("pin", F.struct("shift", "pin")).alias("gained"), F.min_by("pin", F.struct("shift", "pin")).alias("dropped"))
    seen = moved.withColumn("category", F.lit("mux-verified")).withColumn("severity", F.lit("info"))
    none = shifts.select("run_key", "sel").distinct().join(moved, ["run_key", "sel"], "left_anti")
    none = none.select("run_key", "sel", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("gained"), F.lit(None).cast("string").alias("dropped"), F.lit("untested-mux").alias("category"), F.lit("high").alias("severity"))
    return seen.unionByName(none)
