"""Scores of block diagrams: blocks, links and one specification row for each design, any number of designs at once.

blocks (design, node, kind, power, area, frequency, interfaces), links (design, src, dst, domain), specs (design,
power_budget, area_budget, target_frequency, standards), expected (src, dst): links that matter where both ends exist.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least score of each grade.
GRADES = [(0.90, "A+"), (0.85, "A"), (0.78, "A-"), (0.72, "B+"), (0.65, "B"), (0.58, "B-"), (0.50, "C+"), (0.42, "C"), (0.35, "C-"), (0.25, "D"), (0.0, "F")]
LOSSES = ("power", "area", "timing", "connectivity", "coverage", "crossing", "isolation", "redundancy", "supply")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for nothing."""
    return F.coalesce(F.when(whole > 0, part / whole), F.lit(0.0))


def losses(blocks: DataFrame, links: DataFrame, specs: DataFrame, expected: DataFrame, supply: str = "pmu") -> DataFrame:
    """The nine losses of each design, 0 at best: budgets used, frequencies missed, expected links and standards
    missing, risky frequency steps, digital links into analog blocks, repeated kinds, and blocks without supply."""
    s = specs.select("design", "power_budget", "area_budget", "target_frequency", "standards")
    own = blocks.join(s.select("design", "target_frequency"), "design")
    clocked = F.col("kind").isin("digital", "mixed")
    gap = F.least(F.greatest((F.col("target_frequency") - F.col("frequency")) / F.col("target_frequency"), F.lit(0.0)), F.lit(1.0))
    totals = own.groupBy("design").agg(
        F.sum("power").alias("_p"),
        F.sum("area").alias("_a"),
        F.coalesce(F.avg(F.when(clocked, gap)), F.lit(0.0)).alias("timing"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("kind").isin("analog", "mixed")).alias("_quiet"),
        F.max((F.col("node") == supply).cast("int")).alias("_has"),
    )
    kinds = blocks.filter(~F.col("kind").isin("io", "memory")).groupBy("design", "kind").agg(F.count(F.lit(1)).alias("k"))
    excess = kinds.groupBy("design").agg(F.sum(F.greatest(F.col("k") - 2, F.lit(0))).alias("_excess"))

    end = blocks.select("design", "node", "kind", "frequency")
    a = end.select("design", F.col("node").alias("src"), F.col("frequency").alias("_fs"))
    b = end.select("design", F.col("node").alias("dst"), F.col("frequency").alias("_fd"), F.col("kind").alias("_kd"))
    wired = links.join(a, ["design", "src"]).join(b, ["design", "dst"])
    digital = F.col("domain") == "digital"
    risky = F.greatest("_fs", "_fd") / F.greatest(F.least("_fs", "_fd"), F.lit(0.001)) > 4.0
    wires = wired.groupBy("design").agg(F.count_if(digital).alias("_dig"), F.count_if(digital & risky).alias("_risky"), F.count_if(digital & F.col("_kd").isin("analog", "mixed")).alias("_noisy"))
    fed = links.filter((F.col("src") == supply) & (F.col("domain") == "power") & (F.col("dst") != supply)).select("design", F.col("dst").alias("node")).distinct()
    powered = blocks.join(fed, ["design", "node"], "left_semi").groupBy("design").agg(F.count(F.lit(1)).alias("_fed"))

    pairs = expected.join(a, "src").join(b.select("design", "dst"), ["design", "dst"]).select("design", "src", "dst")
    there = pairs.join(links.select("design", "src", "dst", F.lit(1).alias("_l")).distinct(), ["design", "src", "dst"], "left")
    connected = there.groupBy("design").agg(share(F.count_if(F.col("_l").isNull()), F.count(F.lit(1))).alias("connectivity"))

    asked = s.select("design", F.explode(F.array_distinct("standards")).alias("std"))
    offered = blocks.select("design", F.explode("interfaces").alias("face")).distinct()
    o, r = F.lower("face"), F.lower("std")
    met = asked.join(offered, "design").filter(o.contains(r) | r.contains(o)).select("design", "std").distinct().withColumn("_m", F.lit(1))
    covered = asked.join(met, ["design", "std"], "left").groupBy("design").agg(share(F.count_if(F.col("_m").isNull()), F.count(F.lit(1))).alias("coverage"))

    j = reduce(lambda x, y: x.join(y, "design", "left"), [s, totals, excess, wires, powered, connected, covered])
    nil = lambda c: F.coalesce(F.col(c), F.lit(0))
    rest = nil("_n") - nil("_has")
    return j.select(
        "design",
        F.when(F.col("power_budget") > 0, nil("_p") / F.col("power_budget")).otherwise(1.0).alias("power"),
        F.when(F.col("area_budget") > 0, nil("_a") / F.col("area_budget")).otherwise(1.0).alias("area"),
        F.coalesce("timing", F.lit(0.0)).alias("timing"),
        F.coalesce("connectivity", F.lit(0.0)).alias("connectivity"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        share(nil("_risky"), nil("_dig")).alias("crossing"),
        F.least(share(nil("_noisy"), nil("_quiet")), F.lit(1.0)).alias("isolation"),
        F.least(share(nil("_excess"), nil("_n")), F.lit(1.0)).alias("redundancy"),
        F.when(nil("_has") == 0, 1.0).otherwise(share(rest - nil("_fed"), rest)).alias("supply"),
    )


def graded(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted loss, the score 1 - loss / 2 (not below 0) to four digits, and its grade."""
    loss = sum(F.col(c) * w for c, w in weights.items()) / sum(weights.values())
    score = F.round(F.greatest(F.lit(0.0), 1 - loss / 2), 4)
    grade = F.lit(GRADES[-1][1])
    for least, name in reversed(GRADES):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return scored.withColumn("loss", loss).withColumn("score", score).withColumn("grade", grade)


def briefs(blocks: DataFrame, links: DataFrame, specs: DataFrame, ratio: float = 2.0) -> DataFrame:
    """What each block of a design may use: power with 15 and area with 10 per cent to spare, frequency up to the target;
    the blocks it drives and is driven by (power links apart), its supplies, and the digital neighbours whose frequency
    is more than `ratio` times apart."""
    key = ["design", "node"]
    ends = blocks.select("design", "node", "frequency")
    inside = links.join(ends.select("design", F.col("node").alias("src"), F.col("frequency").alias("_fs")), ["design", "src"]).join(ends.select("design", F.col("node").alias("dst"), F.col("frequency").alias("_fd")), ["design", "dst"])
    names = lambda c: F.array_sort(F.collect_set(c))
    data = inside.filter("domain <> 'power'")
    out = data.groupBy("design", F.col("src").alias("node")).agg(names("dst").alias("drives"))
    into = data.groupBy("design", F.col("dst").alias("node")).agg(names("src").alias("driven_by"))
    fed = inside.filter("domain = 'power'").groupBy("design", F.col("dst").alias("node")).agg(names("src").alias("powered_by"))
    far = F.greatest("_fs", "_fd") / F.greatest(F.least("_fs", "_fd"), F.lit(0.01)) > ratio
    apart = inside.filter((F.col("domain") == "digital") & far)
    note = lambda c, f: F.concat(F.col(c), F.lit(" ("), F.format_string("%.0f", F.col(f)), F.lit("MHz)"))
    both = apart.select("design", F.col("src").alias("node"), note("dst", "_fd").alias("note")).union(apart.select("design", F.col("dst").alias("node"), note("src", "_fs").alias("note")))
    crossings = both.groupBy(key).agg(names("note").alias("crossings"))
    base = blocks.join(specs.select("design", "target_frequency"), "design")
    made = base.select(*key, (F.col("power") * 1.15).alias("max_power"), (F.col("area") * 1.10).alias("max_area"), F.least("frequency", "target_frequency").alias("frequency"))
    for part in (out, into, fed, crossings):
        made = made.join(part, key, "left")
    empty = F.array().cast("array<string>")
    return made.withColumns({c: F.coalesce(c, empty) for c in ("drives", "driven_by", "powered_by", "crossings")})


def design_numbers(blocks: DataFrame, links: DataFrame, specs: DataFrame, latency: DataFrame) -> DataFrame:
    """Five numbers of each design: power and area against their budgets, critical latency (latency: design, total) in
    periods of the target, blocks / 20 and links / 50."""
    b = blocks.groupBy("design").agg(F.sum("power").alias("_p"), F.sum("area").alias("_a"), F.count(F.lit(1)).alias("_n"))
    e = links.groupBy("design").agg(F.count(F.lit(1)).alias("_e"))
    j = specs.join(b, "design").join(e, "design", "left").join(latency, "design", "left")
    over = lambda x, y: F.col(x) / F.greatest(y, F.lit(1.0))
    numbers = F.array(over("_p", F.col("power_budget")), over("_a", F.col("area_budget")), F.coalesce("total", F.lit(0.0)) / F.greatest(1000.0 / F.col("target_frequency"), F.lit(1.0)), F.col("_n") / 20.0, F.coalesce("_e", F.lit(0)) / 50.0)
    return j.select("design", numbers.alias("numbers"))
