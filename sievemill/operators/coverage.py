"""Coverage models: nested features, groups, points and bins; merging, crosses, gaps and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flatten(models: DataFrame) -> DataFrame:
    """One row a bin, with the dotted path of each level, from features: array<name, groups: array<name, points:
    array<name, bins: array<name>>>>; levels without children keep a row."""
    f = models.select(F.explode_outer("features").alias("f"))
    g = f.select(F.col("f.name").alias("feature"), F.explode_outer("f.groups").alias("g"))
    p = g.select("feature", F.col("g.name").alias("group"), F.explode_outer("g.points").alias("p"))
    b = p.select("feature", "group", F.col("p.name").alias("point"), F.explode_outer("p.bins").alias("b"))
    return b.select("feature", "group", "point", F.col("b.name").alias("bin")).withColumn("path", F.concat_ws(".", "feature", "group", "point", "bin"))


def totals(flat: DataFrame) -> DataFrame:
    """Counts of features, groups, points and bins."""
    key = lambda *c: F.countDistinct(F.when(F.col(c[-1]).isNotNull(), F.struct(*c)))
    return flat.agg(F.countDistinct("feature").alias("features"), key("feature", "group").alias("groups"), key("feature", "group", "point").alias("points"), F.count("bin").alias("bins"))


def merge_models(models: DataFrame) -> DataFrame:
    """Rows (model, feature, group, ...) of several models as one: of equal (feature, group) those of the first model."""
    first = models.groupBy("feature", "group").agg(F.min("model").alias("model"))
    return models.join(first, ["feature", "group", "model"])


def resolve(paths: DataFrame, flat: DataFrame) -> DataFrame:
    """Points under each path of one to three levels (feature, feature.group, feature.group.point)."""
    points = flat.select("feature", "group", "point").distinct()
    levels = points.select(F.explode(F.array("feature", F.concat_ws(".", "feature", "group"), F.concat_ws(".", "feature", "group", "point"))).alias("path"), F.concat_ws(".", "feature", "group", "point").alias("target"))
    return paths.join(levels, "path", "left")


def cross_points(crosses: DataFrame, flat: DataFrame) -> DataFrame:
    """crosses (name, targets) with the points that their targets expand to, and whether the cross is valid: two
    targets at least and all of them known."""
    t = crosses.select("name", F.size("targets").alias("k"), F.explode("targets").alias("path"))
    r = resolve(t, flat)
    found = r.groupBy("name", "k").agg(F.countDistinct("target").alias("points"), F.countDistinct(F.when(F.col("target").isNotNull(), F.col("path"))).alias("known"), F.countDistinct("path").alias("asked"))
    return found.select("name", "points", ((F.col("k") >= 2) & (F.col("known") == F.col("asked"))).alias("valid"))


def register_bins(width: Column, access: Column) -> Column:
    """Names of the bins of a register field: both values of one bit; zero, middle and top up to 4 bits; zero, the
    middle quarters and top up to 8 and beyond; a read-only field gets one more that ignores writes."""
    bins = (
        F.when(width == 1, F.array(F.lit("zero"), F.lit("one")))
        .when(width <= 4, F.array(F.lit("zero"), F.lit("mid"), F.lit("max")))
        .otherwise(F.array(F.lit("zero"), F.lit("low"), F.lit("mid"), F.lit("high"), F.lit("max")))
    )
    return F.when(access == "RO", F.concat(bins, F.array(F.lit("write_ignored")))).otherwise(bins)


def register_ranges(width: Column) -> Column:
    """Low and high end of the inner bins: everything between zero and the top, for wide fields in quarters."""
    top = F.pow(F.lit(2), width).cast("long") - 1
    quarter = F.floor((top + 1) / 4)
    pair = lambda a, b: F.struct(a.cast("long").alias("low"), b.cast("long").alias("high"))
    zero = F.lit(0)
    small = F.array(pair(zero, zero), pair(zero + 1, top - 1), pair(top, top))
    wide = F.array(pair(zero, zero), pair(zero + 1, quarter - 1), pair(quarter, 3 * quarter - 1), pair(3 * quarter, top - 1), pair(top, top))
    return F.when(width == 1, F.array(pair(zero, zero), pair(top, top))).when(width <= 4, small).otherwise(wide)


def scorecard(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """One row: expected, covered and per cent of the expected keys that were seen."""
    j = expected.select(*keys).distinct().join(seen.select(*keys).distinct().withColumn("_s", F.lit(1)), keys, "left")
    return j.agg(F.count(F.lit(1)).alias("expected"), F.count("_s").alias("covered")).withColumn("pct", 100.0 * F.col("covered") / F.greatest("expected", F.lit(1)))


def missing(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows that were never seen, in the expected order (column ord)."""
    return expected.join(seen.select(*keys).distinct(), keys, "left_anti").orderBy("ord")


def output_gaps(signatures: DataFrame, rules: DataFrame) -> DataFrame:
    """States whose mean output bit contradicts the value that their role asks for: signatures (state, role, output,
    mean), rules (role, output, expected 0 or 1)."""
    j = signatures.join(rules, ["role", "output"])
    return j.filter((F.col("mean") >= 0.5).cast("int") != F.col("expected"))


def gap_report(missing_states: DataFrame, missing_moves: DataFrame, short: DataFrame) -> DataFrame:
    """One row a gap with its kind and the run that would close it."""
    a = missing_states.select(F.lit("state").alias("kind"), F.col("state").alias("subject"), F.concat(F.lit("drive into "), "state").alias("action"))
    b = missing_moves.select(F.lit("transition").alias("kind"), F.concat_ws("->", "src", "dst").alias("subject"), F.concat(F.lit("stay in "), "src", F.lit(", then go to "), "dst").alias("action"))
    c = short.select(F.lit("dwell").alias("kind"), F.col("state").alias("subject"), F.concat(F.lit("stay longer in "), "state").alias("action"))
    return a.unionByName(b).unionByName(c)


def ip_profiles(instances: DataFrame, built_in: DataFrame, overrides: DataFrame, generic: str = "generic") -> DataFrame:
    """states of each instance's type: an override beats the built-in profile; an unknown type gets two states and a notice."""
    o, b = overrides.select("ip_type", F.col("states").alias("_o")), built_in.select("ip_type", F.col("states").alias("_b"))
    j = instances.join(o, "ip_type", "left").join(b, "ip_type", "left")
    unknown = F.col("_o").isNull() & F.col("_b").isNull()
    return j.select(*instances.columns, F.coalesce("_o", "_b", F.array(F.lit("OFF"), F.lit("ON"))).alias("states"), F.when(unknown, F.concat(F.lit(f"no profile, using {generic}: "), F.coalesce("ip_type", F.lit("?")))).alias("notice"))


def viewer_signals(results: DataFrame, rules: list[tuple[str, list[str]]], default: list[str]) -> DataFrame:
    """Failing rows with the signals to show: those of every rule whose text is in the checker's name, in order, once."""
    lists = [F.when(F.lower("checker").contains(text), F.array(*[F.lit(s) for s in signals])).otherwise(F.array().cast("array<string>")) for text, signals in rules]
    found = F.array_distinct(F.concat(*lists))
    chosen = F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(s) for s in default]))
    return results.filter("status = 'FAIL'").withColumn("signals", chosen)


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def richness(seen: DataFrame, settled: DataFrame, flat: list[str]) -> DataFrame:
    """One row: seen transitions (src, dst), those that are rich, and their share in per cent. A transition is rich if a
    stretch of its target settles (settled: state, settled) or the target's name begins with one that has no transient."""
    ok = settled.filter("settled").select(F.col("state").alias("dst")).distinct().withColumn("_ok", F.lit(True))
    begins = F.lit(False)
    for name in flat:
        begins = begins | F.upper("dst").startswith(name.upper())
    j = seen.select("src", "dst").distinct().join(ok, "dst", "left").withColumn("_rich", begins | F.coalesce("_ok", F.lit(False)))
    return j.agg(F.count(F.lit(1)).alias("seen"), F.count_if("_rich").alias("rich")).withColumn("pct", 100.0 * F.col("rich") / F.greatest("seen", F.lit(1)))
