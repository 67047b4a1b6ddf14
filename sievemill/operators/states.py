"""State machines seen in samples: patterns, signatures, transitions and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.session import numbered

from .sequence import by_run


def pattern_states(samples: DataFrame, pattern: str, order: list[str]) -> DataFrame:
    """state_id by first appearance of each pattern, and how many samples show it."""
    firsts = samples.groupBy(pattern).agg(F.min(F.struct(*order)).alias("_f"), F.count(F.lit(1)).alias("n"))
    return numbered(firsts, "state_id", "_f").select(F.col("state_id").cast("int").alias("state_id"), pattern, "n")


def merge_rare(states: DataFrame, bits: str, share: float = 0.002, least: int = 3) -> DataFrame:
    """Each rare pattern (fewer than max(least, bround(share * total)) samples) goes to the frequent one at the
    smallest Hamming distance, the first seen of equals. The frequent ones, at most 1 / share or 1.5 / share for few
    samples, are one array, of which each rare pattern takes the minimum."""
    total = F.broadcast(states.agg(F.sum("n").alias("_total")))  # one row
    marked = states.join(total).withColumn("rare", F.col("n") < F.greatest(F.lit(least), F.bround(F.col("_total") * share))).drop("_total")
    kept = F.broadcast(marked.filter("not rare").agg(F.collect_list(F.struct("state_id", bits)).alias("_kept")))  # one row
    far = lambda k: F.struct(F.bit_count(F.col(bits).bitwiseXOR(k[bits])).alias("far"), k["state_id"].alias("to_id"))
    best = F.when(F.col("rare"), F.array_min(F.transform("_kept", far))["to_id"])
    return marked.join(kept).select("state_id", bits, "n", F.coalesce(best, "state_id").alias("merged_id"))


def transitions(samples: DataFrame, state: str = "state") -> DataFrame:
    """Changes from one sample to the next of a run: count, and share of the first state's samples that have a next."""
    pairs = samples.select("run_key", F.col(state).alias("src"), F.lead(state).over(by_run()).alias("dst")).filter("dst IS NOT NULL")
    out = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = out.withColumn("of", F.sum("n").over(Window.partitionBy("src"))).filter("src <> dst")
    return out.select("src", "dst", "n", (F.col("n") / F.col("of")).alias("probability"))


def signatures(samples: DataFrame, columns: list[str]) -> DataFrame:
    """Means of binarized outputs by state."""
    return samples.groupBy("state").agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n"))


def thin_states(samples: DataFrame, defined: DataFrame, least: int = 20) -> DataFrame:
    """Defined states with fewer samples than needed, unseen ones included."""
    n = samples.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return defined.select("state").join(n, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < least)


def validate(defined: DataFrame, moves: DataFrame, start: str, exempt: list[str]) -> DataFrame:
    """Per state: reachable from the start, and complete (has a way out, unless exempt)."""
    from .graph import reachable

    reach = reachable(moves.select("src", "dst"), start).select(F.col("node").alias("state"), F.lit(True).alias("_r"))
    out = moves.select(F.col("src").alias("state")).distinct().withColumn("_o", F.lit(True))
    found = defined.select("state").join(reach, "state", "left").join(out, "state", "left")
    return found.select(
        "state",
        (F.coalesce("_r", F.lit(False)) | (F.col("state") == start)).alias("reachable"),
        (F.coalesce("_o", F.lit(False)) | F.col("state").isin(exempt)).alias("complete"),
    )


def ambiguous_guards(moves: DataFrame) -> DataFrame:
    """Guards (src, guard, dst) that stand at more than one way out of a state: there the machine is not deterministic."""
    return moves.groupBy("src", "guard").agg(F.count(F.lit(1)).alias("ways")).filter("ways > 1")


def machine_report(defined: DataFrame, moves: DataFrame, start: str, exempt: list[str], seen: DataFrame) -> DataFrame:
    """One row: states, how many are reachable and complete, ambiguous guards, and the share of states seen in samples."""
    v = validate(defined, moves, start, exempt)
    hit = defined.select("state").join(seen.select("state").distinct(), "state", "left_semi").agg(F.count(F.lit(1)).alias("_h"))
    ways = ambiguous_guards(moves).agg(F.count(F.lit(1)).alias("ambiguous"))
    totals = v.agg(F.count(F.lit(1)).alias("states"), F.count_if("reachable").alias("reachable"), F.count_if("complete").alias("complete"))
    one = totals.join(F.broadcast(ways)).join(F.broadcast(hit))  # one row each
    return one.withColumn("deterministic", F.col("ambiguous") == 0).withColumn("seen_pct", 100.0 * F.col("_h") / F.greatest("states", F.lit(1))).drop("_h")


def changed_bits_guard(before: str = "before", after: str = "after"):
    """Guard text of a transition between two maps of bits: `k == v` for the keys that changed, in key order."""
    changed = F.map_filter(F.col(after), lambda k, v: ~v.eqNullSafe(F.try_element_at(F.col(before), k)))
    parts = F.transform(F.array_sort(F.map_entries(changed)), lambda e: F.concat_ws(" == ", e["key"], e["value"].cast("string")))
    return F.array_join(parts, " && ")


def state_means(samples: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Mean, mean magnitude, rms and population deviation of the value by state and more keys."""
    v = F.col("value")
    out = samples.groupBy("state", *by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.avg(F.abs(v)).alias("mean_abs"), F.sqrt(F.avg(v * v)).alias("rms"), F.stddev_pop(v).alias("std"))
    return out.filter(F.col("n") >= least)


def dominance(means: DataFrame, supply: str, primary: str, times: float = 3.0) -> DataFrame:
    """Per state the supplies by falling mean magnitude, and a mismatch where another one than the primary dominates it."""
    by = Window.partitionBy("state").orderBy(F.desc("mean_abs"), supply)
    own = F.max(F.when(F.col(supply) == primary, F.col("mean_abs"))).over(Window.partitionBy("state"))
    ranked = means.withColumn("rank", F.row_number().over(by)).withColumn("_p", own)
    mismatch = (F.col("rank") == 1) & (F.col(supply) != primary) & (F.col("mean_abs") > times * F.col("_p"))
    return ranked.select("state", supply, "mean_abs", "rms", "rank", F.coalesce(mismatch, F.lit(False)).alias("mismatch"))


def transition_sensitivity(samples: DataFrame, reach: int = 3, top: int = 8) -> DataFrame:
    """States entered, by the mean magnitude of the change across `reach` samples on both sides, clipped to the run."""
    n = F.max("idx").over(Window.partitionBy("run_key"))
    ahead, behind = F.least(F.lit(reach), n - F.col("idx")), F.least(F.lit(reach), F.col("idx"))
    later = F.coalesce(*[F.when(ahead == k, F.lead("value", k).over(by_run())) for k in range(reach + 1)])
    sooner = F.coalesce(*[F.when(behind == k, F.lag("value", k).over(by_run())) for k in range(reach + 1)])
    at = samples.withColumn("step", F.abs(later - sooner)).withColumn("_p", F.lag("state").over(by_run())).filter("state <> _p")
    return at.groupBy("state").agg(F.avg("step").alias("sensitivity"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("sensitivity"), "state").limit(top)
