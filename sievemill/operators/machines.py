"""Naming and masking of states, interface and activity predicates, and report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.session import bounded

from .cuts import with_halo

SEVERITIES = ("critical", "high", "medium", "low", "info")


def column_kinds(wide: DataFrame, names: list[str], low: float = 0.15, high: float = 0.85, mean_below: float = 0.05, max_below: float = 0.5) -> DataFrame:
    """signal, mean_share, max_share and digital of the columns (run_key, idx, t, names...), all in one pass: the share
    of its time that a run spends strictly between the two levels of the signal's range, over the runs. A signal that
    never changes spends none."""
    by = Window.partitionBy("run_key", "piece").orderBy("idx")
    held = F.greatest(F.coalesce(F.lead("t").over(by) - F.col("t"), F.lit(0.0)), F.lit(0.0))
    rows = with_halo(wide, 0, 1).withColumn("_w", held).filter("own")
    pairs = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).cast("double").alias("value")) for n in names])
    tall = rows.select("run_key", "_w", F.explode(pairs).alias("p")).select("run_key", "_w", "p.*")
    span = tall.groupBy("signal").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # one row a signal
    z = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    inside = F.sum(F.when((z > low) & (z < high), F.col("_w")).otherwise(0.0))
    shares = tall.join(F.broadcast(span), "signal").groupBy("signal", "run_key").agg(F.try_divide(inside, F.sum("_w")).alias("share"))
    out = shares.groupBy("signal").agg(F.avg("share").alias("mean_share"), F.max("share").alias("max_share"))
    return out.withColumn("digital", (F.col("mean_share") < mean_below) & (F.col("max_share") < max_below))


def digital_columns(wide: DataFrame, names: list[str], inputs: list[str], outputs: list[str]) -> list[str]:
    """Digital signals of the columns (run_key, idx, t, names...): the declared inputs among them or, without any, all
    that are no outputs. One row a signal reaches the driver."""
    found = {r["signal"] for r in column_kinds(wide, names).filter("digital").select("signal").collect()}
    digital = [n for n in names if n in found]
    return [n for n in digital if n in inputs] or [n for n in digital if n not in outputs]


def logic_pattern(columns: list[str]) -> Column:
    """The bits of the columns as one string, in order; without columns a constant."""
    return F.concat(*[F.col(c).cast("string") for c in columns]) if columns else F.lit("0")


def active(state: Column, value: Column, peak: Column, off_names: list[str], share: float = 0.05) -> Column:
    """Not in a state whose name tells that it is off; where the state is unknown, above a share of the peak."""
    off = F.lower(state).rlike("|".join(off_names)) if off_names else F.lit(False)
    return F.when(state.isNotNull(), ~off).otherwise(F.abs(value) > share * peak)


def named_states(samples: DataFrame, defined: DataFrame) -> DataFrame:
    """Samples with the name of their state; an unknown id is called STATE_<id>."""
    return samples.join(defined.select("state_id", "name"), "state_id", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("STATE_"), F.col("state_id"))))


def with_fallback_key(runs: DataFrame, sequences: DataFrame) -> DataFrame:
    """The sequence of run@corner or, without one, of the run."""
    full = sequences.select(F.col("key").alias("_k1"), F.col("sequence").alias("_s1"))
    run = sequences.select(F.col("key").alias("_k2"), F.col("sequence").alias("_s2"))
    j = runs.join(full, F.concat_ws("@", "run", "corner") == F.col("_k1"), "left").join(run, F.col("run") == F.col("_k2"), "left")
    return j.withColumn("sequence", F.coalesce("_s1", "_s2")).drop("_k1", "_k2", "_s1", "_s2")


def name_states(states: DataFrame, enable: str = "enable", fault: str = "fault", ready: str = "ready") -> DataFrame:
    """Names by role from bits (state_id and the role columns): FAULT beats DISABLED beats REGULATION beats STARTUP;
    equal names get _2, _3, ... by id, DISABLED never changes."""
    base = F.when(F.col(fault) == 1, "FAULT").when(F.col(enable) == 0, "DISABLED").when(F.col(ready) == 1, "REGULATION").otherwise("STARTUP")
    k = F.row_number().over(Window.partitionBy("_n").orderBy("state_id"))
    return states.withColumn("_n", base).withColumn("_k", k).withColumn("name", F.when((F.col("_k") == 1) | (F.col("_n") == "DISABLED"), F.col("_n")).otherwise(F.concat_ws("_", "_n", "_k"))).drop("_n", "_k")


def split_modes(states: DataFrame, moves: DataFrame, mode_of: str, modes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Replaces one state by one a mode, and each of its transitions by one a mode."""
    parts = F.array(*[F.concat(F.lit(f"{mode_of}_"), F.lit(m)) for m in modes])
    fan = lambda c: F.when(F.col(c) == mode_of, parts).otherwise(F.array(F.col(c)))
    s = states.select(F.explode(fan("state")).alias("state"))
    m = moves.select(F.explode(fan("src")).alias("src"), "dst").select("src", F.explode(fan("dst")).alias("dst")).filter("src <> dst").distinct()
    return s, m


def state_space_size(bits: int, masked: int = 0) -> int:
    """Patterns of so many free bits, without those masked."""
    return (1 << max(0, bits)) - masked


def unmet_interfaces(required: DataFrame, offered: DataFrame) -> DataFrame:
    """Required standards that no offered name holds or lies in, whatever the case; both are dimensions."""
    r, o = F.lower("standard"), F.lower("interface")
    return required.join(bounded(offered), r.contains(o) | o.contains(r), "left_anti")


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: blocks, links, area and power in all, and the block with the most power."""
    n = nodes.agg(F.count(F.lit(1)).alias("blocks"), F.sum("area").alias("area"), F.sum("power").alias("power"), F.max_by("node", F.struct("power", "node")).alias("hungriest"))
    return n.withColumn("links", F.lit(edges.count()).cast("long"))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the distinct tokens of two texts that they have in common."""
    t = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9_]+"), lambda y: y != ""))
    return F.size(F.array_intersect(t(a), t(b))) / F.greatest(F.size(F.array_union(t(a), t(b))), F.lit(1))


def ordered_findings(findings: DataFrame, key: str) -> DataFrame:
    """Findings from critical to info, then by key."""
    order = F.array(*[F.lit(s) for s in SEVERITIES])
    return findings.orderBy(F.array_position(order, F.col("severity")), key)


def finding_lines(findings: DataFrame) -> DataFrame:
    """One Markdown line and one JSON object a finding; files are written from them as text."""
    line = F.concat(F.lit("- **"), F.upper("severity"), F.lit("** "), "summary", F.when(F.col("action").isNotNull(), F.concat(F.lit(" ("), "action", F.lit(")"))).otherwise(""))
    return findings.select("*", line.alias("markdown"), F.to_json(F.struct(*findings.columns)).alias("json"))


def junit_cases(results: DataFrame) -> DataFrame:
    """One test case element a result."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    body = F.when(F.col("status") == "FAIL", F.concat(F.lit('><failure message="'), F.coalesce(esc("message"), F.lit("")), F.lit('"/></testcase>'))).otherwise("/>")
    return results.select(F.concat(F.lit('<testcase classname="'), esc("checker"), F.lit('" name="'), esc("item"), F.lit('"'), body).alias("element"))
