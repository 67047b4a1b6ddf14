"""Guards of transitions by decision trees, all transitions and nodes of a level in one pass.

A level takes two passes over the steps, which are written once: the range of each feature in each node, and counts by
bins of that range. The best cut of a node lies between two filled bins; as each level bins the ranges of its own nodes,
cuts get finer with depth. Ranges and trees are sent to the steps while they are small tables, so that only counts are
shuffled, at most BINS a node and feature.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.session import cut, sent, written

from .cuts import with_halo

BINS = 256


def steps(samples: DataFrame, features: list[str]) -> DataFrame:
    """samples (run_key, idx, state, features): src, next and x, for each sample but a run's last its state, the next
    one and the features there, as these drive the change. Rows with a missing feature are left out."""
    wide = with_halo(samples.select("run_key", "idx", "state", F.array(*[F.col(f).cast("double") for f in features]).alias("x")), 0, 1)
    by = Window.partitionBy("run_key", "piece").orderBy("idx")
    pairs = wide.select("own", F.col("state").alias("src"), F.lead("state").over(by).alias("next"), F.lead("x").over(by).alias("x"))
    return pairs.filter(F.col("own") & F.col("next").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))).drop("own")


def _score(pos: Column, n: Column) -> Column:
    """The larger over both sides, the lower the Gini impurity."""
    return F.try_divide(pos.cast("double") * pos, n)


def best_cuts(rows: DataFrame, bins: int) -> DataFrame:
    """rows (move, node, y, x): for each node n and pos, and feature and threshold of the cut with the lowest Gini
    impurity, the first feature and smallest threshold of equals; null where no cut lowers it."""
    node = ["move", "node"]
    each = rows.select(*node, "y", F.posexplode("x").alias("feature", "v"))
    span = sent(each.groupBy(*node, "feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    j = each.join(span, [*node, "feature"])
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"))).otherwise(0)
    hist = j.groupBy(*node, "feature", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.min("v").alias("low"), F.max("v").alias("high"))
    hist = written(hist)
    own = Window.partitionBy(*node, "feature")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumns({"nl": F.sum("n").over(upto), "pl": F.sum("pos").over(upto), "nt": F.sum("n").over(own), "pt": F.sum("pos").over(own), "after": F.lead("low").over(own.orderBy("bin"))})
    score = _score(F.col("pl"), F.col("nl")) + _score(F.col("pt") - F.col("pl"), F.col("nt") - F.col("nl"))
    cuts = hist.filter("after is not null").withColumn("score", score).filter(F.col("score") > _score(F.col("pt"), F.col("nt")) * (1 + 1e-12) + 1e-12)
    best = cuts.groupBy(*node).agg(F.min(F.struct((-F.col("score")).alias("s"), "feature", ((F.col("high") + F.col("after")) / 2).alias("threshold"))).alias("b"))
    size = hist.filter("feature = 0").groupBy(*node).agg(F.max("nt").alias("n"), F.max("pt").alias("pos"))
    return size.join(best.select(*node, "b.feature", "b.threshold"), node, "left")


def grow(pairs: DataFrame, depth: int = 4, bins: int = BINS, least: int = 3) -> DataFrame:
    """pairs (src, next, x): src, dst, node (1, children 2k and 2k + 1), n, pos, feature and threshold (null: a leaf) of
    a tree for each transition out of a state with so many steps: whether the next state is dst."""
    pairs = written(pairs)
    size = pairs.groupBy("src", "next").agg(F.count(F.lit(1)).alias("n"))
    moves = size.withColumn("of", F.sum("n").over(Window.partitionBy("src"))).filter((F.col("src") != F.col("next")) & (F.col("of") >= least)).select("src", F.col("next").alias("dst"))
    moves = sent(moves.withColumn("move", F.monotonically_increasing_id()))
    rows = pairs.join(moves, "src").select("move", F.lit(1).alias("node"), (F.col("next") == F.col("dst")).cast("int").alias("y"), "x")
    levels = []
    for level in range(depth + 1):
        found = best_cuts(rows, bins)
        levels.append(cut(found.withColumns({"feature": F.lit(None).cast("int"), "threshold": F.lit(None).cast("double")}) if level == depth else found))
        if level < depth:
            split = sent(levels[-1].filter("feature is not null").select("move", "node", "feature", "threshold"))
            right = (F.get("x", F.col("feature")) > F.col("threshold")).cast("int")
            rows = rows.join(split, ["move", "node"]).select("move", (F.col("node") * 2 + right).alias("node"), "y", "x")
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out.join(moves, "move").select("src", "dst", "node", "n", "pos", "feature", "threshold")


def condition_name(name: str) -> str:
    """V(...) for voltages and I(...) for currents, by the name."""
    up = name.upper()
    return f"V({name})" if up.startswith("V") or "VOLT" in up else f"I({name})" if up.startswith("I") or "CURR" in up else name


def guards(trees: DataFrame, features: list[str]) -> DataFrame:
    """src, dst, probability (of the transition, over the steps of src), guard (the path to the leaf with the highest
    share, the right one of equals), and share, steps of that leaf. A tree without cuts has the guard (1)."""

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = {int(r.node): r for r in pdf.itertuples()}

        def best(k: int) -> tuple[float, int, list[str]]:
            r = nodes[k]
            if pd.isna(r.feature):
                return r.pos / r.n, int(r.n), []
            name = condition_name(features[int(r.feature)])
            left, right = best(2 * k), best(2 * k + 1)
            way = right if right[0] >= left[0] else left
            return way[0], way[1], [f"{name} {'>' if way is right else '<='} {r.threshold:.4g}", *way[2]]

        share, n, conditions = best(1)
        root = nodes[1]
        return pd.DataFrame({"src": [root.src], "dst": [root.dst], "probability": [root.pos / root.n], "guard": ["(" + (" && ".join(conditions) or "1") + ")"], "share": [share], "steps": [n]})

    kind = dict(trees.dtypes)["src"]
    return trees.groupBy("src", "dst").applyInPandas(path, f"src {kind}, dst {kind}, probability double, guard string, share double, steps long")


def learn_guards(samples: DataFrame, features: list[str], depth: int = 4, bins: int = BINS) -> DataFrame:
    return guards(grow(steps(samples, features), depth, bins), features)
