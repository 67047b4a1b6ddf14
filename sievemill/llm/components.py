"""Connected components by hooking and contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected(edges: DataFrame, name: str = "labels") -> DataFrame:
    """edges (a, b), any direction -> (v, root): each vertex of an edge with the smallest vertex it can reach.

    In a round every vertex hooks to its smallest neighbour, if smaller, and takes the hook of that vertex. The edges
    are then drawn between hooks, equal ones once, and those within a hook vanish, so the graph shrinks from round to
    round; each is written to the shared folder. The hooks of all rounds, one after another, lead to the roots; they are
    written every few rounds. Vertices should be named at random, as fingerprints are: then a round takes away a fixed
    share of the vertices, whereas names that rise along a long path would take rounds in proportion to its length."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), f"{name}-edges")
    roots, rounds, hooks = None, 0, []
    while roots is None or both.limit(1).count():
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p"))
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("root"))
        hook = materialise(hook.join(up, "p").select("v", "root"), name)
        for_a, for_b = (hook.select(F.col("v").alias(c), F.col("root").alias(f"{c}r")) for c in "ab")
        drawn = both.join(for_a, "a").join(for_b, "b").select(F.col("ar").alias("a"), F.col("br").alias("b")).filter("a <> b").distinct()
        before, both = both, materialise(drawn, f"{name}-edges")
        discard(before)
        if roots is None:
            roots = hook
        else:
            later = hook.select(F.col("v").alias("root"), F.col("root").alias("_r"))
            roots = roots.join(later, "root", "left").select("v", F.coalesce("_r", "root").alias("root"))
        rounds += 1
        hooks.append(hook)
        if rounds % 4 == 0:
            roots = materialise(roots, name)
            discard(*hooks)
            hooks = [roots]
    found = materialise(roots, name)
    discard(both, *hooks)
    return found
