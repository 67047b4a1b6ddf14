"""Operators over small directed graphs and netlists, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.session import cut, numbered


def layers(edges: DataFrame, start) -> DataFrame:
    """node and hops from the start, by breadth-first search until nothing new is reached: a round joins the newest layer
    only, so it costs the edges it touches, and is checkpointed; what was seen is, every few rounds."""
    edges = cut(edges.select("src", "dst").distinct())
    seen = front = edges.sparkSession.createDataFrame([(start, 0)], f"node {dict(edges.dtypes)['src']}, hops int")
    k = 0
    while True:
        k += 1
        new = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = cut(new.join(seen, "node", "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            return seen
        seen = seen.union(front) if k % 8 else cut(seen.union(front))


def reachable(edges: DataFrame, start) -> DataFrame:
    """Nodes downstream of the start; the start itself only if it lies on a cycle."""
    seen = layers(edges, start).select("node")
    back = edges.join(seen, edges["src"] == seen["node"]).filter(F.col("dst") == F.lit(start)).select(F.col("dst").alias("node"))
    return seen.filter(F.col("node") != F.lit(start)).union(back.distinct())


def longest_path(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """Latency of each node after so many relaxations of all edges: the largest sum of node latencies on a path into it
    (edges `src, dst`, nodes `node, latency`); a cycle grows until the rounds end."""
    best = nodes.select("node", F.col("latency").alias("total"))
    for k in range(rounds):
        into = edges.join(best.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("total").alias("before"))
        best = nodes.join(into, "node", "left").select("node", (F.col("latency") + F.coalesce("before", F.lit(0.0))).alias("total"))
        if k % 8 == 7:
            best = cut(best)
    return best


def net_edges(components: DataFrame, most: int | None = None, size: int = 2048) -> DataFrame:
    """Pairs of components on a common net, from (component, nets): one edge for each net they share. A net of more
    than `size` components is cut into groups, and each pair of groups is dealt out by itself, so one supply net is
    many tasks' work. Its pairs grow with the square of its components all the same: `most` leaves nets of more
    components out here, for net_members to tell."""
    on, n = _on_nets(components)
    on = on.join(n if most is None else n.filter(F.col("n") <= most), "net")
    groups = F.ceil(F.col("n") / size).cast("long")
    own = on.withColumn("_b", F.pmod(F.xxhash64("component"), groups)).withColumn("_n", groups)
    low = own.select("net", F.col("component").alias("a"), F.col("_b").alias("_p"), F.explode(F.sequence("_b", F.col("_n") - 1)).alias("_q"))
    high = own.select("net", F.col("component").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), "_b")).alias("_p"), F.col("_b").alias("_q"))
    pairs = low.join(high, ["net", "_p", "_q"]).filter((F.col("_p") < F.col("_q")) | (F.col("a") < F.col("b")))
    return pairs.select("net", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def net_members(components: DataFrame, least: int) -> DataFrame:
    """net, n and component of the nets with more than `least` components: the form for supplies and other nets whose
    pairs would be too many; two components on such a net share its row."""
    on, n = _on_nets(components)
    return on.join(n.filter(F.col("n") > least), "net").select("net", "n", "component")


def _on_nets(components: DataFrame) -> tuple[DataFrame, DataFrame]:
    on = components.select("component", F.explode(F.array_distinct("nets")).alias("net")).distinct()
    return on, on.groupBy("net").agg(F.count(F.lit(1)).alias("n"))


def degree_histogram(edges: DataFrame, bins: int = 10, top: int = 20) -> DataFrame:
    """Nodes by degree in equal bins from 0 to `top`, the last bin closed; higher degrees are left out."""
    d = edges.select(F.col("a").alias("n")).union(edges.select("b")).groupBy("n").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") <= top)
    return d.groupBy(F.least(F.floor(F.col("d") * bins / top), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("nodes"))


def cross_domain(edges: DataFrame, nodes: DataFrame, ratio: float = 4.0) -> DataFrame:
    """Edges between nodes of different domains whose frequencies differ by more than the ratio."""
    s = nodes.select(F.col("node").alias("src"), F.col("domain").alias("sd"), F.col("freq").alias("sf"))
    d = nodes.select(F.col("node").alias("dst"), F.col("domain").alias("dd"), F.col("freq").alias("df"))
    j = edges.join(s, "src").join(d, "dst").withColumn("ratio", F.greatest("sf", "df") / F.least("sf", "df"))
    return j.filter((F.col("sd") != F.col("dd")) & (F.col("ratio") > ratio)).select("src", "dst", "ratio")


def fan_lists(edges: DataFrame, exclude: str) -> DataFrame:
    """Sorted distinct fan-in and fan-out names of each node, edges of one kind left out; bounded by a node's degree."""
    e = edges.filter(F.col("kind") != exclude)
    out = e.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("fan_out"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("fan_in"))
    return out.join(into, "node", "full").select("node", F.coalesce("fan_in", F.array().cast("array<string>")).alias("fan_in"), F.coalesce("fan_out", F.array().cast("array<string>")).alias("fan_out"))


def mean_aggregate(edges: DataFrame, features: DataFrame) -> DataFrame:
    """One encoder layer without weights: mean of the out-neighbours' features, own features where there are none."""
    near = edges.join(features.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.avg("x").alias("_m"))
    return features.join(near, "node", "left").select("node", ((F.col("x") + F.coalesce("_m", "x")) / 2).alias("x"))


def cosine_top_k(items: DataFrame, query: list[float], k: int, eps: float = 1e-8) -> DataFrame:
    """The k items (i, iv) nearest to one vector by cosine (eps is added to each norm), ties by id: a scan and a top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    iv = F.transform("iv", lambda x: x.cast("double"))
    return items.select("i", _cosine(q, iv, eps).alias("sim")).orderBy(F.desc("sim"), "i").limit(k)


def _cosine(a: Column, b: Column, eps: float) -> Column:
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)) + eps
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (norm(a) * norm(b))


def cosine_neighbours(items: DataFrame, queries: DataFrame, k: int, eps: float = 1e-8) -> DataFrame:
    """query, rank, i, sim: the k items (i, iv) nearest to each query (i, iv) by cosine (eps is added to each norm), ties
    by id. Blocks of queries meet those blocks of items that may hold one of the k nearest; see blocks.py."""
    import numpy as np

    from .blocks import nearest_points

    def shaped(df: DataFrame) -> DataFrame:
        v = F.transform("iv", lambda x: x.cast("double"))
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + eps
        return df.select(F.col("i").cast("long").alias("id"), F.transform(v, lambda x: x / norm).alias("x"), F.lit(0).cast("long").alias("tag"))

    far = lambda q, _, p, __: -np.round(q @ p.T, 12)  # noqa: E731  equal vectors tie
    # |q - p|^2 = |q|^2 + |p|^2 - 2 cos, and both lengths are one but for eps and null vectors
    reach = lambda d: F.sqrt(F.greatest(2.0 + 2.0 * d + 1e-6, F.lit(0.0)))
    found = nearest_points(shaped(queries), shaped(items), k, far, reach)
    return found.select(F.col("id").alias("query"), "rank", F.col("point").alias("i"), (-F.col("distance")).alias("sim"))


def link_weights(links: DataFrame, order: str) -> DataFrame:
    """One row for each (src, dst): the weight of the last link between them."""
    return links.groupBy("src", "dst").agg(F.max_by("weight", order).alias("weight"))


def _dense(weights: list[list[float]], x: Column) -> Column:
    """A matrix, one row an output, times a vector."""
    return F.array(*[F.aggregate(F.zip_with(F.array(*[F.lit(float(w)) for w in row]), x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for row in weights])


def encode_layer(edges: DataFrame, features: DataFrame, own: list[list[float]], near: list[list[float]]) -> DataFrame:
    """features (design, node, x) through one layer: own weights times x plus near weights times the mean of the
    out-neighbours' x (zeros without any), scaled to unit length."""
    size = len(own[0])
    of = edges.join(features.withColumnRenamed("node", "dst"), ["design", "dst"])
    sums = of.groupBy("design", F.col("src").alias("node")).agg(F.array(*[F.avg(F.col("x")[k]) for k in range(size)]).alias("_m"))
    j = features.join(sums, ["design", "node"], "left").withColumn("_m", F.coalesce("_m", F.array_repeat(F.lit(0.0), size)))
    j = j.withColumn("_h", F.zip_with(_dense(own, F.col("x")), _dense(near, F.col("_m")), lambda a, b: a + b))
    norm = F.sqrt(F.aggregate("_h", F.lit(0.0), lambda s, v: s + v * v))
    return j.select("design", "node", F.transform("_h", lambda v: F.when(norm > 0, v / norm).otherwise(v)).alias("x"))


def encode_designs(edges: DataFrame, features: DataFrame, layers_: list[tuple[list[list[float]], list[list[float]]]], stats: DataFrame) -> DataFrame:
    """Vector of each design: the mean of its nodes after all layers, and its own numbers (stats: design, numbers)."""
    h = features
    for own, near in layers_:
        h = encode_layer(edges, h, own, near)
    size = len(layers_[-1][0])
    pooled = h.groupBy("design").agg(F.array(*[F.avg(F.col("x")[k]) for k in range(size)]).alias("pooled"))
    return pooled.join(stats, "design").select("design", F.concat("pooled", "numbers").alias("vector"))
