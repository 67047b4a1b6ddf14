"""Near-duplicate vectors of one label by NN-descent.

Equal vectors of a label are one class with a count. A first neighbour graph comes from random splits: each of a few
forests deals the classes by the signs of random projections to bounded partitions, where random trees cut them into
leaves that are compared whole. The graph is then refined round by round: the neighbours of each class, in both
directions, are joined with their vectors and compared with each other, and each class keeps its LIST best. Only
neighbours within twice the angle of the threshold are held, as a path over farther ones says little about a link;
rounds end when they change few lists.

A list whose last entry is still a link is saturated: there may be more links than it holds. Such a list is enlarged to
all of the class's component. The component is cut into blocks by place, and block pairs are decided by the distance of
their centres and their radii where that suffices, else by comparing their vectors; only counts leave a task, so a
group of copies of any size needs no list of its pairs.

The recall is audited: a bounded sample (AUDIT_ROWS at random, and as many with links) is compared with all classes. If
the links found are fewer than LEAST_RECALL of these, further forests are added and the rounds run again, at most
PASSES times; the last figure is returned with the rows.

Defined cases: vectors that are null, empty, zero or not finite throughout, and rows with a null label, link with
nothing; vectors of different lengths neither; each row is a vector, so rows of one id are linked like any others, and
those with their component's id are all kept; a row without an id is its own component, with a null id, unless it is
linked, and is kept if that id is null; columns other than id, vector and label are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_map, discard, materialise, pandas_map, small_batches
from .components import connected
from .negatives import schema_of
from .vectors import usable
from .whitening import matrix_of

#: Entries of a neighbour list, forests of a pass, random trees in a partition, rows of a leaf, bits of a cell.
LIST, FORESTS, TREES, LEAF, BITS = 16, 3, 4, 256, 12
#: Bytes of vectors in a partition, vectors of a block.
PART_BYTES, BLOCK = 2 << 20, 2048
ROUNDS, PASSES, LEAST_RECALL, AUDIT_ROWS = 4, 3, 0.99, 256
EDGE = "u long, v long, cos double"
MARGIN = 1e-9


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither vanish nor overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors for each length."""
    sizes = np.diff(column.offsets.to_numpy())
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, units(matrix_of(column.take(pa.array(at))))


def _cells(seeds: list[int]):
    """The signs of BITS random projections, as a number, for each forest."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            out = np.zeros((len(xs), len(seeds)), dtype=np.int64)
            size = xs.map(len).to_numpy()
            for d in np.unique(size):
                own = size == d
                ways = np.concatenate([np.random.default_rng([s, d]).standard_normal((d, BITS)) for s in seeds], axis=1)
                side = (units(np.stack(xs[own].to_list())) @ ways > 0).reshape(own.sum(), len(seeds), BITS)
                out[own] = side @ (1 << np.arange(BITS, dtype=np.int64))
            yield pd.Series(list(out))

    return run


def leaves(u: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Random halves of the rows, down to LEAF rows."""
    todo = [np.arange(len(u))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            yield own
            continue
        order = own[np.argsort(u[own] @ rng.standard_normal(u.shape[1]), kind="stable")]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]


def nearest(c: np.ndarray, floor: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in c of the best of each row from floor up, but for the diagonal."""
    np.fill_diagonal(c, -2)
    if c.shape[1] > most:
        col = np.argpartition(-c, most - 1, axis=1)[:, :most]
    else:
        col = np.broadcast_to(np.arange(c.shape[1]), c.shape)
    row = np.broadcast_to(np.arange(len(c))[:, None], col.shape)
    fit = np.take_along_axis(c, col, axis=1) >= floor
    return row[fit], col[fit]


def _first_graph(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            forest, label, c = (batch.column(k).to_numpy() for k in range(3))
            for at, u in by_length(batch.column(3)):
                key = np.stack([forest[at], label[at]], axis=1)
                for f, lab in np.unique(key, axis=0):
                    own = (key == (f, lab)).all(axis=1)
                    held.setdefault((u.shape[1], f, lab), []).append((c[at[own]], u[own]))
        for (_, f, _), parts in held.items():
            c, u = (np.concatenate(p) for p in zip(*parts))
            rng = np.random.default_rng([int(f), len(c)])
            for _ in range(TREES if len(c) > LEAF else 1):
                for own in leaves(u, rng):
                    cos = u[own] @ u[own].T
                    r, k = nearest(cos, floor, LIST)
                    yield pa.RecordBatch.from_arrays([pa.array(c[own[r]]), pa.array(c[own[k]]), pa.array(cos[r, k])], schema=pa.schema([("u", pa.int64()), ("v", pa.int64()), ("cos", pa.float64())]))

    return run


def best_lists(edges: DataFrame) -> DataFrame:
    """The LIST best neighbours of each class; Spark keeps LIST a task before it shuffles."""
    one = edges.groupBy("u", "v").agg(F.max("cos").alias("cos"))
    best = Window.partitionBy("u").orderBy(F.desc("cos"), "v")
    return one.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= LIST).drop("_r")


def _compare(floor: float):
    """All neighbours of w with each other: pairs that enter the list of their first class."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        length = pdf["x"].map(len).to_numpy()
        for d in np.unique(length):
            own = pdf[length == d].sort_values("w", kind="stable")
            ids, last, u, w = own["v"].to_numpy(), own["last"].to_numpy(), units(np.stack(own["x"].to_list())), own["w"].to_numpy()
            starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(w)]):
                cos = u[s:e] @ u[s:e].T
                np.fill_diagonal(cos, -2)
                r, k = np.nonzero((cos >= floor) & (cos > last[s:e, None]))
                out.append(pd.DataFrame({"u": ids[s + r], "v": ids[s + k], "cos": cos[r, k]}))
        found = pd.concat(out) if out else pd.DataFrame({"u": [], "v": [], "cos": []}).astype({"u": "int64", "v": "int64", "cos": "float64"})
        found = found.drop_duplicates(["u", "v"]).sort_values(["u", "cos"], ascending=[True, False])
        return found[found.groupby("u").cumcount() < LIST]

    return run


def refine(lists: DataFrame, classes: DataFrame, floor: float, threshold: float) -> tuple[DataFrame, int]:
    """One round of neighbours of neighbours: the new lists, and how many entries are new."""
    small_batches(lists.sparkSession)
    last = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("last"))
    # a full list of links gains nothing by better ones
    last = last.select(F.col("u").alias("v"), F.when(F.col("n") < LIST, F.lit(floor)).when(F.col("last") >= threshold, F.lit(2.0)).otherwise(F.col("last")).alias("last"))
    both = lists.select(F.col("u").alias("w"), "v", "cos").union(lists.select(F.col("v").alias("w"), F.col("u").alias("v"), "cos"))
    both = both.groupBy("w", "v").agg(F.max("cos").alias("cos"))  # both directions may differ in the last bit
    top = Window.partitionBy("w").orderBy(F.desc("cos"), "v")
    hood = both.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= 2 * LIST).select("w", "v")
    hood = materialise(hood.join(last, "v", "left").fillna(floor, ["last"]), "hood")
    buckets = max(1, hood.count() // 20_000)
    dealt = hood.join(classes.select(F.col("c").alias("v"), "x"), "v").withColumn("_b", F.pmod(F.xxhash64("w"), F.lit(buckets)))
    found = dealt.groupBy("_b").applyInPandas(_compare(floor), EDGE)
    out = materialise(best_lists(lists.union(found)), "lists")
    new = out.join(lists.select("u", "v"), ["u", "v"], "left_anti").count()
    discard(hood)
    return out, new


# --- saturated lists: counts within their components

HELD = "block long, root long, dim int, n long, centre binary, radius double, c binary, copies binary, u binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = schema_of(HELD.replace("radius double, ", ""))
    schema = pa.schema([*list(kinds)[:5], ("radius", pa.float64()), *list(kinds)[5:]])
    held: dict[tuple, list] = {}
    number = TaskContext.get().partitionId() << 24

    def out(root: int, dim: int, parts: list) -> pa.RecordBatch:
        nonlocal number
        number += 1
        c, copies, u = (np.concatenate(p) for p in zip(*parts))
        centre = u.mean(axis=0)
        row = [number, root, dim, int(copies.sum()), centre.tobytes(), float(np.sqrt(((u - centre) ** 2).sum(axis=1).max())), c.tobytes(), copies.tobytes(), u.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema)], schema=schema)

    for batch in batches:
        root, c, copies = (batch.column(k).to_numpy() for k in range(3))
        for at, u in by_length(batch.column(3)):
            for r in np.unique(root[at]):
                own = root[at] == r
                parts = held.setdefault((int(r), u.shape[1]), [])
                parts.append((c[at[own]], copies[at[own]], u[own]))
                if sum(len(p[0]) for p in parts) >= BLOCK:
                    yield out(int(r), u.shape[1], held.pop((int(r), u.shape[1])))
    for (r, d), parts in held.items():
        yield out(r, d, parts)


def _decide(threshold: float):
    """all: every pair of two blocks is a link; some: vectors must be compared; pairs without links go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gap = np.array([np.sqrt(((np.frombuffer(a) - np.frombuffer(b)) ** 2).sum()) for a, b in zip(pdf["centre"], pdf["centre2"])])
            spread = (pdf["radius"] + pdf["radius2"]).to_numpy()
            every = 1 - (gap + spread + MARGIN) ** 2 / 2 >= threshold + MARGIN
            none = 1 - np.maximum(gap - spread - MARGIN, 0) ** 2 / 2 < threshold - MARGIN
            yield pd.DataFrame({"block": pdf["block"], "block2": pdf["block2"], "n2": pdf["n2"], "all": every})[~none]

    return run


def _count(threshold: float):
    """Links of each class of a block with those of other blocks, added up while the block stays the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[int, tuple] = {}
            for r in pdf.itertuples():
                a, b = (np.frombuffer(v).reshape(-1, r.dim) for v in (r.u, r.u2))
                n = (a @ b.T >= threshold) @ np.frombuffer(r.copies2, dtype=np.int64)
                c, before = out.get(r.block, (r.c, 0))
                out[r.block] = c, before + n
            yield pd.DataFrame({"c": np.concatenate([np.frombuffer(c, dtype=np.int64) for c, _ in out.values()] or [[]]).astype(np.int64), "n_links": np.concatenate([n for _, n in out.values()] or [[]]).astype(np.int64)})

    return run


def crowded_counts(members: DataFrame, threshold: float) -> DataFrame:
    """members (c, copies, x, root): c and n_links, counted within the root's members, copies of c itself included but
    for one."""
    spark = members.sparkSession
    small_batches(spark)
    celled = members.withColumn("_cell", column_map(spark, _cells([0]), "array<long>")("x")[0])
    parts = max(1, (members.agg(F.sum(8 * F.size("x")).alias("b")).first()["b"] or 0) // PART_BYTES)
    dealt = celled.repartitionByRange(parts, "root", F.size("x"), "_cell", "c").select("root", "c", "copies", "x")
    blocks = materialise(dealt.mapInArrow(_blocks, HELD), "blocks")
    small = blocks.select("root", "dim", "block", "n", "centre", "radius")
    other = small.select("root", "dim", *[F.col(k).alias(k + "2") for k in ("block", "n", "centre", "radius")])
    decided = materialise(small.join(other, ["root", "dim"]).transform(pandas_map, _decide(threshold), "block long, block2 long, n2 long, all boolean"), "decided")
    sides = blocks.select("block", "dim", "c", "u"), blocks.select(F.col("block").alias("block2"), F.col("copies").alias("copies2"), F.col("u").alias("u2"))
    counted = decided.filter("not all").join(sides[1], "block2").join(sides[0], "block").transform(pandas_map, _count(threshold), "c long, n_links long")
    sure = decided.filter("all").groupBy("block").agg(F.sum("n2").alias("n_links")).join(blocks.select("block", "c"), "block")
    flat = sure.transform(pandas_map, _spread, "c long, n_links long")
    out = counted.union(flat).groupBy("c").agg((F.sum("n_links") - 1).alias("n_links"))
    out = materialise(out, "crowded")
    discard(blocks, decided)
    return out


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            c = np.frombuffer(r.c, dtype=np.int64)
            yield pd.DataFrame({"c": c, "n_links": np.full(len(c), r.n_links)})


# --- the whole


def _audit(sample: dict, threshold: float):
    """True links of the sample's classes among those of a task. sample: by label and length, numbers and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            label, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, u in by_length(batch.column(2)):
                for lab in np.unique(label[at]):
                    c, s = sample.get((int(lab), u.shape[1]), ((), None))
                    if len(c):
                        own = label[at] == lab
                        for k, n in zip(c, (s @ u[own].T >= threshold) @ copies[at[own]]):
                            total[k] = total.get(k, 0) + int(n)
        yield pa.RecordBatch.from_pydict({"c": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    return run


def recall_of(classes: DataFrame, found: DataFrame, threshold: float) -> float:
    """Share of the true links of a bounded sample that were found. found: c, n_links (> 0)."""
    h = F.xxhash64("c", F.lit(5))
    some = classes.orderBy(h).limit(AUDIT_ROWS).select("c").union(found.orderBy(h).limit(AUDIT_ROWS).select("c")).distinct()
    rows = classes.join(some, "c").join(found, "c", "left").select("c", "label", "x", F.coalesce("n_links", F.lit(0)).alias("n_links")).collect()
    sample: dict[tuple, list] = {}
    for r in rows:
        sample.setdefault((r["label"], len(r["x"])), []).append(r)
    held = {k: ([r["c"] for r in rs], units(np.array([r["x"] for r in rs]))) for k, rs in sample.items()}
    true = classes.select("label", "copies", "x").mapInArrow(_audit(held, threshold), "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    want = {r["c"]: r["n"] - 1 for r in true.collect()}
    total = sum(want.values())
    return 1.0 if total == 0 else sum(min(r["n_links"], want[r["c"]]) for r in rows) / total


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, passes: int = PASSES) -> DataFrame:
    """vec_id, n_links, component_id, kept and audited_recall, a row for each of vectors."""
    spark = vectors.sparkSession
    small_batches(spark)
    floor = math.cos(min(math.pi / 2, 2 * math.acos(threshold)))
    fit = usable("embedding") & F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)
    print_of = [F.when(fit, F.xxhash64("label", "embedding", F.lit(s))).alias(f"f{s}") for s in (1, 2)]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("x"), *print_of)
    # nulls sort last: the smallest id of a class is one that is there
    one = rows.filter("f1 is not null").groupBy("f1", "f2").agg(F.min("vec_id").alias("first"), F.min(F.struct("label", "x")).alias("r"), F.count(F.lit(1)).alias("copies"))
    numbered = one.select("f1", "f2", "first", "copies", "r.label", "r.x", F.monotonically_increasing_id().alias("_i"))
    classes = materialise(numbered.withColumn("c", F.xxhash64("_i")).drop("_i"), "classes")
    size = classes.agg(F.sum(8 * F.size("x")).alias("b")).first()["b"] or 0
    lists, recall, n_links, roots = None, 1.0, None, None
    for turn in range(passes):
        seeds = [turn * FORESTS + k + 1 for k in range(FORESTS)]
        celled = classes.withColumn("_cells", column_map(spark, _cells(seeds), "array<long>")("x")).select("c", "label", "x", F.posexplode("_cells").alias("forest", "cell"))
        parts = FORESTS * max(1, -(-size // PART_BYTES))
        dealt = celled.repartitionByRange(parts, "forest", F.size("x"), "label", "cell", "c").select((F.col("forest") + turn * FORESTS).cast("long").alias("forest"), "label", "c", "x")
        first = dealt.mapInArrow(_first_graph(floor), EDGE)
        before, lists = lists, materialise(best_lists(first if lists is None else lists.union(first)), "lists")
        discard(before)
        total = lists.count()
        for _ in range(ROUNDS if total else 0):
            before = lists
            lists, new = refine(lists, classes, floor, threshold)
            discard(before)
            if new <= total // 1000:
                break
        links = lists.filter(F.col("cos") >= threshold)
        both = materialise(links.select("u", "v").union(links.select("v", "u")).distinct(), "links")
        discard(roots, n_links)
        roots = connected(both.select(F.col("u").alias("a"), F.col("v").alias("b")), "near")
        full = links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LIST).select(F.col("u").alias("v"))
        crowded = roots.join(full, "v").select("root").distinct()
        inside = roots.join(crowded, "root").select(F.col("v").alias("c"), "root")
        members = materialise(classes.join(inside, "c").select("c", "copies", "x", "root"), "members")
        plain = both.join(inside.select(F.col("c").alias("u")), "u", "left_anti").join(classes.select(F.col("c").alias("v"), "copies"), "v")
        plain = plain.groupBy(F.col("u").alias("c")).agg(F.sum("copies").alias("n_links")).join(classes.select("c", "copies"), "c").select("c", (F.col("n_links") + F.col("copies") - 1).alias("n_links"))
        alone = classes.filter("copies > 1").join(both.select(F.col("u").alias("c")), "c", "left_anti").select("c", (F.col("copies") - 1).alias("n_links"))
        inner = crowded_counts(members, threshold)
        n_links = materialise(plain.union(alone).union(inner), "counts")
        discard(both, members, inner)
        recall = recall_of(classes, n_links, threshold)
        if recall >= LEAST_RECALL:
            break
    named = classes.select("c", "f1", "f2", "first").join(roots.select(F.col("v").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    told = named.join(smallest, "root").join(n_links, "c", "left").select("f1", "f2", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    told = materialise(told, "told")
    out = rows.select("vec_id", "f1", "f2").join(told, ["f1", "f2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    discard(classes, lists, roots, n_links)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(float(recall)).alias("audited_recall"))
