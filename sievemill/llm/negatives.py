"""Hard negatives by branch and bound over ball trees.

Rows are dealt by place: a tree of splits, fitted to a bounded sample (SAMPLE_ROWS, by hash of the id), gives each row a
cell, and equal ranges of (cell, hash of the id) become partitions, so a crowded cell is cut and no partition is larger
than another. Each partition plants a ball tree of its rows: a node has centre c and radius r, so the inner product of
a vector q with any row below it lies between c.q - |q| r and c.q + |q| r.

A search asks, for each query, for the k best rows of its own label or of other labels with a score in a window. A node
is left out where its bounds miss the window, where it has no row of the kind, or where its upper bound lies strictly
beneath the k-th best score known so far; that score is first bounded from below by the nodes whose rows are surely in
the window, then by the leaves scanned, highest bound first. The upper nodes of all trees are kept apart, so a block of
queries goes only to the trees that can hold results. Results are exact: bounds have a margin for rounding, scores are
integers, and leaves with a bound equal to the k-th score are read for the ties, which the smaller id wins.

Defined cases: rows with a null id, a null label, or a vector that is null, empty or not finite throughout take no part;
vectors of different lengths never meet; equal rows count once, rows of one id with other vectors or labels count each;
an anchor with fewer rows of either kind gives fewer results; a negative positive score has an empty window; a score
that does not fit a long raises; columns other than id, vector and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_map, discard, materialise, pandas_map, small_batches
from .vectors import integers, usable
from .whitening import matrix_of

#: Bytes of a tree's vectors, rows of a leaf, levels of the nodes kept apart, queries of a block, blocks a task.
TREE_BYTES, LEAF, TOP_LEVELS, BLOCK, BLOCKS_A_TASK = 8 << 20, 64, 4, 2048, 16
#: Rows to which the cells are fitted, and trees whose upper nodes are looked at together.
SAMPLE_ROWS, TREES_AT_ONCE = 4096, 1024
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
MARGIN = 1e-9


def split_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A direction between two far rows, and the rows' places along it."""
    away = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    a = x[away.argmax()]
    b = x[((x - a) ** 2).sum(axis=1).argmax()]
    return a - b, x @ (a - b)


class BallTree:
    """Nodes in order of level; a node's rows are start to stop, its children left and left + 1 (0: a leaf)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, nodes=None):
        self.ids, self.labels, self.x = ids, labels, x
        if nodes is None:
            nodes = self._plant()
        self.start, self.stop, self.left, self.level, self.centre, self.radius = nodes
        self.kinds, code = np.unique(self.labels, return_inverse=True)
        self.keys = np.sort(code.astype(np.int64) * (len(ids) + 1) + np.arange(len(ids)))

    def _plant(self):
        order, real = np.arange(len(self.ids)), self.x.astype(np.float64)
        start, stop, left, level, centre, radius = [0], [len(order)], [], [0], [], []
        k = 0
        while k < len(start):
            own = order[start[k] : stop[k]]
            rows = real[own]
            c = rows.mean(axis=0)
            centre.append(c)
            radius.append(float(np.sqrt(((rows - c) ** 2).sum(axis=1).max())) * (1 + MARGIN))
            if len(own) <= LEAF:
                left.append(0)
            else:
                half = len(own) // 2
                order[start[k] : stop[k]] = own[np.argpartition(split_of(rows)[1], half)]
                left.append(len(start))
                middle = start[k] + half
                start, stop, level = [*start, start[k], middle], [*stop, middle, stop[k]], [*level, level[k] + 1, level[k] + 1]
            k += 1
        self.ids, self.labels, self.x = self.ids[order], self.labels[order], self.x[order]
        return np.array(start), np.array(stop), np.array(left), np.array(level), np.array(centre), np.array(radius)

    def of_label(self, labels: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Rows of each label below each node."""
        code = np.searchsorted(self.kinds, labels)
        known = (code < len(self.kinds)) & (self.kinds[np.minimum(code, len(self.kinds) - 1)] == labels)
        base = code[:, None] * (len(self.ids) + 1)
        found = np.searchsorted(self.keys, base + self.stop[nodes]) - np.searchsorted(self.keys, base + self.start[nodes])
        return np.where(known[:, None], found, 0)


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest inner product of each query with the rows of each node."""
    norm = np.sqrt((q * q).sum(axis=1))[:, None]
    dot, spread = q @ centre.T, norm * radius
    slack = spread + MARGIN * (norm * np.sqrt((centre * centre).sum(axis=1)) + spread + 1)
    return dot - slack, dot + slack


def surely(low: np.ndarray, high: np.ndarray, count: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    """A score that the k-th best of each query reaches: its best nodes that lie in the window hold k rows."""
    inside = (low >= lo[:, None]) & (high <= hi[:, None])
    value = np.where(inside, low, -np.inf)
    order = np.argsort(-value, axis=1)
    held = np.cumsum(np.take_along_axis(np.where(inside, count, 0), order, axis=1), axis=1) >= k
    at = held.argmax(axis=1)
    return np.where(held.any(axis=1), np.take_along_axis(value, order, axis=1)[np.arange(len(at)), at], -np.inf)


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products as int64 (rows by queries)."""
    most = x.shape[1] * int(max(x.max(), -int(x.min()))) * int(max(q.max(), -int(q.min())))
    if most < 1 << 53:
        return (x.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        found = x.astype(object) @ q.T.astype(object)
        if found.max() > HIGHEST or found.min() < LOWEST:
            raise OverflowError("an inner product does not fit a long")
        return found.astype(np.int64)
    return x.astype(np.int64) @ q.T.astype(np.int64)


def best_of(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each q, in order."""
    order = np.lexsort((ids, -score, q))
    first = np.r_[True, q[order][1:] != q[order][:-1]]
    place = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return order[place < k]


def search(tree: BallTree, q: np.ndarray, own: np.ndarray, label: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int):
    """(query, score, id) of the k best rows of each query in this tree."""
    real, m = q.astype(np.float64), len(q)
    kinds, of_kind = np.unique(label, return_inverse=True)
    low_edge, high_edge = lo.astype(np.float64), hi.astype(np.float64)
    alive, floor = {0: np.ones(m, dtype=bool)}, np.full(m, -np.inf)
    leaves, leaf_high, leaf_alive = [], [], []
    for depth in range(tree.level.max() + 1):
        nodes = np.array([n for n in np.flatnonzero(tree.level == depth) if n in alive], dtype=np.int64)
        if not len(nodes):
            break
        low, high = bounds(real, tree.centre[nodes], tree.radius[nodes])
        held = tree.of_label(kinds, nodes)
        held = (held if same else (tree.stop - tree.start)[nodes] - held)[of_kind]
        floor = np.maximum(floor, surely(low, high, held, low_edge, high_edge, k + same))
        on = np.stack([alive[n] for n in nodes], axis=1) & (held > 0) & (low <= high_edge[:, None]) & (high >= np.maximum(low_edge, floor)[:, None])
        for j, n in enumerate(nodes):
            if on[:, j].any():
                if tree.left[n]:
                    alive[tree.left[n]] = alive[tree.left[n] + 1] = on[:, j]
                else:
                    leaves.append(n)
                    leaf_high.append(high[:, j])
                    leaf_alive.append(on[:, j])
    got = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    if not leaves:
        return got
    bound = np.where(np.stack(leaf_alive, axis=1), np.stack(leaf_high, axis=1), -np.inf)
    order = np.argsort(-bound, axis=1)
    at, width = 0, 1
    while at < len(leaves):
        part = order[:, at : at + width]
        who, col = np.nonzero((high := np.take_along_axis(bound, part, axis=1)) >= floor[:, None])
        keep = high[who, col] > -np.inf
        who, leaf = who[keep], part[who[keep], col[keep]]
        if not len(who):
            break
        by = np.argsort(leaf, kind="stable")
        who, leaf, found = who[by], leaf[by], [got]
        for s, e in zip(edges := np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]), np.r_[edges[1:], len(leaf)]):
            n, qs = leaves[leaf[s]], who[s:e]
            rows = slice(tree.start[n], tree.stop[n])
            score = scores(tree.x[rows], q[qs])
            fit = ((tree.labels[rows, None] == label[qs]) == same) & (score >= lo[qs]) & (score <= hi[qs]) & (score >= floor[qs])
            if same:
                fit &= tree.ids[rows, None] != own[qs]
            r, c = np.nonzero(fit)
            found.append((qs[c], score[r, c], tree.ids[rows][r]))
        w, v, i = (np.concatenate(p) for p in zip(*found))
        top = best_of(w, v, i, k)
        got = w[top], v[top], i[top]
        full, first = np.unique(got[0], return_index=True)
        have = np.diff(np.r_[first, len(got[0])])
        floor[full[have == k]] = np.maximum(floor[full[have == k]], got[1][first[have == k] + k - 1])
        at, width = at + width, width * 2
    return got


# --- planting


class Cells:
    """Splits fitted to a sample; a row's cell is the path of its sides."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.splits = depth, {}
        self._split(sample.astype(np.float64), 1)

    def _split(self, x: np.ndarray, node: int) -> None:
        if node < 1 << self.depth and len(x) > 1:
            way, place = split_of(x)
            cut = float(np.median(place))
            self.splits[node] = (way, cut)
            self._split(x[place < cut], 2 * node)
            self._split(x[place >= cut], 2 * node + 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        node, x = np.ones(len(x), dtype=np.int64), x.astype(np.float64)
        for level in range(self.depth):
            side = np.zeros(len(x), dtype=np.int64)
            for n in np.unique(node):
                if n in self.splits:
                    own = node == n
                    way, cut = self.splits[n]
                    side[own] = x[own] @ way >= cut
            node = 2 * node + side
        return node - (1 << self.depth)


def _cell(cells: dict[int, Cells]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            out = np.zeros(len(xs), dtype=np.int64)
            size = xs.map(len).to_numpy()
            for d in np.unique(size):
                if d in cells:
                    out[size == d] = cells[d].of(np.stack(xs[size == d].to_list()))
            yield pd.Series(out)

    return run


def with_cells(rows: DataFrame, bytes_each: int) -> tuple[DataFrame, int]:
    """rows with their cell, and the number of partitions of bytes_each."""
    size = rows.agg(F.sum(8 * F.size("x")).alias("b")).first()["b"] or 0
    parts = max(1, -(-size // bytes_each))
    if parts == 1:
        return rows.withColumn("cell", F.lit(0).cast("long")), 1
    sample = rows.select("x", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE_ROWS).select("x").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["x"]), []).append(r["x"])
    depth = min(10, int(parts).bit_length() + 2)
    cells = {d: Cells(np.array(xs, dtype=np.int64), depth) for d, xs in by_dim.items()}
    return rows.withColumn("cell", column_map(rows.sparkSession, _cell(cells), "long")("x")), parts


TREE = "tree long, dim int, n int, kind string, ids binary, labels binary, x binary, nodes binary, centre binary, top_nodes binary, top_labels binary"
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def schema_of(ddl: str) -> pa.Schema:
    return pa.schema([(n, ARROW[t]) for n, t in (c.split() for c in ddl.split(", "))])


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    for kind in (np.int16, np.int32):
        if not x.size or (x.max() <= np.iinfo(kind).max and x.min() >= np.iinfo(kind).min):
            return x.astype(kind)
    return x


def thinned(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, most: int):
    """Equal rows once; of rows with equal label and vector those with the smallest ids, more of which no result can
    hold."""
    mix = np.random.default_rng(7).integers(1, 1 << 62, x.shape[1])
    with np.errstate(over="ignore"):
        h = x @ mix
    order = np.lexsort((ids, *x.T[::-1], labels, h)) if len(np.unique(h)) < len(h) else np.arange(len(h))
    ids, labels, x, h = ids[order], labels[order], x[order], h[order]
    if len(ids) < 2 or len(np.unique(h)) == len(h):
        return ids, labels, x
    alike = np.r_[False, (h[1:] == h[:-1]) & (labels[1:] == labels[:-1]) & (x[1:] == x[:-1]).all(axis=1)]
    keep = ~(alike & np.r_[False, ids[1:] == ids[:-1]])
    ids, labels, x, alike = ids[keep], labels[keep], x[keep], alike[keep]
    place = np.arange(len(ids)) - np.flatnonzero(~alike)[np.cumsum(~alike) - 1]
    return ids[place < most], labels[place < most], x[place < most]


def _plant(tree_bytes: int, most: int):
    def planted(number: int, parts: list) -> list:
        ids, labels, x = thinned(*(np.concatenate(p) for p in zip(*parts)), most)
        tree = BallTree(ids, labels, x)
        tops = np.flatnonzero((tree.level == TOP_LEVELS) | (tree.level < TOP_LEVELS) & (tree.left == 0))
        held = tree.of_label(tree.kinds, tops)
        k, n = np.nonzero(held)
        x = narrow(tree.x)
        nodes = np.stack([tree.start, tree.stop, tree.left, tree.level]).astype(np.int64).tobytes() + tree.radius.tobytes()
        return [number, x.shape[1], len(x), str(x.dtype), tree.ids.tobytes(), tree.labels.tobytes(), x.tobytes(), nodes, tree.centre.tobytes(), tops.astype(np.int64).tobytes(), np.stack([n, tree.kinds[k], held[k, n]]).astype(np.int64).tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = {}, TaskContext.get().partitionId() << 24

        def out(parts):
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(planted(number, parts), schema_of(TREE))], schema=schema_of(TREE))

        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for d in np.unique(sizes):
                own = batch.filter(pa.array(sizes == d))
                parts = held.setdefault(int(d), [])
                parts.append((own.column(0).to_numpy(), own.column(1).to_numpy(), matrix_of(own.column(2))))
                if sum(p[2].nbytes for p in parts) >= 2 * tree_bytes:
                    yield out(held.pop(int(d)))
        for parts in held.values():
            yield out(parts)

    return run


def plant(rows: DataFrame, parts: int, most: int, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """rows (vec_id, label, x, cell): a written table of trees."""
    small_batches(rows.sparkSession)
    dealt = rows.select("vec_id", "label", "x", "cell").repartitionByRange(parts, F.size("x"), "cell", F.xxhash64("vec_id"), "vec_id")
    return materialise(dealt.select("vec_id", "label", "x").mapInArrow(_plant(tree_bytes, most), TREE), "trees")


@lru_cache(maxsize=1)
def tree_of(number: int, dim: int, n: int, kind: str, ids: bytes, labels: bytes, x: bytes, nodes: bytes, centre: bytes) -> BallTree:
    m = len(nodes) // 40
    ints = np.frombuffer(nodes, dtype=np.int64, count=4 * m).reshape(4, m)
    made = (*ints, np.frombuffer(centre).reshape(m, dim), np.frombuffer(nodes, dtype=np.float64, offset=32 * m))
    return BallTree(np.frombuffer(ids, dtype=np.int64), np.frombuffer(labels, dtype=np.int64), np.frombuffer(x, dtype=kind).reshape(n, dim), made)


# --- searching

ASKED = "block long, dim int, a binary, own binary, label binary, lo binary, hi binary, x binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, number = {}, TaskContext.get().partitionId() << 24

    def out(d: int, parts: list) -> pa.RecordBatch:
        nonlocal number
        number += 1
        a, own, label, lo, hi, x = (np.concatenate(p) for p in zip(*parts))
        row = [number, d, *(v.astype(np.int64).tobytes() for v in (a, own, label, lo, hi, x))]
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema_of(ASKED))], schema=schema_of(ASKED))

    for batch in batches:
        sizes = np.diff(batch.column(5).offsets.to_numpy())
        for d in np.unique(sizes):
            own = batch.filter(pa.array(sizes == d))
            parts = held.setdefault(int(d), [])
            parts.append((*(own.column(c).to_numpy() for c in range(5)), matrix_of(own.column(5))))
            if sum(len(p[0]) for p in parts) >= BLOCK:
                yield out(int(d), held.pop(int(d)))
    for d, parts in held.items():
        yield out(d, parts)


def _asked(r) -> tuple[np.ndarray, ...]:
    a, own, label, lo, hi = (np.frombuffer(v, dtype=np.int64) for v in (r.a, r.own, r.label, r.lo, r.hi))
    return a, own, label, lo, hi, np.frombuffer(r.x, dtype=np.int64).reshape(len(a), r.dim)


UPPER = "slot long, dim int, tree binary, n binary, centre binary, radius binary, held binary"


def _uppers(pdf: pd.DataFrame) -> pd.DataFrame:
    """The upper nodes of some trees, a row for each length of vectors."""
    out = []
    for d, own in pdf.groupby("dim"):
        tree, n, centre, radius, held, at = [], [], [], [], [], 0
        for r in own.itertuples():
            m = len(r.nodes) // 40
            top = np.frombuffer(r.top_nodes, dtype=np.int64)
            ints = np.frombuffer(r.nodes, dtype=np.int64, count=4 * m).reshape(4, m)
            entries = np.frombuffer(r.top_labels, dtype=np.int64).reshape(3, -1).copy()
            entries[0] += at
            at += len(top)
            tree.append(np.full(len(top), r.tree))
            n.append((ints[1] - ints[0])[top])
            centre.append(np.frombuffer(r.centre).reshape(m, d)[top])
            radius.append(np.frombuffer(r.nodes, dtype=np.float64, offset=32 * m)[top])
            held.append(entries)
        out.append([pdf["slot"].iloc[0], d, *(np.concatenate(v).tobytes() for v in (tree, n, centre, radius)), np.concatenate(held, axis=1).tobytes()])
    return pd.DataFrame(out, columns=[c.split()[0] for c in UPPER.split(", ")])


def _route(same: bool, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                _, _, label, lo, hi, q = _asked(r)
                tree, n = np.frombuffer(r.tree, dtype=np.int64), np.frombuffer(r.n, dtype=np.int64)
                kinds, of_kind = np.unique(label, return_inverse=True)
                node, kind, count = np.frombuffer(r.held, dtype=np.int64).reshape(3, -1)
                mine = np.isin(kind, kinds)
                held = np.zeros((len(kinds), len(n)), dtype=np.int64)
                held[np.searchsorted(kinds, kind[mine]), node[mine]] = count[mine]
                low, high = bounds(q.astype(np.float64), np.frombuffer(r.centre).reshape(len(n), -1), np.frombuffer(r.radius))
                held = (held if same else n - held)[of_kind]
                lo, hi = lo.astype(np.float64), hi.astype(np.float64)
                floor = surely(low, high, held, lo, hi, k + same)
                on = (held > 0) & (low <= hi[:, None]) & (high >= np.maximum(lo, floor)[:, None])
                found = np.unique(tree[on.any(axis=0)])
                yield pd.DataFrame({"block": np.full(len(found), r.block), "tree": found})

    return run


FOUND = "a long, hi long, id long, score long"


def _search(same: bool, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                tree = tree_of(r.tree, r.dim, r.n, r.kind, *map(bytes, (r.ids, r.labels, r.tx, r.nodes, r.centre)))
                a, own, label, lo, hi, q = _asked(r)
                w, score, ids = search(tree, q, own, label, lo, hi, same, k)
                yield pd.DataFrame({"a": a[w], "hi": hi[w], "id": ids, "score": score})

    return run


def find(trees: DataFrame, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """queries (a, own, label, lo, hi, x, cell): a written table (a, hi, id, score, rank) of the k best rows of each,
    of its own label or of others, scored from lo to hi."""
    spark = queries.sparkSession
    n_queries, n_trees = queries.count(), trees.count()
    n_blocks = max(1, -(-n_queries // BLOCK))
    dealt = queries.repartitionByRange(n_blocks, F.size("x"), "cell", "a", "hi").select("a", "own", "label", "lo", "hi", "x")
    blocks = materialise(dealt.mapInArrow(_pack, ASKED), "queries")
    slots = max(1, -(-n_trees // TREES_AT_ONCE))
    upper = trees.withColumn("slot", F.pmod(F.xxhash64("tree"), F.lit(slots))).select("slot", "tree", "dim", "nodes", "centre", "top_nodes", "top_labels")
    upper = upper.groupBy("slot").applyInPandas(_uppers, UPPER)
    looked = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))).join(upper, ["slot", "dim"])
    pairs = looked.transform(pandas_map, _route(same, k), "block long, tree long")
    turns = max(1, -(-n_blocks // BLOCKS_A_TASK))
    pairs = materialise(pairs.withColumn("turn", F.pmod(F.xxhash64("block"), F.lit(turns))), "routes")
    held = trees.select("tree", "n", "kind", "ids", "labels", F.col("x").alias("tx"), "nodes", "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"))
    work = pairs.join(blocks, "block").join(held, ["tree", "turn"])
    found = work.transform(pandas_map, _search(same, k), FOUND)
    best = Window.partitionBy("a", "hi").orderBy(F.desc("score"), "id")
    out = materialise(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "found")
    discard(blocks, pairs)
    return out


def usable_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label (long) and integer vector x of the rows that take part."""
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding")
    return vectors.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integers("embedding", scale).alias("x"))


def hard_negatives(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """rows (vec_id, label, x): anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Negatives score
    low to high per cent of the positive."""
    celled, parts = with_cells(rows, tree_bytes)
    trees = plant(celled, parts, max(positives + 1, negatives), tree_bytes)
    anchors = materialise(celled.filter(is_anchor).distinct().withColumn("a", F.monotonically_increasing_id()), "anchors")
    ask = anchors.select("a", F.col("vec_id").alias("own"), "label", "x", "cell")
    near = find(trees, ask.withColumns({"lo": F.lit(LOWEST), "hi": F.lit(HIGHEST)}), True, positives)
    near = near.select("a", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score").cast("decimal(20,0)")
    edges = near.select("a", "positive_score").distinct().select("a", F.ceil(p * low / 100).cast("long").alias("lo"), F.floor(p * high / 100).cast("long").alias("hi"), "positive_score").filter("lo <= hi")
    asked = edges.drop("positive_score").distinct().join(ask, "a")
    hard = find(trees, asked, False, negatives).select("a", "hi", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(edges.select("a", "positive_score", "hi"), ["a", "positive_score"]).join(hard, ["a", "hi"]).join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a")
    discard(trees)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
