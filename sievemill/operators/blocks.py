"""Exact nearest points, block by block.

Points and rows are dealt by place (cells of median splits, fitted to a bounded sample, cut by a hash of the id where
crowded) to blocks of bounded size that know their centre and radius. Each block of rows is first held against the
block of points with the nearest centre; that bounds how far the k-th nearest of its rows can be, and only blocks of
points that are not surely farther are looked at after that. The pairs of a block of points are dealt to tasks PAIRS at a
time; a pair is matrix products of TILE distances each or, where one nearest point is asked for and a lower bound of
distances is known, a search by cells of CELL rows and points. So a worker holds one pair and a tile, however many pairs
there are; neither side is ever collected or sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.session import cut, sent, small_batches

#: Rows to which cells are fitted, bytes of a block of points and of rows, blocks of points looked at together.
SAMPLE, POINT_BYTES, ROW_BYTES, TOGETHER = 4096, 8 << 20, 1 << 20, 4096
BLOCK = "block long, n int, centre binary, radius double, ids binary, x binary, tag binary"
MARGIN = 1e-9
#: Distances that a task holds at once.
TILE = 1 << 18
#: Pairs of one block of points that reach a task together; most rows of a cell within a block.
PAIRS, CELL = 4, 256
#: Stands for the block of rows in a line that holds a block of points.
NONE = -1
#: Places as far out as this have no usable centre or box; rounding of places, in parts of their size.
OUTSIDE, ROUNDING = 1e150, 1e-14


class Cells:
    """Median splits along the widest side; a row's cell is its path."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.splits = depth, {}
        self._split(sample, 1)

    def _split(self, x: np.ndarray, node: int) -> None:
        if node < 1 << self.depth and len(x) > 1:
            way = int(np.ptp(x, axis=0).argmax())
            at = float(np.median(x[:, way]))
            self.splits[node] = way, at
            self._split(x[x[:, way] < at], 2 * node)
            self._split(x[x[:, way] >= at], 2 * node + 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            side = np.zeros(len(x), dtype=np.int64)
            for n in np.unique(node):
                if n in self.splits:
                    own = node == n
                    side[own] = x[own, self.splits[n][0]] >= self.splits[n][1]
            node = 2 * node + side
        return node - (1 << self.depth)


def _placed(at: np.ndarray) -> bool:
    return bool((np.abs(at) < OUTSIDE).all())


def _packed(limit: int, sides: int | None):
    def out(number: int, parts: list) -> tuple:
        ids, x, tag = (np.concatenate(p) for p in zip(*parts))
        at = x[:, :sides]
        centre, radius = np.zeros(at.shape[1]), float("inf")
        if _placed(at):
            centre = at.mean(axis=0)
            radius = float(np.sqrt(((at - centre) ** 2).sum(axis=1).max())) * (1 + MARGIN) + float(np.abs(at).max()) * ROUNDING
        return number, len(ids), centre.tobytes(), radius, ids.astype(np.int64).tobytes(), x.tobytes(), tag.astype(np.int64).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, parts, held = TaskContext.get().partitionId() << 24, [], 0
        names = [c.split()[0] for c in BLOCK.split(", ")]
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_list()).astype(float)
                parts.append((pdf["id"].to_numpy(), x, pdf["tag"].to_numpy()))
                held += x.nbytes
            if held >= 2 * limit:
                number += 1
                yield pd.DataFrame([out(number, parts)], columns=names)
                parts, held = [], 0
        if parts:
            yield pd.DataFrame([out(number + 1, parts)], columns=names)

    return run


def packed(rows: DataFrame, limit: int, sides: int | None = None) -> DataFrame:
    """rows (id long, x array<double>, tag long): a written table of blocks of about `limit` bytes; the first `sides` of
    x tell the place. Rows with a missing number are near nothing."""
    rows = rows.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    size = rows.agg(F.sum(8 * F.size("x")).alias("b")).first()["b"] or 0
    parts = max(1, -(-size // limit))
    cell: Column = F.lit(0)
    if parts > 1:
        sample = rows.select("x", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).collect()
        cells = Cells(np.array([r["x"] for r in sample], dtype=float)[:, :sides], min(10, parts.bit_length() + 2))

        @F.pandas_udf("long")
        def cell_of(x: pd.Series) -> pd.Series:
            return pd.Series(cells.of(np.stack(x.to_list()).astype(float)) if len(x) else np.zeros(0, dtype=np.int64))

        rows, cell = cut(rows.withColumn("_cell", cell_of("x"))), F.col("_cell")  # ranges are taken from a pass of their own
    dealt = rows.withColumn("_cell", cell).repartitionByRange(parts, "_cell", F.xxhash64("id"), "id")
    return cut(dealt.select("id", "x", "tag").mapInPandas(_packed(limit, sides), BLOCK))


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"slot": pdf["slot"].iloc[:1], "blocks": [pdf["block"].to_numpy(dtype=np.int64).tobytes()], "centres": [b"".join(pdf["centre"])], "radii": [pdf["radius"].to_numpy(dtype=float).tobytes()]})


def _looked(home: bool):
    """For each block of rows the block of points with the nearest centre of those looked at; or (not home) all but its
    home that may hold a point within `reach` of a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                centre, blocks = np.frombuffer(r.centre), np.frombuffer(r.blocks, dtype=np.int64)
                gap = np.sqrt(((np.frombuffer(r.centres).reshape(len(blocks), -1) - centre) ** 2).sum(axis=1))
                if home:
                    k = int(gap.argmin())
                    out.append((r.block, int(blocks[k]), float(gap[k])))
                else:
                    near = gap - r.radius - np.frombuffer(r.radii)
                    out += [(r.block, int(b), float(g)) for b, g in zip(blocks, near) if b != r.home and g <= r.reach * (1 + MARGIN) + MARGIN]
            yield pd.DataFrame(out, columns=["block", "points", "gap"])

    return run


class Boxed:
    """The rows of a block in cells of at most CELL: of one tag where that has rows enough, else of several. Each cell
    has a box and a list of its tags, and is in the order of ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, tag: np.ndarray, sides: int | None):
        _, code, n = np.unique(tag, return_inverse=True, return_counts=True)
        code = np.where(n[code] < CELL // 4, -1, code)
        by = np.argsort(code, kind="stable")
        todo, cells = np.split(by, np.flatnonzero(np.diff(code[by])) + 1), []
        while todo:
            own = todo.pop()
            if len(own) <= CELL:
                cells.append(own[np.argsort(ids[own])])
            else:
                way = int(np.ptp(x[own, :sides], axis=0).argmax())
                half = np.argpartition(x[own, way], len(own) // 2)
                todo += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
        self.order, self.n = np.concatenate(cells), np.array([len(c) for c in cells])
        self.ids, self.x, self.tag = ids[self.order], x[self.order], tag[self.order]
        self.start = np.r_[0, np.cumsum(self.n)]
        self.low, self.high = (f.reduceat(self.x[:, :sides], self.start[:-1], axis=0) for f in (np.minimum, np.maximum))
        self.size = max(float(np.abs(self.low).max()), float(np.abs(self.high).max()))
        self.names, code = np.unique(self.tag, return_inverse=True)
        held = np.unique(np.repeat(np.arange(len(cells)), self.n) * len(self.names) + code)
        self.held, self.held_from = held % len(self.names), np.searchsorted(held, np.arange(len(cells)) * len(self.names))

    def gaps(self, low: np.ndarray, high: np.ndarray, size: float) -> np.ndarray:
        """A distance from the box that none of a cell's rows is nearer than."""
        gap = np.maximum(np.maximum(self.low - high, low - self.high), 0.0)
        return np.maximum(np.sqrt((gap * gap).sum(axis=1)) * (1 - MARGIN) - (self.size + size) * ROUNDING, 0.0)

    def with_tag(self, tag: np.ndarray) -> np.ndarray:
        """Whether a cell holds one of these tags."""
        hit, at = np.zeros(len(self.names), dtype=bool), np.searchsorted(self.names, tag).clip(max=len(self.names) - 1)
        hit[at[self.names[at] == tag]] = True
        return np.logical_or.reduceat(hit[self.held], self.held_from)


def _by_cells(rows: Boxed, points: Boxed, kernel: Callable, floor: Callable, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """id, point and distance of each row's nearest point, where that is within the row's `most`: cells of points are
    looked at from the nearest on, until no row of the cell can gain by another."""
    near, far = np.full(len(rows.ids), -1), most[rows.order]
    for a, b, low, high in zip(rows.start, rows.start[1:], rows.low, rows.high):
        bound = floor(points.gaps(low, high, rows.size), points.with_tag(rows.tag[a:b]))
        best, at, line = far[a:b], near[a:b], np.arange(b - a)
        for c in np.argsort(bound, kind="stable"):
            if bound[c] > best.max():
                break
            own = slice(points.start[c], points.start[c + 1])
            d = kernel(rows.x[a:b], rows.tag[a:b], points.x[own], points.tag[own])
            j = d.argmin(axis=1)  # the first, so the smallest id, of equals
            d, j = d[line, j], j + points.start[c]
            gain = (d < best) | (d == best) & ((at < 0) | (points.ids[j] < points.ids[at]))
            best[gain], at[gain] = d[gain], j[gain]
    found = near >= 0
    return rows.ids[found], points.ids[near[found]], far[found]


def _within(ids: np.ndarray, known: bytes | None, most: bytes | None) -> np.ndarray:
    """How far off a point may be for each row, by the points that it has already."""
    out = np.full(len(ids), np.inf)
    if known:
        own, far = np.frombuffer(known, dtype=np.int64), np.frombuffer(most)
        at = np.searchsorted(own, ids).clip(max=len(own) - 1)
        out = np.where(own[at] == ids, far[at], out)
    return out


def _known(k: int):
    """Of a block its rows and how far their k-th nearest point is, and the largest of these."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["id"].to_numpy(), kind="stable")
        ids, far = pdf["id"].to_numpy()[order], pdf["distance"].to_numpy()[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        most = np.maximum.reduceat(far, first)
        most[np.diff(np.r_[first, len(ids)]) < k] = np.inf
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "known": [ids[first].astype(np.int64).tobytes()], "most": [most.astype(float).tobytes()], "d": [float(most.max())]})

    return run


def _pairs(kernel: Callable, k: int, floor: Callable | None, sides: int | None):
    """The k nearest of each row in a pair of blocks, if they may be among its k nearest of all. A block of points comes before the blocks of rows that it meets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pids, p, ptag, boxed = None, None, None, None
        for pdf in batches:
            for r in pdf.itertuples():
                ids, tag = (np.frombuffer(v, dtype=np.int64) for v in (r.ids, r.tag))
                x = np.frombuffer(r.x).reshape(len(ids), -1)
                if r.block == NONE:
                    pids, p, ptag = ids, x, tag
                    boxed = Boxed(ids, x, tag, sides) if k == 1 and floor is not None and _placed(x[:, :sides]) else None
                    continue
                most = _within(ids, r.known, r.most)
                if boxed is not None and _placed(x[:, :sides]):
                    own, near, d = _by_cells(Boxed(ids, x, tag, sides), boxed, kernel, floor, most)
                    yield pd.DataFrame({"block": np.full(len(own), r.block), "id": own, "point": near, "distance": d})
                    continue
                step = max(1, TILE // len(pids))
                for at in range(0, len(ids), step):
                    d = kernel(x[at : at + step], tag[at : at + step], p, ptag)
                    n = min(k, len(pids))
                    least = np.partition(d, n - 1, axis=1)[:, n - 1]
                    a, c = np.nonzero(d <= np.minimum(least, most[at : at + step])[:, None])  # ties too, ids decide
                    order = np.lexsort((pids[c], d[a, c], a))
                    a, c = a[order], c[order]
                    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                    place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
                    a, c = a[place < k], c[place < k]
                    yield pd.DataFrame({"block": np.full(len(a), r.block), "id": ids[at + a], "point": pids[c], "distance": d[a, c]})

    return run


FOUND = "block long, id long, point long, distance double"


def _dealt(pairs: DataFrame) -> DataFrame:
    """pairs (block, points), written, with the part of those of its block of points that each belongs to."""
    rank = F.row_number().over(Window.partitionBy("points").orderBy("block"))
    return sent(pairs.withColumn("part", F.floor((rank - 1) / PAIRS)))


def nearest_points(rows: DataFrame, points: DataFrame, k: int, kernel: Callable, reach: Callable[[Column], Column], point_bytes: int = POINT_BYTES, row_bytes: int = ROW_BYTES, sides: int | None = None, floor: Callable | None = None) -> DataFrame:
    """rows and points (id long, x array<double>, tag long): id, rank, point and distance of the k nearest points of
    each row, the smaller point of equals; ids of rows are unique. kernel(x, tags, points, tags) gives distances;
    reach(distance) is the Euclidean distance of x beyond which no point can be as near. With `sides`, only so many of x
    tell the place, and the kernel alone sees the others. floor(gaps, same) is the smallest distance of points at least
    so far off, whose tags may be the row's (same) or are not."""
    small_batches(rows.sparkSession)
    if k == 1:  # of points that are alike only the first can be nearest
        points = points.groupBy("x", "tag").agg(F.min("id").alias("id")).select("id", "x", "tag")
    own, other = packed(rows, row_bytes, sides), packed(points, point_bytes, sides)
    blocks = other.count()
    slots = max(1, -(-blocks // TOGETHER))
    upper = other.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots))).select("slot", "block", "centre", "radius").groupBy("slot").applyInPandas(_summary, "slot long, blocks binary, centres binary, radii binary")
    each = lambda df: df.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))).join(upper, "slot")
    small = own.select("block", "centre", "radius")
    home = each(small).mapInPandas(_looked(True), "block long, points long, gap double").groupBy("block").agg(F.min_by("points", F.struct("gap", "points")).alias("points"))
    home = _dealt(home)
    blob = F.lit(None).cast("binary")

    def search(pairs: DataFrame, own: DataFrame) -> DataFrame:
        parts = sent(pairs.select("points", "part").distinct())
        held = parts.join(other.withColumnRenamed("block", "points"), "points").select("points", "part", F.lit(NONE).cast("long").alias("block"), "ids", "x", "tag", blob.alias("known"), blob.alias("most"))
        both = held.union(pairs.join(own, "block").select(held.columns)).repartition(max(1, 2 * parts.count()), "points", "part")
        return both.sortWithinPartitions("points", "part", "block").mapInPandas(_pairs(kernel, k, floor, sides), FOUND)

    found = first = cut(search(home, own.withColumns({"known": blob, "most": blob})))
    if blocks > 1:
        known = cut(first.groupBy("block").applyInPandas(_known(k), "block long, known binary, most binary, d double"))
        limits = known.select("block", reach(F.col("d")).alias("reach"))
        more = each(small.join(limits, "block").join(home.select("block", F.col("points").alias("home")), "block"))
        more = _dealt(more.mapInPandas(_looked(False), "block long, points long, gap double").select("block", "points"))
        found = first.union(search(more, own.join(known, "block")))
    found = found.select("id", "point", "distance")
    best = Window.partitionBy("id").orderBy("distance", "point")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("id", "rank", "point", "distance")
