"""Nearest points by blocks against brute force."""

import numpy as np
import pytest

from sievemill.operators import blocks, graph, lookup


@pytest.mark.parametrize("point_bytes, row_bytes", [(8 << 20, 1 << 20), (600, 300)])
def test_nearest_points(spark, point_bytes, row_bytes):
    """In one block and in many; a third of the points lie in one place, many distances tie."""
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.integers(0, 50, (200, 2)), np.tile([[7, 7]], (100, 1)), rng.integers(400, 420, (50, 2))]).astype(float)
    x = np.concatenate([rng.integers(0, 60, (150, 2)), rng.integers(390, 430, (20, 2)), [[1e4, -1e4]]]).astype(float)
    tags = rng.integers(0, 3, len(p)), rng.integers(0, 3, len(x))
    frame = lambda v, t: spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(v, t))], "id long, x array<double>, tag long")
    far = lambda a, s, b, t: ((a[:, None] - b) ** 2).sum(axis=2) + (s[:, None] != t) * 10.0
    d = far(x, tags[1], p, tags[0])
    for k in (1, 4):
        got = blocks.nearest_points(frame(x, tags[1]), frame(p, tags[0]), k, far, blocks.F.sqrt, point_bytes, row_bytes).collect()
        want = {(i, r + 1): (int(j), d[i, j]) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(p)), d[i]))[:k])}
        assert {(r["id"], r["rank"]): (r["point"], r["distance"]) for r in got} == want
    few = blocks.nearest_points(frame(x, tags[1]), frame(p[:2], tags[0][:2]), 4, far, blocks.F.sqrt, point_bytes, row_bytes).collect()
    assert len(few) == 2 * len(x)
    assert blocks.nearest_points(frame(x, tags[1]).limit(0), frame(p, tags[0]), 1, far, blocks.F.sqrt).collect() == []
    assert blocks.nearest_points(frame(x, tags[1]), frame(p, tags[0]).limit(0), 1, far, blocks.F.sqrt).collect() == []


def test_far_blocks_are_not_looked_at(spark):
    """Rows and points in 16 far clusters: few of the pairs of blocks are compared."""
    rng = np.random.default_rng(2)
    centre = rng.permutation(16)[:, None] * np.array([1e6, -1e6])
    rows = [(int(16 * i + j), (centre[j] + rng.standard_normal(2)).tolist(), 0) for i in range(40) for j in range(16)]
    df = spark.createDataFrame(rows, "id long, x array<double>, tag long")
    compared = spark.sparkContext.accumulator(0)

    def far(a, _, b, __):
        compared.add(len(a) * len(b))
        return ((a[:, None] - b) ** 2).sum(axis=2)

    got = blocks.nearest_points(df, df, 1, far, blocks.F.sqrt, 640, 640).collect()
    assert all(r["id"] == r["point"] for r in got) and len(got) == 640 and compared.value < 0.35 * 640 * 640 * 2


def test_cosine_neighbours(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.standard_normal((300, 8)), np.zeros((2, 8)), np.tile(rng.standard_normal((1, 8)), (40, 1))])
    df = spark.createDataFrame([(i, [float(c) for c in a]) for i, a in enumerate(v)], "i long, iv array<float>")
    u = np.float32(v).astype(float)
    u = u / (np.sqrt((u * u).sum(axis=1, keepdims=True)) + 1e-8)
    got = graph.cosine_neighbours(df, df.filter("i % 20 = 0"), 6).collect()
    for q in range(0, len(v), 20):
        sim = np.round(u @ u[q], 12)
        want = np.lexsort((np.arange(len(v)), -sim))[:6]
        assert [(r["i"], round(r["sim"], 9)) for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] == [(int(j), round(sim[j], 9)) for j in want]


def test_nearest_corner_with_missing_processes(spark):
    rows = spark.createDataFrame([(1, 1.0, 20.0, "TT"), (2, 5.0, 0.0, "XX"), (3, 1.0, 20.0, None)], "id long, v double, t double, process string")
    grid = spark.createDataFrame([(10, 1.0, 20.0, "FF"), (11, 1.2, 25.0, "TT"), (12, 4.0, 0.0, "SS")], "corner long, gv double, gt double, gprocess string")
    got = {r["id"]: (r["corner"], round(r["distance"], 6)) for r in lookup.nearest(rows, grid, 1.0, 10.0).collect()}
    assert got == {1: (11, 0.29), 2: (12, 11.0), 3: (10, 10.0)}


def test_large_nets_are_cut(spark):
    """The pairs are the same however a net is cut, and large nets can be told by membership."""
    rows = [(i, ["vdd", "vdd", f"n{i % 7}"]) for i in range(60)] + [(90, [])]
    df = spark.createDataFrame(rows, "component int, nets array<string>")
    want = sorted([("vdd", a, b) for a in range(60) for b in range(a + 1, 60)] + [(f"n{a % 7}", a, b) for a in range(60) for b in range(a + 7, 60, 7)])
    for size in (2048, 16, 7):
        assert sorted(map(tuple, graph.net_edges(df, size=size).collect())) == want
    assert sorted(map(tuple, graph.net_edges(df, most=20).collect())) == [t for t in want if t[0] != "vdd"]
    assert sorted(map(tuple, graph.net_members(df, 20).collect())) == [("vdd", 60, i) for i in range(60)]


def test_corners_that_tie_in_plain_numbers(spark):
    """Corners as far above as below: differences decide, as in SQL, not quotients rounded before."""
    gaps = np.arange(1, 400) / 4
    at = [(i, 1000.25 + 10 * i) for i in range(len(gaps))]
    rows = spark.createDataFrame([(i, v, 3.0, "TT") for i, v in at], "id long, v double, t double, process string")
    corners = [(2 * i + (up > 0) * 1, v + up * (gaps[i] % 4 + 0.25), 3.0, "TT") for i, v in at for up in (1, -1)]
    grid = spark.createDataFrame([(int(c), float(v), t, p) for c, v, t, p in corners], "corner long, gv double, gt double, gprocess string")
    gv = np.array([c[1] for c in corners])
    ids = np.array([c[0] for c in corners])
    want = {i: int(ids[np.lexsort((ids, ((v - gv) / 1000.0) ** 2))[0]]) for i, v in at}
    assert {r["id"]: r["corner"] for r in lookup.nearest(rows, grid, 1000.0, 5.0).collect()} == want


def test_a_worker_holds_a_tile_and_few_blocks(spark):
    """A call of the kernel makes at most TILE distances, and pairs of blocks reach a worker a few megabytes at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    large = spark.sparkContext.accumulator(0)

    def far(a, _, b, __):
        large.add(len(a) * len(b) > 1 << 18)
        return (a - b[:, 0]) ** 2

    try:
        spark.conf.set(key, "64m")
        df = spark.range(1500).selectExpr("id", "array(CAST(id AS DOUBLE)) AS x", "0L AS tag")
        got = blocks.nearest_points(df, df, 1, far, blocks.F.sqrt).collect()
        assert len(got) == 1500 and all(r["id"] == r["point"] for r in got) and large.value == 0
        assert int(spark.conf.get(key).removesuffix("b")) <= 8 << 20
        spark.conf.set(key, "1m")
        blocks.nearest_points(df.limit(3), df.limit(3), 1, far, blocks.F.sqrt)
        assert spark.conf.get(key) in ("1m", "1048576", "1048576b")
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("point_bytes, row_bytes", [(8 << 20, 32 << 10), (64 << 10, 32 << 10)])
def test_nearest_corner_looks_at_few_corners(spark, monkeypatch, point_bytes, row_bytes):
    """Frequent, rare and unknown processes, corners alike, ties, and numbers far out or missing: as brute force, with
    few of the pairs compared, and those of one block of corners in several tasks."""
    from pyspark import TaskContext
    from pyspark.accumulators import AccumulatorParam

    class Seen(AccumulatorParam):
        def zero(self, value):
            return set()

        def addInPlace(self, a, b):
            return a | b

    compared, tasks, real = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(set(), Seen()), blocks.nearest_points

    def counted(rows, points, k, kernel, *rest, **named):
        def far(x, tag, p, ptag):
            compared.add(len(x) * len(p))
            tasks.add({TaskContext.get().partitionId()})
            return kernel(x, tag, p, ptag)

        return real(rows, points, k, far, *rest, **named | {"point_bytes": point_bytes, "row_bytes": row_bytes})

    monkeypatch.setattr(blocks, "nearest_points", counted)
    monkeypatch.setattr(blocks, "PAIRS", 1, raising=False)
    rng = np.random.default_rng(4)
    n, m = 6000, 5000
    names = np.array(["TT", "FF", "SS", *[f"P{i}" for i in range(40)]])
    process = lambda k, of: names[rng.choice(len(of), k, p=of / of.sum())]
    v, t, p = rng.integers(-4000, 40000, n) / 4, rng.integers(0, 25, n).astype(float), process(n, np.r_[9, 9, 9, np.full(40, 0.1)])
    gv, gt, gp = rng.integers(-4000, 40000, m) / 4, rng.integers(0, 25, m).astype(float), process(m, np.r_[9, 9, 0, np.full(40, 0.1)])
    gv[1000:1400], gt[1000:1400], gp[1000:1400] = 250.0, 3.0, "TT"
    v[:300], t[:300], p[:300] = 250.0, 3.0, "TT"
    v[300:303] = 1e9, -1e12, float("nan")
    corner = rng.permutation(m) + 7
    rows = spark.createDataFrame([(i, float(a), float(b), str(c)) for i, (a, b, c) in enumerate(zip(v, t, p))], "id long, v double, t double, process string").union(spark.sql("SELECT -1L, CAST(NULL AS DOUBLE), 1D, 'TT'"))
    grid = spark.createDataFrame([(int(i), float(a), float(b), str(c)) for i, a, b, c in zip(corner, gv, gt, gp)], "corner long, gv double, gt double, gprocess string")
    got = {r["id"]: (r["corner"], r["distance"]) for r in lookup.nearest(rows, grid, 1000.0, 5.0).collect()}
    want, by = {}, np.argsort(corner)
    for i in range(n):
        d = ((v[i] - gv[by]) / 1000.0) ** 2 + ((t[i] - gt[by]) / 5.0) ** 2 + (p[i] != gp[by]) * 10.0
        want |= {i: (int(corner[by[d.argmin()]]), d.min())} if v[i] == v[i] else {}
    assert got == want
    assert compared.value < 0.5 * n * m and len(tasks.value) > 1


def test_places_without_a_box(spark):
    """A few rows and points at infinity do not hide the points that others are nearest to."""
    at = [float("inf"), float("-inf"), *[float(i) for i in range(200)]]
    df = spark.createDataFrame([(i, [a, 0.0], 0) for i, a in enumerate(at)], "id long, x array<double>, tag long")
    far = lambda a, _, b, __: (a[:, :1] - b[:, 0]) ** 2
    for floor in (None, lambda gap, _: gap**2):
        got = {r["id"]: r["point"] for r in blocks.nearest_points(df, df, 1, far, blocks.F.sqrt, 800, 400, floor=floor).collect()}
        assert [got[i] for i in range(2, len(at))] == list(range(2, len(at)))
