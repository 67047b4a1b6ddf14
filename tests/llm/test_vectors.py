"""Operators over embeddings, against brute force, planted cases and the defined odd cases."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import connect, rows
from sievemill.llm import near_vectors, negatives, queries, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"
#: Null, empty, zero and broken vectors, null ids and labels, repeated and scaled vectors, one of another length.
ODD = [
    (0, [0.5, 0.25, 0.0], 1),
    (1, [0.5, 0.25, 0.0], 1),
    (1, [0.5, 0.25, 0.0], 1),
    (2, [1.0, 0.5, 0.0], 1),
    (3, [0.5, 0.25, 0.0], 2),
    (4, None, 1),
    (5, [], 1),
    (6, [0.0, 0.0, 0.0], 1),
    (8, [NAN, 0.0, 1.0], 1),
    (9, [INF, 0.0, 1.0], 1),
    (10, [None, 0.0, 1.0], 1),
    (11, [0.5, 0.25, 0.01], None),
    (None, [0.5, 0.25, 0.001], 1),
    (100, [0.25, 0.5, 0.125], 2),
    (12, [-0.5, 0.5, 0.0], 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    names = "x cell a c n root u v f1 f2 first copies component whitened n_links kept rank own lo hi score".split()
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", *[f"'z' AS {n}" for n in names])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def good(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


# --- hard negatives


def brute_negatives(data, anchor, most=5, low=80, high=100):
    """data: (id, label, integer vector), equal rows once."""
    data, out = list(dict.fromkeys((i, y, tuple(x)) for i, y, x in data)), []
    for i, y, x in data:
        if anchor(i):
            score = [(-sum(a * b for a, b in zip(x, z)), j, w) for j, w, z in data if len(z) == len(x)]
            for s, p, _ in sorted(t for t in score if t[2] == y and t[1] != i)[:most]:
                window = sorted(t[:2] for t in score if t[2] != y and low * -s <= 100 * -t[0] <= high * -s)[:most]
                out += [(i, p, k + 1, j, -s, -n) for k, (n, j) in enumerate(window)]
    return sorted(out)


def integer_rows(df):
    return [(r["vec_id"], r["label"], [math.floor(256 * c) for c in r["embedding"]]) for r in df.collect() if r["vec_id"] is not None and r["label"] is not None and good(r["embedding"])]


@pytest.mark.parametrize("tree_bytes", [8 << 20, 20_000])
def test_negatives_are_those_of_brute_force(spark, sf_dir, tree_bytes):
    """One tree, and many small ones with cells."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = negatives.hard_negatives(negatives.usable_rows(df), F.col("vec_id") % 20 == 0, tree_bytes=tree_bytes)
    assert sorted(map(tuple, got.collect())) == brute_negatives(integer_rows(df), lambda i: i % 20 == 0) != []


def test_negatives_with_ties_copies_and_other_windows(spark):
    """A third of the rows hold one vector, in both labels; small integers tie often."""
    rng = np.random.default_rng(3)
    data = [(i, [0.25, 0.5, 0.0, 0.25] if i % 3 == 0 else (rng.integers(-3, 4, 4) / 8).tolist(), int(rng.integers(0, 3))) for i in range(900)]
    df = spark.createDataFrame(data, SCHEMA)
    rows_ = negatives.usable_rows(df)
    for low, high, most in ((80, 100, 5), (50, 130, 2), (100, 100, 7)):
        got = negatives.hard_negatives(rows_, F.col("vec_id") % 90 == 0, most, most, low, high, tree_bytes=4000)
        assert sorted(map(tuple, got.collect())) == brute_negatives(integer_rows(df), lambda i: i % 90 == 0, most, low, high)


def test_negatives_odd(odd, none):
    for df in (odd, none):
        got = sorted(map(tuple, negatives.hard_negatives(negatives.usable_rows(df), F.col("vec_id") % 2 == 0).collect()))
        assert got == brute_negatives(integer_rows(df), lambda i: i % 2 == 0)


def test_bounds_hold_and_scores_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (1000, 8))
    tree = negatives.BallTree(np.arange(1000), np.zeros(1000, dtype=np.int64), x)
    q = rng.integers(-300, 300, (5, 8))
    low, high = negatives.bounds(q.astype(float), tree.centre, tree.radius)
    for n, (a, b) in enumerate(zip(tree.start, tree.stop)):
        s = q @ tree.x[a:b].T
        assert (s.min(axis=1) >= low[:, n]).all() and (s.max(axis=1) <= high[:, n]).all()
    big = np.array([[1 << 30, (1 << 30) + 1], [3, 5]])
    assert negatives.scores(big, big).tolist() == [[sum(a * b for a, b in zip(r, s)) for s in big.tolist()] for r in big.tolist()]
    with pytest.raises(OverflowError):
        negatives.scores(np.array([[1 << 62]]), np.array([[4]]))


def test_pruning_reads_few_leaves():
    """Rows in tight, far clusters: a query reads its own cluster's leaves, not all."""
    rng = np.random.default_rng(2)
    centre = rng.integers(-100, 101, (64, 16)) * 100
    x = np.repeat(centre, 128, axis=0) + rng.integers(-3, 4, (64 * 128, 16))
    tree = negatives.BallTree(np.arange(len(x)), np.arange(len(x)) % 2, x)
    seen, real = [], negatives.scores
    try:
        negatives.scores = lambda rows_, q: (seen.append(rows_.shape[0] * q.shape[0]), real(rows_, q))[1]
        q = x[::997]
        negatives.search(tree, q, np.arange(len(x))[::997], tree.labels[:1].repeat(len(q)), np.full(len(q), negatives.LOWEST), np.full(len(q), negatives.HIGHEST), True, 5)
    finally:
        negatives.scores = real
    assert sum(seen) < 0.2 * len(q) * len(x)


# --- whitening


def exact_covariance(xs):
    n, d = len(xs), len(xs[0])
    mean = [Fraction(sum(x[i] for x in xs), n) for i in range(d)]
    return [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in xs) / n for j in range(d)] for i in range(d)]


def check_whitening(df, components=4):
    data = [(r["vec_id"], [math.floor(256 * c) for c in r["embedding"]]) for r in df.select("vec_id", "embedding").collect() if good(r["embedding"])]
    got = whitening.whiten(df, components).collect()
    fit = sorted({tuple(x) for _, x in data})
    v = np.array(exact_covariance(fit), dtype=float)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    keep = min(components, int((e > 1e-13 * e[0]).sum()))
    assert len(got) == len(data) * keep
    s = [sum(x[i] for x in fit) for i in range(len(fit[0]))]
    want = {}
    for i, x in data:
        y = [len(fit) * a - b for a, b in zip(x, s)]
        z = np.array([t / len(fit) for t in y]) @ axes[:, :keep] / np.sqrt(e[:keep])
        for k in range(keep):
            want.setdefault((i, k + 1), []).append((len(fit), sum(t * t for t in y), z[k]))
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append((r["n"], int(r["deviation"]), r["whitened"]))
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(v), rel=1e-6) and r["identity_error"] < 1e-6
    assert set(by) == set(want)
    for k in range(1, keep + 1):
        sign = np.sign(sum(np.dot([t[2] for t in sorted(by[key])], [t[2] for t in sorted(want[key])]) for key in want if key[1] == k and len(want[key]) == 1))
        for key in (key for key in want if key[1] == k):
            g, w = sorted(by[key]), sorted(want[key])
            assert [t[:2] for t in g] == [t[:2] for t in w]
            if len(w) == 1:
                assert g[0][2] == pytest.approx(sign * w[0][2], abs=1e-6)
    return got


def test_whitening_is_that_of_fractions(spark, sf_dir):
    check_whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 6).alias("embedding")))


def test_whitening_far_from_zero_and_large(spark):
    """Offsets of 10^9 and a spread of a few, large numbers, and a vector that a third of all rows hold."""
    rng = np.random.default_rng(4)
    base = np.array([1e9, -3e8, 5.0, 2e6, 0.5])
    data = [(i, (base + (0 if i % 3 == 0 else rng.integers(-4, 5, 5) * [1, 2, 3, 1, 5])).tolist()) for i in range(300)]
    check_whitening(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    data = [(i, (rng.standard_normal(3) * [1e14, 1e13, 1e12]).tolist()) for i in range(50)]
    check_whitening(spark.createDataFrame(data, "vec_id long, embedding array<double>"))


def test_whitening_of_low_rank_and_odd(spark, odd, none):
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in check_whitening(line)} == {1}
    assert len(check_whitening(odd.filter("vec_id <> 12 or vec_id is null"))) > 0
    alike = spark.createDataFrame([(1, [0.5]), (2, [0.5])], "vec_id long, embedding array<double>")
    for df in (alike, none):
        got = whitening.whiten(df)
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(Exception, match="one length"):
        whitening.whiten(spark.createDataFrame([(1, [0.5]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>"))


def test_digits_are_exact():
    rng = np.random.default_rng(5)
    for most in (300, 1 << 30, (1 << 63) - 1):
        x = rng.integers(-most, most, (200, 5), endpoint=True)
        exact = x.astype(object)
        assert (whitening.whole(whitening.gram(x)) == exact.T @ exact).all()
        assert (whitening.whole(whitening.added(whitening.gram(x), whitening.gram(x))) == 2 * (exact.T @ exact)).all()
        assert (whitening.whole(whitening.column_sums(x)) == exact.sum(axis=0)).all()
        assert whitening.squares(x >> 3) == ((exact >> 3) ** 2).sum(axis=1).tolist()


# --- near duplicates


def brute_near(data, threshold=0.93):
    """(id, links, component, kept) of rows (id, vector, label)."""
    fit = [i for i, (_, v, y) in enumerate(data) if good(v) and any(v) and y is not None]
    links = {i: set() for i in range(len(data))}
    for i in fit:
        for j in fit:
            a, b = np.array(data[i][1], dtype=float), np.array(data[j][1], dtype=float)
            if i != j and data[i][2] == data[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i].add(j)
    out = []
    for i in range(len(data)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [data[j][0] for j in seen if data[j][0] is not None]
        least = min(ids) if ids else None
        out.append((data[i][0], len(links[i]), least, data[i][0] == least))
    return sorted(out, key=str)


def found_near(df, **more):
    return sorted(map(tuple, near_vectors.near_duplicate_vectors(df, **more).drop("audited_recall").collect()), key=str)


def planted(n=600, d=24, seed=6):
    """Noise, pairs, a group of 200 near copies, a chain whose ends are far apart, and exact copies."""
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(d) for _ in range(n)]
    out += [v + 0.05 * rng.standard_normal(d) for v in out[: n // 10]]
    out += [out[0] + 0.05 * rng.standard_normal(d) for _ in range(200)] + [out[1]] * 30
    a, b = np.eye(d)[:2]
    out += [10 * (math.cos(t) * a + math.sin(t) * b) for t in np.linspace(0, 3, 60)]
    order = rng.permutation(len(out))
    return [(int(i), [float(c) for c in np.float32(out[j])], int(j % 2) if j < n else 0 if j >= n + n // 10 else int((j - n) % 2)) for i, j in enumerate(order)]


def test_near_vectors_are_those_of_brute_force(spark, monkeypatch):
    data = planted()
    want = brute_near(data)
    df = spark.createDataFrame(data, SCHEMA)
    assert found_near(df) == want
    monkeypatch.setattr(near_vectors, "PART_BYTES", 16_000)  # many partitions, blocks and rounds
    monkeypatch.setattr(near_vectors, "BLOCK", 32)
    monkeypatch.setattr(near_vectors, "LEAF", 40)
    got = found_near(df, passes=5)
    missed = sum(w[1] - g[1] for g, w in zip(got, want))
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and missed <= 0.01 * sum(w[1] for w in want)


def test_recall_is_audited(spark, monkeypatch):
    """Lists cut short show in the audited figure."""
    df = spark.createDataFrame(planted(), SCHEMA)
    assert near_vectors.near_duplicate_vectors(df).first()["audited_recall"] == 1.0
    monkeypatch.setattr(near_vectors, "crowded_counts", lambda members, threshold: members.limit(0).selectExpr("c", "cast(0 as long) n_links"))
    assert near_vectors.near_duplicate_vectors(df, passes=1).first()["audited_recall"] < 0.5


def test_blocks_are_decided_by_their_balls():
    """All and no links by centre and radius, never against what comparing gives."""
    rng = np.random.default_rng(7)
    for spread in (0.01, 0.1, 0.3):
        a, b = (near_vectors.units(c + spread * rng.standard_normal((20, 8))) for c in rng.standard_normal((2, 8)))
        for x, y in ((a, a), (a, b)):
            import pandas as pd

            side = lambda u, k: {f"block{k}": [1], f"n{k}": [20], f"centre{k}": [u.mean(axis=0).tobytes()], f"radius{k}": [float(np.sqrt(((u - u.mean(axis=0)) ** 2).sum(axis=1).max()))]}
            got = next(near_vectors._decide(0.93)(iter([pd.DataFrame(side(x, "") | side(y, "2"))])))
            links = x @ y.T >= 0.93
            assert links.all() if len(got) and got["all"].iloc[0] else len(got) or not links.any()


def test_near_vectors_odd(odd, none):
    assert found_near(odd) == brute_near(ODD)
    assert found_near(none) == []


@pytest.mark.parametrize("name", ["op11_ball_tree_negatives", "op13_nn_descent_near_dedup"])
def test_queries_give_the_rows_of_their_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = connect(sf_dir).execute(queries.ORACLES[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
