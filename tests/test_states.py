"""Splits of states and guards of transitions against brute force."""

import numpy as np
import pytest

from sievemill.operators import guards as gd
from sievemill.operators import mixtures as mx


def whole_em(x, k, floor=1e-6, rounds=40, tolerance=1e-3):
    """Expectation and maximisation over all rows at once, from equal shares of the widest feature."""
    n, d = x.shape
    widest = x.var(axis=0).argmax()
    cuts = [np.sort(x[:, widest])[int(np.ceil(n * round(840 * j / k) / 840)) - 1] for j in range(1, k)]
    share, before = np.eye(k)[np.searchsorted(cuts, x[:, widest])], -np.inf
    for turn in range(rounds + 1):
        w = share.sum(axis=0)
        mean = share.T @ x / w[:, None]
        cov = np.array([(share[:, j, None] * (x - mean[j])).T @ (x - mean[j]) / w[j] + floor * np.eye(d) for j in range(k)])
        log = np.stack([np.log(w[j] / n) - 0.5 * (np.log(np.linalg.det(2 * np.pi * cov[j])) + np.einsum("ni,ij,nj->n", x - mean[j], np.linalg.inv(cov[j]), x - mean[j])) for j in range(k)], axis=1)
        total = mx.log_sum(log)
        if abs(total.mean() - before) < tolerance or turn == rounds - 1:
            return total.sum(), mean, log.argmax(axis=1)
        before, share = total.mean(), np.exp(log - total[:, None])


def test_mixtures_are_those_over_all_rows(spark):
    rng = np.random.default_rng(2)
    groups = {"a": [(0, 0), (6, 0), (12, 3)], "b": [(0, 0), (0, 8)], "c": [(5, 5)]}
    rows = {s: np.concatenate([rng.standard_normal((150, 2)) + m for m in ms]) for s, ms in groups.items()}
    data = [(s, i, s, float(a), float(b)) for s, x in rows.items() for i, (a, b) in enumerate(x)] + [("few", i, "few", 1.0 * i, 0.0) for i in range(5)] + [("a", 900, "a", None, 1.0)]
    df = spark.createDataFrame(data, "run_key string, idx int, state string, p double, q double").repartition(5)
    got = mx.fit_mixtures(df, ["p", "q"], most=5)
    for s, x in rows.items():
        best = min((mx.bic(whole_em(x, k)[0], len(x), k, 2), k) for k in range(2, 6))
        assert len(got[s][0].weight) == best[1] and got[s][1] == pytest.approx(best[0], rel=1e-5)
        mean = whole_em(x, best[1])[1]
        assert np.allclose(np.sort(got[s][0].mean, axis=0), np.sort(mean, axis=0), atol=1e-3)
    told = mx.mixture_states(df, ["p", "q"], most=5).toPandas()
    assert told[told["p"].isna()]["component"].isna().all() and (told[told["state"] == "few"]["components"] == 1).all()
    a = told[(told["state"] == "a") & told["p"].notna()]
    assert a["components"].iloc[0] == 3 and (a.sort_values("idx")["component"].to_numpy() == np.repeat([0, 1, 2], 150)).mean() > 0.98


def test_splits_need_size_variance_and_calm(spark):
    calm = [("r", i, "calm", float(i >= 40)) for i in range(80)]
    wild = [("r", 100 + i, "wild", float(i % 2)) for i in range(80)]
    flat = [("r", 200 + i, "flat", 3.0) for i in range(80)]
    few = [("r", 300 + i, "few", float(i > 4)) for i in range(9)]
    long = [("q", i, "long", float(i >= 6000)) for i in range(9000)]
    df = spark.createDataFrame(calm + wild + flat + few + long, "run_key string, idx int, state string, v double")
    got = {r["state"]: r for r in mx.split_states(df, ["v"]).collect()}
    assert {s: r["accepted"] for s, r in got.items()} == {"calm": True, "wild": False, "flat": False, "few": False, "long": True}
    assert got["calm"]["low"] == [0.0] and got["calm"]["high"] == [1.0] and got["wild"]["changes"] == 79 and got["long"]["changes"] == 1 and got["flat"]["high"] is None


def brute_tree(x, y, depth):
    """Node -> (n, pos, feature, threshold), every midpoint tried."""
    out = {}

    def grow(own, node):
        n, pos = len(own), int(y[own].sum())
        best = None
        if node < 2**depth:
            for f in range(x.shape[1]):
                v = np.unique(x[own, f])
                for t in (v[1:] + v[:-1]) / 2:
                    left = x[own, f] <= t
                    p, m = int(y[own][left].sum()), int(left.sum())
                    score = p * p / m + (pos - p) ** 2 / (n - m)
                    if score > pos * pos / n * (1 + 1e-12) + 1e-12 and (best is None or score > best[0]):
                        best = score, f, t
        out[node] = (n, pos, *(best[1:] if best else (None, None)))
        if best:
            left = x[own, best[1]] <= best[2]
            grow(own[left], 2 * node)
            grow(own[~left], 2 * node + 1)

    grow(np.arange(len(x)), 1)
    return out


def test_trees_are_those_of_all_midpoints(spark):
    """Features of few values, so that every value has a bin of its own."""
    rng = np.random.default_rng(5)
    n = 1500
    x = np.stack([rng.integers(0, 40, n), rng.integers(0, 7, n), rng.integers(0, 100, n)], axis=1).astype(float)
    state = np.array(["s"] * n, dtype=object)
    for i in range(1, n):
        if state[i - 1] == "s":
            state[i] = "t" if x[i, 0] > 25 and x[i, 1] <= 3 else "u" if x[i, 2] > 90 else "s"
    df = spark.createDataFrame([("r", i, state[i], *map(float, x[i])) for i in range(n)], "run_key string, idx int, state string, vin double, mode double, iload double")
    trees = gd.grow(gd.steps(df, ["vin", "mode", "iload"]), depth=4)
    got = {}
    for r in trees.collect():
        got.setdefault((r["src"], r["dst"]), {})[r["node"]] = (r["n"], r["pos"], r["feature"], r["threshold"])
    want = {}
    for src in "stu":
        at = np.flatnonzero(state[:-1] == src)
        for dst in set(state[at + 1]) - {src}:
            want[src, dst] = brute_tree(x[at + 1], (state[at + 1] == dst).astype(int), 4)
    assert got == want
    told = {(r["src"], r["dst"]): r for r in gd.guards(trees, ["vin", "mode", "iload"]).collect()}
    assert told["s", "t"]["guard"] in ("(V(vin) > 25.5 && mode <= 3.5)", "(mode <= 3.5 && V(vin) > 25.5)") and told["s", "t"]["share"] == 1.0
    assert told["t", "s"]["guard"] == "(1)" and "I(iload) > 90.5" in told["s", "u"]["guard"]


def test_steps_cross_pieces_and_not_runs(spark):
    df = spark.range(10_000).selectExpr("cast(id % 2 as string) AS run_key", "cast(id div 2 as int) AS idx", "cast(id div 2 % 3 as string) AS state", "double(id div 2) AS v")
    got = gd.steps(df, ["v"]).collect()
    assert len(got) == 9998 and all((int(r["x"][0]) - 1) % 3 == int(r["src"]) and int(r["x"][0]) % 3 == int(r["next"]) for r in got)


def test_steps_are_read_once(spark):
    """However many levels a tree has, the steps are made once; deeper nodes add up to those above."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    pairs = spark.range(400).selectExpr("CAST(id % 3 AS STRING) AS src", "CAST(id * id % 7 % 3 AS STRING) AS next", "array(CAST(id % 7 AS DOUBLE)) AS x")
    trees = gd.grow(pairs.mapInPandas(seen, "src string, next string, x array<double>"), depth=3).collect()
    assert read.value == 400 and max(r["node"] for r in trees) > 3
    at = {(r["src"], r["dst"], r["node"]): r for r in trees}
    for (src, dst, node), r in at.items():
        if r["feature"] is not None:
            assert all(r[c] == at[src, dst, 2 * node][c] + at[src, dst, 2 * node + 1][c] for c in ("n", "pos"))
