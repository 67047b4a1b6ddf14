"""Kernels against analytic answers."""

import itertools

import numpy as np
import pytest

from sievemill.operators import kernels as k


def test_adc_of_a_quantized_sine():
    n, bits = 4096, 10
    codes = np.round((np.sin(2 * np.pi * 101 * np.arange(n) / n) + 1) / 2 * (2**bits - 1))
    m = k.adc_dynamic(codes)
    assert abs(m["enob"] - bits) < 0.3 and m["snr"] >= m["sinad"] > 55
    third = k.adc_dynamic(codes + 10 * np.sin(2 * np.pi * 303 * np.arange(n) / n))
    assert -36 < third["thd"] < -32 and third["sinad"] < m["sinad"]


def test_savgol_keeps_parabolas():
    x = np.arange(60.0)
    y = 3 - 2 * x + 0.5 * x * x
    assert np.allclose(k.savgol(y, 11), y) and np.allclose(k.savgol(y, 11, derivative=1), -2 + x)
    holed = y.copy()
    holed[[10, 30]] = np.nan
    assert np.isfinite(k.savgol(holed, 11)).all() and np.isnan(k.savgol(np.full(8, np.nan), 5)).all()
    assert len(k.savgol(np.arange(3.0), 11)) == 3


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 6)):
        c = rng.random((n, m))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        a = k.assign(c)
        assert len(set(a.tolist())) == n and abs(c[np.arange(n), a].sum() - best) < 1e-12


def test_poles_are_matched():
    a, b = np.array([-1 + 2j, -1 - 2j, -5]), np.array([-5.1, -1.1 - 2j, -1.1 + 2j, -90])
    assert sorted(k.match_poles(a, b)) == [(0, 2), (1, 1), (2, 0)]


POLES = np.array([-0.5 + 6j, -0.5 - 6j, -3])


def response(t):
    return (2 * np.exp(-0.5 * t) * np.cos(6 * t) + 1.5 * np.exp(-3 * t)).real


def distance(found):
    return max(min(abs(found - p)) / abs(p) for p in POLES)


def test_identification():
    dt = 0.02
    t = np.arange(400) * dt
    poles, residues = k.prony(response(t), dt, 3)
    assert distance(poles) < 1e-6
    assert np.allclose((np.exp(np.outer(t, poles)) @ residues).real, response(t), atol=1e-6)
    assert distance(k.era(response(t[:200]), dt, 3)) < 1e-6
    rng = np.random.default_rng(0)
    u = rng.normal(size=600)
    roots = np.exp(POLES * dt)
    a, b = np.poly(roots).real, [0.2, 0.1]
    y = np.zeros(600)
    for n in range(3, 600):
        y[n] = -a[1:] @ y[n - 3 : n][::-1] + b[0] * u[n] + b[1] * u[n - 1]
    assert distance(k.arx(u, y, dt, 3)) < 1e-6


@pytest.mark.parametrize("poles, residues", [([-1e3], [5e3]), ([-1e3 + 9e3j, -1e3 - 9e3j, -4e4], [2e3 + 1e3j, 2e3 - 1e3j, 3e4])])
def test_vector_fit(poles, residues):
    s = 1j * np.geomspace(1e2, 1e6, 200)
    h = sum(r / (s - p) for p, r in zip(poles, residues)) + 0.1
    found, res, const = k.vector_fit(s, h, len(poles))
    fit = sum(r / (s - p) for p, r in zip(found, res)) + const
    assert np.abs(fit - h).max() / np.abs(h).max() < 1e-6
    assert max(min(abs(found - p)) / abs(p) for p in np.array(poles)) < 1e-4


def test_transients():
    t = np.arange(100) * 0.1
    v = np.where(t < 5, 1.0, 1 - np.exp(-(t - 5)) * np.cos(4 * (t - 5)))
    m = k.transient(t, v, 50)
    assert m["undershoot"] == pytest.approx(1.0) and m["overshoot"] > 0.3 and m["ringing"] >= 2 and 3 < m["settling"] <= 5
    assert k.settles(t, np.r_[np.zeros(20), np.ones(80)], 1.0) and not k.settles(t, np.r_[np.zeros(97), 9, 8, 7], 1.0) and not k.settles(t[:4], t[:4], 0)


def test_groups_and_their_errors(spark):
    rows = [("a", i, 0.1, 0.0, float(response(np.array([i * 0.02]))[0])) for i in range(300)] + [("b", i, 0.1, 0.0, 1.0) for i in range(2)]
    df = spark.createDataFrame([(n, i, 0.02, u, y) for n, i, _, u, y in rows], "network string, idx int, dt double, u double, y double")
    got = k.identify(df, "prony", 3).collect()
    assert distance(np.array([complex(r["re"], r["im"]) for r in got if r["network"] == "a"])) < 1e-4
    assert all(r["error"] for r in got if r["network"] == "b")


def test_settled_islands_are_those_of_the_kernel(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for run in range(12):
        idx = 0
        for island, n in enumerate(rng.integers(1, 40, 6)):
            v = 1 + rng.choice([0.001, 0.5]) * np.exp(-np.arange(n) / rng.choice([1, 50]))
            t = (idx + np.arange(n)) * 0.5
            want[f"{run}/{island}"] = k.settles(t, v, 6.0)
            rows += [(run, idx + i, float(a), float(b), "ab"[island % 2]) for i, (a, b) in enumerate(zip(t, v))]
            idx += int(n)
    df = spark.createDataFrame(rows, "run_key int, idx int, t double, value double, state string").repartition(5)
    assert {r["stretch"]: r["settled"] for r in k.settled_islands(df, 6.0).collect()} == want and len(set(want.values())) == 2
    gap = df.withColumn("value", k.F.when(k.F.col("idx") % 5 != 0, k.F.col("value")))
    long = {x["stretch"] for x in df.groupBy("run_key").count().selectExpr("concat(run_key, '/0') AS stretch").collect()}
    lost = [r["settled"] for r in k.settled_islands(gap, 0.0).collect() if r["stretch"] in long]
    assert lost and not any(lost)  # each stretch of five samples or more lacks one near its end, shorter ones are too short
