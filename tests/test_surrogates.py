"""Surrogates, formulas and netlists against dense solutions and hand-made cases."""

import numpy as np
import pytest

from sievemill.operators import netlists
from sievemill.operators import surrogates as sg
from sievemill.sources import formats


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-2, 2, (120, 2))
    y = np.stack([np.sin(2 * x[:, 0]) + x[:, 1], x[:, 0] * x[:, 1] * 50], axis=1)
    rows = [(i, *map(float, a), 1.0, *map(float, b)) for i, (a, b) in enumerate(zip(x, y))] + [(900, None, 1.0, 1.0, 0.0, 0.0)]
    return x, y, spark.createDataFrame(rows, "id int, a double, b double, flat double, y double, z double").repartition(6)


def gauss(k):
    """The inverse by elimination: BLAS threads of the test process may lock up beside a JVM."""
    a = np.hstack([k, np.eye(len(k))])
    for i in range(len(k)):
        a[i] /= a[i, i]
        for j in range(len(k)):
            if j != i:
                a[j] -= a[j, i] * a[i]
    return a[:, len(k) :]


def test_all_points_give_the_dense_process(spark, data):
    x, y, df = data
    model = sg.fit_process(df, ["a", "b", "flat"], ["y", "z"], points=500, lengths=(1.5,), noise=1e-2)
    z, w = (x - x.mean(axis=0)) / x.std(axis=0), (y - y.mean(axis=0)) / y.std(axis=0)
    asked = np.random.default_rng(5).uniform(-3, 3, (40, 2))
    q = (asked - x.mean(axis=0)) / x.std(axis=0)
    k, c = sg.matern_rbf(z, z, 1.5) + 1e-2 * np.eye(len(z)), sg.matern_rbf(q, z, 1.5)
    inverse = gauss(k)
    mean = y.mean(axis=0) + c @ inverse @ w * y.std(axis=0)
    std = np.sqrt(1 - (c @ inverse * c).sum(axis=1))[:, None] * y.std(axis=0)
    rows = spark.createDataFrame([(i, *map(float, a), 1.0) for i, a in enumerate(asked)] + [(99, None, 0.0, 1.0)], "id int, a double, b double, flat double")
    got = {r["id"]: r for r in sg.predicted(rows, model, ["a", "b", "flat"]).collect()}
    assert got[99]["mean"] is None and got[99]["std"] is None
    assert np.allclose([got[i]["mean"] for i in range(40)], mean, atol=1e-4) and np.allclose([got[i]["std"] for i in range(40)], std, atol=1e-3)


def test_few_points_and_the_best_length(data):
    x, y, df = data
    model = sg.fit_process(df, ["a", "b"], ["y"], points=60, noise=1e-3)
    mean, std = model.predict(x)
    assert len(model.points) == 60 and np.abs(mean[:, 0] - y[:, 0]).mean() < 0.1 and model.length in (0.5, 1.0, 2.0, 4.0)
    far = model.predict(np.array([[50.0, 50.0]]))[1]
    assert far[0, 0] == pytest.approx(y[:, 0].std(), rel=1e-3) and np.median(std) < 0.15 * far[0, 0]
    with pytest.raises(ValueError):
        sg.fit_process(df.limit(0), ["a"], ["y"])


def test_planted_formulas_are_found(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0.5, 3, (400, 3))
    made = {"p": 2 * x[:, 0] / x[:, 1] - 4 * np.sqrt(x[:, 2]) + 1, "q": 5 * np.log(x[:, 1]) + 0.5 * x[:, 0] * x[:, 2]}
    rows = [(k, *map(float, a), float(b)) for k, y in made.items() for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, y double")
    got = sg.formulas(df, ["a", "b", "c"], "y", key="k").collect()
    last = {k: {r["term"]: r["coefficient"] for r in got if r["k"] == k and r["step"] == max(s["step"] for s in got if s["k"] == k)} for k in made}
    big = lambda d: {t: round(c, 4) for t, c in d.items() if abs(c) > 1e-4}
    assert big(last["p"]) == {"a/b": 2.0, "sqrt(c)": -4.0, None: 1.0} and big(last["q"]) == {"log(b)": 5.0, "a*c": 0.5}
    names = list(sg.term_library(["a", "b", "c"]))
    signed = df.selectExpr("k", "a - 1.7 AS a", "b", "c", "y")
    terms = {r["term"] for r in sg.formulas(signed, ["a", "b", "c"], "y", most=9).collect()}
    assert not terms & {"log(a)", "sqrt(a)"} and terms <= {*names, None}


def test_each_step_is_that_of_brute_force():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((200, 6))
    x[:, 5] = x[:, 0] + 0.1 * rng.standard_normal(200)
    y = 3 * x[:, 0] - 2 * x[:, 3] + 0.5 * x[:, 4] + 0.1 * rng.standard_normal(200) + 4
    all_ = np.column_stack([x, y])
    taken, rest = [], y - y.mean()
    for own, w, r2 in sg.pursuit(200, all_.sum(axis=0), all_.T @ all_, np.ones(6, dtype=bool), 4, 1.0):
        z = x - x.mean(axis=0)
        gain = np.abs(z.T @ rest) / np.sqrt((z * z).sum(axis=0))
        gain[taken] = -1
        taken.append(int(gain.argmax()))
        want = np.linalg.lstsq(np.column_stack([x[:, taken], np.ones(200)]), y, rcond=None)[0]
        rest = y - np.column_stack([x[:, taken], np.ones(200)]) @ want
        assert own == taken and np.allclose(w, want) and r2 == pytest.approx(1 - (rest @ rest) / ((y - y.mean()) ** 2).sum())


SPICE = """* three levels
.param rl=2k
.subckt INV in out vdd
Mp out in vdd vdd pch W=2u L=180n
Mn out in 0 0 nch W=1u
+ L=180n
.ends INV
.subckt buf a y
Xi1 a m vcc! inv
Xi2 m y sup INV
Rl y 0 'rl'
.ends
Xb1 n1 n2 buf
Xb2 n2 n3 BUF
Xu n1 n2 macro
C1 n3 0 1p
.end
"""
SPECTRE = """// the same inverter
simulator lang=spectre
parameters wp=2u
subckt inv (in out vdd)
Mp (out in vdd vdd) pch w=wp l=180n
Mn (out in 0 0) nch w=1u \\
  l=180n
ends inv
subckt buf a y
i1 (a m s) inv
i2 (m y s) inv
R1 (y 0) resistor r=2k
ends buf
b1 (n1 n2) buf
c1 (n2 0) capacitor c=1p
"""


def flat(spark, tmp_path, text, name="n.sp"):
    (tmp_path / name).write_text(text)
    return {r["path"]: r for r in netlists.flatten(formats.read_cards(spark, f"{tmp_path}/{name}")).collect()}


def test_subcircuits_are_expanded(spark, tmp_path):
    got = flat(spark, tmp_path, SPICE)
    assert sorted(got) == sorted([f"Xb{b}.{p}" for b in (1, 2) for p in ("Xi1.Mp", "Xi1.Mn", "Xi2.Mp", "Xi2.Mn", "Rl")] + ["Xu", "C1"])
    assert got["Xb1.Xi1.Mp"]["nets"] == ["Xb1.m", "n1", "Xb1.vcc!", "Xb1.vcc!"] and got["Xb1.Xi2.Mn"]["nets"] == ["n2", "Xb1.m", "0", "0"]
    assert got["Xb2.Xi2.Mp"]["nets"] == ["n3", "Xb2.m", "Xb2.sup", "Xb2.sup"] and got["Xb2.Rl"]["params"] == {"value": 2000.0}
    assert got["Xu"]["type"] == "subckt" and got["Xb1.Xi1.Mn"]["params"] == {"w": pytest.approx(1e-6), "l": pytest.approx(180e-9)}


def test_spectre_is_read(spark, tmp_path):
    got = flat(spark, tmp_path, SPECTRE, "n.scs")
    assert sorted(got) == ["b1.R1", "b1.i1.Mn", "b1.i1.Mp", "b1.i2.Mn", "b1.i2.Mp", "c1"]
    assert got["b1.i1.Mp"]["nets"] == ["b1.m", "n1", "b1.s", "b1.s"] and got["b1.i1.Mp"]["type"] == "mosfet" and got["b1.i1.Mp"]["params"]["w"] == pytest.approx(2e-6)
    assert got["b1.R1"]["params"]["value"] == 2000.0 and got["c1"]["type"] == "capacitor" and got["b1.i2.Mn"]["params"]["l"] == pytest.approx(180e-9)


def test_broken_hierarchies_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="holds itself"):
        flat(spark, tmp_path, ".subckt a p\nXb p b\n.ends\n.subckt b p\nXa p a\n.ends\nX1 n a\n")
    with pytest.raises(ValueError, match="1 nets for 2 ports"):
        flat(spark, tmp_path, ".subckt a p q\nR1 p q 1\n.ends\nX1 n a\n")
    with pytest.raises(ValueError, match="more than once"):
        flat(spark, tmp_path, ".subckt a p\nR1 p 0 1\n.ends\n.subckt A p\nR1 p 0 1\n.ends\nX1 n a\n")
