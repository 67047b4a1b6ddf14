"""Naming, masking, predicates, report texts and the remaining kernels."""

import json

import numpy as np
from pyspark.sql import functions as F

from sievemill.operators import kernels as k
from sievemill.operators import machines as m
from sievemill.operators import states as st


def test_names_and_modes(spark):
    s = spark.createDataFrame([(0, 0, 0, 0), (1, 1, 0, 1), (2, 1, 0, 1), (3, 1, 1, 0), (4, 0, 0, 1), (5, 1, 0, 0)], "state_id int, enable int, fault int, ready int")
    assert [r["name"] for r in m.name_states(s).orderBy("state_id").collect()] == ["DISABLED", "REGULATION", "REGULATION_2", "FAULT", "DISABLED", "STARTUP"]
    names = m.named_states(spark.createDataFrame([(0,), (9,)], "state_id int"), m.name_states(s))
    assert sorted(r["name"] for r in names.collect()) == ["DISABLED", "STATE_9"]
    a, b = m.split_modes(spark.createDataFrame([("ON",), ("OFF",)], "state string"), spark.createDataFrame([("OFF", "ON"), ("ON", "OFF")], "src string, dst string"), "ON", ["hi", "lo"])
    assert sorted(r["state"] for r in a.collect()) == ["OFF", "ON_hi", "ON_lo"] and b.count() == 4
    assert m.state_space_size(3, 2) == 6


def test_predicates(spark):
    req, off = spark.createDataFrame([("I2C",), ("SPI-4",)], "standard string"), spark.createDataFrame([("i2c v3",)], "interface string")
    assert [r[0] for r in m.unmet_interfaces(req, off).collect()] == ["SPI-4"]
    rows = spark.createDataFrame([("DISABLED", 5.0), ("RUN", 0.0), (None, 0.01), (None, 9.0)], "state string, value double")
    assert [r[0] for r in rows.select(m.active(F.col("state"), F.col("value"), F.lit(10.0), ["disabled", "off"])).collect()] == [False, True, False, True]
    runs = spark.createDataFrame([("r", "TT"), ("r", "FF"), ("q", "TT")], "run string, corner string")
    seq = spark.createDataFrame([("r@TT", 1), ("r", 2)], "key string, sequence int")
    assert {(r["run"], r["corner"]): r["sequence"] for r in m.with_fallback_key(runs, seq).collect()} == {("r", "TT"): 1, ("r", "FF"): 2, ("q", "TT"): None}
    guard = spark.sql("SELECT map('a', 0, 'b', 1, 'c', 1) AS before, map('a', 1, 'b', 1, 'c', 0) AS after").select(st.changed_bits_guard()).first()[0]
    assert guard == "a == 1 && c == 0"
    assert spark.range(1).select(m.token_overlap(F.lit("a*x + b"), F.lit("b - A"))).first()[0] == 2 / 3
    nodes = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 7.0)], "node string, area double, power double")
    t = m.graph_totals(nodes, nodes).first()
    assert (t["blocks"], t["area"], t["hungriest"], t["links"]) == (2, 3.0, "b", 2)


def test_digital_columns(spark):
    rows = [(1, i, float(i), float(i % 8 > 3), float(i), float(i % 6 > 2)) for i in range(48)]
    wide = spark.createDataFrame(rows, "run_key int, idx int, t double, en double, ramp double, pg double")
    assert m.digital_columns(wide, ["en", "ramp", "pg"], ["en", "ramp"], ["pg"]) == ["en"]
    assert m.digital_columns(wide, ["en", "ramp", "pg"], [], ["pg"]) == ["en"]
    assert spark.createDataFrame([(1, 0)], "a int, b int").select(m.logic_pattern(["a", "b"])).first()[0] == "10"


def test_reports(spark):
    f = spark.createDataFrame([("low", "z", None), ("critical", "a", "fix")], "severity string, summary string, action string")
    lines = m.finding_lines(m.ordered_findings(f, "summary")).collect()
    assert [r["markdown"] for r in lines] == ["- **CRITICAL** a (fix)", "- **LOW** z"] and json.loads(lines[0]["json"])["action"] == "fix"
    cases = spark.createDataFrame([("a<b", "i", "FAIL", 'x "y"'), ("c", "j", "PASS", None)], "checker string, item string, status string, message string")
    assert [r[0] for r in m.junit_cases(cases).collect()] == ['<testcase classname="a&lt;b" name="i"><failure message="x &quot;y&quot;"/></testcase>', '<testcase classname="c" name="j"/>']


def test_kernels(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=4096)
    f, h = k.spectrum(x, np.convolve(x, [0.5, 0.5])[: len(x)], 1.0)
    assert np.allclose(np.abs(h[1:100]), np.abs(np.cos(np.pi * f[1:100])), atol=0.05)
    p = rng.random((60, 2))
    s = k.RadialSurrogate(p, np.sin(3 * p[:, 0]) + p[:, 1])
    q = rng.random((30, 2)) * 0.8 + 0.1
    assert np.abs(s.predict(q) - np.sin(3 * q[:, 0]) - q[:, 1]).max() < 0.05
    sens = k.pole_sensitivity({"r": 1.0, "l": 1e-3, "c": 1e-6}, k.series_rlc_poles)
    assert np.allclose(sens["r"].real, -1 / (2 * 1e-3), rtol=1e-3)
    rows = k.sweep(spark, ["prony", "era", "none"], [0.0], 2).collect()
    assert all(r["pole_error"] < 1e-4 for r in rows if r["method"] != "none") and all("unsupported" in r["error"] for r in rows if r["method"] == "none")
