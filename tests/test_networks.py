"""Networks with known poles, their responses, synthetic data and the coverage workbook."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.functions import scalar as fn
from sievemill.operators import graph as g
from sievemill.operators import networks as nw
from sievemill.operators import states as st
from sievemill.sources import formats, generators, runs


def test_poles_of_networks():
    for poles, poly in ((nw.series_poles(2.0, 0.5, 0.1), [0.5 * 0.1, 2.0 * 0.1, 1]), (nw.parallel_poles(2.0, 0.5, 0.1), [0.5 * 0.1, 0.5 / 2.0, 1])):
        assert np.allclose(np.sort_complex(poles), np.sort_complex(np.roots(poly)))
    one = np.linalg.eigvals(nw.ladder([(2.0, 0.5, 0.1)])[0])
    assert np.allclose(np.sort_complex(one), np.sort_complex(nw.series_poles(2.0, 0.5, 0.1)))
    a, b, c = nw.ladder([(1.0, 0.5, 0.2), (0.3, 0.1, 0.4)])
    assert np.isclose((c @ np.linalg.solve(-a, b)).item(), 1.0), "at rest the ladder hands on its input"
    near = nw.random_ladder(4, 3, near=True)
    assert all(0.96 < x[1] * x[2] / (y[1] * y[2]) < 1.04 for x, y in zip(near, near[1:])) and near == nw.random_ladder(4, 3, near=True)


def test_realizations():
    poles, residues = np.array([-1.0 + 0j, -4.0, -2 + 1j]), np.array([2.0, 3.0, 1.0])
    s = 0.7j
    assert np.isclose(sum(1 / (1 / r + s * c) * 0 + c / (s + 1 / (r * c)) for r, c in nw.foster(poles, residues)), 2 / (s + 1) + 3 / (s + 4))
    terms = nw.cauer([1.0, 3.0], [1.0, 4.0, 3.0 - 2.0])
    assert len(terms) == 2 and terms[0] == 1.0
    assert nw.cauer([0.0], [1.0, 2.0]) == []


def test_responses_agree():
    poles, residues = np.array([-0.5 + 3j, -0.5 - 3j, -2.0]), np.array([1 - 1j, 1 + 1j, 0.5])
    t = np.linspace(0, 4, 4001)
    h = nw.impulse_of(poles, residues, t)
    area = np.concatenate([[0], np.cumsum((h[1:] + h[:-1]) / 2 * np.diff(t))])
    assert np.allclose(nw.step_of(poles, residues, t), area, atol=1e-5)
    assert np.isclose(nw.response_of(poles, residues, np.array([0.0]))[0].real, nw.step_of(poles, residues, np.array([60.0]))[0])
    assert np.allclose(nw.step_of(np.array([0.0]), np.array([2.0]), t), 2 * t)
    for kind, at, seen in (("impulse", t, h), ("step", t, area), ("frequency", t, nw.response_of(poles, residues, t))):
        assert nw.cross_check(poles, residues, at, seen, kind) < 1e-4
    assert nw.cross_check(poles, residues, t, h + 0.1) > 0.01


def test_held_response_is_the_step_response():
    a, b, c = nw.ladder([(2.0, 0.5, 0.1)])
    poles = np.linalg.eigvals(a)
    t = np.arange(200) * 0.02
    assert np.allclose(nw.held(a, b, c, np.ones(200), 0.02), nw.step_of(poles, np.array([20 / (poles[0] - poles[1]), 20 / (poles[1] - poles[0])]), t), atol=1e-9)
    noisy = nw.held(a, b, c, np.ones(200), 0.02, snr_db=20)
    clean = nw.held(a, b, c, np.ones(200), 0.02)
    assert 0.05 < np.std(noisy - clean) / np.sqrt(np.mean(clean**2)) < 0.2


def test_sweep_by_excitation(spark):
    got = nw.sweep(spark, [(1.0, 0.5, 0.2)], ["prony", "arx", "vector_fit"], ["impulse", "step"], [None, 60.0]).collect()
    assert {(r["method"], r["excitation"]) for r in got} == {("prony", "impulse"), ("arx", "impulse"), ("arx", "step"), ("vector_fit", "frequency")} and len(got) == 8
    assert all(r["error"] is None and r["pole_error"] < 1e-3 for r in got if r["snr_db"] is None)


def test_fingerprints(spark):
    nodes = spark.createDataFrame([(1, n, t) for n, t in zip("abcdef", ["r", "r", "c", "x", "r", "c"])] + [(2, "z", "r")], "graph int, node string, type string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (1, "c", "d"), (1, "e", "f"), (1, "f", "e")], "graph int, a string, b string")
    one, two = sorted(nw.fingerprints(nodes, edges, ["r", "c", "other"]).collect())
    assert [round(one[c], 6) for c in ("type_r", "type_c", "type_other", "components", "diameter", "n_nodes", "n_edges")] == [0.5, round(1 / 3, 6), round(1 / 6, 6), round(2 / 6, 6), 0.1, 0.06, 0.025]
    assert np.isclose(one["cc_mean"], (1 + 1 + 1 / 3) / 6) and one["cc_max"] == 1 and one["degree_0"] == 0.5 and one["degree_1"] == 0.5
    assert (two["diameter"], two["components"], two["n_nodes"], two["degree_0"]) == (0, 1, 0.01, 1)


def test_layers_of_a_chain_with_cycles(spark):
    edges = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).union(spark.sql("SELECT 5L, 0L UNION ALL SELECT 20L, 3L"))
    got = g.layers(edges.coalesce(1), 0)
    assert got.agg(F.count(F.lit(1)), F.max("hops"), F.sum((F.col("node") == F.col("hops")).cast("int"))).first()[:] == (31, 30, 31)


def test_ambiguous_guards(spark):
    moves = spark.createDataFrame([("a", "b", "x"), ("a", "c", "x"), ("a", "c", "y"), ("b", "c", "x")], "src string, dst string, guard string")
    assert [tuple(r) for r in st.ambiguous_guards(moves).collect()] == [("a", "x", 2)]


@pytest.mark.parametrize("topology, figures", [("ota_5t", 8), ("ota_folded", 8), ("ldo", 8), ("current_mirror", 5)])
def test_circuit_datasets(spark, topology, figures):
    clean = generators.circuit_dataset(spark, topology, 400, noise=False).toPandas()
    noisy = generators.circuit_dataset(spark, topology, 400).toPandas()
    y = [c for c in clean if c.startswith("y_")]
    assert len(y) == figures and (clean[[c for c in clean if c[0] == "x"]] == noisy[[c for c in clean if c[0] == "x"]]).all().all()
    off = (noisy[y] / clean[y] - 1).to_numpy()
    assert np.isfinite(off).all() and 0.005 < np.abs(off).mean() < 0.05
    if topology == "ota_5t":
        r = clean.iloc[7]
        gm = np.sqrt(2 * 0.04 * 8.6e-3 / 4e-9 * r["x_w1"] / r["x_l1"] * 1e-6 * r["x_ibias"] * 1e-6 / 2)
        assert np.isclose(r["y_slew_v_us"], r["x_ibias"] * 1e-6 / (r["x_cc"] * 1e-15) / 1e6) and np.isclose(r["y_noise_nv"], np.sqrt(8 * 1.38e-23 * 300 / (3 * gm)) * 1e9)
        assert clean["y_phase_margin"].between(0, 90).all() and (clean["x_w1"] < 3.6).all()
    with pytest.raises(ValueError):
        generators.circuit_dataset(spark, "?", 1)


def test_waves(spark):
    amp = generators.amplifier_wave(spark, 300, 1e-8, slew=1e5).toPandas()
    assert np.abs(np.diff(amp["vout"])).max() <= 1e5 * 1e-8 * (1 + 1e-9) and amp["en"].sum() == 270
    fast = generators.amplifier_wave(spark, 300, 1e-8).toPandas()
    assert np.allclose(fast["vout"], fast["vdiff"])
    dc = generators.converter_wave(spark, 1000, 1e-8).toPandas()
    assert np.isclose((dc["vsw"] > 0).mean(), 0.36, atol=0.02) and dc["vout"].between(1.76, 1.84).all() and dc["pg"].sum() == 800
    assert generators.plain_wave(spark, 100, 1e-6).toPandas()["sig_a"].between(-1, 1).all()
    lhs = generators.latin_hypercube(spark, {"a": (0.0, 1.0), "b": (5.0, 7.0)}, 37, seed=3).toPandas()
    assert sorted((lhs["a"] * 37).astype(int)) == list(range(37)) == sorted(((lhs["b"] - 5) / 2 * 37).astype(int))


def test_tables_and_frequencies(spark, tmp_path):
    (tmp_path / "u.csv").write_text("vout,en\n1,0\n2,x\n3,1\n")
    got = {(r["signal"], r["idx"]): (r["t"], r["value"]) for r in runs.read_table_csv(spark, f"{tmp_path}/u.csv").collect()}
    assert got[("vout", 2)] == (1e-4, 3.0) and got[("en", 1)] == (5e-5, None)
    (tmp_path / "f.csv").write_text("freq,real,imag\n1,0.5,-0.5\n")
    assert [tuple(r) for r in runs.read_frequency_csv(spark, f"{tmp_path}/f.csv").collect()] == [(1.0, 0.5, -0.5)]
    with pytest.raises(ValueError, match="columns: freq, real, imag"):
        runs.read_frequency_csv(spark, f"{tmp_path}/f.csv", freq="w")
    runs.write_predictions(spark.createDataFrame([(1.0, 2.0, 2.5), (1.0, 0.0, 1.0)], "x double, y double, p double"), f"{tmp_path}/p", {"y": "p"})
    assert sorted(str(r["y_err_pct"]) for r in spark.read.option("header", True).csv(f"{tmp_path}/p").collect()) == ["25.0", "None"]
    keys = spark.createDataFrame([("a", "tt"), ("a", "ff")], "run_id string, corner_id string")
    assert runs.check_runs(keys) is keys
    with pytest.raises(ValueError, match="a@tt"):
        runs.check_runs(keys.union(keys.limit(1)))


def workbook(sheets):
    """A small xlsx file: shared strings, inline strings and numbers."""
    shared, parts = [], {}
    for i, (name, rows) in enumerate(sheets.items()):
        cells = ""
        for r, row in enumerate(rows):
            cells += f'<row r="{r + 1}">'
            for c, v in enumerate(row):
                at = f"{chr(65 + c)}{r + 1}"
                if isinstance(v, str) and c % 2:
                    cells += f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
                elif isinstance(v, str):
                    shared.append(v)
                    cells += f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'
                elif v is not None:
                    cells += f'<c r="{at}"><v>{v}</v></c>'
            cells += "</row>"
        parts[f"xl/worksheets/s{i}.xml"] = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" r:id="i{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="i{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{main}">' + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_diameters():
    """As by a search from every node; a large star, a line and many parts take few searches."""
    rng = np.random.default_rng(4)
    for n, m in ((2, 1), (12, 11), (30, 32), (60, 90), (80, 300)):
        for _ in range(20):
            near = [set() for _ in range(n)]
            for a, b in [(i, int(rng.integers(max(0, i - 3), i))) for i in range(1, n)] + rng.integers(0, n, (max(0, m - n), 2)).tolist():
                if a != b:
                    near[a].add(b), near[b].add(a)
            assert nw._diameter(near, range(n)) == max(max(nw._hops(near, x).values()) for x in range(n))
    ring = [{(i - 1) % 9, (i + 1) % 9} for i in range(9)]
    assert nw._diameter(ring, range(9)) == 4 and nw._diameter([set()], [0]) == 0


def test_fingerprints_of_large_graphs(spark):
    """A star of 30000 nodes beside 30000 single ones: a search from every node would take hours."""
    n = 30000
    nodes = spark.range(2 * n).select(F.lit("g").alias("graph"), F.col("id").alias("node"), F.lit("a").alias("type"))
    edges = spark.range(1, n).select(F.lit("g").alias("graph"), F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    r = nw.fingerprints(nodes, edges, ["a", "other"]).first()
    assert r["diameter"] == 2 / 20 and r["components"] == (n + 1) / (2 * n) and r["n_edges"] == (n - 1) / 200


def test_coverage_workbook(spark, tmp_path):
    sheets = {
        "Features": [["Feature_Name", "Tags"], ["f1", "a, b"], [None, None]],
        "CoverGroups": [["feature_name", "cg_name", "clock", "args", "goal"], ["f1", "g1", "clk", "int id, logic [7:0] addr", 90], ["f2", "g2", None, None, None]],
        "CoverPoints": [["feature_name", "cg_name", "cp_name", "variable"], ["f1", "g1", "p1", "v"], ["f1", "nowhere", "p2", "v"]],
        "Bins": [["feature_name", "cg_name", "cp_name", "bin_name", "type", "values", "ranges", "transitions", "min_hits"], ["f1", "g1", "p1", "b1", "values", "1, 2", None, None, None], ["f1", "g1", "p1", "b2", "Ranges", None, "0:3, 8:9", None, 2], ["f1", "g1", "p1", "b3", "transition", None, None, "A=>B | B=>C=>A", None]],
        "CG_Crosses": [["feature_name", "cg_name", "cross_name", "coverpoints"], ["f1", "g1", "x", "p1, p1"]],
        "Crosses": [["cross_name", "targets"], ["all", "f1.g1 | f2"]],
    }
    (tmp_path / "plan.xlsx").write_bytes(workbook(sheets))
    m = formats.read_coverage_workbook(spark, f"{tmp_path}/*.xlsx").first()
    assert m["project"] == "plan" and [f["name"] for f in m["features"]] == ["f1", "f2"] and m["features"][0]["tags"] == ["a", "b"]
    group = m["features"][0]["groups"][0]
    assert (group["clock"], group["goal"], [tuple(x) for x in group["args"]]) == ("clk", 90, [("int", "id"), ("logic [7:0]", "addr")])
    b1, b2, b3 = group["points"][0]["bins"]
    assert b1["values"] == ["1", "2"] and [tuple(r) for r in b2["ranges"]] == [("0", "3"), ("8", "9")] and b2["min_hits"] == 2 and b3["transitions"] == [["A", "B"], ["B", "C", "A"]]
    assert group["crosses"][0]["coverpoints"] == ["p1", "p1"] and m["crosses"][0]["targets"] == ["f1.g1", "f2"]
    text = "project: p\nfeatures:\n- name: f\n  covergroups:\n  - name: g\n    coverpoints:\n    - {name: c, variable: v, bins: [{name: r, type: range, ranges: [[0, 3]]}, {name: t, transitions: [[A, B]]}, {name: w, pattern: '1x'}, {name: a, auto_bin_max: 4}]}\n"
    bins = formats.read_coverage_yaml(spark, text).first()["features"][0]["groups"][0]["points"][0]["bins"]
    assert [b["type"] for b in bins] == ["range", "transition", "wildcard", "auto"] and tuple(bins[0]["ranges"][0]) == ("0", "3") and bins[3]["auto_bin_max"] == 4


def test_codes_of_technologies(spark):
    r = spark.range(1).select(fn.technology_code(F.lit("14nm")).alias("a"), fn.technology_code(F.lit(None).cast("string")).alias("b"), fn.log_size(F.lit(-1.0), F.lit(1.0)).alias("c")).first()
    assert r["a"][0] == 1 and r["a"][6] == 1 and r["b"][:3] == [0, 0, 1] and r["c"] == 0
