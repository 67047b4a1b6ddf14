"""Sources, sinks, scalar functions, generators and streams on small hand-made inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.functions import scalar as fn
from sievemill.operators import coverage as cov
from sievemill.operators import sequence as q
from sievemill.operators import states as st
from sievemill.sources import formats, generators, runs
from sievemill.streaming import events as stream


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_csv_runs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,vout,iload$flow\n0,1,2\n1e-6,1.5,\n2e-6,bad,4\n")
    (tmp_path / "b.csv").write_text("t, vin\n0,9\n")
    s = runs.read_wave_csv(spark, f"{tmp_path}/*.csv")
    rows = {(r["run_id"], r["signal"], r["idx"]): r["value"] for r in s.collect()}
    assert rows[("a", "vout", 1)] == 1.5 and rows[("a", "vout", 2)] is None and rows[("a", "iload$flow", 1)] is None and rows[("b", "vin", 0)] == 9 and len(rows) == 7
    (tmp_path / "bad.csv").write_text("t\n1\n")
    with pytest.raises(Exception, match="time column"):
        runs.read_wave_csv(spark, f"{tmp_path}/bad.csv").collect()
    with pytest.raises(Exception):
        runs.read_wave_csv(spark, f"{tmp_path}/none*.csv").collect()


def test_container(spark, tmp_path):
    rows = [(r, c, sig, i, i * 1e-6, float(i // 2)) for r in ("r1", "r2") for c in ("TT", "FF") for sig in ("v", "i$flow") for i in range(6)]
    s = spark.createDataFrame(rows, "run_id string, corner_id string, signal string, idx int, t double, value double")
    path = str(tmp_path / "box")
    runs.write_runs(s, path)
    with pytest.raises(Exception, match="already exists"):
        runs.write_runs(s, path)
    with pytest.raises(ValueError, match="exist already"):
        runs.append_runs(s.limit(1), path)
    runs.append_runs(s.filter("run_id = 'r1'").withColumn("run_id", F.lit("r3")), path)
    box = runs.read_runs(spark, path)
    assert box.count() == 72
    assert runs.select_runs(box, ["r3@TT", "r1@FF"]).count() == 24
    for wrong in ("r1", "r9", "r1@SS"):
        with pytest.raises(ValueError):
            runs.select_runs(box, [wrong])
    p = runs.profile(box).filter("run_id = 'r1' AND corner_id = 'TT'").first()
    assert (p["samples"], p["signals"], round(p["changed_pct"], 1)) == (12, 2, 50.0)
    wide = runs.run_matrix(box, ["v", "none"]).filter("run_id = 'r2' AND corner_id = 'TT' AND idx = 5").first()
    assert wide["v"] == 2.0 and wide["none"] is None
    assert {(r["base"], r["kind"]) for r in runs.signal_names(box).collect()} == {("v", "voltage"), ("i", "current")}
    plan = box.filter("run_id = 'r1' AND signal = 'v'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "EqualTo(signal,v)" in plan


def test_state_parameters(spark):
    rows = spark.createDataFrame([("TT", None, "r", 1.0), ("TT", "ON", "r", 1.5), ("TT", "OFF", "r", 1.0)], "corner string, state string, param string, value double")
    assert [tuple(r) for r in runs.state_parameters(rows).collect()] == [("TT", "ON", "r", 1.5, 0.5)]
    with pytest.raises(ValueError):
        runs.state_parameters(rows.filter("state IS NOT NULL"))


def test_vcd_and_raw(spark, tmp_path):
    (tmp_path / "a.vcd").write_text("$timescale 10 ns $end\n$var wire 1 ! clk $end\n$var wire 4 # bus $end\n$enddefinitions $end\n#0\n0!\nb0101 #\n#5\n1!\nbx1 #\n#7\nx!\n")
    got = [tuple(r)[1:] for r in formats.read_vcd(spark, f"{tmp_path}/a.vcd").collect()]
    assert got == [("clk", 0.0, 0.0), ("bus", 0.0, 5.0), ("clk", pytest.approx(5e-8), 1.0), ("bus", pytest.approx(5e-8), None), ("clk", pytest.approx(7e-8), None)]
    (tmp_path / "b.raw").write_text("Title: x\nVariables:\n\t0\ttime\ttime\n\t1\tv(out)\tvoltage\nValues:\n0\t0.0\n\t1.5\n1\t1e-6\n2\t2e-6\n\t2.5\n")
    got = [tuple(r)[1:] for r in formats.read_nutmeg(spark, f"{tmp_path}/b.raw").collect()]
    assert got == [(0, "time", "time", 0.0), (0, "v(out)", "voltage", 1.5), (1, "time", "time", 2e-6), (1, "v(out)", "voltage", 2.5)]


def test_netlist(spark, tmp_path):
    (tmp_path / "n.sp").write_text("* title\n.param wn=2u cl=1e-12\nM1 out in 0 0 nch W=wn\n+ L=180n\nR1 out vdd 10k\nC1 out 0 'cl'\nX1 a b amp gain=3\n.end\n")
    got = {r["component"]: r for r in formats.read_netlist(spark, f"{tmp_path}/n.sp").collect()}
    assert got["M1"]["nets"] == ["out", "in", "0", "0"] and got["M1"]["model"] == "nch" and got["M1"]["params"] == {"w": pytest.approx(2e-6), "l": pytest.approx(180e-9)}
    assert got["R1"]["params"] == {"value": 10000.0} and got["C1"]["params"] == {"value": 1e-12} and got["X1"]["type"] == "subckt"


def test_reports(spark, tmp_path):
    item = {"checker": "adc", "item": "snr", "status": "FAIL", "measured": "61.5"}
    (tmp_path / "a.json").write_text(json.dumps({"report": {"meta": {"ip": "x"}, "results": [item]}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"aggregate_report": {"all_results": [item, item | {"status": "PASS", "measured": "n/a"}]}}))
    (tmp_path / "c.json").write_text("{broken")
    got = formats.read_reports(spark, f"{tmp_path}/*.json").collect()
    assert sorted((r["status"], r["measured_value"]) for r in got if r["status"] == "FAIL") == [("FAIL", 61.5)] * 2 and len(got) == 3


def test_models_and_tables(spark, tmp_path):
    text = "project: p\nfeatures:\n- name: f\n  covergroups:\n  - name: g\n    coverpoints:\n    - {name: c, variable: v, bins: [{name: b0, values: [0]}, {name: b1, values: [1]}]}\nfeature_crosses:\n- {name: x, targets: [f.g, f.g.c], goal: 90}\n"
    model = formats.read_coverage_yaml(spark, text)
    flat = cov.flatten(model)
    assert cov.totals(flat).first().asDict() == {"features": 1, "groups": 1, "points": 1, "bins": 2}
    assert cov.cross_points(model.select(F.explode("crosses").alias("c")).select("c.name", "c.targets"), flat).first()["valid"]
    (tmp_path / "r.csv").write_text("register_name,field_name,bit_range,access\nA,x,[7:4],RO\nA,y,3,RW\n")
    assert [r["width"] for r in formats.read_registers(spark, f"{tmp_path}/r.csv").collect()] == [4, 1]
    (tmp_path / "d.csv").write_text("y_b,x_b,technology,x_a\n1,2,n7,3\n")
    assert formats.read_dataset(spark, f"{tmp_path}/d.csv").columns == ["technology", "x_a", "x_b", "y_b"]
    (tmp_path / "s.csv").write_text("chip_id,vdd,vout,note\nc1,1.1,1.2,ok\n")
    assert [tuple(r) for r in formats.read_silicon(spark, f"{tmp_path}/s.csv").collect()] == [("c1", "TT", 27.0, 1.1, "vout", 1.2)]


def test_scalar_functions(spark):
    assert value(spark, fn.si_number(F.lit("-1.5e-3u"))) == pytest.approx(-1.5e-9)
    assert value(spark, fn.format_corner(F.lit("SS"), F.lit(1.08), F.lit(-40.0))) == "SS_1p08V_N40C"
    c = value(spark, fn.parse_corner(F.lit("SS_1p08V_N40C")))
    assert (c["process"], c["voltage"], c["temperature"]) == ("SS", 1.08, -40.0)
    assert value(spark, fn.parse_meta(F.lit("a=1, b = x=y ,bad,a=2"))) == {"b": "x=y", "a": "2"}
    assert value(spark, fn.parse_signal(F.lit("v@r@c@d")))["name"] is None
    assert [tuple(r) for r in value(spark, fn.parse_ranges(F.lit("0x10:0b11, 7")))] == [(16, 3), (7, 7)]
    assert value(spark, fn.parse_transitions(F.lit("A=>B | C => D=>E"))) == [["A", "B"], ["C", "D", "E"]]
    assert value(spark, fn.pin_type(F.lit("AVDD_1"))) == "supply" and value(spark, fn.identifier(F.lit("1a-b"))) == "_1a_b"
    assert value(spark, fn.hamming(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3)))) == 1
    assert value(spark, fn.mean_pool(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), 2)) == [2.0, 3.0]
    with pytest.raises(Exception, match="32 bits"):
        value(spark, fn.quantize(F.lit(1e12), F.lit(1.0), F.lit(0.0)))
    pole = lambda re, im: F.struct(F.lit(re).alias("re"), F.lit(im).alias("im"))
    h = value(spark, fn.pole_residue(F.array(pole(-1.0, 2.0)), F.array(pole(3.0, 1.0)), F.lit(0.0), F.lit(1.0)))
    want = (3 + 1j) / (1j - (-1 + 2j))
    assert (h["re"], h["im"]) == (pytest.approx(want.real), pytest.approx(want.imag))
    assert value(spark, fn.is_passive(F.array(pole(-1.0, 0.0)), F.array(pole(1.0, 0.0)))) and not value(spark, fn.is_passive(F.array(pole(-1.0, 0.0)), F.array(pole(-1.0, 0.0))))
    assert value(spark, fn.lookup(F.from_json(F.lit('{"a":{"b":"7"}}'), "map<string,map<string,string>>"), ["a", "b"], F.lit("0"))) == "7"


@pytest.mark.parametrize("text", ["", "short", "x" * 45, "para one\n\n" * 9, "a\n\n" + "y" * 60])
def test_chunks_end_and_cover(spark, text):
    chunks = value(spark, fn.chunk_text(F.lit(text), 20, 4))
    assert all(0 < len(c) <= 20 for c in chunks) and (not text) == (not chunks)
    at = 0
    for c in chunks:
        k = text.find(c, max(0, at - 4))
        assert 0 <= k <= at
        at = k + len(c)
    assert at == len(text)


def test_hand_checked_sequences(spark):
    rows = [("r1", i, i * 1.0, s) for i, s in enumerate("AABBBA")] + [("r2", i, i * 1.0, s) for i, s in enumerate("BA")]
    s = spark.createDataFrame(rows, "run_key string, idx int, t double, state string")
    assert q.islands(s).groupBy("run_key").count().orderBy("run_key").collect()[0]["count"] == 3
    assert {(r["src"], r["dst"]): r["n"] for r in st.transitions(s).collect()} == {("A", "B"): 1, ("B", "A"): 2}
    ramp = spark.createDataFrame([("r", i, float(i), v) for i, v in enumerate([0.0, 0.4, 0.8, 1.2, 1.3])], "run_key string, idx int, t double, value double")
    assert [r["idx"] for r in q.change_points(ramp, 0.5).orderBy("idx").collect()] == [0, 2, 4]
    assert q.change_points(ramp, 0.0).count() == 5
    grid = spark.range(10).select(F.lit("r").alias("run_key"), F.col("id").cast("int").alias("idx"))
    held = spark.createDataFrame([("r", 0, 1.0), ("r", 5, 2.0), ("r", 9, 3.0)], "run_key string, idx int, value double")
    assert [r["value"] for r in q.decode_changes(grid, held).orderBy("idx").collect()] == [1.0] * 5 + [2.0] * 4 + [3.0]


def test_generators(spark):
    assert [r["value"] for r in generators.excitation(spark, "ramp", 5, 1.0).orderBy("idx").collect()] == [0, 0.25, 0.5, 0.75, 1.0]
    for kind in ("step", "impulse", "chirp", "multitone", "prbs"):
        assert generators.excitation(spark, kind, 64, 0.01).count() == 64
    x = np.array([r["a"] for r in generators.latin_hypercube(spark, {"a": (0.0, 10.0), "b": (1.0, 2.0)}, 20).collect()])
    assert sorted((x / 0.5).astype(int)) == list(range(20))
    assert generators.pvt_grid(spark, ["TT", "FF", "SS", "SF", "FS"], [1.0, 1.1, 1.2], [-40.0, 27.0, 125.0]).distinct().count() == 45
    assert generators.regulator_wave(spark, 100, 1e-6).filter("vout > 1.1").count() > 0


def run_stream(spark, df, source, schema, mode="append"):
    name = f"out_{abs(hash(source)) % 10**8}_{mode}_{len(df.columns)}"
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
        return spark.table(name).collect()
    finally:
        query.stop()


def test_streams(spark, tmp_path):
    rows = [("r1", f"2024-01-01 00:00:{i:02d}", float(v), "A") for i, v in enumerate([0, 0.4, 0.8, 1.2, 1.3])] + [("r2", "2024-01-01 00:05:00", 9.0, "B"), ("r2", "2024-01-01 01:00:00", 9.0, "B")]
    df = spark.createDataFrame(rows, "run_key string, ts string, value double, state string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    kept = run_stream(spark, stream.change_points(source(), 0.5), str(tmp_path) + "c", None)
    assert [r["value"] for r in kept if r["run_key"] == "r1"] == [0.0, 0.8] and len(kept) == 3
    stats = run_stream(spark, stream.windowed_stats(source(), "1 minute", "1 minute", "1 minute"), str(tmp_path) + "w", None, "complete")
    assert {(r["state"], r["n"]) for r in stats} == {("A", 5), ("B", 1)}
    found = run_stream(spark, stream.sessions(source(), "2 minutes", "1 minute"), str(tmp_path) + "s", None, "complete")
    assert sorted(r["n"] for r in found) == [1, 1, 5]
