"""Text sources: a file in many byte ranges gives the rows of a file in one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.sources import formats, lines, runs


@pytest.fixture
def cut(spark):
    """Reads with ranges of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def put(size):
        for k in keys:
            spark.conf.set(k, str(size))

    yield put
    for k, v in before.items():
        spark.conf.set(k, v)


def in_ranges(cut, read):
    """The rows read in one range and in many."""
    cut(1 << 27)
    one = read()
    cut(300)
    many = read()
    return sorted(map(tuple, one.collect()), key=str), sorted(map(tuple, many.collect()), key=str)


def test_csv_in_ranges(spark, tmp_path, cut):
    rng = np.random.default_rng(1)
    rows = [(float(i), *rng.standard_normal(3)) for i in range(400)]
    text = 'time, "a" ,b,b\r\n' + "".join(("\r\n" if i % 50 == 7 else "") + ",".join(map(repr, map(float, r))) + "\r\n" for i, r in enumerate(rows))
    (tmp_path / "long run.csv").write_bytes(text.encode())
    (tmp_path / "b+1.csv").write_text("t,x\n" + "".join(f"{i},{i * i}\n" for i in range(200)))
    one, many = in_ranges(cut, lambda: runs.read_wave_csv(spark, f"{tmp_path}/*.csv"))
    want = [("long run", n, i, r[0], r[k + 1]) for i, r in enumerate(rows) for k, n in enumerate(("a", "b", "b.1"))] + [("b+1", "x", i, float(i), float(i * i)) for i in range(200)]
    assert many == one == sorted(want, key=str)
    cut(300)
    assert lines.read_lines(spark, f"{tmp_path}/*.csv").select("split").distinct().count() > 50
    table = runs.read_table_csv(spark, f"{tmp_path}/b*.csv", span=1.0).filter("signal = 'x'").orderBy("idx").collect()
    assert [r["t"] for r in table] == pytest.approx(np.linspace(0, 1, 200)) and [r["value"] for r in table] == [i * i for i in range(200)]


def test_cells_that_are_no_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,x\n0,nan\n1,bad\n2,1.5d\n3, inf \n4,-2e-3\n5\n6,\n7,1_0\n")
    got = {r["idx"]: r["value"] for r in runs.read_wave_csv(spark, f"{tmp_path}/a.csv").collect()}
    assert got == {0: None, 1: None, 2: None, 3: float("inf"), 4: -2e-3, 5: None, 6: None, 7: None}


def test_dumps_in_ranges(spark, tmp_path, cut):
    rng = np.random.default_rng(2)
    body, want, now = [], [], 0
    for _ in range(300):
        now += int(rng.integers(1, 5))
        body.append(f"#{now}")
        for code, names, bits in (("!", ("clk",), 1), ("#", ("bus", "alias"), 4), ("%", ("wide",), 70)):
            if rng.random() < 0.6:
                v = int(rng.integers(0, 2**bits if bits < 60 else 2**60))
                text = "x" * bits if rng.random() < 0.1 else f"{v:0{bits}b}"
                body.append(f"{text}{code}" if bits == 1 else f"b{text} {code}")
                want += [("a.vcd", n, now * 1e-8, None if "x" in text else float(v)) for n in names]
        if rng.random() < 0.5:
            body.append(f"r{now / 8} $r")
            want.append(("a.vcd", "real", now * 1e-8, now / 8))
    head = "$date now $end\n$timescale\n  10 ns\n$end\n$scope module top $end\n$var wire 1 ! clk $end\n$var wire 4 # bus [3:0] $end\n$var wire 4 # alias $end\n$var wire 70 % wide $end\n$var real 64 $r real $end\n$upscope $end\n$enddefinitions $end\n$dumpvars\n0!\n$end\n"
    (tmp_path / "a.vcd").write_text(head + "\n".join(body) + "\n")
    want.append(("a.vcd", "clk", 0.0, 0.0))
    one, many = in_ranges(cut, lambda: formats.read_vcd(spark, f"{tmp_path}/a.vcd"))
    key = lambda r: (r[1], round(r[2] * 1e8), str(r[3]))
    assert one == many
    for got, w in zip(sorted(many, key=key), sorted(want, key=key), strict=True):
        assert got[:2] == w[:2] and got[2] == pytest.approx(w[2]) and got[3] == (w[3] if w[3] is None else pytest.approx(w[3]))
    (tmp_path / "none.vcd").write_text("$var wire 1 ! clk $end\n$enddefinitions $end\n")
    with pytest.raises(Exception, match="no value changes"):
        formats.read_vcd(spark, f"{tmp_path}/none.vcd").collect()


def test_points_in_ranges(spark, tmp_path, cut):
    """Points of one line and of several, some with a value missing, are cut anywhere."""
    names = ["time", "v(a)", "i(b)"]
    text, want = "Title: t\nVariables:\n" + "".join(f"\t{k}\t{n}\tkind{k}\n" for k, n in enumerate(names)) + "Values:\n", []
    for i in range(300):
        values = [i * 1.0, i * 2.0, i * 3.0][: 2 if i % 40 == 13 else 3]
        text += f" \n{i}\t{values[0]}\n" + "".join(f"\t{v}\n" for v in values[1:])
        if len(values) == 3:
            want += [("p.raw", len(want) // 3, n, f"kind{k}", values[k]) for k, n in enumerate(names)]
    (tmp_path / "p.raw").write_text(text)
    one, many = in_ranges(cut, lambda: formats.read_nutmeg(spark, f"{tmp_path}/p.raw"))
    assert one == many == sorted(want, key=str)


@pytest.mark.parametrize("name", ["csv_round_trip", "vcd_round_trip", "raw_round_trip"])
def test_round_trips_in_ranges(spark, sf_dir, cut, name):
    from oracle import connect, rows

    from sievemill.plans import source_queries as s

    cut(2000)
    assert rows(s.QUERIES[name](spark, sf_dir).toPandas()) == rows(connect(sf_dir).execute(s.ORACLES[name]).df())


def test_many_runs_in_several_files(spark, tmp_path, cut):
    """Runs lie whole in few files, whatever their number; headers stand first, and nothing is lost in ranges."""
    rows = [(r, i, i * 0.5 + r, float(r * i), "ab"[i % 2]) for r in range(40) for i in range(1 + r % 9)]
    df = spark.createDataFrame(rows, "run_key long, idx int, t double, value double, state string").repartition(7)
    csv, raw, vcd = (str(tmp_path / k) for k in ("csv", "raw", "vcd"))
    lines.write_csv_runs(df, csv, each=60)
    lines.write_points(df, raw, each=60)
    lines.write_changes(df.select("run_key", (F.col("t") * 2).cast("long").alias("now"), F.col("state").alias("signal"), "value"), vcd, "s", each=60)
    for path, head in ((csv, "time,value,run"), (raw, "Title:"), (vcd, "$timescale")):
        files = list((tmp_path / path).glob("*/part-*"))
        assert 1 < len(files) <= 4 and all(f.read_text().startswith(head) for f in files)
    cut(300)
    one = runs.read_wave_csv(spark, f"{csv}/*/*", key="run")
    assert sorted(map(tuple, one.collect())) == sorted((str(r), "value", i, t, v) for r, i, t, v, _ in rows)
    table = runs.read_table_csv(spark, f"{csv}/*/*", time="seconds", span=1.0, key="run").filter("signal = 'value'")
    assert sorted((r["run_id"], r["idx"], round(r["t"], 9)) for r in table.collect()) == sorted((str(r), i, round(i / max(r % 9, 1), 9)) for r, i, *_ in rows)
    points = lines.read_points(spark, f"{raw}/*/*", titles=True).select("title", "idx", "name", "value")
    assert sorted(map(tuple, points.collect())) == sorted((str(r), i, n, x) for r, i, t, v, _ in rows for n, x in (("time", t), ("v(out)", v)))
    changes = lines.read_changes(spark, f"{vcd}/*/*", scopes=True).select("scope", "signal", "t", "value")
    assert sorted(map(tuple, changes.collect())) == sorted((str(r), s, float(int(t * 2)), v) for r, _, t, v, s in rows)


def test_runs_that_do_not_stand_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,x,run\n0,1,a\n1,2,b\n2,3,a\n")
    with pytest.raises(Exception, match="do not stand together"):
        runs.read_wave_csv(spark, f"{tmp_path}/a.csv", key="run").collect()
