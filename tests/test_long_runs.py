"""Operators that cut runs into pieces: they equal the kernels over whole runs, and a long run is many tasks' work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.functions.session import numbered_in
from sievemill.operators import cuts, kernels, lagged, responses, smoothing, spectra

SAMPLES = "run_key string, idx int, value double"


def runs_of(spark, series, schema=SAMPLES):
    return spark.createDataFrame([(k, i, *(v if isinstance(v, tuple) else (v,))) for k, vs in series.items() for i, v in enumerate(vs)], schema)


def by_run(df, *columns):
    pdf = df.toPandas().sort_values(["run_key", "idx"])
    return {k: tuple(g[c].to_numpy(dtype=float) for c in columns) for k, g in pdf.groupby("run_key")}


def holed(n, seed):
    rng = np.random.default_rng(seed)
    y = np.cumsum(rng.standard_normal(n))
    out = [float(v) for v in y]
    for i in rng.integers(0, n, n // 10):
        out[i] = None if i % 2 else float("nan")
    return out


def test_smoothing_equals_the_kernel(spark):
    series = {f"n{n}": holed(n, n) for n in (5, 7, 12, 64, 65, 200, 2000, 9000)} | {"one": [3.0], "two": [1.0, 4.0], "three": [1.0, 5.0, 2.0], "four": [1.0, 2.0, 0.0, 7.0]}
    for window in (None, 11):
        got = by_run(smoothing.smooth(runs_of(spark, series), window), "smooth", "slope")
        for k, v in series.items():
            y = np.array([np.nan if x is None else x for x in v])
            w = window or kernels.smoothing_window(len(y))
            for g, want in zip(got[k], (kernels.savgol(y, w), kernels.savgol(y, w, derivative=1))):
                assert np.allclose(g, want, atol=1e-7), (k, window)
    nothing = smoothing.smooth(runs_of(spark, {"none": [None] * 9})).collect()
    assert len(nothing) == 9 and all(r["smooth"] is None for r in nothing)


def test_filling_crosses_pieces(spark):
    v = [None, None, 2.0, *[None] * 20, 8.0, float("nan"), None]
    got = by_run(cuts.filled(runs_of(spark, {"a": v, "b": [None] * 3}), "run_key", size=4), "value")
    y = np.array([np.nan if x is None else x for x in v])
    assert np.allclose(got["a"][0], np.interp(np.arange(len(y)), np.flatnonzero(np.isfinite(y)), y[np.isfinite(y)])) and np.isnan(got["b"][0]).all()


def test_halo(spark):
    rows = cuts.with_halo(runs_of(spark, {"a": [0.0] * 10}), 2, 1, size=4).filter("not own").select("idx", "piece").collect()
    assert sorted(map(tuple, rows)) == [(2, 1), (3, 1), (4, 0), (6, 2), (7, 2), (8, 1)]


def test_spectra_equal_the_kernel(spark):
    rng = np.random.default_rng(4)
    series = {}
    for n in (64, 65, 255, 256, 1000, 5000):
        x = rng.standard_normal(n)
        series[f"n{n}"] = [(0.1, float(a), float(b)) for a, b in zip(x, np.convolve(x, [0.5, 0.3, 0.2])[:n] + 3)]
    series["few"] = [(0.1, 1.0, 1.0)] * 63
    got = spectra.transfer(runs_of(spark, series, "run_key string, idx int, dt double, x double, y double")).toPandas()
    assert set(got["run_key"]) == set(series) - {"few"}
    for k, g in got.groupby("run_key"):
        _, x, y = np.array(series[k]).T
        f, z = kernels.spectrum(x, y, 10.0)
        g = g.sort_values("freq")
        assert np.allclose(g["freq"], f) and np.allclose(g["re"] + 1j * g["im"], z) and np.allclose(g["gain"], np.abs(z))


def driven(n=600, seed=0):
    rng = np.random.default_rng(seed)
    u, y = rng.normal(size=n), np.zeros(n)
    for i in range(3, n):
        y[i] = 1.2 * y[i - 1] - 0.7 * y[i - 2] + 0.1 * y[i - 3] + 0.2 * u[i] + 0.1 * u[i - 1]
    return u, y + 0.01 * rng.normal(size=n)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_coefficients_are_least_squares(spark, order):
    u, y = driven(9000)
    df = runs_of(spark, {"a": [(1.0, float(a), float(b)) for a, b in zip(u, y)], "few": [(1.0, 1.0, 1.0)] * 3}, "network string, idx int, dt double, u double, y double")
    got = {r["name"]: r["value"] for r in lagged.coefficients(df, order).filter("network = 'a'").collect()}
    past = np.column_stack([*(y[order - k : len(y) - k] for k in range(1, order + 1)), *(u[order - k : len(y) - k] for k in range(order + 1))])
    assert np.allclose(list(got.values()), np.linalg.lstsq(past, y[order:], rcond=None)[0], atol=1e-8)
    assert lagged.coefficients(df, 2).filter("network = 'few'").first()["error"] == "too few samples"


def test_missing_samples_are_left_out(spark):
    u, y = driven(500)
    rows = [(1.0, float(a), None if i % 50 == 9 else float(b)) for i, (a, b) in enumerate(zip(u, y))]
    got = [r["value"] for r in lagged.coefficients(runs_of(spark, {"a": rows}, "network string, idx int, dt double, u double, y double"), 1).collect()]
    keep = [i for i in range(1, 500) if i % 50 != 9 and (i - 1) % 50 != 9]
    past = np.column_stack([y[np.array(keep) - 1], u[keep], u[np.array(keep) - 1]])
    assert np.allclose(got, np.linalg.lstsq(past, y[keep], rcond=None)[0])


POLES = np.array([-0.5 + 6j, -0.5 - 6j, -3])


def test_poles_by_sums(spark):
    dt, n = 0.02, 400
    t = np.arange(n) * dt
    y = 2 * np.exp(-0.5 * t) * np.cos(6 * t) + 1.5 * np.exp(-3 * t)
    rng = np.random.default_rng(0)
    u, driven_y, a = rng.normal(size=n), np.zeros(n), np.poly(np.exp(POLES * dt)).real
    for i in range(3, n):
        driven_y[i] = -a[1:] @ driven_y[i - 3 : i][::-1] + 0.2 * u[i] + 0.1 * u[i - 1]
    df = runs_of(spark, {"free": [(dt, 0.0, float(v)) for v in y], "driven": [(dt, float(a), float(b)) for a, b in zip(u, driven_y)]}, "network string, idx int, dt double, u double, y double")
    for method, name in (("prony", "free"), ("era", "free"), ("arx", "driven")):
        found = np.array([complex(r["re"], r["im"]) for r in kernels.identify(df.filter(F.col("network") == name), method, 3).collect()])
        assert len(found) == 3 and max(min(abs(found - p)) / abs(p) for p in POLES) < 1e-4, method
    by_knee = lagged.identify(df.filter("network = 'free'"), "era", 0, knee=1e-5).collect()
    assert len(by_knee) == 3
    with pytest.raises(ValueError):
        lagged.identify(df, "magic", 3)


def test_numbers_within_keys(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(v)) for k, v in zip(rng.choice([0, 0, 0, 1, 2, 3], 3000), rng.permutation(3000))]
    got = numbered_in(spark.createDataFrame(rows, "k int, v int").repartition(7), "k", "idx", "v").collect()
    want = {}
    for k, v in sorted(rows):
        want.setdefault(k, []).append(v)
    assert {(r["k"], r["v"]): r["idx"] for r in got} == {(k, v): i for k, vs in want.items() for i, v in enumerate(vs)}


def test_a_long_run_is_many_tasks(spark):
    """One run of 400,000 samples: every exchange behind the cuts has rows in each of its partitions."""
    df = spark.range(400_000).selectExpr("'a' AS run_key", "cast(id as int) AS idx", "1.0 AS dt", "sin(id) AS x", "cos(id) AS y", "sin(id) AS value")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows, keys in ((cuts.with_halo(df, 5), ["run_key", "piece"]), (df.withColumn("block", F.floor(F.col("idx") / 64)), ["run_key", "block"])):
        assert rows.repartition(n, *keys).select(F.spark_partition_id().alias("p")).distinct().count() == n


# Three cases with their bounds: a smooth pair, a resonance, and five poles with noise.
CASES = {
    "pair": ([-2e3, -4e4], [1e3, 2e4], 0.0, 1e-6),
    "resonance": ([-1e3 + 9e3j, -1e3 - 9e3j, -4e4], [2e3 + 1e3j, 2e3 - 1e3j, 3e4], 0.0, 1e-4),
    "noise": ([-500 + 2e4j, -500 - 2e4j, -3e3 + 8e4j, -3e3 - 8e4j, -1e3], [4e3, 4e3, 2e3 + 5e3j, 2e3 - 5e3j, 1e3], 1e-5, 1e-3),
}


def test_responses_are_fitted(spark):
    """Within the bounds for each, whatever the partitions; one network has a third of all rows and more."""
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    for name, (poles, residues, noise, _) in CASES.items():
        w = np.geomspace(1e2, 1e6, 4000 if name == "pair" else 400)
        h = sum(r / (1j * w - p) for p, r in zip(poles, residues)) + 0.1
        h = h * (1 + noise * (rng.normal(size=len(w)) + 1j * rng.normal(size=len(w))))
        truth[name] = (w, h)
        rows += [(name, float(a), float(b.real), float(b.imag)) for a, b in zip(w, h)]
    df = spark.createDataFrame([*rows, ("few", 1.0, 1.0, 0.0), ("pair", 2.0, None, 0.0)], "network string, w double, re double, im double").repartition(5)
    for name, (poles, _, _, bound) in CASES.items():
        model = responses.fit_responses(df.filter(F.col("network").isin(name, "few")), len(poles)).collect()
        found = np.array([complex(r["re"], r["im"]) for r in model])
        w, h = truth[name]
        fit = sum(complex(r["residue_re"], r["residue_im"]) / (1j * w - p) for r, p in zip(model, found)) + model[0]["constant"]
        assert {r["network"] for r in model} == {name} and np.abs(fit - h).max() / np.abs(h).max() < bound
        assert max(min(abs(found - p)) / abs(p) for p in poles) < 100 * bound
        errors = responses.response_errors(df.na.drop(), spark.createDataFrame(model)).first()
        assert errors["worst"] == pytest.approx(np.abs(fit - h).max() / np.abs(h).max(), rel=1e-3, abs=1e-12) and errors["n"] == len(w)


def test_fitted_spectra_equal_the_kernel(spark, sf_dir):
    from sievemill.plans import kernel_queries as q

    got = q.fitted_spectra(spark, sf_dir).toPandas()
    x = q.averaged_spectra(spark, sf_dir).toPandas()
    assert set(got["network"]) == set(x["run_key"].astype(str)) and (got["n"] == 128).all() and (got["rms"] < got["worst"]).all()
    lines = q.lines(spark, sf_dir).toPandas().sort_values(["run_key", "idx"])
    same = 0
    for k, g in lines.groupby("run_key"):
        f, h = kernels.spectrum(g["x"].to_numpy(), g["y"].to_numpy(), 1.0)
        poles, _, const = kernels.vector_fit(2j * np.pi * f[1:], h[1:], 2, 8)
        own = got[got["network"] == str(k)]
        same += np.allclose(np.sort_complex(own["re"] + 1j * own["im"]), np.sort_complex(poles), rtol=1e-3) and abs(own["constant"].iloc[0] - const) < 1e-3 * abs(const)
    assert same >= 0.9 * lines["run_key"].nunique()  # eight rounds on noise may part from tiny differences


def test_medians_hold_no_group(spark):
    """Exact medians of skewed groups, with many equal values, and where the bracket misses the middle."""
    from sievemill.operators import insights

    rng = np.random.default_rng(5)
    groups = {"a": rng.standard_normal(20001), "b": rng.integers(0, 4, 5000) * 1.0, "c": np.array([3.0]), "d": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("e", None)], "g string, value double")
    want = {g: (float(np.median(v)), len(v)) for g, v in groups.items()}
    assert {r["g"]: (r["median"], r["n"]) for r in insights.medians(df, ["g"]).collect()} == want
    ends = spark.createDataFrame([("a", 20001, 5.0, 6.0)], "g string, n long, _lo double, _hi double")
    assert insights._middles(df, ends, ["g"]).first()["median"] is None


def test_column_kinds_do_not_shuffle_by_signal(spark):
    """The ranges, a row a signal, go to the rows: a shuffle by signal gives a task all rows of one."""
    from sievemill.operators import machines

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        wide = spark.range(400).selectExpr("id % 4 AS run_key", "CAST(id AS INT) AS idx", "CAST(id AS DOUBLE) AS t", "id % 2 * 1.0D AS a", "CAST(id AS DOUBLE) AS b")
        made = machines.column_kinds(wide, ["a", "b"])
        assert {r["signal"]: r["digital"] for r in made.collect()} == {"a": True, "b": False}
        assert "SortMergeJoin [signal" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


def test_short_runs_are_smoothed_in_one_shuffle(spark):
    """Runs that fit an array are shuffled once; with longer ones among them the rows are the same."""
    series = {f"n{n}": holed(n, n) for n in (1, 2, 3, 9, 130, 700)} | {"none": [None] * 9}
    rows = runs_of(spark, series)
    made = smoothing.smooth(rows)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    found, both = by_run(made, "smooth", "slope"), by_run(smoothing.smooth(rows, most=100), "smooth", "slope")
    assert set(found) == set(both) == set(series)
    assert all(np.allclose(a, b, atol=1e-7, equal_nan=True) for k in series for a, b in zip(found[k], both[k]))
    assert cuts.by_length(rows, "run_key", 700)[1] is None and cuts.by_length(rows, "run_key", 699)[1].count() == 700


def test_runs_across_batches(spark):
    """Runs are whole however rows are dealt to batches."""
    import pandas as pd

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        rows = runs_of(spark, {f"r{n}": [float(i) for i in range(n)] for n in range(1, 40)}).repartition(3)
        sizes = lambda pdf, ends: pd.DataFrame({"n": np.diff(ends), "x": [pdf["value"].iloc[a:b].sum() for a, b in zip(ends, ends[1:])]})
        got = cuts.run_by_run(rows, "run_key", "idx", sizes, "n long, x double").collect()
        assert sorted(map(tuple, got)) == [(n, n * (n - 1) / 2) for n in range(1, 40)]
    finally:
        spark.conf.set(key, before)


def test_short_runs_are_transformed_and_fitted_in_one_shuffle(spark):
    """Runs and networks that fit an array are shuffled once; those cut and fitted by passes give the same."""
    rng = np.random.default_rng(6)
    series = {f"n{n}": [(0.5, float(a), float(b)) for a, b in rng.standard_normal((n, 2))] for n in (63, 64, 255, 600, 900)}
    rows = runs_of(spark, series, "run_key string, idx int, dt double, x double, y double")
    made = spectra.transfer(rows)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    a, b = (t.toPandas().sort_values(["run_key", "freq"]).reset_index(drop=True) for t in (made, spectra.transfer(rows, most=300)))
    assert (a[["run_key", "segments"]] == b[["run_key", "segments"]]).all().all() and np.allclose(a.drop(columns="run_key"), b.drop(columns="run_key")) and len(a) == 33 + 128 + 2 * 129
    s = np.geomspace(1, 1e3, 90) * 1j
    h = {f"p{p}": 3 / (s + p) + 2 / (s + 7 * p) + 0.5 for p in (5, 20, 60)}
    rows = spark.createDataFrame([(k, float(w.imag), float(z.real), float(z.imag)) for k, v in h.items() for w, z in zip(s[: 90 if k == "p5" else 70], v)], "network string, w double, re double, im double")
    made = responses.fit_responses(rows, 2)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    a, b = (t.toPandas().sort_values(["network", "k"]).reset_index(drop=True) for t in (made, responses.fit_responses(rows, 2, most=80)))
    assert list(a["network"]) == list(b["network"]) and len(a) == 6 and np.allclose(a.drop(columns="network"), b.drop(columns="network"))
    assert np.allclose(sorted(a["re"]), [-420, -140, -60, -35, -20, -5], rtol=1e-6)
