"""Feature tables and small models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.operators import features as f


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=800), rng.normal(size=800)
    rows = [(i, float(x), float(x * 2 + 1e-9), float(y), 1.0, float(3 + 2 * x - y), int(x > 0.3)) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "id long, a double, a2 double, b double, flat double, y double, hit int").cache()


def test_columns_and_selection(table):
    assert f.drop_flat_columns(table, ["a", "a2", "b", "flat"]) == ["a", "b"]
    mi = {r["feature"]: r["mi"] for r in f.mutual_information(table, ["a", "b", "flat"], "y").collect()}
    assert mi["a"] > mi["b"] > mi["flat"] >= 0
    assert f.select_features(table, ["a", "a2", "b"], ["y"], 2) in (["a", "b"], ["a2", "b"])
    assert f.select_features(table, ["a", "a2", "b"], ["y"], 1, forced=("b",)) == ["b"]


def test_encoding(spark):
    rows = spark.createDataFrame([("t", "10"), ("t", "2"), ("c", "FF"), ("c", "TT"), ("c", "1")], "key string, value string")
    got = {(r["key"], r["value"]): r["code"] for r in f.encode_meta(rows).collect()}
    assert got == {("t", "10"): 10.0, ("t", "2"): 2.0, ("c", "1"): 0.0, ("c", "FF"): 1.0, ("c", "TT"): 2.0}
    t = spark.createDataFrame([("x", 1.0, None), ("x", 3.0, 5.0), ("y", 5.0, 7.0)], "k string, u double, v double")
    z = {r["k"]: r["code"] for r in f.target_codes(t, "k", ["u", "v"]).collect()}
    s = np.std([1, 3, 5])
    assert z["x"] == pytest.approx(((1 - 3) / s + ((3 - 3) / s + (5 - 6) / 1) / 2) / 2) and z["y"] == pytest.approx(((5 - 3) / s + 1) / 2)


def test_samples_and_splits(table):
    assert f.cap_rows(table, "id", 100).count() == 100 and f.cap_rows(table, "id", 100).exceptAll(f.cap_rows(table, "id", 100)).count() == 0
    assert 100 < f.split(table, "id", 0.2).filter("test").count() < 220
    assert f.one_hot(table, "hit", ["0", "1"]).agg(F.sum("hit_0") + F.sum("hit_1")).first()[0] == 800


def test_models(table):
    m = f.fit_linear(table, ["a", "b"], "y")
    assert m["intercept"] == pytest.approx(3) and m["a"] == pytest.approx(2) and m["b"] == pytest.approx(-1) and m["r2"] == pytest.approx(1)
    wide, names = f.polynomial_terms(table.withColumn("z", F.col("a") * F.col("b") * 4 + 1), ["a", "b"], 2)
    assert names == ["a", "b", "a*a", "a*b", "b*b"] and f.fit_linear(wide, names, "z")["a*b"] == pytest.approx(4)
    assert "a <= " in f.guard_tree(table, ["a", "b"], "hit")
    fit = f.boosted_surrogate(table, ["a", "b"], "y", rounds=10)
    assert fit(table).agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0] < 0.8
    two = table.withColumn("a", F.col("a") + F.when(F.col("id") % 2 == 0, 50).otherwise(0))
    assert f.split_states(two, ["a"]).groupBy("cluster").count().count() == 2
    k, rows = f.mixture_states(two, ["a"], most=3)
    assert k in (2, 3) and rows.count() == 800


def test_recommendations(spark):
    sim = spark.createDataFrame([("d1", 0.9), ("d2", 0.8), ("d3", 0.1)], "design string, sim double")
    owned = spark.createDataFrame([("d1", "p", 1.0, False), ("d2", "p", 0.5, False), ("d2", "q", 1.0, False), ("d3", "r", 9.0, False), ("me", "q", 0.0, True)], "design string, item string, score double, mine boolean")
    got = f.recommend(sim, owned).collect()
    assert [(r["item"], round(r["score"], 6)) for r in got] == [("p", 1.3)]
    pred = spark.createDataFrame([(1, 0.1), (1, 0.3), (2, 0.5)], "candidate int, std double")
    assert f.next_sample(pred).first()["candidate"] == 2


def test_merge_on_grid_over_all_runs(spark):
    """Runs of different grids and numbers of parts are merged each on its own."""
    from sievemill.operators import lookup

    made = [(r, p, i, float(i * r), "v", float(100 * r + 10 * p + i)) for r in (1, 2, 3) for p in range(r) for i in range(2 + r)]
    frame = lambda rows: spark.createDataFrame(rows, "run_key long, part int, idx long, t double, signal string, value double")
    got = {(x["run_key"], x["idx"]): (x["t"], x["value"]) for x in lookup.merge_on_grid(frame(made)).collect()}
    assert got == {(r, i): (float(i * r), float(100 * r + 10 * (r - 1) + i)) for r in (1, 2, 3) for i in range(2 + r)}
    with pytest.raises(ValueError):
        lookup.merge_on_grid(frame([*made, (3, 3, 0, 0.5, "v", 1.0)]))
