"""Feature tables: metadata encoding, degenerate columns, selection, splits, and small models by Spark's own ML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_flat_columns(df: DataFrame, columns: list[str], least_std: float = 1e-8, most_corr: float = 0.999) -> list[str]:
    """Columns worth keeping, in order: those that vary, and that no kept column before them is correlated with too
    strongly. One aggregation; the driver sees one number a pair."""
    sd = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    vary = [c for c in columns if sd[c] is not None and sd[c] > least_std]
    pairs = [(a, b) for i, b in enumerate(vary) for a in vary[:i]]
    corr = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).first() if pairs else {}
    kept: list[str] = []
    for c in vary:
        if all(abs(corr[f"{a}|{c}"] or 0) <= most_corr for a in kept):
            kept.append(c)
    return kept


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 16) -> DataFrame:
    """feature, mi: mutual information with the target over equal-width bins (an estimate of its own, unlike those from
    nearest neighbours)."""
    names = [*features, target]
    edge = df.agg(*[F.min(c).alias(f"lo_{c}") for c in names], *[F.max(c).alias(f"hi_{c}") for c in names]).first()

    def bin_of(c: str) -> Column:
        lo, hi = edge[f"lo_{c}"], edge[f"hi_{c}"]
        return F.least(F.floor((F.col(c) - lo) * (bins / ((hi - lo) or 1.0))), F.lit(bins - 1))

    long = df.select(bin_of(target).alias("y"), *[bin_of(c).alias(c) for c in features]).unpivot(["y"], features, "feature", "x")
    joint = long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("feature")
    n, nx, ny, nxy = F.sum("n").over(total), F.sum("n").over(Window.partitionBy("feature", "x")), F.sum("n").over(Window.partitionBy("feature", "y")), F.col("n")
    return joint.withColumn("part", nxy / n * F.log(nxy * n / (nx * ny))).groupBy("feature").agg(F.sum("part").alias("mi"))


def select_features(df: DataFrame, features: list[str], targets: list[str], most: int, forced: tuple[str, ...] = (), most_corr: float = 0.95) -> list[str]:
    """Forced names, then features by their largest mutual information with any target, leaving out those that are
    correlated with a chosen one, until there are `most`."""
    best: dict[str, float] = {}
    for t in targets:
        for r in mutual_information(df, features, t).collect():  # one row a feature
            best[r["feature"]] = max(best.get(r["feature"], 0.0), r["mi"])
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    corr = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).first() if pairs else {}
    near = lambda a, b: abs((corr[f"{a}|{b}"] if features.index(a) < features.index(b) else corr[f"{b}|{a}"]) or 0) > most_corr
    chosen = [f for f in features if f in forced]
    for f in sorted(set(features) - set(chosen), key=lambda x: (-best.get(x, 0), features.index(x))):
        if len(chosen) >= most:
            break
        if not any(near(f, c) for c in chosen):
            chosen.append(f)
    return chosen


def encode_meta(rows: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """code of each metadata value: the number itself where all values of the key are numbers, else its rank by name."""
    numeric = F.min(F.col(value).try_cast("double").isNotNull()).over(Window.partitionBy(key))
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(value)) - 1
    return rows.withColumn("code", F.when(numeric, F.col(value).try_cast("double")).otherwise(rank.cast("double")))


def target_codes(rows: DataFrame, category: str, columns: list[str]) -> DataFrame:
    """code of each category: the mean, over its rows, of the row's mean z-score (population deviation, missing left out)."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    z = [F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")) for c in columns]
    have = F.array_compact(F.array(*z))
    row = F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda s, x: s + x) / F.size(have))
    return rows.join(F.broadcast(stats)).withColumn("_z", row).groupBy(category).agg(F.avg("_z").alias("code"), F.count(F.lit(1)).alias("n"))  # stats: one row


def one_hot(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    return rows.select("*", *[(F.col(key) == v).cast("int").alias(f"{key}_{v}") for v in values])


def cap_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), the same for the same seed: a sampling operator."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """test: true for about that share of the rows, by a hash of the key."""
    return df.withColumn("test", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit_linear(df: DataFrame, features: list[str], target: str) -> dict[str, float]:
    """Least squares with intercept by normal equations: one aggregation of sums, solved on the driver; r2 included."""
    import numpy as np

    cols = ["1", *features]
    x = {c: F.lit(1.0) if c == "1" else F.col(c) for c in cols}
    y = F.col(target)
    sums = [F.sum(x[a] * x[b]).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    r = df.agg(*sums, *[F.sum(x[c] * y).alias(f"y_{i}") for i, c in enumerate(cols)], F.sum(y * y).alias("yy"), F.count(F.lit(1)).alias("n")).first()
    k = len(cols)
    a = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([r[f"y_{i}"] for i in range(k)])
    w = np.linalg.lstsq(a, b, rcond=None)[0]
    sst, sse = r["yy"] - b[0] ** 2 / r["n"], r["yy"] - 2 * w @ b + w @ a @ w
    return {c: float(v) for c, v in zip(["intercept", *features], w)} | {"r2": 1.0 if sst < 1e-30 else float(1 - sse / sst)}


def polynomial_terms(df: DataFrame, features: list[str], degree: int) -> tuple[DataFrame, list[str]]:
    """All products of up to `degree` features, with replacement."""
    from itertools import combinations_with_replacement

    terms = [c for d in range(1, degree + 1) for c in combinations_with_replacement(features, d)]
    names = ["*".join(t) for t in terms]
    out = df
    for name, t in zip(names, terms):
        if len(t) > 1:
            product = F.lit(1.0)
            for f in t:
                product = product * F.col(f)
            out = out.withColumn(name, product)
    return out, names


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)


def split_states(df: DataFrame, features: list[str], k: int = 2, seed: int = 7) -> DataFrame:
    """cluster of each row by k-means."""
    from pyspark.ml.clustering import KMeans

    rows = _vector(df, features)
    return KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(rows).transform(rows).drop("_x")


def mixture_states(df: DataFrame, features: list[str], most: int = 8, seed: int = 7) -> tuple[int, DataFrame]:
    """The Gaussian mixture of 2 to `most` components with the lowest BIC, and each row's component."""
    from math import log

    from pyspark.ml.clustering import GaussianMixture

    rows = _vector(df, features).persist()
    try:
        n, d, best = rows.count(), len(features), None
        for k in range(2, most + 1):
            m = GaussianMixture(k=k, seed=seed, featuresCol="_x", predictionCol="component", probabilityCol="_p").fit(rows)
            bic = -2 * m.summary.logLikelihood + log(n) * (k - 1 + k * d + k * d * (d + 1) / 2)
            if best is None or bic < best[0]:
                best = (bic, k, m)
    finally:
        rows.unpersist()
    return best[1], best[2].transform(rows).drop("_x", "_p")


def guard_tree(df: DataFrame, features: list[str], label: str, depth: int = 4) -> str:
    """Rules of a small decision tree for a 0/1 label, as text with feature names."""
    from pyspark.ml.classification import DecisionTreeClassifier

    m = DecisionTreeClassifier(maxDepth=depth, seed=7, featuresCol="_x", labelCol=label).fit(_vector(df, features).withColumn(label, F.col(label).cast("double")))
    text = m.toDebugString
    for i in range(len(features) - 1, -1, -1):
        text = text.replace(f"feature {i} ", f"{features[i]} ")
    return text


def boosted_surrogate(train: DataFrame, features: list[str], target: str, rounds: int = 30, depth: int = 4):
    """Gradient-boosted trees; call .transform(vector(df)) of the result's pair."""
    from pyspark.ml.regression import GBTRegressor

    model = GBTRegressor(maxIter=rounds, maxDepth=depth, seed=7, featuresCol="_x", labelCol=target, predictionCol="p").fit(_vector(train, features))
    return lambda df: model.transform(_vector(df, features)).drop("_x")


def recommend(similar: DataFrame, owned: DataFrame, least: float = 0.7, k: int = 5) -> DataFrame:
    """similar (design, sim) with items (design, item, score) of designs over the similarity: items not owned, by the sum
    of similarity times score."""
    s = similar.filter(F.col("sim") > least).join(owned.filter("NOT mine"), "design")
    fresh = s.join(owned.filter("mine").select("item").distinct(), "item", "left_anti")
    return fresh.groupBy("item").agg(F.sum(F.col("sim") * F.col("score")).alias("score")).orderBy(F.desc("score"), "item").limit(k)


def next_sample(predictions: DataFrame) -> DataFrame:
    """The candidate with the largest mean uncertainty."""
    return predictions.groupBy("candidate").agg(F.avg("std").alias("u")).orderBy(F.desc("u"), "candidate").limit(1)
