"""Surrogates from summed matrices: a sparse Gaussian process with variances, and formulas found term by term."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inducing points, and partial sums merged at once.
POINTS, FAN_IN = 256, 16
PARTIAL = "part long, a binary, b binary, yy binary"


def matern_rbf(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    """A Matern kernel of order 5/2 and a Gaussian one, one half each."""
    d2 = np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0) / length**2
    d = np.sqrt(5 * d2)
    return 0.5 * (1 + d + d * d / 3) * np.exp(-d) + 0.5 * np.exp(-d2 / 2)


@dataclass
class SparseProcess:
    """Means and scales of features and targets, inducing points, and the solved matrices of the chosen length."""

    x_mean: np.ndarray
    x_scale: np.ndarray
    y_mean: np.ndarray
    y_scale: np.ndarray
    points: np.ndarray
    length: float
    weights: np.ndarray
    gain: np.ndarray  # K_mm^-1 - noise (noise K_mm + K_mn K_nm)^-1
    noise: float

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation of each target."""
        k = matern_rbf((x - self.x_mean) / self.x_scale, self.points, self.length)
        var = np.maximum(1 - ((k @ self.gain) * k).sum(axis=1), 0)
        return self.y_mean + k @ self.weights * self.y_scale, np.sqrt(var)[:, None] * self.y_scale


def _sums(points: np.ndarray, lengths: tuple, scales: tuple):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x_mean, x_scale, y_mean, y_scale = scales
        a, b, yy = np.zeros((len(lengths), len(points), len(points))), np.zeros((len(lengths), len(points), len(y_mean))), np.zeros(len(y_mean))
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = (np.stack(pdf["x"].to_list()) - x_mean) / x_scale, (np.stack(pdf["y"].to_list()) - y_mean) / y_scale
            yy += (y * y).sum(axis=0)
            for j, length in enumerate(lengths):
                k = matern_rbf(points, x, length)
                a[j] += k @ k.T
                b[j] += k @ y
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "a": [a.tobytes()], "b": [b.tobytes()], "yy": [yy.tobytes()]})

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN_IN], **{c: [sum(np.frombuffer(v) for v in pdf[c]).tobytes()] for c in ("a", "b", "yy")}})


def fit_process(rows: DataFrame, features: list[str], targets: list[str], points: int = POINTS, lengths: tuple = (0.5, 1.0, 2.0, 4.0), noise: float = 1e-3) -> SparseProcess:
    """A Gaussian process on `points` inducing points, the distinct rows with the smallest hashes; with all rows as
    points it is the dense solution. One pass sums K_mn K_nm and K_mn y for every length, and the length with the
    highest evidence is taken. Features that never change are left flat; rows with a missing value are left out."""
    array = lambda names: F.array(*[F.col(c).cast("double") for c in names])
    rows = rows.select(array(features).alias("x"), array(targets).alias("y")).filter(F.forall(F.concat("x", "y"), lambda v: v.isNotNull() & ~F.isnan(v)))
    each = [(c, i) for c, names in (("x", features), ("y", targets)) for i in range(len(names))]
    r = rows.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c)[i]).alias(f"{n}{c}{i}") for c, i in each for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    if not r["n"]:
        raise ValueError("no row to fit")
    flat = lambda s: s if s and s > 1e-12 else 1.0
    scales = tuple(np.array([v(r[f"{n}{c}{i}"]) for i in range(len(names))]) for c, names in (("x", features), ("y", targets)) for n, v in (("m", float), ("s", flat)))
    chosen = rows.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(points).collect()
    at = (np.array([p["x"] for p in chosen]) - scales[0]) / scales[1]
    parts = rows.rdd.getNumPartitions()
    one = rows.mapInPandas(_sums(at, lengths, scales), PARTIAL)
    while parts > 1:
        one = one.groupBy(F.floor(F.col("part") / FAN_IN).alias("_of")).applyInPandas(_added, PARTIAL)
        parts = -(-parts // FAN_IN)
    # solved in a task: the driver's BLAS may run many threads, which is no place for this next to a JVM
    r2 = one.mapInPandas(_solved(at, len(targets), lengths, noise, r["n"]), "length double, weights binary, gain binary").first()
    m = len(at)
    return SparseProcess(*scales, at, r2["length"], np.frombuffer(bytes(r2["weights"])).reshape(m, -1), np.frombuffer(bytes(r2["gain"])).reshape(m, m), noise)


def _solved(at: np.ndarray, t: int, lengths: tuple, noise: float, n: int):
    """The length with the highest evidence, with its weights and the matrix of its variances."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                m, best = len(at), None
                a, b, yy = np.frombuffer(row.a).reshape(-1, m, m), np.frombuffer(row.b).reshape(-1, m, t), np.frombuffer(row.yy)
                for j, length in enumerate(lengths):
                    k = matern_rbf(at, at, length) + 1e-10 * np.eye(m)
                    s = noise * k + a[j]
                    w = np.linalg.solve(s, b[j])
                    fit = -0.5 * (t * (np.linalg.slogdet(s)[1] - np.linalg.slogdet(k)[1] + (n - m) * np.log(noise)) + ((yy - (b[j] * w).sum(axis=0)) / noise).sum())
                    if best is None or fit > best[0]:
                        best = fit, length, w, np.linalg.inv(k) - noise * np.linalg.inv(s)
                yield pd.DataFrame({"length": [best[1]], "weights": [best[2].tobytes()], "gain": [best[3].tobytes()]})

    return run


def predicted(rows: DataFrame, model: SparseProcess, features: list[str]) -> DataFrame:
    """rows with mean and std, arrays over the targets; null where a feature is missing."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))

    @F.pandas_udf("mean array<double>, std array<double>")
    def told(xs: pd.Series) -> pd.DataFrame:
        if not len(xs):
            return pd.DataFrame({"mean": [], "std": []})
        mean, std = model.predict(np.stack(xs.to_list()))
        return pd.DataFrame({"mean": list(mean), "std": list(std)})

    zero = F.array(*[F.lit(0.0)] * len(features))
    made = rows.withColumn("_p", told(F.when(fit, x).otherwise(zero)))
    return made.withColumns({c: F.when(fit, F.col(f"_p.{c}")) for c in ("mean", "std")}).drop("_p")


# --- formulas


def term_library(features: list[str]) -> dict[str, Column]:
    """Each feature, its square, inverse, root, logarithm and exponential, and products and quotients of two; null where
    a term has no value."""
    terms = {}
    for f in features:
        x = F.col(f).cast("double")
        terms |= {f: x, f"{f}^2": x * x, f"1/{f}": F.try_divide(F.lit(1.0), x), f"sqrt({f})": F.when(x >= 0, F.sqrt(x)), f"log({f})": F.when(x > 0, F.ln(x)), f"exp({f})": F.when(x < 700, F.exp(x))}
    for f, g in combinations(features, 2):
        x, y = F.col(f).cast("double"), F.col(g).cast("double")
        terms |= {f"{f}*{g}": x * y, f"{f}/{g}": F.try_divide(x, y), f"{g}/{f}": F.try_divide(y, x)}
    return terms


def pursuit(n: float, sums: np.ndarray, gram: np.ndarray, usable: np.ndarray, most: int, enough: float) -> list[tuple[list[int], np.ndarray, float]]:
    """Orthogonal matching pursuit over the last column from sums and products: after each step the terms (as indices),
    their coefficients with the intercept last, and r2. The term that fits the rest best joins; the first of equals."""
    c = gram - np.outer(sums, sums) / n
    scale = np.sqrt(np.maximum(np.diag(c), 0))
    y, taken, out = len(sums) - 1, [], []
    rest = c[:, y].copy()
    fine = usable & (scale[:-1] > 1e-9 * np.maximum(np.sqrt(np.abs(np.diag(gram))[:-1]), 1e-300))
    r2 = 0.0
    while scale[y] > 0 and len(taken) < most and r2 < enough:
        gain = np.where(fine, np.abs(rest[:-1]) / np.where(fine, scale[:-1], 1), -1)
        gain[taken] = -1
        best = int(np.argmax(gain >= gain.max() * (1 - 1e-9)))
        if gain[best] <= 1e-9 * scale[y]:
            break
        taken.append(best)
        d = scale[taken]
        w = np.linalg.lstsq(c[np.ix_(taken, taken)] / np.outer(d, d), c[taken, y] / d, rcond=1e-12)[0] / d
        rest = c[:, y] - c[:, taken] @ w
        r2 = float(1 - max(rest[y] - rest[taken] @ w, 0) / c[y, y])
        out.append((list(taken), np.append(w, (sums[y] - w @ sums[taken]) / n), r2))
    return out


TERM_SUMS = "key string, part int, n long, width int, sums binary, gram binary, missing binary"


def _term_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums and products of the terms by key, over a task's rows."""
    held: dict[str, list] = {}
    part = TaskContext.get().partitionId() // FAN_IN
    names = [c.split()[0] for c in TERM_SUMS.split(", ")]

    def out() -> pd.DataFrame:
        rows = [(k, part, n, len(s), s.tobytes(), g.tobytes(), m.tobytes()) for k, (n, s, g, m) in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=names)

    for pdf in batches:
        for key, own in pdf.groupby("key"):
            v = np.array(own["v"].to_list(), dtype=float)
            gone = ~np.isfinite(v)
            v[gone] = 0.0
            new = [len(v), v.sum(axis=0), v.T @ v, gone.sum(axis=0).astype(float)]
            held[key] = [a + b for a, b in zip(held[key], new)] if key in held else new
        if len(held) > 1000:
            yield out()
    yield out()


def _terms_added(pdf: pd.DataFrame) -> pd.DataFrame:
    one = pdf.iloc[:1].assign(part=0, n=pdf["n"].sum())
    return one.assign(**{c: [sum(np.frombuffer(v) for v in pdf[c]).tobytes()] for c in ("sums", "gram", "missing")})


def formulas(rows: DataFrame, features: list[str], target: str, key: str | None = None, most: int = 4, enough: float = 1 - 1e-9) -> DataFrame:
    """key (if given), step, term (null: the intercept), coefficient and r2: the formula after each step, one for each
    key. One pass sums the products of all terms; terms without a value in some row of the key are left out."""
    terms = term_library(features)
    names = list(terms)
    values = F.array(*terms.values(), F.col(target).cast("double"))
    rows = rows.filter(F.col(target).isNotNull()).select((F.col(key).cast("string") if key else F.lit("")).alias("key"), values.alias("v")).filter("key IS NOT NULL")
    sums = rows.mapInPandas(_term_sums, TERM_SUMS)
    for keys in (["key", "part"], ["key"]):
        sums = sums.groupBy(*keys).applyInPandas(_terms_added, TERM_SUMS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                gram = np.frombuffer(r.gram).reshape(r.width, r.width)
                for step, (taken, w, r2) in enumerate(pursuit(r.n, np.frombuffer(r.sums), gram, np.frombuffer(r.missing)[:-1] == 0, most, enough), 1):
                    out += [(r.key, step, n, float(c), r2) for n, c in zip([names[i] for i in taken] + [None], w)]
            yield pd.DataFrame(out, columns=["key", "step", "term", "coefficient", "r2"], dtype=object)

    found = sums.mapInPandas(run, "key string, step int, term string, coefficient double, r2 double")
    return found.withColumnRenamed("key", key) if key else found.drop("key")
