"""Regressions on lagged samples: products are summed in the JVM, one aggregate a network, and a small system is solved
from the sums. Runs are cut into pieces with the lags as margin, so a long network is many tasks' work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cuts import with_halo
from .kernels import poles_of_roots


def lagged_sums(series: DataFrame, order: int, inputs: bool) -> DataFrame:
    """series (network, idx, dt, u, y): n, dt and products, the sums over the upper triangle of all products of y to y
    lagged by `order`, then u likewise where inputs are asked for. Rows with a missing value among these are left out."""
    cut = with_halo(series.select("network", "idx", "dt", *[F.col(c).cast("double").alias(c) for c in "uy"]), order)
    by = Window.partitionBy("network", "piece").orderBy("idx")
    terms = {f"{c}{k}": F.lag(c, k).over(by) if k else F.col(c) for c in ("y", *("u" * inputs)) for k in range(order + 1)}
    rows = cut.withColumns(terms).filter(F.col("own")).na.drop(subset=list(terms))
    names = list(terms)
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    full = rows.groupBy("network").agg(F.count(F.lit(1)).alias("n"), F.array(*products).alias("products"))
    every = series.groupBy("network").agg(F.min_by("dt", "idx").alias("dt"))
    return every.join(full, "network", "left").select("network", F.coalesce("n", F.lit(0)).alias("n"), "dt", "products")


def square(products, size: int) -> np.ndarray:
    g = np.zeros((size, size))
    g[np.triu_indices(size)] = products
    return g + np.triu(g, 1).T


def solved(g: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Least squares from a Gram matrix, its columns scaled to one; directions lost to rounding get nothing."""
    scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    return np.linalg.lstsq(g * np.outer(scale, scale), rhs * scale, rcond=1e-14)[0] * scale


def ar_coefficients(g: np.ndarray, order: int, inputs: bool) -> np.ndarray:
    """a_1..a_p, then b_0..b_p: y = sum a_k y[-k] + sum b_k u[-k]."""
    past = [*range(1, order + 1), *range(order + 1, 2 * order + 2)] if inputs else list(range(1, order + 1))
    return solved(g[np.ix_(past, past)], g[past, 0])


def era_roots(g: np.ndarray, order: int | None, knee: float) -> np.ndarray:
    """Discrete roots by the eigensystem of data correlations: with H0 the lagged samples and H1 those one step on,
    H0 H0' = U S^2 U' and the system is S^-1 U' H1 H0' U S^-1."""
    g = g[::-1, ::-1]  # oldest first
    s2, u = np.linalg.eigh(g[:-1, :-1])
    s, u = np.sqrt(np.maximum(s2[::-1], 0)), u[:, ::-1]
    r = order or max(1, int(np.argmax(np.append(s / max(s[0], 1e-300), 0) < knee)))
    if not s[r - 1] > 0:
        raise ValueError("the response has fewer modes than asked for")
    return np.linalg.eigvals((u[:, :r] / s[:r]).T @ g[1:, :-1] @ u[:, :r] / s[:r])


def _each(kernel, names: list[str]):
    """kernel(row) -> dicts, one network a row; a failure is a row with its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    out += [{"network": r.network, **m, "error": None} for m in kernel(r)]
                except (ValueError, np.linalg.LinAlgError) as e:
                    out.append({"network": r.network, "error": str(e)})
            yield pd.DataFrame(out, columns=names, dtype=object)

    return run


def _solve(sums: DataFrame, kernel, schema: str) -> DataFrame:
    kind = dict(sums.dtypes)["network"]
    names = ["network", *(x.split()[0] for x in schema.split(", ")), "error"]
    return sums.mapInPandas(_each(kernel, names), f"network {kind}, {schema}, error string")


def coefficients(series: DataFrame, order: int, inputs: bool = True) -> DataFrame:
    """network, name (a1.. then b0..) and value of the model that fits best; networks with fewer equations than
    unknowns are errors."""
    names = [f"a{k}" for k in range(1, order + 1)] + ([f"b{k}" for k in range(order + 1)] if inputs else [])
    size = (order + 1) * (1 + inputs)

    def kernel(r) -> list[dict]:
        if r.n < len(names):
            raise ValueError("too few samples")
        return [{"name": k, "value": float(v)} for k, v in zip(names, ar_coefficients(square(r.products, size), order, inputs))]

    return _solve(lagged_sums(series, order, inputs), kernel, "name string, value double")


def identify(series: DataFrame, method: str, order: int, knee: float = 1e-3) -> DataFrame:
    """network, k, re and im: poles by prony (a free response as a sum of exponentials), arx (with the input) or era
    (lags twice the order and more; order 0: to the first singular value under `knee` of the largest)."""
    if method not in ("prony", "arx", "era"):
        raise ValueError(f"unsupported method {method}")
    lags = max(2 * order + 2, 8) if method == "era" else order

    def kernel(r) -> list[dict]:
        if r.n < (2 * order + 1 if method == "arx" else lags):
            raise ValueError("too few samples")
        g = square(r.products, (lags + 1) * (1 + (method == "arx")))
        roots = era_roots(g, order or None, knee) if method == "era" else np.roots(np.r_[1, -ar_coefficients(g, order, method == "arx")[:order]])
        return [{"k": i, "re": float(p.real), "im": float(p.imag)} for i, p in enumerate(poles_of_roots(roots, r.dt))]

    return _solve(lagged_sums(series, lags, method == "arx"), kernel, "k int, re double, im double")
