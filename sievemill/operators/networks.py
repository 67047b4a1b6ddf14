"""Networks of resistors, inductors and capacitors with known poles, their responses, and sweeps of the identifiers.

States of a network are inductor currents and capacitor voltages; matrices are small, and many networks are rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import arx, era, impulse_of, match_poles, per_group, prony, vector_fit


def pair_of_poles(damping: float, square: float) -> np.ndarray:
    """Roots of s^2 + 2 damping s + square."""
    root = np.sqrt(complex(damping * damping - square))
    return np.array([-damping + root, -damping - root])


def series_poles(r: float, l: float, c: float) -> np.ndarray:  # noqa: E741
    return pair_of_poles(r / (2 * l), 1 / (l * c))


def parallel_poles(r: float, l: float, c: float) -> np.ndarray:  # noqa: E741
    return pair_of_poles(1 / (2 * r * c), 1 / (l * c))


def ladder(stages: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices A, B, C of a ladder of stages (r, l, c): each has r and l in series and c to ground; the output is the
    last voltage. Stage k takes the voltage before it and feeds the current of the stage after it."""
    n = len(stages)
    a, b, c = np.zeros((2 * n, 2 * n)), np.zeros((2 * n, 1)), np.zeros((1, 2 * n))
    for k, (res, ind, cap) in enumerate(stages):
        cur, vol = 2 * k, 2 * k + 1
        a[cur, [cur, vol]] = -res / ind, -1 / ind
        a[vol, cur] = 1 / cap
        if k:
            a[cur, vol - 2] = 1 / ind
            a[vol - 2, cur] = -1 / stages[k - 1][2]
    b[0, 0], c[0, -1] = 1 / stages[0][1], 1.0
    return a, b, c


def random_ladder(n: int, seed: int, near: bool = False) -> list[tuple[float, float, float]]:
    """Stages drawn between 0.05 and 2 ohm, 1 and 50 nH, 1 and 100 nF; near: resonances within three per cent of the
    stage before."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        r, ind, cap = rng.uniform(0.05, 2.0), rng.uniform(1e-9, 50e-9), rng.uniform(1e-9, 100e-9)
        if near and out:
            cap = out[-1][1] * out[-1][2] / ind * rng.uniform(0.97, 1.03)
        out.append((r, ind, cap))
    return out


def foster(poles: np.ndarray, residues: np.ndarray) -> list[tuple[float, float]]:
    """(r, c) of the parallel branches of the real poles; complex pairs need other branches and are left out."""
    real = np.abs(poles.imag) <= 1e-9
    return [(-1 / (p * k) if p else np.inf, k) for p, k in zip(poles.real[real].tolist(), residues.real[real].tolist())]


def cauer(num: np.ndarray, den: np.ndarray) -> list[float]:
    """Leading terms of the continued fraction of den / num: the elements of a ladder with the same poles."""
    above, below, out = np.trim_zeros(np.asarray(den, float), "f"), np.trim_zeros(np.asarray(num, float), "f"), []
    for _ in range(len(den) - 1):
        if len(above) < len(below):
            above, below = below, above
        if len(above) < 2 or not len(below):
            break
        lead = above[0] / below[0]
        out.append(float(lead))
        taken = np.concatenate([lead * below, np.zeros(len(above) - len(below))])
        rest = above - taken
        rest[np.abs(rest) < 1e-12 * max(1.0, np.abs(above).max())] = 0.0
        above, below = below, np.trim_zeros(rest, "f")
    return out


def held(a: np.ndarray, b: np.ndarray, c: np.ndarray, u: np.ndarray, dt: float, snr_db: float | None = None, seed: int = 0) -> np.ndarray:
    """Response to an input that is held from sample to sample, with seeded noise at a signal-to-noise ratio."""
    n = len(a)
    whole = np.zeros((n + 1, n + 1))
    whole[:n, :n], whole[:n, n:] = a * dt, b * dt
    squarings = max(0, int(np.ceil(np.log2(max(np.abs(whole).sum(axis=1).max(), 1e-12)))) + 1)
    step, term = np.eye(n + 1), np.eye(n + 1)
    for k in range(1, 20):  # the exponential's series of the halved matrix, squared up again
        term = term @ whole / 2.0**squarings / k
        step = step + term
    for _ in range(squarings):
        step = step @ step
    x, y = np.zeros(n), np.zeros(len(u))
    for i, v in enumerate(u):
        y[i] = (c @ x).item()
        x = step[:n, :n] @ x + step[:n, n] * v
    return with_noise(y, snr_db, seed)


def with_noise(y: np.ndarray, snr_db: float | None, seed: int = 0) -> np.ndarray:
    if snr_db is None:
        return y
    power = np.mean(np.abs(y) ** 2) / 10 ** (snr_db / 10)
    rng = np.random.default_rng(seed)
    noise = rng.normal(size=y.shape)
    if np.iscomplexobj(y):
        noise = (noise + 1j * rng.normal(size=y.shape)) / np.sqrt(2)
    return y + noise * np.sqrt(max(power, 1e-30))


def step_of(poles: np.ndarray, residues: np.ndarray, t: np.ndarray, direct: float = 0.0) -> np.ndarray:
    """Unit step response of a sum of residues over poles; a pole at the origin gives a ramp."""
    out = np.full(len(t), direct, dtype=complex)
    for p, r in zip(poles, residues):
        out += r * t if abs(p) < 1e-30 else r / p * np.expm1(p * t)
    return out.real


def response_of(poles: np.ndarray, residues: np.ndarray, w: np.ndarray, direct: float = 0.0) -> np.ndarray:
    return (residues / (1j * w[:, None] - poles)).sum(axis=1) + direct


def cross_check(poles: np.ndarray, residues: np.ndarray, at: np.ndarray, seen: np.ndarray, kind: str = "impulse", direct: float = 0.0) -> float:
    """Root mean square error of the model's response against data, over the range of the data."""
    made = {"impulse": lambda: impulse_of(poles, residues, at), "step": lambda: step_of(poles, residues, at, direct), "frequency": lambda: response_of(poles, residues, at, direct)}[kind]()
    size = np.abs(seen).max() - np.abs(seen).min() if kind == "frequency" else np.ptp(seen)
    return float(np.sqrt(np.mean(np.abs(seen - made) ** 2)) / (size if size > 0 else 1.0))


#: Excitations that each identifier can use.
SUPPORTED = {"prony": ("impulse",), "era": ("impulse",), "arx": ("impulse", "step", "prbs"), "vector_fit": ("frequency",)}


def sweep(spark, stages: list[tuple[float, float, float]], methods: list[str], excitations: list[str], snrs: list[float | None], n: int = 1500) -> DataFrame:
    """Relative pole error of each method on one ladder by excitation and noise, one row a combination that the method
    supports (a method of the frequency domain has one excitation); a failure is a row with its text."""
    combos = [(m, e, s) for m in methods for e in (SUPPORTED[m] if SUPPORTED[m] == ("frequency",) else [x for x in excitations if x in SUPPORTED[m]]) for s in snrs]
    grid = spark.createDataFrame([(i, *x) for i, x in enumerate(combos)], "run int, method string, excitation string, snr_db double")
    a, b, c = ladder(stages)
    truth = np.linalg.eigvals(a)

    def kernel(pdf: pd.DataFrame) -> dict:
        row = pdf.iloc[0]
        snr = None if row["snr_db"] is None or np.isnan(row["snr_db"]) else float(row["snr_db"])
        order, big = len(truth), np.abs(truth).max()
        if row["excitation"] == "frequency":
            w = np.geomspace(np.abs(truth).min() / 10, big * 10, 300)
            h = (c @ np.linalg.solve(1j * w[:, None, None] * np.eye(order) - a, np.broadcast_to(b, (len(w), order, 1)))).ravel()
            found = vector_fit(1j * w, with_noise(h, snr), order)[0]
        else:
            dt = 0.2 / big
            u = {"impulse": np.r_[1 / dt, np.zeros(n - 1)], "step": np.ones(n), "prbs": np.sign(np.random.default_rng(0).normal(size=n))}[row["excitation"]]
            y = held(a, b, c, u, dt, snr)
            found = {"prony": lambda: prony(y[1:], dt, order)[0], "era": lambda: era(y[1:], dt, order), "arx": lambda: arx(u, y, dt, order)}[row["method"]]()
        pairs = match_poles(truth, found)
        return {"pole_error": float(np.mean([abs(truth[i] - found[j]) for i, j in pairs]) / np.abs(truth).mean())}

    return grid.join(per_group(grid, "run", "run", kernel, "pole_error double"), "run").drop("run")


def fingerprints(nodes: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """Per graph (nodes graph, node, type; edges graph, a, b, undirected): share of each type (others count as the last),
    shares of degrees in ten bins up to 20, clustering (mean, deviation, extremes), components a node, the largest
    component's diameter / 20, nodes / 100 and edges / 200. A graph is one design that a task holds; there may be
    any number of them."""
    names = [*(f"type_{t}" for t in types), *(f"degree_{k}" for k in range(10)), "cc_mean", "cc_std", "cc_min", "cc_max", "components", "diameter", "n_nodes", "n_edges"]

    def one(key, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        at = {v: i for i, v in enumerate(own["node"])}
        n = len(at)
        near: list[set[int]] = [set() for _ in range(n)]
        for x, y in zip(links["a"], links["b"]):
            if x in at and y in at and x != y:
                near[at[x]].add(at[y]), near[at[y]].add(at[x])
        share = np.zeros(len(types))
        for t in own["type"]:
            share[types.index(t) if t in types else -1] += 1
        degree = np.array([len(s) for s in near])
        bins = np.histogram(degree, bins=10, range=(0, 20))[0]
        cc = np.array([2 * sum(len(near[x] & s) for x in s) / 2 / (len(s) * (len(s) - 1)) if len(s) > 1 else 0.0 for s in near])

        seen, parts = set(), []
        for x in range(n):
            if x not in seen:
                parts.append(_hops(near, x).keys())
                seen |= parts[-1]
        diameter = _diameter(near, max(parts, key=len, default=()))
        stats = [cc.mean(), cc.std(), cc.min(), cc.max()] if n else [0.0] * 4
        row = [*(share / max(n, 1)), *(bins / max(bins.sum(), 1)), *stats, len(parts) / max(n, 1), diameter / 20, n / 100, sum(map(len, near)) / 2 / 200]
        return pd.DataFrame([[key[0], *map(float, row)]], columns=["graph", *names])

    kind = dict(nodes.dtypes)["graph"]
    schema = f"graph {kind}, " + ", ".join(f"`{x}` double" for x in names)
    return nodes.select("graph", "node", "type").groupBy("graph").cogroup(edges.select(F.col("graph").alias("graph"), "a", "b").groupBy("graph")).applyInPandas(one, schema)


def _hops(near: list[set[int]], start: int) -> dict[int, int]:
    """Distances from a node by breadth-first search."""
    hops, front, k = {start: 0}, {start}, 0
    while front:
        k += 1
        front = {y for x in front for y in near[x]} - hops.keys()
        hops.update(dict.fromkeys(front, k))
    return hops


def _diameter(near: list[set[int]], part) -> int:
    """The longest distance in a connected part. All nodes within i hops of a root are at most 2 i apart, so distances
    are looked at from the nodes farthest from a root in the middle inwards, until one found is as long: a few searches
    for most graphs, and one from each node only where all lie equally far out, as in a ring."""
    if len(part) < 2:
        return 0
    first = _hops(near, max(part, key=lambda x: len(near[x])))
    one = _hops(near, max(first, key=first.get))
    other = _hops(near, max(one, key=one.get))
    found, across = max(other.values()), max(one.values())
    root = _hops(near, next(x for x in one if one[x] == across // 2 and other[x] == across - across // 2))
    levels: list[list[int]] = [[] for _ in range(max(root.values()) + 1)]
    for x, k in root.items():
        levels[k].append(x)
    for k in range(len(levels) - 1, 0, -1):
        for x in levels[k]:
            if found >= 2 * k:
                return found
            found = max(found, max(_hops(near, x).values()))
    return found


def scaling_ratios(source_nm: Column, target_nm: Column) -> Column:
    """Ratios of sizes, capacitance, resistance, supply and speed from one technology to a smaller or larger one; half the
    size where one of them is unknown."""
    a = F.when((source_nm > 0) & (target_nm > 0), target_nm / source_nm).otherwise(0.5)
    parts = {"l_ratio": a, "w_ratio": a, "c_ratio": a * a, "r_ratio": 1 / a, "vdd_ratio": F.pow(a, F.lit(0.3)), "idsat_ratio": 1 / a, "ft_ratio": 1 / a}
    return F.struct(*[x.alias(n) for n, x in parts.items()])
