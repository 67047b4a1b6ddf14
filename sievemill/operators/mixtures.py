"""Splits of states by what their samples hold: two means, and Gaussian mixtures with the number chosen by BIC.

All states, and for mixtures all numbers of components, are fitted in the same rounds: a round is one pass over the
rows that leaves sums by state and cluster, from which the next means (and covariances) follow. Starts are fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.session import cut

from .cuts import SIZE

#: Bytes of parameters sent with a round, and tasks whose sums are merged in the first step.
MODEL_BYTES, TASKS = 32 << 20, 64


def two_means(rows: DataFrame, features: list[str], rounds: int = 20) -> DataFrame:
    """rows (state, features): state, n, variance (over all features together) and the centres low and high, arrays of
    the features. It starts with the samples up to the mean and above it of the feature that varies most, and ends when
    no centre moves. States whose samples are all alike have no high centre."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = rows.select("state", x.alias("x")).filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    d = len(features)
    stats = rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("x")[i]) for i in range(d)]).alias("mean"), F.array(*[F.var_pop(F.col("x")[i]) for i in range(d)]).alias("var"))
    grand = F.aggregate("mean", F.lit(0.0), lambda s, v: s + v) / d
    spread = F.aggregate("var", F.lit(0.0), lambda s, v: s + v) / d + F.aggregate("mean", F.lit(0.0), lambda s, v: s + (v - grand) * (v - grand)) / d
    widest = (F.array_position("var", F.array_max("var")) - 1).cast("int")
    stats = cut(stats.select("state", "n", "mean", spread.alias("variance"), widest.alias("widest")))
    above = F.get("x", F.col("widest")) > F.get("mean", F.col("widest"))
    sides = rows.join(stats.select("state", "mean", "widest"), "state").select("state", "x", above.cast("int").alias("side"))

    def centres(labelled: DataFrame) -> DataFrame:
        one = labelled.groupBy("state", "side").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(d)]).alias("c"))
        return cut(one.groupBy("state").agg(F.max(F.when(F.col("side") == 0, F.col("c"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("high")))

    now = centres(sides)
    for _ in range(rounds):
        before, now = now, centres(assigned(rows, now).select("state", "x", "side"))
        moved = now.join(before.select("state", F.col("low").alias("l"), F.col("high").alias("h")), "state").filter(~F.col("low").eqNullSafe(F.col("l")) | ~F.col("high").eqNullSafe(F.col("h")))
        if not moved.limit(1).count():
            break
    return stats.select("state", "n", "variance").join(now, "state")


def assigned(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows (state, x) with side: 1 where the high centre is nearer, else 0."""
    far = lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    side = F.when(F.col("high").isNotNull() & (far("high") < far("low")), 1).otherwise(0)
    return rows.join(centres.select("state", "low", "high"), "state").withColumn("side", side)


def split_states(samples: DataFrame, features: list[str], least: int = 10, variance: float = 0.01, changes: float = 0.1, rounds: int = 20) -> DataFrame:
    """samples (run_key, idx, state, features): state, n, variance, low, high, changes and accepted. A state is split in
    two where it has enough samples, varies enough, and the side changes between its samples (one after another within
    runs) in fewer than that share of them."""
    found = two_means(samples, features, rounds)
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = samples.select("run_key", "idx", "state", x.alias("x")).filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    told = assigned(rows, found).select("state", "run_key", "idx", "side", F.floor(F.col("idx") / SIZE).alias("piece"))
    by = Window.partitionBy("state", "run_key", "piece").orderBy("idx")
    inner = told.withColumn("turn", (F.col("side") != F.lag("side").over(by)).cast("int"))
    pieces = inner.groupBy("state", "run_key", "piece").agg(F.sum("turn").alias("turns"), F.min_by("side", "idx").alias("first"), F.max_by("side", "idx").alias("last"))
    seam = F.coalesce((F.col("first") != F.lag("last").over(Window.partitionBy("state", "run_key").orderBy("piece"))).cast("int"), F.lit(0))
    turns = pieces.withColumn("seam", seam).groupBy("state").agg(F.sum(F.coalesce("turns", F.lit(0)) + F.col("seam")).alias("changes"))
    good = (F.col("n") >= least) & (F.col("variance") >= variance) & F.col("high").isNotNull() & (F.col("changes") < changes * F.col("n"))
    return found.join(turns, "state").select("state", "n", "variance", "low", "high", "changes", good.alias("accepted"))


# --- Gaussian mixtures


class Mixture:
    """Weights, means and covariances of k components."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray):
        self.weight, self.mean, self.cov = weight, mean, cov
        self.half = np.linalg.inv(np.linalg.cholesky(cov))
        self.shift = np.log(weight) + np.log(np.abs(np.diagonal(self.half, axis1=1, axis2=2))).sum(axis=1) - mean.shape[1] / 2 * np.log(2 * np.pi)

    def joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, rows by components."""
        z = np.einsum("kij,nkj->nki", self.half, x[:, None, :] - self.mean[None])
        return self.shift - (z * z).sum(axis=2) / 2


def log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]


def sums_of(x: np.ndarray, share: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By component: its weight, and sums of x - at and of their products."""
    y = x - at
    return np.concatenate([share.sum(axis=0)[:, None], share.T @ y, np.einsum("nk,ni,nj->kij", share, y, y).reshape(share.shape[1], -1)], axis=1)


def from_sums(sums: np.ndarray, at: np.ndarray, floor: float) -> Mixture:
    d = len(at)
    n = sums[:, 0] + 10 * np.finfo(float).eps
    mean = sums[:, 1 : 1 + d] / n[:, None]
    cov = sums[:, 1 + d :].reshape(-1, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :] + floor * np.eye(d)
    return Mixture(n / n.sum(), mean + at, cov)


def bic(loglik: float, n: int, k: int, d: int) -> float:
    return -2 * loglik + np.log(n) * (k - 1 + k * d + k * d * (d + 1) / 2)


SUMS = "state string, k int, part int, width int, loglik double, sums binary"


def _expect(models: dict, starts: dict):
    """Sums of a task's rows by state and number of components, under the models, or by the first cuts (starts: the
    widest feature, edges by k, and a middle of the state)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in batches:
            for state, own in pdf.groupby("state"):
                x = np.stack(own["x"].to_list())
                widest, edges, at = starts[state]
                for k, cuts in edges.items():
                    if models:
                        if (state, k) not in models:
                            continue
                        a = models[state, k].joint(x)
                        total = log_sum(a)
                        share, fit = np.exp(a - total[:, None]), float(total.sum())
                    else:
                        share, fit = np.eye(k)[np.searchsorted(cuts, x[:, widest])], 0.0
                    s = held.setdefault((state, k), [0.0, 0.0])
                    s[0] += fit
                    s[1] = s[1] + sums_of(x, share, at)
        part = TaskContext.get().partitionId() // TASKS
        yield pd.DataFrame([(s, k, part, v.shape[1], f, v.tobytes()) for (s, k), (f, v) in held.items()], columns=[c.split()[0] for c in SUMS.split(", ")])

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    v = sum(np.frombuffer(s).reshape(-1, w) for s, w in zip(pdf["sums"], pdf["width"]))
    return pdf.iloc[:1].assign(part=0, loglik=pdf["loglik"].sum(), sums=[v.tobytes()])


def _totals(rows: DataFrame, models: dict, starts: dict) -> dict:
    one = rows.mapInPandas(_expect(models, starts), SUMS)
    for keys in (["state", "k", "part"], ["state", "k"]):
        one = one.groupBy(*keys).applyInPandas(_added, SUMS)
    return {(r["state"], r["k"]): (r["loglik"], np.frombuffer(bytes(r["sums"])).reshape(-1, r["width"])) for r in one.collect()}


def fit_mixtures(rows: DataFrame, features: list[str], most: int = 8, rounds: int = 40, tolerance: float = 1e-3, floor: float = 1e-6, least: int = 10) -> dict[str, tuple[Mixture, float]]:
    """rows (state, features): for each state of `least` samples or more the mixture of 2 to `most` components (a fifth
    of the samples at most) with the lowest BIC, and that. Components start with equal shares of the samples by the
    feature that varies most; a fit ends when the mean log-likelihood rises by less than the tolerance. Parameters, a
    few numbers a state, go through the driver; where those of all states are more than MODEL_BYTES, states are fitted
    in groups, a loop of rounds each."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = rows.select(F.col("state").cast("string").alias("state"), x.alias("x")).filter(F.col("state").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows, d = cut(rows), len(features)
    states = rows.select("state").distinct().count()
    each = sum(range(2, most + 1)) * (1 + d + d * d) * 8 + 8 * most * most
    groups = max(1, -(-states * each // MODEL_BYTES))
    out: dict[str, tuple[Mixture, float]] = {}
    for g in range(groups):
        own = rows.filter(F.pmod(F.xxhash64("state"), F.lit(groups)) == g) if groups > 1 else rows
        stats = own.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("x")[i]) for i in range(d)]).alias("mean"), F.array(*[F.var_pop(F.col("x")[i]) for i in range(d)]).alias("var"), F.array(*[F.percentile_approx(F.col("x")[i], [j / 840 for j in range(1, 840)], 10_000) for i in range(d)]).alias("cuts"))
        starts, size = {}, {}
        for r in stats.filter(F.col("n") >= least).collect():
            widest = int(np.argmax(r["var"]))
            size[r["state"]] = r["n"]
            starts[r["state"]] = widest, {k: np.array([r["cuts"][widest][round(840 * j / k) - 1] for j in range(1, k)]) for k in range(2, min(most, r["n"] // 5 + 1) + 1)}, np.array(r["mean"])
        if not starts:
            continue
        own = own.filter(F.col("state").isin(list(starts))) if len(starts) < 1000 else own.join(stats.filter(F.col("n") >= least).select("state"), "state", "left_semi")
        models: dict = {}
        level: dict = {}
        done: dict = {}
        for turn in range(rounds + 1):
            asked = {k: m for k, m in models.items() if k not in done}
            if turn and not asked:
                break
            for key, (fit, sums) in _totals(own, asked, starts).items():
                state, k = key
                mean = fit / size[state]
                if turn and (abs(mean - level.get(key, -np.inf)) < tolerance or turn == rounds):
                    done[key] = models[key], bic(fit, size[state], k, d)
                    continue
                if turn:
                    level[key] = mean
                try:
                    models[key] = from_sums(sums, starts[state][2], floor)
                except np.linalg.LinAlgError:
                    done[key] = None
        for (state, _), found in done.items():
            if found and (state not in out or found[1] < out[state][1]):
                out[state] = found
    return out


def mixture_states(samples: DataFrame, features: list[str], most: int = 8) -> DataFrame:
    """samples with component (from 0, by the mean of the first feature) and components (how many the state has; one
    where it has too few samples); rows with a missing feature have no component."""
    models = {s: m for s, (m, _) in fit_mixtures(samples, features, most).items()}
    order = {s: np.argsort(np.argsort(m.mean[:, 0], kind="stable"), kind="stable") for s, m in models.items()}

    @F.pandas_udf("component int, components int")
    def told(state: pd.Series, x: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"component": np.zeros(len(x), dtype="int32"), "components": np.ones(len(x), dtype="int32")})
        for s in state.dropna().unique():
            if s in models:
                at = np.flatnonzero((state == s).to_numpy())
                out.iloc[at, 0] = order[s][models[s].joint(np.stack(x.iloc[at].to_list())).argmax(axis=1)]
                out.iloc[at, 1] = len(models[s].weight)
        return out

    x = F.array(*[F.col(f).cast("double") for f in features])
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    zero = F.array(*[F.lit(0.0)] * len(features))
    made = told(F.col("state").cast("string"), F.when(fit, x).otherwise(zero))
    return samples.withColumn("_m", made).withColumns({"component": F.when(fit, F.col("_m.component")), "components": F.col("_m.components")}).drop("_m")
