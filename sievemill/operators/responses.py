"""Vector fitting of frequency responses.

Networks of at most WHOLE rows are fitted one by one in tasks, with all rounds. For larger ones each relocation of the
poles is one pass over the rows: the weighted rows of a network are reduced to the triangle of their QR factors, batch by batch in the tasks and then in
two steps over the cluster, so a network of any number of frequencies is many tasks' work and only triangles of a few
columns meet. Where the poles move next, and at the end the residues, is a least-squares problem of such a triangle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.functions.session import cut

from .cuts import WHOLE, by_length, run_by_run
from .kernels import relocated, residues_of, start_poles, vector_fit, weighted_rows

#: Triangles that a task holds before it hands them on, and tasks whose triangles are merged in the first step.
HELD, TASKS = 1000, 64
POLES = "network string, re array<double>, im array<double>"


def _triangle(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a, mode="r")


def _reduce(relocate: bool):
    """Triangles of [basis, 1, -basis h | h] (to relocate) or [basis, 1 | h] over the rows that a task has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        part = TaskContext.get().partitionId() // TASKS

        def out() -> pd.DataFrame:
            rows = [(k, part, r.shape[1], r.tobytes()) for k, r in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["network", "part", "width", "r"])

        for pdf in batches:
            for network, own in pdf.groupby("network"):
                poles = np.array(own["pole_re"].iloc[0]) + 1j * np.array(own["pole_im"].iloc[0])
                a = weighted_rows(1j * own["w"].to_numpy(), own["re"].to_numpy() + 1j * own["im"].to_numpy(), poles, relocate)
                held[network] = _triangle(np.vstack([held[network], a]) if network in held else a)
            if len(held) >= HELD:
                yield out()
        yield out()

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [np.frombuffer(r).reshape(-1, w) for r, w in zip(pdf["r"], pdf["width"])]
    r = _triangle(np.vstack(rows))
    return pd.DataFrame({"network": pdf["network"].iloc[:1], "part": [0], "width": [r.shape[1]], "r": [r.tobytes()]})


TRIANGLE = "network string, part int, width int, r binary"


def triangles(rows: DataFrame, poles: DataFrame, relocate: bool) -> DataFrame:
    """network, re and im of its poles, width and r of its triangle."""
    named = rows.join(poles.select("network", F.col("re").alias("pole_re"), F.col("im").alias("pole_im")), "network")
    one = named.mapInPandas(_reduce(relocate), TRIANGLE)
    for keys in (["network", "part"], ["network"]):
        one = one.groupBy(*keys).applyInPandas(_merge, TRIANGLE)
    return poles.join(one.select("network", "width", "r"), "network")


def _moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for x in pdf.itertuples():
            poles = np.array(x.re) + 1j * np.array(x.im)
            new = relocated(np.frombuffer(x.r).reshape(-1, x.width), poles)
            new = new if len(new) == len(poles) else poles
            out.append((x.network, new.real.tolist(), new.imag.tolist()))
        yield pd.DataFrame(out, columns=["network", "re", "im"])


def _rows_of(network: str, poles: np.ndarray, res: np.ndarray, const: float) -> list[tuple]:
    order = np.lexsort((poles.imag, -poles.real))
    return [(network, k, float(poles[j].real), float(poles[j].imag), float(res[j].real), float(res[j].imag), const) for k, j in enumerate(order)]


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for x in pdf.itertuples():
            poles = np.array(x.re) + 1j * np.array(x.im)
            res, const = residues_of(np.frombuffer(x.r).reshape(-1, x.width), poles)
            out += _rows_of(x.network, poles, res, const)
        yield pd.DataFrame(out, columns=FITTED_COLUMNS)


FITTED = "network string, k int, re double, im double, residue_re double, residue_im double, constant double"
FITTED_COLUMNS = [c.split()[0] for c in FITTED.split(", ")]


def _fit_whole(rows: DataFrame, order: int, rounds: int) -> DataFrame:
    """fit_responses for networks that fit an array each."""

    def fitted(pdf: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
        w, h, out = pdf["w"].to_numpy(), pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy(), []
        for a, b in zip(ends, ends[1:]):
            if b - a >= order:
                out += _rows_of(pdf["network"].iloc[a], *vector_fit(1j * w[a:b], h[a:b], order, rounds))
        return pd.DataFrame(out, columns=FITTED_COLUMNS)

    return run_by_run(rows, "network", "w", fitted, FITTED)


def fit_responses(rows: DataFrame, order: int, rounds: int = 12, most: int = WHOLE) -> DataFrame:
    """rows (network string, w, re, im; w > 0): network, k, re and im of its poles, residue_re, residue_im and constant.
    Unstable poles are mirrored; rows are weighted by 1 / |h|; rows with a missing value are left out, and so are
    networks with fewer rows than the order. Networks of more than `most` rows are fitted by passes over their rows."""
    rows = rows.select("network", *[F.col(c).cast("double").alias(c) for c in ("w", "re", "im")]).na.drop()
    whole, large = by_length(rows, "network", most)
    found = _fit_whole(whole, order, rounds)
    return found if large is None else found.union(_fit_by_passes(cut(large), order, rounds))


def _fit_by_passes(rows: DataFrame, order: int, rounds: int) -> DataFrame:
    """fit_responses for networks of any number of rows."""
    span = rows.groupBy("network").agg(F.min(F.abs("w")).alias("low"), F.max(F.abs("w")).alias("top"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= order)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [start_poles(a, b, order) for a, b in zip(pdf["low"], pdf["top"])]
            yield pd.DataFrame({"network": pdf["network"], "re": [p.real.tolist() for p in made], "im": [p.imag.tolist() for p in made]})

    poles = cut(span.select("network", "low", "top").mapInPandas(first, POLES))
    for _ in range(rounds):
        poles = cut(triangles(rows, poles, True).mapInPandas(_moved, POLES))
    return triangles(rows, poles, False).mapInPandas(_told, FITTED)


def response_errors(rows: DataFrame, model: DataFrame) -> DataFrame:
    """network, n and the root mean square and largest error of the model, over the largest |h|."""
    terms = model.groupBy("network").agg(F.max("constant").alias("constant"), F.collect_list(F.struct("re", "im", "residue_re", "residue_im")).alias("poles"))
    j = rows.join(terms, "network")
    # r / (jw - p) = r conj(jw - p) / |jw - p|^2
    real = lambda p: (p["residue_re"] * -p["re"] + p["residue_im"] * (F.col("w") - p["im"])) / (p["re"] * p["re"] + (F.col("w") - p["im"]) * (F.col("w") - p["im"]))
    imag = lambda p: (p["residue_im"] * -p["re"] - p["residue_re"] * (F.col("w") - p["im"])) / (p["re"] * p["re"] + (F.col("w") - p["im"]) * (F.col("w") - p["im"]))
    off_re = F.aggregate("poles", F.col("constant") - F.col("re"), lambda s, p: s + real(p))
    off_im = F.aggregate("poles", -F.col("im"), lambda s, p: s + imag(p))
    e = j.select("network", F.hypot("re", "im").alias("size"), F.hypot(off_re, off_im).alias("off")).groupBy("network")
    return e.agg(F.count(F.lit(1)).alias("n"), (F.sqrt(F.avg(F.col("off") * F.col("off"))) / F.max("size")).alias("rms"), (F.max("off") / F.max("size")).alias("worst"))
