"""Whitening of integer embeddings with an exact covariance.

Elements become integers, floor(256 * c). Products of integers are split into limbs of 20 bits: a block of at most 8192
rows then has float64 products below 2^53, so BLAS gives them exactly. The products of limbs are put together as big
integers (digit arrays with carries), the sums of all tasks are merged eight at a time, and n * sum(x x') - S S' is the
n^2-fold covariance without any rounding, however far the vectors lie from zero. Its eigenvectors are found in double
precision and refined in extended precision.

The covariance covers each distinct integer vector once; equal ones are dropped before the shuffle, so a vector that a
third of all rows hold costs one row a task. Every usable row is whitened.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries go; rows with a null id and repeated
rows stay, each on its own; components whose variance is below 1e-14 of the largest are constant but for rounding and
are left out, so equal vectors or fewer than two distinct ones give no rows; vectors of different lengths raise;
deviations of more than 38 digits are null; columns other than id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, input_partitions, materialise, small_batches, struct_map
from .vectors import integers, usable

#: Bits of a limb, rows of a block (2 * LIMB + log2(BLOCK) <= 53), partial sums merged at once.
LIMB, BLOCK, FAN_IN = 20, 8192, 8
LEAST_SHARE = 1e-14


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of limb k times 2^(LIMB k), as float64; the last limb has the sign."""
    out, rest = [], x
    while rest.size and (rest.max() >= 1 << LIMB or rest.min() < -(1 << LIMB)):
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    return [*out, rest.astype(np.float64)]


def carry(digits: list[np.ndarray]) -> list[np.ndarray]:
    """Digits of base 2^LIMB kept small enough that sums of a few stay in 64 bits."""
    k = 0
    while k < len(digits):
        if digits[k].size and np.abs(digits[k]).max() > 1 << 40:
            up = digits[k] >> LIMB
            digits[k] = digits[k] - (up << LIMB)
            if k + 1 == len(digits):
                digits.append(np.zeros_like(up))
            digits[k + 1] = digits[k + 1] + up
        k += 1
    return digits


def added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    if len(a) < len(b):
        a, b = b, a
    return carry([x + b[k] if k < len(b) else x for k, x in enumerate(a)])


def gram(x: np.ndarray) -> list[np.ndarray]:
    """Digits of x' x for integers x of at most BLOCK rows."""
    parts = limbs(x)
    out = [np.zeros((x.shape[1], x.shape[1]), dtype=np.int64) for _ in range(2 * len(parts) - 1)]
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            p = (a.T @ parts[j]).astype(np.int64)
            out[i + j] += p if i == j else p + p.T
    return carry(out)


def column_sums(x: np.ndarray) -> list[np.ndarray]:
    return carry([p.sum(axis=0).astype(np.int64) for p in limbs(x)])


def whole(digits: list[np.ndarray]) -> np.ndarray:
    """The big integers themselves, as an array of Python ints."""
    out = np.zeros(digits[0].shape, dtype=object)
    for k, d in enumerate(digits):
        out = out + (d.astype(object) << (LIMB * k) if k else d.astype(object))
    return out


PARTIAL = "part long, dim int, n long, s binary, g binary"


def _frame(part: int, n: int, s: list[np.ndarray], g: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "dim": [len(s[0])], "n": [n], "s": [np.stack(s).tobytes()], "g": [np.stack(g).tobytes()]})


def _digits(raw: bytes, *shape: int) -> list[np.ndarray]:
    return list(np.frombuffer(raw, dtype=np.int64).reshape(-1, *shape))


def same_length(dims) -> int:
    if len(found := {int(d) for d in dims}) > 1:
        raise ValueError(f"vectors of one length are needed, not of {sorted(found)[:5]}")
    return found.pop()


def matrix_of(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as one matrix."""
    dim = same_length(np.unique(np.diff(column.offsets.to_numpy())))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, s, g = 0, None, None
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            x = matrix_of(batch.column(0).slice(at, BLOCK))
            if s is not None:
                same_length((len(s[0]), x.shape[1]))
            s, g = (column_sums(x), gram(x)) if s is None else (added(s, column_sums(x)), added(g, gram(x)))
            n += len(x)
    if n:
        yield pa.RecordBatch.from_pandas(_frame(TaskContext.get().partitionId(), n, s, g), schema=pa.schema([("part", pa.int64()), ("dim", pa.int32()), ("n", pa.int64()), ("s", pa.binary()), ("g", pa.binary())]))


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    d = same_length(pdf["dim"].unique())
    s, g = _digits(pdf["s"].iloc[0], d), _digits(pdf["g"].iloc[0], d, d)
    for a, b in zip(pdf["s"].iloc[1:], pdf["g"].iloc[1:]):
        s, g = added(s, _digits(a, d)), added(g, _digits(b, d, d))
    return _frame(int(pdf["part"].iloc[0]) // FAN_IN, int(pdf["n"].sum()), s, g)


@dataclass
class Whitening:
    """n vectors, their sums, the components (columns) with variances e, and the trace of the covariance."""

    n: int
    sums: np.ndarray  # Python ints
    axes: np.ndarray
    e: np.ndarray
    trace: float


def refined(v: np.ndarray, low: np.ndarray, steps: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of v + low: found in double precision, then corrected in extended
    precision by the first-order terms of residual and orthogonality."""
    found, x = np.linalg.eigh(v)
    a, x = v.astype(np.longdouble) + low.astype(np.longdouble), x.astype(np.longdouble)
    d, e = len(v), found.astype(np.longdouble)
    for _ in range(steps):
        off, s = np.eye(d, dtype=np.longdouble) - x.T @ x, x.T @ a @ x
        e = np.diag(s) / (1 - np.diag(off))
        gap = e[None, :] - e[:, None]
        near = np.abs(gap) <= 4 * np.finfo(np.float64).eps * np.abs(e).max()
        turn = np.where(near, off / 2, (s + e[None, :] * off) / np.where(near, 1, gap))
        x = x + x @ turn
    x = x / np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-e, kind="stable")
    return e[order], x[:, order]


def decomposed(n: int, s: np.ndarray, g: np.ndarray, components: int) -> Whitening:
    """From exact sums; the only rounding is that of the finished covariance."""
    exact = n * g - np.outer(s, s)
    square = n * n
    high = np.array([[x / square for x in row] for row in exact], dtype=np.float64)
    low = np.array([[float(Fraction(x, square) - Fraction(h)) for x, h in zip(*rows)] for rows in zip(exact, high.tolist())], dtype=np.float64)
    trace = sum(exact.diagonal().tolist()) / square
    e, axes = refined(high, low) if trace > 0 else (np.zeros(0), np.zeros((len(s), 0)))
    keep = min(components, int((e > LEAST_SHARE * e[:1]).sum()) if len(e) else 0)
    return Whitening(n, s, axes[:, :keep].astype(np.float64), e[:keep].astype(np.float64), trace)


def fit(distinct: DataFrame, components: int = 4) -> Whitening | None:
    """distinct (x) holds each integer vector once. One partial sum a task, merged eight at a time down to one."""
    small_batches(distinct.sparkSession)
    parts = input_partitions(distinct)
    sums = distinct.select("x").mapInArrow(_partials, PARTIAL)
    while parts > 1:
        sums = sums.groupBy(F.floor(F.col("part") / FAN_IN).alias("_of")).applyInPandas(_merged, PARTIAL)
        parts = -(-parts // FAN_IN)
    row = sums.mapInPandas(_decompose(components), SOLVED).first()
    if row is None:
        return None
    d = len(row["sums"])
    return Whitening(row["n"], np.array([int(s) for s in row["sums"]], dtype=object), np.frombuffer(bytes(row["axes"])).reshape(d, -1), np.array(row["e"]), row["trace"])


SOLVED = "n long, sums array<string>, axes binary, e array<double>, trace double"


def _decompose(components: int):
    """decomposed, in a task: there numpy runs one thread, and the driver holds no matrix but the components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                m = decomposed(r.n, whole(_digits(r.s, r.dim)), whole(_digits(r.g, r.dim, r.dim)), components)
                yield pd.DataFrame({"n": [m.n], "sums": [list(map(str, m.sums))], "axes": [m.axes.tobytes()], "e": [m.e.tolist()], "trace": [m.trace]})

    return run


def centred(x: np.ndarray, m: Whitening) -> np.ndarray:
    """n * x - S, exact: int64 where that is wide enough, else Python ints."""
    if m.n * int(max(-int(x.min()), int(x.max()), 0)) + max(map(abs, m.sums)) < 1 << 62:
        return m.n * x - m.sums.astype(np.int64)
    return m.n * x.astype(object) - m.sums


def squares(y: np.ndarray) -> list[int]:
    """Exact row sums of squares."""
    if y.dtype == object:
        return (y * y).sum(axis=1).tolist()
    if y.shape[1] * int(np.abs(y).max()) ** 2 < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    parts = [p.astype(np.int64) for p in limbs(y)]
    out = [0] * len(y)
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            sums = (a * parts[j]).sum(axis=1).tolist()
            out = [o + (t << (LIMB * (i + j) + (i < j))) for o, t in zip(out, sums)]
    return out


def _apply(m: Whitening):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for xs in batches:
            if not len(xs):
                yield pd.DataFrame({"deviation": [], "whitened": []})
                continue
            y = centred(np.stack(xs.to_list()), m)
            z = (y / m.n).astype(np.float64) @ m.axes / np.sqrt(m.e)
            yield pd.DataFrame({"deviation": list(map(str, squares(y))), "whitened": list(z)})

    return run


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: the id, component (int, from 1), n, deviation (decimal), whitened,
    explained, identity_error."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(vector_col)).select(F.col(id_col).alias("vec_id"), integers(vector_col).alias("x"))
    distinct = materialise(rows.select("x").distinct(), "distinct-vectors")
    m = fit(distinct, components)
    head = "vec_id, cast(null as int) component, cast(null as long) n, cast(null as decimal(38,0)) deviation, cast(null as double) whitened, cast(null as double) explained, cast(null as double) identity_error"
    if m is None or not len(m.e):
        discard(distinct)
        return rows.selectExpr(*head.split(", ")).limit(0)
    made = struct_map(spark, _apply(m), "deviation string, whitened array<double>")
    seen = distinct.select(made("x").alias("w")).select([F.col("w.whitened")[k].alias(f"w{k}") for k in range(len(m.e))])
    pairs = [(i, j) for i in range(len(m.e)) for j in range(i, len(m.e))]
    spread = seen.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(spread[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    discard(distinct)
    per = F.posexplode("w.whitened").alias("_k", "whitened")
    share = F.array(*[F.lit(float(e / m.trace)) for e in m.e])
    out = rows.select("vec_id", made("x").alias("w")).select("vec_id", F.expr("try_cast(w.deviation as decimal(38,0))").alias("deviation"), per)
    return out.select("vec_id", (F.col("_k") + 1).cast("int").alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("_k") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))
