"""Numeric kernels that SQL cannot express: numpy inside grouped pandas functions, one small series a group.

Groups are runs, channels or networks and are spread over the cluster; the kernels keep their general numpy form so
that they can be tested without Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adc_dynamic(codes: np.ndarray, harmonics: int = 5, spread: int = 2) -> dict[str, float]:
    """SNR, SINAD, ENOB, THD and SFDR in dB of a sampled sine, by a Hann-windowed spectrum. A tone is the power of its
    bin and `spread` bins on both sides; harmonics 2 to `harmonics` fold at the Nyquist frequency, and the noise leaves
    out the bins of harmonics 1 to 9 and those around zero."""
    n = len(codes)
    power = np.abs(np.fft.rfft((codes - codes.mean()) * np.hanning(n))) ** 2
    bins = np.arange(len(power))
    tone = int(np.argmax(power[spread + 1 :])) + spread + 1

    def around(k: int) -> np.ndarray:
        folded = k * tone % n
        return np.abs(bins - min(folded, n - folded)) <= spread

    low = bins <= spread
    signal = power[around(1)].sum()
    taken = around(1) | low
    distortion = 0.0
    for k in range(2, harmonics + 1):
        own = around(k) & ~taken
        distortion += power[own].sum()
        taken |= own
    quiet = ~low & ~np.any([around(k) for k in range(1, 10)], axis=0)
    noise = max(power[quiet].sum(), 1e-30)
    spur = max(power[~around(1) & ~low].max(), 1e-30)
    db = lambda a, b: float(10 * np.log10(max(a, 1e-30) / max(b, 1e-30)))
    sinad = db(signal, noise + distortion)
    return {"snr": db(signal, noise), "sinad": sinad, "enob": (sinad - 1.76) / 6.02, "thd": db(distortion, signal), "sfdr": db(power[tone], spur)}


def savgol(y: np.ndarray, window: int, order: int = 2, derivative: int = 0) -> np.ndarray:
    """Savitzky-Golay smoothing or derivative (per sample): least-squares polynomials over a sliding window, those of
    the first and last full window reaching to the ends. Missing values are filled linearly by position first."""
    y = np.asarray(y, dtype=float)
    ok = np.isfinite(y)
    if not ok.any():
        return np.full(len(y), np.nan)
    y = np.interp(np.arange(len(y)), np.flatnonzero(ok), y[ok])
    window = min(window, len(y) - 1 + len(y) % 2)
    if window <= order:
        return y if derivative == 0 else np.gradient(y) if len(y) > 1 else np.zeros(len(y))
    half = window // 2
    x = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True))

    def at(coefs: np.ndarray, where: np.ndarray) -> np.ndarray:
        p = np.polynomial.Polynomial(coefs)
        return (p.deriv(derivative) if derivative else p)(where)

    out = np.empty(len(y))
    scale = float(np.prod(np.arange(1, derivative + 1))) if derivative else 1.0
    out[half : len(y) - half] = np.convolve(y, (fit[derivative] * scale)[::-1], "valid")
    out[:half] = at(fit @ y[:window], x[:half])
    out[len(y) - half :] = at(fit @ y[-window:], x[half + 1 :])
    return out


def smoothing_window(n: int) -> int:
    """An odd twentieth of the samples, five at least."""
    return max(5, n // 20 // 2 * 2 + 1)


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least total cost (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner, back = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while owner[j0]:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = now < least[free]
            least[free[better]], back[free[better]] = now[better], j0
            j1 = free[np.argmin(least[free])]
            step = least[j1]
            u[owner[used]] += step
            v[used] -= step
            least[free] -= step
            j0 = j1
        while j0:
            owner[j0], j0 = owner[back[j0]], back[j0]
    out = np.zeros(n, dtype=int)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def match_poles(a: np.ndarray, b: np.ndarray, pad: float = 1e12) -> list[tuple[int, int]]:
    """Pairs of poles with the least total distance; surplus poles stay unpaired."""
    k = max(len(a), len(b))
    cost = np.full((k, k), pad)
    cost[: len(a), : len(b)] = np.abs(a[:, None] - b[None, :])
    return [(i, int(j)) for i, j in enumerate(assign(cost)) if i < len(a) and j < len(b)]


def poles_of_roots(roots: np.ndarray, dt: float) -> np.ndarray:
    """Continuous-time poles of discrete roots, conjugate pairs exactly so, by falling real part."""
    p = np.log(roots[np.abs(roots) > 1e-12].astype(complex)) / dt
    p = np.where(np.abs(p.imag) < 1e-9 * np.maximum(1, np.abs(p)), p.real + 0j, p)
    return p[np.lexsort((p.imag, -p.real))]


def prony(y: np.ndarray, dt: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Poles and residues of a free response as a sum of exponentials: linear prediction, its roots, then amplitudes."""
    n = len(y)
    rows = np.column_stack([y[order - 1 - k : n - 1 - k] for k in range(order)])
    coefs = np.linalg.lstsq(rows, y[order:], rcond=None)[0]
    poles = poles_of_roots(np.roots(np.r_[1, -coefs]), dt)
    basis = np.exp(np.outer(np.arange(n) * dt, poles))
    return poles, np.linalg.lstsq(basis, y.astype(complex), rcond=None)[0]


def era(y: np.ndarray, dt: float, order: int | None = None, knee: float = 1e-3) -> np.ndarray:
    """Poles by the eigensystem realization algorithm from impulse samples; the order defaults to the first singular
    value under `knee` of the largest."""
    k = (len(y) - 1) // 2
    h0 = np.array([y[i + 1 : i + 1 + k] for i in range(k)])
    h1 = np.array([y[i + 2 : i + 2 + k] for i in range(k - 1)])
    u, s, vt = np.linalg.svd(h0[: k - 1], full_matrices=False)
    r = order or max(1, int(np.argmax(np.append(s / s[0], 0) < knee)))
    root = np.sqrt(s[:r])
    a = (u[:, :r] / root).T @ h1 @ (vt[:r] / root[:, None]).T
    return poles_of_roots(np.linalg.eigvals(a), dt)


def arx(u: np.ndarray, y: np.ndarray, dt: float, order: int) -> np.ndarray:
    """Poles of y[n] = sum a_k y[n-k] + sum b_k u[n-k] fitted by least squares."""
    n = len(y)
    past = np.column_stack([*(y[order - k : n - k] for k in range(1, order + 1)), *(u[order - k : n - k] for k in range(order + 1))])
    coefs = np.linalg.lstsq(past, y[order:], rcond=None)[0]
    return poles_of_roots(np.roots(np.r_[1, -coefs[:order]]), dt)


def start_poles(low: float, top: float, order: int) -> np.ndarray:
    """Weakly damped pairs spread over the frequencies, and for odd orders one real pole."""
    low = max(low, top * 1e-3)
    pairs = lambda betas: [p for b in betas for p in (-b / 100 + 1j * b, -b / 100 - 1j * b)]
    if order % 2:
        beta = np.geomspace(low, top, order // 2 + 1)
        return paired(np.array([-beta[0] + 0j, *pairs(beta[1:])]))
    return paired(np.array(pairs(np.geomspace(low, top, order // 2))))


def is_pair(p: complex) -> bool:
    return abs(p.imag) > 1e-9 * abs(p)


def paired(p: np.ndarray) -> np.ndarray:
    """Real poles, then conjugate pairs side by side."""
    up = p[p.imag > 1e-9 * np.abs(p)]
    real = p[np.abs(p.imag) <= 1e-9 * np.abs(p)].real
    return np.r_[real.astype(complex), *(q for x in up for q in (x, x.conjugate()))]


def pole_basis(s: np.ndarray, poles: np.ndarray) -> np.ndarray:
    """A column a pole, so that real coefficients give real responses."""
    cols, k = [], 0
    while k < len(poles):
        p = poles[k]
        if is_pair(p):
            a, b = 1 / (s - p), 1 / (s - p.conjugate())
            cols += [a + b, 1j * (a - b)]
            k += 2
        else:
            cols.append(1 / (s - p.real))
            k += 1
    return np.column_stack(cols)


def weighted_rows(s: np.ndarray, h: np.ndarray, poles: np.ndarray, relocate: bool) -> np.ndarray:
    """Real rows [basis, 1, -basis h | h] to relocate poles, or [basis, 1 | h] for residues, weighted by 1 / |h|."""
    f, one = pole_basis(s, poles), np.ones(len(s))
    m = np.column_stack([f, one, -f * h[:, None], h] if relocate else [f, one, h]) / np.maximum(np.abs(h), 1e-30)[:, None]
    return np.r_[m.real, m.imag]


def least_squares(rows: np.ndarray) -> np.ndarray:
    """Coefficients of the last column by the others, columns scaled to one."""
    a, b = rows[:, :-1], rows[:, -1]
    scale = np.maximum(np.linalg.norm(a, axis=0), 1e-300)
    return np.linalg.lstsq(a / scale, b, rcond=None)[0] / scale


def relocated(rows: np.ndarray, poles: np.ndarray) -> np.ndarray:
    """Poles moved to the zeros of the fitted weight; unstable ones are mirrored."""
    x = least_squares(rows)[len(poles) + 1 :]
    a, b, k = np.zeros((len(poles), len(poles))), np.zeros(len(poles)), 0
    while k < len(poles):
        p = poles[k]
        if is_pair(p):
            a[k : k + 2, k : k + 2] = [[p.real, p.imag], [-p.imag, p.real]]
            b[k] = 2
            k += 2
        else:
            a[k, k], b[k] = p.real, 1
            k += 1
    new = np.linalg.eigvals(a - np.outer(b, x)).astype(complex)
    return paired(np.where(new.real > 0, -new.real + 1j * new.imag, new))


def residues_of(rows: np.ndarray, poles: np.ndarray) -> tuple[np.ndarray, float]:
    x, out, k = least_squares(rows), np.zeros(len(poles), dtype=complex), 0
    while k < len(poles):
        if is_pair(poles[k]):
            out[k], out[k + 1] = x[k] + 1j * x[k + 1], x[k] - 1j * x[k + 1]
            k += 2
        else:
            out[k], k = x[k], k + 1
    return out, float(x[-1])


def vector_fit(s: np.ndarray, h: np.ndarray, order: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """Poles, residues and constant of h(s): poles are relocated to the zeros of a fitted weight, unstable ones are
    mirrored, and the residues come from a last linear fit. Rows are weighted by 1 / |h|."""
    poles = start_poles(np.abs(s).min(), np.abs(s).max(), order)
    for _ in range(rounds):
        new = relocated(weighted_rows(s, h, poles, True), poles)
        if len(new) != order:
            break
        poles = new
    out, const = residues_of(weighted_rows(s, h, poles, False), poles)
    return poles, out, const


def settles(t: np.ndarray, v: np.ndarray, settling: float, least: int = 5, rel: float = 0.01, eps: float = 1e-6) -> bool:
    """Whether a stretch stays for the settling time, and some end of it of `least` samples lies near its final level."""
    if len(v) < least or t[-1] - t[0] < settling:
        return False
    level = np.median(v[-max(3, len(v) // 5) :])
    return bool((np.abs(v[-least:] - level) <= rel * abs(level) + eps).all())


def transient(t: np.ndarray, v: np.ndarray, event: int, band: float = 0.01) -> dict[str, float]:
    """Undershoot, overshoot, settling time and ringing after sample `event`, against the mean of the last half before it."""
    before, after = v[event // 2 : event], v[event:]
    target = before.mean() if len(before) else v[0]
    off = np.abs(after - target) > band * max(abs(target), 1e-12)
    last = np.flatnonzero(off)
    sign = np.sign(after - target)
    sign = sign[sign != 0]
    settle = t[min(event + last[-1] + 1, len(t) - 1)] - t[event] if len(last) else 0.0
    return {"undershoot": float(max(0.0, target - after.min())), "overshoot": float(max(0.0, after.max() - target)), "settling": float(settle), "ringing": int((np.diff(sign) != 0).sum())}


def per_group(df: DataFrame, key: str, order: str, kernel, schema: str) -> DataFrame:
    """kernel(pdf sorted by `order`) -> dict or list of dicts, one call a group; a failing group gives its error as a row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        try:
            made = kernel(pdf)
            made = [made] if isinstance(made, dict) else made
            return pd.DataFrame([{key: pdf[key].iloc[0], **m, "error": None} for m in made], columns=names)
        except (ValueError, np.linalg.LinAlgError) as e:
            return pd.DataFrame([{key: pdf[key].iloc[0], "error": str(e)}], columns=names)

    kind = dict(df.dtypes)[key]
    full = f"{key} {kind}, {schema}, error string"
    names = [key, *(x.split()[0] for x in schema.split(", ")), "error"]
    return df.groupBy(key).applyInPandas(run, full)


def adc_metrics(samples: DataFrame) -> DataFrame:
    """adc_dynamic of each run_key over value; runs of fewer than 16 samples are errors."""

    def kernel(pdf: pd.DataFrame) -> dict:
        if len(pdf) < 16:
            raise ValueError("too few samples")
        return adc_dynamic(pdf["value"].to_numpy(dtype=float))

    return per_group(samples.select("run_key", "idx", "value"), "run_key", "idx", kernel, "snr double, sinad double, enob double, thd double, sfdr double")


def settled_islands(samples: DataFrame, settling: float, least: int = 5, rel: float = 0.01, eps: float = 1e-6) -> DataFrame:
    """stretch (run_key/island) and settled: settles() of each stretch of one state, as aggregates. The level is the
    median of the last fifth, three samples at least; a missing value among these or the last `least` is not settled."""
    from .sequence import with_islands

    key = ["run_key", "island"]
    rows = with_islands(samples).select(*key, "idx", "t", "value")
    ends = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("last"), F.min_by("t", "idx").alias("t0"), F.max_by("t", "idx").alias("t1"))
    tail = rows.join(ends, key).withColumn("back", F.col("last") - F.col("idx"))
    near = F.greatest(F.lit(3), F.floor(F.col("n") / 5))
    tail = tail.filter(F.col("back") < F.greatest(near, F.lit(least)))
    level = tail.groupBy(*key).agg(F.median(F.when(F.col("back") < near, F.col("value"))).alias("level"))
    off = tail.join(level, key).withColumn("far", (F.col("back") < least) & (F.abs(F.col("value") - F.col("level")) > rel * F.abs("level") + eps) | F.col("value").isNull() | F.isnan("value"))
    told = off.groupBy(*key).agg(F.max("far").alias("far"), F.first("n").alias("n"), (F.first("t1") - F.first("t0")).alias("span"))
    return told.select(F.concat_ws("/", *key).alias("stretch"), ((F.col("n") >= least) & (F.col("span") >= settling) & ~F.col("far")).alias("settled"))


def identify(series: DataFrame, method: str, order: int) -> DataFrame:
    """Poles of each network from rows (network, idx, dt, u, y), by prony, era or arx, over sums of lagged products."""
    from .lagged import identify as by_sums

    return by_sums(series, method, order)


def spectrum(x: np.ndarray, y: np.ndarray, fs: float, segment: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and transfer estimate y / x by averaged Hann-windowed segments that overlap by half."""
    n = min(segment, len(x))
    if len(x) < 64:
        raise ValueError("too few samples")
    w = np.hanning(n + 1)[:-1]
    sxx, sxy = np.zeros(n // 2 + 1), np.zeros(n // 2 + 1, dtype=complex)
    for k in range(0, len(x) - n + 1, n - n // 2):
        a, b = (np.fft.rfft((z[k : k + n] - z[k : k + n].mean()) * w) for z in (x, y))
        sxx += np.abs(a) ** 2
        sxy += a.conj() * b
    return np.fft.rfftfreq(n, 1 / fs), sxy / np.maximum(sxx, 1e-300)


class RadialSurrogate:
    """Gaussian radial basis interpolation of scaled inputs with a small ridge; falls back to a linear fit where the
    system is singular."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-8):
        self.mean, self.scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-8, x.std(axis=0), 1.0)
        self.z, self.y0 = (x - self.mean) / self.scale, y.mean()
        d = self._d(self.z)
        self.width = np.median(d[d > 0]) if (d > 0).any() else 1.0
        try:
            self.w = np.linalg.solve(np.exp(-d / self.width) + ridge * np.eye(len(x)), y - self.y0)
        except np.linalg.LinAlgError:
            self.w = None
            self.line = np.linalg.lstsq(np.column_stack([np.ones(len(x)), self.z]), y, rcond=None)[0]

    def _d(self, z: np.ndarray) -> np.ndarray:
        return ((z[:, None, :] - self.z[None, :, :]) ** 2).sum(axis=2)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        if self.w is None:
            return np.column_stack([np.ones(len(z)), z]) @ self.line
        return self.y0 + np.exp(-self._d(z) / self.width) @ self.w


def series_rlc_poles(r: float, l: float, c: float) -> np.ndarray:  # noqa: E741
    return np.sort_complex(np.roots([l * c, r * c, 1.0]))


def pole_sensitivity(params: dict[str, float], poles_of, step: float = 0.01) -> dict[str, np.ndarray]:
    """Finite differences of matched poles by each parameter, relative step."""
    base, out = poles_of(**params), {}
    for k, v in params.items():
        moved = poles_of(**params | {k: v * (1 + step)})
        pairs = dict(match_poles(base, moved))
        out[k] = np.array([(moved[pairs[i]] - base[i]) / (v * step) for i in range(len(base))])
    return out


def impulse_of(poles: np.ndarray, residues: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (np.exp(np.outer(t, poles)) @ residues).real


def sweep(spark, methods: list[str], noises: list[float], seeds: int, n: int = 300, dt: float = 0.02) -> DataFrame:
    """Pole error of each method on seeded noisy responses, one row a combination; a failure is a row with its text."""
    grid = spark.createDataFrame([(f"{m}/{x}/{s}", m, x, s) for m in methods for x in noises for s in range(seeds)], "run string, method string, noise double, seed int")
    truth = np.array([-0.5 + 6j, -0.5 - 6j, -3.0])

    def kernel(pdf: pd.DataFrame) -> dict:
        row = pdf.iloc[0]
        rng = np.random.default_rng(int(row["seed"]))
        t = np.arange(n) * dt
        y = impulse_of(truth, np.array([1, 1, 1.5]), t)
        y = y + rng.normal(size=n) * row["noise"] * y.std()
        found = {"prony": lambda: prony(y, dt, 3)[0], "era": lambda: era(y, dt, 3)}.get(row["method"])
        if found is None:
            raise ValueError(f"unsupported method {row['method']}")
        p = found()
        return {"pole_error": float(max(min(abs(p - q)) / abs(q) for q in truth))}

    return grid.join(per_group(grid, "run", "run", kernel, "pole_error double"), "run").drop("run")
