"""Synthetic inputs from `range` and built-in functions, the same for the same seed."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions.scalar import TECHNOLOGIES

PI2 = 6.283185307179586


def time_base(spark: SparkSession, n: int, dt: float) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("idx"), (F.col("id") * dt).alias("t"))


def excitation(spark: SparkSession, kind: str, n: int, dt: float, f0: float = 1.0, f1: float = 10.0, tones: int = 4, seed: int = 0) -> DataFrame:
    """step, ramp, impulse, chirp (linear from f0 to f1), multitone (tones from f0 to f1) or prbs (+1 and -1)."""
    t, end = F.col("t"), max(n - 1, 1) * dt
    forms = {
        "step": lambda: F.when(F.col("idx") > 0, 1.0).otherwise(0.0),
        "ramp": lambda: t / end,
        "impulse": lambda: F.when(F.col("idx") == 0, 1.0 / dt).otherwise(0.0),
        "chirp": lambda: F.sin(PI2 * (f0 * t + (f1 - f0) / (2 * end) * t * t)),
        "multitone": lambda: sum(F.sin(PI2 * (f0 + (f1 - f0) * k / max(tones - 1, 1)) * t) for k in range(tones)) / tones,
        "prbs": lambda: F.when(F.pmod(F.xxhash64(F.col("idx"), F.lit(seed)), F.lit(2)) == 0, 1.0).otherwise(-1.0),
    }
    return time_base(spark, n, dt).withColumn("value", forms[kind]())


def latin_hypercube(spark: SparkSession, bounds: dict[str, tuple[float, float]], n: int, seed: int = 0) -> DataFrame:
    """n rows (up to 3e9) in which every dimension has one value in each of n equal strata. A dimension's strata are
    dealt by a permutation of its own, a multiplication modulo n by a number without a common factor, so that each row
    works out its strata alone and no rows are sorted."""
    out = spark.range(n).select(F.col("id").alias("sample"))
    rng = random.Random(seed)
    for k, (name, (lo, hi)) in enumerate(bounds.items()):
        factor = next(f for f in iter(lambda: rng.randrange(1, max(2, n)), None) if math.gcd(f, n) == 1)
        stratum = (F.col("sample") * F.lit(factor) + F.lit(rng.randrange(max(1, n)))) % F.lit(n)
        jitter = F.pmod(F.xxhash64(F.lit(k), "sample", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        out = out.withColumn(name, lo + (hi - lo) * (stratum + jitter) / n)
    return out


def pvt_grid(spark: SparkSession, processes: list[str], voltages: list[float], temperatures: list[float]) -> DataFrame:
    """Every combination of process, voltage and temperature."""
    lists = [F.array(*[F.lit(x) for x in xs]) for xs in (processes, voltages, temperatures)]
    df = spark.range(1)
    for name, xs in zip(("process", "voltage", "temperature"), lists):
        df = df.withColumn(name, F.explode(xs))
    return df.drop("id")


def regulator_wave(spark: SparkSession, n: int, dt: float, target: float = 1.2, tau: float = 5e-6) -> DataFrame:
    """Start-up of a regulator: enable, output charging to its target, load current step at the middle."""
    base = time_base(spark, n, dt)
    on = F.col("idx") >= n // 10
    vout = F.when(on, target * (1 - F.exp(-(F.col("t") - n // 10 * dt) / tau))).otherwise(0.0)
    return base.select("idx", "t", on.cast("double").alias("en"), vout.alias("vout"), F.when(F.col("idx") >= n // 2, 0.05).otherwise(0.001).alias("iload$flow"))


def amplifier_wave(spark: SparkSession, n: int, dt: float, slew: float = 50e6, tone: float = 1e6) -> DataFrame:
    """Differential sine of 0.1 V and an output that follows it no faster than the slew rate."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:  # one row: the whole wave depends on its start
            for _ in range(len(pdf)):
                t = np.arange(n) * dt
                vin, out = 0.1 * np.sin(PI2 * tone * t), np.zeros(n)
                for k in range(1, n):
                    out[k] = out[k - 1] + min(max(vin[k] - out[k - 1], -slew * dt), slew * dt)
                yield pd.DataFrame({"idx": np.arange(n, dtype=np.int32), "t": t, "vdiff": vin, "vout": out, "en": (np.arange(n) >= n // 10).astype(float)})

    return spark.range(1).mapInPandas(run, "idx int, t double, vdiff double, vout double, en double")


def converter_wave(spark: SparkSession, n: int, dt: float, switching: float = 2e6, duty: float = 0.36, seed: int = 0) -> DataFrame:
    """Switching node of 12 V, inductor current and output with ripple, enable and power good."""
    t, k = F.col("t"), F.col("idx")
    ripple = F.sin(PI2 * switching * t)
    noise = (F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 0.017  # as wide as 5 mV of deviation
    phase = t * switching - F.floor(t * switching)
    return time_base(spark, n, dt).select("idx", "t", F.when(phase < duty, 12.0).otherwise(0.0).alias("vsw"), (0.5 + 0.1 * ripple).alias("il"), (1.8 + 0.02 * ripple + noise).alias("vout"), (k >= n // 20).cast("double").alias("en"), (k >= n // 5).cast("double").alias("pg"))


def plain_wave(spark: SparkSession, n: int, dt: float) -> DataFrame:
    """A sine of 10 kHz and an enable bit."""
    return time_base(spark, n, dt).select("idx", "t", F.sin(PI2 * 1e4 * F.col("t")).alias("sig_a"), (F.col("idx") >= n // 10).cast("double").alias("en"))


def _draw(k: int, lo: float, hi: float, seed: int) -> Column:
    """Uniform numbers by row and dimension."""
    return lo + (hi - lo) * F.pmod(F.xxhash64("sample", F.lit(k), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _about(value: Column, k: int, share: float, seed: int) -> Column:
    """The value with relative noise of about normal shape: the sum of four uniform numbers."""
    unit = sum(_draw(100 * k + j, -0.5, 0.5, seed) for j in range(4)) * math.sqrt(3.0)
    return value * (1 + share * unit)


def circuit_dataset(spark: SparkSession, topology: str, n: int, technology: str = "180nm", seed: int = 42, noise: bool = True) -> DataFrame:
    """n sizings of ota_5t, ota_folded, ldo or current_mirror (x_...) and their figures by hand analysis (y_...)."""
    length, supply, oxide, _, _ = TECHNOLOGIES.get(technology, TECHNOLOGIES["180nm"])
    um, db = length * 1e6, lambda x: 20 * F.log10(x)
    made = spark.range(n).select(F.col("id").alias("sample"))

    def sizes(**ranges: tuple[float, float]) -> None:
        nonlocal made
        made = made.withColumns({f"x_{name}": _draw(k, *span, seed) for k, (name, span) in enumerate(ranges.items())})

    x = lambda name: F.col(f"x_{name}")
    share = 0.03
    if topology in ("ota_5t", "ota_folded"):
        sizes(w1=(um, 20 * um), l1=(um, 4 * um), w3=(2 * um, 40 * um), l3=(um, 4 * um), w5=(um, 20 * um), l5=(um, 4 * um), ibias=(1, 50), cload=(100, 2000), cc=(50, 500), vdd=(supply - 0.05, supply + 0.05))
        per_area, drain = 8.6e-3 / oxide, x("ibias") * 1e-6 / 2
        gm = lambda mobility, w, length_: F.sqrt(2 * mobility * per_area * (x(w) / x(length_)) * 1e-6 * drain)
        gm1, gm3 = gm(0.04, "w1", "l1"), gm(0.015, "w3", "l3")
        gain = db(F.greatest(gm1 / (0.05 * gm1 + 0.05 * gm3), F.lit(1.0)))
        unity = gm1 / (PI2 * x("cc") * 1e-15) / 1e6
        second = gm3 / (PI2 * x("cload") * 1e-15) / 1e6
        margin = F.greatest(F.lit(0.0), F.least(F.lit(90.0), 90 - F.degrees(F.atan(unity / F.greatest(second, F.lit(0.01))))))
        figures = {
            "gain_db": gain,
            "unity_mhz": unity,
            "phase_margin": margin,
            "power_uw": x("ibias") * x("vdd"),
            "noise_nv": F.sqrt(8 * 1.38e-23 * 300 / (3 * gm1)) * 1e9,
            "cmrr_db": gain + db(F.greatest(gm1 / (2 * 0.05 * gm1 + 1e-12), F.lit(1.0))),
            "slew_v_us": x("ibias") * 1e-6 / (x("cc") * 1e-15) / 1e6,
            "swing_v": x("vdd") - 0.4,
        }
        if topology == "ota_folded":  # more gain for more power
            figures |= {"gain_db": gain + _draw(50, 6, 12, seed), "unity_mhz": unity * _draw(51, 0.7, 1.1, seed), "power_uw": figures["power_uw"] * _draw(52, 1.5, 2.0, seed)}
    elif topology == "ldo":
        sizes(wp=(20, 200), lp=(0.3, 2), wn=(2, 20), ln=(0.2, 1), ibias=(5, 100), rfb1=(10, 200), rfb2=(10, 200), cout=(1, 100), vdd=(supply, supply + 0.3))
        gm = 0.5e-3 * x("wn") / x("ln")
        figures = {
            "vout": F.least(supply * 0.4 * (1 + x("rfb1") / x("rfb2")), x("vdd") - 0.1),
            "line_mv_v": 1000 / F.greatest(gm * 50e3, F.lit(1.0)),
            "load_mv_a": 1 / F.greatest(gm, F.lit(1e-6)),
            "psrr_db": db(F.greatest(gm * 50e3 / 10, F.lit(1.0))),
            "quiescent_ua": x("ibias"),
            "dropout_mv": 200 / F.greatest(x("wp"), F.lit(1.0)),
            "phase_margin": 55 + _draw(50, -5, 10, seed),
            "power_uw": x("ibias") * x("vdd"),
        }
    elif topology == "current_mirror":
        share = 0.02
        sizes(w_ref=(1, 10), l_ref=(0.2, 2), w_out=(1, 10), l_out=(0.2, 2), iref=(1, 50))
        rout = 100 * x("l_out") / x("w_out")
        figures = {
            "ratio": (x("w_out") / x("l_out")) / (x("w_ref") / x("l_ref")),
            "vmin_mv": 150 * F.sqrt(x("l_ref")),
            "rout_kohm": rout,
            "bandwidth_mhz": 1 / (PI2 * 1e-15 * x("w_out") * 1e-6 * rout * 1e3) / 1e6,
            "mismatch_pct": 0.5 / F.sqrt(x("w_ref") * x("l_ref") + x("w_out") * x("l_out")),
        }
    else:
        raise ValueError(f"unknown topology {topology}")
    return made.withColumns({f"y_{name}": _about(v, 10 + k, share, seed) if noise else v for k, (name, v) in enumerate(figures.items())})
