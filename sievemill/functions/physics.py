"""Device formulas as column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boltzmann's constant in J/K and eV/K, thermal conductivities in W/(m K), and plausible ranges.
BOLTZMANN, BOLTZMANN_EV = 1.380649e-23, 8.617e-5
CONDUCTIVITY = {"silicon": 150, "soi": 20, "gaas": 46}
PLAUSIBLE = {
    "gain_dB": (0, 120),
    "ugf_MHz": (0.001, 10000),
    "phase_margin_deg": (0, 89.9),
    "power_uW": (0.01, 1e6),
    "noise_nV_sqrtHz": (0.1, 1e4),
    "cmrr_dB": (20, 160),
    "slew_rate_V_us": (0.01, 1e4),
    "output_swing_V": (0, 5),
    "psrr_dB": (0, 140),
    "dropout_mV": (10, 2000),
}


def region(vgs: Column, vds: Column, vth: Column, pmos: Column | None = None) -> Column:
    """off, subthreshold (within 0.1 V under the threshold), linear or saturation; signs turned for p-channel."""
    sign = F.lit(1.0) if pmos is None else F.when(pmos, -1.0).otherwise(1.0)
    over, vds = sign * (vgs - vth), sign * vds
    return F.when(over <= -0.1, "off").when(over < 0, "subthreshold").when(vds < over, "linear").otherwise("saturation")


def saturation_current(vgs: Column, vth: Column, mu: Column, cox: Column, width: Column, length: Column) -> Column:
    over = F.greatest(vgs - vth, F.lit(0.0))
    return mu * cox * width / length * over * over / 2


def transconductance(current: Column, overdrive: Column) -> Column:
    return 2 * current / F.greatest(overdrive, F.lit(1e-9))


def output_conductance(current: Column, early: Column) -> Column:
    return current / F.greatest(F.abs(early), F.lit(1.0))


def thermal_noise(gm: Column, kelvin: float = 300.0) -> Column:
    """Current noise density in A^2 / Hz."""
    return gm * (4 * BOLTZMANN * kelvin * 2 / 3)


def flicker_noise(kf: Column, current: Column, width: Column, length: Column, cox: Column, freq: Column) -> Column:
    return F.when(freq > 0, kf * current / (cox * width * length * freq)).otherwise(0.0)


def input_noise(gm: Column, kelvin: float = 300.0, gamma: float = 2 / 3) -> Column:
    """Input-referred voltage noise in V / sqrt(Hz)."""
    return F.sqrt(4 * BOLTZMANN * kelvin * gamma / F.greatest(gm, F.lit(1e-9)))


def noise_figure(source: Column, gm: Column) -> Column:
    """In dB, of one transistor."""
    return 10 * F.log10(F.greatest(1 + gm * source * (2 / 3), F.lit(1.0)))


def noise_level(white: Column, corner: Column, freq: Column) -> Column:
    return white * F.sqrt(1 + corner / F.greatest(freq, F.lit(1.0)))


def junction_temperature(watts: Column, resistance: Column, ambient: float = 25.0) -> Column:
    return watts * resistance + ambient


def thermal_resistance(square_um: Column, substrate: Column) -> Column:
    """Of a die, in K / W; an unknown substrate counts as silicon."""
    k = F.lit(float(CONDUCTIVITY["silicon"]))
    for name, x in CONDUCTIVITY.items():
        k = F.when(substrate == name, float(x)).otherwise(k)
    return 1 / (2 * k * F.sqrt(pi * F.greatest(square_um * 1e-12, F.lit(1e-12))))


def migration_margin(density: Column, most: Column) -> Column:
    return (most - density) / F.greatest(most, F.lit(1e-12))


def hot_carrier_risk(vds: Column, vgs: Column, vth: Column, vdd: Column) -> Column:
    """From 0 (safe) to 1."""
    stress = (vds - F.greatest(vgs - vth, F.lit(0.05))) / F.greatest(vdd, F.lit(0.1))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), stress))


def bias_instability(vgs: Column, kelvin: Column, years: float = 10) -> Column:
    """Threshold shift over a budget of 0.1 V, from 0 to 1."""
    rate = F.exp(-0.5 / (BOLTZMANN_EV * F.greatest(kelvin, F.lit(250.0))))
    return F.least(rate * (years * 3.15e7) ** 0.25 * F.abs(vgs) / 0.1, F.lit(1.0))


def migration_life(density: Column, kelvin: Column, energy: float = 0.9, n: float = 2.0) -> Column:
    """Relative mean time to failure by Black's equation."""
    return F.exp(energy / (BOLTZMANN_EV * kelvin)) / (F.pow(density, F.lit(n)) + 1e-30)


def slew_rate(micro_amps: Column, femto_farads: Column) -> Column:
    """In V / us."""
    return micro_amps / femto_farads * 1e3


def switching_power(activity: Column, femto_farads: Column, volts: Column, mega_hertz: Column) -> Column:
    """In uW."""
    return activity * femto_farads * volts * volts * mega_hertz * 1e-3


def plausible(name: Column, value: Column) -> Column:
    """Whether a named value lies in its inclusive range; unknown names always do."""
    out = F.lit(True)
    for k, (lo, hi) in PLAUSIBLE.items():
        out = F.when(name == k, value.between(lo, hi)).otherwise(out)
    return out
