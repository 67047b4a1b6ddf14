"""Scalar functions as column expressions, so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SI suffixes and units.
SI = [("meg", 1e6), ("f", 1e-15), ("p", 1e-12), ("n", 1e-9), ("u", 1e-6), ("m", 1e-3), ("k", 1e3), ("g", 1e9), ("t", 1e12)]
UNITS = {"A": 1.0, "mA": 1e-3, "uA": 1e-6, "nA": 1e-9, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "ps": 1e-12}


def si_number(text: Column) -> Column:
    """Number with an SI suffix (longest first, case ignored), signed exponents included; anything else is 0."""
    t = F.lower(F.trim(text))
    pattern = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)(meg|[fpnumkgt])?[a-z]*$"
    number, suffix = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    scale = F.lit(1.0)
    for s, x in SI:
        scale = F.when(suffix == s, x).otherwise(scale)
    return F.coalesce(number.try_cast("double") * scale, F.lit(0.0))


def unit_scale(unit: Column) -> Column:
    """Factor to the base unit, 1 for an unknown one."""
    out = F.lit(1.0)
    for u, x in UNITS.items():
        out = F.when(unit == u, x).otherwise(out)
    return out


def parse_corner(text: Column) -> Column:
    """process, voltage and temperature of PP_1p8V_N40C: p is the decimal point, a leading N a minus."""
    pattern = r"^([A-Za-z]+)_(N?[0-9]+(?:p[0-9]+)?)V_(N?[0-9]+(?:p[0-9]+)?)C$"
    num = lambda k: F.regexp_replace(F.regexp_replace(F.regexp_extract(text, pattern, k), "^N", "-"), "p", ".").try_cast("double")
    return F.struct(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).alias("process"), num(2).alias("voltage"), num(3).alias("temperature"))


def format_corner(process: Column, voltage: Column, temperature: Column) -> Column:
    def part(x: Column) -> Column:
        whole = F.abs(x) == F.floor(F.abs(x))
        digits = F.when(whole, F.floor(F.abs(x)).cast("string")).otherwise(F.regexp_replace(F.abs(x).cast("string"), r"\.", "p"))
        return F.concat(F.when(x < 0, "N").otherwise(""), digits)

    return F.concat(process, F.lit("_"), part(voltage), F.lit("V_"), part(temperature), F.lit("C"))


def parse_meta(text: Column) -> Column:
    """k=v pairs parted by commas as a map, trimmed; tokens without = are skipped, the first = parts, the last key wins."""
    pairs = F.filter(F.split(text, ","), lambda x: x.contains("="))
    key = lambda x: F.trim(F.substring_index(x, "=", 1))
    entries = F.transform(pairs, lambda x: F.struct(key(x).alias("k"), F.trim(F.substring(x, F.locate("=", x) + 1, F.length(x))).alias("v")))
    last = F.filter(entries, lambda e, i: F.size(F.filter(entries, lambda o, j: (o["k"] == e["k"]) & (j > i))) == 0)
    return F.map_from_entries(last)


def corner_of_meta(meta: Column) -> Column:
    """Value of the corner key, whatever its case; null without one."""
    hits = F.filter(F.map_entries(meta), lambda e: F.lower(e["key"]) == "corner")
    return F.try_element_at(F.transform(hits, lambda e: e["value"]), F.lit(1))


def parse_signal(text: Column) -> Column:
    """name, name@run or name@run@corner; more parts give nothing."""
    p = F.split(text, "@")
    ok = F.size(p) <= 3
    return F.struct(*[F.when(ok, F.try_element_at(p, F.lit(k))).alias(a) for k, a in ((1, "name"), (2, "run"), (3, "corner"))])


def signal_kind(name: Column, suffix: str = "$flow") -> Column:
    return F.when(name.endswith(suffix), "current").otherwise("voltage")


def strip_kind(name: Column, suffix: str = "$flow") -> Column:
    return F.when(name.endswith(suffix), F.substring(name, 1, F.length(name) - len(suffix))).otherwise(name)


def parse_int(text: Column) -> Column:
    """Integer literal, decimal, 0x, 0b or 0o."""
    t = F.lower(F.trim(text))
    base = lambda p, b: F.conv(F.substring(t, 3, F.length(t)), b, 10).cast("long")
    return F.when(t.startswith("0x"), base("0x", 16)).when(t.startswith("0b"), base("0b", 2)).when(t.startswith("0o"), base("0o", 8)).otherwise(t.try_cast("long"))


def parse_ranges(text: Column) -> Column:
    """lo:hi, lo:hi, ... as an array of (low, high); a single number is a range of one."""
    return F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.struct(parse_int(F.split(x, ":")[0]).alias("low"), parse_int(F.element_at(F.split(x, ":"), -1)).alias("high")))


def parse_transitions(text: Column) -> Column:
    """A=>B | C=>D as an array of arrays of names."""
    return F.transform(F.split(text, r"\|"), lambda x: F.transform(F.split(x, "=>"), lambda y: F.trim(y)))


def pin_type(name: Column) -> Column:
    """Type of a pin by parts of its name; the first rule that fits counts."""
    n = F.lower(name)
    rules = [("supply", r"vdd|vcc|vbat|avdd|dvdd"), ("ground", r"gnd|vss"), ("clock", r"clk|clock"), ("reset", r"rst|reset"), ("output", r"out|_o$"), ("input", r"in|_i$")]
    out = F.lit("signal")
    for kind, pattern in reversed(rules):
        out = F.when(n.rlike(pattern), kind).otherwise(out)
    return out


def identifier(text: Column) -> Column:
    """Other characters than letters, digits and underscores become underscores; a digit in front gets one before it."""
    t = F.regexp_replace(text, "[^A-Za-z0-9_]", "_")
    return F.when(t.rlike("^[0-9]"), F.concat(F.lit("_"), t)).otherwise(t)


def quantize(value: Column, step: Column, offset: Column) -> Column:
    """Half-even steps from the offset; raises where they leave 32 bits."""
    q = F.rint((value - offset) / step)
    return F.when(F.abs(q) <= 2147483647, q.cast("int")).otherwise(F.raise_error(F.lit("quantized value exceeds 32 bits")).cast("int"))


def dequantize(q: Column, step: Column, offset: Column) -> Column:
    return q * step + offset


def hamming(a: Column, b: Column) -> Column:
    """Positions in which two arrays differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def mean_pool(vectors: Column, size: int) -> Column:
    """Mean of an array of vectors of that size."""
    total = F.aggregate(vectors, F.array_repeat(F.lit(0.0), size), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vectors))


def lookup(data: Column, keys: list[str], default: Column) -> Column:
    """Nested lookup in maps, the default where a level is missing."""
    for key in keys:
        data = F.try_element_at(data, F.lit(key))
    return F.coalesce(data, default)


def pole_residue(poles: Column, residues: Column, re: Column, im: Column) -> Column:
    """Sum of r / (s - p) over arrays of (re, im) at s = re + i im, as (re, im)."""

    def term(p: Column, r: Column) -> Column:
        a, b = re - p["re"], im - p["im"]
        d = a * a + b * b
        return F.struct(((r["re"] * a + r["im"] * b) / d).alias("re"), ((r["im"] * a - r["re"] * b) / d).alias("im"))

    zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    return F.aggregate(F.zip_with(poles, residues, term), zero, lambda s, x: F.struct((s["re"] + x["re"]).alias("re"), (s["im"] + x["im"]).alias("im")))


def is_passive(poles: Column, residues: Column, eps: float = 1e-9) -> Column:
    """All poles in the left half plane and no negative residue on a real pole."""
    stable = F.forall(poles, lambda p: p["re"] <= eps)
    fine = F.forall(F.zip_with(poles, residues, lambda p, r: (F.abs(p["im"]) > eps) | (r["re"] >= 0)), lambda x: x)
    return stable & fine


def s_to_z(re: Column, im: Column, z0: float = 50.0) -> Column:
    """Impedance z0 (1 + s) / (1 - s) of a reflection coefficient."""
    d = (1 - re) * (1 - re) + im * im
    return F.struct((z0 * (1 - re * re - im * im) / d).alias("re"), (z0 * 2 * im / d).alias("im"))


def chunk_text(text: Column, size: int = 8000, overlap: int = 500) -> Column:
    """Chunks of at most `size` characters that overlap, ending at the last blank line of their second half if there is
    one; the end of the text ends the last chunk."""
    n = F.length(text)
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        piece = F.substring(text, s["at"], F.lit(size))
        blank = F.length(F.substring_index(piece, "\n\n", -1))
        cut = F.length(piece) - blank
        whole = s["at"] + size - 1 >= n
        use = F.when(whole | ~piece.contains("\n\n") | (cut <= size // 2), F.length(piece)).otherwise(cut)
        nxt = F.when(whole, n + 1).otherwise(F.greatest(s["at"] + 1, s["at"] + use - overlap))
        return F.when(s["at"] > n, s).otherwise(F.struct(nxt.cast("int").alias("at"), F.array_append(s["out"], F.substring(piece, F.lit(1), use)).alias("out")))

    most = F.greatest(F.lit(1), F.ceil(n / max(1, size // 2 - overlap)) + 1).cast("int")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), most), state, step)["out"]).otherwise(F.array().cast("array<string>"))


# Gate length, supply, oxide thickness and thresholds of technologies, from large to small.
TECHNOLOGIES = {
    "180nm": (180e-9, 1.8, 4e-9, 0.50, -0.50),
    "90nm": (90e-9, 1.2, 2e-9, 0.35, -0.35),
    "65nm": (65e-9, 1.0, 1.5e-9, 0.30, -0.30),
    "45nm": (45e-9, 1.0, 1.2e-9, 0.28, -0.28),
    "28nm": (28e-9, 0.9, 1.0e-9, 0.25, -0.25),
    "14nm": (14e-9, 0.8, 0.9e-9, 0.22, -0.22),
}


def log_size(value: Column, reference: Column) -> Column:
    """Decades over the reference, divided by three; 0 for sizes that are not positive."""
    return F.when((value > 0) & (reference > 0), F.log10(value / reference) / 3).otherwise(0.0)


def technology_code(name: Column) -> Column:
    """Seven numbers of a technology: place in the order, gate length, supply, oxide, both thresholds and whether it has
    fins; an unknown one has the numbers of the largest."""
    first = next(iter(TECHNOLOGIES.values()))
    last = max(len(TECHNOLOGIES) - 1, 1)

    def code(k: int, values: tuple) -> Column:
        length, supply, oxide, vn, vp = (F.lit(x) for x in values)
        length0, supply0, oxide0 = first[:3]
        fins = F.coalesce(F.regexp_extract(name, r"^([0-9]+)nm$", 1).try_cast("int") <= 14, F.lit(False))
        return F.array(F.lit(k / last), F.log10(length / length0), supply / supply0, F.log10(oxide / oxide0), vn, F.abs(vp), fins.cast("double"))

    out = code(0, first)
    for k, (known, values) in enumerate(TECHNOLOGIES.items()):
        out = F.when(name == known, code(k, values)).otherwise(out)
    return out
