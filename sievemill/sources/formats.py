"""Text formats: value change dumps, ASCII raw files, netlists, check reports, coverage models and dataset CSVs.

Dumps and raw files are read in byte ranges (see lines.py). Netlists, reports and models are small: each is read whole
by Spark's binary or text source and parsed in a task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.sources.lines import read_changes, read_points

# The element letters of netlists, and suffixes of numbers.
ELEMENTS = {"m": ("mosfet", 4), "r": ("resistor", 2), "c": ("capacitor", 2), "l": ("inductor", 2), "v": ("vsource", 2), "i": ("isource", 2), "d": ("diode", 2), "q": ("bjt", 3)}
SUFFIXES = {"meg": 1e6, "f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "m": 1e-3, "k": 1e3, "g": 1e9, "t": 1e12}


def parse_files(spark: SparkSession, pattern: str, parse: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """parse(text) -> rows, for each file; the file's name comes first."""
    names = ["file", *(re.match(r"\s*(\w+)", x)[1] for x in re.split(r",(?![^<]*>)", schema))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                name = path.rsplit("/", 1)[-1]
                yield pd.DataFrame([(name, *row) for row in parse(bytes(content).decode("utf-8", "replace"))], columns=names)

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, f"file string, {schema}")


def read_vcd(spark: SparkSession, pattern: str) -> DataFrame:
    """file, signal, t (seconds) and value of value change dumps; long ones are read in byte ranges."""
    return read_changes(spark, pattern).withColumn("file", F.regexp_extract("file", r"([^/]+)$", 1))


def read_nutmeg(spark: SparkSession, pattern: str) -> DataFrame:
    """file, idx, name, kind and value of ASCII raw files; long ones are read in byte ranges."""
    return read_points(spark, pattern).withColumn("file", F.regexp_extract("file", r"([^/]+)$", 1))


def spice_number(text: str) -> float | None:
    m = re.match(r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)(meg|[fpnumkgt])?[a-z]*$", text.lower())
    return float(m[1]) * SUFFIXES.get(m[2], 1.0) if m else None


def cards_of(text: str) -> list[str]:
    """The cards of a netlist: + continues one, and so does a backslash at a line's end; * // and ; begin comments."""
    cards: list[str] = []
    joins = False
    for line in text.splitlines():
        line = re.split(r";|\$ |//", line, maxsplit=1)[0].rstrip()
        if (line.startswith("+") or joins) and cards:
            cards[-1] += " " + line.removeprefix("+").removesuffix("\\")
        elif line.strip() and not line.lstrip().startswith("*"):
            cards.append(line.strip().removesuffix("\\"))
        joins = line.endswith("\\")
    return cards


#: Spectre's names of primitives, and what the start of a model's name tells.
PRIMITIVES = {"resistor": "resistor", "capacitor": "capacitor", "inductor": "inductor", "vsource": "vsource", "isource": "isource", "diode": "diode", "bjt": "bjt"}
DEVICES = re.compile(r"nmos|nfet|nch|pmos|pfet|pch|mos")


def netlist_rows(text: str) -> list[tuple]:
    """(component, type, nets, model, params, owner, ports) of the cards of a netlist, SPICE or Spectre: instances, with
    the subcircuit that they stand in as owner (null: the top), and definitions (type definition) with their ports.
    .param and parameters values stand for their names."""
    cards = cards_of(text)
    symbols: dict[str, float] = {}
    for card in cards:
        if re.match(r"\.param|parameters|params", card.lower()):
            symbols |= {k.lower(): x for k, v in re.findall(r"(\w+)\s*=\s*([^\s=]+)", card) if (x := spice_number(v)) is not None}
    value = lambda v: symbols.get(v.strip("'{}").lower(), spice_number(v.strip("'{}")))
    out, owners = [], [None]
    for card in cards:
        head, low = card[0].lower(), card.lower()
        pairs = re.findall(r"(\w+)\s*=\s*([^\s=]+)", card)
        plain = re.sub(r"\w+\s*=\s*[^\s=]+", "", card)
        params = {k.lower(): x for k, v in pairs if (x := value(v)) is not None}
        if m := re.match(r"(\.?subckt|inline\s+subckt|module)\s+(\S+)\s*(.*)", plain, re.I):
            owners.append(m[2].lower())
            out.append((m[2], "definition", [], None, params, owners[-2], m[3].replace("(", " ").replace(")", " ").split()))
        elif re.match(r"\.?ends\b|endmodule\b", low):
            if len(owners) > 1:
                owners.pop()
        elif m := re.match(r"(\S+)\s*\(([^)]*)\)\s*(\S+)", plain):
            kind = PRIMITIVES.get(m[3].lower()) or ("mosfet" if DEVICES.search(m[3].lower()) else "subckt")
            key = {"resistor": "r", "capacitor": "c", "inductor": "l", "vsource": "dc", "isource": "dc"}.get(kind)
            if key in params:
                params["value"] = params[key]
            out.append((m[1], kind, m[2].split(), m[3], params, owners[-1], []))
        elif head in {*ELEMENTS, "x"} and not re.match(r"parameters|params|simulator|include|global|model|library|section|statistics", low):
            words = plain.split()
            if head == "x":
                kind, nets, rest = "subckt", words[1:-1], words[-1:]
            else:
                kind, n = ELEMENTS[head]
                nets, rest = words[1 : 1 + n], words[1 + n :]
            number = value(rest[0]) if rest and kind in ("resistor", "capacitor", "inductor", "vsource", "isource") else None
            if number is not None:
                params["value"] = number
            out.append((words[0], kind, nets, None if number is not None or not rest else rest[0], params, owners[-1], []))
    return out


NETLIST = "component string, type string, nets array<string>, model string, params map<string,double>, owner string, ports array<string>"


def read_cards(spark: SparkSession, pattern: str) -> DataFrame:
    """file and the columns of netlist_rows: instances and definitions with the subcircuit they stand in."""
    return parse_files(spark, pattern, netlist_rows, NETLIST)


def read_netlist(spark: SparkSession, pattern: str) -> DataFrame:
    """The instances of netlists as they stand, those in subcircuits too."""
    return read_cards(spark, pattern).filter("type <> 'definition'").drop("owner", "ports")


RESULT = "checker:string,item:string,status:string,measured:string,min:string,max:string,unit:string,message:string,waveform_anchor_time:string"
ENVELOPE = f"map<string,struct<meta:map<string,string>,results:array<struct<{RESULT}>>,all_results:array<struct<{RESULT}>>>>"


def read_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """Result items of report files: a JSON object whose members, whatever their names, hold results or (aggregate
    files) all_results; files that are no JSON are skipped."""
    raw = spark.read.text(pattern, wholetext=True).select(F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE"}).alias("m"))
    r = raw.filter("m IS NOT NULL").select(F.explode(F.map_values("m")).alias("r"))
    items = r.select(F.explode(F.coalesce("r.results", "r.all_results")).alias("i"))
    return items.select("i.*").withColumn("measured_value", F.col("measured").try_cast("double"))


# Kinds of coverage bins, with the other names that files use.
BIN_KINDS = {"values": "values", "value": "values", "range": "range", "ranges": "range", "transition": "transition", "default": "default", "ignore": "ignore", "illegal": "illegal", "wildcard": "wildcard", "auto": "auto"}
BIN = "array<struct<name:string,type:string,values:array<string>,ranges:array<struct<low:string,high:string>>,transitions:array<array<string>>,pattern:string,auto_bin_max:int,min_hits:int,weight:double,comment:string>>"
POINT = f"array<struct<name:string,variable:string,bins:{BIN},condition:string,comment:string>>"
CROSS = "array<struct<name:string,coverpoints:array<string>,exclude_bins:array<string>,comment:string>>"
GROUP = f"array<struct<name:string,clock:string,points:{POINT},crosses:{CROSS},args:array<struct<type:string,name:string>>,condition:string,per_instance:boolean,auto_bin_max:int,goal:int,comment:string>>"
FEATURE = f"array<struct<name:string,groups:{GROUP},description:string,tags:array<string>,source_doc:string>>"
MODEL = f"project string, features {FEATURE}, crosses array<struct<name:string,targets:array<string>,goal:int,comment:string,exclude_combinations:array<string>>>"


def _texts(items) -> list[str]:
    return [str(x) for x in items or []]


def _whole(x) -> int | None:
    return None if x is None or x == "" else int(float(x))


def _bin(raw: dict) -> tuple:
    """One bin; without a type, what it holds tells it. A kind that is not known counts as values."""
    kind = str(raw.get("type") or "values").lower()
    if raw.get("pattern") is not None:
        kind = "wildcard"
    elif kind == "values" and raw.get("transitions"):
        kind = "transition"
    elif kind == "values" and raw.get("auto_bin_max") is not None:
        kind = "auto"
    ranges = [(str(r[0]), str(r[-1])) for r in raw.get("ranges") or []]
    steps = [_texts(t) for t in raw.get("transitions") or []]
    weight = raw.get("weight")
    return raw.get("name"), BIN_KINDS.get(kind, "values"), _texts(raw.get("values")), ranges, steps, raw.get("pattern"), _whole(raw.get("auto_bin_max")), _whole(raw.get("min_hits")) or 1, None if weight is None else float(weight), raw.get("comment")


def read_coverage_yaml(spark: SparkSession, text: str) -> DataFrame:
    """A coverage model as nested arrays: project, features > groups > points > bins, with all that bins hold."""
    import yaml

    doc = yaml.safe_load(text) or {}
    points = lambda g: [(p.get("name"), p.get("variable"), [_bin(b) for b in p.get("bins") or []], p.get("condition"), p.get("comment")) for p in g.get("coverpoints") or []]
    inner = lambda g: [(c.get("name"), _texts(c.get("coverpoints")), _texts(c.get("exclude_bins")), c.get("comment")) for c in g.get("crosses") or []]
    args = lambda g: [(x.get("type"), x.get("name")) for x in g.get("args") or []]
    groups = lambda f: [(g.get("name"), g.get("clock"), points(g), inner(g), args(g), g.get("condition"), bool(g.get("per_instance")), _whole(g.get("auto_bin_max")), _whole(g.get("goal", 100)), g.get("comment")) for g in f.get("covergroups") or []]
    features = [(f.get("name"), groups(f), f.get("description"), _texts(f.get("tags")), f.get("source_doc")) for f in doc.get("features") or []]
    crosses = [(c.get("name"), _texts(c.get("targets")), c.get("goal"), c.get("comment"), _texts(c.get("exclude_combinations"))) for c in doc.get("feature_crosses") or []]
    return spark.createDataFrame([(doc.get("project"), features, crosses)], MODEL)


def workbook_sheets(content: bytes) -> dict[str, list[dict[str, str]]]:
    """The rows of each sheet of a workbook, by the names in its first row (lower case, col_N where there is none); rows
    without any value are left out. A workbook is a zip file of XML parts, so no further library is needed."""
    import io
    import zipfile
    from xml.etree import ElementTree

    main, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    out: dict[str, list[dict[str, str]]] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = lambda name: ElementTree.fromstring(z.read(name))
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{main}t"))
        shared = [text(s) for s in part("xl/sharedStrings.xml").iter(f"{main}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in part("xl/_rels/workbook.xml.rels")}
        for sheet in part("xl/workbook.xml").iter(f"{main}sheet"):
            rows = []
            for row in part("xl/" + targets[sheet.get(f"{rel}id")]).iter(f"{main}row"):
                cells: dict[int, str] = {}
                for k, cell in enumerate(row.iter(f"{main}c")):
                    letters = re.match(r"[A-Z]*", cell.get("r") or "")[0]
                    at = k
                    if letters:
                        at = -1
                        for ch in letters:
                            at = (at + 1) * 26 + ord(ch) - 65
                    kind, value = cell.get("t"), cell.find(f"{main}v")
                    got = text(cell) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
                    if got not in (None, ""):
                        cells[at] = got
                rows.append(cells)
            head = rows[0] if rows else {}
            name = lambda k, head=head: head[k].strip().lower() if k in head else f"col_{k}"
            out[sheet.get("name")] = [{name(k): v for k, v in r.items()} for r in rows[1:] if r]
    return out


def _listed(text: str | None, sep: str = ",") -> list[str]:
    return [x.strip() for x in (text or "").split(sep) if x.strip()]


def coverage_of_sheets(sheets: dict[str, list[dict[str, str]]], project: str) -> tuple:
    """A coverage model from the sheets Features, CoverGroups, CoverPoints, Bins, CG_Crosses and Crosses. A group may
    bring its feature along; points, bins and crosses of unknown parents and rows without names are left out."""
    rows = lambda name, *need: [r for r in sheets.get(name, []) if all(r.get(c) for c in need)]
    features = {r["feature_name"]: r for r in rows("Features", "feature_name")}
    groups = {(r["feature_name"], r["cg_name"]): r for r in rows("CoverGroups", "feature_name", "cg_name")}
    for f, _ in groups:
        features.setdefault(f, {})
    points = {(r["feature_name"], r["cg_name"], r["cp_name"]): r for r in rows("CoverPoints", "feature_name", "cg_name", "cp_name")}
    bins: dict[tuple, list[tuple]] = {}
    for r in rows("Bins", "feature_name", "cg_name", "cp_name", "bin_name"):
        pairs = [x.strip("[]() ").split(":") for x in _listed(r.get("ranges"))]
        steps = [[y.strip() for y in x.split("=>")] for x in _listed(r.get("transitions"), "|")]
        raw = {**r, "name": r["bin_name"], "values": _listed(r.get("values")), "ranges": pairs, "transitions": steps, "type": r.get("type", "values")}
        kind = BIN_KINDS.get(raw["type"].lower(), "values")  # a sheet names its kinds
        made = _bin(raw)
        bins.setdefault((r["feature_name"], r["cg_name"], r["cp_name"]), []).append((made[0], kind, *made[2:]))
    inner: dict[tuple, list[tuple]] = {}
    for r in rows("CG_Crosses", "feature_name", "cg_name", "cross_name"):
        inner.setdefault((r["feature_name"], r["cg_name"]), []).append((r["cross_name"], _listed(r.get("coverpoints")), _listed(r.get("exclude_bins")), r.get("comment")))

    def group(key: tuple, r: dict) -> tuple:
        own = [(p[2], q.get("variable", p[2]), bins.get(p, []), q.get("condition"), q.get("comment")) for p, q in points.items() if p[:2] == key]
        args = [tuple(x.rsplit(" ", 1)) for x in _listed(r.get("args")) if " " in x]
        per = str(r.get("per_instance", "")).lower() not in ("", "0", "false")
        return key[1], r.get("clock"), own, inner.get(key, []), args, r.get("condition"), per, _whole(r.get("auto_bin_max")), _whole(r.get("goal")) or 100, r.get("comment")

    made = [(f, [group(k, g) for k, g in groups.items() if k[0] == f], r.get("description"), _listed(r.get("tags")), r.get("source_doc")) for f, r in features.items()]
    crosses = [(r["cross_name"], _listed(r.get("targets"), "|"), _whole(r.get("goal")) or 100, r.get("comment"), []) for r in rows("Crosses", "cross_name")]
    return project, made, crosses


def _named(value, kind):
    """Nested tuples as dictionaries, by the names of a schema."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType):
        return {f.name: _named(v, f.dataType) for f, v in zip(kind.fields, value)}
    return [_named(v, kind.elementType) for v in value] if isinstance(kind, T.ArrayType) else value


def read_coverage_workbook(spark: SparkSession, pattern: str) -> DataFrame:
    """One coverage model a workbook, with the schema of read_coverage_yaml; the project is the file's stem."""
    kind = spark.createDataFrame([], MODEL).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [coverage_of_sheets(workbook_sheets(bytes(c)), p.rsplit("/", 1)[-1].rsplit(".", 1)[0]) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame({"raw": [json.dumps(_named(m, kind)) for m in made]})

    raw = spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "raw string")
    return raw.select(F.from_json("raw", kind).alias("m")).select("m.*")


def read_registers(spark: SparkSession, path: str) -> DataFrame:
    """Register fields with the width of their bit range (7:4, 3 or [7:4])."""
    raw = spark.read.option("header", True).csv(path)
    bits = F.regexp_extract_all("bit_range", F.lit(r"(\d+)"), 1)
    return raw.withColumn("width", (F.abs(F.element_at(bits, 1).cast("int") - F.element_at(bits, -1).cast("int")) + 1).cast("int"))


def read_dataset(spark: SparkSession, path: str, known: list[str] | None = None) -> DataFrame:
    """technology, then x_ and y_ columns in name order (or the known ones in file order), as doubles; an empty file is
    an error."""
    raw = spark.read.option("header", True).csv(path)
    picked = [c for c in raw.columns if c in known] if known else sorted(c for c in raw.columns if c.startswith("x_")) + sorted(c for c in raw.columns if c.startswith("y_"))
    if not raw.limit(1).count():
        raise ValueError(f"{path} has no rows")
    own = ["technology"] if "technology" in raw.columns else []
    return raw.select(*own, *[F.col(c).try_cast("double").alias(c) for c in picked])


def read_silicon(spark: SparkSession, path: str) -> DataFrame:
    """Measurements in long form: chip_id, pvt_corner, temperature, vdd (with defaults) and every other numeric column."""
    raw = spark.read.option("header", True).csv(path)
    defaults = {"chip_id": "unknown", "pvt_corner": "TT", "temperature": "27", "vdd": "0"}
    for c, d in defaults.items():
        raw = raw.withColumn(c, F.coalesce(F.col(c), F.lit(d)) if c in raw.columns else F.lit(d))
    rest = [c for c in raw.columns if c not in defaults]
    long = raw.unpivot(list(defaults), rest, "spec_name", "text").withColumn("value", F.col("text").try_cast("double")).filter("value IS NOT NULL")
    return long.select("chip_id", "pvt_corner", F.col("temperature").try_cast("double").alias("temperature"), F.col("vdd").try_cast("double").alias("vdd"), "spec_name", "value")
