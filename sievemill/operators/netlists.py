"""Flat netlists from hierarchical ones: subcircuits are expanded level by level, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.functions.session import cut

#: Nets that are the same on all levels.
GLOBAL = ("0", "gnd!", "vdd!", "vss!")


def flatten(cards: DataFrame, most: int = 64) -> DataFrame:
    """cards (component, type, nets, model, params, owner, ports) as read_cards gives them: path (names from the top,
    with dots), type, model, params and nets of all devices. A net of a subcircuit is the one its port is tied to, else
    its own, with the path before it; names are compared without case, and definitions may stand in any file, but once.
    An instance whose subcircuit is not defined stays as it is, with the type subckt; one with another number of nets
    than ports raises, and so do cycles and more than `most` levels."""
    defined = cards.filter("type = 'definition'").select(F.lower("component").alias("name"), "ports")
    twice = defined.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"subcircuit {twice[0]['name']} is defined more than once")
    parts = cards.filter("type <> 'definition'").select("owner", "component", "type", "nets", "model", "params").join(defined.select(F.col("name").alias("_name"), F.col("ports").alias("_ports")), (F.col("type") == "subckt") & (F.lower("model") == F.col("_name")), "left")
    parts = cut(parts)
    own = lambda n: F.when(F.lower(n).isin(*GLOBAL), n).otherwise(F.concat("_path", F.lit("."), n))
    level = parts.filter("owner IS NULL").select(F.col("component").alias("path"), "type", "model", "params", "nets", "_name", "_ports", F.array(F.coalesce("_name", F.lit(""))).alias("_above"))
    found = None
    for _ in range(most):
        level = cut(level)
        leaves = level.filter("_name IS NULL").select("path", "type", "model", "params", "nets")
        found = leaves if found is None else found.union(leaves)
        inner = level.filter("_name IS NOT NULL")
        if not inner.limit(1).count():
            return found
        wrong = inner.filter(F.size("nets") != F.size("_ports")).limit(1).collect()
        if wrong:
            raise ValueError(f"{wrong[0]['path']}: {len(wrong[0]['nets'])} nets for {len(wrong[0]['_ports'])} ports")
        round_ = inner.filter(F.size(F.array_distinct("_above")) < F.size("_above")).limit(1).collect()
        if round_:
            raise ValueError(f"subcircuit {round_[0]['_name']} holds itself, at {round_[0]['path']}")
        held = inner.select(F.col("path").alias("_path"), F.col("_name").alias("owner"), F.map_from_arrays(F.transform("_ports", F.lower), "nets").alias("_tied"), "_above")
        j = held.join(parts, "owner")
        nets = F.transform("nets", lambda n: F.coalesce(F.try_element_at("_tied", F.lower(n)), own(n)))
        level = j.select(F.concat("_path", F.lit("."), "component").alias("path"), "type", "model", "params", nets.alias("nets"), "_name", "_ports", F.when(F.col("_name").isNotNull(), F.concat("_above", F.array("_name"))).otherwise(F.col("_above")).alias("_above"))
    raise ValueError(f"more than {most} levels of subcircuits")
