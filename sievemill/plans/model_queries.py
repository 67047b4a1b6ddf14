"""Surrogates, formulas and hierarchical netlists over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions.session import new_folder
from sievemill.operators import features as ft
from sievemill.operators import netlists
from sievemill.operators import surrogates as sg
from sievemill.sources import formats

from .inputs import Catalog, rounded, table

C = Catalog()
INPUTS = ["l_quantity", "l_discount", "l_tax"]


def _surrogate(spark, sf):
    li = table(spark, sf, "lineitem")
    model = sg.fit_process(li, INPUTS, ["l_extendedprice"], points=64, noise=0.1)
    asked = li.select(*INPUTS).distinct()
    return sg.predicted(asked, model, INPUTS).select(*INPUTS, F.col("mean")[0].alias("price"), F.col("std")[0].alias("std"))


@C.add()
def surrogate_prices(spark, sf):
    """Price by quantity, discount and tax, with its standard deviation, at all their combinations."""
    return rounded(_surrogate(spark, sf), 3)


@C.add()
def most_uncertain_prices(spark, sf):
    """The quantity whose price is least known over all discounts and taxes: where to sample next."""
    return rounded(ft.next_sample(_surrogate(spark, sf).withColumn("candidate", F.col("l_quantity"))), 3)


@C.add("SELECT r.s AS l_returnflag, 1 AS step, v.term, CAST(v.c AS DOUBLE) AS coefficient, 1.0 AS r2 FROM (SELECT DISTINCT l_returnflag AS s FROM lineitem) AS r, (VALUES ('l_quantity*l_discount', 3.0), (CAST(NULL AS VARCHAR), 7.0)) AS v(term, c)")
def found_formulas(spark, sf):
    """A product found among the terms of quantity and discount, for each return flag: 3 quantity discount + 7."""
    li = table(spark, sf, "lineitem").withColumn("y", 3 * F.col("l_quantity") * F.col("l_discount") + 7)
    return rounded(sg.formulas(li, ["l_quantity", "l_discount"], "y", key="l_returnflag"))


@C.add(
    """SELECT 'x' || replace(lower(r_name), ' ', '_') || '.xn' || n_nationkey || '.r' || c_custkey AS path, 'resistor' AS type, round(1000.0 + c_custkey, 4) AS value,
  ['bus', 'x' || replace(lower(r_name), ' ', '_') || '.xn' || n_nationkey || '.k' || c_custkey] AS nets
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def flattened_netlist(spark, sf):
    """Regions hold nations, nations hold a resistor a customer: written as netlists, one file a level, and flattened."""
    path = new_folder(spark, "netlist")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    bodies = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.concat_ws("\n", F.collect_list(F.format_string("r%s in k%s %s", F.col("c_custkey").cast("string"), F.col("c_custkey").cast("string"), (F.col("c_custkey") + 1000).cast("string")))).alias("text"))
    low = bodies.select(F.format_string("* a nation\n.subckt nation%s in\n%s\n.ends", F.col("c_nationkey").cast("string"), "text").alias("value"))
    calls = nation.groupBy("n_regionkey").agg(F.concat_ws("\n", F.collect_list(F.format_string("xn%s p nation%s", F.col("n_nationkey").cast("string"), F.col("n_nationkey").cast("string")))).alias("text"))
    mid = calls.select(F.format_string(".subckt region%s p\n%s\n.ends", F.col("n_regionkey").cast("string"), "text").alias("value"))
    top = region.select(F.format_string("x%s bus region%s", F.replace(F.lower("r_name"), F.lit(" "), F.lit("_")), F.col("r_regionkey").cast("string")).alias("value"))
    for k, part in enumerate((low, mid, top)):
        part.write.text(f"{path}/level{k}")
    flat = netlists.flatten(formats.read_cards(spark, f"{path}/*/*.txt"))
    return flat.select("path", "type", F.round(F.col("params")["value"], 4).alias("value"), "nets")


QUERIES, ORACLES = C.queries, C.oracles
