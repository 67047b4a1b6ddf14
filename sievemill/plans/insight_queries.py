"""Findings around events, dividers, fingerprints and compliance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.operators import insights as n
from sievemill.operators import sequence as q

from .inputs import SAMPLES_SQL, Catalog, rounded, samples, table
from .sequence_queries import BITS, FLOOR

C = Catalog()


def pins(spark, sf):
    return samples(spark, sf).withColumn("pin", F.col("idx") % 7 * 1.5).withColumn("current", F.col("value") - 20)


@C.add(
    BITS + """, w AS (SELECT e.run_key, e.idx, arg_max(CAST(x.idx % 7 * 1.5 AS DOUBLE), (abs(x.value - 20), -x.idx)) AS v FROM e JOIN s x ON x.run_key = e.run_key AND x.idx BETWEEN e.idx - 5 AND e.idx + 5 WHERE e.rise <> 0 GROUP BY ALL),
 sp AS (SELECT run_key, max(idx % 7 * 1.5) - min(idx % 7 * 1.5) AS span FROM s GROUP BY 1), f AS (SELECT run_key, median(v) AS threshold, stddev_pop(v) AS spread, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 2)
 SELECT run_key, round(threshold, 6) AS threshold, round(spread, 6) AS spread, n, round(1 / (1 + spread / span), 6) AS confidence FROM f JOIN sp USING (run_key) WHERE span > 0"""
)
def effective_thresholds(spark, sf):
    return rounded(n.effective_threshold(pins(spark, sf), "pin"))


@C.add(
    FLOOR + BITS[BITS.index(", b AS (") :] + """, m AS (SELECT run_key, idx, rise, avg(value) OVER (PARTITION BY run_key ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before,
  avg(value) OVER (PARTITION BY run_key ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS after FROM e),
 h AS (SELECT run_key, count(*) AS edges, avg(CAST(sign(after - before) = rise AS INTEGER)) AS a, median(abs(after - before)) AS step FROM m WHERE rise <> 0 AND after IS NOT NULL AND before IS NOT NULL GROUP BY 1)
 SELECT run_key, edges, round(greatest(a, 1 - a), 6) AS consistency, round(step, 6) AS step FROM h JOIN fl USING (run_key) WHERE edges >= 2 AND greatest(a, 1 - a) >= 0.6 AND step > 1 * floor"""
)
def dummy_loads(spark, sf):
    s = samples(spark, sf)
    w = q.edge_windows(s, 4, 1).filter("before IS NOT NULL AND after IS NOT NULL").withColumn("v_before", F.lit(1.0)).withColumn("v_after", F.lit(1.0))
    return rounded(n.dummy_loads(w, q.noise_floor(s), 1.0))


@C.add(
    BITS + """, w AS (SELECT run_key, idx, rise, max(abs(value)) OVER (p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS peak, median(abs(value)) OVER (p ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b,
  median(abs(value)) OVER (p ROWS BETWEEN 4 FOLLOWING AND 7 FOLLOWING) AS a FROM e WINDOW p AS (PARTITION BY run_key ORDER BY idx))
 SELECT run_key, idx, peak, round(greatest(coalesce(b, 0), coalesce(a, 0)), 6) AS flank, round(peak / nullif(greatest(coalesce(b, 0), coalesce(a, 0)), 0), 6) AS ratio FROM w WHERE rise <> 0"""
)
def shoot_through(spark, sf):
    return rounded(n.shoot_through(samples(spark, sf), 4))


@C.add(
    BITS + """, a AS (SELECT run_key, idx, value, (abs(value - 20) + abs(lag(value - 20) OVER p)) / 2 * (t - lag(t) OVER p) AS q FROM s WINDOW p AS (PARTITION BY run_key ORDER BY idx)),
 g AS (SELECT run_key, sum(q) AS q, arg_max(value, idx) - arg_min(value, idx) AS dv, count(*) AS n FROM a GROUP BY 1) SELECT run_key, round(q, 2) AS q, round(dv, 2) AS dv, round(q / abs(dv), 2) AS capacitance FROM g WHERE n >= 3 AND abs(dv) > 1e-3"""
)
def inrush_capacitance(spark, sf):
    return rounded(n.inrush_capacitance(pins(spark, sf)), 2)


@C.add("SELECT l_returnflag, round(median(CASE WHEN l_tax / nullif(l_discount, 0) > 0 THEN l_tax / nullif(l_discount, 0) END), 6) AS ratio, count(CASE WHEN l_tax / nullif(l_discount, 0) > 0 THEN 1 END) AS n FROM lineitem GROUP BY 1")
def divider_ratios(spark, sf):
    return rounded(n.divider_ratio(table(spark, sf, "lineitem").select("l_returnflag", F.col("l_tax").alias("fb"), F.col("l_discount").alias("out")), ["l_returnflag"]))


@C.add("SELECT p_type AS role, count(*) AS total, count(*) FILTER (p_size > 25) AS with_current FROM part GROUP BY 1")
def probe_coverage(spark, sf):
    return n.probe_coverage(table(spark, sf, "part").select(F.col("p_type").alias("role"), (F.col("p_size") > 25).alias("with_current")))


@C.add("WITH t AS (SELECT DISTINCT p_type AS type FROM part UNION SELECT 'NONE') SELECT t.type, count(p_partkey) AS n, round(coalesce(avg(p_size), 0), 6) AS mean, round(coalesce(stddev_pop(p_size), 0), 6) AS std, coalesce(min(p_size), 0) AS min, coalesce(max(p_size), 0) AS max, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS sum FROM t LEFT JOIN part ON p_type = t.type GROUP BY t.type")
def size_statistics(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    types = sorted(r[0] for r in parts.select("type").distinct().collect())  # names of types: a dimension
    return rounded(n.size_statistics(parts, [*types, "NONE"]))


GRAPH = """WITH e0 AS (SELECT n_nationkey AS a, CAST((n_nationkey * 2 + 1) % 25 AS INTEGER) AS b FROM nation UNION SELECT n_nationkey, CAST((n_nationkey + 5) % 25 AS INTEGER) FROM nation UNION SELECT n_nationkey, CAST((n_nationkey + 1) % 25 AS INTEGER) FROM nation),
 e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e0 WHERE a <> b), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), d AS (SELECT a AS node, count(*) AS d FROM u GROUP BY 1)"""


@C.add(
    GRAPH + """, t AS (SELECT x.a AS node, count(*) / 2 AS t FROM u x JOIN u y ON y.a = x.a AND x.b < y.b JOIN e z ON z.a = x.b AND z.b = y.b GROUP BY 1)
 SELECT node, d, round(CASE WHEN d > 1 THEN 2.0 * coalesce((SELECT count(*) FROM u x JOIN u y ON y.a = x.a AND x.b < y.b JOIN e z ON z.a = x.b AND z.b = y.b WHERE x.a = node), 0) / (d * (d - 1)) ELSE 0 END, 6) AS clustering FROM d"""
)
def graph_clustering(spark, sf):
    k = table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"))
    to = lambda x: k.select("a", (x % 25).cast("int").alias("b"))
    a = F.col("a")
    return rounded(n.clustering(to(a * 2 + 1).union(to(a + 5)).union(to(a + 1))))


@C.add(
    """WITH l AS (SELECT s_suppkey, s_acctbal / 10000 AS power, (s_nationkey % 5) / 5.0 AS area FROM supplier), w AS (SELECT *, (power * 2 + area * 1) / 3 AS loss FROM l)
 SELECT s_suppkey, round(power, 6) AS power, round(area, 6) AS area, round(loss, 6) AS loss, CASE WHEN loss <= 0.15 THEN 'A' WHEN loss <= 0.3 THEN 'B' WHEN loss <= 0.5 THEN 'C' ELSE 'D' END AS grade FROM w"""
)
def weighted_grades(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10000).alias("power"), ((F.col("s_nationkey") % 5) / 5).alias("area"))
    return rounded(n.weighted_loss(rows, {"power": 2.0, "area": 1.0}))


@C.add(
    """WITH sp AS (SELECT * FROM (VALUES ('ECONOMY', 10.0, 30.0), ('SMALL', NULL, 20.0), ('GHOST', 1.0, 2.0)) AS v(spec, lo, hi)), m AS (SELECT p_type AS spec, avg(p_size) AS value FROM part GROUP BY 1)
 SELECT spec, lo AS min, hi AS max, round(value, 6) AS value, value IS NOT NULL AS evaluated, CASE WHEN value IS NOT NULL THEN coalesce(value >= lo, true) AND coalesce(value <= hi, true) END AS passed FROM sp LEFT JOIN m USING (spec)"""
)
def spec_compliance(spark, sf):
    specs = spark.createDataFrame([("ECONOMY", 10.0, 30.0), ("SMALL", None, 20.0), ("GHOST", 1.0, 2.0)], "spec string, min double, max double")
    return rounded(n.compliance(specs, table(spark, sf, "part").groupBy(F.col("p_type").alias("spec")).agg(F.avg("p_size").alias("value"))))


@C.add(
    """WITH sh AS (SELECT r_regionkey AS pole, 1.0 + r_regionkey AS shift FROM region), se AS (SELECT s_nationkey % 5 AS pole, s_suppkey AS param, s_acctbal / 1000 AS slope, 1.0 + s_suppkey AS nominal FROM supplier),
 j AS (SELECT pole, param, shift / slope AS delta, abs(shift / slope / nominal) AS rel FROM sh JOIN se USING (pole) WHERE slope <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY pole ORDER BY rel, param) AS rank FROM j)
 SELECT CAST(pole AS INTEGER) AS pole, CAST(rank AS INTEGER) AS rank, param, round(delta, 6) AS delta, round(rel, 6) AS rel FROM r WHERE rank <= 3"""
)
def explained_shifts(spark, sf):
    shifts = table(spark, sf, "region").select(F.col("r_regionkey").alias("pole"), (F.lit(1.0) + F.col("r_regionkey")).alias("shift"))
    sens = table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).cast("int").alias("pole"), F.col("s_suppkey").alias("param"), (F.col("s_acctbal") / 1000).alias("slope"), (F.lit(1.0) + F.col("s_suppkey")).alias("nominal"))
    return rounded(n.explain_shift(shifts, sens))


@C.add("SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'ALL' ELSE 'P' || n_regionkey END AS process, string_agg(n_name, ',' ORDER BY n_name) AS runs FROM nation GROUP BY 1")
def runs_by_process(spark, sf):
    meta = F.when(F.col("n_nationkey") % 3 == 0, F.create_map(F.lit("x"), F.lit("y"))).otherwise(F.create_map(F.lit("corner"), F.concat(F.lit("P"), "n_regionkey")))
    return n.run_groups(table(spark, sf, "nation").select(F.col("n_name").alias("run_id"), meta.alias("meta"))).withColumn("runs", F.array_join("runs", ","))


@C.add(
    SAMPLES_SQL + """, a AS (SELECT run_key, idx, value AS a FROM s WHERE state <> 'error'), b AS (SELECT run_key, idx, value + idx % 3 AS b FROM s WHERE state <> 'view')
 SELECT run_key, round(avg((a - b) * (a - b)), 6) AS mse, round(avg(abs(a - b)), 6) AS mae, round(max(abs(a - b)), 6) AS worst, count(*) AS n FROM a JOIN b USING (run_key, idx) GROUP BY 1"""
)
def reference_comparison(spark, sf):
    s = samples(spark, sf)
    right = s.filter("state <> 'view'").select("run_key", "idx", (F.col("value") + F.col("idx") % 3).alias("value"))
    return rounded(n.reference_compare(s.filter("state <> 'error'").select("run_key", "idx", "value"), right, ["run_key"]))


@C.add(
    """WITH c AS (SELECT p_partkey AS chip_id, p_type AS spec FROM part), m AS (SELECT * FROM (VALUES ('ECONOMY', 1.0), ('small_size', 2.0), ('MED', 3.0), ('zzz', 4.0)) AS v(other, sim)),
 l AS (SELECT spec, arg_min(sim, other) AS l FROM (SELECT DISTINCT spec FROM c) JOIN m ON contains(lower(spec), lower(other)) OR contains(lower(other), lower(spec)) GROUP BY 1)
 SELECT chip_id, spec, coalesce(m.sim, l.l) AS sim FROM c LEFT JOIN m ON m.other = c.spec LEFT JOIN l USING (spec)"""
)
def silicon_matching(spark, sf):
    sims = spark.createDataFrame([("ECONOMY", 1.0), ("small_size", 2.0), ("MED", 3.0), ("zzz", 4.0)], "spec string, sim double")
    return n.silicon_match(table(spark, sf, "part").select(F.col("p_partkey").alias("chip_id"), F.col("p_type").alias("spec")), sims).select("chip_id", "spec", "sim")


QUERIES, ORACLES = C.queries, C.oracles
