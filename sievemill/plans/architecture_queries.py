"""Block diagrams made of suppliers: a design for each region, blocks in a ring with a supply."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.operators import architecture as arch
from sievemill.operators import graph as g

from .inputs import Catalog, rounded, table

C = Catalog()

DESIGNS = """WITH b AS (SELECT s_nationkey % 5 AS design, CASE WHEN s_suppkey < 3 THEN 'pmu' ELSE 'n' || s_suppkey END AS node,
   CASE s_suppkey % 5 WHEN 0 THEN 'digital' WHEN 1 THEN 'analog' WHEN 2 THEN 'mixed' WHEN 3 THEN 'io' ELSE 'memory' END AS kind, abs(s_acctbal) / 100 AS power, s_suppkey % 7 / 10.0 AS area, 10.0 + s_suppkey * 13 % 400 AS freq,
   ['IF' || s_suppkey % 3, 'can-fd'] AS faces FROM supplier),
 l AS (SELECT design, node AS src, 'n' || k AS dst, CASE WHEN node = 'pmu' THEN 'power' ELSE 'digital' END AS domain FROM (SELECT design, node, unnest([3, 4, 5, 6, 7, 8, 9]) AS k FROM b WHERE node IN ('pmu', 'n3', 'n4', 'n5'))),
 ex AS (SELECT * FROM (VALUES ('n3', 'n8'), ('pmu', 'n4'), ('n6', 'n7')) AS v(src, dst)), ds AS (SELECT DISTINCT design FROM b), st AS (SELECT unnest(['CAN', 'if1', 'USB']) AS std)"""


def designs(spark, sf):
    """blocks, links and specs."""
    k = F.col("s_suppkey")
    kind = F.when(k % 5 == 0, "digital").when(k % 5 == 1, "analog").when(k % 5 == 2, "mixed").when(k % 5 == 3, "io").otherwise("memory")
    blocks = table(spark, sf, "supplier").select(
        (F.col("s_nationkey") % 5).cast("int").alias("design"),
        F.when(k < 3, "pmu").otherwise(F.concat(F.lit("n"), k)).alias("node"),
        kind.alias("kind"),
        (F.abs("s_acctbal") / 100).alias("power"),
        (k % 7 / 10).alias("area"),
        (10.0 + k * 13 % 400).alias("frequency"),
        F.array(F.concat(F.lit("IF"), k % 3), F.lit("can-fd")).alias("interfaces"),
    )
    fan = F.explode(F.array(*[F.lit(f"n{x}") for x in range(3, 10)]))
    links = blocks.filter(F.col("node").isin("pmu", "n3", "n4", "n5")).select("design", F.col("node").alias("src"), fan.alias("dst"))
    links = links.withColumn("domain", F.when(F.col("src") == "pmu", "power").otherwise("digital"))
    standards = F.array(F.lit("CAN"), F.lit("if1"), F.lit("USB"))
    specs = blocks.select("design").distinct().select("design", F.lit(500.0).alias("power_budget"), F.lit(2.0).alias("area_budget"), F.lit(100.0).alias("target_frequency"), standards.alias("standards"))
    return blocks, links, specs


@C.add(
    DESIGNS + """, t AS (SELECT design, sum(power) AS p, sum(area) AS a, coalesce(avg(CASE WHEN kind IN ('digital', 'mixed') THEN least(greatest((100 - freq) / 100, 0), 1) END), 0) AS timing, count(*) AS n, count(*) FILTER (kind IN ('analog', 'mixed')) AS quiet,
   max(CAST(node = 'pmu' AS INTEGER)) AS has FROM b GROUP BY 1),
 e AS (SELECT design, sum(greatest(k - 2, 0)) AS excess FROM (SELECT design, kind, count(*) AS k FROM b WHERE kind NOT IN ('io', 'memory') GROUP BY ALL) GROUP BY 1),
 w AS (SELECT l.design, count(*) FILTER (domain = 'digital') AS dig, count(*) FILTER (domain = 'digital' AND greatest(x.freq, y.freq) / greatest(least(x.freq, y.freq), 0.001) > 4) AS risky, count(*) FILTER (domain = 'digital' AND y.kind IN ('analog', 'mixed')) AS noisy
   FROM l JOIN b x ON x.design = l.design AND x.node = src JOIN b y ON y.design = l.design AND y.node = dst GROUP BY 1),
 f AS (SELECT b.design, count(*) AS fed FROM b WHERE (design, node) IN (SELECT design, dst FROM l WHERE src = 'pmu' AND domain = 'power') GROUP BY 1),
 c AS (SELECT x.design, avg(CASE WHEN (x.design, ex.src, ex.dst) IN (SELECT design, src, dst FROM l) THEN 0.0 ELSE 1.0 END) AS missing FROM ex JOIN b x ON x.node = ex.src JOIN b y ON y.node = ex.dst AND y.design = x.design GROUP BY 1),
 v AS (SELECT ds.design, avg(CASE WHEN EXISTS (SELECT 1 FROM (SELECT design, unnest(faces) AS face FROM b) q WHERE q.design = ds.design AND (contains(lower(face), lower(std)) OR contains(lower(std), lower(face)))) THEN 0.0 ELSE 1.0 END) AS missing FROM ds, st GROUP BY 1),
 r AS (SELECT t.design, p / 500 AS power, a / 2.0 AS area, timing, coalesce(c.missing, 0) AS connectivity, v.missing AS coverage, coalesce(CASE WHEN dig > 0 THEN risky / dig END, 0) AS crossing,
   least(coalesce(CASE WHEN quiet > 0 THEN noisy / quiet END, 0), 1) AS isolation, least(coalesce(excess, 0) / n, 1) AS redundancy, CASE WHEN has = 0 THEN 1 ELSE coalesce((n - has - coalesce(fed, 0)) / nullif(n - has, 0), 0) END AS supply
   FROM t LEFT JOIN e USING (design) LEFT JOIN w USING (design) LEFT JOIN f USING (design) LEFT JOIN c USING (design) LEFT JOIN v USING (design)),
 g AS (SELECT *, (power * 2 + area + timing + connectivity + coverage + crossing + isolation + redundancy + supply) / 10 AS loss FROM r), h AS (SELECT *, round(greatest(0, 1 - loss / 2), 4) AS score FROM g)
 SELECT CAST(design AS INTEGER) AS design, round(power, 6) AS power, round(area, 6) AS area, round(timing, 6) AS timing, round(connectivity, 6) AS connectivity, round(coverage, 6) AS coverage, round(crossing, 6) AS crossing, round(isolation, 6) AS isolation,
   round(redundancy, 6) AS redundancy, round(supply, 6) AS supply, round(loss, 6) AS loss, score, CASE WHEN score >= 0.9 THEN 'A+' WHEN score >= 0.85 THEN 'A' WHEN score >= 0.78 THEN 'A-' WHEN score >= 0.72 THEN 'B+' WHEN score >= 0.65 THEN 'B'
   WHEN score >= 0.58 THEN 'B-' WHEN score >= 0.5 THEN 'C+' WHEN score >= 0.42 THEN 'C' WHEN score >= 0.35 THEN 'C-' WHEN score >= 0.25 THEN 'D' ELSE 'F' END AS grade FROM h"""
)
def architecture_grades(spark, sf):
    blocks, links, specs = designs(spark, sf)
    expected = spark.createDataFrame([("n3", "n8"), ("pmu", "n4"), ("n6", "n7")], "src string, dst string")
    weights = dict.fromkeys(arch.LOSSES, 1.0) | {"power": 2.0}
    return rounded(arch.graded(arch.losses(blocks, links, specs, expected), weights))


@C.add(
    DESIGNS + """, i AS (SELECT l.*, x.freq AS fs, y.freq AS fd FROM l JOIN b x ON x.design = l.design AND x.node = src JOIN b y ON y.design = l.design AND y.node = dst),
 o AS (SELECT design, src AS node, string_agg(DISTINCT dst, ',' ORDER BY dst) AS v FROM i WHERE domain <> 'power' GROUP BY ALL), d AS (SELECT design, dst AS node, string_agg(DISTINCT src, ',' ORDER BY src) AS v FROM i WHERE domain <> 'power' GROUP BY ALL),
 p AS (SELECT design, dst AS node, string_agg(DISTINCT src, ',' ORDER BY src) AS v FROM i WHERE domain = 'power' GROUP BY ALL), q AS (SELECT * FROM i WHERE domain = 'digital' AND greatest(fs, fd) / greatest(least(fs, fd), 0.01) > 2),
 n AS (SELECT design, node, string_agg(DISTINCT note, ',' ORDER BY note) AS v FROM (SELECT design, src AS node, dst || ' (' || CAST(round(fd) AS BIGINT) || 'MHz)' AS note FROM q UNION ALL SELECT design, dst, src || ' (' || CAST(round(fs) AS BIGINT) || 'MHz)' FROM q) GROUP BY ALL)
 SELECT CAST(b.design AS INTEGER) AS design, b.node, round(power * 1.15, 6) AS max_power, round(area * 1.1, 6) AS max_area, least(freq, 100.0) AS frequency, coalesce(o.v, '') AS drives, coalesce(d.v, '') AS driven_by, coalesce(p.v, '') AS powered_by, coalesce(n.v, '') AS crossings
 FROM b LEFT JOIN o USING (design, node) LEFT JOIN d USING (design, node) LEFT JOIN p USING (design, node) LEFT JOIN n USING (design, node)"""
)
def design_briefs(spark, sf):
    made = arch.briefs(*designs(spark, sf))
    return rounded(made.withColumns({c: F.array_join(c, ",") for c in ("drives", "driven_by", "powered_by", "crossings")}))


@C.add(
    DESIGNS + """, e AS (SELECT DISTINCT design, src, dst FROM l), x0 AS (SELECT design, node, power AS p, area AS a FROM b),
 m1 AS (SELECT e.design, src AS node, avg(p) AS mp, avg(a) AS ma FROM e JOIN x0 ON x0.design = e.design AND x0.node = e.dst GROUP BY ALL),
 h1 AS (SELECT design, node, 0.01 * p + 0.5 * coalesce(ma, 0) AS u, a - 0.02 * coalesce(mp, 0) AS v FROM x0 LEFT JOIN m1 USING (design, node)), x1 AS (SELECT design, node, CASE WHEN u * u + v * v > 0 THEN u / sqrt(u * u + v * v) ELSE u END AS p, CASE WHEN u * u + v * v > 0 THEN v / sqrt(u * u + v * v) ELSE v END AS a FROM h1),
 m2 AS (SELECT e.design, src AS node, avg(p) AS mp, avg(a) AS ma FROM e JOIN x1 ON x1.design = e.design AND x1.node = e.dst GROUP BY ALL),
 h2 AS (SELECT design, node, p + 0.5 * coalesce(mp, 0) AS u, a + 0.5 * coalesce(ma, 0) AS v FROM x1 LEFT JOIN m2 USING (design, node)), x2 AS (SELECT design, CASE WHEN u * u + v * v > 0 THEN u / sqrt(u * u + v * v) ELSE u END AS p, CASE WHEN u * u + v * v > 0 THEN v / sqrt(u * u + v * v) ELSE v END AS a FROM h2)
 SELECT CAST(d.design AS INTEGER) AS design, round(d.p, 5) AS v0, round(d.a, 5) AS v1, round(t.p / 500, 5) AS v2, round(t.a / 2, 5) AS v3, round(t.n / 20.0, 5) AS v5, round(coalesce(k.n, 0) / 50.0, 5) AS v6
 FROM (SELECT design, avg(p) AS p, avg(a) AS a FROM x2 GROUP BY 1) d JOIN (SELECT design, sum(power) AS p, sum(area) AS a, count(*) AS n FROM b GROUP BY 1) t USING (design) LEFT JOIN (SELECT design, count(*) AS n FROM l GROUP BY 1) k USING (design)"""
)
def design_vectors(spark, sf):
    """Two layers with fixed weights over power and area."""
    blocks, links, specs = designs(spark, sf)
    features = blocks.select("design", "node", F.array("power", "area").alias("x"))
    layers = [([[0.01, 0.0], [0.0, 1.0]], [[0.0, 0.5], [-0.02, 0.0]]), ([[1.0, 0.0], [0.0, 1.0]], [[0.5, 0.0], [0.0, 0.5]])]
    latency = specs.select("design", F.lit(0.0).alias("total"))
    made = g.encode_designs(links.select("design", "src", "dst").distinct(), features, layers, arch.design_numbers(blocks, links, specs, latency))
    return rounded(made.select("design", *[F.col("vector")[k].alias(f"v{k}") for k in (0, 1, 2, 3, 5, 6)]), 5)


QUERIES, ORACLES = C.queries, C.oracles
