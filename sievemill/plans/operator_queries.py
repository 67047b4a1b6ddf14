"""Queries over operators that the other modules of this package leave out: runs, features, machines, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions import scalar as fn
from sievemill.operators import coverage as cov
from sievemill.operators import features as ft
from sievemill.operators import graph as gr
from sievemill.operators import insights as ins
from sievemill.operators import kernels as k
from sievemill.operators import lookup as lk
from sievemill.operators import machines as mc
from sievemill.operators import networks as nw
from sievemill.operators import sequence
from sievemill.operators import states as st
from sievemill.sources import runs

from .inputs import SAMPLES_SQL as S
from .inputs import Catalog, rounded, samples, table

C = Catalog()


def as_runs(spark, sf):
    """events as the run container has them: one signal an event type."""
    return samples(spark, sf).select(F.col("run_key").cast("string").alias("run_id"), F.lit("").alias("corner_id"), F.col("state").alias("signal"), "idx", "t", "value")


@C.add(
    S + """, c AS (SELECT *, CAST(value IS DISTINCT FROM lag(value) OVER (PARTITION BY run_key, state ORDER BY idx) AS INTEGER) AS c FROM s)
 SELECT CAST(run_key AS VARCHAR) AS run_id, '' AS corner_id, round(min(t), 6) AS t_min, round(max(t), 6) AS t_max, count(*) AS samples, count(DISTINCT state) AS signals, round(100.0 * sum(c) / count(*), 6) AS changed_pct FROM c GROUP BY run_key"""
)
def run_profiles(spark, sf):
    return rounded(runs.profile(as_runs(spark, sf)))


@C.add(S + " SELECT state AS base, CASE WHEN idx % 2 = 0 THEN 'current' ELSE 'voltage' END AS kind, count(DISTINCT run_key) AS runs FROM s GROUP BY ALL")
def run_signals(spark, sf):
    named = as_runs(spark, sf).withColumn("signal", F.concat("signal", F.when(F.col("idx") % 2 == 0, "$flow").otherwise("")))
    return runs.signal_names(named).select("base", "kind", F.size("runs").cast("long").alias("runs"))


@C.add(S + " SELECT CAST(run_key AS VARCHAR) AS run_id, '' AS corner_id, idx, max(CASE WHEN state = 'click' THEN value END) AS click, max(CASE WHEN state = 'view' THEN value END) AS \"view\", max(CASE WHEN state = 'none' THEN value END) AS none FROM s GROUP BY run_key, idx")
def run_matrices(spark, sf):
    """A signal that no run has is a column of nulls."""
    return runs.run_matrix(as_runs(spark, sf), ["click", "view", "none"]).withColumn("none", F.col("none").cast("double"))


@C.add(S + " SELECT CAST(run_key AS VARCHAR) AS run_id, count(DISTINCT state) AS n_signals, count(DISTINCT idx) AS ntime, CAST(row_number() OVER (ORDER BY CAST(run_key AS VARCHAR)) AS INTEGER) AS run_number, 'TT' AS corner_id FROM s GROUP BY run_key")
def numbered_runs(spark, sf):
    return runs.number_runs(as_runs(spark, sf), "TT")


@C.add(S + " SELECT CAST(run_key AS VARCHAR) AS run_id, state AS signal, count(*) AS n FROM s WHERE run_key IN (1, 2) GROUP BY ALL")
def selected_runs(spark, sf):
    """The selection by name is the operator: one run by its name, one with its corner."""
    return runs.select_runs(as_runs(spark, sf), ["1", "2@"]).groupBy("run_id", "signal").agg(F.count(F.lit(1)).alias("n"))


@C.add(
    """WITH r AS (SELECT o_orderpriority AS corner, NULLIF(o_orderstatus, 'O') AS state, 'price' AS param, max(o_totalprice) AS value FROM orders GROUP BY ALL)
 SELECT a.corner, a.state, a.param, round(a.value, 6) AS value, round(a.value - b.value, 6) AS delta FROM r a JOIN r b ON b.state IS NULL AND a.state IS NOT NULL AND a.corner = b.corner WHERE a.value <> b.value"""
)
def state_parameter_changes(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("corner"), F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("state"), F.lit("price").alias("param")).agg(F.max("o_totalprice").alias("value"))
    return rounded(runs.state_parameters(o))


@C.add(
    """WITH r AS (SELECT DISTINCT 'brand' AS key, p_brand AS value FROM part UNION SELECT DISTINCT 'size', CAST(p_size AS VARCHAR) FROM part)
 SELECT key, value, CASE WHEN key = 'size' THEN CAST(value AS DOUBLE) ELSE CAST(dense_rank() OVER (PARTITION BY key ORDER BY value) - 1 AS DOUBLE) END AS code
 FROM (SELECT key, value, CASE WHEN key = 'size' THEN value END AS n FROM r)"""
)
def encoded_metadata(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(F.lit("brand").alias("key"), F.col("p_brand").alias("value")).union(p.select(F.lit("size"), F.col("p_size").cast("string"))).distinct()
    return ft.encode_meta(rows)


@C.add(
    """WITH m AS (SELECT avg(o_totalprice) AS ma, stddev_pop(o_totalprice) AS sa, avg(o_custkey) AS mb, stddev_pop(o_custkey) AS sb FROM orders)
 SELECT o_orderpriority, round(avg(((o_totalprice - ma) / sa + (o_custkey - mb) / sb) / 2), 6) AS code, count(*) AS n FROM orders, m GROUP BY 1"""
)
def category_codes(spark, sf):
    return rounded(ft.target_codes(table(spark, sf, "orders"), "o_orderpriority", ["o_totalprice", "o_custkey"]))


@C.add("SELECT p_partkey, p_type, CAST(p_type = 'SMALL' AS INTEGER) AS \"p_type_SMALL\", CAST(p_type = 'ECONOMY' AS INTEGER) AS \"p_type_ECONOMY\" FROM part")
def one_hot_types(spark, sf):
    return ft.one_hot(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", ["SMALL", "ECONOMY"])


@C.add("WITH x AS (SELECT stddev_pop(l_quantity) AS a, stddev_pop(l_extendedprice) AS b, corr(l_quantity, l_extendedprice) AS c FROM lineitem) SELECT 'l_quantity' AS kept FROM x WHERE a > 1e-8 UNION ALL SELECT 'l_extendedprice' FROM x WHERE b > 1e-8 AND abs(c) <= 0.999")
def telling_columns(spark, sf):
    """A constant column and a multiple of another one go."""
    li = table(spark, sf, "lineitem").select("l_quantity", F.lit(1.0).alias("flat"), (F.col("l_quantity") * 2).alias("double"), "l_extendedprice")
    return spark.createDataFrame([(c,) for c in ft.drop_flat_columns(li, ["l_quantity", "flat", "double", "l_extendedprice"])], "kept string")


@C.add(
    """WITH e AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_discount) AS d0, max(l_discount) AS d1, min(l_tax) AS t0, max(l_tax) AS t1 FROM lineitem),
 b AS (SELECT least(floor((l_tax - t0) * (16 / (t1 - t0))), 15) AS y, least(floor((l_quantity - q0) * (16 / (q1 - q0))), 15) AS l_quantity, least(floor((l_discount - d0) * (16 / (d1 - d0))), 15) AS l_discount FROM lineitem, e),
 u AS (SELECT 'l_quantity' AS feature, l_quantity AS x, y FROM b UNION ALL SELECT 'l_discount', l_discount, y FROM b), j AS (SELECT feature, x, y, count(*) AS n FROM u GROUP BY ALL),
 w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM j)
 SELECT feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM w GROUP BY feature"""
)
def feature_information(spark, sf):
    return rounded(ft.mutual_information(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_tax"))


@C.add(S + ", p AS (SELECT *, max(abs(value)) OVER (PARTITION BY run_key) AS peak FROM s) SELECT run_key, idx, CASE WHEN state <> 'view' THEN state NOT IN ('error', 'signup') ELSE abs(value) > 0.05 * peak END AS active FROM p")
def active_samples(spark, sf):
    s = samples(spark, sf)
    peaks = s.groupBy("run_key").agg(F.max(F.abs("value")).alias("peak"))
    return s.join(peaks, "run_key").select("run_key", "idx", mc.active(F.nullif(F.col("state"), F.lit("view")), F.col("value"), F.col("peak"), ["error", "signup"]).alias("active"))


@C.add(S + " SELECT run_key, idx, CAST(idx % 4 AS INTEGER) AS state_id, CASE idx % 4 WHEN 0 THEN 'OFF' WHEN 2 THEN 'ON' ELSE 'STATE_' || CAST(idx % 4 AS VARCHAR) END AS name FROM s")
def named_states(spark, sf):
    s = samples(spark, sf).select("run_key", "idx", (F.col("idx") % 4).cast("int").alias("state_id"))
    return mc.named_states(s, spark.createDataFrame([(0, "OFF"), (2, "ON")], "state_id int, name string")).select("run_key", "idx", "state_id", "name")


@C.add("SELECT o_orderkey, 'r' || CAST(o_custkey % 4 AS VARCHAR) AS run, o_orderstatus AS corner, CASE WHEN o_custkey % 4 = 1 AND o_orderstatus = 'F' THEN 'own' WHEN o_custkey % 4 = 1 THEN 'of the run' WHEN o_custkey % 4 = 2 THEN 'second' END AS sequence FROM orders")
def sequences_by_run_or_corner(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("r"), (F.col("o_custkey") % 4).cast("string")).alias("run"), F.col("o_orderstatus").alias("corner"))
    return mc.with_fallback_key(o, spark.createDataFrame([("r1@F", "own"), ("r1", "of the run"), ("r2", "second")], "key string, sequence string"))


@C.add("SELECT p_partkey, concat_ws(' && ', CASE WHEN p_size % 2 <> p_partkey % 2 THEN 'en == ' || p_partkey % 2 END, CASE WHEN p_size % 3 <> p_partkey % 3 THEN 'mode == ' || p_partkey % 3 END) AS guard FROM part")
def transition_guards(spark, sf):
    bits = lambda c: F.create_map(F.lit("mode"), F.col(c) % 3, F.lit("en"), F.col(c) % 2)
    return table(spark, sf, "part").select("p_partkey", bits("p_size").alias("before"), bits("p_partkey").alias("after")).select("p_partkey", st.changed_bits_guard().alias("guard"))


@C.add(S + ", v AS (SELECT DISTINCT state FROM s UNION SELECT 'OFF') SELECT count(*) AS states, count(*) FILTER (state IN ('click', 'view', 'error')) AS reachable, count(*) FILTER (state IN ('click', 'view', 'signup', 'OFF')) AS complete, CAST(1 AS BIGINT) AS ambiguous, false AS deterministic, round(100.0 * count(*) FILTER (state <> 'OFF') / count(*), 6) AS seen_pct FROM v")
def machine_reports(spark, sf):
    moves = spark.createDataFrame([("click", "view", "a"), ("view", "error", "b"), ("signup", "click", "a"), ("click", "error", "a")], "src string, dst string, guard string")
    seen = table(spark, sf, "events").select(F.col("event_type").alias("state"))
    return rounded(st.machine_report(seen.distinct().union(spark.sql("SELECT 'OFF'")), moves, "click", ["OFF"], seen))


@C.add("SELECT count(*) AS blocks, CAST(sum(p_size) AS BIGINT) AS area, round(sum(p_retailprice), 4) AS power, arg_max(p_partkey, (p_retailprice, p_partkey)) AS hungriest, (SELECT count(*) FROM lineitem) AS links FROM part")
def design_totals(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("area"), F.col("p_retailprice").alias("power"))
    return rounded(mc.graph_totals(p, table(spark, sf, "lineitem")), 4)


@C.add(
    """WITH o AS (SELECT c_nationkey AS design, 'i' || c_custkey % 37 AS item, c_acctbal AS score, c_custkey < 10 AS mine FROM customer)
 SELECT item, round(sum(design / 25.0 * score), 4) AS score FROM o WHERE NOT mine AND design / 25.0 > 0.7 AND item NOT IN (SELECT item FROM o WHERE mine) GROUP BY item ORDER BY sum(design / 25.0 * score) DESC, item LIMIT 5"""
)
def recommended_items(spark, sf):
    c = table(spark, sf, "customer")
    owned = c.select(F.col("c_nationkey").alias("design"), F.concat(F.lit("i"), F.col("c_custkey") % 37).alias("item"), F.col("c_acctbal").alias("score"), (F.col("c_custkey") < 10).alias("mine"))
    return rounded(ft.recommend(table(spark, sf, "nation").select(F.col("n_nationkey").alias("design"), (F.col("n_nationkey") / 25).alias("sim")), owned), 4)


@C.add("SELECT p_size AS candidate, round(avg(p_retailprice), 6) AS u FROM part GROUP BY 1 ORDER BY avg(p_retailprice) DESC, 1 LIMIT 1")
def next_samples(spark, sf):
    return rounded(ft.next_sample(table(spark, sf, "part").select(F.col("p_size").alias("candidate"), F.col("p_retailprice").alias("std"))))


FINDINGS = "WITH f AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity, 'order ' || o_orderkey AS summary, CASE WHEN o_orderstatus = 'F' THEN 'check it' END AS action FROM orders)"


def findings(spark, sf):
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    return table(spark, sf, "orders").select("o_orderkey", severity.alias("severity"), F.concat(F.lit("order "), "o_orderkey").alias("summary"), F.when(F.col("o_orderstatus") == "F", "check it").alias("action"))


@C.add(FINDINGS + " SELECT o_orderkey, severity FROM f ORDER BY list_position(['critical', 'high', 'medium', 'low', 'info'], severity), o_orderkey LIMIT 100")
def worst_findings(spark, sf):
    """The first hundred of a report."""
    return mc.ordered_findings(findings(spark, sf), "o_orderkey").limit(100).select("o_orderkey", "severity")


@C.add(FINDINGS + " SELECT o_orderkey, '- **' || upper(severity) || '** ' || summary || CASE WHEN action IS NOT NULL THEN ' (' || action || ')' ELSE '' END AS markdown FROM f")
def finding_texts(spark, sf):
    return mc.finding_lines(findings(spark, sf)).select("o_orderkey", "markdown")


@C.add("SELECT '<testcase classname=\"a&amp;b\" name=\"' || o_orderkey || '\"' || CASE WHEN o_orderstatus = 'F' THEN '><failure message=\"&lt;' || o_orderpriority || '\"/></testcase>' ELSE '/>' END AS element FROM orders")
def junit_elements(spark, sf):
    o = table(spark, sf, "orders")
    return mc.junit_cases(o.select(F.lit("a&b").alias("checker"), F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("PASS").alias("status"), F.concat(F.lit("<"), "o_orderpriority").alias("message")))


@C.add(
    S + """, m AS (SELECT DISTINCT state AS src, lead(state) OVER (PARTITION BY run_key ORDER BY idx) AS dst FROM s), p AS (SELECT src, dst FROM m WHERE dst IS NOT NULL),
 a AS (SELECT unnest(CASE WHEN src = 'click' THEN ['click_fast', 'click_slow'] ELSE [src] END) AS src, dst FROM p), b AS (SELECT src, unnest(CASE WHEN dst = 'click' THEN ['click_fast', 'click_slow'] ELSE [dst] END) AS dst FROM a)
 SELECT DISTINCT src, dst FROM b WHERE src <> dst"""
)
def moves_by_mode(spark, sf):
    s = samples(spark, sf)
    moves = s.select(F.col("state").alias("src"), F.lead("state").over(st.by_run()).alias("dst")).filter("dst IS NOT NULL").distinct()
    return mc.split_modes(s.select("state").distinct(), moves, "click", ["fast", "slow"])[1]


@C.add(
    S + """, d AS (SELECT DISTINCT state FROM s), p AS (SELECT DISTINCT state AS src, lead(state) OVER (PARTITION BY run_key ORDER BY idx) AS dst FROM s)
 SELECT 'state' AS kind, 'OFF' AS subject, 'drive into OFF' AS action UNION ALL
 SELECT 'transition', a.state || '->' || b.state, 'stay in ' || a.state || ', then go to ' || b.state FROM d a, (SELECT state FROM d UNION ALL SELECT 'OFF') b WHERE a.state <> b.state AND NOT EXISTS (SELECT 1 FROM p WHERE src = a.state AND dst = b.state) UNION ALL
 SELECT 'dwell', state, 'stay longer in ' || state FROM s GROUP BY state HAVING count(*) < 1000000"""
)
def coverage_gaps(spark, sf):
    s = samples(spark, sf)
    d = s.select("state").distinct()
    off = spark.sql("SELECT 'OFF' AS state")
    moves = s.select(F.col("state").alias("src"), F.lead("state").over(st.by_run()).alias("dst")).distinct()
    wanted = d.select(F.col("state").alias("src")).join(d.union(off).select(F.col("state").alias("dst")), F.col("src") != F.col("dst"))  # names of states
    return cov.gap_report(off, wanted.join(moves, ["src", "dst"], "left_anti"), st.thin_states(s, d, 1_000_000))


@C.add(
    """WITH t AS (SELECT o_orderkey, list_distinct(list_filter(regexp_split_to_array(lower(o_orderpriority), '[^a-z0-9_]+'), lambda x: x <> '')) AS a, ['1', 'urgent', 'high', '2'] AS b FROM orders)
 SELECT o_orderkey, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS overlap FROM t"""
)
def token_overlaps(spark, sf):
    return rounded(table(spark, sf, "orders").select("o_orderkey", mc.token_overlap(F.col("o_orderpriority"), F.lit("1 urgent, HIGH (2)")).alias("overlap")))


@C.add("SELECT l_orderkey, l_linenumber, l_quantity >= 10 AND l_discount - 0.05 >= -1e-12 AS passive FROM lineitem")
def passive_networks(spark, sf):
    """A complex pair that is stable from a quantity of ten on, and a real pole whose residue may be negative."""
    c = lambda re, im: F.struct(re.cast("double").alias("re"), F.lit(im).cast("double").alias("im"))
    poles = F.array(c(10 - F.col("l_quantity"), 2.0), c(10 - F.col("l_quantity"), -2.0), c(F.lit(-1.0), 0.0))
    residues = F.array(c(F.lit(-1.0), 1.0), c(F.lit(-1.0), -1.0), c(F.round(F.col("l_discount") - 0.05, 9), 0.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.is_passive(poles, residues).alias("passive"))


@C.add("SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def linear_fit(spark, sf):
    m = ft.fit_linear(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(m["intercept"], 3), round(m["l_quantity"], 3), round(m["r2"], 6))], "intercept double, slope double, r2 double")


@C.add("SELECT l_orderkey, l_linenumber, round(a * a, 6) AS aa, round(a * b, 6) AS ab, round(b * b, 6) AS bb FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax AS b FROM lineitem)")
def polynomial_features(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"))
    out, names = ft.polynomial_terms(li, ["a", "b"], 2)
    return rounded(out.select("l_orderkey", "l_linenumber", *[F.col(f"`{n}`").alias(n.replace("*", "")) for n in names if "*" in n]))


@C.add(
    """WITH n AS (SELECT p_partkey AS state_id, CASE WHEN p_partkey % 7 = 0 THEN 'FAULT' WHEN p_size % 2 = 0 THEN 'DISABLED' WHEN p_size % 3 = 0 THEN 'REGULATION' ELSE 'STARTUP' END AS base FROM part),
 k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY state_id) AS k FROM n) SELECT state_id, CASE WHEN k = 1 OR base = 'DISABLED' THEN base ELSE base || '_' || k END AS name FROM k"""
)
def state_names(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("state_id"), (F.col("p_size") % 2).alias("enable"), (F.col("p_partkey") % 7 == 0).cast("int").alias("fault"), (F.col("p_size") % 3 == 0).cast("int").alias("ready"))
    return mc.name_states(p).select("state_id", "name")


@C.add("SELECT standard FROM (VALUES ('AXI4 lite'), ('brand#1'), ('SPI')) AS v(standard) WHERE NOT EXISTS (SELECT 1 FROM part WHERE contains(lower(standard), lower(p_brand)) OR contains(lower(p_brand), lower(standard)))")
def unmet_standards(spark, sf):
    wanted = spark.createDataFrame([("AXI4 lite",), ("brand#1",), ("SPI",)], "standard string")
    return mc.unmet_interfaces(wanted, table(spark, sf, "part").select(F.col("p_brand").alias("interface")).distinct())


@C.add(
    """WITH r AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_quantity * 1.7 AS x, l_discount * 100 + 0.5 AS y FROM lineitem), g AS (SELECT a * 10.0 AS gx, b * 2.0 AS gy FROM range(9) t(a), range(6) u(b)),
 n AS (SELECT id, arg_min(gx * gx + gy, ((x - gx) * (x - gx) + (y - gy) * (y - gy), gx, gy)) AS z FROM r, g WHERE x > 80 OR y > 10 GROUP BY id, x, y),
 f AS (SELECT *, floor(x / 10) * 10 AS x0, floor(y / 2) * 2 AS y0 FROM r WHERE x <= 80 AND y <= 10), h AS (SELECT *, CASE WHEN x = x0 THEN x0 ELSE x0 + 10 END AS x1, CASE WHEN y = y0 THEN y0 ELSE y0 + 2 END AS y1 FROM f),
 z AS (SELECT *, CASE WHEN x1 > x0 THEN (x - x0) / 10 ELSE 0 END AS fx, CASE WHEN y1 > y0 THEN (y - y0) / 2 ELSE 0 END AS fy FROM h)
 SELECT id, round((1 - fx) * ((1 - fy) * (x0 * x0 + y0) + fy * (x0 * x0 + y1)) + fx * ((1 - fy) * (x1 * x1 + y0) + fy * (x1 * x1 + y1)), 4) AS z, false AS fallback FROM z UNION ALL SELECT id, round(z, 4), true FROM n"""
)
def lookup_with_fallback(spark, sf):
    grid = spark.range(0, 9).select((F.col("id") * 10.0).alias("gx")).join(F.broadcast(spark.range(0, 6).select((F.col("id") * 2.0).alias("gy"))))  # 54 points
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") * 1.7).alias("x"), (F.col("l_discount") * 100 + 0.5).alias("y")).distinct()
    return rounded(lk.bilinear_or_nearest(rows, grid.withColumn("gz", F.col("gx") * F.col("gx") + F.col("gy"))), 4)


@C.add("SELECT n_nationkey AS network, round(-0.5 - n_nationkey / 50.0, 4) AS re, round(s * (2 + n_nationkey / 10.0), 4) AS im FROM nation, (VALUES (1), (-1)) AS v(s)")
def identified_networks(spark, sf):
    """The poles of damped oscillations, one network a nation, found again from their samples."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("network"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("idx"), F.lit(0.05).alias("dt"), F.lit(0.0).alias("u"))
    t = F.col("idx") * F.col("dt")
    y = F.exp(-(0.5 + F.col("network") / 50) * t) * F.cos((2 + F.col("network") / 10) * t)
    return rounded(k.identify(n.withColumn("y", y), "prony", 2).select("network", "re", "im"), 4)


@C.add("SELECT p_partkey, CASE WHEN p_size > 10 THEN round(log10((p_size - 10) / 12.0) / 3, 6) ELSE 0 END AS size FROM part")
def size_features(spark, sf):
    return rounded(table(spark, sf, "part").select("p_partkey", fn.log_size((F.col("p_size") - 10).cast("double"), F.lit(12.0)).alias("size")))


@C.add(
    """WITH t AS (SELECT * FROM (VALUES ('180nm', 0, 180.0, 1.8, 4.0, 0.5, 0), ('90nm', 1, 90, 1.2, 2, 0.35, 0), ('65nm', 2, 65, 1.0, 1.5, 0.3, 0), ('45nm', 3, 45, 1.0, 1.2, 0.28, 0), ('28nm', 4, 28, 0.9, 1.0, 0.25, 0), ('14nm', 5, 14, 0.8, 0.9, 0.22, 1), ('7nm', 0, 180, 1.8, 4, 0.5, 1)) AS v(name, k, l, vdd, tox, vth, fin))
 SELECT s_suppkey, round(k / 5.0, 6) AS place, round(log10(l / 180), 6) AS length, round(vdd / 1.8, 6) AS supply, round(log10(tox / 4), 6) AS oxide, CAST(vth AS DOUBLE) AS vth_n, CAST(vth AS DOUBLE) AS vth_p, CAST(fin AS DOUBLE) AS fins
 FROM supplier JOIN t ON name = ['180nm', '90nm', '65nm', '45nm', '28nm', '14nm', '7nm'][s_suppkey % 7 + 1]"""
)
def technology_codes(spark, sf):
    names = F.array(*[F.lit(x) for x in ("180nm", "90nm", "65nm", "45nm", "28nm", "14nm", "7nm")])
    s = table(spark, sf, "supplier").select("s_suppkey", fn.technology_code(F.element_at(names, (F.col("s_suppkey") % 7 + 1).cast("int"))).alias("c"))
    return rounded(s.select("s_suppkey", *[F.col("c")[k].alias(n) for k, n in enumerate(("place", "length", "supply", "oxide", "vth_n", "vth_p", "fins"))]))


@C.add("SELECT p_partkey, round(a, 6) AS l_ratio, round(a * a, 6) AS c_ratio, round(1 / a, 6) AS r_ratio, round(power(a, 0.3), 6) AS vdd_ratio FROM (SELECT p_partkey, CASE WHEN p_size > 5 THEN (p_size - 5) / 65.0 ELSE 0.5 END AS a FROM part)")
def scaling_of_technologies(spark, sf):
    r = table(spark, sf, "part").select("p_partkey", nw.scaling_ratios(F.lit(65.0), (F.col("p_size") - 5).cast("double")).alias("r"))
    return rounded(r.select("p_partkey", "r.l_ratio", "r.c_ratio", "r.r_ratio", "r.vdd_ratio"))


@C.add("SELECT o_custkey % 100 AS src, o_orderkey % 13 AS dst, arg_max(o_totalprice, o_orderkey) AS weight FROM orders GROUP BY ALL")
def last_link_weights(spark, sf):
    o = table(spark, sf, "orders")
    return gr.link_weights(o.select((F.col("o_custkey") % 100).alias("src"), (F.col("o_orderkey") % 13).alias("dst"), F.col("o_totalprice").alias("weight"), "o_orderkey"), "o_orderkey")


@C.add(
    """WITH s AS (SELECT l_returnflag AS run, l_linestatus AS st, l_extendedprice AS o, CASE WHEN l_returnflag = 'A' THEN l_quantity * 10 END AS fb, CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_discount END AS i FROM lineitem),
 a AS (SELECT run, median((o - fb) / i) AS r1, median(fb / i) AS r2, count(*) AS n FROM s WHERE i > 1e-9 AND fb > 0 AND o > fb GROUP BY 1), b AS (SELECT run, median(o / i - 250 / i) AS r1, median(250 / i) AS r2, count(*) AS n FROM s WHERE i > 1e-9 AND st = 'F' AND o / i > 250 / i GROUP BY 1)
 SELECT s.run, CASE WHEN a.n > 0 THEN 1 WHEN b.n > 0 THEN 2 ELSE 3 END AS tier, round(coalesce(a.r1, b.r1), 4) AS r1, round(coalesce(a.r2, b.r2), 4) AS r2, coalesce(a.n, b.n, 0) AS n FROM (SELECT DISTINCT run FROM s) s LEFT JOIN a USING (run) LEFT JOIN b USING (run)"""
)
def divider_resistors(spark, sf):
    """Measured feedback for one group, a nominal reference in its place for another, no current for the third."""
    li = table(spark, sf, "lineitem")
    fb, i = F.when(F.col("l_returnflag") == "A", F.col("l_quantity") * 10), F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.col("l_discount"))
    s = li.select(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("state"), F.col("l_extendedprice").alias("out"), fb.alias("fb"), i.alias("i"), F.lit(None).cast("double").alias("ref"))
    return rounded(ins.divider_resistors(s, ["run"], 250.0, "F"), 4)


@C.add(
    """WITH s AS (SELECT o_orderkey % 200 AS run, CASE WHEN o_custkey % 2 = 0 THEN 'SEL_A' ELSE 'SEL_B' END AS sel, CAST(o_custkey % 3 AS INTEGER) AS idx, o_orderpriority AS pin, round(avg(o_totalprice) - 150000, 4) AS shift FROM orders GROUP BY ALL),
 m AS (SELECT run, sel, idx, arg_max(pin, (shift, pin)) AS gained, arg_min(pin, (shift, pin)) AS dropped FROM s WHERE abs(shift) > 4 * 40000 GROUP BY ALL)
 SELECT run AS run_key, sel, CAST(idx AS DOUBLE) AS idx, gained, dropped, 'mux-verified' AS category, 'info' AS severity FROM m UNION ALL SELECT DISTINCT run, sel, NULL, NULL, NULL, 'untested-mux', 'high' FROM s WHERE (run, sel) NOT IN (SELECT run, sel FROM m)"""
)
def mux_findings(spark, sf):
    o = table(spark, sf, "orders")
    shifts = o.groupBy((F.col("o_orderkey") % 200).alias("run_key"), F.when(F.col("o_custkey") % 2 == 0, "SEL_A").otherwise("SEL_B").alias("sel"), (F.col("o_custkey") % 3).cast("int").alias("idx"), F.col("o_orderpriority").alias("pin")).agg(F.round(F.avg("o_totalprice") - 150000, 4).alias("shift"))
    return ins.mux_findings(shifts, shifts.select("run_key", "pin").distinct().withColumn("floor", F.lit(40000.0))).withColumn("idx", F.col("idx").cast("double"))


@C.add(
    S + """, p AS (SELECT DISTINCT state AS src, lead(state) OVER (PARTITION BY run_key ORDER BY idx) AS dst FROM s), t AS (SELECT * FROM p WHERE dst IS NOT NULL AND src <> dst)
 SELECT count(*) AS seen, count(*) FILTER (dst IN ('click', 'error')) AS rich, round(100.0 * count(*) FILTER (dst IN ('click', 'error')) / count(*), 6) AS pct FROM t"""
)
def transition_richness(spark, sf):
    settled = spark.createDataFrame([("click", True), ("view", False)], "state string, settled boolean")
    return rounded(cov.richness(st.transitions(samples(spark, sf)), settled, ["err", "off"]))


@C.add(
    """WITH n AS (SELECT p_brand AS graph, count(*) AS n, count(*) FILTER (p_type = 'SMALL') AS small FROM part GROUP BY 1)
 SELECT graph, round(small / n, 6) AS small, round(CASE WHEN n > 1 THEN 2 ELSE 0 END / 20.0, 6) AS diameter, round(1.0 / n, 6) AS components, 0.0 AS clustering, round(n / 100.0, 6) AS n_nodes, round((n - 1) / 200.0, 6) AS n_edges FROM n"""
)
def graph_fingerprints(spark, sf):
    """The parts of a brand as a star around the first."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("graph"), F.col("p_partkey").alias("node"), F.col("p_type").alias("type"))
    edges = p.join(p.groupBy("graph").agg(F.min("node").alias("a")), "graph").filter("node <> a").select("graph", "a", F.col("node").alias("b"))
    made = nw.fingerprints(p, edges, ["SMALL", "other"])
    return rounded(made.select("graph", F.col("type_SMALL").alias("small"), "diameter", "components", F.col("cc_max").alias("clustering"), "n_nodes", "n_edges"))


@C.add(
    """WITH c AS (SELECT n_nationkey AS run_key, k AS idx, pow(10, k / 10.0) AS f, 20.0 - 20 * k / 10.0 * (1 + n_nationkey / 10.0) + 20 AS v FROM nation, range(41) t(k)),
 w AS (SELECT *, lag(f) OVER (PARTITION BY run_key ORDER BY idx) AS f0, lag(v) OVER (PARTITION BY run_key ORDER BY idx) AS v0, first(v) OVER (PARTITION BY run_key ORDER BY idx) AS g, max(f) OVER (PARTITION BY run_key) AS last FROM c),
 x AS (SELECT run_key, min(g) AS gain, coalesce(arg_min(f0 + (g - 3 - v0) / (v - v0) * (f - f0), idx) FILTER (v0 IS NOT NULL AND v <= g - 3), max(last)) AS corner, coalesce(arg_min(f0 + (0 - v0) / (v - v0) * (f - f0), idx) FILTER (v0 > 0 AND v <= 0), max(last)) AS unity FROM w GROUP BY 1)
 SELECT run_key, round(gain, 4) AS gain, round(min(corner), 4) AS corner, round(min(unity), 4) AS unity, round(-20 * (1 + run_key / 10.0), 4) AS slope FROM x GROUP BY run_key, gain"""
)
def corner_frequencies(spark, sf):
    """Straight lines over the logarithm of the frequency, one slope a nation."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("run_key"), F.explode(F.sequence(F.lit(0), F.lit(40))).alias("idx"))
    curve = n.select("run_key", "idx", F.pow(F.lit(10.0), F.col("idx") / 10).alias("t"), (40.0 - 2.0 * F.col("idx") * (1 + F.col("run_key") / 10)).alias("value"))
    return rounded(sequence.corner_frequencies(curve), 4)


QUERIES, ORACLES = C.queries, C.oracles
