"""Checks, corner statistics and roll-ups over orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.operators import checks as k
from sievemill.operators import sequence as q
from sievemill.operators import states as st

from .inputs import SAMPLES_SQL as S
from .inputs import Catalog, rounded, samples, table
from .sequence_queries import BITS

C = Catalog()


def corners(spark, sf):
    """Mean line measures of each ship mode stand-in (return flag, status) and parameter: corner, param, measured."""
    li = table(spark, sf, "lineitem").withColumn("corner", F.concat_ws("_", "l_returnflag", "l_linestatus"))
    rows = li.groupBy("corner").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return rows.unpivot("corner", ["quantity", "discount", "tax"], "param", "measured")


CORNERS = """WITH a AS (SELECT l_returnflag || '_' || l_linestatus AS corner, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1),
 c AS (UNPIVOT a ON quantity, discount, tax INTO NAME param VALUE measured),
 spec AS (SELECT * FROM (VALUES ('quantity', 25.0, 26.0), ('discount', NULL, 0.05), ('tax', 0.03, NULL)) AS v(param, lo, hi))"""


def spec(spark):
    return spark.createDataFrame([("quantity", 25.0, 26.0), ("discount", None, 0.05), ("tax", 0.03, None)], "param string, min double, max double")


def lines(spark, sf):
    """Every line as a Monte-Carlo sample of three parameters."""
    return table(spark, sf, "lineitem").unpivot(["l_orderkey"], ["l_quantity", "l_discount", "l_tax"], "param", "measured")


LINES = """WITH c AS (UNPIVOT (SELECT l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME param VALUE measured)"""


@C.add("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS max, min(l_quantity) AS min, round(sqrt(avg(l_quantity * l_quantity)), 6) AS rms FROM lineitem GROUP BY 1")
def named_measures(spark, sf):
    return rounded(k.measures(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity"))


@C.add(
    """WITH m AS (SELECT l_suppkey, avg(l_quantity) AS mean, max(l_discount) AS top FROM lineitem GROUP BY 1)
 SELECT l_suppkey, round(mean, 6) AS mean, CASE WHEN mean < 25 OR mean > 26 THEN 'FAIL' ELSE 'PASS' END AS status, round(least(mean - 25, 26 - mean), 6) AS margin,
   CASE WHEN top > 0.09 THEN 'FAIL' ELSE 'PASS' END AS top_status, 'PASS' AS target_status FROM m"""
)
def parametric_checks(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean"), F.max("l_discount").alias("top"))
    none = F.lit(None).cast("double")
    status, margin = k.check(F.col("mean"), F.lit(25.0), F.lit(26.0), none)
    top, _ = k.check(F.col("top"), none, F.lit(0.09), none)
    aimed, _ = k.check(F.col("mean"), none, none, F.lit(1.0))
    return rounded(m.select("l_suppkey", "mean", status.alias("status"), margin.alias("margin"), top.alias("top_status"), aimed.alias("target_status")))


@C.add(
    S + """, n AS (SELECT *, count(*) OVER (PARTITION BY run_key) AS n FROM s)
 SELECT run_key, round(avg(value), 6) AS avg, max(abs(value)) AS peak, round(sqrt(avg(value * value)), 6) AS rms, round(arg_max(t, (abs(value), -idx)), 6) AS peak_time, max(abs(value)) FILTER (idx < greatest(1, n // 100)) AS inrush FROM n GROUP BY run_key"""
)
def current_stats(spark, sf):
    return rounded(k.current_stats(samples(spark, sf)))


@C.add(S + " SELECT state, round(avg(value), 6) AS mean, round(avg(value) - min(value), 6) AS droop, round(max(value) - min(value), 6) AS ripple, round(arg_min(t, (value, t)), 6) AS droop_time FROM s GROUP BY state")
def supply_stats(spark, sf):
    return rounded(k.supply_stats(samples(spark, sf), ["state"]))


@C.add(
    CORNERS + """, m AS (SELECT *, least(coalesce(measured - lo, 1e300), coalesce(hi - measured, 1e300)) AS margin FROM c JOIN spec USING (param))
 SELECT param, round(min(margin), 6) AS worst_margin, arg_min(corner, (margin, corner)) AS worst_corner, bool_and(margin >= 0) AS passed,
   coalesce(string_agg(corner, ',' ORDER BY corner) FILTER (margin < 0), '') AS failing FROM m GROUP BY param"""
)
def corner_worst_case(spark, sf):
    return rounded(k.corner_worst(corners(spark, sf), spec(spark)).withColumn("failing", F.array_join("failing", ",")))


ERF = "(sign({x}) * (1 - (((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-{x} * {x})))"


def cdf(x: str) -> str:
    z = f"(({x}) / sqrt(2.0))"
    return "((1 + " + ERF.format(x=z, t=f"(1 / (1 + 0.3275911 * abs({z})))") + ") / 2)"


MC = LINES + """, spec AS (SELECT * FROM (VALUES ('l_quantity', 0.0, 60.0), ('l_discount', NULL, 0.05), ('l_tax', 0.0, 0.1)) AS v(param, lo, hi)),
 a AS (SELECT param, count(measured) AS n, avg(measured) AS mean, stddev_pop(measured) AS sigma FROM c GROUP BY 1),
 j AS (SELECT *, (hi - mean) / sigma AS up, (mean - lo) / sigma AS down FROM a JOIN spec USING (param))"""


def mc_rows(spark, sf):
    limits = spark.createDataFrame([("l_quantity", 0.0, 60.0), ("l_discount", None, 0.05), ("l_tax", 0.0, 0.1)], "param string, min double, max double")
    return k.monte_carlo(lines(spark, sf), limits)


@C.add(
    MC + " SELECT param, n, round(mean, 6) AS mean, round(sigma, 6) AS sigma, round(CASE WHEN up + down IS NOT NULL THEN least(up, down) / 3 END, 6) AS cpk, round(CASE WHEN up + down IS NOT NULL THEN "
    + cdf("up") + " - " + cdf("-down") + " END, 6) AS yield, CASE WHEN least(up, down) / 3 >= 1.33 AND up + down IS NOT NULL THEN 'PASS' ELSE 'FAIL' END AS status FROM j"
)
def monte_carlo_capability(spark, sf):
    return rounded(k.with_verdict(mc_rows(spark, sf)))


@C.add(LINES + " SELECT param, round(stddev_pop(measured) / greatest(avg(measured), 1e-30), 6) AS cv, CAST(row_number() OVER (ORDER BY stddev_pop(measured) / greatest(avg(measured), 1e-30) DESC, param) AS INTEGER) AS rank FROM c GROUP BY param")
def sensitivity_ranking(spark, sf):
    return rounded(k.sensitivity_ranking(lines(spark, sf)))


@C.add(
    MC + ", w AS (SELECT param, sigma, CAST(step AS INTEGER) AS step, 0.1 * (1 - step / 5) AS tolerance FROM j, (SELECT unnest(range(5)) AS step)) SELECT param, step, round(tolerance, 6) AS tolerance, round(2 * "
    + cdf("tolerance / sigma") + " - 1, 6) AS yield FROM w"
)
def yield_tolerance_sweep(spark, sf):
    return rounded(k.yield_sweep(mc_rows(spark, sf), F.lit(0.1), 5))


RESULTS = """WITH r AS (SELECT o_orderpriority AS checker, o_orderkey AS item, 400000 - o_totalprice AS margin,
   CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'P' THEN 'WARNING' ELSE 'PASS' END AS status FROM orders)"""


def results(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "P", "WARNING").otherwise("PASS")
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("checker"), F.col("o_orderkey").alias("item"), (400000 - F.col("o_totalprice")).alias("margin"), status.alias("status"))


@C.add(RESULTS + " SELECT checker, count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'WARNING') AS warned, round(100.0 * count(*) FILTER (status = 'PASS') / greatest(count(*), 1), 6) AS pass_rate FROM r GROUP BY checker")
def report_roll_up(spark, sf):
    return rounded(k.roll_up(results(spark, sf), ["checker"]))


@C.add(
    RESULTS + """, a AS (SELECT count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed FROM r),
 w AS (SELECT string_agg(checker || '/' || item, ', ' ORDER BY margin, checker, item) AS worst FROM (SELECT * FROM r WHERE status = 'FAIL' ORDER BY margin, checker, item LIMIT 3)),
 b AS (SELECT string_agg(DISTINCT checker, ',' ORDER BY checker) AS blocked FROM r WHERE status = 'FAIL' AND checker IN ('1-URGENT'))
 SELECT total, passed, failed, concat_ws('; ', CASE WHEN 100.0 * passed / total < 95 THEN 'pass rate' END, CASE WHEN failed > 10 THEN 'too many failures' END, 'missing: 6-NEVER', 'blocked: ' || blocked) AS violations, worst FROM a, w, b"""
)
def quality_gate(spark, sf):
    return k.quality_gate(results(spark, sf), ["1-URGENT", "6-NEVER"], ["1-URGENT"], 95.0, 10)


FINDINGS = "WITH f AS (SELECT CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'low' ELSE 'info' END AS severity FROM events)"


@C.add(FINDINGS + " SELECT severity, count(*) AS n, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END AS rank FROM f GROUP BY severity")
def severity_counts(spark, sf):
    t = F.col("event_type")
    severity = F.when(t == "error", "critical").when(t == "purchase", "high").when(t == "signup", "low").otherwise("info")
    return k.severity_counts(table(spark, sf, "events").select(severity.alias("severity")))


RUNS = S + """, ev AS (SELECT user_id, event_type, value, event_id FROM events),
 rw AS (SELECT CAST(user_id // 10 AS INTEGER) AS run, user_id AS corner, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (value > 100) AS states, avg(CAST(value > 20 AS INTEGER)) AS coverage FROM ev GROUP BY 1, 2),
 g AS (SELECT *, count(*) OVER (PARTITION BY run) AS c, max(c0) OVER () AS mx FROM (SELECT *, count(*) OVER (PARTITION BY run) AS c0 FROM rw)),
 h AS (SELECT *, CASE WHEN mx < 3 THEN '*' WHEN c >= 3 THEN CAST(run AS VARCHAR) END AS grp FROM g),
 st AS (SELECT grp, count(*) AS m, quantile_cont(coverage, 0.25) AS q1, quantile_cont(coverage, 0.75) AS q3, median(coverage) AS mid FROM h WHERE grp IS NOT NULL GROUP BY grp),
 mo AS (SELECT grp, states AS mode, n FROM (SELECT grp, states, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC) AS r FROM h WHERE grp IS NOT NULL GROUP BY grp, states) WHERE r = 1)"""


@C.add(
    RUNS + """ SELECT run, corner, reasons FROM (SELECT run, corner, concat_ws(',', CASE WHEN n > 0.5 * m AND states <> mode THEN 'states' END, CASE WHEN m >= 4 AND coverage < q1 - 1.5 * (q3 - q1) THEN 'iqr' END, CASE WHEN coverage < mid - 0.2 THEN 'median' END) AS reasons
 FROM h JOIN st USING (grp) JOIN mo USING (grp)) WHERE reasons <> ''"""
)
def corner_outliers(spark, sf):
    e = table(spark, sf, "events")
    states = F.array_join(F.sort_array(F.collect_set(F.when(F.col("value") > 100, F.col("event_type")))), ",")
    rows = e.groupBy(F.expr("CAST(user_id DIV 10 AS INT)").alias("run"), F.col("user_id").alias("corner")).agg(F.nullif(states, F.lit("")).alias("states"), F.avg((F.col("value") > 20).cast("int")).alias("coverage"))
    return k.corner_outliers(rows)


@C.add(
    """WITH h AS (SELECT least(CAST(floor(l_quantity) AS BIGINT), 63) AS code, count(*) AS hits FROM lineitem WHERE l_quantity BETWEEN 0 AND 64 GROUP BY 1),
 i AS (SELECT r.code, coalesce(hits, 0) AS hits FROM (SELECT unnest(range(1, 63)) AS code) r LEFT JOIN h USING (code)),
 d AS (SELECT *, hits / avg(hits) OVER () - 1 AS dnl FROM i)
 SELECT code, hits, round(dnl, 6) AS dnl, round(sum(dnl) OVER (ORDER BY code), 6) AS inl, hits = 0 AS missing FROM d"""
)
def code_density(spark, sf):
    return rounded(k.code_density(table(spark, sf, "lineitem").select(F.col("l_quantity").alias("code")), 6))


@C.add(
    BITS + """, p AS (SELECT run_key, t - lag(t) OVER (PARTITION BY run_key ORDER BY idx) AS p FROM e WHERE rise = 1)
 SELECT run_key, count(p) AS periods, round(1e6 / avg(p), 6) AS frequency, round(stddev_pop(p), 4) AS jitter, round(stddev_samp(p), 4) AS jitter_samp FROM p GROUP BY run_key HAVING count(p) >= 2"""
)
def edge_jitter(spark, sf):
    j = k.jitter(q.edges(samples(spark, sf)))
    return j.select("run_key", "periods", F.round(F.col("frequency") * 1e6, 6).alias("frequency"), F.round("jitter", 4).alias("jitter"), F.round("jitter_samp", 4).alias("jitter_samp"))


FIT = "WITH r AS (SELECT l_returnflag AS grp, l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem)"


def fits(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))


@C.add(FIT + " SELECT grp, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*) + 1e-12), 6) AS r2, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(100 * avg(abs(y - p) / (abs(y) + 1e-9)), 4) AS mape FROM r GROUP BY grp")
def regression_metrics(spark, sf):
    m = k.regression_metrics(fits(spark, sf), ["grp"])
    return m.select("grp", F.round("r2", 6).alias("r2"), *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "mape")])


@C.add(FIT + " SELECT grp, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))) / CASE WHEN max(y) = min(y) THEN 1 ELSE max(y) - min(y) END, 4) AS nrmse FROM r GROUP BY grp")
def fit_error(spark, sf):
    return rounded(k.fit_error(fits(spark, sf), ["grp"]), 4)


@C.add(FIT + " SELECT grp, y, p, round(CASE WHEN abs(y) >= 1e-30 THEN 100 * abs(p - y) / abs(y) END, 6) AS err_pct FROM r")
def holdout_errors(spark, sf):
    return rounded(k.holdout_errors(fits(spark, sf)))


@C.add("WITH m AS (SELECT l_linestatus, l_returnflag AS model, avg(l_tax * l_tax) AS mse FROM lineitem GROUP BY ALL) SELECT l_linestatus, arg_min(model, (mse, model)) AS model, round(min(mse), 8) AS mse FROM m GROUP BY 1")
def model_selection(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_linestatus", F.col("l_returnflag").alias("model")).agg(F.avg(F.col("l_tax") * F.col("l_tax")).alias("mse"))
    return rounded(k.best_model(m, ["l_linestatus"]), 8)


@C.add(
    """WITH g AS (SELECT p_partkey, p_retailprice AS sim, avg(l_extendedprice / l_quantity) AS measured FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL),
 d AS (SELECT *, 100 * (measured - sim) / CASE WHEN abs(sim) <= 1e-10 THEN 1 ELSE abs(sim) END AS gap_pct FROM g)
 SELECT p_partkey, round(sim, 4) AS sim, round(measured, 4) AS measured, round(gap_pct, 4) AS gap_pct, CASE WHEN abs(gap_pct) > 10 THEN 'HIGH' WHEN abs(gap_pct) > 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM d"""
)
def silicon_gaps(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("measured"))
    part = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("sim"))
    return rounded(k.silicon_gaps(part.join(li, "p_partkey")).select("p_partkey", "sim", "measured", "gap_pct", "severity"), 4)


@C.add("SELECT l_returnflag, round(max(l_discount) FILTER (l_quantity <= 10) - min(l_discount) FILTER (l_quantity <= 10), 6) AS ripple, round(-max(l_discount) FILTER (l_quantity >= 40), 6) AS attenuation FROM lineitem GROUP BY 1")
def filter_response(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("freq"), F.col("l_discount").alias("gain"))
    return rounded(k.filter_response(rows, ["l_returnflag"], 10, 40))


@C.add(
    """WITH m AS (SELECT o_custkey AS run, unnest(['status', 'priority', 'year']) AS key, unnest([o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS VARCHAR)]) AS value FROM orders)
 SELECT key, count(DISTINCT value) AS values, NOT ((SELECT count(DISTINCT run) FROM m) > 1 AND (count(DISTINCT value) = 1 OR count(DISTINCT value) < 0.5 * (SELECT count(DISTINCT run) FROM m))) AS trusted FROM m GROUP BY key"""
)
def metadata_trust(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("string").alias("year"))
    return k.meta_trust(o.unpivot("run", ["status", "priority", "year"], "key", "value"))


@C.add(
    """WITH b AS (SELECT l_linestatus AS state, round_even(l_discount, 2) AS bv, round_even(l_tax * 10000, 0) / 10000 AS bi, l_returnflag AS path, avg(l_quantity) AS m FROM lineitem GROUP BY ALL HAVING count(*) >= 3),
 d AS (SELECT state, bv, bi, count(*) AS paths, (max(m) - min(m)) / greatest(abs(max(m)), abs(min(m))) AS rel FROM b GROUP BY ALL HAVING count(*) >= 2)
 SELECT state, bv, bi, paths, round(rel, 6) AS rel FROM d WHERE rel > 0.05"""
)
def vi_consistency(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("state"), F.col("l_discount").alias("v"), F.col("l_tax").alias("i"), F.col("l_returnflag").alias("path"), F.col("l_quantity").alias("y"))
    return rounded(k.vi_consistency(rows, 3, 0.05))


@C.add("WITH s AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS slope, max(l_quantity) - min(l_quantity) AS span FROM lineitem GROUP BY 1) SELECT round(median(abs(slope)), 4) AS slope, count(*) AS runs FROM s WHERE span > 10")
def large_signal_slope(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run_key"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("value"))
    return rounded(k.large_signal_slope(rows, 10), 4)


@C.add("SELECT l_suppkey, max(abs(l_extendedprice)) FILTER (l_quantity >= 49) AS capacity, coalesce(max(abs(l_extendedprice)) FILTER (l_quantity >= 49), 0) < 0.98 * 100000 AS short FROM lineitem GROUP BY 1")
def drive_capacity(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").alias("v"), F.col("l_extendedprice").alias("i"))
    return k.drive_capacity(rows, ["l_suppkey"], 49, 100000)


@C.add(
    """WITH p AS (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 'in' WHEN 'R' THEN 'out' END AS side, abs(l_quantity) * l_tax AS p FROM lineitem),
 a AS (SELECT l_suppkey, avg(p) FILTER (side = 'out') AS o, avg(p) FILTER (side = 'in') AS n FROM p GROUP BY 1)
 SELECT l_suppkey, round(CASE WHEN n > 1e-18 THEN o / n END, 6) AS efficiency, CASE WHEN n > 1e-18 THEN o / n < 0 OR o / n > 1.05 END AS odd FROM a"""
)
def power_efficiency(spark, sf):
    side = F.when(F.col("l_returnflag") == "A", "in").when(F.col("l_returnflag") == "R", "out")
    rows = table(spark, sf, "lineitem").select("l_suppkey", side.alias("side"), F.col("l_quantity").alias("i"), F.col("l_tax").alias("v"))
    return rounded(k.efficiency(rows, ["l_suppkey"]))


@C.add("SELECT l_suppkey, round(avg(CAST(l_returnflag = 'A' AND NOT l_discount <= 0.08 AS INTEGER)), 6) AS share FROM lineitem GROUP BY 1 HAVING avg(CAST(l_returnflag = 'A' AND NOT l_discount <= 0.08 AS INTEGER)) > 0.05")
def sequencing_violations(spark, sf):
    return rounded(k.sequencing_violations(table(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_returnflag") == "A", F.col("l_discount") <= 0.08, 0.05))


@C.add(
    S + """, u AS (SELECT state, min(t) FILTER (value >= 200) AS up FROM s GROUP BY state)
 SELECT state, round(up, 6) AS up, CAST(row_number() OVER (ORDER BY up NULLS LAST, state) AS INTEGER) AS position, round(up - lag(up) OVER (ORDER BY up NULLS LAST, state), 6) AS margin FROM u"""
)
def power_sequence(spark, sf):
    return rounded(k.power_sequence(samples(spark, sf), "state", 200.0))


@C.add(
    S + """, r AS (SELECT state, CAST(run_key % 4 AS INTEGER) AS supply, value FROM s), m AS (SELECT state, supply, avg(abs(value)) AS mean_abs, sqrt(avg(value * value)) AS rms FROM r GROUP BY ALL HAVING count(*) >= 3),
 o AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY mean_abs DESC, supply) AS rank, max(mean_abs) FILTER (supply = 0) OVER (PARTITION BY state) AS own FROM m)
 SELECT state, supply, round(mean_abs, 6) AS mean_abs, round(rms, 6) AS rms, CAST(rank AS INTEGER) AS rank, coalesce(rank = 1 AND supply <> 0 AND mean_abs > 1.02 * own, false) AS mismatch FROM o"""
)
def supply_dominance(spark, sf):
    rows = samples(spark, sf).withColumn("supply", (F.col("run_key") % 4).cast("int"))
    return rounded(st.dominance(st.state_means(rows, ["supply"]), "supply", 0, 1.02))


QUERIES, ORACLES = C.queries, C.oracles
