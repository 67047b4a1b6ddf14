"""Window and state operators over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.operators import sequence as q
from sievemill.operators import states as st

from .inputs import SAMPLES_SQL as S
from .inputs import Catalog, rounded, samples

C = Catalog()
ISLANDS = S + """, c AS (SELECT *, CASE WHEN idx = 0 OR state <> lag(state) OVER (PARTITION BY run_key ORDER BY idx) THEN 1 ELSE 0 END AS new FROM s),
 i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY run_key ORDER BY idx) - 1 AS INTEGER) AS island FROM c),
 g AS (SELECT run_key, island, state, CAST(min(idx) AS INTEGER) AS first_idx, CAST(max(idx) AS INTEGER) AS last_idx, count(*) AS n, min(t) AS t_start, max(t) AS t_end FROM i GROUP BY ALL)"""
BITS = S + """, b AS (SELECT *, CASE WHEN max(value) OVER w - min(value) OVER w < 1e-9 THEN CAST(first_value(value) OVER (PARTITION BY run_key ORDER BY idx) > 0.5 AS INTEGER)
   ELSE CAST(value > (min(value) OVER w + max(value) OVER w) / 2 AS INTEGER) END AS bit FROM s WINDOW w AS (PARTITION BY run_key)),
 e AS (SELECT *, bit - lag(bit) OVER (PARTITION BY run_key ORDER BY idx) AS rise FROM b)"""


@C.add(ISLANDS + " SELECT run_key, island - 0 AS island, state, first_idx, last_idx, n, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM g")
def state_islands(spark, sf):
    return rounded(q.islands(samples(spark, sf)))


@C.add(S + " SELECT run_key, idx, last_value(CASE WHEN state <> 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY run_key ORDER BY idx) AS value FROM s")
def zero_order_hold(spark, sf):
    s = samples(spark, sf)
    return q.decode_changes(s, s.filter("state <> 'view'")).select("run_key", "idx", "value")


@C.add(S + ", f AS (SELECT run_key, idx, t, last_value(CASE WHEN state <> 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY run_key ORDER BY idx) AS value FROM s) SELECT run_key, idx, value FROM f WHERE t BETWEEN 600000 AND 1200000")
def filled_time_slice(spark, sf):
    s = samples(spark, sf).withColumn("value", F.when(F.col("state") != "view", F.col("value")))
    return q.time_slice(s, 600000, 1200000).select("run_key", "idx", "value")


@C.add(
    "WITH RECURSIVE " + S[5:] + """, w AS (SELECT run_key, idx, value, value AS last, true AS keep FROM s WHERE idx = 0
  UNION ALL SELECT s.run_key, s.idx, s.value, CASE WHEN abs(s.value - w.last) > 60 THEN s.value ELSE w.last END, abs(s.value - w.last) > 60 FROM w JOIN s ON s.run_key = w.run_key AND s.idx = w.idx + 1)
 SELECT run_key, idx, value FROM w WHERE keep OR idx = (SELECT max(idx) FROM s WHERE s.run_key = w.run_key)"""
)
def change_points(spark, sf):
    return q.change_points(samples(spark, sf), 60.0)


@C.add(S + " SELECT run_key, CASE WHEN greatest(0.5, 0.01 * (max(value) - min(value))) > 0 THEN greatest(0.5, 0.01 * (max(value) - min(value))) ELSE 1e-9 END AS tol FROM s GROUP BY run_key")
def tolerance(spark, sf):
    return q.resolve_tolerance(samples(spark, sf), 0.5, 0.01)


@C.add(
    ISLANDS + """, d AS (SELECT run_key, median(dt) AS dt FROM (SELECT run_key, t - lag(t) OVER (PARTITION BY run_key ORDER BY idx) AS dt FROM s) GROUP BY run_key)
 SELECT run_key, island, state, n, round(n * coalesce(dt, 0), 3) AS dwell, n * coalesce(dt, 0) >= 90000 AS sufficient FROM g JOIN d USING (run_key)"""
)
def dwell_sufficiency(spark, sf):
    return rounded(q.dwell(samples(spark, sf), 30000.0), 3)


@C.add(ISLANDS + " SELECT run_key, state, first_idx, n FROM (SELECT *, row_number() OVER (PARTITION BY run_key, state ORDER BY n DESC, first_idx) AS r FROM g) WHERE r = 1")
def longest_island(spark, sf):
    return q.longest_island(samples(spark, sf))


@C.add(ISLANDS + ", k AS (SELECT *, count(*) OVER (PARTITION BY run_key, island) AS c FROM i) SELECT run_key, idx, state, island FROM k WHERE c >= 3")
def state_slices(spark, sf):
    return q.state_slices(samples(spark, sf), 3).select("run_key", "idx", "state", "island")


@C.add(
    ISLANDS + """, d AS (SELECT run_key, median(dt) AS dt FROM (SELECT run_key, t - lag(t) OVER (PARTITION BY run_key ORDER BY idx) AS dt FROM s) GROUP BY run_key),
 m AS (SELECT run_key, median(n * coalesce(dt, 0)) AS d FROM g JOIN d USING (run_key) GROUP BY run_key)
 SELECT run_key, round(greatest(CASE WHEN d > 0 THEN d * 0.05 ELSE 1e-6 END, 1e-12), 4) AS transition_time FROM m"""
)
def transition_time(spark, sf):
    return rounded(q.transition_time(samples(spark, sf)), 4)


@C.add(BITS + " SELECT run_key, idx, round(t, 6) AS t, rise FROM e WHERE rise <> 0")
def signal_edges(spark, sf):
    return rounded(q.edges(samples(spark, sf)))


@C.add(
    BITS + """, m AS (SELECT run_key, idx, rise, avg(value) OVER (PARTITION BY run_key ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) AS before,
  avg(value) OVER (PARTITION BY run_key ORDER BY idx ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING) AS after FROM e)
 SELECT run_key, idx, rise, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS shift FROM m WHERE rise <> 0"""
)
def edge_windows(spark, sf):
    return rounded(q.edge_windows(samples(spark, sf), 4, 2))


@C.add(
    S + """, z AS (SELECT *, count(*) OVER (PARTITION BY run_key) // 4 AS size FROM s), w AS (SELECT *, idx // size AS win, CAST(idx % size AS DOUBLE) AS x FROM z WHERE size > 0)
 SELECT run_key, CAST(win AS INTEGER) AS win, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(coalesce(CASE WHEN var_pop(x) > 0 THEN regr_slope(value, x) END, 0), 6) AS slope FROM w WHERE win < 4 GROUP BY run_key, win"""
)
def windowed_features(spark, sf):
    return rounded(q.windowed_features(samples(spark, sf), 4))


MID = S + """, r AS (SELECT min(value) AS lo, max(value) AS hi FROM s),
 w AS (SELECT run_key, (value - lo) / (hi - lo) AS z, greatest(coalesce(lead(t) OVER (PARTITION BY run_key ORDER BY idx) - t, 0), 0) AS w FROM s, r),
 m AS (SELECT run_key, sum(CASE WHEN z > 0.15 AND z < 0.85 THEN w ELSE 0 END) / nullif(sum(w), 0) AS mid_share FROM w GROUP BY run_key)"""


@C.add(MID + " SELECT run_key, round(mid_share, 6) AS mid_share FROM m")
def mid_rail_dwell(spark, sf):
    return rounded(q.mid_rail_dwell(samples(spark, sf)))


@C.add(MID + " SELECT round(avg(mid_share), 6) AS mean_share, round(max(mid_share), 6) AS max_share, avg(mid_share) < 0.05 AND max(mid_share) < 0.5 AS digital FROM m")
def digital_signal(spark, sf):
    return rounded(q.classify_digital(samples(spark, sf)))


@C.add(
    S + """, d AS (SELECT run_key, idx, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b, (value - lag(value) OVER w) / (t - lag(t) OVER w) AS l, (lead(value) OVER w - value) / (lead(t) OVER w - t) AS r FROM s WINDOW w AS (PARTITION BY run_key ORDER BY idx))
 SELECT run_key, idx, round(CASE WHEN a IS NULL THEN r WHEN b IS NULL THEN l ELSE (l * b + r * a) / (a + b) END, 6) AS slope FROM d"""
)
def gradient(spark, sf):
    return rounded(q.gradient(samples(spark, sf)).select("run_key", "idx", "slope"))


@C.add(
    S + """, a AS (SELECT run_key, idx, coalesce((value + lag(value) OVER w) / 2 * (t - lag(t) OVER w), 0) AS x FROM s WINDOW w AS (PARTITION BY run_key ORDER BY idx))
 SELECT run_key, idx, round(sum(x) OVER (PARTITION BY run_key ORDER BY idx), 3) AS integral FROM a"""
)
def cumulative_trapezoid(spark, sf):
    return rounded(q.cumulative_trapezoid(samples(spark, sf)).select("run_key", "idx", "integral"), 3)


@C.add(S + " SELECT run_key, idx, list_sort([coalesce(lag(value) OVER w, 0.0), value, coalesce(lead(value) OVER w, 0.0)])[2] AS smooth FROM s WINDOW w AS (PARTITION BY run_key ORDER BY idx)")
def median_filter(spark, sf):
    return q.median3(samples(spark, sf)).select("run_key", "idx", "smooth")


FLOOR = S + """, c AS (SELECT *, count(*) OVER (PARTITION BY run_key) AS n, value - lag(value) OVER (PARTITION BY run_key ORDER BY idx) AS dv FROM s),
 z AS (SELECT *, greatest(4, n // 12) AS size, idx // greatest(4, n // 12) AS win FROM c),
 mw AS (SELECT run_key, win, median(value) AS mid FROM z GROUP BY ALL), md AS (SELECT run_key, median(dv) AS dmid FROM z GROUP BY ALL),
 mads AS (SELECT run_key, win, count(*) AS m, any_value(size) AS size, median(abs(value - mid)) * 1.4826 AS mad FROM z JOIN mw USING (run_key, win) GROUP BY ALL),
 best AS (SELECT run_key, min(mad) AS mad FROM mads WHERE m = size GROUP BY ALL),
 rest AS (SELECT run_key, any_value(n) AS n, stddev_pop(value) AS sd, median(abs(dv - dmid)) * 1.4826 / sqrt(2.0) AS step FROM z JOIN md USING (run_key) GROUP BY ALL),
 fl AS (SELECT run_key, greatest(coalesce(CASE WHEN n < 4 THEN sd WHEN mad > 0 THEN mad ELSE step END, 0), 1e-15) AS floor FROM rest LEFT JOIN best USING (run_key))"""


@C.add(FLOOR + " SELECT run_key, round(floor, 6) AS floor FROM fl")
def noise_floor(spark, sf):
    return rounded(q.noise_floor(samples(spark, sf)))


@C.add(FLOOR + " SELECT run_key, idx, value FROM s JOIN fl USING (run_key) WHERE abs(value) > 5 * floor")
def above_noise_floor(spark, sf):
    s = samples(spark, sf)
    return q.above_floor(s, q.noise_floor(s), 5.0).select("run_key", "idx", "value")


@C.add(
    S + """, k AS (SELECT *, value > 20 AS ok, count(*) OVER (PARTITION BY run_key) AS n, min(CAST(value > 20 AS INTEGER)) OVER (PARTITION BY run_key ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a FROM s)
 SELECT run_key, round(coalesce(min(t) FILTER (a = 1 AND idx + 5 < n), min(t) FILTER (ok), 1e12), 6) AS lock_time FROM k GROUP BY run_key"""
)
def lock_time(spark, sf):
    found = q.lock_time(samples(spark, sf), F.col("value") > 20, 5)
    return rounded(found.withColumn("lock_time", F.when(F.col("lock_time") == float("inf"), 1e12).otherwise(F.col("lock_time"))))


@C.add(
    S + """, x AS (SELECT run_key, t, CASE WHEN lag(value) OVER w >= 30 AND value < 30 THEN lag(t) OVER w + (t - lag(t) OVER w) * (lag(value) OVER w - 30) / (lag(value) OVER w - value) END AS hit FROM s WINDOW w AS (PARTITION BY run_key ORDER BY idx))
 SELECT run_key, round(coalesce(min(hit), max(t)), 4) AS crossing FROM x GROUP BY run_key"""
)
def first_crossing(spark, sf):
    return rounded(q.first_crossing(samples(spark, sf), 30.0), 4)


@C.add(
    S + """, p AS (SELECT state AS src, lead(state) OVER (PARTITION BY run_key ORDER BY idx) AS dst FROM s), n AS (SELECT src, dst, count(*) AS n FROM p WHERE dst IS NOT NULL GROUP BY ALL)
 SELECT src, dst, n, round(n / total, 6) AS probability FROM (SELECT *, sum(n) OVER (PARTITION BY src) AS total FROM n) WHERE src <> dst"""
)
def state_transitions(spark, sf):
    return rounded(st.transitions(samples(spark, sf)))


@C.add(BITS + " SELECT state, round(avg(bit), 6) AS bit, count(*) AS n FROM b GROUP BY state")
def state_signatures(spark, sf):
    return rounded(st.signatures(q.binarize(samples(spark, sf)), ["bit"]))


@C.add(
    S + """, p AS (SELECT CAST(value AS INTEGER) // 16 AS bits, min((run_key, idx)) AS f, count(*) AS n FROM s GROUP BY 1),
 k AS (SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS state_id, bits, n, n < greatest(3, round_even(sum(n) OVER () * 0.02, 0)) AS rare FROM p),
 m AS (SELECT a.state_id, min((bit_count(xor(a.bits, b.bits)), b.state_id)) AS m FROM k a JOIN k b ON a.rare AND NOT b.rare GROUP BY 1)
 SELECT k.state_id, bits, n, coalesce(m.m[2], k.state_id) AS merged_id FROM k LEFT JOIN m USING (state_id)"""
)
def rare_state_merge(spark, sf):
    s = samples(spark, sf).withColumn("bits", F.floor(F.expr("bround(value, 0)") / 16).cast("int"))
    return st.merge_rare(st.pattern_states(s, "bits", ["run_key", "idx"]), "bits", 0.02)


@C.add(S + ", d AS (SELECT DISTINCT state FROM s UNION SELECT 'never') SELECT d.state, count(s.state) AS n FROM d LEFT JOIN s ON d.state = s.state GROUP BY 1 HAVING count(s.state) < 2000")
def thin_states(spark, sf):
    s = samples(spark, sf)
    return st.thin_states(s, s.select("state").distinct().union(spark.sql("SELECT 'never'")), 2000)


@C.add(S + " SELECT state, count(*) AS n, round(avg(value), 6) AS mean, round(avg(abs(value)), 6) AS mean_abs, round(sqrt(avg(value * value)), 6) AS rms, round(stddev_pop(value), 6) AS std FROM s GROUP BY state HAVING count(*) >= 3")
def state_means(spark, sf):
    return rounded(st.state_means(samples(spark, sf), []))


@C.add(
    S + """, p AS (SELECT *, lag(state) OVER w AS before, max(idx) OVER (PARTITION BY run_key) AS last FROM s WINDOW w AS (PARTITION BY run_key ORDER BY idx)),
 d AS (SELECT p.state, abs(b.value - a.value) AS step FROM p JOIN s a ON a.run_key = p.run_key AND a.idx = greatest(p.idx - 3, 0) JOIN s b ON b.run_key = p.run_key AND b.idx = least(p.idx + 3, p.last) WHERE p.state <> p.before)
 SELECT state, round(avg(step), 6) AS sensitivity, count(*) AS n FROM d GROUP BY state ORDER BY avg(step) DESC, state LIMIT 8"""
)
def transition_sensitivity(spark, sf):
    return rounded(st.transition_sensitivity(samples(spark, sf)))


@C.add(
    ISLANDS + """, m AS (SELECT run_key, state, island, avg(value) AS m, count(*) AS n FROM i GROUP BY ALL HAVING count(*) >= 2),
 p AS (SELECT *, lead(m) OVER (PARTITION BY state ORDER BY m, run_key, island) - m AS gap, count(*) OVER (PARTITION BY state) AS k FROM m),
 cc AS (SELECT state, m AS cut FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY gap DESC NULLS LAST, m) AS r FROM p WHERE k >= 4) WHERE r = 1)
 SELECT state, round(avg(m) FILTER (m <= cut), 6) AS low, round(avg(m) FILTER (m > cut), 6) AS high, avg(m) FILTER (m > cut) - avg(m) FILTER (m <= cut) > 3 * greatest(stddev_pop(m) FILTER (m <= cut), stddev_pop(m) FILTER (m > cut)) AS bimodal
 FROM p JOIN cc USING (state) WHERE k >= 4 GROUP BY state"""
)
def state_bimodality(spark, sf):
    return rounded(q.bimodality(samples(spark, sf)))


QUERIES, ORACLES = C.queries, C.oracles
