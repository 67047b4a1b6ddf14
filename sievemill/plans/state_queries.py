"""States split by their samples, and guards learnt for all transitions at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.operators import guards as gd
from sievemill.operators import mixtures as mx

from .inputs import SAMPLES_SQL as S
from .inputs import Catalog, rounded, samples

C = Catalog()
ROUNDS = 6


def with_offset(spark, sf):
    """Samples whose value is higher by 1000 from a run's 25th on: two levels a state."""
    return samples(spark, sf).withColumn("value", F.col("value") + F.when(F.col("idx") >= 25, 1000.0).otherwise(0.0))


OFFSET_SQL = S + ", x AS (SELECT run_key, idx, state, value + CASE WHEN idx >= 25 THEN 1000.0 ELSE 0 END AS v FROM s), c0 AS (SELECT x.state, avg(v) FILTER (v <= m) AS lo, avg(v) FILTER (v > m) AS hi FROM x JOIN (SELECT state, avg(v) AS m FROM x GROUP BY state) AS a USING (state) GROUP BY x.state)"
for _k in range(1, ROUNDS + 1):
    OFFSET_SQL += f", c{_k} AS (SELECT x.state, avg(v) FILTER ((v - hi) * (v - hi) >= (v - lo) * (v - lo)) AS lo, avg(v) FILTER ((v - hi) * (v - hi) < (v - lo) * (v - lo)) AS hi FROM x JOIN c{_k - 1} USING (state) GROUP BY x.state)"
OFFSET_SQL += f""", t AS (SELECT state, run_key, idx, CASE WHEN (v - hi) * (v - hi) < (v - lo) * (v - lo) THEN 1 ELSE 0 END AS side, v FROM x JOIN c{ROUNDS} USING (state)),
 d AS (SELECT state, v, CASE WHEN side <> lag(side) OVER (PARTITION BY state, run_key ORDER BY idx) THEN 1 ELSE 0 END AS turn FROM t),
 r AS (SELECT state, count(*) AS n, var_pop(v) AS variance, sum(turn) AS changes FROM d GROUP BY state)
 SELECT state, n, round(variance, 4) AS variance, round(lo, 4) AS low, round(hi, 4) AS high, CAST(changes AS BIGINT) AS changes, n >= 10 AND variance >= 0.01 AND changes < 0.1 * n AS accepted FROM r JOIN c{ROUNDS} USING (state)"""


@C.add(OFFSET_SQL)
def state_splits(spark, sf):
    """Two levels of value in each event type."""
    found = mx.split_states(with_offset(spark, sf), ["value"], rounds=ROUNDS)
    return rounded(found.withColumns({"low": F.col("low")[0], "high": F.col("high")[0]}), 4)


@C.add()
def state_mixtures(spark, sf):
    """The components of each event type's values, their number chosen by BIC."""
    told = mx.mixture_states(with_offset(spark, sf), ["value"], most=4)
    return told.groupBy("state", "components", "component").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 3).alias("mean"))


STEPS_SQL = S + """, f AS (SELECT run_key, idx, state, value, idx % 5 AS phase FROM s),
 p AS (SELECT state AS src, lead(state) OVER w AS next, lead(value) OVER w AS x0, CAST(lead(phase) OVER w AS DOUBLE) AS x1 FROM f WINDOW w AS (PARTITION BY run_key ORDER BY idx)),
 q AS (SELECT * FROM p WHERE next IS NOT NULL),
 m AS (SELECT src, next AS dst FROM q WHERE src <> next AND src IN (SELECT src FROM q GROUP BY src HAVING count(*) >= 3) GROUP BY ALL),
 e AS (SELECT m.src, m.dst, CAST(q.next = m.dst AS INTEGER) AS y, unnest([0, 1]) AS feature, unnest([x0, x1]) AS v FROM m JOIN q USING (src)),
 b AS (SELECT *, min(v) OVER g AS lo, max(v) OVER g AS hi FROM e WINDOW g AS (PARTITION BY src, dst, feature)),
 h AS (SELECT src, dst, feature, CASE WHEN hi > lo THEN least(255, CAST(floor((v - lo) / (hi - lo) * 256) AS INTEGER)) ELSE 0 END AS bin, count(*) AS n, sum(y) AS pos, min(v) AS low, max(v) AS high FROM b GROUP BY ALL),
 c AS (SELECT *, CAST(sum(n) OVER u AS DOUBLE) AS nl, CAST(sum(pos) OVER u AS DOUBLE) AS pl, CAST(sum(n) OVER w AS DOUBLE) AS nt, CAST(sum(pos) OVER w AS DOUBLE) AS pt, lead(low) OVER o AS after
       FROM h WINDOW w AS (PARTITION BY src, dst, feature), o AS (PARTITION BY src, dst, feature ORDER BY bin), u AS (PARTITION BY src, dst, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
 z AS (SELECT src, dst, feature, (high + after) / 2 AS threshold, nl, pl, pl * pl / nl + (pt - pl) * (pt - pl) / (nt - nl) AS score, pt * pt / nt AS whole FROM c WHERE after IS NOT NULL),
 k AS (SELECT src, dst, first(feature ORDER BY score DESC, feature, threshold) AS feature, first(threshold ORDER BY score DESC, feature, threshold) AS threshold
       FROM z WHERE score > whole * (1 + 1e-12) + 1e-12 GROUP BY ALL),
 t AS (SELECT src, dst, count(*) AS n, sum(y) AS pos FROM e WHERE feature = 0 GROUP BY ALL)
 SELECT src, dst, n, CAST(pos AS BIGINT) AS pos, CAST(k.feature AS INTEGER) AS feature, round(k.threshold, 6) AS threshold FROM t LEFT JOIN k USING (src, dst)"""


def guard_features(spark, sf):
    return samples(spark, sf).withColumn("phase", F.col("idx") % 5)


@C.add(STEPS_SQL)
def guard_cuts(spark, sf):
    """The first cut of each transition's tree over the next event's value and place."""
    trees = gd.grow(gd.steps(guard_features(spark, sf), ["value", "phase"]), depth=1).filter("node = 1")
    return rounded(trees.select("src", "dst", "n", "pos", "feature", "threshold"))


@C.add()
def learnt_guards(spark, sf):
    return rounded(gd.learn_guards(guard_features(spark, sf), ["value", "phase"]))


QUERIES, ORACLES = C.queries, C.oracles
