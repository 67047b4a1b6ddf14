"""Kernels over whole runs of samples: smoothing, spectra and regressions as sums that merge, converter figures by run."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sievemill.functions.session import cut, numbered_in
from sievemill.operators import kernels as k
from sievemill.operators import machines as mc
from sievemill.operators import lagged, responses, smoothing, spectra

from .inputs import SAMPLES_SQL as S
from .inputs import Catalog, rounded, samples, table

C = Catalog()

#: Order lines as one run a supplier: x is the quantity, y the price.
LINES_SQL = """WITH l AS (SELECT l_suppkey AS run_key, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS idx,
 l_quantity AS x, l_extendedprice AS y, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)"""


def lines(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run_key"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return numbered_in(rows, "run_key", "idx", "l_orderkey", "l_linenumber", "l_partkey", "y").select("run_key", "idx", "x", "y")


@C.add()
def converter_dynamics(spark, sf):
    return rounded(k.adc_metrics(samples(spark, sf)), 4)


#: The parabola over the window of each row, that of the nearest full window at the ends.
PARABOLA = """, w AS (SELECT *, least(greatest(5, n // 20 // 2 * 2 + 1), n - 1 + n % 2) // 2 AS h FROM l),
 c AS (SELECT *, least(greatest(idx, h), n - 1 - h) AS mid FROM w),
 m AS (SELECT c.run_key, c.idx, any_value(c.h) AS h, any_value(c.idx - c.mid) AS d, sum(o.v) AS m0, sum(o.v * (o.idx - c.mid)) AS m1, sum(o.v * (o.idx - c.mid) ** 2) AS m2
       FROM c JOIN w AS o ON o.run_key = c.run_key AND o.idx BETWEEN c.mid - c.h AND c.mid + c.h GROUP BY c.run_key, c.idx),
 s AS (SELECT *, 2.0 * h + 1 AS k, h * (h + 1) * (2.0 * h + 1) / 3 AS s2, h * (h + 1) * (2.0 * h + 1) / 3 * (3 * h * h + 3 * h - 1) / 5 AS s4 FROM m),
 p AS (SELECT *, (s4 * m0 - s2 * m2) / (k * s4 - s2 * s2) AS a, m1 / s2 AS b, (k * m2 - s2 * m0) / (k * s4 - s2 * s2) AS c FROM s)
 SELECT run_key, idx, round(a + b * d + c * d * d, 4) AS smooth, round(b + 2 * c * d, 4) AS slope FROM p"""


@C.add(S + ", l AS (SELECT run_key, idx, value AS v, count(*) OVER (PARTITION BY run_key) AS n FROM s)".replace("WITH", "") + PARABOLA.replace(" s AS (", " z AS (").replace("FROM s)", "FROM z)"))
def smoothed_signals(spark, sf):
    return rounded(smoothing.smooth(samples(spark, sf)), 4)


@C.add(LINES_SQL.replace("l_extendedprice AS y", "l_extendedprice / sqrt(2.0) AS v") + PARABOLA)
def smoothed_prices(spark, sf):
    """Windows of a twentieth of a run. Prices over the root of two, so that no result lies between two roundings."""
    return rounded(smoothing.smooth(lines(spark, sf).withColumn("value", F.col("y") / F.sqrt(F.lit(2.0)))), 4)


@C.add(
    LINES_SQL
    + """, g AS (SELECT run_key, n, least(256, n) AS seg, least(256, n) - least(256, n) // 2 AS hop FROM l WHERE n >= 64 GROUP BY run_key, n),
 cut AS (SELECT g.run_key, g.seg, s.s, l.idx - s.s * g.hop AS j, l.x, l.y FROM g JOIN (SELECT unnest(range(100000)) AS s) AS s ON s.s <= (g.n - g.seg) // g.hop
         JOIN l ON l.run_key = g.run_key AND l.idx >= s.s * g.hop AND l.idx < s.s * g.hop + g.seg),
 z AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / seg) AS w, x - avg(x) OVER q AS dx, y - avg(y) OVER q AS dy FROM cut WINDOW q AS (PARTITION BY run_key, s)),
 f AS (SELECT z.run_key, z.seg, z.s, k.k, sum(w * dx * cos(2 * pi() * k * j / seg)) AS xr, -sum(w * dx * sin(2 * pi() * k * j / seg)) AS xi,
              sum(w * dy * cos(2 * pi() * k * j / seg)) AS yr, -sum(w * dy * sin(2 * pi() * k * j / seg)) AS yi
       FROM z JOIN (SELECT unnest(range(129)) AS k) AS k ON k.k <= z.seg // 2 GROUP BY ALL),
 p AS (SELECT run_key, seg, k, count(*) AS segments, sum(xr * xr + xi * xi) AS xx, sum(xr * yr + xi * yi) AS re, sum(xr * yi - xi * yr) AS im FROM f GROUP BY ALL)
 SELECT run_key, round(k / seg, 6) AS freq, round(sqrt(re * re + im * im) / xx, 3) AS gain, segments FROM p"""
)
def averaged_spectra(spark, sf):
    """The transfer from quantity to price, a run a supplier, over averaged segments."""
    found = spectra.transfer(lines(spark, sf).withColumn("dt", F.lit(1.0)))
    return found.select("run_key", F.round("freq", 6).alias("freq"), F.round("gain", 3).alias("gain"), "segments")


@C.add()
def fitted_spectra(spark, sf):
    """Two poles of each supplier's transfer from quantity to price, from its averaged spectrum. Both are unrelated in
    the test tables, so the fit shows that the numbers are right, no more."""
    found = spectra.transfer(lines(spark, sf).withColumn("dt", F.lit(1.0))).filter("freq > 0")
    rows = cut(found.select(F.col("run_key").cast("string").alias("network"), (F.col("freq") * 2 * math.pi).alias("w"), "re", "im"))
    model = cut(responses.fit_responses(rows, 2, rounds=8))
    return model.join(responses.response_errors(rows, model), "network")


@C.add(
    S
    + """, g AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY run_key ORDER BY idx) AND idx > 0 THEN 1 ELSE 0 END AS new FROM s),
 i AS (SELECT *, sum(new) OVER (PARTITION BY run_key ORDER BY idx) AS island FROM g),
 e AS (SELECT run_key, island, count(*) AS n, max(idx) AS last, max(t) - min(t) AS span FROM i GROUP BY ALL),
 j AS (SELECT i.*, n, span, last - idx AS back FROM i JOIN e USING (run_key, island)),
 m AS (SELECT run_key, island, median(value) FILTER (back < greatest(3, n // 5)) AS level FROM j GROUP BY ALL),
 f AS (SELECT j.run_key, j.island, any_value(n) AS n, any_value(span) AS span, bool_or(back < 5 AND abs(value - level) > 0.01 * abs(level) + 1e-6) AS far FROM j JOIN m USING (run_key, island) GROUP BY ALL)
 SELECT run_key || '/' || CAST(island AS INTEGER) AS stretch, n >= 5 AND span >= 3600 AND NOT far AS settled FROM f"""
)
def settled_stretches(spark, sf):
    return k.settled_islands(samples(spark, sf), 3600.0)


@C.add()
def identified_poles(spark, sf):
    rows = samples(spark, sf).select(F.col("run_key").alias("network"), "idx", F.lit(1.0).alias("dt"), F.lit(0.0).alias("u"), F.col("value").alias("y"))
    return rounded(k.identify(rows, "prony", 3), 4)


@C.add(
    LINES_SQL
    + """, v AS (SELECT run_key, y AS t, lag(y) OVER q AS a, x AS b, lag(x) OVER q AS c FROM l WINDOW q AS (PARTITION BY run_key ORDER BY idx)),
 g AS (SELECT run_key, sum(a*a) AS aa, sum(a*b) AS ab, sum(a*c) AS ac, sum(b*b) AS bb, sum(b*c) AS bc, sum(c*c) AS cc, sum(a*t) AS ya, sum(b*t) AS yb, sum(c*t) AS yc
       FROM v WHERE a IS NOT NULL GROUP BY run_key HAVING count(*) >= 3),
 d AS (SELECT *, aa*(bb*cc - bc*bc) - ab*(ab*cc - bc*ac) + ac*(ab*bc - bb*ac) AS det FROM g),
 r AS (SELECT run_key, unnest(['a1', 'b0', 'b1']) AS name, unnest([
   (ya*(bb*cc - bc*bc) - ab*(yb*cc - bc*yc) + ac*(yb*bc - bb*yc)) / det,
   (aa*(yb*cc - bc*yc) - ya*(ab*cc - bc*ac) + ac*(ab*yc - yb*ac)) / det,
   (aa*(bb*yc - yb*bc) - ab*(ab*yc - yb*ac) + ya*(ab*bc - bb*ac)) / det]) AS value FROM d)
 SELECT run_key AS network, name, round(value, 4) AS value, CAST(NULL AS VARCHAR) AS error FROM r"""
)
def lagged_coefficients(spark, sf):
    """Price by the price before it and both quantities, a network a supplier."""
    rows = lines(spark, sf).select(F.col("run_key").alias("network"), "idx", F.lit(1.0).alias("dt"), F.col("x").alias("u"), "y")
    return rounded(lagged.coefficients(rows, 1), 4)


@C.add(
    LINES_SQL
    + """, v AS (SELECT run_key, y AS t, lag(y, 1) OVER q AS a, lag(y, 2) OVER q AS b FROM l WINDOW q AS (PARTITION BY run_key ORDER BY idx)),
 g AS (SELECT run_key, sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*t) AS ya, sum(b*t) AS yb FROM v WHERE b IS NOT NULL GROUP BY run_key HAVING count(*) >= 2),
 c AS (SELECT run_key, (ya*bb - yb*ab) / (aa*bb - ab*ab) AS p, (aa*yb - ab*ya) / (aa*bb - ab*ab) AS q FROM g),
 r AS (SELECT run_key, p / 2 AS m, p*p / 4 + q AS d FROM c),
 z AS (SELECT run_key, unnest([1, -1]) AS s, m, d FROM r),
 e AS (SELECT run_key, CASE WHEN d >= 0 THEN ln(abs(m + s * sqrt(d))) ELSE ln(m*m - d) / 2 END AS re,
              CASE WHEN d < 0 THEN s * atan2(sqrt(-d), m) WHEN m + s * sqrt(d) < 0 THEN pi() ELSE 0 END AS im FROM z)
 SELECT run_key AS network, round(re, 4) + 0 AS re, round(im, 4) + 0 AS im FROM e"""
)
def price_modes(spark, sf):
    """Poles of the free second-order model of each supplier's prices; they are poles a sample."""
    rows = lines(spark, sf).select(F.col("run_key").alias("network"), "idx", F.lit(1.0).alias("dt"), F.lit(0.0).alias("u"), "y")
    return rounded(lagged.identify(rows, "prony", 2).select("network", (F.col("re") + 0.0).alias("re"), (F.col("im") + 0.0).alias("im")), 4)


@C.add(
    LINES_SQL
    + """, v AS (SELECT run_key, x, y, CASE WHEN idx % 7 > 2 THEN 1.0 ELSE 0.0 END AS enable, CASE WHEN idx + 1 < n THEN 1.0 ELSE 0.0 END AS w FROM l),
 u AS (SELECT run_key, w, unnest(['quantity', 'price', 'enable']) AS signal, unnest([x, y, enable]) AS value FROM v),
 z AS (SELECT run_key, w, u.signal, (value - lo) / (hi - lo) AS z FROM u JOIN (SELECT signal, min(value) AS lo, max(value) AS hi FROM u GROUP BY signal) AS r USING (signal)),
 s AS (SELECT signal, run_key, sum(CASE WHEN z > 0.15 AND z < 0.85 THEN w ELSE 0 END) / nullif(sum(w), 0) AS share FROM z GROUP BY signal, run_key)
 SELECT signal, round(avg(share), 6) AS mean_share, round(max(share), 6) AS max_share, avg(share) < 0.05 AND max(share) < 0.5 AS digital FROM s GROUP BY signal"""
)
def signal_kinds(spark, sf):
    """Which of three columns of the order lines are digital."""
    wide = lines(spark, sf).select("run_key", "idx", F.col("idx").cast("double").alias("t"), F.col("x").alias("quantity"), F.col("y").alias("price"), (F.col("idx") % 7 > 2).cast("double").alias("enable"))
    return rounded(mc.column_kinds(wide, ["quantity", "price", "enable"]))


QUERIES, ORACLES = C.queries, C.oracles
