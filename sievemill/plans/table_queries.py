"""Lookup, graph, coverage, set, top-k and scalar operators over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions import physics as ph
from sievemill.functions import scalar as fn
from sievemill.operators import coverage as cov
from sievemill.operators import graph as g
from sievemill.operators import lookup as lk
from sievemill.operators import states as st

from .inputs import SAMPLES_SQL as S
from .inputs import Catalog, rounded, samples, table

C = Catalog()

MAP = """WITH m AS (SELECT * FROM (VALUES ('5-LOW', 'F', NULL, 'low_a', 0), ('5-LOW', 'F', NULL, 'low_b', 1), ('5-LOW', 'F', 7, 'low_run7', 2), ('2-HIGH', 'O', NULL, 'high', 3)) AS v(name, kind, scope, target, pos)),
 l AS (SELECT name, kind, scope, arg_max(target, pos) AS target FROM m GROUP BY ALL), r AS (SELECT o_orderkey, o_custkey AS run, o_orderpriority AS name, o_orderstatus AS kind FROM orders)"""


def mapping(spark):
    rows = [("5-LOW", "F", None, "low_a", 0), ("5-LOW", "F", None, "low_b", 1), ("5-LOW", "F", 7, "low_run7", 2), ("2-HIGH", "O", None, "high", 3)]
    return spark.createDataFrame(rows, "name string, kind string, run_scope long, target string, pos int")


@C.add(MAP + " SELECT o_orderkey, run, r.name, r.kind, coalesce(a.target, b.target, r.name) AS target FROM r LEFT JOIN l a ON a.name = r.name AND a.kind = r.kind AND a.scope = r.run LEFT JOIN l b ON b.name = r.name AND b.kind = r.kind AND b.scope IS NULL")
def signal_map_lookup(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("kind"))
    return lk.map_names(o, mapping(spark)).select("o_orderkey", "run", "name", "kind", "target")


@C.add("SELECT DISTINCT p_brand AS name FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')")
def unmapped_names(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct()
    return lk.unmapped(names, spark.createDataFrame([("Brand#1",), ("Brand#2",)], "target string"))


@C.add(
    """WITH c AS (SELECT DISTINCT n_name AS candidate FROM nation), n AS (SELECT * FROM (VALUES ('nation_1'), ('ION_3'), ('_24'), ('nothing')) AS v(name))
 SELECT name, arg_min(candidate, (CASE WHEN lower(candidate) = lower(name) THEN 0 WHEN ends_with(lower(candidate), lower(name)) THEN 1 ELSE 2 END, candidate)) AS suggested FROM n JOIN c ON contains(lower(candidate), lower(name)) GROUP BY name"""
)
def name_suggestions(spark, sf):
    names = spark.createDataFrame([("nation_1",), ("ION_3",), ("_24",), ("nothing",)], "name string")
    return lk.suggest(names, table(spark, sf, "nation").select(F.col("n_name").alias("candidate")).distinct())


@C.add(
    """WITH g AS (SELECT s_suppkey AS corner, s_acctbal AS gv, CAST(s_nationkey AS DOUBLE) AS gt, CAST(s_suppkey % 3 AS INTEGER) AS gp FROM supplier),
 r AS (SELECT c_custkey AS id, c_acctbal AS v, CAST(c_nationkey AS DOUBLE) AS t, CAST(c_custkey % 3 AS INTEGER) AS p FROM customer),
 d AS (SELECT id, corner, ((v - gv) / 1000) * ((v - gv) / 1000) + ((t - gt) / 5) * ((t - gt) / 5) + CASE WHEN p = gp THEN 0 ELSE 10 END AS d FROM r, g)
 SELECT id, arg_min(corner, (d, corner)) AS corner, round(min(d), 6) AS distance FROM d GROUP BY id"""
)
def nearest_corner(spark, sf):
    """Every supplier is a corner, every customer a row."""
    grid = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("corner"), F.col("s_acctbal").alias("gv"), F.col("s_nationkey").cast("double").alias("gt"), (F.col("s_suppkey") % 3).cast("int").alias("gprocess"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").cast("double").alias("t"), (F.col("c_custkey") % 3).cast("int").alias("process"))
    return rounded(lk.nearest(rows, grid, 1000.0, 5.0))


@C.add(
    """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity * 1.7 AS x, l_discount * 100 + 0.5 AS y FROM lineitem),
 d AS (SELECT DISTINCT id, x, y FROM r), f AS (SELECT *, floor(x / 10) * 10 AS x0, floor(y / 2) * 2 AS y0 FROM d WHERE x <= 80 AND y <= 10),
 h AS (SELECT id, x, y, x0, y0, CASE WHEN x = x0 THEN x0 ELSE x0 + 10 END AS x1, CASE WHEN y = y0 THEN y0 ELSE y0 + 2 END AS y1 FROM f),
 z AS (SELECT *, CASE WHEN x1 > x0 THEN (x - x0) / 10 ELSE 0 END AS fx, CASE WHEN y1 > y0 THEN (y - y0) / 2 ELSE 0 END AS fy FROM h)
 SELECT d.id, round((1 - fx) * ((1 - fy) * (x0 * x0 + y0) + fy * (x0 * x0 + y1)) + fx * ((1 - fy) * (x1 * x1 + y0) + fy * (x1 * x1 + y1)), 4) AS z FROM d LEFT JOIN z USING (id, x, y)"""
)
def bilinear_lookup(spark, sf):
    x = spark.range(0, 9).select((F.col("id") * 10.0).alias("gx"))
    grid = x.crossJoin(spark.range(0, 6).select((F.col("id") * 2.0).alias("gy"))).select("gx", "gy", (F.col("gx") * F.col("gx") + F.col("gy")).alias("gz"))  # 54 points
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") * 1.7).alias("x"), (F.col("l_discount") * 100 + 0.5).alias("y")).distinct()
    return rounded(lk.bilinear(rows, grid), 4)


FAMILY = """WITH e AS (SELECT DISTINCT p_type AS expected FROM part UNION SELECT 'ECONOMY_X' UNION SELECT 'NONE_Y'), s AS (SELECT DISTINCT p_type AS seen FROM part),
 m AS (SELECT expected, bool_or(seen = expected OR starts_with(seen, split_part(expected, '_', 1)) OR starts_with(expected, split_part(seen, '_', 1))) AS hit FROM e, s GROUP BY 1)"""


@C.add(FAMILY + " SELECT expected, CASE WHEN hit THEN 'covered' ELSE 'missing' END AS verdict FROM m")
def family_coverage(spark, sf):
    seen = table(spark, sf, "part").select(F.col("p_type").alias("seen")).distinct()
    expected = seen.select(F.col("seen").alias("expected")).union(spark.createDataFrame([("ECONOMY_X",), ("NONE_Y",)], "expected string"))
    hit, miss = lk.family_split(expected, seen)
    return hit.withColumn("verdict", F.lit("covered")).union(miss.withColumn("verdict", F.lit("missing")))


@C.add("SELECT o_custkey AS run_id, o_orderpriority AS corner_id, max(o_orderkey) AS run_number FROM orders GROUP BY ALL")
def last_run_wins(spark, sf):
    return lk.dedupe_runs(table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("corner_id"), F.col("o_orderkey").alias("run_number")))


@C.add(S + ", p AS (SELECT CAST(unnest([0, 1]) AS INTEGER) AS part, run_key, idx, t, state, value FROM s) SELECT run_key, idx, CASE WHEN idx % 2 = 0 THEN 'shared' ELSE 'own_1' END AS signal, round(t, 6) AS t, value + 1 AS value FROM p WHERE part = 1 UNION ALL SELECT run_key, idx, 'own_0', round(t, 6), value FROM p WHERE part = 0 AND idx % 2 = 1")
def merge_on_one_grid(spark, sf):
    """Two parts of a run share the grid; of the signal that both have, the last part's values count."""
    one = samples(spark, sf).select("run_key", "idx", "t", "value")
    name = lambda k: F.when(F.col("idx") % 2 == 0, "shared").otherwise(f"own_{k}")
    parts = one.select(F.lit(0).alias("part"), "run_key", "idx", "t", name(0).alias("signal"), "value").union(one.select(F.lit(1), "run_key", "idx", "t", name(1), F.col("value") + 1))
    return rounded(lk.merge_on_grid(parts).select("run_key", "idx", "signal", "t", "value"))


EDGES = "WITH e AS (SELECT n_nationkey AS src, CAST((n_nationkey * 2 + 1) % 25 AS INTEGER) AS dst FROM nation UNION SELECT n_nationkey, CAST((n_nationkey + 5) % 25 AS INTEGER) FROM nation WHERE n_nationkey < 10)"


def edges(spark, sf):
    n = table(spark, sf, "nation")
    a = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).cast("int").alias("dst"))
    return a.union(n.filter("n_nationkey < 10").select("n_nationkey", ((F.col("n_nationkey") + 5) % 25).cast("int"))).distinct()


@C.add(EDGES.replace("WITH e", "WITH RECURSIVE e") + ", r(node) AS (SELECT dst FROM e WHERE src = 3 UNION SELECT e.dst FROM e JOIN r ON e.src = r.node) SELECT node FROM r")
def downstream_nodes(spark, sf):
    return g.reachable(edges(spark, sf), 3)


@C.add(EDGES.replace("WITH e", "WITH RECURSIVE e") + ", r(node, hops) AS (SELECT 3, 0 UNION SELECT e.dst, hops + 1 FROM e JOIN r ON e.src = r.node WHERE hops < 30) SELECT node, min(hops) AS hops FROM r GROUP BY node")
def graph_layers(spark, sf):
    return g.layers(edges(spark, sf), 3)


@C.add(
    """WITH RECURSIVE n AS (SELECT n_nationkey AS node, 1.0 + n_regionkey AS latency FROM nation), e AS (SELECT n_nationkey AS src, n_nationkey + 5 AS dst FROM nation WHERE n_nationkey < 20),
 p AS (SELECT node, latency AS total FROM n UNION ALL SELECT e.dst, p.total + n.latency FROM p JOIN e ON e.src = p.node JOIN n ON n.node = e.dst)
 SELECT node, max(total) AS total FROM p GROUP BY node"""
)
def longest_path(spark, sf):
    n = table(spark, sf, "nation")
    nodes = n.select(F.col("n_nationkey").alias("node"), (F.lit(1.0) + F.col("n_regionkey")).alias("latency"))
    return g.longest_path(n.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("src"), (F.col("n_nationkey") + 5).alias("dst")), nodes, 5)


@C.add("WITH t AS (SELECT DISTINCT l_orderkey AS net, l_suppkey AS c FROM lineitem) SELECT x.net, x.c AS a, y.c AS b FROM t x JOIN t y ON x.net = y.net AND x.c < y.c")
def shared_net_edges(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("component"), F.array("l_orderkey").alias("nets"))
    return g.net_edges(li)


@C.add("WITH t AS (SELECT DISTINCT l_returnflag AS net, l_orderkey AS component FROM lineitem), n AS (SELECT net, count(*) AS n FROM t GROUP BY net HAVING count(*) > 500) SELECT net, n, component FROM t JOIN n USING (net)")
def supply_net_members(spark, sf):
    """Three nets with a third of all orders each, told by membership."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("component"), F.array("l_returnflag").alias("nets"))
    return g.net_members(li, 500)


@C.add("WITH d AS (SELECT n, count(*) AS d FROM (SELECT o_custkey AS n FROM orders UNION ALL SELECT o_orderkey + 1000000000 FROM orders) GROUP BY n) SELECT CAST(least(d * 10 // 20, 9) AS INTEGER) AS bin, count(*) AS nodes FROM d WHERE d <= 20 GROUP BY 1")
def degree_histogram(spark, sf):
    return g.degree_histogram(table(spark, sf, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") + 1000000000).alias("b")))


@C.add(EDGES + ", n AS (SELECT n_nationkey AS node, n_regionkey AS domain, 1.0 + n_nationkey AS freq FROM nation) SELECT src, dst, round(greatest(a.freq, b.freq) / least(a.freq, b.freq), 6) AS ratio FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE a.domain <> b.domain AND greatest(a.freq, b.freq) / least(a.freq, b.freq) > 2")
def clock_crossings(spark, sf):
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("domain"), (F.lit(1.0) + F.col("n_nationkey")).alias("freq"))
    return rounded(g.cross_domain(edges(spark, sf), nodes, 2.0))


@C.add(
    EDGES + """, k AS (SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM e WHERE (src + dst) % 3 <> 0), o AS (SELECT src AS node, string_agg(DISTINCT dst, ',' ORDER BY dst) AS fan_out FROM k GROUP BY 1), i AS (SELECT dst AS node, string_agg(DISTINCT src, ',' ORDER BY src) AS fan_in FROM k GROUP BY 1)
 SELECT coalesce(o.node, i.node) AS node, coalesce(fan_in, '') AS fan_in, coalesce(fan_out, '') AS fan_out FROM o FULL JOIN i ON o.node = i.node"""
)
def fan_lists(spark, sf):
    e = edges(spark, sf).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.when((F.col("src") + F.col("dst")) % 3 == 0, "power").otherwise("data").alias("kind"))
    return g.fan_lists(e, "power").select("node", F.array_join("fan_in", ",").alias("fan_in"), F.array_join("fan_out", ",").alias("fan_out"))


@C.add(EDGES + ", x AS (SELECT n_nationkey AS node, CAST(n_nationkey AS DOUBLE) AS x FROM nation), m AS (SELECT src AS node, avg(x) AS m FROM e JOIN x ON x.node = dst GROUP BY 1) SELECT x.node, round((x + coalesce(m, x)) / 2, 6) AS x FROM x LEFT JOIN m USING (node)")
def mean_aggregation(spark, sf):
    feats = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_nationkey").cast("double").alias("x"))
    return rounded(g.mean_aggregate(edges(spark, sf), feats))


@C.add(S + ", v AS (SELECT DISTINCT state FROM s UNION SELECT 'OFF'), m AS (SELECT 'click' AS src, 'view' AS dst UNION ALL SELECT 'view', 'error' UNION ALL SELECT 'signup', 'click') SELECT state, state IN ('click', 'view', 'error') AS reachable, state IN ('click', 'view', 'signup', 'OFF') AS complete FROM v")
def machine_validation(spark, sf):
    moves = spark.createDataFrame([("click", "view"), ("view", "error"), ("signup", "click")], "src string, dst string")
    defined = table(spark, sf, "events").select(F.col("event_type").alias("state")).distinct().union(spark.sql("SELECT 'OFF'"))
    return st.validate(defined, moves, "click", ["OFF"])


@C.add(
    """WITH e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-8 AS n FROM embeddings),
 d AS (SELECT q.i AS query, e.i AS i, round(list_dot_product(q.v, e.v) / (q.n * e.n), 12) AS sim FROM e q JOIN e ON q.i % 20 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, i) AS INTEGER) AS rank FROM d)
 SELECT query, rank, i, round(sim, 6) AS sim FROM r WHERE rank <= 10"""
)
def similar_designs(spark, sf):
    """Every vector whose id is divisible by 20 against all vectors."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("iv"))
    return rounded(g.cosine_neighbours(e, e.filter("i % 20 = 0"), 10))


@C.add("SELECT arg_min(p_partkey, (d, p_partkey)) AS best, round(min(d), 6) AS distance FROM (SELECT p_partkey, (p_size - 25.5) * (p_size - 25.5) + (p_retailprice / 100 - 9) * (p_retailprice / 100 - 9) AS d FROM part)")
def inverse_design(spark, sf):
    d = (F.col("p_size") - 25.5) ** 2 + (F.col("p_retailprice") / 100 - 9) ** 2
    return rounded(table(spark, sf, "part").agg(F.min_by("p_partkey", F.struct(d, "p_partkey")).alias("best"), F.min(d).alias("distance")))


BINS = """WITH b AS (SELECT p_partkey AS field, CAST(p_size % 20 + 1 AS INTEGER) AS width, CASE WHEN p_partkey % 3 = 0 THEN 'RO' ELSE 'RW' END AS access FROM part)"""


@C.add(BINS + """ SELECT field, array_to_string(list_concat(CASE WHEN width = 1 THEN ['zero', 'one'] WHEN width <= 4 THEN ['zero', 'mid', 'max'] ELSE ['zero', 'low', 'mid', 'high', 'max'] END, CASE WHEN access = 'RO' THEN ['write_ignored'] ELSE [] END), ',') AS bins,
 CASE WHEN width = 1 THEN '0:0,1:1' WHEN width <= 4 THEN '0:0,1:' || ((1 << width) - 2) || ',' || ((1 << width) - 1) || ':' || ((1 << width) - 1)
  ELSE '0:0,1:' || ((1 << width) // 4 - 1) || ',' || ((1 << width) // 4) || ':' || (3 * ((1 << width) // 4) - 1) || ',' || (3 * ((1 << width) // 4)) || ':' || ((1 << width) - 2) || ',' || ((1 << width) - 1) || ':' || ((1 << width) - 1) END AS ranges FROM b""")
def register_field_bins(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("field"), (F.col("p_size") % 20 + 1).cast("int").alias("width"), F.when(F.col("p_partkey") % 3 == 0, "RO").otherwise("RW").alias("access"))
    ranges = F.array_join(F.transform(cov.register_ranges(F.col("width")), lambda r: F.concat_ws(":", r["low"].cast("string"), r["high"].cast("string"))), ",")
    return p.select("field", F.array_join(cov.register_bins(F.col("width"), F.col("access")), ",").alias("bins"), ranges.alias("ranges"))


def model(spark, sf):
    """region > nation > market segment as feature > group > point, customers' statuses as bins."""
    j = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    sign = F.when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    b = j.groupBy("r_name", "n_name", "c_mktsegment").agg(F.array_sort(F.collect_set(sign)).alias("b"))
    p = b.groupBy("r_name", "n_name").agg(F.collect_list(F.struct(F.col("c_mktsegment").alias("name"), F.transform("b", lambda x: F.struct(x.alias("name"))).alias("bins"))).alias("points"))
    gr = p.groupBy("r_name").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), "points")).alias("groups"))
    return gr.select(F.array(F.struct(F.col("r_name").alias("name"), "groups")).alias("features"))


MODEL = "WITH f AS (SELECT DISTINCT r_name AS feature, n_name AS grp, c_mktsegment AS point, CASE WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS bin FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@C.add(MODEL + " SELECT feature || '.' || grp || '.' || point || '.' || bin AS path, feature, grp AS \"group\", point, bin FROM f")
def coverage_paths(spark, sf):
    return cov.flatten(model(spark, sf))


@C.add(MODEL + " SELECT count(DISTINCT feature) AS features, count(DISTINCT (feature, grp)) AS groups, count(DISTINCT (feature, grp, point)) AS points, count(*) AS bins FROM f")
def coverage_totals(spark, sf):
    return cov.totals(cov.flatten(model(spark, sf)))


@C.add(
    MODEL + """, p AS (SELECT DISTINCT feature, grp, point FROM f), l AS (SELECT unnest([feature, feature || '.' || grp, feature || '.' || grp || '.' || point]) AS path, feature || '.' || grp || '.' || point AS target FROM p),
 c AS (SELECT * FROM (VALUES ('two', 'ASIA'), ('two', 'AFRICA'), ('one', 'ASIA'), ('bad', 'ASIA'), ('bad', 'NOWHERE')) AS v(name, path)), z AS (SELECT r_name, row_number() OVER (ORDER BY r_name) AS k FROM region),
 d AS (SELECT name, CASE path WHEN 'ASIA' THEN (SELECT r_name FROM z WHERE k = 1) WHEN 'AFRICA' THEN (SELECT r_name FROM z WHERE k = 2) ELSE path END AS path FROM c)
 SELECT name, count(DISTINCT target) AS points, count(DISTINCT path) >= 2 AND count(DISTINCT path) = count(DISTINCT CASE WHEN target IS NOT NULL THEN path END) AS valid FROM d LEFT JOIN l USING (path) GROUP BY name"""
)
def coverage_crosses(spark, sf):
    flat = cov.flatten(model(spark, sf))
    a, b = [r[0] for r in table(spark, sf, "region").select("r_name").orderBy("r_name").limit(2).collect()]
    crosses = spark.createDataFrame([("two", [a, b]), ("one", [a]), ("bad", [a, "NOWHERE"])], "name string, targets array<string>")
    return cov.cross_points(crosses, flat)


@C.add("WITH m AS (SELECT CAST(o_custkey % 3 AS INTEGER) AS model, o_orderpriority AS feature, o_orderstatus AS grp, count(*) AS bins FROM orders GROUP BY ALL), f AS (SELECT feature, grp, min(model) AS model FROM m GROUP BY ALL) SELECT feature, grp AS \"group\", model, bins FROM m JOIN f USING (feature, grp, model)")
def merge_coverage_models(spark, sf):
    m = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 3).cast("int").alias("model"), F.col("o_orderpriority").alias("feature"), F.col("o_orderstatus").alias("group")).agg(F.count(F.lit(1)).alias("bins"))
    return cov.merge_models(m).select("feature", "group", "model", "bins")


@C.add(S + ", p AS (SELECT DISTINCT state AS src, lead(state) OVER (PARTITION BY run_key ORDER BY idx) AS dst FROM s), x AS (SELECT DISTINCT a.state AS src, b.state AS dst FROM s a, (SELECT DISTINCT state FROM s UNION SELECT 'OFF') b WHERE a.state <> b.state) SELECT count(*) AS expected, count(p.src) AS covered, round(100.0 * count(p.src) / greatest(count(*), 1), 6) AS pct FROM x LEFT JOIN p ON p.src = x.src AND p.dst = x.dst")
def transition_scorecard(spark, sf):
    s = samples(spark, sf)
    names = s.select(F.col("state").alias("src")).distinct()
    expected = names.join(F.broadcast(names.select(F.col("src").alias("dst")).union(spark.sql("SELECT 'OFF'"))), F.col("src") != F.col("dst"))
    return rounded(cov.scorecard(expected, st.transitions(s), ["src", "dst"]))


@C.add("SELECT 'OFF' AS state, 1 AS ord UNION ALL SELECT 'FAULT', 3")
def missing_states(spark, sf):
    expected = spark.createDataFrame([("OFF", 1), ("click", 2), ("FAULT", 3)], "state string, ord int")
    return cov.missing(expected, table(spark, sf, "events").select(F.col("event_type").alias("state")), ["state"])


@C.add("WITH s AS (SELECT o_orderstatus AS state, 'ready' AS role, 'pg' AS output, avg(CAST(o_totalprice > 100000 AS INTEGER)) AS mean FROM orders GROUP BY 1) SELECT role, output, state, round(mean, 6) AS mean, 0 AS expected FROM s WHERE mean >= 0.5")
def output_contradictions(spark, sf):
    sig = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.avg((F.col("o_totalprice") > 100000).cast("int")).alias("mean")).withColumn("role", F.lit("ready")).withColumn("output", F.lit("pg"))
    return rounded(cov.output_gaps(sig, spark.createDataFrame([("ready", "pg", 0)], "role string, output string, expected int")))


@C.add("SELECT p_partkey, p_type AS ip_type, CASE p_type WHEN 'ECONOMY' THEN 'OFF,EN' WHEN 'SMALL' THEN 'A,B,C' ELSE 'OFF,ON' END AS states, CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL') THEN 'no profile, using generic: ' || p_type END AS notice FROM part")
def profile_dispatch(spark, sf):
    built = spark.createDataFrame([("ECONOMY", ["OFF", "IDLE"]), ("SMALL", ["A", "B", "C"])], "ip_type string, states array<string>")
    own = spark.createDataFrame([("ECONOMY", ["OFF", "EN"])], "ip_type string, states array<string>")
    return cov.ip_profiles(table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("ip_type")), built, own).withColumn("states", F.array_join("states", ","))


@C.add("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'clk,urgent' WHEN o_orderpriority IN ('2-HIGH') THEN 'clk,high' ELSE 'vout' END AS signals FROM orders WHERE o_orderstatus = 'F'")
def failing_signals(spark, sf):
    r = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("checker"), F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("PASS").alias("status"))
    rules = [("urgent", ["clk", "urgent"]), ("high", ["clk", "high"]), ("1-", ["clk"])]
    return cov.viewer_signals(r, rules, ["vout"]).select("o_orderkey", F.array_join("signals", ",").alias("signals"))


@C.add(
    """SELECT p_partkey, CAST(p_size AS DOUBLE) * 1e3 AS kilo, CAST(p_size AS DOUBLE) * 1e-3 AS milli, CAST(p_size AS DOUBLE) * 1e6 AS mega, 0.0 AS bad, 'TT' AS process, p_size / 10.0 AS voltage, CAST(-p_size AS DOUBLE) AS temperature,
 'a' || p_partkey AS name, 'r1' AS run, CASE WHEN p_partkey % 2 = 0 THEN 'c2' END AS corner, 'tt' AS corner_of, CAST(p_size AS BIGINT) AS hex FROM part"""
)
def scalar_parsing(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    c = fn.parse_corner(F.concat(F.lit("TT_"), F.regexp_replace((F.col("p_size") / 10).cast("string"), r"\.", "p"), F.lit("V_N"), size, F.lit("C")))
    s = fn.parse_signal(F.concat_ws("@", F.concat(F.lit("a"), F.col("p_partkey")), F.lit("r1"), F.when(F.col("p_partkey") % 2 == 0, "c2")))
    meta = fn.parse_meta(F.concat(F.lit(" Corner = tt ,bad,n="), size))
    return p.select(
        "p_partkey",
        fn.si_number(F.concat(size, F.lit("k"))).alias("kilo"),
        fn.si_number(F.concat(size, F.lit("m"))).alias("milli"),
        fn.si_number(F.concat(size, F.lit("MEG"))).alias("mega"),
        fn.si_number(F.lit("x1")).alias("bad"),
        c["process"].alias("process"),
        c["voltage"].alias("voltage"),
        c["temperature"].alias("temperature"),
        s["name"].alias("name"),
        s["run"].alias("run"),
        s["corner"].alias("corner"),
        fn.corner_of_meta(meta).alias("corner_of"),
        fn.parse_int(F.concat(F.lit("0x"), F.hex("p_size"))).alias("hex"),
    )


@C.add("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 0.5, 0) * 0.5 AS restored, CASE WHEN l_quantity - 10 <= -0.1 THEN 'off' WHEN l_quantity < 10 THEN 'subthreshold' WHEN l_tax * 500 < l_quantity - 10 THEN 'linear' ELSE 'saturation' END AS region, round(50 * (1 - l_discount * l_discount - l_tax * l_tax) / ((1 - l_discount) * (1 - l_discount) + l_tax * l_tax), 6) AS z_re FROM lineitem")
def scalar_math(spark, sf):
    li = table(spark, sf, "lineitem")
    qz = fn.quantize(F.col("l_extendedprice"), F.lit(0.5), F.lit(0.0))
    return li.select("l_orderkey", "l_linenumber", fn.dequantize(qz, F.lit(0.5), F.lit(0.0)).alias("restored"), ph.region(F.col("l_quantity"), F.col("l_tax") * 500, F.lit(10.0)).alias("region"), F.round(fn.s_to_z(F.col("l_discount"), F.col("l_tax"))["re"], 6).alias("z_re"))


@C.add(
    """SELECT p_partkey, round(0.5 * 2 * greatest(p_size / 20.0 - 0.5, 0) * greatest(p_size / 20.0 - 0.5, 0), 6) AS ids, round(10 * log10(greatest(1 + p_size / 1000.0 * 50 * (2.0 / 3), 1)), 6) AS nf, round(1 / (2 * CASE WHEN p_type = 'SMALL' THEN 20.0 ELSE 150.0 END * sqrt(pi() * greatest(p_size * 1e-12, 1e-12))), 4) AS rth,
 round((50.0 - p_size) / 50.0, 6) AS em, round(greatest(0, least(1, (p_size / 20.0 - greatest(p_size / 40.0 - 0.5, 0.05)) / 1.8)), 6) AS hci, round(least(exp(-0.5 / (8.617e-5 * (250 + p_size))) * power(10 * 3.15e7, 0.25) * (p_size / 20.0) / 0.1, 1), 6) AS nbti,
 round(p_size * 1e-6 / (7 * 1e-15) / 1e6, 4) AS slew, round(0.2 * p_size * 1e-15 * 1.44 * 100e6 * 1e6, 6) AS dyn, p_size BETWEEN 20 AND 160 AS ok FROM part"""
)
def device_physics(spark, sf):
    p, x = table(spark, sf, "part"), F.col("p_size")
    one = F.lit(1.0)
    return rounded(
        p.select(
            "p_partkey",
            ph.saturation_current(x / 20, F.lit(0.5), F.lit(2.0), one, one, one).alias("ids"),
            ph.noise_figure(F.lit(50.0), x / 1000).alias("nf"),
            F.round(ph.thermal_resistance(x.cast("double"), F.when(F.col("p_type") == "SMALL", "soi").otherwise("?")), 4).alias("rth"),
            ph.migration_margin(x.cast("double"), F.lit(50.0)).alias("em"),
            ph.hot_carrier_risk(x / 20, x / 40, F.lit(0.5), F.lit(1.8)).alias("hci"),
            ph.bias_instability(x / 20, 250.0 + x).alias("nbti"),
            F.round(ph.slew_rate(x.cast("double"), F.lit(7.0)), 4).alias("slew"),
            ph.switching_power(F.lit(0.2), x.cast("double"), F.lit(1.2), F.lit(100.0)).alias("dyn"),
            ph.plausible(F.lit("cmrr_dB"), x.cast("double")).alias("ok"),
        )
    )


QUERIES, ORACLES = C.queries, C.oracles
