"""Dimension lookups: prioritised maps, fuzzy names, nearest and bracketing grid points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.session import bounded, cut, numbered


def map_names(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows (run, name, kind) renamed by mapping (name, kind, run_scope, target, pos): an entry of the run beats one
    for all runs, the last entry of equals counts, and names without entry stay."""
    last = mapping.groupBy("name", "kind", "run_scope").agg(F.max_by("target", "pos").alias("target"))
    scoped = last.filter("run_scope IS NOT NULL").select("name", "kind", F.col("run_scope").alias("run"), F.col("target").alias("_s"))
    general = last.filter("run_scope IS NULL").select("name", "kind", F.col("target").alias("_g"))
    out = rows.join(scoped, ["run", "name", "kind"], "left").join(general, ["name", "kind"], "left")
    return out.withColumn("target", F.coalesce("_s", "_g", "name")).drop("_s", "_g")


def unmapped(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """Names that no entry targets."""
    return names.join(mapping.select(F.col("target").alias("name")), "name", "left_anti")


def suggest(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each name the first candidate that contains it or ends with it, ignoring case; both sides are dimensions."""
    n, c = F.lower("name"), F.lower("candidate")
    rank = F.when(c == n, 0).when(c.endswith(n), 1).otherwise(2)
    hit = names.join(bounded(candidates), c.contains(n), "inner")
    return hit.groupBy("name").agg(F.min_by("candidate", F.struct(rank, "candidate")).alias("suggested"))


def nearest(rows: DataFrame, grid: DataFrame, v_scale: float, t_scale: float, penalty: float = 10.0) -> DataFrame:
    """For each row (id, v, t, process) the grid point (corner, gv, gt, gprocess) at the smallest scaled squared
    distance, a different process costing `penalty`; the first corner of equals. Rows and grid may have any size: they
    meet in blocks near each other, see blocks.py."""
    from .blocks import nearest_points

    def far(x, tag, p, ptag):  # differences are taken before they are scaled: those equal as numbers tie
        return (((x[:, 2:3] - p[:, 2]) / v_scale) ** 2 + ((x[:, 3:] - p[:, 3]) / t_scale) ** 2) + (tag[:, None] != ptag) * penalty

    floor = lambda gap, same: gap**2 + ~same * penalty
    at = lambda df, key, v, t, process: df.select(F.col(key).cast("long").alias("id"), F.array(F.col(v) / v_scale, F.col(t) / t_scale, F.col(v), F.col(t)).alias("x"), F.xxhash64(process).alias("tag"))
    own = rows.select("id", "v", "t", "process").repartition("id", "v", "t", "process")  # files may be few
    own = cut(own.withColumn("_row", F.monotonically_increasing_id()))
    found = nearest_points(at(own, "_row", "v", "t", "process"), at(grid, "corner", "gv", "gt", "gprocess"), 1, far, F.sqrt, sides=2, floor=floor)
    return own.select("id", "_row").join(found.withColumnRenamed("id", "_row"), "_row").select("id", F.col("point").alias("corner"), "distance")


def in_one_row(dimension: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """A dimension as one array in one row; raises for more rows than an array is meant for."""
    if dimension.limit(most + 1).count() > most:
        raise ValueError(f"a dimension of at most {most} rows is needed here")
    return F.broadcast(dimension.agg(F.collect_list(F.struct(*dimension.columns)).alias(name)))


def _interpolated(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """rows with z, by the four grid points around (x, y)."""
    by = rows.join(in_one_row(grid.select("gx").distinct(), "_xs")).join(in_one_row(grid.select("gy").distinct(), "_ys"))
    for c in "xy":
        at, own = F.col(c), F.col(f"_{c}s.g{c}")
        by = by.withColumn(f"{c}0", F.array_max(F.filter(own, lambda g: g <= at))).withColumn(f"{c}1", F.array_min(F.filter(own, lambda g: g >= at)))  # noqa: B023
    by = by.drop("_xs", "_ys")
    for k in ("00", "01", "10", "11"):
        corner = grid.select(F.col("gx").alias(f"x{k[0]}"), F.col("gy").alias(f"y{k[1]}"), F.col("gz").alias(f"z{k}"))
        by = by.join(corner, [f"x{k[0]}", f"y{k[1]}"], "left")
    fx = F.when(F.col("x1") > F.col("x0"), (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(0.0)
    fy = F.when(F.col("y1") > F.col("y0"), (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0"))).otherwise(0.0)
    z = (1 - fx) * ((1 - fy) * F.col("z00") + fy * F.col("z01")) + fx * ((1 - fy) * F.col("z10") + fy * F.col("z11"))
    return by.select(*rows.columns, z.alias("z"))


def bilinear(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Interpolates grid (gx, gy, gz) at rows (id, x, y) from the four neighbours; null outside the hull or where a
    neighbour is missing. The grid is a dimension."""
    return _interpolated(rows, grid).select("id", "z")


def bilinear_or_nearest(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """bilinear, and the value of the nearest grid point, the smallest (gx, gy) of equals, where that gives null."""
    from .blocks import nearest_points

    far = lambda x, _, p, __: (x[:, :1] - p[:, 0]) ** 2 + (x[:, 1:] - p[:, 1]) ** 2
    points = cut(numbered(grid.select("gx", "gy", "gz"), "_k", "gx", "gy", "gz"))
    told = cut(_interpolated(rows, grid).withColumn("_row", F.monotonically_increasing_id()))
    lost = told.filter("z IS NULL AND x IS NOT NULL AND y IS NOT NULL")
    at = lambda df, key, x, y: df.select(F.col(key).cast("long").alias("id"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("x"), F.lit(0).cast("long").alias("tag"))
    near = nearest_points(at(lost, "_row", "x", "y"), at(points, "_k", "gx", "gy"), 1, far, F.sqrt, floor=lambda gap, _: gap**2)
    near = near.join(points.select(F.col("_k").alias("point"), F.col("gz").alias("_near")), "point").select(F.col("id").alias("_row"), "_near")
    return told.join(near, "_row", "left").select("id", F.coalesce("z", "_near").alias("z"), F.col("z").isNull().alias("fallback"))


def same_family(detail: Column, reference: Column) -> Column:
    """Equal, or one starts with the first underscore-separated token of the other."""
    first = lambda c: F.split_part(c, F.lit("_"), F.lit(1))
    return (detail == reference) | detail.startswith(first(reference)) | reference.startswith(first(detail))


def family_split(expected: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expected names covered by a seen one of their family, and those missing; both are dimensions."""
    test = same_family(F.col("seen"), F.col("expected"))
    return expected.join(bounded(seen), test, "left_semi"), expected.join(bounded(seen), test, "left_anti")


def dedupe_runs(runs: DataFrame) -> DataFrame:
    """The last of the runs that share (run_id, corner_id)."""
    w = Window.partitionBy("run_id", "corner_id").orderBy(F.desc("run_number"))
    return runs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def merge_on_grid(parts: DataFrame) -> DataFrame:
    """parts (part, idx, t, signal, value) of one run, or of many with a run_key, merged to the grid of each run's first
    part: a signal that occurs in several parts is taken from the last; raises where the grids of a run differ."""
    run = [c for c in parts.columns if c == "run_key"]
    grids = parts.select(*run, "part", "idx", "t").distinct().groupBy(*run, "idx").agg(F.countDistinct("t").alias("k"), F.countDistinct("part").alias("p"))
    whole = grids.groupBy(*run).agg(F.max("p").alias("p"), F.min("p").alias("q"), F.max("k").alias("k"))
    if whole.filter("k > 1 OR p <> q").limit(1).count():
        raise ValueError("the parts of a run must share one time grid")
    return parts.groupBy(*run, "idx", "signal").agg(F.max_by("t", "part").alias("t"), F.max_by("value", "part").alias("value"))
