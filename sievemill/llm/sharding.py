"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal text form a group, and a group is placed as one item in the shard where the dot product of its
(bytes, tokens, rows) vector with the shard's residual capacity is highest, largest items first.

The greedy step must not see the corpus. It gets items of three kinds, all bounded in number by parameters:
groups of at least 1 / (n_shards * fine) of some total (at most 3 * n_shards * fine of them); all other groups,
bundled by a hash of their text into `bundles` items; and the chunks of those groups that exceed a whole shard
(at most 3 * n_shards such groups, their rows dealt into `chunks` pieces), as no placement could balance
them whole. So shard totals differ by about the size of the last item placed.

Defined cases: null text counts as empty (size 1, crc 0); no rows give no rows; equal rows go to one shard unless
their group must be cut; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of


def word_count(text: Column) -> Column:
    """Words between blanks of any kind, the default token measure."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def place(items: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each item (rows of bytes, tokens, rows): highest dot product with the residual capacities."""
    total = items.sum(axis=0).astype(float)
    share = items / np.where(total > 0, total, 1)
    residual = np.full((n_shards, items.shape[1]), 1.0 / n_shards)
    shard = np.zeros(len(items), dtype=np.int64)
    for i in np.lexsort((np.arange(len(items)), -share.max(axis=1))):
        best = int(np.argmax(residual @ share[i]))
        shard[i] = best
        residual[best] -= share[i]
    return shard


def shard_documents(docs: DataFrame, n_shards: int = 8, fine: int = 1024, bundles: int = 4096, chunks: int = 64, tokens=word_count, block_rows: int = 5000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 within a shard)."""
    spark = docs.sparkSession
    t = text_of("text")
    slim = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(t) + 1).cast("long").alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            tokens(t).alias("tokens"),
            F.md5(t.cast("binary")).alias("g"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    measures = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")]
    total = slim.agg(*measures).first()
    rows = total["r"]
    groups = slim.groupBy("g").agg(*measures)
    share = F.greatest(*[F.col(c) / F.lit(float(max(1, total[c] or 0))) for c in "btr"])
    groups = materialise(groups.withColumn("share", share), "shard-groups")

    is_big = F.col("share") >= 1.0 / (n_shards * fine)
    big = groups.filter(is_big).orderBy("g").collect()  # at most 3 * n_shards * fine rows
    oversized = [x["g"] for x in big if x["share"] > 1.0 / n_shards]
    chunk = F.when(F.col("g").isin(oversized), F.pmod(F.xxhash64("row"), F.lit(chunks))).otherwise(0).cast("int") if oversized else F.lit(0)
    slim = slim.withColumn("chunk", chunk)
    cut = slim.filter(F.col("g").isin(oversized)).groupBy("g", "chunk").agg(*measures).orderBy("g", "chunk").collect() if oversized else []
    bundle = F.pmod(F.xxhash64("g"), F.lit(bundles)).cast("int")
    rest = groups.filter(~is_big).groupBy(bundle.alias("bundle")).agg(*[F.sum(c).alias(c) for c in "btr"]).orderBy("bundle").collect()

    keys = [(x["g"], 0) for x in big if x["g"] not in set(oversized)] + [(x["g"], x["chunk"]) for x in cut]
    vectors = [[x[c] for c in "btr"] for x in [*(x for x in big if x["g"] not in set(oversized)), *cut, *rest]]
    shard = place(np.array(vectors, dtype=float).reshape(-1, 3), n_shards).tolist()
    of_group = spark.createDataFrame([(g, c, s) for (g, c), s in zip(keys, shard)], "g string, chunk int, of_group int")
    of_bundle = spark.createDataFrame([(x["bundle"], s) for x, s in zip(rest, shard[len(keys) :])], "bundle int, of_bundle int")
    placed = (
        slim.withColumn("bundle", bundle)
        .join(F.broadcast(of_group), ["g", "chunk"], "left")
        .join(F.broadcast(of_bundle), "bundle", "left")
        .withColumn("shard", F.coalesce("of_group", "of_bundle"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "chunk"), F.lit(max(1, rows // (block_rows * n_shards)))))
    )
    # A slot is the number of rows in earlier blocks of the shard plus the place in the block.
    cells = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "row")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(cells, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))
    )
