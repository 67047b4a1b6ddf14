"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments of 16 bits and each segment has a table from its value to the rows that hold it.
A query probes the segments in turn with all values at distance 0, then 1, 2, ... Once segment s has been probed to
radius r (those after it to r - 1), every row within distance m * r + s is known to have been seen, so the search stops
as soon as the k-th best verified distance is that small; ties at this distance are then complete too and are broken
by id. When the probes of a step would outnumber the rows, all rows are verified instead, which covers any distance.

Rows are dealt to shards by a hash of their id, queries to blocks; a task takes one shard and one block, both of
bounded size, and the best k of all shards are merged. Equal codes are one entry with its smallest ids: at most k + 1
of them can be in a result, so very common vectors cost no more than rare ones.

Defined cases: null or empty vectors have no code, are neither found nor answered; a query does not find its own id;
fewer than k rows give fewer results; repeated ids count once, with each distinct code; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pandas_map

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
SHARD_ROWS, BLOCK_QUERIES, LEAST_BLOCKS, LEAST_QUERIES = 200_000, 50_000, 12, 128


def code_of(vector) -> int | None:
    """Signs of the elements; element j of a longer vector adds to bit j mod 64."""
    if vector is None or len(vector) == 0:
        return None
    v = np.nan_to_num(np.asarray(vector, dtype=np.float64))
    v = np.pad(v, (0, -len(v) % BITS)).reshape(-1, BITS).sum(axis=0)
    return int(np.packbits(v > 0, bitorder="little").view("<u8")[0])


def masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), radius)], dtype=np.int64)


MASKS = [masks(r) for r in range(WIDTH + 1)]


class Index:
    """Tables of one shard: distinct codes, and for each the k + 1 smallest ids."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, k: int):
        order = np.lexsort((ids, codes))
        codes, ids = codes[order], ids[order]
        first = np.r_[True, codes[1:] != codes[:-1]]
        start = np.flatnonzero(first)
        self.codes, self.ids, self.start = codes[start], ids, start
        self.size = np.minimum(np.diff(np.r_[start, len(codes)]), k + 1)
        self.k = k
        self.tables = []
        for s in range(SEGMENTS):
            key = self.segment(self.codes, s)
            by = np.argsort(key, kind="stable")
            self.tables.append((by, np.searchsorted(key[by], np.arange((1 << WIDTH) + 1))))

    @staticmethod
    def segment(codes: np.ndarray, s: int) -> np.ndarray:
        return (codes >> np.uint64(WIDTH * s)).astype(np.int64) & ((1 << WIDTH) - 1)

    def search(self, code: int, own: int) -> list[tuple[int, int]]:
        """(distance, id) of the k best, in order."""
        q = np.uint64(code)
        seen = np.zeros(len(self.codes), dtype=bool)
        rows, dist = [], []

        def verify(new: np.ndarray) -> None:
            seen[new] = True
            rows.append(new)
            dist.append(np.bitwise_count(self.codes[new] ^ q).astype(np.int64))

        for r in range(WIDTH + 1):
            for s in range(SEGMENTS):
                if len(MASKS[r]) > len(self.codes):
                    verify(np.flatnonzero(~seen))
                    covered = BITS
                else:
                    by, stop = self.tables[s]
                    keys = int(self.segment(np.array([q]), s)[0]) ^ MASKS[r]
                    lo, n = stop[keys], stop[keys + 1] - stop[keys]
                    at = by[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]  # a row is under one key of a segment
                    verify(at[~seen[at]])
                    covered = SEGMENTS * r + s
                d = np.concatenate(dist)
                have = self.size[np.concatenate(rows)[d <= covered]].sum()
                if have >= self.k + 1 or covered >= BITS:
                    return self.best(np.concatenate(rows), d, own)
        return self.best(np.concatenate(rows), np.concatenate(dist), own)

    def best(self, rows: np.ndarray, dist: np.ndarray, own: int) -> list[tuple[int, int]]:
        if not len(rows):
            return []
        if len(rows) > self.k + 1:
            keep = dist <= np.partition(dist, self.k)[self.k]
            rows, dist = rows[keep], dist[keep]
        n = self.size[rows]
        ids = self.ids[np.repeat(self.start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        d = np.repeat(dist, n)
        keep = ids != own
        ids, d = ids[keep], d[keep]
        order = np.lexsort((ids, d))[: self.k]
        return list(zip(d[order].tolist(), ids[order].tolist()))


def _codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made = [(i, code_of(v)) for i, v in zip(pdf["vec_id"], pdf["embedding"])]
        made = [(i, c - (1 << 64) if c >> 63 else c) for i, c in made if c is not None]
        yield pd.DataFrame(made, columns=["vec_id", "code"]).astype("int64")


def binary_codes(vectors: DataFrame) -> DataFrame:
    """vec_id and code (64 sign bits in a long)."""
    return vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull()).transform(pandas_map, _codes, "vec_id long, code long")


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates(["vec_id", "code"]).sort_values(["vec_id", "code"])
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "ids": [pdf["vec_id"].to_numpy().astype("<i8").tobytes()], "codes": [pdf["code"].to_numpy().astype("<i8").tobytes()]})


PACKED = "part int, ids binary, codes binary"


@lru_cache(maxsize=1)
def index_of(codes: bytes, ids: bytes, k: int) -> Index:
    """Kept by a worker for the next block of queries to the same shard."""
    return Index(np.frombuffer(codes, dtype="<u8"), np.frombuffer(ids, dtype="<i8"), k)


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, codes, qids, qcodes in zip(pdf["ids"], pdf["codes"], pdf["qids"], pdf["qcodes"]):
                index = index_of(bytes(codes), bytes(ids), k)
                out = []
                for i, c in zip(np.frombuffer(qids, dtype="<i8").tolist(), np.frombuffer(qcodes, dtype="<u8").tolist()):
                    out += [(i, c - (1 << 64) if c >> 63 else c, n, d) for d, n in index.search(c, i)]
                yield pd.DataFrame(out, columns=["query_id", "query_code", "neighbor_id", "distance"]).astype("int64")

    return run


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance. Small query sets are still cut into a dozen blocks for parallel work."""
    n, nq = codes.count(), queries.count()
    shards = max(1, -(-n // shard_rows))
    blocks = max(1, -(-nq // block_queries), min(LEAST_BLOCKS // shards, nq // LEAST_QUERIES))
    part = lambda df, m: df.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")).groupBy("part").applyInPandas(_pack, PACKED)
    index = part(codes, shards).select("ids", "codes", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"))
    asked = part(queries, blocks).select("part", F.col("ids").alias("qids"), F.col("codes").alias("qcodes"))
    work = index.join(asked, "part").repartition(shards * blocks)
    found = work.transform(pandas_map, _search(k), "query_id long, query_code long, neighbor_id long, distance long")
    found = found.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    best = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
