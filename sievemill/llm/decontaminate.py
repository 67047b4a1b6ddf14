"""Benchmark decontamination by greedy string tiling.

Words (lower-cased runs of letters, digits and underscores; in scripts without blanks each character) are numbered by the benchmark's own vocabulary. Rolling
Karp-Rabin hashes of every window of `min_words` words of a document are looked up among those of the benchmark; these
shared seeds join documents with items. For each joined pair that enough seeds cover, the longest match that overlaps
no earlier tile is marked, again and again, until none of min_words words is left. A document holds an item if its
tiles cover at least `threshold` of the item's words, in whatever order they stand.

The benchmark is read in blocks of about `block_items` items and `block_bytes` of text at most, each sent to all tasks;
all texts of one item_id are in one block. With several blocks the hits of one are written before the next is read, so
driver and tasks hold one block at a time; the documents are scanned once a block.

Defined cases: null or empty texts match nothing; items of fewer than min_words words never match, as they stand in
many clean texts, unless short_items is set: then they match where they stand whole in one run; a document that holds
several items, or one several times, gives one row an item; repeated rows give rows each; for items that share an id
each is matched on its own and the best coverage is reported; very long texts cost memory in proportion, however often
their words repeat; extra columns are ignored by find_leaks and kept by drop_leaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_map, free_name, materialise, text_of

# Thai to Khmer, kana, Han ideographs, as Unicode's blocks have them.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W{UNSPACED}]+|(?=\w)[{UNSPACED}]")
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
#: Digests of documents that are broadcast at most.
BROADCAST_ROWS = 1_000_000
FIELDS = ("item_id", "item_words", "covered_words", "tiles", "longest_tile")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all windows of k numbers."""
    n = len(ids) - k + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for j in range(k if n > 0 else 0):
        out = out * BASE + ids[j : j + n]
    return out


class Benchmark:
    """One block of items: vocabulary, numbered words, and the seeds in hash order."""

    def __init__(self, items: list[tuple], k: int, short_items: bool = False):
        self.k, self.ids = k, [i for i, _ in items]
        cut = [words_of(t or "") for _, t in items]
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], dtype=np.uint64) for ws in cut]
        hashes = [rolling(w, k) for w in self.words]
        seed = np.concatenate([np.zeros(0, np.uint64), *hashes])
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        pos = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)])
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.pos = seed[order], item[order], pos[order]
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.short: dict[int, dict[int, list[int]]] = {}  # by length and hash, of items below k words
        for x, w in enumerate(self.words if short_items else ()):
            if 0 < len(w) < k:
                self.short.setdefault(len(w), {}).setdefault(int(rolling(w, len(w))[0]), []).append(x)

    def holds(self, text: str, threshold: float) -> list[tuple]:
        """(item_id, item words, covered words, tiles, longest tile) of the items that the text holds."""
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words_of(text)], dtype=np.uint64)
        found: dict = {}
        for x, tiles in [*self._long(ids, threshold), *self._whole(ids)]:
            size, covered = int(self.size[x]), sum(tiles)
            best = found.get(self.ids[x])
            if best is None or covered / size > best[2] / best[1]:
                found[self.ids[x]] = (self.ids[x], size, covered, len(tiles), max(tiles))
        return list(found.values())

    def _known(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Starts of the windows of k words that all are in the vocabulary."""
        if len(ids) < k:
            return np.zeros(0, dtype=np.int64)
        known = np.cumsum(np.r_[0, ids != 0])
        return np.flatnonzero(known[k:] - known[:-k] == k)

    def _whole(self, ids: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Items below k words that stand in the text in one run."""
        for n, items in self.short.items():
            at = self._known(ids, n)
            for h in np.unique(rolling(ids, n)[at]).tolist():
                for x in items.get(h, ()):
                    yield x, [n]

    def _long(self, ids: np.ndarray, threshold: float) -> Iterator[tuple[int, list[int]]]:
        """The tiles of the items that they cover enough of. Seeds are looked up once for each distinct hash, so what is
        listed is bounded by the block's seeds and by the text, not by their product."""
        at = self._known(ids, self.k)
        if not len(at) or not len(self.seed):
            return
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(self.k):
            h = h * BASE + ids[at + j]
        distinct, which = np.unique(h, return_inverse=True)
        lo, hi = np.searchsorted(self.seed, distinct, "left"), np.searchsorted(self.seed, distinct, "right")
        n = hi - lo
        if not n.any():
            return
        of = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, pos, kind = self.item[of], self.pos[of], np.repeat(np.arange(len(distinct)), n)
        order = np.lexsort((pos, item))
        item, pos, kind = item[order], pos[order], kind[order]
        last = np.r_[item[1:] != item[:-1], True]
        new = np.where(last, self.k, np.minimum(self.k, np.r_[pos[1:], 0] - pos))  # words that a seed covers before the next
        first = np.flatnonzero(np.r_[True, last[:-1]])
        most = np.add.reduceat(new, first)  # no tiling can cover more than all seeds do
        stop = np.r_[first[1:], len(item)]
        by = np.argsort(which, kind="stable")
        start = np.searchsorted(which[by], np.arange(len(distinct) + 1))
        for a, b in zip(first[ok := most >= threshold * self.size[item[first]]].tolist(), stop[ok].tolist()):
            x = int(item[a])
            here = np.concatenate([at[by[start[c] : start[c + 1]]] for c in np.unique(kind[a:b]).tolist()])
            tiles = tile(self.words[x], ids, pos[a:b], np.sort(here), self.k)
            if tiles and sum(tiles) >= threshold * self.size[x]:
                yield x, tiles


class Windows:
    """Hashes of all windows of any length of a list of numbers, and how far each place is free."""

    def __init__(self, words: np.ndarray, used: np.ndarray):
        self.words, self.used = words, used
        x = words * MIX
        x = (x ^ (x >> np.uint64(29))) * MIX
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(x), BASE)])
        self.sums = np.r_[np.uint64(0), np.cumsum((x ^ (x >> np.uint64(32))) * power[:-1])]
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(len(x), INVERSE)])
        self.look()

    def look(self) -> None:
        n = len(self.words)
        stop = np.where(self.used, np.arange(n), n)
        self.free = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)

    def at(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and Karp-Rabin hashes of the free windows of n words."""
        i = np.flatnonzero(self.free >= n)
        return i, (self.sums[i + n] - self.sums[i]) * self.back[i]


def tile(item: np.ndarray, doc: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> list[int]:
    """Lengths of the greedy tiles, given the places i and j of shared seeds in item and document.

    The longest free match is found by halving: where a run of n words is shared, one of n - 1 is, so a search over
    window hashes tells the largest n. All matches of that length are marked, first ones first, and the search goes on
    below it. Memory is linear in the words, however often they repeat."""
    if not len(i) or not len(j):
        return []
    edge = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(edge, j, 1)
    np.add.at(edge, j + k, -1)
    seeded = np.flatnonzero(np.cumsum(edge)[:-1] > 0)  # no tile has other words
    words = np.insert(doc[seeded], np.flatnonzero(np.diff(seeded) > 1) + 1, np.uint64(0))
    a, b = Windows(item, np.zeros(len(item), dtype=bool)), Windows(words, words == 0)
    out: list[int] = []
    most = min(int(a.free.max(initial=0)), int(b.free.max(initial=0)))
    while most >= k:
        low, high = k - 1, most
        while low < high:
            n = (low + high + 1) // 2
            if np.isin(a.at(n)[1], b.at(n)[1]).any():
                low = n
            else:
                high = n - 1
        if low < k:
            break
        (ai, ah), (bi, bh) = a.at(low), b.at(low)
        order = np.lexsort((bi, bh))
        bi, bh = bi[order], bh[order]
        lo, hi = np.searchsorted(bh, ah, "left"), np.searchsorted(bh, ah, "right")
        marked, past = set(), -1
        for p, x, y in zip(ai.tolist(), lo.tolist(), hi.tolist()):
            if p < past:
                continue
            while x < y and (b.used[q := int(bi[x])] or b.used[q + low - 1] or not np.array_equal(item[p : p + low], words[q : q + low])):
                x += 1
            if x < y:
                b.used[q : q + low] = True
                marked.add(p)
                past = p + low
        for p in marked:
            a.used[p : p + low] = True
        out += [low] * len(marked)
        a.look(), b.look()
        most = min(low - 1, int(a.free.max(initial=0)), int(b.free.max(initial=0)))
    return out


def block_count(benchmark: DataFrame, block_items: int, block_bytes: int) -> int:
    """Blocks by the number of items and by their bytes, whichever are more."""
    about = benchmark.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_of("text"))).alias("size")).first()
    return max(-(-about["n"] // block_items), -(-(about["size"] or 0) // block_bytes))


def benchmark_blocks(benchmark: DataFrame, k: int, parts: int, short_items: bool = False) -> Iterator[Benchmark]:
    """Blocks by item_id, read one after another."""
    rows = benchmark.select("item_id", "text").distinct()
    for b in range(parts):
        own = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == b)
        yield Benchmark([(x["item_id"], x["text"]) for x in own.sort("item_id", "text").collect()], k, short_items)


def _find(block: Benchmark, threshold: float):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(FIELDS, hit)) for hit in block.holds(t, threshold)] for t in texts], dtype=object)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = 5, threshold: float = 0.5, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, short_items: bool = False) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    spark, kind = docs.sparkSession, benchmark.schema["item_id"].dataType.simpleString()
    fields = f"item_id:{kind}," + ",".join(f"{c}:bigint" for c in FIELDS[1:])
    out = None
    parts = block_count(benchmark, block_items, block_bytes)
    for block in benchmark_blocks(benchmark, min_words, parts, short_items):
        hits = column_map(spark, _find(block, threshold), f"array<struct<{fields}>>")(text_of("text"))
        found = docs.select("doc_id", F.explode(hits).alias("hit")).select("doc_id", "hit.*")
        found = found if parts == 1 else materialise(found, "leaks")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {fields.replace(':', ' ')}")
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def _clean(block: Benchmark, threshold: float):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not block.holds(t, threshold) for t in texts], dtype=bool)

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = 5, threshold: float = 0.5, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, short_items: bool = False) -> DataFrame:
    """The documents that hold no benchmark item, unchanged. With several blocks, the digests of texts that hold items
    are written block by block, and documents with such a text go."""
    parts, spark = block_count(benchmark, block_items, block_bytes), docs.sparkSession
    digest, name = F.sha2(text_of("text"), 256), free_name(docs, "_digest")
    gone = None
    for block in benchmark_blocks(benchmark, min_words, parts, short_items):
        clean = column_map(spark, _clean(block, threshold), "boolean")(text_of("text"))
        if parts == 1:
            return docs.filter(clean)
        found = materialise(docs.filter(~clean).select(digest.alias(name)).distinct(), "leaking")
        gone = found if gone is None else gone.unionByName(found)
    if gone is None:
        return docs
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.withColumn(name, digest).join(gone, name, "left_anti").select(docs.columns)
