"""Line dedup with sharded cuckoo filters backed by exact reference-count tables.

State (LineIndex): a reference-count table (shard, h1, h2, refs) of 128-bit line keys, refs being the number of
documents that hold the key, and a table of one cuckoo filter per shard over the "hot" keys, those whose count reaches
the threshold. Inserting documents adds their counts and puts newly hot keys into the filters; deleting documents takes
their counts away and discards the keys that cooled. So dropping lines is reversible: what a document loses is always
decided by the present counts, never stored in it.

Filters are built shard by shard in tasks, about five bytes a key, and broadcast in groups of shards of bounded size,
one pass over the documents a group (one group up to some ten million hot keys). The distinct keys that a group lets
through are held against the exact table first; those that are not hot, about two in a thousand million, are sent along
as exceptions. With them the filters decide every line exactly, and no line is ever shuffled.

Defined cases: null or empty text is one empty line; empty keys are never dropped unless min_chars is 0; a document
that loses all lines keeps the empty text; repeated rows count as documents of their own; extra columns are kept, but
those called n_lines, n_dropped and kept_text are replaced.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, give_back, materialise, pandas_map, small_batches, text_of

BLANK = b" \t\n\x0b\x0c\r"
SLOTS = 4
MAX_KICKS = 500
M64 = (1 << 64) - 1
#: Hot keys of a shard at most, when shards are chosen; stashed keys of a filter that is made anew.
SHARD_KEYS, CROWDED = 2_000_000, 64
#: Keys that a task remembers, so that it hashes them once.
REMEMBERED = 100_000


def line_key(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z lower-cased (bytes.lower changes ASCII letters only)."""
    return line.strip(BLANK).lower()


def key_hash(key: bytes) -> int:
    return xxhash.xxh3_128_intdigest(key)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; the second bucket is the first xor a hash of the fingerprint, so an
    entry can be moved or deleted without its key."""

    def __init__(self, capacity: int):
        self.n = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.85))))
        self.t = np.zeros((self.n, SLOTS), dtype=np.uint32)
        self.stash: list[tuple[int, int]] = []

    @staticmethod
    def finger(h1: int) -> int:
        return (h1 >> 32) or 1

    def other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & (self.n - 1)

    def places(self, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets."""
        fp = np.maximum(h1 >> np.uint64(32), 1)
        b = h1 & np.uint64(self.n - 1)
        c = (b ^ (fp * np.uint64(0x5BD1E995))) & np.uint64(self.n - 1)
        return fp.astype(np.uint32), b.astype(np.int64), c.astype(np.int64)

    def add(self, h1: int) -> None:
        fp, b = self.finger(h1), h1 & (self.n - 1)
        for x in (b, self.other(b, fp)):
            free = np.flatnonzero(self.t[x] == 0)
            if len(free):
                self.t[x, free[0]] = fp
                return
        for k in range(MAX_KICKS):
            s = (fp + k) % SLOTS
            fp, self.t[b, s] = int(self.t[b, s]), fp
            b = self.other(b, fp)
            free = np.flatnonzero(self.t[b] == 0)
            if len(free):
                self.t[b, free[0]] = fp
                return
        self.stash.append((b, fp))  # a full table never loses a key

    @classmethod
    def of(cls, h1: np.ndarray) -> CuckooFilter:
        """A filter of these keys: each goes to a free slot of either bucket, the few others are added one by one."""
        made = cls(len(h1))
        used = np.zeros(made.n, dtype=np.int64)
        fp, *both = made.places(h1)
        left = np.arange(len(h1))
        for bucket in both:
            order = left[np.argsort(bucket[left], kind="stable")]
            at = bucket[order]
            slot = used[at] + np.arange(len(at)) - np.searchsorted(at, at)
            fits = slot < SLOTS
            made.t[at[fits], slot[fits]] = fp[order[fits]]
            used += np.bincount(at[fits], minlength=made.n)
            left = order[~fits]
        for x in h1[left].tolist():
            made.add(x)
        return made

    def discard(self, h1: int) -> bool:
        fp, b = self.finger(h1), h1 & (self.n - 1)
        for x in (b, self.other(b, fp)):
            at = np.flatnonzero(self.t[x] == fp)
            if len(at):
                self.t[x, at[0]] = 0
                return True
            if (x, fp) in self.stash:
                self.stash.remove((x, fp))
                return True
        return False

    def may_hold(self, h1: np.ndarray) -> np.ndarray:
        fp, b, c = self.places(h1)
        f = fp[:, None]
        hit = (self.t[b] == f).any(axis=1) | (self.t[c] == f).any(axis=1)
        for x, y in self.stash:
            hit |= ((b == x) | (c == x)) & (fp == y)
        return hit

    def dump(self) -> bytes:
        return struct.pack("<QQ", self.n, len(self.stash)) + np.array(self.stash, dtype="<u8").tobytes() + self.t.astype("<u4").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.n, k = struct.unpack_from("<QQ", raw)
        made.stash = [tuple(x) for x in np.frombuffer(raw, "<u8", 2 * k, 16).reshape(-1, 2).tolist()]
        made.t = np.frombuffer(raw, "<u4", made.n * SLOTS, 16 + 16 * k).reshape(-1, SLOTS)
        return made


class ShardedFilter:
    """Some shards' filters; a key's shard is h2 mod n_shards, and keys of other shards are not held."""

    def __init__(self, n_shards: int, parts: dict[int, bytes]):
        self.n_shards, self.parts = n_shards, {k: CuckooFilter.load(raw) for k, raw in parts.items()}

    def may_hold(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        shard, out = (h2 % np.uint64(self.n_shards)).astype(np.int64), np.zeros(len(h1), dtype=bool)
        for k in np.unique(shard).tolist():
            if k in self.parts:
                at = shard == k
                out[at] = self.parts[k].may_hold(h1[at])
        return out


def _keys(text: str | None) -> list[bytes]:
    return [line_key(x) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def shard_of(n_shards: int):
    """h2 modulo the shards, taken as an unsigned number."""
    low, high = F.col("h2").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("h2", 32)
    return F.pmod(F.pmod(high, F.lit(n_shards)) * F.lit((1 << 32) % n_shards) + F.pmod(low, F.lit(n_shards)), F.lit(n_shards)).cast("int")


def _counts(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for text in pdf["text"]:
                seen.update({k for k in _keys(text) if len(k) >= min_chars and (min_chars <= 1 or len(k.decode("utf-8", "replace")) >= min_chars)})
            hashes = [key_hash(k) for k in seen]
            yield pd.DataFrame({"h1": [signed(h >> 64) for h in hashes], "h2": [signed(h & M64) for h in hashes], "refs": list(seen.values())}).astype("int64")

    return run


def reference_counts(docs: DataFrame, n_shards: int = 8, min_chars: int = 1) -> DataFrame:
    """shard, h1, h2, refs: for each line key the number of documents that hold it; added up before the shuffle."""
    part = docs.select("text").transform(pandas_map, _counts(min_chars), "h1 long, h2 long, refs long")
    return part.groupBy("h1", "h2").agg(F.sum("refs").alias("refs")).withColumn("shard", shard_of(n_shards))


def merge_counts(state: DataFrame, change: DataFrame, sign: int) -> DataFrame:
    """Exact counts after inserting (sign 1) or deleting (sign -1) the documents that `change` was counted from."""
    both = state.select("shard", "h1", "h2", "refs").unionByName(change.select("shard", "h1", "h2", (F.col("refs") * sign).alias("refs")))
    return both.groupBy("shard", "h1", "h2").agg(F.sum("refs").alias("refs")).filter("refs > 0")


def _hash_columns(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes = [key_hash(k) for k in keys]
    return tuple(np.fromiter(x, dtype=np.uint64, count=len(keys)) for x in ((h >> 64 for h in hashes), (h & M64 for h in hashes)))


@dataclass
class LineIndex:
    """refs: shard, h1, h2, refs of all keys; filters: shard, filter over the hot keys."""

    refs: DataFrame
    filters: DataFrame
    min_docs: int
    n_shards: int
    min_chars: int = 1

    def hot(self) -> DataFrame:
        return self.refs.filter(F.col("refs") >= self.min_docs).select("shard", "h1", "h2")


FILTERS = "shard int, filter binary, crowded boolean"


def _filter_row(shard: int, made: CuckooFilter) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "filter": [made.dump()], "crowded": [len(made.stash) > CROWDED]})


def build_filters(hot: DataFrame) -> DataFrame:
    """shard, filter: one task a shard."""
    build = lambda key, pdf: _filter_row(int(key[0]), CuckooFilter.of(pdf["h1"].to_numpy().view(np.uint64)))
    return materialise(hot.select("shard", "h1").groupBy("shard").applyInPandas(build, FILTERS), "line-filters").drop("crowded")


def new_index(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, n_shards: int | None = None) -> LineIndex:
    """Counts and filters of all documents. Without a given number, shards are chosen by the number of hot keys."""
    refs = materialise(reference_counts(docs, n_shards or 8, min_chars), "line-refs")
    if n_shards is None:
        n_shards = max(8, -(-refs.filter(F.col("refs") >= min_docs).count() // SHARD_KEYS))
        refs = refs.withColumn("shard", shard_of(n_shards))
    index = LineIndex(refs, None, min_docs, n_shards, min_chars)
    index.filters = build_filters(index.hot())
    return index


def _change(key, filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter without the cooled keys and with the newly hot ones."""
    h1, sign = keys["h1"].to_numpy().view(np.uint64), keys["sign"].to_numpy()
    if not len(filters):
        return _filter_row(int(key[0]), CuckooFilter.of(h1[sign > 0]))
    made = CuckooFilter.load(bytes(filters["filter"].iloc[0]))
    made.t = made.t.copy()
    for x in h1[sign < 0].tolist():
        made.discard(x)
    for x in h1[sign > 0].tolist():
        made.add(x)
    return _filter_row(int(key[0]), made)


def changed_index(index: LineIndex, docs: DataFrame, sign: int) -> LineIndex:
    """The index after inserting (sign 1) or deleting (sign -1) documents. Only shards with changed keys are touched;
    filters that became crowded are built anew from the exact table."""
    change = reference_counts(docs, index.n_shards, index.min_chars)
    refs = materialise(merge_counts(index.refs, change, sign), "line-refs")
    after = LineIndex(refs, None, index.min_docs, index.n_shards, index.min_chars)
    key = ["shard", "h1", "h2"]
    heated = after.hot().join(index.hot(), key, "left_anti").withColumn("sign", F.lit(1))
    cooled = index.hot().join(after.hot(), key, "left_anti").withColumn("sign", F.lit(-1))
    keys = heated.unionByName(cooled).select("shard", "h1", "sign")
    made = materialise(index.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(_change, FILTERS), "line-filters")
    whole, crowded = made.filter("NOT crowded").drop("crowded"), made.filter("crowded").select("shard")
    after.filters = whole.unionByName(build_filters(after.hot().join(crowded, "shard", "left_semi"))) if crowded.limit(1).count() else whole
    return after


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    return changed_index(index, docs, 1)


def delete_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    return changed_index(index, docs, -1)


def _let_through(n_shards: int, shared):
    """Distinct keys that the filters let through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters, seen = ShardedFilter(n_shards, shared.value), set()
        for pdf in batches:
            new = list({k for t in pdf["text"] for k in _keys(t)} - seen)
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(new)
            h1, h2 = _hash_columns(new)
            hit = filters.may_hold(h1, h2)
            yield pd.DataFrame({"h1": h1[hit].view(np.int64), "h2": h2[hit].view(np.int64)})

    return run


def _drop(n_shards: int, shared, exceptions):
    """Positions of the lines that go, with those that earlier groups of shards found."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        filters, wrong = ShardedFilter(n_shards, shared.value), exceptions.value
        verdicts: dict[bytes, bool] = {}
        for column, before in batches:
            texts = [x.encode("utf-8", "surrogatepass").split(b"\n") for x in column]
            keys = [[line_key(x) for x in lines] for lines in texts]
            if len(verdicts) > REMEMBERED:
                verdicts.clear()
            new = [k for k in {k for ks in keys for k in ks} if k not in verdicts]
            if new:
                h1, h2 = _hash_columns(new)
                verdicts.update((k, bool(m) and (a, b) not in wrong) for k, m, a, b in zip(new, filters.may_hold(h1, h2), h1.tolist(), h2.tolist()))
            gone = [sorted({p for p, k in enumerate(ks) if verdicts[k]}.union(was)) for ks, was in zip(keys, before)]
            kept = []
            for lines, out in zip(texts, gone):
                for p in reversed(out):
                    del lines[p]
                kept.append(b"\n".join(lines).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"gone": gone, "n_lines": [len(ks) for ks in keys], "n_dropped": [len(x) for x in gone], "kept_text": kept})
        give_back()

    return run


def drop_lines(docs: DataFrame, index: LineIndex, broadcast_keys: int = 6_000_000) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text, all lines gone whose key is hot in the index. The filters of at most
    broadcast_keys keys (of one shard at least) are broadcast at once."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    name = free_name(docs, "_lines")
    hot = index.hot()
    groups = max(1, min(index.n_shards, -(-hot.count() // max(1, broadcast_keys))))
    out, gone = docs, F.array().cast("array<int>")
    for g in range(groups):
        own = index.filters.filter(F.pmod("shard", F.lit(groups)) == g).collect()  # bounded by broadcast_keys
        shared = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in own})
        through = docs.select("text").transform(pandas_map, _let_through(index.n_shards, shared), "h1 long, h2 long").distinct()
        wrong = through.join(hot, ["h1", "h2"], "left_anti").collect() if own else []  # two in 10^9 of the distinct lines
        exceptions = spark.sparkContext.broadcast({(r["h1"] & M64, r["h2"] & M64) for r in wrong})
        drop = F.pandas_udf(_typed(_drop(index.n_shards, shared, exceptions)), "gone array<int>, n_lines long, n_dropped long, kept_text string")
        out = out.withColumn(name, drop(text_of("text"), gone))
        if g < groups - 1:
            out = materialise(out, "line-groups")  # so that tasks hold one group's filters
            gone = F.col(f"{name}.gone")
    return out.select(*docs.columns, *[f"{name}.{c}" for c in ("n_lines", "n_dropped", "kept_text")])


def _typed(f):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from f(batches)

    return run


def drop_repeated_lines(docs: DataFrame, state: DataFrame, min_docs: int = 10, n_shards: int = 8, broadcast_keys: int = 6_000_000) -> DataFrame:
    """drop_lines by a table of counts, whose filters are built first."""
    index = LineIndex(state, None, min_docs, n_shards)
    index.filters = build_filters(index.hot())
    return drop_lines(docs, index, broadcast_keys)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Count all documents, then drop by those counts."""
    return drop_lines(docs, new_index(docs, min_docs, min_chars))
