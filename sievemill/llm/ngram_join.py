"""N-gram Jaccard join by prefix trees, exact, and the near-duplicate components that its links make.

1. One pass over the texts writes each document's fingerprint and number of shingles as a plain table, and the hashes
   that very many sets hold. A second pass sends the sets of shingle hashes out in packed blobs, one hash range a task.
   Equal sets have one fingerprint: a task sends one of them only, and the ranges drop those of other tasks. Very common
   hashes are dealt by hash and fingerprint, over all ranges.
2. Each range counts, for every hash, the sets that hold it, and sends on only hashes held by two sets or more: the
   others can be in no intersection, so for them the number alone matters. Very common hashes have the number of the
   first pass, a lower bound; any order that is the same for all sets keeps the join exact.
3. In the global order (rarest first, then by hash) two sets of the needed similarity share a hash of their prefixes.
   Most sets have a prefix of unshared hashes and are done. The others meet in groups: those connected by shared
   prefix hashes.
4. In a group, the ordered sets are stored in a trie. All sets traverse it together, sharing the partial overlaps of
   common paths, and leave a subtree once the overlap and the remaining lengths cannot reach what is needed, or once
   leaf and set are connected already.
5. Large groups are cut into blocks of sets of like length and, so far as it goes, the same rarest prefix hash. Each
   block has its trie first. Then a set is sent on only to those blocks that hold one of its prefix hashes in a set of
   like length which is not connected with it yet, so what is copied follows the hashes that sets really share.
6. The links of each task (a spanning forest of them) are joined to components.

A set is known by a fingerprint of 128 bits, a shingle by a hash of 64 bits: within two sets of a million shingles each
the chance of an accidental common one is one in ten million. Documents and links never pass through the driver.

Defined cases: null texts and texts without words have an empty set and link with nothing; texts of fewer than five
words have one shingle, the whole sequence; rows that share a doc_id are one vertex each and report that id; null ids
never become a component's id unless it has no other; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, pandas_map
from .components import connected

N_WORDS = 5
#: Hashes that a task gathers before it sends blobs; elements and sets of one trie task.
FLUSH = 1_000_000
TASK_ELEMENTS, TASK_SETS = 1_000_000, 800
#: A hash is very common if so many sets of a flush hold it, one in so many of them, and a quarter of a range's worth in all.
HOT_SETS, HOT_SHARE = 64, 128
#: Fingerprints that a task remembers, so that it sends equal sets once.
REMEMBERED = 1_000_000
#: Rows of ids and small numbers that are broadcast at most.
BROADCAST_ROWS = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Hash ranges at least.
LEAST_RANGES = 12
#: Hashes of a range: 24 MB and about as much again of fingerprints.
RANGE_HASHES = 3_000_000


def shingles(text: str | None, n_words: int = N_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; bytes.lower and bytes.split take A-Z and [\\x20\\x09-\\x0D] only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(n_words, len(h))
    if not width:
        return h
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = (out ^ h[j : len(h) - width + 1 + j]) * MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def needed(a, b, percent: int):
    """Smallest intersection i with 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


BLOB = ["part", "fp", "n", "cnt", "h"]
Key = Callable[[np.ndarray, np.ndarray], np.ndarray]
Hot = tuple[np.ndarray, np.ndarray]
NO_HOT: Hot = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def fingerprint(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def as_pairs(raw: bytes) -> np.ndarray:
    """Fingerprints as rows of two numbers."""
    return np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2)


def _distinct(batches: Iterator[pd.DataFrame], n_words: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray], list[bytes], list[bool]]]:
    """Each batch with its documents' sets, their fingerprints, and whether the task meets the set for the first time."""
    seen: set[bytes] = set()
    for pdf in batches:
        sets = [shingles(t, n_words) for t in pdf["text"]]
        fps, new = [fingerprint(h) for h in sets], []
        for h, fp in zip(sets, fps):
            new.append(len(h) > 0 and fp not in seen)
            if new[-1]:
                seen.add(fp)
        if len(seen) > REMEMBERED:
            seen.clear()
        yield pdf, sets, fps, new


def _survey(n_words: int):
    """(doc_id, fp, n, null, null) of each document; (null, null, null, h, times) of hashes that many sets of a flush hold."""

    def common(held: list[np.ndarray]) -> pd.DataFrame:
        h, times = np.unique(np.concatenate(held), return_counts=True)
        many = times >= max(HOT_SETS, len(held) // HOT_SHARE)
        return pd.DataFrame({"doc_id": None, "fp": None, "n": pd.array([None] * many.sum(), dtype="Int64"), "h": h[many].view(np.int64), "times": times[many]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf, sets, fps, new in _distinct(batches, n_words):
            none = pd.array([None] * len(pdf), dtype="Int64")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps, "n": [len(h) for h in sets], "h": none, "times": none})
            for h, is_new in zip(sets, new):
                if is_new:
                    held.append(h)
                    size += len(h) + 50
                    if size >= FLUSH:
                        yield common(held)
                        held, size = [], 0
        if held:
            yield common(held)

    return run


def _deal(sets: list[tuple], key: Key) -> pd.DataFrame:
    """Packed rows by key. sets: arrays (fp, n, cnt, h), cnt hashes of h for each fp."""
    fp, n, cnt, h = (np.concatenate([x[k] for x in sets]) for k in range(4))
    of = np.repeat(np.arange(len(fp), dtype=np.int32), cnt)
    part = key(h, fp[:, 0][of])
    low = part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part  # sets are in order, so this sort by radix is enough
    order = np.argsort(low, kind="stable")
    h, of, part = h[order], of[order], part[order]
    rows = []
    for p in np.unique(part).tolist():
        s = slice(*np.searchsorted(part, [p, p + 1]))
        who, count = np.unique(of[s], return_counts=True)
        rows.append((p, fp[who].tobytes(), n[who].astype(np.int32).tobytes(), count.astype(np.int32).tobytes(), h[s].tobytes()))
    return pd.DataFrame(rows, columns=BLOB)


def _blobs(key: Key, n_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, size = [], 0
        for _, found, fps, new in _distinct(batches, n_words):
            for h, fp, is_new in zip(found, fps, new):
                if not is_new:
                    continue
                n = np.array([len(h)], dtype=np.int32)
                sets.append((as_pairs(fp), n, n, h))
                size += len(h) + 50
                if size >= FLUSH:
                    yield _deal(sets, key)
                    sets, size = [], 0
        if sets:
            yield _deal(sets, key)

    return run


def _finer(key: Key):
    """Deals packed rows out again by a finer key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, size = [], 0
        for pdf in batches:
            for fp, n, cnt, h in zip(*(pdf[c] for c in BLOB[1:])):
                sets.append((as_pairs(fp), np.frombuffer(n, np.int32), np.frombuffer(cnt, np.int32), np.frombuffer(h, np.uint64)))
                size += len(h) // 8
                if size >= FLUSH:
                    yield _deal(sets, key)
                    sets, size = [], 0
        if sets:
            yield _deal(sets, key)

    return run


def _times(h: np.ndarray, hot: Hot) -> np.ndarray:
    """How often the very common ones among the hashes were met; 0 for the others."""
    if not len(hot[0]):
        return np.zeros(len(h), dtype=np.int64)
    at = np.minimum(np.searchsorted(hot[0], h), len(hot[0]) - 1)
    return np.where(hot[0][at] == h, hot[1][at], 0)


def part_of(parts: int, coarse: int | None = None, hot: Hot = NO_HOT) -> Key:
    def key(h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        p = (h % np.uint64(parts)).astype(np.int64)
        salted = np.flatnonzero(_times(h, hot))
        p[salted] = ((h[salted] ^ fp[salted]) * MIX >> np.uint64(32)) % np.uint64(parts)
        return p % coarse if coarse else p

    return key


def _read(pdf: pd.DataFrame, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[column].dropna()), dtype=kind)


def _whole(f: Callable[[pd.DataFrame], pd.DataFrame]):
    """f over all rows of a task at once: a task has one range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            yield f(pd.concat(held))

    return run


def _by_set(parts: int, fp: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """Postings packed by the range of their set's fingerprint."""
    to = (fp[:, 0] % np.uint64(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    to, columns = to[order], [x[order] for x in (fp, *columns)]
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
    cut = [*first.tolist(), len(to)]
    rows = [(int(to[a]), *(x[a:b].tobytes() for x in columns)) for a, b in zip(cut, cut[1:])]
    return pd.DataFrame(rows, columns=["part", "fp", "n", "h", "df"])


def _postings(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    return as_pairs(b"".join(pdf["fp"])), *(_read(pdf, c, k) for c, k in (("n", np.int32), ("h", np.uint64), ("df", np.int32)))


def _shared(parts: int, hot: Hot = NO_HOT):
    """Hashes of one range that two sets or more hold, with that number, dealt out again by fingerprint."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cnt = _read(pdf, "cnt", np.int32)
        of = np.repeat(np.arange(len(cnt), dtype=np.int32), cnt)
        h, fps, sizes = _read(pdf, "h", np.uint64), as_pairs(b"".join(pdf["fp"])), _read(pdf, "n", np.int32)
        order = np.argsort(h, kind="stable")
        s = h[order]
        twice = np.zeros(len(s), dtype=bool)
        twice[1:] = s[1:] == s[:-1]
        twice[:-1] |= twice[1:]
        twice |= _times(s, hot) > 0
        order = order[twice]
        h, of = h[order], of[order]
        fp, n = fps[of], sizes[of]
        order = np.lexsort((fp[:, 1], fp[:, 0], h))
        h, fp, n = h[order], fp[order], n[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (fp[1:] != fp[:-1]).any(axis=1)][: len(h)]
        h, fp, n = h[new], fp[new], n[new]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        size = np.diff(np.r_[start, len(h)])
        df = np.repeat(size, size)
        often = _times(h, hot)
        df = np.where(often > 0, often, df)
        keep = df > 1
        return _by_set(parts, fp[keep], n[keep], h[keep], np.minimum(df[keep], 2**31 - 1).astype(np.int32))

    return run


def _finer_sets(parts: int):
    """Deals packed postings out again by a finer range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield _by_set(parts, *_postings(pdf))

    return run


def _assemble(percent: int):
    """Sets whose prefix reaches into their shared hashes, in global order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, n, h, df = _postings(pdf)
        order = np.lexsort((h, df, fp[:, 1], fp[:, 0]))
        fp, n, h, df = fp[order], n[order], h[order], df[order]
        new = np.r_[True, (fp[1:] != fp[:-1]).any(axis=1)][: len(fp)]
        start = np.flatnonzero(new)
        second = new & np.r_[False, fp[1:, 0] == fp[:-1, 0]][: len(fp)]  # of two sets whose first halves agree; one range has both
        name = np.where(second, fp[:, 0] ^ (fp[:, 1] * MIX), fp[:, 0])
        rows = []
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(fp)]):
            size, shared = int(n[a]), b - a
            prefix = size - -(-percent * size // 100) + 1 - (size - shared)
            if prefix > 0:
                rows.append((int(name[a].view(np.int64)), fp[a].tobytes(), size, shared, h[a : a + prefix].view(np.int64), h[a:b].tobytes(), df[a:b].tobytes()))
        return pd.DataFrame(rows, columns=["fp", "key", "n", "size", "prefix", "h", "df"])

    return run


def trie_links(sets: list[np.ndarray], n: np.ndarray, percent: int, stored: np.ndarray | None = None, cells: int = 64 << 20, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of ranks, each in rising order; n: full sizes, with unshared hashes.
    stored: if given, only pairs of one stored and one other set are of interest; joined: labels of sets that are
    connected already."""
    m = len(sets)
    order = sorted(range(m), key=lambda i: sets[i].astype(">u4").tobytes())
    sets, n, back = [sets[i] for i in order], np.asarray(n, dtype=np.int64)[order], np.array(order)
    side = None if stored is None else np.asarray(stored)[order]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    common = np.zeros(max(0, m - 1), dtype=np.int64)  # length of the path that neighbours share
    for i in range(m - 1):
        k = min(size[i], size[i + 1])
        differ = sets[i][:k] != sets[i + 1][:k]
        common[i] = int(differ.argmax()) if differ.any() else k
    label, links = np.arange(m) if joined is None else np.asarray(joined)[order].copy(), []
    width = int(max((s[-1] for s in sets if len(s)), default=-1)) + 1
    step = max(1, cells // max(1, width))
    for first in range(0, m, step):
        probes = np.arange(first, min(m, first + step))
        held = np.zeros((width, len(probes)), dtype=np.uint8)  # which ranks each probe holds
        for c, p in enumerate(probes.tolist()):
            held[sets[p], c] = 1
        stack = [(0, m, 0, np.arange(len(probes)), np.zeros(len(probes), dtype=np.int64))]
        while stack:
            lo, hi, depth, live, got = stack.pop()
            leaf = hi - lo == 1
            ok = probes[live] > lo  # each pair once
            if leaf:
                ok &= label[probes[live]] != label[lo]
                if side is not None:
                    ok &= side[probes[live]] != side[lo]
            live, got = live[ok], got[ok]
            if not len(live):
                continue
            end = int(size[lo]) if leaf else int(common[lo : hi - 1].min())
            if end > depth:
                got = got + held[sets[lo][depth:end][:, None], live[None, :]].sum(axis=0, dtype=np.int64)
            left = np.minimum(int(size[lo:hi].max()) - end, size[probes[live]] - got)
            ok = got + left >= needed(n[probes[live]], int(n[lo:hi].min()), percent)
            live, got = live[ok], got[ok]
            if not len(live):
                continue
            if leaf:
                for p in probes[live].tolist():
                    if label[p] != label[lo]:
                        links.append((int(back[lo]), int(back[p])))
                        label[label == label[p]] = label[lo]
                continue
            cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo : hi - 1] == end)).tolist(), hi]
            for a, b in zip(cuts, cuts[1:]):
                stack.append((a, b, end, live, got))
    return links


def _group_links(own: pd.DataFrame, percent: int, stored: np.ndarray | None = None) -> list[tuple[int, int]]:
    fp = own["fp"].tolist()
    h = [np.frombuffer(x, dtype=np.uint64) for x in own["h"]]
    df = [np.frombuffer(x, dtype=np.int32) for x in own["df"]]
    alike, at = np.unique(np.concatenate(h), return_inverse=True)
    count = np.zeros(len(alike), dtype=np.int64)
    count[at] = np.concatenate(df)
    rank = np.empty(len(alike), dtype=np.int64)
    rank[np.lexsort((alike, count))] = np.arange(len(alike))
    ranks = np.split(rank[at], np.cumsum([len(x) for x in h])[:-1])
    joined = pd.factorize(own["comp"])[0] if "comp" in own else None
    return [(fp[a], fp[b]) for a, b in trie_links(ranks, own["n"].to_numpy(), percent, stored, joined=joined)]


def _links(percent: int):
    """Links of whole groups, several a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([x for _, own in pdf.groupby("root", sort=True) for x in _group_links(own, percent)], columns=["a", "b"])

    return run


def _block_links(percent: int):
    """Links of one block, or between two."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = pdf["block"].to_numpy()
        stored = blocks == blocks.min() if len(set(blocks)) > 1 else None
        return pd.DataFrame(_group_links(pdf, percent, stored), columns=["a", "b"])

    return run


def ranges(hashes: int) -> int:
    """Hash ranges, so that each fits a task."""
    return max(LEAST_RANGES, -(-hashes // RANGE_HASHES))


def survey(docs: DataFrame, n_words: int = N_WORDS) -> tuple[DataFrame, Hot, int]:
    """The written table (doc_id as a string, fp, n) of all documents, the very common hashes with their counts, and the
    number of all hashes. Of very common ones there are at most four a range, as their postings would fill a quarter."""
    rows = docs.select(F.col("doc_id").cast("string"), "text").transform(pandas_map, _survey(n_words), "doc_id string, fp binary, n long, h long, times long")
    found = materialise(rows, "ngram-documents")
    documents = found.filter(F.col("n").isNotNull()).select("doc_id", "fp", "n")
    total = documents.agg(F.sum("n")).first()[0] or 0
    often = found.filter(F.col("h").isNotNull()).groupBy("h").agg(F.sum("times").alias("times"))
    often = sorted((r["h"] % (1 << 64), r["times"]) for r in often.filter(F.col("times") >= total // (4 * ranges(total))).collect())
    return documents, (np.array([h for h, _ in often], dtype=np.uint64), np.array([t for _, t in often], dtype=np.int64)), total


def jaccard_sets(docs: DataFrame, percent: int = 80, n_words: int = N_WORDS, fan_out: int = 1024, hot: Hot = NO_HOT, hashes: int = 0) -> DataFrame:
    """The written table of distinct sets that may have a link: fp, n, size, prefix, h, df. hot and hashes: what survey
    found.

    With more hash ranges than fan_out, hashes are dealt to coarse ranges first and from there to the fine ones, so
    that packed rows stay large however large the corpus."""
    parts = ranges(hashes)
    coarse = math.isqrt(parts) + 1 if parts > fan_out else None
    packed, posted = "part int, fp binary, n binary, cnt binary, h binary", "part int, fp binary, n binary, h binary, df binary"
    blobs = docs.select("text").transform(pandas_map, _blobs(part_of(parts, coarse, hot), n_words), packed)
    if coarse:
        blobs = blobs.repartitionById(coarse, "part").transform(pandas_map, _finer(part_of(parts, hot=hot)), packed)
    shared = blobs.repartitionById(parts, "part").transform(pandas_map, _whole(_shared(coarse or parts, hot)), posted)
    if coarse:
        shared = shared.repartitionById(coarse, "part").transform(pandas_map, _finer_sets(parts), posted)
    sets = shared.repartitionById(parts, "part").transform(pandas_map, _whole(_assemble(percent)), "fp long, key binary, n long, size long, prefix array<long>, h binary, df binary")
    return materialise(sets, "ngram-sets")  # fp: the first half of the fingerprint, a number as a name; key: all of it


LINKS = "a long, b long"


def set_links(sets: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b): fingerprints of linked sets, enough of them to connect whatever all links connect."""
    postings = sets.select("fp", F.explode("prefix").alias("token"))
    centre = postings.groupBy("token").agg(F.min("fp").alias("c"), F.max("fp").alias("d")).filter("c < d").select("token", "c")
    meet = postings.join(centre, "token").filter("fp <> c").select(F.col("fp").alias("a"), F.col("c").alias("b")).distinct()
    groups = connected(meet, "ngram-groups")
    member = sets.join(groups.withColumnRenamed("v", "fp"), "fp")
    member = materialise(member.select("fp", "root", "n", "size", F.col("prefix")[0].alias("first"), "h", "df"), "ngram-members")
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("w")).withColumn("blocks", block_count())
    sizes = materialise(sizes, "ngram-sizes")
    about = sizes.agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.max("blocks").alias("blocks")).first()
    total, few = about["w"] or 0, about["n"] <= BROADCAST_ROWS
    sizes = sizes.select("root", "blocks")
    placed = member.join(F.broadcast(sizes) if few else sizes, "root")  # with few groups the members stay where they are
    spread = int(max(12, total // (TASK_ELEMENTS // 4)))
    small = placed.filter("blocks = 1").withColumn("task", F.pmod(F.xxhash64("root"), F.lit(spread)))
    links = small.select("task", "root", "fp", "n", "h", "df").groupBy("task").applyInPandas(_links(percent), LINKS)
    if (about["blocks"] or 1) > 1:
        links = links.unionByName(large_links(placed.filter("blocks > 1"), sets, percent))
    links = materialise(links, "ngram-links")
    discard(member, groups)
    return links


def block_count():
    """Blocks that m sets of w elements are cut into."""
    return F.ceil(F.greatest(F.col("w") / TASK_ELEMENTS, F.col("m") / TASK_SETS)).cast("int")


def in_blocks(large: DataFrame, percent: int) -> DataFrame:
    """large with the band of each set's length and its block: sets of one band whose first prefix hashes fall together,
    parted further by fingerprint where these are too many. Linked sets lie in the same band or neighbouring ones."""
    cell = ["root", "band", "cell"]
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) + 1e-9)).cast("int")
    large = large.withColumn("band", band).withColumn("cell", F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int")).drop("blocks")
    counts = large.groupBy(cell).agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("w")).select(*cell, block_count().alias("pieces"))
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces"))
    return large.join(counts, cell).withColumn("block", F.concat_ws("-", F.hex("root"), "band", "cell", piece)).drop("cell", "pieces", "first")


def meetings(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, other): the other blocks that hold one of the set's prefix hashes in a set of a neighbouring band which is not
    in its component. placed: fp, band, block, comp."""
    tokens = placed.join(sets.select("fp", "prefix"), "fp").select("fp", "band", "block", "comp", F.explode("prefix").alias("token"))
    cells = tokens.groupBy("token", F.col("band").alias("at"), F.col("block").alias("other")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    near = (F.col("block") != F.col("other")) & (F.abs(F.col("band") - F.col("at")) <= 1) & ((F.col("lo") != F.col("comp")) | (F.col("hi") != F.col("comp")))
    return tokens.join(cells, "token").filter(near).select("fp", "other").distinct()


def large_links(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within blocks first, then those between blocks that join what is not connected yet."""
    placed = materialise(in_blocks(large, percent), "ngram-blocks")
    inside = materialise(placed.groupBy("block").applyInPandas(_block_links(percent), LINKS), "ngram-inside")
    comps = connected(inside, "ngram-inside")
    light = placed.select("fp", "band", "block").join(comps.select(F.col("v").alias("fp"), F.col("root").alias("comp")), "fp", "left")
    light = materialise(light.withColumn("comp", F.coalesce("comp", "fp")), "ngram-light")
    sent = materialise(meetings(light, sets), "ngram-meetings")
    pairs = placed.drop("band").join(light.select("fp", "comp"), "fp").join(sent, "fp")
    pairs = pairs.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "root")
    return inside.unionByName(pairs.groupBy("i", "j").applyInPandas(_block_links(percent), LINKS))


def near_duplicates(docs: DataFrame, percent: int = 80, n_words: int = N_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    documents, hot, hashes = survey(docs, n_words)
    sets = jaccard_sets(docs, percent, n_words, hot=hot, hashes=hashes)
    links = set_links(sets, percent)
    roots = connected(links, "ngram-components")
    classes = materialise(roots.withColumnRenamed("v", "fp").join(sets.select("fp", "key"), "fp").select("key", "root"), "ngram-classes")
    discard(sets, links, roots)
    about = documents.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("fp").alias("key"), F.col("n").alias("n_shingles"))
    empty = about.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    named = about.filter("n_shingles > 0").join(classes, "key", "left").withColumn("class", F.coalesce(F.col("root").cast("string"), F.hex("key")))
    lowest = named.groupBy("class").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    lowest = materialise(lowest, "ngram-lowest")  # a table of its own, so that Spark can split a class of very many documents in the join
    return named.join(lowest, "class", "left").select("doc_id", "n_shingles", F.coalesce("lowest", "doc_id").alias("component_id")).unionByName(empty)


def keep_one(docs: DataFrame, percent: int = 80, n_words: int = N_WORDS, broadcast_ids: int = BROADCAST_ROWS) -> DataFrame:
    """docs without those whose component has a smaller doc_id; unchanged otherwise. The ids to drop are broadcast
    only while they are few; beyond that both sides are shuffled by id."""
    gone = near_duplicates(docs, percent, n_words).filter("component_id < doc_id").select("doc_id").distinct()
    gone = materialise(gone, "near-duplicates")
    return docs.join(F.broadcast(gone) if gone.count() <= broadcast_ids else gone, "doc_id", "left_anti").select(docs.columns)
