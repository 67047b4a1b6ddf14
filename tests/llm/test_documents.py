"""Operators over documents, against brute force on small tables and on the defined odd cases."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievemill.llm import components, line_dedup, ngram_join, packing, quality_fm, queries, sharding, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


# --- sharding


def check_shards(rows, got, n=8, slack=None):
    assert len(got) == len(rows)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert 0 <= s < n and slots == list(range(len(slots)))
    size = np.bincount([r["shard"] for r in got], [r["size"] for r in got], minlength=n) if got else np.zeros(n)
    if slack:
        assert size.max() - size.min() <= slack


def test_sharding_balances_and_keeps_groups(docs):
    rows = docs.collect()
    got = sharding.shard_documents(docs).collect()
    check_shards(rows, got, slack=max(len(r["text"].encode()) for r in rows) * 1.5)
    by_text = defaultdict(set)
    for r in got:
        by_text[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())


def test_sharding_cuts_a_group_larger_than_a_shard(spark):
    rows = [(i, "same text " * 5 if i % 2 else f"own {i} text", None, None, 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check_shards(df.collect(), sharding.shard_documents(df).collect(), slack=6000)


def test_sharding_balances_tokens_and_rows(spark):
    """Few long words in one half, many short ones in the other: bytes, tokens and rows are near equal in each shard."""
    rng = random.Random(2)
    texts = [" ".join("x" * 40 + str(rng.random()) for _ in range(20)) if i % 2 else "\n".join(f"{rng.randrange(99)}" for _ in range(rng.randrange(300))) for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shard = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df).collect()}
    sums = np.zeros((8, 3))
    for i, t in enumerate(texts):
        sums[shard[i]] += [len(t) + 1, len(t.split()), 1]
    assert ((sums.max(axis=0) - sums.min(axis=0)) / sums.mean(axis=0) < 0.05).all(), sums
    words = spark.createDataFrame([(t,) for t in ("", " \t\n", "a  b\x0bc\td", "é\u2003f")], "t string").select(sharding.word_count(sharding.F.col("t"))).collect()
    assert [r[0] for r in words] == [0, 0, 4, 1]


def test_sharding_cuts_rows_of_one_id(spark):
    """A group larger than a shard is cut even where all its rows are equal."""
    rows = [(1, "one and the same")] * 4000 + [(i, f"own {i}") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_shards(df.collect(), sharding.shard_documents(df).collect(), slack=6000)


def test_sharding_odd(odd_docs, no_docs):
    check_shards(odd_docs.collect(), sharding.shard_documents(odd_docs).collect())
    assert sharding.shard_documents(no_docs).collect() == []


# --- token counts


def test_token_counts(docs, odd_docs, no_docs):
    lib = Tokenizer.from_file(BYTES)
    for df in (docs, odd_docs):
        got = Counter(tuple(r) for r in token_counts.count_tokens(df, BYTES, public_tokenizers.PATTERN).collect())
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
            want[(r["doc_id"], len((r["text"] or "").encode()), n, n > 1024)] += 1
        assert got == want
    assert token_counts.count_tokens(no_docs, BYTES, public_tokenizers.PATTERN).collect() == []


def test_token_counts_of_random_strings():
    rng, lib = random.Random(3), Tokenizer.from_file(BYTES)
    texts = ["".join(rng.choice("ab aé\n\t 'sll!!==  0129ñ中😀\x1c​<|endoftext|>") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    texts += ["=" * 3000, " " * 3000, "ab" * 2000, "a" * 999, "<|endoftext|>" * 3]
    counter = token_counts.Counter(BYTES, public_tokenizers.PATTERN)
    assert [n for p in token_counts.pieces(texts, 5000) for n in counter.count(p)] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


# --- near duplicates


def brute_components(rows):
    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {}
    for doc, text in rows:
        sets.setdefault(doc, []).append(grams(text))
    items = [(d, s) for d, ss in sets.items() for s in ss]
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (_, s)), (b, (_, t)) in itertools.combinations(enumerate(items), 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            parent[find(a)] = find(b)
    lowest = {}
    for k, (d, s) in enumerate(items):
        if d is not None and s:
            lowest[find(k)] = min(lowest.get(find(k), d), d)
    return Counter((d, len(s), lowest.get(find(k), d) if s else d) for k, (d, s) in enumerate(items))


def test_near_duplicates(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        got = Counter(tuple(r) for r in ngram_join.near_duplicates(df).collect())
        assert got == brute_components([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert ngram_join.near_duplicates(no_docs).collect() == []


def test_coarse_ranges_change_nothing(docs):
    as_rows = lambda df: sorted(map(str, df.select("fp", "n", "size", "prefix", "h", "df").filter("fp IS NOT NULL").collect()))
    assert as_rows(ngram_join.jaccard_sets(docs, fan_out=8)) == as_rows(ngram_join.jaccard_sets(docs))


def test_near_duplicates_in_one_hot_group_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TASK_SETS", 20)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(130):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6, 9])):
            words[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_chained_group_is_not_paired_block_by_block(spark, monkeypatch):
    """A long chain of near copies and sets that share one very common hash: each set is sent only where it can meet."""
    monkeypatch.setattr(ngram_join, "TASK_SETS", 40)
    rng = random.Random(11)
    words = [f"c{i}" for i in range(2000)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(600)]  # neighbours overlap by 53 of 59 shingles
    rows += [(1000 + i, "all rights are reserved here " + " ".join(f"e{rng.randrange(10**6)}" for _ in range(3))) for i in range(300)]
    rows += [(2000 + i, "one short text for all of them" + f" z{i}" * (i % 2)) for i in range(60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    assert got == brute_components(rows)
    sent = []
    real = ngram_join.meetings
    monkeypatch.setattr(ngram_join, "meetings", lambda placed, sets: sent.append((placed.count(), real(placed, sets).count(), placed.select("block").distinct().count())) or real(placed, sets))
    ngram_join.near_duplicates(docs).count()
    n, copies, blocks = sent[0]
    assert n >= 600 and blocks >= 15 and copies < 0.6 * n * blocks, sent


def test_copies_and_common_hashes_are_dealt_evenly(spark, monkeypatch):
    """No group of a range holds the ids or sets of all copies, nor all postings of a very common hash."""
    monkeypatch.setattr(ngram_join, "HOT_SETS", 20)
    rng = random.Random(8)
    texts = ["one two three"] * 300 + [None] * 150 + [""] * 150 + ["all rights are reserved here " + " ".join(f"e{rng.randrange(10**6)}" for _ in range(6)) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)]
    batches = [pd.DataFrame({"doc_id": [str(i) for i, _ in rows], "text": [t for _, t in rows]})]
    seen = pd.concat(ngram_join._survey(5)(iter(batches)))
    often = seen[seen["h"].notna()]
    hot = (np.array(often["h"].tolist(), dtype=np.int64).view(np.uint64), np.array(often["times"].tolist(), dtype=np.int64))
    assert hot[1].tolist() == [400] and seen["n"].notna().sum() == 1000
    blobs = pd.concat(ngram_join._blobs(ngram_join.part_of(8, hot=hot), 5)(iter(batches)))
    assert set(blobs.columns) == {"part", "fp", "n", "cnt", "h"}
    copies = ngram_join.shingles("one two three").tobytes()
    assert b"".join(blobs["h"]).count(copies) == 1
    held = [sum(np.frombuffer(h, np.uint64).tolist().count(int(hot[0][0])) for h in g["h"]) for _, g in blobs.groupby("part")]
    assert sum(held) == 400 and max(held) < 100
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(ngram_join.survey(df)[1][0]) == 1
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(df).collect()) == brute_components(rows)


def test_trie_links_find_the_components():
    rng = np.random.default_rng(1)
    for _ in range(40):
        base = [np.sort(rng.choice(60, 30, replace=False)) for _ in range(3)]
        sets, n = [], []
        for _ in range(rng.integers(2, 30)):
            b = base[rng.integers(3)]
            s = np.unique(np.r_[b[rng.random(30) > rng.choice([0, 0.05, 0.1, 0.2])], rng.choice(60, rng.integers(0, 3))])
            sets.append(s), n.append(len(s) + rng.integers(0, 3))

        def roots(links, m=len(sets)):
            p = list(range(m))

            def find(x):
                while p[x] != x:
                    x = p[x]
                return x

            for a, b in links:
                p[find(a)] = find(b)
            return [[find(i) == find(j) for j in range(m)] for i in range(m)]

        want = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * (i := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (n[a] + n[b] - i)]
        assert roots(ngram_join.trie_links(sets, np.array(n), 80, cells=60 * 7)) == roots(want)


def test_keep_one_either_way(docs):
    want = sorted(r["doc_id"] for r in ngram_join.near_duplicates(docs).filter("doc_id = component_id").collect())
    for most in (0, 10**6):
        kept = ngram_join.keep_one(docs, broadcast_ids=most)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want


def test_components(spark):
    rng = random.Random(2)
    for edges in ([], [(i, i + 1) for i in range(40)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]):
        name = {v: rng.randrange(10**9) for e in edges for v in e}
        edges = [(name[a], name[b]) for a, b in edges]
        parent = {v: v for a, b in edges if a != b for v in (a, b)}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        got = {r["v"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {v: find(v) for v in parent}


# --- line dedup


def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    cut = [(d, (t or "").split("\n")) for d, t in rows]
    docs = Counter(k for _, lines in cut for k in {key(x) for x in lines} if k)
    out = Counter()
    for d, lines in cut:
        kept = [x for x in lines if docs[key(x)] < least]
        out[(d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("broadcast_keys", [0, 10**6])
def test_line_dedup(spark, docs, odd_docs, no_docs, broadcast_keys):
    for df, least in ((docs, 3), (odd_docs, 2)):
        state = line_dedup.reference_counts(df)
        kept = line_dedup.drop_repeated_lines(df, state, least, broadcast_keys=broadcast_keys)
        got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in kept.collect())
        assert got == brute_lines([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], least)
    assert line_dedup.dedup_lines(no_docs).collect() == []


def test_line_counts_are_reversible(docs):
    first, second = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    state = line_dedup.reference_counts(first)
    both = line_dedup.merge_counts(state, line_dedup.reference_counts(second), 1)
    as_set = lambda df: {tuple(r) for r in df.select("shard", "h1", "h2", "refs").collect()}
    assert as_set(both) == as_set(line_dedup.reference_counts(docs))
    assert as_set(line_dedup.merge_counts(both, line_dedup.reference_counts(second), -1)) == as_set(state)


def test_cuckoo_filter_insert_and_delete():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    f = line_dedup.CuckooFilter(len(keys))
    for k in keys.tolist():
        f.add(k)
    assert f.may_hold(keys).all()
    assert f.may_hold(rng.integers(0, 2**64, 20000, dtype=np.uint64)).mean() < 0.001
    for k in keys[:2500].tolist():
        assert f.discard(k)
    assert f.may_hold(keys[2500:]).all() and f.may_hold(keys[:2500]).mean() < 0.001


def test_filters_follow_insertions_and_deletions(docs):
    """Filters and output after inserting and deleting documents are those of never having had them."""
    first, second = docs.filter("doc_id % 3 > 0"), docs.filter("doc_id % 3 = 0")
    held = lambda index: {(r["shard"], x) for r in index.filters.collect() for x in _entries(line_dedup.CuckooFilter.load(bytes(r["filter"])))}
    kept = lambda index: Counter(tuple(r) for r in line_dedup.drop_lines(first, index).select("doc_id", "n_dropped", "kept_text").collect())
    start = line_dedup.new_index(first, 3)
    more = line_dedup.insert_documents(start, second)
    back = line_dedup.delete_documents(more, second)
    all_docs = line_dedup.new_index(docs, 3)
    assert len(held(more)) > len(held(start)) and held(back) == held(start)
    assert kept(more) == kept(all_docs) != kept(start) == kept(back)


def _entries(f):
    for b, s in zip(*np.nonzero(f.t)):
        yield int(f.t[b, s])
    yield from (fp for _, fp in f.stash)


def test_filters_of_many_keys():
    """More keys than one broadcast group used to hold; a full filter keeps what it cannot place."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 1_200_000, dtype=np.uint64))
    f = line_dedup.CuckooFilter.load(line_dedup.CuckooFilter.of(keys).dump())
    assert f.may_hold(keys).all() and not f.may_hold(rng.integers(0, 2**64, 200_000, dtype=np.uint64)).any()
    small = line_dedup.CuckooFilter(8)
    for k in keys[:60].tolist():
        small.add(k)
    again = line_dedup.CuckooFilter.load(small.dump())
    assert again.stash and again.may_hold(keys[:60]).all()


def test_exceptions_settle_what_filters_let_through(spark):
    """A filter with strangers in it lets their lines through; the exact table keeps them."""
    rows = [(i, f"shared line\nown line {i}\nother {i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = line_dedup.new_index(df, 10)
    index.filters = line_dedup.build_filters(index.refs)  # of all keys, hot or not
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.drop_lines(df, index).collect()}
    assert got == {i: f"own line {i}\nother {i % 7}" for i in range(60)}


# --- packing


def check_packing(rows, got):
    lib = Tokenizer.from_file(WORDS)
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append(lib.encode(t or "", add_special_tokens=False).ids + [1])
    pieces = Counter()
    for r in got:
        fits = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
        assert fits and 0 < r["length"] <= 2048
        pieces[r["doc_id"]] += r["length"]
    assert pieces == Counter({d: sum(map(len, x)) for d, x in ids.items()})
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0, "a sequence without padding has a power of two of ids"


def test_packing(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        check_packing([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], packing.pack_documents(df, WORDS).collect())
    assert packing.pack_documents(no_docs, WORDS).collect() == []


def test_word_ids_of_random_strings():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab aé\n\t 'sll!!.., ,0129ñ中😀\x1ćİΣß") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["A<|endoftext|>B İSTANBUL ΣΑΣ é é ́x <|startoftext|>", "Don't, WE'LL. it's"]
    w = packing.WordIds(WORDS)
    got = [x.tolist() for p in token_counts.pieces(texts, 3000) for x in w.encode(p, 1)]
    assert got == [e.ids + [1] for e in w.lib.encode_batch(texts, add_special_tokens=False)]


def test_special_strings_keep_their_case():
    texts = ["a <|EndOfText|> B", "<|ENDOFTEXT|><|endoftext|> Mixed", "One<|StartOfText|>Two É", "plain <|endoftext|>X"]
    w = packing.WordIds(WORDS)
    assert [x.tolist() for x in w.encode(texts, 1)] == [e.ids + [1] for e in w.lib.encode_batch(texts, add_special_tokens=False)]


def test_step_groups_are_equal(docs):
    got = packing.pack_documents(docs, WORDS).filter("step_group >= 0").groupBy("step_group", "sequence_id").sum("length").collect()
    total = defaultdict(int)
    for r in got:
        total[r["step_group"]] += r["sum(length)"]
    assert max(total.values()) <= packing.STEP_TOKENS


# --- quality classifier


def test_quality_on_held_out_rows(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    scored = queries.op8_factorisation_machine(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert scored.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    assert len(rows) > 40 and np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_machine_sums_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    size = (1 << quality_fm.BITS) + quality_fm.STATS
    m = quality_fm.Machine(0.3, rng.normal(size=size).astype(np.float32), rng.normal(0, 0.1, (quality_fm.FACTORS, size)).astype(np.float32), np.zeros(quality_fm.STATS, np.float32), np.ones(quality_fm.STATS, np.float32))
    rows = quality_fm.Rows([quality_fm.features("a b c a d")], m.mean, m.scale)
    x, at = rows.value.astype(float), rows.index
    pairs = sum(float(m.v[:, at[i]] @ m.v[:, at[j]]) * x[i] * x[j] for i, j in itertools.combinations(range(len(x)), 2))
    assert abs(m.margin(rows)[0] - (0.3 + m.w[at] @ x + pairs)) < 1e-3


def test_repeated_ids_are_learnt_once(spark):
    docs = spark.createDataFrame([(1, f"good text {i}") for i in range(500)] + [(i, f"bad text {i}") for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 30)], "doc_id long, quality int")
    seen = []
    real, quality_fm._fit = quality_fm._fit, lambda batches: iter([pd.DataFrame({"model": [str(sum(map(len, batches))).encode()]})])
    try:
        quality_fm.Machine.unpack, kept = staticmethod(seen.append), quality_fm.Machine.unpack
        quality_fm.fit_quality(docs, labels)
    finally:
        quality_fm._fit, quality_fm.Machine.unpack = real, kept
    assert int(seen[0]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1, 30))


def test_quality_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 1), (None, 0), (4, None)], "doc_id long, quality int")
    machine = quality_fm.fit_quality(odd_docs, labels)
    assert quality_fm.score_quality(odd_docs, machine).count() == odd_docs.count()
    assert quality_fm.score_quality(no_docs, machine).collect() == []
    assert quality_fm.fit_quality(odd_docs, labels.limit(0)) is None
    assert {r["score"] for r in quality_fm.score_quality(odd_docs, None).collect()} == {0.5}
    assert quality_fm.keep_good(odd_docs, None).columns == odd_docs.columns
