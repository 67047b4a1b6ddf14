"""Token counts by rank-synchronous array merging of byte-level BPE.

A text is cut into pre-tokens by the tokenizer's pattern. The distinct pre-tokens of a bounded piece of work are laid
out as one ragged array of symbol ids, and in each round every sequence merges its lowest-rank pair, all sequences at
once, until none has a pair left; the surviving symbols are the tokens. Equal pairs of one sequence are merged in the
same round only where no pair with the new symbol ranks lower, as then the order cannot matter.

Special strings inside a text are one token each, as the tokenizers library takes them by default. Defined cases:
null text is empty (0 tokens); repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_map, text_of

#: Characters of text that are in work at once, and pre-tokens whose counts a worker remembers.
PIECE_CHARS = 1_000_000
REMEMBERED = 800_000
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + moved.index(b)) for b in range(256)]


class RankMerger:
    """Merge ranks as sorted arrays, and the rounds over ragged arrays."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        a = np.array([vocab[x] for x, _ in pairs], dtype=np.int64)
        b = np.array([vocab[y] for _, y in pairs], dtype=np.int64)
        new = np.array([vocab[x + y] for x, y in pairs], dtype=np.int64)
        order = np.argsort(a << 32 | b, kind="stable")
        self.keys, self.rank, self.new = (a << 32 | b)[order], order.astype(np.int64), new[order]
        lowest = np.full(max(vocab.values()) + 1, NONE)
        np.minimum.at(lowest, a, np.arange(len(a)))
        np.minimum.at(lowest, b, np.arange(len(a)))
        self.by_rank = new
        self.together = lowest[new] > np.arange(len(a))
        self.start = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int64)

    def ranks(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rank of each symbol with the one after it; NONE at sequence ends and for pairs without a merge."""
        out = np.full(len(flat), NONE)
        if len(flat) > 1:
            key = flat[:-1] << 32 | flat[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[:-1][hit] = self.rank[at[hit]]
            out[first[1:] - 1] = NONE
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        total = size.copy()
        who = np.flatnonzero(size > 1)
        flat = self.start[np.frombuffer(b"".join(words[i] for i in who), dtype=np.uint8)] if len(who) else np.zeros(0, np.int64)
        size = size[who]
        while len(who):
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            rank = self.ranks(flat, first)
            best = np.minimum.reduceat(rank, first)
            seq = np.repeat(np.arange(len(who)), size)
            merge = (rank == best[seq]) & (rank != NONE)
            at = np.flatnonzero(merge)
            if len(at):
                s = seq[at]
                opens = np.r_[True, s[1:] != s[:-1]]
                runs = np.r_[True, (at[1:] != at[:-1] + 1) | opens[1:]]
                place = np.arange(len(at)) - np.flatnonzero(runs)[np.cumsum(runs) - 1]
                take = np.where(self.together[rank[at]], place % 2 == 0, opens)  # aaa: the first pair, not both
                at = at[take]
                flat[at] = self.by_rank[rank[at]]
                keep = np.ones(len(flat), dtype=bool)
                keep[at + 1] = False
                flat = flat[keep]
                size = size - np.bincount(seq[at], minlength=len(who))
            going = (best != NONE) & (size > 1)
            total[who] = size
            if not going.all():
                flat = flat[np.repeat(going, size)]
                who, size = who[going], size[going]
        return total


@lru_cache(maxsize=2)
def load_merger(path: str) -> tuple[RankMerger, list[str]]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return RankMerger(spec["model"]["vocab"], spec["model"]["merges"]), [t["content"] for t in spec["added_tokens"]]


class Counter:
    """Counts texts; remembers the counts of pre-tokens that it has seen."""

    def __init__(self, path: str, pattern: str):
        self.merger, special = load_merger(path)
        self.pattern = regex.compile(pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def words(self, text: str) -> tuple[list[str], int]:
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1:
            return self.pattern.findall(text), 0
        return [w for p in parts for w in self.pattern.findall(p)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = [w for w in {w for words, _ in cut for w in words} if w not in known]
        if new:
            self.known.update(zip(new, self.merger.counts([w.encode() for w in new]).tolist()))
        return [sum(map(self.known.__getitem__, words)) + extra for words, extra in cut]


@lru_cache(maxsize=1)
def load_counter(path: str, pattern: str) -> Counter:
    """Kept by a Python worker from task to task; what it remembers changes the time only."""
    return Counter(path, pattern)


def pieces(texts: list[str], most: int = PIECE_CHARS) -> Iterator[list[str]]:
    """Lists of whole texts of about `most` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 100
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count(path: str, pattern: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = load_counter(path, pattern)
        for texts in batches:
            yield pd.Series([x for p in pieces(texts.tolist()) for x in counter.count(p)], dtype="int64")

    return run


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    n = column_map(docs.sparkSession, _count(path, pattern), "long")(text_of("text"))
    out = docs.select("doc_id", F.octet_length(text_of("text")).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
