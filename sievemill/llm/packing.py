"""Hierarchical multi-length packing into sequences without padding.

Each task routes its documents by length to context-size tiers (256, 512, 1024, 2048). Documents longer than the
largest tier fill whole windows and their rest is routed. A long window takes a long piece first and its gap is filled
from the shorter tiers, largest fitting piece first, cutting one last piece; the shorter tiers are packed the same way
from what is left. What a task cannot fill at its end is laid into windows of ever smaller powers of two, so no
sequence is padded. Sequences of one tier are counted off into step groups of equal tokens.

Tokenizing works on distinct blank-separated words, by the library, remembered in each worker: the vocabulary's
pre-tokenizer never joins characters across blanks, so the ids of a text are the ids of its words in order.

Packing is local to a task and needs no shuffle. Sequence ids hold the task's number, so the input should be a stored
table (as for any operator whose rows depend on their order). Defined cases: null text is empty and gives the one
closing id; repeated rows are packed each; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pandas_map, text_of
from .token_counts import pieces

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16 * 2048
REMEMBERED = 300_000
#: Characters that every Unicode library lower-cases alike, one by one: below U+0250 without the dotted capital I.
LATIN = re.compile("[\\x00-\\u012f\\u0131-\\u024f]*").fullmatch
#: Marks that end a run of letters (an apostrophe may not).
MARKS = string.punctuation.replace("'", "")
#: Windows of a tier that stay unpacked to fill the gaps of longer ones.
RESERVE = 16


class WordIds:
    """Ids of whole texts by way of their distinct words, each asked of the library once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.lib, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])  # for lower-case Latin words both leave nothing to do
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that end a run of letters
        self.ends[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.special = [a.content for a in self.lib.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 20, dtype=np.uint32), 0
        self.start, self.size = np.zeros(1 << 20, dtype=np.int64), np.zeros(1 << 20, dtype=np.int64)

    def _add(self, words: list[str], size: np.ndarray, flat: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        n = len(self.at)
        if n + len(words) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(len(x) + len(words), dtype=np.int64)]) for x in (self.start, self.size))
        self.start[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(words)] = size
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.at.update(zip(words, range(n, n + len(words))))

    def _ask(self, words: list[str]) -> None:
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            ids = [e.ids for e in self.lib.encode_batch_fast(part, add_special_tokens=False)]
            size = np.array([len(x) for x in ids], dtype=np.int64)
            self._add(part, size, np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum())))

    def _ask_letters(self, words: list[str]) -> None:
        """Lower-case words of letters only are one pre-token each, so many can be asked for in one text."""
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            made = self.bare.encode_batch_fast([" ".join(part[j : j + 200]) for j in range(0, len(part), 200)], add_special_tokens=False)
            flat = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in made] or [np.zeros(0, np.uint32)])
            size = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
            if len(size) != len(part):
                raise ValueError("the vocabulary parts runs of letters")
            self._add(part, size, flat)

    def _learn(self, new: set[str]) -> None:
        """A lower-case Latin word followed by marks has the ids of the word and of the marks, as the vocabulary parts
        letters from marks; so far as it can, the library is asked for words of letters only."""
        lower = [w for w in new if w.islower() and (w.isascii() or LATIN(w))]
        stems = [w if w.isalpha() else w.rstrip(MARKS) for w in lower]
        plain = [s for s in stems if s.isalpha()]
        built = [(w, s, w[len(s) :]) for w, s in zip(lower, stems) if len(w) > len(s) and s.isalpha()]
        rest = {*new.difference(lower), *[w for w, s in zip(lower, stems) if not s.isalpha()], *[m for _, _, m in built]}
        at = self.at
        self._ask([w for w in rest if w not in at])  # a set less dict keys would walk all the keys
        self._ask_letters([w for w in set(plain) if w not in at])
        if built:
            both = np.array([[at[s] for _, s, _ in built], [at[m] for _, _, m in built]], dtype=np.int64).T.ravel()
            size = self.size[both]
            self._add([w for w, _, _ in built], size.reshape(-1, 2).sum(axis=1), self._gather(both, size))

    def _gather(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        stop = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - stop + size, size) + np.arange(stop[-1])]

    def _lower(self, text: str) -> str:
        """The text as the vocabulary sees it: in lower case, unless that makes special strings that the text has not,
        as those are matched with their case. Only Latin texts, others are left to the library."""
        if not LATIN(text):
            return text
        low = text.lower()
        if any(low.count(x) != text.count(x) for x in self.special):
            return text
        return low

    def encode(self, texts: list[str], end: int) -> Iterator[np.ndarray]:
        """Ids of each text and the closing id. The vocabulary ignores case, so Latin texts are lower-cased first,
        which makes fewer distinct words."""
        if len(self.at) > REMEMBERED:
            self._clear()
        cut = [self._lower(t).replace("\n", " ").split(" ") for t in texts]
        words = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.at.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if len(miss := np.flatnonzero(at < 0)):
            new = [words[i] for i in miss.tolist()]
            self._learn(set(new))
            at[miss] = np.fromiter(map(self.at.__getitem__, new), dtype=np.int64, count=len(new))
        size = self.size[at]
        flat, total = self._gather(at, size), np.r_[0, np.cumsum(size)]
        bounds = total[np.cumsum([0, *map(len, cut)])]
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            out = np.empty(b - a + 1, dtype=np.uint32)
            out[:-1], out[-1] = flat[a:b], end
            yield out


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """Kept by a Python worker from task to task; what it remembers changes the time only."""
    return WordIds(path)


class Packer:
    """Pieces are (doc, start, ids, doc_tokens); finished rows gather in `rows`."""

    def __init__(self, tiers: tuple[int, ...], base: int):
        self.tiers, self.base = tuple(sorted(tiers)), base
        self.queues = {t: deque() for t in self.tiers}
        self.waiting = dict.fromkeys(self.tiers, 0)
        self.rows: list[tuple] = []
        self.made = 0
        self.of_tier = dict.fromkeys(self.tiers, 0)

    def route(self, piece: tuple) -> None:
        n = len(piece[2])
        if n:
            tier = next((t for t in self.tiers if n <= t), self.tiers[-1])
            self.queues[tier].append(piece)
            self.waiting[tier] += n

    def pop(self, tier: int) -> tuple:
        piece = self.queues[tier].popleft()
        self.waiting[tier] -= len(piece[2])
        return piece

    def add(self, doc, ids: np.ndarray) -> None:
        top, n = self.tiers[-1], len(ids)
        cut = n // top * top
        for k in range(0, cut, top):
            self.emit([(doc, k, ids[k : k + top], n)], top)
        self.route((doc, cut, ids[cut:], n))
        for tier in self.tiers:
            self.drain(tier, 0 if tier == top else RESERVE * tier)

    def drain(self, tier: int, reserve: int) -> None:
        """Full windows of this tier, for as long as its own pieces are over the reserve and the gaps can be filled."""
        while self.queues[tier] and self.waiting[tier] > 2 * reserve and sum(self.waiting[t] for t in self.tiers if t <= tier) >= tier:
            self.emit(self.window(tier), tier)

    def window(self, size: int) -> list[tuple]:
        inside, gap = [], size
        for tier in [t for t in reversed(self.tiers) if t <= size or not inside]:
            while gap and self.queues[tier] and len(self.queues[tier][0][2]) <= gap:
                inside.append(self.pop(tier))
                gap -= len(inside[-1][2])
        for tier in self.tiers:  # the gap that no whole piece fits is cut from the shortest tier that has one
            while gap and self.queues[tier]:
                doc, start, ids, n = self.pop(tier)
                inside.append((doc, start, ids[:gap], n))
                self.route((doc, start + len(ids[:gap]), ids[gap:], n))
                gap -= len(inside[-1][2])
        return inside

    def emit(self, inside: list[tuple], tier: int) -> None:
        offset, seq = 0, self.base + self.made
        self.made += 1
        group = -1
        if tier in self.of_tier:
            group = self.base + (self.tiers.index(tier) << 32) + self.of_tier[tier] // max(1, STEP_TOKENS // tier)
            self.of_tier[tier] += 1
        for doc, start, ids, n in inside:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, seq, offset, tier, group))
            offset += len(ids)

    def finish(self) -> None:
        for tier in reversed(self.tiers):
            self.drain(tier, 0)
        left = sum(self.waiting.values())
        size = self.tiers[-1]
        while left:
            size = min(size, 1 << (left.bit_length() - 1))
            self.emit(self.window(size), size)
            left -= size

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])


def _pack(path: str, tiers: tuple[int, ...], end: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(path)
        packer = Packer(tiers, TaskContext.get().partitionId() << 40)
        for pdf in batches:
            for doc, ids in zip(pdf["doc_id"].tolist(), (x for p in pieces(pdf["text"].tolist()) for x in words.encode(p, end))):
                packer.add(doc, ids)
                if len(packer.rows) >= 20_000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return run


def pack_documents(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group."""
    kind = docs.schema["doc_id"].dataType
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    rows = docs.select(F.col("doc_id").cast("string"), text_of("text").alias("text")).transform(pandas_map, _pack(path, tiers, end_id), schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))
