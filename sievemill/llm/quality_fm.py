"""Quality classifier: a factorisation machine over hashed words, structure statistics and size metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is taken in time linear in the
non-zero features as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Inputs come from the whole text only: hashed lower-cased words (damped counts, unit length), and statistics of its
bytes, words and lines. The machine is fitted in one task on at most `sample_rows` labelled rows (the bound that the
memory of that task rests on), chosen by a hash of their ids, and scores every document.

Defined cases: null and empty texts have no word features and get the score of their statistics; null labels are left
out; documents with several labels use each; of several texts with one id the one with the smallest hash is learnt from; extra columns are ignored by `score` and kept by `keep_good`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_map, pandas_map, text_of

BITS = 16
FACTORS = 4
SAMPLE_ROWS = 16_000
STATS = 17


def fold_of(doc_id: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds; null ids count as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")), F.lit(0)) % folds


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word buckets, their unit-length damped counts, and the statistics."""
    raw = text.encode()
    words = raw.lower().split()
    hashed = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) & np.uint32((1 << BITS) - 1)
    bucket, n = np.unique(hashed, return_counts=True)
    value = np.log1p(n).astype(np.float32)
    value /= np.sqrt((value**2).sum()) or 1
    h = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) if raw else np.zeros(256, dtype=np.int64)
    size, count, lines = max(1, len(raw)), max(1, len(words)), h[10] + 1
    upper, lower = h[65:91].sum(), h[97:123].sum()
    punct = h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()
    stats = [np.log1p(len(raw)), np.log1p(len(words)), np.log1p(lines), len(raw) / count, len(words) / lines, len(bucket) / count]
    stats += [upper / max(1, upper + lower), h[48:58].sum() / size, punct / size, h[128:].sum() / size, h[32] / size]
    stats += [h[33] / count, h[124] / count, (h[46] + h[44] + h[63]) / count, (h[35:39].sum() + h[42]) / count, (n.max() if len(n) else 0) / count, (hashed[1:] == hashed[:-1]).sum() / count]
    return bucket.astype(np.int64), value, np.array(stats, dtype=np.float32)


class Rows:
    """Sparse rows: words first, then the standardised statistics."""

    def __init__(self, made: list[tuple], mean: np.ndarray, scale: np.ndarray):
        dense = np.clip((np.stack([m[2] for m in made]) - mean) / scale, -4, 4) * np.float32(0.3)
        own = (1 << BITS) + np.arange(STATS)
        self.index = np.concatenate([x for m in made for x in (m[0], own)])
        self.value = np.concatenate([x for m, d in zip(made, dense) for x in (m[1], d)]).astype(np.float32)
        size = np.array([len(m[0]) + STATS for m in made])
        self.start = np.cumsum(size) - size
        self.size = size


class Machine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.w0, self.w, self.v, self.mean, self.scale = w0, w, v, mean, scale

    def margin(self, rows: Rows) -> np.ndarray:
        x, at = rows.value, rows.index
        out = np.add.reduceat(self.w[at] * x, rows.start) + self.w0
        for f in range(self.v.shape[0]):
            t = self.v[f][at] * x
            out += 0.5 * (np.add.reduceat(t, rows.start) ** 2 - np.add.reduceat(t * t, rows.start))
        return out

    def score(self, made: list[tuple]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(Rows(made, self.mean, self.scale)).astype(float)))

    @classmethod
    def fit(cls, made: list[tuple], labels: np.ndarray, steps: int = 1000, rate: float = 0.12, decay: float = 1e-5) -> Machine:
        """Mini-batch AdaGrad on the log loss, from a fixed seed; about `steps` steps but six epochs at least."""
        rng = np.random.default_rng(7)
        batch = int(np.clip(len(made) // 64, 16, 128))
        epochs = max(6, -(-steps * batch // len(made)))
        size = (1 << BITS) + STATS
        stats = np.stack([m[2] for m in made])
        mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        m = cls(float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.05, (FACTORS, size)).astype(np.float32), mean, scale)
        seen_w, seen_v, seen_0 = np.full(size, 1e-3), np.full((FACTORS, size), 1e-3), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(made))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                rows = Rows([made[i] for i in part], mean, scale)
                x, at, of = rows.value, rows.index, np.repeat(np.arange(len(part)), rows.size)
                g = (1 / (1 + np.exp(-m.margin(rows))) - labels[part]) / len(part)
                touched, to = np.unique(at, return_inverse=True)
                gx = g[of] * x
                grad = np.bincount(to, gx) + decay * m.w[touched]
                steps = []
                for f in range(FACTORS):
                    t = m.v[f][at] * x
                    steps.append(np.bincount(to, gx * (np.add.reduceat(t, rows.start)[of] - t)) + decay * m.v[f][touched])
                seen_w[touched] += grad**2
                m.w[touched] -= rate * grad / np.sqrt(seen_w[touched])
                for f, s in enumerate(steps):
                    seen_v[f][touched] += s**2
                    m.v[f][touched] -= rate * s / np.sqrt(seen_v[f][touched])
                seen_0 += g.sum() ** 2
                m.w0 -= rate * g.sum() / np.sqrt(seen_0)
        return m

    def pack(self) -> bytes:
        return np.concatenate([[self.w0], self.w, self.v.ravel(), self.mean, self.scale]).astype("<f4").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Machine:
        a, size = np.frombuffer(raw, dtype="<f4").copy(), (1 << BITS) + STATS
        w, v, rest = a[1 : 1 + size], a[1 + size : 1 + size * (1 + FACTORS)], a[1 + size * (1 + FACTORS) :]
        return cls(float(a[0]), w, v.reshape(FACTORS, size), rest[:STATS], rest[STATS:])


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [(i, y, features(t)) for pdf in batches for i, y, t in zip(pdf["doc_id"], pdf["quality"], pdf["text"])]
    rows.sort(key=lambda r: r[:2])
    if rows:
        yield pd.DataFrame({"model": [Machine.fit([r[2] for r in rows], np.array([r[1] for r in rows], dtype=float)).pack()]})


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine | None:
    """Learns from rows outside fold 0; None without any labelled row."""
    chosen = labels.select("doc_id", "quality").filter((fold_of("doc_id") != 0) & F.col("quality").isNotNull())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text for an id, however often it stands in docs
    rows = rows.select(F.col("doc_id").cast("string"), "quality", "text")
    found = rows.repartition(1).transform(pandas_map, _fit, "model binary").collect()
    return Machine.unpack(bytes(found[0]["model"])) if found else None


def _scored(packed: bytes | None):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = Machine.unpack(packed) if packed else None
        for texts in batches:
            score = np.full(len(texts), 0.5)
            for k in range(0, len(texts) if machine else 0, 256):
                score[k : k + 256] = machine.score([features(t) for t in texts.iloc[k : k + 256]])
            yield pd.Series(score)

    return run


def score_of(docs: DataFrame, machine: Machine | None) -> Column:
    """Score of each document (0.5 without a machine)."""
    return column_map(docs.sparkSession, _scored(machine and machine.pack()), "double")(text_of("text"))


def score_quality(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score of every document."""
    return docs.select("doc_id", score_of(docs, machine).alias("score"))


def keep_good(docs: DataFrame, machine: Machine | None, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, unchanged."""
    return docs.filter(score_of(docs, machine) >= threshold)
