"""Quality classifier by positive-unlabelled learning.

Features of a text: shares of byte classes, word, repetition and line statistics, and frequencies of byte-class trigrams. A small
network is trained by the non-negative unbiased risk

    pi * E_P[l(+)] + max(0, E_U[l(-)] - pi * E_P[l(-)])

from trusted positives (labelled quality 1, training folds only) and unlabelled documents of all kinds. The class prior pi is
estimated first: the least ratio of unlabelled to positive mass above any score of a first network.
Then the logit is shifted so that ``CUT`` lies midway between the score that ``KEEP`` of the trusted positives reach and the
middle of the unlabelled rest.

Bounds: at most ``MOST_POSITIVE`` positives and ``MOST_UNLABELLED`` unlabelled documents, chosen by a hash of doc_id, and only
their features come to the driver. Every text is scored whole.

Nulls and empty texts have all features 0 and are scored like any other; null doc_ids are scored but never train; repeated labels
of a document count as quality 1 only if all say so. Without any positive label the score is 1/2. Empty tables give no rows;
extra columns are kept out (``scores``) or kept (``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, lean
from .text import hash_spans, pieces, spans, utf8

CUT, KEEP = 0.7, 0.99
MOST_POSITIVE, MOST_UNLABELLED = 4000, 8000
FOLDS, HELD = 4, 2
HIDDEN, EPOCHS, SEED = 16, 60, 7

#: Byte classes: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 sentence mark, 6 symbol, 7 other bytes.
KIND = np.full(256, 6, np.int64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 7
KIND[[32, 9]], KIND[[10, 13]], KIND[[46, 44, 59, 58, 33, 63, 39, 34, 45, 40, 41]] = 3, 4, 5
TRIGRAMS = 8**3
STATS = 18


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of features for each document of a piece."""
    n = len(off) - 1
    out = np.zeros((n, STATS + TRIGRAMS), np.float32)
    if not len(data):
        return out
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    kind = KIND[data]
    share = np.bincount(doc * 8 + kind, minlength=n * 8).reshape(n, 8) / np.maximum(size, 1)[:, None]
    out[:, :8] = share
    tri = kind[:-2] * 64 + kind[1:-1] * 8 + kind[2:]
    same = doc[:-2] == doc[2:]
    t = np.bincount((doc[:-2] * TRIGRAMS + tri)[same], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    out[:, STATS:] = np.sqrt(t / np.maximum(size - 2, 1)[:, None])
    starts, ends, woff = spans(data, off)
    words = np.diff(woff)
    h = hash_spans(data, starts, ends)
    who = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)
    length = ends - starts
    out[:, 8] = np.log1p(words) / 10
    out[:, 9] = np.bincount(who, length, n) / some / 10
    out[:, 10] = np.sqrt(np.maximum(np.bincount(who, length.astype(float) ** 2, n) / some - (out[:, 9] * 10) ** 2, 0)) / 10
    o = np.lexsort((h, who))
    new = np.concatenate([[True], (h[o][1:] != h[o][:-1]) | (who[o][1:] != who[o][:-1])]) if len(h) else np.zeros(0, bool)
    out[:, 11] = np.bincount(who[o][new], minlength=n) / some
    if len(h) > 1:
        twice = (h[1:] == h[:-1]) & (who[1:] == who[:-1])
        out[:, 12] = np.bincount(who[1:][twice], minlength=n) / some
    first, last = kind[starts], kind[ends - 1]
    out[:, 13] = np.bincount(who, first == 1, n) / some
    out[:, 14] = np.bincount(who, last == 6, n) / some
    out[:, 15] = np.bincount(who, (length > 1) & (first == 1) & (kind[np.minimum(starts + 1, len(kind) - 1)] == 1), n) / some
    out[:, 16] = np.bincount(who, (length == 1) & (first >= 5), n) / some
    out[:, 17] = np.bincount(doc, kind == 4, n) / some
    return out


def feature_batches(b: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    data, off = utf8(b.column(k))
    for i, j in pieces(off, 1 << 19):
        for a in range(i, j, 1024):
            e = min(a + 1024, j)
            yield a, features(data[off[a] : off[e]], off[a : e + 1] - off[a])


def sample_features(docs: DataFrame, chosen: DataFrame) -> np.ndarray:
    """Features of the documents whose doc_id is in ``chosen`` (bounded)."""

    def run(batches):
        for b in batches:
            for _, x in feature_batches(b, 0):
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], ["x"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("text").mapInArrow(lean(run), "x binary").collect()
    return np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, STATS + TRIGRAMS)


class Network:
    """One hidden layer of tanh units; its output is a logit."""

    def __init__(self, x: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), 1 / (x.std(0) + 0.02)
        d = x.shape[1]
        self.p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.p
        return np.tanh(self.scaled(x) @ a + b) @ c + d[0]

    def grads(self, x: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        a, b, c, _ = self.p
        h = np.tanh(x @ a + b)
        dh = dz[:, None] * c * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(keepdims=True)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(pos: np.ndarray, unl: np.ndarray, prior: float) -> Network:
    """Minimises the non-negative risk by Adam; where the negative part is below zero its gradient is turned back."""
    net, rng = Network(np.concatenate([pos, unl])), np.random.default_rng(SEED)
    p, u = net.scaled(pos), net.scaled(unl)
    m, v, t = [np.zeros_like(x) for x in net.p], [np.zeros_like(x) for x in net.p], 0
    size = 256
    for _ in range(EPOCHS):
        for idx in np.array_split(rng.permutation(len(u)), max(1, len(u) // size)):
            px, ux = p[rng.integers(0, len(p), min(size, len(p)))], u[idx]
            a, b, c, d = net.p
            zp, zu = (np.tanh(x @ a + b) @ c + d[0] for x in (px, ux))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp_plus, gp_minus, gu_minus = -sigmoid(-zp) / len(px), sigmoid(zp) / len(px), sigmoid(zu) / len(ux)
            if negative >= 0:
                dp, du = prior * gp_plus - prior * gp_minus, gu_minus
            else:
                dp, du = prior * gp_minus, -gu_minus
            g = [x + y + 1e-4 * w for x, y, w in zip(net.grads(px, dp), net.grads(ux, du), net.p, strict=True)]
            t += 1
            for k in range(4):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                net.p[k] = net.p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in the unlabelled: a network told them apart naively, then the least ratio of mass above a score.

    Half of the positives train, the other half count, so that the ratio is not that of memorised rows.
    """
    net = train(pos[::2], unl[::2], 0.5)
    zp, zu = np.sort(net.logits(pos[1::2])), np.sort(net.logits(unl[1::2]))
    if not len(zp) or not len(zu):
        return 0.5
    cuts = np.quantile(zp, np.linspace(0.0, 0.6, 61))
    fp = 1 - np.searchsorted(zp, cuts) / len(zp)
    fu = 1 - np.searchsorted(zu, cuts) / len(zu)
    return float(np.clip((fu / fp).min(), 0.05, 0.95))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Network, float] | None:
    """(network, shift of its logit), or None without positives."""
    docs = docs.select("doc_id", "text")
    mine = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    mine = mine.filter((F.col("quality") == 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD))
    pos = sample_features(docs, mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_POSITIVE).select("doc_id"))
    free = docs.filter("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64(F.lit("u"), "doc_id"), "doc_id").limit(MOST_UNLABELLED).distinct()
    unl = sample_features(docs, free)
    if not len(pos) or not len(unl):
        return None
    pos, unl = pos[np.lexsort(pos.T[:STATS])], unl[np.lexsort(unl.T[:STATS])]  # rows come in no order
    rng = np.random.default_rng(SEED)
    pos, unl = pos[rng.permutation(len(pos))], unl[rng.permutation(len(unl))]
    prior = estimate_prior(pos, unl)
    net = train(pos, unl, prior)
    low = float(np.quantile(net.logits(pos), 1 - KEEP))
    rest = float(np.quantile(net.logits(unl), (1 - prior) / 2))  # the middle of the unlabelled that are no positives
    return net, np.log(CUT / (1 - CUT)) - low + 0.5 * max(low - rest, 0.0)


def with_scores(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """docs with a column ``name``, which docs must not have: the score (0 to 1, higher: better)."""
    model = fit(docs, labels)
    k = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    names = [f.name for f in schema]

    def run(batches):
        for b in batches:
            score = np.full(len(b), 0.5)
            if model is not None:
                for a, x in feature_batches(b, k):
                    score[a : a + len(x)] = sigmoid(model[0].logits(x) + model[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=names)

    return docs.mapInArrow(lean(run), schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    s = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs less those scored below ``CUT``. Columns may have any names."""
    name = free_name(docs.columns, "score")
    return with_scores(docs, labels, name).filter(F.col(name) >= CUT).drop(name)
