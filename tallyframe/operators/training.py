"""Encoders without weights, heads on frozen features, and the optimiser's steps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def hash_encoding(text: Column, dim: int = 64) -> Column:
    """A signed bag of hashed words, of unit length. Words are hashed by Spark; each is added to its cell once."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)) * 2 + F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)))

    @F.pandas_udf("array<double>")
    def bag(cells: pd.Series) -> pd.Series:
        n = cells.map(lambda c: 0 if c is None else len(c)).to_numpy(np.int64)
        flat = np.concatenate([c for c in cells if c is not None and len(c)] or [np.zeros(0)]).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        sums = np.bincount(row * dim + flat // 2, 1.0 - 2 * (flat % 2), len(n) * dim).reshape(-1, dim)
        sums /= np.sqrt((sums**2).sum(1, keepdims=True) + 1e-24)
        return pd.Series([None if c is None else x for c, x in zip(cells, sums.tolist())])

    return bag(cells)


class AdamW:
    """Decoupled weight decay; steps on dense arrays."""

    def __init__(self, lr: float = 1e-3, decay: float = 0.01, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8):
        self.lr, self.decay, self.betas, self.eps, self.t = lr, decay, betas, eps, 0
        self.m: list[np.ndarray] = []
        self.v: list[np.ndarray] = []

    def step(self, params: list[np.ndarray], grads: list[np.ndarray], rate: float = 1.0) -> None:
        if not self.m:
            self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        self.t += 1
        a, b = self.betas
        for p, g, m, v in zip(params, grads, self.m, self.v):
            m += (1 - a) * (g - m)
            v += (1 - b) * (g * g - v)
            p -= rate * self.lr * (m / (1 - a**self.t) / (np.sqrt(v / (1 - b**self.t)) + self.eps) + self.decay * p)


def clip(grads: list[np.ndarray], limit: float = 1.0) -> float:
    """Scales gradients down to a global norm; returns the norm before."""
    norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
    if norm > limit:
        for g in grads:
            g *= limit / norm
    return norm


def fit_head(df: DataFrame, vector: str, target: str, classes: int, epochs: int = 30, lr: float = 0.05, progress: Callable[[int, float], None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A softmax head on frozen vectors; rows without a target or with no vector of the first one's width are left out, and no row gives a head of width zero. Each epoch is one job: partitions sum loss and gradient, the driver steps on sums of the head's size."""
    import pyarrow as pa

    known = df.where(F.col(target).isNotNull() & F.col(vector).isNotNull())
    first = known.select(F.size(vector)).first()
    dim = first[0] if first else 0
    w, b, opt = np.zeros((classes, dim)), np.zeros(classes), AdamW(lr, 0.0)
    rows = known.where(F.size(vector) == dim).select(F.col(vector).cast("array<double>").alias("x"), F.col(target).cast("int").alias("y"))
    for epoch in range(epochs if first else 0):
        now_w, now_b = w.copy(), b.copy()

        def sums(batches, now_w=now_w, now_b=now_b):
            gw, gb, loss, n = np.zeros_like(now_w), np.zeros_like(now_b), 0.0, 0
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                    y = batch.column(1).to_numpy()
                    z = x @ now_w.T + now_b
                    p = np.exp(z - z.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    loss -= np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
                    p[np.arange(len(y)), y] -= 1
                    gw, gb, n = gw + p.T @ x, gb + p.sum(0), n + len(y)
            flat = np.concatenate([gw.ravel(), gb, [loss, n]])
            yield pa.record_batch([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

        got = rows.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i").column("v").to_numpy().copy()
        n = max(got[-1], 1)
        opt.step([w, b], [got[: w.size].reshape(w.shape) / n, got[w.size : w.size + classes] / n])
        if progress:
            progress(epoch, got[-2] / n)
    return w, b


def head_logits(vector: Column, w: np.ndarray, b: np.ndarray) -> Column:
    """Logits as one native expression; the head is a literal of its fixed size."""
    return F.array(*[S.dot(vector, F.array(*map(F.lit, map(float, row)))) + float(bias) for row, bias in zip(w, b)])


def top_neurons(scores: Column, keep: int) -> Column:
    """Indices of the `keep` greatest scores (of equal ones the first), in order."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, keep), lambda x: x["i"]))
