"""Quality classifier: a generalised additive model with pairwise interactions.

features() turns a text into numbers; fit() bins them and boosts shallow trees feature by
feature in a cycle, then over the strongest pairs, so that what is learned is one lookup
table a feature and one a pair; scoring adds table entries.

Cases: null and empty texts have the features of an empty text and get a score like any
other. With no labelled row, or one class only, the score is the (smoothed) share of
label 1. Rows are scored one by one; columns beside id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from ._shared import crc_mod, table

NAMES = ["log_bytes", "log_words", "word_len", "upper", "digit", "space", "newline", "stop", "comma", "pipe", "bang", "symbol", "other_punct", "non_ascii", "distinct_words", "repeated_words", "distinct_shingles", "words_a_line", "short_words", "long_words"]
#: Labelled rows to learn from, at most; bins of a feature; bins of each side of a pair.
SAMPLE, BINS, PAIR_BINS = 40_000, 32, 12
ROUNDS, RATE, PAIRS = 120, 0.15, 8


def _mask(*codes: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_CLASSES = [_mask(*range(65, 91)), _mask(*range(48, 58)), _mask(32, 9), _mask(10), _mask(46), _mask(44), _mask(124), _mask(33), _mask(*b"#$%&*@^~<>{}[]\\=+"), _mask(*b"\"'()-/:;?_`"), _mask(*range(128, 256))]


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text."""
    n = np.diff(off)
    some = np.maximum(n, 1)
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
    cls = [count(m[data]) for m in _CLASSES]
    start, end, first, h = V.word_hashes(data, off)
    nw = np.diff(first)
    size = end - start
    by_word = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = False
    three = np.zeros(len(h), V.U64)
    if len(h) > 2:
        three[:-2] = V.mix(h[:-2] + V.mix(h[1:-1] + V.mix(h[2:])))
    unique, unique3 = np.ones(len(nw)), np.ones(len(nw))
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a + 1:
            unique[i] = len(np.unique(h[a:b])) / (b - a)
        if b > a + 3:
            unique3[i] = len(np.unique(three[a : b - 2])) / (b - a - 2)
    words = np.maximum(nw, 1)
    out = [np.log1p(n), np.log1p(nw), by_word(size) / words, *(c / some for c in cls), unique, by_word(same) / words, unique3, nw / (cls[3] + 1), by_word(size <= 2) / words, by_word(size >= 15) / words]
    return np.stack(out, 1).astype(np.float32)


def featurize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the features of every whole text."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.concatenate([features(data, off) for _, _, data, off in V.chunks(batch.column(1))])
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))
                yield pa.record_batch([batch.column(0), flat], ["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, x array<float>")


class Gam:
    """Tables over bins: main effects, and effects of pairs over coarser bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS):
        y = y.astype(float)
        share = (y.sum() + 1) / (len(y) + 2)
        self.base, self.pairs = float(np.log(share / (1 - share))), []
        d = x.shape[1]
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(d)]
        self.coarse = [c[:: max(1, -(-len(c) // (PAIR_BINS - 1)))] for c in self.cuts]
        self.main = [np.zeros(len(c) + 1) for c in self.cuts]
        if not len(x) or y.min() == y.max():
            return
        bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]
        f = np.full(len(y), self.base)
        for _ in range(rounds):
            for j in range(d):
                p = 1 / (1 + np.exp(-f))
                step = _tree(np.bincount(bins[j], y - p, len(self.main[j])), np.bincount(bins[j], p * (1 - p), len(self.main[j])))
                self.main[j] += RATE * step
                f += RATE * step[bins[j]]
        low = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.coarse)]
        p = 1 / (1 + np.exp(-f))
        gain = []
        for a in range(d):
            for b in range(a):
                gain.append((_quadrants(*self._cells(low, a, b, y - p, p * (1 - p)))[1], a, b))
        self.pairs = [(a, b, np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1))) for g, a, b in sorted(gain, reverse=True)[:pairs] if g > 0]
        for _ in range(rounds // 2):
            for a, b, lut in self.pairs:
                p = 1 / (1 + np.exp(-f))
                step = _quadrants(*self._cells(low, a, b, y - p, p * (1 - p)))[0]
                lut += RATE * step
                f += RATE * step[low[a], low[b]]

    def _cells(self, low, a, b, g, h):
        na, nb = len(self.coarse[a]) + 1, len(self.coarse[b]) + 1
        cell = low[a] * nb + low[b]
        return np.bincount(cell, g, na * nb).reshape(na, nb), np.bincount(cell, h, na * nb).reshape(na, nb)

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, lut in enumerate(self.main):
            f += lut[np.searchsorted(self.cuts[j], x[:, j], "right")]
        for a, b, lut in self.pairs:
            f += lut[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-f))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2, reg: float = 1.0) -> np.ndarray:
    """The leaf values of a tree of this depth over ordered bins, by bin."""
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = cg**2 / (ch + reg) + (g.sum() - cg) ** 2 / (h.sum() - ch + reg)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + reg):
            return np.concatenate([_tree(g[:k], h[:k], depth - 1, reg), _tree(g[k:], h[k:], depth - 1, reg)])
    return np.full(len(g), g.sum() / (h.sum() + reg))


def _quadrants(g: np.ndarray, h: np.ndarray, reg: float = 1.0) -> tuple[np.ndarray, float]:
    """The best tree of one cut on each side, and its gain over no cut."""
    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for c in (cg, ch):
        ll = c[:-1, :-1]
        lr, rl = c[:-1, -1:] - ll, c[-1:, :-1] - ll
        parts.append((ll, lr, rl, c[-1, -1] - ll - lr - rl))
    gain = sum(a**2 / (b + reg) for a, b in zip(*parts)) - cg[-1, -1] ** 2 / (ch[-1, -1] + reg)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    v = [a[i, j] / (b[i, j] + reg) for a, b in zip(*parts)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j])


def fit(rows: DataFrame, sample: int = SAMPLE) -> Gam:
    """rows: (doc_id, x, y) with y 0 or 1; about `sample` of them at most are used, drawn by a hash of the id."""
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    got = rows.select("x", "y").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float32).reshape(-1, len(NAMES))
    return Gam(x, got.column("y").to_numpy().astype(int))


def classify(feats: DataFrame, model: Gam, at: float = 0.3) -> DataFrame:
    """feats with score and predicted (1 from score `at` on)."""
    shared = feats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
                s = shared.value.score(x)
                yield pa.record_batch([batch.column(0), pa.array(s), pa.array((s >= at).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = feats.schema["doc_id"].dataType.simpleString()
    return feats.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    feats = table(featurize(docs), "quality-features")  # the texts are read once
    held = crc_mod(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("y"))
    model = fit(feats.where(~held).join(labels, "doc_id"))
    return classify(feats, model).select("doc_id", held.alias("held_out"), "score", "predicted")
