"""A ModernBERT encoder in NumPy, run inside Arrow batches.

Layers normalise first and have no biases; attention turns between the whole sequence and a
band around each token; positions rotate queries and keys; the MLP is gated. Sequences of a
batch lie one after another without padding, so all products but attention are one matrix
product for the batch; attention is one product a sequence for all heads, or one a block of a long sequence.

The weights are read once, on the driver, and broadcast: their size is that of the model
and does not grow with the data.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import token_ids
from ..sources.tensors import TensorFile, write_tensors


@dataclass(frozen=True)
class Config:
    """Names as in the public config.json of this kind of model."""

    hidden_size: int
    num_hidden_layers: int
    num_attention_heads: int
    intermediate_size: int
    vocab_size: int
    norm_eps: float = 1e-5
    global_attn_every_n_layers: int = 3
    local_attention: int = 128
    global_rope_theta: float = 160_000.0
    local_rope_theta: float = 10_000.0
    classifier_pooling: str = "mean"
    hidden_activation: str = "gelu"

    def check(self) -> None:
        sizes = (self.hidden_size, self.num_hidden_layers, self.num_attention_heads, self.intermediate_size, self.vocab_size, self.global_attn_every_n_layers, self.local_attention)
        if min(sizes) <= 0 or self.hidden_size % (2 * self.num_attention_heads):
            raise ValueError("sizes that do not fit together")
        if self.hidden_activation != "gelu" or self.classifier_pooling not in ("mean", "cls"):
            raise ValueError("an activation or a pooling that is not known here")

    def window(self, layer: int) -> int | None:
        """How far a layer's tokens see to either side; None: the whole sequence."""
        return None if layer % self.global_attn_every_n_layers == 0 else self.local_attention // 2


def shapes(c: Config) -> dict[str, tuple[int, ...]]:
    """Tensors of a model by their public names. The first layer has no norm before its attention."""
    h, i = c.hidden_size, c.intermediate_size
    out = {"embeddings.tok_embeddings.weight": (c.vocab_size, h), "embeddings.norm.weight": (h,), "final_norm.weight": (h,)}
    for k in range(c.num_hidden_layers):
        at = f"layers.{k}."
        out |= {at + "attn.Wqkv.weight": (3 * h, h), at + "attn.Wo.weight": (h, h), at + "mlp_norm.weight": (h,), at + "mlp.Wi.weight": (2 * i, h), at + "mlp.Wo.weight": (h, i)}
        if k:
            out[at + "attn_norm.weight"] = (h,)
    return out


def erf(x: np.ndarray) -> np.ndarray:
    """To 1.5e-7, by Abramowitz and Stegun 7.1.26."""
    # Coefficients of that formula.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * np.abs(x))
    series = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    return np.sign(x) * (1 - series * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / np.sqrt(np.float32(2))))


def normed(x: np.ndarray, weight: np.ndarray, eps: float) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + eps) * weight


def rotations(longest: int, width: int, theta: float, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines (position, 1, half a head's width) of angles that grow with the position."""
    half = width // 2
    angle = np.arange(longest)[:, None] * theta ** (-np.arange(half) / half)
    return tuple(f(angle).astype(dtype)[:, None, :] for f in (np.cos, np.sin))


def rotated(x: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
    """x (tokens, heads, width): halves of a head's values turned by each token's angles."""
    half = x.shape[-1] // 2
    a, b = x[..., :half], x[..., half:]
    return np.concatenate([a * cos - b * sin, b * cos + a * sin], -1)


#: Queries of a sequence that a layer with a window scores at once, and scores of a head that are held at once.
BLOCK, SCORES = 256, 1 << 20


class Encoder:
    def __init__(self, config: Config, weights: dict[str, np.ndarray]):
        config.check()
        for name, shape in shapes(config).items():
            if name not in weights or weights[name].shape != shape:
                raise ValueError(f"{name}: {weights[name].shape if name in weights else 'missing'}, not {shape}")
        self.config, self.weights = config, weights

    def hidden(self, sequences: list[np.ndarray], activity: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Last states of all tokens, and the sequences' borders in them. activity: gets each layer's sums of absolute MLP values by neuron."""
        c, w = self.config, self.weights
        size = np.array([len(s) for s in sequences], np.int64)
        border = np.concatenate([[0], np.cumsum(size)])
        ids = np.concatenate([*sequences, np.zeros(0)]).astype(np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < c.vocab_size:
            raise ValueError("an id outside the vocabulary")
        position = np.arange(len(ids)) - np.repeat(border[:-1], size)
        x = normed(w["embeddings.tok_embeddings.weight"][ids], w["embeddings.norm.weight"], c.norm_eps)
        for k in range(c.num_hidden_layers):
            at = f"layers.{k}."
            y = normed(x, w[at + "attn_norm.weight"], c.norm_eps) if k else x
            x = x + self._attention(y @ w[at + "attn.Wqkv.weight"].T, position, border, k) @ w[at + "attn.Wo.weight"].T
            up, gate = np.split(normed(x, w[at + "mlp_norm.weight"], c.norm_eps) @ w[at + "mlp.Wi.weight"].T, 2, 1)
            inner = gelu(up) * gate
            if activity is not None:
                activity.append(np.abs(inner).sum(0, dtype=np.float64))
            x = x + inner @ w[at + "mlp.Wo.weight"].T
        return normed(x, w["final_norm.weight"], c.norm_eps), border

    def _attention(self, qkv: np.ndarray, position: np.ndarray, border: np.ndarray, layer: int) -> np.ndarray:
        c, window = self.config, self.config.window(layer)
        theta = c.global_rope_theta if window is None else c.local_rope_theta
        q, k, v = (part.reshape(len(qkv), c.num_attention_heads, -1) for part in np.split(qkv, 3, 1))
        cos, sin = (x[position] for x in rotations(int(np.diff(border).max(initial=0)), q.shape[-1], theta, q.dtype))
        q, k = rotated(q, cos, sin) / np.sqrt(q.dtype.type(q.shape[-1])), rotated(k, cos, sin)
        q, k, v = (np.ascontiguousarray(part.transpose(1, 0, 2)) for part in (q, k, np.concatenate([v, np.ones_like(v[..., :1])], -1)))
        out = np.empty_like(q)
        # No score is beyond the longest query times the longest key: if that is small, exponentials are safe as they are.
        safe = float((q**2).sum(-1).max(initial=0)) * float((k**2).sum(-1).max(initial=0)) < 40**2
        if window is not None:
            ahead = np.subtract.outer(-np.arange(BLOCK), -np.arange(BLOCK + 2 * window))  # of a key from the first that a query sees
            band = np.where((ahead >= 0) & (ahead <= 2 * window), 0, -np.inf).astype(q.dtype)
        for a, b in zip(border[:-1].tolist(), border[1:].tolist()):
            block = BLOCK if window is not None else max(1, SCORES // max(b - a, 1))
            for s in range(a, b, block):
                e = min(s + block, b)
                lo, hi = (a, b) if window is None else (max(a, s - window), min(b, e + window))
                score = q[:, s:e] @ k[:, lo:hi].transpose(0, 2, 1)
                if window is not None and hi - lo > window + 1:
                    score += band[: e - s, lo - s + window : hi - s + window]
                if not safe:
                    score -= score.max(-1, keepdims=True)
                np.exp(score, out=score)
                sums = score @ v[:, lo:hi]  # the last column: of the weights themselves
                np.divide(sums[..., :-1], sums[..., -1:], out=out[:, s:e])
        out = out.transpose(1, 0, 2)
        return out.reshape(len(qkv), -1)

    def pooled(self, sequences: list[np.ndarray]) -> np.ndarray:
        """One vector a sequence: the mean of its tokens, or its first; zeros without a token."""
        x, border = self.hidden(sequences)
        out = np.zeros((len(sequences), self.config.hidden_size), np.float32)
        some = np.flatnonzero(np.diff(border))
        if len(some):
            if self.config.classifier_pooling == "cls":
                out[some] = x[border[some]]
            else:
                out[some] = np.add.reduceat(x.astype(np.float64), border[some]) / np.diff(border)[some][:, None]
        return out

    # ---- smaller models

    def output_norms(self) -> list[np.ndarray]:
        """For each layer, how much one unit of each MLP neuron adds."""
        return [np.sqrt((self.weights[f"layers.{k}.mlp.Wo.weight"].astype(np.float64) ** 2).sum(0)) for k in range(self.config.num_hidden_layers)]

    def with_neurons(self, keep: list[list[int]]) -> Encoder:
        """The MLP cut to these neurons, as many in each layer."""
        c, n = self.config, len(keep[0]) if keep else 0
        if len(keep) != c.num_hidden_layers or any(len(k) != n or len(set(k)) != n or not all(0 <= i < c.intermediate_size for i in k) for k in keep) or not n:
            raise ValueError("each layer keeps as many different neurons")
        new = dict(self.weights)
        for k, own in enumerate(keep):
            at = f"layers.{k}.mlp."
            new[at + "Wi.weight"] = self.weights[at + "Wi.weight"][[*own, *(c.intermediate_size + i for i in own)]]
            new[at + "Wo.weight"] = self.weights[at + "Wo.weight"][:, own]
        return Encoder(replace(c, intermediate_size=n), new)

    def with_vocabulary(self, old_ids: list[int]) -> Encoder:
        """The embedding rows of these ids, which are numbered anew in their order."""
        name = "embeddings.tok_embeddings.weight"
        return Encoder(replace(self.config, vocab_size=len(old_ids)), self.weights | {name: self.weights[name][old_ids]})


def random_weights(config: Config, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {n: np.ones(s, np.float32) if len(s) == 1 else rng.normal(0, 0.7 / np.sqrt(s[1]), s).astype(np.float32) for n, s in shapes(config).items()}


def save(encoder: Encoder, path: str, kind: str = "BF16") -> None:
    """A folder of config.json and model.safetensors; it appears whole, in place of an older one."""
    part = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(part)
    with open(f"{part}/config.json", "w", encoding="utf-8") as f:
        json.dump(asdict(encoder.config), f, indent=1)
    write_tensors(f"{part}/model.safetensors", encoder.weights, {n: kind if w.ndim > 1 else "F32" for n, w in encoder.weights.items()})
    if os.path.isdir(path):
        os.replace(path, old := f"{part}.old")
        os.replace(part, path)
        shutil.rmtree(old)
    else:
        os.replace(part, path)


def load(path: str) -> Encoder:
    with open(f"{path}/config.json", encoding="utf-8") as f:
        given = json.load(f)
    config = Config(**{k: v for k, v in given.items() if k in Config.__dataclass_fields__})
    if any(given.get(k) for k in ("attention_bias", "mlp_bias", "norm_bias")):
        raise ValueError("biases are not known here")
    file = TensorFile(f"{path}/model.safetensors")
    return Encoder(config, {n.removeprefix("model."): file[n] for n in file.names() if n.removeprefix("model.") in shapes(config)})


# ---- texts to vectors


def _by_length(sequences: list[np.ndarray], most: int = 4096):
    """Numbers of sequences, longest first, in groups of about `most` tokens."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    group, n = [], 0
    for i in order:
        if group and n + len(sequences[i]) > most:
            yield group
            group, n = [], 0
        group.append(i)
        n += len(sequences[i])
    if group:
        yield group


def embed_ids(df: DataFrame, ids: str, encoder: Encoder, out: str = "vector", max_len: int = 8192) -> DataFrame:
    """df with a vector for each array of ids, of which max_len at most are read; null ids are an empty sequence."""
    shared = df.sparkSession.sparkContext.broadcast(encoder)
    at, names = df.columns.index(ids), [*df.columns, out]

    def run(batches):
        model = shared.value
        for batch in batches:
            sequences = [np.array((s or [])[:max_len], np.int64) for s in batch.column(at).to_pylist()]
            vectors = np.zeros((len(sequences), model.config.hidden_size), np.float32)
            for group in _by_length(sequences):
                vectors[group] = model.pooled([sequences[i] for i in group])
            ends = pa.array(np.arange(len(sequences) + 1, dtype=np.int32) * vectors.shape[1])
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def embed(df: DataFrame, text: str, encoder: Encoder, tokenizer: str, prompt: str = "", out: str = "vector", max_len: int = 8192) -> DataFrame:
    """df with a vector for each text behind its role's prompt. Rows are dealt out evenly first: a small file with many texts is work for all cores."""
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = df.repartition(tasks).withColumn("_ids", token_ids(F.concat(F.lit(prompt), F.coalesce(text, F.lit(""))), tokenizer))
    return embed_ids(own, "_ids", encoder, out, max_len).drop("_ids")


def mlp_activity(df: DataFrame, ids: str, encoder: Encoder) -> DataFrame:
    """(layer, neuron, activity): mean absolute value of each MLP neuron over all tokens, from sums by batch."""
    shared = df.sparkSession.sparkContext.broadcast(encoder)

    def run(batches):
        model = shared.value
        for batch in batches:
            sequences = [np.array(s or [], np.int64) for s in batch.column(0).to_pylist()]
            total, n = np.zeros((model.config.num_hidden_layers, model.config.intermediate_size)), sum(map(len, sequences))
            for group in _by_length(sequences):
                sums: list[np.ndarray] = []
                model.hidden([sequences[i] for i in group], sums)
                total += np.stack(sums)
            if n:
                layer, neuron = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
                yield pa.record_batch([pa.array(layer), pa.array(neuron), pa.array(total.ravel()), pa.array([n] * total.size, pa.int64())], ["layer", "neuron", "s", "n"])

    sums = df.select(ids).mapInArrow(run, "layer int, neuron int, s double, n bigint")
    return sums.groupBy("layer", "neuron").agg((F.sum("s") / F.sum("n")).alias("activity"))


def busiest(activity: DataFrame, encoder: Encoder, keep: int) -> list[list[int]]:
    """For each layer the `keep` neurons that add most: activity times the norm of what they write. As many rows as the model has neurons."""
    norms, best = encoder.output_norms(), [[] for _ in range(encoder.config.num_hidden_layers)]
    for r in activity.collect():
        best[r.layer].append((-r.activity * norms[r.layer][r.neuron], r.neuron))
    return [sorted(i for _, i in sorted(b)[:keep]) for b in best]
