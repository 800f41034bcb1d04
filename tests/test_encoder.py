"""The encoder against a token-by-token reading of its definition, and what is built on it."""

import math

import numpy as np
import pytest
from tallyframe.operators import encoder as E

SMALL = E.Config(hidden_size=16, num_hidden_layers=4, num_attention_heads=2, intermediate_size=12, vocab_size=40, local_attention=6)


def model(config=SMALL, seed=0):
    weights = E.random_weights(config, seed)
    rng = np.random.default_rng(seed + 1)
    return E.Encoder(config, {n: w + rng.normal(0, 0.1, w.shape).astype(np.float32) for n, w in weights.items()})


def plain(m, ids):
    """One sequence in double precision, with loops."""
    c, w = m.config, {n: x.astype(float) for n, x in m.weights.items()}
    norm = lambda v, g: (v - v.mean()) / math.sqrt(v.var() + c.norm_eps) * g
    x = [norm(w["embeddings.tok_embeddings.weight"][i], w["embeddings.norm.weight"]) for i in ids]
    d = c.hidden_size // c.num_attention_heads

    def turn(v, t, theta):
        out = v.copy()
        for j in range(d // 2):
            a = t * theta ** (-2 * j / d)
            out[j], out[j + d // 2] = v[j] * math.cos(a) - v[j + d // 2] * math.sin(a), v[j + d // 2] * math.cos(a) + v[j] * math.sin(a)
        return out

    for k in range(c.num_hidden_layers):
        at, whole = f"layers.{k}.", k % c.global_attn_every_n_layers == 0
        theta = c.global_rope_theta if whole else c.local_rope_theta
        qkv = [w[at + "attn.Wqkv.weight"] @ (norm(v, w[at + "attn_norm.weight"]) if k else v) for v in x]
        heads = []
        for h in range(c.num_attention_heads):
            part = lambda t, j: qkv[t][j * c.hidden_size + h * d : j * c.hidden_size + (h + 1) * d]  # noqa: B023, E731
            for t in range(len(x)):
                seen = [s for s in range(len(x)) if whole or abs(s - t) <= c.local_attention // 2]
                z = np.array([turn(part(t, 0), t, theta) @ turn(part(s, 1), s, theta) / math.sqrt(d) for s in seen])
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                heads.append(sum(a * part(s, 2) for a, s in zip(p, seen)))
        x = [v + w[at + "attn.Wo.weight"] @ np.concatenate([heads[h * len(x) + t] for h in range(c.num_attention_heads)]) for t, v in enumerate(x)]
        for t, v in enumerate(x):
            z = w[at + "mlp.Wi.weight"] @ norm(v, w[at + "mlp_norm.weight"])
            a, b = z[: c.intermediate_size], z[c.intermediate_size :]
            x[t] = v + w[at + "mlp.Wo.weight"] @ (np.array([0.5 * y * (1 + math.erf(y / math.sqrt(2))) for y in a]) * b)
    return np.array([norm(v, w["final_norm.weight"]) for v in x])


def test_states_are_those_of_the_definition():
    m, rng = model(), np.random.default_rng(5)
    sequences = [rng.integers(0, 40, n) for n in (1, 17, 0, 5, 9)]
    got, border = m.hidden(sequences)
    for s, a, b in zip(sequences, border[:-1], border[1:]):
        if len(s):
            np.testing.assert_allclose(got[a:b], plain(m, s.tolist()), atol=2e-4)
    assert got.dtype == np.float32
    vectors = m.pooled(sequences)
    assert not vectors[2].any() and np.allclose(vectors[1], got[1:18].mean(0), atol=1e-6)
    first = E.Encoder(E.replace(m.config, classifier_pooling="cls"), m.weights).pooled(sequences)
    assert np.allclose(first[1], got[1]) and not first[2].any()


def test_gelu_is_exact_to_seven_digits():
    x = np.linspace(-6, 6, 4001)
    assert np.abs(E.gelu(x) - [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x]).max() < 1e-6


@pytest.mark.parametrize("change", [{"hidden_size": 18}, {"num_hidden_layers": 0}, {"hidden_activation": "relu"}, {"classifier_pooling": "max"}, {"vocab_size": 41}])
def test_sizes_that_do_not_fit_are_refused(change):
    m = model()
    with pytest.raises(ValueError):
        E.Encoder(E.replace(m.config, **change), m.weights)
    with pytest.raises(ValueError):
        m.hidden([np.array([40])])


@pytest.mark.parametrize("kind, near", [("F32", 1e-6), ("BF16", 0.2)])
def test_a_saved_model_gives_the_same_vectors(tmp_path, kind, near):
    m, ids = model(), [np.arange(12)]
    for seed in (3, 0):  # the second takes the first one's place
        E.save(model(seed=seed), str(tmp_path / "m"), kind)
    back = E.load(str(tmp_path / "m"))
    assert back.config == m.config and [p.name for p in tmp_path.iterdir()] == ["m"]
    np.testing.assert_allclose(back.pooled(ids), m.pooled(ids), atol=near)


def test_rows_of_a_table(spark):
    m, rng = model(), np.random.default_rng(8)
    rows = [(i, rng.integers(0, 40, int(n)).tolist(), "x") for i, n in enumerate(rng.integers(0, 30, 50))] + [(50, None, "x")]
    df = spark.createDataFrame(rows, "k int, ids array<int>, other string").repartition(4)
    got = {r.k: r.vector for r in E.embed_ids(df, "ids", m).collect()}
    want = m.pooled([np.array(r[1] or [], np.int64) for r in rows])
    assert len(got) == 51
    for k, v in got.items():
        np.testing.assert_allclose(v, want[k], atol=2e-5)
    assert E.embed_ids(df.where("false"), "ids", m).count() == 0
    short = {r.k: r.vector for r in E.embed_ids(df, "ids", m, max_len=3).collect()}
    np.testing.assert_allclose(short[0], m.pooled([np.array(rows[0][1][:3], np.int64)])[0], atol=2e-5)


def test_neurons_that_are_silent_can_go(spark):
    m = model()
    weights = dict(m.weights)
    for k in range(4):
        weights[f"layers.{k}.mlp.Wi.weight"] = weights[f"layers.{k}.mlp.Wi.weight"].copy()
        weights[f"layers.{k}.mlp.Wi.weight"][[2, 7, 9]] = 0  # these neurons' input
    m = E.Encoder(m.config, weights)
    rows = [(np.random.default_rng(i).integers(0, 40, 9).tolist(),) for i in range(20)]
    activity = E.mlp_activity(spark.createDataFrame(rows, "ids array<int>").repartition(3), "ids", m)
    assert {(r.layer, r.neuron) for r in activity.where("activity = 0").collect()} == {(k, i) for k in range(4) for i in (2, 7, 9)}
    keep = E.busiest(activity, m, 9)
    assert keep == [[0, 1, 3, 4, 5, 6, 8, 10, 11]] * 4
    ids = [np.array(r[0]) for r in rows]
    np.testing.assert_allclose(m.with_neurons(keep).pooled(ids), m.pooled(ids), atol=1e-5)
    with pytest.raises(ValueError):
        m.with_neurons([[0, 0]] * 4)


def test_a_smaller_vocabulary_keeps_its_rows():
    m, kept = model(), [3, 5, 11, 39]
    small = m.with_vocabulary(kept)
    np.testing.assert_allclose(small.pooled([np.array([0, 3, 2])]), m.pooled([np.array([3, 39, 11])]), atol=1e-6)


@pytest.mark.parametrize("scale", [1, 8])
def test_blocks_of_long_sequences_change_nothing(monkeypatch, scale):
    m, rng = model(), np.random.default_rng(5)
    m = E.Encoder(m.config, {n: w * scale if "Wqkv" in n else w for n, w in m.weights.items()})
    sequences = [rng.integers(0, 40, n) for n in (1, 17, 0, 5, 24)]
    monkeypatch.setattr(E, "BLOCK", 4)
    monkeypatch.setattr(E, "SCORES", 50)
    got, border = m.hidden(sequences)
    for s, a, b in zip(sequences, border[:-1], border[1:]):
        if len(s):
            np.testing.assert_allclose(got[a:b], plain(m, s.tolist()), atol=2e-4 * scale)


def test_texts_of_one_partition_are_dealt_to_all_cores(spark):
    import public_tokenizers
    from pyspark.sql import functions as F

    config = E.Config(hidden_size=16, num_hidden_layers=2, num_attention_heads=2, intermediate_size=12, vocab_size=50_257)
    rows = [(i, f"text {i}" if i else None) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, t string").coalesce(1)
    got = E.embed(df, "t", E.Encoder(config, E.random_weights(config, 1)), public_tokenizers.path("byte_bpe_50k.json"), "query: ").withColumn("at", F.spark_partition_id()).collect()
    assert sorted(r.k for r in got) == list(range(40)) and len({r.at for r in got}) >= spark.sparkContext.defaultParallelism
