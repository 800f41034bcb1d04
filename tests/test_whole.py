"""Cases that the generated tables don't have."""

import random
import zlib

import numpy as np
import pytest

from tallyframe.functions import tokens
from tallyframe.operators import open_mode, spans
from tallyframe.plans import registry


def test_conversation_pairs_with_gaps_and_repeated_turns(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(c, t, "user", f"{c}.{t}") for c in range(5) for t in rnd.sample(range(6000), 200)]
    rows += [(9, 1, "user", "a"), (9, 1, "user", "b"), (9, 2, "user", None), (9, 5000, "user", "d"), (10, 3, "user", None), (10, 4000, "user", "e")]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    expected, last = [], {}
    for c, t, _, text in sorted(rows, key=lambda r: (r[0], r[1], r[3] or "")):
        expected.append((c, t, last.get(c), text))
        last[c] = text
    got = [tuple(r) for r in registry.queries()["conversation_pairs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", ["open_nearest", "open_accuracy_by_label", "open_unmatched", "open_score_level"])
def test_more_prototypes_than_are_broadcast(spark, monkeypatch, name):
    run = lambda: sorted(map(tuple, registry.queries()[name](spark, "/root/testdata/sf0.001").collect()), key=repr)
    expected = run()
    monkeypatch.setattr(open_mode, "MAX_BROADCAST", 3)
    assert run() == expected


def test_viterbi_decode_covers_whole_texts(spark, tmp_path):
    rnd = random.Random(6)
    texts = ["", None, "one", " two  words\n"] + [" ".join(rnd.choice(["la", "été", "x1", "of"]) + str(rnd.randrange(999)) for _ in range(n)) for n in (13, 700, 20_000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.tags for r in registry.queries()["viterbi_decode"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        h = np.array([zlib.crc32(w.encode()) % 1000 for w in (t or "").split()], float)
        z = np.sin(h[:, None] * np.arange(1, 6)) * 3
        assert got[i] == spans.viterbi(z - np.log(np.exp(z).sum(1, keepdims=True)), 0.5), i


def test_viterbi_of_many_is_viterbi_of_each():
    rnd = np.random.default_rng(2)
    lengths = rnd.integers(0, 9, 50)
    logp = np.log(rnd.dirichlet(np.ones(7), lengths.sum())).round(1)
    ends = np.cumsum(lengths)
    assert spans.viterbi_all(logp, lengths, 0.3).tolist() == [t for n, e in zip(lengths, ends) for t in spans.viterbi(logp[e - n : e], 0.3)]


def test_encodings_are_held_for_a_bounded_number_of_characters(monkeypatch):
    import public_tokenizers

    path, held = public_tokenizers.path("byte_bpe_50k.json"), []
    real = tokens.opened(path)

    class Seen:
        def encode_batch_fast(self, given, add_special_tokens):
            held.append(sum(map(len, given)) if len(given) > 1 else 0)
            return real.encode_batch_fast(given, add_special_tokens=add_special_tokens)

    monkeypatch.setattr(tokens, "opened", lambda path: Seen())
    texts = ["", "été " * 40_000, *(f"word {i} of a text " * (i % 90) for i in range(2000)), "z" * (tokens.AT_ONCE + 1), "end"]
    got = [e.ids for e in tokens.encodings(texts, path)]
    assert got == [real.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(held) > 3 and max(held) <= tokens.AT_ONCE


def test_token_counts_of_one_batch(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", None, "one", "héllo wörld " * 30_000, *(f" {i} words" * (i % 40) for i in range(500))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: tokens.opened(path).encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in registry.queries()["token_counts"](spark, str(tmp_path)).collect()} == {i: len(w) for i, w in want.items()}
    assert {r.doc_id: r.ids for r in df.select("doc_id", tokens.token_ids("text", path).alias("ids")).collect()} == want


def test_viterbi_in_groups_holds_a_bounded_number_of_tokens(monkeypatch):
    rnd, seen, real = np.random.default_rng(3), [], spans.viterbi_all
    monkeypatch.setattr(spans, "AT_ONCE", 64)
    monkeypatch.setattr(spans, "viterbi_all", lambda z, n, bias: seen.append(n.tolist()) or real(z, n, bias))
    for lengths in (rnd.integers(0, 40, 60), np.array([0, 200, 1, 64, 0, 65]), np.zeros(3, int), np.zeros(0, int)):
        logp = np.log(rnd.dirichlet(np.ones(5), int(lengths.sum()))).round(1).reshape(-1, 5)
        assert spans.viterbi_groups(logp, lengths, 0.3).tolist() == real(logp, lengths, 0.3).tolist()
    assert all(len(n) == 1 or sum(n) <= 64 for n in seen)
