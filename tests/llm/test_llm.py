"""The training-data operators against brute force, with the hard cases of their contracts."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tallyframe.llm.queries")
import public_tokenizers as PT  # noqa: E402
import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tallyframe.llm import bpe, embedding_dedup, exact_dedup, language_id, license_scan, lm_score, ngram_join, packing, quality, suffix_dedup  # noqa: E402

RND = random.Random(5)
WORDS = ["la", "den", "été", "the", "of", "mit", "license", "under", "Straße", "x1", "—", "don't"]
LONG = " ".join(RND.choice(WORDS) + str(i) for i in range(400))
EDIT = LONG.split(" ")
EDIT[200] = "changed"
PASSAGE = " ".join(RND.choice(WORDS) + str(i) for i in range(1000, 1060))
TEXTS = [LONG, LONG, " ".join(EDIT), None, "", "  \n", "Released under the MIT License. Apache License, Version 2.0; CC BY-NC 4.0", "a b", "a b", "ab" * 300, PASSAGE + " one tail", "head two " + PASSAGE, "日本語のテキスト", "привет мир", "UNDER THE MIT LICENSE"]


def docs(spark, texts=TEXTS):
    rows = [(i, t, "en" if i % 2 else "fr", i, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, h string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact(spark):
    got = {r["row"]["doc_id"]: r["dedup"] for r in exact_dedup.exact_dedup(docs(spark)).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[t or ""].append(i)
    for i, t in enumerate(TEXTS):
        g = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())
    assert exact_dedup.exact_dedup(docs(spark, []).where("false")).count() == 0


def test_exact_of_many_small_buckets_with_chains(spark, monkeypatch):
    """Buckets beyond the histogram's depth, repeated and null ids, and texts that share a key."""
    monkeypatch.setattr(exact_dedup, "DEPTH", 3)
    texts = [f"text {i % 90} " + "long " * (i % 7) for i in range(400)] + [TEXTS[0]] * 50 + [None, ""]
    rows = [(None if i % 11 == 0 else i // 2, t, i, "x") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row int, dedup string").repartition(6)
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(-1 if i is None else i)

    def holds():
        index = exact_dedup.build_index(d, bucket_bytes=300)[0].collect()
        assert len(index) == len(groups) == len({(r.bucket, r.h, r.chain) for r in index})
        for r in exact_dedup.exact_dedup(d, bucket_bytes=300).collect():
            g, i = groups[r.row.text or ""], -1 if r.row.doc_id is None else r.row.doc_id
            assert (r.dedup.group_size, r.dedup.kept, -1 if r.dedup.keep_id is None else r.dedup.keep_id) == (len(g), i == max(g), max(g))
        return index

    buckets = collections.Counter(r.bucket for r in holds())
    assert len(buckets) > 8 and {r.chain for r in holds()} == {0}
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.length(*c).cast("long"))
    assert max(r.chain for r in holds()) > 3


def test_directory_splits_overfull_buckets():
    weights = {i: 10 for i in range(0, 1 << 16, 256)} | {5: 5000}
    slots = exact_dedup.directory(weights, 400)
    load = collections.Counter()
    for i, w in weights.items():
        load[slots[i]] += w
    assert len(slots) == 1 << 16 and slots == sorted(slots) and all(w <= 400 << more for (_, more), w in load.items()) and slots[5][1] == 4


def test_license(spark):
    got = by_id(license_scan.scan(docs(spark)))
    assert len(got) == len(TEXTS)
    r = got[6]
    assert (r["n_base"], r["first_word"], r["base_labels"]) == (3, 1, "apache-2,cc-by-nc,mit")
    assert got[14]["base_labels"] == "mit" and got[3]["n_words"] == 0 and got[3]["score"] == 0
    for i, t in enumerate(TEXTS):
        assert got[i]["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))


def brute_license(text):
    """All columns of the scan for one text, with loops."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base, own, shares = [], [], [0.0]
    for label, phrase, template in license_scan.listed():
        k, grams = license_scan.K, len(template) - license_scan.K + 1
        votes = [(i - j, i, j) for i in range(len(words) - k + 1) for j in range(grams) if words[i : i + k] == template[j : j + k]]
        groups, before = [], None
        for d in sorted({v[0] for v in votes}):
            if phrase or before is None or d - before > license_scan.GAP:
                groups.append([])
            groups[-1] += [v for v in votes if v[0] == d]
            before = d
        for g in groups:
            last, n = -1, 0
            for _, _, j in sorted((i, j, j) for _, i, j in g):
                last, n = (j, n + 1) if j > last else (last, n)
            shares.append(round(n / grams, 6))
            if phrase and n == grams:
                base.append((g[0][0], label))
            elif not phrase and n / grams >= 0.8:
                own.append(label)
    starts = [d for d, _ in base]
    names = {label for _, label in base}
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(names | set(own))), max(shares)


def test_license_of_every_column(spark):
    rnd = random.Random(12)
    whole = [" ".join(words) for _, _, words in license_scan.listed()]
    texts = list(TEXTS)
    for k in range(120):
        w = rnd.choice(whole).split()
        kind = k % 4
        if kind == 1:  # some words put in and left out
            for _ in range(rnd.randrange(1, 4)):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randrange(2)] = ["extra"] * rnd.randrange(3)
        elif kind == 2:  # pieces in another order
            at = rnd.randrange(1, len(w))
            w = w[at:] + w[:at]
        elif kind == 3:
            w = w[: rnd.randrange(len(w))] * 2
        texts.append(" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(20))) + " " + rnd.choice([", ", " "]).join(w).upper() + " tail")
    got = by_id(license_scan.scan(docs(spark, texts)))
    keys = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert [tuple(got[i][k] for k in keys) for i in range(len(texts))] == [brute_license(t) for t in texts]
    assert len({got[i]["labels"] for i in range(len(texts))}) > 8


def test_bpe(spark):
    ranks = bpe.load_ranks(PT.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = TEXTS + [*thue_morse(2048), "z" * 500, "".join(RND.choice("ab é'sѣ\t\n!1") for _ in range(300))]
    got = by_id(bpe.encode_documents(docs(spark, texts), PT.path("byte_bpe_multi_50k.tiktoken"), with_ids=True))
    for i, t in enumerate(texts):
        assert got[i]["ids"] == enc.encode_ordinary(t or "") and bytes(got[i]["decoded"]).decode() == (t or "")
    words = sorted({w for t in TEXTS if t for w in t.split(" ") if w})
    out = spark.createDataFrame([(w.encode(),) for w in words], "word binary").select("word", bpe.folded(F.col("word"), ranks).alias("ids")).collect()
    assert all(r.ids == enc._core_bpe.encode_single_piece(bytes(r.word)) for r in out)


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PT.path("byte_bpe_50k.json"))
    texts = TEXTS + [*thue_morse(1024), "word " * 3000, "a<|endoftext|>b"]
    rows = packing.pack_documents(docs(spark, texts)).collect()
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        end = 0
        for a, n in sorted(s):
            assert a == end
            end += n
        assert end <= 1024


def thue_morse(n):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("collide", [False, True])
def test_pieces_whose_hashes_collide_keep_their_own_ids(monkeypatch, collide):
    """Words whose polynomial hashes are equal, and all words under four keys, in batches one after another."""
    from tallyframe.llm import _pretok as P, _vec as V
    from tokenizers import Tokenizer
    import pyarrow as pa

    texts = [*thue_morse(1024), *thue_morse(2048), "the cat", "the dog " * 5, "a b c d e f", "zebra zebra", "x" * 17 + " " + "x" * 16 + "y", ""]
    if collide:
        plain = P.codes
        monkeypatch.setattr(P, "codes", lambda *a: plain(*a)._replace(key=plain(*a).size.astype(V.U64) % V.U64(4)))
    ranks = bpe.load_ranks(PT.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tok = Tokenizer.from_file(PT.path("byte_bpe_50k.json"))
    for coder, exact in ((bpe.RankCoder(ranks), enc.encode_ordinary), (packing.Coder(PT.path("byte_bpe_50k.json")), lambda t: tok.encode(t, add_special_tokens=False).ids)):
        for part in (texts, texts[::-1], texts[::2], texts):
            ids, border = coder.encode(*V.strings(pa.array(part)), None)
            assert [ids[a:b].tolist() for a, b in zip(border[:-1], border[1:])] == [exact(t) for t in part]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_words_have_the_ids_of_tokenizers(file):
    """Words of all characters of up to three bytes, more than go at once, also by a file that is not byte-level alone."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PT.path(file))
    words = [c.encode() for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff"] + [(" " * RND.randint(0, 1) + "".join(RND.choices("aeinrst0é日🙂", k=RND.randint(1, 60)))).encode() for _ in range(3000)]
    flat, size = packing.Coder(PT.path(file)).ids_of(words)
    ends = np.cumsum(size).tolist()
    assert [flat[b - n : b].tolist() for b, n in zip(ends, size.tolist())] == [tok.encode(w.decode(), add_special_tokens=False).ids for w in words]


def test_new_words_do_not_take_an_encoding_each():
    """Encoding each new word by itself took most of the time of op4_packing."""
    from tokenizers import Tokenizer

    class Counted:
        def __init__(self, tok):
            self.tok = tok

        def encode_batch_fast(self, texts, **how):
            made.append(len(texts))
            return self.tok.encode_batch_fast(texts, **how)

    made, coder = [], packing.Coder(PT.path("byte_bpe_50k.json"))
    for name, part in list(vars(coder).items()):
        if isinstance(part, Tokenizer):
            setattr(coder, name, Counted(part))
    assert len(coder.ids_of([b" w%d" % i for i in range(5000)])[1]) == 5000
    assert 0 < sum(made) <= 5


def test_plan_is_best_fit_decreasing():
    for _ in range(100):
        size = RND.choice([7, 16, 64])
        lengths = [RND.randint(1, size) for _ in range(RND.randint(0, 80))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms[rooms.index(min(fit))] -= n
            else:
                rooms.append(size - n)
        used = collections.Counter()
        for n, _, many, base, _ in packing.plan(collections.Counter(lengths), size):
            for k in range(many):
                used[base + k] += n
        assert sorted(size - v for v in used.values()) == sorted(rooms)


def test_ngram_join(spark):
    texts = TEXTS + [LONG + f" tail{i}" for i in range(5)]
    sets = []
    for t in texts:
        w = [x.lower() for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    got = by_id(ngram_join.ngram_join(docs(spark, texts)))
    for i, a in enumerate(sets):
        assert got[i]["n_links"] == sum(1 for j, b in enumerate(sets) if i != j and a and 9 * len(a & b) >= 4 * (len(a) + len(b)))
    assert got[2]["class_id"] == 0 and got[8]["class_id"] == 7 and got[4]["class_id"] == 4


def near_copies(rnd, groups, each, words=60):
    """Groups of texts that share a frequent passage; a text differs from its group's first by up to five words."""
    passage = " ".join(f"p{k}" for k in range(40))
    out = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(words)]
        for _ in range(each):
            w = list(base)
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(words)] = f"z{rnd.random()}"
            out.append(" ".join(w[: words - rnd.randrange(4)]) + " " + passage)
    return out


def brute_links(texts):
    """For each text the texts linked to it, and the least index it reaches."""
    sets = []
    for t in texts:
        w = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").lower().encode())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    near = [[j for j, b in enumerate(sets) if i != j and a and b and 9 * len(a & b) >= 4 * (len(a) + len(b))] for i, a in enumerate(sets)]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        todo = [i] if least[i] == i else []
        while todo:
            for j in near[todo.pop()]:
                if least[j] > i:
                    least[j] = i
                    todo.append(j)
    return near, least


@pytest.mark.parametrize("small, block, large", [(128, 512, 16_384), (8, 16, 32), (8, 16, 10_000)])
def test_ngram_join_of_many_near_copies(spark, monkeypatch, small, block, large):
    """More sets at a node than are compared all with all, so that leaders, descents and several blocks take part."""
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LARGE", large)
    texts = near_copies(random.Random(3), 2, 220) + near_copies(random.Random(4), 40, 3, 20)
    near, least = brute_links(texts)
    got = by_id(ngram_join.ngram_join(docs(spark, texts)))
    assert [got[i]["n_links"] for i in range(len(texts))] == list(map(len, near))
    assert [got[i]["class_id"] for i in range(len(texts))] == least


def shuffled(spark, run):
    """What run() returns, and the bytes that its stages wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: (lambda seq: [seq.apply(i) for i in range(seq.size())])(store.stageList(None, False, False, getattr(spark._jvm, "scala").Array.emptyDoubleArray(), None))
    before = {x.stageId() for x in stages()}
    out = run()
    return out, sum(x.shuffleWriteBytes() for x in stages() if x.stageId() not in before)


def test_ngram_join_moves_texts_of_candidates_only(spark):
    """Texts that are in no proposed pair stay where they are, where no join is a broadcast for its size."""
    rnd = random.Random(11)
    texts = [" ".join(f"{rnd.getrandbits(64):x}" for _ in range(1000)) for _ in range(300)]
    texts += [t + " tail" for t in texts[:10]]
    d = docs(spark, texts).repartition(4).localCheckpoint()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got, moved = shuffled(spark, lambda: by_id(ngram_join.ngram_join(d)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [i for i in range(310) if got[i]["n_links"]] == [*range(10), *range(300, 310)]
    assert 0 < moved < sum(map(len, texts)) / 4


@pytest.mark.parametrize("bits", [1 << 25, 1 << 16])
def test_may_match_loses_no_match(spark, monkeypatch, bits):
    """Null matches null; a map that is full lets rows pass."""
    from tallyframe.llm import _shared

    monkeypatch.setattr(_shared, "BITS", bits)
    rows = spark.range(200_000).selectExpr("nullif(id, 7) AS k", "cast(id AS string) AS s")
    for key in ("k", "s"):
        some = rows.where("k IS NULL OR k % 3 = 0").withColumnRenamed(key, "o")
        out = _shared.may_match(rows, key, some, "o")
        assert out.where("k IS NULL OR k % 3 = 0").count() == 66_668
        assert out.count() < 67_500 if bits == 1 << 25 else out.count() > 66_668
    assert _shared.may_match(rows, "k", rows.where("false"), "k").count() == 0


def test_suffix(spark):
    texts = TEXTS + ["q" * 250]
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[s : s + 200] for t in raw for s in range(len(t) - 199))
    got = {r["row"]["doc_id"]: r for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    for i, t in enumerate(raw):
        gone = set()
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                gone |= set(range(s, s + 200))
        assert bytes(got[i]["kept_text"]) == bytes(b for k, b in enumerate(t) if k not in gone)
        assert got[i]["n_removed"] == len(gone) and got[i]["n_spans"] == sum(k - 1 not in gone for k in gone)


def test_embeddings(spark):
    base = np.random.default_rng(2).normal(size=(30, 16))
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i % 5] + 0.01 * (i + 1) / 60], (i % 5) % 3) for i in range(60)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, rows[0][1], None), (204, rows[0][1], 0), (205, [1.0, 2.0], 0), (206, [2.0, 4.0], 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    fine = {i: (np.array(v), label) for i, v, label in rows if v and label is not None and np.isfinite(v).all() and any(v)}
    near = {i: {j for j, (w, m) in fine.items() if j != i and m == label and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98} for i, (v, label) in fine.items()}
    for i, *_ in rows:
        reach, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near.get(i, ())), min(reach), i == min(reach))


def test_embeddings_over_many_lists_and_blocks(spark, monkeypatch):
    """More than one list, probes of other lists, and several blocks of a list, against all pairs."""
    monkeypatch.setattr(embedding_dedup, "LIST", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 12))
    x = np.concatenate([base[i % 60] + rng.normal(size=(1, 12)) * (0.02 + 0.2 * (i % 3)) for i in range(500)]).astype(np.float32)
    x[::50] = x[7]
    rows = [(i, [float(v) for v in x[i]], i % 2) for i in range(len(x))]
    got = {r["vec_id"]: r for r in embedding_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    near = (unit @ unit.T >= 0.98) & (np.arange(500)[:, None] % 2 == np.arange(500) % 2) & ~np.eye(500, dtype=bool)
    assert 1000 < near.sum() < 20000
    assert [got[i]["n_links"] for i in range(500)] == near.sum(1).tolist()
    least = np.arange(500)
    while True:
        new = np.minimum(least, np.where(near, least[None], 500).min(1))
        if (new == least).all():
            break
        least = new
    assert [got[i]["component_id"] for i in range(500)] == least.tolist()


def test_language(spark):
    en, fr = "the of and with that this from", "le la des une qui avec dans"
    texts = [" ".join(RND.choice((fr if i % 2 == 0 else en).split()) for _ in range(30)) for i in range(60)] + [None, "", "123 ...", (en + " ") * 5 + (fr + " ") * 2]
    d = docs(spark, texts)
    model = language_id.fit(d.where("doc_id < 50"))
    got = {r["row"]["doc_id"]: r for r in language_id.identify(d, model).collect()}
    assert all(got[i]["lang_pred"] == ("fr" if i % 2 == 0 else "en") for i in range(60))
    assert [got[i]["lang_pred"] for i in (60, 61, 62)] == ["und"] * 3 and [tuple(s) for s in got[63]["lang_spans"]] == [("en", 0, 35), ("fr", 35, 49)]
    assert [tuple(s) for s in got[60]["lang_spans"] + got[62]["lang_spans"]] == []
    clash = d.withColumn("lang_pred", F.lit(1)).withColumn("lang_spans", F.lit("x")).withColumn("row", F.lit(2)).withColumn("lang_score", F.lit(3))
    assert sorted(r["lang_pred"] for r in language_id.identify(clash, model).collect()) == sorted(r["lang_pred"] for r in got.values())
    assert language_id.identify(d.where("false"), model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(d, language_id.fit(d.where("false"))).collect()} == {"und"}


def test_language_path_is_the_best_of_all(spark):
    """Viterbi over words against every labelling, by score less a penalty for each switch."""
    import itertools
    import pyarrow as pa

    model = language_id.Model(["a", "b", "c"], np.random.default_rng(4).integers(0, 50, (3, 1 << language_id.BITS)).astype(float), np.ones((3, language_id.N_SCRIPTS)))
    texts = [" ".join("".join(RND.choice("abcdé") for _ in range(RND.randint(1, 9))) for _ in range(n)) for n in (1, 2, 5, 7, 7, 6)]
    from tallyframe.llm import _vec as V

    score, _, first = model.word_scores(*V.strings(pa.array(texts)))
    label = model.spans(score, first)
    for a, b in zip(first[:-1], first[1:]):
        worth = lambda path: sum(score[a + i, k] for i, k in enumerate(path)) - language_id.SWITCH * sum(x != y for x, y in zip(path, path[1:]))
        assert worth(label[a:b]) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=b - a))), abs=1e-3)


def test_lm_score(spark):
    target = lm_score.fit(docs(spark, ["alpha beta gamma"] * 20))
    background = lm_score.fit(docs(spark, ["delta epsilon zeta"] * 20))
    got = by_id(lm_score.score(docs(spark, ["alpha beta gamma", "delta epsilon zeta", None]), target, background, in_background=False))
    assert got[0]["score"] < 0 < got[1]["score"] and got[2]["score"] is None and got[2]["n_tokens"] == 0


def test_lm_score_counts_every_event(spark, monkeypatch):
    """More distinct words and bigrams than any fixed table of 2^18 and 2^20 could keep apart, against exact counts."""
    monkeypatch.setattr(lm_score, "BLOCK", 1 << 20)
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(10**7)}" for _ in range(3000)) for _ in range(400)]
    texts += texts[:2] + [None, "", "The the THE, the", "x"] + ["the w5 " + " ".join(f"w{rnd.randrange(30)}" for _ in range(200)) for _ in range(40)]
    aim = texts[:3] + texts[-20:] + ["the only words of the target", None]
    split = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())
    models = []
    for corpus in (aim, texts):
        one, two = collections.Counter(), collections.Counter()
        for w in map(split, corpus):
            one.update(w)
            two.update(zip(w, w[1:]))
        models.append((one, two, sum(one.values())))
    assert len(models[1][0]) > 1 << 18 and len(models[1][1]) > 1 << 20
    vocabulary = len(models[0][0].keys() | models[1][0].keys()) + 1

    def loss(w, model, own):
        one, two, total = model
        out = 0.0
        for i, x in enumerate(w):
            p = (one[x] - own + 0.1) / (total - own + 0.1 * vocabulary)
            seen = one[w[i - 1]] - own if i else 0
            if seen > 0:
                p = 0.6 * (two[w[i - 1], x] - own) / seen + 0.4 * p
            out -= np.log(p)
        return out / len(w)

    d = docs(spark, texts)
    aimed = lm_score.fit(docs(spark, aim))
    got, same = by_id(lm_score.score(d, aimed)), by_id(lm_score.score(d, aimed, lm_score.fit(d)))
    assert got == same and len(got) == len(texts)
    for i, t in enumerate(texts):
        w = split(t)
        assert got[i]["n_tokens"] == len(w)
        if w:
            expected = loss(w, models[0], 0), loss(w, models[1], 1)
            assert (got[i]["target_loss"], got[i]["background_loss"]) == pytest.approx(expected, abs=1e-6)
            assert got[i]["score"] == pytest.approx(expected[0] - expected[1], abs=1e-6)
        else:
            assert got[i]["score"] is None


HARD = [(1, None, "de"), (1, None, "de"), (None, "", None), (None, "one two three four five six", "en"), (None, "one two three four five six", "en"), (2, "word " * 60_000, "en"), (3, "a b", "en"), (3, "a b", "fr"), (4, "x" * 300, "en"), (4, "x" * 300, "en"), (5, "— … ", None)]


def hard(spark, rows=HARD):
    """Null and repeated ids, null, empty, equal and very long texts, and columns named as those that operators make."""
    kind = "doc_id long, text string, lang string, row string, h int, u int, g int, id int, fp int, n int, block int, dedup int, lang_pred int, score int, bucket int, spans int, kept_text int, class_id int, component int"
    return spark.createDataFrame([(*r, "own", *range(15)) for r in rows], kind)


@pytest.mark.parametrize("rows", [HARD, []])
def test_hard_cases_of_every_operator(spark, rows):
    d = hard(spark, rows)
    path = PT.path("byte_bpe_multi_50k.tiktoken")
    texts = [(i, t or "") for i, t, _ in rows]
    n_of = collections.Counter(t for _, t in texts)
    out = lm_score.score(d, lm_score.fit(hard(spark, HARD))).collect()
    assert len(out) == len(rows) and all((r.score is None) == (r.n_tokens == 0) for r in out)
    out = suffix_dedup.remove_repeats(d).collect()
    assert len(out) == len(rows) and all(r.row["row"] == "own" for r in out)
    assert sorted(r.n_removed for r in out) == sorted(len(t.encode()) if len(t) >= 200 else 0 for _, t in texts)
    out = ngram_join.ngram_join(d).collect()
    assert len(out) == len(rows) and sorted(r.n_links for r in out) == sorted(n_of[t] - 1 if re.search(r"\w|—|…", t) else 0 for _, t in texts)
    out = packing.pack_documents(d).collect()
    ids = lambda p: sum(r["length"] for r in p)
    assert (sum(r["start"] == 0 for r in out), ids(out)) == (len(rows), sum(r["doc_tokens"] for r in out if r["start"] == 0))
    assert sorted(r["n_words"] for r in license_scan.scan(d).collect()) == sorted(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)) for _, t in texts)
    out = bpe.encode_documents(d, path).collect()
    assert sorted(r.decoded_sha256 for r in out) == sorted(hashlib.sha256(t.encode()).hexdigest() for _, t in texts)
    out = exact_dedup.exact_dedup(d).collect()
    assert len(out) == len(rows) and all(r.dedup.group_size == n_of[r.row.text or ""] and r.row.dedup == 7 for r in out)
    model = language_id.fit(hard(spark, HARD).where("lang IS NOT NULL"))
    out = language_id.identify(d, model).collect()
    assert len(out) == len(rows) and all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.row.text or "")) for r in out)


def test_hard_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int, key string, list int, v int, home int, links int"
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [2.0, 0.0], 1), (None, None, 1), (3, [], 1), (4, [1.0, None], 1), (5, [0.0, 0.0], 1), (6, [1.0, 0.0], None), (7, [1e30, 0.0], 1)]
    d = spark.createDataFrame([(*r, "own", 1, 2, 3, 4) for r in rows], kind)
    got = sorted(((-1 if r.vec_id is None else r.vec_id), r.n_links) for r in embedding_dedup.near_dedup(d).collect())
    assert got == [(-1, 0), (-1, 3), (1, 3), (1, 3), (3, 0), (4, 0), (5, 0), (6, 0), (7, 3)]
    assert embedding_dedup.near_dedup(d.where("false")).count() == 0


def test_held_out_rows_of_the_given_tables(spark):
    """Language and quality of rows that nothing was learned from."""
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang").collect()}
    rows = [r for r in language_id.op8_language_id(spark, d).collect() if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert len(rows) > 200 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) > 0.98
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in quality.op10_quality(spark, d).collect() if r.held_out and r.doc_id in quality_of]
    good, bad = ([r.score for r in rows if quality_of[r.doc_id] == k] for k in (1, 0))
    assert min(len(good), len(bad)) > 5 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95


def test_gam_scores_are_sums_of_its_tables():
    """The score of the model against bin after bin of its tables."""
    x = np.random.default_rng(3).normal(size=(800, len(quality.NAMES))).astype(np.float32)
    gam = quality.Gam(x, (x[:, 2] + x[:, 3] * x[:, 4] > 0).astype(int))
    score = gam.score(x)
    assert score.shape == (800,) and (score >= 0).all() and (score <= 1).all()
    assert gam.pairs
    for row, got in list(zip(x, score))[:60]:
        at = lambda cuts, v: sum(1 for c in cuts if c <= v)
        f = gam.base + sum(gam.main[j][at(gam.cuts[j], row[j])] for j in range(len(row)))
        f += sum(lut[at(gam.coarse[a], row[a]), at(gam.coarse[b], row[b])] for a, b, lut in gam.pairs)
        assert got == pytest.approx(1 / (1 + np.exp(-f)), abs=1e-9)
    # rows are scored by themselves, in whatever order and company
    order = np.random.default_rng(4).permutation(800)
    np.testing.assert_allclose(gam.score(x[order]), score[order], rtol=0, atol=1e-12)
    np.testing.assert_allclose([gam.score(x[i : i + 1])[0] for i in range(20)], score[:20], rtol=0, atol=1e-12)


def test_gam():
    x = np.random.default_rng(0).normal(size=(3000, len(quality.NAMES))).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    s = quality.Gam(x[:2000], y[:2000]).score(x[2000:])
    assert ((s > 0.5) == y[2000:]).mean() > 0.85  # only a pair can tell
    assert abs(quality.Gam(x[:10], np.ones(10)).score(x[:2])[0] - 11 / 12) < 1e-9


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    os.makedirs(tmp_path / "d")
    texts = TEXTS + [" ".join(RND.choice(["the", "of", "with"]) + str(RND.random()) for _ in range(60)) for _ in range(6)]
    rows = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "d/documents.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "d")).collect()}
    assert kept.isdisjoint({0, 3, 4, 5, 7}) and set(range(len(TEXTS), len(texts))) <= kept and 1 in kept and 2 not in kept


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's whole output, bytes and pieces, from the output of the one before."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    os.makedirs(tmp_path / "d")
    texts = TEXTS + near_copies(random.Random(8), 3, 8) + near_copies(random.Random(8), 1, 4)
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d/documents.parquet"))
    docs_now, have = spark.read.parquet(str(tmp_path / "d/documents.parquet")), {r[0]: r for r in rows}
    steps = dict(corpus_pipeline.STAGES)

    def take(name):
        out = corpus_pipeline.table(steps[name](spark, docs_now, str(tmp_path / "d")), f"test-{name}")
        return out, {r["doc_id"]: tuple(r) for r in out.collect()}

    docs_now, got = take("language_id")
    assert got == {i: r for i, r in have.items() if i in got} and {i for i in have if i not in got} >= {3, 4, 5}
    have = got
    docs_now, got = take("exact_dedup")
    last = {r[1]: i for i, r in sorted(have.items())}
    assert got == {i: r for i, r in have.items() if last[r[1]] == i} and len(got) < len(have)
    have = got
    docs_now, got = take("near_dedup")
    ids = sorted(have)
    least = brute_links([have[i][1] for i in ids])[1]
    assert got == {i: have[i] for k, i in enumerate(ids) if least[k] == k} and len(got) < len(have)
    have = got
    docs_now, got = take("passages")
    raw = {i: r[1].encode() for i, r in have.items()}
    seen = collections.Counter(t[s : s + 200] for t in raw.values() for s in range(len(t) - 199))
    expected = {}
    for i, t in raw.items():
        gone = {k for s in range(len(t) - 199) if seen[t[s : s + 200]] > 1 for k in range(s, s + 200)}
        text = bytes(b for k, b in enumerate(t) if k not in gone).decode()
        expected[i] = (i, text, *have[i][2:4], len(text))
    assert got == expected and any(expected[i][1] != have[i][1] for i in have)
    pieces = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path / "d")).collect():
        pieces[r["doc_id"]].append(r)
    tok = Tokenizer.from_file(PT.path("byte_bpe_50k.json"))
    assert set(pieces) == set(expected)
    for i, own in pieces.items():
        ids, at = [*tok.encode(expected[i][1], add_special_tokens=False).ids, 0], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
