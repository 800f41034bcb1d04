"""Labels, teacher answers, requests, windows and tokens, case by case."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyframe.functions import text as T
from tallyframe.functions import tokens
from tallyframe.operators import consensus, data, evaluate, labelled, requests, schema, spans, training, windows
from tallyframe.sources import examples


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_only_booleans_and_numbers_are_probabilities(spark):
    rows = spark.createDataFrame([(x,) for x in ("true", "false", "1", "0.25", '"0.5"', "1.5", "null", "{}", "[1]")], "v string")
    assert [r[0] for r in rows.select(schema.noul_target(F.parse_json("v"))).collect()] == [1.0, 0.0, 1.0, 0.25, None, None, None, None, None]


def test_option_index_of_all_kinds(spark):
    cases = [("noul", "true", 0), ("noul", "false", 1), ("noul", "0.5", 0), ("noul", "0.49", 1), ("choice", '"b"', 1), ("choice", '"z"', -1), ("choice", "1", -1), ("score", "1", 1), ("score", "1.5", -1), ("score", "2", -1), ("choice", '{"a":0.2,"b":0.7}', 1), ("choice", '{"a":0.4,"b":0.4}', 0), ("choice", '{"z":1}', -1), ("choice", "[1]", -1), ("choice", "null", -1)]
    got = one(spark, *[labelled.option_index(F.parse_json(F.lit(v)), kind, ["a", "b"]) for kind, v, _ in cases])
    assert list(got) == [want for *_, want in cases]


def test_first_object_with_the_key():
    of = consensus.find_object
    assert of('use {a} then {"p":1} ok {b}', "p") == '{"p":1}'
    assert of('```json\n{"q": {"p": 1}}\n``` and {"p": 2}', "p") == '{"p": 2}'
    assert of('{"q": {"p": 1}}', "q") == '{"q": {"p": 1}}' and of("none { here", "p") is None and of(None, "p") is None


def test_first_object_of_a_column(spark):
    assert one(spark, consensus.first_object(F.lit('so {"x":1}.'), "x"))[0] == '{"x":1}'


def test_one_option_takes_all(spark):
    got = one(spark, consensus.soft_choice(F.array(F.lit("a")), F.lit("a"), F.lit(0.3)), consensus.soft_choice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit("a"), F.lit(0.9)))
    assert got[0] == [1.0] and got[1] == pytest.approx([0.9, 0.05, 0.05])


@pytest.mark.parametrize("text, core", [("\tParis\n", "Paris"), ("rock ‘n’", "rock ‘n"), ("(a) b),", "a) b"), ("Ann (née B),", "Ann (née B)"), ("“Ann”", "Ann"), ("f(x)", "f(x)"), ("?!", "?!"), (" St. Inc. ", "St. Inc."), ("'tis'", "tis"), ("", "")])
def test_trim_of_signs_and_white_space(text, core):
    a, b = spans.trim(text)
    assert text[a:b] == core


def test_lines_lose_white_space_of_all_kinds(spark):
    got = one(spark, *[examples.line_inputs(F.lit(x)) for x in ("\thello\r", ' \t{"text":"x","context":"c"}\r\n', " {broken", '{"text":""}')])
    assert [tuple(x) for x in got] == [("hello", ""), ("x", "c"), ("{broken", ""), ('{"text":""}', "")]


def test_swapped_letters_have_capitals(spark):
    got = one(spark, T.leet(F.lit("Test AEIOST xyz")), T.homoglyph(F.lit("COPE xyXY")), T.TRANSFORMS["upper"](F.lit("straße é")))
    assert got[0] == "7357 431057 xyz" and got[1] == "СОРЕ " + "хуXY" and got[2] == "STRAßE É"


def test_rows_with_null_keys_stay(spark):
    df = spark.createDataFrame([(None, "x", 2), (None, "x", 1), ("a", None, 3), ("a", None, None), ("a", "x", 5)], "k string, t string, o int")
    assert sorted((str(r.k), str(r.t), r.o) for r in data.first_of(df, ["k", "t"], "o").collect()) == [("None", "x", 1), ("a", "None", 3), ("a", "x", 5)]


def test_head_without_rows_and_with_null_vectors(spark):
    kind = "v array<double>, y int"
    w, b = training.fit_head(spark.createDataFrame([], kind), "v", "y", 3)
    assert w.shape == (3, 0) and b.tolist() == [0, 0, 0]
    rows = [([1.0, 0.0], 0), (None, 1), ([0.0, 1.0], 1), ([1.0], 1), ([0.5, 0.0], None)]
    w, _ = training.fit_head(spark.createDataFrame(rows, kind).coalesce(1), "v", "y", 2, epochs=20)
    assert w[0, 0] > w[1, 0] and w[1, 1] > w[0, 1]


def test_picks_fall_where_the_running_sum_says(spark):
    rng = np.random.default_rng(3)
    flat = data.gazetteer(spark.createDataFrame([(f"v{i:04d}", float(w)) for i, w in enumerate(rng.pareto(1, 700) + 0.01)], "value string, weight double"))
    cum = sorted((r.cum, r.value) for r in flat.collect())
    draws = spark.createDataFrame([(i, float(u)) for i, u in enumerate([0.0, 0.999999, *rng.random(300)])], "i int, u double")
    got = data.picks(draws, flat, 8).collect()
    assert len(got) == 302
    for r in got:
        goal = r.u * cum[-1][0]
        assert r.value == next(v for c, v in cum if c > goal)


def test_state_of_each_form():
    of = requests.state_of
    assert of('"plain"', True) == {"text": "plain", "context": "", "error": None}
    assert of('{"text":"a","context":"b"}', True)["context"] == "b" and of('{"text":"a","context":null}', False)["text"] == "a"
    assert of('{"text":"a","x":1}', True)["text"] == '{"text":"a","x":1}' and of("[1, 2]", True)["text"] == "[1,2]"
    assert of('{"text":"a","context":"b"}', False)["error"] and of("{", True)["error"]


def test_criteria():
    of = requests.criterion_of
    assert of("n", '"short"')["description"] == "short" and of("n", None)["description"] == ""
    assert of("n", '{"description":"d","examples":["x","",3],"why":{"b":1}}') == {"name": "n", "description": 'd\n{"why":{"b":1}}', "examples": ["x"]}
    assert of("n", '{"examples":"one"}')["examples"] == ["one"] and of("n", "7")["description"] == "7"
    with pytest.raises(ValueError):
        requests.open_candidates("noul", [{"name": "a"}])
    assert requests.open_candidates("choice", [{"name": "a"}, {"name": "b", "description": "B"}], "Which?") == ["Which?\na", "Which?\nB"]


def test_embedding_inputs(spark):
    many = json.dumps(["x"] * (requests.MAX_INPUTS + 1))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(['"a"', '["a","b"]', "[]", '["a",null]', "[1]", "null", "", None, '{"a":1}', many])], "i int, v string")
    got = [(r.x.texts, r.x.error is None) for r in rows.select("i", requests.embed_inputs(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got[:2] == [(["a"], True), (["a", "b"], True)] and all(x == (None, False) for x in got[2:])


def test_vectors_survive_base64(spark):
    v = F.array(*[F.lit(x).cast("float") for x in (0.1, -2.5, 3e20)])
    got = one(spark, requests.floats_base64(v))[0]
    back = spark.createDataFrame([(got,), (None,)], "b string").select(requests.base64_floats(F.col("b"))).collect()
    assert back[0][0] == np.array([0.1, -2.5, 3e20], np.float32).tolist() and back[1][0] is None


def test_windows_give_every_token_once_and_mark_the_template(spark):
    df = spark.createDataFrame([(1, list(range(100)), [i % 3 for i in range(100)], 7.0), (2, [5], [1], 8.0), (3, [], [], None)], "k int, ids array<int>, tags array<int>, y double")
    cut = windows.cut(df, "k", "ids", 20, 4, [-7], [-8, -9])
    assert all(r.ids[0] == -7 and r.ids[-2:] == [-8, -9] and len(r.ids) <= 23 for r in cut.collect())
    assert {r.k: r.ids for r in windows.joined(cut, "k", "ids").collect()} == {1: list(range(100)), 2: [5], 3: []}
    trained = windows.training_windows(df, "k", "ids", "tags", "y", 20, [-7], [-8]).collect()
    assert all(r.tags[0] == r.tags[-1] == -1 and (r.target is None or r.w_idx == 0) for r in trained)
    assert all(i % 3 == t for r in trained if r.k == 1 for i, t in zip(r.ids[1:-1], r.tags[1:-1]))
    assert windows.window_size(512, 1, 2) == 509 and windows.window_size(2, 1, 2) == 1


def test_span_calibration_recovers_a_temperature(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    tag = [int(rng.choice(3, p=q)) for q in p]
    rows = spark.createDataFrame([((z[i] * 3).tolist(), tag[i]) for i in range(4000)], "z array<double>, tag int")
    assert evaluate.calibrate_spans(rows) == pytest.approx(3, rel=0.1)
    assert evaluate.calibrate_spans(rows.withColumn("tag", F.lit(-1)), 1.7) == 1.7
    assert evaluate.calibrate_spans(spark.createDataFrame([([1.0, 0.0], 0)], "z array<double>, tag int"), 1.7) == 1.7


def test_targets_tied_at_the_maximum_all_count(spark):
    rows = spark.createDataFrame([("q", [0.0, 2.0, 1.0], [0.5, 0.5, 0.0]), ("q", [3.0, 0.0, 0.0], [1.0, 0.0, 0.0])], "question string, z array<double>, t array<double>")
    m = evaluate.evaluate(rows, [schema.choice("q", "", "a", "b", "c")]).first()
    # option a: gold 2, found 1, right 1; option b: gold 1, found 1, right 1
    assert (m.n, m.accuracy) == (2, 1.0) and m.macro_f1 == pytest.approx((2 / 3 + 1) / 2)


def test_meta_union_and_order(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", {"k": "old"}) for i in range(5)], "ex_id int, split string, meta map<string,string>")
    got = df.select(labelled.with_meta(F.col("meta"), "k", F.lit("new")).alias("m"), labelled.with_meta(F.lit(None).cast("map<string,string>"), "x", F.lit("1")).alias("n")).first()
    assert got.m == {"k": "new"} and got.n == {"x": "1"}
    assert labelled.by_split(df, "a").count() == 2 and [r.ex_id for r in labelled.first_n(df, 2).collect()] == [0, 1]
    assert labelled.union_all(df, df.drop("meta"), df.select("ex_id")).where("meta IS NULL").count() == 10


@pytest.fixture(scope="module")
def byte_bpe():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_offsets_are_bytes(spark, byte_bpe):
    texts = ["Straße été 日本 x", "", None, " two  spaces"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokens.token_offsets(F.col("t"), byte_bpe).alias("o"), tokens.n_tokens(F.col("t"), byte_bpe).alias("n")).orderBy("i").collect()
    for r, t in zip(rows, texts):
        raw = (t or "").encode()
        assert len(r.o.ids) == len(r.o.starts) == r.n and all(0 <= a <= b <= len(raw) for a, b in zip(r.o.starts, r.o.ends))
        assert not raw or (r.o.starts[0], r.o.ends[-1]) == (0, len(raw))
    assert tokens.core_start("a  word", 1, 7) == 3 and tokens.core_start("a   ", 1, 4) == 1


def test_files_that_are_no_byte_bpe_are_refused():
    assert "type" in tokens.supported({"model": {"type": "WordPiece"}}) and tokens.supported({"model": {"type": "BPE", "dropout": 0.1}})
    assert tokens.supported({"model": {"type": "BPE"}, "pre_tokenizer": {"type": "Whitespace"}}) and tokens.supported({"model": {"type": "BPE"}, "pre_tokenizer": {"type": "ByteLevel"}}) is None


def test_pruning_keeps_ids_in_order_and_merges_whole(spark, byte_bpe, tmp_path):
    words = spark.createDataFrame([("lower", 3), ("low", 2), ("newest", 1)], "word string, n long")
    counts = {r.token: r.n for r in tokens.symbol_counts(words, byte_bpe).collect()}
    assert counts["l"] == 5 and counts["w"] == 6 and all(len(t) == 1 or counts[t] >= 1 for t in counts)
    vocab, ranked = tokens.vocabulary(spark, byte_bpe), tokens.merges(spark, byte_bpe)
    kept, left = tokens.pruned(vocab, ranked, spark.createDataFrame([(t,) for t in counts], "token string"))
    kept, left = kept.orderBy("id").collect(), left.orderBy("rank").collect()
    assert [r.id for r in kept] == list(range(len(kept))) and [r.old_id for r in kept] == sorted(r.old_id for r in kept)
    names = {r.token for r in kept}
    assert names == set(counts) and all({r.a, r.b, r.a + r.b} <= names for r in left) and len(left) >= 3
    # the pruned merges give the same final symbols
    small = {(r.a, r.b): r.rank for r in left}
    for w in ("lower", "low", "newest"):
        assert tokens.merge_symbols(list(w), small)[-1] == tokens.merge_symbols(list(w), tokens._ranks(byte_bpe))[-1]


def test_examples_of_several_files_and_back(spark, tmp_path):
    rows = [{"text": "a", "labels": {"q": True}, "family": "f"}, {"context": "c", "text": "b", "labels": {"q": 0.5, "t": {"x": 1}}, "meta": {"k": "v"}}]
    for name, part in (("one", rows[:1]), ("two", rows[1:])):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in part) + "\n\n")
    df = examples.read_examples(spark, f"{tmp_path}/one, {tmp_path}/two,")
    got = {r.text: r for r in df.select("text", "context", "family", "meta", F.to_json("labels").alias("l")).collect()}
    assert set(got) == {"a", "b"} and json.loads(got["b"].l) == rows[1]["labels"] and got["b"].meta == {"k": "v"} and got["a"].family == "f"
    examples.write_examples(df, str(tmp_path / "out"))
    again = {r.text: json.loads(r.l) for r in examples.read_examples(spark, str(tmp_path / "out")).select("text", F.to_json("labels").alias("l")).collect()}
    assert again == {"a": {"q": True}, "b": {"q": 0.5, "t": {"x": 1}}}
    (tmp_path / "bad").write_text('{"text": \n')
    with pytest.raises(Exception):
        examples.read_examples(spark, str(tmp_path / "bad")).collect()


def test_sources_of_other_kinds(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("# names\nAda\t3\t{\"k\":\"v\"}\nBo\n\n")
    got = {r.value: (r.weight, r.metadata) for r in examples.read_gazetteer(spark, str(tmp_path / "g.tsv")).collect()}
    assert got == {"Ada": (3.0, {"k": "v"}), "Bo": (1.0, None)}
    (tmp_path / "p.jsonl").write_text('{"query":"q","document":"d","negatives":["n"]}\n')
    assert examples.read_search_pairs(spark, str(tmp_path / "p.jsonl")).first().negatives == ["n"]
    (tmp_path / "e.jsonl").write_text('{"query":"","document":"d"}\n')
    with pytest.raises(Exception):
        examples.read_search_pairs(spark, str(tmp_path / "e.jsonl")).collect()
    (tmp_path / "s.json").write_text('[{"name":"q","kind":"choice","options":["a",{"name":"b","description":"B"}]}]')
    assert examples.load_schema(str(tmp_path / "s.json"))[0]["options"] == ["a", "b"]
    v = spark.createDataFrame([("x", [0.5, 1.0])], "id string, v array<double>")
    assert examples.vectors_json(v, "id", "v").first()[0] == '{"id":"x","embedding":[0.5,1.0]}'
