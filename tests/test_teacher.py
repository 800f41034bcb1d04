"""Labelling by a teacher: what is asked, what is kept, and what answers mean."""

import json

from pyspark.sql import functions as F
from tallyframe.operators import schema, teacher

QUESTIONS = [schema.noul("spam", "Is it spam?"), schema.choice("topic", "Which?", "sport", "art"), schema.score("heat", "How hot?", "low", "mid", "top")]


def examples(spark, rows):
    return spark.createDataFrame(rows, "ex_id int, text string, context string, l string").select("ex_id", "text", "context", F.parse_json("l").alias("labels"))


ROWS = [(1, "buy now", "", "{}"), (2, "buy now", "", "{}"), (3, "a goal", "news", '{"spam":false}'), (4, "done", "", '{"spam":1,"topic":"art","heat":2}'), (5, "fail", "", "{}")]


def made_client():
    """A function of a function: it goes to workers by its code, as they don't have this file."""

    def client(system, user, schema):
        import json

        if "fail" in user:
            raise TimeoutError
        assert "spam (noul)" in system and set(json.loads(schema)["required"]) == {"spam", "topic", "heat"}
        return 'Sure: {"spam": {"p": 0.9}, "topic": {"option": "sport", "confidence": 0.8}, "heat": {"level": "mid"}} {x}'

    return client


def test_labels_come_from_answers_and_old_ones_stay(spark):
    cache = spark.createDataFrame([], "key string, response string")
    done, kept = teacher.label(examples(spark, ROWS), QUESTIONS, made_client(), cache)
    got = {r.ex_id: json.loads(r.l) for r in done.select("ex_id", F.to_json("labels").alias("l")).collect()}
    fresh = {"spam": 0.9, "topic": {"sport": 0.8, "art": 0.2}, "heat": "mid"}
    rounded = lambda x: json.loads(json.dumps(x), parse_float=lambda f: round(float(f), 9))
    assert {k: rounded(v) for k, v in got.items()} == {1: fresh, 2: fresh, 3: fresh | {"spam": False}, 4: {"spam": 1, "topic": "art", "heat": 2}, 5: {}}
    assert kept.count() == 2  # equal requests are one; the failed one has no response


def test_what_is_cached_is_not_asked_and_the_budget_holds(spark):
    def never(system, user, schema):
        raise AssertionError

    cache = spark.createDataFrame([], "key string, response string")
    requests = teacher.label_requests(examples(spark, ROWS), QUESTIONS, "teacher").cache()
    assert requests.count() == 4 and requests.select("key").distinct().count() == 3
    full = requests.select("key", F.lit('{"spam":{"p":0.5}}').alias("response")).distinct()
    done, kept = teacher.label(examples(spark, ROWS), QUESTIONS, never, full)
    assert kept.count() == 3 and {r[0] for r in done.where("ex_id <> 4").select(F.variant_get("labels", "$.spam", "string")).collect()} == {"0.5", "false"}
    assert teacher.label(examples(spark, ROWS[:3]), QUESTIONS, made_client(), cache, budget=1)[1].count() == 1


def test_a_partition_gives_up_after_failures(spark):
    rows = spark.createDataFrame([(str(i), "s", "fail", "{}") for i in range(9)], "key string, system string, user string, schema string").coalesce(1)
    answers = teacher.asked(rows, made_client())
    counts = teacher.statuses(rows, rows.select("key").where("key = '0'"), answers).first()
    assert (counts.requested, counts.done, counts.failed, counts.skipped, counts.cached) == (9, 0, 2, 6, 1)


def test_fences_are_longer_than_those_of_the_text(spark):
    got = spark.createDataFrame([("plain", ""), ("a ```` b", "c")], "t string, c string").select(teacher.user_prompt(F.col("t"), F.col("c")).alias("u")).collect()
    assert got[0].u == "Text:\n```\nplain\n```" and got[1].u == "Context:\n`````\nc\n`````\nText:\n`````\na ```` b\n`````"


def test_unusable_answers_give_no_label(spark):
    raw = ['{"spam":{"p":2}}', '{"topic":{"option":"war"}}', '{"heat":{"level":"max"}}', "none", None, '{"topic":{"option":"art"}}', '{"heat":{"level":"top"}}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    got = df.select("i", *[teacher.answer_label(F.col("r"), q).alias(q.name) for q in QUESTIONS]).orderBy("i").collect()
    assert [(r.spam, r.topic, r.heat) for r in got[:5]] == [(None, None, None)] * 5
    assert json.loads(got[5].topic) == {"sport": 0.0, "art": 1.0} and got[6].heat == '"top"'


def test_rewrites_in_any_order(spark):
    rows = [("a", 'x {"items":[{"id":"2","text":" two "},{"id":"1","text":"one"},{"id":"3"}]} y'), ("b", "no"), ("c", '{"items":[]}')]
    got = teacher.rewritten(spark.createDataFrame(rows, "key string, response string")).collect()
    assert sorted(map(tuple, got)) == [("a", "1", "one"), ("a", "2", "two")]
