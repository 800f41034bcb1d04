"""Labels from a teacher model: requests, a cache of responses, and what responses say.

A client is a function (system, user, schema) -> text that runs on executors; it raises to
refuse a request. Requests with a cached response never reach it, equal requests reach it once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.examples import cache_misses, response_key
from . import consensus, labelled
from .schema import Question

Client = Callable[[str, str, str], str]


def label_schema(questions: Sequence[Question]) -> str:
    """The JSON schema of a response: an object a question."""
    number = {"type": "number", "minimum": 0, "maximum": 1}
    of = {
        "noul": lambda q: {"p": number},
        "choice": lambda q: {"option": {"type": "string", "enum": list(q.options)}, "confidence": number},
        "score": lambda q: {"level": {"type": "string", "enum": list(q.options)}},
    }
    each = {q.name: {"type": "object", "properties": (p := of[q.kind](q)), "required": list(p)} for q in questions if q.kind in of}
    return json.dumps({"type": "object", "properties": each, "required": list(each)}, sort_keys=True)


def system_prompt(questions: Sequence[Question], policy: str = "") -> str:
    """What is asked, a line a question, and a policy after it."""
    lines = [f"- {q.name} ({q.kind}{': ' + ', '.join(q.options) if q.options else ''}): {q.instructions}" for q in questions if q.kind != "spans"]
    return "\n".join(["Answer these questions about the text in one JSON object:", *lines, *([f"\n{policy}"] if policy else [])])


def user_prompt(text: Column, context: Column) -> Column:
    """The text between fences that it does not hold itself, a context before it."""
    runs = F.regexp_extract_all(F.concat(F.coalesce(context, F.lit("")), F.lit("\n"), text), F.lit(r"(`+)"), F.lit(1))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(2), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))) + 1)
    block = lambda name, x: F.concat(F.lit(f"{name}:\n"), fence, F.lit("\n"), x, F.lit("\n"), fence)
    return F.when(F.coalesce(context, F.lit("")) == "", block("Text", text)).otherwise(F.concat(block("Context", context), F.lit("\n"), block("Text", text)))


def label_requests(examples: DataFrame, questions: Sequence[Question], model: str, policy: str = "", temperature: float = 0.0) -> DataFrame:
    """examples (ex_id, text, context, labels) that lack a label -> with key, system, user and schema."""
    open_ = examples.where(~labelled.complete(F.col("labels"), questions))
    rows = open_.withColumns({"system": F.lit(system_prompt(questions, policy)), "user": user_prompt(F.col("text"), F.col("context")), "schema": F.lit(label_schema(questions))})
    return rows.withColumn("key", response_key(F.lit(model), F.col("system"), F.col("user"), F.col("schema"), F.lit(temperature)))


def asked(requests: DataFrame, client: Client, give_up: int = 3) -> DataFrame:
    """requests (key, system, user, schema) -> (key, response, status): done, failed, or skipped after give_up failures one after another in a partition."""

    def run(frames):
        failures = 0
        for frame in frames:
            rows = []
            for key, system, user, schema in zip(frame.key, frame.system, frame.user, frame.schema):
                if failures >= give_up:
                    rows.append((key, None, "skipped"))
                    continue
                try:
                    rows.append((key, client(system, user, schema), "done"))
                    failures = 0
                except Exception:  # a client may fail in any way; the row says so
                    rows.append((key, None, "failed"))
                    failures += 1
            yield pd.DataFrame(rows, columns=["key", "response", "status"])

    return requests.select("key", "system", "user", "schema").mapInPandas(run, "key string, response string, status string")


def answer_of(raw: str | None, question: Question) -> str | None:
    """The label that a response gives to a question, as JSON; None without a usable one. A choice with a confidence is a distribution, the rest of it spread evenly."""
    found = consensus.find_object(raw, question.name)
    answer = json.loads(found)[question.name] if found else None
    if not isinstance(answer, dict):
        return None
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if question.kind == "noul":
        p = answer.get("p")
        return json.dumps(p) if number(p) and 0 <= p <= 1 else None
    if question.kind == "score":
        return json.dumps(answer["level"], ensure_ascii=False) if answer.get("level") in question.options else None
    if answer.get("option") not in question.options:
        return None
    k = len(question.options)
    sure = max(min(answer["confidence"], 1.0), 1 / k) if number(answer.get("confidence")) else 1.0
    return json.dumps({o: sure if o == answer["option"] else (1 - sure) / max(k - 1, 1) for o in question.options}, ensure_ascii=False)


def answer_label(response: Column, question: Question) -> Column:
    """answer_of() of a column."""

    @F.pandas_udf("string")
    def labels(responses: pd.Series) -> pd.Series:
        return responses.map(lambda r: answer_of(r, question))

    return labels(response)


def with_answers(examples: DataFrame, responses: DataFrame, questions: Sequence[Question]) -> DataFrame:
    """examples with key, joined to their responses (key, response); labels that were there stay, and an example without a response stays as it is."""
    asked_for = [q for q in questions if q.kind != "spans"]
    rows = examples.join(responses.select("key", "response"), "key", "left")
    rows = rows.withColumns({f"_{q.name}": answer_label(F.col("response"), q) for q in asked_for})
    pairs = [F.concat(F.lit(json.dumps(q.name) + ":"), F.coalesce(F.to_json(labelled.label_of(F.col("labels"), q.name)), F.col(f"_{q.name}"))) for q in asked_for]
    new = F.parse_json(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*pairs)), ","), F.lit("}")))
    rows = rows.withColumn("labels", F.when(F.col("response").isNull(), F.col("labels")).otherwise(new))
    return rows.drop("response", "key", "system", "user", "schema", *[f"_{q.name}" for q in asked_for])


def label(examples: DataFrame, questions: Sequence[Question], client: Client, cache: DataFrame, model: str = "teacher", policy: str = "", budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(examples with labels, cache with new responses). budget: new requests at most, those with the least keys. The new responses should be written before both are used, as a client's answers need not repeat."""
    requests = label_requests(examples, questions, model, policy)
    todo = cache_misses(requests.select("key", "system", "user", "schema"), cache)
    if budget is not None:
        todo = todo.orderBy("key").limit(budget)
    fresh = asked(todo, client).where("status = 'done'").select("key", "response", F.lit(0).alias("n"))
    merged = labelled.merged_cache(cache, fresh)
    done = examples.where(labelled.complete(F.col("labels"), questions))
    return with_answers(requests, merged, questions).unionByName(done), merged


def statuses(requests: DataFrame, cache: DataFrame, answers: DataFrame) -> DataFrame:
    """One row of counts: requested, done, cached, skipped, failed."""
    state = requests.select("key").join(cache.select("key", F.lit("cached").alias("_c")).distinct(), "key", "left").join(answers.select("key", "status"), "key", "left")
    return labelled.status_counts(state.select(F.coalesce("_c", "status").alias("status")))


def rewritten(responses: DataFrame, key: str = "key") -> DataFrame:
    """Batch responses {"items": [{"id", "text"}]} -> (key, id, text), a row an item that has a text, in whatever order; a response without items gives none."""
    found = consensus.first_object(F.col("response"), "items")
    items = F.from_json("_found", "items array<struct<id: string, text: string>>")["items"]
    return responses.withColumn("_found", found).select(key, F.explode(items).alias("i")).select(key, "i.id", F.trim("i.text").alias("text")).where("text <> ''")


def consensus_states(parts: Sequence[DataFrame], key: str = "ex_id") -> DataFrame:
    """Counts by state over the consensus of several questions (key, state)."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(key, "state") for p in parts]).groupBy("state").agg(F.count("*").alias("n"))
