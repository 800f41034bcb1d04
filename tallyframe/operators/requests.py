"""Decision and embedding requests: what a state, a criterion and an input mean, and which questions are learned."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_INPUTS = 2048
INPUT = "struct<text: string, context: string, error: string>"
CRITERION = "struct<name: string, description: string, examples: array<string>>"


def _compact(value) -> str:
    """JSON with sorted keys and no spaces; a string stands for itself."""
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def state_of(raw: str | None, paired: bool) -> dict:
    """A JSON state: a string is the text; an object of text and at most a context is both; all else is its JSON as text."""
    out = {"text": None, "context": "", "error": None}
    try:
        value = json.loads(raw) if raw is not None else None
    except ValueError:
        return out | {"error": "not JSON"}
    pair = isinstance(value, dict) and len(value) <= 2 and isinstance(value.get("text"), str) and (value.get("context") is None or isinstance(value["context"], str))
    if pair and set(value) <= {"text", "context"}:
        out |= {"text": value["text"], "context": value.get("context") or ""}
    else:
        out["text"] = _compact(value)
    if out["context"] and not paired:
        return out | {"text": None, "error": "the model reads no context"}
    return out


def state_input(raw: Column, paired: bool = True) -> Column:
    """state_of() of a column of JSON: (text, context, error)."""

    @F.pandas_udf(INPUT)
    def parsed(states: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([state_of(s, paired) for s in states], columns=["text", "context", "error"])

    return parsed(raw)


def criterion_of(name: str, raw: str | None) -> dict:
    """A criterion in JSON: a string describes; of an object `description` and `examples` are taken and the rest is added to the description."""
    value = json.loads(raw) if raw is not None else None
    out = {"name": name, "description": "", "examples": []}
    if not isinstance(value, dict):
        return out | {"description": "" if value is None else _compact(value)}
    examples = value.get("examples")
    examples = [examples] if isinstance(examples, str) else examples if isinstance(examples, list) else []
    out["examples"] = [e for e in examples if isinstance(e, str) and e]
    if "description" in value:
        out["description"] = _compact(value["description"])
    rest = {k: v for k, v in value.items() if k not in ("examples", "description")}
    if rest:
        out["description"] = f"{out['description']}\n{_compact(rest)}".strip()
    return out


def criterion(name: Column, raw: Column) -> Column:
    @F.pandas_udf(CRITERION)
    def parsed(names: pd.Series, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([criterion_of(n, v) for n, v in zip(names, values)], columns=["name", "description", "examples"])

    return parsed(name, raw)


def open_candidates(kind: str, options: list[dict], instructions: str = "") -> list[str]:
    """The texts that an open question's options are compared by; noul questions need two options, others two or more. Instructions come before a description."""
    if len(options) < 2 or (kind == "noul" and len(options) != 2):
        raise ValueError(f"{len(options)} options for an open question of kind {kind}")
    head = f"{instructions}\n" if instructions else ""
    return [head + (o.get("description") or o["name"]) for o in options]


def embed_inputs(raw: Column) -> Column:
    """(texts, error) of an embedding request's input in JSON: a string or an array of 1 to MAX_INPUTS strings."""
    many = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v array<variant>")["v"]
    kind = F.schema_of_variant(F.try_parse_json(raw))
    one = F.when(kind == "STRING", F.try_variant_get(F.try_parse_json(raw), "$", "string"))
    texts = F.transform(many, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    missing = raw.isNull() | (F.trim(raw) == "") | (kind == "VOID")
    nulls = F.exists(many, lambda v: F.is_variant_null(v))
    wrong = F.exists(texts, lambda t: t.isNull())
    error = F.when(missing, "input is missing").when(one.isNotNull(), None).when(~F.coalesce(kind.startswith("ARRAY"), F.lit(False)), "input is neither a text nor an array of texts").when(F.size(many) == 0, "input is empty")
    error = error.when(nulls, "an input is null").when(wrong, "input is neither a text nor an array of texts").when(F.size(many) > MAX_INPUTS, "too many inputs")
    return F.struct(F.when(error.isNull(), F.when(one.isNotNull(), F.array(one)).otherwise(texts)).alias("texts"), error.alias("error"))


def floats_base64(vector: Column) -> Column:
    """32-bit little-endian numbers in base64."""

    @F.pandas_udf("string")
    def coded(vectors: pd.Series) -> pd.Series:
        import base64

        return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())

    return coded(vector)


def base64_floats(text: Column) -> Column:
    @F.pandas_udf("array<float>")
    def plain(texts: pd.Series) -> pd.Series:
        import base64

        return texts.map(lambda t: None if t is None else np.frombuffer(base64.b64decode(t), "<f4"))

    return plain(text)


def learned(asked: DataFrame, schema: DataFrame) -> DataFrame:
    """Questions asked (question, ..) that the model's schema has; they go through its heads."""
    return asked.join(schema.select(F.col("name").alias("question")).distinct(), "question", "left_semi")


def open_questions(asked: DataFrame, schema: DataFrame) -> DataFrame:
    """The others, which are answered by comparison with their options."""
    return asked.join(schema.select(F.col("name").alias("question")).distinct(), "question", "left_anti")


def routed(asked: DataFrame, schema: DataFrame) -> DataFrame:
    """asked with `route`: learned or open; a learned question whose options the head cannot answer is refused."""
    known = schema.select(F.col("name").alias("question"), F.col("kind").alias("_kind"), F.col("options").alias("_options"))
    subset = F.size(F.array_except("options", "_options")) == 0
    fits = (F.col("kind") == F.col("_kind")) & F.when(F.col("kind") == "choice", subset).when(F.col("kind") == "score", F.size("options") == F.size("_options")).otherwise(True)
    route = F.when(F.col("_kind").isNull(), "open").when(fits, "learned").otherwise("refused")
    return asked.join(known, "question", "left").withColumn("route", route).drop("_kind", "_options")


def usage(rows: DataFrame, tokens: str = "n_tokens", by: str = "request_id") -> DataFrame:
    """Tokens of each request."""
    return rows.groupBy(by).agg(F.sum(tokens).alias("prompt_tokens"), F.sum(tokens).alias("total_tokens"))


def prediction_lines(df: DataFrame, answers: str = "answers") -> DataFrame:
    """A JSON line an input: text, context where there is one, answers."""
    context = F.when(F.col("context") != "", F.col("context"))
    return df.select(F.to_json(F.struct("text", context.alias("context"), F.col(answers).alias("answers"))).alias("value"))


def prompted(role: str, text: Column, prompts: dict[str, str]) -> Column:
    """A text behind its role's prompt, if the model has one."""
    return F.concat(F.lit(prompts.get(role, "")), text)
