"""Questions: their declaration, validation, and the targets that labels give."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("noul", "choice", "score", "spans")
MAX_SPAN_TYPES = 63


@dataclass(frozen=True)
class Question:
    name: str
    kind: str
    instructions: str = ""
    options: tuple[str, ...] = field(default=())


def noul(name: str, instructions: str = "") -> Question:
    return Question(name, "noul", instructions)


def choice(name: str, instructions: str, *options: str) -> Question:
    return Question(name, "choice", instructions, options)


def score(name: str, instructions: str, *levels: str) -> Question:
    return Question(name, "score", instructions, levels)


def spans(name: str, instructions: str, *types: str) -> Question:
    return Question(name, "spans", instructions, types)


def validate(questions: list[Question]) -> None:
    """Raises ValueError at the first fault."""
    if not questions:
        raise ValueError("a schema needs a question")
    seen = set()
    for q in questions:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", q.name):
            raise ValueError(f"bad name: {q.name!r}")
        if q.name in seen:
            raise ValueError(f"two questions named {q.name}")
        seen.add(q.name)
        n = len(q.options)
        if q.kind not in KINDS or (q.kind == "noul" and n) or (q.kind in ("choice", "score") and n < 2) or (q.kind == "spans" and not 1 <= n <= MAX_SPAN_TYPES):
            raise ValueError(f"{q.name}: {n} options for kind {q.kind}")
        if len(set(q.options)) < n or "" in q.options:
            raise ValueError(f"{q.name}: options must be unique and not empty")


def frame(spark: SparkSession, questions: list[Question]) -> DataFrame:
    return spark.createDataFrame([(i, q.name, q.kind, q.instructions, list(q.options)) for i, q in enumerate(questions)], "q_idx int, name string, kind string, instructions string, options array<string>")


def index(questions: list[Question], name: str) -> int:
    return next((i for i, q in enumerate(questions) if q.name == name), -1)


def noul_target(v: Column) -> Column:
    """1 or 0 for a boolean, a number within [0, 1] for itself; null for all else, strings of a number included."""
    flag, number, kind = F.try_variant_get(v, "$", "boolean"), F.try_variant_get(v, "$", "double"), F.schema_of_variant(v)
    is_number = kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    return F.when(kind == "BOOLEAN", flag.cast("double")).when(is_number & number.between(0, 1), number)


def choice_target(options: Column, name: Column, weights: Column) -> Column:
    """One-hot for an option's name, else a distribution over the options from weights; null if neither fits."""
    known = F.size(F.array_except(F.map_keys(weights), options)) == 0
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, x: a + x)
    fits = known & F.forall(F.map_values(weights), lambda x: x >= 0) & (total > 0)
    return F.when(F.array_contains(options, name), F.transform(options, lambda o: F.when(o == name, 1.0).otherwise(0.0))).when(fits, F.transform(options, lambda o: F.coalesce(weights[o], F.lit(0.0)) / total))


def score_target(options: Column, name: Column, level: Column) -> Column:
    """The index of a level, by name or by a whole number in range."""
    at = F.array_position(options, name) - 1
    return F.when(at >= 0, at).when((level == F.floor(level)) & level.between(0, F.size(options) - 1), level.cast("bigint"))


def unknown_labels(labels: DataFrame, questions: DataFrame) -> DataFrame:
    """labels (.., question): rows for questions that the schema lacks."""
    return labels.join(F.broadcast(questions.select(F.col("name").alias("question"))), "question", "left_anti")


def valid_spans(found: Column, text: Column) -> Column:
    """Spans sorted by start, or null if one leaves the text's bytes, is empty, or overlaps another."""
    order = F.array_sort(found)
    inside = F.forall(order, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.octet_length(text)))
    apart = F.forall(F.zip_with(F.slice(order, F.lit(1), F.greatest(F.size(order) - 1, F.lit(0))), F.slice(order, F.lit(2), F.greatest(F.size(order) - 1, F.lit(0))), lambda a, b: a["end"] <= b["start"]), lambda x: x)
    return F.when(inside & apart, order)


def merged_labels(existing: Column, fresh: Column) -> Column:
    """Fresh labels where the existing map has none."""
    return F.map_from_entries(F.concat(F.map_entries(existing), F.map_entries(F.map_filter(fresh, lambda k, _: ~F.map_contains_key(existing, k)))))


def compatible(asked: Column, learned: Column, kind: str) -> Column:
    """Whether the options asked for can be answered by those learned: a subset for choices, as many levels for scores."""
    return F.size(F.array_except(asked, learned)) == 0 if kind == "choice" else F.size(asked) == F.size(learned) if kind == "score" else F.lit(True)
