"""Labelled examples against a schema: targets, selection, and bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import schema as Q

_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def label_of(labels: Column, question: str) -> Column:
    """The label of a question as VARIANT; null if there is none or it is null."""
    value = F.try_variant_get(labels, f"$.{question}", "variant")
    return F.when(~F.is_variant_null(value), value)


def target(value: Column, question: Q.Question) -> Column:
    """The target of a label as an array: [p] of a noul question, a distribution of a choice, [level] of a score; null if the label does not fit."""
    if question.kind == "noul":
        p = Q.noul_target(value)
        return F.when(p.isNotNull(), F.array(p))
    options = F.array(*map(F.lit, question.options))
    kind = F.schema_of_variant(value)
    name = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    if question.kind == "choice":
        return Q.choice_target(options, name, F.when(kind.startswith("OBJECT"), F.try_variant_get(value, "$", "map<string,double>")))
    level = Q.score_target(options, name, F.when(kind.rlike(_NUMBER), F.try_variant_get(value, "$", "double")))
    return F.when(level.isNotNull(), F.array(level.cast("double")))


def example_targets(examples: DataFrame, questions: Sequence[Q.Question], key: str = "ex_id", labels: str = "labels") -> DataFrame:
    """(key, question, kind, labelled, target): every example with every question that is not of spans. labelled without a target: a label that does not fit."""
    each = []
    for q in questions:
        if q.kind != "spans":
            value = label_of(F.col(labels), q.name)
            each.append(F.struct(F.lit(q.name).alias("question"), F.lit(q.kind).alias("kind"), value.isNotNull().alias("labelled"), target(value, q).cast("array<double>").alias("target")))
    return examples.select(key, F.explode(F.array(*each)).alias("_x")).select(key, "_x.*")


def option_index(value: Column, kind: str, options: Sequence[str]) -> Column:
    """The option that a label (VARIANT) means: a boolean is the first or second; a name; a whole number of a score, or half or more for the first of a noul question; the greatest of a map, of equal ones the first. -1: none."""
    of = F.schema_of_variant(value)
    names = F.array(*map(F.lit, options))
    number = F.try_variant_get(value, "$", "double")
    flag = F.when(F.try_variant_get(value, "$", "boolean"), 0).otherwise(1)
    name = F.array_position(names, F.try_variant_get(value, "$", "string")).cast("int") - 1
    if kind == "score":
        numeric = F.when((number == F.floor(number)) & number.between(0, len(options) - 1), number.cast("int")).otherwise(-1)
    else:
        numeric = F.when(number >= 0.5, 0).otherwise(1) if kind == "noul" else F.lit(-1)
    weights = F.try_variant_get(value, "$", "map<string,double>")
    ranked = F.filter(F.transform(names, lambda o, i: F.struct(weights[o].alias("p"), (-i).alias("i"))), lambda x: x["p"] > -1)
    best = F.coalesce(-F.array_max(ranked)["i"], F.lit(-1))
    out = F.when(of == "BOOLEAN", flag).when(of == "STRING", name).when(of.rlike(_NUMBER), numeric).when(of.startswith("OBJECT"), best)
    return F.coalesce(out, F.lit(-1))


def by_split(examples: DataFrame, split: str) -> DataFrame:
    return examples.where(F.col("split") == split)


def first_n(examples: DataFrame, n: int, key: str = "ex_id") -> DataFrame:
    return examples.orderBy(key).limit(n)


def complete(labels: Column, questions: Sequence[Q.Question]) -> Column:
    """Whether each question has a label."""
    return reduce(lambda a, b: a & b, [label_of(labels, q.name).isNotNull() for q in questions], F.lit(True))


def with_meta(meta: Column, key: str, value: Column) -> Column:
    """The map with one more entry, which takes the place of an older one; a null map counts as empty."""
    kept = F.map_filter(F.coalesce(meta, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(F.lit(key), value))


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of files, groups or variants, columns matched by name; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def round_robin(examples: DataFrame, instructions: Sequence[str], key: str = "ex_id") -> DataFrame:
    """examples with `instruction`, one after another by the number of the example."""
    return examples.withColumn("instruction", F.get(F.array(*map(F.lit, instructions)), F.pmod(F.col(key), F.lit(len(instructions))).cast("int")))


def subset(flat: DataFrame, keep: Column) -> DataFrame:
    """A gazetteer's rows that fit, with their flattened weights and a new running sum."""
    from .data import gazetteer

    return gazetteer(flat.where(keep).drop("cum"))


def status_counts(rows: DataFrame, status: str = "status", states: Sequence[str] = ("done", "cached", "refused", "skipped", "failed")) -> DataFrame:
    """One row: requested, and how many rows are in each state."""
    return rows.agg(F.count("*").alias("requested"), *[F.count_if(F.col(status) == s).alias(s) for s in states])


def merged_cache(kept: DataFrame, new: DataFrame, key: str = "key", value: str = "response") -> DataFrame:
    """The first response put for a key wins: one that is kept, else the first of the new ones by `n`."""
    both = kept.select(key, value, F.lit(-1).cast("long").alias("n")).unionByName(new.select(key, value, F.col("n").cast("long").alias("n")))
    return both.groupBy(key).agg(F.min_by(value, F.struct("n", value)).alias(value))


def loaded_cache(lines: DataFrame, key: str = "key", value: str = "response") -> DataFrame:
    """Of a file's lines (n, key, response) the last of a key wins."""
    return lines.groupBy(key).agg(F.max_by(value, F.struct("n", value)).alias(value))


def distinct_by(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row of equal keys, the first in order; nulls are equal."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
