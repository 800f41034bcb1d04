"""Labels from several teachers: parsing, merging, and consensus."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def soft_choice(options: Column, option: Column, confidence: Column) -> Column:
    """A distribution from one option and a confidence, which is kept within [1/k, 1]; the rest is spread evenly."""
    k = F.size(options)
    c = F.greatest(F.least(confidence, F.lit(1.0)), 1.0 / k)
    return F.transform(options, lambda o: F.when(o == option, c).otherwise((1.0 - c) / F.greatest(k - 1, F.lit(1))))


def noul_consensus(verdicts: DataFrame, teachers: int, key: str = "ex_id") -> DataFrame:
    """verdicts (key, teacher, p, label): state kept (all on one side, and that of a label if there is one), disputed, or dropped (a teacher is missing); mean of p."""
    per = verdicts.groupBy(key).agg(F.count("p").alias("n"), F.avg("p").alias("mean"), F.min((F.col("p") >= 0.5).cast("int")).alias("lo"), F.max((F.col("p") >= 0.5).cast("int")).alias("hi"), F.max("label").alias("label"))
    against = F.col("label").isNotNull() & (F.col("label") != F.col("hi"))
    state = F.when(F.col("n") < teachers, "dropped").when((F.col("lo") != F.col("hi")) | against, "disputed").otherwise("kept")
    return per.select(key, state.alias("state"), F.when(state == "kept", F.col("mean")).alias("p"))


def choice_consensus(verdicts: DataFrame, teachers: int, key: str = "ex_id") -> DataFrame:
    """verdicts (key, teacher, option, p), a row an option: options' mean probabilities where all teachers prefer the same one (of equal ones the first by name)."""
    best = verdicts.groupBy(key, "teacher").agg(F.min(F.struct(-F.col("p"), F.col("option")))["option"].alias("best"))
    same = best.groupBy(key).agg(F.count("*").alias("n"), F.min("best").alias("a"), F.max("best").alias("b")).where((F.col("n") == teachers) & (F.col("a") == F.col("b")))
    return verdicts.groupBy(key, "option").agg(F.avg("p").alias("p")).join(same.select(key, F.col("a").alias("choice")), key)


def score_consensus(verdicts: DataFrame, teachers: int, key: str = "ex_id") -> DataFrame:
    """verdicts (key, teacher, level): the level that all name."""
    per = verdicts.groupBy(key).agg(F.count("*").alias("n"), F.min("level").alias("level"), F.max("level").alias("top"))
    return per.where((F.col("n") == teachers) & (F.col("level") == F.col("top"))).select(key, "level")


def choice_states(verdicts: DataFrame, teachers: int, key: str = "ex_id") -> DataFrame:
    """(key, state) of choices: kept if all teachers prefer one option, disputed if they do not, dropped if one is missing."""
    best = verdicts.groupBy(key, "teacher").agg(F.min(F.struct(-F.col("p"), F.col("option")))["option"].alias("best"))
    return _states(best, "best", teachers, key)


def score_states(verdicts: DataFrame, teachers: int, key: str = "ex_id") -> DataFrame:
    """(key, state) of levels, in the same way."""
    return _states(verdicts.where("level IS NOT NULL"), "level", teachers, key)


def _states(rows: DataFrame, value: str, teachers: int, key: str) -> DataFrame:
    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("a"), F.max(value).alias("b"))
    return per.select(key, F.when(F.col("n") < teachers, "dropped").when(F.col("a") == F.col("b"), "kept").otherwise("disputed").alias("state"))


def verified(examples: DataFrame, answers: DataFrame, key: str = "ex_id") -> DataFrame:
    """Examples with an answer take its label; the others stay as they are."""
    return examples.join(answers.select(key, F.col("label").alias("_new")), key, "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def parsed_items(raw: Column) -> Column:
    """Items of a batch response; null if it is not one."""
    return F.from_json(raw, "struct<items: array<struct<id: string, p: double, option: string, confidence: double, level: string>>>")["items"]


def find_object(raw: str | None, key: str) -> str | None:
    """The first JSON object in a text, whatever stands around it, that has the key at its top; null without one."""
    decoder, at = json.JSONDecoder(), 0
    while raw is not None and (at := raw.find("{", at)) >= 0:
        try:
            found, end = decoder.raw_decode(raw, at)
        except ValueError:
            at += 1
            continue
        if key in found:
            return raw[at:end]
        at = end
    return None


def first_object(raw: Column, key: str) -> Column:
    """find_object() of a column: out of prose or a code fence."""

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find_object(t, key))

    return found(raw)


def distinct_variants(variants: Column, source: Column, k: int) -> Column:
    """The first k variants, trimmed; blanks, repeats and the source itself go afterwards."""
    return F.array_distinct(F.filter(F.transform(F.slice(variants, 1, k), F.trim), lambda v: (v != "") & (v != source)))
