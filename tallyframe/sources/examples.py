"""Readers and writers of examples, lines, gazetteers, search pairs, schemas and cached responses."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# White space of Unicode.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
EXAMPLE = "context string, text string, labels variant, family string, split string, meta map<string,string>"


def listed(*paths: str) -> list[str]:
    """Paths, each of which may be a list with commas and begin in the home folder; blanks are left out."""
    return [os.path.expanduser(p) for part in paths for p in map(str.strip, part.split(",")) if p]


def read_examples(spark: SparkSession, *paths: str) -> DataFrame:
    """Examples from JSON lines, labels as VARIANT; empty lines are skipped, bad JSON fails. paths: as in listed(); folders and patterns are Spark's."""
    lines = spark.read.text(listed(*paths)).where("value <> ''")
    return lines.select(F.from_json("value", EXAMPLE, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def write_examples(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def stripped(value: Column) -> Column:
    """Without white space at both ends, tabs and line ends included."""
    return F.btrim(value, F.lit(SPACE))


def line_inputs(value: Column) -> Column:
    """(text, context) of a plain or JSON line: a line that starts with { and has a text parses, any other is the text."""
    line = stripped(value)
    parsed = F.from_json(line, "text string, context string")
    is_json = line.startswith("{") & (F.coalesce(parsed["text"], F.lit("")) != "")
    return F.struct(F.when(is_json, parsed["text"]).otherwise(line).alias("text"), F.when(is_json, F.coalesce(parsed["context"], F.lit(""))).otherwise("").alias("context"))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Prediction inputs; blank lines are skipped."""
    return spark.read.text(list(paths)).where(stripped(F.col("value")) != "").select(line_inputs(F.col("value")).alias("i")).select("i.*")


def read_embedding_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, text) of lines to embed: blank lines count too; bad JSON fails; without an id of its own a line has its number, from 0, over the files in order."""
    place = ["file", "block"]
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    # one row a block of a file, so that the order is made of few rows
    blocks = lines.groupBy(*place).agg(F.count("*").alias("n"), F.min("m").alias("least"))
    blocks = blocks.select(*place, "least", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(*place)) - F.col("n")).alias("before"))
    number = F.col("before") + F.col("m") - F.col("least")
    is_json = stripped(F.col("value")).startswith("{")
    parsed = F.from_json(F.when(is_json, stripped(F.col("value"))), "id string, text string", {"mode": "FAILFAST"})
    return lines.join(blocks, place).select(F.coalesce(parsed["id"], number.cast("string")).alias("id"), F.when(is_json, F.coalesce(parsed["text"], F.lit(""))).otherwise(F.col("value")).alias("text"))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(value, weight, metadata): tab-separated, # starts a comment, a missing weight is 1."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).where((stripped(F.col("value")) != "") & ~F.col("value").startswith("#"))
    weight = F.coalesce(F.get(part, F.lit(1)).try_cast("double"), F.lit(1.0))
    return rows.select(F.get(part, F.lit(0)).alias("value"), weight.alias("weight"), F.from_json(F.get(part, F.lit(2)), "map<string,string>").alias("metadata"))


def read_search_pairs(spark: SparkSession, *paths: str) -> DataFrame:
    pairs = spark.read.schema("query_id string, query string, document_id string, document string, negatives array<string>").json(list(paths))
    given = F.coalesce((F.col("query") != "") & (F.col("document") != ""), F.lit(False))
    return pairs.where(F.assert_true(given, F.lit("query and document are needed")).isNull())


def load_schema(path: str) -> list[dict]:
    """Questions of a schema file, or of model metadata that holds one; options may be strings or objects with a name."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    questions = data["schema"] if isinstance(data, dict) else data
    return [q | {"options": [o["name"] if isinstance(o, dict) else o for o in q.get("options") or []]} for q in questions]


def response_key(model: Column, system: Column, user: Column, schema: Column, temperature: Column) -> Column:
    return F.sha2(F.concat_ws("\0", model, system, user, schema, temperature.cast("string")), 256)


def cache_misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests without an answer, each key once."""
    return requests.join(cache.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def vectors_json(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.to_json(F.struct(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))).alias("value"))
