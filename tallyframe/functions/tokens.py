"""Tokens of texts by a public tokenizer file, as Arrow functions, and tables of its vocabulary.

A worker reads the file once. Files that are no BPE, or whose pieces are made in another
way than the two that are known here, are refused when they are opened.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OFFSETS = "struct<ids: array<int>, starts: array<int>, ends: array<int>>"


def supported(spec: dict) -> str | None:
    """Why a tokenizer file cannot be used; None if it can."""
    model = spec.get("model") or {}
    if model.get("type") != "BPE":
        return f"a model of type {model.get('type')}"
    if model.get("dropout"):
        return "merges with dropout"
    if model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return "marks on parts of words"
    pre, normal = spec.get("pre_tokenizer"), spec.get("normalizer")
    bytes_ = (pre or {}).get("type") == "ByteLevel" and (normal is None or normal.get("type") in ("NFC", "NFD", "NFKC"))
    spaces = pre is None and (normal or {}).get("type") in ("Replace", "Sequence") and bool(model.get("byte_fallback"))
    return None if bytes_ or spaces else "another way to make pieces"


@lru_cache(maxsize=4)
def opened(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        reason = supported(json.load(f))
    if reason:
        raise ValueError(f"{path}: {reason}")
    return Tokenizer.from_file(path)


#: Characters of the texts whose encodings a worker holds at once (an encoding takes many times its text); a longer text is alone.
AT_ONCE = 1 << 18


def encodings(given: list, path: str, special: bool = False):
    """The encodings of texts or pairs, one after another; AT_ONCE bounds those that are held."""
    group, n = [], 0
    for g in given:
        size = len(g) if isinstance(g, str) else len(g[0]) + len(g[1])
        if group and n + size > AT_ONCE:
            yield from opened(path).encode_batch_fast(group, add_special_tokens=special)
            group, n = [], 0
        group.append(g)
        n += size
    if group:
        yield from opened(path).encode_batch_fast(group, add_special_tokens=special)


def token_ids(text: Column, path: str, special: bool = False, parallel_to: Column | None = None) -> Column:
    """Ids of a text, or of a pair (text, context); a null text is empty."""

    def ids(texts: pd.Series, pairs: pd.Series | None = None) -> pd.Series:
        given = texts.fillna("").tolist() if pairs is None else list(zip(texts.fillna(""), pairs.fillna("")))
        return pd.Series([np.array(e.ids, np.int32) for e in encodings(given, path, special)], dtype=object)

    if parallel_to is None:
        return F.pandas_udf(lambda texts: ids(texts), "array<int>", F.PandasUDFType.SCALAR)(text)
    return F.pandas_udf(lambda texts, pairs: ids(texts, pairs), "array<int>", F.PandasUDFType.SCALAR)(text, parallel_to)


def token_offsets(text: Column, path: str) -> Column:
    """Ids with the bytes [start, end) of each token in the UTF-8 text."""

    def spans(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts.fillna(""):
            e = opened(path).encode(t, add_special_tokens=False)
            at = [0]
            for c in t:
                at.append(at[-1] + len(c.encode("utf-8")))
            rows.append((e.ids, [at[a] for a, _ in e.offsets], [at[b] for _, b in e.offsets]))
        return pd.DataFrame(rows, columns=["ids", "starts", "ends"])

    return F.pandas_udf(spans, OFFSETS, F.PandasUDFType.SCALAR)(text)


def n_tokens(text: Column, path: str) -> Column:
    """Number of tokens of a text; no ids leave the worker."""

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(e) for e in encodings(texts.fillna("").tolist(), path)], dtype="int32")

    return F.pandas_udf(count, "int", F.PandasUDFType.SCALAR)(text)


def core_start(text: str, start: int, end: int) -> int:
    """Where a token's text begins without the white space it carries in front; one of white space alone begins at its start."""
    from ..sources.examples import SPACE

    at = end - len(text[start:end].lstrip(SPACE))
    return start if at == end else at


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) in the file's own writing of bytes."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return spark.createDataFrame([(i, t) for t, i in vocab.items()], "id int, token string")


def merges(spark: SparkSession, path: str) -> DataFrame:
    """(rank, a, b)."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)["model"]["merges"]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in given)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "rank int, a string, b string")


def merge_symbols(word: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """All symbols that a word's merges pass through: its characters, every result, and so the final ones."""
    parts, seen = list(word), list(word)
    while len(parts) > 1:
        found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        seen.append(parts[i])
    return seen


def symbol_counts(words: DataFrame, path: str, least: int = 1) -> DataFrame:
    """words (word, n): distinct pieces in the file's writing of bytes and how often they occur -> (token, n) of final and intermediate symbols that occur `least` times or more."""

    def symbols(pieces: pd.Series) -> pd.Series:
        ranks = _ranks(path)
        return pieces.map(lambda w: merge_symbols(list(w), ranks))

    each = words.select("n", F.explode(F.pandas_udf(symbols, "array<string>", F.PandasUDFType.SCALAR)("word")).alias("token"))
    return each.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[tuple[str, str], int]:
    with open(path, encoding="utf-8") as f:
        given = json.load(f)["model"]["merges"]
    return {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(given)}


def pruned(vocab: DataFrame, ranked: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vocab (id, token), ranked merges (rank, a, b) and keep (token): the vocabulary with new ids in the old order (old_id, id, token), and the merges of which both parts and the result are kept, ranked anew. A vocabulary's size bounds both."""
    kept = vocab.join(keep.select("token").distinct(), "token", "left_semi")
    kept = kept.select(F.col("id").alias("old_id"), (F.row_number().over(Window.orderBy("id")) - 1).alias("id"), "token")
    names = kept.select("token")
    left = ranked.join(names.withColumnRenamed("token", "a"), "a", "left_semi").join(names.withColumnRenamed("token", "b"), "b", "left_semi")
    left = left.withColumn("token", F.concat("a", "b")).join(names, "token", "left_semi")
    return kept, left.select((F.row_number().over(Window.orderBy("rank")) - 1).alias("rank"), "a", "b")
