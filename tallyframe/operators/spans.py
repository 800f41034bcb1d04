"""Passages: windows over tokens, tagging, decoding and trimming."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.examples import SPACE


def plan_windows(n: Column, size: int, margin: int) -> Column:
    """Windows (start, end, keep_from, keep_to) over n tokens: slices of equal size are kept, a margin more is read on either side."""
    m = min(margin, (size - 1) // 4)
    k = F.when(n <= size, F.lit(1)).otherwise(F.ceil(n / (size - 2 * m))).cast("int")

    def window(i: Column) -> Column:
        lo, hi = F.floor(i * n / k).cast("int"), F.floor((i + 1) * n / k).cast("int")
        extra = F.when(k == 1, 0).otherwise(m)
        return F.struct(F.greatest(lo - extra, F.lit(0)).alias("start"), F.least(hi + extra, n.cast("int")).alias("end"), lo.alias("keep_from"), hi.alias("keep_to"))

    return F.transform(F.sequence(F.lit(0), k - 1), window)


def pair_budget(a: Column, b: Column, max_len: int, specials: int = 3) -> Column:
    """(keep_a, keep_b): the text first, the context at least a third of the budget."""
    budget = max(max_len - specials, 0)
    first = F.least(a, F.lit(budget // 3))
    keep_b = F.least(b, budget - first)
    fits = a + b <= budget
    return F.struct(F.when(fits, a).otherwise(F.least(a, budget - keep_b)).alias("keep_a"), F.when(fits, b).otherwise(keep_b).alias("keep_b"))


def tag_tokens(tokens: Column, spans: Column) -> Column:
    """BIO tags of tokens (start, end) by overlap with spans (start, end, type index): 0 outside, 1 + 2k first, 2 + 2k further."""
    owner = F.transform(tokens, lambda t: F.array_position(F.transform(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])), True))
    kind = lambda o: F.element_at(spans, o.cast("int"))["type"]
    return F.transform(owner, lambda o, i: F.when(o == 0, F.lit(0)).otherwise(F.when((i > 0) & (F.get(owner, i - 1) == o), 2 + 2 * kind(o)).otherwise(1 + 2 * kind(o))))


def viterbi(logp: np.ndarray, bias: float = 0.0) -> list[int]:
    """The best legal tags: an inside tag only after a tag of its type. bias is added to all tags but outside; ties go to the lower tag."""
    n, k = logp.shape
    if not n:
        return []
    score = logp + np.where(np.arange(k) > 0, bias, 0.0)
    inside = (np.arange(k) > 0) & (np.arange(k) % 2 == 0)
    legal = np.ones((k, k), bool)
    for t in np.flatnonzero(inside):
        legal[:, t] = False
        legal[[t - 1, t], t] = True
    path, back = np.where(inside, -np.inf, score[0]), np.zeros((n, k), int)
    for i in range(1, n):
        step = np.where(legal, path[:, None], -np.inf)
        back[i] = step.argmax(0)
        path = step.max(0) + score[i]
    tags = [int(path.argmax())]
    for i in range(n - 1, 0, -1):
        tags.append(int(back[i, tags[-1]]))
    return tags[::-1]


def viterbi_all(logp: np.ndarray, lengths: np.ndarray, bias: float = 0.0) -> np.ndarray:
    """viterbi() of many sequences, one after another in logp, a step of all of them at a time."""
    k, out = logp.shape[1], np.zeros(len(logp), np.int32)
    order = np.argsort(-lengths, kind="stable")
    order = order[: np.count_nonzero(lengths)]
    start, long = (np.cumsum(lengths) - lengths)[order], lengths[order]
    if not len(order):
        return out
    score = logp + np.where(np.arange(k) > 0, bias, 0.0)
    inside = (np.arange(k) > 0) & (np.arange(k) % 2 == 0)
    bar = np.zeros((k, k))
    for t in np.flatnonzero(inside):
        bar[:, t] = -np.inf
        bar[[t - 1, t], t] = 0
    active = np.searchsorted(-long, -np.arange(long[0]), "left")  # sequences that have a token i
    path, back = np.where(inside, -np.inf, score[start]), np.zeros((len(logp), k), np.int16)
    for i in range(1, int(long[0])):
        m = active[i]
        step = path[:m, :, None] + bar
        back[start[:m] + i] = step.argmax(1)
        path[:m] = step.max(1) + score[start[:m] + i]
    tags = path.argmax(1)
    for i in range(int(long[0]) - 1, -1, -1):
        m = active[i]
        out[start[:m] + i] = tags[:m]
        tags[:m] = back[start[:m] + i, tags[:m]]
    return out


#: Tokens that a worker decodes at once; a longer sequence is alone.
AT_ONCE = 1 << 17


def viterbi_groups(logp: np.ndarray, lengths: np.ndarray, bias: float = 0.0) -> np.ndarray:
    """viterbi_all() in groups of AT_ONCE tokens, which bound the memory; sequences of like length are together, so that steps are few."""
    start, order, out = np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable"), np.zeros(len(logp), np.int32)
    ends, a = np.cumsum(lengths[order]), 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(ends, AT_ONCE + (ends[a - 1] if a else 0), "right")))
        own, n = order[a:b], lengths[order[a:b]]
        at = np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[at] = viterbi_all(logp[at], n, bias)
        a = b
    return out


def decode(df: DataFrame, logp: str, bias: float = 0.0) -> DataFrame:
    """df with `tags`; logp is an array of arrays, a row a token. Batches go through Arrow."""
    import pyarrow as pa

    at, names = df.columns.index(logp), [*df.columns, "tags"]

    def tagged(rows):
        inner = rows.flatten()
        width = inner.value_lengths().unique().to_pylist()
        if len(width) > 1 or width == [None]:
            return [None if r is None else viterbi(np.array(r, float).reshape(len(r), -1), bias) if r else [] for r in (row.as_py() for row in rows)]
        lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = viterbi_groups(inner.flatten().to_numpy(zero_copy_only=False).reshape(len(inner), -1), lengths, bias) if width else np.zeros(0, np.int32)
        ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()), mask=rows.is_null() if rows.null_count else None)

    def run(batches):
        for batch in batches:
            tags = tagged(batch.column(at))
            yield pa.record_batch([*batch.columns, tags if isinstance(tags, pa.Array) else pa.array(tags, pa.list_(pa.int32()))], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("tags", T.ArrayType(T.IntegerType()))]))


def tagged_spans(tags: list[int], tokens: list[tuple[int, int]], types: list[str]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    last = 0
    for tag, (a, b) in zip(tags, tokens):
        if tag and tag % 2 == 0 and last in (tag, tag - 1) and out:
            out[-1] = (out[-1][0], b, out[-1][2])
        elif tag:
            out.append((a, b, types[(tag - 1) // 2]))
        last = tag
    return out


# Signs that are cut off a passage at its start and end, and brackets by closing sign.
LEADING, TRAILING = "([{«‹“‘\"'¿¡", ",;:!?)]}»›”’\"'"
BRACKETS = {")": "(", "]": "[", "}": "{", "»": "«", "›": "‹", "”": "“"}


def trim(text: str) -> tuple[int, int]:
    """Character bounds without white space and punctuation; a closing bracket with its opener inside stays; if all would go, all stays."""
    a = len(text) - len(text.lstrip(LEADING + SPACE))
    b = len(text)
    while b > a:
        sign, inside = text[b - 1], text[a : b - 1]
        closes = sign in BRACKETS and inside.count(BRACKETS[sign]) > inside.count(sign)
        if closes or sign not in TRAILING + SPACE:
            return a, b
        b -= 1
    return 0, len(text)


def overlapping(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Tokens with the spans of the same text that they overlap."""
    s = spans.select(F.col(key).alias("_k"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), "type")
    return tokens.join(s, (tokens[key] == F.col("_k")) & (F.col("s_start") < tokens["end"]) & (tokens["start"] < F.col("s_end"))).drop("_k")
