"""Long token sequences cut into windows, and what windows give joined again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import plan_windows


def window_size(max_len: int, prefix: int, suffix: int) -> int:
    """Text tokens of a window, beside the special tokens of the template."""
    return max(max_len - prefix - suffix, 1)


def _framed(ids: Column, prefix: list[int], suffix: list[int]) -> Column:
    return F.concat(F.array(*map(F.lit, prefix)).cast("array<int>"), ids, F.array(*map(F.lit, suffix)).cast("array<int>"))


def cut(df: DataFrame, key: str, ids: str, size: int, margin: int, prefix: list[int] = [], suffix: list[int] = []) -> DataFrame:  # noqa: B006
    """df (key, ids) -> (key, w_idx, ids, keep_from, keep_to): windows of `size` text tokens in the template; of a window the text's tokens from keep_from to keep_to count, so each token counts in one window."""
    planned = df.select(key, F.col(ids).alias("_ids"), F.posexplode(plan_windows(F.size(ids), size, margin)).alias("w_idx", "_w"))
    own = F.slice("_ids", F.col("_w.start") + 1, F.col("_w.end") - F.col("_w.start"))
    keep = [(F.col(f"_w.{k}") - F.col("_w.start") + len(prefix)).alias(k) for k in ("keep_from", "keep_to")]
    return planned.select(key, "w_idx", _framed(own, prefix, suffix).alias("ids"), *keep)


def joined(windows: DataFrame, key: str, per_token: str) -> DataFrame:
    """(key, w_idx, keep_from, keep_to, per_token) -> (key, per_token) of the whole sequence, each token from the window that keeps it."""
    kept = F.slice(per_token, F.col("keep_from") + 1, F.col("keep_to") - F.col("keep_from"))
    parts = windows.select(key, F.struct("w_idx", kept.alias("kept")).alias("part")).groupBy(key).agg(F.array_sort(F.collect_list("part")).alias("parts"))  # a text's own windows
    return parts.select(key, F.flatten(F.transform("parts", lambda p: p["kept"])).alias(per_token))


def pooled(windows: DataFrame) -> DataFrame:
    """Questions on a pooled vector read the first window only."""
    return windows.where("w_idx = 0")


def training_windows(df: DataFrame, key: str, ids: str, tags: str, target: str, size: int, prefix: list[int] = [], suffix: list[int] = []) -> DataFrame:  # noqa: B006
    """(key, w_idx, ids, tags, target): whole windows with a margin of an eighth; template tokens have tag -1, and windows after the first no pooled target."""
    plan = plan_windows(F.size(ids), size, size // 8)
    rows = df.select(key, F.col(ids).alias("_ids"), F.col(tags).alias("_tags"), F.col(target).alias("_target"), F.posexplode(plan).alias("w_idx", "_w"))
    own = lambda c: F.slice(c, F.col("_w.start") + 1, F.col("_w.end") - F.col("_w.start"))
    none = lambda n: F.array_repeat(F.lit(-1), n)
    marked = F.concat(none(len(prefix)), own("_tags").cast("array<int>"), none(len(suffix)))
    return rows.select(key, "w_idx", _framed(own("_ids"), prefix, suffix).alias("ids"), marked.alias("tags"), F.when(F.col("w_idx") == 0, F.col("_target")).alias("target"))
