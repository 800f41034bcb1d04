"""Splits, sampling and batching of examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def split_key(family: Column, context: Column, text: Column, by: str = "family") -> Column:
    own = F.concat(F.lit("text:"), F.coalesce(context, F.lit("")), F.lit("\0"), text)
    return own if by == "example" else F.when(F.coalesce(family, F.lit("")) != "", F.concat(F.lit("family:"), family)).otherwise(own)


def hold_out(df: DataFrame, key: Column, fraction: float, seed: int, exact: bool = True) -> DataFrame:
    """df with `held`; a family moves as one, and rows added later do not move others."""
    return df.withColumn("held", S.held(key, fraction, seed, exact))


def train_calib_test(df: DataFrame, key: Column, seed: int, test: float = 0.1, calib: float = 0.05, exact: bool = True) -> DataFrame:
    """df with `split`: test first, then calibration out of the rest."""
    return df.withColumn("split", F.when(S.held(key, test, seed, exact), "test").when(S.held(key, calib, seed + 1, exact), "calib").otherwise("train"))


def families(df: DataFrame, family: str = "family") -> DataFrame:
    return df.groupBy(F.coalesce(family, F.lit("")).alias("family")).agg(F.count("*").alias("n")).orderBy("family")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """An order that depends on seed and key only, not on partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def gazetteer(df: DataFrame, alpha: float = 1.0, least: float = 0.0, prefix: int = 3) -> DataFrame:
    """(value, weight) -> flattened weights and their running sum, in the order of values; an alpha of zero or less is one.

    Values are summed within groups of one beginning, and the sums of the groups before are added.
    """
    kept = df.where((F.col("weight") > 0) & (F.col("weight") >= least)).withColumn("weight", F.pow("weight", F.lit(alpha if alpha > 0 else 1.0)))
    kept = kept.withColumn("_at", F.substring("value", 1, prefix))
    groups = kept.groupBy("_at").agg(F.sum("weight").alias("_w"))
    groups = groups.select("_at", (F.sum("_w").over(Window.partitionBy(F.lit(0)).orderBy("_at")) - F.col("_w")).alias("_before"))
    within = F.sum("weight").over(Window.partitionBy("_at").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("cum", within).join(groups, "_at").withColumn("cum", F.col("cum") + F.col("_before")).drop("_at", "_before")


def picks(draws: DataFrame, flat: DataFrame, per_cell: int = 64) -> DataFrame:
    """draws (.., u in [0, 1)) with the value that u falls on. The whole weight is cut into equal cells, some `per_cell` values each, and draws meet the values of their cell."""
    whole = flat.agg(F.max("cum").alias("total"), F.count("*").alias("n")).first()
    cells, total = max(1, whole["n"] // per_cell), whole["total"] or 1.0
    cell = lambda x: F.least(F.floor(x / total * cells), F.lit(cells - 1))
    spans = flat.select("value", F.col("cum").alias("_hi"), (F.col("cum") - F.col("weight")).alias("_lo"))
    spans = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    out = draws.withColumn("_goal", F.col("u") * total).withColumn("_cell", cell(F.col("_goal"))).join(spans, "_cell")
    return out.where((F.col("_goal") >= F.col("_lo")) & (F.col("_goal") < F.col("_hi"))).drop("_cell", "_goal", "_lo", "_hi")


def candidate_pairs(examples: DataFrame, options: list[str], correct: str) -> DataFrame:
    """Each example with every option and whether it is the right one."""
    return examples.withColumn("candidate", F.explode(F.array(*map(F.lit, options)))).withColumn("label", (F.col("candidate") == F.col(correct)).cast("double"))


def length_batches(df: DataFrame, length: str, key: str, size: int, seed: int, window: int = 50) -> DataFrame:
    """df with `batch`: a seeded order is cut into windows of `window` batches, each sorted by length and cut into batches."""
    dealt = df.withColumn("w", F.pmod(F.xxhash64(F.lit(seed), key), F.greatest(F.lit(1), F.lit(df.count() // (size * window) + 1))))
    rank = F.row_number().over(Window.partitionBy("w").orderBy(length, F.xxhash64(F.lit(seed), key), key)) - 1
    return dealt.withColumn("batch", F.struct("w", F.floor(rank / size).alias("n"))).drop("w")


def choice_batches(labels: DataFrame, size: int, seed: int, share: int = 50_000) -> DataFrame:
    """labels (ex_id, question, option) -> the batch of each, `size` to a batch and question in a seeded order.

    Ranks are made within buckets of about `share` rows by hash and then shifted by the counts
    of the buckets before, so that no question is sorted in one task.
    """
    parts = labels.count() // share + 1
    order = F.xxhash64(F.lit(seed), "ex_id")
    dealt = labels.withColumn("o", order).withColumn("part", F.floor((F.col("o") / F.lit(2.0**63) + 1) * (parts / 2)).cast("int"))
    count = dealt.groupBy("question", "part").agg(F.count("*").alias("n"))
    before = count.withColumn("before", F.sum("n").over(Window.partitionBy("question").orderBy("part")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("question", "part").orderBy("o", "ex_id")) - 1
    out = dealt.withColumn("r", rank).join(before, ["question", "part"])
    return out.select("ex_id", "question", "option", F.floor((F.col("r") + F.col("before")) / size).alias("batch"))


def search_batches(pairs: DataFrame, size: int, seed: int, share: int = 50_000) -> DataFrame:
    """pairs (query_id, document_id, ..) with `batch`: no batch has a query twice, and no pair is lost.

    Pairs are dealt by hash to groups of about `share`; the rank of a pair among its query's
    pairs of the group makes the layer, and a layer, in which each query occurs once, is cut
    into batches.
    """
    groups = max(1, pairs.count() // share)
    h = F.xxhash64(F.lit(seed), "query_id", "document_id")
    dealt = pairs.withColumn("h", h).withColumn("g", F.pmod("h", F.lit(groups)))
    layer = F.row_number().over(Window.partitionBy("g", "query_id").orderBy("h", "document_id"))
    dealt = dealt.withColumn("layer", layer)
    rank = F.row_number().over(Window.partitionBy("g", "layer").orderBy("h", "query_id")) - 1
    return dealt.withColumn("batch", F.struct("g", "layer", F.floor(rank / size).alias("n"))).drop("h", "g", "layer")


def relevance_mask(batch: DataFrame, relevant: DataFrame) -> DataFrame:
    """batch (batch, query_id, document_id): each query against its batch's documents; masked if relevant and not the target."""
    docs = batch.select("batch", F.col("document_id").alias("candidate")).distinct()
    cross = batch.join(docs, "batch")
    known = relevant.select("query_id", F.col("document_id").alias("candidate"), F.lit(True).alias("rel")).distinct()
    out = cross.join(known, ["query_id", "candidate"], "left")
    return out.select("batch", "query_id", "document_id", "candidate", (F.col("candidate") == F.col("document_id")).alias("positive"), (F.coalesce("rel", F.lit(False)) & (F.col("candidate") != F.col("document_id"))).alias("masked"))


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys, nulls being equal, those that are first in order; found by partial aggregation."""
    best = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(order).alias("_first"))
    same = F.col(order).eqNullSafe(F.col("_first"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(best, same, "left_semi")


def previous(rows: DataFrame, key: str, order: str, value: str, name: str, span: int = 1000) -> DataFrame:
    """rows with `name`: the value of the row before by a numeric order within the key, equal ones by value; nulls are last.

    Ranges of `span` numbers are sorted one by one, and only their last values by key: a long key is not one task's sort.
    """
    at, own = F.floor(F.col(order) / span), [F.col(order).asc_nulls_last(), F.col(value).asc_nulls_first()]
    ranges = rows.groupBy(F.col(key).alias("_k"), at.alias("_a")).agg(F.max(F.struct(order, value))[value].alias("_last"))
    ranges = ranges.withColumn("_before", F.lag("_last").over(Window.partitionBy("_k").orderBy(F.col("_a").asc_nulls_last()))).drop("_last")
    within = Window.partitionBy(key, "_at").orderBy(*own)
    out = rows.withColumn("_at", at).withColumn("_n", F.row_number().over(within)).withColumn("_lag", F.lag(value).over(within))
    out = out.join(ranges, F.col(key).eqNullSafe(F.col("_k")) & F.col("_at").eqNullSafe(F.col("_a")), "left")
    return out.select(*rows.columns, F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag")).alias(name))
