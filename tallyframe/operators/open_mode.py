"""Open categories: options described in words are prototypes in embedding space."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

SCALE = 20.0
#: Prototypes are broadcast up to this many; more are joined by a shuffle, in blocks of about as many, with groups of texts.
MAX_BROADCAST, TEXT_GROUPS = 10_000, 16


@dataclass(frozen=True)
class Candidate:
    name: str
    description: str = ""
    examples: tuple[str, ...] = ()


def candidate_context(name: Column, description: Column) -> Column:
    return F.when(F.coalesce(description, F.lit("")) == "", name).otherwise(F.concat_ws("\n", name, description))


def open_noul(instructions: str, otherwise: str = "None of this applies.") -> list[Candidate]:
    return [Candidate("true", instructions), Candidate("false", otherwise)]


def prototypes(vectors: DataFrame, option: str, vector: str) -> DataFrame:
    """(option, proto): the unit vector of the sum of each option's unit vectors; sums by component are partial on each side of the shuffle."""
    parts = vectors.where(F.col(option).isNotNull()).select(F.col(option).alias("option"), F.posexplode(S.unit(F.col(vector))).alias("i", "x"))
    sums = parts.groupBy("option", "i").agg(F.sum("x").alias("x")).groupBy("option").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return sums.select("option", S.unit(F.transform("v", lambda s: s["x"])).alias("proto"))


def cosines(texts: DataFrame, vector: str, protos: DataFrame) -> DataFrame:
    """Each text with `cosines`: an array of (cosine, option) in the order of options. Up to MAX_BROADCAST prototypes ride along as one small row."""
    if protos.limit(MAX_BROADCAST + 1).count() > MAX_BROADCAST:
        return _blocked(texts, vector, protos)
    one = protos.groupBy().agg(F.array_sort(F.collect_list(F.struct("option", "proto"))).alias("protos"))
    unit = texts.withColumn("_unit", S.unit(F.col(vector)))
    return unit.join(F.broadcast(one)).withColumn("cosines", _with_all()).drop("protos", "_unit")


def _with_all() -> Column:
    return F.transform("protos", lambda c: F.struct(S.dot(F.col("_unit"), c["proto"]).alias("cosine"), c["option"].alias("option")))


def _blocked(texts: DataFrame, vector: str, protos: DataFrame) -> DataFrame:
    """cosines() of many prototypes: each group of texts meets each block of prototypes by a shuffle; a second one puts a text's cosines together."""
    blocks = -(-protos.count() // MAX_BROADCAST)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    parts = protos.groupBy(F.pmod(F.xxhash64("option"), F.lit(blocks)).cast("int").alias("_block")).agg(F.collect_list(F.struct("option", "proto")).alias("protos")).withColumn("_group", all_of(TEXT_GROUPS))
    unit = texts.select(F.struct("*").alias("_row"), S.unit(F.col(vector)).alias("_unit"), F.monotonically_increasing_id().alias("_id"))
    unit = unit.withColumn("_group", F.pmod(F.xxhash64("_id"), F.lit(TEXT_GROUPS)).cast("int")).withColumn("_block", all_of(blocks))
    met = unit.join(parts.hint("shuffle_hash"), ["_group", "_block"]).select("_id", "_row", _with_all().alias("cosines"))
    out = met.groupBy("_id").agg(F.first("_row").alias("_row"), F.flatten(F.collect_list("cosines")).alias("c"))
    in_order = F.array_sort(F.transform("c", lambda x: F.struct(x["option"].alias("option"), x["cosine"].alias("cosine"))))
    return out.select("_row.*", F.transform(in_order, lambda x: F.struct(x["cosine"].alias("cosine"), x["option"].alias("option"))).alias("cosines"))


def choose_in(texts: DataFrame, vector: str, protos: DataFrame, scale: float = SCALE) -> DataFrame:
    """Each text with choice, confidence, margin and cosine: softmax of scaled cosines, the first of equal ones."""
    z = F.transform("cosines", lambda c: c["cosine"] * scale)
    out = cosines(texts, vector, protos).withColumn("_p", S.softmax(z)).withColumn("_at", S.first_max(F.col("_p")))
    best = F.get("cosines", F.col("_at"))
    return out.select(*texts.columns, best["option"].alias("choice"), F.get("_p", F.col("_at")).alias("confidence"), S.margin(F.col("_p")).alias("margin"), best["cosine"].alias("cosine"), F.col("_p").alias("probs"))


def choose_among(pairs: DataFrame, key: str, candidate: str, z: str) -> DataFrame:
    """The best candidate of each key by pair logits: softmax over the key's candidates; ties go to the first name."""
    own = Window.partitionBy(key)
    p = F.exp(F.col(z) - F.max(z).over(own))
    scored = pairs.withColumn("p", p).withColumn("p", F.col("p") / F.sum("p").over(own))
    best = F.row_number().over(own.orderBy(F.desc("p"), candidate))
    return scored.withColumn("_r", best).where("_r = 1").drop("_r")


def open_score(probs: Column) -> Column:
    return S.expected_level(probs)
