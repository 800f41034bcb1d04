"""Answers from logits, calibration, and the metrics of answers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .schema import Question


def noul_answer(z: Column, temperature: float = 1.0) -> Column:
    p = S.sigmoid(z / temperature)
    return F.struct(p.alias("p"), F.greatest(p, 1 - p).alias("confidence"))


def choice_answer(z: Column, options: Sequence[str], temperature: float = 1.0) -> Column:
    p = S.softmax(z, temperature)
    return F.struct(S.by_position(options, S.first_max(p)).alias("choice"), F.array_max(p).alias("confidence"), S.margin(p).alias("margin"), p.alias("probs"))


def score_answer(z: Column, temperature: float = 1.0) -> Column:
    p = S.ordinal_probs(z, temperature)
    return F.struct(S.expected_level(p).alias("score"), S.first_max(p).alias("level"), F.array_max(p).alias("confidence"), p.alias("probs"))


def answers(df: DataFrame, questions: Sequence[Question], logits: str = "logits", temperatures: Mapping[str, float] | None = None) -> DataFrame:
    """df with `answers`: a struct of each question's answer, from a map of its name to its logits; null where it has none."""
    of = temperatures or {}

    def one(q: Question) -> Column:
        z, t = F.col(logits)[q.name], of.get(q.name, 1.0)
        answer = noul_answer(F.get(z, F.lit(0)), t) if q.kind == "noul" else choice_answer(z, q.options, t) if q.kind == "choice" else score_answer(z, t)
        return F.when(z.isNotNull(), answer).alias(q.name)

    return df.withColumn("answers", F.struct(*[one(q) for q in questions if q.kind != "spans"]))


def answer_rows(df: DataFrame, questions: Sequence[Question], key: str, logits: str = "logits", temperatures: Mapping[str, float] | None = None) -> DataFrame:
    """(key, question, value, confidence): one row an answer; value: p, the option's name, or the expected level."""
    rows = answers(df, questions, logits, temperatures)
    value = {"noul": "p", "choice": "choice", "score": "score"}
    each = [F.struct(F.lit(q.name).alias("question"), F.col(f"answers.{q.name}.{value[q.kind]}").cast("string").alias("value"), F.col(f"answers.{q.name}.confidence").alias("confidence")) for q in questions if q.kind != "spans"]
    return rows.select(key, F.explode(F.array(*each)).alias("_x")).select(key, "_x.*").where("confidence IS NOT NULL")


def restricted(probs: Column, options: Column) -> Column:
    """A map of probabilities cut to the options asked for and renormalised; uniform if nothing is left."""
    kept = F.map_filter(probs, lambda k, _: F.array_contains(options, k))
    total = S.total(F.map_values(kept))
    return F.map_from_arrays(options, F.transform(options, lambda o: F.when(total > 0, F.coalesce(kept[o], F.lit(0.0)) / total).otherwise(1.0 / F.size(options))))


def noul_metrics(df: DataFrame, z: str = "z", y: str = "y", by: str | None = None) -> DataFrame:
    """n, accuracy, precision, recall, f1, brier and nll; by a column also its groups, besides the total."""
    p, t = S.sigmoid(F.col(z)), F.col(y).cast("double")
    yes, gold = p >= 0.5, t >= 0.5
    hit = lambda c: F.sum(c.cast("int"))
    aggs = [F.count("*").alias("n"), F.avg((yes == gold).cast("double")).alias("accuracy"), hit(yes & gold).alias("tp"), hit(yes).alias("found"), hit(gold).alias("gold"), F.avg(F.pow(p - t, F.lit(2.0))).alias("brier"), F.avg(S.noul_loss(F.col(z), t)).alias("nll")]
    if by:
        out = df.withColumn("group", F.coalesce(by, F.lit(""))).rollup("group").agg(*aggs, F.grouping("group").alias("total"))
    else:
        out = df.agg(*aggs)
    precision, recall = S.ratio(F.col("tp"), F.col("found")), S.ratio(F.col("tp"), F.col("gold"))
    return out.withColumns({"precision": precision, "recall": recall, "f1": S.f_beta(precision, recall)}).drop("tp", "found", "gold")


def auc(df: DataFrame, z: str = "z", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve with average ranks; null with one class only.

    Counts by distinct score come first. The running count then goes over ranges of scores:
    their sums are few, and each range runs on its own.
    """
    by = by or []
    pos = (F.col(y) >= 0.5).cast("long")
    per = df.groupBy(*by, F.col(z).alias("z")).agg(F.count("*").alias("n"), F.sum(pos).alias("p"))
    per = per.withColumn("bin", F.floor(S.sigmoid(F.col("z")) * 4096))
    bins = per.groupBy(*by, "bin").agg(F.sum("n").alias("bn"))
    bins = bins.withColumn("below", F.sum("bn").over(Window.partitionBy(*by, F.lit(0)).orderBy("bin")) - F.col("bn")).drop("bn")  # 4096 rows a group at most
    inner = F.sum("n").over(Window.partitionBy(*by, "bin").orderBy("z")) - F.col("n")
    ranked = per.withColumn("inner", inner).join(F.broadcast(bins) if not by else bins, [*by, "bin"])
    rank = F.col("below") + F.col("inner") + (F.col("n") + 1) / 2.0
    out = ranked.groupBy(*by).agg(F.sum("p").cast("double").alias("np"), F.sum(F.col("n") - F.col("p")).cast("double").alias("nn"), F.sum(F.col("p") * rank).alias("r"))
    return out.select(*by, F.try_divide(F.col("r") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * F.col("nn")).alias("auc"))


def quantiles(df: DataFrame, by: str, value: str, at: list[float]) -> DataFrame:
    """(by, q, at, n): of each group the least value that a share q of its rows does not exceed, nulls left out.

    Values are counted first; the running count goes over ranges of values, whose sums are few, and each range runs on its own.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ends = per.groupBy(by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("n"))
    per = per.join(ends, per[by].eqNullSafe(ends[by])).drop(ends[by])
    share = F.coalesce(F.try_divide((F.col("_v") - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0))
    per = per.withColumn("_bin", F.floor(share * 4096))
    bins = per.groupBy(F.col(by).alias("_by"), F.col("_bin").alias("_b")).agg(F.sum("_c").alias("_bn"))
    bins = bins.withColumn("_below", F.sum("_bn").over(Window.partitionBy("_by").orderBy("_b")) - F.col("_bn")).drop("_bn")  # 4097 rows a group at most
    ranked = per.withColumn("_upto", F.sum("_c").over(Window.partitionBy(by, "_bin").orderBy("_v"))).join(bins, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bin") == F.col("_b")))
    out = ranked.withColumn("q", F.explode(F.array(*map(F.lit, at)))).where(F.col("_below") + F.col("_upto") >= F.ceil(F.col("q") * F.col("n")))
    return out.groupBy(by, "q").agg(F.min("_v").alias("at"), F.max("n").alias("n"))


def ece(df: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width."""
    per = df.select(F.least(F.floor(confidence * bins), F.lit(bins - 1)).alias("b"), confidence.alias("c"), correct.cast("double").alias("ok")).groupBy("b").agg(F.count("*").alias("n"), F.avg("c").alias("c"), F.avg("ok").alias("ok"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("ok"))) / F.sum("n")).alias("ece"))


def macro_f1(df: DataFrame, gold: str, found: str) -> DataFrame:
    """Mean F1 over the options that occur as gold."""
    both = df.select(F.explode(F.array(F.struct(F.col(gold).alias("o"), F.lit(1).alias("g"), F.lit(0).alias("f"), F.lit(0).alias("tp")), F.struct(F.col(found).alias("o"), F.lit(0).alias("g"), F.lit(1).alias("f"), (F.col(gold) == F.col(found)).cast("int").alias("tp")))).alias("x")).select("x.*")
    per = both.groupBy("o").agg(F.sum("g").alias("g"), F.sum("f").alias("f"), F.sum("tp").alias("tp")).where("g > 0")
    return per.agg(F.avg(S.f_beta(S.ratio(F.col("tp"), F.col("f")), S.ratio(F.col("tp"), F.col("g")))).alias("macro_f1"))


def priors(df: DataFrame, questions: list[str]) -> DataFrame:
    """Mean target of each noul question over the rows that have it."""
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col(q).cast("double").alias("t")) for q in questions]))
    return df.select(each.alias("x")).select("x.*").groupBy("question").agg(F.count("t").alias("n"), F.avg("t").alias("prior"))


def nll_grid(df: DataFrame, temperatures: Sequence[float], z: str = "z", y: str = "y") -> DataFrame:
    """Mean loss of a noul question at each temperature, in one pass over the rows."""
    means = df.agg(*[F.avg(S.noul_loss(F.col(z) / float(t), F.col(y))).alias(f"t{i}") for i, t in enumerate(temperatures)])
    return means.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(temperatures)])).alias("x")).select("x.*")


def fit_temperature(loss: Callable[[list[float]], list[float]], width: int = 12, rounds: int = 4) -> float:
    """The temperature in [0.05, 20] of least loss: grids of `width` values in log space, each a single pass, narrowing around the best."""
    import math

    lo, hi = math.log(0.05), math.log(20)
    for _ in range(rounds):
        grid = [math.exp(lo + (hi - lo) * i / (width - 1)) for i in range(width)]
        values = loss(grid)
        i = values.index(min(values))
        lo, hi = math.log(grid[max(0, i - 1)]), math.log(grid[min(width - 1, i + 1)])
    return math.exp((lo + hi) / 2)


def calibrate(df: DataFrame, z: str = "z", y: str = "y") -> float:
    """Temperature of a noul question; 1 if the labels are hard and every answer is right, as nothing is to learn then."""
    hard = F.col(y).isin(0, 1)
    apart = df.agg(F.bool_and(hard & ((F.col(z) >= 0) == (F.col(y) >= 0.5)))).first()[0]
    if apart is None or apart:
        return 1.0
    return fit_temperature(lambda ts: [r["nll"] for r in nll_grid(df, ts, z, y).orderBy("temperature").collect()])


def span_metrics(found: DataFrame, gold: DataFrame, key: str = "ex_id") -> DataFrame:
    """Precision, recall, F1 and F2 of spans by type and in all ('*'); each gold span matches once."""
    cols = [key, "start", "end", "type"]
    f, g = (df.groupBy(*cols).agg(F.count("*").alias(n)) for df, n in ((found, "f"), (gold, "g")))
    both = f.join(g, cols, "full").fillna(0, ["f", "g"]).withColumn("tp", F.least("f", "g"))
    per = both.rollup("type").agg(F.sum("f").alias("found"), F.sum("g").alias("gold"), F.sum("tp").alias("tp"))
    p, r = S.ratio(F.col("tp"), F.col("found")), S.ratio(F.col("tp"), F.col("gold"))
    return per.select(F.coalesce("type", F.lit("*")).alias("type"), "found", "gold", p.alias("precision"), r.alias("recall"), S.f_beta(p, r).alias("f1"), S.f_beta(p, r, 2.0).alias("f2"))
