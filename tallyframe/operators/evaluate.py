"""Metrics of a whole schema: noul, choice and score questions side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import decide
from .schema import Question

METRICS = ("accuracy", "nll", "brier", "mae", "ece", "precision", "recall", "f1", "auc", "macro_f1")


def _row(df: DataFrame, question: str, **have: Column) -> DataFrame:
    return df.select(F.lit(question).alias("question"), "n", *[have.get(m, F.lit(None)).cast("double").alias(m) for m in METRICS])


def macro_f1_of_targets(df: DataFrame, k: int, target: str = "t", choice: str = "choice") -> DataFrame:
    """Mean F1 over the options that some target prefers; all options at a target's maximum count as right. choice: index of the answer."""
    best = F.array_max(target)
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(i.alias("o"), (F.get(F.col(target), i) == best).cast("int").alias("g"), (F.col(choice) == i).cast("int").alias("f"))))
    per = df.select(each.alias("x")).select("x.*").groupBy("o").agg(F.sum("g").alias("g"), F.sum("f").alias("f"), F.sum(F.col("g") * F.col("f")).alias("tp")).where("g > 0")
    return per.agg(F.avg(S.f_beta(S.ratio(F.col("tp"), F.col("f")), S.ratio(F.col("tp"), F.col("g")))).alias("macro_f1"))


def noul(df: DataFrame, question: Question, temperature: float = 1.0) -> DataFrame:
    """df (z, t): arrays of one logit and one target."""
    rows = df.select((F.get("z", F.lit(0)) / temperature).alias("z"), F.get("t", F.lit(0)).alias("y"))
    p = S.sigmoid(F.col("z"))
    calibration = decide.ece(rows, F.greatest(p, 1 - p), (p >= 0.5) == (F.col("y") >= 0.5))
    out = decide.noul_metrics(rows).crossJoin(calibration).crossJoin(decide.auc(rows))  # a row each
    return _row(out, question.name, **{m: F.col(m) for m in ("accuracy", "nll", "brier", "precision", "recall", "f1", "ece", "auc")})


def choice(df: DataFrame, question: Question, temperature: float = 1.0) -> DataFrame:
    """df (z, t): logits and a distribution over the options."""
    p = S.softmax(F.col("z"), temperature)
    rows = df.select("t", p.alias("p")).withColumn("choice", S.first_max(F.col("p")).cast("int"))
    rows = rows.withColumn("ok", F.get("t", F.col("choice")) == F.array_max("t")).withColumn("loss", S.choice_loss(F.col("p"), F.col("t")))
    one = rows.agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"), F.avg("loss").alias("nll"))
    out = one.crossJoin(decide.ece(rows, F.array_max("p"), F.col("ok"))).crossJoin(macro_f1_of_targets(rows, len(question.options)))  # a row each
    return _row(out, question.name, **{m: F.col(m) for m in ("accuracy", "nll", "ece", "macro_f1")})


def score(df: DataFrame, question: Question, temperature: float = 1.0) -> DataFrame:
    """df (z, t): thresholds' logits and an array of the level."""
    level = F.get("t", F.lit(0)).cast("int")
    p = S.ordinal_probs(F.col("z"), temperature)
    rows = df.select(level.alias("y"), p.alias("p"), S.score_loss(F.transform("z", lambda x: x / temperature), level).alias("loss"))
    rows = rows.withColumn("ok", S.first_max(F.col("p")) == F.col("y"))
    mae = F.abs(S.expected_level(F.col("p")) - F.col("y"))
    one = rows.agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"), F.avg("loss").alias("nll"), F.avg(mae).alias("mae"))
    out = one.crossJoin(decide.ece(rows, F.array_max("p"), F.col("ok")))  # a row each
    return _row(out, question.name, **{m: F.col(m) for m in ("accuracy", "nll", "mae", "ece")})


def evaluate(rows: DataFrame, questions: Sequence[Question], temperatures: Mapping[str, float] | None = None) -> DataFrame:
    """rows (question, z, t), those without a target left out -> one row a question that is not of spans: n and METRICS, null where a metric is not of its kind."""
    known = rows.where(F.col("t").isNotNull())
    out = None
    for q in questions:
        if q.kind == "spans":
            continue
        one = {"noul": noul, "choice": choice, "score": score}[q.kind](known.where(F.col("question") == q.name), q, (temperatures or {}).get(q.name, 1.0))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no question to evaluate")
    return out


def token_metrics(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    """rows (z, tag) of tokens, tag -1 being none: n, accuracy, nll and ece over tags."""
    p = S.softmax(F.col("z"), temperature)
    known = rows.where("tag >= 0").select("tag", p.alias("p")).withColumn("ok", S.first_max(F.col("p")) == F.col("tag"))
    loss = -F.ln(F.greatest(F.get("p", F.col("tag").cast("int")), F.lit(1e-300)))
    one = known.agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"), F.avg(loss).alias("nll"))
    return one.crossJoin(decide.ece(known, F.array_max("p"), F.col("ok")))  # a row each


def calibrate_spans(rows: DataFrame, before: float = 1.0) -> float:
    """The temperature of tags of tokens (z, tag) of least loss; `before` stays if there are none or every tag wins already."""
    known = rows.where("tag >= 0").select("z", F.col("tag").cast("int").alias("tag"))
    apart = known.agg(F.bool_and(F.get("z", F.col("tag")) >= F.array_max("z"))).first()[0]
    if apart is None or apart:
        return before

    def loss(temperatures: list[float]) -> list[float]:
        means = [F.avg(-F.get(S.log_softmax(F.col("z"), t), F.col("tag"))).alias(f"t{i}") for i, t in enumerate(temperatures)]
        return list(known.agg(*means).first())

    return decide.fit_temperature(loss)


def hidden_mse(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays of numbers."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def mean_pool(tokens: Column) -> Column:
    """The mean of rows of numbers; null without one."""
    zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(tokens, zero, lambda s, row: F.zip_with(s, row, lambda x, y: x + y))
    return F.when(F.size(tokens) > 0, F.transform(total, lambda x: x / F.size(tokens)))


def first_pool(tokens: Column) -> Column:
    return F.get(tokens, F.lit(0))


def info_nce(pairs: DataFrame, symmetric: bool = False, temperature: float = 1.0) -> DataFrame:
    """pairs (batch, query_id, candidate, z, positive, masked) -> (batch, loss): mean over queries of the cross-entropy of their positive against the candidates that are not masked; symmetric: the mean of both directions, documents asking for queries."""

    def one_way(key: str) -> DataFrame:
        rows = pairs.where(~F.col("masked")).select("batch", key, (F.col("z") / temperature).alias("z"), "positive")
        top = rows.groupBy("batch", key).agg(F.max("z").alias("top"), F.max(F.when(F.col("positive"), F.col("z"))).alias("own"), F.collect_list("z").alias("zs"))  # a batch's width
        loss = F.ln(F.aggregate("zs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))) + F.col("top") - F.col("own")
        return top.where("own IS NOT NULL").groupBy("batch").agg(F.avg(loss).alias("loss"))

    there = one_way("query_id")
    if not symmetric:
        return there
    back = one_way("candidate").withColumnRenamed("loss", "back")
    return there.join(back, "batch").select("batch", ((F.col("loss") + F.col("back")) / 2).alias("loss"))
