"""Probability, calibration and vector functions as Columns; all arithmetic in double."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def _d(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def sigmoid(z: Column) -> Column:
    """Stable on both sides of zero."""
    z = _d(z)
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def softplus(z: Column) -> Column:
    z = _d(z)
    return F.when(z > 30, z).when(z < -30, F.exp(z)).otherwise(F.log1p(F.exp(z)))


def scaled(z: Column, temperature: float | Column = 1.0) -> Column:
    """An array of logits over a temperature."""
    return F.transform(z, lambda x: _d(x) / _d(temperature))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once even where body has it within a lambda."""
    return F.transform(F.array(value), body)[0]


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def softmax(z: Column, temperature: float | Column = 1.0) -> Column:
    """Of an array, shifted by its maximum."""
    shifted = let(scaled(z, temperature), lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top))))
    return let(shifted, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def log_softmax(z: Column, temperature: float = 1.0) -> Column:
    """Of an array; a temperature of zero or less counts as one."""
    s = scaled(z, temperature if temperature > 0 else 1.0)
    shifted = let(s, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: x - top)))
    return let(shifted, lambda v: let(F.ln(total(F.transform(v, F.exp))), lambda n: F.transform(v, lambda x: x - n)))


def first_max(p: Column) -> Column:
    """0-based index of the greatest element, the first of equal ones."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def margin(p: Column) -> Column:
    """The greatest probability less the mean of the others; a single one is its own margin."""
    best, n = F.array_max(p), F.size(p)
    return F.when(n <= 1, best).otherwise(best - (total(p) - best) / (n - 1))


def ordinal_probs(z: Column, temperature: float = 1.0) -> Column:
    """Probabilities of K levels from K - 1 threshold logits: cumulative minimum of sigmoids, then differences."""
    low = let(F.transform(scaled(z, temperature), sigmoid), lambda above: F.transform(above, lambda _, i: F.array_min(F.slice(above, F.lit(1), i + 1))))
    return let(low, lambda g: F.zip_with(F.concat(F.array(F.lit(1.0)), g), F.concat(g, F.array(F.lit(0.0))), lambda a, b: a - b))


def expected_level(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i))


def clamp(p: Column, eps: float = EPS) -> Column:
    p = _d(p)
    return F.when(F.isnan(p), F.lit(0.5)).otherwise(F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps)))


def logit(p: Column) -> Column:
    return F.ln(clamp(p) / (1.0 - clamp(p)))


def prior_shift(train: Column | float, deploy: Column | float) -> Column:
    """What to add to a logit learned at one prior for use at another."""
    return logit(_d(deploy)) - logit(_d(train))


def at_prior(p: Column, train: Column | float, deploy: Column | float) -> Column:
    return sigmoid(logit(p) + prior_shift(train, deploy))


def evidence(risk: Column, neutral: float = 0.3, hit: float = 1.0, miss: float = 0.2, floor: float = 0.01, ceil: float = 0.99) -> Column:
    """Log-likelihood ratio of a risk, weighted on either side of neutral."""
    r = F.greatest(F.least(_d(risk), F.lit(ceil)), F.lit(floor))
    d = logit(r) - logit(F.lit(neutral))
    return F.when(d >= 0, d * hit).otherwise(d * miss)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, eps: float = 1e-24) -> Column:
    return let(F.sqrt(dot(v, v) + eps), lambda n: F.transform(v, lambda x: _d(x) / n))


def truncated(v: Column, dim: int) -> Column:
    """The first `dim` components, of unit length again."""
    return unit(F.slice(v, 1, dim))


def pair_logit(cosine: Column, log_scale: float, bias: float) -> Column:
    return _d(cosine) * float(2.718281828459045**log_scale) + bias


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return ratio((1 + b) * precision * recall, b * precision + recall)


def ratio(a: Column, b: Column) -> Column:
    """a / b in double; nothing over nothing is 0."""
    return F.coalesce(F.try_divide(_d(a), _d(b)), F.lit(0.0))


def quantized(v: Column) -> Column:
    """Integers in -127..127 and their scale: the greatest magnitude over 127, rounded half to even."""
    whole = F.array_max(F.transform(v, lambda x: F.abs(_d(x)))) / 127.0
    return let(whole, lambda scale: F.struct(scale.alias("scale"), F.transform(v, lambda x: F.when(scale > 0, F.rint(_d(x) / scale)).otherwise(0.0).cast("int")).alias("q")))


def learning_rate(step: Column, steps: int, warmup: float, peak: float) -> Column:
    """Linear warm-up, then linear decay to zero."""
    warm = max(1, int(steps * warmup))
    return F.when(step < warm, peak * (step + 1) / warm).otherwise(peak * (F.lit(float(steps)) - step) / max(1, steps - warm))


def noul_loss(z: Column, y: Column) -> Column:
    return softplus(z) - _d(y) * _d(z)


def choice_loss(p: Column, t: Column) -> Column:
    """Cross-entropy of targets t, probabilities floored at 1e-300."""
    return -total(F.zip_with(p, t, lambda x, y: _d(y) * F.ln(F.greatest(x, F.lit(1e-300)))))


def score_loss(z: Column, level: Column) -> Column:
    """The sum of the thresholds' binary losses."""
    return total(F.transform(z, lambda x, k: softplus(x) - F.when(level > k, _d(x)).otherwise(0.0)))


def distillation(student: Column, teacher: Column, temperature: float = 1.0) -> Column:
    """Squared temperature times KL(teacher || student) of two arrays of logits."""
    p, lp, lq = softmax(teacher, temperature), log_softmax(teacher, temperature), log_softmax(student, temperature)
    return temperature**2 * total(F.transform(F.arrays_zip(p.alias("p"), lp.alias("a"), lq.alias("b")), lambda x: x["p"] * (x["a"] - x["b"])))


def fnv1a64(text: Column) -> tuple[Column, Column]:
    """The FNV-1a hash of ASCII text as (high, low) halves of 32 bits; no step leaves the range of bigint."""
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))

    def step(s, c):
        lo = s["lo"].bitwiseXOR(F.ascii(c).cast("bigint"))
        low = lo * 435
        high = (s["hi"] * 435 + F.shiftright(low, 32) + lo * 256).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.struct(high.alias("hi"), low.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))

    out = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)
    return out["hi"], out["lo"]


def held(key: Column, fraction: float, seed: int, exact: bool = True) -> Column:
    """Whether a key is held out: hash of '<seed>:<key>' modulo a million, below the fraction. exact=False takes md5, which is faster on long keys."""
    full = F.concat(F.lit(f"{seed}:"), key)
    if exact:
        hi, lo = fnv1a64(full)
        part = ((hi % 1_000_000) * (2**32 % 1_000_000) + lo) % 1_000_000
    else:
        part = F.conv(F.substring(F.md5(full.cast("binary")), 1, 8), 16, 10).cast("bigint") % 1_000_000
    return part < int(round(fraction * 1_000_000))


def by_position(of: Sequence[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, of)), i + 1)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
