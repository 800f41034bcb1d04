"""Closed-form facts, invariants, and every registered query against DuckDB on the smallest tables."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import scalar as S
from tallyframe.operators import consensus, data, decide, schema, spans, training
from tallyframe.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_closed_forms(spark):
    assert abs(one(spark, S.at_prior(F.lit(0.9), 0.5, 0.02)) - 0.15517) < 1e-4
    assert abs(one(spark, S.evidence(F.lit(0.3)))) < 1e-12
    assert one(spark, S.truncated(F.array(F.lit(3.0), F.lit(4.0), F.lit(12.0)), 2)) == pytest.approx([0.6, 0.8])
    p = one(spark, S.ordinal_probs(F.array(F.lit(-1.0), F.lit(2.0))))
    assert min(p) >= 0 and abs(sum(p) - 1) < 1e-12
    t = one(spark, schema.choice_target(F.array(F.lit("a"), F.lit("b")), F.lit(""), F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(3.0))))
    assert t == [0.25, 0.75]
    assert one(spark, consensus.soft_choice(F.array(*map(F.lit, "abc")), F.lit("a"), F.lit(0.9))) == pytest.approx([0.9, 0.05, 0.05])


def test_optimizer():
    g = [np.array([3.0]), np.array([4.0])]
    assert training.clip(g) == 5 and g[0][0] == pytest.approx(0.6) and g[1][0] == pytest.approx(0.8)
    p = [np.array([1.0])]
    training.AdamW(0.1, 0.0).step(p, [np.array([1.0])])
    assert p[0][0] == pytest.approx(0.9, abs=1e-6)


def test_schema_rules():
    schema.validate([schema.noul("a"), schema.choice("b", "", "x", "y")])
    for bad in ([], [schema.noul("A")], [schema.noul("a"), schema.noul("a")], [schema.choice("a", "", "x")], [schema.choice("a", "", "x", "x")], [schema.spans("a", "", *map(str, range(64)))]):
        with pytest.raises(ValueError):
            schema.validate(bad)


def test_viterbi_against_all_sequences():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        logp = np.log(rnd.dirichlet(np.ones(5), 3))
        best = max((sum(logp[i, t] for i, t in enumerate(s)), s) for s in np.ndindex(5, 5, 5) if all(not (t and t % 2 == 0) or (i and s[i - 1] in (t, t - 1)) for i, t in enumerate(s)))
        assert tuple(spans.viterbi(logp)) == best[1]


def test_windows_cover_each_token_once(spark):
    for n, size, margin in ((1, 4, 1), (100, 16, 4), (1000, 128, 8), (37, 5, 9)):
        w = one(spark, spans.plan_windows(F.lit(n), size, margin))
        kept = [t for x in w for t in range(x.keep_from, x.keep_to)]
        assert kept == list(range(n)) and all(x.end - x.start <= size and x.start <= x.keep_from and x.keep_to <= x.end for x in w)


def test_trim():
    for text, want in (("(Paris),", "Paris"), ("Smith (Jr)", "Smith (Jr)"), ("U.S.", "U.S."), ("...", "..."), ('"x"', "x"), ("(", "(")):
        a, b = spans.trim(text)
        assert text[a:b] == want


def test_hold_out_is_stable_and_whole(spark):
    rows = [(f"t{i}", f"f{i % 50}") for i in range(200)]
    key = data.split_key(F.col("family"), F.lit(""), F.col("text"))
    before = {r.text: (r.family, r.held) for r in data.hold_out(spark.createDataFrame(rows, "text string, family string"), key, 0.3, 1).collect()}
    after = {r.text: (r.family, r.held) for r in data.hold_out(spark.createDataFrame([*rows, ("new", "f0")], "text string, family string"), key, 0.3, 1).collect()}
    assert all(after[t] == v for t, v in before.items())
    assert all(len({h for f, h in before.values() if f == g}) == 1 for g in {f for f, _ in before.values()})


def test_calibration_recovers_a_temperature(spark):
    rnd = random.Random(3)
    zs = [rnd.gauss(0, 2) for _ in range(4000)]
    rows = [(3.0 * z, int(rnd.random() < 1 / (1 + math.exp(-z)))) for z in zs]
    assert 2.4 < decide.calibrate(spark.createDataFrame(rows, "z double, y int")) < 3.7


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def _rows(table):
    cols = sorted(table.column_names)
    plain = lambda x: "" if x is None else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return cols, sorted(tuple(map(plain, r)) for r in zip(*[table.column(c).to_pylist() for c in cols]))


@pytest.mark.parametrize("name", [n for n in registry.queries() if n != "windowed_rates"])
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, D).toArrow()
    if name in registry.oracle_sql():
        assert _rows(got) == _rows(duck.execute(registry.oracle_sql()[name]).to_arrow_table())
    else:
        assert got.num_rows >= 0
