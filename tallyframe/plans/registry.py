"""All registered queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T
from ..functions import tokens
from ..operators import consensus as C
from ..operators import data, decide, encoder, evaluate, labelled, requests, schema, spans, synth, training, windows
from ..operators import open_mode as O
from ..sources import examples as X
from ..streaming import live

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c, n: int = 6):
    return F.round(c, n)


# ---- open mode

_PROTO = """
WITH u AS (SELECT vec_id, label, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id) + 1e-24) AS x
           FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
s AS (SELECT label AS option, i, sum(x) AS x FROM u WHERE label IS NOT NULL GROUP BY ALL),
p AS (SELECT option, i, x / sqrt(sum(x * x) OVER (PARTITION BY option) + 1e-24) AS x FROM s),
c AS (SELECT vec_id, label, option, sum(u.x * p.x) AS cosine FROM u JOIN p USING (i) GROUP BY ALL),
e AS (SELECT *, exp(20 * cosine - max(20 * cosine) OVER (PARTITION BY vec_id)) AS e FROM c),
q AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, option) AS r, count(*) OVER (PARTITION BY vec_id) AS k FROM e)
"""


def _chosen(spark, d):
    v = _t(spark, d, "embeddings")
    return O.choose_in(v, "embedding", O.prototypes(v, "label", "embedding"))


@query(_PROTO + "SELECT vec_id, label, option AS choice, round(p, 6) AS confidence, round(p - (1 - p) / (k - 1), 6) AS margin, round(cosine, 6) AS cosine FROM q WHERE r = 1")
def open_nearest(spark, d):
    return _chosen(spark, d).select("vec_id", "label", "choice", _r("confidence").alias("confidence"), _r("margin").alias("margin"), _r("cosine").alias("cosine"))


@query(_PROTO + "SELECT coalesce(label::VARCHAR, '*') AS label, count(*) AS n, round(avg((label = option)::INT::DOUBLE), 6) AS accuracy FROM q WHERE r = 1 GROUP BY ROLLUP (label)")
def open_accuracy_by_label(spark, d):
    out = _chosen(spark, d).rollup("label").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("choice")).cast("double")).alias("a"))
    return out.select(F.coalesce(F.col("label").cast("string"), F.lit("*")).alias("label"), "n", _r("a").alias("accuracy"))


@query(_PROTO + "SELECT vec_id, round(cosine, 6) AS cosine FROM q WHERE r = 1 AND cosine < 0.5")
def open_unmatched(spark, d):
    return _chosen(spark, d).where("cosine < 0.5").select("vec_id", _r("cosine").alias("cosine"))


@query(_PROTO + "SELECT vec_id, round(sum(option * p), 6) AS score FROM q GROUP BY vec_id")
def open_score_level(spark, d):
    return _chosen(spark, d).select("vec_id", _r(O.open_score(F.col("probs"))).alias("score"))


@query("""SELECT vec_id, i::INT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id) + 1e-24), 6) AS x
FROM (SELECT vec_id, unnest(embedding[1:16])::DOUBLE AS x, generate_subscripts(embedding[1:16], 1) AS i FROM embeddings)""")
def truncate_matryoshka(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.posexplode(S.truncated(F.col("embedding"), 16)).alias("i", "x")).select("vec_id", (F.col("i") + 1).alias("i"), _r("x").alias("x"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT AS i FROM embeddings),
s AS (SELECT *, max(abs(x)) OVER (PARTITION BY vec_id) / 127.0 AS scale FROM v)
SELECT vec_id, i, round_even(x / scale, 0)::INT AS q, round(scale, 8) AS scale FROM s""")
def int8_rows(spark, d):
    q = _t(spark, d, "embeddings").select("vec_id", S.quantized(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.posexplode("q.q").alias("i", "v"), _r("q.scale", 8).alias("scale")).select("vec_id", (F.col("i") + 1).alias("i"), F.col("v").alias("q"), "scale")


@query("""WITH p AS (SELECT c_custkey, o_orderpriority AS candidate, avg(o_totalprice) / 50000.0 AS z FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
e AS (SELECT *, exp(z - max(z) OVER w) AS e FROM p WINDOW w AS (PARTITION BY c_custkey)),
q AS (SELECT c_custkey, candidate, e / sum(e) OVER (PARTITION BY c_custkey) AS p FROM e)
SELECT c_custkey, candidate, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY p DESC, candidate) AS r FROM q) WHERE r = 1""")
def choose_among(spark, d):
    pairs = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.expr("c_custkey = o_custkey")).groupBy("c_custkey", F.col("o_orderpriority").alias("candidate")).agg((F.avg("o_totalprice") / 50000.0).alias("z"))
    return O.choose_among(pairs, "c_custkey", "candidate", "z").select("c_custkey", "candidate", _r("p").alias("p"))


# ---- splits and sampling

_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({k}, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616)"


@query(f"SELECT source AS family, count(*) AS n, ({_FNV.format(k=chr(39) + '7:family:' + chr(39) + ' || source')} % 1000000) < 300000 AS held FROM documents GROUP BY source")
def holdout_by_family(spark, d):
    fam = data.families(_t(spark, d, "documents"), "source")
    return data.hold_out(fam, data.split_key(F.col("family"), F.lit(""), F.lit("")), 0.3, 7)


_MD5 = "(('0x' || substr(md5('{s}:' || 'text:' || chr(0) || text), 1, 8))::BIGINT % 1000000)"


@query(f"SELECT doc_id, {_MD5.format(s=3)} < 200000 AS held FROM documents")
def holdout_by_example_fast(spark, d):
    docs = _t(spark, d, "documents")
    return data.hold_out(docs, data.split_key(None, F.lit(""), F.col("text"), "example"), 0.2, 3, exact=False).select("doc_id", "held")


@query(f"SELECT CASE WHEN {_MD5.format(s=1)} < 100000 THEN 'test' WHEN {_MD5.format(s=2)} < 50000 THEN 'calib' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1")
def train_calib_test_counts(spark, d):
    docs = _t(spark, d, "documents")
    return data.train_calib_test(docs, data.split_key(None, F.lit(""), F.col("text"), "example"), 1, exact=False).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT coalesce(source, '') AS family, count(*) AS n FROM documents GROUP BY 1")
def families(spark, d):
    return data.families(_t(spark, d, "documents"), "source")


@query("""WITH w AS (SELECT c_mktsegment AS value, count(*)::DOUBLE AS weight FROM customer GROUP BY 1)
SELECT value, round(pow(weight, 0.5), 6) AS weight, round(sum(pow(weight, 0.5)) OVER (ORDER BY value), 6) AS cum FROM w WHERE weight >= 2""")
def gazetteer_weights(spark, d):
    w = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").cast("double").alias("weight"))
    return data.gazetteer(w, 0.5, 2).select("value", _r("weight").alias("weight"), _r("cum").alias("cum"))


@query("""WITH w AS (SELECT c_mktsegment AS value, count(*)::DOUBLE AS weight FROM customer GROUP BY 1),
g AS (SELECT value, sum(weight) OVER (ORDER BY value) AS cum, weight FROM w),
u AS (SELECT event_id, (event_id * 7919 % 10007) / 10007.0::DOUBLE AS u FROM events)
SELECT event_id, value FROM u JOIN g ON u.u * (SELECT sum(weight) FROM w) >= cum - weight AND u.u * (SELECT sum(weight) FROM w) < cum""")
def weighted_pick(spark, d):
    w = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").cast("double").alias("weight"))
    draws = _t(spark, d, "events").select("event_id", (F.col("event_id") * 7919 % 10007 / F.lit(10007.0)).alias("u"))
    return data.picks(draws, data.gazetteer(w)).select("event_id", "value")


@query("""SELECT c_custkey, candidate, (candidate = c_mktsegment)::INT::DOUBLE AS label FROM customer, (SELECT unnest(['BUILDING', 'MACHINERY', 'HOUSEHOLD']) AS candidate)""")
def candidate_pairs(spark, d):
    return data.candidate_pairs(_t(spark, d, "customer"), ["BUILDING", "MACHINERY", "HOUSEHOLD"], "c_mktsegment").select("c_custkey", "candidate", "label")


@query("""WITH l AS (SELECT 'quality' AS question, count(*) AS n FROM labels UNION ALL SELECT 'toxic', count(*) FROM labels)
SELECT question, b AS batch, least(16, n - 16 * b) AS size FROM l, range(100000000) t(b) WHERE b < (n + 15) // 16""".replace("range(100000000) t(b)", "(SELECT unnest(range((SELECT count(*) // 16 + 1 FROM labels))) AS b)"))
def choice_batches_counts(spark, d):
    labels = _t(spark, d, "labels").select(F.col("doc_id").alias("ex_id"), F.explode(F.array(F.struct(F.lit("quality").alias("question"), F.col("quality").alias("option")), F.struct(F.lit("toxic").alias("question"), F.col("toxic").alias("option")))).alias("x")).select("ex_id", "x.*")
    return data.choice_batches(labels, 16, 5).groupBy("question", "batch").agg(F.count("*").alias("size"))


@query("SELECT count(*) AS pairs, true AS queries_once FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)")
def search_batches(spark, d):
    pairs = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey")).select(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("document_id")).distinct()
    per = data.search_batches(pairs, 32, 1).groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("q"))
    return per.agg(F.sum("n").alias("pairs"), F.bool_and((F.col("n") == F.col("q")) & (F.col("n") <= 32)).alias("queries_once"))


@query("""WITH b AS (SELECT c_custkey // 32 AS batch, c_custkey AS query_id, (c_custkey % 50) AS document_id FROM customer),
r AS (SELECT DISTINCT c_custkey AS query_id, (c_custkey + k * 13) % 50 AS candidate FROM customer, (SELECT unnest([0, 1]) AS k)),
x AS (SELECT b.*, candidate FROM b JOIN (SELECT DISTINCT batch, document_id AS candidate FROM b) USING (batch))
SELECT x.batch, x.query_id, x.document_id, x.candidate, x.candidate = x.document_id AS positive, r.query_id IS NOT NULL AND x.candidate <> x.document_id AS masked FROM x LEFT JOIN r ON x.query_id = r.query_id AND x.candidate = r.candidate""")
def relevance_mask(spark, d):
    c = _t(spark, d, "customer")
    batch = c.select(F.floor(F.col("c_custkey") / 32).alias("batch"), F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 50).alias("document_id"))
    rel = c.select(F.col("c_custkey").alias("query_id"), F.explode(F.array(F.col("c_custkey") % 50, (F.col("c_custkey") + 13) % 50)).alias("document_id"))
    return data.relevance_mask(batch, rel)


@query("SELECT context, text, min(id) AS id FROM (SELECT role AS context, text, conv_id * 1000 + turn AS id FROM conversations) GROUP BY ALL")
def dedupe_context_text(spark, d):
    c = _t(spark, d, "conversations").select(F.col("role").alias("context"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return data.first_of(c, ["context", "text"], "id").distinct()


@query("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context, text FROM conversations")
def conversation_pairs(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    return data.previous(c, "conv_id", "turn", "text", "context").select("conv_id", "turn", "context", "text")


# ---- labels and schema


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 1.0::DOUBLE WHEN event_id % 5 = 1 THEN NULL WHEN value / 100 <= 1 THEN round(value / 100, 6) END AS target FROM events""")
def label_targets_noul(spark, d):
    v = F.when(F.col("event_id") % 5 == 0, F.lit("true")).when(F.col("event_id") % 5 == 1, F.lit("null")).otherwise((F.col("value") / 100).cast("string"))
    return _t(spark, d, "events").select("event_id", _r(schema.noul_target(F.parse_json(v))).alias("target"))


@query("""WITH o AS (SELECT unnest(['click', 'error', 'view']) AS option)
SELECT event_id, option, CASE WHEN event_type IN ('click', 'error', 'view') THEN (event_type = option)::INT::DOUBLE ELSE CASE option WHEN 'click' THEN 0.25 WHEN 'view' THEN 0.75 ELSE 0 END END::DOUBLE AS target FROM events, o""")
def label_targets_choice(spark, d):
    options = F.array(*map(F.lit, ["click", "error", "view"]))
    target = schema.choice_target(options, F.col("event_type"), F.create_map(F.lit("click"), F.lit(1.0), F.lit("view"), F.lit(3.0)))
    return _t(spark, d, "events").select("event_id", F.explode(F.arrays_zip(options.alias("option"), target.alias("target"))).alias("x")).select("event_id", "x.option", "x.target")


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 END::BIGINT AS level FROM orders""")
def label_targets_score(spark, d):
    levels = F.array(*map(F.lit, ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]))
    return _t(spark, d, "orders").select("o_orderkey", schema.score_target(levels, F.col("o_orderpriority"), F.lit(None).cast("double")).alias("level"))


@query("SELECT event_type AS question, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def unknown_labels_anti(spark, d):
    qs = schema.frame(spark, [schema.noul("click"), schema.noul("view")])
    return schema.unknown_labels(_t(spark, d, "events").select(F.col("event_type").alias("question")), qs).groupBy("question").agg(F.count("*").alias("n"))


@query("SELECT 'quality' AS question, count(quality) AS n, round(avg(quality), 6) AS prior FROM labels UNION ALL SELECT 'toxic', count(toxic), round(avg(toxic), 6) FROM labels")
def train_priors(spark, d):
    return decide.priors(_t(spark, d, "labels"), ["quality", "toxic"]).select("question", "n", _r("prior").alias("prior"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'old' ELSE 'new' END AS label, 'new' AS other FROM events""")
def merge_labels_existing_wins(spark, d):
    old = F.when(F.col("event_type") == "click", F.create_map(F.lit("label"), F.lit("old"))).otherwise(F.create_map().cast("map<string,string>"))
    fresh = F.create_map(F.lit("label"), F.lit("new"), F.lit("other"), F.lit("new"))
    m = schema.merged_labels(old, fresh)
    return _t(spark, d, "events").select("event_id", m["label"].alias("label"), m["other"].alias("other"))


@query("""WITH s AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) SELECT doc_id, n >= 12 AS fits FROM s""")
def span_validity(spark, d):
    s = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("x").alias("type"))
    return _t(spark, d, "documents").select("doc_id", schema.valid_spans(F.array(s(8, 12), s(0, 5)), F.col("text")).isNotNull().alias("fits"))


# ---- answers


@query("SELECT event_id, round(1 / (1 + exp(-((value - 50) / 30) / 1.5)), 6) AS p FROM events")
def decide_noul(spark, d):
    z = (F.col("value") - 50) / 30
    return _t(spark, d, "events").select("event_id", _r(decide.noul_answer(z, 1.5)["p"]).alias("p"))


_Z3 = "(SELECT rid, l_orderkey, l_linenumber, unnest(['N', 'A', 'R']) AS o, unnest([l_quantity / 10, l_discount * 30, l_tax * 40]) AS z, unnest([1, 2, 3]) AS i FROM (SELECT *, row_number() OVER () AS rid FROM lineitem))"


@query(f"""WITH e AS (SELECT *, exp(z / 2 - max(z / 2) OVER w) AS e FROM {_Z3} WINDOW w AS (PARTITION BY rid)),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY rid) AS p FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY z DESC, i) AS r FROM p)
SELECT l_orderkey, l_linenumber, o AS choice, round(p, 6) AS confidence, round(p - (1 - p) / 2, 6) + 0.0 AS margin FROM r WHERE r = 1""")
def decide_choice(spark, d):
    z = F.array(F.col("l_quantity") / 10, F.col("l_discount") * 30, F.col("l_tax") * 40)
    a = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", decide.choice_answer(z, ["N", "A", "R"], 2.0).alias("a"))
    return a.select("l_orderkey", "l_linenumber", "a.choice", _r("a.confidence").alias("confidence"), (_r("a.margin") + 0.0).alias("margin"))


@query("""WITH s AS (SELECT event_id, 1 / (1 + exp(-(value / 40 - 0.5))) AS a, 1 / (1 + exp(-(value / 60 - 1))) AS b, 1 / (1 + exp(-(value / 30 - 2))) AS c FROM events),
g AS (SELECT event_id, a AS g0, least(a, b) AS g1, least(a, b, c) AS g2 FROM s),
p AS (SELECT event_id, [1 - g0, g0 - g1, g1 - g2, g2] AS p FROM g)
SELECT event_id, round(p[2] + 2 * p[3] + 3 * p[4], 6) AS score, (list_position(p, list_max(p)) - 1)::INT AS level FROM p""")
def decide_score_ordinal(spark, d):
    z = F.array(F.col("value") / 40 - 0.5, F.col("value") / 60 - 1, F.col("value") / 30 - 2)
    a = _t(spark, d, "events").select("event_id", decide.score_answer(z).alias("a"))
    return a.select("event_id", _r("a.score").alias("score"), "a.level")


@query("""WITH p AS (SELECT event_id, greatest(least(1 / (1 + exp(-(value - 50) / 30)), 1 - 1e-6), 1e-6) AS p FROM events)
SELECT event_id, round(1 / (1 + exp(-(ln(p / (1 - p)) + ln(0.02 / 0.98)))), 6) AS p FROM p""")
def prior_shift(spark, d):
    return _t(spark, d, "events").select("event_id", _r(S.at_prior(S.sigmoid((F.col("value") - 50) / 30), 0.5, 0.02)).alias("p"))


@query("""WITH r AS (SELECT event_id, greatest(least(value / 100, 0.99), 0.01) AS r FROM events), x AS (SELECT event_id, ln(r / (1 - r)) - ln(0.3 / 0.7) AS d FROM r)
SELECT event_id, round(CASE WHEN d >= 0 THEN d ELSE 0.2 * d END, 6) AS llr FROM x""")
def evidence_llr(spark, d):
    return _t(spark, d, "events").select("event_id", _r(S.evidence(F.col("value") / 100)).alias("llr"))


@query("""WITH m AS (SELECT c_custkey, 0.6::DOUBLE * (c_mktsegment = 'BUILDING')::INT AS a, 0.3::DOUBLE AS b FROM customer)
SELECT c_custkey, round(a / (a + b), 6) AS x, round(b / (a + b), 6) AS y FROM m""")
def option_subset_renorm(spark, d):
    probs = F.create_map(F.lit("x"), F.when(F.col("c_mktsegment") == "BUILDING", 0.6).otherwise(0.0), F.lit("y"), F.lit(0.3), F.lit("z"), F.lit(0.1))
    m = decide.restricted(probs, F.array(F.lit("x"), F.lit("y")))
    return _t(spark, d, "customer").select("c_custkey", _r(m["x"]).alias("x"), _r(m["y"]).alias("y"))


# ---- metrics

_EV = "(SELECT *, (value - 50) / 30 AS z, 1 / (1 + exp(-(value - 50) / 30)) AS p, (event_id % 7 < 3 OR value > 80)::INT AS y FROM events)"


def _scored(spark, d):
    return _t(spark, d, "events").withColumns({"z": (F.col("value") - 50) / 30, "y": ((F.col("event_id") % 7 < 3) | (F.col("value") > 80)).cast("int")})


_METRICS = """count(*) AS n, round(avg(((p >= 0.5) = (y = 1))::INT), 6) AS accuracy, round(avg((p - y) * (p - y)), 6) AS brier,
round(avg(CASE WHEN z > 30 THEN z WHEN z < -30 THEN exp(z) ELSE ln(1 + exp(z)) END - y * z), 6) AS nll,
round(coalesce(sum((p >= 0.5 AND y = 1)::INT) / nullif(sum((p >= 0.5)::INT), 0)::DOUBLE, 0), 6) AS precision,
round(coalesce(sum((p >= 0.5 AND y = 1)::INT) / nullif(sum(y), 0)::DOUBLE, 0), 6) AS recall,
round(coalesce(2.0::DOUBLE * sum((p >= 0.5 AND y = 1)::INT) / nullif(sum((p >= 0.5)::INT) + sum(y), 0), 0), 6) AS f1"""


def _rounded(m, *keys):
    return m.select(*keys, "n", *[_r(c).alias(c) for c in ("accuracy", "brier", "nll", "precision", "recall", "f1")])


@query(f"SELECT {_METRICS} FROM {_EV}")
def metrics_noul(spark, d):
    return _rounded(decide.noul_metrics(_scored(spark, d)))


@query(f"SELECT CASE WHEN grouping(event_type) = 1 THEN '*' ELSE event_type END AS grp, {_METRICS} FROM {_EV} GROUP BY ROLLUP (event_type)")
def metrics_by_group_rollup(spark, d):
    m = decide.noul_metrics(_scored(spark, d), by="event_type").withColumn("grp", F.when(F.col("total") == 1, "*").otherwise(F.col("group")))
    return _rounded(m, "grp")


_AUC = """WITH e AS (SELECT {g} AS g, round(value) AS z, (event_id % 7 < 3 OR value > 80)::INT AS y FROM events),
r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY z) + (count(*) OVER (PARTITION BY g, z) - 1) / 2.0::DOUBLE AS r FROM e)
SELECT {s} round((sum(r * y) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * sum(1 - y)), 6) AS auc FROM r GROUP BY g"""


@query(_AUC.format(g="0", s=""))
def auc_ties(spark, d):
    return decide.auc(_scored(spark, d).withColumn("z", F.round("value"))).select(_r("auc").alias("auc"))


@query(_AUC.format(g="event_type", s="g AS event_type,"))
def auc_by_group(spark, d):
    return decide.auc(_scored(spark, d).withColumn("z", F.round("value")), by=["event_type"]).select("event_type", _r("auc").alias("auc"))


@query(f"""WITH b AS (SELECT least(floor(greatest(p, 1 - p) * 10), 9) AS b, greatest(p, 1 - p) AS c, ((p >= 0.5) = (y = 1))::INT AS ok FROM {_EV}),
g AS (SELECT count(*) AS n, avg(c) AS c, avg(ok) AS ok FROM b GROUP BY b.b) SELECT round(sum(n * abs(c - ok)) / sum(n), 6) AS ece FROM g""")
def ece10(spark, d):
    p = S.sigmoid(F.col("z"))
    return decide.ece(_scored(spark, d), F.greatest(p, 1 - p), (p >= 0.5) == (F.col("y") == 1)).select(_r("ece").alias("ece"))


@query("""WITH x AS (SELECT l_returnflag AS g, CASE WHEN l_quantity > 25 THEN 'N' WHEN l_linestatus = 'O' THEN 'A' ELSE 'R' END AS f FROM lineitem),
m AS (SELECT o, (SELECT count(*) FROM x WHERE g = o) AS gold, (SELECT count(*) FROM x WHERE f = o) AS found, (SELECT count(*) FROM x WHERE f = o AND g = o) AS tp FROM (SELECT DISTINCT g AS o FROM x))
SELECT round(avg(coalesce(2.0::DOUBLE * tp / nullif(gold + found, 0), 0)), 6) AS macro_f1 FROM m""")
def macro_f1(spark, d):
    f = F.when(F.col("l_quantity") > 25, "N").when(F.col("l_linestatus") == "O", "A").otherwise("R")
    return decide.macro_f1(_t(spark, d, "lineitem").withColumn("f", f), "l_returnflag", "f").select(_r("macro_f1").alias("macro_f1"))


@query("""WITH x AS (SELECT (left(o_orderpriority, 1)::INT - 1) AS level, o_totalprice / 100000 AS s FROM orders) SELECT count(*) AS n, round(avg(abs(s - level)), 6) AS mae FROM x""")
def score_mae(spark, d):
    x = _t(spark, d, "orders").select((F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("level"), (F.col("o_totalprice") / 100000).alias("s"))
    return x.agg(F.count("*").alias("n"), _r(F.avg(F.abs(F.col("s") - F.col("level")))).alias("mae"))


@query(f"""SELECT t AS temperature, round(avg(CASE WHEN z / t > 30 THEN z / t WHEN z / t < -30 THEN exp(z / t) ELSE ln(1 + exp(z / t)) END - y * z / t), 6) AS nll
FROM {_EV}, (SELECT unnest([0.5::DOUBLE, 1, 1.5, 2, 4, 8]) AS t) GROUP BY t""")
def nll_grid(spark, d):
    return decide.nll_grid(_scored(spark, d), [0.5, 1, 1.5, 2, 4, 8]).select("temperature", _r("nll").alias("nll"))


@query("""SELECT event_type, count(*) AS n, round(quantile_disc(value, 0.5), 6) AS median, round(quantile_disc(value, 0.9), 6) AS p90 FROM events GROUP BY 1""")
def latency_quantiles(spark, d):
    q = decide.quantiles(_t(spark, d, "events"), "event_type", "value", [0.5, 0.9])
    return q.groupBy("event_type").agg(F.max("n").alias("n"), _r(F.max(F.when(F.col("q") == 0.5, F.col("at")))).alias("median"), _r(F.max(F.when(F.col("q") == 0.9, F.col("at")))).alias("p90"))


# ---- consensus

_TEACH = "(SELECT doc_id AS ex_id, t, CASE WHEN (doc_id + t) % 11 = 0 THEN NULL ELSE ((doc_id * 37 + t * 13) % 100) / 100.0::DOUBLE END AS p FROM documents, (SELECT unnest([0, 1]) AS t))"


@query(f"""WITH v AS (SELECT ex_id, count(p) AS n, avg(p) AS m, min((p >= 0.5)::INT) AS lo, max((p >= 0.5)::INT) AS hi FROM {_TEACH} GROUP BY 1),
s AS (SELECT v.*, quality AS label FROM v LEFT JOIN labels ON ex_id = doc_id),
w AS (SELECT ex_id, m, CASE WHEN n < 2 THEN 'dropped' WHEN lo <> hi OR (label IS NOT NULL AND label <> hi) THEN 'disputed' ELSE 'kept' END AS state FROM s)
SELECT ex_id, state, round(CASE WHEN state = 'kept' THEN m END, 6) AS p FROM w""")
def consensus_noul(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("ex_id")).join(_t(spark, d, "labels").select(F.col("doc_id").alias("ex_id"), F.col("quality").alias("label")), "ex_id", "left")
    v = docs.withColumn("teacher", F.explode(F.array(F.lit(0), F.lit(1))))
    v = v.withColumn("p", F.when((F.col("ex_id") + F.col("teacher")) % 11 == 0, F.lit(None)).otherwise((F.col("ex_id") * 37 + F.col("teacher") * 13) % 100 / F.lit(100.0)))
    return C.noul_consensus(v, 2).select("ex_id", "state", _r("p").alias("p"))


@query("""WITH v AS (SELECT doc_id AS ex_id, t AS teacher, o AS option, (((doc_id * 31 + o_i * 17 + t * (doc_id % 3)) % 10) + 1)::DOUBLE AS p FROM documents, (SELECT unnest([0, 1]) AS t), (SELECT unnest(['a', 'b', 'c']) AS o, unnest([0, 1, 2]) AS o_i)),
b AS (SELECT *, row_number() OVER (PARTITION BY ex_id, teacher ORDER BY p DESC, option) AS r FROM v),
k AS (SELECT ex_id, min(option) AS choice FROM b WHERE r = 1 GROUP BY 1 HAVING min(option) = max(option))
SELECT ex_id, option, round(avg(p), 6) AS p, choice FROM v JOIN k USING (ex_id) GROUP BY ex_id, option, choice""")
def consensus_choice(spark, d):
    v = _t(spark, d, "documents").select(F.col("doc_id").alias("ex_id")).withColumn("teacher", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("x", F.explode(F.array(*[F.struct(F.lit(o).alias("option"), F.lit(i).alias("i")) for i, o in enumerate("abc")])))
    v = v.select("ex_id", "teacher", "x.option", ((F.col("ex_id") * 31 + F.col("x.i") * 17 + F.col("teacher") * (F.col("ex_id") % 3)) % 10 + 1).cast("double").alias("p"))
    return C.choice_consensus(v, 2).select("ex_id", "option", _r("p").alias("p"), "choice")


@query("""SELECT o_custkey AS ex_id, min(o_orderpriority) AS level FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders) GROUP BY 1 HAVING count(*) = 2 AND min(o_orderpriority) = max(o_orderpriority)""")
def consensus_score(spark, d):
    v = _t(spark, d, "orders").select(F.col("o_custkey").alias("ex_id"), F.col("o_orderstatus").alias("teacher"), F.col("o_orderpriority").alias("level")).distinct()
    return C.score_consensus(v, 2)


@query("SELECT d.doc_id AS ex_id, coalesce(l.quality::VARCHAR, d.lang) AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def verify_filter(spark, d):
    ex = _t(spark, d, "documents").select(F.col("doc_id").alias("ex_id"), F.col("lang").alias("label"))
    return C.verified(ex, _t(spark, d, "labels").select(F.col("doc_id").alias("ex_id"), F.col("quality").cast("string").alias("label")))


@query("""SELECT event_id, option, round(CASE WHEN option = event_type THEN c ELSE (1 - c) / 4 END, 6) AS p FROM (SELECT *, greatest(least((props->>'k')::DOUBLE / 60, 1), 0.2) AS c FROM events), (SELECT unnest(['view', 'signup', 'click', 'error', 'purchase']) AS option)""")
def json_label_parse(spark, d):
    kinds = ["view", "signup", "click", "error", "purchase"]
    options = F.array(*map(F.lit, kinds))
    c = F.from_json("props", "k double")["k"] / 60
    p = C.soft_choice(options, F.col("event_type"), c)
    return _t(spark, d, "events").select("event_id", F.explode(F.arrays_zip(options.alias("option"), p.alias("p"))).alias("x")).select("event_id", "x.option", _r("x.p").alias("p"))


@query("""WITH k AS (SELECT event_id, sha256(event_type || chr(0) || user_id || chr(0) || (props->>'k')) AS key FROM events), c AS (SELECT DISTINCT key FROM k WHERE event_id % 2 = 0)
SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM c)""")
def cache_misses(spark, d):
    e = _t(spark, d, "events").select("event_id", F.sha2(F.concat_ws("\0", "event_type", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")), 256).alias("key"))
    return X.cache_misses(e, e.where("event_id % 2 = 0")).select("key")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE trim(html) END AS text, CASE WHEN page_id % 2 = 0 THEN 'site' ELSE '' END AS context FROM pages""")
def line_inputs(spark, d):
    line = F.when(F.col("page_id") % 2 == 0, F.to_json(F.struct(F.col("url").alias("text"), F.lit("site").alias("context")))).otherwise(F.concat(F.lit("  "), F.col("html"), F.lit(" ")))
    return _t(spark, d, "pages").select("page_id", X.line_inputs(line).alias("i")).select("page_id", "i.text", "i.context")


# ---- spans and texts


@query("""WITH n AS (SELECT doc_id, n_chars AS n, CASE WHEN n_chars <= 128 THEN 1 ELSE ceil(n_chars / 112.0)::BIGINT END AS k FROM documents),
w AS (SELECT doc_id, n, k, unnest(range(k)) AS i FROM n), s AS (SELECT doc_id, n, k, i, (i * n) // k AS lo, ((i + 1) * n) // k AS hi FROM w)
SELECT doc_id, i::INT AS w_idx, greatest(lo - CASE WHEN k = 1 THEN 0 ELSE 8 END, 0)::INT AS start, least(hi + CASE WHEN k = 1 THEN 0 ELSE 8 END, n)::INT AS "end", lo::INT AS keep_from, hi::INT AS keep_to FROM s""")
def window_plan(spark, d):
    w = _t(spark, d, "documents").select("doc_id", F.posexplode(spans.plan_windows(F.col("n_chars"), 128, 8)).alias("w_idx", "w"))
    return w.select("doc_id", "w_idx", "w.*")


@query("""SELECT doc_id, least(n_chars, 1000) AS a, CASE WHEN a + n_chars <= 509 THEN a ELSE least(a, 509 - least(n_chars, 509 - least(a, 169))) END AS keep_a,
CASE WHEN a + n_chars <= 509 THEN n_chars ELSE least(n_chars, 509 - least(a, 169)) END AS keep_b FROM documents""")
def pair_truncation(spark, d):
    a = F.least("n_chars", F.lit(1000).cast("long"))
    return _t(spark, d, "documents").select("doc_id", a.alias("a"), spans.pair_budget(a, F.col("n_chars"), 512).alias("b")).select("doc_id", "a", F.col("b.keep_a").cast("long").alias("keep_a"), F.col("b.keep_b").cast("long").alias("keep_b"))


_TOK = "(SELECT doc_id, unnest(range(coalesce(length(text), 0) // 6)) AS i, i * 6 AS s, i * 6 + 5 AS e FROM documents)"


@query(f"""WITH t AS (SELECT doc_id, i, CASE WHEN s < 20 + doc_id % 5 AND 3 < e THEN 1 WHEN s < 60 AND 40 < e THEN 2 ELSE 0 END AS o FROM {_TOK} t(doc_id, i, s, e)),
p AS (SELECT *, lag(o) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM t)
SELECT doc_id, i::INT AS i, CASE WHEN o = 0 THEN 0 WHEN b = o THEN 2 + 2 * (o - 1) ELSE 1 + 2 * (o - 1) END::INT AS tag FROM p""")
def span_overlap_tags(spark, d):
    """Tokens are the whole text in steps of six characters."""
    n = F.floor(F.coalesce(F.char_length("text"), F.lit(0)) / 6)
    steps = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    tokens = F.transform(steps, lambda i: F.struct((i * 6).cast("long").alias("start"), (i * 6 + 5).cast("long").alias("end")))
    s = F.array(F.struct(F.lit(3).cast("long").alias("start"), (20 + F.col("doc_id") % 5).alias("end"), F.lit(0).alias("type")), F.struct(F.lit(40).cast("long").alias("start"), F.lit(60).cast("long").alias("end"), F.lit(1).alias("type")))
    return _t(spark, d, "documents").select("doc_id", F.posexplode(spans.tag_tokens(tokens, s)).alias("i", "tag"))


@query("""WITH g AS (SELECT doc_id AS ex_id, 10 * k AS s, 10 * k + 5 AS e, CASE WHEN k % 2 = 0 THEN 'PER' ELSE 'LOC' END AS type FROM documents, (SELECT unnest(range(4)) AS k)),
f AS (SELECT ex_id, s, e + (ex_id % 3 = 0)::INT AS e, type FROM g WHERE (ex_id + s) % 4 <> 0),
x AS (SELECT type, 1 AS g, 0 AS f, 0 AS tp FROM g UNION ALL SELECT f.type, 0, 1, (g.ex_id IS NOT NULL)::INT FROM f LEFT JOIN g ON f.ex_id = g.ex_id AND f.s = g.s AND f.e = g.e AND f.type = g.type),
m AS (SELECT coalesce(type, '*') AS type, sum(f)::BIGINT AS found, sum(g)::BIGINT AS gold, sum(tp) / sum(f)::DOUBLE AS p, sum(tp) / sum(g)::DOUBLE AS r FROM x GROUP BY ROLLUP (type))
SELECT type, found, gold, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(5 * p * r / (4 * p + r), 6) AS f2 FROM m""")
def span_metrics(spark, d):
    gold = _t(spark, d, "documents").select(F.col("doc_id").alias("ex_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("ex_id", (F.col("k") * 10).alias("start"), (F.col("k") * 10 + 5).alias("end"), F.when(F.col("k") % 2 == 0, "PER").otherwise("LOC").alias("type"))
    found = gold.where("(ex_id + start) % 4 <> 0").withColumn("end", F.col("end") + (F.col("ex_id") % 3 == 0).cast("int"))
    m = decide.span_metrics(found, gold)
    return m.select("type", "found", "gold", *[_r(c).alias(c) for c in ("precision", "recall", "f1", "f2")])


@query("""SELECT doc_id, left(text, 7) AS span, octet_length(encode(text)) AS n_bytes FROM documents""")
def byte_spans(spark, d):
    end = F.octet_length(F.substring("text", 1, 7))
    return _t(spark, d, "documents").select("doc_id", T.byte_span(F.col("text"), F.lit(0), end).alias("span"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("""SELECT item_id, replace(upper(replace(text, 'ß', chr(64976))), chr(64976), 'ß') AS up, lower(text) AS low, base64(encode(text)) AS b64, lower(hex(encode(text))) AS hex,
translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS rot13,
substr(regexp_replace(text, '([^ ])', ' \\1', 'g'), CASE WHEN left(text, 1) = ' ' THEN 1 ELSE 2 END) AS spaced, translate(text, 'aeiostAEIOST', '431057431057') AS leet, translate(text, 'aceopxyACEOP', 'асеорхуАСЕОР') AS homoglyph, CASE WHEN length(text) > 50 THEN left(text, 50) || ' […]' ELSE text END AS clipped FROM benchmark""")
def text_transforms(spark, d):
    x, c = T.TRANSFORMS, F.col("text")
    return _t(spark, d, "benchmark").select("item_id", x["upper"](c).alias("up"), x["lower"](c).alias("low"), x["base64"](c).alias("b64"), x["hex"](c).alias("hex"), x["rot13"](c).alias("rot13"), x["spaced"](c).alias("spaced"), x["leet"](c).alias("leet"), x["homoglyph"](c).alias("homoglyph"), T.clipped(c, 50).alias("clipped"))


@query("""SELECT source, regexp_matches(source, '^src1[^/]*$') AS matches FROM documents GROUP BY source""")
def family_glob(spark, d):
    return _t(spark, d, "documents").select("source").distinct().select("source", F.col("source").rlike(T.family_pattern("src1*")).alias("matches"))


@query("""SELECT step, CASE WHEN step < 10 THEN round(0.001 * (step + 1) / 10, 8) ELSE round(0.001 * (100.0 - step) / 90, 8) END::DOUBLE AS lr FROM (SELECT unnest(range(100)) AS step)""")
def lr_schedule(spark, d):
    return spark.range(100).select(F.col("id").alias("step"), F.round(S.learning_rate(F.col("id"), 100, 0.1, 1e-3), 8).alias("lr"))


@query("""WITH a AS (SELECT part.p_partkey, unnest([p_size / 10.0::DOUBLE, 1, p_retailprice / 1000]) AS z, unnest([1.0::DOUBLE, p_size / 20.0, 0.5]) AS t, unnest([1, 2, 3]) AS i FROM part),
l AS (SELECT p_partkey, i, z / 2 - ln(sum(exp(z / 2)) OVER w) AS q, t / 2 - ln(sum(exp(t / 2)) OVER w) AS p FROM a WINDOW w AS (PARTITION BY p_partkey))
SELECT p_partkey, round(4 * sum(exp(p) * (p - q)), 6) AS kl FROM l GROUP BY 1""")
def distillation_term(spark, d):
    z = F.array(F.col("p_size") / 10.0, F.lit(1.0), F.col("p_retailprice") / 1000)
    t = F.array(F.lit(1.0), F.col("p_size") / 20.0, F.lit(0.5))
    return _t(spark, d, "part").select("p_partkey", _r(S.distillation(z, t, 2.0)).alias("kl"))


@query("""WITH a AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM a)
SELECT vec_id, array_to_string(list_sort(list(i)), ',') AS kept FROM r WHERE r <= 8 GROUP BY 1""")
def top_neurons(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.array_join(training.top_neurons(F.col("embedding"), 8).cast("array<string>"), ",").alias("kept"))


@query("""SELECT time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM """ + _EV + " GROUP BY 1")
def windowed_rates(spark, d):
    rows = live.decide_stream(_scored(spark, d), "z")
    return live.windowed_rates(rows, "ts", "p", "y").select("start", "n", _r("mean_p").alias("mean_p"), _r("mean_y").alias("mean_y"))


# ---- beyond SQL


@query()
def viterbi_decode(spark, d):
    """Tokens are the words of the whole text; a token's logits are sines of its hash."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.crc32(F.encode(w, "utf-8")) % 1000)
    z = F.transform(hashes, lambda h: S.log_softmax(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda t: F.sin((h * t).cast("double")) * 3)))
    return spans.decode(_t(spark, d, "documents").select("doc_id", z.alias("z")), "z", 0.5).select("doc_id", "tags")


@query()
def hash_encode(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", training.hash_encoding(F.col("text"), 32).alias("vector"))


@query()
def head_on_frozen_vectors(spark, d):
    v = _t(spark, d, "embeddings")
    w, b = training.fit_head(v, "embedding", "label", 10, epochs=5)
    return v.select("vec_id", "label", S.first_max(training.head_logits(F.col("embedding"), w, b)).alias("choice"))


@query()
def calibrated_temperature(spark, d):
    t = decide.calibrate(_scored(spark, d))
    return spark.createDataFrame([(t,)], "temperature double")


# ---- examples against a schema, evaluation, requests, windows, tokens

_QUESTIONS = [schema.noul("toxic"), schema.choice("lang", "", "de", "en", "es", "fr"), schema.score("level", "", "low", "high", "top")]
_LABELS = """(SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN '0.25' WHEN 2 THEN '"0.5"' END AS a,
CASE event_id % 5 WHEN 0 THEN '"en"' WHEN 1 THEN '{"en":1,"fr":3}' WHEN 2 THEN '"xx"' END AS b, CASE event_id % 3 WHEN 0 THEN '"high"' WHEN 1 THEN '2' ELSE '1.5' END AS c FROM events)"""


def _labelled(spark, d):
    i = F.col("event_id")
    a = F.when(i % 4 == 0, "true").when(i % 4 == 1, "0.25").when(i % 4 == 2, '"0.5"').otherwise("null")
    b = F.when(i % 5 == 0, '"en"').when(i % 5 == 1, '{"en":1,"fr":3}').when(i % 5 == 2, '"xx"').otherwise("null")
    c = F.when(i % 3 == 0, '"high"').when(i % 3 == 1, "2").otherwise("1.5")
    text = F.concat(F.lit('{"toxic":'), a, F.lit(',"lang":'), b, F.lit(',"level":'), c, F.lit("}"))
    return _t(spark, d, "events").select(i.alias("ex_id"), F.parse_json(text).alias("labels"))


@query(f"""WITH l AS {_LABELS}
SELECT event_id AS ex_id, 'toxic' AS question, a IS NOT NULL AS labelled, CASE a WHEN 'true' THEN '1.0' WHEN '0.25' THEN '0.25' END AS target FROM l
UNION ALL SELECT event_id, 'lang', b IS NOT NULL, CASE event_id % 5 WHEN 0 THEN '0.0,1.0,0.0,0.0' WHEN 1 THEN '0.0,0.25,0.0,0.75' END FROM l
UNION ALL SELECT event_id, 'level', true, CASE event_id % 3 WHEN 0 THEN '1.0' WHEN 1 THEN '2.0' END FROM l""")
def example_targets(spark, d):
    out = labelled.example_targets(_labelled(spark, d), _QUESTIONS)
    return out.select("ex_id", "question", "labelled", F.array_join(F.col("target").cast("array<string>"), ",").alias("target"))


@query(f"""SELECT event_id AS ex_id, (CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END)::INT AS toxic,
(CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE -1 END)::INT AS lang, (CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE -1 END)::INT AS level FROM {_LABELS}""")
def option_index(spark, d):
    of = {"toxic": ["yes", "no"], "lang": _QUESTIONS[1].options, "level": _QUESTIONS[2].options}
    return _labelled(spark, d).select("ex_id", *[labelled.option_index(labelled.label_of(F.col("labels"), q.name), q.kind, of[q.name]).alias(q.name) for q in _QUESTIONS])


@query(f"SELECT event_id AS ex_id, a IS NOT NULL AND b IS NOT NULL AS complete FROM {_LABELS}")
def complete_labels(spark, d):
    return _labelled(spark, d).select("ex_id", labelled.complete(F.col("labels"), _QUESTIONS).alias("complete"))


@query("SELECT event_id, ['first', 'second', 'third'][event_id % 3 + 1] AS instruction FROM events")
def instruction_round_robin(spark, d):
    return labelled.round_robin(_t(spark, d, "events").select("event_id"), ["first", "second", "third"], "event_id")


@query("""WITH w AS (SELECT c_mktsegment AS value, count(*)::DOUBLE AS weight FROM customer GROUP BY 1), s AS (SELECT value, pow(weight, 0.5) AS weight FROM w WHERE value > 'B')
SELECT value, round(weight, 6) AS weight, round(sum(weight) OVER (ORDER BY value), 6) AS cum FROM s""")
def gazetteer_subset(spark, d):
    w = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").cast("double").alias("weight"))
    return labelled.subset(data.gazetteer(w, 0.5), F.col("value") > "B").select("value", _r("weight").alias("weight"), _r("cum").alias("cum"))


@query("SELECT count(*) AS requested, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events")
def status_counts(spark, d):
    return labelled.status_counts(_t(spark, d, "events"), "event_type", ["click", "view"])


@query("""WITH c AS (SELECT event_type AS key, event_id AS n, user_id::VARCHAR AS response FROM events)
SELECT key, arg_min(response, n) AS first, arg_max(response, n) AS last FROM c GROUP BY key""")
def response_cache(spark, d):
    c = _t(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("n"), F.col("user_id").cast("string").alias("response"))
    first = labelled.merged_cache(c.where("false"), c).withColumnRenamed("response", "first")
    return first.join(labelled.loaded_cache(c).withColumnRenamed("response", "last"), "key")


@query("""WITH v AS (SELECT doc_id AS ex_id, t AS teacher, ((doc_id * 7 + t * 3) % 10) / 10.0 AS p FROM (SELECT doc_id FROM documents), (SELECT unnest([0, 1]) AS t)),
m AS (SELECT ex_id, min((p >= 0.5)::INT) AS lo, max((p >= 0.5)::INT) AS hi FROM v GROUP BY 1)
SELECT count(*) AS examples, sum((lo <> hi)::INT)::BIGINT AS disputed FROM m""")
def consensus_disputes(spark, d):
    v = _t(spark, d, "documents").select(F.col("doc_id").alias("ex_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("teacher"))
    v = v.withColumn("p", (F.col("ex_id") * 7 + F.col("teacher") * 3) % 10 / 10.0).withColumn("label", F.lit(None).cast("int"))
    return C.noul_consensus(v, 2).agg(F.count("*").alias("examples"), F.count_if(F.col("state") == "disputed").alias("disputed"))


_EVAL = """WITH e AS (SELECT l_orderkey, [l_quantity::DOUBLE * 0.1037, l_discount::DOUBLE * 31.3, l_tax::DOUBLE * 41.7] AS z, ['N', 'A', 'R'] AS o, l_returnflag, row_number() OVER () AS rid FROM lineitem),
x AS (SELECT rid, l_returnflag, unnest(z) AS z, unnest(o) AS o, generate_subscripts(z, 1) AS i FROM e),
p AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY rid) AS p, row_number() OVER (PARTITION BY rid ORDER BY z DESC, i) AS r FROM x),
a AS (SELECT rid, l_returnflag AS gold, max(CASE WHEN r = 1 THEN o END) AS found, max(p) AS conf, max(CASE WHEN o = l_returnflag THEN p END) AS own FROM p GROUP BY ALL),
b AS (SELECT count(*) AS n, avg(conf) AS c, avg((gold = found)::INT) AS ok FROM a GROUP BY least(floor(conf * 10), 9)),
f AS (SELECT o, (SELECT count(*) FROM a WHERE gold = o) AS g, (SELECT count(*) FROM a WHERE found = o) AS k, (SELECT count(*) FROM a WHERE found = o AND gold = o) AS tp FROM (SELECT DISTINCT gold AS o FROM a))
SELECT count(*) AS n, round(avg((gold = found)::INT), 6) AS accuracy, round(avg(-ln(own)), 6) AS nll, (SELECT round(sum(n * abs(c - ok)) / sum(n), 6) FROM b) AS ece,
(SELECT round(avg(coalesce(2.0::DOUBLE * tp / nullif(g + k, 0), 0)), 6) FROM f) AS macro_f1 FROM a"""


@query(_EVAL)
def evaluate_choice(spark, d):
    z = F.array(*[F.col(c).cast("double") * f for c, f in (("l_quantity", 0.1037), ("l_discount", 31.3), ("l_tax", 41.7))])
    t = F.transform(F.array(*map(F.lit, "NAR")), lambda o: (F.col("l_returnflag") == o).cast("double"))
    rows = _t(spark, d, "lineitem").select(F.lit("flag").alias("question"), z.alias("z"), t.alias("t"))
    m = evaluate.evaluate(rows, [schema.choice("flag", "", "N", "A", "R")])
    return m.select("n", *[_r(c).alias(c) for c in ("accuracy", "nll", "ece", "macro_f1")])


@query("""WITH e AS (SELECT (left(o_orderpriority, 1)::INT - 1) % 3 AS y, 1 / (1 + exp(-(o_totalprice / 100000 - 1))) AS a, 1 / (1 + exp(-(o_totalprice / 200000 - 1))) AS b, o_totalprice / 100000 - 1 AS za, o_totalprice / 200000 - 1 AS zb FROM orders),
g AS (SELECT *, [1 - a, a - least(a, b), least(a, b)] AS p FROM e),
s AS (SELECT y, p[2] + 2 * p[3] AS score, list_position(p, list_max(p)) - 1 AS level, ln(1 + exp(za)) - CASE WHEN y > 0 THEN za ELSE 0 END + ln(1 + exp(zb)) - CASE WHEN y > 1 THEN zb ELSE 0 END AS loss FROM g)
SELECT count(*) AS n, round(avg((level = y)::INT), 6) AS accuracy, round(avg(abs(score - y)), 6) AS mae, round(avg(loss), 6) AS nll FROM s""")
def evaluate_score(spark, d):
    price = F.col("o_totalprice").cast("double")
    y = ((F.substring("o_orderpriority", 1, 1).cast("int") - 1) % 3).cast("double")
    rows = _t(spark, d, "orders").select(F.lit("s").alias("question"), F.array(price / 100000 - 1, price / 200000 - 1).alias("z"), F.array(y).alias("t"))
    return evaluate.evaluate(rows, [schema.score("s", "", "a", "b", "c")]).select("n", *[_r(c).alias(c) for c in ("accuracy", "mae", "nll")])


@query("""WITH t AS (SELECT event_id, (event_id % 6 - 1)::INT AS tag, [value / 50, (event_id % 7) / 3.0, 1.0, 0.5, (event_id % 3)::DOUBLE] AS z FROM events),
x AS (SELECT event_id, tag, unnest(z) AS z, generate_subscripts(z, 1) - 1 AS i FROM t WHERE tag >= 0),
p AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY event_id) AS p, row_number() OVER (PARTITION BY event_id ORDER BY z DESC, i) AS r FROM x)
SELECT count(*) FILTER (i = 0) AS n, round(sum((r = 1 AND i = tag)::INT) / count(*) FILTER (i = 0), 6) AS accuracy, round(sum(CASE WHEN i = tag THEN -ln(p) END) / count(*) FILTER (i = 0), 6) AS nll FROM p""")
def token_metrics(spark, d):
    z = F.array(F.col("value").cast("double") / 50, F.col("event_id") % 7 / 3.0, F.lit(1.0), F.lit(0.5), (F.col("event_id") % 3).cast("double"))
    m = evaluate.token_metrics(_t(spark, d, "events").select(z.alias("z"), (F.col("event_id") % 6 - 1).cast("int").alias("tag")))
    return m.select("n", _r("accuracy").alias("accuracy"), _r("nll").alias("nll"))


@query("""WITH x AS (SELECT c_custkey // 16 AS batch, c_custkey AS query_id FROM customer), p AS (SELECT a.batch, a.query_id, b.query_id AS candidate, ((a.query_id * 13 + b.query_id * 7) % 11) / 4.0::DOUBLE AS z, a.query_id = b.query_id AS positive,
a.query_id <> b.query_id AND (a.query_id + b.query_id) % 5 = 0 AS masked FROM x a JOIN x b USING (batch)),
q AS (SELECT batch, query_id, ln(sum(exp(z))) - max(CASE WHEN positive THEN z END) AS loss FROM p WHERE NOT masked GROUP BY ALL),
r AS (SELECT batch, candidate, ln(sum(exp(z))) - max(CASE WHEN positive THEN z END) AS loss FROM p WHERE NOT masked GROUP BY ALL)
SELECT batch, round((a + b) / 2, 6) AS loss FROM (SELECT batch, avg(loss) AS a FROM q GROUP BY 1) JOIN (SELECT batch, avg(loss) AS b FROM r GROUP BY 1) USING (batch)""")
def info_nce(spark, d):
    x = _t(spark, d, "customer").select(F.floor(F.col("c_custkey") / 16).alias("batch"), F.col("c_custkey").alias("query_id"))
    pairs = x.join(x.select("batch", F.col("query_id").alias("candidate")), "batch")
    same = F.col("query_id") == F.col("candidate")
    pairs = pairs.withColumns({"z": (F.col("query_id") * 13 + F.col("candidate") * 7) % 11 / 4.0, "positive": same, "masked": ~same & ((F.col("query_id") + F.col("candidate")) % 5 == 0)})
    return evaluate.info_nce(pairs, symmetric=True).select("batch", _r("loss").alias("loss"))


@query("""WITH x AS (SELECT conv_id, turn, i, length(text) * (i + 1) % 17 AS v FROM conversations, (SELECT unnest(range(3)) AS i)) SELECT conv_id, i::INT AS i, round(avg(v), 6) AS x FROM x GROUP BY ALL""")
def mean_pooling(spark, d):
    row = F.array(*[(F.char_length("text") * (i + 1) % 17).cast("double") for i in range(3)])
    pooled = _t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(row).alias("rows"))
    return pooled.select("conv_id", F.posexplode(evaluate.mean_pool(F.col("rows"))).alias("i", "x")).select("conv_id", "i", _r("x").alias("x"))


@query("""WITH m AS (SELECT vec_id, label, avg(x) AS x FROM (SELECT vec_id, label, pow(unnest(embedding)::DOUBLE - 0.1, 2) AS x FROM embeddings) GROUP BY ALL) SELECT vec_id, round(x, 6) AS mse FROM m""")
def hidden_mse(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return _t(spark, d, "embeddings").select("vec_id", _r(evaluate.hidden_mse(x, F.transform(x, lambda v: F.lit(0.1)))).alias("mse"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text ELSE '{"n":' || turn || ',"text":"a"}' END AS text, CASE WHEN turn % 3 = 1 THEN role ELSE '' END AS context FROM conversations""")
def state_inputs(spark, d):
    c = _t(spark, d, "conversations")
    quoted = F.get_json_object(F.to_json(F.struct("text")), "$")
    raw = F.when(F.col("turn") % 3 == 0, F.regexp_extract(quoted, r'^\{"text":(.*)\}$', 1)).when(F.col("turn") % 3 == 1, F.to_json(F.struct("text", F.col("role").alias("context")))).otherwise(F.concat(F.lit('{"text": "a", "n": '), F.col("turn").cast("string"), F.lit("}")))
    return c.select("conv_id", "turn", requests.state_input(raw).alias("i")).select("conv_id", "turn", "i.text", "i.context")


@query("""SELECT event_type AS question, count(*) AS n, CASE event_type WHEN 'click' THEN 'learned' WHEN 'view' THEN 'refused' ELSE 'open' END AS route FROM events GROUP BY 1""")
def route_questions(spark, d):
    qs = schema.frame(spark, [schema.noul("click"), schema.choice("view", "", "a", "b")])
    asked = _t(spark, d, "events").select(F.col("event_type").alias("question"), F.when(F.col("event_type") == "view", "choice").otherwise("noul").alias("kind"), F.when(F.col("event_type") == "view", F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("options"))
    return requests.routed(asked, qs).groupBy("question", "route").agg(F.count("*").alias("n"))


@query("SELECT conv_id, sum(length(text))::BIGINT AS prompt_tokens, sum(length(text))::BIGINT AS total_tokens FROM conversations GROUP BY 1")
def usage_sums(spark, d):
    return requests.usage(_t(spark, d, "conversations").withColumn("n_tokens", F.char_length("text").cast("long")), by="conv_id")


@query("""SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE))::DECIMAL(18,4)::DOUBLE AS total, (4 * len(embedding) + 2) // 3 * 4 AS size FROM embeddings""")
def vectors_base64(spark, d):
    text = requests.floats_base64(F.col("embedding"))
    v = _t(spark, d, "embeddings").select("vec_id", text.alias("b")).withColumn("back", requests.base64_floats(F.col("b")))
    total = F.aggregate("back", F.lit(0.0), lambda s, x: s + x.cast("double")).cast("decimal(18,4)").cast("double")
    return v.select("vec_id", total.alias("total"), F.char_length("b").cast("long").alias("size"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n, CASE WHEN len(w) <= 64 THEN 1 ELSE ceil(len(w) / 48.0)::BIGINT END AS k FROM w),
i AS (SELECT *, unnest(range(k)) AS i FROM n), s AS (SELECT *, (i * n) // k AS lo, ((i + 1) * n) // k AS hi, CASE WHEN k = 1 THEN 0 ELSE 8 END AS m FROM i)
SELECT doc_id, i::INT AS w_idx, (least(hi + m, n) - greatest(lo - m, 0) + 2)::INT AS size, (lo - greatest(lo - m, 0) + 1)::INT AS keep_from, (hi - greatest(lo - m, 0) + 1)::INT AS keep_to FROM s""")
def cut_windows(spark, d):
    """Tokens are the words of the whole text."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    ids = F.transform(words, lambda w: F.char_length(w))
    w = windows.cut(_t(spark, d, "documents").select("doc_id", ids.alias("ids")), "doc_id", "ids", 64, 8, [-1], [-2])
    return w.select("doc_id", "w_idx", F.size("ids").alias("size"), "keep_from", "keep_to")


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(w)::INT AS n, md5(array_to_string(list_transform(w, lambda x: length(x)), ',')) AS digest FROM w""")
def joined_windows(spark, d):
    """What windows keep is the whole sequence again."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    w = windows.cut(_t(spark, d, "documents").select("doc_id", F.transform(words, lambda w: F.char_length(w)).alias("ids")), "doc_id", "ids", 64, 8, [-1], [-2])
    out = windows.joined(w, "doc_id", "ids")
    return out.select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")).alias("digest"))


@query()
def token_counts(spark, d):
    import public_tokenizers

    return _t(spark, d, "documents").select("doc_id", tokens.n_tokens(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("n_tokens"))


@query()
def modernbert_embed(spark, d):
    """Vectors of a small encoder with random weights: the path from texts through tokens to vectors, with no weights given."""
    import public_tokenizers

    config = encoder.Config(hidden_size=64, num_hidden_layers=4, num_attention_heads=4, intermediate_size=96, vocab_size=50_257)
    model = encoder.Encoder(config, encoder.random_weights(config, 1))
    return encoder.embed(_t(spark, d, "conversations").select("conv_id", "turn", "text"), "text", model, public_tokenizers.path("byte_bpe_50k.json"), "query: ").drop("text")


@query()
def synth_generate(spark, d):
    """Examples from two templates, with values from the table of parts."""
    brands = _t(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy("p_brand").limit(1000).collect()  # brands are few
    order = synth.parse_template("order", "family: shop/order\nlabel.urgent: false\n---\nPlease send {{int:2-90}} of {{pick:brand}}.{{include:shop/rush|p=0.3}}")
    rush = synth.parse_template("rush", "family: shop/rush\nweight: 0\nlabel.urgent: true\n---\n {{one:Today|By noon}}!")
    corpus = synth.Corpus([order, rush], {"brand": synth.Gazetteer([(r.p_brand, float(r.n)) for r in brands])})
    return synth.synthesize(spark, corpus, 500, 3).withColumn("labels", F.to_json("labels"))


@query("""WITH v AS (SELECT o_custkey AS ex_id, o_orderstatus AS teacher, min(o_orderpriority) AS level FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
p AS (SELECT ex_id, count(*) AS n, min(level) AS a, max(level) AS b FROM v GROUP BY 1)
SELECT CASE WHEN n < 2 THEN 'dropped' WHEN a = b THEN 'kept' ELSE 'disputed' END AS state, count(*) AS n FROM p GROUP BY 1""")
def score_disputes(spark, d):
    v = _t(spark, d, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("ex_id"), F.col("o_orderstatus").alias("teacher")).agg(F.min("o_orderpriority").alias("level"))
    return C.score_states(v, 2).groupBy("state").agg(F.count("*").alias("n"))


@query("""WITH z AS (SELECT event_id, value / 50 - 1 AS a, [value / 40, (event_id % 7) / 3.0::DOUBLE] AS b FROM events),
p AS (SELECT event_id, 1 / (1 + exp(-a / 1.5)) AS p, CASE WHEN b[1] >= b[2] THEN 'x' ELSE 'y' END AS c, exp(greatest(b[1], b[2])) / (exp(b[1]) + exp(b[2])) AS q FROM z)
SELECT event_id, 'spam' AS question, round(p, 6) AS value, '' AS choice, round(greatest(p, 1 - p), 6) AS confidence FROM p
UNION ALL SELECT event_id, 'kind', NULL, c, round(q, 6) FROM p""")
def decide_schema(spark, d):
    """Answers of a schema of two questions at once."""
    value = F.col("value").cast("double")
    z = F.create_map(F.lit("spam"), F.array(value / 50 - 1), F.lit("kind"), F.array(value / 40, F.col("event_id") % 7 / 3.0))
    rows = decide.answer_rows(_t(spark, d, "events").select("event_id", z.alias("logits")), [schema.noul("spam"), schema.choice("kind", "", "x", "y")], "event_id", temperatures={"spam": 1.5})
    return rows.select("event_id", "question", _r(F.col("value").try_cast("double")).alias("value"), F.when(F.col("question") == "kind", F.col("value")).otherwise("").alias("choice"), _r("confidence").alias("confidence"))
