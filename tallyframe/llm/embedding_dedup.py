"""Embedding near-dedup by product quantisation.

Unit vectors are dealt to coarse inverted lists; what is left after the list's centre is
cut into subspaces and each part replaced by the nearest of 256 codewords. A query reads
its distances to codes from a table, over all lists that can hold a neighbour: a vector
nearer than r to the query lies in list c only if the query is no further than r beyond the
plane between c and its own centre. Of the lists of two vectors the lower one's vector asks, so
a pair of lists is read once. A code's distance is off by at most the length of what
the code leaves out, which is stored, so nothing within r is lost; what passes is compared
by cosine in double precision.

The centres and codewords are fitted on SAMPLE vectors at most; every vector is indexed and
every vector is a query. Equal vectors of a label are one entry with a count. Lists are
compared in blocks, and a block gives counts and a spanning forest of its links, not pairs.

Cases: null vectors, zero vectors, null or non-finite components and null labels link with
nothing. Vectors of another length than the fitted one are compared in a list of their own
per length. Rows may repeat and ids be null (a null id is greater than others); other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from ._shared import components, small_batches, table

LINK = 0.98
#: Vectors to fit on, at most; vectors a list on average; subspaces; rows in a block.
SAMPLE, LIST, PARTS, BLOCK = 16_384, 512, 8, 1_024


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of the rows of x, started from rows spread over it."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(near, x[:, j], k) / np.maximum(n, 1), c[:, j])
    return c


class Quantizer:
    def __init__(self, x: np.ndarray, total: int):
        """x: unit vectors to fit on; total: how many there are in all, which sets the number of lists."""
        self.dim = x.shape[1]
        k = int(np.clip(total // LIST, 1, min(4096, max(1, len(x) // 4))))
        self.centres = kmeans(x, k)
        self.gaps = np.sqrt(np.maximum(_square(self.centres, self.centres), 0))
        rest = x - self.centres[_square(x, self.centres).argmin(1)]
        self.cuts = np.array_split(np.arange(self.dim), min(PARTS, self.dim))
        self.words = [kmeans(rest[:, c], min(256, len(x))) for c in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and length of what they leave out."""
        home = _square(x, self.centres).argmin(1)
        rest = x - self.centres[home]
        codes = np.stack([_square(rest[:, c], w).argmin(1) for c, w in zip(self.cuts, self.words)], 1).astype(np.uint8)
        for i, (c, w) in enumerate(zip(self.cuts, self.words)):
            rest[:, c] -= w[codes[:, i]]
        return home, codes, np.sqrt((rest**2).sum(1))

    def probes(self, x: np.ndarray, home: np.ndarray, r: float) -> list[np.ndarray]:
        d = _square(x, self.centres)
        beyond = d - d[np.arange(len(x)), home][:, None]
        return [np.flatnonzero(row) for row in beyond <= 2 * r * self.gaps[home] + 1e-9]

    def near(self, q: np.ndarray, home: int, codes: np.ndarray, left_out: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, entry) of one list that the codes do not put beyond r."""
        rest = q - self.centres[home]
        d = np.zeros((len(q), len(codes)), np.float32)
        for i, (c, w) in enumerate(zip(self.cuts, self.words)):
            d += np.maximum(_square(rest[:, c], w), 0).astype(np.float32)[:, codes[:, i]]
        return np.nonzero(d <= ((r + left_out + 1e-3) ** 2).astype(np.float32)[None])  # the tables are rounded


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T


def _matrix(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision, or None if it can't link."""
    if not column.null_count and len(column):
        flat = column.flatten()
        width = len(flat) // len(column)
        if not flat.null_count and width and (np.diff(column.offsets.to_numpy()) == width).all():
            x = flat.to_numpy().astype(float).reshape(-1, width)
            fine = np.isfinite(x).all(1) & (x != 0).any(1)
            return [row if ok else None for row, ok in zip(x, fine.tolist())]
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        ok = v and None not in v
        x = np.array(v, float) if ok else None
        out.append(x if ok and np.isfinite(x).all() and x.any() else None)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max()  # no overflow of squares
    return x / top / np.sqrt(((x / top) ** 2).sum())


def _packed(x: np.ndarray) -> bytes:
    """A vector as bytes: of 32-bit numbers where they are the same."""
    small = x.astype("<f4")
    return b"4" + small.tobytes() if (small == x).all() else b"8" + x.astype("<f8").tobytes()


def _plain(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, "<f" + v[:1].decode(), offset=1).astype(float) for v in column.to_pylist()]


def _keys(batches):
    import hashlib

    for batch in batches:
        raw = [None if x is None or label is None else hashlib.blake2b(repr(label).encode() + b"\0" + x.tobytes(), digest_size=16).digest() for x, label in zip(_matrix(batch.column(1)), batch.column(2).to_pylist())]
        yield pa.record_batch([*batch.columns, pa.array(raw, pa.binary())], ["vec_id", "v", "label", "key"])


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", link: float = LINK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    keyed = rows.mapInArrow(_keys, f"vec_id {kinds['vec_id']}, v array<double>, label {kinds['label']}, key binary")
    keyed = table(keyed, "vectors")
    entries = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    entries = table(entries, "entries")
    total = entries.count()
    plain = keyed.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return plain
    dim = entries.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    fit_on = entries.where(F.size("v") == dim)
    if total > SAMPLE:
        fit_on = fit_on.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / total))
    sample = fit_on.select("key", "v").toArrow().sort_by("key")
    quantizer = Quantizer(np.stack([_unit(x) for x in _matrix(sample.column("v").combine_chunks())]), total)
    shared = spark.sparkContext.broadcast(quantizer)  # 4096 centres and 256 codewords a subspace at most
    r = float(np.sqrt(2 - 2 * link)) + 1e-7

    def assign(batches):
        q = shared.value
        for batch in batches:
            x = [_unit(v) for v in _matrix(batch.column(1))]
            packed = pa.array([_packed(v) for v in _matrix(batch.column(1))], pa.binary())
            home, codes, left, probes = [-1] * len(x), [None] * len(x), [0.0] * len(x), [None] * len(x)
            at = [i for i, v in enumerate(x) if len(v) == q.dim]
            if at:
                m = np.stack([x[i] for i in at])
                h, c, e = q.encode(m)
                for i, hi, ci, ei, p in zip(at, h.tolist(), c, e.tolist(), q.probes(m, h, r)):
                    home[i], codes[i], left[i], probes[i] = hi, ci.tobytes(), ei, p[p >= hi].tolist()
            for i, v in enumerate(x):
                if probes[i] is None:
                    home[i] = -len(v)
                    probes[i], codes[i] = [home[i]], b""
            yield pa.record_batch([batch.column(0), packed, batch.column(2), batch.column(3), pa.array(home, pa.int32()), pa.array(codes, pa.binary()), pa.array(left, pa.float64()), pa.array(probes, pa.list_(pa.int32()))], ["key", "v", "label", "copies", "home", "codes", "left_out", "probes"])

    index = entries.select("key", "v", "label", "copies").mapInArrow(assign, f"key binary, v binary, label {kinds['label']}, copies bigint, home int, codes binary, left_out double, probes array<int>")
    index = table(index, "index")
    sizes = index.groupBy("label", F.col("home").alias("list")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    asks = index.select("label", F.explode("probes").alias("list"), "home", "key", "v", "copies")
    asked = asks.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nq"))
    sizes = table(sizes.join(asked, ["label", "list"]), "list-sizes")
    part = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    base = index.withColumn("list", F.col("home")).join(sizes, ["label", "list"]).select("label", "list", part("nb").alias("i"), F.explode_outer(F.expr("sequence(0, nq - 1)")).alias("j"), F.lit(0).alias("query"), "key", "v", "copies", "codes", "left_out")
    asks = asks.join(sizes, ["label", "list"]).select("label", "list", F.explode_outer(F.expr("sequence(0, nb - 1)")).alias("i"), part("nq").alias("j"), F.when(F.col("home") == F.col("list"), 1).otherwise(2).alias("query"), "key", "v", "copies", F.lit(b"").alias("codes"), F.lit(0.0).alias("left_out"))
    names = ["label", "list", "i", "j"]

    def compare(batches):
        quantizer = shared.value
        for t in V.grouped(batches, names):
            query = t.column("query").to_numpy()
            ask, key = query > 0, t.column("key").to_pylist()
            unit = np.stack([_unit(v) for v in _plain(t.column("v"))])
            q, b = np.flatnonzero(ask), np.flatnonzero(~ask)
            if not len(q) or not len(b):
                continue
            home, copies = t.column("list")[0].as_py(), t.column("copies").to_numpy()
            if home < 0:
                p, s = (z.ravel() for z in np.indices((len(q), len(b))))
            else:
                codes = np.frombuffer(b"".join(t.column("codes").take(pa.array(b)).to_pylist()), np.uint8).reshape(len(b), -1)
                p, s = quantizer.near(unit[q], home, codes, t.column("left_out").to_numpy()[b], r)
            keep = np.zeros(len(p), bool)
            for lo in range(0, len(p), 1 << 16):
                a, c = unit[q[p[lo : lo + (1 << 16)]]], unit[b[s[lo : lo + (1 << 16)]]]
                keep[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", a, c) >= link
            number: dict[bytes, int] = {}
            for k in key:
                number.setdefault(k, len(number))
            who = np.array([number[k] for k in key])
            foreign = query[q[p[keep]]] == 2
            p, s = who[q[p[keep]]], who[b[s[keep]]]
            weight = np.zeros(len(number), np.int64)
            weight[who] = copies
            fine = p != s
            p, s, foreign = p[fine], s[fine], foreign[fine]
            links = np.bincount(p, weight[s], len(number)).astype(np.int64)
            links += np.bincount(s[foreign], weight[p[foreign]], len(number)).astype(np.int64)  # vectors of one list ask each other
            forest = V.Forest(len(number))
            for m, n in zip(p.tolist(), s.tolist()):
                forest.union(m, n)
            of = list(number)
            out = [i for i in range(len(of)) if links[i] or forest.find(i) != i]
            if out:
                yield pa.record_batch([pa.array([of[i] for i in out], pa.binary()), pa.array([of[forest.find(i)] for i in out], pa.binary()), pa.array(links[out])], ["a", "b", "links"])

    both = base.unionByName(asks)
    found = table(both.repartition(*names).sortWithinPartitions(*names).select(*names, "query", "key", "v", "copies", "codes", "left_out").mapInArrow(compare, "a binary, b binary, links bigint"), "links")
    links = found.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    joined = components(found.select("a", "b")).withColumnRenamed("id", "key").join(entries.select("key", "rep"), "key")
    joined = joined.join(joined.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("key", "component_id")
    classes = entries.select("key", "rep", "copies").join(links, "key", "left").join(joined, "key", "left")
    classes = classes.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = keyed.where("key IS NOT NULL").select("vec_id", "key").join(classes, "key").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(plain)


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE x = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON v.vec_id = least.x
"""
