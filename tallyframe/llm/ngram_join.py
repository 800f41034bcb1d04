"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles. Equal sets are one class from the start. A node
is a path of chosen tokens: at each node a set picks tokens by a hash of node and token,
with a chance that gives sets of the threshold's similarity one shared pick on average;
sets that pick the same token meet in the child. Nodes with few sets are compared all with
all, others are split further. Runs of independent trees are repeated until a pair at the
threshold is missed with a chance under TARGET. From the second level on a set picks among
its KEEP least hashes, which is a sample of it.

Nodes of up to LARGE sets are compared in blocks of BLOCK. At a larger one a leader, the set
with the least hash of all there, is compared with each of them. A set within 0.3 of the leader need not go further: whatever is within
0.2 of it is within 0.5 of the leader, by the triangle inequality of the Jaccard distance,
and is linked to it there. (The estimate that stands for 0.3 is 0.18, three standard errors
nearer.) Before the runs goes the first level of a pilot tree: a set that it finds within 0.3
of a leader leaves the runs for good, if that leader stays; its nodes of up to LARGE sets are
compared with those of the runs. So a large group of near copies takes
steps in proportion to its size, in one tree. What still is together at the last level is
compared in blocks.

Comparisons at nodes are estimates from the least hashes of the sets and only propose. The
components of the proposed pairs are then compared in full: every pair of sets of a
component by exact Jaccard similarity, so that the links of a document are counted without
a row a pair. Components of more than BLOCK sets are packed into blocks, a row each, and
blocks are paired, not sets.

Little moves: of the many sets alone at their node, of sketches that no node needs and of texts
outside the components most are told by a bitmap (`may_match`) before a join deals them.

Cases: null and empty texts have no shingle and link with nothing; texts of one to four
words have one shingle, all their words. Rows with equal sets are copies and count as links
of each other. Ids may repeat or be null; columns beside id and text are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from ._shared import components, drop_table, may_match, small_batches, table

SHINGLE, THRESHOLD, LEVELS = 5, 0.8, 4
#: A pair at the threshold is missed at the first level of all trees with a smaller chance: a tree has no shared pick with 1/e at most.
TARGET = 1e-5
RUNS = int(np.ceil(-np.log(TARGET)))  # and the pilot
#: Least hashes kept of a set; estimates from which on a pair is proposed, and a set is taken to be as good as its leader.
KEEP, PROPOSE, SAME = 96, 0.5, 0.82
#: Sets at a node that are compared in one piece; sets in a block; sets at a node that are compared in blocks, before it is split.
SMALL, BLOCK, LARGE = 2048, 2048, 16_384
SEEDS = V.mix(np.arange(1, RUNS + 2, dtype=V.U64) * V.U64(0xA24BAED4963EE407))


def chosen(tokens: np.ndarray, node: np.ndarray, branch: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """For each node (given as numbers) the children that a set chooses: (index of node, child)."""
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, V.U64)
    h = V.mix(V.mix(tokens)[None, :] ^ node[:, None])
    most = min(1.0, branch / (THRESHOLD * len(tokens)))
    i, j = np.nonzero(h <= V.U64(min(int(most * 2.0**64), 2**64 - 1)))
    return i, V.mix(h[i, j] + V.U64(1))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, fp, sketch, pilot, nodes): number of shingles, digest of the set, least hashes, children of the first root and of the others."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in V.chunks(batch.column(1)):
                _, _, first, h = V.word_hashes(data, off)
                sets = V.shingles(h, first, SHINGLE)
                fp = [_digest(s) if len(s) else None for s in sets]
                sketch = [(s[:KEEP] >> V.U64(32)).astype("<u4").tobytes() for s in sets]
                pilot, nodes = ([chosen(s, x)[1].view(np.int64) for s in sets] for x in (SEEDS[:1], SEEDS[1:]))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int32()), pa.array(fp, pa.binary()), pa.array(sketch, pa.binary()), pa.array(pilot, pa.list_(pa.int64())), pa.array(nodes, pa.list_(pa.int64())), batch.column(2).slice(lo, hi - lo)], ["doc_id", "n", "fp", "sketch", "pilot", "nodes", "text_hash"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col)).mapInArrow(run, f"doc_id {kind}, n int, fp binary, sketch binary, pilot array<bigint>, nodes array<bigint>, text_hash bigint")


def estimate(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> float:
    """Jaccard similarity from the least hashes of two sets and their sizes."""
    top = min(a[-1] if na > len(a) else 1 << 32, b[-1] if nb > len(b) else 1 << 32)
    common = len(np.intersect1d(a, b, assume_unique=False))
    both = np.searchsorted(a, top, "right") + np.searchsorted(b, top, "right") - common
    return common / max(int(both), 1)


def proposals(left: list[np.ndarray], nl: np.ndarray, right: list[np.ndarray] | None = None, nr: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (place in left, place in right) whose estimate is PROPOSE or more; without right those within left.

    A pair's union has as many hashes under the lesser bound as the shorter sketch or more, so
    only pairs with a share of those in common are counted out.
    """
    alone, sets = right is None, [*left, *(right or [])]
    right, nr, begin = (left, nl, 0) if alone else (right, nr, len(left))
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    size = np.array([len(x) for x in sets], np.int64)
    row, shared = np.repeat(np.arange(len(size)), size), times > 1  # what one set alone has is in no pair
    keep = shared[number]
    row, number = row[keep], (np.cumsum(shared) - 1)[number[keep]]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    common, many = np.zeros((len(left), len(right)), np.float32), int(shared.sum())
    for lo in range(0, many, 4096):
        p, q = np.searchsorted(number, [lo, lo + 4096])
        m = np.zeros((len(sets), min(4096, many - lo)), np.float32)
        m[row[p:q], number[p:q] - lo] = 1
        common += m[: len(left)] @ m[begin:].T
    most = (1 + PROPOSE) / PROPOSE
    near = (common > 0) & (most * common >= np.minimum.outer(size[: len(left)], size[begin:]))
    x, y = np.nonzero(np.triu(near, 1) if alone else near)
    bound = lambda sets, n: np.array([s[-1] if k > len(s) else 1 << 32 for s, k in zip(sets, n)], np.int64)
    top = np.minimum(bound(left, nl)[x], bound(right, nr)[y])

    def under(sets: list[np.ndarray], i: np.ndarray) -> np.ndarray:
        """How many hashes of set i are up to `top`: all sets stand one after another, each in a range of its own."""
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        flat = np.concatenate(sets).astype(np.int64) + (np.repeat(np.arange(len(sets)), np.diff(ends)) << 33)
        return np.searchsorted(flat, (i << 33) + top, "right") - ends[i]

    both = common[x, y]
    fine = both >= PROPOSE * (under(left, x) + under(right, y) - both)
    return x[fine], y[fine]


def _stars(fp: list, x: np.ndarray, y: np.ndarray, known: np.ndarray) -> list[tuple]:
    """The hits (pairs of places in fp) as stars around the first of what they join; the known ones are together already."""
    label = np.arange(len(fp))
    label[known] = known[:1]
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        if len(known):
            new[known] = new[known].min()
        new = new[new]
        if (new == label).all():
            break
        label = new
    tell = label != np.arange(len(fp))
    tell[known[1:]] = False
    return [(fp[i], fp[label[i]]) for i in np.flatnonzero(tell).tolist()]


def _edges(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], ["a", "b"])


def _compare(batches):
    """Sorted rows (node, fp, n, sketch) of whole small nodes -> stars of the proposed pairs."""
    for t in V.grouped(batches, ["node"]):
        fp, n = t.column("fp").to_pylist(), t.column("n").to_numpy()
        sets = [np.frombuffer(x, "<u4") for x in t.column("sketch").to_pylist()]
        if len(fp) == 2:
            out = [(fp[1], fp[0])] if estimate(sets[0], n[0], sets[1], n[1]) >= PROPOSE else []
        else:
            out = _stars(fp, *proposals(sets, n), np.zeros(0, np.int64))
        if out:
            yield _edges(out)


def block_pairs(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, nb, fp, n, known, payload) -> (key, i, j, items), sorted: the items of block i and, if it is another, of block j, a row each. A block is a row before it is repeated."""
    block = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int").alias("b")
    packed = rows.groupBy(key, "nb", block).agg(F.collect_list(F.struct("fp", "n", "known", "payload")).alias("items"))
    packed = packed.withColumn("o", F.explode(F.expr("sequence(0, cast(nb AS int) - 1)")))
    return packed.select(key, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).alias("second"), "items").repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "second")


def _blocks(batches, key: str):
    """For each pair of blocks: fp, n, known, payloads of both one after another, and how many the first has (all, if it is one block with itself)."""
    for t in V.grouped(batches, [key, "i", "j"]):
        items = t.column("items").combine_chunks()
        if len(items) == 1 and t.column("i")[0].as_py() != t.column("j")[0].as_py():
            continue  # the other block is empty
        flat = items.flatten()
        yield flat.field("fp").to_pylist(), flat.field("n").to_numpy(), flat.field("known").to_numpy(zero_copy_only=False), flat.field("payload").to_pylist(), len(items[0]), len(items) == 1


def _compare_blocks(batches):
    for fp, n, known, payload, many, alone in _blocks(batches, "node"):
        sets = [np.frombuffer(x, "<u4") for x in payload]
        if alone:
            x, y = proposals(sets, n)
        else:
            x, y = proposals(sets[:many], n[:many], sets[many:], n[many:])
            y = y + many
        if out := _stars(fp, x, y, np.flatnonzero(known)):
            yield _edges(out)


def _descend(level: int):
    """Rows (node, fp, n, sketch, leader, ln, lsketch) of large nodes -> similarity to the leader and children of each set."""

    def run(batches):
        for batch in batches:
            like, children = [], []
            node, fp, n, sketch, leader, ln, lsketch = (batch.column(c).to_pylist() for c in ("node", "fp", "n", "sketch", "leader", "ln", "lsketch"))
            for at, f, k, s, lf, lk, ls in zip(node, fp, n, sketch, leader, ln, lsketch):
                x = np.frombuffer(s, "<u4")
                like.append(1.0 if f == lf else estimate(x, k, np.frombuffer(ls, "<u4"), lk))
                found = chosen(x.astype(V.U64), np.array([at & (2**64 - 1)], V.U64) ^ V.U64(level << 32), 1.5)[1] if like[-1] < SAME else np.zeros(0, V.U64)
                children.append(found.view(np.int64))
            yield pa.record_batch([batch.column("node"), batch.column("fp"), batch.column("leader"), pa.array(like, pa.float64()), pa.array(children, pa.list_(pa.int64()))], ["node", "fp", "leader", "alike", "children"])

    return run


def descend(rows: DataFrame, about: DataFrame, used: list[DataFrame], levels: int = LEVELS) -> tuple[list[DataFrame], list[DataFrame]]:
    """rows (node, fp) of the first level. The proposed pairs (a, b), and pairs (fp, leader) of sets that are as good as a leader. used: gets the tables that these read. levels: fewer than LEVELS leave large nodes at the leader."""
    edges, near = [], []

    def kept(df: DataFrame, name: str) -> DataFrame:
        used.append(table(df, name))
        return used[-1]

    for level in range(1, levels + 1):
        stats = kept(rows.groupBy("node").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("fp")).alias("sig")).where("m > 1"), "nodes")
        # nodes of the same sets, in whatever tree, are compared once
        once = stats.where(F.col("m") <= LARGE).groupBy("m", "sig").agg(F.min("node").alias("node")).select("node", "m")
        take = kept(once.unionByName(stats.where(F.col("m") > LARGE).select("node", "m")), "take")
        # most sets are alone at their node and stay where they are; the others meet their sketches once, whatever their node's size
        met = kept(may_match(rows, "node", take, "node").join(take, "node").select("node", "m", "fp"), "met")
        here = kept(met.join(may_match(about, "fp", met, "fp"), "fp").select("node", "m", "fp", "n", "sketch"), "here")
        small = here.where(F.col("m") <= SMALL).select("node", "fp", "n", "sketch").repartition("node").sortWithinPartitions("node")
        edges.append(small.mapInArrow(_compare, "a binary, b binary"))
        middle = here.where(F.col("m").between(SMALL + 1, LARGE)).select("node", F.ceil(F.col("m") / BLOCK).alias("nb"), "fp", "n", F.lit(False).alias("known"), F.col("sketch").alias("payload"))
        edges.append(block_pairs(middle, "node").mapInArrow(_compare_blocks, "a binary, b binary"))
        large = here.where(F.col("m") > LARGE).select("node", "fp", "n", "sketch")
        if large.isEmpty():
            break
        lead = large.groupBy("node").agg(F.min_by(F.struct("fp", "n", "sketch"), F.xxhash64("fp")).alias("l")).select("node", F.col("l.fp").alias("leader"), F.col("l.n").alias("ln"), F.col("l.sketch").alias("lsketch"))
        down = large.join(lead, "node").select("node", "fp", "n", "sketch", "leader", "ln", "lsketch")
        down = kept(down.mapInArrow(_descend(level), "node bigint, fp binary, leader binary, alike double, children array<bigint>"), "down")
        others = down.where(F.col("fp") != F.col("leader"))
        edges.append(others.where(F.col("alike") >= PROPOSE).select(F.col("fp").alias("a"), F.col("leader").alias("b")).distinct())
        near.append(others.where(F.col("alike") >= SAME).select("fp", "leader").distinct())
        if level == levels < LEVELS:
            break
        # where the leader is linked with all, they are one component already
        apart = down.groupBy("node").agg(F.min("alike").alias("least"), F.count_if(F.col("alike") < SAME).alias("m")).where(F.col("least") < PROPOSE).select("node", "m")
        on = down.where(F.col("alike") < SAME).join(apart, "node")
        if level < LEVELS:
            rows = kept(on.select(F.explode(F.array_distinct("children")).alias("node"), "fp"), "rows")
        else:
            rest = on.join(about, "fp").select("node", F.ceil(F.col("m") / BLOCK).alias("nb"), "fp", "n", (F.col("alike") >= PROPOSE).alias("known"), F.col("sketch").alias("payload"))
            edges.append(block_pairs(rest, "node").mapInArrow(_compare_blocks, "a binary, b binary"))
    return edges, near


def propose(sets: DataFrame, used: list[DataFrame]) -> DataFrame:
    """sets: (fp, n, sketch, pilot, nodes), one row a class. The pairs (a, b) that link what the trees put together; `used` gets the tables that they are read from."""
    about = sets.select("fp", "n", "sketch")
    pilot, left, edges = sets.select(F.explode("pilot").alias("node"), "fp"), sets.select("fp", "nodes"), []
    large = table(pilot.groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") > LARGE).select("node"), "large")
    used.append(large)
    if not large.isEmpty():
        edges, near = descend(pilot.join(large, "node"), about, used, 1)
        # the pilot's other nodes are compared with those of the runs
        pilot = pilot.join(large, "node", "left_anti")
        like = near[0]
        # a leader that is itself near another one keeps its followers in the runs to come
        gone = like.join(like.select(F.col("fp").alias("leader")).distinct(), "leader", "left_anti").select("fp").distinct()
        left = table(left.join(gone, "fp", "left_anti"), "left")
        used.append(left)
    edges += descend(left.select(F.explode("nodes").alias("node"), "fp").unionByName(pilot), about, used)[0]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def linked(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x of a, y of b) of sets with exact similarity of THRESHOLD or more."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(a) * len(b) <= 16:
        hit = [(x, y) for x in a.tolist() for y in b.tolist() if x != y and 9 * len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= 4 * (size[x] + size[y])]
        return np.array([x for x, _ in hit], np.int64), np.array([y for _, y in hit], np.int64)
    values, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    keep = times[number] > 1
    row, number = row[keep], (np.cumsum(times > 1) - 1)[number[keep]]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    common, many = np.zeros((len(a), len(b)), np.float32), int(number[-1]) + 1 if len(number) else 0
    width = min(4096, many)
    for lo in range(0, many, max(1, width)):
        p, q = np.searchsorted(number, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[p:q], number[p:q] - lo] = 1
        common += m[a] @ m[b].T
    x, y = np.nonzero((9 * common.astype(np.int64) >= 4 * np.add.outer(size[a], size[b])) & (a[:, None] != b[None, :]))
    return a[x], b[y]


def _digest(one: np.ndarray) -> bytes:
    return hashlib.blake2b(one.tobytes(), digest_size=16).digest()


def own_sets(t: pa.RecordBatch | pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets of the texts, and which rows hold a class's own text: one a class, and not another text of a repeated id."""
    data, off = V.strings(t.column("text"))
    _, _, first, h = V.word_hashes(data, off)
    sets, fp = V.shingles(h, first, SHINGLE), t.column("fp").to_pylist()
    own = np.array([_digest(s) == f for s, f in zip(sets, fp)], bool)
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(own).tolist():
        own[i] = seen.setdefault(fp[i], i) == i
    return sets, own


def _links(fp: list, copies: np.ndarray, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, both_ways: bool):
    """(a, b, links): linked documents of class a among these sets, and its root b there."""
    x, y = linked(sets, a, b)
    links = np.bincount(x, copies[y], len(fp))
    if both_ways:  # across blocks each pair comes once
        links += np.bincount(y, copies[x], len(fp))
    forest = V.Forest(len(fp))
    for p, q in zip(x.tolist(), y.tolist()):
        forest.union(p, q)
    some = np.flatnonzero(links).tolist()
    if some:
        yield pa.record_batch([pa.array([fp[i] for i in some], pa.binary()), pa.array([fp[forest.find(i)] for i in some], pa.binary()), pa.array(links[some].astype(np.int64))], ["a", "b", "links"])


def _verify(batches):
    """Sorted rows (component, fp, copies, text) of whole components."""
    for t in V.grouped(batches, ["component"]):
        sets, own = own_sets(t)
        at = np.flatnonzero(own)
        if len(at) > 1:
            yield from _links(t.column("fp").to_pylist(), t.column("copies").to_numpy(), sets, at, at, False)


def _as_sets(batches):
    """Rows (component, nb, fp, n, text) -> (component, nb, fp, n, known, payload): the set instead of the text."""
    for batch in batches:
        sets, own = own_sets(batch)
        at = pa.array(np.flatnonzero(own))
        payload = pa.array([sets[i].tobytes() for i in at.to_pylist()], pa.binary())
        yield pa.record_batch([*(batch.column(c).take(at) for c in ("component", "nb", "fp", "n")), pa.array([False] * len(at)), payload], ["component", "nb", "fp", "n", "known", "payload"])


def _verify_blocks(batches):
    for fp, copies, _, payload, many, alone in _blocks(batches, "component"):
        sets = [np.frombuffer(x, "<u8") for x in payload]
        at = np.arange(len(fp))
        yield from _links(fp, copies, sets, at[:many], at if alone else at[many:], not alone)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_shingles, text_hash) for every row: the least id of what it is linked to, over any number of links, and the number of documents that it is linked to directly."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    whole = table(sketches(docs), "sketches")
    firsts = [F.first(c).alias(c) for c in ("n", "sketch", "pilot", "nodes")]
    sets = table(whole.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *firsts), "sets")
    # sketches and children are with the classes now
    all_rows = table(whole.select("doc_id", "n", "fp", "text_hash"), "rows")
    drop_table(whole)
    some = all_rows.where("fp IS NOT NULL")
    used: list[DataFrame] = []
    proposed = table(components(propose(sets, used)).withColumnRenamed("id", "fp"), "proposed")
    for gone in used:
        drop_table(gone)
    size = proposed.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))
    member = table(proposed.join(size, "component").join(sets.select("fp", F.col("doc_id").alias("rep"), F.col("copies").alias("n")), "fp"), "members")
    # one row a class where ids do not repeat; of rows that repeat id and text any may stand for it
    texts = table(member.join(may_match(docs, "doc_id", member, "rep"), F.col("rep").eqNullSafe(F.col("doc_id"))).select("component", "nb", "fp", "n", "text"), "texts")
    for gone in (proposed, member):
        drop_table(gone)
    within = texts.where("nb = 1").select("component", "fp", F.col("n").alias("copies"), "text").repartition("component").sortWithinPartitions("component")
    blocks = texts.where("nb > 1").mapInArrow(_as_sets, "component binary, nb bigint, fp binary, n bigint, known boolean, payload binary")
    blocks = blocks.groupBy("component", "nb", "fp", "n", "known").agg(F.first("payload").alias("payload"))
    # a component that one task has seen whole is settled there; only those in blocks need their links joined
    settled = table(within.mapInArrow(_verify, "a binary, b binary, links bigint"), "links")
    parts = table(block_pairs(blocks, "component").mapInArrow(_verify_blocks, "a binary, b binary, links bigint"), "links")
    drop_table(texts)
    links = settled.unionByName(parts).groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links"))
    joined = settled.select(F.col("a").alias("fp"), F.col("b").alias("component")).unionByName(components(parts.select("a", "b")).withColumnRenamed("id", "fp"))
    joined = joined.join(sets.select("fp", "doc_id"), "fp")
    least = joined.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    joined = joined.join(least, "component").select("fp", "class_id")
    classes = sets.select("fp", F.col("doc_id").alias("own"), "copies").join(links, "fp", "left").join(joined, "fp", "left")
    classes = classes.select("fp", F.coalesce("class_id", "own").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = some.select("doc_id", "n", "fp", "text_hash").join(classes, "fp").select("doc_id", "class_id", "n_links", F.col("n").cast("long").alias("n_shingles"), "text_hash")
    none = all_rows.where("fp IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_shingles"), "text_hash")
    return out.unionByName(none)


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 9 * c >= 4 * (a.n + b.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x)
SELECT w.doc_id, class_id, (SELECT count(*) FROM links WHERE x = w.doc_id) AS n_links, coalesce(n.n, 0) AS n_shingles FROM w JOIN least ON w.doc_id = least.x LEFT JOIN n ON w.doc_id = n.doc_id
"""
