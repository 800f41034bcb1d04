"""Suffix dedup by a depth-limited radix sort.

Two suffixes share a window of LENGTH bytes if they agree through LENGTH bytes; deeper they
need no order. Passes by ever longer digits split the suffixes, and a suffix alone in its
group leaves. Suffixes are taken in bundles: each window belongs to one of its GRAM-byte
strings, chosen by content (the least hash, of equal ones the last), and a bundle is the
run of windows that chose one place. Equal windows choose equal strings in equal places, so
they meet in the pass over that digit.

  distinct texts  equal texts are one; a text that occurs more than once is repeated as a whole.
  digit 1         the chosen string (GRAM bytes). Bundles alone with theirs leave. Bundles
                  with all bytes equal (by a 128-bit BLAKE2b digest) are repeated as a whole
                  and go on as one.
  group           of GROUP bundles at most: sorted in one task, first by what STEP
                  neighbouring windows share, then by window. Equal hashes count only if the
                  bytes are equal.
  digit 2         larger groups are cut into runs of STEP windows, whose digit is the
                  LENGTH - STEP + 1 bytes that the run's windows share; groups of GROUP at
                  most are sorted as above.
  digit 3         of groups still larger, single windows are counted under their own bytes.

So no group, however often its string occurs, meets in one task: counts are partial sums,
and what is joined back to them splits under adaptive execution.

Cases: null texts are empty; texts shorter than LENGTH bytes are left alone; matches never
cross texts; equal texts count as two places. Ids may repeat or be null. Other columns are
carried along, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _vec as V
from ._shared import drop_table, small_batches, table

LENGTH, GRAM = 200, 32
#: Grams of a window; neighbouring windows in a run; bundles of a group that one task sorts.
SPREAD, STEP, GROUP = LENGTH - GRAM + 1, 13, 2048
_MULTIPLY = V.mix(np.arange(11, 15, dtype=V.U64)) | V.U64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place; it selects and deals, and is never taken for equality."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()
    total = words[:n] * _MULTIPLY[0]
    for i in range(1, 4):
        total += words[8 * i : 8 * i + n] * _MULTIPLY[i]
    return V.mix(total)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each bundle: its string's hash and place, first and last start of its windows, and row."""
    long = np.diff(off) >= LENGTH
    if not long.any():
        return (np.zeros(0, V.U64), *[np.zeros(0, np.int64)] * 4)
    g = gram_hashes(data)
    at = np.arange(len(g), dtype=V.U64)
    least = (g >> V.U64(32) << V.U64(32)) | (V.U64(0xFFFFFFFF) - at)  # of equal grams the last; a column of text is shorter than 2^32
    width = 1
    while 2 * width <= SPREAD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (SPREAD - width)], least[SPREAD - width :])
    fits = np.zeros(len(data) + 1, np.int64)
    fits[off[:-1][long]] += 1
    np.subtract.at(fits, off[1:][long] - LENGTH + 1, 1)
    start = np.flatnonzero(np.cumsum(fits)[: len(least)] > 0)
    place = 0xFFFFFFFF - (least[start] & V.U64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    place, lo, hi = place[new], start[new], start[np.append(new[1:], len(start)) - 1]
    return g[place], place, lo, hi, np.searchsorted(off, place, "right") - 1


def bundles(texts: DataFrame) -> DataFrame:
    """texts (id, text) -> (g, c, id, shift, lo, hi): the chosen string's hash, digest of all bytes, how far the string is behind the first window, first and last start."""

    def run(batches):
        for batch in batches:
            u = batch.column(0).to_numpy()
            for first, _, data, off in V.chunks(batch.column(1)):
                g, place, lo, hi, row = anchors(data, off)
                if not len(g):
                    continue
                raw = memoryview(np.ascontiguousarray(data))
                c = [hashlib.blake2b(raw[a : b + LENGTH], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist())]
                yield pa.record_batch([pa.array(g.view(np.int64)), pa.array(c, pa.binary()), pa.array(u[first + row]), *(pa.array(x.astype(np.int32)) for x in (place - lo, lo - off[row], hi - off[row]))], ["g", "c", "id", "shift", "lo", "hi"])

    return texts.select("id", "text").mapInArrow(run, "g bigint, c binary, id bigint, shift int, lo int, hi int")


def contexts(batches):
    """Rows (text, bundles) -> (digit, k, c, base, shift, bytes), a row a bundle."""
    for batch in batches:
        data, off = V.strings(batch.column(0))
        raw, lists = memoryview(np.ascontiguousarray(data)), batch.column(1)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(off) - 1), np.diff(lists.offsets.to_numpy()))
        lo, hi = (off[row] + flat.field(name).to_numpy() for name in ("lo", "hi"))
        for k in range(0, len(row), 8192):
            part = slice(k, k + 8192)
            bytes_ = pa.array([bytes(raw[a : b + LENGTH]) for a, b in zip(lo[part].tolist(), hi[part].tolist())], pa.binary())
            g, k_, c, shift = (flat.field(name).slice(k, 8192) for name in ("g", "k", "c", "shift"))
            yield pa.record_batch([g, k_, c, pa.array(np.zeros(len(bytes_), np.int32)), shift, bytes_], ["digit", "k", "c", "base", "shift", "bytes"])


def _runs(off: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of STEP windows, counted from the chosen string: row, latest start that the run can have, first and last start it has, all as places in the data."""
    last = np.diff(off) - LENGTH
    low_r, high_r = (shift - last) // STEP, shift // STEP
    many = high_r - low_r + 1
    row = np.repeat(np.arange(len(shift)), many)
    r = low_r[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    top = shift[row] - r * STEP
    low, high = np.maximum(0, top - STEP + 1), np.minimum(last[row], top)
    return row, off[row] + top, off[row] + low, off[row] + high


def _padded(data: np.ndarray) -> np.ndarray:
    """All strings of LENGTH bytes as rows of 64-bit numbers, without a copy."""
    data = np.ascontiguousarray(data)
    return np.ndarray((len(data) - LENGTH + 1, LENGTH // 8), "<u8", data, strides=(1, 8))


def _same(views: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 16384):
        out[k : k + 16384] = (views[a[k : k + 16384]] == views[b[k : k + 16384]]).all(1)
    return out


def _first_of_run(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by key, and for each place of it the place where its run of equal keys begins and how long that run is."""
    order = np.argsort(key, kind="stable")
    if not len(key):
        return order, order, order
    begin = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    size = np.diff(np.append(begin, len(key)))
    return order, np.repeat(begin, size), np.repeat(size, size)


def repeated_windows(data: np.ndarray, off: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """For each byte of `data` whether a window starts there that starts elsewhere too. data: distinct bundles one after another."""
    mark = np.zeros(len(data), bool)
    if not len(off) or len(data) < LENGTH:
        return mark
    views, sums = _padded(data), V.prefix(V.TABLES[0][data])
    row, top, low, high = _runs(off, shift)
    core = V.span_hash(sums, top, top + LENGTH - STEP + 1)
    order, _, size = _first_of_run(core)
    alive = np.sort(order[size > 1])
    core, low, high = core[alive], low[alive], high[alive]
    # runs of windows that are equal as a whole: the first stands for the others, which are done
    order, begin, _ = _first_of_run(V.span_hash(sums, low, high + LENGTH))
    first = order[begin]
    equal = (order != first) & (high[order] - low[order] == high[first] - low[first])
    some = np.flatnonzero(equal)
    equal[some] = _same(views, low[order[some]], low[first[some]]) & _same(views, high[order[some]], high[first[some]])
    done = np.zeros(len(low), bool)
    done[order[equal]] = done[first[equal]] = True
    stands = np.ones(len(low), bool)
    stands[order[equal]] = False
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, low[done], 1)
    np.subtract.at(edge, high[done] + 1, 1)
    mark |= np.cumsum(edge)[:-1] > 0
    core, low, high = core[stands], low[stands], high[stands]
    order, _, size = _first_of_run(core)
    left = order[size > 1]
    many = high[left] - low[left] + 1
    at = np.repeat(low[left] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    order, begin, size = _first_of_run(V.span_hash(sums, at, at + LENGTH))
    order, first = at[order[size > 1]], at[order[begin[size > 1]]]
    other = np.flatnonzero(order != first)
    equal = _same(views, order[other], first[other])
    mark[order[other][equal]] = mark[first[other][equal]] = True
    if not equal.all():  # different bytes under one hash: by the bytes themselves
        groups: dict[bytes, set[int]] = {}
        odd = set(first[other][~equal].tolist())
        for x, y in zip(order.tolist(), first.tolist()):
            if y in odd:
                groups.setdefault(data[x : x + LENGTH].tobytes(), set()).add(x)
        for same in groups.values():
            if len(same) > 1:
                mark[list(same)] = True
    return mark


def _whole_groups(batches, size: int = 2 * GROUP):
    """Tables of about `size` rows or more of a stream sorted by its first column, no group cut."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n < size:
            continue
        both = pa.Table.from_batches(held).combine_chunks()
        digit = both.column(0).to_numpy()
        cut = int(np.searchsorted(digit, digit[-1]))
        if cut:
            yield both.slice(0, cut).combine_chunks()
            held = both.slice(cut).combine_chunks().to_batches()
            n -= cut
        else:
            held = both.to_batches()
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def sort_groups(batches):
    """Rows (digit, c, base, shift, bytes), sorted by digit -> (c, lo, hi): runs of repeated windows, as starts in c."""
    for t in _whole_groups(batches):
        data, off = V.strings(t.column("bytes"))
        mark = repeated_windows(data, off, t.column("shift").to_numpy().astype(np.int64))
        lo, end = V.runs(mark, off)
        if len(lo):
            row = np.searchsorted(off, lo, "right") - 1
            by = t.column("base").to_numpy()[row] - off[row]
            yield pa.record_batch([t.column("c").combine_chunks().take(pa.array(row)), pa.array((lo + by).astype(np.int32)), pa.array((end - 1 + by).astype(np.int32))], ["c", "lo", "hi"])


def cut_runs(batches):
    """Rows (c, base, shift, bytes) -> the same of their runs of STEP windows, with the digit that a run's windows share."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = V.strings(batch.column(3))
        row, top, low, high = _runs(off, batch.column(2).to_numpy().astype(np.int64))
        digit = V.span_hash(V.prefix(V.TABLES[1][data]), top, top + LENGTH - STEP + 1)
        raw = memoryview(np.ascontiguousarray(data))
        piece = pa.array([bytes(raw[a : b + LENGTH]) for a, b in zip(low.tolist(), high.tolist())], pa.binary())
        base = batch.column(1).to_numpy()[row] + (low - off[row])
        yield pa.record_batch([pa.array(digit.view(np.int64)), batch.column(0).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (base, top - low)), piece], ["digit", "c", "base", "shift", "bytes"])


def cut_windows(batches):
    """Rows (c, base, bytes) -> single windows (w, c, s)."""
    for batch in batches:
        out = []
        for c, base, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            out += [(raw[s : s + LENGTH], c, base + s) for s in range(len(raw) - LENGTH + 1)]
        if out:
            w, c, s = zip(*out)
            yield pa.record_batch([pa.array(w, pa.binary()), pa.array(c, pa.binary()), pa.array(s, pa.int32())], ["w", "c", "s"])


_PIECE, _FOUND = "digit bigint, c binary, base int, shift int, bytes binary", "c binary, lo int, hi int"


def _sorted(pieces: DataFrame) -> DataFrame:
    one = pieces.select("digit", "c", "base", "shift", "bytes").repartition("digit").sortWithinPartitions("digit")
    return one.mapInArrow(sort_groups, _FOUND)


def repeated(texts: DataFrame) -> DataFrame:
    """texts (id, text), distinct -> (id, spans): the starts of each text's repeated windows, as runs (lo, hi), both included."""
    made = table(bundles(texts), "bundles")
    # both sides of a join on a key that may be hot are tables: then it splits under adaptive execution
    often = table(made.groupBy("g").count().where("count > 1").select("g"), "often")
    kept = table(made.join(often, "g"), "bundles")
    for gone in (made, often):
        drop_table(gone)
    each = table(kept.groupBy("g", "c").agg(F.count("*").alias("m"), F.min_by(F.struct("id", "shift", "lo", "hi"), F.struct("id", "lo")).alias("at")), "contexts")
    found = [each.where("m > 1").select("c", F.lit(0).alias("lo"), (F.col("at.hi") - F.col("at.lo")).alias("hi"))]
    size = each.groupBy("g").agg(F.count("*").alias("k")).where("k > 1")
    lists = each.join(size, "g").groupBy("at.id").agg(F.collect_list(F.struct("g", "k", "c", "at.shift", "at.lo", "at.hi")).alias("bundles"))
    held = table(texts.join(lists, "id").select("text", "bundles").mapInArrow(contexts, "digit bigint, k bigint, c binary, base int, shift int, bytes binary"), "contexts")
    found.append(table(_sorted(held.where(F.col("k") <= GROUP)), "found"))
    runs = table(held.where(F.col("k") > GROUP).select("c", "base", "shift", "bytes").mapInArrow(cut_runs, _PIECE), "runs")
    drop_table(held)
    size = runs.groupBy("digit").agg(F.count("*").alias("k")).where("k > 1")
    sized = table(runs.join(size, "digit"), "runs")
    drop_table(runs)
    found.append(table(_sorted(sized.where(F.col("k") <= GROUP)), "found"))
    single = table(sized.where(F.col("k") > GROUP).select("c", "base", "bytes").mapInArrow(cut_windows, "w binary, c binary, s int"), "windows")
    drop_table(sized)
    often = single.groupBy("w").count().where("count > 1").select("w")
    found.append(single.join(often, "w").select("c", F.col("s").alias("lo"), F.col("s").alias("hi")))
    all_found = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    by_c = table(all_found.groupBy("c").agg(F.collect_set(F.struct("lo", "hi")).alias("found")), "by-context")
    spans = kept.join(by_c, "c").select("id", F.expr("transform(found, x -> struct(lo + x.lo AS lo, lo + x.hi AS hi))").alias("spans"))
    out = table(spans.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    for gone in (kept, each, found[1], found[2], single, by_c):
        drop_table(gone)
    return out


def remove_repeats(docs: DataFrame, text_col: str = "text", as_text: bool = False) -> DataFrame:
    """All columns of docs but the text as `row`, with kept_text, n_bytes, n_removed, n_spans and kept_sha256.

    kept_text is binary, as a cut may fall within a character; as_text makes it a string without such parts.

    Every byte that a repeated window covers goes, at each of its places.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select((F.struct(*others) if others else F.struct(F.lit(None).alias("none"))).alias("row"), F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("u"))
    texts = docs.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    texts = table(texts.select(F.monotonically_increasing_id().alias("id"), "text", "copies"), "texts")
    spans = repeated(texts.where(F.octet_length("text") >= LENGTH))

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out = [[], [], [], [], [], []]
            for text, copies, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                whole = text.encode("utf-8")
                raw = np.frombuffer(whole, np.uint8)
                keep, n_spans = raw, 0
                if copies > 1 and len(raw) >= LENGTH:
                    keep, n_spans = raw[:0], 1
                elif found:
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, [s["lo"] for s in found], 1)
                    np.subtract.at(edge, [s["hi"] + LENGTH for s in found], 1)
                    gone = np.cumsum(edge)[:-1] > 0
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    keep = raw[~gone]
                kept = keep.tobytes()
                for to, x in zip(out, (hashlib.sha256(whole).digest(), kept, len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest())):
                    to.append(x)
            yield pa.record_batch([pa.array(out[0], pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in out[1]], pa.string()) if as_text else pa.array(out[1], pa.binary()), *(pa.array(x, pa.int64()) for x in out[2:5]), pa.array(out[5], pa.string())], names)

    kind = T.StructType([T.StructField("u", T.BinaryType()), T.StructField("kept_text", T.StringType() if as_text else T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    names = kind.names
    done = texts.join(spans, "id", "left").select("text", "copies", "spans").mapInArrow(cut, kind)
    return rows.join(done, "u").drop("u")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - 199, 0))) AS i FROM d)),
r AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true)::INT AS new FROM s SEMI JOIN (SELECT k FROM s GROUP BY k HAVING count(*) > 1) f ON s.k = f.k),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
c AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY doc_id, run),
p AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM c),
k AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept, sum(hi - lo)::BIGINT AS gone, count(*) AS n FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
