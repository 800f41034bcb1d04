"""LM scoring by cross-entropy difference.

Two interpolated bigram models, one of a target corpus and one of the background, share
one vocabulary: the distinct words of both. Words and bigrams are keyed by 64-bit hashes
and counted without a bound on their number. Documents are dealt, compressed, to blocks of
about BLOCK bytes by a hash; each block sends its distinct events and their counts once, dealt to parts by ranges
of the key. A part adds up the counts of its events and answers each block with those of
the block's events, in their order. A second pass over a block scores each document by the
mean over its tokens of loss under the target model minus loss under the background model.
Lower: more like the target. Both models are made alike: the same smoothing and mixture over
the same vocabulary, to which the end of a text belongs as a successor, so that a word's count
is that of all its successors and an estimate sums to one. A model that has counted the very
token that it scores leaves it out. Blocks and parts grow in number with the texts, not in size.

Cases: null and empty texts have no tokens and a null score; an empty target or background
has the uniform model, as have words in neither corpus, which share one more entry. Rows are
scored one by one, so repeated rows get equal scores; columns beside id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from ._shared import table

#: Bytes of text of a block, and of the texts that a part of the events stands for.
BLOCK = 8 << 20
#: Tokens that a count of a partition holds before it sends them, and bytes of documents that are dealt at once.
HELD, DEALT = 1 << 20, 16 << 20
#: Weight of the bigram estimate, and what each unigram gets beforehand.
MIX, PRIOR = 0.6, 0.1
TARGET, BACKGROUND, NEITHER = 0, 1, -1
SENT = "part int, model int, block int, keys binary, n binary"
NUMBERS = "words", "target", "background"


@dataclass(frozen=True)
class Corpus:
    """Texts of a model and their bytes, with some for each row."""

    texts: DataFrame
    size: int


def fit(texts: DataFrame, text_col: str = "text") -> Corpus:
    """The texts to count; all events of all rows are counted where documents are scored."""
    texts = texts.select(F.col(text_col).alias("text"))
    return Corpus(texts, texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0] or 0)


def events(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token its word's key, whether a token is before it in its text, and its bigram's key; and the first token of each row."""
    _, _, first, h = V.word_hashes(data, off)
    before, inner = np.zeros(len(h), V.U64), np.ones(len(h), bool)
    before[1:] = h[:-1]
    inner[first[:-1][first[:-1] < len(h)]] = False
    return h, inner, V.mix(before * V.U64(0x9E3779B97F4A7C15) + h), first


def packed(uni: np.ndarray, bi: np.ndarray, model: int, block: int, parts: int) -> pa.RecordBatch:
    """Rows of SENT: sorted distinct keys and their counts, by part: 2 * part of words, 2 * part + 1 of bigrams."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], V.U64)
    rows = []
    for kind, events in enumerate((uni, bi)):
        keys, n = np.unique(events, return_counts=True)
        at = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
        rows += [(2 * p + kind, model, block, narrow(keys[a:b]), squeezed(n[a:b])) for p, (a, b) in enumerate(zip(at, at[1:])) if b > a]
    kinds = pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["part", "model", "block", "keys", "n"])


def narrow(keys: np.ndarray) -> bytes:
    """The number of sorted keys, and their differences by planes of bytes, of which the high ones are small."""
    planes = np.diff(keys, prepend=V.U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(keys).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def wide(data: bytes) -> np.ndarray:
    many = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 8 * many, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, many).T).view("<u8").ravel(), dtype=V.U64)


def squeezed(n: np.ndarray) -> bytes:
    return pa.compress(n.astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def loose(n: bytes, many: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(n, many * 8, codec="zstd", asbytes=True), np.int64)


def tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words, inner and bigrams of events() for a whole column, and the number of tokens of each row."""
    out = []
    for _, _, data, off in V.chunks(texts):
        uni, inner, bi, first = events(data, off)
        out.append((uni, inner, bi, np.diff(first)))
    if not out:
        return np.zeros(0, V.U64), np.zeros(0, bool), np.zeros(0, V.U64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, docs): the documents of a run of rows that go to a block, compressed."""
    held, size = [], 0

    def sent() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows, [("block", "ascending")])).combine_chunks()
        ids, at = np.unique(rows.column("block").to_numpy(), return_index=True)
        docs, out = rows.select(["doc_id", "text"]), []
        for a, b in zip(at, [*at[1:], len(rows)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(docs.slice(a, b - a))
            out.append(sink.getvalue().to_pybytes())
        return pa.record_batch([pa.array(ids, pa.int32()), pa.array(out, pa.binary())], ["block", "docs"])

    for batch in batches:
        lo = 0
        for _, hi, data, _ in V.chunks(batch.column(1), DEALT // 4):
            held.append(batch.slice(lo, hi - lo))
            size, lo = size + len(data) + 32 * (hi - lo), hi
            if size >= DEALT:
                yield sent()
                held, size = [], 0
    if held:
        yield sent()


def dealt(rows: pa.Table) -> pa.Table:
    """The documents of a block."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in rows.column("docs").to_pylist()])


def counted(corpus: Corpus, model: int, parts: int) -> DataFrame:
    """Rows of SENT of a corpus whose texts ask for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for _, _, data, off in V.chunks(batch.column(0)):
                uni, inner, bi, _ = events(data, off)
                held.append((uni, bi[inner]))
                many += len(uni)
                if many >= HELD:
                    yield packed(*map(np.concatenate, zip(*held)), model, -1, parts)
                    held, many = [], 0
        if many:
            yield packed(*map(np.concatenate, zip(*held)), model, -1, parts)

    return corpus.texts.mapInArrow(run, SENT)


def answer(rows: pa.Table) -> pa.Table:
    """The counts of a part's events under both models for each block that asks, and a row of the part's numbers of words and tokens."""
    part, model, block, n = (rows.column(c).to_pylist() for c in ("part", "model", "block", "n"))
    keys = [wide(k) for k in rows.column("keys").to_pylist()]
    ends = np.cumsum([0, *map(len, keys)])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.zeros((2, len(distinct)), np.int64)
    own = [at[a:b] for a, b in zip(ends, ends[1:])]
    for m, where, x in zip(model, own, n):
        if m != NEITHER:
            counts[m, where] += loose(x, len(where))
    out = [(b, part[0], squeezed(counts[:, where].ravel()), len(where), 0, 0, 0) for b, where in zip(block, own) if b >= 0]
    if part[0] % 2 == 0:
        out.append((-1, part[0], b"", 0, int(counts.any(axis=0).sum()), *counts.sum(axis=1).tolist()))
    kinds = pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
    return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["block", "part", "n", "many", *NUMBERS])


def losses(n1: np.ndarray, n2: np.ndarray, inner: np.ndarray, total: int, words: int, own: int = 0) -> np.ndarray:
    """Of each token, in nats. n1, n2: counts of its word and bigram. own: 1 if the model has counted the very token, which is then taken off all counts."""
    p1 = (n1 - own + PRIOR) / (total - own + PRIOR * (words + 1))
    seen = np.zeros(len(n1), np.int64)
    seen[1:] = n1[:-1] - own
    seen[~inner] = 0
    ratio = np.divide(n2 - own, seen, out=np.zeros(len(n1)), where=seen > 0)
    return -np.log(np.where(seen > 0, MIX * ratio + (1 - MIX) * p1, p1))


def score(docs: DataFrame, target: Corpus, background: Corpus | None = None, id_col: str = "doc_id", text_col: str = "text", in_background: bool = True) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score), one row a document. background: None if it is the documents. in_background: the background has counted these documents."""
    own = fit(docs, text_col)
    blocks = own.size // BLOCK + 1
    parts = (own.size + target.size + (background.size if background else 0)) // BLOCK + 1
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).mapInArrow(deal, "block int, docs binary")
    model, of = (NEITHER if background else BACKGROUND), int(in_background or not background)

    def asked(rows: pa.Table) -> pa.Table:
        uni, inner, bi, _ = tokens(dealt(rows).column("text"))
        return pa.Table.from_batches([packed(uni, bi[inner], model, rows.column("block")[0].as_py(), parts)])

    sent = docs.groupBy("block").applyInArrow(asked, SENT).unionByName(counted(target, TARGET, parts))
    if background:
        sent = sent.unionByName(counted(background, BACKGROUND, parts))
    answers = table(sent.groupBy("part").applyInArrow(answer, "block int, part int, n binary, many bigint, " + ", ".join(f"{x} bigint" for x in NUMBERS)), "lm-counts")
    words, *totals = (x or 0 for x in answers.where("block < 0").agg(*map(F.sum, NUMBERS)).first())

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = dealt(rows)
        uni, inner, bi, n = tokens(rows.column("text"))
        got = sorted(zip(*(answers.column(c).to_pylist() for c in ("part", "n", "many"))))
        n1, n2 = np.zeros((2, len(uni)), np.int64), np.zeros((2, len(uni)), np.int64)
        for kind, (out, keys, where) in enumerate(((n1, uni, slice(None)), (n2, bi[inner], inner))):
            counts = [loose(x, 2 * many).reshape(2, many) for part, x, many in got if part % 2 == kind]
            distinct, at = np.unique(keys, return_inverse=True)
            if sum(c.shape[1] for c in counts) != len(distinct):
                raise RuntimeError("the texts of a block changed between the passes")
            if counts:
                out[:, where] = np.concatenate(counts, axis=1)[:, at]
        ends = np.cumsum([0, *n])
        t, b = (np.diff(np.concatenate([[0.0], np.cumsum(losses(n1[m], n2[m], inner, totals[m], words, o))])[ends]) / np.maximum(n, 1) for m, o in ((TARGET, 0), (BACKGROUND, of)))
        none = n == 0
        return pa.table([rows.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array(x, mask=none) for x in (t, b, t - b))], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    own_answers = answers.where("block >= 0").select("block", "part", "n", "many")
    return docs.groupBy("block").cogroup(own_answers.groupBy("block")).applyInArrow(run, f"doc_id {kind}, n_tokens bigint, target_loss double, background_loss double, score double")


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    """Target: the conversations; background: all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
