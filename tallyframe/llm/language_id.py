"""Language identification by script, word scores and Viterbi.

Each word has a score for each language: the log-likelihood of its byte trigrams under
counts learned from labelled texts. The script of its letters first narrows the languages
to those seen with it. A Viterbi pass with a penalty for each switch of language labels
spans of words; the language with most letters labelled is the prediction.

Cases: null texts and texts without a letter are `und` with score 0; a script that no
language was seen with leaves all open; with no training text everything is `und`.
Ties go to the language that comes first in order. Rows are labelled one by one; all columns
are carried along as `row`, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _vec as V
from ._shared import crc_mod, small_batches

BITS = 16
#: Cost of a switch of language, in nats; smoothing of a trigram's count; labelled texts to learn from, at most.
SWITCH, PRIOR, SAMPLE = 12.0, 0.5, 20_000

#: The script that a UTF-8 lead byte stands for. 0 Latin, 1 Greek, 2 Cyrillic, 3 Armenian and Hebrew, 4 Arabic, 5 Indic, 6 other of three bytes, 7 Han and kana, 8 Hangul, 9 rest.
SCRIPT = np.zeros(256, np.int8)
for _low, _high, _script in ((0xCE, 0xCF, 1), (0xD0, 0xD4, 2), (0xD5, 0xD7, 3), (0xD8, 0xDF, 4), (0xE0, 0xE0, 5), (0xE1, 0xE2, 6), (0xE3, 0xE9, 7), (0xEA, 0xED, 8), (0xEE, 0xF4, 9)):
    SCRIPT[_low : _high + 1] = _script
N_SCRIPTS = 10
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
FLAT = np.where(LETTER, V.LOWER, 0).astype(np.int64)


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashed trigram around each byte; start, end of each run of letters, and the first of each row."""
    start, end = V.runs(LETTER[data], off)
    flat = FLAT[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != 0x97)) + 1
    flat[upper] += 32
    around = np.zeros(len(flat) + 2, np.int64)
    around[1:-1] = flat
    left, right = around[:-2].copy(), around[2:].copy()
    left[start], right[end - 1] = 0, 0
    code = ((left << 16) | (flat << 8) | right) * 0x9E3779B1 & 0xFFFFFFFF
    return code >> (32 - BITS), start, end, np.searchsorted(start, off)


def scripts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.int8)
    return np.maximum.reduceat(SCRIPT[data], np.stack([start, np.minimum(end, len(data) - 1)], 1).ravel())[::2] if len(data) > 1 else SCRIPT[data]


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, seen: np.ndarray):
        """counts: trigrams by language; seen: words by language and script."""
        self.langs = langs
        self.logs = np.ascontiguousarray(np.log((counts + PRIOR) / (counts.sum(1, keepdims=True) + PRIOR * counts.shape[1])).T.astype(np.float32)) if langs else None
        share = seen / np.maximum(seen.sum(1, keepdims=True), 1)
        fits = share >= 1e-3
        fits[:, ~fits.any(0)] = True
        self.bars = np.where(fits, 0, -50.0).T.astype(np.float32)

    def word_scores(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score by word and language, letters' bytes of each word, first word of each row."""
        code, start, end, first = trigrams(data, off)
        out = np.empty((len(start), len(self.langs)), np.float32)
        if len(start):
            edges = np.stack([start, end], 1).ravel()
            cut = edges[:-1] if edges[-1] == len(data) else edges
            for k in range(len(self.langs)):
                out[:, k] = np.add.reduceat(self.logs[code, k], cut)[::2][: len(start)]
            out += self.bars[scripts(data, start, end)]
        return out, end - start, first

    def spans(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The language of each word on the best path of its row; all rows step together, the longest first."""
        n, k = score.shape
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        size, at = size[order], first[:-1][order]
        longest = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # rows with more than t words
        moved, best, label = np.zeros((n, k), bool), np.zeros(n, np.int16), np.zeros(n, np.int16)
        path = np.zeros((len(size), k), np.float32)
        last = np.zeros(len(size), np.int64)
        for t in range(longest):
            m = live[t]
            v, w = path[:m], at[:m] + t
            if t:
                top = v.argmax(1)
                best[w] = top
                lead = v[np.arange(m), top][:, None] - SWITCH
                moved[w] = lead > v
                np.maximum(v, lead, out=v)
            v += score[w]
            v -= v.max(1, keepdims=True)
        last[:] = path.argmax(1)
        for t in range(longest - 1, -1, -1):
            m = live[t]
            w = at[:m] + t
            now = last[:m]
            label[w] = now
            if t:
                last[:m] = np.where(moved[w, now], best[w], now)
        return label

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, list]:
        """Language, score and spans [(language, first word, end word)] as label runs of each row."""
        langs, scores, labels = [], [], []
        for _, _, data, off in V.chunks(column, max(1 << 20, (16 << 20) // max(4, len(self.langs)))):
            parts = [self.word_scores(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in _pieces(off)]
            score, size = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
            label = self.spans(score, first)
            row = np.repeat(np.arange(len(off) - 1), np.diff(first))
            mass = np.bincount(row * len(self.langs) + label, size, (len(off) - 1) * len(self.langs)).reshape(-1, len(self.langs))
            top, total = mass.argmax(1), mass.sum(1)
            scores.append(np.where(total > 0, mass.max(1) / np.maximum(total, 1), 0))
            langs += [self.langs[i] if has else "und" for i, has in zip(top.tolist(), (total > 0).tolist())]
            labels.append((first, label))
        return langs, np.concatenate(scores) if scores else np.zeros(0), labels


def _pieces(off: np.ndarray, size: int = 1 << 20) -> list[tuple[int, int]]:
    out, lo = [], 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def _no_letters(column: pa.Array) -> np.ndarray:
    """Rows whose bytes outside ASCII, if any, are no letters either."""
    data, off = V.strings(column)
    plain = np.zeros(256, bool)
    plain[65:91] = plain[97:123] = True
    n = np.concatenate([[0], np.cumsum(plain[data])])
    bare = n[off[1:]] == n[off[:-1]]
    for i in np.flatnonzero(bare):
        bare[i] = not any(c.isalpha() for c in bytes(data[off[i] : off[i + 1]]).decode("utf-8", "replace"))
    return bare


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learns from rows with a language, at most about `sample` of them, drawn by a hash of the id."""
    docs = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    n = docs.select("i").count()
    if n > sample:
        docs = docs.where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < int((1 << 20) * sample / n))

    def count(batches):
        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lo, hi, data, off in V.chunks(batch.column(1)):
                code, start, end, first = trigrams(data, off)
                kind, names = scripts(data, start, end), batch.column(0).slice(lo, hi - lo).to_pylist()
                for i, name in enumerate(names):
                    a, b = first[i], first[i + 1]
                    if b > a:
                        t, s = sums.setdefault(name, [np.zeros(1 << BITS, np.int64), np.zeros(N_SCRIPTS, np.int64)])
                        inside = FLAT[data[start[a] : end[b - 1]]] > 0
                        np.add.at(t, code[start[a] : end[b - 1]][inside], 1)
                        s += np.bincount(kind[a:b], minlength=N_SCRIPTS)
        for name, (t, s) in sums.items():
            both = np.concatenate([t, s])
            at = np.flatnonzero(both)
            yield pa.record_batch([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(both[at])], ["lang", "event", "n"])

    rows = docs.select("lang", "text").mapInArrow(count, "lang string, event int, n bigint").groupBy("lang", "event").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    both = np.zeros((len(langs), (1 << BITS) + N_SCRIPTS))
    number = {name: i for i, name in enumerate(langs)}
    both[[number[x] for x in rows.column("lang").to_pylist()], rows.column("event").to_numpy()] = rows.column("n").to_numpy()
    return Model(langs, both[:, : 1 << BITS], both[:, 1 << BITS :])


def _label_runs(model: Model, first: np.ndarray, label: np.ndarray, none: np.ndarray) -> pa.Array:
    """Runs of equal labels of each row as a list of (lang, first_word, end_word); rows of `none` have an empty one."""
    cut = np.ones(len(label), bool)
    cut[1:] = label[1:] != label[:-1]
    cut[first[:-1][first[:-1] < len(label)]] = True
    row = np.repeat(np.arange(len(none)), np.diff(first))
    cut &= ~none[row]
    at = np.flatnonzero(cut)
    end = np.minimum(np.append(at[1:], len(label)), first[row[at] + 1])
    border = np.searchsorted(row[at], np.arange(len(none) + 1)).astype(np.int32)
    names = pa.DictionaryArray.from_arrays(pa.array(label[at].astype(np.int32)), pa.array(model.langs)).cast(pa.string())
    words = [pa.array((x - first[row[at]]).astype(np.int32)) for x in (at, end)]
    return pa.ListArray.from_arrays(pa.array(border), pa.StructArray.from_arrays([names, *words], ["lang", "first_word", "end_word"]))


_SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())]))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs as `row`, with lang_pred, lang_score and lang_spans (lang, first_word, end_word)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(1)
            if not model.langs:
                langs, scores, spans = ["und"] * batch.num_rows, np.zeros(batch.num_rows), pa.array([[]] * batch.num_rows, span)
            else:
                langs, scores, labels = model.predict(column)
                bare = _no_letters(column)
                langs, scores, spans, row = ["und" if b else x for x, b in zip(langs, bare.tolist())], np.where(bare, 0.0, scores), [], 0
                for first, label in labels:
                    spans.append(_label_runs(model, first, label, bare[row : row + len(first) - 1]))
                    row += len(first) - 1
                spans = pa.concat_arrays(spans)
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(scores), spans], out.names)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    out = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_spans", _SPANS)])
    return rows.mapInArrow(run, out)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", (crc_mod(F.col("row.doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
