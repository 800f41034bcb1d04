"""Byte-level BPE encoding and decoding by ranks.

A pass over the texts splits them into pieces; the ranked merges are folded over the bytes
of the distinct words only, all words of a block together, with one table of all pairs of
tokens that merge; a worker keeps the words it has seen. Decoding concatenates the bytes of
the tokens. Nothing moves between tasks.

`folded()` is the same fold as a Spark expression (higher-order functions over byte arrays
and a literal rank table). It gives the same ids, but at corpus size it took more CPU and
disk than the limits allow (figures in the README), so the query folds in NumPy.

Cases: null and empty texts have no tokens. Words longer than LONG bytes are merged with a
heap, to the same result, as a fold takes quadratic time. Rows are encoded one by one;
repeated rows are kept; columns beside id and text are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _pretok as P
from . import _vec as V
from ._shared import small_batches
from .packing import Coder

LONG = 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """All pairs of tokens whose bytes together are a token: first << 16 | second -> rank of the whole."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a << 16 | b] = rank
    return out


def _row(a, b):
    """The row of a pair in the pair table; works on numbers and columns."""
    return (a * 40503 + b % 16) % 65536


def packed_rows(keys: dict[int, int]) -> tuple[list[int], list[int]]:
    """The pair table as short rows pushed into one another: the entry of (a, b) is at base[row] + b and holds key << 17 | rank, so that a lookup is one read and a check of the key."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for key, rank in keys.items():
        rows.setdefault(_row(key >> 16, key & 0xFFFF), []).append((key & 0xFFFF, key, rank))
    size = 1 << max(10, (2 * len(keys)).bit_length())
    flat, base, draw = np.full(size + 65536, -1, np.int64), np.zeros(65536, np.int64), np.random.default_rng(1)
    for r, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        b, key, rank = (np.array(x) for x in zip(*row))
        for _ in range(2000):
            tries = draw.integers(0, size, 64)
            free = (flat[tries[:, None] + b] < 0).all(1) & (len(set(b.tolist())) == len(b))
            if free.any():
                base[r] = tries[free.argmax()]
                flat[base[r] + b] = key << 17 | rank
                break
        else:
            raise ValueError("the rank table has no place for a row")
    return base.tolist(), flat.tolist()


def _literal(values: list, kind: str) -> Column:
    """A constant array: the optimizer parses the text once."""
    text = "[" + ",".join(map(str, values)) + "]"
    return F.from_json(F.lit(text), kind)


def folded(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a binary column's word: one merge a step, the lowest rank first and of equal ranks the leftmost, until no pair merges.

    The state holds the ids between two marks that merge with nothing, and the rank of each
    pair; a step renews the two pairs beside the merge.
    """
    mark = max(ranks.values()) + 1
    base, flat = packed_rows(pairs(ranks))
    # the literals stand once, outside the lambdas: Spark hashes a large literal anew for each expression around it
    tables = F.array(F.struct(_literal(base, "array<int>").alias("base"), _literal(flat, "array<bigint>").alias("flat"), _literal([ranks[bytes([b])] for b in range(256)], "array<int>").alias("byte")))
    chars = F.split(F.decode(word, "ISO-8859-1"), "")
    return F.transform(tables, lambda t: _fold(t, chars, mark))[0]


def _fold(table: Column, chars: Column, mark: int) -> Column:
    start = F.concat(F.array(F.lit(mark)), F.transform(chars, lambda c: F.get(table["byte"], F.ascii(c))), F.array(F.lit(mark)))

    def rank(a: Column, b: Column) -> Column:
        entry = F.get(table["flat"], F.get(table["base"], _row(a, b)) + b)
        return F.when(F.shiftright(entry, 17) == a.cast("bigint") * 65536 + b, entry.bitwiseAND(F.lit((1 << 17) - 1)).cast("int"))

    def merged(state: Column, at: Column) -> Column:
        ids, ranked = state["ids"], state["ranks"]
        new, many = F.get(ranked, at - 1), F.lit(1 << 20)
        beside = F.array(rank(F.get(ids, at - 2), new), rank(new, F.get(ids, at + 1)))
        return F.struct(F.concat(F.slice(ids, F.lit(1), at - 1), F.array(new), F.slice(ids, at + 2, many)).alias("ids"), F.concat(F.slice(ranked, F.lit(1), at - 2), beside, F.slice(ranked, at + 2, many)).alias("ranks"))

    def step(state: Column, _: Column) -> Column:
        # a pair's rank is the id of what it makes; null: no pair merges
        at = F.array_position(state["ranks"], F.array_min(state["ranks"])).cast("int")
        return F.when(F.array_min(state["ranks"]).isNull(), state).otherwise(F.transform(F.array(at), lambda p: merged(state, p))[0])

    first = F.transform(F.array(start), lambda ids: F.struct(ids.alias("ids"), F.zip_with(F.slice(ids, F.lit(1), F.size(ids) - 1), F.slice(ids, F.lit(2), F.size(ids) - 1), rank).alias("ranks")))[0]
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(chars) - 1, F.lit(1))), first, step, lambda s: F.slice(s["ids"], F.lit(2), F.size(s["ids"]) - 2))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs and linked neighbours."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, bytes, bytes]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (r := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, parts[i], parts[j]))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p is not None]


class RankCoder(Coder):
    """Coder whose pieces are merged by ranks."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 32 << 20):
        import public_tokenizers
        import regex

        self.ranks, self.limit, self.special = ranks, limit, []
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.base, self.table = (np.array(x) for x in packed_rows(pairs(ranks)))
        self.byte = np.array([ranks[bytes([b])] for b in range(256)])
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            tokens[r] = token
        self.pieces = _joined(tokens)
        self.numbers = _joined([b"%d," % i for i in range(len(tokens))])
        self.clear()

    def fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and the number of each word's. One merge a round in every word: the lowest rank, of equal ones the leftmost."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_ids, done_words, none = [], [], np.int64(1 << 62)
        while len(ids):
            a, b = ids[:-1], ids[1:]
            entry = self.table[self.base[_row(a, b)] + b]
            hit = (entry >> 17 == (a << 16 | b)) & (word[1:] == word[:-1])
            best = np.full(len(ids), none)
            best[:-1][hit] = ((entry[hit] & 0x1FFFF) << 40) | np.flatnonzero(hit)
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(best, start)
            open_ = best < none
            at = best[open_] & ((1 << 40) - 1)
            ids[at] = best[open_] >> 40
            live = np.repeat(open_, np.diff(np.append(start, len(ids))))
            done_ids.append(ids[~live])
            done_words.append(word[~live])
            live[at + 1] = False
            ids, word = ids[live], word[live]
        if not done_ids:
            return np.zeros(0, np.int64), size
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        flat, size = self.fold([b"" if len(w) > LONG else w for w in words])
        if long:
            parts = np.split(flat, np.cumsum(size)[:-1])
            for i in long:
                parts[i] = np.array(merge_long(words[i], self.ranks), np.int64)
            flat, size = np.concatenate(parts), np.array([len(x) for x in parts])
        return flat, size

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after another."""
        return _gather(self.pieces, ids)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _gather(parts: tuple[np.ndarray, np.ndarray], which: np.ndarray) -> np.ndarray:
    flat, at = parts
    return flat[P.ragged(at[which], at[which + 1] - at[which])]


_CODERS: dict[str, RankCoder] = {}


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with the ids and the decoded bytes besides on request. path: of the rank file."""

    def run(batches):
        if path not in _CODERS:
            _CODERS[path] = RankCoder(load_ranks(path))
        coder = _CODERS[path]
        for batch in batches:
            for lo, hi, data, off in V.chunks(batch.column(1), 1 << 20):
                ids, border = coder.encode(data, off, None)
                ids = ids.astype(np.int64)
                text, back = _gather(coder.numbers, ids), coder.decode(ids)
                in_text, in_back = (np.concatenate([[0], np.cumsum(np.diff(at)[ids])])[border].tolist() for at in (coder.numbers[1], coder.pieces[1]))
                text, back = memoryview(text), memoryview(back)
                shown = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(in_text[:-1], in_text[1:])]
                decoded = [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(in_back[:-1], in_back[1:])]
                out = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(border)), pa.array(shown), pa.array(decoded)]
                if with_ids:
                    out += [pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array([bytes(back[a:b]) for a, b in zip(in_back[:-1], in_back[1:])], pa.binary())]
                yield pa.record_batch(out, names)

    small_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
