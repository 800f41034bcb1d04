"""Packing tokenized documents into sequences by best-fit decreasing.

Documents longer than a window are first cut into full windows. The rest are placed
longest first, each in the open sequence with the least room that suffices; a segment
tree over the remaining room finds it. Since only lengths matter, the plan is made on
the number of pieces of each length (as many numbers as a window has tokens, whatever the
input), for all pieces of a length at once, and is exactly what placing them one by one
gives. Pieces then take the places planned for their length by rank.

Cases: a null text is empty; an empty text is its closing token. Repeated rows are packed
each. An empty table gives an empty result. Columns beside id and text are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _pretok as P
from . import _vec as V
from ._pretok import ragged
from ._shared import small_batches, table

SIZE = 1024

#: New words in one string that goes to the tokenizer, which needs several times its memory meanwhile.
JOINED = 1024


class Coder:
    """Token ids of pieces, kept for pieces seen before; a worker has one. limit: bytes kept at most before it starts anew.

    The ids are those of `tokenizers`, piece by piece. Pieces are looked up by a 64-bit hash
    and taken for equal only if their bytes are; a piece whose bytes differ from those
    behind its hash is encoded by itself. New pieces go to the model of the file in long
    strings, in the characters that stand for bytes there and with a space between pieces,
    as an encoding a piece takes thrice the time.
    """

    def __init__(self, path: str, limit: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        before = self.tokenizer.pre_tokenizer
        self.plain = isinstance(before, ByteLevel) and not before.add_prefix_space and self.tokenizer.normalizer is None
        self.model = Tokenizer(self.tokenizer.model)  # the same model, not a copy
        self.model.pre_tokenizer = WhitespaceSplit()
        # a byte whose Latin-1 character is printable is that character, the others are those from U+0100 in order; the last is the space between pieces
        signs = sorted(map(ord, ByteLevel.alphabet()))
        self.sign = np.append(np.arange(256), 32).astype("<u4")
        self.sign[np.setdiff1d(np.arange(256), signs)] = [c for c in signs if c > 255]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        self.width[list(vocab.values())] = list(map(len, vocab))
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, V.U64), np.zeros(0, np.int64)  # at: number of the entry
        self.code = P.codes(np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 2)
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def kept_bytes(self) -> int:
        return 64 * len(self.keys) + 4 * len(self.flat) + len(self.text)

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        if self.plain:
            cuts = [self._joined(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
            flat = np.concatenate(cuts)
            # ids fall to words by their bytes; where the two don't meet, the vocabulary is not of bytes
            ends, at = np.cumsum(self.width[flat]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            last = np.searchsorted(ends, at)
            if len(ends) and ends[-1] == at[-1] and (ends[last] == at).all():
                return flat, np.diff(last, prepend=-1)
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum())), size

    def _joined(self, words: list[bytes]) -> np.ndarray:
        """Ids of the words, one after another."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        signs = np.full(len(data) + len(words), self.sign[256])
        signs[np.arange(len(data)) + np.repeat(np.arange(len(words)), size)] = self.sign[data]
        return np.array(self.model.encode_batch_fast([signs.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.uint32)

    def _append(self, words: list[bytes]) -> np.ndarray:
        flat, size = self.ids_of(words)
        new = len(self.start) + np.arange(len(size))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        return new

    def entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each piece's entry."""
        if self.kept_bytes() > self.limit:
            self.clear()
        raw, code = bytes(data), P.codes(data, start, end)
        keys, one, number = np.unique(code.key, return_index=True, return_inverse=True)
        odd = ~P.same(code, np.arange(len(start)), data, start, code, one[number], data, start)
        to = np.searchsorted(self.keys, keys)
        has = np.zeros(len(keys), bool)
        inside = to < len(self.keys)
        has[inside] = self.keys[to[inside]] == keys[inside]
        if has.any():
            known = self.at[to[has]]
            other = ~P.same(code, one[has], data, start, self.code, known, self.text, self.text_at)
            if other.any():
                bad = np.zeros(len(keys), bool)
                bad[np.flatnonzero(has)[other]] = True
                odd |= bad[number]
        if not has.all():
            fresh = one[~has]
            entry = self._append([raw[a:b] for a, b in zip(start[fresh].tolist(), end[fresh].tolist())])
            size = np.where(end[fresh] - start[fresh] > 16, end[fresh] - start[fresh], 0)
            # an entry's code and text stand at its number, also where words encoded by themselves came between
            gap = np.zeros(int(entry[0]) - len(self.text_at), np.int64)
            self.text_at = np.concatenate([self.text_at, gap, len(self.text) + np.cumsum(size) - size])
            self.text = np.concatenate([self.text, data[ragged(start[fresh], size)]])
            self.code = P.Codes(*(np.concatenate([kept, gap.astype(kept.dtype), new[fresh]]) for kept, new in zip(self.code, code)))
            self.keys, self.at = np.insert(self.keys, to[~has], keys[~has]), np.insert(self.at, to[~has], entry)
            to = np.searchsorted(self.keys, keys)
        out = self.at[to][number]
        if odd.any():
            mine = {raw[a:b]: 0 for a, b in zip(start[odd].tolist(), end[odd].tolist())}
            mine = dict(zip(mine, self._append(list(mine)).tolist()))
            out[odd] = [mine[raw[a:b]] for a, b in zip(start[odd].tolist(), end[odd].tolist())]
        return out

    def encode(self, data: np.ndarray, off: np.ndarray, close: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, each row with `close` (if any) after it, and the rows' borders in them."""
        raw = bytes(data)
        if any(s in raw for s in self.special):  # their strings are tokens of their own
            rows = [np.array([*self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, *([] if close is None else [close])], np.uint32) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        start, end, first = P.split(data, off, self.pattern)
        entry = self.entries(data, start, end) if len(start) else np.zeros(0, np.int64)
        if close is None:
            border = np.concatenate([[0], np.cumsum(self.size[entry])])
            return self.flat[ragged(self.start[entry], self.size[entry])], border[first]
        flat = np.append(self.flat, np.uint32(close))
        starts, sizes = np.append(self.start, len(self.flat)), np.append(self.size, 1)
        entry = np.insert(entry, first[1:], len(self.start))
        border = np.concatenate([[0], np.cumsum(sizes[entry])])
        return flat[ragged(starts[entry], sizes[entry])], border[first + np.arange(len(first))]


_CODERS: dict[str, Coder] = {}


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, close: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and one rest a document."""

    def run(batches):
        coder = _CODERS.setdefault(tokenizer, None) or _CODERS.__setitem__(tokenizer, Coder(tokenizer)) or _CODERS[tokenizer]
        for batch in batches:
            for lo, hi, data, off in V.chunks(batch.column(1), 1 << 20):
                ids, border = coder.encode(data, off, close)
                n = np.diff(border)
                parts = -(-n // size)
                row = np.repeat(np.arange(hi - lo), parts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * size
                length = np.minimum(size, n[row] - start)
                raw, a = memoryview(ids.astype("<u4")).cast("B"), border[row] + start
                crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(a.tolist(), length.tolist())]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


class Rooms:
    """A segment tree over remaining room 0..size: which rooms have open sequences."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree, self.open = [False] * (2 * self.leaves), [[] for _ in range(size + 1)]

    def put(self, room: int, base: int, n: int) -> None:
        if n and room:
            self.open[room].append((base, n))
            self._set(room, True)

    def take(self, room: int) -> tuple[int, int]:
        got = self.open[room].pop()
        if not self.open[room]:
            self._set(room, False)
        return got

    def _set(self, room: int, value: bool) -> None:
        i = room + self.leaves
        self.tree[i] = value
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room of `least` or more."""
        i = least + self.leaves
        if self.tree[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for counts of lengths. Runs (length, first rank, n, first sequence, offset): ranks and sequences of a run go up together."""
    rooms, out, fresh = Rooms(size), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, base = size, fresh
                n = -(-left // (size // length))
                fresh += n
            else:
                base, n = rooms.take(room)
            fit = room // length
            # the sequence just used has the least room, so each is filled before the next
            full, rest = min(n, left // fit), 0
            if full < n:
                rest = left - full * fit if left < n * fit else 0
            for k in range(fit if full else 0):
                out.append((length, rank, full, base, size - room + k * length))
                rank += full
            for k in range(rest):
                out.append((length, rank, 1, base + full, size - room + k * length))
                rank += 1
            rooms.put(room - fit * length, base, full)
            used = full + (rest > 0)
            if rest:
                rooms.put(room - rest * length, base + full, 1)
            rooms.put(room, base + used, n - used)
            left = counts[length] - rank
    return out


def pack(rows: DataFrame, size: int = SIZE, share: int = 100_000) -> DataFrame:
    """rows (doc_id, start, length, ...) with sequence_id and offset. share: about as many rows are ranked in one group."""
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # `size` rows at most
    total = sum(counts.values())
    groups = max(1, -(-total // share), rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    below = dealt.groupBy("length", "g").count()
    below = below.select("length", "g", (F.sum("count").over(Window.partitionBy("length").orderBy("g")) - F.col("count")).alias("below"))
    rank = F.row_number().over(Window.partitionBy("length", "g").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("rank", rank).join(below, ["length", "g"]).select(*rows.columns, (F.col("rank") + F.col("below")).alias("rank"))
    runs: dict[int, np.ndarray] = {}
    for length, *run in plan(counts, size):
        runs.setdefault(length, []).append(run)
    runs = {k: np.array(v).T for k, v in runs.items()}
    shared = rows.sparkSession.sparkContext.broadcast(runs)  # its size depends on `size` alone
    names = rows.columns

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(names_at[c]).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                first, _, base, where = shared.value[int(k)]
                i = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = base[i] + rank[at] - first[i], where[i]
            yield pa.record_batch([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names_at = {c: i for i, c in enumerate([*names, "rank"])}
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """Every piece of every document with its place; a document is read and tokenized once."""
    import public_tokenizers

    small_batches(docs.sparkSession)
    return pack(table(pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), size=size), "pieces"), size)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
