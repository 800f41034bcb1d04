"""Tensor files of the public safetensors format: a length, a JSON header, raw little-endian data."""

from __future__ import annotations

import json
import math
import os

import numpy as np

#: Bytes of a header, at most: a broken file must not ask for much memory.
HEADER = 100 << 20

# Names of the format and how their data lies in the file.
KINDS = {"F32": "<f4", "F16": "<f2", "BF16": "<u2", "I8": "i1"}


class TensorFile:
    """A mapped file; a tensor is read when it is asked for, as float32."""

    def __init__(self, path: str):
        size = os.path.getsize(path)
        with open(path, "rb") as f:
            n = int.from_bytes(f.read(8), "little")
            if size < 8 or n > min(HEADER, size - 8):
                raise ValueError(f"{path}: header of {n} bytes")
            header = json.loads(f.read(n))
        self.meta: dict[str, str] = header.pop("__metadata__", {})
        for name, e in header.items():
            a, b = e["data_offsets"]
            if e["dtype"] not in KINDS:
                raise ValueError(f"{path}: {name} is of type {e['dtype']}")
            if not 0 <= a <= b <= size - 8 - n or b - a != math.prod(e["shape"]) * np.dtype(KINDS[e["dtype"]]).itemsize:
                raise ValueError(f"{path}: {name} does not fit its place")
        self.entries = header
        self.data = np.memmap(path, np.uint8, "r", 8 + n) if size > 8 + n else np.zeros(0, np.uint8)

    def names(self) -> list[str]:
        return sorted(self.entries)

    def raw(self, name: str) -> np.ndarray:
        """As stored; BF16 as its upper halves of float32."""
        e = self.entries[name]
        a, b = e["data_offsets"]
        return self.data[a:b].view(KINDS[e["dtype"]]).reshape(e["shape"])

    def __getitem__(self, name: str) -> np.ndarray:
        raw = self.raw(name)
        if self.entries[name]["dtype"] == "BF16":
            return (raw.astype(np.uint32) << 16).view(np.float32)
        return raw.astype(np.float32)


def bf16(x: np.ndarray) -> np.ndarray:
    """Upper halves of float32, rounded to the nearest, ties to even; NaN stays NaN."""
    x = np.ascontiguousarray(x, np.float32)
    bits = x.view(np.uint32)
    rounded = (bits + 0x7FFF + ((bits >> 16) & 1)) >> 16
    return np.where(np.isnan(x), (bits >> 16) | 0x40, rounded).astype("<u2")


def write_tensors(path: str, tensors: dict[str, np.ndarray], kinds: dict[str, str] | None = None, meta: dict[str, str] | None = None) -> None:
    """Tensors by name; kinds: F32 where not given. Names are in order, so that equal tensors give equal files; the file appears whole."""
    header, parts, at = {"__metadata__": meta} if meta else {}, [], 0
    for name in sorted(tensors):
        kind, x = (kinds or {}).get(name, "F32"), np.asarray(tensors[name])
        data = (bf16(x) if kind == "BF16" else x.astype(KINDS[kind])).tobytes()
        header[name] = {"dtype": kind, "shape": list(x.shape), "data_offsets": [at, at + len(data)]}
        parts.append(data)
        at += len(data)
    head = json.dumps(header, separators=(",", ":"), ensure_ascii=False, sort_keys=True).encode()
    head += b" " * (-len(head) % 8)
    with open(f"{path}.part", "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        f.writelines(parts)
    os.replace(f"{path}.part", path)
