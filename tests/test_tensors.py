"""Tensor files: random tensors of all kinds through a file, rounding bit by bit, damaged files."""

import json
import struct

import numpy as np
import pytest
from tallyframe.sources.tensors import KINDS, TensorFile, bf16, write_tensors


def _random(rng):
    kinds = {f"w{i:02d}": rng.choice(sorted(KINDS)) for i in range(rng.integers(1, 12))}
    shapes = {n: tuple(rng.integers(0, 5, rng.integers(0, 4)).tolist()) for n in kinds}
    return {n: (rng.integers(-128, 128, s) if kinds[n] == "I8" else rng.normal(size=s) * 10.0 ** rng.integers(-3, 4)) for n, s in shapes.items()}, kinds


@pytest.mark.parametrize("seed", range(8))
def test_random_tensors_come_back(tmp_path, seed):
    tensors, kinds = _random(np.random.default_rng(seed))
    write_tensors(str(tmp_path / "x"), tensors, kinds, {"seed": str(seed)})
    write_tensors(str(tmp_path / "y"), dict(sorted(tensors.items(), reverse=True)), kinds, {"seed": str(seed)})
    f = TensorFile(str(tmp_path / "x"))
    assert (tmp_path / "x").read_bytes() == (tmp_path / "y").read_bytes() and f.meta == {"seed": str(seed)} and f.names() == sorted(tensors)
    digits = {"F32": 24, "F16": 11, "BF16": 8, "I8": 30}
    for name, x in tensors.items():
        got = f[name]
        assert got.shape == np.shape(x) and got.dtype == np.float32
        np.testing.assert_allclose(got, x, rtol=2.0 ** -digits[kinds[name]], atol=1e-7)
    assert not list(tmp_path.glob("*.part"))


def test_rounding_is_to_the_nearest_and_to_even_on_ties():
    rng = np.random.default_rng(11)
    bits = np.concatenate([rng.integers(0, 1 << 32, 4000), (rng.integers(0, 1 << 16, 2000) << 16) | 0x8000]).astype(np.uint32)
    x = bits.view(np.float32)
    for b, v, r in zip(bits.tolist(), x.tolist(), bf16(x).tolist()):
        if v != v:
            assert r & 0x7F80 == 0x7F80 and r & 0x7F
            continue
        low, rest = b >> 16, b & 0xFFFF
        up = rest > 0x8000 or (rest == 0x8000 and low & 1)
        assert r == low + up


def _file(path, header, data=b""):
    head = header if isinstance(header, bytes) else json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + data)
    return str(path)


@pytest.mark.parametrize("place, kind, shape", [([0, 12], "F32", [3, 1]), ([4, 8], "F32", [2]), ([6, 2], "F16", [0]), ([-4, 0], "F32", [1]), ([0, 8], "F32", [1]), ([0, 8], "C64", [1])])
def test_tensors_that_do_not_fit_are_refused(tmp_path, place, kind, shape):
    with pytest.raises(ValueError):
        TensorFile(_file(tmp_path / "x", {"t": {"dtype": kind, "shape": shape, "data_offsets": place}}, bytes(8)))


def test_files_that_end_early_are_refused(tmp_path):
    whole = tmp_path / "x"
    write_tensors(str(whole), {"t": np.ones(40)})
    raw = whole.read_bytes()
    for n in (3, 8, 20, len(raw) - 1):
        whole.write_bytes(raw[:n])
        with pytest.raises(ValueError):
            TensorFile(str(whole))
