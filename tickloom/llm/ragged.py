"""Numpy helpers over many texts at once, used inside Python tasks."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterator

import numpy as np

U64 = np.uint64


def release() -> None:
    """Give freed memory back to the system: Python workers stay alive between
    stages, beside an executor whose heap needs the room."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}
#: Between two visible characters a single space starts a new token whatever surrounds it.
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def long_pieces(text: str, size: int) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut only before spaces
    between visible characters; a text without such a space stays whole."""
    at = 0
    while len(text) - at > size and (cut := _SAFE_CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def batches(pieces: Iterator[tuple[int, str]], size: int) -> Iterator[list[tuple[int, str]]]:
    """Consecutive (row, piece) pairs, about ``size`` characters together."""
    held, n = [], 0
    for row, piece in pieces:
        held.append((row, piece))
        n += len(piece) + 1
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, 1 << 20), base, dtype=U64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _powers[name] = np.multiply.accumulate(p)
    return _powers[name][:n]


class SliceHashes:
    """64-bit hash of any slice codes[start:end], from one prefix sum.

    Polynomial in randomised character values, mixed with the length: equal
    slices have equal hashes; two different ones agree once in about 2**64.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.prefix = np.zeros(n + 1, dtype=U64)
        with np.errstate(over="ignore"):
            np.cumsum(mix(codes.astype(U64) + U64(0x632BE59BD9B4E019)) * _power("up", _BASE, n), out=self.prefix[1:])
        self.down = _power("down", pow(_BASE, -1, 1 << 64), n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.prefix[ends] - self.prefix[starts]) * self.down[starts]
            return mix(h ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


def slice_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SliceHashes(codes)(starts, ends)


class DirectMap:
    """A cache from 64-bit hash to row of a value array: bounded, and a key may
    displace another (which is then computed again)."""

    def __init__(self, bits: int = 20, dtype=np.int32):
        self.mask = U64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=U64)
        self.values = np.full(1 << bits, -1, dtype=dtype)

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, which of them are known)."""
        at = (h & self.mask).astype(np.int64)
        v = self.values[at]
        return v, (self.keys[at] == h) & (v >= 0)

    def put(self, h: np.ndarray, v: np.ndarray) -> None:
        at = (h & self.mask).astype(np.int64)
        # One writer for each slot, so that key and value stay together.
        _, first = np.unique(at, return_index=True)
        self.keys[at[first]] = h[first]
        self.values[at[first]] = v[first]
