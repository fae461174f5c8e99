"""Sets of word shingles as 64-bit hashes, a block of texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shared import by_bytes

#: Words longer than this are hashed by themselves, not eight bytes of all words at a time.
LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(data: bytes, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of stretches of ``data``: eight bytes after another, mixed with the hash so far.

    A chain of such steps, unlike a polynomial in the letters, has no texts that collide whatever its constants are."""
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    mask = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    salt = mixed(np.array([2 * seed + 1], np.uint64))[0]
    with np.errstate(over="ignore"):
        out = mixed((eight[start] & mask[np.minimum(size, 8)]) ^ salt) + size.astype(np.uint64)
        at = np.flatnonzero((size > 8) & (size <= LONG))
        for done in range(8, LONG, 8):
            if not len(at):
                break
            out[at] = mixed(out[at] * np.uint64(0x9E3779B97F4A7C15) + (eight[start[at] + done] & mask[np.minimum(size[at] - done, 8)]))
            at = at[size[at] > done + 8]
    for i in np.flatnonzero(size > LONG).tolist():
        digest_ = hashlib.blake2b(data[start[i] : start[i] + size[i]], digest_size=8, salt=seed.to_bytes(8, "little"))
        out[i] = int.from_bytes(digest_.digest(), "little")
    return mixed(out)


def same(data: bytes, a: np.ndarray, b: np.ndarray, size: np.ndarray, other_size: np.ndarray) -> bool:
    """Whether all stretches from ``a`` are those from ``b``, byte for byte."""
    if (size != other_size).any():
        return False
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    mask = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    at = np.flatnonzero(a != b)
    a, b, size = a[at], b[at], size[at]
    for done in range(0, LONG, 8):
        if not len(a):
            return True
        if (((eight[a + done] ^ eight[b + done]) & mask[np.minimum(size - done, 8)]) != 0).any():
            return False
        left = size > done + 8
        a, b, size = a[left], b[left], size[left]
    return all(data[x : x + n] == data[y : y + n] for x, y, n in zip(a.tolist(), b.tolist(), size.tolist(), strict=True))


class Shingler:
    """Words are runs without ASCII white space, A-Z lower-cased; shingles are ``k`` words. Another ``seed`` gives independent hashes."""

    def __init__(self, k: int, seed: int = 0, block_bytes: int = 1_000_000):
        self.k, self.seed, self.block_bytes = k, seed, block_bytes
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        rng = np.random.Generator(np.random.PCG64([5, seed]))
        self.factor = rng.integers(1, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For each text (null: empty) its sorted distinct shingle hashes."""
        for _, found in self.with_texts(column):
            yield found

    def with_texts(self, column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
        """Each text's bytes too."""
        for texts in by_bytes((x.as_py() or b"" for x in column.cast(pa.binary())), self.block_bytes):
            yield from zip(texts, self._block(texts), strict=True)

    def _block(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        # a space after each text keeps words apart
        data = b" ".join(texts).lower() + b" "
        inside = ~self.space[np.frombuffer(data, np.uint8)]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        start, end = edge[::2], edge[1::2]
        word = hashed(data, start, end - start, self.seed)
        first = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        n = len(word) - self.k + 1
        with np.errstate(over="ignore"):
            runs = np.zeros(max(n, 0), np.uint64)
            for i in range(self.k if n > 0 else 0):
                runs += word[i : i + n] * self.factor[i]
            runs = mixed(runs)
            for lo, hi in zip(first, first[1:], strict=False):
                if hi - lo >= self.k:
                    yield np.unique(runs[lo : hi - self.k + 1])
                elif hi > lo:
                    yield mixed(np.array([(word[lo:hi] * self.factor[: hi - lo]).sum() + np.uint64(hi - lo)], np.uint64))
                else:
                    yield runs[:0]


def digest(text: bytes, hashes: np.ndarray, k: int) -> tuple[int, int]:
    """Two 64-bit numbers for a text's set, as signed; for a set of a few shingles one of them is of the very words."""
    with np.errstate(over="ignore"):
        both = [mixed(hashes + np.uint64(1)).sum(), mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()]
    if 0 < len(hashes) <= 8:
        words = text.lower().split()
        shingles = {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
        both[1] = int.from_bytes(hashlib.blake2b(b"\n".join(sorted(shingles)), digest_size=8).digest(), "little")
    return tuple(int(np.uint64(x).view(np.int64)) for x in both)
