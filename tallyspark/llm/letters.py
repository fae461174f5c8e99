"""Blocks of texts as arrays of code points, with their runs of letters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .shared import by_bytes


class Letters:
    """Tells which code points are letters; each is looked up once."""

    def __init__(self):
        self.kind = np.zeros(0x110000, np.int8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        kind = self.kind[codes]
        if (kind == 0).any():
            for c in np.unique(codes[kind == 0]).tolist():
                self.kind[c] = 1 if chr(c).isalpha() else -1
            kind = self.kind[codes]
        return kind == 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def blocks(column: Iterable, chars: int) -> Iterator[list[str]]:
    """A string column's texts, null as empty, in lists of about so many characters."""
    yield from by_bytes((x.as_py() or "" if isinstance(x, pa.Scalar) else x or "" for x in column), chars)
