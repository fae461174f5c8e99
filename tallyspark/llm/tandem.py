"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch with smallest period q, as long as it keeps that period, of
``exponent * q`` words or more.  All its words occur ``exponent`` times in it, so a
text is first cut at words that are rarer, again and again until every part's words
are frequent in the part: no run is cut.  The parts of many texts, each with letters
of its own, are one string with one suffix tree, kept as suffix array, its inverse and
the LCP intervals; a place in the tree is an interval and a depth, its suffix link
leads to the interval of the following suffix.  Then, as published:

1. The string is cut into Lempel-Ziv blocks.  At each border, every period up to the
   blocks' length is tried with two common extensions.  The squares found cover the
   leftmost occurrence of every square, by turning to the right.
2. From each the tree is walked along suffix links, one turn a step, until it comes
   round: all squares of the vocabulary are then marked, each at its place.
3. The suffixes below a marked place are that square's occurrences.  Those of one
   period that follow one another word by word are one run.

Squares whose root is itself a repetition are left out, the run of the shorter period
has them.  Suffix ranks come from prefix doubling, whose levels also answer common
extensions in both directions; all steps are array operations.

Defined results: a null, empty or blank text has no words and no runs, and collapses to
the empty text; rows with a null id are handled as all others; each of repeated rows has
its row.  Columns that are not kept are dropped, so their names cannot clash.  A task
holds one block of texts, or one text if it is longer; memory is in proportion to that
text's words times the logarithm of its longest repeat.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def frequent_parts(words: list[str], times: int, shortest: int) -> Iterator[tuple[int, list[str]]]:
    """(place, part): the longest parts in which every word occurs ``times`` times or more."""
    todo = [(0, words)]
    while todo:
        at, part = todo.pop()
        if len(part) < shortest:
            continue
        count = Counter(part)
        rare = {w for w, n in count.items() if n < times}
        if not rare:
            yield at, part
            continue
        cuts = [i for i, w in enumerate(part) if w in rare]
        for a, b in zip([-1, *cuts], [*cuts, len(part)], strict=True):
            if b - a - 1 >= shortest:
                todo.append((at + a + 1, part[a + 1 : b]))


def doubled_ranks(x: np.ndarray) -> list[np.ndarray]:
    """Level l: the rank of the 2**l letters from each place on, and -1 behind the end; the last level tells all places apart."""
    levels, width = [np.append(x, -1)], 1
    while True:
        rank = levels[-1][:-1].astype(np.int64)
        if rank.max(initial=-1) == len(x) - 1:
            return levels
        second = np.zeros(len(x), np.int64)
        if width < len(x):
            second[:-width] = rank[width:] + 1
        _, rank = np.unique(rank * (len(x) + 2) + second, return_inverse=True)
        levels.append(np.append(rank.astype(np.int32), np.int32(-1)))
        width *= 2


def forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many letters from places i and j on are equal (i != j)."""
    i, j, n = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for level in range(len(levels) - 2, -1, -1):
        step = (levels[level][i] == levels[level][j]).astype(np.int64) << level
        i += step
        j += step
        n += step
    return n


def backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many letters up to places i and j, those included, are equal (i != j; -1 is before the string)."""
    i, j, n = i + 1, j + 1, np.zeros(len(i), np.int64)
    for level in range(len(levels) - 2, -1, -1):
        a, b = i - (1 << level), j - (1 << level)
        step = ((np.minimum(a, b) >= 0) & (levels[level][np.maximum(a, 0)] == levels[level][np.maximum(b, 0)])).astype(np.int64) << level
        i -= step
        j -= step
        n += step
    return n


def minima(a: np.ndarray) -> list[np.ndarray]:
    """Level l: the least of the 2**l values from each place on."""
    table = [a]
    while (1 << len(table)) <= len(a):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def down(table: list[np.ndarray], end: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The first place from which on all values before ``end`` reach ``least``."""
    end = end.copy()
    for level in range(len(table) - 1, -1, -1):
        at = end - (1 << level)
        end -= ((at >= 0) & (table[level][np.maximum(at, 0)] >= least)).astype(np.int64) << level
    return end


def up(table: list[np.ndarray], begin: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The place behind the last value that, like all from ``begin`` on, reaches ``least``."""
    begin = begin.copy()
    for level in range(len(table) - 1, -1, -1):
        top = len(table[level]) - 1
        begin += ((begin <= top) & (table[level][np.minimum(begin, top)] >= least)).astype(np.int64) << level
    return begin


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, how far in it) for every one of so many of each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def primitive(levels: list[np.ndarray], start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the k letters from ``start`` on are no repetition of a shorter word."""
    factor = np.zeros(k.max(initial=1) + 1, np.int64)  # the smallest prime that divides
    for p in range(2, len(factor)):
        if p * p >= len(factor):
            break
        if factor[p] == 0:
            multiples = factor[p * p :: p]
            multiples[multiples == 0] = p
    factor = np.where(factor == 0, np.arange(len(factor)), factor)
    whole, rest = np.ones(len(k), bool), k.copy()
    while (open_ := np.flatnonzero((rest > 1) & whole)).size:
        p = factor[rest[open_]]
        shorter = k[open_] // p
        whole[open_] &= forward(levels, start[open_], start[open_] + shorter) < k[open_] - shorter
        rest[open_] //= p
    return whole


def lempel_ziv(sa: np.ndarray, isa: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the blocks: the longest piece that begins earlier too, or one letter."""
    n, table, rank = len(sa), minima(sa), isa[np.arange(len(sa))]
    longest, places = np.ones(n, np.int64), np.arange(n)
    for near in (down(table, rank, places) - 1, up(table, rank + 1, places)):  # the next suffixes in order that begin earlier
        has = np.flatnonzero((near >= 0) & (near < n))
        longest[has] = np.maximum(longest[has], forward(levels, has, sa[near[has]]))
    starts, at, steps = [], 0, longest.tolist()
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    return starts, longest[starts]


def covering_squares(levels: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half the length) of squares that cover the leftmost ones; ``most``: the greatest period of interest of each block."""
    n, ends = len(levels[0]) - 1, starts + lengths
    after = np.append(lengths[1:], 0)
    # those with their centre in the block, around its end
    b, k = spread(np.where(ends < n, np.minimum(lengths, most), 0))
    k += 1
    h1, q = ends[b], ends[b] - k
    k1, k2 = forward(levels, h1, q), backward(levels, h1 - 1, q - 1)
    one = (k1 + k2 >= k) & (k1 > 0)
    found = [(np.maximum(q - k2, q - k + 1)[one], k[one])]
    # those that begin before the block
    b, k = spread(np.minimum(np.minimum(lengths + after, most), n - 1 - starts))
    k += 1
    h, q = starts[b], starts[b] + k
    k1, k2 = forward(levels, h, q), backward(levels, h - 1, q - 1)
    start = np.maximum(h - k2, h - k + 1)
    one = (k1 + k2 >= k) & (k1 > 0) & (k2 > 0) & (start + k <= ends[b])
    found.append((start[one], k[one]))
    start, k = (np.concatenate(c) for c in zip(*found, strict=True))
    keep = primitive(levels, start, k)
    return start[keep], k[keep]


def runs_of(x: np.ndarray, most_period: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of two periods or more, one a row, up to the period of interest at each place."""
    if len(x) < 2:
        return np.zeros((0, 3), np.int64)
    levels = doubled_ranks(x)
    isa = levels[-1][:-1].astype(np.int64)
    sa = np.empty(len(x), np.int64)
    sa[isa] = np.arange(len(x))
    starts, lengths = lempel_ziv(sa, isa, levels)
    start, k = covering_squares(levels, starts, lengths, most_period[starts])
    # one step along the suffix link is one turn of the square; after k of them it is the first again
    which, turn = spread(np.minimum(forward(levels, start, start + k) - k, k - 1) + 1)
    place, k = start[which] + turn, k[which]
    lcp = minima(np.append(-1, forward(levels, sa[:-1], sa[1:])))
    rank = isa[place]
    low, high = down(lcp, rank + 1, 2 * k) - 1, up(lcp, rank + 1, 2 * k)
    _, marked = np.unique(low * (len(x) + 1) + k, return_index=True)
    which, below = spread((high - low)[marked])
    period, place = k[marked][which], sa[low[marked][which] + below]
    order = np.lexsort((place, period))
    period, place = period[order], place[order]
    first = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1))) if len(place) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(place)) - 1
    return np.column_stack([place[first], place[last] + 2 * period[first] - place[first], period[first]])


def runs_of_texts(texts: list[list[str]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, as (start, length, period), by start and then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    letters, sizes, origin = [], [], []
    count = 0
    for t, words in enumerate(texts):
        for at, part in frequent_parts(words, exponent, max(least, exponent)):
            codes: dict[str, int] = {}
            letters.append(np.fromiter((codes.setdefault(w, len(codes)) for w in part), np.int64, len(part)) + count)
            count += len(codes)
            sizes.append(len(part))
            origin.append((t, at))
    if not sizes:
        return found
    ends = np.cumsum(sizes)
    runs = runs_of(np.concatenate(letters), np.repeat(np.array(sizes) // exponent, sizes))
    runs = runs[runs[:, 1] >= np.maximum(least, exponent * runs[:, 2])]
    part = np.searchsorted(ends, runs[:, 0], side="right")
    for (start, length, period), p in zip(runs.tolist(), part.tolist(), strict=True):
        t, at = origin[p]
        found[t].append((start - int(ends[p]) + sizes[p] + at, length, period))
    for f in found:
        f.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words but those that a run contains after its first period, with single spaces."""
    if not runs:
        return " ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return " ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def find_runs(docs: DataFrame, least: int = 6, exponent: int = 4, keep: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1 << 21) -> DataFrame:
    """(id, n_words, runs, collapsed, kept columns): the runs of at least ``least`` words and ``exponent`` periods of every whole text."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"), *(F.col(c) for c in keep))
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [WORD.findall(t or "") for t in batch.column(1).to_pylist()]
        runs = runs_of_texts(texts, least, exponent)
        flat = np.array([r for of in runs for r in of], np.int64).reshape(-1, 3)
        offsets = np.cumsum([0, *(len(of) for of in runs)])
        structs = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(RUNS.value_type))
        done = [pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), pa.array([collapsed(t, r) for t, r in zip(texts, runs, strict=True)], pa.string())]
        names = [id_col, "n_words", "runs", "collapsed", *keep]
        return pa.RecordBatch.from_arrays([batch.column(0), *done, *batch.columns[2:]], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(np.nan_to_num(pa.compute.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(float)) + 1)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + block_chars, side="right")))
                yield block(batch.slice(at, end - at))
                at = end

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{id_col}` {kinds[id_col]}", "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", *(f"`{c}` {kinds[c]}" for c in keep)])
    return rows.mapInArrow(tidy(task), schema)
