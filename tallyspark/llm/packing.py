"""Cost-balanced packing of token streams into sequences of fixed capacity.

Every document (its ids, then an end id) becomes pieces; pieces become sequences
of at most ``capacity`` tokens.  A piece of n tokens costs ``linear * n +
quadratic * n * n``, an estimate of the work of its layers and of its attention,
which never crosses documents.  Whole multiples of the capacity fill sequences
of their own.  The remainders of a batch of documents are then taken in
descending length, and each goes to the sequence of the lowest cost so far that
has room for it.  When it fits nowhere, it is cut: the lowest-cost sequence with
any room takes what it can hold, and the rest is taken again in its turn.

The work is done where the texts are read, so there is no shuffle.  A task packs
its remainders in batches of ``batch_docs``, into as many sequences as they fill to
the last token.  What is left over, less than one capacity in all, goes into the next
batch; only the sequences of a task's last batch have room left, less than one
capacity in all.  So each batch takes in at
least ``batch_docs - capacity`` new remainders, however short they are.  Sequence ids
count up from task number * 2**33.

Defined results: null or empty texts are one piece of one token (the end id);
equal rows are packed one by one; columns other than id and text are dropped; an
empty table gives an empty table.  Null ids of documents are kept as they are.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import encoder_of, shipped, texts
from .shared import tidy


class Piece(NamedTuple):
    length: int
    order: int
    doc: object
    start: int
    doc_tokens: int
    ids: bytes


def balanced(pieces: Iterable[Piece], n_sequences: int, capacity: int, linear: float, quadratic: float) -> tuple[list[list[Piece]], list[Piece]]:
    """``n_sequences`` sequences of pieces, and the pieces for which no room was left.

    Longest piece first, to the cheapest sequence with room; pieces are cut only when they fit nowhere whole."""
    queue = [(-p.length, p.order, p.start, p) for p in pieces]
    heapq.heapify(queue)
    sequences: list[list[Piece]] = [[] for _ in range(n_sequences)]
    cost, room = [0.0] * n_sequences, [capacity] * n_sequences
    by_cost = [(0.0, s) for s in range(n_sequences)]
    # lengths only go down, so a sequence too full for one piece waits, most room first, until a piece fits
    waiting: list[tuple[int, float, int]] = []
    while queue and (by_cost or waiting):
        *_, p = heapq.heappop(queue)
        while waiting and -waiting[0][0] >= p.length:
            _, c, s = heapq.heappop(waiting)
            heapq.heappush(by_cost, (c, s))
        while by_cost and room[by_cost[0][1]] < p.length:
            c, s = heapq.heappop(by_cost)
            heapq.heappush(waiting, (-room[s], c, s))
        if by_cost:
            _, s = heapq.heappop(by_cost)
        else:  # fits nowhere whole: the one with most room takes a part
            _, _, s = heapq.heappop(waiting)
            n = room[s]
            rest = p._replace(length=p.length - n, start=p.start + n, ids=p.ids[4 * n :])
            heapq.heappush(queue, (-rest.length, rest.order, rest.start, rest))
            p = p._replace(length=n, ids=p.ids[: 4 * n])
        sequences[s].append(p)
        room[s] -= p.length
        cost[s] += linear * p.length + quadratic * p.length * p.length
        if room[s]:
            heapq.heappush(by_cost, (cost[s], s))
    return sequences, [p for *_, p in queue]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    batch_docs: int = 4096,
    with_ids: bool = True,
    rows_at_once: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, token_ids.

    ``start`` is the piece's place in its document, ``offset`` its place in its sequence.
    A task gives out its rows ``rows_at_once`` at a time, and a few more for the sequence that is then at hand.
    ``batch_docs`` bounds the remainders (under ``capacity`` ids each) held at once by a task; it is at least twice ``capacity``.
    """
    batch_docs = max(batch_docs, 2 * capacity)
    file = shipped(docs, tokenizer_path)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema[id_col].dataType
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(file)
        sequence, order = TaskContext.get().partitionId() << 33, 0
        pending: list[Piece] = []
        rows: list[tuple] = []
        id_type = None

        def out():
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if with_ids:
                ids = [np.frombuffer(x, "<i4") for x in columns[7]]
                ends = np.cumsum([0, *map(len, ids)]).astype("i4")
                arrays.append(pa.ListArray.from_arrays(ends, np.concatenate(ids) if ids else np.array([], "i4")))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, [*names, "token_ids"][: len(arrays)])

        def put(sequence, pieces):
            offset = 0
            for p in pieces:
                rows.append((p.doc, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, sequence, offset, p.ids))
                offset += p.length

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, found in zip(batch.column(0).to_pylist(), encoder.encode(texts(batch)), strict=True):
                ids = found.astype("<u4").tobytes() + end
                n = len(ids) // 4
                for start in range(0, n - n % capacity, capacity):
                    put(sequence, [Piece(capacity, order, doc, start, n, ids[4 * start : 4 * (start + capacity)])])
                    sequence += 1
                    if len(rows) >= rows_at_once:
                        yield out()
                if n % capacity:
                    pending.append(Piece(n % capacity, order, doc, n - n % capacity, n, ids[4 * (n - n % capacity) :]))
                order += 1
                if len(pending) >= batch_docs:
                    packed, pending = balanced(pending, sum(p.length for p in pending) // capacity, capacity, linear, quadratic)
                    for pieces in packed:
                        put(sequence, pieces)
                        sequence += 1
                        if len(rows) >= rows_at_once:
                            yield out()
                    packed = None
        for pieces in balanced(pending, -(-sum(p.length for p in pending) // capacity), capacity, linear, quadratic)[0]:
            put(sequence, pieces)
            sequence += 1
            if len(rows) >= rows_at_once:
                yield out()
        if rows:
            yield out()

    schema = f"`{id_col}` {kind.simpleString()}, " + ", ".join(f"{x} bigint" for x in names[1:]) + ", token_ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
