"""Nearest neighbours by inner product with a block matrix join of int8 codes.

Rows are dealt into blocks, the stated queries into pieces, and a task has one of each.
A vector x is ``scale * codes + error`` with whole codes from -127 to 127, so
``<q, x>`` is off ``scale_q * scale_x * <codes_q, codes_x>`` by at most
``|error_q| |codes_x| scale_x + |q| |error_x|``.  The products of codes come tile by tile
from one matrix product (exact: whole numbers below 2**24 at a time in single precision).  A
pair whose upper bound is below the k-th best lower bound, or below what the query's heap
holds already, is dropped; the others are multiplied in double precision, component by
component from the first on, and go into the query's heap of k.

Blocks follow in waves, each eight times as long as the one before.  After a wave the
heaps of all blocks are merged to the k best of each query, and the next wave's
tasks start with the k-th as their floor.  So a task hands on what can still be
among the best: over all waves some ``8 k`` rows a query and wave, however many blocks there
are.  The bounds hold for every pair, so nothing is missed: recall is 1.

Equal vectors of a block are one column of its tiles, with all their ids.

Defined results: rows whose id is null, or whose vector is null, empty, zero or holds null
or non-finite components take no part; a query meets vectors of its own length; a query's own
row is every row with its id; of repeated rows each counts.  A product that is no number (both
infinities met) counts as minus infinity.  Other columns are dropped; without queries or
candidates the result is empty.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, tidy_group

EXACT = 1024  # so many products of two codes add up below 2**24


class Codes:
    """Vectors as int8 codes with a scale, and what bounds the error of their products."""

    def __init__(self, x: np.ndarray):
        scale = np.abs(x).max(1, initial=0) / 127
        self.codes = np.rint(np.divide(x, scale[:, None], out=np.zeros_like(x), where=scale[:, None] > 0)).astype(np.int8)
        coded = self.codes * scale[:, None]
        self.scale, self.error, self.coded, self.norm = scale, np.linalg.norm(x - coded, axis=1), np.linalg.norm(coded, axis=1), np.linalg.norm(x, axis=1)

    def bounds(self, other: Codes, mine: slice, its: slice) -> tuple[np.ndarray, np.ndarray]:
        """(the products by the codes, how far off they may be) of every pair of rows."""
        a, b = self.codes[mine], other.codes[its]
        product = np.zeros((len(a), len(b)))
        for lo in range(0, a.shape[1], EXACT):
            product += a[:, lo : lo + EXACT].astype(np.float32) @ b[:, lo : lo + EXACT].astype(np.float32).T
        product *= self.scale[mine, None]
        product *= other.scale[its]
        # a little more, for the rounding of all these and of the product itself
        off = np.outer(self.error[mine], other.coded[its]) + np.outer(self.norm[mine], other.error[its] + other.norm[its] * 1e-12)
        return product, off


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of rows, summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return np.where(np.isnan(total), -np.inf, total)


class Heaps:
    """The k best (score, then smaller id) of each query."""

    def __init__(self, own: np.ndarray, floor: np.ndarray, k: int):
        self.own, self.k, self.floor = own, k, floor.copy()
        self.held: list[list[tuple[float, int]]] = [[] for _ in own]

    def add(self, query: int, score: float, ids: np.ndarray) -> None:
        """``ids``: in order, of one vector."""
        first, last = np.searchsorted(ids, [self.own[query], self.own[query] + 1])
        held = self.held[query]
        for i in (*ids[: min(first, self.k)].tolist(), *ids[last : last + max(0, self.k - first)].tolist()):
            if len(held) < self.k:
                heapq.heappush(held, (score, -i))
            elif held[0] < (score, -i):
                heapq.heapreplace(held, (score, -i))
            else:
                break
        if len(held) == self.k:
            self.floor[query] = max(self.floor[query], held[0][0])


def join_blocks(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, tile: tuple[int, int] = (512, 2048), at_once: int = 1 << 17) -> Heaps:
    """The k best rows of each query that reach its floor."""
    heaps = Heaps(own, floor, k)
    points, of = np.unique(rows, axis=0, return_inverse=True)
    order = np.lexsort((ids, of))
    ids, starts = ids[order], np.searchsorted(of[order], np.arange(len(points) + 1))
    asked, known = Codes(queries), Codes(points)
    # of the columns with the best lower bounds, so many may have no row but the query's own
    selves = np.bincount(np.searchsorted(np.sort(own), ids[np.isin(ids, own)]), minlength=len(own))[np.searchsorted(np.sort(own), own)]
    for q in range(0, len(queries), tile[0]):
        part = slice(q, min(q + tile[0], len(queries)))
        best = np.zeros((part.stop - q, 0))  # lower bounds so far
        keep = k + int(selves[part].max(initial=0))
        for p in range(0, len(points), tile[1]):
            columns = slice(p, p + tile[1])
            near, off = asked.bounds(known, part, columns)
            low = np.concatenate([best, near - off], axis=1)
            if low.shape[1] > keep:
                low = np.partition(low, low.shape[1] - keep, axis=1)[:, low.shape[1] - keep :]
            best = np.where(np.isnan(low), -np.inf, low)
            if best.shape[1] == keep:
                heaps.floor[part] = np.fmax(heaps.floor[part], best.min(1))
            near += off
            i, j = np.nonzero(~(near < heaps.floor[part, None]))
            for lo in range(0, len(i), at_once):
                a, b = i[lo : lo + at_once] + q, j[lo : lo + at_once] + p
                score = products(queries[a], points[b])
                reach = np.flatnonzero(score >= heaps.floor[a])
                reach = reach[np.lexsort((-score[reach], a[reach]))]
                for query, column, s in zip(a[reach].tolist(), b[reach].tolist(), score[reach].tolist(), strict=True):
                    if s >= heaps.floor[query]:
                        heaps.add(query, s, ids[starts[column] : starts[column + 1]])
    return heaps


def usable(vector: Column) -> Column:
    """Neither empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, block_values: int = 1 << 20, query_values: int = 1 << 21, least_block: int = 2048, growth: int = 8,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): the k rows of largest inner product of every row for which ``is_query`` holds.

    ``block_values``, ``query_values``: most components of a block of rows and of a piece of queries.
    """
    work = Workspace(vectors.sparkSession)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col).cast("array<double>")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("vector")).alias("length")).first()
    length = size["length"] or 1
    blocks = max(1, min(64, -(-size["n"] // least_block)), -(-size["n"] * length // block_values))
    least_pieces = max(1, -(-size["q"] * length // query_values))
    deal = lambda n, *salt: F.pmod(F.xxhash64("id", *salt), F.lit(n)).cast("int")

    def answer(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        ids = table["id"].to_numpy()
        x = np.asarray(table["vector"].combine_chunks().flatten(), float).reshape(len(ids), -1)
        out = [[], [], []]
        if asks.any() and not asks.all():
            floor = table["floor"].to_numpy()[asks]
            with np.errstate(over="ignore", invalid="ignore", under="ignore"):
                heaps = join_blocks(x[asks], ids[asks], floor, x[~asks], ids[~asks], k)
            for query, held, least in zip(ids[asks].tolist(), heaps.held, floor.tolist(), strict=True):
                good = [(s, -i) for s, i in held if s >= least]
                out[0] += [query] * len(good)
                out[1] += [i for _, i in good]
                out[2] += [s for s, _ in good]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "id", "score"])

    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best, first = None, 0
    while first < blocks:
        last = min(blocks, first * growth + 1)
        pieces = max(least_pieces, min(-(-size["q"] // 256), 64 // (last - first)), 1)
        some = rows.withColumn("b", deal(blocks)).where(F.col("b").between(first, last - 1)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).withColumn("asks", F.lit(False)).withColumn("floor", F.lit(float("-inf")))
        asked = rows.where("asks").withColumn("p", deal(pieces, F.lit(1))).withColumn("b", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        if best is None:
            asked = asked.withColumn("floor", F.lit(float("-inf")))
        else:
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
            asked = asked.join(kth, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        columns = [F.size("vector").alias("length"), "b", "p", "asks", "id", "floor", "vector"]
        found = some.select(columns).union(asked.select(columns)).groupBy("length", "b", "p").applyInArrow(tidy_group(answer), "query_id bigint, id bigint, score double")
        both = found if best is None else found.union(best.drop("rank"))
        best = work.saved(both.withColumn("rank", ranked).where(F.col("rank") <= k))
        first = last
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
