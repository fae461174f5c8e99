"""Exact top-k search by integer inner product with dual-tree cover trees.

Vectors are made whole numbers, floor(scale * x).  The rows are dealt into
blocks, the stated queries too, and every block of queries meets every block of
rows.  In a task both get a cover tree: a node has a centre and the radius of
all it covers, its children's centres cover it at half that radius, and points
that are their own whole subtree are kept in the node as an array.  Pairs of
nodes are taken together.  No query q near centre a (radius r) has with a row x
near centre b (radius s) a product above ``a.b + |a| s + |b| r + r s``; a pair
is dropped if that is below the worst k-th score among the node's queries so
far.  Equal vectors are one point with its smallest ids.  The blocks' answers
are merged by a ranked window, which Spark cuts to k before it shuffles.

Defined results: rows whose id is null, or whose vector is null, empty or holds
null or non-finite components take no part; a query meets only vectors of its
own length; of repeated rows each counts as a candidate, and a query's own row
is every row with its id.  Scores beyond 64 bits are cut to the nearest such
number.  Columns other than id and vector are dropped; without queries or
candidates the result is empty.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Node(NamedTuple):
    centre: np.ndarray
    radius: float
    children: list
    points: np.ndarray  # those that no child covers
    covered: np.ndarray  # all below


def cover_tree(x: np.ndarray, leaf: int = 48) -> Node:
    """A cover tree over the rows of ``x``, built from the top with a list of open nodes."""

    def node(points: np.ndarray) -> Node:
        far = np.linalg.norm(x[points] - x[points[0]], axis=1)
        return Node(x[points[0]], float(far.max()) * (1 + 1e-9), [], points, points)

    root = node(np.arange(len(x)))
    opened = [(root, None, 0)]
    while opened:
        at, above, place = opened.pop()
        if len(at.points) <= leaf or at.radius == 0:
            continue
        rest, single, half = at.points, [], at.radius / 2
        while len(rest):
            near = np.linalg.norm(x[rest] - x[rest[0]], axis=1) <= half
            group = rest[near]
            rest = rest[~near]
            if len(group) == 1:
                single.append(group[0])
            else:
                at.children.append(node(group))
        points = np.array(single, np.int64)
        closed = at._replace(points=points)
        if above is None:
            root = closed
        else:
            above.children[place] = closed
        opened += [(c, closed, k) for k, c in enumerate(closed.children)]
    return root


class Best:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k = own, k
        self.scores = [np.zeros(0) for _ in own]
        self.ids = [np.zeros(0, np.int64) for _ in own]
        self.worst = np.full(len(own), -np.inf)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, of: np.ndarray) -> None:
        """``scores``: queries x points; ``ids`` belong to the points ``of``."""
        reach = scores >= self.worst[queries][:, None]
        for q, row, found in zip(queries, scores, reach, strict=True):
            if not found.any():
                continue
            good = found[of] & (ids != self.own[q])
            s, i = np.concatenate([self.scores[q], row[of[good]]]), np.concatenate([self.ids[q], ids[good]])
            order = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[order], i[order]
            if len(order) == self.k:
                self.worst[q] = self.scores[q][-1]


def dual_search(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """``queries``, ``rows``: float matrices of whole numbers; exact while products stay under 2**53."""
    best = Best(own, k)
    points, of = np.unique(rows, axis=0, return_inverse=True)
    order = np.lexsort((ids, of))
    ids, of = ids[order], of[order]
    # an own row may be among them, so one more id than k
    first = np.concatenate([[True], of[1:] != of[:-1]])
    rank = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
    ids, of = ids[rank <= k], of[rank <= k]
    starts = np.searchsorted(of, np.arange(len(points) + 1))

    def brute(q: np.ndarray, p: np.ndarray) -> None:
        for lo in range(0, len(q), 512):
            part = q[lo : lo + 512]
            take = np.concatenate([np.arange(starts[x], starts[x + 1]) for x in p])
            best.add(part, queries[part] @ points[p].T, ids[take], np.repeat(np.arange(len(p)), starts[p + 1] - starts[p]))

    def bound(a: Node, b: Node) -> float:
        return (a.centre @ b.centre + np.linalg.norm(a.centre) * b.radius + np.linalg.norm(b.centre) * a.radius + a.radius * b.radius) * (1 + 1e-12) + 1

    top, below = cover_tree(queries), cover_tree(points)
    pairs = [(bound(top, below), top, below)]
    while pairs:
        limit, a, b = pairs.pop()
        if limit < best.worst[a.covered].min():
            continue
        if not a.children and not b.children:
            brute(a.covered, b.points)
        elif b.children and (not a.children or b.radius >= a.radius):
            if len(b.points):
                brute(a.covered, b.points)
            pairs += sorted(((bound(a, c), a, c) for c in b.children), key=lambda t: t[0])
        else:
            if len(a.points):
                lone = Node(queries[a.points[0]], float(np.linalg.norm(queries[a.points] - queries[a.points[0]], axis=1).max()), [], a.points, a.points)
                pairs.append((bound(lone, b), lone, b))
            pairs += sorted(((bound(c, b), c, b) for c in a.children), key=lambda t: t[0])
    return best


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024, block: int = 16_384, query_block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of every row for which ``is_query`` holds."""
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col).cast("array<double>"))).withColumn("_query", F.coalesce(is_query, F.lit(False)))
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), "_query")
    size = rows.agg(F.count("*").alias("n"), F.count_if("_query").alias("q")).first()
    blocks = max(1, min(64, -(-size["n"] // 2048)), -(-size["n"] // block))
    query_blocks = max(1, -(-size["q"] // query_block))
    deal = lambda n, *salt: F.pmod(F.xxhash64("id", *salt), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.withColumn("role", F.lit(0)).withColumn("b", deal(blocks)).withColumn("q", every(query_blocks))
    asked = rows.where("_query").withColumn("role", F.lit(1)).withColumn("q", deal(query_blocks, F.lit(1))).withColumn("b", every(blocks))
    columns = [F.size("vector").alias("length"), "b", "q", "role", "id", "vector"]

    def answer(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        ids = table["id"].to_numpy()
        vector = table["vector"].combine_chunks()
        x = np.floor(scale * np.asarray(vector.flatten(), float).reshape(len(ids), -1))
        q, own, r, cand = x[role == 1], ids[role == 1], x[role == 0], ids[role == 0]
        out = [[], [], []]
        if len(q) and len(r):
            if np.abs(q).max() * np.abs(r).max() * x.shape[1] < 2.0**53:
                best = dual_search(q, own, r, cand, k)
                found = zip(own, best.ids, best.scores, strict=True)
            else:
                found = _whole(q, own, r, cand, k)
            for query, i, s in found:
                out[0] += [query] * len(i)
                out[1] += list(i)
                out[2] += [int(v) for v in s]
        return pa.table([pa.array(c, pa.int64()) for c in out], ["query_id", "id", "score"])

    answers = candidates.select(columns).union(asked.select(columns)).groupBy("length", "b", "q").applyInArrow(answer, "query_id bigint, id bigint, score bigint")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _whole(q, own, r, cand, k):
    """With Python's whole numbers, for components too large for doubles."""
    whole = [[int(v) for v in row] for row in r]
    for query, row in zip(own, q, strict=True):
        values = [int(v) for v in row]
        scores = [max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(values, other, strict=True)))) for other in whole]
        best = sorted((-s, i) for s, i in zip(scores, cand, strict=True) if i != query)[:k]
        yield query, [i for _, i in best], [-s for s, _ in best]
