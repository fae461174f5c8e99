"""Near-duplicate embeddings with inverted lists and product quantisation.

Equal vectors are first made one.  A bounded sample (the smallest hashes) trains,
for each length of vectors, the coarse centroids and, on the residuals, one codebook
for each subspace.  Every vector is indexed: in the list of its nearest
centroid, with the codes of its residual and the length of what the codes miss.
Every vector is also a query to up to ``probes`` lists that can hold a vector within
the linking distance, those nearest beyond the planes between lists first.  There a table of
distances from the query's residual to all code words gives each entry's
asymmetric distance by lookups.  An entry is passed on if that distance is at
most the linking distance plus the length that its codes miss: by the triangle
inequality this loses no pair inside the probed lists.  What passes is compared
exactly, by cosine in double precision.

Lists longer than ``block`` are cut into blocks, of entries and of queries, so
no task ever holds a whole list.  Blocks return counts of links and a spanning
forest of them, never all pairs.  A link that only one of its two ends probes
for is counted for the other end there too.

Defined results: vectors link with vectors of their own length only; those that are
null, zero, or hold null or non-finite components link with nothing and are
their own component; so are rows with a null id, whose component is null.
Repeated rows are copies that link with each other.  Columns other than id and
vector are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, components, forest, tidy, tidy_group


class Quantiser(NamedTuple):
    centroids: np.ndarray  # lists x dims
    books: np.ndarray  # subspaces x words x dims of a subspace


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def slices(rows: int, width: int, cells: int = 2_000_000) -> Iterator[slice]:
    """Parts of so many rows that a table of ``width`` columns stays under about ``cells`` numbers."""
    step = max(1, cells // max(width, 1))
    yield from (slice(lo, lo + step) for lo in range(0, rows, step))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[s], centroids).argmin(1) for s in slices(len(x), len(centroids))])


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    centroids = x[np.random.default_rng(seed).permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def coarse(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centroids of the lists; of many lists in two levels, so the work grows with rows x sqrt(lists)."""
    if lists <= 1024:
        return k_means(sample, lists, 8, seed)
    top = nearest(sample, k_means(sample, round(lists**0.5), 8, seed))
    parts = [sample[top == c] for c in np.unique(top)]
    return np.concatenate([k_means(p, max(1, round(lists * len(p) / len(sample))), 8, seed + n) for n, p in enumerate(parts)])


def fit(sample: np.ndarray, rows: int, subspaces: int, words: int, list_rows: int, max_lists: int, seed: int) -> Quantiser:
    """``rows``: how many vectors will be indexed; the number of lists follows it, up to ``max_lists`` and an eighth of the sample."""
    centroids = coarse(sample, max(1, min(max_lists, rows // list_rows, len(sample) // 8)), seed)
    rest = sample - centroids[nearest(sample, centroids)]
    width = -(-sample.shape[1] // subspaces)
    rest = np.pad(rest, ((0, 0), (0, width * subspaces - sample.shape[1])))
    books = [k_means(rest[:, s * width : (s + 1) * width], words, 6, seed + s) for s in range(subspaces)]
    size = min(map(len, books))
    return Quantiser(centroids, np.stack([b[:size] for b in books]))


def plain(dims: int, subspaces: int) -> Quantiser:
    """One list and one code word, for a length that the sample does not have: all its rows are compared exactly."""
    return Quantiser(np.zeros((1, dims)), np.zeros((subspaces, 1, -(-dims // subspaces))))


def probed(x: np.ndarray, q: Quantiser, reach: float, probes: int) -> list[np.ndarray]:
    """The lists of each vector, its own first: up to ``probes`` that can hold a vector within ``reach``, most likely first.

    What is in another list is on the far side of the plane halfway between the two centroids, so that plane must be within reach."""
    out = []
    for s in slices(len(x), len(q.centroids)):
        far = squared(x[s], q.centroids)
        home = far.argmin(1)
        homes, of = np.unique(home, return_inverse=True)  # no more rows than the slice, so never lists x lists
        between = np.sqrt(squared(q.centroids[homes], q.centroids))[of]
        plane = (far - far[np.arange(len(far)), home][:, None]) / np.maximum(2 * between, 1e-300)
        plane[np.arange(len(far)), home] = -1
        order = np.argsort(plane, 1, kind="stable")[:, :probes]
        near = np.take_along_axis(plane, order, 1) <= reach + 1e-9
        out += [o[n].astype("i4") for o, n in zip(order, near, strict=True)]
    return out


def residuals(x: np.ndarray, lists: np.ndarray, q: Quantiser) -> np.ndarray:
    return np.pad(x - q.centroids[lists], ((0, 0), (0, q.books.shape[0] * q.books.shape[2] - x.shape[1]))).reshape(len(x), q.books.shape[0], q.books.shape[2])


def codes_of(rest: np.ndarray, q: Quantiser) -> tuple[np.ndarray, np.ndarray]:
    """Code words of residuals, and the length of what they miss."""
    codes = np.stack([squared(rest[:, s], q.books[s]).argmin(1) for s in range(len(q.books))], 1)
    missed = rest - q.books[np.arange(len(q.books)), codes]
    return codes.astype(np.uint8), np.sqrt((missed * missed).sum((1, 2)))


def finite(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def link(
    vectors: DataFrame,
    threshold: float = 0.95,
    probes: int = 32,
    subspaces: int = 16,
    words: int = 64,
    list_rows: int = 128,
    max_lists: int = 16_384,
    sample_rows: int = 16_384,
    most_sample_rows: int = 131_072,
    most_sample_values: int = 1 << 23,
    block: int = 4096,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id) of every vector.

    The sample has ``sample_rows`` vectors, or an eighth of all up to ``most_sample_rows``, and never more than
    ``most_sample_values`` components of the longest vectors.
    """
    spark = vectors.sparkSession
    work = Workspace(spark)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    usable = F.col("id").isNotNull() & finite(F.col("vector"))
    good = rows.where(usable)
    classes = work.saved(good.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    have = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("length")).first()
    wanted = min(max(sample_rows, min(most_sample_rows, have["n"] // 8)), max(1, most_sample_values // (have["length"] or 1)))
    sample = classes.select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(wanted).toPandas()["vector"]
    lengths = sample.map(len)
    sizes = classes.where(F.size("vector").isin(lengths.unique().tolist())).groupBy(F.size("vector").alias("length")).count().collect()
    quantisers = {n: tuple(fit(unit(np.stack(sample[lengths == n].to_numpy())), count, subspaces, words, list_rows, max_lists, seed)) for n, count in sizes}
    found = _found(classes, quantisers, threshold, probes, subspaces, block, np.float32 if single else np.float64, work)
    links = found.where("root is null").groupBy("rep").agg(F.sum("n").alias("others"))
    joined = components(found.where("root is not null").select(F.col("rep").alias("src"), F.col("root").alias("dst")), work)
    known = classes.join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = good.join(known, "vector").select("id", "n_links", "component_id")
    bad = rows.where(~usable).select("id", F.lit(0).cast("long"), F.col("id"))
    return good.union(bad).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id")


def _found(classes: DataFrame, quantisers: dict[int, tuple], threshold: float, probes: int, subspaces: int, block: int, kind: type, work: Workspace) -> DataFrame:
    """(rep, n, root): numbers of linked rows where root is null, else forest edges."""
    shipped = classes.sparkSession.sparkContext.broadcast(quantisers)  # bounded by max_lists and the sample
    reach = (2 - 2 * threshold) ** 0.5

    def quantiser(dims: int) -> Quantiser:
        return Quantiser(*shipped.value[dims]) if dims in shipped.value else plain(dims, subspaces)

    def assign(batches):
        blob = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                q, part = quantiser(dims), batch.filter(pa.array(lengths == dims))
                raw = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                x = unit(raw)
                near = probed(x, q, reach, probes)
                codes, missed = codes_of(residuals(x, np.array([n[0] for n in near]), q), q)
                columns = [part.column(0), part.column(2), pa.array([dims] * len(x), pa.int32()), pa.array(near, pa.list_(pa.int32())), blob(raw.astype(kind)), blob(codes), pa.array(missed, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "copies", "length", "near", "x", "codes", "missed"])

    schema = "rep bigint, copies bigint, length int, near array<int>, x binary, codes binary, missed double"
    indexed = work.saved(classes.select("rep", "vector", "copies").mapInArrow(tidy(assign), schema))
    entries = indexed.withColumn("list", F.col("near")[0])
    asked = indexed.withColumn("list", F.explode("near"))
    # at most max_lists rows a length
    count = lambda df, name: df.groupBy("length", "list").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    size = count(entries, "e_blocks").join(count(asked, "q_blocks"), ["length", "list"])
    spread = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["length", "list", "e", "q", "role", "rep", "copies", "near", "x", "codes", "missed"]
    entries = entries.join(size, ["length", "list"]).withColumn("e", spread("e_blocks")).withColumn("q", every("q_blocks")).withColumn("role", F.lit(0)).select(columns)
    asked = asked.join(size, ["length", "list"]).withColumn("q", spread("q_blocks")).withColumn("e", every("e_blocks"))
    asked = asked.withColumns({"role": F.lit(1), "codes": F.lit(None).cast("binary"), "missed": F.lit(None).cast("double")}).select(columns)

    def compare(table: pa.Table) -> pa.Table:
        dims, at = table["length"][0].as_py(), table["list"][0].as_py()
        q = quantiser(dims)
        role = table["role"].to_numpy()
        e, a = (table.filter(pa.array(role == r)) for r in (0, 1))
        empty = pa.table({"rep": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not e.num_rows or not a.num_rows:
            return empty
        matrix = lambda column, kind, width: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
        ids, ids_e = a["rep"].to_numpy(), e["rep"].to_numpy()
        x, y = unit(matrix(a["x"], kind, dims)), unit(matrix(e["x"], kind, dims))
        codes = matrix(e["codes"], np.uint8, len(q.books))
        copies, copies_e = a["copies"].to_numpy(), e["copies"].to_numpy()
        limit = (reach + e["missed"].to_numpy() + 1e-9) ** 2
        home = np.array([n[0] for n in a["near"].to_pylist()])
        lists = np.full((len(ids_e), probes), -1)
        for row, near in enumerate(e["near"].to_pylist()):
            lists[row, : len(near)] = near
        nodes, place = np.unique(np.concatenate([ids, ids_e]), return_inverse=True)
        label = np.arange(len(nodes))
        links, links_e = np.zeros(len(ids), np.int64), np.zeros(len(ids_e), np.int64)
        for s in slices(len(ids), len(ids_e), 1_000_000):
            rest = residuals(x[s], np.full(len(x[s]), at), q)
            far = np.zeros((len(rest), len(codes)))
            for k in range(len(q.books)):
                far += squared(rest[:, k], q.books[k])[:, codes[:, k]]
            i, j = np.nonzero(far <= limit)
            i += s.start
            near = ids[i] != ids_e[j]
            i, j = i[near], j[near]
            # exactly, some pairs at once
            good = np.concatenate([np.einsum("ij,ij->i", x[i[p]], y[j[p]]) >= threshold for p in slices(len(i), dims)] or [np.zeros(0, bool)])
            i, j = i[good], j[good]
            links += np.bincount(i, copies_e[j], len(ids)).astype(np.int64)
            # the entry would not find this query by itself
            alone = np.concatenate([(lists[j[p]] != home[i[p], None]).all(1) for p in slices(len(i), probes)] or [np.zeros(0, bool)])
            links_e += np.bincount(j[alone], copies[i[alone]], len(ids_e)).astype(np.int64)
            forest(place[i], place[len(ids) + j], label)
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        rep = np.concatenate([ids[links > 0], ids_e[links_e > 0], nodes[moved]])
        n = np.concatenate([links[links > 0], links_e[links_e > 0], np.zeros(len(moved), np.int64)])
        root = pa.array([None] * (len(rep) - len(moved)) + nodes[label[moved]].tolist(), pa.int64())
        return pa.table({"rep": pa.array(rep, pa.int64()), "n": pa.array(n, pa.int64()), "root": root})

    return work.saved(entries.union(asked).groupBy("length", "list", "e", "q").applyInArrow(tidy_group(compare), "rep bigint, n bigint, root bigint"))
