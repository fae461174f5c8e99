"""Documents linked by the Jaccard similarity of their word n-gram sets.

The join is a blocked sparse matrix product of the document by n-gram incidence
with its transpose, on as few columns as can hold a link:

* Equal sets are one row of the matrix (128-bit digests; for a set of a few
  shingles half of it is of the very words).
* N-grams have one global order, rare ones first.  A row of size n that is
  linked with another shares an n-gram among its first n - ceil(t n) + 1, so
  only these columns enter.  Which n-grams are frequent is counted
  in stretches of all documents; the order decides only how much work there is, never the result.
* The incidence is dealt into blocks of columns (by hash), packed as arrays.  A
  block drops the columns with one row.  Columns known to be frequent are not
  collected in blocks but stay rows that Spark can split.
* First each column's rows are multiplied with one leading row only, in a few
  turns.  Verified links join components, which collapses large groups in linear
  work.
  Overlap counts are accumulated over the columns, and a pair is discarded when
  its count plus all that can be outside the columns is below what its sizes require.
* Then come all products between rows of different components, but for those whose
  places in their rows leave too little room for that overlap.
* Rows folded to one bit a hash, the parity of what falls on it, differ in no more
  places than the sets do.  That bounds a pair's overlap from above, by a fiftieth of
  the bytes; only pairs within the bound are verified, on the whole sets and by
  other hashes than those that found them.

A pair in one component needs no product, so no link between components is lost.

Defined results: null texts and texts without words have an empty set and link
with nothing; rows with a null id are never linked and get a null component;
rows with the same id are one document, linked by whatever links either; all
rows are returned, repeated ones too; columns other than id and text are dropped
and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, components, tidy
from .shingles import Shingler, digest, mixed

ENTRY = "gram bigint, node bigint, n int, place int"


def at_least(n: np.ndarray, up: int, down: int) -> np.ndarray:
    """ceil(n * up / down) in whole numbers."""
    return -(-n * up // down)


def join(
    docs: DataFrame,
    k: int = 5,
    similarity: tuple[int, int] = (75, 100),
    frequent_rows: int = 1 << 18,
    entries_per_block: int = 500_000,
    broadcast_ids: int = 1_000_000,
    lanes: tuple[int, ...] = (1, 4, 16),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id) of every row; ``similarity`` is a fraction.

    ``lanes``: for each led turn, among how many leaders a group's columns are shared out.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    up, down = similarity
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = work.saved(source.mapInArrow(tidy(_counter(k)), "id bigint, n int, node bigint, d2 bigint, folded binary, gram bigint, times bigint"))
    sizes = counted.where("gram is null").select("id", "n", "node", "d2")
    real = sizes.where("id is not null and n > 0")
    folded = counted.where("gram is null").select("id", "n", "folded")
    # equal sets: one class, named by its smallest id; a node is a set's first digest
    classes = work.saved(real.groupBy("node", "n", "d2").agg(F.min("id").alias("rep")))
    member = real.join(classes, ["node", "n", "d2"]).select("id", "rep")

    frequent = _frequent(counted.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")), frequent_rows)
    total = real.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, int(total * (down - up) / down) // entries_per_block, spark.sparkContext.defaultParallelism)
    order = spark.sparkContext.broadcast(frequent)  # at most frequent_rows
    packed = source.where("id is not null").mapInArrow(tidy(_packer(k, up, down, blocks, order)), f"block int, {ENTRY}, packed binary")
    held = work.saved(packed.repartition(blocks, "block").mapInArrow(tidy(_unpack), ENTRY))

    links = work.saved(member.groupBy("id").agg(F.min("rep").alias("src"), F.max("rep").alias("dst")).where("src != dst").select("src", "dst"))
    sets: list[DataFrame] = []
    for turn in range(len(lanes) + 1):
        stars = work.saved(components(links, work))
        label = stars.withColumnRenamed("node", "rep")
        nodes = work.saved(classes.join(label, "rep", "left").select("node", "n", "rep", F.coalesce("component", "rep").alias("component")))
        if turn:
            before, held = held, _still_open(held, nodes, work)
            work.drop(before)
        pairs = work.saved(_led(held, nodes, turn, lanes[turn], up, down) if turn < len(lanes) else _crossed(held, nodes, up, down))
        # the components so far stand for all links so far
        links = work.saved(stars.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(_verified(_bounded(pairs, folded, up, down, broadcast_ids, work), source, sets, k, up, down, broadcast_ids, work)))
    label = components(links, work).withColumnRenamed("node", "rep")
    known = real.join(classes, ["node", "n", "d2"]).join(label, "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    result = sizes.join(known, "id", "left")
    # an empty set of a document whose other rows are linked is still that document
    return result.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _counter(k: int, chunk: int = 2_000_000):
    """Sizes, digests and folded rows of all sets, and the n-grams met more than once in a stretch of about ``chunk``.

    An n-gram that no stretch holds twice is not counted: its place in the order is among the rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(k), [], 0
        names = ["id", "n", "node", "d2", "folded", "gram", "times"]

        def repeated():
            grams, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            grams, times = grams[times > 1].view(np.int64), times[times > 1]
            none = pa.nulls(len(grams), pa.int64())
            return pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), none, none, pa.nulls(len(grams), pa.binary()), pa.array(grams), pa.array(times, pa.int64())], names)

        for batch in batches:
            rows, bits = [], []
            seen = set()
            for text, s in shingler.with_texts(batch.column(1)):
                rows.append((len(s), *digest(text, s, k)))
                bits.append(_fold(s))
                if rows[-1] not in seen:  # copies are one row of the matrix
                    seen.add(rows[-1])
                    held.append(s)
                    size += len(s)
            n, d1, d2 = zip(*rows, strict=True) if rows else ([], [], [])
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bits, pa.binary()), none, none], names)
            if size >= chunk:
                yield repeated()
                held, size = [], 0
        yield repeated()

    return run


def _fold(hashes: np.ndarray) -> bytes:
    """The parity of the hashes on each of about as many places, a power of two, as there are hashes."""
    places = max(64, 1 << (len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(places - 1)).view(np.int64), minlength=places) & 1, bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """In how many places two folded rows differ; the longer is folded further."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _bounded(pairs: DataFrame, folded: DataFrame, up: int, down: int, broadcast_ids: int, work: Workspace) -> DataFrame:
    """The pairs whose folded rows allow the overlap that their sizes require."""
    ids = work.saved(pairs.select("id").union(pairs.select("other")).distinct())
    wanted = folded.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, "id", "left_semi")
    one = wanted.select("id", "n", F.col("folded").alias("x"))
    two = wanted.select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("folded").alias("y"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            apart = [_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            # two sets have as much in common as is left of both without what only one has, halved
            yield batch.select([0, 1, 2, 3]).filter(pa.array(both - np.array(apart, np.int64) >= 2 * at_least(both, up, up + down)))

    columns = pairs.join(one, ["id", "n"]).join(two, ["other", "m"]).select("id", "other", "n", "m", "x", "y")
    # a document with several rows of one size brings its pair more than once
    return work.saved(columns.mapInArrow(tidy(within), "id bigint, other bigint, n int, m int").distinct())


def _frequent(times: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, at most ``most``, and their counts; from a power of two on."""
    steps = times.where("times >= 16").groupBy(F.floor(F.log2("times")).alias("step")).agg(F.count("*").alias("grams")).orderBy(F.desc("step")).collect()
    left, least = most, None
    for r in steps:
        if r["grams"] > left:
            break
        left, least = left - r["grams"], r["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = times.where(F.col("times") >= 2**least).toPandas()
    grams = rows["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], rows["times"].to_numpy(np.int64)[order]


def _packer(k: int, up: int, down: int, blocks: int, order, chunk: int = 500_000):
    """The columns of each row that can hold a link: frequent ones as rows, the others packed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        grams, times = order.value
        names = ["gram", "node", "n", "place"]
        held, size = [], 0

        def out():
            node, sizes = np.array([d for d, *_ in held], np.int64), np.array([n for _, n, *_ in held], np.int32)
            gram, often = np.concatenate([g for *_, g, _ in held]), np.concatenate([t for *_, t in held])
            row = np.repeat(np.arange(len(held), dtype=np.int32), [len(g) for *_, g, _ in held])
            place = np.concatenate([np.arange(len(g), dtype=np.int32) for *_, g, _ in held])
            hot = np.flatnonzero(often)
            if len(hot):
                # spread by row as well, so that a frequent column is in many partitions
                spread = (mixed(gram[hot] ^ node[row[hot]].view(np.uint64)) % np.uint64(blocks)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(gram[hot].view(np.int64)), pa.array(node[row[hot]]), pa.array(sizes[row[hot]]), pa.array(place[hot]), pa.nulls(len(hot), pa.binary())], ["block", *names, "packed"])
            block = (gram % np.uint64(blocks)).astype(np.int32)
            cold = np.flatnonzero(often == 0)
            cold = cold[np.argsort(block[cold], kind="stable")]
            found, starts = np.unique(block[cold], return_index=True)
            blobs = []
            for lo, hi in zip(starts, [*starts[1:], len(cold)], strict=True):
                at = cold[lo:hi]
                used, runs = np.unique(row[at], return_counts=True)
                parts = [np.array([len(at), len(used)], np.int64), gram[at], node[used], sizes[used], runs.astype(np.int32), place[at]]
                blobs.append(b"".join(p.tobytes() for p in parts))
            none = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), none, none, none.cast(pa.int32()), none.cast(pa.int32()), pa.array(blobs, pa.binary())], ["block", *names, "packed"])

        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for text, s in shingler.with_texts(batch.column(1)):
                n = len(s)
                if not n or (mark := digest(text, s, k)) in seen:
                    continue
                seen.add(mark)
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                    often = np.where(grams[at] == s, times[at], 0)
                    rank = np.lexsort((s, often))
                    s, often = s[rank], often[rank]
                else:
                    often = np.zeros(n, np.int64)
                keep = n - int(at_least(np.int64(n), up, down)) + 1
                held.append((mark[0], n, s[:keep], often[:keep]))
                size += keep
                if size >= chunk:
                    yield from out()
                    held, size, seen = [], 0, set()
        if held:
            yield from out()

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's distinct (column, row): of blocks those columns that have more than one row, and the frequent ones."""
    names = ["gram", "node", "n", "place"]
    cold: list[list[np.ndarray]] = []
    hot: list[list[np.ndarray]] = []
    for batch in batches:
        packed = batch.column(5)
        plain = packed.is_null()
        hot.append([batch.column(i).filter(plain).to_numpy() for i in range(1, 5)])
        for blob in packed.drop_null():
            raw = blob.as_py()
            n, m = np.frombuffer(raw, np.int64, 2)
            at, parts = 16, []
            for count, kind in ((n, np.int64), (m, np.int64), (m, np.int32), (m, np.int32), (n, np.int32)):
                parts.append(np.frombuffer(raw, kind, count, at))
                at += parts[-1].nbytes
            gram, node, size, runs, place = parts
            cold.append([gram, np.repeat(node, runs), np.repeat(size, runs), place])
    for held, alone in ((hot, True), (cold, False)):
        if not held:
            continue
        gram, node, size, place = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        if not alone:  # few columns have a second row, so these go before the larger sort
            order = np.argsort(gram, kind="stable")
            same = gram[order][1:] == gram[order][:-1]
            order = order[np.append(same, False) | np.append(False, same)] if len(gram) else order
            gram, node, size, place = gram[order], node[order], size[order], place[order]
        order = np.lexsort((size, node, gram))
        gram, node, size, place = gram[order], node[order], size[order], place[order]
        new = np.append(True, (gram[1:] != gram[:-1]) | (node[1:] != node[:-1]) | (size[1:] != size[:-1])) if len(gram) else np.zeros(0, bool)
        gram, node, size, place = gram[new], node[new], size[new], place[new]
        if not alone and len(gram):
            same = gram[1:] == gram[:-1]
            twice = np.append(same, False) | np.append(False, same)
            gram, node, size, place = gram[twice], node[twice], size[twice], place[twice]
        for lo in range(0, len(gram), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in (gram, node, size, place)], names)


def _needed(n: str, m: str, up: int, down: int) -> Column:
    """The least overlap of sets of these sizes that are linked."""
    return F.ceil((F.col(n) + F.col(m)) * up / (up + down))


def _outside(n: str, m: str, up: int, down: int) -> Column:
    """The most overlap outside the columns: the row whose columns end first has all of it there."""
    return F.ceil(F.greatest(n, m) * up / down) - 1


def _still_open(held: DataFrame, nodes: DataFrame, work: Workspace) -> DataFrame:
    """The columns with rows of more than one component; the others have nothing to add, now or later."""
    labelled = held.join(nodes.select("node", "n", "component"), ["node", "n"])
    open_ = labelled.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    return work.saved(held.join(open_.select("gram"), "gram", "left_semi"))


def _led(held: DataFrame, nodes: DataFrame, turn: int, lanes: int, up: int, down: int) -> DataFrame:
    """Each row with the leading rows that it meets in enough columns; another turn has other leaders.

    A group of like rows has a leader for each lane, which has its share of the columns: so a
    row that is not linked with one leader meets others in the same turn.  What a lane counts is
    scaled up, with a margin, before it meets the bound.
    """
    share = 3 * lanes if lanes > 1 else 1
    mask = F.xxhash64(F.lit(turn), F.pmod("gram", F.lit(lanes)))
    leader = held.groupBy("gram").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("first")).select("gram", F.col("first").bitwiseXOR(mask).alias("other"))
    met = held.join(leader, "gram").where("node != other").groupBy("node", "n", "other").agg(F.count("*").alias("columns"))
    one = nodes.select("node", "n", F.col("rep").alias("id"), "component")
    two = nodes.select(F.col("node").alias("other"), F.col("n").alias("m"), F.col("rep").alias("other_id"), F.col("component").alias("other_component"))
    met = met.join(one, ["node", "n"]).join(two, "other").where("component != other_component")
    met = met.where(F.col("columns") * share + _outside("n", "m", up, down) >= _needed("n", "m", up, down)).where(F.least("n", "m") * down >= F.greatest("n", "m") * up)
    return met.select("id", F.col("other_id").alias("other"), "n", "m")


def _crossed(held: DataFrame, nodes: DataFrame, up: int, down: int) -> DataFrame:
    """All pairs of rows from different components whose overlap may suffice."""
    held = held.join(nodes.select("node", "n", F.col("rep").alias("id"), "component"), ["node", "n"]).select("gram", "id", "n", "place", "component")
    size = held.groupBy("gram", "component").agg(F.count("*").alias("rows"))
    largest = size.groupBy("gram").agg(F.max_by("component", F.struct("rows", "component")).alias("largest"))
    held = held.join(largest, "gram").withColumn("inner", F.col("component") == F.col("largest"))
    few = held.where("not inner").select("gram", "id", "n", "place", "component")
    other = held.select("gram", F.col("id").alias("other"), F.col("n").alias("m"), F.col("place").alias("other_place"), F.col("component").alias("other_component"), "inner")
    # a linked pair's first common column leaves room for all the overlap that it needs
    room = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("other_place")) >= _needed("n", "m", up, down)
    sizes = F.least("n", "m") * down >= F.greatest("n", "m") * up
    apart = F.col("component") != F.col("other_component")
    met = few.join(other, (few["gram"] == other["gram"]) & room & sizes & apart & (F.col("inner") | (F.col("id") < F.col("other"))))
    swap = F.col("id") > F.col("other")
    return met.select(*(F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("id", "other"), ("other", "id"), ("n", "m"), ("m", "n")))).distinct()


def _verified(pairs: DataFrame, source: DataFrame, sets: list[DataFrame], k: int, up: int, down: int, broadcast_ids: int, work: Workspace) -> DataFrame:
    """The pairs that are linked, by their documents' whole sets; sets that are new are added to ``sets`` for later turns."""
    ids = work.saved(pairs.select("id").union(pairs.select("other")).distinct())
    near = F.broadcast if ids.count() <= broadcast_ids else (lambda df: df)
    new = ids
    for known in sets:
        new = new.join(known.select("id").distinct(), "id", "left_anti")

    def whole(batches):
        shingler = Shingler(k, seed=1)  # other hashes than those that found the pair
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = list(shingler.sets(part.column(1)))
                ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out).view(np.int64)))], ["id", "grams"])

    sets.append(work.saved(source.join(near(work.saved(new)), "id", "left_semi").mapInArrow(tidy(whole), "id bigint, grams array<bigint>")))
    wanted = reduce(DataFrame.union, sets).join(near(ids), "id", "left_semi")
    # of a document with several rows, the row of the pair's size
    one, two = wanted.select("id", F.col("grams").alias("x")), wanted.select(F.col("id").alias("other"), F.col("grams").alias("y"))
    both = pairs.join(one, "id").where("size(x) = n").join(two, "other").where("size(y) = m")
    overlap = F.size(F.array_intersect("x", "y"))
    return both.where(overlap * down >= (F.col("n") + F.col("m") - overlap) * up).select(F.col("id").alias("src"), F.col("other").alias("dst")).distinct()
