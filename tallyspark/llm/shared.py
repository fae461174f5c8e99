"""Tables in the folder that all of a cluster's machines share, and connected components on them."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_bytes(texts: Iterable[bytes], most: int) -> Iterator[list[bytes]]:
    """Runs of texts that end once they have ``most`` bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def release() -> None:
    """Gives memory that this process has freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def release_executors(spark: SparkSession) -> None:
    """Has the JVMs of the executors give back memory that they have freed: a heap that one job has stretched stays so for all that follow.

    One short task a core, so that on idle executors each has one."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def release_shuffles(spark: SparkSession) -> None:
    """Deletes the shuffle files of jobs that have ended: Spark does so once the driver's JVM has collected their plans, which it may put off for long."""
    gc.collect()
    spark._jvm.System.gc()


def tidy(run: Callable) -> Callable:
    """A task function over batches that keeps no freed memory: workers live on for tasks of other kinds."""

    def wrapped(batches):
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_group(run: Callable) -> Callable:
    """The same for a function of a group's table or tables."""

    def of_table(table):
        try:
            return run(table)
        finally:
            release()

    def of_two(key, left, right):
        try:
            return run(key, left, right)
        finally:
            release()

    return of_table if run.__code__.co_argcount == 1 else of_two


class Workspace:
    """A folder of intermediate tables under ``spark.checkpoint.dir``; writing one cuts the lineage for good."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:  # a session without a cluster, as in tests
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            root = f"file://{tempfile.gettempdir()}/tallyspark-{spark.sparkContext.applicationId}"
        self.root = f"{root}/{uuid.uuid4().hex}"
        self.count = 0
        # results are read after the operator has returned, so its tables stay until the application ends
        path, system = self._path(self.root)
        system.deleteOnExit(path)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def saved(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        release()  # what planning and training left in the driver
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.saved_at = path
        return kept

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing will read again."""
        path, system = self._path(df.saved_at)
        system.delete(path, True)

    def close(self) -> None:
        """Deletes all tables at once, for callers that have read their results."""
        path, system = self._path(self.root)
        system.delete(path, True)


def forest(u: np.ndarray, v: np.ndarray, label: np.ndarray) -> None:
    """Joins the labels of edges' ends, in place; a label is the smallest place in its component."""
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _stars(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars around the smallest nodes, about ``most`` edges at a time."""
    held, size = [], 0

    def out():
        u, v = (np.concatenate(c) for c in zip(*held, strict=True))
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = np.arange(len(nodes))
        forest(place[: len(u)], place[len(u) :], label)
        moved = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= most:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def components(edges: DataFrame, work: Workspace, task_edges: int = 1 << 20) -> DataFrame:
    """(node, component) of every node of ``edges`` (src, dst): the smallest node it is connected with.

    Each partition first makes stars of its own edges, so at most one edge a node and
    partition is left.  Up to ``task_edges`` of these (some 16 MB) are joined by one
    task.  More go through large-star and small-star rounds: each shortens all paths,
    keeps the components, and ends in one star around each smallest node.  A node's
    minimum is aggregated before the shuffle and joined back, so a hub is a skewed
    join that Spark splits, not a group in one task.
    """
    both = edges.where("src != dst and src is not null and dst is not null")
    stars = lambda df: df.mapInArrow(tidy(_stars), "u bigint, v bigint")
    whole = lambda df: df.select(F.col("u").alias("node"), F.col("v").alias("component")).union(df.select("v", "v").distinct())
    now = work.saved(stars(both.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))))
    if now.count() <= task_edges:
        return whole(work.saved(stars(now.repartition(1))))
    mark = None
    while True:
        stats = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == tuple(stats):
            return whole(now)
        mark = tuple(stats)
        sides = now.union(now.select("v", "u"))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = work.saved(small.union(least.select("u", "m")).distinct())
        work.drop(now)
        now = after
