"""A log directory addressed by (partition, offset), written in whole runs and read without a scan for its bounds.

Files lie by writer, arrival hour and partition.  A commit names, for each hour and
partition of a run, the offsets it holds, so the log's ranges are known from the
commits alone, a run counts once however often it is tried, and hours that have passed
the retention go as whole folders while the offsets go on.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RECORD
from .commits import Commits, State

#: A file's columns: the offset comes before nested ones, since statistics are found by place.
STORED = T.StructType([*(RECORD[n] for n in ("offset", "ts", "key", "value", "headers")), T.StructField("hour", T.StringType()), RECORD["partition"]])
Ranges = list[tuple[int, int, int]]


def appended(records: DataFrame, ends: DataFrame | None, order: list[str], partitions: int, span: int = 1 << 20) -> DataFrame:
    """Adds partition (by key) and offset: each partition goes on at its ``end_offset`` in ``ends``, in the order of the two columns ``order``.

    Rows are numbered in chunks of ``span`` of the second column, and chunks by a running sum over their counts, so no task has a whole partition.
    """
    out = records.withColumns({"partition": F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"), "_chunk": F.struct(order[0], F.floor(F.col(order[1]) / span).alias("n"))})
    counts = out.groupBy("partition", "_chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("partition").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("partition", "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    if ends is not None:  # as many rows as partitions
        bases = bases.join(F.broadcast(ends.select("partition", "end_offset")), "partition", "left").withColumn("_base", F.col("_base") + F.coalesce("end_offset", F.lit(0))).drop("end_offset")
    place = F.row_number().over(Window.partitionBy("partition", "_chunk").orderBy(*order))
    return out.withColumn("_place", place).join(bases, ["partition", "_chunk"]).withColumn("offset", F.col("_base") + F.col("_place") - 1).drop("_base", "_place", "_chunk")


def footer_ranges(spark: SparkSession, path: str, schema: T.StructType = STORED, by: tuple[str, ...] = ("hour", "partition"), offset: str = "offset") -> DataFrame:
    """(by, first, next, rows) of parquet files in folders named by the columns ``by``: from the files' statistics, no row is read."""
    session = spark.newSession()  # the settings stay there
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    files = session.read.schema(schema).parquet(path)
    return files.groupBy(*by).agg(F.min(offset).alias("first"), F.max(offset).alias("last"), F.count("*").alias("rows")).select(*by, "first", (F.col("last") + 1).alias("next"), "rows")


def in_range(partition: int, start: int, end: int):
    return (F.col("partition") == partition) & (F.col("offset") >= start) & (F.col("offset") < end)


class Log:
    """The log at ``path``; ``partitions`` is needed by its first writer only."""

    def __init__(self, spark: SparkSession, path: str, partitions: int | None = None):
        self.spark, self.path, self.commits = spark, path.rstrip("/"), Commits(spark, path)
        self.asked = partitions

    def ranges(self, state: State | None = None) -> Ranges:
        """(partition, start, end) of every partition, empty ones too, from the commits; an error where there is no log."""
        state = state or self.commits.state()
        if not state.marks:
            raise ValueError(f"{self.path}: the log has no partitions")
        return log_ranges(state)

    def append(self, records: DataFrame, run_id: str, order: list[str], info: dict | None = None) -> int:
        """Appends records (key, value, headers, ts and the columns ``order``) as one run; returns its number of rows.

        A run that is in the log already is not written again.  Another writer's commit in between raises
        ``Conflict``, and nothing of this run is seen.
        """
        state = self.commits.state()
        if run_id in state.runs:
            return state.runs[run_id]["rows"]
        partitions = len(state.marks) or self.asked
        if not partitions:
            raise ValueError("a new log needs its number of partitions")
        ends = self.spark.createDataFrame([(int(p), end) for p, end in state.marks.items()], "partition int, end_offset bigint") if state.marks else None
        placed = appended(records, ends, order, partitions).withColumn("hour", F.date_format("ts", "yyyyMMddHH"))
        attempt = self.commits.attempt()
        out = placed.select(*(f.name for f in STORED)).repartitionByRange("hour", "partition", "offset").sortWithinPartitions("hour", "partition", "offset")
        out.write.partitionBy("hour", "partition").parquet(f"{self.path}/{attempt}")
        found = [] if records.isEmpty() else footer_ranges(self.spark, f"{self.path}/{attempt}").collect()  # a row for each hour and partition
        entries = [{"path": f"{attempt}/hour={r['hour']}/partition={r['partition']}", "hour": r["hour"], "partition": r["partition"], "first": r["first"], "next": r["next"], "rows": r["rows"]} for r in found]
        marks = {str(p): 0 for p in range(partitions)} | state.marks
        for e in entries:
            marks[str(e["partition"])] = max(marks[str(e["partition"])], e["next"])
        rows = sum(e["rows"] for e in entries)
        self.commits.commit(state, run_id, entries, info=(info or {}) | {"rows": rows}, marks=marks)
        return rows

    def read(self, ranges: Ranges | None = None) -> DataFrame:
        """The committed records, or those in ``ranges``; only the folders that reach into them are listed and only their row groups read."""
        state = self.commits.state()
        wanted = {p: (start, end) for p, start, end in ranges} if ranges is not None else None
        paths = [e["path"] for e in state.entries.values() if wanted is None or (e["partition"] in wanted and e["first"] < wanted[e["partition"]][1] and e["next"] > wanted[e["partition"]][0])]
        if not paths:
            return self.spark.createDataFrame([], RECORD)
        out = self.spark.read.schema(STORED).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/{p}" for p in sorted(paths))).select(*RECORD.names)
        if wanted is not None:
            keep = F.lit(False)
            for p, start, end in ranges:
                keep = keep | in_range(p, start, end)
            out = out.where(keep)
        return out

    def runs(self) -> DataFrame:
        """(run_id, info): the runs of the log, with what their writers told."""
        rows = [(k, {a: str(b) for a, b in v.items()}) for k, v in self.commits.state().runs.items()]
        return self.spark.createDataFrame(rows, "run_id string, info map<string,string>")

    def expire(self, now: dt.datetime, hours: int) -> int:
        """Drops the folders of all arrival hours that ended ``hours`` or more before ``now`` (UTC); returns how many. End offsets stay."""
        state = self.commits.state()
        limit = now - dt.timedelta(hours=hours)
        old = [p for p, e in state.entries.items() if e["hour"] != "__HIVE_DEFAULT_PARTITION__" and dt.datetime.strptime(e["hour"], "%Y%m%d%H") + dt.timedelta(hours=1) <= limit]
        if old:
            self.commits.commit(state, None, drop=old)
            self.commits.delete(old)  # after the commit, so none is named that is not there
        return len(old)


def log_ranges(state: State) -> Ranges:
    starts: dict[int, int] = {}
    for e in state.entries.values():
        starts[e["partition"]] = min(e["first"], starts.get(e["partition"], e["first"]))
    return [(int(p), starts.get(int(p), end), end) for p, end in sorted(state.marks.items(), key=lambda m: int(m[0]))]
