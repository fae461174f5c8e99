"""The processed table: first delivery wins, unless the event was replayed; then the last replay does."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.commits import Commits, State


def folded(rows: DataFrame, key: str = "event_id", order: str = "seq", replayed: str = "replayed") -> DataFrame:
    """One row for each key, by a mergeable maximum: partly aggregated before the only shuffle, so hot keys are harmless."""
    rank = F.struct(F.col(replayed), F.when(F.col(replayed), F.col(order)).otherwise(-F.col(order)))
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("row")).select(key, "row.*").select(rows.columns)


class Table:
    """The table as day-partitioned base files and a delta for each batch, of which no key's row is written twice.

    A batch adds what changes the table: replays, and first deliveries of keys that it does not have.  So only
    replays can stand above an older row, and a reader takes the base without their keys, joined to a small
    table and not shuffled, and the folded deltas.  ``compact`` folds the deltas into the days that they
    touch and rewrites no other.  Base files are in order of ``layout`` within their day, so a reader that asks
    for a tenant, a device and a time opens the days of that time and the row groups of that tenant.

    Batches have numbers; one that is in the table already changes nothing, and a batch or a compaction that fails
    leaves no trace.  Rows without a key have no place in the table.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "event_id", at: str = "timestamp", layout: tuple[str, ...] = ("tenant_id", "device_id", "timestamp"), broadcast_rows: int = 1_000_000):
        self.spark, self.path, self.key, self.at, self.layout, self.most = spark, path.rstrip("/"), key, at, layout, broadcast_rows
        self.commits = Commits(spark, path)

    def append(self, rows: DataFrame, number: int) -> int:
        """Adds a batch of rows (key, seq, replayed and others) in order of arrival; returns how many changed the table."""
        state, run = self.commits.state(), f"batch-{number}"
        if run in state.runs:
            return state.runs[run]["rows"]
        batch = folded(rows.where(F.col(self.key).isNotNull())).withColumn("day", F.to_date(self.at))
        attempt = self.commits.attempt()
        changes, entries = self._unknown(batch, state), []
        told = Observation()
        changes.observe(told, F.count(F.lit(1)).alias("rows"), F.count_if("replayed").alias("replays")).write.parquet(f"{self.path}/{attempt}")
        counts = told.get
        if counts["rows"]:
            entries = [{"path": attempt, "kind": "delta", "schema": changes.schema.json(), **counts}]
        self.commits.commit(state, run, entries, info=counts)
        return counts["rows"]

    def _unknown(self, batch: DataFrame, state: State) -> DataFrame:
        """The replays of a folded batch, and of its first deliveries those whose key the table does not have.

        The table's keys meet the batch's where they lie; those that both have are shuffled, no others.
        """
        stored = self._files(state, "base"), self._files(state, "delta")
        first = batch.where("not replayed")
        known = [s.select(self.key) for s in stored if s is not None]
        if not known:
            return batch
        asked = first.select(self.key).limit(self.most + 1)
        small = F.broadcast(asked) if asked.count() <= self.most else first.select(self.key)
        met = known[0].join(small, self.key, "left_semi")
        for one in known[1:]:
            met = met.union(one.join(small, self.key, "left_semi"))
        return batch.join(met.distinct().withColumn("_known", F.lit(True)), self.key, "left").where(F.col("replayed") | F.col("_known").isNull()).drop("_known")

    def _files(self, state: State, kind: str) -> DataFrame | None:
        found = [e for e in state.entries.values() if e["kind"] == kind]
        if not found:
            return None
        schema = StructType.fromJson(json.loads(found[-1]["schema"]))
        reader = self.spark.read.schema(schema)
        if kind == "base":  # the days are folders
            reader = reader.option("basePath", f"{self.path}/data")
        return reader.parquet(*sorted(f"{self.path}/{e['path']}" for e in found)).select(*schema.names)

    def _merged(self, state: State, within: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        """The table's rows for which the narrowing ``within`` holds, by merge of base and deltas."""
        base, delta = self._files(state, "base"), self._files(state, "delta")
        if delta is None:
            return None if base is None else within(base)
        if base is not None:
            above = delta.where("replayed").select(self.key)
            replays = sum(e["replays"] for e in state.entries.values() if e["kind"] == "delta")
            kept = within(base) if not replays else within(base).join(F.broadcast(above) if replays <= self.most else above, self.key, "left_anti")
        new = within(folded(delta).select(*delta.columns))
        return new if base is None else kept.select(*new.columns).union(new)

    def read(self, tenant: str | None = None, device: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
        """The rows as they stand now, or those of a tenant, a device and a time; every bound reaches the scan of the base."""

        def within(rows: DataFrame) -> DataFrame:
            for column, value in (("tenant_id", tenant), ("device_id", device)):
                if value is not None:
                    rows = rows.where(F.col(column) == value)
            if since is not None:
                rows = rows.where((F.col(self.at) >= since) & (F.col("day") >= F.to_date(since)))
            if until is not None:
                rows = rows.where((F.col(self.at) < until) & (F.col("day") <= F.to_date(until - F.expr("INTERVAL 1 MICROSECOND"))))
            return rows

        found = self._merged(self.commits.state(), within)
        if found is None:
            raise ValueError(f"{self.path}: the table has no rows yet")
        return found.drop("day")

    def compact(self) -> int:
        """Folds the deltas into the base; returns how many days were written."""
        state = self.commits.state()
        delta, base = self._files(state, "delta"), self._files(state, "base")
        if delta is None:
            return 0
        touched = delta.select("day")
        if base is not None:
            above = delta.where("replayed").select(self.key)
            replays = sum(e.get("replays", 0) for e in state.entries.values())
            if replays:
                touched = touched.union(base.join(F.broadcast(above) if replays <= self.most else above, self.key, "left_semi").select("day"))
        days = [r["day"] for r in touched.distinct().collect()]  # as many as days
        named = {"__HIVE_DEFAULT_PARTITION__" if d is None else d.isoformat() for d in days}
        rows = self._merged(state, lambda r: r.where(F.col("day").isin([d for d in days if d is not None]) | (F.col("day").isNull() if None in days else F.lit(False))))
        attempt = self.commits.attempt()
        # in the order that the writer asks for, so it sorts no more
        rows.repartitionByRange("day", *self.layout).sortWithinPartitions("day", *self.layout).write.partitionBy("day").parquet(f"{self.path}/{attempt}")
        written = sorted(self.commits._names(attempt))
        schema = StructType([*(f for f in rows.schema if f.name != "day"), rows.schema["day"]]).json()
        entries = [{"path": f"{attempt}/{n}", "kind": "base", "day": n[4:], "schema": schema} for n in written if n.startswith("day=")]
        old = [p for p, e in state.entries.items() if e["kind"] == "delta" or e["day"] in named]
        self.commits.commit(state, None, entries, old)
        return len(entries)
