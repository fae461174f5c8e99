"""The read side: processed telemetry and anomalies by tenant, device and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import with_last


def recent(rows: DataFrame, limit: int, tenant: str | None = None, device: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """The newest rows that fit; every condition reaches the scan."""
    for column, value in (("tenant_id", tenant), ("device_id", device)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if since is not None:
        rows = rows.where(F.col("timestamp") >= since)
    if until is not None:
        rows = rows.where(F.col("timestamp") < until)
    return rows.orderBy(F.desc("timestamp"), "event_id").limit(limit)


def by_event_id(rows: DataFrame, event_id: str) -> DataFrame:
    return rows.where(F.col("event_id") == event_id)


def by_key(records: DataFrame, key: str) -> DataFrame:
    """A log's records of one key."""
    return records.where(F.col("key") == key)


def first_by(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first record of each key, by a mergeable minimum; null keys have none."""
    others = [c for c in records.columns if c != key]
    return records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")


def device_latest(rows: DataFrame) -> DataFrame:
    """Each device's last reading of each metric, ties to the larger event id."""
    keys = ["tenant_id", "device_id", "metric"]
    last = F.max_by(F.struct("timestamp", "value", "unit", "event_id"), F.struct("timestamp", "event_id"))
    return rows.groupBy(*keys).agg(last.alias("last")).select(*keys, "last.*")


def summed_by_window(rows: DataFrame, window: str, *keys: str) -> DataFrame:
    """Count, least, greatest and mean value by keys and time window."""
    grouped = rows.groupBy(*keys, F.window("timestamp", window).alias("w"))
    out = grouped.agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("w.start").alias("window_start"), "n", "least", "greatest", (F.col("total").cast("double") / F.col("n")).alias("mean"))


def heartbeat_gaps(rows: DataFrame, seconds: int) -> DataFrame:
    """Readings that come more than ``seconds`` after the device's one before; windows hold a device's readings of a day."""
    keys = {k: F.col(k) for k in ("tenant_id", "device_id")}
    out = with_last(rows, keys, ["timestamp", "event_id"], "timestamp", F.to_date("timestamp"), "previous_at")
    gap = F.timestamp_diff("SECOND", F.col("previous_at"), F.col("timestamp"))
    return out.withColumn("gap_seconds", gap).where(F.col("gap_seconds") > seconds).select("tenant_id", "device_id", "event_id", "previous_at", "timestamp", "gap_seconds")
