"""Where an event goes: the processed table and log, the anomaly log, or the dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import clock
from ..schema import SERVICE, WIDTHS
from .ingest import MICROS, NO_KEY, message_key
from .normalize import processed

NULL_PAYLOAD = "IllegalArgumentException: telemetry payload must not be null"


def table_row(envelope: DataFrame, now: Column | None = None, *more: str) -> DataFrame:
    """A processed envelope as a row of the table; the version is not kept."""
    p = F.col("payload")
    return envelope.select(
        *more,
        F.col("eventId").alias("event_id"),
        F.col("tenantId").alias("tenant_id"),
        F.col("eventType").alias("event_type"),
        "timestamp",
        "source",
        p["deviceId"].alias("device_id"),
        p["deviceType"].alias("device_type"),
        p["metric"].alias("metric"),
        p["value"].try_cast("decimal(18,4)").alias("value"),
        p["value"].isNotNull().alias("_had_value"),
        p["unit"].alias("unit"),
        p["location"].alias("location"),
        clock(now).alias("ingested_at"),
    )


def constraint_failure() -> Column:
    """The first rule of the table that a row breaks, or null."""
    checks = []
    for name, width in WIDTHS.items():
        checks.append(F.when(F.col(name).isNull(), F.lit(f"constraint: {name} must not be null")))
        checks.append(F.when(F.char_length(name) > width, F.lit(f"constraint: {name} is longer than {width}")))
    checks.append(F.when(~F.col("_had_value"), F.lit("constraint: value must not be null")))
    checks.append(F.when(F.col("value").isNull(), F.lit("constraint: value is out of range")))
    return F.coalesce(*checks)


def routed(detected: DataFrame, now: Column | None = None, replayed: str = "replayed") -> DataFrame:
    """Adds ``error`` and ``route``: normal, anomaly, dlq, or dropped_replay for a replay that fails again."""
    names = [c for c in detected.columns if c != "row"]
    as_row = table_row(processed(detected, now, *(F.col(c).alias(f"in_{c}") for c in names)), now, *(f"in_{c}" for c in names))
    broken = as_row.withColumn("_broken", constraint_failure())
    row = [c for c in as_row.columns if not c.startswith(("in_", "_"))]
    out = broken.select(*(F.col(f"in_{c}").alias(c) for c in names), F.struct(*row).alias("row"), "_broken")
    error = (
        F.when(F.col("payload").isNull(), F.lit(NULL_PAYLOAD))
        .when(F.col("anomalous"), F.when(message_key(F.col("eventId"), F.col("tenantId")).isNull(), F.lit(NO_KEY)))
        .otherwise(F.col("_broken"))
    )
    out = out.withColumn("error", error).drop("_broken")
    failed = F.when(F.col(replayed), "dropped_replay").otherwise("dlq")
    return out.withColumn("route", F.when(F.col("error").isNotNull(), failed).when(F.col("anomalous"), "anomaly").otherwise("normal"))


def dead_letters(routed_events: DataFrame, now: Column | None = None, *more: str) -> DataFrame:
    """Records for the dead-letter log: key (or null), the unchanged event, why and when it failed."""
    fields = ["eventId", "tenantId", "eventType", "timestamp", "source", "version", "payload"]
    out = routed_events.where("route = 'dlq'")
    return out.select(
        *more,
        message_key(F.col("eventId"), F.col("tenantId")).alias("key"),
        F.struct(*fields).alias("event"),
        F.col("error").alias("errorMessage"),
        F.lit(SERVICE).alias("sourceService"),
        clock(now).alias("failedAt"),
    )


def rendered(letters: DataFrame, *more: str) -> DataFrame:
    """(key, value, ``more``): dead letters as JSON texts."""
    return letters.select(*more, "key", F.to_json(F.struct("event", "errorMessage", "sourceService", "failedAt"), MICROS).alias("value"))
