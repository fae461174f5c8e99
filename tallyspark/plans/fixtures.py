"""Telemetry as a view over the ``events`` table: one SQL text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The faults are dealt by these divisors. ``{q}`` quotes identifiers.
TELEMETRY = """
WITH base AS (
  SELECT event_id AS seq, event_id AS k, user_id, event_type, ts, CAST(value AS DECIMAL(18,4)) AS v, false AS replayed FROM events
  UNION ALL
  SELECT event_id + 1000000000, event_id, user_id, event_type, ts, CAST(value AS DECIMAL(18,4)) + 1, false FROM events WHERE event_id % 83 = 0
  UNION ALL
  SELECT event_id + 2000000000, event_id, user_id, event_type, ts, CAST(value AS DECIMAL(18,4)) + 2, true FROM events WHERE event_id % 89 = 0
)
SELECT
  seq, replayed,
  CASE WHEN k % 101 = 0 THEN '   '
       WHEN k % 7 = 0 THEN concat('  evt-', CAST(k AS VARCHAR(20)), chr(9))
       ELSE concat('evt-', CAST(k AS VARCHAR(20))) END AS {q}eventId{q},
  CASE WHEN k % 53 = 0 THEN '' ELSE concat('tenant-', CAST(user_id % 5 AS VARCHAR(20))) END AS {q}tenantId{q},
  'Telemetry.Reading' AS {q}eventType{q},
  CASE WHEN k % 61 = 0 THEN NULL ELSE ts END AS {q}timestamp{q},
  'sensor-gateway' AS {q}source{q},
  CASE WHEN k % 11 = 0 THEN ' ' ELSE ' 1.1 ' END AS {q}version{q},
  k % 73 <> 0 AS has_payload,
  CASE WHEN k % 73 = 0 THEN NULL WHEN k % 59 = 0 THEN '   ' ELSE concat('device-', CAST(user_id AS VARCHAR(20))) END AS {q}deviceId{q},
  CASE WHEN k % 73 = 0 THEN NULL ELSE 'Combo-Sensor' END AS {q}deviceType{q},
  CASE WHEN k % 73 = 0 THEN NULL
       WHEN event_type IN ('error','click') THEN ' Temperature '
       WHEN event_type = 'view' THEN 'humidity' ELSE 'pressure' END AS {q}metric{q},
  CASE WHEN k % 73 = 0 OR k % 67 = 0 THEN NULL
       WHEN k % 71 = 0 THEN CAST(0 AS DECIMAL(18,4))
       WHEN event_type IN ('error','click') THEN CAST(v - 60 AS DECIMAL(18,4)) ELSE CAST(v AS DECIMAL(18,4)) END AS {q}value{q},
  CASE WHEN k % 73 = 0 OR k % 79 = 0 THEN NULL ELSE ' C ' END AS {q}unit{q},
  CASE WHEN k % 73 = 0 THEN NULL ELSE concat(' zone-', CAST(user_id % 3 AS VARCHAR(20))) END AS {q}location{q}
FROM base
"""
PAYLOAD = ["deviceId", "deviceType", "metric", "value", "unit", "location"]
NOW = "2026-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    """The fixed processing time of the registered queries."""
    return F.lit(NOW).cast("timestamp_ntz")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events (seq, replayed, eventId ... version, payload) in order of arrival ``seq``; the base's three parts are one scan here."""
    _, fields = TELEMETRY.split("\n)\nSELECT")
    value = F.col("value").cast("decimal(18,4)")
    part = lambda seq, v, replayed: F.struct((F.col("event_id") + seq).alias("seq"), v.cast("decimal(19,4)").alias("v"), F.lit(replayed).alias("replayed"))
    parts = F.array(part(0, value, False), F.when(F.col("event_id") % 83 == 0, part(1_000_000_000, value + 1, False)), F.when(F.col("event_id") % 89 == 0, part(2_000_000_000, value + 2, True)))
    base = table(spark, sf_dir, "events").select(F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p"), F.col("event_id").alias("k"), "user_id", "event_type", "ts").select("p.*", "k", "user_id", "event_type", "ts")
    flat = spark.sql("SELECT" + fields.format(q="`").replace("FROM base", "FROM {base}"), base=base)
    payload = F.when(F.col("has_payload"), F.struct(*PAYLOAD))
    return flat.withColumn("payload", payload).drop("has_payload", *PAYLOAD)
